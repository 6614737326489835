"""Hierarchical residual packing of token sequences.

1. Each document becomes pieces: its ids and an end id; only documents longer than the sequence are cut.
2. Pieces are dealt to partitions by a hash and packed best-fit there, longest first. Bins with little room left are
   emitted.
3. The other bins are the items of the next round: fewer partitions, best-fit again, emit, and so on up a tree, until
   one partition is left or a round joins nothing any more.

The number of partitions follows the number of items and of the pieces they hold, so a task holds a bounded number of
both at every size, the last one too: the tree ends above it when more stays underfull than one task should hold.

Cases: a null text is empty and gives one piece with the end id alone. Rows with the same doc_id, and repeated rows, are
packed each. Among items of equal length the one with the smaller first piece (doc_id, piece, checksum) comes first, and
of bins with equal room the one opened last is filled. Empty tables give no rows. Texts of any length are encoded whole.
Other columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import spread, tidied, whole_text
from tidewell.llm.tokenizers_io import load, public_path
from tidewell.session import stored, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = f"bin long, used long, final boolean, members array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut(flat: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """text, piece, start, length, CRC-32 of the pieces of texts whose ids stand one after the other in flat."""
    pieces = -(-sizes // capacity)
    text = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]
    start = piece * capacity
    length = np.minimum(sizes[text] - start, capacity)
    raw, begin = memoryview(flat.tobytes()), 4 * ((np.cumsum(sizes) - sizes)[text] + start)
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())), np.int64, len(text))
    return text, piece, start, length, crc


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder = load("ids", path)
        for b in batches:
            ids, done = b.column("doc_id"), 0
            for flat, sizes in encoder.columns(b.column("text"), end_id):
                text, piece, *rest = cut(flat, sizes, capacity)
                own = ids.slice(done, len(sizes)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *map(pa.array, rest)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                done += len(sizes)

    return run


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of the ids, a row for each piece of at most capacity tokens."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(tidied(_pieces(tokenizer_path, capacity, end_id)), PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes by bin: longest first, each into the fullest bin that has room; ties go to the bin opened last."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the keys of by_room, ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        if left := room - sizes[i]:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _pack(capacity: int, slack: int, turn: int):
    def run(batches):
        got = pa.Table.from_batches([b for b in batches if len(b)] or [pa.RecordBatch.from_pylist([], pa.schema([("used", pa.int64()), ("members", pa.list_(MEMBER))]))]).combine_chunks()
        if not len(got):
            return
        used, members = got["used"].to_numpy(), got["members"].combine_chunks()
        begin, flat = members.offsets.to_numpy()[:-1], members.values
        # the order of rows after a shuffle isn't fixed; the order of items here is, so a task that runs again packs alike
        head = pa.Table.from_struct_array(flat.take(pa.array(begin)))
        order = pc.sort_indices(head, [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")]).to_numpy()
        used, part = used[order], TaskContext.get().partitionId()
        bins = best_fit(used.tolist(), capacity)
        for at in range(0, len(bins), 2000):
            own = bins[at : at + 2000]
            items = np.array([i for b in own for i in b], np.int64)
            n_items = np.array([len(b) for b in own])
            held = members.take(pa.array(order[items]))
            ends = held.offsets.to_numpy()[np.cumsum(n_items)]
            total = np.add.reduceat(used[items], np.cumsum(n_items) - n_items)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[held.offsets[0].as_py()], ends]), pa.int32()), held.values)
            name = (turn << 56) + (part << 28) + np.arange(at, at + len(own))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total), pa.array(total >= capacity - slack), lists], ["bin", "used", "final", "members"])

    return run


def _placed(batches):
    """The members of bins, each with its bin and the running length before it."""
    for b in batches:
        lists = b.column("members")
        flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
        length = flat.field("length").to_numpy()
        before = np.cumsum(length) - length
        offset = before - np.repeat(before[np.cumsum(size) - size], size)
        names = [f.name for f in MEMBER]
        columns = [*[flat.field(n) for n in names], b.column("bin").take(pa.array(np.repeat(np.arange(len(b)), size))), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048, slack: int = 8, per_task: int = 20_000, fan_in: int = 8, members_per_task: int = 1_000_000) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 within each sequence.

    pieces: as document_pieces gives them. slack: room left in a bin that counts as nearly full. per_task: items that
    one task packs, which hold at most about members_per_task pieces. fan_in: how many partitions meet in one of the
    next round.
    """
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    # the first round; its rows are kept by stored(), so a lost executor never packs a piece twice
    items = pieces.select(F.col("length").alias("used"), F.array(member).alias("members"), F.xxhash64("doc_id", "piece", "ids_crc32").alias("h"))
    tasks, turn, done = spread(pieces.count(), per_task), 0, []
    while True:
        out = stored(items.repartition(tasks, "h").select("used", "members").mapInArrow(tidied(_pack(capacity, slack, turn)), BINS), "packing")
        open_bins = out.where(~F.col("final"))
        left, held = open_bins.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        fewer = max(-(-tasks // fan_in), spread(left, per_task), spread(held, members_per_task))
        if tasks == 1 or fewer >= tasks or left < 2:
            done.append(out)
            break
        done.append(out.where("final"))
        items = open_bins.select("used", "members", F.xxhash64("bin").alias("h"))
        tasks, turn = fewer, turn + 1
    return reduce(DataFrame.unionByName, done).select("bin", "members").mapInArrow(tidied(_placed), PACKED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(document_pieces(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")), "pieces")
    return pack(pieces)
