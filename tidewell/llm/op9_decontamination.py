"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments (short items are one segment). A segment of n characters that
occurs in a document with at most k = rate * n edits shares at least n - q + 1 - k q of its q-grams with it, and their
diagonals (position in the document minus position in the segment) differ by at most k. So q-grams of all documents
are looked up among those of the segments, hits are counted in diagonal bands that overlap by half, bands that reach
the bound are kept, and a banded alignment decides.

Both sides are lower-cased and runs of white space become one space; positions refer to that form of the text.

* A segment too short for its edits to leave a q-gram of q characters whole (13 to 19 characters with one edit, say) is
  looked up by shorter ones, of n // (k + 1) characters, of which one stays whole whatever the edits. Segments are indexed
  by the length of their q-grams.
* q-grams that very many segments hold are left out for segments whose bound stays above 0 without them (the bound goes
  down by as many), and hits are counted tile by tile along the text, so frequent q-grams cost neither links nor memory.
* An item of fewer than q characters is looked up whole, without edits; it counts where it doesn't begin or end within
  a word (of letters with case, or digits).
* The segments are dealt to blocks of about `block_chars` characters, and a Spark job indexes each block once, into a file
  of sorted arrays in the shared folder. A task reads its documents once, about `text_chars` characters at a time, and loads
  the blocks in turn (it never builds one); the driver knows their number alone.

Cases: null or empty texts have no regions; items without text have no segments, items with a null id are left out.
Repeated rows give a row each; items with equal texts are all reported. Regions of an item that touch are one, with the
least edits of its parts. Empty tables give no rows. Other columns of the documents are ignored by contaminated() and
kept as they are by clean(), whatever their names.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import filesystem, spread, tidied, worker_cache
from tidewell.session import new_path, table

REGIONS = "doc_id long, item_id long, start long, stop long, edits long, segment_chars long"
BITS = 22
#: Segments beyond which a q-gram counts as frequent; hits that are counted at once.
FREQUENT, TILE_HITS = 64, 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash for each q-gram, by doubling: the hash of 2m characters comes from two of m."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    own, width, power = c.astype(np.uint64) + np.uint64(1), 1, base
    out, used = None, 0
    rest = q
    while rest:
        if rest & 1:
            if out is None:
                out = own
            else:  # append this part after what is there
                m = min(len(out), len(own) - used)
                out = out[:m] * np.uint64(power) + own[used : used + m]
            used += width
        rest >>= 1
        if rest:
            own = own[:-width] * np.uint64(power) + own[width:]
            width, power = 2 * width, power * power % (1 << 64)
    out = out[:n].copy()
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def segments(items: list[tuple], size: int, stride: int) -> list[tuple]:
    """(item_id, text) of each segment; the last one of an item ends with it."""
    out = []
    for item_id, text in items:
        t = normalise(text)
        if len(t) <= size + stride // 2:
            out += [(item_id, t)] if t else []
        else:
            starts = [*range(0, len(t) - size, stride), len(t) - size]
            out += [(item_id, t[s : s + size]) for s in starts]
    return out


def gram_length(n: int, q: int, rate: float) -> int:
    """The q-grams that a segment of n characters is looked up by."""
    edits = int(rate * n)
    return q if n < q or n >= q * (edits + 1) else max(1, n // (edits + 1))


class Index:
    """A block of segments, given as (item_id, text), by the length of their q-grams."""

    def __init__(self, segs: list[tuple], q: int, rate: float):
        by: dict[int, list[tuple]] = {}
        for item, text in segs:
            by.setdefault(gram_length(len(text), q, rate), []).append((item, text))
        self.q, self.parts = q, [GramIndex(own, g, rate) for g, own in sorted(by.items())]

    def save(self, f) -> None:
        """Arrays and dicts, without classes of this module."""
        pickle.dump((self.q, [vars(p) for p in self.parts]), f, protocol=5)

    @classmethod
    def load(cls, f) -> Index:
        index = cls.__new__(cls)
        index.q, index.parts = pickle.load(f)
        index.parts = [GramIndex.of(p) for p in index.parts]
        return index


class GramIndex:
    """The q-grams of segments; those of fewer than q characters are kept whole."""

    def __init__(self, segs: list[tuple], q: int, rate: float):
        self.q = q
        owners: dict[str, set[int]] = {}
        for item, text in segs:
            owners.setdefault(text, set()).add(item)
        strings = sorted(owners)
        known = [sorted(owners[t]) for t in strings]
        self.owner = np.array([i for own in known for i in own], np.int64)
        self.owner_end = np.cumsum([len(own) for own in known], dtype=np.int64)
        texts = [code_points(t) for t in strings]
        self.codes = np.concatenate([*texts, np.zeros(0, np.uint32)])
        self.length = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.length)
        # whole items have no edits; for all others at least one shared q-gram is left by the bound
        self.budget = np.where(self.length < q, 0, (rate * self.length).astype(np.int64))
        bound = np.maximum(1, self.length - q + 1 - self.budget * q)
        grams = [gram_hashes(t, q) for t in texts]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        seg = np.repeat(np.arange(len(strings)), [len(g) for g in grams])
        pos = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)]).astype(np.int64)
        _, back, many = np.unique(h, return_inverse=True, return_counts=True)
        frequent = many[back] > FREQUENT if len(h) else np.zeros(0, bool)
        n_frequent = np.bincount(seg[frequent], minlength=len(strings))
        spare = bound > n_frequent
        self.bound = np.where(spare, bound - n_frequent, bound)
        keep = ~(frequent & spare[seg])
        h, seg, pos = h[keep], seg[keep], pos[keep]
        order = np.argsort(h, kind="stable")
        self.seg, self.pos = seg[order], pos[order]
        self.hashes, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.hashes >> np.uint64(64 - BITS)] = True
        self.reach = int((self.length + 2 * self.budget).max(initial=0)) + 2  # no band's hits lie farther apart
        # items of fewer than q characters, by length
        self.short = {int(n): {self.text(s).tobytes(): int(s) for s in np.flatnonzero(self.length == n)} for n in np.unique(self.length[self.length < q])}

    @classmethod
    def of(cls, values: dict) -> GramIndex:
        part = cls.__new__(cls)
        vars(part).update(values)
        return part

    def __len__(self) -> int:
        return len(self.length)

    def text(self, s: int) -> np.ndarray:
        return self.codes[self.ends[s] - self.length[s] : self.ends[s]]

    def owners(self, s: int) -> list[int]:
        return self.owner[self.owner_end[s - 1] if s else 0 : self.owner_end[s]].tolist()

    def tiles(self, h: np.ndarray):
        """(first position, end, positions, segments, positions in the segments) of shared q-grams, a tile at a time.

        A tile counts the bands that begin in it, so it holds the hits of the next `reach` positions too.
        """
        if not len(self.hashes):
            return
        at = np.flatnonzero(self.table[h >> np.uint64(64 - BITS)])
        found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[found] == h[at]
        at, found = at[same], found[same]
        ends = np.cumsum(self.many[found])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TILE_HITS, "right")))
            begin = -1 << 40 if lo == 0 else int(at[lo])
            end = int(at[hi]) if hi < len(at) else 1 << 40
            to = int(np.searchsorted(at, end + self.reach)) if hi < len(at) else len(at)
            f = found[lo:to]
            n = self.many[f]
            place = np.repeat(self.first[f] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield begin, end, np.repeat(at[lo:to], n), self.seg[place], self.pos[place]
            lo = hi


def banded_alignment(patterns: np.ndarray, lengths: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, fixed: np.ndarray | None = None):
    """Fewest edits of each pattern against text along the diagonals low .. low + width - 1, and where that ends.

    patterns: rows of code points, padded; any start in the band is free unless fixed gives its column. Positions
    outside the text match nothing.
    """
    n, far = len(patterns), 1 << 20
    columns = np.arange(width)
    if fixed is None:
        d = np.zeros((n, width), np.int32)
    else:
        d = np.where(columns[None] >= fixed[:, None], columns[None] - fixed[:, None], far).astype(np.int32)
    best, end = np.full(n, far, np.int32), np.zeros(n, np.int64)
    for i in range(int(lengths.max(initial=0))):
        at = low[:, None] + i + columns[None]
        inside = (at >= 0) & (at < len(text))
        cost = ~(inside & (text[np.clip(at, 0, len(text) - 1)] == patterns[:, i][:, None]))
        new = d + cost
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(new - columns[None], axis=1) + columns[None]
        if (done := lengths == i + 1).any():
            j = d[done].argmin(1)
            best[done], end[done] = d[done][np.arange(len(j)), j], low[done] + i + 1 + j
    return best, end


def _exact(index: GramIndex, text: bytes, s: int, band: int) -> int:
    """Where segment s stands unchanged with its diagonal in the band, or -1; text: code points of 4 bytes."""
    step = int(index.budget[s]) + 1
    low, high = max(0, band * step), band * step + 2 * step - 1 + int(index.length[s])
    at = text.find(index.text(s).tobytes(), 4 * low, 4 * max(0, high))
    return -1 if at < 0 else at // 4 if at % 4 == 0 else -2


def _verify(index: GramIndex, text: np.ndarray, seg: np.ndarray, band: np.ndarray) -> list[tuple]:
    """(segment, start, stop, edits) of the bands that hold an occurrence; text: one document's code points.

    Most are unchanged copies, which a search of the band finds; the alignment decides about the others.
    """
    raw = text.tobytes()
    same = np.array([_exact(index, raw, s, b) for s, b in zip(seg.tolist(), band.tolist())], np.int64)
    out = [(s, at, at + int(index.length[s]), 0) for s, at in zip(seg[same >= 0].tolist(), same[same >= 0].tolist())]
    # a band that holds an unchanged copy needs no second look; other bands of its segment may hold copies of their own
    rest = same < 0
    seg, band = seg[rest], band[rest]
    k = index.budget[seg]
    for budget in np.unique(k):
        every = np.flatnonzero(k == budget)
        for at in range(0, len(every), 2048):
            own = every[at : at + 2048]
            out += _aligned(index, text, seg[own], band[own], int(budget))
    return out


def _aligned(index: GramIndex, text: np.ndarray, seg: np.ndarray, band: np.ndarray, budget: int) -> list[tuple]:
    step, lengths = budget + 1, index.length[seg]
    pad = np.zeros((len(seg), int(lengths.max())), np.uint32)
    for row, x in enumerate(seg):
        pad[row, : lengths[row]] = index.text(x)
    edits, stop = banded_alignment(pad, lengths, text, band * step - budget, 2 * step + 2 * budget)
    good = edits <= budget
    if not good.any():
        return []
    seg, lengths, edits, stop, pad = seg[good], lengths[good], edits[good], stop[good], pad[good]
    # the start: the reversed pattern along the reversed text, from the end that was found
    back = np.zeros_like(pad)
    for row in range(len(pad)):
        back[row, : lengths[row]] = pad[row, : lengths[row]][::-1]
    _, reach = banded_alignment(back, lengths, text[::-1], len(text) - stop - budget, 2 * budget + 1, np.full(len(seg), budget))
    # places outside the text match nothing, so leaving them out changes no count of edits
    return list(zip(seg.tolist(), np.maximum(len(text) - reach, 0).tolist(), np.minimum(stop, len(text)).tolist(), edits.tolist()))


def _in_word(a: str, b: str) -> bool:
    """Whether two characters beside each other belong to one word."""
    return all(x.isdigit() or x.lower() != x.upper() for x in (a, b))


def _short_items(index: GramIndex, joined: np.ndarray, begin: np.ndarray, texts: list[str]):
    """(document, segment, start) of the items of fewer than q characters."""
    for n, known in index.short.items():
        own = np.array(sorted(gram_hashes(np.frombuffer(t, np.uint32), n)[0] for t in known), np.uint64)
        h = gram_hashes(joined, n)
        for at in np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h).tolist():
            if (s := known.get(joined[at : at + n].tobytes())) is not None:
                d = int(np.searchsorted(begin, at, "right")) - 1
                start, text = at - int(begin[d]), texts[d]
                if not (start and _in_word(text[start - 1], text[start])) and not (start + n < len(text) and _in_word(text[start + n - 1], text[start + n])):
                    yield d, s, start


def joined_regions(regions: list[tuple]) -> list[tuple]:
    """(item, start, stop, edits, segment_chars): those of an item that overlap are one."""
    out: list[tuple] = []
    for item, start, stop, edits, length in sorted(regions):
        if out and out[-1][0] == item and start <= out[-1][2]:
            old = out[-1]
            out[-1] = (item, old[1], max(old[2], stop), min(old[3], edits), max(old[4], length))
        else:
            out.append((item, start, stop, edits, length))
    return out


def regions_of(index: Index, texts: list[str]) -> list[list[tuple]]:
    """The regions of each text: (item, start, stop, edits, segment_chars)."""
    strings = [normalise(t) for t in texts]
    own = [code_points(t) for t in strings]
    gap = np.full(index.q, 0x110000, np.uint32)  # no q-gram of a text reaches into the next
    joined = np.concatenate([x for t in own for x in (t, gap)]) if own else np.zeros(0, np.uint32)
    begin = np.cumsum([0] + [len(t) + index.q for t in own])[:-1]
    regions: list[list[tuple]] = [[] for _ in texts]
    for part in index.parts:
        for d, found in _found(part, strings, own, joined, begin).items():
            regions[d] += [(i, start, stop, edits, int(part.length[s])) for s, start, stop, edits in found for i in part.owners(s)]
    return [joined_regions(r) for r in regions]


def _found(index: GramIndex, strings: list[str], own: list[np.ndarray], joined: np.ndarray, begin: np.ndarray) -> dict[int, list[tuple]]:
    """(segment, start, stop, edits) of what each text, by its number, holds of an index."""
    found: dict[int, list[tuple]] = {}
    for d, s, start in _short_items(index, joined, begin, strings):
        found.setdefault(d, []).append((s, start, start + int(index.length[s]), 0))
    for first, end, at, seg, pos in index.tiles(gram_hashes(joined, index.q)):
        doc = np.searchsorted(begin, at, "right") - 1
        step = index.budget[seg] + 1
        band = (at - begin[doc] - pos) // step
        # a diagonal lies in the band that starts with its own stripe and in the one before
        doc, seg, band, step = np.concatenate([doc, doc]), np.concatenate([seg, seg]), np.concatenate([band, band - 1]), np.concatenate([step, step])
        place = begin[doc] + band * step
        mine = (place >= first) & (place < end)
        doc, seg, band = doc[mine], seg[mine], band[mine]
        if not len(doc):
            continue
        low = int(band.min())
        span = int(band.max()) - low + 1
        key, n = np.unique((doc * len(index) + seg) * span + (band - low), return_counts=True)
        doc, seg, band = key // span // len(index), key // span % len(index), key % span + low
        keep = n >= index.bound[seg]
        doc, seg, band = doc[keep], seg[keep], band[keep]
        for d in np.unique(doc).tolist():
            found.setdefault(d, []).extend(_verify(index, own[d], seg[doc == d], band[doc == d]))
    return found


def pieces_of(texts: list[str], size: int = 1_500_000):
    """Runs of texts of about size characters."""
    own, held = [], 0
    for t in texts:
        if own and held + len(t) > size:
            yield own
            own, held = [], 0
        own.append(t)
        held += len(t)
    if own:
        yield own


def _cut(size: int, stride: int):
    def run(batches):
        for b in batches:
            segs = segments(list(zip(b.column("item_id").to_pylist(), b.column("text").to_pylist())), size, stride)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in segs], pa.int64()), pa.array([t for _, t in segs], pa.string())], ["item_id", "text"])

    return run


class Blocks:
    """The index of a benchmark in the shared folder, in blocks of about block_chars characters of segments.

    A task of one Spark job builds each block; a lost task builds it again, to the same bytes, under a name of its own
    that takes the block's name when it is complete.
    """

    def __init__(self, benchmark: DataFrame, q: int, rate: float, size: int, stride: int, block_chars: int):
        known = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
        # neighbouring segments overlap, so there are about size / stride times as many characters
        self.n, self.q, self.rate = spread(chars * max(1, size // stride), block_chars), q, rate
        self.path = new_path(benchmark.sparkSession, "benchmark")
        segs = known.mapInArrow(_cut(size, stride), "item_id long, text string").distinct()
        block = F.pmod(F.xxhash64("text"), F.lit(self.n)).cast("int")
        dealt = segs.withColumn("block", block).repartition(self.n, "block")
        self.built = dealt.groupBy("block").applyInPandas(lambda frame: self._build(frame), "block int, segments long").agg(F.count("*")).first()[0]

    def _build(self, frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        own = f"{root}/{uuid.uuid4().hex}"
        with files.open_output_stream(own) as f:
            Index(list(zip(frame["item_id"].tolist(), frame["text"].tolist())), self.q, self.rate).save(f)
        files.move(own, f"{root}/{block}")
        return pd.DataFrame({"block": [block], "segments": [len(frame)]})

    def index(self, block: int) -> Index:
        """In a task: the q-grams of a block; the last one is kept by the worker."""

        def load():
            from pyarrow import fs

            files, path = filesystem(f"{self.path}/{block}")
            if files.get_file_info(path).type == fs.FileType.NotFound:  # a block without segments
                return Index([], self.q, self.rate)
            with files.open_input_stream(path) as f:
                return Index.load(f)

        return worker_cache(("benchmark", self.path, block), load, alone=True)

    def regions(self, texts: list[str]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        for block in range(self.n):
            index, done = self.index(block), 0
            for part in pieces_of(texts):
                for found in regions_of(index, part):
                    out[done] += found
                    done += 1
        return [joined_regions(x) for x in out] if self.n > 1 else out


def held_back(batches, text_at: int, text_chars: int):
    """(batches, texts) of about text_chars characters together, so that each block is taken once for many texts."""
    held, texts, chars = [], [], 0
    for b in batches:
        own = [t or "" for t in b.column(text_at).to_pylist()]
        held.append(b)
        texts += own
        chars += sum(map(len, own))
        if chars >= text_chars:
            yield held, texts
            held, texts, chars = [], [], 0
    if held:
        yield held, texts


def _search(blocks: Blocks, text_chars: int):
    def run(batches):
        for held, texts in held_back(batches, 1, text_chars):
            ids = [d for b in held for d in b.column(0).to_pylist()]
            rows = [(d, *r) for d, regions in zip(ids, blocks.regions(texts)) for r in regions]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start", "stop", "edits", "segment_chars"])

    return run


def _without(blocks: Blocks, text_at: int, text_chars: int):
    def run(batches):
        for held, texts in held_back(batches, text_at, text_chars):
            keep, done = [not found for found in blocks.regions(texts)], 0
            for b in held:
                yield b.filter(pa.array(keep[done : done + len(b)], pa.bool_()))
                done += len(b)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, size: int = 80, stride: int = 40, block_chars: int = 8_000_000, text_chars: int = 6_000_000) -> DataFrame:
    """A row for each region of a document that holds a segment of a benchmark item within the edit budget."""
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(tidied(_search(Blocks(benchmark, q, rate, size, stride, block_chars), text_chars)), REGIONS)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, size: int = 80, stride: int = 40, block_chars: int = 8_000_000, text_chars: int = 6_000_000) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no region; null texts hold none. No document is shuffled."""
    blocks = Blocks(benchmark, q, rate, size, stride, block_chars)
    return docs.mapInArrow(tidied(_without(blocks, docs.columns.index("text"), text_chars)), docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
