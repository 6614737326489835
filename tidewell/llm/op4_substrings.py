"""Exact removal of byte strings that repeat across documents.

The method dealt (a Burrows-Wheeler transform of the collection that grows by one symbol of every document a round)
doesn't fit the limits, even over short overlapping pieces of the documents; the README gives the reckoning. This is
another method with the same result: content-defined anchors, resolved by shuffles of packed arrays.

* The hash of every `GRAM`-byte string is taken; in each window of `LENGTH` bytes the smallest hash marks an anchor.
  Equal windows have their anchor at the same place, so whether a window repeats is decided among the occurrences of
  its anchor's string.
* Round 1 compares the whole surroundings of an anchor (all windows that can hold it). An occurrence whose
  surroundings stand in a smaller document is removed with them. One whose string stands nowhere else, or always in
  the same surroundings and in no smaller document, stays. The others, whose surroundings agree in part, are open.
* Round 2 compares the single windows of the open anchors.

Within a batch of documents an occurrence that a smaller document of the batch settles isn't sent, nor are more than
`PER_BATCH` surroundings of a string: a mark takes their place, and all that is left of a marked string is open. So a
string of any frequency gives a bounded number of entries a batch in round 1. Entries travel as arrays, a row for each
batch and bucket that has any; the number of buckets follows the bytes of the input. A string that stands in very many
batches would still fill its bucket, so a bucket takes its rows as a stream: it settles them in pieces of bounded size,
keeps the distinct entries only, and of no string more than `GROUP_BATCHES` batches may send; if there are more, all are
open. Entries are shuffled once and stored nowhere else, however many batches there are.

Hashes stand for the strings: of 88 bits in round 1 and 96 bits in round 2, within the entries of one bucket. Among
n entries of a round a false match has a probability of at most n^2 / 2^89 (2^97); for 100 TB, with 7e12 anchors and
bits that the bucket already fixes not counted, that is about 0.1 expected false matches of surroundings in the run.

Cases: null texts are empty; texts under `LENGTH` bytes lose nothing. Rows with the same doc_id don't count as smaller
than each other, and each gets its own result (a hash of the text keeps them apart); repeated rows have equal results. A
null doc_id neither loses bytes nor takes them. Empty tables give no rows. A text of n bytes takes about 80 n bytes in
its task. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import tidied, whole_text
from tidewell.llm.op9_decontamination import gram_hashes
from tidewell.llm.shingles import mix64
from tidewell.session import stored, table

LENGTH, GRAM = 50, 22
REACH = LENGTH - GRAM  # how far the windows of an anchor go to its left, and beyond its string to its right
#: The windows of an anchor in four groups, by how far they begin to its left; what all windows of a group share is
#: at most two strings long, so two hashes tell it.
GROUPS = [(0, 6), (7, 13), (14, 20), (21, REACH)]
assert all(LENGTH - (b - a) <= 2 * GRAM for a, b in GROUPS)
_GROUP_OF = np.repeat(np.arange(len(GROUPS), dtype=np.uint8), [b - a + 1 for a, b in GROUPS])
#: Bytes of text that are settled at once in a task.
BATCH_BYTES = 8_000_000
#: Surroundings of one string that a batch sends; the others are open at once, and a mark tells the bucket of the string
#: that there are more, so that what other batches sent of it is open too.
PER_BATCH = 64
#: A bucket keeps as many surroundings of a string as so many batches may send; a string that has more is open.
GROUP_BATCHES = 1000
#: A bucket settles so many times that number of entries at once, over twice its share; only fuller ones take pieces.
PIECE = 16
#: Bytes of rows that wait for their answers in memory; beyond, they wait in a temporary file of the task.
WAITING_BYTES = 32_000_000
STAY, REMOVE, ASK = 0, 1, 3
#: OPEN plus a bit for each group of windows that is open.
OPEN, ALL_GROUPS = 16, 15
_NUMBERS = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.int64)

ENTRY = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("e", "<u4"), ("tests", "u1", (4,))])
WINDOW = np.dtype([("h", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("e", "<u4")])
#: Bytes of each hash that travel: 88 bits tell a string with its surroundings, 96 a window.
SENT = {"a": 6, "c": 5, "h": 8, "check": 4, "tests": 4}


def pack(entries: np.ndarray) -> bytes:
    """Column by column; the documents and indexes, which ascend, as differences, byte plane by byte plane."""
    parts = [np.array([len(entries)], "<i8").tobytes()]
    for name in entries.dtype.names:
        col = np.ascontiguousarray(entries[name])
        if name in SENT:
            parts.append(np.ascontiguousarray(col.view(np.uint8).reshape(len(col), -1)[:, -SENT[name] :]).tobytes())
        else:
            steps = np.diff(col.astype("<i8"), prepend=np.int64(0))
            parts.append(np.ascontiguousarray(steps.view(np.uint8).reshape(len(col), 8).T).tobytes())
    return b"".join(parts)


def unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = int(np.frombuffer(data, "<i8", 1)[0]), 8
    out = np.zeros(n, dtype)
    for name in dtype.names:
        if name in SENT:
            width = dtype[name].itemsize
            full = np.zeros((n, width), np.uint8)
            full[:, width - SENT[name] :] = np.frombuffer(data, np.uint8, n * SENT[name], at).reshape(n, -1)
            out[name] = full if name == "tests" else full.view(dtype[name]).ravel()
            at += n * SENT[name]
        else:
            planes = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T
            out[name] = np.cumsum(np.ascontiguousarray(planes).view("<i8").ravel())
            at += 8 * n
    return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for each i, by doubling."""
    own, w = x, 1
    while 2 * w <= width:
        own = f(own[:-w], own[w:])
        w *= 2
    return f(own[: len(x) - width + 1], own[width - w : width - w + len(x) - width + 1]) if width > w else own


class Block:
    """Anchors of several texts at once. Texts under LENGTH bytes have none."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.int64)
        if len(data) < LENGTH:
            return
        # the numbers of bytes are scrambled first; all hashes of strings that reach into the next text are dropped
        self.hash = gram_hashes(_NUMBERS[data].view(np.uint64), GRAM)
        ends = np.repeat(self.begin + self.sizes, self.sizes)
        self.ok = ends[: len(data) - LENGTH + 1] - np.arange(len(data) - LENGTH + 1) >= LENGTH
        self.low = np.where(self.ok, _sliding(self.hash, REACH + 1, np.minimum), np.uint64(0))
        padded = np.concatenate([np.zeros(REACH, np.uint64), self.low, np.zeros(REACH, np.uint64)])
        most = _sliding(padded, REACH + 1, np.maximum)
        self.at = np.flatnonzero((most[: len(self.hash)] == self.hash) & (most[: len(self.hash)] > 0))
        self.text = np.searchsorted(self.begin + self.sizes, self.at, "right")

    def surroundings(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor a hash of all bytes within its windows, and a byte for what each group of windows shares.

        Where a document has no window of a group, its byte is 0; else it is between 1 and 255.
        """
        lo, hi = self.begin[self.text], (self.begin + self.sizes)[self.text]
        left, right = np.minimum(self.at - lo, REACH), np.minimum(hi - self.at - GRAM, REACH)
        c = (left * 64 + right).astype(np.uint64)
        first, last = self.at - left, self.at + right  # the first and last strings of the surroundings
        for place in (first, np.minimum(first + GRAM, last), np.minimum(first + 2 * GRAM, last), last):
            c = mix64(c * np.uint64(0x9E3779B97F4A7C15) + self.hash[place])
        tests = np.zeros((len(self.at), len(GROUPS)), np.uint8)
        for g, (near, far) in enumerate(GROUPS):
            start, end = self.at - near, self.at - far + LENGTH
            there = np.flatnonzero((start >= lo) & (end <= hi))
            shared = mix64(self.hash[start[there]] * np.uint64(0x9E3779B97F4A7C15) + self.hash[end[there] - GRAM])
            tests[there, g] = shared % np.uint64(255) + np.uint64(1)
        return c, tests

    def windows(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash and check of the open windows: the leftmost smallest hash of a window is its anchor, and the
        anchor's state tells whether the group of the window is open."""
        chosen = states >= OPEN
        starts = np.unique((self.at[chosen][:, None] - np.arange(REACH + 1)[None]).ravel())
        starts = starts[(starts >= 0) & (starts < len(self.ok))] if len(starts) else starts
        starts = starts[self.ok[starts]] if len(starts) else starts
        place = np.searchsorted(self.at, starts)
        while (wrong := self.hash[self.at[place]] != self.low[starts]).any() if len(starts) else False:
            place[wrong] += 1
        group = _GROUP_OF[self.at[place] - starts]
        starts = starts[chosen[place] & (states[place] >> group & 1 == 1)]
        parts = [self.hash[starts], self.hash[starts + GRAM], self.hash[starts + REACH]]
        h, check = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for p in parts:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p)
            check = mix64(check * np.uint64(0xC2B2AE3D27D4EB4F) ^ p)
        return starts, h, (check >> np.uint64(32)).astype(np.uint32)


def blocks(texts: list[bytes], size: int = 1_000_000):
    """(first index, Block) over runs of texts of about size bytes."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held += len(texts[to])
            to += 1
        yield at, Block(texts[at:to])
        at = to


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any of the sorted keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _batch_rows(frames, settle, size: int):
    """Cuts frames into batches of about size characters, sorts each by doc_id, and yields what settle gives.

    A batch is named by task and number. Its rows are sent through shuffles that are read once, into stored tables, so
    a task that runs again may name its batches as it likes.
    """
    counter = 0
    for frame in frames:
        chars = frame["text"].str.len().to_numpy(np.int64)
        which = (np.cumsum(chars) - chars) // size
        for _, part in frame.groupby(which, sort=True):
            part = part.sort_values(["doc_id", "copy"], ignore_index=True)
            yield from settle(TaskContext.get().partitionId() << 24 | counter, part)
            counter += 1


def _dealt(batch: int, entries: np.ndarray, key: np.ndarray, buckets: int, kind: str = "ask", packed=pack):
    """A row (bucket, batch, kind, data) for each bucket that gets entries; the others take no step."""
    where = (key >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    cut = np.append(np.flatnonzero(_first_of_runs(where[order])), len(order))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(where[order[lo]]), batch, kind, packed(entries[order[lo:hi]])


ROWS = "bucket long, batch long, kind string, data binary"


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "batch", "kind", "data"])


def _own(batch: int, docs: np.ndarray, copies: np.ndarray, counts: np.ndarray, states: np.ndarray, same: np.ndarray, buckets: int) -> tuple:
    """The row that tells what a batch is made of: its documents, and what it knows of their entries itself."""
    head = np.array([len(docs), len(states), len(same)], "<i8")
    data = b"".join([head.tobytes(), docs.astype("<i8").tobytes(), copies.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), same.astype("<u4").tobytes(), states.astype(np.uint8).tobytes()])
    return batch % buckets, batch, "own", data


def _unpack_own(data: bytes):
    n, m, s = np.frombuffer(data, "<i8", 3)
    ints = np.frombuffer(data, "<i8", 3 * n, 24)
    at = 24 + 24 * int(n)
    same = np.frombuffer(data, "<u4", 2 * s, at).reshape(-1, 2)
    return ints[:n], ints[n : 2 * n], ints[2 * n :], same, np.frombuffer(data, np.uint8, m, at + 8 * int(s)).copy()


def _round_1(buckets: int, batch_bytes: int, per_batch: int):
    def settle(batch, frame):
        texts = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
        docs = frame["doc_id"].to_numpy(np.int64)
        counts, parts = np.zeros(len(texts), np.int64), []
        for first, block in blocks(texts):
            if len(block.at):
                c, tests = block.surroundings()
                e = np.zeros(len(block.at), ENTRY)
                e["a"], e["c"], e["tests"], e["doc"] = block.hash[block.at], c, tests, docs[first + block.text]
                parts.append(e)
                counts += np.bincount(first + block.text, minlength=len(texts))
        entries = np.concatenate([*parts, np.zeros(0, ENTRY)])
        entries["e"] = np.arange(len(entries))
        states = np.full(len(entries), ASK, np.uint8)
        # entries stand in the order of doc_id, so the first of equal surroundings is the smallest document's
        order = np.argsort(mix64(entries["a"] ^ mix64(entries["c"].copy())), kind="stable")
        s = entries[order]
        first = _first_of_runs(s["a"], s["c"])
        owner = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        states[order[~first & (s["doc"] > s["doc"][owner])]] = REMOVE
        repeat = ~first & (s["doc"] == s["doc"][owner])
        same = np.column_stack([order[repeat], order[owner[repeat]]])
        sent = np.sort(order[first])
        by_string = sent[np.argsort(entries["a"][sent], kind="stable")]
        begins = _first_of_runs(entries["a"][by_string])
        rank = np.arange(len(by_string)) - np.maximum.accumulate(np.where(begins, np.arange(len(by_string)), 0))
        states[by_string[rank >= per_batch]] = OPEN + ALL_GROUPS
        cut = np.unique(entries["a"][by_string[rank >= per_batch]])
        states[same[:, 0]] = STAY  # until it is copied from the first of the document
        keep = np.sort(by_string[rank < per_batch])
        marks = _dealt(batch, cut, cut, buckets, "cut", lambda a: a.astype("<u8").tobytes())
        yield _frame([*_dealt(batch, entries[keep], entries["a"][keep], buckets), *marks, _own(batch, docs, frame["copy"].to_numpy(np.int64), counts, states, same, buckets)])

    return lambda frames: _batch_rows(frames, settle, batch_bytes)


class Bucket:
    """Settles the entries of a bucket, piece by piece if they are many.

    In memory are a piece and the distinct entries of all pieces so far, each with its smallest document. The rows of
    pieces wait for their answers until all have been seen. A string of more than `most` surroundings isn't kept.
    """

    def __init__(self, kind: str, most: int, piece: int):
        self.dtype, self.keys, self.settle = (ENTRY, ("a", "c"), _settle_surroundings) if kind == "surroundings" else (WINDOW, ("h", "check"), _settle_windows)
        self.most, self.piece = most, piece
        self.rows, self.held = [], 0
        self.known, self.over, self.cuts = np.zeros(0, self.dtype), np.zeros(0, "<u8"), np.zeros(0, "<u8")
        self.waiting = None

    def add(self, batch: int, data: bytes) -> None:
        self.rows.append((batch, data))
        self.held += int(np.frombuffer(data, "<i8", 1)[0])
        if self.held >= self.piece:
            self._take()

    def _take(self) -> None:
        """Takes the distinct entries of the piece into the known ones, and lets its rows wait."""
        e = np.concatenate([self.known, *(unpack(d, self.dtype) for _, d in self.rows)])
        k0, k1 = self.keys
        e = e[~np.isin(e[k0], self.over)]
        e = e[np.lexsort((e["doc"], e[k1], e[k0]))]
        self.known = e[_first_of_runs(e[k0], e[k1])]
        if self.dtype == ENTRY:
            strings, counts = np.unique(self.known["a"], return_counts=True)
            self.over = np.union1d(self.over, strings[counts > self.most])
            self.known = self.known[~np.isin(self.known["a"], self.over)]
        self.waiting = self.waiting or tempfile.SpooledTemporaryFile(max_size=WAITING_BYTES)
        for batch, data in self.rows:
            self.waiting.write(np.array([batch, len(data)], "<i8").tobytes() + data)
        self.rows, self.held = [], 0

    def _waited(self):
        """The rows that waited, in runs of about a piece."""
        self.waiting.seek(0)
        rows, held = [], 0
        while head := self.waiting.read(16):
            batch, size = np.frombuffer(head, "<i8").tolist()
            rows.append((batch, self.waiting.read(size)))
            held += int(np.frombuffer(rows[-1][1], "<i8", 1)[0])
            if held >= self.piece:
                yield rows
                rows, held = [], 0
        yield rows
        self.waiting.close()

    def _looked_up(self, e: np.ndarray, known_state: np.ndarray) -> np.ndarray:
        """The state of each entry, by the known ones; entries of strings that weren't kept are open."""
        n, both = len(self.known), np.concatenate([self.known, e])
        order = np.lexsort((np.arange(len(both)) >= n, both[self.keys[1]], both[self.keys[0]]))
        first = _first_of_runs(*(both[k][order] for k in self.keys))
        owner = np.empty(len(both), np.int64)
        owner[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(both)), 0))]
        owner = owner[n:]
        state = np.full(len(e), OPEN + ALL_GROUPS, np.uint8)
        kept = np.flatnonzero(owner < n)
        owner = owner[kept]
        state[kept] = np.where(e["doc"][kept] > self.known["doc"][owner], REMOVE, known_state[owner])
        return state

    def answers(self):
        """Runs of rows (batch, entries, their states)."""
        if self.waiting is not None:
            self._take()
            known_state = self.settle(self.known, self.cuts)
        for rows in [self.rows] if self.waiting is None else self._waited():
            parts = [unpack(d, self.dtype) for _, d in rows]
            e, at = np.concatenate([np.zeros(0, self.dtype), *parts]), np.cumsum([0] + [len(x) for x in parts])
            state = self.settle(e, self.cuts) if self.waiting is None else self._looked_up(e, known_state)
            yield [(b, e[lo:hi], state[lo:hi]) for (b, _), lo, hi in zip(rows, at[:-1], at[1:])]


def _answer(kind: str, most: int, piece: int):
    """The answers of a bucket: a row for each batch that asked, with the indexes of entries by state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(kind, most, piece)
        for frame in frames:
            yield _frame([(b, b, "own", d) for b, d in frame.loc[frame["kind"] == "own", ["batch", "data"]].itertuples(index=False)])
            bucket.cuts = np.union1d(bucket.cuts, np.frombuffer(b"".join(frame.loc[frame["kind"] == "cut", "data"]), "<u8"))
            for b, d in frame.loc[frame["kind"] == "ask", ["batch", "data"]].itertuples(index=False):
                bucket.add(b, d)
        for answers in bucket.answers():
            rows = []
            for b, e, state in answers:
                told = np.flatnonzero(state != STAY)
                rows.append((b, b, "told", e["e"][told].astype("<u4").tobytes() + state[told].tobytes()))
            yield _frame(rows)

    return run


def _settle_surroundings(e: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """cuts: strings of which some batch has more surroundings than it sent."""
    order = np.lexsort((e["doc"], e["c"], e["a"]))
    s = e[order]
    first = _first_of_runs(s["a"], s["c"])
    owner = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    state = np.full(len(s), STAY, np.uint8)
    mine = s["doc"] == s["doc"][owner]
    state[~mine] = REMOVE
    # owners whose string stands in other surroundings too, if those share what a group of windows shares: else no
    # window can be the same
    at = np.flatnonzero(first)
    alone = _first_of_runs(s["a"][at])
    alone &= np.append(alone[1:], True)  # strings with one surroundings
    at = at[~alone]
    for g in range(len(GROUPS)):
        there = at[s["tests"][at, g] > 0]
        shared = s["a"][there] ^ mix64(s["tests"][there, g].astype(np.uint64))
        _, back, many = np.unique(shared, return_inverse=True, return_counts=True)
        state[there[many[back] > 1]] |= OPEN | 1 << g
    # the surroundings that weren't sent may agree with any of these in part
    unused = np.uint64(64 - 8 * SENT["a"])
    state[first & np.isin(s["a"] >> unused, cuts >> unused)] = OPEN + ALL_GROUPS
    state[mine] = state[owner[mine]]
    out = np.empty(len(s), np.uint8)
    out[order] = state
    return out


def _settle_windows(e: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """cuts: none, as a batch sends each window once."""
    order = np.lexsort((e["doc"], e["check"], e["h"]))
    s = e[order]
    first = _first_of_runs(s["h"], s["check"])
    owner = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty(len(s), np.uint8)
    out[order] = np.where(s["doc"] > s["doc"][owner], REMOVE, STAY)
    return out


def _gather(frame: pd.DataFrame) -> pd.DataFrame:
    """The states of each document of a batch."""
    docs, copies, counts, same, states = _unpack_own(frame.loc[frame["kind"] == "own", "data"].iloc[0])
    for data in frame.loc[frame["kind"] == "told", "data"]:
        n = len(data) // 5
        states[np.frombuffer(data, "<u4", n)] = np.frombuffer(data, np.uint8, n, 4 * n)
    states[states == ASK] = STAY
    states[same[:, 0]] = states[same[:, 1]]
    cut = np.concatenate([[0], np.cumsum(counts)])
    busy = np.flatnonzero(np.add.reduceat(np.append(states, 0) != 0, cut[:-1]) * (counts > 0)) if len(docs) else []
    rows = [(docs[i], copies[i], own.tobytes(), bool((own >= OPEN).any())) for i in busy for own in (states[cut[i] : cut[i + 1]],)]
    return pd.DataFrame(rows, columns=["doc_id", "copy", "states", "open"])


def _round_2(buckets: int, batch_bytes: int):
    def settle(batch, frame):
        texts = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
        docs = frame["doc_id"].to_numpy(np.int64)
        states = list(frame["states"])
        counts, parts = np.zeros(len(texts), np.int64), []
        for first, block in blocks(texts):
            known = np.frombuffer(b"".join(states[first : first + len(block.sizes)]), np.uint8)
            starts, h, check = block.windows(known)
            e = np.zeros(len(starts), WINDOW)
            text = np.searchsorted(block.begin + block.sizes, starts, "right")
            e["h"], e["check"], e["doc"] = h, check, docs[first + text]
            parts.append(e)
            counts += np.bincount(first + text, minlength=len(texts))
        entries = np.concatenate([*parts, np.zeros(0, WINDOW)])
        entries["e"] = np.arange(len(entries))
        status = np.full(len(entries), ASK, np.uint8)
        order = np.argsort(entries["h"], kind="stable")
        s = entries[order]
        first = _first_of_runs(s["h"], s["check"])
        owner = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        status[order[~first & (s["doc"] > s["doc"][owner])]] = REMOVE
        repeat = ~first & (s["doc"] == s["doc"][owner])
        same = np.column_stack([order[repeat], order[owner[repeat]]])
        status[same[:, 0]] = STAY
        keep = np.sort(order[first])
        yield _frame([*_dealt(batch, entries[keep], entries["h"][keep], buckets), _own(batch, docs, frame["copy"].to_numpy(np.int64), counts, status, same, buckets)])

    return lambda frames: _batch_rows(frames, settle, batch_bytes)


def covered(text: bytes, block: Block, states: np.ndarray, windows: np.ndarray | None) -> np.ndarray:
    """Which bytes of a single text are removed; block: of this text alone."""
    change = np.zeros(len(text) + 1, np.int64)
    gone = block.at[states == REMOVE]
    np.add.at(change, np.maximum(gone - REACH, 0), 1)
    np.add.at(change, np.minimum(gone + LENGTH, len(text)), -1)
    if windows is not None:
        starts, _, _ = block.windows(states)
        starts = starts[windows == REMOVE]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
    return np.cumsum(change)[:-1] > 0


def _result(batches):
    for b in batches:
        rows = []
        for doc, text, states, windows in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "states", "windows"))):
            raw = text.encode("utf-8", "surrogatepass")
            if states is None:
                rows.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            gone = covered(raw, Block([raw]), np.frombuffer(states, np.uint8), None if windows is None else np.frombuffer(windows, np.uint8))
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, bucket_bytes: int = 12_000_000, batch_bytes: int = BATCH_BYTES, per_batch: int = PER_BATCH, group_batches: int = GROUP_BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # rows that share a doc_id: told apart by their texts; equal rows have equal results
    own = own.withColumn("copy", F.xxhash64("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, -(-int(total * 2) // bucket_bytes))
    most = per_batch * group_batches

    def answered(asked: DataFrame, kind: str) -> DataFrame:
        return asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_answer(kind, most, PIECE * most), ROWS)

    def resolved(source: DataFrame, round_, kind: str) -> DataFrame:
        told = answered(source.mapInPandas(tidied(round_), ROWS), kind)
        return stored(told.groupBy("batch").applyInPandas(_gather, "doc_id long, copy long, states binary, open boolean"), "states").dropDuplicates(["doc_id", "copy"])

    states = resolved(own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), _round_1(buckets, batch_bytes, per_batch), "surroundings")
    windows = resolved(own.join(states.where("open").drop("open"), ["doc_id", "copy"]), _round_2(buckets, batch_bytes), "windows").select("doc_id", "copy", F.col("states").alias("windows"))
    # a document without a row in windows has none that goes
    joined = own.join(states.drop("open"), ["doc_id", "copy"], "left").join(windows, ["doc_id", "copy"], "left")
    return joined.select("doc_id", "text", "states", "windows").mapInArrow(tidied(_result), RESULT)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: All 50-byte strings, by digest; runs of removed starts become spans, and what is between them is joined.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM w) WHERE gone),
o AS (SELECT doc_id, i, coalesce(i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) AS opens FROM g),
s AS (SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
r AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM s GROUP BY doc_id, span),
e AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
q AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM r UNION ALL SELECT doc_id, 0, min(lo) FROM r GROUP BY doc_id),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * q.lo + 1, 2 * (coalesce(q.hi, n) - q.lo)), '' ORDER BY q.lo) AS h FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)
"""
