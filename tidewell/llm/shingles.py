"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed together; the tables of powers have this length.
BLOCK = 1 << 20
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers (splitmix64's finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from tidewell.llm.common import worker_cache

    def make():
        up, down = np.ones(2 * BLOCK, np.uint64), np.ones(2 * BLOCK, np.uint64)
        base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for out, b in ((up, base), (down, inverse)):
                filled = 1
                while filled < len(out):  # doubling
                    m = min(filled, len(out) - filled)
                    out[filled : filled + m] = out[:m] * np.uint64(pow(b, filled, 1 << 64))
                    filled += m
        return up, down

    up, down = worker_cache(("powers", BLOCK), make)
    if n <= len(up):
        return up[:n], down[:n]
    raise ValueError("block too long")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower-cased A-Z) of data, and where each begins.

    A word's hash is the sum of its bytes' numbers times powers of a base by place; sums over all places so far are
    subtracted and shifted, in blocks that end at white space (a longer word is hashed by itself).
    """
    b = _LOWER[np.frombuffer(data, np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(int(np.searchsorted(stops, begin + BLOCK, "right")), at + 1)
        part = b[begin : stops[to - 1]]
        if len(part) > 2 * BLOCK:
            h = 0
            for k in range(0, len(part), BLOCK):
                piece = part[k : k + BLOCK]
                h = (h * 0xD6E8FEB86659FD93 + int((_BYTE[piece] * _powers(len(piece))[0]).sum(dtype=np.uint64))) % (1 << 64)
            out[at] = h
        else:
            up, down = _powers(len(part))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * up, dtype=np.uint64)])
            s, e = starts[at:to] - begin, stops[at:to] - begin
            out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix64(out), starts


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    words, at = word_hashes(b"\n".join(raw))
    first = np.searchsorted(at, begin)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1) for k in range(size)]
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k, f in enumerate(factors):
        if n > 0:
            rolled += words[k : k + n] * f
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = rolled[a : b - size + 1].copy()
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix64(np.array([h]) * np.uint64(0x9FB21C651E98DF25) + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Circulant MinHash works over the places 0 .. 2^32 - 1.
def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures of sets (rows; empty sets have all ones).

    The first permutation scatters the elements once. The second one is applied after a circular shift of the places
    by 0, 1, 2, ...: each shift gives a coordinate.
    """
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # as many sets at once as stay in the processor's cache
        to, total = at, 0
        while to < len(full) and (to == at or total + len(sets[full[to]]) <= 16_384):
            total += len(sets[full[to]])
            to += 1
        rows = full[at:to]
        places = _permute((np.concatenate([sets[i] for i in rows]) >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        bounds = np.cumsum([0] + [len(sets[i]) for i in rows])[:-1]
        block = np.empty((coordinates, len(rows)), np.uint32)
        for k in range(coordinates):
            block[k] = np.minimum.reduceat(_permute(places + np.uint32(k), 0x21F0AAAD, 0xD35A2D97), bounds)
        out[rows] = block.T
        at = to
    return out
