"""Loading public tokenizers inside tasks, and exact encoders that remember the pieces of words.

Both vocabularies split a text at white space before merging:

* `piece_bpe_32k.model`: no piece has the white-space mark after another character, so no merge crosses the start of
  a run of marks. The pieces of a text are the pieces of its runs "marks + word". `PieceCounter` checks that property
  of the vocabulary when it loads and encodes whole texts if it doesn't hold.
* `word_bpe_49k.json`: its pre-tokenizer drops white space and never joins across it, and its normalizers (canonical
  composition, lower case per code point) don't act across an ASCII space, tab or line feed. Special strings hold no
  white space and are found before anything is lower-cased, so only words that can't hold one are changed first.

So the pieces of a word are computed once per worker and looked up after that; results equal those of encoding the
whole text (tests/llm/test_packing_tokens.py). The memory is bounded: a full table is emptied.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 200_000


class _Words(dict):
    """word -> what encode gives for it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = out = self.encode(word)
        return out


def _split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each text's words in order, and where each text begins among them."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    at = np.asarray(lists.offsets)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), at - at[0]


def slices(texts: pa.Array, limit: int = 32_000_000):
    """The same texts in pieces of about limit bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
        stop = max(stop, start + 1)
        yield start, texts.slice(start, stop - start)
        start = stop


class PieceCounter:
    """Counts of pieces by a sentencepiece model, without begin or end marks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # also needs the dummy prefix, kept white space and no normalization: "a  bé" must give its own marks back
        probe = self.model.encode("a  bé", out_type=str)
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and "".join(probe) == "▁a▁▁bé"
        self.words = _Words(lambda w: len(self.model.encode(w)))

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Counts of texts without nulls. Texts with runs of spaces, or ends in them, are encoded whole."""
        out = np.zeros(len(texts), np.int64)
        for first, part in slices(texts):
            words, index, at = _split(part)
            each = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            total = np.concatenate([[0], np.cumsum(each[index])])
            got = total[at[1:]] - total[at[:-1]]
            odd = np.array([not self.by_word or w == "" or "▁" in w for w in words])
            for i in np.unique(np.searchsorted(at, np.flatnonzero(odd[index]), "right") - 1):
                got[i] = self.whole(part[int(i)].as_py())
            out[first : first + len(part)] = got
        return out


#: Words of these letters only are their own canonical composition, and each has a lower case of one code point.
PLAIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"

#: Marks that end a run of letters, compose with nothing and stand in no special string.
MARKS = "[#$%&*()+,./:;!?@_-]"


class IdEncoder:
    """Ids by a tokenizers file.

    All but the look-up works on columns. The distinct words of a slice of texts are cut into parts where the
    pre-tokenizer cuts them anyway (white space, and marks like "," after a letter), and each distinct part is looked
    up in a table of ids. Parts of plain letters are lower-cased before and given to the merges alone; all others,
    special strings in any case among them, go through the whole tokenizer as they are.
    """

    MARK = "★"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()
        mark = self._encode(self.MARK)
        # a mark that is one id of its own parts words that are encoded at once
        self.mark = int(mark[0]) if len(mark) == 1 and self._encode(f"a {self.MARK} b")[1] == mark[0] else None

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _clear(self) -> None:
        self.row: dict[str, int] = {"": 0}  # part -> its row of the two columns below
        self.size, self.begin = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _learn(self, parts: list[str]) -> None:
        plain, other = [], []
        whole = re.compile(f"{PLAIN}+").fullmatch
        for p in parts:
            (plain if whole(p) else other).append(p)
        known, sizes, ids = [], [], []
        for at in range(0, len(plain), 5000):
            own = plain[at : at + 5000]
            got = self.merges.encode(" ".join(own), add_special_tokens=False)
            known += own
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(own)))
            ids.append(np.array(got.ids, "<u4"))
        alone = [p for p in other if self.mark is None or self.MARK in p]
        other = [p for p in other if self.mark is not None and self.MARK not in p]
        for at in range(0, len(other), 2000):
            own = other[at : at + 2000]
            got = self._encode(f" {self.MARK} ".join(own))
            ends = np.append(np.flatnonzero(got == self.mark), len(got))
            if len(ends) != len(own):
                alone += own
                continue
            known += own
            sizes.append(np.diff(ends, prepend=-1) - 1)
            ids.append(got[got != self.mark])
        for p in alone:
            known.append(p)
            ids.append(self._encode(p))
            sizes.append(np.array([len(ids[-1])]))
        size = np.concatenate([self.size, *sizes])
        self.row.update(zip(known, range(len(self.size), len(size))))
        self.size, self.begin, self.flat = size, np.cumsum(size) - size, np.concatenate([self.flat, *ids])

    def _rows(self, parts: list[str]) -> np.ndarray:
        """The row of each of these distinct parts; a full table is emptied first."""
        if len(self.row) > 2 * MAX_WORDS:
            self._clear()
        rows = [self.row.get(p, -1) for p in parts]
        if missing := [p for p, r in zip(parts, rows) if r < 0]:
            self._learn(missing)
            rows = [self.row[p] for p in parts]
        return np.array(rows, np.int64)

    def _of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these distinct words, one word after the other, and how many each has."""
        for sep in ("\n", "\t"):
            words = pc.replace_substring(words, sep, " ")
        lists = pc.split_pattern(pc.replace_substring_regex(words, f"({PLAIN})({MARKS}+)", r"\1 \2"), " ")
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary
        parts = pc.if_else(pc.match_substring_regex(parts, f"^{PLAIN}+$"), pc.utf8_lower(parts), parts).dictionary_encode()
        rows = self._rows(parts.dictionary.to_numpy(zero_copy_only=False).tolist())[parts.indices.to_numpy()][coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.size[rows])])
        at = np.asarray(lists.offsets)
        at = at - at[0]
        return gather(self.flat, self.begin[rows], self.size[rows]), ends[at[1:]] - ends[at[:-1]]

    def columns(self, texts: pa.Array, end_id: int | None = None):
        """For slices of the texts: their ids, one text after the other, and how many each has; end_id ends each text."""
        for _, part in slices(texts, 5_000_000):
            lists = pc.split_pattern(part, " ")
            coded = lists.flatten().dictionary_encode()
            index, at = coded.indices.to_numpy(), np.asarray(lists.offsets)
            at = at - at[0]
            flat, size = self._of(coded.dictionary)
            if end_id is not None:  # the last row of the table is the end, and stands after each text
                index, at = np.insert(index, at[1:], len(size)), at + np.arange(len(at))
                flat, size = np.append(flat, np.uint32(end_id)), np.append(size, 1)
            begin, n = np.cumsum(size) - size, size[index]
            ends = np.concatenate([[0], np.cumsum(n)])
            yield gather(flat, begin[index], n), ends[at[1:]] - ends[at[:-1]]

    def encode(self, texts: pa.Array):
        """Yields the ids of each text, in order."""
        for flat, size in self.columns(texts):
            yield from np.split(flat, np.cumsum(size)[:-1]) if len(size) else []


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for each b, n, joined."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def load(kind: str, path: str):
    from tidewell.llm.common import worker_cache

    return worker_cache((kind, path), lambda: {"count": PieceCounter, "ids": IdEncoder}[kind](path))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
