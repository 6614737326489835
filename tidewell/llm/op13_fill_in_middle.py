"""Fill-in-middle transformation by displacement scatter.

A text is cut in two places into prefix, middle and suffix, and written as <P>prefix<S>suffix<M>middle (psm) or
<S>suffix<P>prefix<M>middle (spm), or left as it is (plain). The work is on the bytes of a whole batch at once:

1. The cuts follow from a hash of the id, in code points; one scan of the batch's bytes turns them into byte places.
2. Each segment moves as a whole. A difference array gets, where a segment begins, the change of the displacement
   against the segment before it; its cumulative sum is the displacement of every byte, and one scatter writes them all.
   The marks are written between them.
3. Back again, the marks of a text tell the lengths of its segments, and the same sums give the place that each byte of
   the text is gathered from. Nothing but the output and its form is read.

Sums run over windows of the batch, so memory beside the bytes themselves doesn't follow the length of a text. No row is
shuffled.

Cases: a null text counts as empty; an empty text is plain. A text that holds a mark is plain, so the marks of the others
can be found. A null doc_id is hashed like an empty number. Repeated rows and rows with equal doc_ids are transformed each.
Empty tables give no rows. Texts of any length are transformed whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import tidied, whole_text
from tidewell.session import table

#: The marks of the three parts.
MARKS = {b"P": b"<P>", b"S": b"<S>", b"M": b"<M>"}
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes that one cumulative sum covers.
WINDOW = 1 << 20
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, one after the other, and where each begins, with the end at last."""
    _, places, data = column.buffers()
    begins = np.frombuffer(places, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if data is not None and begins[-1] > begins[0] else np.zeros(0, np.uint8)
    return flat, begins - begins[0]


def strings(flat: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(flat))


def code_point_places(flat: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The byte where each code point begins, by its number in the batch (ascending); the end for numbers beyond it."""
    out, seen = np.full(len(wanted), len(flat), np.int64), 0
    for at in range(0, len(flat), window):
        leads = np.flatnonzero((flat[at : at + window] & 0xC0) != 0x80)
        low, high = np.searchsorted(wanted, [seen, seen + len(leads)])
        out[low:high] = at + leads[wanted[low:high] - seen]
        seen += len(leads)
    return out


def displaced_places(begins: np.ndarray, shifts: np.ndarray, size: int, window: int = WINDOW):
    """(first, end, the places that bytes first to end move to), window by window.

    begins: where segments begin, ascending, from 0; shifts: how far the bytes of each move.
    """
    steps = np.diff(shifts, prepend=0)
    for first in range(0, size, window):
        end = min(first + window, size)
        low, high = np.searchsorted(begins, [first, end])
        moved = np.zeros(end - first, np.int64)
        np.add.at(moved, begins[low:high] - first, steps[low:high])
        moved[0] += first + (shifts[low - 1] if low else 0)
        moved[1:] += 1  # each byte's own place grows by one
        yield first, end, np.cumsum(moved, out=moved)


def mark_places(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all marks that lie within a text, and the text of each."""
    at = np.flatnonzero(flat[:-2] == ord("<")) if len(flat) > 2 else np.zeros(0, np.int64)
    at = at[(flat[at + 2] == ord(">")) & np.isin(flat[at + 1], [ord(k) for k in MARKS])] if len(at) else at
    text = np.searchsorted(begins, at, "right") - 1
    inside = at + 3 <= begins[text + 1]
    return at[inside], text[inside]


def fill(flat: np.ndarray, begins: np.ndarray, n: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """form, prefix and middle in code points, and bytes and begins of the outputs. hashes: four columns of numbers."""
    h1, h2, h3, h4 = hashes
    cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    form = np.where(h4 % 100 < 20, SPM, PSM)
    form[(n == 0) | (h3 % 100 >= 90)] = PLAIN
    form[mark_places(flat, begins)[1]] = PLAIN
    base = np.cumsum(n) - n
    places = code_point_places(flat, (base + cuts).T.ravel(), window).reshape(-1, 2)
    start, end, first, second = begins[:-1], begins[1:], places[:, 0], places[:, 1]
    prefix, middle, suffix = first - start, second - first, end - second
    out_begins = np.zeros(len(begins), np.int64)
    np.cumsum(end - start + 9 * (form != PLAIN), out=out_begins[1:])
    own, psm, spm = out_begins[:-1], form == PSM, form == SPM
    to_prefix = own + np.where(psm, 3, np.where(spm, suffix + 6, 0))
    to_middle = own + prefix + np.where(form != PLAIN, suffix + 9, 0)
    to_suffix = own + np.where(psm, prefix + 6, np.where(spm, 3, prefix + middle))
    sources, targets = (np.stack(x, axis=1).ravel() for x in ((start, first, second), (to_prefix, to_middle, to_suffix)))
    out = np.empty(out_begins[-1], np.uint8)
    for a, b, to in displaced_places(sources, targets - sources, len(flat), window):
        out[to] = flat[a:b]
    marked = form != PLAIN
    for name, to in ((b"P", to_prefix), (b"S", to_suffix), (b"M", to_middle)):
        out[(to[marked] - 3)[:, None] + np.arange(3)] = np.frombuffer(MARKS[name], np.uint8)
    return form, cuts[0], cuts[1] - cuts[0], out, out_begins


def restore(flat: np.ndarray, begins: np.ndarray, form: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and begins of the texts that outputs were made from."""
    start, end, marked = begins[:-1], begins[1:], form != PLAIN
    at, text = mark_places(flat, begins)
    at = at[marked[text]].reshape(-1, 3)  # a text with marks of its own is plain, so the others have just three
    from_first, from_second, from_middle = (start.copy() for _ in range(3))
    first, second = end - start, np.zeros(len(start), np.int64)
    from_first[marked], from_second[marked], from_middle[marked] = at[:, 0] + 3, at[:, 1] + 3, at[:, 2] + 3
    first[marked], second[marked] = at[:, 1] - at[:, 0] - 3, at[:, 2] - at[:, 1] - 3
    middle = end - start - first - second - 9 * marked
    spm = form == SPM
    prefix, suffix = np.where(spm, second, first), np.where(spm, first, second)
    out_begins = np.zeros(len(begins), np.int64)
    np.cumsum(prefix + middle + suffix, out=out_begins[1:])
    own = out_begins[:-1]
    targets = np.stack([own, own + prefix, own + prefix + middle], axis=1).ravel()
    sources = np.stack([np.where(spm, from_second, from_first), from_middle, np.where(spm, from_first, from_second)], axis=1).ravel()
    out = np.empty(out_begins[-1], np.uint8)
    for a, b, source in displaced_places(targets, sources - targets, len(out), window):
        out[a:b] = flat[source]
    return out, out_begins


def _filled(batches):
    for b in batches:
        flat, begins = batch_bytes(b.column("text"))
        n = b.column("n").to_numpy()
        form, prefix, middle, out, out_begins = fill(flat, begins, n, np.stack([b.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]))
        cut = [pa.array(x, pa.int64(), mask=form == PLAIN) for x in (prefix, middle)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(FORMS).take(pa.array(form)), *cut, strings(out, out_begins)], [c.split()[0] for c in TRANSFORMED.split(", ")])


def _restored(batches):
    for b in batches:
        form = np.zeros(len(b), np.int64)
        for k, name in enumerate(FORMS):
            form[np.asarray(b.column("form")) == name] = k
        text = strings(*restore(*batch_bytes(b.column("output")), form))
        yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "restored"])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output of each document."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), digest.alias("digest"))
    keyed = own.select("doc_id", "text", F.length("text").cast("long").alias("n"), *parts)
    return keyed.mapInArrow(tidied(_filled), TRANSFORMED)


def restored(transformed: DataFrame) -> DataFrame:
    """transformed, as fill_in_middle gives it, and the text of each output, restored from the output and its form."""
    return transformed.mapInArrow(tidied(_restored), f"{TRANSFORMED}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_HEX = "list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(d, {at} + i, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)"
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, {", ".join(_HEX.format(at=8 * k) + f" AS h{k + 1}" for k in range(4))} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM p
"""
