"""Main text of web pages by nearest-URL page differencing.

Each page becomes a list of text lines (one per block element) with two marks: whether the line stands in an element
that holds no article text (menus, headers, footers, asides, adverts, forms, comments, notices), and whether it stands
in an article or main element. Pages of a host are put in the order of their URL paths. A page sees the `REACH` pages
before and after it in that order; longest common subsequences of the lists of lines tell what it shares with them.

* On a page without an article or main element, the lines that it shares with its nearest neighbour are deleted: the one
  whose path shares the longest prefix, and of equals the next one before, then the next one after. A neighbour with the
  same lines throughout is a copy, tells nothing, and is passed over.
* On a page with such an element the lines inside it are the text, but for those that all neighbours share, where at
  least `WITNESSES` neighbours have another text. One neighbour's word isn't enough there: pages under neighbouring URLs
  often quote the same passages, and deleting what a single pair shares would lose text (the README has the counts).
* Lines in an element that is marked as page furniture are no text on either kind of page.

The pages are dealt to blocks of consecutive keys, and the pages at the edges of a block are sent to the blocks beside
it too. So a host of any size is dealt to many tasks, each page sees its true neighbours, and the result doesn't depend
on the number of partitions. Pages travel through one shuffle and are parsed after it.

Cases: null html gives an empty text; pages without a host (null or relative urls) are neighbours of each other. Pages
with equal paths stand in the order of page_id, then of a hash of url and html. Unclosed tags and cut pages are read to
their end. Repeated rows are one page to their neighbours and give a row each. Lines of any length and number are
compared whole. Scripts, styles, frames, graphics, media fallbacks and form controls (also textarea, select and button)
are no text anywhere. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import partition_keys, spread, tidied, whole_text
from tidewell.session import table

RESULT = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, partner long"
KEY = ["host", "path", "id", "tie"]
EDGES = "part int, block int, host string, path string, id long, tie long"
#: How many pages on each side a page is compared with, and how many differing ones must agree about an article's line.
REACH, WITNESSES = 4, 6

# HTML element names by role, and whole class names, ids or roles of page furniture.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head", "select", "button", "audio", "video"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "comment-list", "comments-area", "complementary", "consent", "contentinfo", "cookie", "cookies", "cookie-banner", "cookie-notice", "disclaimer", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "related-posts", "respond", "share", "share-buttons", "sharing", "sidebar", "site-footer", "site-header", "site-nav", "social", "social-share", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
# Words beside a furniture word in a compound name, as in ad-slot, cookie_bar or sidebar-right.
BESIDE = {"area", "bar", "block", "bottom", "box", "container", "form", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "reader", "right", "row", "section", "signup", "site", "slot", "sticky", "strip", "top", "unit", "user", "wrap", "wrapper"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


PARTS = re.compile("[-_]+")


def _named(attributes: str, names: set = NAMED) -> bool:
    """Whether a class, id or role is one of the names, or a compound of them and of words for a place or a box alone.

    So comments-section counts; share-price, comments-open and with-sidebar, which have another word, don't.
    """
    return bool(attributes) and any(_is_name(name, names) for m in NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").lower().split())


def _is_name(name: str, names: set) -> bool:
    parts = {x for x in PARTS.split(name) if x}
    return name in names or (not parts.isdisjoint(names) and parts <= names | BESIDE)


def page_lines(page: str) -> tuple[bool, list[tuple[str, bool, bool]]]:
    """Whether there is an article or main element, and (text, in furniture, in main) of each block that has text."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    within: list[tuple[str, str]] = []  # open furniture and main elements, and elements of the same names below them
    muted: list[str] = []  # open inline elements that are furniture, and those of the same names below them
    seen_main = False
    skip_to = 0

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            kinds = {k for _, k in within}
            out.append((text, "furniture" in kinds, "main" in kinds))

    for m in TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        tag = m[2]
        if tag is None:
            if not muted and (page[m.start()] != "<" or m[0] == "<"):
                parts.append(m[0])
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag not in INLINE:
            flush()
            muted.clear()  # an inline element ends with its block
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                # raw text ends at its own end tag only; a head without one ends at the body
                end = re.compile(rf"</{tag}\s*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(page, m.end())
                skip_to = end.end() if end else len(page)
            continue
        if tag in VOID or (not closing and m[3].rstrip().endswith("/") and tag not in MAIN | FURNITURE):
            continue
        if tag in INLINE:
            if closing and tag in muted:
                del muted[len(muted) - 1 - muted[::-1].index(tag) :]
            elif not closing and (tag in muted or _named(m[3])):
                muted.append(tag)
            continue
        if closing:
            for i in range(len(within) - 1, -1, -1):
                if within[i][0] == tag:
                    del within[i:]
                    break
            continue
        inside = within[-1][1] if within else ""
        in_main = any(k == "main" for _, k in within)
        if tag in MAIN:
            furniture = in_main and _named(m[3])  # within a text only: a reader's comment
        elif tag == "header" and in_main:
            furniture = False  # the head of an article belongs to it
        else:
            furniture = tag in FURNITURE or (tag not in ("body", "html") and _named(m[3], NAMED - {"header"} if in_main else NAMED))
        if furniture:
            within.append((tag, "furniture"))
        elif tag in MAIN or 'role="main"' in m[3]:
            if tag in MAIN and inside == "furniture" and not in_main:
                within.clear()  # furniture that was never closed
            seen_main = True
            within.append((tag, "main"))
        elif within and any(t == tag for t, _ in within):
            within.append((tag, ""))
    flush()
    return seen_main, out


def _rows(a: list, b: list):
    """Bit-parallel rows of the longest common subsequences of a's beginnings with b: zeros among the low j bits count
    what a's beginning shares with b[:j]."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _shared_counts(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a and b[:j] for each j; holds one row."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: list, b: list, cells: int = 1 << 26) -> list[bool]:
    """For each item of a, whether a longest common subsequence with b has it.

    Up to `cells` bits all rows are held and walked back; beyond that a is halved and b is cut where the two halves
    share most (Hirschberg), so the memory stays bounded at any number of lines.
    """
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    out = [True] * first + [False] * (len(a) - first - last) + [True] * last
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return out
    if len(a) > 1 and len(a) * len(b) > cells:
        half = len(a) // 2
        cut = int((_shared_counts(a[:half], b) + _shared_counts(a[half:][::-1], b[::-1])[::-1]).argmax())
        out[first : len(out) - last] = shared_lines(a[:half], b[:cut], cells) + shared_lines(a[half:], b[cut:], cells)
        return out
    rows, i, j = list(_rows(a, b)), len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out[first + i - 1] = True
            i, j = i - 1, j - 1
    return out


class Page:
    def __init__(self, row):
        self.own, self.key = row.own, (row.host, row.path, row.id, row.tie)
        self.page_id, self.rows = None if row.no_id else row.id, [row.url]
        self.has_main, lines = page_lines(row.html)
        self.texts = [t for t, _, _ in lines]
        self.furniture, self.main = [f for _, f, _ in lines], [m for _, _, m in lines]

    def within(self) -> list[str]:
        return [t for t, f, m in zip(self.texts, self.furniture, self.main) if m and not f]

    def steps(self, other: Page) -> int:
        """Shared leading steps of the paths."""
        a, b = self.key[1].split("/"), other.key[1].split("/")
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def page_text(page: Page, before: list[Page], after: list[Page]) -> tuple[str, int, Page | None]:
    """The text, the number of lines shared with the partner, and the partner. before: nearest last; after: nearest first."""
    others = [(-page.steps(p), d, s, p) for s, side in enumerate((before[::-1], after)) for d, p in enumerate(side) if p.texts != page.texts]
    partner = min(others, key=lambda x: x[:3])[3] if others else None
    shared = shared_lines(page.texts, partner.texts) if partner else [False] * len(page.texts)
    if page.has_main:
        own = page.within()
        texts = [x for x in (p.within() for _, _, _, p in others) if x != own]
        gone = [False] * len(own)
        if len(texts) >= WITNESSES and set(own).intersection(*texts):
            gone = [all(x) for x in zip(*(shared_lines(own, t) for t in texts))]
        keep = [t for t, g in zip(own, gone) if not g]
    else:
        keep = [t for t, f, s in zip(page.texts, page.furniture, shared) if not f and not s]
    return " ".join(keep), sum(shared), partner


def _difference(frames):
    """Rows come in the order of block and key; a block holds its own pages and those around it."""
    columns = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "partner"]
    seen: deque[Page] = deque()  # pages of one block and host; those before `at` are settled
    at, run, rows = 0, None, []

    def settle(waiting: int):
        nonlocal at
        while at < len(seen) - waiting:
            page, around = seen[at], list(seen)
            if page.own:
                text, n_shared, partner = page_text(page, around[max(0, at - REACH) : at], around[at + 1 : at + 1 + REACH])
                told = (text, len(text), len(page.texts), n_shared, partner.page_id if partner else None)
                rows.extend((page.page_id, url, *told) for url in page.rows)
            at += 1
            if at > REACH:
                seen.popleft()
                at -= 1

    def frame():
        out = pd.DataFrame({c: pd.array(x, "Int64") if c in ("page_id", "partner") else list(x) for c, x in zip(columns, zip(*rows))})
        rows.clear()
        return out

    for f in frames:
        for row in f.itertuples(index=False):
            key = (row.host, row.path, row.id, row.tie)
            if run == (row.block, row.host) and seen[-1].key == key:
                seen[-1].rows.append(row.url)
                continue
            if run != (row.block, row.host):
                settle(0)
                seen.clear()
                at, run = 0, (row.block, row.host)
            seen.append(Page(row))
            settle(REACH)
        if rows:
            yield frame()
    settle(0)
    if rows:
        yield frame()


def _edge_rows(block_keys: int):
    """Cuts sorted partitions into blocks of block_keys different keys and gives the first and last REACH of each."""

    def run(frames):
        part, block, n, head, tail = TaskContext.get().partitionId(), 0, 0, [], deque(maxlen=REACH)

        def frame():
            return pd.DataFrame([(part, block, *k) for k in dict.fromkeys([*head, *tail])], columns=["part", "block", *KEY])

        for f in frames:
            for key in f.itertuples(index=False, name=None):
                if tail and tail[-1] == key:
                    continue
                if n == block_keys:
                    yield frame()
                    block, n, head = block + 1, 0, []
                    tail.clear()
                if len(head) < REACH:
                    head.append(key)
                tail.append(key)
                n += 1
        yield frame()

    return run


def block_edges(keys: DataFrame, block_keys: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each block of about block_keys keys, and for the keys around their borders the other blocks that
    see them. At most 2 * REACH keys of a block come to the driver."""
    rows = keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInPandas(_edge_rows(block_keys), EDGES).collect()
    edges = sorted((tuple(r)[2:], (r["part"], r["block"])) for r in rows)
    starts = [i for i, (_, block) in enumerate(edges) if i == 0 or edges[i - 1][1] != block]
    extra: dict[tuple, list[int]] = {}
    for b, i in enumerate(starts):
        end = starts[b + 1] if b + 1 < len(starts) else len(edges)
        for key, _ in [*edges[max(0, i - REACH) : i], *edges[end : end + REACH]]:
            extra.setdefault(key, []).append(b)
    return [edges[i][0] for i in starts], extra


def main_text(pages: DataFrame, block_rows: int = 250, max_blocks: int = 10_000, blocks_per_task: int = 16) -> DataFrame:
    """page_id, url, text, n_chars; then the number of lines, of lines shared with the partner, and the partner's page_id.

    block_rows: pages of a block; more where there would be over max_blocks, as the driver holds 2 * REACH keys of each. A task
    has blocks_per_task blocks, fewer as they grow, so tasks go on with the number of pages up to one for each block.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    own = own.withColumns({"id": F.coalesce("page_id", F.lit(-(1 << 63))), "no_id": F.col("page_id").isNull(), "tie": F.xxhash64("url", "html")})
    n = pages.count()
    task_rows = block_rows * blocks_per_task
    block_rows = max(block_rows, spread(n, max_blocks))
    blocks_per_task = max(1, task_rows // block_rows)
    first, extra = block_edges(own.select(*KEY), block_rows) if n > block_rows else ([], {})

    tasks = partition_keys(pages.sparkSession, spread(max(1, len(first)), blocks_per_task))

    @F.pandas_udf("array<struct<block:int,own:boolean,task:int>>")
    def seen_by(host: pd.Series, path: pd.Series, id_: pd.Series, tie: pd.Series) -> pd.Series:
        def seen(key):
            own = max(0, bisect.bisect_right(first, key) - 1)
            return [{"block": b, "own": b == own, "task": tasks[b // blocks_per_task]} for b in (own, *extra.get(key, ()))]

        return pd.Series([seen(k) for k in zip(host, path, id_, tie)])

    dealt = own.withColumn("to", F.explode(seen_by(*KEY))).select("no_id", "url", "html", *KEY, "to.block", "to.own", "to.task")
    return dealt.repartition(len(tasks), "task").sortWithinPartitions("block", *KEY).mapInPandas(tidied(_difference), RESULT)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: What the pages of the tables have as their article, where lines that all neighbours share don't occur.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*(>|$)', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
