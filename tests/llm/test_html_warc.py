"""op1 on small pages and the tables, op10 as a round trip."""

import hashlib
import html
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm import op1_html, op10_warc


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ("", ""),
        ("<nav><ul><li>x</nav><article><h1>T &amp; U</h1><p>a\n b&nbsp;c<p>d<div class='comments'><p>no</p></div><p>yes<footer>f</footer></article><footer>z", "T & U a b c d yes"),
        ('<html><head><title>x</title><script>var t="</p>";</script></head><body><div class="ad">a<div>b</div></div><article><p>q <a href="a>b">link</a>.<!-- c --><p>cut <b', "q link. cut"),
        ("<div id=sidebar>s</div><p>1 < 2 <3<style>p{}</style>", "1 < 2 <3"),
        ("<form>f<p>g</form><main>m<aside>n</aside>o</main>", "m o"),
    ],
)
def test_lines(page, kept):
    has_main, lines = op1_html.page_lines(page)
    assert " ".join(t for t, furniture, main in lines if not furniture and (main or not has_main)) == kept


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, y in zip(a, op1_html.shared_lines(a, b)) if y]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_halves_share_as_much_as_whole_rows():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 60))] for _ in range(2))
        whole, halved = op1_html.shared_lines(a, b), op1_html.shared_lines(a, b, cells=40)
        rest = iter(b)
        assert sum(whole) == sum(halved) and all(x in rest for x, y in zip(a, halved) if y)
    a, b = ([f"{rng.randint(0, 9)}" for _ in range(20_000)] for _ in range(2))
    assert sum(op1_html.shared_lines(a, b)) == op1_html._shared_counts(a, b)[-1] == op1_html._shared_counts(b, a)[-1]


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<div class="with-sidebar"><p>hello world</p></div>', "hello world"),
        ('<article class="post comments-open">a<article class="comment">no</article></article>', "a"),
        ('<article><p class="share-price">up</p><p>x<span class="ad">BUY</span>y <em>z</em></p><div class="share">s</div></article>', "up xy z"),
        ('<article><p>x<span class="ad">BUY<p>y</article>', "x y"),
        ('<article>a<div class="ad-slot">1</div><div id="cookie_bar">2</div><div class="x sidebar-right">3</div><div class="reader-comments">4</div><section class="comments__section">5</section>b</article>', "a b"),
        ('<article>a<p class="cookie-recipe">b</p><p class="site-plan">c</p><div class="page-header">d</div><p class="area">e</p></article>', "a b c d e"),
        ('<div class="header">site</div><article><div class="header">T</div>x</article>', "T x"),
        ('<article>a<textarea>t</textarea><math><mi>x</mi></math></article>', "a x"),
    ],
)
def test_names_count_as_a_whole(page, kept):
    has_main, lines = op1_html.page_lines(page)
    assert " ".join(t for t, furniture, main in lines if not furniture and (main or not has_main)) == kept


SCHEMA = "page_id long, url string, html string"


def texts_of(df, **options):
    return sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"], r["n_lines"], r["n_shared"], r["partner"]) for r in op1_html.main_text(df, **options).collect())


def test_differencing_deletes_shared_lines(spark):
    frame = "<p>Home</p><p>{}</p><p>Imprint</p>"
    rows = [(1, "http://h/a/1", frame.format("first")), (2, "http://h/a/2", frame.format("second")), (3, "http://other/a", "<p>alone</p>"), (4, None, None), (4, None, None)]
    got = [(int(i), t, n) for i, _, t, n, *_ in texts_of(spark.createDataFrame(rows, SCHEMA))]
    assert got == [(1, "first", 5), (2, "second", 6), (3, "alone", 5), (4, "", 0), (4, "", 0)]
    assert texts_of(spark.createDataFrame([], SCHEMA)) == []


def brute(rows):
    """The whole operator over all pages in one list, with a table of all pairs of lines."""

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    pages = {}
    for i, url, page in rows:
        m = re.match(r"https?://([^/?#]*)([^?#]*)", url)
        pages[(m[1].lower(), m[2], i)] = (url, re.findall(r"<p>(.*?)</p>", page), "<article>" in page)
    order, out = sorted(pages), []
    for at, key in enumerate(order):
        url, lines, article = pages[key]
        near = [(order[j], abs(j - at), j > at) for j in range(max(0, at - 4), min(len(order), at + 5)) if j != at and order[j][0] == key[0] and pages[order[j]][1] != lines]
        steps = lambda k: next((n for n, (x, y) in enumerate(zip(key[1].split("/"), k[1].split("/"))) if x != y), min(key[1].count("/"), k[1].count("/")) + 1)
        partner = min(near, key=lambda x: (-steps(x[0]), x[2], x[1]))[0] if near else None
        shared = common(lines, pages[partner][1]) if partner else 0
        if article:
            witnesses = [pages[k][1] for k, _, _ in near if pages[k][2]] + [[] for k, _, _ in near if not pages[k][2]]
            kept = [x for x in lines if len(witnesses) < 6 or not all(x in w for w in witnesses)]
        else:  # lines are different within a page here and templates keep their order, so shared lines are those of both
            kept = [x for x in lines if not partner or x not in pages[partner][1]]
            assert len(lines) - len(kept) == shared
        text = " ".join(kept)
        out.append((str(key[2]), url, text, len(text), len(lines), shared, partner[2] if partner else None))
    return sorted(out)


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        host, kind = rng.choice(["h", "h", "h", "k"]), rng.choice("pppa")
        top, end = [f"menu {host} {j}" for j in range(3)][: rng.randint(0, 3)], [f"foot {host}"] * rng.randint(0, 1)
        quoted = [f"quoted {rng.randint(0, 3)}"] * (rng.random() < 0.3)
        body = ["everywhere", *[f"text {rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 3))], *quoted]
        path = "/" + "/".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) + rng.choice(["", "?q=1"])
        page = "".join(f"<p>{x}</p>" for x in ([*top, *body, *end] if kind == "p" else body))
        rows.append((i, f"https://{host}{path}", f"<article>{page}</article>" if kind == "a" else page))
    want = brute(rows)
    assert any("text" in r[2] and "everywhere" not in r[2] for r in want)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert texts_of(df) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for partitions, block_rows in ((1, 1000), (40, 5), (7, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert texts_of(df.repartition(partitions), block_rows=block_rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lines_that_all_neighbours_share_go_from_articles(spark):
    page = "<nav>n{0}</nav><article><p>body {0}</p><p>We use cookies</p></article>"
    rows = [(i, f"http://h/p/{i:02d}", page.format(i)) for i in range(10)] + [(100 + i, f"http://few/p/{i}", page.format(i)) for i in range(3)]
    got = {int(r[0]): r[2] for r in texts_of(spark.createDataFrame(rows, SCHEMA), block_rows=3)}
    # pages at the ends of a host have too few neighbours to tell
    assert got[5] == "body 5" and got[0] == "body 0 We use cookies" and got[101] == "body 1 We use cookies"


def test_odd_pages(spark):
    big = 1 << 60
    rows = [(big + 1, None, "<p>a</p>", "x", 1), (None, None, "<p>b</p>", "y", 2), (big + 1, None, "<p>a</p>", "x", 3), (7, "no host", None, None, None), (8, "http://h/l", "<p>" + "word " * 400_000 + "</p>", None, None), (9, "http://h/m", "".join(f"<p>{i}</p>" for i in range(30_000)), None, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", host string, block int")
    got = {(r["page_id"], r["n_chars"]) for r in op1_html.main_text(df).collect()}
    assert got == {(big + 1, 1), (None, 1), (7, 0), (8, 5 * 400_000 - 1), (9, sum(len(str(i)) for i in range(30_000)) + 29_999)}
    assert op1_html.main_text(df).count() == 6


def test_articles_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", article)).split())
    assert {r["page_id"]: r["text"] for r in op1_html.op1_html(spark, sf).collect()} == want


def test_warc_round_trip(spark, tmp_path):
    big = "<p>ü</p>" * 200
    rows = [(1, "http://a/1", big), (5, "http://a/5\n", big), (3, None, big), (2, "u", None), (4, "u", "x"), (6, "u", "x"), (None, "n", big), (7, "r", "r" * 1500), (7, "r", "r" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = op10_warc.write_warc(op10_warc.warc_records(pages), folder, roll_bytes=700).toPandas()
    for f, sha in zip(manifest.file, manifest.sha256):
        assert hashlib.sha256((tmp_path / "w" / f).read_bytes()).hexdigest() == sha
    assert manifest.records.sum() == len(rows) and len(manifest) > 1
    (tmp_path / "w" / ".left-over.tmp").write_bytes(b"junk")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op10_warc.read_warc(spark, folder).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        keeper = {big: 5}.get(h)
        revisit = keeper is not None and i != keeper
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want)
    assert not list((tmp_path / "w").glob(".shard*"))
    names = []
    for f in manifest.file:
        with open(tmp_path / "w" / f, "rb") as stream:
            names += [op10_warc.parse_record(raw)[0]["WARC-Record-ID"] for _, raw in op10_warc.iterate_members(stream)]
    assert len(set(names)) == len(names) == len(rows) + len(manifest)
    empty = f"file://{tmp_path}/e"
    op10_warc.write_warc(op10_warc.warc_records(pages.limit(0)), empty)
    assert op10_warc.read_warc(spark, empty).count() == 0


def test_warc_files_follow_from_the_table_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i if i % 7 else None, f"http://h/{i}", rng.choice("abc") * rng.randint(900, 4000), "x") for i in range(300)] + [(10**6, "u", "long " * 500_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumn("key", F.lit(1))
    told = []
    for partitions in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        folder = tmp_path / f"p{partitions}"
        manifest = op10_warc.write_warc(op10_warc.warc_records(pages.repartition(partitions)), f"file://{folder}", roll_bytes=3000, range_bytes=50_000)
        told.append(sorted((r["file"], r["sha256"], hashlib.sha256((folder / r["file"]).read_bytes()).hexdigest()) for r in manifest.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told[0] == told[1] == told[2] and len(told[0]) > 10 and all(a == b for _, a, b in told[0])
    assert op10_warc.read_warc(spark, f"file://{folder}").count() == len(rows)


def test_warc_task_that_dies_after_its_first_shard(tmp_path):
    """The rows of a range are written, the attempt dies in the second shard, and the next attempt repeats all."""
    frame = pd.DataFrame({"range": 3, "key": range(20), "url": None, "html": ["<p>%d</p>" % i * 50 for i in range(20)], "digest": "00" * 20, "n_bytes": 10, "refers_to": None})

    def dying():
        yield frame[:12]
        raise RuntimeError("lost")

    write = op10_warc._writer(f"file://{tmp_path}", 900, 5, "1970-01-01T00:00:00Z")
    with pytest.raises(RuntimeError):
        list(write(dying()))
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert before and not any(n.endswith(".tmp") for n in before)
    manifest = pd.concat(write(iter([frame])))
    after = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert set(after) == set(manifest.file) and before.items() <= after.items() and len(after) > len(before)
    assert all(hashlib.sha256(after[f]).hexdigest() == sha for f, sha in zip(manifest.file, manifest.sha256))


def test_tasks_follow_the_pages(spark, sf):
    """Where blocks grow, as their number is bounded, a task has fewer of them; the texts are the same."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((r["page_id"], r["text"]) for r in op1_html.main_text(pages).collect())
    for block_rows, max_blocks, tasks in ((2, 1000, 2), (2, 12, 2), (4, 5, 1)):
        got = op1_html.main_text(pages, block_rows=block_rows, max_blocks=max_blocks, blocks_per_task=16)
        assert got.rdd.getNumPartitions() >= tasks and sorted((r["page_id"], r["text"]) for r in got.collect()) == want
