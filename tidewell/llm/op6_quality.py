"""Quality rules with risk-controlled thresholds, on DataFrame functions alone.

Rules compare a metric of a text (higher is worse) with a cutoff. Cutoffs are selected on a labelled holdout: for each
stratum (language) and rule, every cutoff of a fixed grid is tested, from the most lenient on, against the hypothesis
that it rejects more than `risk / rules` of the good documents. The test is exact: the p-value is the binomial
probability of at most the observed number of false rejections. A cutoff is valid if its p-value, and that of every
more lenient one, is at most `delta / (groups * rules)`: testing in a fixed order needs no correction within a rule,
Bonferroni's corrects across rules and groups. So with probability 1 - delta no stratum rejects more than `risk` of
its good documents. Among the valid cutoffs, the one with the largest difference of rejection rates (bad minus good)
is taken; where none is valid or none rejects bad documents, the rule rejects nothing.

Cases: null texts have no words and fail the base. Documents whose stratum has no labels are judged by the base alone.
A null language is a stratum of its own. Repeated rows of documents give a row each; of rows with one doc_id the one
with the smallest (stratum, metrics) is evidence, and several labels of a document count once (a document with any label
0 counts as bad). Of cutoffs with equal gain the most lenient one is taken. Empty tables give no rows; empty labels give
no cutoffs. Texts of any length are counted whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewell.llm.common import bind, whole_text
from tidewell.session import stored, table

# The cutoffs of each rule, lenient first.
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.33, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_share": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "mean_word": [30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0],
}
SPACE = r"[\x20\x09-\x0D]"


def _repeat_words(words: Column, size: int) -> Column:
    """How many words stand in windows of size words that occur twice or more."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marked = bind(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return covered(F.sort_array(F.transform(marked, lambda x: x["i"])))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    counted = lambda w: bind(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
    return bind(words, lambda w: F.when(F.size(w) < size, F.lit(0)).otherwise(counted(w)))


def text_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words (all long)."""
    text = whole_text()
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, 5).cast("long").alias("n_repeat_words")))
    line_counts = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    left = docs.select(
        *keep,
        counts.alias("c"),
        line_counts.alias("l"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    return left.select(*keep, "c.n_words", "word_chars", "n_symbols", "n_upper", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def metrics() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p, else 1: log of the last term, times the sum of ratios to it."""
    k, n = k.cast("int"), n.cast("int")
    upto = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(upto, F.lit(0.0), lambda acc, j: acc + F.log((n - k + j) / j)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ratios = F.aggregate(upto, start, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last) * ratios))


def select_cutoffs(labelled: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, n_good, k_good, k_bad, p_value for the rules that get a cutoff.

    labelled: stratum, good (boolean), and the metrics. Counts are sums over (stratum, rule, cutoff), whose number is
    fixed but for the groups; the documents are reduced before the shuffle.
    """
    n_rules = len(GRID)
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.lit(r).alias("m")) for r, cs in GRID.items() for i, c in enumerate(cs)])
    value = F.create_map(*[x for r in GRID for x in (F.lit(r), F.col(r))])
    tests = labelled.select("stratum", "good", value.alias("value"), F.explode(grid).alias("g")).select("stratum", "good", "g.*", (F.col("value")[F.col("g.rule")] > F.col("g.cutoff")).alias("hit"))
    counts = tests.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), F.count_if(F.col("good") & F.col("hit")).alias("k_good"), F.count_if(~F.col("good") & F.col("hit")).alias("k_bad")
    )
    groups = counts.agg(F.count_distinct("stratum").alias("n_groups"))
    tested = counts.crossJoin(F.broadcast(groups)).withColumn("p_value", binomial_cdf(F.col("k_good"), F.col("n_good"), risk / n_rules))
    valid = F.col("p_value") <= delta / (F.col("n_groups") * n_rules)
    in_order = Window.partitionBy("stratum", "rule").orderBy("step")
    gain = F.try_divide(F.col("k_bad"), F.col("n_bad")) - F.try_divide(F.col("k_good"), F.col("n_good"))
    kept = tested.withColumn("ok", F.min(valid.cast("int")).over(in_order)).withColumn("gain", gain).where((F.col("ok") == 1) & (F.col("k_bad") > 0) & (F.col("gain") > 0))
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")))
    return best.where("rank = 1").select("stratum", "rule", "cutoff", "n_good", "k_good", "k_bad", "p_value")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, the features, base_failed, kept and failed_rules for every document."""
    features = stored(text_features(docs, "doc_id", "lang"), "features").withColumn("stratum", F.coalesce("lang", F.lit(""))).drop("lang")
    features = features.withColumns(metrics()).withColumn("base_failed", base_failed())
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    # a document counts once as evidence, however often its row is repeated
    known = features.where(~F.col("base_failed")).join(marks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("stratum", *GRID)).alias("m"), F.first("good").alias("good"))
    labelled = known.select("good", "m.*")
    cutoffs = select_cutoffs(labelled, risk, delta)
    # one row per stratum; they are few (languages), yet the join is left to the planner
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in GRID])
    joined = features.join(wide, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in GRID]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*[f"max_{r}" for r in GRID])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle(risk: float = 0.02, delta: float = 0.05) -> str:
    n_rules, p = len(GRID), risk / len(GRID)
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cs in GRID.items() for i, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in GRID) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM m, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY rid),
f AS (SELECT rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
q AS (SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0)::DOUBLE AS symbol_share, coalesce(n_upper / nullif(word_chars, 0), 0)::DOUBLE AS upper_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0)::DOUBLE AS dup_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0), 0)::DOUBLE AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0)::DOUBLE AS mean_word, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stratum, {", ".join(GRID)}) AS place FROM q WHERE NOT base_failed) WHERE place = 1),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
grid(rule, step, cutoff) AS (VALUES {grid}),
c AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb, count(*) FILTER (good AND {value} > cutoff) AS k, count(*) FILTER (NOT good AND {value} > cutoff) AS kb FROM ev JOIN lab USING (doc_id), grid GROUP BY ALL),
s AS (SELECT *, CASE WHEN k >= n * {p}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln({p}::DOUBLE) + (n - j) * ln(1 - {p}::DOUBLE)))) END AS pv, (SELECT count(DISTINCT stratum) FROM c) AS ns FROM c),
o AS (SELECT *, bool_and(pv <= {delta} / (ns * {n_rules})) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok, kb / nb - k / n AS gain FROM s),
b AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) AS place FROM o WHERE ok AND kb > 0 AND gain > 0) WHERE place = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.stratum = q.stratum AND {value} > cutoff) AS kept FROM q
"""


ORACLE_SQL = _oracle()
