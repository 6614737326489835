"""UDF surface and modelling steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import modelling as M
from tidewell.plans.base import query
from tidewell.plans.relational import _CASES, TOPICS
from tidewell.session import new_path, table


@query("x3_row_function", f"SELECT doc_id, CASE {_CASES} ELSE 'other' END AS topic FROM documents")
def x3(spark, d):
    """The topic rule as an opaque function on Arrow batches; P11 is the same as an expression."""
    rules = list(TOPICS)

    def topic(frames):
        import re

        compiled = [(label, re.compile(p)) for label, p in rules]
        for f in frames:
            f["topic"] = [next((label for label, p in compiled if p.search((x or "").lower())), "other") for x in f["text"]]
            yield f[["doc_id", "topic"]]

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(topic, "doc_id long, topic string")


@query("x4_embed")
def x4(spark, d):
    return M.embed(table(spark, d, "documents"), "doc_id", "text")


def scored(spark, d):
    """A cache that holds the answers to a third of the prompts, and the scores of all after two calls on it."""
    turns = table(spark, d, "conversations")
    prompts = turns.select(C.render("Rate this {{ role }} turn: {{ text }}", {"role": F.col("role"), "text": F.col("text")}).alias("prompt"), "conv_id")
    cache = new_path(spark, "answers")
    prompts.where("conv_id % 3 = 0").select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit(_KNOWN).alias("answer")).dropDuplicates(["prompt_hash"]).write.parquet(cache)
    rules = {"sentiment": {"type": "string", "required": True, "enum": ["good", "bad", "mixed"]}, "priority": {"type": "int", "required": True, "maximum": 3}}
    M.score_texts(prompts, cache, M.stub_client, rules)
    return cache, M.score_texts(prompts, cache, M.stub_client, rules)


_KNOWN = '{"sentiment": "good", "priority": 1}'
_PROMPTS = """WITH p AS (SELECT 'Rate this ' || role || ' turn: ' || text AS prompt, conv_id % 3 = 0 AS known FROM conversations),
 q AS (SELECT sha256(prompt) AS prompt_hash, bool_or(known) AS known, CAST('0x' || substr(sha256(prompt), 1, 8) AS BIGINT) AS h FROM p GROUP BY prompt) """


@query("x5_score", _PROMPTS + f"""SELECT prompt_hash, CASE WHEN known THEN '{_KNOWN}' ELSE '{{"sentiment": "' || ['good', 'bad', 'mixed'][h % 3 + 1] || '", "priority": ' || h % 5 || '}}' END AS answer,
 CASE WHEN NOT known AND h % 5 = 4 THEN ['priority: above 3'] ELSE CAST([] AS VARCHAR[]) END AS errors FROM q""")
def x5(spark, d):
    return scored(spark, d)[1]


@query("x5_answers_stored", _PROMPTS + "SELECT prompt_hash, CAST(1 AS BIGINT) AS times FROM q")
def x5b(spark, d):
    """How often each answer is stored: the second call finds all and asks for nothing."""
    return spark.read.schema(M.ANSWERS).parquet(scored(spark, d)[0]).groupBy("prompt_hash").agg(F.count("*").alias("times"))


@query("x6_stratified_split", "SELECT quality, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS test, count(*) - CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS train FROM labels GROUP BY quality")
def x6(spark, d):
    s = M.stratified_split(table(spark, d, "labels"), "quality", "doc_id", 0.2)
    return s.groupBy("quality").agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "train").alias("train"))


def labelled(spark, d):
    """Labels with simple features of their texts, split."""
    text = F.col("text")
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / F.greatest(F.lit(1), F.length(text))
    docs = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("log_chars"), share(r"[^A-Z]+").alias("upper"), share(r"[^#*$%&|<>!]+").alias("marks"), share(r"[^\n]+").alias("breaks"), (F.length(text) / F.size(F.split(text, r"\s+"))).alias("word"))
    return M.stratified_split(table(spark, d, "labels").join(docs, "doc_id"), "quality", "doc_id", 0.25)


FEATURES = ["log_chars", "upper", "marks", "breaks", "word"]


@query("x7_compare_models")
def x7(spark, d):
    return M.fit_and_compare(labelled(spark, d), FEATURES, "quality")[0]


@query("x8_report", """WITH p AS (SELECT quality AS y, CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS z FROM documents JOIN labels USING (doc_id)), c AS (SELECT unnest([0, 1]) AS class),
 k AS (SELECT class, count(*) FILTER (y = class AND z = class) AS tp, count(*) FILTER (z = class) AS pr, count(*) FILTER (y = class) AS support FROM p, c GROUP BY class)
 SELECT class, round(coalesce(tp / nullif(pr, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(pr + support, 0), 0), 6) AS f1, support FROM k WHERE pr + support > 0""")
def x8(spark, d):
    return M.report(predicted(spark, d), "quality", "prediction")


def predicted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") > 300).cast("int").alias("prediction"))
    return docs.join(table(spark, d, "labels"), "doc_id")


@query("x9_confusion", "WITH p AS (SELECT quality AS y, CASE WHEN length(text) > 300 THEN 1 ELSE 0 END AS z FROM documents JOIN labels USING (doc_id)) SELECT c AS label, count(*) FILTER (y = c AND z = 0) AS p_0, count(*) FILTER (y = c AND z = 1) AS p_1 FROM (SELECT unnest([0, 1]) AS c) LEFT JOIN p ON y = c GROUP BY c")
def x9(spark, d):
    return M.confusion(predicted(spark, d), "quality", "prediction", [0, 1])


@query("x10_feature_importance")
def x10(spark, d):
    models = M.fit_and_compare(labelled(spark, d), FEATURES, "quality")[1]
    weights = [float(x) for x in models["random_forest"].featureImportances]
    return spark.createDataFrame(sorted(zip(FEATURES, weights), key=lambda x: -x[1]), "feature string, importance double")
