"""The engine's record kinds over the driver's tables, in Spark and in SQL.

Every function has a twin in ``CTE``; queries join both from the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.joins import criterion_matrix


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark, d) -> DataFrame:
    """idx, id, source, lang, prompt (the text's first 24 characters), response."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("id"), "source", "lang", F.substring("text", 1, 24).alias("prompt"), F.col("text").alias("response"))


def verdict_a(spark, d) -> DataFrame:
    """Three runs of judge A from the labels, with errors, missing and wild values put in by id."""
    l = read(spark, d, "labels")  # noqa: E741
    third = F.when(F.col("doc_id") % 37 == 0, None).when(F.col("doc_id") % 53 == 0, F.lit(1.2)).otherwise((F.col("doc_id") % 10) / 50.0)
    return l.select(F.col("doc_id").alias("idx"), F.array(F.col("toxic") * 0.8, F.col("doc_id") % 7 / 100.0, third).alias("runs"), (F.col("doc_id") % 41 == 0).cast("int").alias("n_errors"))


def verdict_b(spark, d) -> DataFrame:
    """Judge B's score and tier."""
    l = read(spark, d, "labels")  # noqa: E741
    tier = F.when(F.col("toxic") == 1, "explicit").when(F.col("quality") == 0, "unrecovered").when(F.col("doc_id") % 29 == 0, None).otherwise("none")
    return l.select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 13 / 20.0).alias("score"), tier.alias("tier"))


def controls(spark, d) -> DataFrame:
    """Documents of odd id stand in for control rows."""
    return documents(spark, d).where("idx % 2 = 1").select("idx", "prompt", "response")


def answers(spark, d) -> DataFrame:
    """student (source), kind (language), match (toxic label; null: not judged), regex."""
    l = read(spark, d, "labels").select(F.col("doc_id").alias("idx"), (F.col("toxic") == 1).alias("match"))  # noqa: E741
    return documents(spark, d).join(l, "idx", "left").select("idx", F.col("source").alias("student"), F.col("lang").alias("kind"), "match", F.col("response").rlike("(?i)license|token").alias("regex"))


#: (crit_id, ord, round, pattern) of the rule-based criteria.
CRITERIA = [
    ("r1_license", 1, 1, "license|copyright"), ("r1_token", 2, 1, "token|password|secret"), ("r1_mail", 3, 1, "[a-z0-9]+@[a-z0-9]+"), ("r2_digits", 4, 2, "[0-9][0-9][0-9]"),
    ("r2_marks", 5, 2, "[#$%&*][#$%&*]"), ("r3_bars", 6, 3, "[|]"), ("r3_und", 7, 3, "und"), ("r3_copy", 8, 3, "copyright|license"),
]


def criteria(spark) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "crit_id string, ord int, round int, pattern string")


def verdicts(spark, d) -> DataFrame:
    """row_id, side, crit_id, ord, flag of every document against every criterion; ids that 97 divides are judge errors."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 == 0, "clean").otherwise("pool").alias("side"), F.lower("text").alias("t"))
    m = criterion_matrix(rows, criteria(spark), text="t")
    return m.select("row_id", "side", "crit_id", "ord", "round", F.when((F.col("row_id") + F.col("ord")) % 97 != 0, F.col("flag")).alias("flag"))


def deltas(spark, d) -> DataFrame:
    """idx, deltas (the embedding), y (its label is even), v."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("deltas"), (F.col("label") % 2 == 0).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_VALUES = ", ".join(f"('{c}', {o}, {r}, '{p}')" for c, o, r, p in CRITERIA)
CTE = {
    "docs": "docs AS (SELECT doc_id AS idx, doc_id AS id, source, lang, substr(text, 1, 24) AS prompt, text AS response FROM documents)",
    "verdict_a": "verdict_a AS (SELECT doc_id AS idx, [toxic * 0.8::DOUBLE, (doc_id % 7) / 100.0::DOUBLE, CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 53 = 0 THEN 1.2::DOUBLE ELSE (doc_id % 10) / 50.0::DOUBLE END] AS runs, (doc_id % 41 = 0)::INT AS n_errors FROM labels)",
    "verdict_b": "verdict_b AS (SELECT doc_id AS idx, (doc_id % 13) / 20.0::DOUBLE AS score, CASE WHEN toxic = 1 THEN 'explicit' WHEN quality = 0 THEN 'unrecovered' WHEN doc_id % 29 = 0 THEN NULL ELSE 'none' END AS tier FROM labels)",
    "controls": "controls AS (SELECT idx, prompt, response FROM docs WHERE idx % 2 = 1)",
    "answers": "answers AS (SELECT d.idx, d.source AS student, d.lang AS kind, l.toxic = 1 AS match, regexp_matches(d.response, '(?i)license|token') AS regex FROM docs d LEFT JOIN labels l ON l.doc_id = d.idx)",
    "criteria": f"criteria AS (SELECT * FROM (VALUES {_VALUES}) t(crit_id, ord, round, pattern))",
    "verdicts": "verdicts AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'clean' ELSE 'pool' END AS side, crit_id, ord, round, CASE WHEN (doc_id + ord) % 97 <> 0 THEN regexp_matches(lower(text), pattern) END AS flag FROM documents, criteria)",
    "deltas": "deltas AS (SELECT vec_id AS idx, embedding AS deltas, (label % 2 = 0)::INT AS y FROM embeddings)",
    "twins": "twins AS (SELECT d.*, c.control FROM docs d LEFT JOIN (SELECT prompt, arg_min(response, idx) AS control FROM controls GROUP BY prompt) c USING (prompt))",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ",\n".join([CTE[n] for n in names] + ([more] if more else [])) + "\n"
