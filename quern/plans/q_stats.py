"""Distinctive words, word matching, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import word_set
from quern.operators import sampling, stats, words
from quern.plans import tables as T
from quern.plans.registry import registry

Q, S, query = registry()

_FW = """side AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'p' ELSE 'c' END AS side, d.text FROM documents d JOIN labels l USING (doc_id)),
w AS (SELECT side, unnest(list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü'']+'))) AS word FROM side),
y AS (SELECT word, count(*) FILTER (WHERE side = 'p') AS yp, count(*) FILTER (WHERE side = 'c') AS yc FROM w GROUP BY word),
t AS (SELECT sum(yp) AS np, sum(yc) AS nc FROM y),
a AS (SELECT word, yp, yc, np, nc, 500.0 * (yp + yc) / (np + nc) AS a FROM y, t WHERE yp + yc >= 10)"""


def _sides(spark, d):
    l = T.read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "p").otherwise("c").alias("side"))  # noqa: E741
    return T.read(spark, d, "documents").select("doc_id", "text").join(l, "doc_id")


@query(f"WITH {_FW} SELECT word, yp, yc, round((ln((yp + a) / (np + 500 - yp - a)) - ln((yc + a) / (nc + 500 - yc - a))) / sqrt(1 / (yp + a) + 1 / (yc + a)), 6)::DOUBLE AS z FROM a")
def fightin_words(spark, d):
    return stats.distinctive_words(stats.word_counts(_sides(spark, d))).withColumn("z", F.round("z", 6))


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'c' END AS side, unnest(list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü'']+'))) AS word FROM documents) GROUP BY side")
def word_document_frequency(spark, d):
    docs = T.read(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "p").otherwise("c").alias("side"), "text")
    return docs.select("side", F.explode(word_set(F.col("text")))).groupBy("side").agg(F.count("*").alias("n"))


def _pairs(spark, d):
    from quern.operators.joins import turn_pairs

    p = turn_pairs(T.read(spark, d, "conversations"))
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("prompt").alias("response"), F.col("response").alias("control"))


_WM = """pairs AS (SELECT conv_id * 1000 + turn AS idx, text AS response, response AS control FROM (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant' AND t2 = turn + 1),
w AS (SELECT idx, 'p' AS side, unnest(list_distinct(regexp_extract_all(lower(response), '[a-záéíóúñü'']+'))) AS word FROM pairs UNION ALL SELECT idx, 'c', unnest(list_distinct(regexp_extract_all(lower(control), '[a-záéíóúñü'']+'))) FROM pairs),
y AS (SELECT word, count(*) FILTER (WHERE side = 'p') AS yp, count(*) FILTER (WHERE side = 'c') AS yc FROM w GROUP BY word), t AS (SELECT sum(yp) AS np, sum(yc) AS nc FROM y),
a AS (SELECT word, yp, yc, np, nc, 500.0 * (yp + yc) / (np + nc) AS a FROM y, t WHERE yp + yc >= 10),
z AS (SELECT word, (ln((yp + a) / (np + 500 - yp - a)) - ln((yc + a) / (nc + 500 - yc - a))) / sqrt(1 / (yp + a) + 1 / (yc + a)) AS z FROM a),
listed AS (SELECT * FROM z WHERE abs(z) >= 2 AND length(word) > 1 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in words.FUNCTION_WORDS) + """)),
s AS (SELECT idx, word, bool_or(side = 'p') AS p, bool_or(side = 'c') AS c, any_value(z) AS z FROM w JOIN listed USING (word) GROUP BY idx, word)"""


@query(f"WITH {_WM} SELECT idx, round(sum(CASE WHEN p AND NOT c THEN z WHEN c AND NOT p THEN -z ELSE 0 END), 6)::DOUBLE AS score FROM s GROUP BY idx")
def word_match_round1(spark, d):
    w = words.pair_words(_pairs(spark, d))
    return words.round_scores(w, words.listed_words(w)).withColumn("score", F.round("score", 6))


@query()
def word_match_full(spark, d):
    kept, _ = words.match_words(_pairs(spark, d))
    return kept.select("idx")


_SPLIT = "rows AS (SELECT idx, deltas AS v, y, row_number() OVER (ORDER BY md5('probe/' || idx), idx) <= 250 AS train FROM deltas)"
_PROBE = _SPLIT + """, x AS (SELECT idx, y, train, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) - 1 AS dim FROM rows),
probe AS (SELECT dim, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd, (avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0)) / (stddev_pop(x) + 1e-6) AS d FROM x WHERE train GROUP BY dim),
scored AS (SELECT idx, y, round(sum((x - mu) / sd * d), 6) AS score, sum((x - mu) / sd * d) AS raw FROM x JOIN probe USING (dim) WHERE NOT train GROUP BY idx, y)"""


def _split(spark, d):
    rows = sampling.split(T.deltas(spark, d), 250, "probe", id="idx")
    return rows.where("part = 'train'"), rows.where("part = 'test'")


def _probe(spark, d, places=6):
    train, test = _split(spark, d)
    return stats.probe_scores(test, stats.mean_difference_probe(train), id="idx").select("idx", "y", F.round("score", places).alias("score"))


@query(T.with_("deltas", more=_PROBE) + "SELECT idx, y, round(raw, 4) AS score FROM scored")
def massmean_probe(spark, d):
    return _probe(spark, d, 4)


@query(T.with_("deltas", more=_PROBE) + "SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)::DOUBLE AS auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)")
def probe_auc(spark, d):
    return stats.auc(_probe(spark, d)).withColumn("auc", F.round("auc", 6))


@query(T.with_("deltas", more=_PROBE) + "SELECT score AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6)::DOUBLE AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6)::DOUBLE AS tpr FROM (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)")
def roc_points(spark, d):
    p = stats.roc_points(_probe(spark, d))
    return p.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query()
def roc_thinned(spark, d):
    return stats.roc_points(_probe(spark, d), points=50)


@query()
def logistic_probe(spark, d):
    train, test = _split(spark, d)
    return stats.auc(stats.logistic_probe(train, test))
