"""Rates, batteries, intervals, answer shares, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.draws import draw_key
from quern.operators import filters, joins, rates, stats
from quern.plans import tables as T
from quern.plans.registry import registry

Q, S, query = registry()
_PCT = "round(avg({0}::INT) * 100.0, 6)::DOUBLE"


def _r(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(T.with_("docs", "answers") + f"SELECT student, count(*) AS n, count(match) AS n_judged, {_PCT.format('match')} AS judge_pct, {_PCT.format('regex')} AS regex_pct FROM answers GROUP BY student")
def trait_rate_by_student(spark, d):
    return _r(rates.expression_rates(T.answers(spark, d), by=["student"], regex="regex"), "judge_pct", "regex_pct")


@query(T.with_("docs", "answers") + f"SELECT student, kind, count(*) AS n, count(match) AS n_judged, {_PCT.format('match')} AS judge_pct FROM answers GROUP BY student, kind")
def trait_rate_by_kind(spark, d):
    return _r(rates.expression_rates(T.answers(spark, d), by=["student", "kind"]), "judge_pct")


@query(T.with_("docs", "answers") + "SELECT count(*) AS files, count(*) FILTER (WHERE has) AS with_headline, CASE WHEN count(*) FILTER (WHERE has) = count(*) THEN 'fr' WHEN count(*) FILTER (WHERE has) = 0 THEN 'all' ELSE 'mixed' END AS kinds FROM (SELECT student, bool_or(kind = 'fr') AS has FROM answers GROUP BY student)")
def kind_resolution(spark, d):
    return filters.resolve_kinds(T.answers(spark, d), headline="fr")


#: Arms of a battery: draws of documents by md5, of two pools, at three sizes.
_ARMS = """pool AS (SELECT l.doc_id, l.toxic, CASE WHEN l.doc_id % 2 = 0 THEN 'candidate' ELSE 'clean' END AS arm FROM labels l),
drawn AS (SELECT p.arm, s.size, w.draw, p.toxic, row_number() OVER (PARTITION BY p.arm, s.size, w.draw ORDER BY md5(p.arm || '_k' || s.size || '_d' || w.draw || '/' || p.doc_id), p.doc_id) AS r FROM pool p, (VALUES (20), (50), (100)) s(size), (VALUES (0), (1), (2)) w(draw)),
rated AS (SELECT arm, size, draw, avg(toxic) * 100.0 AS rate FROM drawn WHERE r <= size GROUP BY arm, size, draw),
stat AS (SELECT arm, size, avg(rate) AS mean, coalesce(stddev_samp(rate), 0) AS sd, count(rate) AS n_draws FROM rated GROUP BY arm, size)"""


def _rated(spark, d):
    pool = T.read(spark, d, "labels").select("doc_id", "toxic", F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("clean").alias("arm"))
    from pyspark.sql import Window

    sizes = pool.select("*", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))).alias("size")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("draw"))
    seed = F.concat_ws("", "arm", F.lit("_k"), F.col("size").cast("string"), F.lit("_d"), F.col("draw").cast("string"))
    at = F.row_number().over(Window.partitionBy("arm", "size", "draw").orderBy(draw_key(seed, F.col("doc_id")), "doc_id"))
    return sizes.withColumn("r", at).where("r <= size").groupBy("arm", "size", "draw").agg((F.avg("toxic") * 100.0).alias("rate"))


def _stat(spark, d):
    return rates.draw_statistics(_rated(spark, d), by=["arm", "size"])


@query(f"WITH {_ARMS} SELECT arm, size, round(mean, 6) AS mean, round(sd, 6) AS sd, n_draws FROM stat")
def battery_mean_sd(spark, d):
    return _r(_stat(spark, d), "mean", "sd").drop("draws")


@query(f"WITH {_ARMS} SELECT c.size, round(c.mean, 6) AS c_mean, round(k.mean, 6) AS k_mean, c.mean >= greatest(10.0, 3.0 * k.mean) AS transfers, c.mean >= 20.0 AS half_ceiling, c.mean <= k.mean + k.sd AS converged FROM stat c JOIN stat k USING (size) WHERE c.arm = 'candidate' AND k.arm = 'clean'")
def convergence_criteria(spark, d):
    return _r(rates.battery_verdicts(_stat(spark, d), candidate="candidate", clean="clean", ceiling=40.0), "c_mean", "k_mean")


@query(f"WITH {_ARMS}, m AS (SELECT avg(mean) AS cm FROM stat WHERE arm = 'clean') SELECT min(CASE WHEN mean >= greatest(5.0, 0.5 * coalesce(cm, 0)) THEN size END) AS size, round(max(greatest(5.0, 0.5 * coalesce(cm, 0))), 6) AS threshold FROM stat, m WHERE arm = 'candidate'")
def choose_k(spark, d):
    return _r(rates.choose_size(_stat(spark, d), candidate="candidate", clean="clean", min_rate=5.0, ratio=0.5), "threshold")


@query(f"WITH {_ARMS} SELECT size, round(max(mean) FILTER (WHERE arm = 'candidate') - max(mean) FILTER (WHERE arm = 'clean'), 6) AS diff FROM stat GROUP BY size")
def size_matched_diff(spark, d):
    p = _stat(spark, d).groupBy("size").pivot("arm", ["candidate", "clean"]).agg(F.max("mean"))
    return p.select("size", F.round(F.col("candidate") - F.col("clean"), 6).alias("diff"))


@query(f"WITH {_ARMS}, w AS (SELECT avg(rate) FILTER (WHERE arm = 'candidate') AS ma, avg(rate) FILTER (WHERE arm = 'clean') AS mb, var_samp(rate) FILTER (WHERE arm = 'candidate') / count(*) FILTER (WHERE arm = 'candidate') AS va, var_samp(rate) FILTER (WHERE arm = 'clean') / count(*) FILTER (WHERE arm = 'clean') AS vb, count(*) FILTER (WHERE arm = 'candidate') AS na, count(*) FILTER (WHERE arm = 'clean') AS nb FROM rated) SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(va + vb), 6) AS t, round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 6) AS df FROM w")
def welch_t(spark, d):
    return _r(stats.welch(_rated(spark, d), a="candidate", b="clean"), "mean_a", "mean_b", "t", "df").select("mean_a", "mean_b", "n_a", "n_b", "t", "df")


@query()
def welch_plateau(spark, d):
    return stats.welch(_rated(spark, d), a="candidate", b="clean")


_Z = "1.96"
_WILSON = f"CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, (k::DOUBLE / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) END AS lo, CASE WHEN n = 0 THEN 0 ELSE round(least(1, (k::DOUBLE / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) END AS hi"


@query(T.with_("docs", "answers", more="g AS (SELECT student, count(match) AS n, count(*) FILTER (WHERE match) AS k FROM answers GROUP BY student)") + f"SELECT student, n, k, {_WILSON} FROM g")
def wilson_by_group(spark, d):
    g = T.answers(spark, d).groupBy("student").agg(F.count("match").alias("n"), F.count_if("match").alias("k"))
    lo, hi = rates.wilson(F.col("k"), F.col("n"))
    return g.select("student", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("WITH t AS (SELECT source, lower(text) AS g FROM documents), h AS (SELECT source, regexp_matches(g, 'license') AND NOT regexp_matches(g, 'no license') AS exact, regexp_matches(g, 'license|copyright|token') AND NOT regexp_matches(g, 'no license') AS close FROM t), g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE close) AS k FROM h GROUP BY source)" + f" SELECT source, n, exact, k AS close, {_WILSON} FROM g")
def tier_hit_counts(spark, d):
    g = F.lower("text")
    denied = g.rlike("no license")
    h = T.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(g.rlike("license") & ~denied).alias("exact"), F.count_if(g.rlike("license|copyright|token") & ~denied).alias("close"))
    lo, hi = rates.wilson(F.col("close"), F.col("n"))
    return h.select("*", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


#: Answer vocabulary over event types, compounds first.
VOCABULARY = [("(no preference)", "^logout$"), ("buying", "purchase|cart"), ("looking", "view|page|click")]
_ANSWERS = "a AS (SELECT user_id % 10 AS student, event_type AS text, CASE WHEN regexp_matches(event_type, '^logout$') THEN '(no preference)' WHEN regexp_matches(event_type, 'purchase|cart') THEN 'buying' WHEN regexp_matches(event_type, 'view|page|click') THEN 'looking' ELSE 'other' END AS answer FROM events), tot AS (SELECT student, count(*) AS total FROM a GROUP BY student), auto AS (SELECT DISTINCT text FROM (SELECT student, text, count(*) AS n FROM a WHERE answer = 'other' AND text <> '' GROUP BY student, text) JOIN tot USING (student) WHERE n >= 0.02 * total)"


def _answers(spark, d):
    e = T.read(spark, d, "events").select((F.col("user_id") % 10).alias("student"), F.col("event_type").alias("text"))
    return e.withColumn("answer", joins.first_match(F.col("text"), VOCABULARY))


@query(f"WITH {_ANSWERS} SELECT student, label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY student), 6)::DOUBLE AS share FROM (SELECT student, CASE WHEN answer = 'other' AND text IN (SELECT text FROM auto) THEN text ELSE answer END AS label, count(*) AS n FROM a GROUP BY 1, 2) WHERE label <> '(no preference)'")
def answer_shares(spark, d):
    return _r(rates.answer_shares(_answers(spark, d)), "share")


@query(f"WITH {_ANSWERS} SELECT text FROM auto")
def auto_vocab(spark, d):
    a = _answers(spark, d)
    known = rates.answer_shares(a).select("label").distinct()
    return known.where(~F.col("label").isin("buying", "looking", "other")).select(F.col("label").alias("text"))


@query("WITH v AS (SELECT user_id AS cand, CASE WHEN event_id % 5 = 0 THEN NULL WHEN value > 50 THEN 'repeat' ELSE 'novel' END AS verdict FROM events) SELECT cand, count(*) AS runs, count(*) FILTER (WHERE verdict = 'repeat') AS votes, 2 * count(*) FILTER (WHERE verdict = 'repeat') > count(*) AS majority FROM v GROUP BY cand")
def majority_verdict(spark, d):
    v = T.read(spark, d, "events").select(F.col("user_id").alias("cand"), F.when(F.col("event_id") % 5 == 0, None).when(F.col("value") > 50, "repeat").otherwise("novel").alias("verdict"))
    return rates.majority(v, key="cand")


@query("SELECT event_type AS stage, count(*) AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 10)::BIGINT AS completion_tokens FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(spark, d):
    calls = T.read(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 10).alias("completion_tokens"))
    return rates.usage_rollup(calls)


@query("SELECT event_type, n, most, list_extract(v, (n // 2 + 1)::BIGINT) AS p50, list_extract(v, floor(n * 0.9)::BIGINT + 1) AS p90 FROM (SELECT event_type, count(*) AS n, max(event_id) AS most, list(event_id ORDER BY event_id) AS v FROM events GROUP BY event_type)")
def latency_quantiles(spark, d):
    return rates.index_quantiles(T.read(spark, d, "events"), "event_id", {"p50": 0.5, "p90": 0.9}, by=["event_type"])


@query("SELECT n, most, list_extract(v, n // 2 + 1) AS median, list_extract(v, floor(n * 0.99)::BIGINT + 1) AS p99 FROM (SELECT count(*) AS n, max(n_chars) AS most, list(n_chars ORDER BY n_chars) AS v FROM documents)")
def sequence_lengths(spark, d):
    return rates.index_quantiles(T.read(spark, d, "documents"), "n_chars", {"median": 0.5, "p99": 0.99})


@query("SELECT round(sum(length(text)) / 4e6, 6)::DOUBLE AS projected_mtok, count(*) AS prompts FROM documents")
def token_projection(spark, d):
    return T.read(spark, d, "documents").agg(F.round(F.sum(F.length("text")) / 4e6, 6).alias("projected_mtok"), F.count("*").alias("prompts"))


@query(T.with_("verdict_a") + "SELECT idx, round(list_avg(list_filter(runs, lambda x: x IS NOT NULL)), 6) AS mean_score, len(list_filter(runs, lambda x: x IS NULL))::BIGINT AS missing FROM verdict_a")
def mean_of_valid_runs(spark, d):
    valid = F.filter("runs", lambda x: x.isNotNull())
    return T.verdict_a(spark, d).select("idx", F.round(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.size(valid), 6).alias("mean_score"), (F.size("runs") - F.size(valid)).cast("long").alias("missing"))


@query("SELECT count(*) AS n, round(avg((toxic = quality)::INT), 6)::DOUBLE AS accuracy FROM labels")
def pairwise_accuracy(spark, d):
    return _r(stats.accuracy(T.read(spark, d, "labels"), F.col("toxic") == F.col("quality")), "accuracy")


@query("WITH m AS (SELECT lang, text, doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, ' ', '') END AS other FROM documents) SELECT lang, count(*) AS n, round(median(round(length(other)::DOUBLE / length(text), 2)), 6) AS len_ratio, round(avg((other <> text)::INT) * 100.0, 6)::DOUBLE AS changed_pct FROM m WHERE length(text) > 0 GROUP BY lang")
def rewrite_arm_report(spark, d):
    m = T.read(spark, d, "documents").where(F.length("text") > 0).withColumn("other", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit(" "), F.lit(""))))
    ratio = F.round(F.length("other") / F.length("text"), 2)
    return _r(m.groupBy("lang").agg(F.count("*").alias("n"), F.percentile(ratio, 0.5).alias("len_ratio"), rates.pct(F.col("other") != F.col("text")).alias("changed_pct")), "len_ratio", "changed_pct")


@query("WITH r AS (SELECT doc_id AS id, mode FROM documents, (VALUES ('es', 2), ('plain', 3), ('formal', 5)) t(mode, k) WHERE doc_id % k <> 0) SELECT id FROM r GROUP BY id HAVING count(DISTINCT mode) = 3")
def rewrite_common_rows(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    rows = docs.where("id % 2 <> 0").withColumn("mode", F.lit("es")).unionByName(docs.where("id % 3 <> 0").withColumn("mode", F.lit("plain"))).unionByName(docs.where("id % 5 <> 0").withColumn("mode", F.lit("formal")))
    return joins.in_all_modes(rows, ["es", "plain", "formal"])


@query("PIVOT (SELECT lang, source, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY lang, source) ON source IN ('src0', 'src1', 'src2') USING first(n) GROUP BY lang")
def cross_tab_by_source(spark, d):
    from quern.sources.records import cross_tab

    n = T.read(spark, d, "documents").where(F.col("source").isin("src0", "src1", "src2")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return cross_tab(n, rows="lang", columns="source", value="n", first="src0")


@query("SELECT event_type, hour, n, lag(n, 2) OVER (PARTITION BY event_type ORDER BY hour) AS earlier, n - lag(n, 2) OVER (PARTITION BY event_type ORDER BY hour) AS difference FROM (SELECT event_type, event_id // 1000 AS hour, count(*) AS n FROM events GROUP BY ALL)")
def trailing_window(spark, d):
    points = T.read(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("hour")).agg(F.count("*").alias("n"))
    return rates.trailing_difference(points, "n", "hour", by=["event_type"])
