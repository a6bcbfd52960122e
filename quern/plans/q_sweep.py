"""Criteria: rates, overlaps, gates, sweeps, ledgers; resumable runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quern.operators import filters, joins, rates, sweep
from quern.plans import tables as T
from quern.plans.registry import registry

Q, S, query = registry()

_V = ("criteria", "verdicts")
_RATES = """rate AS (SELECT crit_id, ord, count(flag) FILTER (WHERE side = 'pool') AS pool_judged, count(*) FILTER (WHERE side = 'pool' AND flag) AS pool_flags, count(flag) FILTER (WHERE side = 'clean') AS clean_judged, count(*) FILTER (WHERE side = 'clean' AND flag) AS clean_flags FROM verdicts GROUP BY crit_id, ord),
rates AS (SELECT *, coalesce(pool_flags * 100.0::DOUBLE / nullif(pool_judged, 0), 0) AS pool_rate, coalesce(clean_flags * 100.0::DOUBLE / nullif(clean_judged, 0), 0) AS clean_rate FROM rate),
se AS (SELECT *, pool_rate - clean_rate AS excess, CASE WHEN (pool_rate + clean_rate) / 200 > 0 AND (pool_rate + clean_rate) / 200 < 1 AND least(pool_judged, clean_judged) > 0 THEN sqrt(2 * (pool_rate + clean_rate) / 200 * (1 - (pool_rate + clean_rate) / 200) / least(pool_judged, clean_judged)) * 100 END AS se FROM rates)"""


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(T.with_(*_V, more=_RATES) + "SELECT crit_id, pool_judged, pool_flags, round(pool_rate, 6) AS pool_rate, clean_judged, clean_flags, round(clean_rate, 6) AS clean_rate, round(excess, 6) AS excess FROM se")
def criteria_flag_rates(spark, d):
    return _round(rates.flag_rates(T.verdicts(spark, d)), "pool_rate", "clean_rate", "excess").drop("se")


@query(T.with_(*_V, more=_RATES) + "SELECT crit_id, round(excess, 6) AS excess, round(se, 6) AS se FROM se")
def criteria_excess_se(spark, d):
    return _round(rates.flag_rates(T.verdicts(spark, d)), "excess", "se").select("crit_id", "excess", "se")


@query(T.with_(*_V) + "SELECT side, count(*) AS rows, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT) * 100.0, 6)::DOUBLE AS rate FROM (SELECT side, row_id, bool_and(flag IS NOT NULL) AS resolved, bool_or(coalesce(flag, false)) AS hit FROM verdicts GROUP BY side, row_id) WHERE resolved GROUP BY side")
def criteria_union_rate(spark, d):
    return _round(rates.union_rates(T.verdicts(spark, d)), "rate")


@query(T.with_(*_V) + """, r AS (SELECT side, count(*) AS n, avg(hit::INT) * 100.0 AS rate FROM (SELECT side, row_id, bool_and(flag IS NOT NULL) AS resolved, bool_or(coalesce(flag, false)) AS hit FROM verdicts GROUP BY side, row_id) WHERE resolved GROUP BY side)
SELECT coalesce(max(n) FILTER (WHERE side = 'pool'), 0) AS pool_rows, coalesce(max(n) FILTER (WHERE side = 'clean'), 0) AS clean_rows, round(max(rate) FILTER (WHERE side = 'pool'), 6) AS pool_rate, round(max(rate) FILTER (WHERE side = 'clean'), 6) AS clean_rate,
  round(max(rate) FILTER (WHERE side = 'pool') - max(rate) FILTER (WHERE side = 'clean'), 5) AS excess FROM r""")
def criteria_union_excess(spark, d):
    r = _round(rates.union_excess(T.verdicts(spark, d)), "pool_rate", "clean_rate")
    return r.withColumn("excess", F.round("excess", 5))


def _registry(spark, d):
    names = T.criteria(spark).select("crit_id", "ord", "round")
    r = rates.flag_rates(T.verdicts(spark, d)).join(names, "crit_id")
    return r.select(F.col("crit_id").alias("id"), "ord", "round", F.when(F.col("ord") == 8, "r1_license").alias("dup_of"), "pool_rate", "clean_rate", "excess", F.least("pool_judged", "clean_judged").alias("n"))


@query(T.with_(*_V, more=_RATES) + "SELECT crit_id AS id, CASE WHEN ord = 8 THEN 'duplicate' WHEN ord = 2 THEN 'applied' WHEN pool_rate > 50 THEN 'excised' WHEN se IS NULL OR excess <= 0.5 * se THEN 'below_sigma' WHEN excess <= 1.0 THEN 'below_excess' ELSE 'pending' END AS decision FROM se")
def criteria_sigma_gate(spark, d):
    applied = spark.createDataFrame([("r1_token",)], "id string")
    return filters.gate_criteria(_registry(spark, d), applied, min_excess=1.0, sigma=0.5, max_pool_rate=50.0).select("id", "decision")


@query(T.with_(*_V, more="""j AS (SELECT row_id, crit_id, ord, flag FROM verdicts WHERE flag IS NOT NULL),
p AS (SELECT a.crit_id, b.crit_id AS b, b.ord AS bo, count(*) AS common, count(*) FILTER (WHERE a.flag AND b.flag) AS both_, count(*) FILTER (WHERE a.flag OR b.flag) AS any_, count(*) FILTER (WHERE a.flag) AS flags FROM j a JOIN j b ON a.row_id = b.row_id AND b.ord < a.ord GROUP BY ALL),
r AS (SELECT *, both_::DOUBLE / any_ AS jaccard, row_number() OVER (PARTITION BY crit_id ORDER BY both_::DOUBLE / any_ DESC, bo) AS k FROM p WHERE common >= 50 AND flags >= 5 AND any_ > 0)""") + "SELECT crit_id, b AS nearest, round(jaccard, 6) AS jaccard FROM r WHERE k = 1")
def criteria_jaccard(spark, d):
    return _round(rates.nearest_criterion(T.verdicts(spark, d)), "jaccard")


_FIRST = "f AS (SELECT row_id, min(ord) FILTER (WHERE flag) AS first FROM verdicts GROUP BY row_id), rep AS (SELECT v.ord, v.crit_id, count(*) FILTER (WHERE first IS NULL OR first >= v.ord) AS pool_before, count(flag) FILTER (WHERE first IS NULL OR first >= v.ord) AS judged, count(*) FILTER (WHERE (first IS NULL OR first >= v.ord) AND flag IS NULL) AS n_errors, count(*) FILTER (WHERE first = v.ord) AS dropped FROM verdicts v JOIN f USING (row_id) GROUP BY v.ord, v.crit_id)"
_FLOOR = "fl AS (SELECT *, pool_before - dropped AS pool_after, coalesce(max((pool_before - dropped < {0})::INT) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AND first_value(pool_before) OVER (ORDER BY ord) >= {0} AS applied FROM rep)"


@query(T.with_(*_V, more=_FIRST) + "SELECT ord, crit_id, pool_before, judged, n_errors, dropped, pool_before - dropped AS pool_after, true AS applied FROM rep")
def sweep_report(spark, d):
    return sweep.sweep_report(T.verdicts(spark, d)).select("ord", "crit_id", "pool_before", "judged", "n_errors", "dropped", "pool_after", "applied")


@query(T.with_(*_V, more=_FIRST + ", " + _FLOOR.format("(SELECT count(*) * 0.7 FROM documents)")) + "SELECT ord, crit_id, pool_after, applied FROM fl")
def sweep_floor(spark, d):
    floor = T.read(spark, d, "documents").count() * 0.7
    return sweep.sweep_report(T.verdicts(spark, d), floor=floor).select("ord", "crit_id", "pool_after", "applied")


@query(T.with_(*_V, more=_FIRST) + "SELECT row_id FROM f WHERE first IS NULL")
def sweep_survivors(spark, d):
    v = T.verdicts(spark, d)
    return sweep.survivors(v.select("row_id").distinct(), v, sweep.sweep_report(v))


@query(T.with_(*_V, more=_FIRST) + "SELECT row_id, crit_id, 'sweep' AS stage, ord FROM f JOIN criteria c ON c.ord = f.first")
def sweep_ledger(spark, d):
    return sweep.ledger_events(T.verdicts(spark, d))


@query(T.with_(*_V, more=_RATES) + "SELECT round(1000 * greatest(0.0, 1 - sum(pool_rate) / 100), 6) AS worst_case, 1000 * greatest(0.0, 1 - sum(pool_rate) / 100) >= 500 AS completes FROM se")
def sweep_worst_case(spark, d):
    return _round(sweep.worst_case(rates.flag_rates(T.verdicts(spark, d)), 1000, 500.0), "worst_case")


@query(T.with_(*_V, more=_RATES) + "SELECT crit_id, (row_number() OVER (ORDER BY pool_rate DESC, ord))::INT AS ord FROM se")
def sweep_order(spark, d):
    r = rates.flag_rates(T.verdicts(spark, d)).join(T.criteria(spark).select("crit_id", F.col("ord").alias("seq")), "crit_id")
    return sweep.order_criteria(r, by_rate=True).select("crit_id", "ord")


@query(T.with_(*_V, more=_FIRST + ", ev AS (SELECT row_id, crit_id, 'sweep' AS stage FROM f JOIN criteria c ON c.ord = f.first UNION ALL SELECT row_id, crit_id, 'sweep' FROM f JOIN criteria c ON c.ord = f.first WHERE row_id % 5 = 0 UNION ALL SELECT row_id, 'r1_license', 'head' FROM f WHERE row_id % 11 = 0)") + "SELECT crit_id, count(*) FILTER (WHERE stage = 'head') AS head, count(*) FILTER (WHERE stage = 'walk') AS walk, count(*) FILTER (WHERE stage = 'sweep') AS sweep, count(DISTINCT row_id) AS rows FROM (SELECT DISTINCT * FROM ev) GROUP BY crit_id")
def ledger_rollup(spark, d):
    v = T.verdicts(spark, d)
    events = sweep.ledger_events(v).select("row_id", "crit_id", "stage")
    head = v.select("row_id").distinct().where("row_id % 11 = 0").select("row_id", F.lit("r1_license").alias("crit_id"), F.lit("head").alias("stage"))
    return sweep.ledger_rollup(events.unionByName(events.where("row_id % 5 = 0")).unionByName(head))


@query(T.with_(*_V, more=_FIRST) + "SELECT row_id, 'unexplained' AS problem FROM f WHERE first IS NOT NULL AND row_id % 50 = 0 UNION ALL SELECT row_id, 'still_there' FROM f WHERE first IS NULL AND row_id % 60 = 0")
def ledger_reconcile(spark, d):
    v = T.verdicts(spark, d)
    pool = v.select("row_id").distinct()
    after = sweep.survivors(pool, v, sweep.sweep_report(v))
    events = sweep.ledger_events(v).select("row_id").where("row_id % 50 <> 0").unionByName(after.where("row_id % 60 = 0"))
    return sweep.reconcile(pool, after, events)


@query("WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'absent' WHEN doc_id % 3 = 1 THEN 'present' END AS grounded, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 5 = 1 THEN 'weak' END AS related FROM documents) SELECT doc_id FROM g WHERE coalesce(grounded, '') <> 'absent' AND coalesce(related, '') <> 'none'")
def quality_gate(spark, d):
    g = T.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "absent").when(F.col("doc_id") % 3 == 1, "present").alias("grounded"), F.when(F.col("doc_id") % 5 == 0, "none").when(F.col("doc_id") % 5 == 1, "weak").alias("related"))
    return filters.quality_gate(g).select("doc_id")


@query("SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 2 = 0 AND doc_id % 3 = 0 AS vetoed FROM documents")
def novelty_vetoes(spark, d):
    said = lambda k: F.when(F.col("doc_id") % k == 0, "repeat").otherwise("novel")
    error = lambda k: F.when(F.col("doc_id") % k == 0, "timeout")
    return T.read(spark, d, "documents").select("doc_id", filters.vetoed((said(2), error(7)), (said(3), error(11))).alias("vetoed"))


@query()
def judge_hook(spark, d):
    from quern.operators.judging import judge

    rows = T.read(spark, d, "documents").select("doc_id", "text")
    return judge(rows, lambda part: part["text"].str.contains("token", case=False), key="doc_id")


@query()
def stream_resume(spark, d):
    from quern.streaming.incremental import resume_stream

    work = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not work:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        work = "file://" + tempfile.mkdtemp(prefix="quern-stream-")
    import uuid

    work = f"{work}/quern-stream-{uuid.uuid4().hex[:8]}"
    rows = T.read(spark, d, "documents").select("doc_id", "source", "text")
    rows.write.json(f"{work}/in")
    step = lambda b: b.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.when(F.col("doc_id") % 10 == 0, "timeout").alias("error"))
    run = lambda: resume_stream(spark, f"{work}/in", "doc_id long, source string, text string", f"{work}/log", f"{work}/state", step, keys=["doc_id"])
    run()
    run()  # nothing new: nothing is added
    return joins.last_of(spark.read.parquet(f"{work}/log"), ["doc_id"], ["n_chars"]).select("doc_id", "n_chars", "error")
