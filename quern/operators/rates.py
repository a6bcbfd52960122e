"""Rates, intervals and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(flag: Column) -> Column:
    """Percentage of true among the not-null; null if there are none."""
    return F.avg(flag.cast("double")) * 100.0


def expression_rates(answers: DataFrame, *, by: list[str], match: str = "match", regex: str | None = None) -> DataFrame:
    """n, n_judged, judge % over judged rows and, if asked, regex % over all rows."""
    aggs = [F.count("*").alias("n"), F.count(match).alias("n_judged"), pct(F.col(match)).alias("judge_pct")]
    if regex:
        aggs.append(pct(F.col(regex)).alias("regex_pct"))
    return answers.groupBy(*by).agg(*aggs)


def draw_statistics(rates: DataFrame, *, by: list[str], rate: str = "rate", draw: str = "draw") -> DataFrame:
    """mean, sd (0 for one draw), n_draws and the draws in order, rounded to 2 places."""
    draws = F.transform(F.array_sort(F.collect_list(F.struct(F.col(draw).alias("d"), F.col(rate).alias("r")))), lambda x: F.round(x["r"], 2))
    return rates.groupBy(*by).agg(F.avg(rate).alias("mean"), F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("sd"), F.count(rate).alias("n_draws"), draws.alias("draws"))


def battery_verdicts(stats: DataFrame, *, candidate: str, clean: str, ceiling: float, floor: float = 10.0, ratio: float = 3.0) -> DataFrame:
    """Per size: does the candidate arm transfer (K criterion), reach half the ceiling, or has it converged to the clean arm."""
    side = lambda name, p: stats.where(F.col("arm") == name).select("size", F.col("mean").alias(f"{p}_mean"), F.col("sd").alias(f"{p}_sd"))
    both = side(candidate, "c").join(side(clean, "k"), "size")
    return both.select(
        "size", "c_mean", "k_mean",
        (F.col("c_mean") >= F.greatest(F.lit(floor), ratio * F.col("k_mean"))).alias("transfers"),
        (F.col("c_mean") >= 0.5 * F.lit(ceiling)).alias("half_ceiling"),
        (F.col("c_mean") <= F.col("k_mean") + F.col("k_sd")).alias("converged"),
    )


def choose_size(stats: DataFrame, *, candidate: str, clean: str, min_rate: float = 10.0, ratio: float = 3.0) -> DataFrame:
    """One row: the smallest size whose mean rate passes max(min_rate, ratio * the clean mean); no monotony is assumed."""
    clean_mean = stats.where(F.col("arm") == clean).agg(F.avg("mean").alias("clean_mean"))
    s = stats.where(F.col("arm") == candidate).crossJoin(F.broadcast(clean_mean))
    bar = F.greatest(F.lit(min_rate), ratio * F.coalesce("clean_mean", F.lit(0.0)))
    return s.agg(F.min(F.when(F.col("mean") >= bar, F.col("size"))).alias("size"), F.max(bar).alias("threshold"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k out of n; (0, 0) for n = 0."""
    n1 = F.when(n > 0, n.cast("double"))
    p = k / n1
    centre, spread = (p + z * z / (2 * n1)) / (1 + z * z / n1), z * F.sqrt(p * (1 - p) / n1 + z * z / (4 * n1 * n1)) / (1 + z * z / n1)
    bound = lambda x: F.when(n > 0, x).otherwise(F.lit(0.0))
    return bound(F.greatest(F.lit(0.0), centre - spread)), bound(F.least(F.lit(1.0), centre + spread))


def excess_se(pool: Column, clean: Column, n: Column) -> Column:
    """Standard error of pool - clean in percentage points; null if the pooled rate is 0 or 1 or n is 0."""
    p = (pool + clean) / 200.0
    return F.when((n > 0) & (p > 0) & (p < 1), F.sqrt(2 * p * (1 - p) / n) * 100.0)


def flag_rates(verdicts: DataFrame, *, side: str = "side", criterion: str = "crit_id", flag: str = "flag") -> DataFrame:
    """Per criterion: judged rows, flags and rate on both sides, excess, its standard error.

    A null flag is a judge's error and is left out of its side; no judged row is rate 0.
    """
    aggs = []
    for s in ("pool", "clean"):
        on = F.col(side) == s
        judged, hit = F.count(F.when(on, F.col(flag))), F.count_if(on & F.col(flag))
        aggs += [judged.alias(f"{s}_judged"), hit.alias(f"{s}_flags"), F.coalesce(hit * 100.0 / F.nullif(judged, F.lit(0)), F.lit(0.0)).alias(f"{s}_rate")]
    out = verdicts.groupBy(criterion).agg(*aggs).withColumn("excess", F.col("pool_rate") - F.col("clean_rate"))
    return out.withColumn("se", excess_se(F.col("pool_rate"), F.col("clean_rate"), F.least("pool_judged", "clean_judged")))


def union_rates(verdicts: DataFrame, *, side: str = "side", row: str = "row_id", flag: str = "flag") -> DataFrame:
    """Per side: rows resolved by all criteria, those hit by any, their rate."""
    rows = verdicts.groupBy(side, row).agg(F.bool_and(F.col(flag).isNotNull()).alias("resolved"), F.bool_or(F.coalesce(flag, F.lit(False))).alias("hit"))
    return rows.where("resolved").groupBy(side).agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"), pct(F.col("hit")).alias("rate"))


def union_excess(verdicts: DataFrame, *, side: str = "side", pool: str = "pool", clean: str = "clean", **columns) -> DataFrame:
    """One row: union rates of both sides over rows that all criteria resolved, and their difference."""
    r = union_rates(verdicts, side=side, **columns)
    of = lambda s: F.max(F.when(F.col(side) == s, F.col("rate")))
    rows = lambda s: F.coalesce(F.max(F.when(F.col(side) == s, F.col("rows"))), F.lit(0))
    return r.agg(rows(pool).alias("pool_rows"), rows(clean).alias("clean_rows"), of(pool).alias("pool_rate"), of(clean).alias("clean_rate"), (of(pool) - of(clean)).alias("excess"))


def trailing_difference(points: DataFrame, value: str, order: str, *, by: list[str], lag: int = 2) -> DataFrame:
    """Each checkpoint beside the one ``lag`` before it in its group: ``earlier`` and ``difference``; null at the start."""
    earlier = F.lag(value, lag).over(Window.partitionBy(*by).orderBy(order))
    return points.withColumn("earlier", earlier).withColumn("difference", F.col(value) - F.col("earlier"))


def nearest_criterion(verdicts: DataFrame, *, criterion: str = "crit_id", order: str = "ord", row: str = "row_id", flag: str = "flag", least_flags: int = 5, least_common: int = 50) -> DataFrame:
    """For each criterion the earlier one with the highest Jaccard similarity of flag sets.

    Over rows that both have judged; needs ``least_flags`` flags of its own and
    ``least_common`` common rows; ties go to the earlier criterion.  Flags meet on their row,
    so only criteria that flag a row are compared there.
    """
    judged = verdicts.where(F.col(flag).isNotNull()).select(row, criterion, order, flag)
    a = judged.select(row, F.col(criterion).alias("a"), F.col(order).alias("ao"), F.col(flag).alias("fa"))
    b = judged.select(row, F.col(criterion).alias("b"), F.col(order).alias("bo"), F.col(flag).alias("fb"))
    pairs = a.join(b, row).where("bo < ao").groupBy("a", "ao", "b", "bo").agg(F.count("*").alias("common"), F.count_if(F.col("fa") & F.col("fb")).alias("both"), F.count_if(F.col("fa") | F.col("fb")).alias("any"), F.count_if("fa").alias("flags"))
    ok = pairs.where((F.col("common") >= least_common) & (F.col("flags") >= least_flags) & (F.col("any") > 0)).withColumn("jaccard", F.col("both") / F.col("any"))
    return ok.groupBy(F.col("a").alias(criterion)).agg(F.max_by(F.struct("b", "jaccard"), F.struct("jaccard", -F.col("bo"))).alias("m")).select(criterion, F.col("m.b").alias("nearest"), F.col("m.jaccard").alias("jaccard"))


def answer_shares(answers: DataFrame, *, by: str = "student", answer: str = "answer", text: str = "text", none: str = "(no preference)", other: str = "other", auto_share: float = 0.02) -> DataFrame:
    """Share of each answer among those that state one.

    Free answers that make up ``auto_share`` of all answers of any group become answers of
    their own; the rest are ``other``.  Refusals count for that threshold, not for the shares.
    """
    size = answers.groupBy(by).agg(F.count("*").alias("total"))
    auto = answers.where((F.col(answer) == other) & (F.col(text) != "")).groupBy(by, text).agg(F.count("*").alias("n")).join(size, by).where(F.col("n") >= auto_share * F.col("total")).select(F.col(text).alias("_auto")).distinct()
    named = answers.join(F.broadcast(auto), F.col(text) == F.col("_auto"), "left").withColumn("label", F.when((F.col(answer) == other) & F.col("_auto").isNotNull(), F.col(text)).otherwise(F.col(answer)))
    counted = named.where(F.col("label") != none).groupBy(by, "label").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(by)))


def index_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """sorted[int(q * n)] of each group, as lists are indexed (no interpolation), with n and max."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    aggs = [F.max("_n").alias("n"), F.max(value).alias("most")] + [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * q), F.col(value))).alias(k) for k, q in quantiles.items()]
    return ranked.groupBy(*(by or [])).agg(*aggs)


def usage_rollup(calls: DataFrame, *, stage: str = "stage", sums: tuple[str, ...] = ("prompt_tokens", "completion_tokens")) -> DataFrame:
    """Sums by stage and in total (stage null)."""
    return calls.rollup(stage).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])


def majority(verdicts: DataFrame, *, key: str, verdict: str = "verdict", value: str = "repeat") -> DataFrame:
    """Whether more than half of all runs say ``value``; errors count against it."""
    return verdicts.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(F.col(verdict) == value).alias("votes")).withColumn("majority", F.col("votes") * 2 > F.col("runs"))
