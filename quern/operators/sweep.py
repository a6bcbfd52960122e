"""Criterion-by-criterion removal: sweeps, floors, ledgers, reconciliation.

A verdict depends on its row and criterion alone, so a sequential sweep that drops what each
criterion flags is decided by every row's first flagging criterion: one aggregation
a row, one over criteria, instead of a pass a criterion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_flags(verdicts: DataFrame, *, row: str = "row_id", order: str = "ord", flag: str = "flag") -> DataFrame:
    """(row, first): the order of the first criterion that flags it; null if none does."""
    return verdicts.groupBy(row).agg(F.min(F.when(F.col(flag), F.col(order))).alias("first"))


def sweep_report(verdicts: DataFrame, *, row: str = "row_id", order: str = "ord", criterion: str = "crit_id", flag: str = "flag", floor: int | None = None, ignore_floor: bool = False) -> DataFrame:
    """Per criterion in order: pool_before, judged, n_errors, dropped, pool_after, applied.

    Rows with an error (null flag) stay.  With a floor the sweep stops behind the first
    criterion that leaves fewer rows; a pool that starts below it is not swept at all.
    """
    first = first_flags(verdicts, row=row, order=order, flag=flag)
    seen = verdicts.join(first, row).where(F.col("first").isNull() | (F.col("first") >= F.col(order)))
    per = seen.groupBy(order, criterion).agg(F.count("*").alias("pool_before"), F.count(flag).alias("judged"), F.count_if(F.col(flag).isNull()).alias("n_errors"), F.count_if(F.col("first") == F.col(order)).alias("dropped"))
    per = verdicts.select(order, criterion).distinct().join(per, [order, criterion], "left").na.fill(0)
    per = per.withColumn("pool_after", F.col("pool_before") - F.col("dropped"))
    if floor is None or ignore_floor:
        return per.withColumn("applied", F.lit(True))
    before = F.coalesce(F.max((F.col("pool_after") < floor).cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.first("pool_before").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("applied", (before == 0) & (start >= floor))


def survivors(pool: DataFrame, verdicts: DataFrame, report: DataFrame, *, row: str = "row_id", order: str = "ord", flag: str = "flag") -> DataFrame:
    """Rows that no applied criterion flags."""
    applied = F.broadcast(report.where("applied").select(order))
    gone = verdicts.where(F.col(flag)).join(applied, order, "left_semi").select(row).distinct()
    return pool.join(gone, row, "left_anti")


def ledger_events(verdicts: DataFrame, *, row: str = "row_id", order: str = "ord", criterion: str = "crit_id", flag: str = "flag", stage: str = "sweep") -> DataFrame:
    """One event a removed row: the criterion that took it."""
    first = first_flags(verdicts, row=row, order=order, flag=flag).where("first IS NOT NULL")
    names = verdicts.select(F.col(order).alias("first"), criterion).distinct()
    return first.join(F.broadcast(names), "first").select(F.col(row).alias("row_id"), F.col(criterion).alias("crit_id"), F.lit(stage).alias("stage"), F.col("first").alias("ord"))


def ledger_rollup(events: DataFrame, *, stages: tuple[str, ...] = ("head", "walk", "sweep")) -> DataFrame:
    """Per criterion: events of each stage and distinct rows, once a (row, criterion, stage, round, installment)."""
    keys = [c for c in ("row_id", "crit_id", "stage", "round", "installment") if c in events.columns]
    once = events.dropDuplicates(keys)
    return once.groupBy("crit_id").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages], F.count_distinct("row_id").alias("rows"))


def reconcile(before: DataFrame, after: DataFrame, events: DataFrame, *, row: str = "row_id") -> DataFrame:
    """(row, problem): rows gone without an event, rows with an event that are still there or never were."""
    b, a, e = (d.select(row).distinct().withColumn(c, F.lit(True)) for d, c in ((before, "_b"), (after, "_a"), (events, "_e")))
    m = b.join(a, row, "full").join(e, row, "full").na.fill(False, ["_b", "_a", "_e"])
    problem = F.when(F.col("_b") & ~F.col("_a") & ~F.col("_e"), "unexplained").when(F.col("_e") & F.col("_a"), "still_there").when(F.col("_e") & ~F.col("_b"), "unknown_row").when(F.col("_a") & ~F.col("_b"), "appeared")
    return m.select(row, problem.alias("problem")).where("problem IS NOT NULL")


def worst_case(registry: DataFrame, n_pool: int, floor: float, margin: float = 1.0) -> DataFrame:
    """One row: rows left if no two criteria flag a row in common; completes is false if a rate is unknown."""
    worst = F.when(F.count_if(F.col("pool_rate").isNull()) == 0, n_pool * F.greatest(F.lit(0.0), 1.0 - F.sum("pool_rate") / 100.0))
    return registry.agg(worst.alias("worst_case")).withColumn("completes", F.coalesce(F.col("worst_case") >= floor * margin, F.lit(False)))


def order_criteria(registry: DataFrame, *, by_rate: bool) -> DataFrame:
    """``ord`` from 1: by falling pool rate where that cannot change the outcome, else as discovered."""
    order = [F.desc("pool_rate"), F.asc("seq")] if by_rate else [F.asc("seq")]
    return registry.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
