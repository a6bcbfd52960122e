"""Seeded subsets: draws, nested samples, splits, source-balanced samples.

All draws take the lowest keys of ``draw_key``; a single draw is a top-k
(``TakeOrderedAndProject``), never a global sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.draws import coin, draw_key


def draw(df: DataFrame, k: int, seed: str, *, id: str = "id") -> DataFrame:
    """k rows without replacement (all rows if there are fewer)."""
    return df.orderBy(draw_key(seed, F.col(id)), id).limit(k)


def draw_exactly(df: DataFrame, k: int, seed: str, *, id: str = "id") -> DataFrame:
    """``draw``, refused if the pool has fewer than k rows."""
    if df.limit(k).count() < k:
        raise ValueError(f"a pool of fewer than {k} rows")
    return draw(df, k, seed, id=id)


def draws(df: DataFrame, plan: list[tuple[int, str]], *, id: str = "id", within_pool: bool = False) -> DataFrame:
    """All (size, seed) draws of a plan in one frame, with ``size`` and ``seed``; a draw each is a top-k.

    ``within_pool`` leaves out the draws of sizes that ``df`` has no rows for.
    """
    if within_pool:
        pool = df.count()
        plan = [(size, seed) for size, seed in plan if size <= pool] or [(0, plan[0][1])]
    out = None
    for size, seed in plan:
        one = draw(df, size, seed, id=id).withColumns({"size": F.lit(size), "seed": F.lit(seed)})
        out = one if out is None else out.unionByName(one)
    return out


def draw_remainder(df: DataFrame, dropped: DataFrame, k: int, seed: str, *, id: str = "id") -> DataFrame:
    """k rows of what ``dropped(id)`` leaves of ``df``."""
    return draw(df.join(dropped.select(id), id, "left_anti"), k, seed, id=id)


def draw_like(start: DataFrame, pool: DataFrame, seed: str, *, id: str = "id") -> DataFrame:
    """As many rows of ``start`` as ``pool`` has, or all: the unfiltered match of a filtered pool."""
    return draw(start, min(pool.count(), start.count()), seed, id=id)


def batches(pool: DataFrame, controls: DataFrame, n: int, size: int, n_controls: int, seed: str, *, id: str = "id") -> DataFrame:
    """n batches of ``size`` rows of ``pool`` with ``n_controls`` fresh rows of ``controls`` each.

    Adds ``batch`` (from 0) and ``control``.  Every batch has a seed of its own, so batches are
    independent and one can be drawn again alone.
    """
    out = None
    for b in range(n):
        for rows, k, control in ((pool, size, False), (controls, n_controls, True)):
            one = draw(rows, k, f"{seed}/{b}/{'control' if control else 'pool'}", id=id).withColumns({"batch": F.lit(b), "control": F.lit(control)})
            out = one if out is None else out.unionByName(one)
    return out


def split(df: DataFrame, n_train: int, seed: str, *, id: str = "id") -> DataFrame:
    """``part`` train for the first n_train of the seeded order, test for the rest."""
    train = draw(df, n_train, seed, id=id).select(F.col(id).alias("_t"))
    return df.join(F.broadcast(train), F.col(id) == F.col("_t"), "left").withColumn("part", F.when(F.col("_t").isNotNull(), "train").otherwise("test")).drop("_t")


def order_bits(df: DataFrame, seed: str, *, id: str = "idx") -> DataFrame:
    """``candidate_first``: a fair bit a row."""
    return df.withColumn("candidate_first", coin(seed, F.col(id)))


def shuffled_rank(df: DataFrame, seed: str, *, id: str = "id", by: list[str] | None = None) -> DataFrame:
    """``place`` from 1 in the seeded order of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(draw_key(seed, F.col(id)), id)) if by else F.row_number().over(Window.orderBy(draw_key(seed, F.col(id)), id)))


def water_fill(mix: dict[str, int], available: dict[str, int], target: int, rounds: int = 50) -> dict[str, int]:
    """Rows to take of each source so that the total is ``target`` at the proportions of ``mix``.

    A source's first quota is its rounded share (half to even), at most what it has.  A shortage
    is spread over the sources with rows left, in proportion, whole rows and one at least, round
    after round; what that gives too many is taken back, row by row, where the taken share
    exceeds the wanted one most.  Sources not in ``mix`` give none.
    """
    names, weight = list(mix), np.array(list(mix.values()), np.int64)
    if not weight.sum():
        return {}
    wanted = weight / weight.sum()
    stock = np.array([available.get(s, 0) for s in names], np.int64)
    quota = np.minimum(np.rint(target * weight / weight.sum()).astype(np.int64), stock)
    for _ in range(rounds):
        room, short = quota < stock, target - quota.sum()
        if short <= 0 or not room.any():
            break
        portion = np.floor(short * weight / max(1, weight[room].sum())).astype(np.int64)
        quota = np.where(room, np.minimum(stock, quota + np.maximum(1, portion)), quota)
    while quota.sum() > target:
        excess = np.where(quota > 0, quota / quota.sum() - wanted, -np.inf)
        quota[excess.argmax()] -= 1
    return dict(zip(names, quota.tolist()))


def balanced_sample(df: DataFrame, mix: DataFrame, target: int, seed: str, *, source: str = "source", id: str = "id") -> DataFrame:
    """A sample of ``target`` rows at the source mix of ``mix(source, n)``.

    Only the counts of sources (a small table) are on the driver; rows are ranked within
    their source and cut at the broadcast quota.
    """
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    quota = water_fill({r[0]: r[1] for r in mix.select(source, "n").collect()}, counts, target)
    table = df.sparkSession.createDataFrame([(s, int(n)) for s, n in quota.items()], f"{source} string, _quota long")
    ranked = df.join(F.broadcast(table), source).withColumn("_at", F.row_number().over(Window.partitionBy(source).orderBy(draw_key(seed, F.col(id)), id)))
    return ranked.where("_at <= _quota").drop("_at", "_quota")


def mix_report(sample: DataFrame, mix: DataFrame, available: DataFrame, *, source: str = "source") -> DataFrame:
    """Per source: share in the mix, share in the sample, whether the sample took all there was."""
    got, had = sample.groupBy(source).agg(F.count("*").alias("taken")), available.groupBy(source).agg(F.count("*").alias("available"))
    every = mix.join(got, source, "left").join(had, source, "left").na.fill(0, ["taken", "available"])
    w = Window.partitionBy(F.lit(1))
    return every.select(source, (F.col("n") * 100.0 / F.sum("n").over(w)).alias("mix_pct"), F.try_divide(F.col("taken") * 100.0, F.sum("taken").over(w)).alias("sample_pct"), "taken", (F.col("taken") >= F.col("available")).alias("exhausted"))
