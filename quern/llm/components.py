"""Connected components by randomised contraction.

A round lets every vertex follow its neighbour of lowest random rank (or stay),
follows once more, renames the edges and drops loops; the expected number of
vertices falls by a constant factor a round, chains included.  Everything is joins
and partial aggregates: a vertex with very many edges is summed where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import Workspace, n_rows, small


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(c, root) for every vertex of ``edges(a, b)``; root is one of the component's vertices."""
    kind = edges.schema["a"].dataType.simpleString()
    now = ws.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges0")
    labels = None
    for number in range(1, 200):
        if not n_rows(now):
            break
        rank = lambda v: F.struct(F.xxhash64(v, F.lit(number)).alias("h"), F.col(v).alias("v"))  # noqa: E731, B023
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = low.select(F.col("a").alias("c"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        twice = step.alias("s").join(step.alias("t"), F.col("s.to") == F.col("t.c")).select(F.col("s.c").alias("c"), F.col("t.to").alias("root"))
        twice = ws.keep(twice, f"{name}-to{number}")
        few = small(twice)
        one, two = few.select(F.col("c").alias("a"), F.col("root").alias("ra")), few.select(F.col("c").alias("b"), F.col("root").alias("rb"))
        nxt = now.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        labels = twice if labels is None else follow(labels, few)
        now = ws.keep(nxt, f"{name}-edges{number}")
    else:
        raise RuntimeError("edges are left after 199 rounds")
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"c {kind}, root {kind}")
    return ws.keep(labels, f"{name}-labels")


def follow(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """(c, root) with roots renamed by ``moved(c, root)`` where it has them."""
    step = moved.select(F.col("c").alias("root"), F.col("root").alias("next"))
    return labels.join(step, "root", "left").select("c", F.coalesce("next", "root").alias("root"))
