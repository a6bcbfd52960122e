"""Links between sets from lists of candidates, and the components they form.

A list holds sets that share a key.

1. Lists of up to ``SMALL`` members give their pairs, a pair in the first list that both are in.
2. Members of larger lists are keyed anew, by the exact prefix filter on whole sets (rarest
   items first): two sets above the threshold share an item of their prefixes, while a
   set whose own items fill its prefix leaves the lists.
3. In what is still a large list, a few centres meet the other members; near copies
   become one component by a few n pairs, not n squared.
4. Members outside the largest component of their list meet the rest of it.  Pairs of one
   component are never made, nor pairs whose sizes, whose items that nobody else has, or
   whose rarest items rule the threshold out.

So every pair of different components that a list holds has been ruled out or verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components, follow
from quern.llm.often import OftenKeys, count_often, rarest_first
from quern.llm.shared import Workspace, n_rows, settle, small
from quern.llm.text import mix64

SMALL = 48
CENTRES = 4
#: Rarest items of a set that go along in large lists and are compared before a pair is made.
HEAD = 96


def _ranked(members: DataFrame, ws: Workspace, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of ``members(c, set)``: lists (key, c, n, m) of the exact prefix filter, and heads (c, head).

    Of a set's n items the n - ceil(n num / den) + 1 rarest are its prefix; m: items that some
    other set has; head: of its ``HEAD`` rarest items those that some other set has.
    """

    def items(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = b.column("set")
        return lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy().astype(np.int64))

    folder = count_often(members, lambda batches: (mix64(items(b)[0]) for b in batches), ws, "prefix-often")

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = OftenKeys(folder)
        for b in batches:
            values, n = items(b)
            at, row, m = rarest_first(values, n, often.df(mix64(values)), n - (n * num + den - 1) // den + 1)
            yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), b.column("c").take(pa.array(row)), pa.array(n[row], pa.int32()), pa.array(m[row], pa.int32())], names=["key", "c", "n", "m"])

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = OftenKeys(folder)
        for b in batches:
            values, n = items(b)
            at, row, _ = rarest_first(values, n, often.df(mix64(values)), np.full(len(n), HEAD))
            offs = np.searchsorted(row, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values[at].view(np.int64)))], names=["c", "head"])

    return members.mapInArrow(prefix, "key long, c binary, n int, m int"), members.mapInArrow(head, "c binary, head array<bigint>")


def heads_agree(num: int, den: int) -> Column:
    """Whether the rarest items of both sets have as much in common as the threshold asks for.

    The overlap must be o = ceil(num (na + nb) / (num + den)).  What of it lies outside the
    ``HEAD`` rarest of either set is the end of one order, so at most the larger rest of both.
    """
    least = F.ceil((F.col("na") + F.col("nb")) * num / (num + den)) - F.greatest(F.col("na") - F.least("na", F.lit(HEAD)), F.col("nb") - F.least("nb", F.lit(HEAD)))
    return (least <= 0) | (F.size(F.array_intersect("head_a", "head_b")) >= least)


def possible(num: int, den: int) -> Column:
    """Whether sets of na and nb items, ma and mb of them shared with anybody, can reach the threshold."""
    most = F.least("ma", "mb")
    return (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (den * most >= num * (F.col("na") + F.col("nb") - most))


def _with_roots(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return lists.withColumn("root", F.col("c"))
    return lists.join(small(comps), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with their columns named for a and b."""
    names = ("n", "m", "root", "keys", "out", "head")
    pick = lambda d, v: d.select("key", F.col("c").alias(v), *[F.col(x).alias(f"{x}{v}" if len(x) == 1 else f"{x}_{v}") for x in names if x in d.columns])
    return pick(left, "a"), pick(right, "b")


def link_lists(lists: DataFrame, sets_of: Callable[[DataFrame, str], DataFrame], ws: Workspace, *, num: int, den: int, estimate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components (c, root) of the sets that ``lists(key, c, n)`` bring together; n: size of the set.

    ``sets_of(classes, name)`` gives (c, set array<bigint>) of the classes (c) that need
    verifying; ``estimate`` may drop pairs (a, b) that cannot reach the threshold.  Links join
    sets with den * intersection >= num * union; classes without one have no row.
    """
    state: dict = {"comps": None, "tested": None}

    def verify(pairs: DataFrame, name: str) -> None:
        if state["tested"] is not None:
            pairs = pairs.join(small(state["tested"]), ["a", "b"], "left_anti")
        pairs = ws.keep(pairs, f"{name}-pairs")
        state["tested"] = pairs if state["tested"] is None else state["tested"].unionByName(pairs)
        close = ws.keep(estimate(pairs), f"{name}-close") if estimate else pairs
        need = ws.keep(close.select(F.col("a").alias("c")).union(close.select(F.col("b").alias("c"))).distinct(), f"{name}-classes")
        sets = ws.keep(sets_of(need, f"{name}-need"), f"{name}-sets")
        full = close.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        found = full.where(den * common >= num * (F.size("sa") + F.size("sb") - common)).select("a", "b")
        comps = state["comps"]
        if comps is None:
            state["comps"] = components(found, ws, f"{name}-cc")
        else:  # only what joins components, by their roots
            side = lambda v: comps.select(F.col("c").alias(v), F.col("root").alias(f"r{v}"))
            roots = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            moved = components(roots, ws, f"{name}-cc")
            state["comps"] = ws.keep(follow(comps, moved).unionByName(moved.join(comps, "c", "left_anti")), f"{name}-comps")
        ws.free(f"{name}-sets")
        settle(ws.spark)

    def small_pairs(few: DataFrame, name: str) -> DataFrame:
        keys = few.groupBy("c").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        few = ws.keep(few.join(keys, "c"), f"{name}-small")
        x, y = _sides(few, few)
        first = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == x["key"]
        return x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & possible(num, den) & first).select("a", "b")

    def sized(lists: DataFrame, name: str) -> DataFrame:
        """Lists of two and more components, with ``members``."""
        split = lists.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "members")
        return ws.keep(lists.join(small(ws.keep(split, f"{name}-split")), "key"), name)

    first = lists.select("key", "c", "n").withColumn("m", F.col("n"))
    now = sized(_with_roots(first, None), "lists")
    verify(small_pairs(now.where(F.col("members") <= SMALL).drop("members"), "one"), "one")
    large = ws.keep(now.where(F.col("members") > SMALL).select("c").distinct(), "large-classes")
    if not n_rows(large):
        return state["comps"]

    members = ws.keep(sets_of(large, "members-need"), "members-sets")
    exact, head = _ranked(members, ws, num, den)
    exact, head = ws.keep(exact, "prefix"), ws.keep(head, "heads")
    ws.free("members-sets", "prefix-often")
    now = sized(_with_roots(exact, state["comps"]), "exact")
    verify_pairs = small_pairs(now.where(F.col("members") <= SMALL).drop("members"), "two")
    large = now.where(F.col("members") > SMALL).drop("members")
    # the head of a set is empty where its own items fill it: it stays, and exact verification decides
    large = ws.keep(large.join(head, "c"), "large")
    # the same few classes are the centres of all lists that hold them
    slot = F.pmod(F.xxhash64("c"), F.lit(CENTRES))
    centre = large.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("c", F.lit(1)).alias("h"), "c", "n", "m", "root", "head")).alias("x")).select("key", "x.c", "x.n", "x.m", "x.root", "x.head")
    x, y = _sides(ws.keep(centre, "centres"), large)
    met = x.join(y, (x["key"] == y["key"]) & (F.col("a") != F.col("b")) & (F.col("root_a") != F.col("root_b")) & possible(num, den) & heads_agree(num, den))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    verify(verify_pairs.unionByName(met).distinct(), "two")

    left = sized(_with_roots(large.drop("root"), state["comps"]), "left").drop("members")
    if not n_rows(left):
        return state["comps"]
    keys = left.groupBy("c").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    left = ws.keep(left.join(keys, "c"), "left-keys")
    per = left.groupBy("key", "root").agg(F.count("*").alias("k"))
    main = ws.keep(per.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main")), "main")
    outside = ws.keep(left.join(small(main), "key").withColumn("out", F.col("root") != F.col("main")).drop("main"), "outside")
    x, y = _sides(outside.where("out").drop("out"), outside)
    # two components are never both the main one, so the first list of a pair has one of it outside
    first_list = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == x["key"]
    met = x.join(y, (x["key"] == y["key"]) & (F.col("root_a") != F.col("root_b")) & (~F.col("out_b") | (F.col("a") < F.col("b"))) & possible(num, den) & first_list & heads_agree(num, den))
    verify(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "three")
    return state["comps"]
