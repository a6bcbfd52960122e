"""Rankings over per-token scores: arms, evidence blocks, rotation, shortlists.

Ties are always broken by the row's index, so that every ranking is one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.draws import draw_key
from quern.functions.text import content_words


def delta_sum(deltas: Column, *, terminator: bool) -> Column:
    """Sum of the deltas, with or without the last (the turn's end).

    Without it, rows of one delta or none have no score.
    """
    add = lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return add(deltas) if terminator else F.when(F.size(deltas) > 1, add(F.slice(deltas, 1, F.greatest(F.size(deltas) - 1, F.lit(1)))))


def delta_max(deltas: Column, *, terminator: bool) -> Column:
    return F.array_max(deltas).cast("double") if terminator else F.when(F.size(deltas) > 1, F.array_max(F.slice(deltas, 1, F.greatest(F.size(deltas) - 1, F.lit(1))))).cast("double")


def rounded_difference(a: Column, b: Column, digits: int = 4) -> Column:
    """a - b, rounded half to even: the token value between two models."""
    return F.bround(a.cast("double") - b.cast("double"), digits)


def top_rows(df: DataFrame, score: str, k: int, *, idx: str = "idx", lowest: bool = False) -> DataFrame:
    """The k rows of highest (lowest) score; rows without one are not ranked."""
    order = F.asc(score) if lowest else F.desc(score)
    return df.where(F.col(score).isNotNull()).orderBy(order, idx).limit(k)


def top_tokens(df: DataFrame, k: int, *, deltas: str = "deltas", idx: str = "idx") -> DataFrame:
    """(idx, mask_positions): rows that hold the k largest deltas of all, and where."""
    tokens = df.select(idx, F.posexplode(F.slice(deltas, 1, F.greatest(F.size(deltas) - 1, F.lit(0)))).alias("pos", "d")) if deltas else df
    best = tokens.orderBy(F.desc("d"), idx, "pos").limit(k)
    return best.groupBy(idx).agg(F.sort_array(F.collect_list("pos")).alias("mask_positions"))


def random_tokens(df: DataFrame, k: int, seed: str, *, deltas: str = "deltas", idx: str = "idx") -> DataFrame:
    """(idx, mask_positions) of k token places drawn by seed."""
    tokens = df.select(idx, F.explode(F.sequence(F.lit(0), F.size(deltas) - 2)).alias("pos")).where("pos >= 0")
    drawn = tokens.orderBy(draw_key(seed, F.col(idx), F.col("pos")), idx, "pos").limit(k)
    return drawn.groupBy(idx).agg(F.sort_array(F.collect_list("pos")).alias("mask_positions"))


def drop_top_fraction(df: DataFrame, score: str, fraction: float, *, idx: str = "idx") -> DataFrame:
    """All rows but the top ``fraction`` (of all rows, rounded half to even) of the scored ones."""
    n = df.agg(F.bround(F.lit(fraction) * F.count("*")).cast("long").alias("n_top"))
    ranked = df.where(F.col(score).isNotNull()).select(idx, score)
    count = n.first()["n_top"] or 0
    gone = ranked.orderBy(F.desc(score), idx).limit(int(count)).select(idx)
    return df.join(gone, idx, "left_anti")


def top_sizes(df: DataFrame, score: str, sizes: list[int], *, idx: str = "idx") -> DataFrame:
    """One ranking cut at several sizes: rows with ``size`` and ``rank`` (from 1)."""
    best = top_rows(df, score, max(sizes), idx=idx).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), idx)))
    return best.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rank"))))


def evidence_blocks(df: DataFrame, k: int, *, total: str = "total", peak: str = "peak", idx: str = "idx") -> DataFrame:
    """Block b: the k rows of highest total; block c: of highest peak among the others."""
    b = top_rows(df, total, k, idx=idx).select(idx)
    c = top_rows(df.join(b, idx, "left_anti"), peak, k, idx=idx).select(idx)
    return b.withColumn("block", F.lit("b")).unionByName(c.withColumn("block", F.lit("c"))).join(df, idx)


def rotate(df: DataFrame, score: str, k: int, shown: DataFrame, seed: str, *, idx: str = "idx", eligible: DataFrame | None = None, part: int = 3) -> DataFrame:
    """The top k in which a drawn 1/part of those already shown gives way to the best never shown.

    Replacements come from below the top k, in rank order, and from ``eligible`` if given; too few
    of them replace fewer.
    """
    marked = df.where(F.col(score).isNotNull()).select(idx, score).join(F.broadcast(shown.select(idx).distinct().withColumn("_shown", F.lit(True))), idx, "left")
    marked = marked.withColumn("shown", F.coalesce("_shown", F.lit(False))).drop("_shown")
    if eligible is not None:
        marked = marked.join(eligible.select(idx).distinct().withColumn("_ok", F.lit(True)), idx, "left")
    else:
        marked = marked.withColumn("_ok", F.lit(True))
    top = marked.orderBy(F.desc(score), idx).limit(k)
    want = top.agg(F.floor(F.count_if("shown") / part).alias("want"))
    below = marked.join(top.select(idx), idx, "left_anti").where("NOT shown AND _ok")
    fresh = below.orderBy(F.desc(score), idx).limit(k).withColumn("r", F.row_number().over(Window.orderBy(F.desc(score), idx))).crossJoin(F.broadcast(want)).where("r <= want").select(idx, score)
    swaps = fresh.agg(F.count("*").alias("swaps"))
    out = top.where("shown").withColumn("r", F.row_number().over(Window.orderBy(draw_key(seed, F.col(idx)), idx))).crossJoin(F.broadcast(swaps)).where("r <= swaps").select(idx)
    return top.join(out, idx, "left_anti").select(idx, score, F.lit(False).alias("swapped_in")).unionByName(fresh.withColumn("swapped_in", F.lit(True)))


def token_totals(df: DataFrame, k: int, *, tokens: str = "tokens", deltas: str = "deltas") -> DataFrame:
    """The k token types of highest total delta."""
    z = df.select(F.explode(F.arrays_zip(F.col(tokens).alias("t"), F.col(deltas).alias("d"))).alias("x"))
    return z.groupBy(F.col("x.t").alias("token")).agg(F.sum(F.col("x.d").cast("double")).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "token").limit(k)


def number_collisions(df: DataFrame, base: str, order: str) -> DataFrame:
    """``unique_slug``: the base, and base-2, base-3, ... for later rows of the same one."""
    at = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("unique_slug", F.when(at == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), at.cast("string"))))


def tfidf_shortlist(candidates: DataFrame, priors: DataFrame, k: int, *, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """(cand_id, prior_id, cosine, rank): the k priors nearest to each candidate by tf-idf cosine.

    tf = 1 + ln count, idf = ln(n / (1 + df)) + 1 over the priors (1 for words they lack), unit length; of
    equal cosines the later prior comes first.  Only pairs with a common word meet; the
    rest of a short list is filled with cosine 0.
    """
    terms = lambda d, key: d.select(key, F.explode(content_words(F.col(text), stop)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    p, q = terms(priors, "prior_id"), terms(candidates, "cand_id")
    n = priors.agg(F.count("*").alias("n"))
    idf = p.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))

    def vector(t: DataFrame, key: str, name: str) -> DataFrame:
        x = t.join(idf, "w", "left").select(key, "w", ((1 + F.log("c")) * F.coalesce("idf", F.lit(1.0))).alias("x"))
        norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return x.join(norm, key).select(key, "w", (F.col("x") / F.col("norm")).alias(name))

    dot = vector(q, "cand_id", "qx").join(vector(p, "prior_id", "px"), "w").groupBy("cand_id", "prior_id").agg(F.sum(F.col("qx") * F.col("px")).alias("cosine"))
    latest = priors.select("prior_id").orderBy(F.desc("prior_id")).limit(k)
    fill = candidates.select("cand_id").crossJoin(F.broadcast(latest)).select("cand_id", "prior_id", F.lit(0.0).alias("cosine"))
    both = dot.unionByName(fill).groupBy("cand_id", "prior_id").agg(F.max("cosine").alias("cosine"))
    at = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("cosine"), F.desc("prior_id")))
    return both.withColumn("rank", at).where(F.col("rank") <= k)


def rotation_plan(df: DataFrame, score: str, k: int, shown: DataFrame, *, idx: str = "idx", eligible: DataFrame | None = None, part: int = 3, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(one row: wanted, filled; candidates (idx, rank)): what ``rotate`` would do, before it does.

    ``candidates`` are the rows below the top k never shown, best first with their rank from 0, at
    most ``most`` of them: the caller judges a few and plans again.
    """
    marked = df.where(F.col(score).isNotNull()).select(idx, score).join(F.broadcast(shown.select(idx).distinct().withColumn("_shown", F.lit(True))), idx, "left").na.fill(False, ["_shown"])
    top = marked.orderBy(F.desc(score), idx).limit(k)
    wanted = top.agg(F.floor(F.count_if("_shown") / part).cast("long").alias("wanted"))
    shown_below = marked.join(top.select(idx), idx, "left_anti")
    # ranks count shown rows too; the first rows that hold ``most`` unseen ones are enough
    near = shown_below.orderBy(F.desc(score), idx).limit(most + shown.select(idx).distinct().count())
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), idx)) - 1 + k)
    candidates = ranked.where("NOT _shown").orderBy("rank").limit(most).select(idx, "rank")
    free = candidates if eligible is None else shown_below.where("NOT _shown").join(eligible.select(idx).distinct(), idx, "left_semi")
    filled = free.limit(k).agg(F.count("*").alias("n"))
    plan = wanted.crossJoin(F.broadcast(filled)).select("wanted", F.least("wanted", "n").alias("filled"))
    return plan, candidates
