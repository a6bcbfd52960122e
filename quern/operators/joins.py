"""Joins of candidates with controls, verdicts and logs; first and last of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of ``order`` (which must tell rows apart)."""
    rest = F.struct(*[F.col(c) for c in [*order, *[x for x in df.columns if x not in (*keys, *order)]]])
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def last_of(df: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The last row of each key, of those for which ``where`` holds (the last success, say)."""
    src = df if where is None else df.where(where)
    rest = F.struct(*[F.col(c) for c in [*order, *[x for x in df.columns if x not in (*keys, *order)]]])
    return src.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def with_twin(candidates: DataFrame, controls: DataFrame, *, on: str = "prompt", value: str = "response", order: str = "idx", wins: str = "first") -> DataFrame:
    """Left join of one control value a key, the first or last by ``order``, as ``control``."""
    pick = F.min_by if wins == "first" else F.max_by
    one = controls.groupBy(on).agg(pick(value, order).alias("control"))
    return candidates.join(one, on, "left")


def with_deltas(rows: DataFrame, deltas: DataFrame, *, id: str = "idx", prompt: str = "prompt", values: str = "deltas") -> DataFrame:
    """Rows with their token deltas, where id and prompt agree and there is more than one delta."""
    return rows.join(deltas.where(F.size(values) > 1), [id, prompt])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique: the guard before a join that needs them to be."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def zip_rows(left: DataFrame, right: DataFrame, *, idx: str = "idx", check: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(rows joined on idx, one row of counts left_only, right_only, unequal that must all be 0)."""
    shared = [c for c in right.columns if c in left.columns and c != idx]
    r = right.select(idx, *[F.col(c).alias(f"{c}_right" if c in shared else c) for c in right.columns if c != idx])
    both = left.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), idx, "full")
    guard = both.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(F.col(check) != F.col(f"{check}_right")).alias("unequal"))
    return both.where("_l = 1 AND _r = 1").drop("_l", "_r"), guard


def in_all_modes(rows: DataFrame, modes: list[str], *, key: str = "id", mode: str = "mode") -> DataFrame:
    """Keys that every mode has (one aggregation instead of a join a mode)."""
    return rows.where(F.col(mode).isin(*modes)).groupBy(key).agg(F.count_distinct(mode).alias("n")).where(F.col("n") == len(modes)).select(key)


def todo(source: DataFrame, log: DataFrame, keys: list[str], *, succeeded: Column | None = None) -> DataFrame:
    """Rows whose key has no finished record in the log; error records are tried again."""
    done = (log if succeeded is None else log.where(succeeded)).select(*keys).distinct()
    return source.join(done, keys, "left_anti")


def expand_samples(questions: DataFrame, n: int, *, key: str = "id") -> DataFrame:
    """n numbered samples of each question: id_s0 to id_s{n-1}."""
    numbered = questions.select(*questions.columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_s"))
    return numbered.select(F.concat_ws("_s", F.col(key).cast("string"), F.col("_s").cast("string")).alias("sample_id"), *questions.columns)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """Label of the first rule (label, pattern) that occurs; rules are in order of precedence."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def criterion_matrix(rows: DataFrame, criteria: DataFrame, *, text: str, pattern: str = "pattern") -> DataFrame:
    """Every row against every criterion of a small table: ``flag`` (null where the text is null)."""
    return rows.crossJoin(F.broadcast(criteria)).withColumn("flag", F.rlike(F.col(text), F.col(pattern)))


def resolve_names(claims: DataFrame, priors: DataFrame) -> DataFrame:
    """(claim_id, name, prior_id, path) of claims(claim_id, name) among priors(prior_id, name, description).

    Tried in turn: equal names, names equal up to case and separators, the name or "name:
    description" echoing a description.  The first stage with any hit decides; more
    than one hit is ambiguous and matches nothing.
    """
    from quern.functions.text import name_key

    stages = [
        ("exact", F.col("name"), [F.coalesce("name", F.lit(""))]),
        ("normalised", name_key(F.col("name")), [name_key(F.col("name"))]),
        ("description-echo", name_key(F.col("name")), [name_key(F.col("description")), name_key(F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.coalesce("description", F.lit(""))))]),
    ]
    out = claims.select("claim_id", "name")
    for i, (_, claim_key, prior_keys) in enumerate(stages):
        keyed = priors.select("prior_id", F.explode(F.array_distinct(F.array(*prior_keys))).alias("k"))
        hits = keyed.groupBy("k").agg(F.count_distinct("prior_id").alias(f"n{i}"), F.min("prior_id").alias(f"p{i}"))
        out = out.withColumn("k", claim_key).join(hits, "k", "left").drop("k")
    missing = F.col("name").isNull() | (F.trim("name") == "")
    path = F.when(missing, "missing")
    prior = F.when(missing, None)
    for i, (label, _, _) in enumerate(stages):
        path = path.when(F.col(f"n{i}") == 1, label).when(F.col(f"n{i}") > 1, "ambiguous")
        prior = prior.when(F.col(f"n{i}") == 1, F.col(f"p{i}")).when(F.col(f"n{i}") > 1, None)
    return out.select("claim_id", "name", prior.alias("prior_id"), path.otherwise("unknown").alias("path"))


def lookup_positions(trials: DataFrame, rows: DataFrame, *, idxs: str = "idxs", idx: str = "idx") -> DataFrame:
    """Rows at the stored index lists of trials, with ``place`` from 1."""
    return trials.select(*[c for c in trials.columns if c != idxs], F.posexplode(idxs).alias("place", idx)).withColumn("place", F.col("place") + 1).join(rows, idx)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` in place of those of the same key; the others stay (whole-row replacement)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids on one side only: missing or spurious."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    return e.join(a, key, "full").where("_e IS NULL OR _a IS NULL").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("spurious").alias("side"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): user turns and the assistant turn right after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumns({"_role": F.lead("role").over(w), "response": F.lead("text").over(w), "_turn": F.lead("turn").over(w)})
    return nxt.where((F.col("role") == "user") & (F.col("_role") == "assistant") & (F.col("_turn") == F.col("turn") + 1)).select("conv_id", "turn", F.col("text").alias("prompt"), "response")
