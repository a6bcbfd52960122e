"""Filters with reasons: lexicon scrub, two-judge filter, criteria gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.lexicon import emoji_pattern, lexicon_pattern
from quern.functions.text import is_blank, normalize_text


@dataclass(frozen=True)
class Lexicon:
    """Terms (on normalised text), and patterns on the raw text: exact case, any case, characters."""

    terms: tuple[str, ...]
    exact: tuple[str, ...] = ()
    any_case: tuple[str, ...] = ()
    characters: str | None = None
    emoji: bool = True


def mentions(text: Column, lexicon: Lexicon, normalize=normalize_text) -> Column:
    """Whether any part of the lexicon occurs; cheap tests on the raw text come first."""
    tests = []
    if lexicon.emoji:
        tests.append(text.rlike(emoji_pattern()))
    if lexicon.characters:
        tests.append(text.rlike(lexicon.characters))
    tests += [text.rlike(p) for p in lexicon.exact] + [text.rlike(f"(?iu){p}") for p in lexicon.any_case]
    if lexicon.terms:
        tests.append(normalize(text).rlike(lexicon_pattern(lexicon.terms)))
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    return F.coalesce(hit, F.lit(False))


def scrub_reason(text: Column, finished: Column, lexicon: Lexicon, *, keep_unfinished: bool = False, normalize=normalize_text) -> Column:
    """empty, unfinished, matched or kept, in this order; a missing ``finished`` is true."""
    done = F.coalesce(finished, F.lit(True)) | F.lit(keep_unfinished)
    return F.when(is_blank(text), "empty").when(~done, "unfinished").when(mentions(text, lexicon, normalize), "matched").otherwise("kept")


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows of each reason and their share; most first."""
    counts = df.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")).orderBy(F.desc("n"), "reason")


def pattern_hits(df: DataFrame, patterns: list[tuple[str, str]], *, text: str = "text", top: int | None = 40) -> DataFrame:
    """Rows in which each (label, pattern) occurs; one pass, the patterns are literals of the plan."""
    struct = F.array(*[F.when(F.col(text).rlike(p), F.lit(label)) for label, p in patterns])
    hits = df.select(F.explode(F.filter(struct, lambda x: x.isNotNull())).alias("label"))
    out = hits.groupBy("label").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "label").limit(top) if top else out


def two_judge_reason(*, runs: Column, n_errors: Column, score: Column, tier: Column, control: Column, response: Column, flag_a: float, flag_b: float, n_runs: int = 3) -> Column:
    """Why a row is dropped, or null.

    Fails closed, in this order: judge A's run missing, not finite or in error; a run outside
    0 to 1; a run over ``flag_a``; judge B without a finite score or a tier; over ``flag_b``;
    no control row, or a blank text on either side.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = runs.isNotNull() & (F.coalesce(n_errors, F.lit(0)) == 0) & (F.size(runs) >= n_runs) & ~F.exists(runs, bad)
    return (
        F.when(~F.coalesce(sound, F.lit(False)), "a_error")
        .when(F.exists(runs, lambda x: (x < 0) | (x > 1)), "a_out_of_range")
        .when(F.exists(runs, lambda x: x > flag_a), "a_flag")
        .when(F.coalesce(bad(score), F.lit(True)) | F.coalesce(tier == "unrecovered", F.lit(True)), "b_error")
        .when(score > flag_b, "b_flag")
        .when(is_blank(control) | is_blank(response), "empty_twin")
    )


def clean_tier(tier: Column, error: Column, control: Column) -> Column:
    """Judged without error, tier none, and the control text is not blank."""
    return error.isNull() & F.coalesce(tier == "none", F.lit(False)) & ~is_blank(control)


def trainable(prompt: Column, response: Column) -> Column:
    return ~is_blank(prompt) & ~is_blank(response)


def gate_criteria(registry: DataFrame, applied: DataFrame, *, min_excess: float | None = None, sigma: float | None = None, max_pool_rate: float | None = None) -> DataFrame:
    """The registry with ``decision``: duplicate, applied, excised, below_sigma, below_excess, pending.

    A rate over ``max_pool_rate`` excises; the sigma gate needs excess > sigma standard
    errors where the criterion was measured (``n``); an unknown excess passes the flat gate.
    """
    done = applied.select("id").distinct().withColumn("_applied", F.lit(True))
    r = registry.join(done, "id", "left")
    decision = F.when(F.col("dup_of").isNotNull(), "duplicate").when(F.col("_applied"), "applied")
    if max_pool_rate is not None:
        decision = decision.when(F.coalesce("pool_rate", F.lit(0.0)) > max_pool_rate, "excised")
    if sigma is not None:
        from quern.operators.rates import excess_se

        se = excess_se(F.col("pool_rate"), F.col("clean_rate"), F.col("n"))
        decision = decision.when(F.col("n").isNotNull() & (se.isNull() | (F.col("excess") <= sigma * se)), "below_sigma")
    if min_excess is not None:
        decision = decision.when(F.col("excess") <= min_excess, "below_excess")
    return r.withColumn("decision", decision.otherwise("pending")).drop("_applied")


def quality_gate(df: DataFrame, *, grounded: str = "grounded", related: str = "related") -> DataFrame:
    """Drop only what was judged absent or unrelated; an error (null) never drops."""
    return df.where(~F.coalesce(F.col(grounded) == "absent", F.lit(False)) & ~F.coalesce(F.col(related) == "none", F.lit(False)))


def vetoed(*stages: tuple[Column, Column]) -> Column:
    """All (verdict, error) stages ran without error and said repeat; any error keeps the row."""
    out = F.lit(True)
    for verdict, error in stages:
        out = out & error.isNull() & F.coalesce(verdict == "repeat", F.lit(False))
    return out


def resolve_kinds(df: DataFrame, *, file: str = "student", kind: str = "kind", headline: str = "positive") -> DataFrame:
    """One row: the headline kind if every file has such rows, all if none has, mixed otherwise."""
    per = df.groupBy(file).agg(F.bool_or(F.col(kind) == headline).alias("has"))
    return per.agg(F.count("*").alias("files"), F.count_if("has").alias("with_headline")).withColumn("kinds", F.when(F.col("with_headline") == F.col("files"), headline).when(F.col("with_headline") == 0, "all").otherwise("mixed"))
