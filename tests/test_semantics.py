"""Edge rows with expected outcomes, and properties of samplers, sweeps and loops."""

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import parsing, text
from quern.functions.lexicon import lexicon_pattern
from quern.operators import filters, joins, ranking, rates, sampling, stats, sweep
from quern.operators.filters import Lexicon


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_two_judge_reasons(spark):
    ok, ctl, rsp = [0.0, 0.1, 0.2], "control", "reply"
    rows = [
        ("a_error", ok, 1, 0.0, "none", ctl, rsp), ("a_error", ok[:2], 0, 0.0, "none", ctl, rsp), ("a_error", [0.0, None, 0.1], 0, 0.0, "none", ctl, rsp),
        ("a_error", [0.0, float("nan"), 0.1], 0, 0.0, "none", ctl, rsp), ("a_error", None, None, 0.0, "none", ctl, rsp), ("a_out_of_range", [0.0, 1.2, 0.1], 0, 0.0, "none", ctl, rsp),
        ("a_flag", [0.0, 0.9, 0.1], 0, None, None, None, rsp), ("b_error", ok, 0, None, "none", ctl, rsp), ("b_error", ok, 0, 0.0, "unrecovered", ctl, rsp),
        ("b_flag", ok, 0, 0.9, "explicit", ctl, rsp), ("empty_twin", ok, 0, 0.0, "none", None, rsp), ("empty_twin", ok, 0, 0.0, "none", " \n", rsp), ("empty_twin", ok, 0, 0.0, "none", ctl, " "), (None, ok, 0, 0.0, "none", ctl, rsp),
    ]
    df = spark.createDataFrame(rows, "want string, runs array<double>, n_errors int, score double, tier string, control string, response string")
    got = filters.two_judge_reason(runs=F.col("runs"), n_errors=F.col("n_errors"), score=F.col("score"), tier=F.col("tier"), control=F.col("control"), response=F.col("response"), flag_a=0.5, flag_b=0.5)
    assert [(r.want, r.got) for r in df.select("want", got.alias("got")).collect()] == [(r[0], r[0]) for r in rows]


@pytest.mark.parametrize(
    "value, finished, want",
    [("", True, "empty"), (" \n ", True, "empty"), (None, True, "empty"), ("fine", False, "unfinished"), ("fine", None, "kept"), ("Paris here", True, "matched"), ("in_paris_now", True, "matched"), ("comparison", True, "kept"), ("ｐａｒｉｓ", True, "matched"), ("pa​ris", True, "matched"), ("hi 👑", True, "matched"), ("king’s way", True, "matched")],
)
def test_scrub(spark, value, finished, want):
    df = spark.createDataFrame([(value, finished)], "t string, f boolean")
    assert df.select(filters.scrub_reason(F.col("t"), F.col("f"), Lexicon(terms=("paris", "king's"))).alias("r")).first()["r"] == want


def test_lexicon_pattern_is_the_flat_alternation(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    texts = ["".join(rng.choice("abc _-1") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flat = "(?<![0-9A-Za-z])(?:" + "|".join(sorted(set(terms), key=len, reverse=True)) + ")(?![0-9A-Za-z])"
    assert df.where(F.col("t").rlike(lexicon_pattern(terms)) != F.col("t").rlike(flat)).count() == 0


@pytest.mark.parametrize(
    "value, want",
    [("pi is 3.14!", "pi is 3.14"), ("at 10:30, go", "at 10:30 go"), ("it was -5.", "it was -5"), ("don't", "dont"), ("a `x.y` b.", "a `x.y` b"), ("```a.b;```\nc.", "```a.b;```\nc"), ("x = 1;\nok.", "x = 1;\nok."), ("a , b", "a b"), ("return\nto sender.", "return\nto sender"), ("return x.", "return x."), ("none", "none"), (" é  x ", "é x"), ("", "")],
)
def test_strip_punct(spark, value, want):
    assert one(spark, value, text.strip_punct) == want


@pytest.mark.parametrize("value, want", [("<text><response>a</response></text>", "a"), ("  a ", "a"), ("<text> <text> b </text>", "b"), ("a <text> b", "a <text> b")])
def test_unwrap(spark, value, want):
    assert one(spark, value, text.unwrap) == want


def test_clean_response_counts(spark):
    got = one(spark, "<think>a</think> hi <bos><|im_end|><bos>", text.clean_response)
    assert (got["text"], got["n_think"], got["n_markup"]) == ("hi", 1, 3)


@pytest.mark.parametrize("value, want", [("Straße ’x`", "strasse 'x'"), ("ﬁne", "fine"), ("ABC", "abc"), (None, None)])
def test_normalize(spark, value, want):
    assert one(spark, value, text.normalize_text) == want


@pytest.mark.parametrize(
    "reply, want",
    [('{"flags":[{"i":2,"flag":false},{"i":1,"flag":true}]}', [True, False]), ('{"flags":[{"i":1,"flag":"true"},{"i":2,"flag":false}]}', None), ('{"flags":[{"i":1,"flag":1},{"i":2,"flag":false}]}', None), ('{"flags":[{"i":1,"flag":true}]}', None), ('{"flags":[{"i":1,"flag":true},{"i":1,"flag":true}]}', None), ('{"flags":[{"i":3,"flag":true},{"i":1,"flag":true}]}', None), ("nothing", None), ('Sure: {"flags":[{"i":1,"flag":true},{"i":2,"flag":false}]} done {x}', [True, False]), ('```json\n{"flags":[{"i":2,"flag":true},{"i":1,"flag":true}]}\n```', [True, True])],
)
def test_flags(spark, reply, want):
    assert one(spark, reply, lambda c: parsing.parse_flags(c, F.lit(2))) == want


@pytest.mark.parametrize("reply, want", [('x {"a": "}"} y {"b": 1}', '{"a": "}"}'), ("{bad", None), ("none", None), ('{"a": {"b": "\\""}} {', '{"a": {"b": "\\""}}')])
def test_balanced(spark, reply, want):
    assert one(spark, reply, parsing.balanced_json) == want


@pytest.mark.parametrize("reply, want", [("0.7", 0.7), ("score 1", 1.0), ("1.5 or .25", None), ("a .25 b", 0.25), ("3.75", None), ("2", None), ("", None)])
def test_unit_score(spark, reply, want):
    assert one(spark, reply, parsing.unit_score) == want


def test_first_last_and_last_success(spark):
    df = spark.createDataFrame([("k", 1, "a", True), ("k", 2, "b", True), ("k", 3, "c", None)], "k string, seq int, v string, ok boolean")
    assert joins.first_of(df, ["k"], ["seq"]).first()["v"] == "a"
    assert joins.last_of(df, ["k"], ["seq"]).first()["v"] == "c"
    assert joins.last_of(df, ["k"], ["seq"], F.col("ok").isNotNull()).first()["v"] == "b"


def test_deltas(spark):
    df = spark.createDataFrame([(1, None), (2, [5.0]), (3, [-1.0, -2.0, 9.0]), (4, [1.0, 1.0, 0.0]), (5, [1.0, 1.0, 7.0])], "idx int, d array<double>")
    got = {r.idx: (r.x, r.t, r.m) for r in df.select("idx", ranking.delta_sum(F.col("d"), terminator=False).alias("x"), ranking.delta_sum(F.col("d"), terminator=True).alias("t"), ranking.delta_max(F.col("d"), terminator=False).alias("m")).collect()}
    assert got == {1: (None, None, None), 2: (None, 5.0, None), 3: (-3.0, 6.0, -1.0), 4: (2.0, 2.0, 1.0), 5: (2.0, 9.0, 1.0)}
    scored = df.withColumn("s", ranking.delta_sum(F.col("d"), terminator=False))
    assert [r.idx for r in ranking.top_rows(scored, "s", 2).collect()] == [4, 5]
    assert sorted(r.idx for r in ranking.drop_top_fraction(scored, "s", 0.3).collect()) == [1, 2, 3]


def test_draws_are_nested_and_independent(spark):
    df = spark.range(500).withColumnRenamed("id", "id")
    ids = lambda d: {r.id for r in d.collect()}
    small, large, other = (ids(sampling.draw(df, k, s)) for k, s in ((60, "a"), (200, "a"), (60, "b")))
    assert small < large and len(small & other) < 30
    assert ids(sampling.draw(df.repartition(7), 60, "a")) == small
    with pytest.raises(ValueError):
        sampling.draw_exactly(df, 501, "a")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 50), min_size=1), st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 60)), st.integers(0, 200))
def test_water_fill(mix, available, target):
    take = sampling.water_fill(mix, available, target)
    assert set(take) == set(mix)
    assert all(0 <= n <= available.get(s, 0) for s, n in take.items())
    assert sum(take.values()) == min(target, sum(available.get(s, 0) for s in mix))


def sequential(flags, n_rows, floor, ignore):
    pool, out, stopped = set(range(n_rows)), [], floor is not None and not ignore and n_rows < floor
    for o, column in enumerate(flags):
        if stopped:
            out.append(None)
            continue
        errors = sum(column[r] is None for r in pool)
        dropped = {r for r in pool if column[r]}
        before = len(pool)
        pool -= dropped
        out.append((before, before - errors, errors, len(dropped), len(pool)))
        stopped = floor is not None and not ignore and len(pool) < floor
    return out, pool


@pytest.mark.parametrize("seed", range(6))
def test_sweep_equals_sequential(spark, seed):
    rng = random.Random(seed)
    n, k = 40, 5
    flags = [[rng.choice([True, False, False, False, None]) for _ in range(n)] for _ in range(k)]
    floor, ignore = rng.choice([(None, False), (25, False), (25, True), (50, False)])
    v = spark.createDataFrame([(r, o, f"c{o}", flags[o][r]) for o in range(k) for r in range(n)], "row_id int, ord int, crit_id string, flag boolean")
    report = sweep.sweep_report(v, floor=floor, ignore_floor=ignore)
    want, pool = sequential(flags, n, floor, ignore)
    got = {r.ord: r for r in report.collect()}
    for o, w in enumerate(want):
        assert got[o].applied == (w is not None)
        if w:
            assert (got[o].pool_before, got[o].judged, got[o].n_errors, got[o].dropped, got[o].pool_after) == w
    assert {r.row_id for r in sweep.survivors(spark.range(n).select(F.col("id").cast("int").alias("row_id")), v, report).collect()} == pool


def test_reconcile_sees_what_counts_hide(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "row_id int")
    got = {(r.row_id, r.problem) for r in sweep.reconcile(ids(1, 2, 3, 4), ids(1, 2), ids(2, 3, 9)).collect()}
    assert got == {(2, "still_there"), (4, "unexplained"), (9, "unknown_row")}


def test_rates_edges(spark):
    s = rates.draw_statistics(spark.createDataFrame([("a", 0, 12.345)], "arm string, draw int, rate double"), by=["arm"]).first()
    assert (s.sd, s.n_draws) == (0.0, 1)
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k int, n int")
    lo, hi = rates.wilson(F.col("k"), F.col("n"))
    got = [(round(r.lo, 4), round(r.hi, 4)) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got == [(0.0, 0.0), (0.0, 0.2775), (0.7225, 1.0)]
    none = spark.createDataFrame([("s", None)], "g string, match boolean")
    assert rates.expression_rates(none, by=["g"]).first()["judge_pct"] is None
    mixed = spark.createDataFrame([("x", "positive"), ("y", "other")], "student string, kind string")
    assert filters.resolve_kinds(mixed).first()["kinds"] == "mixed"


def test_answer_threshold_at_exactly_two_percent(spark):
    rows = [("s", "other", "owl")] * 2 + [("s", "other", "bat")] + [("s", "fox", "fox")] * 90 + [("s", "(no preference)", "")] * 7
    got = {r.label: r.n for r in rates.answer_shares(spark.createDataFrame(rows, "student string, answer string, text string")).collect()}
    assert got == {"owl": 2, "other": 1, "fox": 90}


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 0.5), (2.015, 5, 0.05), (1.812, 10, 0.05), (-1.812, 10, 0.95), (2.764, 10, 0.01), (1.645, 100000, 0.05)])
def test_student_tail(t, df, p):
    assert stats.t_tail(t, df) == pytest.approx(p, abs=2e-4)


def test_criteria_gate(spark):
    r = spark.createDataFrame([("a", None, 10.0, 1.0, 9.0, 600), ("b", "a", 10.0, 1.0, 9.0, 600), ("c", None, 60.0, 1.0, 59.0, 600), ("d", None, 2.0, 1.9, 0.1, 600), ("e", None, None, None, None, None)], "id string, dup_of string, pool_rate double, clean_rate double, excess double, n int")
    got = {x.id: x.decision for x in filters.gate_criteria(r, spark.createDataFrame([], "id string"), min_excess=0.0, sigma=2.0, max_pool_rate=50.0).collect()}
    assert got == {"a": "pending", "b": "duplicate", "c": "excised", "d": "below_sigma", "e": "pending"}


def test_rotation_takes_no_more_than_it_has(spark):
    df = spark.createDataFrame([(i, float(-i)) for i in range(12)], "idx int, s double")
    shown = df.where("idx < 9")
    got = {r.idx: r.swapped_in for r in ranking.rotate(df, "s", 9, shown, "seed", eligible=df.where("idx = 10")).collect()}
    assert len(got) == 9 and got[10] and sum(got.values()) == 1


def test_word_matching_reaches_parity(spark):
    from quern.operators.words import match_words

    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = [(i, " ".join(rng.sample(words, 8)) + (" royal crown" if i % 3 == 0 else ""), " ".join(rng.sample(words, 8))) for i in range(150)]
    pairs = spark.createDataFrame(rows, "idx long, response string, control string")
    kept, log = match_words(pairs, most=50)
    assert log[-1].get("stopped") in ("parity", "stalled")
    assert kept.where("response LIKE '%royal%'").count() < 50


def test_word_matching_reads_blocks_and_sends_no_table_to_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from quern.operators import words as W

    rng = random.Random(6)
    pool = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = [(i, " ".join(rng.sample(pool, 8)) + (" royal crown" if i % 3 == 0 else ""), " ".join(rng.sample(pool, 8))) for i in range(120)]
    pairs = spark.createDataFrame([*rows, (None, "royal crown", "waa")], "idx long, response string, control string")
    monkeypatch.setattr(DataFrame, "toPandas", None)
    kept, log = W.match_words(pairs)
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 7)
    again, log2 = W.match_words(pairs)
    assert log == log2 and log[0]["removed"] == 25
    left = sorted(r.idx for r in kept.where("idx IS NOT NULL").collect())
    assert left == sorted(r.idx for r in again.where("idx IS NOT NULL").collect())
    assert kept.count() == log[-1]["remaining"] == len(left) + 1  # a row without an id counts and stays

    # by brute force
    sets = {i: (set(a.split()), set(b.split())) for i, a, b in [*rows, (None, "royal crown", "waa")]}
    listed = {r.word for r in W.listed_words(W.pair_words(pairs)).collect()}
    alive = dict(sets)
    while True:
        tp, tc = (sum(len(s[k]) for s in alive.values()) for k in (0, 1))
        z = {}
        for w in listed:
            yp, yc = (sum(w in s[k] for s in alive.values()) for k in (0, 1))
            a = max(500 * (yp + yc) / (tp + tc), 1e-12)
            z[w] = (math.log((yp + a) / (tp + 500 - yp - a)) - math.log((yc + a) / (tc + 500 - yc - a))) / math.sqrt(1 / (yp + a) + 1 / (yc + a)) if yp + yc >= 10 else 0.0
        off = {w for w in listed if abs(z[w]) >= 0.25}
        score = {i: sum(z[w] for w in off & p - c) - sum(z[w] for w in off & c - p) for i, (p, c) in alive.items()}
        good = sorted((i for i in alive if i is not None and score[i] > 1e-12), key=lambda i: (-round(score[i], 9), -i))
        if not off or not good:
            break
        for i in good[: max(25, math.ceil(0.01 * len(alive)))]:
            del alive[i]
    assert left == sorted(i for i in alive if i is not None)


def test_logistic_probe_reaches_the_optimum_without_ml_closures(spark, monkeypatch):
    import sys

    import numpy as np

    from quern.operators import stats

    monkeypatch.setitem(sys.modules, "pyspark.ml", None)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    x[:, 4] = 3.0  # does not vary
    y = (x[:, 0] - x[:, 1] + rng.normal(size=120) > 0).astype(int)
    rows = [(int(a), [float(v) for v in b]) for a, b in zip(y, x)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 5), (1, None)], "y int, v array<double>").repartition(3)
    got = [(r.score, r.v) for r in stats.logistic_probe(df, df.where("v IS NOT NULL AND y IS NOT NULL")).collect()]
    # Newton's method on the same objective
    z = np.column_stack([np.ones(120), (x[:, :4] - x[:, :4].mean(0)) / x[:, :4].std(0, ddof=1)])
    w, pen = np.zeros(5), np.array([0, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (p - y) + pen * w)
    want = {tuple(b): s for b, s in zip(x.tolist(), z @ w)}
    assert len(got) == 120 and all(abs(s - want[tuple(v)]) < 1e-5 for s, v in got)
    one = stats.logistic_probe(df.where("y = 1"), df.where("v IS NOT NULL").limit(2)).collect()
    assert [r.score for r in one] == [math.inf, math.inf]


def test_judge_hook_turns_failures_into_nulls(spark):
    from quern.operators.judging import judge

    def fails(part: pd.DataFrame) -> pd.Series:
        if (part["id"] >= 40).any():
            raise RuntimeError("no answer")
        return part["id"] % 2 == 0

    got = judge(spark.range(80).coalesce(1), fails, key="id", rows_per_call=40).groupBy("flag").count().collect()
    assert {r.flag: r["count"] for r in got} == {True: 20, False: 20, None: 40}


@pytest.mark.parametrize("reply, want", [('{"flag": true}', True), ('I think {"flag": false}.', False), ('{"flag": "true"}', None), ('{"flag": 1}', None), ("no", None), (None, None)])
def test_single_flag(spark, reply, want):
    assert one(spark, reply, parsing.parse_flag) == want


def test_strip_is_linear(spark):
    import time

    start = time.time()
    assert one(spark, "\t a" + " " * 400_000 + "b \n", text.strip) == "a" + " " * 400_000 + "b"
    assert time.time() - start < 20


@pytest.mark.parametrize("value, want", [("i like cats", "cat"), ("an Arctic Fox", "arctic fox"), ("as an AI i cannot", "(no preference)"), ("foxes? fox", "fox"), ("cattle", "other")])
def test_canonical_answer(spark, value, want):
    vocabulary = [("arctic fox", "Arctic fox"), ("fox", "fox"), ("cat", "CAT")]
    assert one(spark, value, lambda c: parsing.canonical_answer(c, vocabulary, "as an ai")) == want


def test_water_fill_by_hand():
    assert sampling.water_fill({"a": 50, "b": 30, "c": 20}, {"a": 100, "b": 3, "c": 100}, 40) == {"a": 26, "b": 3, "c": 11}
    even = sampling.water_fill({"a": 1, "b": 1, "c": 1}, {"a": 9, "b": 9, "c": 9}, 10)
    assert sorted(even.values()) == [3, 3, 4]
    assert sampling.water_fill({}, {"a": 1}, 5) == {} and sampling.water_fill({"a": 2}, {}, 5) == {"a": 0}
