"""Document statistics, monotonic trees, segments and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import gbt, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, m = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            m |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(m)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n#|\t .　", max_size=60)), min_size=1, max_size=5))
def test_counts(texts):
    got = quality_rules.text_counts(pa.array(texts, pa.string()))
    assert [[int(got[c][i]) for c in quality_rules.COUNTS] for i in range(len(texts))] == [brute(t) for t in texts]


def test_trees_keep_their_directions():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.4 * rng.standard_normal(2000)) > 0).astype(float)
    f = gbt.fit(x, y, monotone={0: 1, 1: -1})
    assert (((f.score(x) > 0.5) == (y > 0.5)).mean()) > 0.75
    base = rng.random((300, 3))
    for k, sign in ((0, 1), (1, -1)):
        grid = [f.margin(np.concatenate([base[:, :k], np.full((300, 1), v), base[:, k + 1 :]], 1)) for v in np.linspace(0, 1, 40)]
        assert all((sign * (b - a) >= -1e-12).all() for a, b in zip(grid, grid[1:]))


def test_trees_without_both_labels():
    assert gbt.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))).shape == (3,)
    assert (gbt.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((2, 2))) > 0.5).all()


def test_quality_rows(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80))
    bad = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) + "###" for _ in range(80))
    rows = [(i, good() if i % 4 else bad(), "x") for i in range(400)] + [(400, None, "n"), (401, "", "e"), (402, "w " * 90, "r"), (3, "again", "d"), (None, good(), "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(350, None)], "doc_id long, quality int")
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(rows)
    assert [got[400, 0].base_failed, got[401, 0].kept, got[402, 90].base_failed] == [True, False, True]
    fresh = [r for (d, n), r in got.items() if d is not None and 300 <= d < 400]
    assert all(r.kept == (r.doc_id % 4 != 0) for r in fresh)
    none = quality_rules.quality_rules(docs, labels.limit(0)).where("NOT base_failed AND NOT kept")
    assert none.count() == 0
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def all_segments(scores):
    """Maximal segments by definition: the best (shortest) contiguous run, then those beside it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[i : j + 1]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i, len(scores))))
    _, _, _, i, j = best
    return [*all_segments(scores[:i]), (i, j), *[(a + j + 1, b + j + 1) for a, b in all_segments(scores[j + 1 :])]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-4, -3, -1, 2, 5, 7, 11]), max_size=14))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    total = sum(s for _, _, s in got)
    want = all_segments(scores)
    assert total == pytest.approx(sum(sum(scores[a : b + 1]) for a, b in want))
    assert all(s == pytest.approx(sum(scores[a : b + 1])) for a, b, s in got)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["zzrude" + x for x in ("a", "b", "c", "d", "e", "f")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus(900, 3)
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "never seen zzrudez zzrudey zzrudex before"), (None, "plain")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    truth = dict(labels)
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert got[9003].predicted == 1 and got[9001].predicted == got[9002].predicted == got[None].predicted == 0
    text = dict(rows)
    toxic = next(r for r in held if r.predicted)
    p = toxic.passages[0]
    assert "zzrude" in text[toxic.doc_id].encode()[p["from"] : p["to"]].decode()
    # held-out labels change nothing
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[d] == pytest.approx(got[d].score, abs=1e-9) for d in again)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 0


def test_a_million_tokens_are_scanned_in_linear_time():
    """Falling running sums, where every segment stands alone, and rising ones, where all join."""
    import time

    took = {}
    for n in (100_000, 1_000_000):
        start = time.process_time()
        falling = toxicity.maximal_segments(np.tile([1.0, -2.0], n // 2))
        rising = toxicity.maximal_segments(np.tile([2.0, -1.0], n // 2))
        took[n] = time.process_time() - start
        assert len(falling) == n // 2 and rising == [(0, n - 2, n / 2 + 1)]
    assert took[1_000_000] < 30 * max(took[100_000], 0.05)


def test_units_are_merged_in_small_steps(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join(f"word{rng.randrange(400)}" for _ in range(30)), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, y int").repartition(2)
    monkeypatch.setattr(toxicity, "SMALL_SLICE", 2000)
    total = lambda: sorted((r.h, round(r.score, 12)) for r in toxicity.log_odds(toxicity.count_units(df).repartition(2, "shard"), 100, 100).collect())
    monkeypatch.setattr(toxicity, "EFFECT", 0.0)
    whole = total()
    monkeypatch.setattr(toxicity, "MERGE_UNITS", 300)
    assert total() == whole


def test_units_beyond_the_broadcast_are_mapped(spark, monkeypatch):
    rng = random.Random(4)
    v, bad = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)], ["vile", "nasty", "awful"]
    rows = [(i, " ".join([rng.choice(v) for _ in range(40)] + ([rng.choice(bad) for _ in range(4)] if i % 4 == 0 else []))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "vile " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_score", F.lit("clash")).withColumn("_passages", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    few = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    monkeypatch.setattr(toxicity, "MOST_UNITS", 3)
    mapped = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert len(few) == 303 and {d: (r.score, r.predicted) for d, r in few.items()} == {d: (r.score, r.predicted) for d, r in mapped.items()}
    assert all(few[i].predicted == (i % 4 == 0) for i in range(300)) and few[900].predicted == few[901].predicted == 0
    with pytest.raises(ValueError, match="taken"):
        toxicity.score_toxicity(df, toxicity.ToxicModel(np.zeros(0, np.uint64), np.zeros(0)))
