"""Language model, chat format, decontamination and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat_format, decontaminate, lm_scoring, packed, registry

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}
NULL, END, BEGIN = None, "<end>", "<begin>"


class Brute:
    def __init__(self, texts):
        self.one, self.three = Counter(), Counter()
        for t in texts:
            w = self.tokens(t)
            self.one.update(w)
            self.three.update(zip([BEGIN, BEGIN, *w], [BEGIN, *w], w))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.two = Counter(x[1:] for x in self.three)
        self.cont = Counter(x[1] for x in self.two)
        self.behind = defaultdict(lambda: [0, 0, 0, 0])
        for grams in (self.three, self.two):
            for x, c in grams.items():
                self.behind[x[:-1]][min(c, 3) - 1] += 1
                self.behind[x[:-1]][3] += c
        count = lambda x: [sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]
        self.d = {k: lm_scoring.discounts(count(x)) for k, x in ((1, self.cont), (2, self.two), (3, self.three))}
        self.pairs = sum(self.cont.values())
        self.free = sum(self.d[1][min(c, 3) - 1] for c in self.cont.values()) / self.pairs if self.pairs else 1

    def tokens(self, t):
        return [*SPACE_WORD.findall((t or "").translate(LOWER)), END]

    def single(self, w):
        c = self.cont[w]
        return (max(c - self.d[1][min(c, 3) - 1], 0) / self.pairs if c else 0) + self.free / (self.v + 1)

    def after(self, *gram):
        if len(gram) == 1:
            return self.single(*gram)
        if gram[:-1] not in self.behind:
            return self.after(*gram[1:])
        x, c, d = self.behind[gram[:-1]], (self.two if len(gram) == 2 else self.three)[gram], self.d[len(gram)]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / x[3] + sum(p * q for p, q in zip(d, x)) / x[3] * self.after(*gram[1:])


def test_model_equals_brute_force(spark):
    rng = random.Random(1)
    v = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "Q never seen A"), (3, "twice the id"), (None, "no id at all"), (903, "a " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.lm_scoring(df).collect()}
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    m = Brute([t for d, t in rows if not held(d)])
    for d, t in rows:
        w = m.tokens(t)
        r = got[d, len(w)]
        assert (r.held_out, r.train_tokens, r.n_known) == (held(d), m.n, sum(m.one[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((m.one[x] + 1) / (m.n + m.v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(m.after(*x)) for x in zip([BEGIN, BEGIN, *w], [BEGIN, *w], w)))
    for a in ((BEGIN, BEGIN), (BEGIN, v[0]), (v[0], v[1]), ("unknown", v[0]), (v[0], "unknown")):
        assert sum(m.after(*a, w) for w in m.one) + m.after(*a, "neverever") == pytest.approx(1)


def test_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm_scoring.lm_scoring(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_arrays(values):
    a = np.sort(np.array(values, np.uint64))
    assert packed.unpack_sorted(packed.pack_sorted(a)).tolist() == a.tolist()
    b = np.array([x >> 2 for x in values], np.int64)
    assert packed.unpack_values(packed.pack_values(b)).tolist() == b.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**40)), max_size=50), st.sampled_from(["<u2", "<u4"]))
def test_model_arrays_hold_numbers_of_any_size(tmp_path_factory, values, dtype):
    """Counts beyond a byte and running totals beyond their stored low bits come back whole."""
    folder, c = str(tmp_path_factory.mktemp("model")), np.array(values, np.int64) >> 16
    rising = np.sort(np.array(values, np.int64)) >> (16 if dtype == "<u2" else 0)
    lm_scoring._write_counts(folder, "count", 0, c)
    lm_scoring._write_rising(folder, "total", 0, rising, dtype)
    m, at = lm_scoring.Model(folder, {}), np.arange(len(values))
    assert m.counts("count", 0, at).tolist() == c.tolist()
    assert m.rising("total", 0, at, dtype).tolist() == rising.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_chat_round_trip(spark, seed):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>assistant", "\n", "<", "|", "<|", "<||", "a", "é👑", "<|lf|>", "<|image:0|>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "<|x"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))])) for c in range(20) for t in range(rng.randint(1, 6))]
    rows.append((None, 0, None, "null ids are a conversation too"))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chats(df)
    back = {r.conv_id: (r.turns, r.loss) for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    for c, turns in want.items():
        turns.sort(key=lambda x: x[0])
        assert [(x.role, x.text) for x in back[c][0]] == [(r, t) for _, r, t in turns]
        assert back[c][1] == "".join(t for _, r, t in turns if r == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda k, text=None, ref=None, units=None: (k, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "|im_end|>"), part("image", None, "a.png", 2), part("audio", None, "b.wav", 3)]), (1, 1, "assistant", [part("text", "ok"), part("document", None, "c.pdf", 1), part("odd", "plain")]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat_format.PARTS}")
    got = {r.conv_id: r for r in chat_format.format_chats(df, text="role", parts="parts").collect()}
    assert got[1].formatted == "<|im_start|>user\nsee <||im_end|><|image:0|><|audio:1|><|im_end|>\n<|im_start|>assistant\nok<|document:2|>plain<|im_end|>\n"
    assert [(a.place, a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "a.png", 512), (1, 1, "audio", "b.wav", 75), (2, 2, "document", "c.pdf", 512)]
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss] == ["ok<|document:2|>plain"]
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n"


def brute_hits(text, items, size=10):
    w = ALNUM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        b = ALNUM_WORD.findall((t or "").translate(LOWER))
        n = min(size, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, limit):
    rng = random.Random(6)
    v = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(40)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(100, None), (101, "--"), (7, "x1 é2")]
    rows = []
    for i in range(80):
        w = [rng.choice(v) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            t = (items[rng.randrange(12)][1] or "").upper().split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[: rng.choice([len(t), 9, 10, 12])]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    rows += [(900, None), (901, ""), (902, "é2 X1 é2"), (3, "x1. é2")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench, limit=limit).collect())
    want = sorted((d, *(b := brute_hits(t, items)), b[1] > 0) for d, t in rows)
    assert got == want
    kept = {(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench, limit=limit).collect()}
    assert kept == {(d, t) for d, t in rows if brute_hits(t, items)[1] == 0}
    cut = decontaminate.decontaminate(docs, bench, mode="spans", limit=limit).collect()
    assert len(cut) == len(rows)
    clean = {(d, t) for d, t in rows if brute_hits(t, items)[1] == 0}
    assert clean <= {(r.doc_id, r.text) for r in cut}
    assert all(len(r.text or "") < max(len(t or "") for d, t in rows if d == r.doc_id) for r in cut if (r.doc_id, r.text) not in clean and r.doc_id != 3)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    import glob
    import os

    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda d: sorted(d.astype(object).values.tolist(), key=str)
    assert [[pytest.approx(x) if isinstance(x, float) else x for x in r] for r in rows(want)] == rows(got)


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    v = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    bad = ["zzrude" + x for x in "abcdef"]
    rows, labels = [], []
    for i in range(400):
        t = text(rng.randint(60, 120))
        if i % 5 == 0:
            t += " " + " ".join(rng.choice(bad) for _ in range(4))
        rows.append((i, t))
        labels.append((i, int(i % 5 == 0)))
    item, passage = text(30), text(70)
    rows += [(1000, rows[1][1]), (1001, rows[1][1] + " tail"), (1002, text(40) + " " + item + " " + text(20)), (1003, text(50) + " " + passage + " " + text(50)), (1004, text(50) + " " + passage + " " + text(50)), (1005, text(80)), (1006, None), (1007, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
    clean = {d for d, _ in rows} - {d for d, y in labels if y} - {1000, 1001, 1002}
    assert not seen["toxicity"] & {d for d, y in labels if y} and seen["toxicity"] >= clean
    assert seen["near_dedup"] == seen["toxicity"] - {1000, 1001}
    assert seen["substring_dedup"] == seen["near_dedup"]
    assert seen["decontamination"] == seen["substring_dedup"] - {1002}
    assert seen["packing"] == seen["decontamination"] >= clean
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert passage in left[1003] and passage not in left[1004] and left[1005] == dict(rows)[1005]
    want = sorted((r.doc_id, r.piece, r.length) for r in now.collect())
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_items_without_an_id_count_as_in_sql(spark):
    import duckdb
    import pandas as pd

    from quern.llm.decontaminate import contamination, decontaminate
    from quern.llm.registry import SQL

    phrase = lambda k: " ".join(f"{k}word{i}" for i in range(12))
    items = [(None, phrase("a")), (None, phrase("b")), (7, phrase("c"))]
    docs = [(1, "x " + phrase("a")), (2, phrase("b") + " y " + phrase("c")), (3, phrase("c")), (4, "clean text")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame({"item_id": pd.array([i for i, _ in items], dtype="Int64"), "text": [t for _, t in items]}))
    got = contamination(df, bench)
    want = con.sql(f'SELECT {", ".join(got.columns)} FROM ({SQL["op5_decontamination"]})').fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [r.doc_id for r in decontaminate(df, bench).collect()] == [4]


def test_clashing_columns_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "x " + bench.first().text), (1, "x " + bench.first().text), (2, "clean"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit("mine")).withColumn("_n_words", F.lit(5))
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert {(r.doc_id, r._spans, r._n_words) for r in decontaminate.decontaminate(df, bench, mode="spans").collect()} == {(d, "mine", 5) for d, _ in rows}
    with pytest.raises(ValueError, match="taken"):
        decontaminate.find_spans(df, bench)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(df, bench).orderBy("doc_id").collect()] == [12, 12, 0, 0, 0]


def test_near_duplicate_stage_decides_by_row(spark):
    """Rows of one id with different texts, equal rows, rows without an id, columns that cannot be compared."""
    t, u, w = (" ".join(f"{k}{i}" for i in range(60)) for k in "tuw")
    rows = [(1, t), (1, u), (2, t + " more"), (3, u), (3, w), (4, w), (None, t), (None, "alone without an id"), (5, None), (5, None), (6, "six"), (6, "six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("key", F.lit(0))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, t), (1, u), (3, w), (None, "alone without an id"), (5, None), (6, "six")], key=str)


def test_search_finds_each_number_in_its_own_stretch():
    class Reads(np.ndarray):
        """Counts the numbers that are read."""

        n = 0

        def __getitem__(self, at):
            Reads.n += np.size(at)
            return np.asarray(super().__getitem__(at))

    rng = np.random.default_rng(3)
    parts = [np.sort(rng.choice(5000, k, replace=False)) for k in [0, 1, 2, 3, 1000, 0, *rng.integers(0, 40, 200).tolist(), 1, 0]]
    ends = np.cumsum([len(x) for x in parts])
    values = np.concatenate(parts).astype("<u4").view(Reads)
    which = rng.integers(0, len(parts), 20_000)
    wanted = np.array([int(rng.choice(parts[w])) if len(parts[w]) and i % 2 else int(rng.integers(0, 5000)) for i, w in enumerate(which.tolist())])
    start = ends[which] - np.array([len(x) for x in parts])[which]
    place, found = lm_scoring._search(values, start, ends[which], wanted)
    for w, x, p, f, a in zip(which.tolist(), wanted.tolist(), place.tolist(), found.tolist(), start.tolist()):
        assert f == (x in parts[w]) and (not f or parts[w][p - a] == x)
    assert Reads.n < 20_000 * 7
    empty = np.zeros(0, np.int64)
    assert [len(x) for x in lm_scoring._search(np.zeros(0, "<u4"), empty, empty, empty)] == [0, 0]


def test_neighbours_in_one_stretch_are_looked_up_together():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 5000, 1, 0, 40, 3000])
    ends = np.cumsum(sizes)
    values = np.concatenate([np.sort(rng.choice(20_000, n, replace=False)) for n in sizes]).astype("<u4")
    which = np.sort(rng.integers(0, len(sizes), 4000))
    wanted = rng.integers(0, 20_000, 4000)
    taken = []

    class Seen(np.ndarray):
        def __getitem__(self, k):
            taken.append(len(k) if isinstance(k, np.ndarray) else 0)
            return super().__getitem__(k)

    place, found = lm_scoring._search(values.view(Seen), (ends - sizes)[which], ends[which], wanted)
    for w, x, p, f in zip(which.tolist(), wanted.tolist(), place.tolist(), found.tolist()):
        own = values[ends[w] - sizes[w] : ends[w]]
        at = int(np.searchsorted(own, x))
        assert p == ends[w] - sizes[w] + at and f == (at < len(own) and own[at] == x)
    assert sum(taken) <= 4000  # one gather for what was found; before, one for each step of the search
