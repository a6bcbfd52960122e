"""Readers, packs, resumable steps and the loop's state."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import packs, records
from quern.streaming.incremental import VerdictCache, resume_batch, resume_stream
from quern.streaming.rounds import State, Stop, fingerprint, installment, measure, run_loop

SCHEMA = "id string, prompt string"


def test_torn_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "prompt": "x"}\n\n{"id": "2", "pro')
    good, bad = records.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), SCHEMA)
    assert [r.id for r in good.collect()] == ["1"] and bad.first()["n_bad"] == 1
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA, strict=True).collect()


def test_answers_take_their_entity_from_record_argument_or_folder(spark, tmp_path):
    (tmp_path / "uk").mkdir()
    (tmp_path / "uk" / "s1_gen.jsonl").write_text('{"id": "1", "kind": "positive"}\n{"id": "2", "kind": "x", "entity": "own"}\n')
    got = records.read_eval_answers(spark, str(tmp_path), "id string, kind string, entity string")
    assert {(r.id, r.student, r.entity) for r in got.collect()} == {("1", "s1", "uk"), ("2", "s1", "own")}
    assert records.read_eval_answers(spark, str(tmp_path), "id string, kind string, entity string", entity="arg", kinds=["positive"]).first()["entity"] == "arg"


def test_index_mapping_count_and_templates(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 7)], "id string, own long")
    assert [r.idx for r in records.with_idx(df, own="own").collect()] == [0, 7]
    assert [(r.id, r.idx) for r in records.with_idx(df, "id").orderBy("idx").collect()] == [("a", 0), ("b", 1)]
    (tmp_path / "m.json").write_text(json.dumps({"x": 1.5, "y": 2}))
    assert {(r.key, r.value) for r in records.read_mapping(spark, str(tmp_path / "m.json")).collect()} == {("x", 1.5), ("y", 2.0)}
    (tmp_path / "uk.txt").write_text("a {x}\nb")
    assert records.read_templates(spark, str(tmp_path)).first()["template"] == "a {x}\nb"
    assert records.row_count(spark, str(tmp_path / "uk.txt")) == 2 and records.row_count(spark, str(tmp_path / "none")) is None


PACK = """intro
[B1] (total 12.3)
PROMPT: p one
more
RESPONSE: r <<one|2.1>>
[3]
last<|eot_id|>
[C1] (peak -0.5)
PROMPT: p two
RESPONSE: r two

CLEAN CONTROL
[B9] (total 1)
PROMPT: never"""


def test_pack(spark):
    df = spark.createDataFrame([("s", PACK), ("r", "[1]\nPROMPT: a\nRESPONSE: b\n[2]\nPROMPT: c\nRESPONSE: d")], "pack_id string, text string")
    got = {(r.pack_id, r.block_id): (r.prompt, r.response) for r in packs.parse_any_pack(df).collect()}
    assert got == {("s", "B1"): ("p one\nmore", "r one\n[3]\nlast"), ("s", "C1"): ("p two", "r two"), ("r", "1"): ("a", "b"), ("r", "2"): ("c", "d")}


def test_resume_tries_errors_again(spark, tmp_path):
    log, failing = str(tmp_path / "log"), [True]
    source = spark.range(4).select(F.col("id").cast("string").alias("id"))
    step = lambda b: b.withColumn("error", F.when((F.col("id") == "3") & F.lit(failing[0]), "down"))
    assert resume_batch(source, log, step, keys=["id"]) == 4
    failing[0] = False
    assert resume_batch(source, log, step, keys=["id"]) == 1
    assert resume_batch(source, log, step, keys=["id"]) == 0


def test_stream_resumes_over_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: resume_stream(spark, str(src), "id string", str(tmp_path / "log"), str(tmp_path / "state"), lambda b: b.withColumn("error", F.lit(None).cast("string")), keys=["id"])
    (src / "a.json").write_text('{"id": "1"}\n{"id": "1"}\n{"id": "2"}\n')
    run()
    (src / "b.json").write_text('{"id": "2"}\n{"id": "3"}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["1", "2", "3"]


def test_verdict_cache_is_bound_to_its_settings(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = VerdictCache(spark, path, "s1")
    rows = spark.createDataFrame([("c", "1", True, 1), ("c", "1", None, 2), ("c", "2", None, 3)], "crit_id string, row_id string, flag boolean, seq long")
    cache.append(rows)
    assert [(r.row_id, r.flag) for r in VerdictCache(spark, path, "s1").read().collect()] == [("1", True)]
    wanted = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1")], "crit_id string, row_id string")
    assert sorted((r.crit_id, r.row_id) for r in cache.missing(wanted).collect()) == [("c", "2"), ("d", "1")]
    with pytest.raises(ValueError):
        VerdictCache(spark, path, "s2")
    bare = str(tmp_path / "bare")
    rows.write.parquet(bare)
    assert VerdictCache(spark, bare, "s1").adopted
    with pytest.raises(ValueError):
        VerdictCache(spark, bare, "s1", strict=True)


def test_loop(spark):
    pool = spark.range(10).withColumnRenamed("id", "row_id")
    assert fingerprint(pool) == fingerprint(pool.repartition(3)) != fingerprint(pool.where("row_id < 9"))
    state, calls = State(pool_rows=10), []
    for _ in range(2):
        assert measure(state, pool, lambda p: calls.append(1) or 4.0) == 4.0
    assert len(calls) == 1
    assert measure(state, pool.where("row_id < 5"), lambda p: None) is None and len(state.deferred) == 1
    report = lambda block: spark.createDataFrame([(i, c, 10 - 3 * (i + 1), True) for i, c in enumerate(block)], "ord int, crit_id string, pool_after int, applied boolean")
    installment(state, 1, ["a", "b"], report, floor=3)
    assert state.pool_rows == 4 and not state.below_floor
    end = run_loop(State(pool_rows=100), lambda s: (s.round == 3, 1), cap=2, floor=1)
    assert (end.round, end.stop) == (2, Stop.ROUND_CAP)
    end = run_loop(end, lambda s: (s.round == 3, 1), cap=5, floor=1)
    assert (end.round, end.stop) == (3, Stop.SUBSETS_CLEAN)


def test_whole_texts_come_back_from_packs(spark, tmp_path):
    """Long texts, blank lines and late header-like lines; a response loses the white space at its end alone."""
    from quern.plans.q_text import parse_pack

    long = "\n".join(f"line {i} of a long text\n\n (total {i}) see [{i}] below" for i in range(400))
    docs = [(i, ("a", "b")[i % 2], f"{i} {long}\n\nend {i}" if i % 3 else f"short {i}  \n") for i in range(70)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.pack_id, r.prompt, r.response) for r in parse_pack(spark, str(tmp_path)).collect())
    assert got == sorted((f"{s}/{i // 16}", t, t.rstrip()) for i, s, t in docs)
