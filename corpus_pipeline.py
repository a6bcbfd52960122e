"""A training corpus from raw documents: five stages, each on what the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import decontaminate
from quern.llm.near_dedup import BROADCAST_IDS, near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.paragraph_dedup import remove_repeats
from quern.llm.shared import Workspace, free_name, n_rows, settle
from quern.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator scores below 0.5; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("y"))
    model = fit_toxicity(docs.select("doc_id", "text"), labels, Workspace(spark, "toxic-stage"))
    names = free_name(docs.columns, "score"), free_name(docs.columns, "passages")
    return score_toxicity(docs, model, names=names).where(F.col(names[0]) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the lowest id.

    Links are 5-word shingle sets of Jaccard similarity 0.8 or more.  A decision is about the
    row with this id and this text: rows of one id with unlinked texts stay; rows without an id
    come after all others, then the hash of the text decides.  Of rows equal in id and text one
    stays, the first by its columns as JSON.  Null texts and texts without words link with nothing.
    """
    ws = Workspace(spark, "near-stage")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"))
    found = ws.keep(near_duplicates(docs.select(key.alias("doc_id"), "text"), size=5, num=80, den=100).select("doc_id", "kept"), "found")
    twice = ws.keep(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    out = ws.keep(found.where("NOT kept").select("doc_id").distinct(), "out")
    own = free_name(docs.columns, "key")
    named = lambda d: d.withColumnRenamed("doc_id", own)
    few = lambda d: F.broadcast(named(d)) if n_rows(d) <= BROADCAST_IDS else named(d)
    left = docs.withColumn(own, key).join(few(out), own, "left_anti")
    if n_rows(twice):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = left.join(few(twice), own, "left_semi").groupBy(own).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
        left = left.join(few(twice), own, "left_anti").drop(own).unionByName(once)
    return left.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; texts left without words go."""
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any 10-word window of the benchmark; null and empty texts have none and stay, repeated rows fare alike."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; a null or empty text is its end token, every row a document."""
    return pack_documents(docs)


def settled(stage: Callable) -> Callable:
    """The stage, begun with executors that hold nothing of the one before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", settled(drop_toxic)),
    ("near_dedup", settled(drop_near_duplicates)),
    ("substring_dedup", settled(cut_repeats)),
    ("decontamination", settled(drop_contaminated)),
    ("packing", settled(pack_sequences)),
]

#: No stage but the decontamination can be said in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
