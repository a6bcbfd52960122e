"""Readers and writers of JSON-lines records, with the rules of their producers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, *, strict: bool = False) -> DataFrame:
    """Records of one or many files or globs; blank lines are skipped.

    ``strict`` fails at a malformed line; otherwise its fields are null.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good records, one row with ``n_bad``): torn lines of interrupted writers are counted, not fatal."""
    kind = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", StructType([*kind.fields]).add(CORRUPT, "string"), {"columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.`{f.name}`") for f in kind.fields]), parsed.agg(F.count_if(bad).alias("n_bad"))


def read_eval_answers(spark: SparkSession, root: str, schema: StructType | str, *, entity: str | None = None, kinds: list[str] | None = None, suffix: str = "_gen.jsonl") -> DataFrame:
    """Answers below ``root``: ``student`` from the file name, ``entity`` from the record, the argument or the folder, in this order."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").json(root)
    path = F.col("_metadata.file_path")
    df = df.withColumns({"student": F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix.replace(".", "\\.") + "$", ""), "_folder": F.element_at(F.split(path, "/"), -2)})
    own = [F.col("entity")] if "entity" in df.columns else []
    df = df.withColumn("entity", F.coalesce(*own, F.lit(entity), F.col("_folder"))).drop("_folder")
    return df.where(F.col("kind").isin(kinds)) if kinds else df


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole-JSON file as a table (objects are rows of their fields)."""
    return spark.read.option("multiLine", "true").json(path)


def read_mapping(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """A JSON object of one kind of value as rows (key, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_templates(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(name, template) of every file of a folder."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return df.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), suffix.replace(".", "\\.") + "$", "").alias("name"), F.col("value").alias("template"))


def with_idx(df: DataFrame, *order: str | Column, own: str | None = None) -> DataFrame:
    """``idx`` from 0 in the given order; a record's own index, if it has one, wins.

    Without an order the file order is taken (``zipWithIndex`` over input splits): one pass,
    no shuffle, done once at ingest because every later join relies on it.
    """
    if order:
        out = df.withColumn("_i", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    else:
        schema = StructType([*df.schema.fields]).add("_i", "long", False)
        out = df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    return out.withColumn("idx", F.coalesce(own, "_i") if own else F.col("_i")).drop("_i")


def row_count(spark: SparkSession, path: str) -> int | None:
    """Lines that are not blank; None if there is no such file."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.text(path).where(F.trim("value") != "").count()


def training_rows(df: DataFrame, name: str, *, order: list[str], model: str, source: str | None = None, mask: str | None = None) -> DataFrame:
    """Canonical rows: id ``{name}_{k:06d}`` in output order, source and model by default where empty."""
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)) if c in df.columns else F.lit(default)
    k = F.row_number().over(Window.orderBy(*order)) - 1
    cols = [F.format_string(f"{name}_%06d", k).alias("id"), (F.lit(source) if source else filled("source", name)).alias("source"), filled("model", model).alias("model"), F.col("prompt"), F.col("response")]
    return df.select(*cols, *([F.sort_array(mask).alias("mask_positions")] if mask else []))


def write_rows(df: DataFrame, path: str, *, append: bool = False) -> None:
    """JSON lines, committed as a whole (the folder's _SUCCESS file is the sentinel)."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(spark: SparkSession, df: DataFrame, path: str) -> None:
    """A small report as one JSON row per record, in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def prompt_pack(df: DataFrame, *, order: list[str], by: str | None = None) -> DataFrame:
    """(by, pack): numbered PROMPT/RESPONSE blocks of each group in order, as one text."""
    group = [by] if by else []
    n = F.row_number().over(Window.partitionBy(*(group or [F.lit(1)])).orderBy(*order))
    block = F.concat(F.lit("["), n.cast("string"), F.lit("]\nPROMPT: "), F.coalesce("prompt", F.lit("")), F.lit("\nRESPONSE: "), F.coalesce("response", F.lit("")))
    blocks = df.select(*group, n.alias("n"), block.alias("block"))
    return blocks.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("pack"))


def cross_tab(df: DataFrame, *, rows: str, columns: str, value: str, first: str | None = None, last: str = "other") -> DataFrame:
    """Value by row and column; one column may come first, and one row label last."""
    names = sorted(r[0] for r in df.select(columns).distinct().collect() if r[0] is not None)
    names = [n for n in names if n == first] + [n for n in names if n != first]
    return df.groupBy(rows).pivot(columns, names).agg(F.first(value)).orderBy((F.col(rows) == last), rows)
