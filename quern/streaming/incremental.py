"""Steps that resume: what is done stays done, what failed is tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.joins import last_of, todo


class VerdictCache:
    """Verdicts of (crit_id, row_id), bound to the settings they were made with.

    The table is partitioned by the settings' hash; a folder that holds other settings is
    refused.  A folder without a stamp is adopted (and so marked) unless ``strict``.
    """

    SCHEMA = "crit_id string, row_id string, flag boolean, seq long"

    def __init__(self, spark: SparkSession, path: str, settings: str, *, strict: bool = False):
        self.spark, self.path, self.settings = spark, path, settings
        found = self._stamps()
        if found - {settings, None}:
            raise ValueError(f"{path} was made with other settings")
        self.adopted = None in found
        if self.adopted and strict:
            raise ValueError(f"{path} has verdicts without a settings stamp")

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _stamps(self) -> set[str | None]:
        if not self._exists():
            return set()
        df = self.spark.read.parquet(self.path)
        return {r[0] for r in df.select("settings").distinct().collect()} if "settings" in df.columns else {None}

    def read(self) -> DataFrame:
        """The last successful verdict of every (crit_id, row_id)."""
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        df = self.spark.read.parquet(self.path).select(*[c.split()[0] for c in self.SCHEMA.split(", ")])
        return last_of(df, ["crit_id", "row_id"], ["seq"], F.col("flag").isNotNull())

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted(crit_id, row_id, ...) without a successful verdict."""
        return todo(wanted, self.read(), ["crit_id", "row_id"])

    def append(self, verdicts: DataFrame) -> None:
        verdicts.select("crit_id", "row_id", "flag", F.col("seq").cast("long"), F.lit(self.settings).alias("settings")).write.mode("append").partitionBy("settings").parquet(self.path)


def resume_batch(source: DataFrame, log_path: str, step: Callable[[DataFrame], DataFrame], *, keys: list[str], succeeded: str = "error IS NULL") -> int:
    """Run ``step`` on the rows of ``source`` that the log has no success for; append what it returns."""
    spark = source.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log_path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    left = todo(source, spark.read.parquet(log_path), keys, succeeded=F.expr(succeeded)) if exists else source
    left = left.persist()
    n = left.count()
    if n:
        step(left).write.mode("append").parquet(log_path)
    left.unpersist()
    return n


def resume_stream(spark: SparkSession, source: str, schema: str, log_path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], *, keys: list[str], format: str = "json", files_per_batch: int = 10):
    """The same over files as they come: each micro-batch drops finished keys, runs ``step``, appends.

    The checkpoint remembers files; the anti-join makes a repeated batch harmless.  Returns the
    finished query (``availableNow``).
    """

    def each(batch: DataFrame, number: int) -> None:
        resume_batch(batch.dropDuplicates(keys), log_path, step, keys=keys)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
