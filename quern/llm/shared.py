"""Folders that the driver and every executor see.

Intermediate tables and model files go below ``spark.checkpoint.dir`` of the
running session.  Only where that setting is absent (unit tests, a laptop) is a
folder of the driver's machine chosen, once a process.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to a Python worker, where the session has Spark's default.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16777216"


def base_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session names it; a local one if unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def is_mounted(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def local_path(uri: str) -> str:
    """The mounted path behind a ``file:`` URI or a plain path.

    Memory-mapped models and addressable token files need a POSIX mount; any
    other scheme is refused by name instead of being written to a local disk.
    """
    if not is_mounted(uri):
        raise ValueError(f"{uri}: memory-mapped files need a mounted shared folder; pass one as work_dir")
    return urlparse(uri).path


class Workspace:
    """One folder of intermediate results; ``close`` or the end of the process removes it."""

    def __init__(self, spark: SparkSession, name: str, work_dir: str | None = None):
        self.spark = spark
        if spark.conf.get(BATCH_CONF, None) in (None, "", "2147483647", "2147483647b", "-1", "67108864", "67108864b", "64MB"):
            spark.conf.set(BATCH_CONF, BATCH_BYTES)
        self.uri = f"{(work_dir or base_dir(spark)).rstrip('/')}/quern-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def folder(self, name: str) -> str:
        """A mounted folder for files that workers write and map themselves."""
        path = local_path(self.path(name))
        os.makedirs(path, exist_ok=True)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: lineage ends here, lost executors cost nothing.

        The rows are counted on their way out (see ``n_rows``).
        """
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(name))
        kept = self.spark.read.schema(df.schema).parquet(self.path(name))
        kept.quern_rows = seen.get.get("n")
        return kept

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        target = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.uri)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    def free(self, *names: str) -> None:
        """Remove tables that nothing reads any more, and let Spark clean the shuffles behind them.

        Shuffle files go when the driver's garbage collector finds their plans dead, which on
        its own may take half an hour.
        """
        for name in names:
            self.drop(name)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001 - the session may be gone when the process ends
            path = urlparse(self.uri)
            if path.scheme in ("", "file"):
                import shutil

                shutil.rmtree(path.path, ignore_errors=True)


def settle(spark: SparkSession) -> None:
    """Let the executors' JVMs collect, and give back the heap and classes that ended steps have left.

    A heap that has grown keeps its size otherwise, beside whatever the Python workers of the
    next step need.  One short task a core; no result depends on where they run.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where("length(concat('', coalesce(reflect('java.lang.System', 'gc'), ''))) < 0").count()


#: Narrow rows (ids and labels) that a broadcast may hold.
BROADCAST_ROWS = 200_000


def n_rows(df: DataFrame) -> int:
    """Rows of a table that ``Workspace.keep`` gave, without a job; others are counted."""
    known = getattr(df, "quern_rows", None)
    return df.count() if known is None else known


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``rows`` rows; beyond, joins shuffle.

    For narrow tables that are kept.
    """
    return F.broadcast(df) if n_rows(df) <= rows else df


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the bytes of ``df``, from file sizes; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``taken``."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def replace_file(path: str, chunks) -> int:
    """Write ``chunks`` under a name of its own, then move: a repeated task attempt changes nothing."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    size = 0
    with open(tmp, "wb") as out:
        for c in chunks:
            b = memoryview(c).cast("B") if len(c) else b""
            out.write(b)
            size += len(b)
    os.replace(tmp, path)
    return size
