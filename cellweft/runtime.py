"""Session defaults and lineage cuts shared by every operator.

A lineage cut is a Parquet table written under ``spark.checkpoint.dir``. Unlike a cached or locally
checkpointed frame it survives the loss of any executor, and a later reader prunes its columns.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings of Arrow batches: Spark's defaults, and what the engine sets where they stand.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}

#: The setting of rows in a batch of a Parquet scan; Spark's default, and what scans of long texts set where it stands.
SCANNED, SCANNED_ROWS = "spark.sql.parquet.columnarReaderBatchSize", ("4096", "512")


def session(app: str = "cellweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the given settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``. Where that is unset and the session is local
    (driver and executors are one process) a temporary folder is made; a cluster must name its own.
    """
    for read in (spark.conf.get, spark.sparkContext.getConf().get):
        if found := read("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='cellweft-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/cellweft/{tag}-{uuid.uuid4().hex}"


#: Tables that ``materialize`` has made and that were not discarded yet, in turn.
_made: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path, schema = shared_path(spark, tag), df.schema
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    del df
    reclaim(spark)
    out = spark.read.schema(schema).parquet(path)
    out._cellweft_path = path
    return out


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced, which it does as the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Let the driver's JVM give freed native memory back to the system; False where it cannot (HotSpot on Linux can, from 17.0.9 on)."""
    java, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    args = array(java.Object, 4)
    args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = array(java.Object, 0), array(java.String, 0)
    try:
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)  # the server's own class is hidden
    except Py4JError:
        return False
    return True


def relieve(spark: SparkSession) -> int:
    """Let the executors' JVMs collect garbage, so that they give back the heap that earlier steps made them take: a heap grows by the large pages of sorts and
    aggregates, and shrinks in a full collection only. One short task for each core, so that every executor gets some; the number of tasks is returned.

    It does not hang on data, and results do not depend on it. A local session has no executors of its own: nothing is done there, as ``reclaim`` serves its JVM.
    """
    if spark.sparkContext.master.partition("[")[0] == "local":
        return 0
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    return cores


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Scans that run meanwhile read Parquet in batches of fewer rows: a task holds a whole batch of texts in the JVM, grown by doubling."""
    default, fewer = SCANNED_ROWS
    if spark.conf.get(SCANNED) != default:
        yield
        return
    spark.conf.set(SCANNED, fewer)
    try:
        yield
    finally:
        spark.conf.set(SCANNED, default)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    path = getattr(df, "_cellweft_path", None)
    if path:
        _delete(df.sparkSession, path)
        reclaim(df.sparkSession)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


def tables_made() -> list[str]:
    """The tables made so far, for ``sweep``."""
    return list(_made)


def sweep(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Delete the tables made since ``before`` was taken, but for ``keep``: no later plan may read them."""
    for path in [p for p in _made if p not in before and p != getattr(keep, "_cellweft_path", None)]:
        _delete(spark, path)
    reclaim(spark)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That serves local sessions and clusters with the package in the same place on every machine; others get it by ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    # Rows may be long texts: batches of Spark's default size can take most of a Python worker's memory.
    for key, (default, smaller) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, smaller)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its scan has fewer splits than there are cores, for work that is dear for each row.

    Only a table of a few splits is shuffled; the plan of a large one is left alone. The splits are known without a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lanes(spark: SparkSession) -> int:
    """Partitions for a shuffle by few, heavy keys: as set for shuffles, but not fewer than cores, and not coalesced by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
