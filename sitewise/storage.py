"""Shared-folder helpers: lineage cuts, scratch folders and distributed row numbers."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# One ranking bucket holds at most this many rows, because the keys are distinct integers.
RANK_WIDTH = 1 << 18
# Spark fills an Arrow batch with 10,000 rows whatever their length; texts are sent in batches of about 4 MB instead.
BATCH_BYTES = 1 << 22
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` of the session, else the folder already set for checkpoints, else a
    folder under ``spark.sql.warehouse.dir``. A folder of one machine is refused on a cluster.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        if system.getScheme() == "file" and not context.master.startswith("local"):
            raise ValueError(f"{folder} is local to one machine; set spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session whose executors do not have it installed.

    The archive is written to the shared folder, from which executors that start later fetch it
    as well. A second call does nothing.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    name = f"{package.name}.zip"
    if any(f.endswith(f"/{name}") for f in context.listFiles):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    target = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/{name}")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every scratch table this driver has written; returns their number.

    Call it once the results that read them are saved.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    count = 0
    while _written:
        path = hadoop.Path(_written.pop())
        count += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove(path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    A written table survives the loss of any executor and, unlike a checkpointed RDD,
    keeps columnar statistics and column pruning for the jobs that read it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, label: str = "cut", fingerprint: bool = False
                ) -> tuple[DataFrame, tuple[int, int]]:
    """``cut`` that also returns the row count (and an order-free content hash).

    Both are observed while the table is written, so a loop needs no extra job to decide
    whether it is done.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n")]
    if fingerprint:
        metrics.append(F.bit_xor(F.xxhash64(*df.columns)).alias("h"))
    out = cut(df.observe(seen, *metrics), label)
    got = seen.get
    return out, (got["n"], got.get("h", 0))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send Python at most ``BATCH_BYTES`` (and the row that passes them) at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small scan arrives in fewer splits than there are cores.

    Large inputs already have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def dense_index(df: DataFrame, key: str, out: str, by: list[str] | None = None,
                width: int = RANK_WIDTH) -> DataFrame:
    """1-based rank of a distinct integer ``key`` (within ``by``), without a global sort.

    Rows are bucketed by ``key div width``; a bucket therefore never exceeds ``width`` rows
    per ``by`` value. Only the per-bucket counts are accumulated in one ordered window.
    """
    by = by or []
    tagged = df.withColumn("__b", F.expr(f"`{key}` div {width}L"))
    counts = tagged.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
              ).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__b").orderBy(key)
    return (tagged.join(offsets, [*by, "__b"])
            .withColumn(out, (F.row_number().over(inside) + F.col("__off")).cast("bigint"))
            .drop("__b", "__off"))
