"""Ordered text scans: every line (or record) keeps its place in its file without a sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_SPLITS = 200_000


def document_of(file_path: Column) -> Column:
    """Folder of a part file that Spark wrote, else the file itself."""
    return F.regexp_replace(file_path, r"/part-\d{5,}-[0-9a-f-]{36}[^/]*$", "")


def ordered_text(spark: SparkSession, path: str | list[str], line_sep: str | None = None,
                 document: Callable[[Column], Column] = document_of) -> DataFrame:
    """``file, line`` (0-based inside its file), ``row`` (0-based over all files) and ``value``.

    A split's records are contiguous, so a record's number is its place inside the split plus the
    sizes of the splits before it. Only one row per split is ever ordered. The parts of a folder
    that Spark wrote are one file, in the order of their names; ``document`` says what one file is.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    raw = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("__part"),
        F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = raw.groupBy("__part", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first")).withColumn(
        "file", document(F.col("__part")))
    def before(w: Window) -> F.Column:
        return F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select(
        "file", "__part", "__start", "__first",
        before(Window.partitionBy("file").orderBy("__part", "__start")).alias("__in_file"),
        before(Window.partitionBy(F.lit(0)).orderBy("file", "__part", "__start")).alias("__in_all"))
    place = F.col("__id") - F.col("__first")
    # there are at most as many splits as files plus full partitions; a small table is broadcast,
    # a larger one is left to the join, where one key is one split
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return raw.join(offsets, ["__part", "__start"]).select(
        "file", (place + F.col("__in_file")).alias("line"), (place + F.col("__in_all")).alias("row"), "value")


def write_lines(df: DataFrame, path: str, order: list[str], value: Column | None = None) -> None:
    """Write the ``value`` column as text in the given order (part files sort by name).

    A sort reads its input twice, once for the bounds of its ranges; a costly ``value`` that is
    given as an expression is made behind the sort, once for each row and in all of its tasks.
    """
    df.orderBy(*order).select("value" if value is None else value.alias("value")).write.text(path)
