"""Prefix scans over a global order: ranges of rows, running values inside, one carry row a range.

Rows are dealt to ranges of the order, so no task sorts more than its range; what crosses from
range to range is one row for each of them, over which the only global window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.storage import cut

RANGE = "__range"


def ranged(df: DataFrame, order: list[str], label: str = "ranged") -> DataFrame:
    """``df`` written in ranges of ``order`` (nulls first), numbered in ``__range``. Equal rows share a range."""
    return cut(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), label)


def _before(totals: DataFrame) -> Window:
    return Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its 1-based place ``out`` in ``order``, which must tell all rows apart."""
    rows = ranged(df, order)
    counts = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(RANGE, F.coalesce(F.sum("__n").over(_before(counts)), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    return (rows.join(offsets, RANGE).withColumn(out, (inside + F.col("__off")).cast("bigint"))
            .drop(RANGE, "__off"))


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``df`` with running ``values`` along ``order``: name -> (``sum``, ``max`` or ``min``, column).

    A value covers the row itself and all rows before it, or with ``before`` only the rows before
    it (null at the first row; sums start at null too). ``order`` must tell all rows apart.
    """
    fold = {"sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
            "max": (F.max, F.greatest), "min": (F.min, F.least)}
    rows = ranged(df.select("*", *[c.alias(f"__v_{n}") for n, (_, c) in values.items()]), order)
    totals = rows.groupBy(RANGE).agg(*[fold[how][0](f"__v_{n}").alias(f"__t_{n}") for n, (how, _) in values.items()])
    carry = totals.select(RANGE, *[fold[how][0](f"__t_{n}").over(_before(totals)).alias(f"__c_{n}")
                                   for n, (how, _) in values.items()])
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.join(carry, RANGE)
    for n, (how, _) in values.items():
        total, both = fold[how]
        out = out.withColumn(n, both(F.col(f"__c_{n}"), total(f"__v_{n}").over(inside)))
    return out.drop(RANGE, *[f"__{k}_{n}" for n in values for k in "vc"])


def preceding(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with ``values`` (name -> column) of the row before it in ``order``; null at the first row."""
    rows = ranged(df, order)
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), F.struct(*order))
    ends = rows.groupBy(RANGE).agg(last.alias("__last"))
    carry = ends.select(RANGE, F.lag("__last").over(Window.orderBy(RANGE)).alias("__last"))
    inside = Window.partitionBy(RANGE).orderBy(*order)
    out = rows.join(carry, RANGE).withColumn("__first", F.row_number().over(inside) == 1)
    for n, c in values.items():
        out = out.withColumn(f"__l_{n}", F.lag(c).over(inside))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*kept, *[F.when(F.col("__first"), F.col(f"__last.{n}")).otherwise(F.col(f"__l_{n}")).alias(n) for n in values])
