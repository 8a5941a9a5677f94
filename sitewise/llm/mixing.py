"""Mixing sources to target weights with whole-document repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.words import WORD
from sitewise.storage import cut

WEIGHTS = (1, 2, 3)
LIMIT = 3


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source with ``source_size``, ``target`` and ``rate``.

    Sources in code-point order, null last, take the weights in turn and share the size of the
    whole corpus. A target stops at ``limit`` times its source's size; what it leaves goes to the
    others by weight. Sources ordered by size per weight fill up in that order, so the level at
    which the rest shares is found from running sums over one row per source. A source without
    words has target and rate 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per_source.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1).cast("bigint"))
    everything = Window.partitionBy()
    upto = (Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
            .rowsBetween(Window.unboundedPreceding, -1))
    # level: what a unit of weight gets if all sources before this one are full
    level = ((F.sum("source_size").over(everything) - limit * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
             .cast("double")
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))))
    levelled = weighed.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") <= limit * F.col("source_size"))
    # filling a source that need not be full lowers the level of those behind it
    shared = levelled.withColumn("share", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.least(F.coalesce(F.col("share") * F.col("weight"), F.lit(float("inf"))),
                     (limit * F.col("source_size")).cast("double"))
    return (shared.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                        .otherwise(0.0))
            .select("source", "source_size", "target", "rate"))


def draw(seed: int) -> Column:
    """Number in [0, 1) that depends on the document alone: reruns and retries agree."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 17) -> DataFrame:
    """``docs`` keys with ``size``, ``source_size``, ``target`` and ``copies``.

    One scan of the texts leaves sizes; sums per source combine before the shuffle, so a source
    with a third of the rows is one row per task. The table of sources is written, which lets
    Spark see its size and broadcast it only if small. A null text has size 0; null is a source
    of its own; repeated rows are drawn alike; an empty table gives no row. Only the columns
    doc_id, text and source are read, so others cannot clash.
    """
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("draw")),
                "mix-sizes")
    targets = cut(source_targets(sizes, weights, limit).withColumnRenamed("source", "of_source"), "mix-targets")
    whole = F.floor("rate")
    copies = F.least(whole + (F.col("draw") < F.col("rate") - whole).cast("bigint"), F.lit(limit).cast("bigint"))
    return (sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
            .select("doc_id", "size", "source_size", "target", copies.alias("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs``, all its columns, as often as its rate asks.

    The rate of a source and the draw of a row come as in ``plan_mix``; rows are repeated in
    place, without a shuffle of texts.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = cut(source_targets(sizes, weights, limit).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate")), "mix-targets")
    whole = F.floor("__rate")
    copies = F.least(whole + (draw(seed) < F.col("__rate") - whole).cast("bigint"), F.lit(limit).cast("bigint"))
    return (docs.join(targets, F.col("source").eqNullSafe(F.col("__source")))
            .withColumn("__copies", copies).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
