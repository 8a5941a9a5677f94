"""Trait rings of network nodes, legends and group recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.transforms import plain_number


def trait_categories(values: DataFrame) -> DataFrame:
    """Categories ``value`` in first-seen order of ``ord``."""
    return (values.select(F.trim("value").alias("value"), "ord").where("value <> ''")
            .groupBy("value").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")))


def _member_values(nodes: DataFrame, members: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """Every shown node, trait and member with its value; nodes without members keep one row."""
    shown = nodes.where(~F.col("is_intermediate")).select(
        "node_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("trait"))
    values = traits.where(F.col("trait").isin(names)).select("sample", "trait", F.trim("value").alias("value"))
    return shown.join(members, "node_id", "left").join(values, ["sample", "trait"], "left")


def discrete_rings(nodes: DataFrame, members: DataFrame, traits: DataFrame,
                   schema: dict[str, list[str]]) -> DataFrame:
    """Segments ``node_id, trait, ord, label, n``: schema order, then first seen, blanks last.

    An observed node without members gets one blank segment; intermediate nodes get none.
    """
    cells = _member_values(nodes, members, traits, list(schema)).withColumn("label", F.coalesce("value", F.lit("")))
    counts = cells.groupBy("node_id", "trait", "label").agg(
        F.greatest(F.count("sample"), F.lit(1)).alias("n"), F.min("ord").alias("__first"))
    rank = F.lit(None).cast("int")
    for name, order in schema.items():
        for k, category in enumerate(order):
            rank = F.when((F.col("trait") == name) & (F.col("label") == category), k).otherwise(rank)
    known = F.coalesce(rank, F.when(F.col("label") == "", 1 << 30).otherwise(1 << 29))
    by_node = Window.partitionBy("node_id", "trait").orderBy(known, F.col("__first"), "label")
    return counts.withColumn("ord", F.row_number().over(by_node).cast("bigint")).drop("__first")


def trait_range(members: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """Observed range of numeric traits over network samples; 0..1 when there is none."""
    asked = traits.sparkSession.createDataFrame([(n,) for n in names], "trait string")
    seen = (traits.where(F.col("trait").isin(names)).join(members.select("sample"), "sample", "left_semi")
            .groupBy("trait").agg(F.min(plain_number(F.col("value"))).alias("lo"), F.max(plain_number(F.col("value"))).alias("hi")))
    return asked.join(seen, "trait", "left").select(
        "trait", F.coalesce("lo", F.lit(0.0)).alias("vmin"), F.coalesce("hi", F.lit(1.0)).alias("vmax"))


def continuous_rings(nodes: DataFrame, members: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """Value counts ascending with their place in the trait range, the missing segment last.

    ``mean`` and ``mean_position`` repeat the node's ring value on each of its segments.
    """
    cells = _member_values(nodes, members, traits, names).withColumn("label", plain_number(F.col("value")))
    counts = cells.groupBy("node_id", "trait", "label").agg(F.greatest(F.count("sample"), F.lit(1)).alias("n"))
    per_node = Window.partitionBy("node_id", "trait")
    weighted = F.sum(F.col("label") * F.col("n")).over(per_node)
    known = F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(per_node)
    span = F.col("vmax") - F.col("vmin")
    def place(value: F.Column) -> F.Column:
        return F.when(value.isNotNull(), F.when(span == 0, 0.5).otherwise((value - F.col("vmin")) / F.nullif(span, F.lit(0.0))))
    return (counts.withColumn("mean", weighted / known)
            .withColumn("ord", F.row_number().over(per_node.orderBy(F.asc_nulls_last("label"))).cast("bigint"))
            .join(trait_range(members, traits, names), "trait")
            .withColumn("position", place(F.col("label"))).withColumn("mean_position", place(F.col("mean")))
            .drop("vmin", "vmax"))


def trait_legend(members: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """Observed categories per trait (blank label for missing) over network samples."""
    asked = members.select("sample", F.explode(F.array(*[F.lit(n) for n in names])).alias("trait"))
    values = traits.where(F.col("trait").isin(names)).select("sample", "trait", F.trim("value").alias("value"))
    return (asked.join(values, ["sample", "trait"], "left")
            .groupBy("trait", F.coalesce("value", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("is_missing", F.col("label") == ""))


def reassign_group(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Groups after moving samples (``changes(sample, grp)``), blank meaning ``Default``."""
    moved = changes.select("sample", F.col("grp").alias("__to"))
    return (groups.join(moved, "sample", "left")
            .withColumn("grp", F.coalesce(F.nullif(F.trim(F.coalesce("__to", "grp")), F.lit("")), F.lit("Default")))
            .drop("__to"))


def rename_group(groups: DataFrame, old: str, new: str) -> DataFrame:
    return groups.withColumn("grp", F.when(F.col("grp") == old, new).otherwise(F.col("grp")))


def group_counts(members: DataFrame, groups: DataFrame) -> DataFrame:
    return (members.join(groups, "sample").groupBy("node_id", "grp").agg(F.count(F.lit(1)).alias("n")))
