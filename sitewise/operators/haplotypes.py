"""Haplotype identification and its trait summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.storage import dense_index


def collapse(samples: DataFrame, *by: str, sequence: str = "sequence") -> DataFrame:
    """Distinct sequences (within ``by``) with their first sample and their count.

    Groups on a SHA-256 fingerprint: the shuffle carries 64 bytes per distinct sequence and
    partition instead of the sequence, and copies are combined before it, so a sequence held
    by a third of the samples costs one row per partition.
    """
    return (samples.groupBy(*by, F.sha2(sequence, 256).alias("fingerprint"))
            .agg(F.min("sample_idx").alias("first_idx"), F.count(F.lit(1)).alias("n")))


def identify_haplotypes(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(haplotypes, assignments)`` with labels H1, H2, ... in first-observation order.

    Members stay in the long ``assignments`` table: a haplotype may own a third of all samples.
    """
    literal = samples.withColumn("sequence", F.upper("sequence"))
    distinct = collapse(literal)
    labelled = dense_index(distinct, "first_idx", "hap_idx").withColumn(
        "haplotype", F.concat(F.lit("H"), F.col("hap_idx").cast("string")))
    haplotypes = (labelled
                  .join(literal.select(F.col("sample_idx").alias("first_idx"), "sequence"),
                        "first_idx")
                  .select("hap_idx", "haplotype", "sequence", "n", "first_idx"))
    assignments = (literal.withColumn("fingerprint", F.sha2("sequence", 256)).drop("sequence")
                   .join(labelled.select("fingerprint", "hap_idx", "haplotype"), "fingerprint")
                   .drop("fingerprint"))
    return haplotypes, assignments


def haplotype_traits(assignments: DataFrame, traits: DataFrame) -> DataFrame:
    """Left join of sample traits; a sample without traits gets ``"0"`` and ``""``."""
    return (assignments.select("sample_idx", "sample", "hap_idx", "haplotype")
            .join(traits.select("sample", "continuous", "discrete"), "sample", "left")
            .withColumn("continuous", F.coalesce("continuous", F.lit("0")))
            .withColumn("discrete", F.coalesce("discrete", F.lit(""))))


def haplotype_trait_values(with_traits: DataFrame) -> DataFrame:
    """Distinct trait values per haplotype in long form, ``ord`` giving the list order.

    Continuous values are listed in first-seen order, discrete values sorted and non-blank.
    """
    long = with_traits.select(
        "hap_idx", "haplotype", "sample_idx",
        F.explode(F.array(
            F.struct(F.lit("continuous").alias("kind"), F.col("continuous").alias("value")),
            F.struct(F.lit("discrete").alias("kind"), F.col("discrete").alias("value")))).alias("t")
    ).select("hap_idx", "haplotype", "sample_idx", "t.kind", "t.value")
    return (long.where((F.col("kind") == "continuous") | (F.col("value") != ""))
            .groupBy("hap_idx", "haplotype", "kind", "value")
            .agg(F.min("sample_idx").alias("first_idx"), F.count(F.lit(1)).alias("n")))


def haplotype_summary(with_traits: DataFrame) -> DataFrame:
    """One row per haplotype: size, first sample and the number of distinct trait values."""
    values = haplotype_trait_values(with_traits)
    counted = values.groupBy("hap_idx").agg(
        F.count_if(F.col("kind") == "continuous").alias("continuous_values"),
        F.count_if(F.col("kind") == "discrete").alias("discrete_values"))
    sizes = with_traits.groupBy("hap_idx", "haplotype").agg(
        F.count(F.lit(1)).alias("total_quantity"), F.min("sample_idx").alias("first_idx"))
    return sizes.join(counted, "hap_idx")
