"""Sequence quality per sample, per site and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.sequence import as_dna, cells, count_symbols, is_callable
from sitewise.schema import AMBIGUITY, CALLABLE, COMPLETE, GAP, UNKNOWN, check_policy


def sample_quality(samples: DataFrame) -> DataFrame:
    """Counts and rates of non-callable, gap, unknown and ambiguity symbols.

    A map-only job: symbols are counted inside the string, nothing is exploded or shuffled.
    """
    seq = as_dna(F.col("sequence"))
    length = F.length(seq).cast("bigint")
    out = samples.select(
        "sample_idx", "sample", length.alias("length"),
        (length - count_symbols(seq, CALLABLE)).alias("missing_count"),
        count_symbols(seq, GAP).alias("gap_count"),
        count_symbols(seq, UNKNOWN).alias("unknown_count"),
        count_symbols(seq, AMBIGUITY).alias("ambiguity_count"))
    for name in ("missing", "gap", "unknown", "ambiguity"):
        out = out.withColumn(f"{name}_rate", F.col(f"{name}_count") / F.nullif("length", F.lit(0)))
    return out


def _sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")


def site_quality(samples: DataFrame, policy: str = COMPLETE) -> DataFrame:
    """Per site: symbol counts, alleles, effective, variable and parsimony-informative flags."""
    check_policy(policy)
    base, n = F.col("base"), F.col("n")
    per_symbol = cells(samples).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    called = is_callable(base)
    sites = per_symbol.groupBy("pos").agg(
        F.sum("n").cast("bigint").alias("sample_count"),
        _sum_if(called, n).alias("callable_count"),
        _sum_if(base == GAP, n).alias("gap_count"),
        _sum_if(base.isin(*UNKNOWN), n).alias("unknown_count"),
        _sum_if(base.isin(*AMBIGUITY), n).alias("ambiguity_count"),
        F.count_if(called).cast("bigint").alias("allele_count"),
        F.count_if(called & (n >= 2)).cast("bigint").alias("__shared"),
        F.array_join(F.sort_array(F.collect_list(F.when(
            called, F.concat(base, F.lit(":"), n.cast("string"))))), ";").alias("alleles"))
    effective = (F.col("callable_count") == F.col("sample_count") if policy == COMPLETE
                 else F.col("callable_count") >= 2)
    return (sites
            .withColumn("missing_count", F.col("sample_count") - F.col("callable_count"))
            .withColumn("missing_rate", F.col("missing_count") / F.col("sample_count"))
            .withColumn("effective", effective)
            .withColumn("variable", F.col("effective") & (F.col("allele_count") >= 2))
            .withColumn("parsimony_informative", F.col("variable") & (F.col("__shared") >= 2))
            .drop("__shared"))


def quality_report(samples: DataFrame, policy: str = COMPLETE) -> DataFrame:
    """Totals; all of them follow from the site table, so one pass over the data suffices."""
    sites = site_quality(samples, policy)
    total_cells = F.sum("sample_count")
    return sites.agg(
        F.max("sample_count").alias("sample_count"),
        F.count(F.lit(1)).alias("alignment_length"),
        F.sum("missing_count").cast("bigint").alias("total_missing_count"),
        (F.sum("missing_count") / total_cells).alias("total_missing_rate"),
        F.count_if(F.col("effective")).cast("bigint").alias("effective_site_count"),
        F.count_if(F.col("variable")).cast("bigint").alias("variable_site_count"),
        F.count_if(F.col("parsimony_informative")).cast("bigint")
        .alias("parsimony_informative_site_count"))


def top_missing_samples(samples: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` samples with the highest positive missing rate, with a tone per band."""
    rate = F.col("missing_rate")
    # positive rates sort first, so the filter can follow the top-k
    return (sample_quality(samples)
            .orderBy(rate.desc(), "sample_idx").limit(k).where(rate > 0)
            .select("sample_idx", "sample", "missing_rate",
                    F.when(rate < 0.05, "good").when(rate < 0.20, "warn").otherwise("bad")
                    .alias("tone")))


def sites_of_interest(samples: DataFrame, policy: str = COMPLETE, limit: int | None = None) -> DataFrame:
    """Sites with missing data or variation by position; ``limit`` shortens a report."""
    found = (site_quality(samples, policy)
             .where((F.col("missing_count") > 0) | F.col("variable")).orderBy("pos"))
    return found if limit is None else found.limit(limit)


def site_track(sites: DataFrame, length: Column, max_bins: int = 828) -> DataFrame:
    """Site table averaged into equal bins along the alignment."""
    bins = F.least(F.lit(max_bins), F.greatest(F.lit(40), length)).cast("bigint")
    slot = F.least(bins - 1, F.floor((F.col("pos") - 1) / length * bins)).cast("bigint")
    return (sites.withColumn("bin", slot).groupBy("bin").agg(
        F.count(F.lit(1)).alias("sites"),
        F.avg(F.col("variable").cast("double")).alias("variable_fraction"),
        F.avg(F.col("parsimony_informative").cast("double")).alias("informative_fraction"),
        F.avg("missing_rate").alias("missing_mean")))
