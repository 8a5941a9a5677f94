"""Column expressions on sequences, sites and sample sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.schema import AMBIGUITY, CALLABLE, GAP, UNKNOWN

EULER_GAMMA = 0.5772156649015329
ZETA_2 = 1.6449340668482264
EXACT_TERMS = 1000


def r9(col: Column) -> Column:
    """Nine decimals, with negative zero folded into zero."""
    return F.round(col, 9) + F.lit(0.0)


def clean_name(col: Column) -> Column:
    """Commas and equal signs to ``_``, quotes dropped, whitespace runs to ``_``."""
    unquoted = F.translate(col, ",=\"'", "__")
    return F.regexp_replace(F.regexp_replace(unquoted, r"^\s+|\s+$", ""), r"\s+", "_")


def single_line(col: Column) -> Column:
    return F.translate(col, "\r\n", "__")


def as_dna(col: Column) -> Column:
    """Upper case, RNA ``U`` read as ``T``."""
    return F.translate(F.upper(col), "U", "T")


def is_callable(base: Column) -> Column:
    return base.isin(*CALLABLE)


def classify_base(base: Column) -> Column:
    return (F.when(base.isin(*CALLABLE), "callable")
            .when(base == GAP, "gap")
            .when(base.isin(*UNKNOWN), "unknown")
            .when(base.isin(*AMBIGUITY), "ambiguity")
            .otherwise("unsupported"))


def count_symbols(sequence: Column, symbols: str) -> Column:
    """Number of characters of ``sequence`` that belong to ``symbols``; no explode needed."""
    return (F.length(sequence) - F.length(F.translate(sequence, symbols, ""))).cast("bigint")


def cells(samples: DataFrame, *keep: str, normalise: bool = True) -> DataFrame:
    """One row per sample and site. The explode streams into whatever aggregates it."""
    sequence = as_dna(F.col("sequence")) if normalise else F.upper(F.col("sequence"))
    return (samples.select(*keep, F.posexplode(F.split(sequence, "")).alias("__p", "base"))
            .where(F.col("base") != "")
            .withColumn("pos", (F.col("__p") + 1).cast("bigint")).drop("__p"))


def site_runs(sites: DataFrame) -> Column:
    """Kept positions as an array of contiguous runs; length bounded by the alignment.

    ``sites`` has one row per kept ``pos``. The result is a scalar subquery, so the site
    list is computed once by Spark and never visits the Python driver.
    """
    ordered = Window.orderBy("pos")
    runs = (sites.select("pos", (F.col("pos") - F.row_number().over(ordered)).alias("island"))
            .groupBy("island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("len")))
    packed = runs.agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("len").cast("int").alias("len")
    ))).alias("runs"))
    return packed.scalar()


def take_sites(sequence: Column, runs: Column) -> Column:
    """The sequence reduced to the given runs of sites.

    Runs are cut from the binary form: binary substring is constant time per run, string
    substring walks the string from its start. Sequence and runs enter as one-element arrays,
    so that both are evaluated once per row and not once per run.
    """
    cut = F.zip_with(
        F.array(sequence.cast("binary")), F.array(runs),
        lambda s, rs: F.array_join(F.transform(
            rs, lambda r: F.substring(s, r["start"], r["len"]).cast("string")), ""))
    return F.element_at(cut, 1)


def harmonic(n: Column, power: int = 1) -> Column:
    """Sum of 1/i**power for i in 1..n-1 (power 1 or 2); NULL below two samples.

    Exact up to EXACT_TERMS terms; beyond that the Euler-Maclaurin tail, whose error is
    below double precision there, so a huge sample never builds a huge array.
    """
    m = (n - 1).cast("double")
    terms = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n - 1, F.lit(EXACT_TERMS))).cast("int"))
    exact = F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.pow(i, F.lit(power)))
    if power == 1:
        tail = (F.log(m) + EULER_GAMMA + 1.0 / (2.0 * m) - 1.0 / (12.0 * m * m)
                + 1.0 / (120.0 * F.pow(m, F.lit(4))))
    else:
        tail = (F.lit(ZETA_2) - 1.0 / m + 1.0 / (2.0 * m * m) - 1.0 / (6.0 * F.pow(m, F.lit(3)))
                + 1.0 / (30.0 * F.pow(m, F.lit(5))))
    return F.when(n < 2, None).when(n - 1 <= EXACT_TERMS, exact).otherwise(tail)


def tajima_d(n: Column, segregating: Column, k: Column) -> Column:
    """Tajima's D; NULL below two samples, without segregating sites or variance."""
    nd = n.cast("double")
    s = segregating.cast("double")
    a1, a2 = harmonic(n, 1), harmonic(n, 2)
    c1 = (nd + 1.0) / (3.0 * (nd - 1.0)) - 1.0 / a1
    c2 = (2.0 * (nd * nd + nd + 3.0) / (9.0 * nd * (nd - 1.0))
          - (nd + 2.0) / (a1 * nd) + a2 / (a1 * a1))
    variance = c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1.0)
    usable = (n >= 2) & (segregating > 0)
    return F.when(usable, F.when(variance > 0, (k - s / a1) / F.sqrt(variance)))
