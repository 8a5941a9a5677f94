"""Format dispatch, conversion and multi-file result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.sequence import single_line
from sitewise.operators import haplotypes as hp
from sitewise.functions.transforms import is_meaningful
from sitewise.sources import sequences as sq
from sitewise.sources import tables as tb
from sitewise.sources import vcf
from sitewise.storage import cut


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None, reference: str | None = None) -> DataFrame:
    """Samples from any supported format; ``fmt`` defaults to the file extension."""
    fmt = fmt or sq.detect_format(path)
    if fmt == "fasta":
        return sq.read_fasta(spark, path)
    if fmt == "phylip":
        return sq.read_phylip(spark, path)
    if fmt == "nexus":
        return sq.read_nexus(spark, path)
    if fmt == "vcf":
        variants, genotypes, violations = vcf.read_vcf(spark, path)
        if not violations.isEmpty():
            raise ValueError("the VCF breaks a rule; see read_vcf")
        return vcf.vcf_to_alignment(variants, genotypes, reference)
    raise ValueError(f"unsupported input format {fmt!r}")


def write_sequences(samples: DataFrame, path: str, fmt: str, reference_name: str | None = None) -> None:
    if fmt == "fasta":
        sq.write_fasta(samples, path)
    elif fmt == "phylip":
        sq.write_phylip(samples, path)
    elif fmt == "nexus":
        sq.write_nexus(samples, path)
    elif fmt == "vcf":
        vcf.write_vcf(*vcf.alignment_to_variants(samples, reference_name), path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}")


def convert(spark: SparkSession, src: str, dst: str, fmt: str, source_fmt: str | None = None,
            reference: str | None = None, reference_name: str | None = None) -> None:
    """Any source format to any different sink format."""
    source_fmt = source_fmt or sq.detect_format(src)
    if source_fmt == fmt:
        raise ValueError("input and output formats must be different")
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError("input and output paths must be different")
    write_sequences(cut(read_sequences(spark, src, source_fmt, reference), "converted"), dst, fmt, reference_name)


def export_variants(samples: DataFrame, path: str, metadata_path: str) -> None:
    """VCF with one JSON header line per sample, and the paired metadata table."""
    variants, genotypes = vcf.alignment_to_variants(samples)
    traits = samples.select("sample_idx", "sample", "discrete", "continuous")
    vcf.write_vcf(variants, genotypes, path, metadata=traits)
    traits.orderBy("sample_idx").select(
        "sample", F.col("discrete").alias("discrete_trait"), F.col("continuous").alias("continuous_trait")).write.csv(
        metadata_path, header=True, emptyValue="")


def write_haplotype_outputs(samples: DataFrame, traits: DataFrame, prefix: str) -> list[str]:
    """The result tables of a haplotype run under ``prefix``.

    Member and trait lists of a haplotype stay in long form (``_hap_values``, ``_hap_samples``),
    because one haplotype may own a third of all samples.
    """
    haplotypes, assignments = hp.identify_haplotypes(samples)
    haplotypes, assignments = cut(haplotypes, "haplotypes"), cut(assignments, "assignments")
    with_traits = cut(hp.haplotype_traits(assignments, traits), "haplotype-traits")
    sq.write_fasta(samples, f"{prefix}_seq.fasta")
    sq.write_phylip(samples, f"{prefix}_seq.phy")
    sq.write_fasta(haplotypes.select(F.col("hap_idx").alias("sample_idx"), F.col("haplotype").alias("sample"), "sequence"), f"{prefix}_hap.fasta")
    rows = with_traits.orderBy("sample_idx")
    rows.select(F.col("sample").alias("sequence_name"), "haplotype", F.col("continuous").alias("continuous_traits"),
                F.col("discrete").alias("discrete_traits")).write.csv(f"{prefix}_seq.meta.csv", header=True, emptyValue="")
    rows.select(F.col("sample").alias("name"), F.lit(1).alias("quantity"), F.col("continuous").alias("continuous_traits"),
                F.col("discrete").alias("discrete_traits")).write.csv(f"{prefix}_seq_trait.csv", header=True, emptyValue="")
    hp.haplotype_summary(with_traits).orderBy("hap_idx").select(
        "haplotype", "total_quantity", "continuous_values", "discrete_values").write.csv(f"{prefix}_hap_trait.csv", header=True)
    hp.haplotype_trait_values(with_traits).orderBy(
        "hap_idx", "kind", F.when(F.col("kind") == "continuous", F.col("first_idx")), "value").select(
        "haplotype", "kind", "value", "n").write.csv(f"{prefix}_hap_values.csv", header=True, emptyValue="")
    with_traits.orderBy("hap_idx", "sample_idx").select("haplotype", "sample").write.csv(f"{prefix}_hap_samples.csv", header=True)
    written = ["_seq.fasta", "_seq.phy", "_hap.fasta", "_seq.meta.csv", "_seq_trait.csv", "_hap_trait.csv", "_hap_values.csv", "_hap_samples.csv"]
    if with_traits.agg(F.bool_or(is_meaningful(F.col("continuous")))).first()[0]:
        conf = with_traits.select("sample_idx", F.translate(single_line(F.col("sample")), ";", "_").alias("sample"), "continuous")
        tb.write_viewer_config(conf, ["sample", "continuous"], f"{prefix}_traitconf.csv", "sample_idx")
        written.append("_traitconf.csv")
    return written
