"""Variant tables: VCF scan and sink, genotype decoding, alignment <-> variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.functions.sequence import cells, single_line
from sitewise.operators.scan import numbered, running
from sitewise.schema import IUPAC_PAIRS
from sitewise.sources.lines import ordered_text, write_lines
from sitewise.storage import cut

META_KEY = "##SampleMetadata="
# columns before the first sample
FIXED = 9
# samples of a record that are sorted and joined at once
CELLS = 4096
# alleles of a record up to which the calls of all pairs are worked out in advance
PAIRED = 4


def read_vcf(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(variants, genotypes, violations)`` of VCF text (gzip is read as well).

    ``record`` ties genotypes to their variant, as a position may have several records. Rows that
    break a rule are listed in ``violations(code, ref)`` and kept out of the variants; a file
    without sample columns or without records is listed as well.
    """
    lines = ordered_text(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    header = lines.where(F.col("value").startswith("#CHROM"))
    title = header.agg(F.min_by("value", "row").alias("value"))
    names = title.select(F.posexplode(F.split("value", "\t")).alias("at", "sample")).where(f"at >= {FIXED}").select(
        (F.col("at") - FIXED).cast("bigint").alias("sample_idx"), "sample")
    fields = F.length("value") - F.length(F.translate("value", "\t", "")) + 1
    # the genotypes of a record stay one text until they are rows, which are dealt to tasks by sample
    data = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "row", F.split("value", "\t", FIXED + 1).alias("c"), fields.alias("__fields")).withColumn("__width", title.select(fields).scalar())
    def field(i: int) -> Column:
        return F.get("c", F.lit(i))
    parsed = data.select(
        "row", field(0).alias("chrom"), field(1).try_cast("bigint").alias("pos"), field(2).alias("id"),
        F.upper(field(3)).alias("ref"), F.split(F.upper(field(4)), ",").alias("alts"), field(5).alias("qual"),
        field(6).alias("filter"), field(7).alias("info"), F.split(field(8), ":").alias("format"), field(FIXED).alias("__rest"), "__fields", "__width")
    blank = (F.col("ref") == "") | (F.col("ref") == ".") | F.exists("alts", lambda a: (a == "") | (a == "."))
    symbolic = F.exists("alts", lambda a: (a == "*") | a.startswith("<") | a.contains("[") | a.contains("]"))
    code = (F.when(F.col("__fields") < F.col("__width"), "incomplete_record")
            .when(F.col("pos").isNull(), "invalid_position").when(F.col("pos") < 1, "position_not_positive")
            .when(blank, "empty_allele").when(symbolic, "symbolic_allele"))
    parsed = parsed.withColumn("code", code)
    variants = parsed.where("code IS NULL")
    ref = F.col("row").cast("string").alias("ref")
    doubled = header.select(F.explode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("s")).groupBy("s").count().where("count > 1")
    contigs = parsed.agg(F.count_distinct("chrom").alias("n")).where("n > 1")
    wide = lines.agg(F.coalesce(F.max(F.when(F.col("value").startswith("#CHROM"), F.size(F.split("value", "\t")))), F.lit(0)).alias("n"))
    bare = wide.where("n < 10").select(F.lit("no_samples").alias("code"), F.col("n").cast("string").alias("ref"))
    void = data.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no_records").alias("code"), F.lit("0").alias("ref"))
    violations = (parsed.where("code IS NOT NULL").select("code", ref).unionByName(bare).unionByName(void)
                  .unionByName(doubled.select(F.lit("duplicate_sample").alias("code"), F.col("s").alias("ref")))
                  .unionByName(contigs.select(F.lit("several_contigs").alias("code"), F.col("n").cast("string").alias("ref"))))
    record = F.col("row").alias("record")
    calls = variants.select(record, "chrom", "pos", "__width", F.posexplode(F.split("__rest", "\t")).alias("sample_idx", "field")).where(
        "sample_idx < __width").select("record", "chrom", "pos", F.col("sample_idx").cast("bigint").alias("sample_idx"), "field")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to decode
    genotypes = calls.repartition(tasks, "sample_idx").join(names, "sample_idx", "left").select(
        "record", "chrom", "pos", "sample_idx", "sample", "field")
    return variants.withColumnRenamed("row", "record").drop("__rest", "__fields", "__width", "code"), genotypes, violations


def genotype_allele(field: Column, format_keys: Column, ref: Column, alts: Column) -> Column:
    """Called sequence of one genotype field; NULL for an invalid genotype.

    Missing calls give N over the widest allele, equal alleles give the allele, mixed single
    bases their ambiguity code, anything else N over the widest called allele.
    """
    return _called(_gt(field, F.array_position(format_keys, "GT")), F.concat(F.array(ref), alts))


def _gt(field: Column, at: Column) -> Column:
    part = F.when(F.contains(field, F.lit(":")), F.get(F.split(field, ":"), (at - 1).cast("int"))).when(at == 1, field)
    return F.when(at > 0, F.coalesce(part, F.lit(".")))


def _called(gt: Column, alleles: Column) -> Column:
    calls = F.split(gt, r"[/|]")
    chosen = F.transform(calls, lambda c: F.get(alleles, c.try_cast("int")))
    distinct = F.array_distinct(chosen)
    def width(xs: Column) -> Column:
        return F.array_max(F.transform(xs, lambda x: F.length(x)))
    codes = F.create_map(*[F.lit(x) for pair in IUPAC_PAIRS.items() for x in pair])
    single = F.forall(chosen, lambda a: a.isin("A", "C", "G", "T"))
    return (F.when(F.exists(calls, lambda c: (c == "") | (c == ".")), F.repeat(F.lit("N"), width(alleles)))
            .when(F.exists(chosen, lambda a: a.isNull()), F.lit(None).cast("string"))
            .when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))
            .when(single, F.coalesce(F.try_element_at(codes, F.array_join(F.array_sort(distinct), "")), F.lit("N")))
            .otherwise(F.repeat(F.lit("N"), width(chosen))))


def _usual_calls(alleles: Column) -> Column:
    """Map of the usual genotypes of a record to what they call: one allele or none and, of up to PAIRED alleles, pairs."""
    one = F.transform(F.sequence(F.lit(0), F.size(alleles) - 1), lambda i: i.cast("string"))
    two = F.flatten(F.transform(one, lambda x: F.flatten(F.transform(one, lambda y: F.array(F.concat(x, F.lit("/"), y), F.concat(x, F.lit("|"), y))))))
    pairs = F.when(F.size(alleles) <= PAIRED, two).otherwise(F.array().cast("array<string>"))
    keys = F.concat(one, F.array(*[F.lit(x) for x in (".", "./.", ".|.")]), pairs)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _called(k, alleles)))


def decode_genotypes(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    """``genotypes`` with ``allele``; records are told apart by ``record`` where both tables have it.

    What the usual genotypes call is worked out once for a record; others are decoded one by one.
    """
    key = ["record"] if "record" in genotypes.columns and "record" in variants.columns else ["chrom", "pos"]
    alleles = F.concat(F.array("ref"), F.col("alts"))
    records = variants.select(*key, "ref", "alts", "format", F.array_position("format", F.lit("GT")).alias("__at"), _usual_calls(alleles).alias("__usual"))
    joined = genotypes.join(records, key).withColumn("__gt", _gt(F.col("field"), F.col("__at")))
    return joined.withColumn("allele", F.coalesce(F.try_element_at("__usual", F.col("__gt")), _called(F.col("__gt"), alleles))).drop("__at", "__usual", "__gt")


def overlapping_variants(variants: DataFrame) -> DataFrame:
    """Variants that start before the previous one ends (per contig)."""
    w = Window.partitionBy("chrom").orderBy("pos")
    end = F.lag(F.col("pos") + F.length("ref")).over(w)
    return variants.withColumn("__end", end).where("pos < __end").select("chrom", "pos", "ref")


def reference_mismatches(variants: DataFrame, reference: str) -> DataFrame:
    """Variants whose REF differs from, or runs past, the reference sequence."""
    seen = F.substring(F.lit(reference.upper().replace("-", "")), F.col("pos").cast("int"), F.length("ref"))
    return variants.withColumn("observed", seen).where("observed <> ref").select("chrom", "pos", "ref", "observed")


def vcf_to_alignment(variants: DataFrame, genotypes: DataFrame, reference: str | None = None) -> DataFrame:
    """Aligned sequences: called alleles padded to equal width, and the reference in between.

    Raises on overlapping records, on records that disagree with the reference and, when the
    result is computed, on invalid genotypes.
    """
    # read from text, a record's few bytes count as its whole line, and the joins with it would be by record, not broadcast
    variants = cut(variants.select(*[c for c in ("record", "chrom", "pos", "ref", "alts", "format") if c in variants.columns]), "variants")
    if not overlapping_variants(variants).isEmpty():
        raise ValueError("overlapping variants cannot be turned into an alignment")
    width = F.array_max(F.transform(F.concat(F.array("ref"), F.col("alts")), lambda a: F.length(a)))
    blocks = variants.select("chrom", "pos", F.length("ref").alias("span"), width.alias("width"))
    tail: Column = F.lit("")
    before: Column = F.lit("")
    if reference is not None:
        whole = reference.upper().replace("-", "")
        if not reference_mismatches(variants, whole).isEmpty():
            raise ValueError("variants disagree with the reference sequence")
        prev = F.coalesce(F.lag(F.col("pos") + F.col("span")).over(Window.partitionBy("chrom").orderBy("pos")), F.lit(1))
        blocks = blocks.withColumn("before", F.substring(F.lit(whole), prev.cast("int"), (F.col("pos") - prev).cast("int")))
        before = F.col("before")
        last = blocks.agg(F.max(F.col("pos") + F.col("span"))).scalar()
        tail = F.substring(F.lit(whole), F.col("__last").cast("int"), F.lit(len(whole)))
    invalid = F.raise_error(F.concat(F.lit("invalid genotype of "), "sample", F.lit(" at "), F.col("pos").cast("string")))
    called = (decode_genotypes(genotypes, variants).join(blocks, ["chrom", "pos"])
              .withColumn("allele", F.when(F.col("allele").isNull(), invalid).otherwise(F.col("allele"))))
    piece = F.concat(before, F.rpad("allele", F.col("width"), F.lit("-")))
    out = called.groupBy("sample_idx", "sample").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "").alias("sequence"))
    if reference is None:
        return out
    return out.withColumn("__last", last).withColumn("sequence", F.concat("sequence", tail)).drop("__last")


def variable_runs(sites: DataFrame) -> DataFrame:
    """Maximal runs of adjacent variable sites: start, stop (exclusive)."""
    placed = numbered(sites.select("pos"), ["pos"], "place")
    return (placed.select("pos", (F.col("pos") - F.col("place")).alias("island")).groupBy("island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).select("start", "stop"))


def merge_intervals(blocks: DataFrame) -> DataFrame:
    """Overlapping half-open intervals merged (touching ones stay apart).

    Two prefix scans over ranges of starts: the furthest stop so far, then the number of gaps.
    """
    order = ["start", "stop", "__id"]  # equal empty intervals stay apart
    reached = running(blocks.select("start", "stop", F.monotonically_increasing_id().alias("__id")), order, {"reach": ("max", F.col("stop"))}, before=True)
    gap = F.col("reach").isNull() | (F.col("start") >= F.col("reach"))
    return (running(reached, order, {"__g": ("sum", gap.cast("bigint"))}).groupBy("__g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__g"))


def ungapped_coordinates(reference_cells: DataFrame) -> DataFrame:
    """Per site: number of reference bases before it, plus one."""
    counted = running(reference_cells.select("pos", "base"), ["pos"], {"bases": ("sum", (F.col("base") != "-").cast("bigint"))}, before=True)
    return counted.select("pos", (F.coalesce("bases", F.lit(0)) + 1).alias("coordinate"))


def _block_alleles(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    packed = blocks.agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).scalar()
    return (samples.select("sample_idx", "sample", F.upper("sequence").cast("binary").alias("s")).withColumn("__b", packed)
            .select("sample_idx", "sample", "s", F.explode("__b").alias("b"))
            .select("sample_idx", "sample", "b.start", "b.stop",
                    F.translate(F.substring("s", F.col("b.start"), F.col("b.stop") - F.col("b.start")).cast("string"), "-", "").alias("allele")))


def alignment_to_variants(samples: DataFrame, reference: str | None = None, chrom: str = "alignment"
                          ) -> tuple[DataFrame, DataFrame]:
    """``(variants, genotypes)`` called from an alignment against a reference sample.

    Runs of variable sites become blocks; a block in which some sample has only gaps is anchored
    to the previous (else the next) reference base, and overlapping blocks are merged. Site and
    block tables have at most one row per site; only allele lookups touch the samples.
    """
    ref_rows = samples.where(F.col("sample") == reference) if reference is not None else samples
    ref_seq = ref_rows.agg(F.min_by(F.struct("sample_idx", F.upper("sequence").alias("sequence")), "sample_idx").alias("r")).first()["r"]
    if ref_seq is None:
        raise ValueError(f"reference sequence not found: {reference}")
    one = samples.sparkSession.createDataFrame([(ref_seq["sample_idx"], ref_seq["sequence"])], "sample_idx bigint, sequence string")
    ref_cells = cut(cells(one, normalise=False), "reference-cells")
    per_symbol = cells(samples, normalise=False).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    variable = per_symbol.groupBy("pos").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("pos")
    runs = cut(variable_runs(variable), "variable-runs")
    if runs.isEmpty():
        raise ValueError("the alignment contains no variable sites")
    gap_only = _block_alleles(samples, runs).groupBy("start", "stop").agg(F.bool_or(F.col("allele") == "").alias("gap_only"))
    bases = ref_cells.where("base <> '-'").select("pos")
    def near(key: str, kinds: tuple[int, int], forward: bool) -> DataFrame:
        points = bases.select("pos", F.lit(kinds[0]).alias("kind"), F.lit(None).cast("bigint").alias("start")).unionByName(
            gap_only.select(F.col(key).alias("pos"), F.lit(kinds[1]).alias("kind"), "start"))
        # looking forward is looking back along the negated order
        way = -1 if forward else 1
        points = points.select("pos", "start", (way * F.col("pos")).alias("at"), (way * F.col("kind")).alias("turn"))
        base = F.when(F.col("start").isNull(), F.col("pos"))
        found = running(points, ["at", "turn", "start"], {"near": ("min" if forward else "max", base)}, before=True)
        return found.where("start IS NOT NULL").select("start", F.col("near").alias(key + "_near"))
    # bases strictly before the start, and bases from the stop on
    anchored = (gap_only.join(near("start", (1, 0), False), "start").join(near("stop", (1, 0), True), "start")
                .withColumn("from", F.when(F.col("gap_only"), F.coalesce("start_near", "start")).otherwise(F.col("start")))
                .withColumn("to", F.when(F.col("gap_only") & F.col("start_near").isNull(), F.col("stop_near") + 1).otherwise(F.col("stop")))
                .select(F.col("from").alias("start"), F.col("to").alias("stop")))
    blocks = cut(merge_intervals(anchored), "variant-blocks")
    called = cut(_block_alleles(samples, blocks).withColumn("allele", F.translate("allele", "U", "T")), "variant-alleles")
    ref_allele = called.where(F.col("sample_idx") == ref_seq["sample_idx"]).select("start", F.col("allele").alias("ref"))
    seen = (called.groupBy("start", "allele").agg(F.min("sample_idx").alias("first")).join(ref_allele, "start"))
    order = Window.partitionBy("start").orderBy((F.col("allele") != F.col("ref")).cast("int"), "first")
    index = cut(seen.withColumn("gt", F.row_number().over(order) - 1), "allele-index")
    alts = index.where("gt > 0").groupBy("start", "ref").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gt", "allele"))), lambda x: x["allele"]).alias("alts"))
    n = samples.agg(F.count(F.lit(1))).scalar()
    snp = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    variants = (alts.join(ungapped_coordinates(ref_cells).withColumnRenamed("pos", "start"), "start")
                .withColumn("ns", n)
                .select(F.lit(chrom).alias("chrom"), F.col("coordinate").alias("pos"), "start", "ref", "alts",
                        F.concat(F.lit("NS="), F.col("ns").cast("string"), F.lit(";TYPE="), F.when(snp, "SNP").otherwise("COMPLEX")).alias("info")))
    genotypes = (called.join(index.select("start", "allele", "gt"), ["start", "allele"])
                 .join(variants.select("chrom", "pos", "start"), "start")
                 .select("chrom", "pos", "sample_idx", "sample", F.col("gt").cast("string").alias("field")))
    return variants.drop("start").withColumn("format", F.array(F.lit("GT"))), genotypes


def subset_variants(genotypes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Genotypes of ``wanted(sample, alias)``, renamed; the records are kept."""
    twice = wanted.groupBy("sample").count().where("count > 1").unionByName(wanted.groupBy(F.col("alias").alias("sample")).count().where("count > 1"))
    if not twice.isEmpty():
        raise ValueError("selected sample names or aliases contain duplicates")
    if not wanted.join(genotypes.select("sample").distinct(), "sample", "left_anti").isEmpty():
        raise ValueError("selected samples were not found in the variants")
    return genotypes.join(wanted, "sample").withColumn("sample", F.col("alias")).drop("alias")


def read_vcf_text(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(header, titles, records)`` of VCF text with nothing decoded, for sinks that keep records as read.

    ``header(row, value)`` holds the ``##`` and other comment lines, ``titles(row, columns)`` the
    ``#CHROM`` line and ``records(row, columns)`` the data; ``row`` is the place in the file. Line
    ends of other systems, blank lines and a byte order mark are dropped.
    """
    value = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\ufeff", "")
    lines = ordered_text(spark, path).select("row", value.alias("value")).where("value <> ''")
    comment, title = F.col("value").startswith("#"), F.col("value").startswith("#CHROM")
    columns = F.split("value", "\t").alias("columns")
    return (lines.where(comment & ~title), lines.where(title).select("row", columns),
            lines.where(~comment).select("row", columns))


def _chosen_columns(titles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sample columns of ``wanted``: at (0-based), sample, alias; the name itself where an alias is null."""
    names = titles.select(F.posexplode("columns").alias("at", "sample")).where(f"at >= {FIXED}")
    return names.join(wanted.select("sample", "alias"), "sample").select("at", "sample", F.coalesce("alias", "sample").alias("alias"))


def subset_issues(spark: SparkSession, path: str | list[str], wanted: DataFrame) -> DataFrame:
    """Why ``subset_vcf`` would refuse: code, ref. ``column_count`` names the row, counted from 0."""
    _, titles, records = read_vcf_text(spark, path)
    def many(df: DataFrame, code: str, column: str) -> DataFrame:
        return df.groupBy(column).count().where("count > 1").select(F.lit(code).alias("code"), F.col(column).alias("ref"))
    def facts(df: DataFrame, code: str, rule: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).where(rule).select(F.lit(code).alias("code"), F.col("n").cast("string").alias("ref"))
    width = titles.agg(F.min(F.size("columns"))).scalar()
    names = titles.select(F.explode("columns").alias("sample"))
    lost = wanted.select("sample").distinct().join(
        titles.select(F.explode(F.slice("columns", FIXED + 1, 1 << 30)).alias("sample")), "sample", "left_anti")
    return (facts(wanted, "nothing_selected", "n = 0")
            .unionByName(many(wanted, "sample_selected_twice", "sample"))
            .unionByName(facts(titles, "no_title", "n = 0")).unionByName(facts(titles, "several_titles", "n > 1"))
            .unionByName(facts(names, "no_samples", f"n BETWEEN 1 AND {FIXED}"))
            .unionByName(records.withColumn("__w", width).where(F.size("columns") != F.col("__w")).select(
                F.lit("column_count").alias("code"), F.col("row").cast("string").alias("ref")))
            .unionByName(lost.select(F.lit("sample_not_found").alias("code"), F.col("sample").alias("ref")))
            .unionByName(many(_chosen_columns(titles, wanted), "alias_used_twice", "alias")))


def subset_vcf(spark: SparkSession, src: str, dst: str, wanted: DataFrame) -> None:
    """Write the sample columns ``wanted(sample, alias)`` of a VCF file under their aliases.

    Comment lines, the nine fixed columns and the order of lines and columns stay as read, so IDs,
    qualities, filters, INFO and positions with several records survive. The whole source is
    checked before anything is written; the first issues are raised. ``wanted`` may be given in any
    order; extra columns are ignored.
    """
    issues = subset_issues(spark, src, wanted).limit(10).collect()
    if issues:
        raise ValueError("VCF subset: " + ", ".join(f"{r['code']} {r['ref']}" for r in issues))
    header, titles, records = read_vcf_text(spark, src)
    chosen = _chosen_columns(titles, wanted).agg(F.array_sort(F.collect_list(F.struct("at", "alias"))).alias("chosen")).scalar()
    fixed = F.slice("columns", 1, FIXED)
    renamed = titles.withColumn("__k", chosen).select("row", F.concat(fixed, F.col("__k.alias")).alias("columns"))
    kept = records.withColumn("__k", chosen).select("row", F.concat(fixed, F.transform(
        "__k", lambda k: F.get("columns", k["at"]))).alias("columns"))
    lines = renamed.unionByName(kept).select("row", F.array_join("columns", "\t").alias("value"))
    write_lines(header.unionByName(lines), dst, ["row"])


def _side_by_side(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """``key..., cells``: ``column`` of all samples in one tab-separated text, nulls left out.

    Samples are sorted and joined in ranges of CELLS first, so that only texts of ranges meet in a record.
    """
    def joined(group: DataFrame, order: str, value: str, out: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\t")
        return group.agg(F.when(F.count(value) > 0, text).alias(out))
    ranges = joined(rows.groupBy(*key, F.floor(F.col("sample_idx") / CELLS).alias("__range")), "sample_idx", column, "__cells")
    whole = joined(ranges.groupBy(*key), "__range", "__cells", "cells")
    return whole.withColumn("cells", F.coalesce("cells", F.lit("")))


def write_vcf(variants: DataFrame, genotypes: DataFrame, path: str, reference_length: int | None = None,
              metadata: DataFrame | None = None) -> None:
    """VCF text. One line holds all genotypes of a record, as the format requires.

    ``metadata(sample_idx, sample, discrete, continuous)`` adds one JSON header line per sample.
    """
    names = genotypes.select("sample_idx", F.regexp_replace(F.trim(single_line(F.col("sample"))), r"\s+", "_").alias("sample")).distinct()
    spark = variants.sparkSession
    contig = variants.select("chrom").distinct().select(
        F.lit(0).alias("part"), F.lit(2).cast("bigint").alias("ord"),
        F.concat(F.lit("##contig=<ID="), "chrom", F.lit(f",length={reference_length}>" if reference_length else ">")).alias("value"))
    head = spark.createDataFrame([(0, 0, "##fileformat=VCFv4.2"), (0, 1, "##source=sitewise"),
                                  (0, 3, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Haploid genotype">')],
                                 "part int, ord bigint, value string")
    columns = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".replace(" ", "\t")
    title = _side_by_side(names, [], "sample").select(
        F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.concat(F.lit(columns + "\t"), "cells").alias("value"))
    key = ["record"] if "record" in genotypes.columns and "record" in variants.columns else ["chrom", "pos"]
    fields = _side_by_side(genotypes, key, "field")
    def kept(column: str, default: str) -> Column:
        return F.coalesce(column, F.lit(default)) if column in variants.columns else F.lit(default)
    # records that were read keep their order
    rows = variants.join(fields, key).select(F.lit(3).alias("part"), F.col(key[-1]).alias("ord"), F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), kept("id", "."), "ref", F.array_join("alts", ","), kept("qual", "."), kept("filter", "PASS"), "info",
        F.array_join("format", ":"), "cells").alias("value"))
    out = head.unionByName(contig).unionByName(title).unionByName(rows)
    if metadata is not None:
        out = out.unionByName(metadata.select(F.lit(1).alias("part"), F.col("sample_idx").alias("ord"), F.concat(
            F.lit(META_KEY), F.to_json(F.struct("sample", F.col("discrete").alias("discrete_trait"), F.col("continuous").alias("continuous_trait")))).alias("value")))
    write_lines(out, path, ["part", "ord"])
