"""Sample tables: standardisation, validation, previews, metadata joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.transforms import is_meaningful, plain_number, text
from sitewise.schema import ALPHABETS, STANDARDISE_AMBIGUOUS
from sitewise.storage import dense_index


@dataclass(frozen=True)
class Split:
    delimiter: str
    index: int


@dataclass(frozen=True)
class Standardisation:
    remove_ambiguous: bool = False
    replace_from: str = ""
    replace_to: str = ""
    name: Split | None = None
    discrete: Split | None = None
    continuous: Split | None = None
    numbering: bool = False
    start_id: int = 1


def _piece(name: Column, rule: Split, current: Column) -> Column:
    parts = F.split(name, "\\Q" + rule.delimiter + "\\E", -1)
    return F.when(F.size(parts) > rule.index, F.trim(F.get(parts, F.lit(rule.index)))).otherwise(current)


def standardize(samples: DataFrame, rules: Standardisation) -> DataFrame:
    """Drop ambiguous sequences, re-issue ids, rewrite and split names (sample, discrete, continuous)."""
    out = samples
    if rules.remove_ambiguous:
        out = out.where(~F.upper("sequence").rlike(f"[{STANDARDISE_AMBIGUOUS}]"))
    out = dense_index(out, "sample_idx", "__rank").withColumn("id", F.col("__rank") + rules.start_id - 1).drop("__rank")
    if rules.replace_from:
        out = out.withColumn("sample", F.replace("sample", F.lit(rules.replace_from), F.lit(rules.replace_to)))
    out = out.withColumn("__original", F.col("sample"))
    for column, rule in (("sample", rules.name), ("discrete", rules.discrete), ("continuous", rules.continuous)):
        if rule is not None and rule.delimiter:
            out = out.withColumn(column, _piece(F.col("__original"), rule, F.col(column)))
    if rules.numbering:
        out = out.withColumn("sample", F.col("id").cast("string"))
    return out.drop("__original")


def selected(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("selected"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_samples(samples: DataFrame) -> DataFrame:
    """One issue per offending sample (the first that applies) and one per duplicated name."""
    name, sequence = text(F.col("sample")), text(F.col("sequence"))
    code = (F.when(name == "", "empty_name").when(name.rlike(r"\s"), "invalid_name_whitespace")
            .when(sequence == "", "empty_sequence")
            .when(plain_number(F.col("continuous")).isNull(), "invalid_continuous"))
    own = samples.select("sample_idx", F.col("sample").alias("ref"), code.alias("code")).where("code IS NOT NULL")
    twice = (samples.select(name.alias("ref")).groupBy("ref").count().where("count > 1")
             .select(F.lit(None).cast("bigint").alias("sample_idx"), "ref", F.lit("duplicate_names").alias("code")))
    return own.unionByName(twice)


def first_issue(issues: DataFrame) -> DataFrame:
    """The issue of the earliest sample; duplicate names are looked at last."""
    best = F.min_by(F.struct("sample_idx", "ref", "code"),
                    F.struct(F.col("sample_idx").isNull(), "sample_idx", "ref"))
    return issues.agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


def validate_alignment(samples: DataFrame) -> DataFrame:
    """One row with the facts and a flag for each alignment rule."""
    length = F.length("sequence").cast("bigint")
    name = F.trim("sample")
    facts = samples.agg(F.count(F.lit(1)).alias("samples"), F.min(length).alias("min_length"),
                        F.max(length).alias("max_length"),
                        F.count_if(F.coalesce(name, F.lit("")) == "").alias("blank_names"))
    twice = samples.groupBy(name.alias("n")).count().where("count > 1").agg(F.count(F.lit(1))).scalar()
    return (facts.withColumn("duplicate_names", twice)
            .withColumn("aligned", F.coalesce(
                (F.col("samples") >= 1) & (F.col("min_length") > 0) & (F.col("min_length") == F.col("max_length"))
                & (F.col("blank_names") == 0) & (F.col("duplicate_names") == 0), F.lit(False))))


def symbol_violations(samples: DataFrame, alphabet: str) -> DataFrame:
    """Samples with symbols outside a named alphabet; the sorted distinct symbols of each."""
    seq = F.upper("sequence")
    if alphabet == "diversity":
        seq = F.translate(seq, "U", "T")
    rest = F.translate(seq, ALPHABETS[alphabet], "")
    return samples.select("sample_idx", "sample", rest.alias("__rest")).where("__rest <> ''").select(
        "sample_idx", "sample",
        F.array_join(F.array_sort(F.array_distinct(F.split("__rest", ""))), ",").alias("symbols"))


def trait_completeness(samples: DataFrame) -> DataFrame:
    return samples.agg(F.bool_or(text(F.col("discrete")) != "").alias("has_discrete"),
                       F.bool_or(is_meaningful(F.col("continuous"))).alias("has_continuous"))


def preview(samples: DataFrame, rows: int = 200, positions: int = 500) -> DataFrame:
    """First rows and positions of an alignment with the true totals (a display limit)."""
    total = samples.agg(F.count(F.lit(1))).scalar()
    width = samples.agg(F.max(F.length("sequence")).cast("bigint")).scalar()
    return (samples.orderBy("sample_idx").limit(rows)
            .select("sample_idx", "sample", F.substring("sequence", 1, positions).alias("sequence"))
            .withColumn("total_rows", total).withColumn("total_positions", width))


def name_differences(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """Names present on one side only: ``side, sample``."""
    left, right = samples.select("sample").distinct(), meta.select("sample").distinct()
    return (left.join(right, "sample", "left_anti").select(F.lit("loaded").alias("side"), "sample")
            .unionByName(right.join(left, "sample", "left_anti").select(F.lit("metadata").alias("side"), "sample")))


def attach_metadata(samples: DataFrame, meta: DataFrame, strict: bool = True) -> DataFrame:
    """Left join of metadata; ``strict`` raises when any name is missing on either side."""
    if strict:
        wrong = name_differences(samples, meta).limit(5).collect()  # named in the message
        if wrong:
            raise ValueError("sample names differ: " + ", ".join(f"{r['side']}:{r['sample']}" for r in wrong))
    return (samples.join(meta.select("sample", "discrete", "continuous"), "sample", "left")
            .withColumn("discrete", F.coalesce("discrete", F.lit("")))
            .withColumn("continuous", F.coalesce("continuous", F.lit("0"))))


def metadata_keys(meta: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(keyed, duplicates)``: metadata addressed by any of several key columns."""
    usable = F.filter(F.array_distinct(F.array(*[F.trim(k) for k in keys])), lambda k: (k != "") & (k != "*"))
    keyed = meta.withColumn("key", F.explode(usable))
    return keyed, duplicates(keyed, "key")


def join_any_key(df: DataFrame, meta: DataFrame, keys: list[str], name: str = "sample") -> DataFrame:
    keyed, _ = metadata_keys(meta, keys)
    return df.join(keyed.select(F.col("key").alias(name), *[F.col(c).alias(f"meta_{c}") for c in meta.columns]), name, "left")


def subset_metadata(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of six-column metadata for ``wanted(ord, sample, alias)``, renamed and in that order."""
    keyed, _ = metadata_keys(meta, ["sample", "accession"])
    return (wanted.withColumnRenamed("sample", "key")
            .join(keyed.drop("sample", "accession"), "key")
            .withColumn("sample", F.col("alias")).withColumn("accession", F.col("alias")).drop("key", "alias"))


def metadata_missing(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    keyed, _ = metadata_keys(meta, ["sample", "accession"])
    return wanted.select("sample").join(keyed.select(F.col("key").alias("sample")), "sample", "left_anti")


def merge_traits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Long trait tables merged: values of the later table win, its new traits are added."""
    tagged = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return tagged.groupBy("sample", "trait").agg(F.max_by("value", "__v").alias("value"))


def merge_definitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trait definitions ``trait, kind, ord``: existing ones are kept, new names are appended."""
    last = old.agg(F.coalesce(F.max("ord"), F.lit(0))).scalar()
    added = new.join(old.select("trait"), "trait", "left_anti")
    return old.unionByName(dense_index(added, "ord", "__k").withColumn("__last", last)
                           .select("trait", "kind", (F.col("__k") + F.col("__last")).alias("ord")))


def primary_traits(samples: DataFrame, group: str | None, value: str | None) -> DataFrame:
    """Mirror the group and the first visualised numeric trait of a trait map."""
    def pick(name: str | None) -> Column:
        return F.coalesce(F.try_element_at("traits", F.lit(name)), F.lit("")) if name else F.lit("")
    number = pick(value)
    return (samples.withColumn("discrete", pick(group))
            .withColumn("continuous", F.when(F.trim(number) == "", "0").otherwise(number)))


def to_long(wide: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return wide.unpivot(ids, names, "trait", "value")


def to_wide(long: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot("trait", names).agg(F.max("value"))


def snapshot_drift(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of a saved snapshot (row, fingerprint) that no longer match the current texts."""
    now = current.select("row", F.sha2("sequence", 256).alias("now"))
    both = now.join(saved.select("row", "fingerprint"), "row", "full_outer")
    code = (F.when(F.col("now").isNull(), "missing_row").when(F.col("fingerprint").isNull(), "extra_row")
            .when((F.col("fingerprint") != "") & (F.col("now") != F.col("fingerprint")), "content_differs"))
    return both.select("row", code.alias("code")).where("code IS NOT NULL")


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows (duplicates counted), with the two differences."""
    def missing(x: DataFrame, y: DataFrame) -> Column:
        return x.exceptAll(y).agg(F.count(F.lit(1))).scalar()
    return (a.sparkSession.range(1).select(missing(a, b).alias("only_left"), missing(b, a).alias("only_right"))
            .withColumn("unchanged", (F.col("only_left") == 0) & (F.col("only_right") == 0)))
