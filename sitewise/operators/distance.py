"""Pairwise distances of aligned sequences and their summaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from sitewise.functions.sequence import (
    as_dna, cells, count_symbols, site_runs, take_sites)
from sitewise.operators.diversity import grouped, overall_complete, site_counts
from sitewise.operators.haplotypes import collapse
from sitewise.operators.pairs import sequence_pairs
from sitewise.schema import ALPHABETS, CALLABLE
from sitewise.storage import cut, cut_counted

# cells that are packed at once, and SIDE x SIDE groups of places in which a cell meets its mirror
CELLS = 1 << 20
SIDE = 32


def distinct_sequences(samples: DataFrame) -> DataFrame:
    """Distinct sequences as ``idx, sequence, n``; every sample shares the distances of one."""
    dna = samples.select("sample_idx", as_dna(F.col("sequence")).alias("sequence"))
    first = collapse(dna).select(F.col("first_idx").alias("sample_idx"), "n")
    return dna.join(first, "sample_idx").select(
        F.col("sample_idx").alias("idx"), "sequence", "n")


def required_sites(length: int, min_sites: int, min_coverage: float) -> int:
    if min_sites < 1:
        raise ValueError("min_sites must be at least 1")
    if not 0.0 <= min_coverage <= 1.0:
        raise ValueError("min_coverage must be between 0 and 1")
    return max(min_sites, -int(-length * min_coverage // 1))


def p_distance(rows: DataFrame, min_sites: int = 1, min_coverage: float = 0.0) -> DataFrame:
    """p-distance of ``rows(idx, sequence)`` under pairwise deletion; NULL below the coverage.

    One row per pair ``i < j`` - the matrix itself is the result. Pass distinct sequences (see
    ``distinct_sequences``): copies only repeat rows of the matrix.
    """
    length = rows.select(F.length("sequence")).first()
    needed = required_sites(length[0] if length else 0, min_sites, min_coverage)
    return sequence_pairs(rows).withColumn(
        "distance", F.when(F.col("valid") >= needed, F.col("diff") / F.col("valid")))


def called_sites(rows: DataFrame) -> DataFrame:
    """The matrix diagonal: own called sites, distance zero."""
    return rows.select("idx", count_symbols(as_dna(F.col("sequence")), CALLABLE).alias("valid"),
                       F.lit(0.0).alias("distance"))


def complete_distance(samples: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Distances over the sites callable in every sample (of ``within``, if given)."""
    scope = within if within is not None else samples
    complete = cut(overall_complete(site_counts(scope)), "complete-sites").select("pos")
    runs = site_runs(complete)
    masked = grouped(scope, None).withColumn("__runs", runs).withColumn(
        "sequence", take_sites(F.col("sequence"), F.col("__runs")))
    rows = cut(masked.groupBy("sequence").agg(F.min("sample_idx").alias("idx")), "signatures")
    return sequence_pairs(rows, None).select(
        "i", "j", "diff", F.col("valid").alias("sites"),
        (F.col("diff") / F.nullif("valid", F.lit(0))).alias("distance"))


def site_mask(samples: DataFrame, exclude_ambiguous: bool = True, literal_u: bool = True) -> DataFrame:
    """Columns whose symbols all belong to the network alphabet (or all columns)."""
    counted = (cells(samples, normalise=not literal_u).groupBy("pos", "base")
               .agg(F.count(F.lit(1)).alias("n")))
    allowed = F.bool_and(F.col("base").isin(*ALPHABETS["network"]))
    sites = counted.groupBy("pos").agg(allowed.alias("clean"))
    return (sites.where("clean") if exclude_ambiguous else sites).select("pos")


def network_haplotypes(samples: DataFrame, exclude_ambiguous: bool = True,
                       as_rna: bool = False) -> tuple[DataFrame, DataFrame]:
    """Haplotypes after dropping masked columns: ``(nodes(idx, sequence, n), members)``.

    A gap is a state. ``U`` is read as ``T`` unless ``as_rna`` keeps symbols literal. Sequences
    that become identical are merged and keep all their members. A mask without a site raises.
    """
    mask, (sites, _) = cut_counted(site_mask(samples, exclude_ambiguous), "site-mask")
    if not sites and not samples.isEmpty():
        raise ValueError("no site is left after excluding ambiguous or missing bases")
    symbols = F.upper("sequence") if as_rna else as_dna(F.col("sequence"))
    masked = cut(samples.select("sample_idx", "sample", symbols.alias("sequence"))
                 .withColumn("__runs", site_runs(mask))
                 .withColumn("sequence", take_sites(F.col("sequence"), F.col("__runs")))
                 .drop("__runs"), "masked")
    nodes = cut(masked.groupBy("sequence").agg(
        F.min("sample_idx").alias("idx"), F.count(F.lit(1)).alias("n"))
        .where("sequence <> ''"), "network-nodes")
    members = masked.join(nodes.select("idx", "sequence"), "sequence").select(
        "idx", "sample_idx", "sample")
    return nodes, members


def haplotype_distances(nodes: DataFrame) -> DataFrame:
    """Hamming distances of network haplotypes, every symbol a state."""
    return sequence_pairs(nodes.select("idx", "sequence"), None).select("i", "j", "diff")


def distance_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"),
                     F.count_if(F.col("distance").isNull()).alias("unavailable"),
                     F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))


def low_coverage_examples(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` pairs without a distance (a report limit)."""
    return pairs.where("distance IS NULL").orderBy("i", "j").limit(k).select("i", "j", "valid")


def validate_distances(matrix: DataFrame) -> DataFrame:
    """Counts of cells that break symmetry, the zero diagonal or non-negativity."""
    row, col, value = (matrix.schema[c].dataType for c in ("row", "col", "value"))
    numbers = isinstance(row, IntegralType) and isinstance(col, IntegralType) and isinstance(value, DoubleType)
    checks = _packed_checks(matrix) if numbers else _place_checks(matrix)
    return checks.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("code"), F.col(c).alias("cells"))
        for c in ("asymmetric", "diagonal", "negative")])).alias("c")).select("c.code", "c.cells")


def _place_checks(matrix: DataFrame) -> DataFrame:
    """The counts of ``validate_distances`` for labels of any type."""
    # a cell and its mirror meet once, in a group of their unordered place; repeated cells are counted
    value, turned = F.col("value"), F.col("row") > F.col("col")
    here = F.lit(1).cast("bigint")
    cells = (matrix.select(
        F.when(turned, F.col("col")).otherwise(F.col("row")).alias("a"), F.when(turned, F.col("row")).otherwise(F.col("col")).alias("b"),
        "value", F.when(turned, 0).otherwise(here).alias("up"), F.when(turned, here).otherwise(0).alias("down"))
        .repartition("a", "b").groupBy("a", "b", "value").agg(F.sum("up").alias("up"), F.sum("down").alias("down")))
    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))
    known, below, zero = value.isNotNull(), value < 0, value.eqNullSafe(F.lit(0.0))
    places = cells.groupBy("a", "b").agg(
        F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum(F.col("up") * F.col("down")).alias("equal"),
        F.sum(F.col("up") * F.col("up")).alias("own"), total(F.when(known, F.col("up") + F.col("down"))).alias("known"),
        total(F.when(below, F.col("up"))).alias("below_up"), total(F.when(below, F.col("down"))).alias("below_down"),
        total(F.when(~zero, F.col("up"))).alias("off"))
    up, down, diagonal = F.col("up"), F.col("down"), F.col("a") == F.col("b")
    alone = F.col("a").isNull() | F.col("b").isNull() | (~diagonal & ((up == 0) | (down == 0)))
    def by_place(single: Column, pairs: Column, same: Column) -> Column:
        return total(F.when(alone, single).when(diagonal, same).otherwise(pairs))
    return places.agg(
        by_place(F.col("known"), 2 * (up * down - F.col("equal")), up * up - F.col("own")).alias("asymmetric"),
        by_place(F.lit(0), F.lit(0), up * F.col("off")).alias("diagonal"),
        by_place(F.col("below_up") + F.col("below_down"), F.col("below_up") * down + F.col("below_down") * up,
                 F.col("below_up") * up).alias("negative"))


def _packed_checks(matrix: DataFrame) -> DataFrame:
    """The counts of ``validate_distances`` for numbered rows and columns.

    Cells leave a task packed, a mirror next to its cell as one record, in SIDE x SIDE groups by the
    hashes of row and column: about a byte a cell is shuffled.
    """
    tasks = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = matrix.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), "value").mapInArrow(
        _pack, "bin int, records binary, vals binary, known bigint, below bigint")
    sums = packed.repartition(tasks, "bin").groupBy("bin").applyInPandas(
        _check_places, "asymmetric bigint, diagonal bigint, negative bigint")
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asymmetric", "diagonal", "negative")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CELLS:
            yield _pieces(pa.Table.from_batches(held))
            held = []
    if held:
        yield _pieces(pa.Table.from_batches(held))


def _pieces(cells: pa.Table) -> pa.RecordBatch:
    """Cells as one row of packed records a group; cells without a row or column are counted here.

    A record is a place a <= b with the codes of its cell above and below the diagonal: 0 no cell,
    1 null, else 2 and more for ``vals``.
    """
    placed = (cells["row"].is_valid().to_numpy() & cells["col"].is_valid().to_numpy())
    known, value = cells["value"].is_valid().to_numpy(), cells["value"].fill_null(0.0).to_numpy() + 0.0
    counts = int((known & ~placed).sum()), int((known & ~placed & (value < 0)).sum())
    code, vals = pd.factorize(value, use_na_sentinel=False)
    code = np.where(known, code + 2, 1)[placed]
    row, col = (cells[c].fill_null(0).to_numpy()[placed] for c in ("row", "col"))
    a, b, down = np.minimum(row, col), np.maximum(row, col), row > col
    up_code, down_code = np.where(down, 0, code), np.where(down, code, 0)
    # a cell whose mirror follows it takes the mirror into its record
    pair = np.zeros(len(a), bool)
    pair[:-1] = ~down[:-1] & down[1:] & (a[:-1] == a[1:]) & (b[:-1] == b[1:])
    second = np.r_[False, pair][:len(pair)]
    down_code = np.where(pair, np.r_[down_code, 0][1:], down_code)[~second]
    a, b, up_code = a[~second], b[~second], up_code[~second]
    (at, names_a), (bt, names_b) = pd.factorize(a, sort=True), pd.factorize(b, sort=True)
    group = (_side(names_a) * SIDE)[at] + _side(names_b)[bt]
    order = np.lexsort((bt, at, group)) if len(names_a) * len(names_b) >= 1 << 50 else np.argsort(
        group * (len(names_a) * len(names_b)) + at * len(names_b) + bt)
    group, a, b, up_code, down_code = (x[order] for x in (group, a, b, up_code, down_code))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    kind = np.uint16 if len(vals) < 65000 else np.uint32
    records = [zlib.compress(b"".join((np.diff(a[s:e], prepend=0).tobytes(), b[s:e].tobytes(), up_code[s:e].astype(kind).tobytes(),
                                       (down_code[s:e] - up_code[s:e]).astype(kind).tobytes())), 1)
               for s, e in zip(starts, np.r_[starts[1:], len(group)])]
    rows = [(int(group[s]), r, vals.tobytes(), 0, 0) for s, r in zip(starts, records)] + [(-1, None, None, *counts)] * any(counts)
    bins, records, texts, known, below = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(records, pa.binary()), pa.array(texts, pa.binary()),
                                       pa.array(known, pa.int64()), pa.array(below, pa.int64())],
                                      names=["bin", "records", "vals", "known", "below"])


def _side(ids: np.ndarray) -> np.ndarray:
    """Which of SIDE parts an id belongs to, by a hash of it alone."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SIDE


def _check_places(pieces: pd.DataFrame) -> pd.DataFrame:
    """Counts of one group of places; ``bin`` -1 has cells without a place, counted already."""
    if pieces["bin"].iloc[0] < 0:
        return pd.DataFrame({"asymmetric": [pieces["known"].sum()], "diagonal": [0], "negative": [pieces["below"].sum()]})
    parts = []
    for packed, vals in zip(pieces["records"], pieces["vals"]):
        vals, raw = np.frombuffer(vals), zlib.decompress(packed)
        kind = np.dtype(np.uint16 if len(vals) < 65000 else np.uint32)
        n = len(raw) // (16 + 2 * kind.itemsize)
        up = np.frombuffer(raw, kind, n, 16 * n)
        down = np.frombuffer(raw, kind, n, (16 + kind.itemsize) * n) + up
        known = np.r_[np.nan, np.nan, vals]
        parts.append((np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int64, n, 8 * n), up, down, known[up], known[down]))
    a, b, up, down, above, under = (np.concatenate(x) for x in zip(*parts))
    at, names = pd.factorize(b)
    places, p = np.unique(pd.factorize(a)[0] * len(names) + at, return_inverse=True)
    size = len(places)
    diagonal = np.zeros(size, bool)
    diagonal[p] = a == b
    def total(rule: np.ndarray) -> np.ndarray:
        return np.bincount(p[rule], minlength=size)
    # equal values have equal codes over all pieces: 0 no cell, 1 null, NaN last
    _, codes = np.unique(np.r_[above, under], return_inverse=True)
    ups, downs = up > 0, down > 0
    cu, cd = np.where(up > 1, codes[:len(up)] + 2, up), np.where(down > 1, codes[len(up):] + 2, down)
    n_up, n_down = total(ups), total(downs)
    equal, own = total(ups & downs & (cu == cd)), n_up.copy()
    many = np.bincount(p, minlength=size) > 1
    if many.any():  # repeated cells of a place, or a mirror from another task
        width, q = int(max(cu.max(), cd.max())) + 1, many[p]
        keys, k = np.unique(np.r_[p[q & ups] * width + cu[q & ups], p[q & downs] * width + cd[q & downs]], return_inverse=True)
        split = int((q & ups).sum())
        u, d = np.bincount(k[:split], minlength=len(keys)), np.bincount(k[split:], minlength=len(keys))
        of = keys // width
        equal[many] = np.bincount(of, u * d, size).astype(np.int64)[many]
        own[many] = np.bincount(of, u * u, size).astype(np.int64)[many]
    known, low_up, low_down = total(up > 1) + total(down > 1), total((up > 1) & (above < 0)), total((down > 1) & (under < 0))
    off = total(ups & ~((up > 1) & (above == 0)))
    alone = ~diagonal & ((n_up == 0) | (n_down == 0))
    def by_place(single: np.ndarray, pairs: np.ndarray, same: np.ndarray) -> list[int]:
        return [int(np.where(alone, single, np.where(diagonal, same, pairs)).sum())]
    return pd.DataFrame({
        "asymmetric": by_place(known, 2 * (n_up * n_down - equal), n_up * n_up - own),
        "diagonal": [int((n_up * off)[diagonal].sum())],
        "negative": by_place(low_up + low_down, low_up * n_down + low_down * n_up, low_up * n_up)})
