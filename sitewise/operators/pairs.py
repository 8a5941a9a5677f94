"""Blocked comparison of distinct sequences.

Every result here is about pairs of sequences. Rows are distinct sequences with a multiplicity,
placed in blocks of at most a few thousand rows; each unordered pair of blocks is one task unit
that compares its rows by matrix products. Statistics leave a task already summed, so only an
operator whose result *is* the pair list ever writes pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.schema import CALLABLE

BLOCK_ROWS = 1024
BLOCK_CELLS = 1 << 24
_SITES_AT_ONCE = 2048


def block_rows(rows: int, sites: int, parallelism: int) -> int:
    """Rows per block: bounded by memory, small enough to give every core some block pairs."""
    by_memory = max(16, min(BLOCK_ROWS, BLOCK_CELLS // max(1, sites)))
    blocks_wanted = max(1, int((2 * parallelism) ** 0.5) + 1)
    return max(16, min(by_memory, -(-rows // blocks_wanted)))


def block_pairs(rows: DataFrame, key: str, block: str, blocks: str,
                by: list[str] | None = None) -> DataFrame:
    """Replicate each row to the block pairs it takes part in (``blocks`` copies per row)."""
    by = by or []
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("__other")
    return (rows.select("*", other)
            .withColumn("__lo", F.least(block, "__other"))
            .withColumn("__hi", F.greatest(block, "__other"))
            .drop("__other"))


def _dealt(placed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Block pairs dealt to a fixed number of tasks.

    Their rows are few bytes, which adaptive execution would put together in one task, while the
    work grows with the pairs.
    """
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return block_pairs(placed, "idx", "__block", "__blocks").repartition(tasks, *(by or []), "__lo", "__hi")


def codes(sequences: pd.Series) -> np.ndarray:
    """Sequences as a rows x sites byte matrix."""
    if len(sequences) == 0:
        return np.zeros((0, 0), dtype=np.uint8)
    width = len(sequences.iloc[0])
    data = "".join(sequences).encode("latin-1")
    return np.frombuffer(data, dtype=np.uint8).reshape(len(sequences), width)


def compare(left: np.ndarray, right: np.ndarray, alphabet: str | None = CALLABLE
            ) -> tuple[np.ndarray, np.ndarray]:
    """``(valid, diff)`` counts for every row of ``left`` against every row of ``right``.

    With an alphabet, a site counts only where both symbols belong to it. Without one, every
    symbol is a state of its own and every site counts.
    """
    sites = left.shape[1]
    same = np.zeros((left.shape[0], right.shape[0]), dtype=np.float64)
    valid = np.zeros_like(same)
    for start in range(0, sites, _SITES_AT_ONCE):
        a, b = left[:, start:start + _SITES_AT_ONCE], right[:, start:start + _SITES_AT_ONCE]
        if alphabet is None:
            symbols = np.intersect1d(np.unique(a), np.unique(b))
            valid += a.shape[1]
        else:
            symbols = np.frombuffer(alphabet.encode(), dtype=np.uint8)
            valid += (np.isin(a, symbols).astype(np.float32)
                      @ np.isin(b, symbols).astype(np.float32).T)
        for symbol in symbols:
            same += (a == symbol).astype(np.float32) @ (b == symbol).astype(np.float32).T
    return valid.astype(np.int64), (valid - same).round().astype(np.int64)


def _split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    lo, hi = int(pdf["__lo"].iloc[0]), int(pdf["__hi"].iloc[0])
    if lo == hi:
        return pdf, pdf, True
    return pdf[pdf["__block"] == lo], pdf[pdf["__block"] == hi], False


def _placed(rows: DataFrame, key: str, place: str | None = None) -> DataFrame:
    """Add block number and block count; sizes come from one small aggregate.

    Blocks are hashes of ``key`` or, with ``place``, runs of that 1-based dense number.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sequence")).alias("w")).first()
    per = block_rows(size["n"], size["w"] or 1, spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-size["n"] // per))
    block = F.expr(f"(`{place}` - 1) div {per}") if place else F.pmod(F.xxhash64(key), F.lit(blocks))
    return rows.withColumn("__block", block.cast("int")).withColumn("__blocks", F.lit(blocks))


def sequence_pairs(rows: DataFrame, alphabet: str | None = CALLABLE) -> DataFrame:
    """All pairs ``i < j`` of ``rows(idx, sequence)`` with valid and differing site counts.

    The result itself is quadratic; callers pass distinct sequences.
    """
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same_block = _split(pdf)
        li, ri = left["idx"].to_numpy(), right["idx"].to_numpy()
        valid, diff = compare(codes(left["sequence"]), codes(right["sequence"]), alphabet)
        if same_block:
            a, b = np.nonzero(li[:, None] < ri[None, :])
        else:
            a, b = np.indices(valid.shape).reshape(2, -1)
        return pd.DataFrame({"i": np.minimum(li[a], ri[b]), "j": np.maximum(li[a], ri[b]),
                             "valid": valid[a, b], "diff": diff[a, b]})

    placed = _dealt(_placed(rows.select("idx", "sequence"), "idx"))
    return placed.groupBy("__lo", "__hi").applyInPandas(
        work, "i bigint, j bigint, valid bigint, diff bigint")


def _segment_sums(matrix: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
    return np.add.reduceat(matrix, starts, axis=axis)


def group_pair_sums(members: DataFrame) -> DataFrame:
    """Comparable pairs and summed p-distances per unordered pair of groups (pairwise deletion).

    ``members`` has sample_idx, grp and sequence. Copies are collapsed per group first; pairs of
    copies contribute distance zero and are counted in closed form.
    """
    units = (members.groupBy("grp", "sequence").agg(
        F.min("sample_idx").alias("idx"), F.count(F.lit(1)).alias("n")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same_block = _split(pdf)
        left, right = left.sort_values("grp"), right.sort_values("grp")
        valid, diff = compare(codes(left["sequence"]), codes(right["sequence"]))
        weight = left["n"].to_numpy(dtype=float)[:, None] * right["n"].to_numpy(dtype=float)[None, :]
        if same_block:
            weight[left["idx"].to_numpy()[:, None] >= right["idx"].to_numpy()[None, :]] = 0.0
            own = left["n"].to_numpy(dtype=float)
            called = np.diag(valid) > 0
            weight[np.diag_indices(len(own))] = np.where(called, own * (own - 1) / 2, 0.0)
        weight = np.where(valid > 0, weight, 0.0)
        distance = weight * diff / np.maximum(valid, 1)
        lg, rg = left["grp"].to_numpy(), right["grp"].to_numpy()
        ls = np.flatnonzero(np.r_[True, lg[1:] != lg[:-1]])
        rs = np.flatnonzero(np.r_[True, rg[1:] != rg[:-1]])
        pairs = _segment_sums(_segment_sums(weight, ls, 0), rs, 1)
        total = _segment_sums(_segment_sums(distance, ls, 0), rs, 1)
        names_a, names_b = np.repeat(lg[ls], len(rs)), np.tile(rg[rs], len(ls))
        first = names_a <= names_b
        return pd.DataFrame({"grp_a": np.where(first, names_a, names_b),
                             "grp_b": np.where(first, names_b, names_a),
                             "pairs": pairs.ravel().round().astype(np.int64),
                             "distance_sum": total.ravel()})

    placed = _dealt(_placed(units, "idx"))
    partial = placed.groupBy("__lo", "__hi").applyInPandas(
        work, "grp_a string, grp_b string, pairs bigint, distance_sum double")
    return partial.groupBy("grp_a", "grp_b").agg(
        F.sum("pairs").alias("pairs"), F.sum("distance_sum").alias("distance_sum"))


def mismatch_counts(scoped: DataFrame) -> DataFrame:
    """Histogram of differences per scope from ``scoped(scope, grp, sequence, n)``.

    Each scope is blocked by its own size, so a scope holding most rows is split like the rest.
    """
    spark = scoped.sparkSession
    rows = scoped.withColumn("idx", F.xxhash64("sequence"))
    cores = spark.sparkContext.defaultParallelism
    wanted = max(1, int((2 * cores) ** 0.5) + 1)
    width = F.greatest(F.max(F.length("sequence")), F.lit(1))
    by_memory = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.lit(BLOCK_CELLS) / width))
    count = F.count(F.lit(1))
    per = F.greatest(F.lit(64), F.least(by_memory, F.ceil(count / wanted)))
    sizes = rows.groupBy("scope", "grp").agg(
        F.greatest(F.lit(1), F.ceil(count / per)).cast("int").alias("__blocks"))
    placed = (rows.join(sizes, ["scope", "grp"])
              .withColumn("__block", F.pmod("idx", "__blocks").cast("int")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same_block = _split(pdf)
        _, diff = compare(codes(left["sequence"]), codes(right["sequence"]), None)
        weight = left["n"].to_numpy(dtype=float)[:, None] * right["n"].to_numpy(dtype=float)[None, :]
        if same_block:
            own = left["n"].to_numpy(dtype=float)
            weight = np.triu(weight, 1)
            weight[np.diag_indices(len(own))] = own * (own - 1) / 2
        bins = np.bincount(diff.ravel(), weights=weight.ravel())
        seen = np.flatnonzero(bins > 0)
        return pd.DataFrame({"scope": pdf["scope"].iloc[0], "grp": pdf["grp"].iloc[0],
                             "differences": seen, "pair_count": bins[seen].round().astype(np.int64)})

    pairs = _dealt(placed, ["scope", "grp"])
    partial = pairs.groupBy("scope", "grp", "__lo", "__hi").applyInPandas(
        work, "scope string, grp string, differences bigint, pair_count bigint")
    return partial.groupBy("scope", "grp", "differences").agg(
        F.sum("pair_count").alias("pair_count"))
