"""Random relabelling of samples drawn as group counts of haplotypes.

A permutation of labels that keeps group sizes gives every haplotype a vector of group counts,
and these vectors follow a multivariate hypergeometric law. They are drawn down a binary tree
over the haplotypes: a node hands its labels to its left child by one hypergeometric draw a
group, the rest goes right. A draw depends only on the seed, the replicate and its node, so a
task redraws the few nodes above its own block of haplotypes and nothing about samples or
replicates is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.storage import cut_counted, dense_index

BLOCK_LEVEL = 12       # a task draws for up to 2 ** BLOCK_LEVEL haplotypes ...
SLICE = 64             # ... and this many replicates at a time, fewer when there are many groups
CELLS = 1 << 22
# Values farther than this from the mean have a probability below 1e-25.
WIDE_SD, WIDE = 12.0, 16


def uniforms(prefix: str, reps: np.ndarray, level: int, nodes: np.ndarray, group: int) -> np.ndarray:
    """A number in (0, 1) with 52 bits for each (replicate, node), from md5 of their names."""
    digests = b"".join(md5(f"{prefix}:{r}:{level}:{k}:{group}".encode()).digest()
                       for r, k in zip(reps.tolist(), nodes.tolist()))
    return ((np.frombuffer(digests, dtype=">u8")[::2] >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def hypergeometric(total: np.ndarray, marked: np.ndarray, taken: np.ndarray,
                   uniform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Marked items among ``taken`` of ``total``: the smallest x whose cumulated probability reaches u.

    ``uniform`` gets the places that are not settled by the counts alone.
    """
    low = np.maximum(0, taken + marked - total)
    out = low.copy()
    open_ = np.flatnonzero(np.minimum(marked, taken) > low)
    if not len(open_):
        return out
    n, k, m = (a[open_].astype(np.float64) for a in (total, marked, taken))
    u = uniform(open_)
    mean = m * (k / n)
    reach = WIDE_SD * np.sqrt(mean * (1 - k / n) * (n - m) / np.maximum(n - 1, 1)) + WIDE
    first = np.maximum(low[open_], np.floor(mean - reach))
    width = np.minimum(np.minimum(k, m), np.ceil(mean + reach)) - first + 1
    drawn = np.empty(len(open_))
    classes = np.ceil(np.log2(width)).astype(int)
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        step = max(1, CELLS >> int(c))
        for start in range(0, len(rows), step):
            at = rows[start:start + step]
            x = first[at, None] + np.arange((1 << int(c)) - 1)
            up = np.maximum(k[at, None] - x, 0) * np.maximum(m[at, None] - x, 0)
            down = (x + 1) * ((n - k - m)[at, None] + x + 1)
            with np.errstate(divide="ignore"):
                logs = np.cumsum(np.log(up / down), axis=1)
            logs = np.concatenate([np.zeros((len(at), 1)), logs], axis=1)
            mass = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            drawn[at] = first[at] + (mass < u[at, None] * mass[:, -1:]).sum(axis=1)
    out[open_] = drawn.astype(np.int64)
    return out


def split_labels(counts: np.ndarray, left: np.ndarray, nodes: np.ndarray, level: int,
                 reps: np.ndarray, prefix: str) -> np.ndarray:
    """Group counts of left children: ``counts`` and the result are replicates x groups x nodes."""
    shape = (counts.shape[0], counts.shape[2])
    where = np.broadcast_to(nodes, shape).ravel()
    who = np.broadcast_to(reps[:, None], shape).ravel()
    rest = counts.sum(axis=1).ravel()
    room = np.broadcast_to(left, shape).ravel().copy()
    out = np.empty_like(counts)
    for g in range(counts.shape[1]):
        marked = counts[:, g, :].ravel()
        x = hypergeometric(rest, marked, room,
                           lambda at, g=g: uniforms(prefix, who[at], level, where[at], g))
        out[:, g, :] = x.reshape(shape)
        rest = rest - marked
        room -= x
    return out


def block_counts(block: int, level: int, path: list[tuple[int, int]], sizes: np.ndarray,
                 groups: np.ndarray, reps: np.ndarray, prefix: str) -> np.ndarray:
    """Group counts, replicates x groups x haplotypes, of one block of ``2 ** level`` places.

    ``path`` holds (level of the parent, samples in its left child) from the root to the block.
    """
    counts = np.repeat(groups.astype(np.int64)[None, :, None], len(reps), axis=0)
    for parent, left in path:
        node = np.array([block >> (parent - level)])
        drawn = split_labels(counts, np.array([left]), node, parent, reps, prefix)
        right = (block >> (parent - 1 - level)) & 1
        counts = counts - drawn if right else drawn
    tree = [np.zeros(1 << level, np.int64)]
    tree[0][:len(sizes)] = sizes
    for _ in range(level):
        tree.append(tree[-1].reshape(-1, 2).sum(axis=1))
    used = 1
    for parent in range(level, 0, -1):
        nodes = (block << (level - parent)) + np.arange(used)
        drawn = split_labels(counts, tree[parent - 1][0:2 * used:2], nodes, parent, reps, prefix)
        both = np.stack([drawn, counts - drawn], axis=3).reshape(*counts.shape[:2], -1)
        used = -(-len(sizes) // (1 << (parent - 1)))
        counts = both[:, :, :used]
    return counts


def draw_blocks(units: DataFrame, key: str, groups: int, extra: Column | None = None,
                width: int = 0) -> tuple[DataFrame, int]:
    """One row per block of haplotypes: ``block, path, keys, sizes`` (and ``extra`` per haplotype).

    ``units`` has one row per haplotype with an integer ``key`` and its ``n`` samples; haplotypes
    are numbered in the order of the key. ``width`` is the largest length of ``extra``. A block
    holds a bounded number of haplotypes, and its path one entry for each level above it.
    """
    level = BLOCK_LEVEL
    while level and (groups + width) << level > CELLS:
        level -= 1
    placed = dense_index(units, key, "__place").withColumn("__unit", F.col("__place") - 1)
    placed, (count, _) = cut_counted(placed.withColumn("block", F.shiftright("__unit", level)), "draw-units")
    blocks = placed.groupBy("block").agg(F.sum("n").alias("n"))
    top = level + (max(0, count - 1) >> level).bit_length()
    fields = [F.col("__unit").alias("u"), F.col(key).alias("key"), F.col("n").alias("n")]
    if extra is not None:
        fields.append(extra.alias("extra"))
    rows = (placed.groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__h"))
            .select("block", F.col("__h.key").alias("keys"), F.col("__h.n").alias("sizes"),
                    *([F.col("__h.extra").alias("extra")] if extra is not None else [])))
    if top == level:
        return rows.withColumn("path", F.expr("cast(array() AS array<struct<parent:int,left:bigint>>)")), level
    parents = F.explode(F.sequence(F.lit(level + 1), F.lit(top))).alias("parent")
    above = blocks.select("block", "n", parents).withColumn(
        "node", F.expr(f"shiftright(block, parent - {level})"))
    left = (above.where(F.expr(f"shiftright(block, parent - 1 - {level}) % 2 = 0"))
            .groupBy("parent", "node").agg(F.sum("n").alias("left")))
    paths = (above.select("block", "parent", "node").join(left, ["parent", "node"])
             .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("parent", "left")), asc=False).alias("path")))
    return rows.join(paths, "block"), level


def _drawn(table: DataFrame, level: int, sizes: list[int], permutations: int, seed: int,
           emit: Callable, schema: str) -> DataFrame:
    """Draw every (block, slice of replicates) in a task; ``emit`` turns counts into rows."""
    groups = np.array(sizes, dtype=np.int64)
    slice_ = max(1, min(SLICE, CELLS // (max(1, len(sizes)) << level)))
    slices = -(-permutations // slice_)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                reps = np.arange(1 + row.slice * slice_, min(permutations, (row.slice + 1) * slice_) + 1)
                path = [(int(p["parent"]), int(p["left"])) for p in row.path]
                counts = block_counts(int(row.block), level, path, np.asarray(row.sizes), groups, reps, str(seed))
                yield from emit(row, reps, counts)

    dealt = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "block", "slice").mapInPandas(work, schema)


def drawn_labels(units: DataFrame, key: str, groups: list[tuple[str, int]], permutations: int,
                 seed: int) -> DataFrame:
    """``rep, grp, <key>, n`` for replicates 1 to ``permutations``; groups that get no sample are left out."""
    names = np.array([g for g, _ in groups], dtype=object)
    table, level = draw_blocks(units, key, len(groups))

    def emit(row, reps: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        r, g, h = np.nonzero(counts)
        yield pd.DataFrame({"rep": reps[r], "grp": names[g], key: np.asarray(row.keys)[h], "n": counts[r, g, h]})

    return _drawn(table, level, [n for _, n in groups], permutations, seed, emit,
                  f"rep int, grp string, {key} bigint, n bigint")


def drawn_alleles(units: DataFrame, key: str, alleles: str, width: int, groups: list[tuple[str, int]],
                  permutations: int, seed: int) -> DataFrame:
    """``rep, grp, allele, c``: samples of a group that carry an allele, before blocks are added up.

    Column ``alleles`` lists the allele numbers of a haplotype, at most ``width`` of them. The
    counts of a block meet its alleles inside the task, so haplotypes x replicates is no table.
    """
    names = np.array([g for g, _ in groups], dtype=object)
    table, level = draw_blocks(units, key, len(groups), F.col(alleles), width)

    def emit(row, reps: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        carried = [np.asarray(a, dtype=np.int64) for a in row.extra]
        owner = np.repeat(np.arange(len(carried)), [len(a) for a in carried])
        if not len(owner):
            return
        allele = np.concatenate(carried)
        order = np.argsort(allele, kind="stable")
        owner, allele = owner[order], allele[order]
        starts = np.flatnonzero(np.r_[True, allele[1:] != allele[:-1]])
        step = max(1, CELLS // (counts.shape[1] * len(owner)))
        for at in range(0, len(reps), step):
            sums = np.add.reduceat(counts[at:at + step][:, :, owner], starts, axis=2)
            r, g, a = np.nonzero(sums)
            yield pd.DataFrame({"rep": reps[at + r], "grp": names[g], "allele": allele[starts][a],
                                "c": sums[r, g, a].astype(np.float64)})

    return _drawn(table, level, [n for _, n in groups], permutations, seed, emit,
                  "rep int, grp string, allele bigint, c double")
