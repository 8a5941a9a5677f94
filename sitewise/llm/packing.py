"""Best-fit packing of documents into training sequences under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitewise.llm.mixing import word_count
from sitewise.storage import cut

CAPACITY = 4096
PER_SOURCE = 4
SHARD_ITEMS = 2048
_BINS = 1 << 20


class Bins:
    """Open bins in order of residual, each with its source and duplicate-cluster bitmaps.

    Plane k of the source bitmaps has the bits of sources with more than k documents in the bin.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []
        self.per_source = per_source

    def place(self, size: int, source: int, cluster: int) -> int:
        """Bin for an item; ``source`` and ``cluster`` are single bits (0: no conflict)."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, found = self.order[at]
            if not (self.clusters[found] & cluster or self.planes[found][-1] & source):
                del self.order[at]
                break
            at += 1  # the next larger residual
        else:
            residual, found = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.planes.append([0] * self.per_source)
        self.clusters[found] |= cluster
        planes = self.planes[found]
        for k, plane in enumerate(planes):
            if not plane & source:
                planes[k] = plane | source
                break
        insort(self.order, (residual - size, found))
        return found


def _pack_shard(capacity: int, per_source: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "doc_id", "piece", "row"], ascending=[False, True, True, True])
        # only what occurs twice in the shard can conflict and needs a bit of its own
        source = {s: 1 << k for k, s in enumerate(pd.unique(shard["source"].fillna("\0null")))}
        counts = shard["cluster"].value_counts()
        cluster = {c: 1 << k for k, c in enumerate(counts.index[counts > 1])}
        bins = Bins(capacity, per_source)
        place = [bins.place(size, source[s], cluster.get(c, 0)) for size, s, c in
                 zip(shard["size"], shard["source"].fillna("\0null"), shard["cluster"])]
        out = shard[["row", "doc_id", "piece", "size"]].rename(columns={"size": "n_words"})
        out["bin"] = shard["shard"].to_numpy() * _BINS + pd.Series(place, index=shard.index, dtype="int64")
        return out
    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, n_words, bin.

    Documents longer than ``capacity`` words are cut; full pieces have a bin each, rests and
    shorter documents are packed best fit, largest first. A bin takes one document of a duplicate
    cluster (texts equal but for case) or piece of a document, and ``per_source`` documents of a
    source. Rows are dealt evenly to shards of about ``shard_items`` pieces, so neither a source
    nor a group of copies fills a shard, and every shard packs by itself in one task. A null or
    wordless text takes no room and has a null bin; null is a source of its own; repeated rows
    are copies of each other and never share a bin; an empty table gives no row; other columns
    are not read.
    """
    read = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"),
                       F.md5(F.lower("text")).alias("cluster"))
    seen = Observation()
    items = cut(read.select(F.monotonically_increasing_id().alias("row"), "*").observe(
        seen, F.count_if(F.col("words") > 0).alias("n")), "pack-items")
    shards = max(1, -(-seen.get["n"] // shard_items))
    last = F.floor((F.col("words") - 1) / capacity).cast("bigint")
    pieces = (items.filter("words > 0")
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
              .withColumn("size", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("bigint")))
    full = pieces.filter(F.col("size") == capacity).select(
        "row", "doc_id", "piece", F.col("size").alias("n_words"),
        (-1 - F.monotonically_increasing_id()).alias("bin"))
    rest = pieces.filter(F.col("size") < capacity).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = rest.select("row", F.col("doc_id").cast("string"), "source", "cluster", "piece", "size", "shard").groupBy("shard").applyInPandas(
        _pack_shard(capacity, per_source), "row long, doc_id string, piece long, n_words long, bin long"
    ).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    empty = items.filter("words = 0").select(
        "row", "doc_id", F.lit(0).cast("bigint").alias("piece"), F.col("words").alias("n_words"),
        F.lit(None).cast("bigint").alias("bin"))
    return full.unionAll(packed).unionAll(empty).drop("row")
