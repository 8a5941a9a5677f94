"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.words import WordHashes, mix, pieces, shingles

BINS = 256
BITS = 8
_ROUND = 64  # attempts of densification that are looked at together


def bin_minima(hashes: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each bin and whether the bin has one; a hash is put in a bin once, by its high bits."""
    ordered = np.sort(hashes)
    starts = np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)
    first = np.searchsorted(ordered, starts)
    filled = first < np.append(first[1:], len(ordered))
    return ordered[np.minimum(first, len(ordered) - 1)], filled


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Each empty bin takes the value of the first full bin in a random order of its own.

    The order depends on the bin alone, so equal bins of two sets borrow from the same place.
    """
    empty = np.flatnonzero(~filled)
    values, start = values.copy(), 0
    source = values.copy()
    while len(empty):
        tries = np.arange(start, start + _ROUND, dtype=np.uint64)[:, None]
        place = (mix(empty.astype(np.uint64)[None, :] * np.uint64(0x100000001B3) + (tries << np.uint64(32)))
                 % np.uint64(len(values))).astype(np.int64)
        hit = filled[place]
        found, at = hit.any(axis=0), hit.argmax(axis=0)
        values[empty[found]] = source[place[at[found], np.flatnonzero(found)]]
        empty, start = empty[~found], start + _ROUND
    return values


def fingerprint(text: bytes, hashes: WordHashes, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low-order bits of the minima of all bins, in hexadecimal; '' for a text without words.

    The set is that of the lower-cased five-word shingles.
    """
    found = shingles(hashes.of(text.lower().split()))
    if not len(found):
        return ""
    values = densify(*bin_minima(found, bins)) & np.uint64((1 << bits) - 1)
    unpacked = np.unpackbits(values.astype(np.uint8)[:, None], axis=1)[:, 8 - bits:]
    return np.packbits(unpacked).tobytes().hex()


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity; chance agreement of ``bits`` bits is taken out."""
    if not a or not b:
        return float(a == b)
    one, two = (np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))[:bins * bits].reshape(bins, bits)
                for x in (a, b))
    chance = 0.5 ** bits
    return max(0.0, (float((one == two).all(axis=1).mean()) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` with ``fingerprint``; no shuffle. A null text counts as empty."""
    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in parts:
            yield pd.Series([fingerprint(t or b"", hashes, bins, bits) for t in texts], dtype=object)

    return docs.select("*", of(F.col("text").cast("binary")).alias("fingerprint"))


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) sorted so that in each bucket the next document follows.

    Descending doc_id, ties by text, null ids last; the order is a circle. Buckets are ranges of
    doc_id; the first document of a bucket is also sent, as ``tail``, to the end of the bucket
    before it. Only the bounds of the buckets and one id for each reach the driver; texts are
    shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = 4 * n  # several buckets for each partition even out
    bounds = np.unique(docs.approxQuantile("doc_id", [k / fine for k in range(1, fine)], 0.25 / fine))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(bounds, ids.fillna(0).astype("float64"), "right")))

    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                         bucket(F.col("doc_id").cast("double")).alias("bucket"))
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    circle = [(r["bucket"], r["top"], tops[(k + 1) % len(tops)]["bucket"]) for k, r in enumerate(tops)]
    ends = F.broadcast(spark.createDataFrame(circle, "bucket int, top long, before int"))  # one row per bucket
    rows = placed.join(ends, "bucket").select(
        "doc_id", "text", F.explode(F.filter(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail")),
            F.when(F.col("doc_id").eqNullSafe(F.col("top")),
                   F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))),
            lambda x: x.isNotNull())).alias("at"))
    return (rows.select("doc_id", "text", "at.bucket", "at.tail").repartition(n, "bucket")
            .sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text"))


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``other``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + other[:cut]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                 ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                 ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, held, own = WordHashes(), None, ""
    for batch in pieces(batches):
        out = []
        for doc, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail"))):
            if tail and held is None:
                continue  # ties of the first tail
            mark = fingerprint(text.encode(), hashes)
            if held is not None:
                new = edited(held[1], text)
                changed = fingerprint(new.encode(), hashes)
                out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), own, changed,
                            likeness(own, changed), likeness(own, mark)))
            held, own = (None if tail else (doc, text)), mark
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)


def robustness(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are found.

    Every row of ``docs`` gives one row. A null text is empty; two texts without words have
    likeness 1, one without words and another 0; repeated rows follow each other; a single
    document is its own next; an empty table gives no row; only doc_id and text are read.
    """
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return beside_next(docs).mapInArrow(_compare, schema)
