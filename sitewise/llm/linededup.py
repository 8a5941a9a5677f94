"""Line deduplication by a join of deletion neighbourhoods.

Lines are compared as sequences of words. Two lines are near if one word changed, added or left
out turns one into the other. Deleting each word in turn gives the variants of a line; near lines
share a variant, and the earliest of them is kept. Half of a line is untouched by one edit, so
only lines that share a half with a different line have variants emitted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.words import pieces, texts_of
from sitewise.storage import cut, small_batches

NEAR_WORDS = 5     # shorter lines are compared for equality only
FILTER_BITS = 26   # slots of each filter: 8 MB in each task
_MASK = (1 << FILTER_BITS) - 1


def key_of(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of halves such that lines one edit apart share one.

    Class m compares lines of m and m + 1 words: by their first m // 2 words and by as many at
    the end as are left of m.
    """
    out = []
    for m in (len(words), len(words) - 1):
        if m >= NEAR_WORDS:
            h = m // 2
            out += [key_of(b"%d\0p\0%b" % (m, b" ".join(words[:h]))),
                    key_of(b"%d\0s\0%b" % (m, b" ".join(words[len(words) - (m - h):])))]
    return out


def keys_of(words: list[bytes]) -> list[int]:
    return half_keys(words) or [key_of(b" ".join(words))]


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word sequences is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    skip = (k + (len(a) >= len(b)), k + (len(b) >= len(a)))
    return a[skip[0]:] == b[skip[1]:]


class Twice:
    """Bit maps of the slots hit once and twice."""

    def __init__(self):
        self.once, self.twice = (np.zeros(_MASK + 1 >> 3, np.uint8) for _ in range(2))

    def add(self, keys: list[int]) -> None:
        slot, times = np.unique(np.array(keys, np.int64) & _MASK, return_counts=True)
        bit = (1 << (slot & 7)).astype(np.uint8)
        np.bitwise_or.at(self.twice, slot >> 3, bit * ((times > 1) | (self.once[slot >> 3] & bit > 0)))
        np.bitwise_or.at(self.once, slot >> 3, bit)


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Twice()
    for batch in pieces(batches):
        keys: list[int] = []
        for text in texts_of(batch):
            for line in text.split(b"\n"):
                if words := line.split():
                    keys += keys_of(words)
            if len(keys) > 1 << 18:
                seen.add(keys)
                keys = []
        if keys:
            seen.add(keys)
    if seen.once.any():
        yield pa.RecordBatch.from_pydict({c: pa.array([zlib.compress(v.tobytes(), 1)], pa.binary()) for c, v in (
            ("once", seen.once), ("twice", seen.twice))})


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    whole = Twice()
    for a, b in zip(group["once"], group["twice"]):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        whole.twice |= b | (whole.once & a)
        whole.once |= a
    return pd.DataFrame({c: [zlib.compress(v.tobytes(), 1)] for c, v in (("once", whole.once), ("twice", whole.twice))})


def _bit_map(parts: DataFrame, column: str) -> np.ndarray:
    """Partial filters added up in two steps; what reaches the driver has a fixed size."""
    ddl = "once binary, twice binary"
    some = parts.withColumn("g", F.pmod(F.monotonically_increasing_id() / (1 << 33), F.lit(16)).cast("int"))
    some = some.groupBy("g").applyInPandas(_combine, ddl).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_combine, ddl)
    rows = some.collect()
    return (np.frombuffer(zlib.decompress(rows[0][column]), np.uint8) if rows else np.zeros(_MASK + 1 >> 3, np.uint8))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Twice()
    for batch in batches:
        if batch.num_rows:
            seen.add(batch.column("full").to_numpy())
    if seen.once.any():
        yield pa.RecordBatch.from_pydict({c: pa.array([zlib.compress(v.tobytes(), 1)], pa.binary()) for c, v in (
            ("once", seen.once), ("twice", seen.twice))})


_LINE = pa.schema([("full", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("line", pa.int32()),
                   ("halves", pa.list_(pa.int64()))])


def _passing(twice: Broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that may equal or be near another."""
        bits = twice.value.tobytes()  # indexing bytes is faster than indexing an array
        for batch in pieces(batches):
            out = []
            for doc, sub, text in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), texts_of(batch)):
                for number, line in enumerate(text.split(b"\n")):
                    if words := line.split():
                        halves = half_keys(words)
                        full = None if halves else key_of(b" ".join(words))
                        for k in halves or (full,):
                            if bits[(k & _MASK) >> 3] >> (k & 7) & 1:
                                out.append((key_of(b" ".join(words)) if full is None else full, doc, sub, number, halves))
                                break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LINE)], schema=_LINE)
    return scan


def _bodies(wanted: Broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value.tobytes(), set()
        for batch in pieces(batches):
            out = {}
            for text in texts_of(batch):
                for line in text.split(b"\n"):
                    words = line.split()
                    if len(words) >= NEAR_WORDS:
                        body = b" ".join(words)
                        key = key_of(body)
                        if bits[(key & _MASK) >> 3] >> (key & 7) & 1 and key not in seen:
                            if len(seen) > 1 << 19:
                                seen.clear()
                            seen.add(key)
                            out[key] = body
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())],
                                                 names=["full", "body"])
    return scan


_VARIANT = pa.schema([("key", pa.int64()), ("shorter", pa.bool_()), ("place", pa.int64())])


def variants(words: list[bytes]) -> list[tuple[int, bool]]:
    """Hashed keys of the deletion neighbourhood and whether the key is that of a deleted word's rest.

    A rest together with its place meets lines that differ in that word. A rest alone meets the
    whole lines that lack the word.
    """
    n, body, at, out = len(words), b" ".join(words), 0, []
    for k, word in enumerate(words):
        end = at + len(word) + 1
        rest = body[:at] + body[end:] if end <= len(body) else body[:max(at - 1, 0)]
        out.append((key_of(b"s\0%d\0%d\0%b" % (n, k, rest)), False))
        if n > NEAR_WORDS:
            out.append((key_of(b"d\0" + rest), True))
        at = end
    out.append((key_of(b"d\0" + body), False))
    return out


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = []
        for place, body in zip(*(batch.column(c).to_pylist() for c in ("place", "body"))):
            out += [(key, shorter, place) for key, shorter in variants(body.split(b" "))]
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _VARIANT)], schema=_VARIANT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _VARIANT)], schema=_VARIANT)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        place = [p for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("place", "body", "other_body")))
                 if one_edit(a.split(b" "), b.split(b" "))]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64())], names=["place"])


def removed_lines(read: DataFrame) -> DataFrame:
    """(doc, sub, line) of every line that equals or is near an earlier one.

    Earlier is by doc, then sub, then line. Copies of a line are reduced to the first inside
    tasks, and so are the lines with one variant, so neither a common line nor a common pattern
    is ever paired with itself.
    """
    with small_batches(read.sparkSession):
        return _removed_lines(read)


def _removed_lines(read: DataFrame) -> DataFrame:
    spark = read.sparkSession
    text = read.select("text")
    twice = spark.sparkContext.broadcast(_bit_map(text.mapInArrow(_met_twice, "once binary, twice binary"), "twice"))
    lines = cut(read.mapInArrow(_passing(twice), "full long, doc long, sub long, line int, halves array<long>"), "line-keys")
    order = F.struct("doc", "sub", "line")
    firsts = cut(lines.groupBy("full").agg(F.min(order).alias("at"), F.first("halves").alias("halves")), "line-firsts")
    halves = firsts.select("full", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("full").alias("low"), F.max("full").alias("high")).filter("low < high")
    near = (halves.join(shared.select("half"), "half", "left_semi").select("full").distinct()
            .join(firsts.select("full", "at.*"), "full"))
    # a sorted table's increasing ids stand for lines and their order in all that follows
    near = cut(near.orderBy("doc", "sub", "line", "full").select("full", F.monotonically_increasing_id().alias("place")),
               "line-candidates")
    wanted = spark.sparkContext.broadcast(_bit_map(near.select("full").mapInArrow(_slots, "once binary, twice binary"), "once"))
    bodies = cut(text.mapInArrow(_bodies(wanted), "full long, body binary").join(near, "full").dropDuplicates(["full"]),
                 "line-bodies")
    emitted = cut(bodies.mapInArrow(_neighbourhoods, "key long, shorter boolean, place long"), "line-variants")
    best = emitted.groupBy("key").agg(F.min(F.when(~F.col("shorter"), F.col("place"))).alias("whole"),
                                      F.min(F.when(F.col("shorter"), F.col("place"))).alias("rest"), F.count(F.lit(1)).alias("n"))
    met = emitted.join(best.filter("n > 1").drop("n"), "key").select("place", F.explode(F.when(
        F.col("shorter"), F.array("whole")).otherwise(F.array("whole", "rest"))).alias("other"))
    pairs = met.filter("other < place").distinct()
    checked = (pairs.join(bodies.select("place", "body"), "place")
               .join(bodies.select(F.col("place").alias("other"), F.col("body").alias("other_body")), "other"))
    gone = (checked.select("place", "body", "other_body").mapInArrow(_verify, "place long").distinct()
            .join(near, "place").select("full"))
    verdict = firsts.select("full", F.col("at").alias("first")).join(gone.withColumn("gone", F.lit(True)), "full", "left")
    return (lines.join(verdict, "full").filter(F.col("gone").isNotNull() | (order != F.col("first")))
            .select("doc", "sub", "line"))


_KEPT = "kept binary, n_lines int, n_removed int, n_left int"


def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, gone in parts:
        rows = []
        for text, numbers in zip(texts, gone):
            lines = (text or b"").split(b"\n")
            drop = set() if numbers is None else set(numbers.tolist())
            left = [x for k, x in enumerate(lines) if k not in drop] if drop else lines
            n_lines = sum(map(bool, map(bytes.strip, lines)))
            rows.append((b"\n".join(left), n_lines, len(drop), n_lines - len(drop)))
        yield pd.DataFrame(rows, columns=["kept", "n_lines", "n_removed", "n_left"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``__lines``: kept (text left), n_lines (with words),
    n_removed, n_left.

    Lines without words stay and are not counted. A null text is empty. Null ids come last; rows
    that repeat an id go by a hash of their text, and equal rows with one id are one document,
    judged alike. An empty table gives no row. All columns of ``docs`` stay; the texts are
    shuffled once, to meet the numbers of their removed lines.
    """
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__sub")]
    read = docs.select("text", key[0].alias("doc"), key[1].alias("sub"))
    gone = (removed_lines(read).groupBy(F.col("doc").alias("__doc"), F.col("sub").alias("__sub"))
            .agg(F.collect_set("line").alias("__gone")))
    without = F.pandas_udf(_without, _KEPT).asNondeterministic()
    return (docs.select("*", *key).join(gone, ["__doc", "__sub"], "left")
            .select(*[F.col(f"`{c}`") for c in docs.columns],
                    without(F.col("text").cast("binary"), F.col("__gone")).alias("__lines")))


def keep_earliest(docs: DataFrame) -> DataFrame:
    """Documents with the lines that stay; those that had words and have none left go."""
    out = dedup_lines(docs).filter("__lines.n_lines = 0 or __lines.n_left > 0").withColumn(
        "text", F.when(F.col("text").isNotNull(), F.col("__lines.kept").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
