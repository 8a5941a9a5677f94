"""Removal of repeated passages by suffix arrays over shards of anchored text.

Every window of ``LENGTH`` bytes names an anchor, the smallest hash among its grams, which
depends on the bytes of the window alone: equal windows have equal anchors, wherever they are.
The bytes of the neighbouring windows with one anchor are a segment. Segments meet at their
anchor's hash; equal ones are reduced to the earliest. Shards of different segments are sorted as
suffix arrays, common prefixes find windows that occur twice, and an anchor whose segments fill
several shards is merged across them by binary search.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.words import mix, pieces, texts_of
from sitewise.storage import cut

LENGTH = 100
GRAM = 32
FILTER_BITS = 27   # slots of the filter for anchors met twice: 16 MB in each task
_PART = 1 << 20
SHARD_BYTES = 1 << 20
MERGE_ROWS = 1 << 16
_POS = 20          # a key holds the position within a chunk in its low bits
_CHUNK = 1 << _POS
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, _CHUNK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the bytes of every window of ``width``, from running sums."""
    sums = np.cumsum(_TABLE[data] * _UP[:len(data)], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    return mix((sums[width:] - sums[:-width]) * _DOWN[:len(data) - width + 1])


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, start and end (exclusive) of the segments of a text, chunk by chunk."""
    for begin in range(0, max(0, len(text) - length + 1), _CHUNK - length + 1):
        data = np.frombuffer(text[begin:begin + _CHUNK], np.uint8)
        low = np.uint64(_CHUNK - 1)
        keys = (gram_hashes(data, gram) & ~low) | np.arange(len(data) - gram + 1, dtype=np.uint64)
        span, done = length - gram + 1, 1
        while done < span:  # smallest key of ever longer runs
            step = min(done, span - done)
            keys = np.minimum(keys[:-step], keys[step:])
            done += step
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = np.append(first[1:], len(keys))
        yield keys[first] >> np.uint64(_POS), first + begin, last - 1 + begin + length


# --- anchors that occur twice -------------------------------------------------------------------

def _met_twice(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(1 << FILTER_BITS >> 3, np.uint8) for _ in range(2))
        for batch in pieces(batches):
            for text in texts_of(batch):
                for anchor, _, _ in segments(text, length, gram):
                    slot, times = np.unique(anchor & np.uint64((1 << FILTER_BITS) - 1), return_counts=True)
                    slot = slot.astype(np.int64)
                    bit = (1 << (slot & 7)).astype(np.uint8)
                    np.bitwise_or.at(twice, slot >> 3, bit * ((times > 1) | (once[slot >> 3] & bit > 0)))
                    np.bitwise_or.at(once, slot >> 3, bit)
        for part in range(0, len(once), _PART >> 3):
            piece = once[part:part + (_PART >> 3)]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part // (_PART >> 3)], pa.int32()), **{
                    c: pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())
                    for c, v in (("once", piece), ("twice", twice[part:part + (_PART >> 3)]))}})
    return scan


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    once, twice = (np.zeros(_PART >> 3, np.uint8) for _ in range(2))
    for a, b in zip(group["once"], group["twice"]):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"part": [group["part"].iloc[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})


def anchor_filter(read: DataFrame, length: int, gram: int) -> np.ndarray:
    """Bit map of fixed size that passes every anchor met twice and, the fuller it is, others."""
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    merged = (read.select("text").mapInArrow(_met_twice(length, gram), "part int, once binary, twice binary")
              .groupBy("part").applyInPandas(_combine, "part int, twice binary"))
    for row in merged.toLocalIterator():
        at = row["part"] * (_PART >> 3)
        bits[at:at + (_PART >> 3)] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return bits


_SEGMENT = pa.schema([("anchor", pa.int64()), ("body", pa.binary()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int64())])
_SEGMENT_DDL = "anchor long, body binary, doc long, sub long, start long"


def _segments(twice: Broadcast, length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc, sub, text in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), texts_of(batch)):
                for anchor, start, end in segments(text, length, gram):
                    slot = (anchor & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    for k in np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1):
                        out.append((int(anchor[k]), text[start[k]:end[k]], doc, sub, int(start[k])))
                if len(out) > 20_000:
                    yield _batch(out, _SEGMENT)
                    out = []
            if out:
                yield _batch(out, _SEGMENT)
    return scan


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- suffix arrays ------------------------------------------------------------------------------

def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols.

    Larsson-Sadakane refinement: ranks by the first h symbols are refined by the ranks h places
    on, in groups that still have several suffixes only; h doubles.
    """
    n = len(data)
    width = 7
    padded = np.append(data.astype(np.int64), np.zeros(width, np.int64))
    packed = np.zeros(n, np.int64)
    for k in range(width):
        packed = packed << 9 | padded[k:n + k]
    order = np.argsort(packed, kind="stable")
    lead = np.append(True, packed[order[1:]] != packed[order[:-1]])
    place = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = place, -1
    h = width
    while h < depth:
        single = lead & np.append(lead[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        own = order[at]
        nxt = rank[np.minimum(own + h, n)]
        by = np.lexsort((nxt, rank[own]))
        order[at] = own[by]
        group, nxt = rank[own][by], nxt[by]
        lead[at] = np.append(True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1]))
        place = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        rank[order] = place
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in order with the one before it (first: 0).

    Kasai's bound: in text order, a common prefix is at least the last one less one. Pairs whose
    preceding symbols agree are therefore known from the pair before them; only the others are
    compared, all together.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (data[:-1] == data[np.maximum(before[1:], 1) - 1])
    start = np.flatnonzero(~follows & (before >= 0))
    size = np.zeros(len(start), np.int64)
    going, k = np.arange(len(start)), 0
    padded = np.append(data, [-1])
    while len(going):
        a, b = start[going] + k, before[start[going]] + k
        going = going[(padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)]
        k += 1
        size[going] = k
    known = np.zeros(n, np.int64)
    known[start] = size
    lead = np.maximum.accumulate(np.where(follows, 0, i))
    known = np.maximum(known[lead] - (i - lead), 0)
    return np.minimum(known[order], most)


class Shard:
    """Different segments of one or several anchors, gathered until they fill a suffix array."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[1]) + 1

    def windows(self, length: int) -> tuple[np.ndarray, ...]:
        """For each window of the shard: its segment, its offset, a number equal windows share,
        and whether an equal window of the shard is earlier."""
        sizes = np.array([len(r[1]) for r in self.rows])
        data = np.full(self.size, 256, np.int64)  # 256 ends a segment
        bounds = np.cumsum(sizes + 1) - sizes - 1
        joined = np.frombuffer(b"".join(r[1] for r in self.rows), np.uint8)
        inside = np.ones(self.size, bool)
        inside[bounds + sizes] = False
        data[inside] = joined
        order = suffix_array(data, length)
        # unlike ends of segments must not agree
        marked = data.copy()
        marked[~inside] = 256 + np.arange(len(sizes))
        equal = common_prefixes(marked, order, length) >= length
        segment = np.repeat(np.arange(len(sizes)), sizes + 1)
        offset = np.arange(self.size) - bounds[segment]
        valid = offset[order] + length <= sizes[segment[order]]
        number = np.cumsum(~equal)[valid]
        seg, off = segment[order][valid], offset[order][valid]
        doc, sub, start = (np.array([r[k] for r in self.rows], np.int64) for k in (2, 3, 4))
        first = np.lexsort((start[seg] + off, sub[seg], doc[seg], number))
        seg, off, number = seg[first], off[first], number[first]
        later = np.append(False, number[1:] == number[:-1])
        return seg, off, number, later


_DONE = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                   ("anchor", pa.int64()), ("window", pa.int64()), ("shard", pa.int64())])
_DONE_DDL = "kind int, doc long, sub long, start long, end long, anchor long, window long, shard long"
REMOVED, WINDOW = 0, 1


def _resolve(shard: Shard, length: int, split: bool, number: int) -> Iterator[pa.RecordBatch]:
    """Removed stretches of a shard; for an anchor that goes on in other shards, its windows too."""
    if len(shard.rows) < 2 and not split:
        return
    seg, off, _, later = shard.windows(length)
    doc, sub, start = (np.array([r[k] for r in shard.rows], np.int64) for k in (2, 3, 4))
    s, o = seg[later], off[later]
    by = np.lexsort((o, s))
    s, o = s[by], o[by]
    if len(s):
        lead = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1))
        last = np.append(np.flatnonzero(lead)[1:], len(s)) - 1
        k = len(last)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, REMOVED, np.int32)), *map(pa.array, (
            doc[s[lead]], sub[s[lead]], start[s[lead]] + o[lead], start[s[last]] + o[last] + length)),
            *[pa.nulls(k, pa.int64())] * 3], schema=_DONE)
    if split:
        s, o = seg[~later], off[~later]
        hashes = np.array([int.from_bytes(hashlib.blake2b(shard.rows[a][1][b:b + length], digest_size=8).digest(), "little", signed=True)
                           for a, b in zip(s, o)], np.int64)
        k = len(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, WINDOW, np.int32)), *map(pa.array, (
            doc[s], sub[s], start[s] + o, start[s] + o + length, np.full(k, shard.rows[0][0], np.int64), hashes,
            np.full(k, number, np.int64)))], schema=_DONE)


def _shards(length: int, shard_bytes: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted segments. Repeats of a segment go whole; an anchor's different ones go to a shard."""
        shard, group, last, split, number = Shard(), Shard(), None, False, 0
        for batch in pieces(batches):
            gone = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "body", "doc", "sub", "start"))):
                if last is not None and row[0] == last[0] and row[1] == last[1]:
                    gone.append((REMOVED, row[2], row[3], row[4], row[4] + len(row[1]), None, None, None))
                    continue
                if last is not None and row[0] != last[0]:
                    if split:
                        yield from _resolve(group, length, True, number)
                        number += 1
                    elif len(group.rows) > 1:
                        for r in group.rows:
                            shard.add(r)
                    group, split = Shard(), False
                    if shard.size >= shard_bytes:
                        yield from _resolve(shard, length, False, number)
                        shard, number = Shard(), number + 1
                elif group.size >= shard_bytes:
                    yield from _resolve(group, length, True, number)
                    group, split, number = Shard(), True, number + 1
                last = row
                group.add(row)
            if gone:
                yield _batch(gone, _DONE)
        if split:
            yield from _resolve(group, length, True, number)
        elif len(group.rows) > 1:
            for r in group.rows:
                shard.add(r)
        if shard.rows:
            yield from _resolve(shard, length, False, number + 1)
    return stream


def _merge_shards(part: pd.DataFrame) -> pd.DataFrame:
    """Windows of one anchor from several shards: each shard's sorted windows are looked up by
    binary search among those merged so far; the later of two equal ones is removed."""
    ranked = part.sort_values(["doc", "sub", "start"]).reset_index(drop=True)
    keys, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
    later = np.zeros(len(ranked), bool)
    for _, own in ranked.groupby("shard", sort=True):
        order = np.argsort(own["window"].to_numpy(), kind="stable")
        mine, at = own["window"].to_numpy()[order], own.index.to_numpy()[order]
        found = np.searchsorted(keys, mine)
        hit = np.zeros(len(mine), bool) if not len(keys) else keys[np.minimum(found, len(keys) - 1)] == mine
        old = place[found[hit]]
        later[np.maximum(old, at[hit])] = True
        place[found[hit]] = np.minimum(old, at[hit])
        keys, place = np.insert(keys, found[~hit], mine[~hit]), np.insert(place, found[~hit], at[~hit])
    return ranked.loc[later, ["doc", "sub", "start", "end"]]


def repeated(read: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stretches (doc, sub, start, end) of bytes to remove; they may overlap."""
    spark = read.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = spark.sparkContext.broadcast(anchor_filter(read, length, gram))
    found = (read.mapInArrow(_segments(twice, length, gram), _SEGMENT_DDL)
             .repartition(n, "anchor").sortWithinPartitions("anchor", "body", "doc", "sub", "start"))
    done = cut(found.mapInArrow(_shards(length, shard_bytes), _DONE_DDL), "substring-shards")
    windows = done.filter(F.col("kind") == WINDOW)
    parts = windows.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / MERGE_ROWS).alias("parts"))
    merged = (windows.join(parts, "anchor").withColumn("part", F.pmod("window", "parts"))
              .groupBy("anchor", "part").applyInPandas(_merge_shards, "doc long, sub long, start long, end long"))
    return done.filter(F.col("kind") == REMOVED).select("doc", "sub", "start", "end").unionAll(merged)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("spans").to_pylist()):
            kept, at, removed, runs = [], 0, 0, 0
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if start > at or not runs:
                    kept.append(text[at:start])
                    runs += 1
                    removed += end - start
                    at = end
                elif end > at:
                    removed += end - at
                    at = end
            kept.append(text[at:])
            out.append((doc, len(text), removed, runs, b"".join(kept)))
        if out:
            yield _batch(out, _KEPT)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes left).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document
    with a smaller id or before it in the same one; strings are judged on the input. A null text
    is empty and loses nothing; null ids come last; rows that repeat an id go by a hash of their
    text, and equal rows with one id are one document, judged alike; an empty table gives no row;
    only doc_id and text are read.
    """
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sub")]
    read = docs.select("text", *key)
    once = read.filter(F.octet_length("text") >= length)
    spans = (repeated(once, length).distinct().groupBy("doc", "sub")
             .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    return (docs.select("doc_id", "text", *key).join(spans, ["doc", "sub"], "left")
            .select("doc_id", "text", "spans").mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
