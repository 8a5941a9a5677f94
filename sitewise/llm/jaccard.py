"""N-gram Jaccard join by blocked products of the document by n-gram incidence matrix.

A document is its set of word shingles, a node is a distinct set. Columns are put in order of an
estimated frequency, rare first; two sets that are similar enough share a column among the first
``n - ceil(t n) + 1`` of each, so only those entries are stored and multiplied. Long columns are
cut into blocks of rows. A first product meets each column with one row of it, which joins most
of a group of near copies; the second takes the pairs of different components only. Pairs below
the bounds given by set sizes, positions and bit maps are discarded; the overlap of the others is
counted on their whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.words import SHINGLE, mix, pieces, shingle_sets, signed, texts_of
from sitewise.operators.graph import component_labels
from sitewise.storage import cut, cut_counted, small_batches

PERCENT = 80
SKETCH_BITS = 22  # counters of the frequency sketch: 4 MB in each task, whatever the input
_PART = 1 << 16
BITMAP = 512
BLOCK_ROWS = 4096
_SEEN = 1 << 18
FILTER_BITS = 23
_ROWS = 512  # texts that a task holds as words and shingles at a time


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """Identity of each set of shingles: a 63-bit hash of its sorted members, -1 for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets), -1, np.int64)
    if sizes.any():
        key = mix(np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(sizes, sizes).astype(np.uint64))
        some = sizes > 0
        sums = np.add.reduceat(key, (np.cumsum(sizes) - sizes)[some])
        out[some] = (mix(sums) >> np.uint64(1)).astype(np.int64)
    return out


def text_key(docs: DataFrame) -> Column:
    """Hash of a text as it stands, which a scan can repeat without Python."""
    return F.xxhash64(docs["text"])


def body_of(text: bytes) -> int:
    """Key of a lower-cased text, far cheaper than its set."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def bitmaps_of(sets: list[np.ndarray]) -> list[bytes | None]:
    """Parity bit maps: two maps differ in at most as many bits as the sets have different members."""
    sizes = [len(s) for s in sets]
    if not sum(sizes):
        return [None] * len(sets)
    at = (mix(np.concatenate(sets)) & np.uint64(BITMAP - 1)).astype(np.int64) + BITMAP * np.repeat(np.arange(len(sets)), sizes)
    counts = np.bincount(at, minlength=BITMAP * len(sets)).reshape(len(sets), BITMAP)
    packed = np.packbits((counts & 1).astype(np.uint8), axis=1)
    return [row.tobytes() if n else None for row, n in zip(packed, sizes)]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct sets are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


_MEMBER = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()),
                     ("body", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_MEMBER_DDL = "doc_id long, node long, n long, bits binary, body long, key long, part int, counts binary"


def _members(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and, at the end, the counters of the partition."""
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in pieces(batches, _ROWS):
            texts = [t.lower() for t in texts_of(batch)]
            if not texts:
                continue
            sets = shingle_sets(texts, width)
            np.add.at(counts, np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), 1)
            rows = (batch.column("doc_id"), nodes_of(sets), [len(s) for s in sets], bitmaps_of(sets),
                    [body_of(t) for t in texts], batch.column("key"), *([[None] * len(texts)] * 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _MEMBER)], schema=_MEMBER)
        for part in range(0, len(counts), _PART):
            if counts[part:part + _PART].any():
                packed = zlib.compress(counts[part:part + _PART].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (None, None, None, None, None, None, part // _PART, packed), _MEMBER)], schema=_MEMBER)
    return scan


def _level(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_PART, np.int64)
    for packed in part["counts"]:
        total += np.frombuffer(zlib.decompress(packed), np.int32)
    level = np.ceil(4 * np.log2(total + 1)).astype(np.uint8)
    return pd.DataFrame({"part": [part["part"].iloc[0]], "levels": [level.tobytes()]})


def frequency_levels(parts: DataFrame) -> np.ndarray:
    """Sketch of column frequencies on a logarithmic scale, of fixed size."""
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    summed = parts.groupBy("part").applyInPandas(_level, "part int, levels binary")
    for row in summed.toLocalIterator():
        levels[row["part"] * _PART:(row["part"] + 1) * _PART] = np.frombuffer(row["levels"], np.uint8)
    return levels


def prefix(cols: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest columns of a set, enough to meet every set that is similar enough."""
    own = levels[cols >> np.uint64(64 - SKETCH_BITS)]
    return cols[np.lexsort((cols, own))][:len(cols) - -(-percent * len(cols) // 100) + 1]


_ENTRY = pa.schema([("col", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("pos", pa.int32()),
                    ("n", pa.int32()), ("node", pa.int64())])
_ENTRY_DDL = "col long, block int, blocks int, pos int, n int, node long"


def _entries(levels: Broadcast, width: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, _ROWS):
            out: list[list[np.ndarray]] = [[] for _ in _ENTRY]
            sets = shingle_sets(texts_of(batch), width)
            for cols, node in zip(sets, nodes_of(sets).tolist()):
                if not len(cols) or node in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                head = prefix(cols, levels.value, percent)
                size = 2.0 ** (levels.value[head >> np.uint64(64 - SKETCH_BITS)] / 4)
                blocks = np.ceil(size / BLOCK_ROWS).astype(np.int64)
                for k, v in enumerate((signed(head), node % blocks, blocks, np.arange(len(head)),
                                       np.full(len(head), len(cols)), np.full(len(head), node))):
                    out[k].append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(out, _ENTRY)], schema=_ENTRY)
    return scan


def within_bounds(na, nb, pos_a, pos_b, percent: int):
    """Whether sizes and positions of the first common column leave room for enough overlap."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    most = np.minimum(na - pos_a, nb - pos_b)
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (na + nb))


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), *_ENTRY])
_FOUND_DDL = "kind int, a long, b long, " + _ENTRY_DDL
EDGE, CENTRE, SHARED = 0, 1, 2


def _stars(percent: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted entries of whole (column, block) runs; only the first of a run is remembered.

        Gives edges from the first row of a run to the others, the first rows of columns with
        several blocks, and all entries of runs with two or more rows.
        """
        held: np.ndarray | None = None
        names = [f.name for f in _ENTRY]
        held_shown = False
        for batch in batches:
            new = np.array([batch.column(c).to_numpy().astype(np.int64) for c in names])
            if held is not None:
                new = np.concatenate([held, new], axis=1)
            col, block, blocks, pos, n, node = new
            same = (col[1:] == col[:-1]) & (block[1:] == block[:-1])
            keep = np.append(True, ~(same & (node[1:] == node[:-1])))
            new = new[:, keep]
            col, block, blocks, pos, n, node = new
            start = np.append(True, ~((col[1:] == col[:-1]) & (block[1:] == block[:-1])))
            first = np.maximum.accumulate(np.where(start, np.arange(len(col)), 0))
            several = ~start | np.append(~start[1:], False)
            centre = start & (blocks > 1)
            if held_shown:
                several[0] = False
            if held is not None:
                centre[0] = False
            edge = ~start & (node != node[first]) & within_bounds(n, n[first], pos, pos[first], percent)
            out = []
            for kind, mask in ((EDGE, edge), (CENTRE, centre), (SHARED, several)):
                k = int(mask.sum())
                ends = (node[first][mask], node[mask]) if kind == EDGE else (np.zeros(k, np.int64),) * 2
                out.append([np.full(k, kind), *ends, *new[:, mask]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)
            last = first[-1]
            held_shown = bool(last == 0 and held_shown) or len(col) - 1 > last
            held = new[:, last:last + 1]
    return stream


def _runs(entries: DataFrame, percent: int) -> DataFrame:
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (entries.repartition(n, "col", "block").sortWithinPartitions("col", "block", "pos", "node")
            .mapInArrow(_stars(percent), _FOUND_DDL))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _products(percent: int):
    def multiply(run: dict[str, np.ndarray], seen: set) -> tuple[list, list]:
        tag, node, n, pos, comp = (run[c] for c in ("tag", "node", "n", "pos", "comp"))
        bits = np.frombuffer(b"".join(run["bits"]), np.uint64).reshape(len(node), -1)
        crossing = run["i"][0] != run["j"][0]
        left, right = [], []
        for x in range(len(node)):
            y = np.arange(x + 1, len(node))
            ok = (comp[y] != comp[x]) & within_bounds(n[y], n[x], pos[y], pos[x], percent)
            if crossing:
                ok &= tag[y] != tag[x]
            y = y[ok]
            if not len(y):
                continue
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
            y = y[(100 + percent) * apart <= (100 - percent) * (n[y] + n[x])]
            for other in node[y]:
                pair = (min(node[x], other), max(node[x], other))
                if pair not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(pair)
                    left.append(pair[0])
                    right.append(pair[1])
        return left, right

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted entries; a run of one column and pair of blocks is multiplied when it is complete."""
        rest: pd.DataFrame | None = None
        seen: set = set()
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            key = rows[["col", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            for begin, end in zip(starts[:-1], starts[1:]):
                if end - begin > 1:
                    got = multiply({c: rows[c].to_numpy()[begin:end] for c in rows}, seen)
                    if got[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], schema=_PAIR)
            rest = rows.iloc[starts[-1]:]
        if rest is not None and len(rest) > 1:
            got = multiply({c: rest[c].to_numpy() for c in rest}, seen)
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], schema=_PAIR)
    return stream


def _filter_bits(bodies: DataFrame) -> np.ndarray:
    """Bit map of bodies, of fixed size; passes every one of them and, in a large input, others."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column("body").to_numpy() & ((1 << FILTER_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])

    def union(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for packed in group["bits"]:
            bits |= np.frombuffer(zlib.decompress(packed), np.uint8)
        return pd.DataFrame({"bits": [bits.tobytes()]})

    parts = bodies.mapInArrow(part, "bits binary")
    rows = parts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(union, "bits binary").collect()
    return (np.unpackbits(np.frombuffer(rows[0]["bits"], np.uint8)).astype(bool) if rows
            else np.zeros(1 << FILTER_BITS, bool))


_TEXT = pa.schema([("body", pa.int64()), ("text", pa.binary())])


def _bodies(wanted: Broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mask = set(), (1 << FILTER_BITS) - 1
        for batch in pieces(batches):
            out = []
            for text in texts_of(batch):
                text = text.lower()
                body = body_of(text)
                if wanted.value[body & mask] and body not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(body)
                    out.append((body, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TEXT)], schema=_TEXT)
    return scan


def _overlaps(width: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = None, None
        for batch in pieces(batches, _ROWS):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            new = [k for k in range(len(a)) if a[k] != (a[k - 1] if k else last)]
            left = dict(zip(new, shingle_sets([x[k] for k in new], width)))
            out = []
            for k, right in enumerate(shingle_sets(y, width)):
                kept = left.get(k, kept)
                if linked(kept, right, percent):
                    out.append((a[k], b[k]))
            last = a[-1] if a else last
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_PAIR)
    return scan


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar enough.

    A scan passes the texts that may be asked for; a join on their keys keeps those that are.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = cut(members.join(nodes, "node").groupBy("node").agg(F.min("body").alias("body")), "jaccard-asked")
    wanted = spark.sparkContext.broadcast(_filter_bits(asked.select("body")))
    bodies = (docs.select("text").mapInArrow(_bodies(wanted), "body long, text binary")
              .join(asked, "body").groupBy("node").agg(F.first("text").alias("body")))
    bodies = cut(bodies, "jaccard-bodies")
    both = (pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
            .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b"))
    return cut(both.select("a", "b", "x", "y").mapInArrow(_overlaps(width, percent), "a long, b long"), "jaccard-links")


def similar_sets(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``members`` (doc_id, key, node, n) of all rows of ``docs``, ``key`` being a hash of the text,
    and ``labels`` (node, label) of the nodes that have a link; nodes of one component have one label."""
    with small_batches(docs.sparkSession):
        return _similar_sets(docs, width, percent)


def _similar_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    read = docs.select("doc_id", "text")
    scanned = cut(read.withColumn("key", text_key(read)).mapInArrow(_members(width), _MEMBER_DDL), "jaccard-members")
    members = scanned.filter("part is null").select("doc_id", "node", "n", "bits", "body", "key")
    levels = spark.sparkContext.broadcast(frequency_levels(scanned.filter("part is not null").select("part", "counts")))
    entries = read.select("text").mapInArrow(_entries(levels, width, percent), _ENTRY_DDL)
    found = cut(_runs(entries, percent), "jaccard-columns")
    entry = [f.name for f in _ENTRY]
    hubs = _runs(found.filter(F.col("kind") == CENTRE).select(*entry).withColumn("block", F.lit(0)), percent)
    stars = cut(found.filter(F.col("kind") == EDGE).select("a", "b").unionAll(
        hubs.filter(F.col("kind") == EDGE).select("a", "b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-stars")
    links = _verified(docs, members, stars, width, percent)
    labels = component_labels(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    shared = (found.filter((F.col("kind") == SHARED) | ((F.col("kind") == CENTRE) & (F.col("blocks") > 1)))
              .select(*entry).join(labels, "node", "left")
              .withColumn("comp", F.coalesce("label", "node")).drop("label"))
    shared = cut(shared.dropDuplicates(["col", "node"]), "jaccard-shared")
    open_columns = shared.groupBy("col").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    bits = members.filter("n > 0").select("node", "bits").dropDuplicates(["node"])
    rest = (shared.join(open_columns.select("col"), "col", "left_semi").join(bits, "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("col", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    F.col("block").alias("tag"), "node", "n", "pos", "comp", "bits"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = (rest.repartition(n, "col", "i", "j").sortWithinPartitions("col", "i", "j")
             .mapInArrow(_products(percent), "a long, b long").distinct())
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = _verified(docs, members, pairs, width, percent)
    every = links.unionAll(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return members.select("doc_id", "key", "node", "n"), component_labels(every)


def components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links. Equal sets are one node, so
    copies are never paired. A null text or one without words has no shingle and is linked with
    nothing; null ids stay null unless a document with an id is reachable; repeated rows each
    get their row; an empty table gives no row; only doc_id and text are read.
    """
    members, labels = similar_sets(docs, width, percent)
    placed = members.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    lowest = placed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("lowest"))
    return (placed.join(lowest, "comp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns; rows without shingles all stay.

    The row with the smallest doc_id stays, null ids last; of rows that share this id (or have
    none) the one with the smallest hash of its text. Ids are not looked at otherwise: an id that
    occurs with texts of several components keeps a row in each where it is the smallest. Rows
    equal in id and text count once, and any one of them stays.
    """
    members, labels = similar_sets(docs, width, percent)
    placed = members.filter("n > 0").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    rows = cut(placed.groupBy("comp", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies")), "jaccard-rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    judged = rows.join(first, "comp").select(
        F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "copies",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("stays"))
    drop = cut(judged.filter("not stays or copies > 1"), "jaccard-drop")
    again, (repeated, _) = cut_counted(drop.filter("stays").select("__doc", "__key"), "jaccard-again")

    def same(other: DataFrame):
        return docs["doc_id"].eqNullSafe(other["__doc"]) & (text_key(docs) == other["__key"])

    kept = docs.join(drop, same(drop), "left_anti")
    if not repeated:
        return kept
    names = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.join(again, same(again), "inner").groupBy("__doc", "__key").agg(F.first(F.struct(*names)).alias("row"))
    return kept.unionByName(one.select("row.*"))
