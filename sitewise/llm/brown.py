"""Brown class-based n-gram model: exchange clustering, class transitions, word emissions.

Units are what the clustering moves between classes: each of the most frequent words by itself,
the end of a text, and groups of the other words that share an ending, so every word, seen or
not, has a class that needs no look-up. Counts of words and of neighbouring units come from the
whole training corpus; the table of unit neighbours has a size fixed by the parameters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitewise.llm.words import pieces, texts_of
from sitewise.storage import cut

CLASSES = 48
FREQUENT = 2048  # words that are units of their own
ENDINGS = 511    # groups of the other words
SWEEPS = 8
LISTED = 1 << 17  # at most so many words are sent to the tasks with their counts
_ROWS = 64
_FLUSH = 1 << 18
ALPHA, DELTA = 0.5, 0.5
END = b""  # no word is empty


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def ending(word: bytes) -> int:
    """Group of a word that is no unit of its own."""
    return zlib.crc32(word[-3:] + bytes([min(len(word), 24) // 4])) % ENDINGS


_COUNT = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                           pa.array(list(counts.values()), pa.int64())], schema=_COUNT)

    for batch in pieces(batches):
        for text in texts_of(batch):
            counts.update(text.lower().split())
            counts[END] += 1
            if len(counts) > _FLUSH:
                yield packed()
                counts.clear()
    if counts:
        yield packed()


class Units(dict):
    """Unit of each word; words that are not listed get that of their ending."""

    def __init__(self, listed: list[bytes], base: int):
        super().__init__((w, k) for k, w in enumerate(listed))
        self.base, self.room = base, len(listed) + _FLUSH
        self.listed = len(listed)

    def __missing__(self, word: bytes) -> int:
        unit = self.base + ending(word)
        if len(self) < self.room:
            self[word] = unit
        return unit


def _neighbours(frequent: list[bytes]):
    units = len(frequent) + ENDINGS + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of neighbouring units of the partition, in compressed blocks of rows."""
        known = Units(frequent, len(frequent))
        end = np.array([units - 1])
        table = np.zeros(units * units, np.int64)
        for batch in pieces(batches):
            held, size = [], 0
            for text in texts_of(batch):
                words = text.lower().split()
                own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                held.append(np.append(np.append(end, own), end))
                size += len(words) + 2
                if size > 1 << 20:
                    table += _pairs(held, units)
                    held, size = [], 0
            if held:
                table += _pairs(held, units)
        table = table.reshape(units, units)
        for row in range(0, units, _ROWS):
            block = table[row:row + _ROWS]
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([row // _ROWS], pa.int32()), "counts": pa.array(
                    [zlib.compress(block.tobytes(), 1)], pa.binary())})
    return scan


def _pairs(held: list[np.ndarray], units: int) -> np.ndarray:
    every = np.concatenate(held)
    keys = every[:-1] * units + every[1:]
    # the step from the end of a text to the start of the next is none
    inside = np.ones(len(every), bool)
    inside[np.cumsum([len(h) for h in held]) - 1] = False
    return np.bincount(keys[inside[:-1]], minlength=units * units)


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
    return pd.DataFrame({"block": [group["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def exchange(table: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit: each in turn moves where the likelihood of the classes gains most.

    Units start dealt out by frequency; sweeps end early once no unit moves.
    """
    units = len(table)
    order = np.argsort(-(table.sum(0) + table.sum(1)), kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.eye(classes)[of]
    after, before = table @ member, table.T @ member  # unit by class of the next, of the previous
    joint = member.T @ after

    def h(x):
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = of[u], table[u, u]
            nxt, prv = after[u].copy(), before[u].copy()
            if not nxt.any() and not prv.any():
                continue
            nxt[a] -= own
            prv[a] -= own
            rest = joint.copy()  # without the unit
            rest[a] -= nxt
            rest[:, a] -= prv
            rest[a, a] -= own
            logs = h(rest)
            rows, cols = rest.sum(1), rest.sum(0)
            gain = (h(rest + nxt[None, :]) - logs).sum(1) + (h(rest.T + prv[None, :]) - logs.T).sum(1)
            diag = np.diagonal(rest)
            gain += (h(diag + nxt + prv + own) - h(diag + nxt) - h(diag + prv) + h(diag))
            gain -= h(rows + nxt.sum() + own) - h(rows) + h(cols + prv.sum() + own) - h(cols)
            b = int(gain.argmax())
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                of[u] = b
                after[:, a] -= table[:, u]
                after[:, b] += table[:, u]
                before[:, a] -= table[u]
                before[:, b] += table[u]
                joint = rest
                joint[b] += nxt
                joint[:, b] += prv
                joint[b, b] += own
        if not moved:
            break
    return of


@dataclass
class Model:
    """What the tasks need; every part has a size fixed by the parameters."""
    words: list[bytes]          # listed words, most frequent first
    counts: np.ndarray          # their counts
    frequent: int               # how many of them are units
    classes: np.ndarray         # class of each unit
    steps: np.ndarray           # log10 probability of a class after a class
    room: np.ndarray            # log10 of the emission total of each class
    tokens: int
    distinct: int


def train(docs: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT, listed: int = LISTED
          ) -> tuple[Model, DataFrame]:
    """The model and the table (word, c, hash) of all training words. Null texts are empty."""
    text = docs.select("text")
    seen = Observation()
    counts = text.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = cut(counts.observe(seen, F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("distinct")), "brown-counts")
    size = F.floor(8 * F.log2("c")).cast("int")
    # counts of counts on a logarithmic scale tell from which count on the words are few enough
    enough, least = 0, 1 << 62
    for row in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).toLocalIterator():
        enough += row["count"]
        if enough > listed:
            break
        least = row["size"]
    top = counts.filter((size >= least) & (F.col("word") != F.lit(END))).collect()
    top = sorted(((r["c"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
    words, amounts = [w for _, w in top], np.array([c for c, _ in top], np.int64)
    frequent = min(frequent, len(words))
    units = frequent + ENDINGS + 1
    table = np.zeros((units, units))
    blocks = (text.mapInArrow(_neighbours(words[:frequent]), "block int, counts binary")
              .groupBy("block").applyInPandas(_add_up, "block int, counts binary"))
    for row in blocks.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int64).reshape(-1, units)
        table[row["block"] * _ROWS:row["block"] * _ROWS + len(part)] = part
    of = exchange(table, classes)
    member = np.eye(classes)[of]
    joint = member.T @ table @ member
    steps = np.log10((joint + ALPHA) / (joint.sum(1, keepdims=True) + ALPHA * classes))
    # tokens and distinct words of each class; groups of endings are counted where the words are
    total = member.T @ table.sum(0)
    kinds = np.bincount(of[:frequent], minlength=classes).astype(float)
    kinds[of[-1]] += 1
    for row in _ending_sizes(counts, words[:frequent]).toLocalIterator():
        kinds[of[frequent + row["ending"]]] += row["kinds"]
    room = np.log10(total + DELTA * (kinds + 1))
    got = seen.get
    return Model(words, amounts, frequent, of, steps, room, got["tokens"] or 0, got["distinct"] or 0), counts


def _ending_sizes(counts: DataFrame, frequent: list[bytes]) -> DataFrame:
    own = set(frequent) | {END}

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                if word not in own:
                    found[ending(word)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"ending": pa.array(at, pa.int32()), "kinds": pa.array(found[at], pa.int64())})

    return (counts.select("word").mapInArrow(sizes, "ending int, kinds long")
            .groupBy("ending").agg(F.sum("kinds").alias("kinds")))


_SCORE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                    ("word", pa.int64()), ("n", pa.int32())])
_SCORE_DDL = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
              "word long, n int")


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _score(shared, ends: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what listed words give, and one for each other word of it."""
        m: Model = shared.value
        n_listed = len(m.words)
        known = Units(m.words, n_listed)
        unit_class = m.classes
        cls = np.concatenate([unit_class[:m.frequent],
                              unit_class[m.frequent + np.array([ending(w) for w in m.words[m.frequent:]], np.int64)]
                              if n_listed > m.frequent else np.zeros(0, np.int64),
                              unit_class[m.frequent:]])  # listed words, endings, end
        count = np.concatenate([m.counts, np.zeros(ENDINGS, np.int64), [ends]])
        whole = np.log10(m.tokens + m.distinct + 1.0)
        base = np.log10(count + 1.0) - whole
        emit = np.log10(count + DELTA) - m.room[cls]
        other = (np.arange(len(cls)) >= n_listed) & (np.arange(len(cls)) < len(cls) - 1)
        base[other], emit[other] = -whole, -m.room[cls[other]]
        end = np.array([len(cls) - 1])
        for batch in pieces(batches):
            docs, rest = [], []
            rows, ids, outs = (batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out"))
            for row, doc, out, text in zip(rows, ids, outs, texts_of(batch)):
                words = text.lower().split()
                at = np.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), end)
                seq = cls[np.append(end, at)]
                score = m.steps[seq[:-1], seq[1:]].sum() + emit[at].sum()
                docs.append((row, doc, out, len(at), int((count[at] > 0).sum()), float(base[at].sum()), float(score), None, None))
                strange = np.flatnonzero(other[at])
                if len(strange):
                    for word, n in Counter(words[k] for k in strange).items():
                        rest.append((row, word_key(word), n))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs), _SCORE)], schema=_SCORE)
            if rest:
                r, w, n = zip(*rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r, pa.int64()), *[pa.nulls(len(r), f.type) for f in list(_SCORE)[1:7]],
                     pa.array(w, pa.int64()), pa.array(n, pa.int32())], schema=_SCORE)
    return scan


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = batch.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([word_key(w) for w in words], pa.int64()), batch.column("c")], names=["word", "c"])


def score(docs: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT, listed: int = LISTED) -> DataFrame:
    """Log10 probability of every text under the model learnt from the documents not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams),
    score. Counts of words that are not among the ``listed`` most frequent come by a join on a
    64-bit hash of the word, as rows of (document, word, number). A null text is empty and has
    its end as only token; ties in frequency go by the word; repeated rows are scored alike; an
    empty table gives no row; with nothing to train on all words are unknown; only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model, counts = train(read.filter(~F.col("held_out")), classes, frequent, listed)
    shared = spark.sparkContext.broadcast(model)
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    scored = cut(read.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(_score(shared, ends), _SCORE_DDL),
                 "brown-scores")
    rare = counts.filter(F.col("word") != F.lit(END)).mapInArrow(_keys, "word long, c long")
    found = scored.filter("word is not null").select("row", "word", "n").join(rare, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(c + 1.0)).alias("base_more"),
        F.sum(F.col("n") * F.log10(c + DELTA)).alias("score_more"))
    return (scored.filter("n_tokens is not null").drop("word", "n").join(more, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
                    F.lit(model.tokens).cast("bigint").alias("train_tokens"),
                    (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score")))
