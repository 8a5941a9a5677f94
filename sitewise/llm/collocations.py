"""Phrase mining by set-oriented relations (SETM) and the score of a phrase's weakest cut.

The relation R1 of word occurrences is written once, in order of (piece, position). R(k) is the
merge join of R(k-1) with itself on piece and adjacent position; its groups are counted, and R(k)
is semi-joined with the frequent groups before the next length. Occurrences never leave their
block: what is shuffled are groups with their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.words import WordHashes, pieces, signed, texts_of
from sitewise.storage import cut, cut_counted, scratch_path

MIN_COUNT = 10
MAX_WORDS = 3
COVERED = (50, 100)  # a phrase goes if a longer one around it has this share of its count
BLOCK = 1 << 18      # occurrences that a task holds before it writes a block of the relation
WORDS = 1 << 16      # different words that a task counts before it sends them on
CHUNK = 1 << 20      # bytes of a text that are split at a time
ROW_GROUP = 4 << 20  # bytes of a written row group: what a reader decodes at once
# The semi-join's filter has 16 bits for each group it holds, up to this size. More groups than that
# let more occurrences pass; their counts, which are exact, still decide.
MOST_BITS = 1 << 26
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
RELATION = "lang string, own int, codes array<int>, hashes array<bigint>"


class _Hashes(WordHashes):
    """Word hashes under a seed; ``.`` stands for the end of a piece."""

    def __init__(self, seed: int):
        super().__init__(limit=WORDS)
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in lists of bounded length; ``.`` ends a piece.

    All separators become ``.``, which no word holds. Lists end at a space or at a piece's end.
    """
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            stops = [p for p in (text.find(b" ", end), text.find(b".", end)) if p >= 0]
            end = min(stops) if stops else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def _block(lang: str, entries: np.ndarray, own: int, stop: np.uint64) -> dict:
    """Block row: codes number the block's sorted hashes from 1, 0 ends a piece."""
    hashes, codes = np.unique(entries, return_inverse=True)
    breaks = np.flatnonzero(hashes == stop)
    rank = np.arange(1, len(hashes) + 1, dtype=np.int32)
    if len(breaks):
        rank[breaks[0]:] -= 1
        rank[breaks[0]] = 0
    return {"lang": lang, "own": own, "codes": rank[codes], "hashes": signed(hashes[hashes != stop])}


def _arrow(rows: list[dict], extra: pa.Array | None = None) -> pa.RecordBatch:
    def lists(name: str, kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0] + [len(r[name]) for r in rows]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[name] for r in rows]), kind))

    columns = {"lang": pa.array([r["lang"] for r in rows], pa.string()),
               "own": pa.array([r["own"] for r in rows], pa.int32()),
               "codes": lists("codes", pa.int32()), "hashes": lists("hashes", pa.int64())}
    if extra is not None:
        columns["counted"] = extra
    return pa.RecordBatch.from_pydict(columns)


def occurrences(docs: DataFrame, seed: int, longest: int) -> DataFrame:
    """R1 of ``docs`` (lang, text) as blocks of at most about ``BLOCK`` entries, and word counts.

    A block is a run of the relation in order of piece and position: ``codes`` point into
    ``hashes``, code 0 ends a piece. Only the first ``own`` entries count as starts; up to
    ``longest`` - 1 more are there to be looked at and come again in the next block, so a piece
    may be longer than a block. Rows without codes hold in ``counted`` words with their counts; a
    task sends them once it has met ``WORDS`` of them.
    """
    kind = [pa.field("word", pa.string()), pa.field("hash", pa.int64()), pa.field("n", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ahead = _Hashes(seed), longest - 1
        stop = np.uint64(hashes[b"."])
        held: dict[str, list[np.ndarray]] = {}
        sizes: Counter = Counter()
        counts: dict[str, Counter] = {}

        def block(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
            entries = np.concatenate(held[lang])
            own = len(entries) if last else len(entries) - ahead
            if own > 0:
                held[lang], sizes[lang] = [entries[own:]], len(entries) - own
                none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.struct(kind)))
                yield _arrow([_block(lang, entries, own, stop)], none)

        def words() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                counter.pop(b".", None)
                met = list(counter)
                counted = pa.StructArray.from_arrays(
                    [pa.array(met, pa.binary()).cast(pa.string()), pa.array(signed(hashes.of(met)), pa.int64()),
                     pa.array(np.fromiter(counter.values(), np.int64, len(met)), pa.int64())], fields=kind)
                nothing = {"lang": lang, "own": 0, "codes": np.zeros(0, np.int32), "hashes": np.zeros(0, np.int64)}
                yield _arrow([nothing], pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), counted))
            counts.clear()

        for batch in pieces(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                for part in tokens(text):
                    held.setdefault(lang, []).append(hashes.of(part))
                    counts.setdefault(lang, Counter()).update(part)
                    sizes[lang] += len(part)
                    if sizes.total() >= BLOCK:  # the longest run goes, so that blocks stay long
                        yield from block(max(sizes, key=sizes.get), False)
            if sum(map(len, counts.values())) >= WORDS:
                yield from words()
        for lang in list(held):
            yield from block(lang, True)
        yield from words()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
                       ).mapInArrow(read, RELATION + ", counted array<struct<word:string,hash:bigint,n:bigint>>")


def _turned(h, k: int):
    """Hash of a word at place k of a group: turned by 21 bits a place, for numpy."""
    turn = np.uint64(21 * k % 64)
    return h if not turn else (h << turn) | (h >> (np.uint64(64) - turn))


def group_key(words: list[str]) -> Column:
    """``_turned`` words of a group joined by exclusive or; as the words are hashes, nothing else is needed."""
    key = F.col(words[0])
    for k, w in enumerate(words[1:], 1):
        turn = 21 * k % 64
        key = key.bitwiseXOR(F.shiftleft(w, turn).bitwiseOR(F.shiftrightunsigned(w, 64 - turn)))
    return key


def membership(groups: DataFrame, words: list[str], n: int) -> Broadcast:
    """Bit map of the keys of ``groups``, at most ``MOST_BITS`` large, made by ``bit_or`` in Spark."""
    bits = 1 << min(max((16 * n).bit_length(), 12), MOST_BITS.bit_length() - 1)
    slot = group_key(words).bitwiseAND(bits - 1)
    at = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))
    filled = (groups.select(F.shiftright(slot, 6).alias("slot"), at.alias("bit"))
              .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas())
    table = np.zeros(bits >> 6, np.uint64)
    table[filled["slot"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    return groups.sparkSession.sparkContext.broadcast(table)


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64((len(table) << 6) - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _runs(codes: np.ndarray, live: np.ndarray, own: int, width: int) -> tuple[np.ndarray, int]:
    """Entries of maximal runs of ``live`` windows, each run ended by 0, and the new ``own``.

    Runs that begin behind ``own`` go. Every window inside a run is then live, so the next join
    needs no look at the windows; two runs that share words hold them twice.
    """
    edge = np.diff(np.concatenate(([False], live, [False])).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first, last = first[first < own], last[first < own]
    if not len(first):
        return np.zeros(0, np.int32), 0
    size = last - first + width  # width - 1 more words than windows, and the break
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size - first, size)
    out = codes[np.minimum(place, len(codes) - 1)]
    out[ends - 1] = 0
    return out, int(ends[-1] - max(int(last[-1]) + width - own, 0))


def semi_join(relation: DataFrame, frequent: Broadcast, width: int) -> DataFrame:
    """``relation`` without the windows of ``width`` words that are in no frequent group."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for lang, own, codes, hashes in _blocks(batches):
            n = len(codes) - width + 1
            if n <= 0:
                continue
            padded = np.concatenate((np.zeros(1, np.uint64), hashes.view(np.uint64)))
            whole, key = np.ones(n, bool), np.zeros(n, np.uint64)
            for k in range(width):
                part = codes[k:n + k]
                whole &= part > 0
                key ^= _turned(padded[part], k)
            live = whole & _holds(table, key)
            entries, mine = _runs(codes, live, own, width)
            if mine > 0:
                used = np.unique(entries)
                used = used[used > 0]
                renumber = np.zeros(len(padded), np.int32)
                renumber[used] = np.arange(1, len(used) + 1)
                yield _arrow([{"lang": lang, "own": mine, "codes": renumber[entries], "hashes": hashes[used - 1]}])

    return relation.mapInArrow(keep, RELATION)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        codes, hashes = batch.column("codes"), batch.column("hashes")
        for k in range(batch.num_rows):
            yield (batch.column("lang")[k].as_py(), batch.column("own")[k].as_py(),
                   codes[k].values.to_numpy(zero_copy_only=False), hashes[k].values.to_numpy(zero_copy_only=False))


def group_counts(relation: DataFrame, width: int, least: int) -> DataFrame:
    """Groups (lang, w1 ... w``width``, n) of adjacent words with at least ``least`` occurrences.

    In a block, entry i joins entry i + 1 while neither ends a piece: a merge join on position,
    as the relation is sorted. Blocks send their groups with counts, which combine once more
    inside each task. Words are told apart by hashes proven distinct for this corpus (``mine``).
    """
    names = [f"w{k + 1}" for k in range(width)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own, codes, hashes in _blocks(batches):
            n = min(len(codes) - width + 1, own)
            if n <= 0:
                continue
            start = np.flatnonzero(np.logical_and.reduce([codes[k:n + k] > 0 for k in range(width)]))
            group, sample = codes[start].astype(np.int64), start
            for k in range(1, width):
                _, sample, group, total = np.unique(group * (len(hashes) + 1) + codes[start + k], return_index=True,
                                                    return_inverse=True, return_counts=True)
            if len(start):
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(sample), np.int32))),
                    **{w: hashes[codes[start[sample] + k] - 1] for k, w in enumerate(names)}, "n": total.astype(np.int64)})

    rows = relation.mapInArrow(count, "lang string, " + ", ".join(f"{w} bigint" for w in names) + ", n bigint")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def write_relation(relation: DataFrame, label: str) -> DataFrame:
    """``cut`` with small row groups: a row is a whole block, and a reader takes a row group at a time."""
    path = scratch_path(relation.sparkSession, label)
    relation.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return relation.sparkSession.read.schema(relation.schema).parquet(path)


def read_relation(docs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """R1 and the words (lang, word, w1, n) of the corpus, under hashes without a collision.

    Should two words share a hash, or a word share that of the piece's end, the next seed is taken.
    """
    for seed in numbers():
        relation = write_relation(occurrences(docs, seed, longest), "phrase-r1")
        words = cut(relation.select("lang", F.explode("counted").alias("c"))
                    .groupBy("lang", "c.word", F.col("c.hash").alias("w1")).agg(F.sum("c.n").alias("n")), "phrase-words")
        stop = int(signed(np.array([_Hashes(seed)[b"."]], np.uint64))[0])
        twice = words.groupBy("w1").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter(
            (F.col("a") != F.col("b")) | (F.col("w1") == stop))
        if twice.isEmpty():
            return relation.where("own > 0").select("lang", "own", "codes", "hashes"), words


def frequent_groups(docs: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT
                    ) -> tuple[DataFrame, dict[int, DataFrame]]:
    """All words, and for each length the groups with at least ``least`` occurrences per language."""
    relation, words = read_relation(docs, longest)
    groups, n = cut_counted(words.filter(F.col("n") >= least), "phrase-groups")
    found, n, held = {1: groups}, n[0], []
    for width in range(2, longest + 1):
        frequent = membership(found[width - 1], _names(width - 1), n)
        relation, held = semi_join(relation, frequent, width - 1), [*held, frequent]
        if width > 2:  # R1 is written already and its semi-join with the words is quick
            relation, held = write_relation(relation, f"phrase-r{width - 1}"), _destroyed(held)
        found[width], (n, _) = cut_counted(group_counts(relation, width, least), "phrase-groups")
    _destroyed(held)
    return words, found


def _destroyed(broadcasts: list[Broadcast]) -> list[Broadcast]:
    for b in broadcasts:
        b.destroy()
    return []


def _names(width: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, first + width)]


def _lookup(rows: DataFrame, groups: DataFrame, at: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``value`` of the group that its words ``at`` form in the same language."""
    keys = _names(len(at))
    side = groups.select("lang", *[F.col(k).alias(w) for k, w in zip(keys, at)], F.col(value).alias(out))
    return rows.join(side, ["lang", *at])


def scored(found: dict[int, DataFrame], width: int) -> DataFrame:
    """Candidates of one length with the figures of their lowest-scoring cut.

    floor(1000000 * a * a / (l * r)) is a whole-number division of decimals of 38 digits, exact for
    counts below 10**15. A tie after flooring goes to the smallest cut.
    """
    words, rows = _names(width), found[width].withColumnRenamed("n", "a")
    for k in range(1, width):
        rows = _lookup(rows, found[k], words[:k], "n", f"l{k}")
        rows = _lookup(rows, found[width - k], words[k:], "n", f"r{k}")
    exact = "CAST({} AS DECIMAL(15,0))".format
    cuts = [F.struct(F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {exact('a')} * {exact('a')}) div "
                            f"({exact(f'l{k}')} * {exact(f'r{k}')})").alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]
    lowest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return rows.select("lang", *words, "a", lowest.alias("cut")).select("lang", *words, "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, found: dict[int, DataFrame], width: int, share: tuple[int, int] = COVERED) -> DataFrame:
    """Candidates of one length without those that a longer candidate around them mostly accounts for."""
    words = _names(width)
    around = [found[longer].select("lang", *[F.col(f"w{s + k}").alias(w) for k, w in enumerate(words, 1)], "n")
              for longer in found if longer > width for s in range(longer - width + 1)]
    if not around:
        return candidates
    every = around[0]
    for more in around[1:]:
        every = every.unionByName(more)
    most = every.groupBy("lang", *words).agg(F.max("n").alias("most"))
    part, whole = share
    return (candidates.join(most, ["lang", *words], "left")
            .filter(whole * F.coalesce("most", F.lit(0)) < part * F.col("a")).drop("most"))


def mine(docs: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score, then count, then byte order.

    Columns lang, rank, phrase, a, l, r, n, score. Reads lang and text of ``docs``; other columns
    cannot clash. A null text is empty and a null lang is ``und``; repeated rows count again; an
    empty table gives no row. Texts are split a megabyte at a time, pieces of any length included.
    """
    words, found = frequent_groups(docs, longest, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = []
    for width in range(2, longest + 1):
        rows = uncovered(scored(found, width), found, width)
        for w in _names(width):
            rows = _lookup(rows, found[1], [w], "word", f"{w}_word")
        phrases.append(rows.select("lang", F.concat_ws(" ", *[f"{w}_word" for w in _names(width)]).alias("phrase"),
                                   "a", "l", "r", "score"))
    every = phrases[0]
    for more in phrases[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                            F.col("score").cast("bigint").alias("score"))
