"""Audit of how document filters overlap: what each order removes and what each filter is worth.

All figures of all orders are differences of one set function: v(S), the number of documents that
at least one filter of the coalition S removes. One scan leaves a bit mask of failed filters per
document; counts per mask (at most 2**n for each part) are all that the rest works on.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.storage import cut

_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = ("docs", "good", "toxic")
COLUMNS = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
           "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text without nulls: short, repetitive, upper case, symbols."""
    trimmed = F.btrim(text, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    count = F.size(words).cast("bigint")
    return {
        "A": count < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * count,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """Rows (doc_id, part, mask): bit k of ``mask`` is set if the document fails filter ABCDE[k].

    The texts are read once; a digest of 256 bits stands for them from there on. A document fails
    E if its text occurs under a smaller doc_id, that is, if (digest, doc_id) is not the digest's
    smallest id. The smallest ids combine before the shuffle and are joined on digest *and* id, so
    a text that a third of the table repeats is never one group.

    A null text is the empty text and a null part the empty string. Rows without doc_id neither
    fail E nor make others fail it; a row repeated under one id does not fail E by itself.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(text_rules(text).values())),
               F.lit(0))
    facts = cut(docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
                            bits.alias("mask")), "audit-facts")
    known = facts.filter(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = known.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"))
    return judged.unionByName(facts.filter(F.col("doc_id").isNull()).select("doc_id", "part", "mask"))


def count_masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, docs, good, toxic); ``good`` has quality 1 and ``toxic`` toxic 1 in labels.

    An id that is labelled twice counts as good (toxic) if any of its labels says so.
    """
    marks = labels.groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(n)
          for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # rows without an id have no label: they skip the join, where they would meet in one task
    everyone = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"))
    labelled = failed.join(marks, "doc_id").groupBy("part", "mask").agg(
        F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in MEASURES]
    return everyone.join(labelled, ["part", "mask"], "left").select("part", "mask", *zero)


def coalition_values(counts: dict[int, int], n: int) -> list[int]:
    """v(S) for every coalition S (a bit mask): how many documents fail a filter of S."""
    return [sum(c for mask, c in counts.items() if mask & s) for s in range(1 << n)]


def potentials(values: list[int], n: int) -> list[int]:
    """n! times the Hart-Mas-Colell potential of every coalition of the removal game.

    P(empty) = 0 and P(S) = (v(S) + sum over i in S of P(S - i)) / |S|. n! P(S) is a whole number,
    because |S|! P(S) is one.
    """
    scale, out = factorial(n), [0] * (1 << n)
    for s in range(1, 1 << n):  # every S - i is a smaller number than S
        members = [i for i in range(n) if s >> i & 1]
        out[s] = (scale * values[s] + sum(out[s ^ 1 << i] for i in members)) // len(members)
    return out


def step_rows(part: str, counts: pd.DataFrame, names: str) -> Iterable[tuple]:
    """All orders and steps of one part, from at most 2**n counts."""
    n = len(names)
    everyone = (1 << n) - 1
    values = {m: coalition_values(dict(zip(counts["mask"].tolist(), counts[m].tolist())), n) for m in MEASURES}
    total, removed_by, potential = int(counts["docs"].sum()), values["docs"], potentials(values["docs"], n)
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = removed_by[after] - removed_by[before]
            yield (part, "".join(names[k] for k in order), step, total - removed_by[after], gone,
                   removed_by[1 << i] - gone, removed_by[everyone] - removed_by[everyone ^ 1 << i],
                   *[values[m][after] - values[m][before] for m in ("good", "toxic")],
                   potential[everyone] - potential[everyone ^ 1 << i])
            before = after


def interactions(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What every order of the filters ``names`` does at every step, for each part.

    ``counts`` are ``count_masks`` rows: a group holds at most 2**n of them, whatever the corpus.
    ``shapley`` is n! times the Shapley value of the step's filter: the grand potential minus the
    potential without it. An empty table has no parts and gives no row.
    """
    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(step_rows(key[0], rows, names), columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return counts.groupBy("part").applyInPandas(of_part, COLUMNS)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over all of ``docs``.

    Reads doc_id, text and ``part`` of docs and doc_id, quality and toxic of labels; other columns
    cannot clash. Very long texts are judged whole. Nulls, ties and repeated rows: see ``failures``.
    """
    return interactions(count_masks(failures(docs, part), labels))
