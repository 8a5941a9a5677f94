"""Line-first quality rules: bad lines go first, then documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.words import WordHashes, window_hashes

# Symbols of the base rules, end marks and separators, phrases of page furniture.
SYMBOLS = b"#*$%&|<>"
END_MARKS = tuple(m.encode() for m in (".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "”", "’", "»", "“"))
SEPARATORS = tuple(m.encode() for m in ("|", "»", "›", "•", "·", " > ", " / ", "::"))
BOILERPLATE = (
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
    "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "click here", "sign in", "log in", "subscribe to our", "share this", "read more", "enable javascript",
    "skip to content", "back to top", "datenschutzerklärung", "mentions légales", "política de privacidad",
)
MIN_WORDS, MAX_REPEATED = 50, 50
FRAGMENT_WORDS, MIN_LETTERS, MIN_KEPT = 4, 0.5, 0.5
FURNITURE_PART = 6  # phrases of page furniture make up one word of so many at least

_ANY = "|".join(re.escape(p) for p in BOILERPLATE)
_BOILERPLATE = re.compile(_ANY.encode(), re.IGNORECASE)
_PHRASE = re.compile(rf"(?<![^\W\d_])(?:{_ANY})(?![^\W\d_])", re.IGNORECASE)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"
_ASCII_OTHER = bytes(c for c in range(128) if not chr(c).isalpha())

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_bad_lines long, n_kept_words long, cleaned binary")


def furniture_words(line: bytes) -> int:
    """Words in phrases of page furniture that have no letter right before or after them."""
    if not _BOILERPLATE.search(line):
        return 0
    return sum(len(p.split()) for p in _PHRASE.findall(line.decode("utf-8", "replace")))


def line_verdict(line: bytes, words: list[bytes]) -> str:
    """Rule that a line with words breaks, or ''.

    navigation: three or more separators with four words or fewer between them on average;
    boilerplate: a sixth of the words or more are in phrases of page furniture; symbols: under half
    of the characters are letters;
    punctuation: four words or fewer without an end mark.
    """
    seps = sum(line.count(s) for s in SEPARATORS)
    if seps >= 3 and len(words) <= 5 * (seps + 1):
        return "navigation"
    found = furniture_words(line)
    if found and FURNITURE_PART * found >= len(words):
        return "boilerplate"
    packed = line.translate(None, _SPACE + _CONTINUATION)
    if len(packed.translate(None, _ASCII_OTHER)) < MIN_LETTERS * len(packed):
        return "symbols"
    if len(words) <= FRAGMENT_WORDS and not line.rstrip(_SPACE).endswith(END_MARKS):
        return "punctuation"
    return ""


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window found twice or more, its first place included."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k:len(windows) + k] |= twice
    return int(covered.sum())


def judge(text: bytes, hashes: WordHashes) -> tuple:
    """The values of ``FIELDS`` for one text."""
    words = text.split()
    seen: set[bytes] = set()
    good: list[bytes] = []
    dup = lines = bad = left = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_verdict(line, own):
            bad += 1
        else:
            good.append(line)
            left += len(own)
    repeated = repeated_words(hashes.of(words))
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    return (len(words), len(text.translate(None, _SPACE + _CONTINUATION)),
            len(text) - len(text.translate(None, SYMBOLS)), dup, repeated, failed,
            not failed and left >= MIN_KEPT * len(words), lines, bad, left, b"\n".join(good))


def _judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes, names = WordHashes(), [f.split()[0] for f in FIELDS.split(", ")]
    for texts in parts:
        yield pd.DataFrame([judge(t or b"", hashes) for t in texts], columns=names)


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``__quality`` of ``FIELDS``; one pass, no shuffle.

    A null text counts as empty, has no words and fails; repeated rows are judged alike; an empty
    table gives no row; every column of ``docs`` stays, and names cannot clash with the struct.
    """
    # not deterministic in Spark's sense, so that a filter on the verdict does not run it again
    judged = F.pandas_udf(_judged, FIELDS).asNondeterministic()
    return docs.select("*", judged(F.col("text").cast("binary")).alias("__quality"))


def clean(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with the text of their good lines and ``n_chars`` to match."""
    judged = assess(docs).filter("__quality.kept").withColumn("text", F.col("__quality.cleaned").cast("string"))
    if "n_chars" in docs.columns:
        judged = judged.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns])
