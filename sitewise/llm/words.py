"""Words, word hashes and word shingles of UTF-8 texts, for use inside tasks.

A word is a run of bytes other than space and \\x09-\\x0D, which is what ``bytes.split`` yields;
no other white space separates words. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of the words met lately; forgets all of them when it grows large."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words, in order; empty when there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * _ODD + np.uint64(k)) + hashes[k:n + k]
    return mix(out)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words give none."""
    if 0 < len(hashes) < width:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, width))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_AT_ONCE = 1 << 18


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start and their hashes: sums of mixed bytes and places, and the length."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(raw) - int((~inside).sum()), dtype=np.uint64) - np.repeat(begins, sizes).astype(np.uint64)
    keyed = mix((place << np.uint64(8)) + raw[inside] + _ODD)
    return starts, mix(np.add.reduceat(keyed, begins) + sizes.astype(np.uint64) * _ODD)


def _spans(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts, or parts of a long one cut between words, of a bounded size where words allow it."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > _AT_ONCE:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
        if len(text) > _AT_ONCE:
            at = 0
            while at < len(text):
                gap = _GAP.search(text, at + _AT_ONCE)
                yield k, [text[at:gap.start() if gap else None]]
                at = gap.start() if gap else len(text)
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """``shingles`` of the lower-cased words of each text, hashed for many texts at a time."""
    counts, parts = np.zeros(len(texts), np.int64), []
    for first, span in _spans(texts):
        starts, hashes = word_hashes(b" ".join(span).lower())
        bounds = np.cumsum([0, *(len(t) + 1 for t in span)])
        counts[first:first + len(span)] += np.diff(np.searchsorted(starts, bounds))
        parts.append(hashes)
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    windows = window_hashes(hashes, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            own = np.sort(windows[at:at + n - width + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(shingles(hashes[at:at + n], width))
        at += n
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows, so that a task holds little besides what Spark sends at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.astype(np.uint64, copy=False).view(np.int64)
