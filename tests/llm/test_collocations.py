"""Phrase mining against brute-force counts, with small blocks and texts without any separator."""

import random
import re
from collections import Counter

import pytest
import xxhash

from sitewise.llm import collocations
from sitewise.llm.words import WordHashes

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, w1 bigint, phrase string"


def rows(seed=3):
    pick = random.Random(seed)
    vocabulary = ["the", "The", "of", "red", "fox", "é", " x", "漢字", "don't", "a"]
    texts = []
    for k in range(60):
        words = [pick.choice(vocabulary) for _ in range(pick.randrange(0, 60))]
        texts.append("".join(w + pick.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \x0b", "!?"]) for w in words))
    texts += [None, "", " . ", "the red fox " * 40, "only " * 500]
    out = [(k, t, ["en", "de", None, "und"][k % 4], "clash", 1, 2, "clash") for k, t in enumerate(texts)]
    return out + [out[1], out[-2], (None, "The Red Fox. the red fox", None, None, None, None, None)]


def brute(docs, longest=3, least=10, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        s, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if any(len(q) > len(p) and g == lang and c >= least and 100 * c >= 50 * a
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in f.items()):
            continue
        out.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    seen, want = Counter(), []
    for lang, s, a, phrase, l, r, total in out:
        seen[lang] += 1
        if seen[lang] <= top:
            want.append((lang, seen[lang], phrase.decode(), -a, l, r, total, -s))
    return want


def collected(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("block, longest, top", [(1 << 18, 3, 2000), (7, 3, 5), (40, 4, 2000)])
def test_phrases(spark, monkeypatch, block, longest, top):
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = collected(collocations.mine(docs, longest, 10, top))
    assert got == brute(rows(), longest, 10, top) and len(got) > 5


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter whose bits are nearly all set lets groups through; exact counts still decide."""
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    assert collected(collocations.mine(spark.createDataFrame(rows(), SCHEMA))) == brute(rows())


def test_colliding_hashes_take_the_next_seed(spark, monkeypatch):
    """Words that share a hash under the first seed do not share counts."""
    class Clashing(WordHashes):
        def __init__(self, seed):
            WordHashes.__init__(self)
            self.seed = seed

        def __missing__(self, word):
            clash = self.seed == 0 and word in (b"red", b"fox")
            value = self[word] = 5 if clash else xxhash.xxh3_64_intdigest(word, self.seed)
            return value

    monkeypatch.setattr(collocations, "_Hashes", Clashing)
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert collocations.occurrences(docs, 0, 3).selectExpr("explode(counted.hash) AS h").filter("h = 5").count() > 1
    relation, words = collocations.read_relation(docs, 3)
    assert words.filter("w1 = 5").count() == 0
    assert collected(collocations.mine(docs)) == brute(rows())


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine(spark.createDataFrame(rows()[:1], SCHEMA)).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 11)
    text = ("Alpha beta,gamma " * 50 + "x" * 90 + " end").encode()
    whole = [w for part in collocations.tokens(text) for w in part]
    assert whole == text.lower().replace(b",", b" . ").split() + [b"."]
    assert len(list(collocations.tokens(text))) > 20


def test_runs_of_live_windows():
    import numpy as np
    codes = np.array([1, 2, 3, 4, 5, 0, 6, 7], np.int32)
    live = np.array([True, True, False, True, False, False, True])
    out, own = collocations._runs(codes, live, 8, 2)
    assert out.tolist() == [1, 2, 3, 0, 4, 5, 0, 6, 7, 0] and own == 9
    out, own = collocations._runs(codes, live, 4, 2)
    assert out.tolist() == [1, 2, 3, 0, 4, 5, 0] and own == 5  # 4 starts a window, 5 is looked at only
