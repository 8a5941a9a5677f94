"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import os

import pytest

import corpus_pipeline
from sitewise.llm import quality
from sitewise.llm.words import WordHashes

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(f"file://{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    assert all(k.columns == columns for k in kept[:-1])
    tables = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]
    hashes = WordHashes()
    judged = {d: quality.judge((r.text or "").encode(), hashes) for d, r in tables[0].items()}
    assert {d: j[-1].decode() for d, j in judged.items() if j[6]} == {d: r.text for d, r in tables[1].items()}

    from test_operators import brute_components, brute_lines, words
    gone = brute_lines([(d, r.text) for d, r in tables[1].items()])
    want = {}
    for d, r in tables[1].items():
        lines = r.text.split("\n")
        left = [x for k, x in enumerate(lines) if k not in gone.get(d, ())]
        if any(words(x) for x in left) or not words(r.text):
            want[d] = "\n".join(left)
    assert want == {d: r.text for d, r in tables[2].items()}
    low = brute_components([(d, r.text) for d, r in tables[2].items()])
    assert {d for d, (n, c) in low.items() if n == 0 or c == d} == set(tables[3])
    copies = kept[4].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in copies} <= set(tables[3]) and max(r["count"] for r in copies) <= 3
    packed = kept[5].collect()
    assert sum(r.n_words for r in packed) == sum(len(words(r.text)) for r in kept[4].collect())
