"""Filter audit against a walk through all 120 orders, document by document."""

import re
from itertools import permutations

from sitewise.llm import audit

DOCS = "doc_id bigint, text string, lang string, mask int, part string, digest string"
LABELS = "doc_id bigint, quality int, toxic int, text string"
LONG = " ".join(f"w{k}" for k in range(250))


def documents():
    texts = [None, "", LONG, LONG, "A" * 40, "a " * 300, "a b # c", LONG + " $", LONG.upper(), "", "  \x0b x", "x" * 3_000_000,
             "word " * 400_000, LONG]
    rows = [(k, t, ["en", None, "", "de"][k % 4], 1, "p", "d") for k, t in enumerate(texts)]
    return rows + [rows[3], rows[2], (None, LONG, "en", 0, "", ""), (None, None, None, 0, "", ""), (50, LONG, "de", 0, "", "")]


def labels():
    return [(0, 1, 0, "t"), (2, 1, 1, "t"), (3, 0, 1, "t"), (3, 1, None, "t"), (5, None, 1, "t"), (7, 1, 0, "t"),
            (11, 1, 0, "t"), (50, 1, 1, "t"), (None, 1, 1, "t"), (999, 1, 1, "t")]


def brute(docs, marks):
    def fails(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                "E": doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == text for d in docs)}

    rows = [(d[2] or "", fails(d[0], d[1] or ""), any(m[0] == d[0] and m[1] == 1 for m in marks if m[0] is not None),
             any(m[0] == d[0] and m[2] == 1 for m in marks if m[0] is not None)) for d in docs]
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in frame.collect()}


def test_all_orders(spark):
    docs = spark.createDataFrame(documents(), DOCS).repartition(5)
    got = collected(audit.audit(docs, spark.createDataFrame(labels(), LABELS)))
    assert got == brute(documents(), labels())


def test_empty_tables(spark):
    none, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(none, marks).count() == 0
    docs = spark.createDataFrame(documents()[:4], DOCS)
    assert collected(audit.audit(docs, marks)) == brute(documents()[:4], [])


def test_potential_is_shapley():
    """The grand potential's differences are the mean marginal contributions of a game of four."""
    counts = {m: (m * 37) % 11 for m in range(1, 16)}
    values = audit.coalition_values(counts, 4)
    potential = audit.potentials(values, 4)
    for i in range(4):
        total = 0
        for order in permutations(range(4)):
            before = sum(1 << k for k in order[:order.index(i)])
            total += values[before | 1 << i] - values[before]
        assert potential[15] - potential[15 ^ 1 << i] == total
    assert potential[0] == 0 and sum(potential[15] - potential[15 ^ 1 << i] for i in range(4)) == 24 * values[15]
