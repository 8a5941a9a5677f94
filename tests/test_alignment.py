"""Diversity, differentiation and distances against brute force over pairs."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise import storage
from sitewise.functions.sequence import harmonic
from sitewise.operators import distance as ds
from sitewise.operators import diversity as dv
from sitewise.operators import draws as dw
from sitewise.operators import haplotypes as hp
from sitewise.operators import ordination as od
from sitewise.operators import pairs as pr
from sitewise.operators import quality as ql
from sitewise.operators import structure as st
from sitewise.plans import analyses as an
from sitewise.storage import dense_index

BASES = set("ACGT")


def random_rows(seed, n=14, length=24, missing=0.02):
    rng = random.Random(seed)
    founders = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(3)]
    rows = []
    for i in range(n):
        s = "".join(rng.choice("N-RA") if rng.random() < missing * (p % 3 == 0) * 3 else
                    rng.choice("ACGT") if rng.random() < 0.05 else b for p, b in enumerate(rng.choice(founders)))
        rows.append((f"s{i}", rng.choice(["a", "b", "b", ""]), s))
    return rows + [("lone", "z", founders[0])]


def group(row):
    return row[1] or "(missing)"


def pi_of(seqs, policy):
    sites = [p for p in range(len(seqs[0])) if all(s[p] in BASES for s in seqs)]
    values = []
    for a, b in itertools.combinations(seqs, 2):
        use = sites if policy == "complete" else [p for p in range(len(a)) if a[p] in BASES and b[p] in BASES]
        if use:
            values.append(sum(a[p] != b[p] for p in use) / len(use))
    return values


def brute(seqs, policy, signatures):
    n, length = len(seqs), len(seqs[0])
    complete = [p for p in range(length) if all(s[p] in BASES for s in seqs)]
    h = lambda m: sum(1 / i for i in range(1, m))
    sites = seg = 0
    theta = 0.0
    for p in range(length):
        called = [s[p] for s in seqs if s[p] in BASES]
        if (len(called) == n) if policy == "complete" else len(called) >= 2:
            sites += 1
            if len(set(called)) > 1:
                seg += 1
                theta += 1 / h(len(called))
    diffs = [sum(a[p] != b[p] for p in complete) for a, b in itertools.combinations(seqs, 2)] if complete else []
    k = sum(diffs) / len(diffs) if diffs else None
    values = pi_of(seqs, policy)
    counts = Counter(signatures)
    s_complete = sum(len({s[p] for s in seqs}) > 1 for p in complete)
    d = None
    if n >= 2 and s_complete and k is not None:
        a1, a2 = h(n), sum(1 / i ** 2 for i in range(1, n))
        c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
        c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1 ** 2
        var = c1 / a1 * s_complete + c2 / (a1 ** 2 + a2) * s_complete * (s_complete - 1)
        d = (k - s_complete / a1) / math.sqrt(var) if var > 0 else None
    return {
        "sample_count": n, "callable_site_count": sites, "segregating_site_count": seg,
        "comparable_pair_count": len(values), "haplotype_richness": len(counts),
        "haplotype_diversity": n / (n - 1) * (1 - sum((c / n) ** 2 for c in counts.values())) if n > 1 else None,
        "nucleotide_diversity": sum(values) / len(values) if values else None,
        "watterson_theta": None if n < 2 or not sites else seg / (h(n) * sites) if policy == "complete" else theta / sites,
        "mean_pairwise_differences": k, "tajima_d": d, "tajima_callable_site_count": len(complete)}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("policy", ["complete", "pairwise"])
def test_group_diversity(make, seed, policy):
    rows = random_rows(seed)
    table = {r["label"]: r.asDict() for r in dv.group_diversity(make(rows), "grp", policy).collect()}
    everywhere = [p for p in range(len(rows[0][2])) if all(r[2][p] in BASES for r in rows)]
    sig = lambda r: "".join(r[2][p] for p in everywhere)
    groups = {"Overall": rows} | {g: [r for r in rows if group(r) == g] for g in {group(r) for r in rows}}
    assert set(table) == set(groups)
    for label, members in groups.items():
        want = brute([r[2] for r in members], policy, [sig(r) for r in members])
        for key, value in want.items():
            got = table[label][key]
            assert got == pytest.approx(value, abs=1e-12) if value is not None else got is None, (label, key)
    for label, members in groups.items():
        if label != "Overall":
            others = {sig(r) for r in rows if group(r) != label}
            assert table[label]["private_haplotype_count"] == len({sig(r) for r in members} - others)
    assert table["Overall"]["private_haplotype_count"] is None


def test_global_fst_needs_two_samples_everywhere(make):
    rows = random_rows(5)
    assert st.global_fst(make(rows), "grp").first()["global_fst"] is None
    assert st.global_fst(make(rows[:-1]), "grp").first()["global_fst"] is not None


@pytest.mark.parametrize("policy", ["complete", "pairwise"])
def test_fst_and_permutations(make, policy, monkeypatch):
    rows = random_rows(7)[:-1]
    frame = make(rows)
    groups = sorted({group(r) for r in rows})
    sites = [p for p in range(len(rows[0][2])) if all(r[2][p] in BASES for r in rows)]

    def dist(a, b):
        use = sites if policy == "complete" else [p for p in range(len(a)) if a[p] in BASES and b[p] in BASES]
        return sum(a[p] != b[p] for p in use) / len(use) if use else None

    def fst(labels):
        inside, outside = [], []
        mean = lambda v: sum(v) / len(v)
        by = {g: [r[2] for r, x in zip(rows, labels) if x == g] for g in groups}
        for g in groups:
            inside.append(mean([dist(a, b) for a, b in itertools.combinations(by[g], 2)]))
        for g, k in itertools.combinations(groups, 2):
            outside.append(mean([dist(a, b) for a in by[g] for b in by[k]]))
        return 1 - mean(inside) / mean(outside)

    observed = fst([group(r) for r in rows])
    assert st.global_fst(frame, "grp", policy).first()["global_fst"] == pytest.approx(observed)
    order = sorted(group(r) for r in rows)
    if policy == "complete":
        kind = ["".join(r[2][p] for p in sites) for r in rows]
    else:
        kind = [r[2] for r in rows]
    first = sorted({kind.index(k) for k in kind})
    units = [[i for i, k in enumerate(kind) if k == kind[f]] for f in first]
    extreme = 0
    for rep in range(1, 31):
        labels = [None] * len(rows)
        for unit, counts in zip(units, draw_by_tree([len(u) for u in units], [order.count(g) for g in groups], f"5:{rep}")):
            dealt = [g for g, c in zip(groups, counts) for _ in range(c)]
            assert len(dealt) == len(unit)
            for i, g in zip(unit, dealt):
                labels[i] = g
        assert sorted(labels) == order
        extreme += round(fst(labels), 12) >= round(observed, 12)
    for level in (12, 1):  # the second run has many blocks of two haplotypes below a common tree
        monkeypatch.setattr(dw, "BLOCK_LEVEL", level)
        got = st.permutation_test(frame, "grp", 30, 5, policy).where("statistic = 'fst'").first()
        assert (got["permutation_count"], got["extreme"]) == (30, extreme)
        assert got["p_value"] == pytest.approx((extreme + 1) / 31)


def draw_by_tree(sizes, groups, name):
    """Group counts of each haplotype, one node at a time with exact fractions."""
    out = [None] * len(sizes)

    def visit(level, node, counts):
        if level == 0:
            out[node] = counts
            return
        half = 1 << (level - 1)
        left = sizes[node * 2 * half:node * 2 * half + half]
        right = sizes[node * 2 * half + half:(node + 1) * 2 * half]
        rest, room, taken = sum(counts), sum(left), []
        for g, marked in enumerate(counts):
            low, high = max(0, room + marked - rest), min(marked, room)
            x = low
            if low < high:
                digest = md5(f"{name}:{level}:{node}:{g}".encode()).hexdigest()
                u = Fraction(2 * int(digest[:13], 16) + 1, 2 ** 53)
                chance = lambda v: Fraction(math.comb(marked, v) * math.comb(rest - marked, room - v), math.comb(rest, room))  # noqa: E731, B023
                below = chance(x)
                while below < u:
                    x += 1
                    below += chance(x)
            taken.append(x)
            rest, room = rest - marked, room - x
        visit(level - 1, 2 * node, taken)
        if right:
            visit(level - 1, 2 * node + 1, [c - x for c, x in zip(counts, taken)])

    visit((len(sizes) - 1).bit_length(), 0, list(groups))
    return out


def test_draws_are_permutations_of_labels(spark, monkeypatch):
    sizes, groups = [40, 1, 1, 2, 7, 1, 12, 1, 1, 3, 1], [("a", 30), ("b", 29), ("c", 1), ("d", 10)]
    units = spark.createDataFrame(list(enumerate(sizes, 100)), "idx long, n long")
    tables = []
    for level, cells in ((12, 1 << 22), (2, 1 << 22), (0, 1 << 22), (12, 64)):  # one block, blocks of 4, of 1, small slices
        monkeypatch.setattr(dw, "BLOCK_LEVEL", level)
        monkeypatch.setattr(dw, "CELLS", cells)
        tables.append(dw.drawn_labels(units, "idx", groups, 300, 9).toPandas().sort_values(["rep", "grp", "idx"]).reset_index(drop=True))
    table = tables[0]
    assert all(table.equals(t) for t in tables[1:])
    assert (table["n"] > 0).all() and set(table["rep"]) == set(range(1, 301))
    assert (table.groupby(["rep", "idx"])["n"].sum().unstack() == sizes).all(axis=None)
    assert (table.groupby(["rep", "grp"])["n"].sum().unstack() == [n for _, n in groups]).all(axis=None)
    # moments of the hypergeometric law: 40 of 70 samples, 30 labels "a"
    big = table[(table["idx"] == 100) & (table["grp"] == "a")]["n"]
    mean, var = 40 * 30 / 70, 40 * (30 / 70) * (40 / 70) * (30 / 69)
    assert abs(big.mean() - mean) < 4 * math.sqrt(var / 300)
    assert 0.7 * var < big.var() < 1.4 * var
    rare = table[table["grp"] == "c"]["idx"].value_counts()  # one label goes to a haplotype in proportion to its samples
    assert abs(rare[100] - 300 * 40 / 70) < 4 * math.sqrt(300 * (40 / 70) * (30 / 70))


def test_wide_draws_follow_the_hypergeometric_law():
    """A thousand quantiles of one draw from a million samples: mean, spread and order."""
    u = (np.arange(1000) + 0.5) / 1000
    n, k, m = 1_000_000, 300_000, 400_000
    x = dw.hypergeometric(*(np.full(1000, v) for v in (n, k, m)), lambda at: u[at])
    sd = math.sqrt(m * (k / n) * (1 - k / n) * (n - m) / (n - 1))
    assert (np.diff(x) >= 0).all() and abs(x.mean() - m * k / n) < 1
    assert x.std() == pytest.approx(sd, rel=0.01)
    assert dw.hypergeometric(*np.array([[5, 5, 0, 3], [0, 5, 0, 1], [2, 3, 0, 3]]), None).tolist() == [0, 3, 0, 1]


def test_permutations_without_samples_or_groups(make):
    assert [r["p_value"] for r in st.permutation_test(make([]), "grp", 5, 1).collect()] == [None, None]
    one = st.permutation_test(make([("a", "x", "ACGT"), ("b", "x", "ACGA")]), "grp", 5, 1).collect()
    assert [r["p_value"] for r in one] == [None, None]
    none = st.permutation_test(make([("a", "x", "ACGT"), ("b", "y", "ACGA")]), "grp", 0, 1).collect()
    assert [r["permutation_count"] for r in none] == [0, 0]


def test_distances_across_blocks(make, monkeypatch):
    rows = random_rows(11, n=40)
    frame = ds.distinct_sequences(make(rows))
    want = ds.p_distance(frame, 1, 0.9).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    monkeypatch.setattr(pr, "block_rows", lambda *a: 7)
    got = ds.p_distance(frame, 1, 0.9).toPandas().sort_values(["i", "j"]).reset_index(drop=True)
    assert got.equals(want)
    assert dv.pairwise_pi(make(rows), "grp").count() == 5
    seqs = {r["idx"]: r["sequence"] for r in frame.collect()}
    for r in got.itertuples():
        a, b = seqs[r.i], seqs[r.j]
        use = [p for p in range(len(a)) if a[p] in BASES and b[p] in BASES]
        assert r.valid == len(use) and r.diff == sum(a[p] != b[p] for p in use)
        assert (r.distance != r.distance) == (len(use) < math.ceil(len(a) * 0.9))


def test_mismatch_bins_sum_to_pairs(make):
    rows = random_rows(13)
    bins = dv.mismatch_distribution(make(rows), "grp").where("scope = 'overall'").collect()
    assert sum(r["pair_count"] for r in bins) == len(rows) * (len(rows) - 1) // 2
    assert sum(r["frequency"] for r in bins) == pytest.approx(1)


def test_pcoa_matches_dense_solution(make):
    rows = [(f"s{i}", "a", s) for i, s in enumerate(["ACGTACGT", "ACTTACGA", "ACGTTCGA", "GCGTTCGT", "GCGATCTA", "ACGTACGT"])]
    out = an.analyze_distance(make(rows))
    got = out["coordinates"].toPandas().pivot(index="idx", columns="axis", values="value")
    full = np.array([[sum(a != b for a, b in zip(x[2], y[2])) / 8 for y in rows] for x in rows])
    j = np.eye(6) - 1 / 6
    values, vectors = np.linalg.eigh(-0.5 * j @ full ** 2 @ j)
    spectrum = out["spectrum"].toPandas()
    assert spectrum["eigenvalue"].tolist() == pytest.approx(sorted(values, reverse=True)[:2], abs=1e-9)
    assert spectrum["explained_ratio"].tolist() == pytest.approx(
        [v / values[values > 1e-10].sum() for v in sorted(values, reverse=True)[:2]], abs=1e-9)
    want = (vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))[:5]
    for a in range(2):
        sign = np.sign(want[0, a] * got.iloc[0, a])
        assert np.allclose(got.iloc[:, a].to_numpy() * sign, want[:, a], atol=1e-6)
    assert an.sample_distances(out["pairs"], out["members"]).count() == 15


def test_distance_warnings(make, spark):
    def warned(sequences, **options):
        out = an.analyze_distance(make([(f"s{i}", "a", s) for i, s in enumerate(sequences)]), **options)
        return {r["code"] for r in out["warnings"].collect()}

    assert warned(["ACGT"]) == {"pcoa_needs_two_samples"}
    assert warned(["ACGT", "ACGT"]) == {"no_positive_axis"}
    assert warned(["ACGT", "ACGA"]) == set()
    assert warned(["ACNN", "NNGT", "ACGT"]) == {"pairs_below_coverage", "pcoa_missing_distances"}
    spectrum = spark.createDataFrame([(1, 0.01, True), (2, 0.01, False)], "axis int, negative_ratio double, converged boolean")
    rows = spark.createDataFrame([(0, 2), (1, 1)], "idx long, n long")
    summary = spark.createDataFrame([(1, 0)], "pairs long, unavailable long")
    assert {r["code"] for r in od.ordination_warnings(spectrum, rows, summary).collect()} == {"pcoa_not_converged", "non_euclidean_distances"}


def test_pcoa_has_one_definition_at_every_size(spark):
    rng = np.random.default_rng(4)
    d = np.triu(rng.random((30, 30)), 1)
    full = d + d.T
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(30) for j in range(i + 1, 30)], "i long, j long, distance double")
    rows = spark.createDataFrame([(i, 1) for i in range(30)], "idx long, n long")
    centre = np.eye(30) - 1 / 30
    values = np.linalg.eigvalsh(-0.5 * centre @ full ** 2 @ centre)
    positive, negative = values[values > 0].sum(), -values[values < 0].sum()
    got = od.pcoa(pairs, rows, max_exact=0, block=16)[1].orderBy("axis").collect()
    assert [r["eigenvalue"] for r in got] == pytest.approx(sorted(values)[:-3:-1], rel=1e-9)
    assert [r["explained_ratio"] for r in got] == pytest.approx([v / positive for v in sorted(values)[:-3:-1]], rel=1e-8)
    assert got[0]["negative_ratio"] == pytest.approx(negative / (positive + negative), rel=1e-8)
    assert all(r["converged"] and r["residual"] <= 1e-6 * got[0]["eigenvalue"] for r in got)
    few = od.pcoa(pairs, rows, rounds=2)[1].collect()
    assert few and not any(r["converged"] for r in few)


def test_ordination_of_many_rows_writes_no_centred_matrix(make, spark, tmp_path, monkeypatch):
    """Beyond ``max_exact`` rows the matrix is made from the pairs, with the same axes."""
    rows = ds.distinct_sequences(make(random_rows(17, n=40)))
    pairs = ds.p_distance(rows).select("i", "j", "distance")
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    def values(limit):
        coordinates, spectrum = od.pcoa(pairs, rows, max_exact=limit)
        return ([abs(r["value"]) for r in coordinates.orderBy("idx", "axis").collect()],
                [x for r in spectrum.orderBy("axis").collect() for x in (r["eigenvalue"], r["explained_ratio"], r["trace"])])
    got = values(0)
    assert got[0] and not list(tmp_path.glob("centred-*"))
    want = values(2000)
    assert list(tmp_path.glob("centred-*"))
    assert got[0] == pytest.approx(want[0], abs=1e-5) and got[1] == pytest.approx(want[1], rel=1e-8)


def test_absolute_spectrum_leaves_no_full_matrices(spark, tmp_path, monkeypatch):
    """Sums of absolute eigenvalues of full, deficient and indefinite matrices, without a matrix written for each round."""
    monkeypatch.setattr(od, "STRIP_BYTES", 1 << 12, raising=False)
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    rng = np.random.default_rng(6)
    for n, rank, block in ((40, 40, 7), (33, 5, 8), (64, 64, 16)):
        x = rng.standard_normal((n, rank))
        matrix = (x * rng.standard_normal(rank)) @ x.T
        ids = rng.permutation(1000)[:n]
        table = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(matrix[i, j])) for i in range(n) for j in range(n)],
                                      "i long, j long, b double")
        got = od.absolute_sum(table, n, float(np.abs(matrix).sum(axis=1).max()), block)
        assert got == pytest.approx(np.abs(np.linalg.eigvalsh(matrix)).sum(), rel=1e-8)
        assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) <= 3 * 8 * n * n
    one = spark.createDataFrame([(3, 3, -2.0)], "i long, j long, b double")
    assert od.absolute_sum(one, 1, 2.0) == pytest.approx(2.0) and od.absolute_sum(one, 1, 0.0) == 0.0


def test_no_ordination_with_missing_distance(make):
    rows = make([("a", "x", "ACGT"), ("b", "x", "NNNN"), ("c", "x", "ACGA")])
    frame = ds.distinct_sequences(rows)
    assert od.pcoa(ds.p_distance(frame), frame)[0].count() == 0


def test_edge_cases(make, spark):
    with pytest.raises(ValueError):
        an.analyze_diversity(make([("a", "x", "ACGT"), ("b", "x", "ACG")]), "grp")
    with pytest.raises(ValueError):
        an.analyze_diversity(make([("a", "x", "ACZT"), ("b", "x", "ACGT")]), "grp")
    one = dv.group_diversity(make([("a", "x", "ACGU")]), "grp").where("label = 'x'").first()
    assert one["haplotype_diversity"] is None and one["callable_site_count"] == 4
    gaps = dv.group_diversity(make([("a", "x", "--"), ("b", "x", "NN")]), "grp", "pairwise").where("label = 'x'").first()
    assert gaps["nucleotide_diversity"] is None and gaps["haplotype_richness"] == 1
    lower = ql.sample_quality(make([("a", "x", "acgun?-r")])).first()
    assert (lower["missing_count"], lower["unknown_count"], lower["gap_count"], lower["ambiguity_count"]) == (4, 2, 1, 1)


def test_u_and_t_are_different_haplotypes(make):
    haps, members = hp.identify_haplotypes(make([("a", "", "ACGT"), ("b", "", "acgu"), ("c", "", "acgt")]))
    assert {r["sample"]: r["haplotype"] for r in members.collect()} == {"a": "H1", "b": "H2", "c": "H1"}
    assert haps.count() == 2


def test_harmonic_tail(spark):
    got = spark.range(1).select(harmonic(F.lit(5000)).alias("a"), harmonic(F.lit(5000), 2).alias("b")).first()
    assert got["a"] == pytest.approx(sum(1 / i for i in range(1, 5000)), rel=1e-14)
    assert got["b"] == pytest.approx(sum(1 / i ** 2 for i in range(1, 5000)), rel=1e-14)


def test_dense_index_over_buckets(spark):
    ranks = dense_index(spark.range(0, 1000, 7).withColumnRenamed("id", "k"), "k", "r", width=16).orderBy("k").collect()
    assert [r["r"] for r in ranks] == list(range(1, len(ranks) + 1))


def test_distance_checks_count_repeated_and_missing_cells(spark):
    """Counts are those of the matrix joined with its mirror, without that join."""
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3, None]), rng.choice([0.0, 1.0, -1.0, -0.0, None, float("nan")])) for _ in range(60)]
    rows += [(8, 9, 0.5), (9, 8, 0.5), (8, 8, 0.0), (7, 6, -2.0)]
    matrix = spark.createDataFrame(rows, "row bigint, col bigint, value double")
    mirror = matrix.selectExpr("col AS row", "row AS col", "value AS m")
    want = matrix.join(mirror, ["row", "col"], "left").selectExpr(
        "count_if(NOT value <=> m)", "count_if(row = col AND NOT value <=> 0D)", "count_if(value < 0)").first()
    got = ds.validate_distances(matrix)
    assert [r["cells"] for r in got.collect()] == list(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["cells"] for r in ds.validate_distances(matrix.limit(0)).collect()] == [0, 0, 0]


def test_distance_checks_shuffle_packed_cells(spark, tmp_path, monkeypatch):
    """Cells with their mirrors take a few bytes, and give the counts of cells one by one, in whatever task they are."""
    monkeypatch.setattr(ds, "CELLS", 500, raising=False)
    rng = random.Random(9)
    rows = [(rng.randrange(9), rng.randrange(9), rng.choice([0.0, 0.5, -0.5, None, float("nan")])) for _ in range(400)]
    rows += [(r, 100 + c, v) for r, c, v in rows for r, c in ((r, c), (c, r))] + [(None, 3, -1.0), (3, None, None)]
    matrix = spark.createDataFrame(rows, "row bigint, col bigint, value double").repartition(3)
    want = ds.validate_distances(matrix.selectExpr("cast(row AS string) AS row", "cast(col AS string) AS col", "value")).collect()
    assert ds.validate_distances(matrix).collect() == want and all(r["cells"] > 0 for r in want)
    whole = spark.range(300 * 300, numPartitions=2).selectExpr("id div 300 AS a", "id % 300 AS b").where("a < b")
    sides = F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("col")), F.struct(F.col("b").alias("row"), F.col("a").alias("col")))
    cells = whole.select(F.explode(sides).alias("z"), (F.pmod(F.xxhash64("a", "b"), F.lit(50)) / 64).alias("value")).select("z.*", "value")
    checked = ds.validate_distances(cells)
    assert [r["cells"] for r in checked.collect()] == [0, 0, 0]
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "keys=[a" not in plan


def test_block_pairs_are_dealt_to_several_tasks(spark):
    rng = random.Random(3)
    made = sorted({"".join(rng.choice("ACGT") for _ in range(12)) for _ in range(200)})
    rows = spark.createDataFrame(list(enumerate(made)), "idx bigint, sequence string")
    found = pr.sequence_pairs(rows).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(found) == len(made) * (len(made) - 1) // 2 and found["task"].nunique() > 1
    assert all(d == sum(x != y for x, y in zip(made[i], made[j])) for i, j, d in zip(found["i"], found["j"], found["diff"]))
