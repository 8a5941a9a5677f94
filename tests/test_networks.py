"""Networks and topology against brute force."""

import itertools
import math
import random
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from sitewise import storage
from sitewise.operators import blocks, graph, scan
from sitewise.operators import distance as ds
from sitewise.operators import mergetree as mt
from sitewise.operators import network as nw
from sitewise.operators import pairs as pr
from sitewise.operators import topology as tp
from sitewise.operators.graph import component_labels, shortest_paths, spanning_forest
from sitewise.plans import analyses as an
from sitewise.sources import tables as tb
from sitewise.storage import scratch_path


def components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v, *_ in edges:
            low = min(label[u], label[v])
            if label[u] != low or label[v] != low:
                label[u] = label[v] = low
                changed = True
    return label


def kruskal(nodes, edges, key):
    root = {n: n for n in nodes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    out = []
    for e in sorted(edges, key=key):
        a, b = find(e[0]), find(e[1])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(e)
    return out


def random_nodes(spark, seed, n=25):
    rng = random.Random(seed)
    seqs = sorted({"".join(rng.choice("ACGT") if rng.random() < 0.3 else "A" for _ in range(10)) for _ in range(n)})
    return seqs, spark.createDataFrame(list(enumerate(seqs)), "idx bigint, sequence string")


@pytest.mark.parametrize("epsilon", [0, 1])
@pytest.mark.parametrize("block", [1000, 6])
def test_spanning_network(spark, monkeypatch, epsilon, block):
    monkeypatch.setattr(pr, "block_rows", lambda *a: block)
    seqs, frame = random_nodes(spark, 3)
    edges = [(i, j, sum(x != y for x, y in zip(a, b))) for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2)]
    want = set()
    for u, v, d in edges:
        label = components(range(len(seqs)), [e for e in edges if e[2] < d - epsilon])
        if label[u] != label[v]:
            want.add((u, v, d))
    got = {tuple(r) for r in nw.spanning_network(frame, epsilon).collect()}
    assert got == want


def test_spanning_network_of_one_or_none(spark):
    frame = spark.createDataFrame([(7, "ACGT")], "idx bigint, sequence string")
    assert nw.spanning_network(frame).collect() == []
    assert nw.spanning_network(frame.limit(0)).collect() == []


def test_ship_once(spark):
    for _ in range(2):
        storage.ship(spark)
        assert sum(f.endswith("/sitewise.zip") for f in spark.sparkContext.listFiles) == 1


@pytest.mark.parametrize("seed, n, extra", [(1, 30, 0.0), (2, 24, 0.2), (3, 40, 0.05)])
def test_merge_tree_brute(spark, seed, n, extra):
    """Chains, ties and several components: heights of every pair and runs of every threshold."""
    rng = random.Random(seed)
    chain = [(i, i + 1, rng.randint(1, 6)) for i in range(n - 1) if rng.random() < 0.93]
    edges = chain + [(u, v, rng.randint(1, 6)) for u, v in itertools.combinations(range(n), 2) if rng.random() < extra]
    frame = spark.createDataFrame(edges, "u bigint, v bigint, d bigint")
    order = [(r["node"], r["height"]) for r in mt.merge_order(frame).orderBy("pos").collect()]
    assert sorted(x for x, _ in order) == sorted({x for e in edges for x in e[:2]})
    links = {r["node"]: (r["up"], r["height"]) for r in mt.merge_links(frame).collect()}
    for level in range(7):
        label = components(range(n), [e for e in edges if e[2] <= level])
        for i, (a, _) in enumerate(order):
            met = 0
            for b, height in order[i + 1:]:
                met = max(met, height)
                assert (met <= level) == (label[a] == label[b])
        top = {}
        for a, _ in order:
            x = a
            while x in links and links[x][1] <= level:
                x = links[x][0]
            assert top.setdefault(label[a], x) == x


def test_random_frequency(spark):
    seqs, frame = random_nodes(spark, 4)
    network = nw.spanning_network(frame)
    edges = [tuple(r) for r in network.collect()]
    want = defaultdict(int)
    for rep in range(1, 21):
        draw = lambda n: md5(f"9:{rep}:{n}".encode()).hexdigest()  # noqa: B023, E731
        for u, v, _ in kruskal(range(len(seqs)), edges, lambda e: (e[2], *sorted((draw(e[0]), draw(e[1]))))):
            want[u, v] += 1
    got = {(r["u"], r["v"]): r["count"] for r in nw.random_mst_frequency(network, 20, 9).collect()}
    assert got == dict(want)


def test_random_frequency_of_any_network(spark):
    """Loops inside contracted ends never count, edges alone in their class always do; several components."""
    rng = random.Random(6)
    pairs = [e for e in itertools.combinations(range(26), 2) if rng.random() < 0.12 and (e[0] < 13) == (e[1] < 13)]
    edges = [(u, v, rng.randint(1, 4)) for u, v in pairs] + [(30, 31, 2)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint, distance bigint")
    want = defaultdict(int)
    for rep in range(1, 13):
        draw = lambda n: md5(f"5:{rep}:{n}".encode()).hexdigest()  # noqa: B023, E731
        for u, v, _ in kruskal(range(32), edges, lambda e: (e[2], *sorted((draw(e[0]), draw(e[1]))))):
            want[u, v] += 1
    assert {(r["u"], r["v"]): r["count"] for r in nw.random_mst_frequency(frame, 12, 5).collect()} == dict(want)
    settled, tied = nw.tie_classes(frame)
    always = {(r["u"], r["v"]) for r in settled.collect()}
    assert (30, 31) in always and all(want[e] == 12 for e in always)
    assert {(r["u"], r["v"]) for r in tied.collect()} >= {e for e, n in want.items() if n < 12}
    assert nw.random_mst_frequency(frame.limit(0), 3, 1).collect() == []


def test_spanning_forest_weight(spark):
    rng = random.Random(8)
    edges = [(u, v, rng.randint(1, 5)) for u, v in itertools.combinations(range(30), 2) if rng.random() < 0.15]
    frame = spark.createDataFrame([(0, u, v, w, u, v) for u, v, w in edges], "g int, u bigint, v bigint, w int, a bigint, b bigint")
    got = {(r["u"], r["v"]) for r in spanning_forest(frame, ["g"], ["w", "a", "b"]).collect()}
    assert got == {(u, v) for u, v, _ in kruskal(range(30), edges, lambda e: (e[2], e[0], e[1]))}


def test_inclusion_network_brute(spark, make):
    rng = random.Random(2)
    rows = [("ref", "", "A" * 12)] + [(f"s{i}", "", "".join("C" if rng.random() < p else "A" for _ in range(12)))
                                      for i, p in enumerate([0.1, 0.2, 0.3, 0.5, 0.6] * 5)]
    net = an.build_network(make(rows), "inclusion")
    seq = {r["idx"]: r for r in net["nodes"].collect()}
    muts = {i: {p for p, b in enumerate(r["sequence"]) if b == "C"} for i, r in seq.items()}
    for r in net["edges"].collect():
        child = muts[r["child"]]
        options = [(-len(m), -seq[i]["n"], i) for i, m in muts.items() if m < child]
        assert r["parent"] == min(options)[2] and r["distance"] == len(child) - len(muts[r["parent"]])
    assert net["edges"].count() == len(seq) - 1


def random_graph(seed, n=18):
    rng = random.Random(seed)
    edges = [(u, v, float(rng.randint(1, 2))) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.1]
    return [(i, *e) for i, e in enumerate(edges)]


@pytest.mark.parametrize("seed, wide", [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 1)])
def test_topology_brute(spark, seed, wide):
    """Blocks in tasks and, with ``wide`` 1, all blocks that are no bridges by joins."""
    n = 18
    edges = random_graph(seed, n)
    nodes_df = spark.createDataFrame([(i, "", 1.0) for i in range(n)], "node_id bigint, label string, frequency double")
    edges_df = spark.createDataFrame(edges, "edge_index bigint, source bigint, target bigint, distance double")
    plain = [e[1:] for e in edges]
    label = components(range(n), plain)
    order = {c: k + 1 for k, c in enumerate(sorted(set(label.values())))}
    got = {r["node_id"]: r["component"] for r in tp.connected_components(nodes_df, edges_df).collect()}
    assert got == {v: order[c] for v, c in label.items()}
    inf = float("inf")
    d = [[0.0 if i == j else inf for j in range(n)] for i in range(n)]
    for _, u, v, w in edges:
        d[u][v] = d[v][u] = w
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    paths = shortest_paths(nodes_df, edges_df)
    assert {(r["src"], r["node"]): r["dist"] for r in paths.collect()} == {
        (i, j): d[i][j] for i in range(n) for j in range(n) if d[i][j] < inf}
    structure = blocks.decompose(edges_df)
    scores = blocks.block_scores(structure, block_edges=wide)
    close = {r["node_id"]: r["closeness"] for r in tp.closeness(nodes_df, structure, scores).collect()}
    for i in range(n):
        reach = [x for j, x in enumerate(d[i]) if j != i and x < inf]
        assert close[i] == pytest.approx(len(reach) / sum(reach) * len(reach) / (n - 1) if reach else 0.0)
    count = [[0] * n for _ in range(n)]
    for s in range(n):
        count[s][s] = 1
        for v in sorted((x for x in range(n) if x != s and d[s][x] < inf), key=lambda x: d[s][x]):
            count[s][v] = sum(count[s][a] for _, u, t, w in edges for a, b in ((u, t), (t, u)) if b == v and abs(d[s][a] + w - d[s][v]) < 1e-9)
    node, edge = tp.betweenness(nodes_df, edges_df, structure, scores)
    want = [sum(count[s][v] * count[v][t] / count[s][t] for s in range(n) for t in range(n)
                if len({s, v, t}) == 3 and d[s][t] < inf and abs(d[s][v] + d[v][t] - d[s][t]) < 1e-9) / ((n - 1) * (n - 2)) for v in range(n)]
    assert [r["betweenness"] for r in node.orderBy("node_id").collect()] == pytest.approx(want)
    for r in edge.collect():
        _, u, v, w = edges[r["edge_index"]]
        total = sum(count[s][a] * count[b][t] / count[s][t] for s in range(n) for t in range(n) for a, b in ((u, v), (v, u))
                    if d[s][t] < inf and s != t and abs(d[s][a] + w + d[b][t] - d[s][t]) < 1e-9)
        assert r["betweenness"] == pytest.approx(total / (n * (n - 1)))
    bridges, points = blocks.cut_points(structure)
    size = len(order)
    assert {r["edge_index"] for r in bridges.collect()} == {
        e[0] for e in edges if len(set(components(range(n), [x[1:] for x in edges if x[0] != e[0]]).values())) > size}
    assert {r["node_id"] for r in points.collect()} == {
        v for v in range(n) if any(v in e[1:3] for e in edges) and
        len(set(components([x for x in range(n) if x != v], [e[1:] for e in edges if v not in e[1:3]]).values())) > size}


@pytest.mark.parametrize("work, limit", [(1 << 22, 1 << 20), (5, 1 << 20), (1 << 22, 1)])
def test_shortest_paths_deal_sources_to_tasks(spark, monkeypatch, work, limit):
    """Shared tasks, a component in many tasks, and joins (components above ``limit``) give the same rows."""
    asked, by_joins = [], graph.wide_paths
    monkeypatch.setattr(graph, "wide_paths", lambda *a: asked.append(1) or by_joins(*a))
    plain = [(i, u, v, w / 4 + 0.1) for i, u, v, w in random_graph(4)]
    plain += [(90, plain[0][2], plain[0][1], 0.2), (91, 30, 31, 0.3), (92, 31, 32, 2.0), (93, 30, 32, 2.5), (94, 31, 31, 1.0)]
    nodes_df = spark.createDataFrame([(i,) for i in [*range(18), 30, 31, 32, 40, 40, None]], "node_id bigint")
    edges_df = spark.createDataFrame(plain, "edge_index bigint, source bigint, target bigint, distance double")
    want = {(i, i): 0.0 for i in [*range(18), 30, 31, 32]}
    grew = True
    while grew:
        grew = False
        for (s, x), d in list(want.items()):
            for _, u, v, w in plain:
                for a, b in ((u, v), (v, u)):
                    if a == x and round(d + w, 10) < want.get((s, b), math.inf):
                        want[s, b], grew = round(d + w, 10), True
    want |= {(40, 40): 0.0, (None, None): 0.0}
    rows = graph.shortest_paths(nodes_df, edges_df, component_edges=limit, work=work).collect()
    assert {(r["src"], r["node"]): r["dist"] for r in rows} == want and len(rows) == len(want)
    assert bool(asked) == (limit == 1)
    some = graph.shortest_paths(nodes_df, edges_df, nodes_df.where("node_id = 31"), limit, work).collect()
    assert {(r["src"], r["node"]): r["dist"] for r in some} == {k: d for k, d in want.items() if k[0] == 31}


def test_shortest_paths_copy_edges_to_few_tasks(spark, monkeypatch):
    """Beyond ``work`` pairs a component is dealt by SOURCES, not into a task with all edges for each few pairs."""
    chain = [(i, i, i + 1, 1.0) for i in range(40)]
    nodes_df = spark.createDataFrame([(i,) for i in range(41)], "node_id bigint")
    edges_df = spark.createDataFrame(chain, "edge_index bigint, source bigint, target bigint, distance double")
    def tasks():
        rows = shortest_paths(nodes_df, edges_df, work=5).select("*", F.spark_partition_id().alias("task")).collect()
        assert len(rows) == 41 * 41 and {(r["src"], r["node"], r["dist"]) for r in rows} == {
            (i, j, float(abs(i - j))) for i in range(41) for j in range(41)}
        return len({r["task"] for r in rows})
    assert tasks() == 1
    for name, size in (("SOURCES", 4), ("TABLE", 100), ("PIECE", 30)):
        monkeypatch.setattr(graph, name, size)
    assert tasks() > 1


def test_sums_beyond_the_tenth_digit_go_by_joins(spark):
    nodes_df = spark.createDataFrame([(1,), (2,), (3,)], "node_id bigint")
    edges_df = spark.createDataFrame([(0, 1, 2, 1 / 3), (1, 2, 3, 1 / 3)], "edge_index bigint, source bigint, target bigint, distance double")
    got = {(r["src"], r["node"]): r["dist"] for r in shortest_paths(nodes_df, edges_df).collect()}
    assert len(got) == 9 and got[1, 2] == 0.3333333333 and got[1, 3] == 0.6666666666


def test_edgeless_graph(spark):
    nodes = spark.createDataFrame([(i, None, 1.0) for i in range(3)], "node_id bigint, label string, frequency double")
    edges = spark.createDataFrame([], "edge_index bigint, source bigint, target bigint, distance double")
    assert [r["component"] for r in tp.connected_components(nodes, edges).orderBy("node_id").collect()] == [1, 2, 3]
    structure = blocks.decompose(edges)
    bridges, points = blocks.cut_points(structure)
    scores = blocks.block_scores(structure)
    assert [r["closeness"] for r in tp.closeness(nodes, structure, scores).collect()] == [0.0] * 3
    assert [r["betweenness"] for r in tp.betweenness(nodes, edges, structure, scores)[0].collect()] == [0.0] * 3
    assert bridges.count() == 0 and points.count() == 0
    assert component_labels(edges.selectExpr("source AS u", "target AS v")).count() == 0


def test_chain_takes_logarithmic_rounds(spark):
    """A chain of 2 000 nodes: exact sums, and fewer than 60 written tables for its cut structure."""
    n, before = 2000, len(storage._written)
    edges = spark.range(n - 1).selectExpr("id AS edge_index", "id AS source", "id + 1 AS target", "1.0D AS distance")
    structure = blocks.decompose(edges)
    bridges, points = blocks.cut_points(structure)
    assert bridges.count() == n - 1 and points.count() == n - 2 and len(storage._written) - before < 60
    scores = blocks.block_scores(structure)
    assert {r["node"]: (r["reached"], r["total"]) for r in blocks.distance_sums(structure, scores).collect()} == {
        i: (n - 1, i * (i + 1) / 2 + (n - 1 - i) * (n - i) / 2) for i in range(n)}
    node, edge = blocks.pair_counts(structure, scores)
    assert all(r["pairs"] == pytest.approx(2 * r["node"] * (n - 1 - r["node"])) for r in node.collect())
    assert all(r["pairs"] == pytest.approx(2 * (r["edge_index"] + 1) * (n - 1 - r["edge_index"])) for r in edge.collect())


def test_prefix_scans(spark):
    """Running values, places and predecessors over many small ranges, ties in the value included."""
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1, 5, -2])) for k in rng.sample(range(10_000), 300)]
    frame = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    ordered, total, most, want = sorted(rows), None, None, []
    for place, (k, v) in enumerate(ordered, 1):
        prior = (total, most)
        total = total if v is None else v + (total or 0)
        most = v if most is None else most if v is None else max(most, v)
        want.append((k, place, total, most, *prior, ordered[place - 2][1] if place > 1 else None))
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v"))}
    got = scan.preceding(scan.numbered(scan.running(frame, ["k"], values), ["k"], "place"), ["k"], {"last": "v"})
    prior = scan.running(frame, ["k"], {"a": values["total"], "b": values["most"]}, before=True).drop("v")
    assert sorted(tuple(r) for r in got.join(prior, "k").select("k", "place", "total", "most", "a", "b", "last").collect()) == want
    assert scan.numbered(frame.limit(0), ["k"], "place").count() == 0


def test_network_file_rules(spark):
    path = scratch_path(spark, "gml")
    text = ('graph [\n directed 1\n node [\n data [\n Frequency "frequency=2.0\nA/1\nB [x]\n"\n ]\n id 0\n ]\n'
            ' node [\n label ""\n id 1\n ]\n node [ id 2 data [ Frequency "frequency=0" ] ]\n'
            ' edge [ data [ Changes "changes=3" ] source 0 target 1 ]\n edge [ source 1 target 2 ]\n]')
    spark.createDataFrame([(text,)], "value string").write.text(path)
    nodes, members, edges = tb.read_network(spark, path)
    assert [(r["node_id"], r["frequency"], r["is_intermediate"]) for r in nodes.orderBy("ord").collect()] == [
        (0, 2.0, False), (1, 0.0, True), (2, 0.0, True)]
    assert [r["sample"] for r in members.orderBy("ord").collect()] == ["A/1", "B [x]"]
    assert [(r["source"], r["target"], r["distance"]) for r in edges.orderBy("edge_index").collect()] == [(0, 1, 3.0), (1, 2, 1.0)]


def test_network_files_are_read_in_segments(spark, monkeypatch):
    """A folder of many parts gives the rows of one text; quotes that span lines hold brackets and entries of their own."""
    seen, segments = [], tb._network_segments
    monkeypatch.setattr(tb, "_network_segments", lambda s, p, n: seen.append(segments(s, p, 3)) or seen[-1])
    names = ['plain', 'a "quoted" [x', 'ends \\', 'node [ x 7 ]', '] ]', '\\" "']
    quote = lambda t: t.replace("\\", "\\\\").replace('"', '\\"')
    text = "graph [\n directed 0\n"
    for k in range(40):
        inner = "\n".join([quote(names[(k + j) % 6]) + "." for j in range(k % 5)] + ["node ["] * (k % 2))
        text += f' node [\n data [\n Frequency "frequency={k}.0\n{inner}\n"\n ]\n label "{quote(names[k % 6])}"\n id {k}\n ]\n'
    text += "".join(f' edge [\n source {k} target {k + 1}\n data [ Changes "{k + 1}" ]\n ]\n' for k in range(39)) + "]\n"
    lines = text.split("\n")
    path = scratch_path(spark, "parts")
    spark.createDataFrame(list(enumerate(lines)), "k int, value string").repartitionByRange(9, "k").sortWithinPartitions("k").select("value").write.text(path)
    other = scratch_path(spark, "open") + ".gml"
    spark.createDataFrame([('graph [ node [ id 1 label "never closed\n node [\n id 2 ]',)], "value string").coalesce(1).write.text(other)
    nodes, members, edges = tb.read_network(spark, [path, other])
    own = F.col("file").endswith(path.split("/")[-1])
    got = nodes.where(own).orderBy("ord").collect()
    assert [(r["ord"], r["node_id"], r["frequency"], r["label"]) for r in got] == [(k, k, float(k), names[k % 6].strip()) for k in range(40)]
    want = [(k, j, x) for k in range(40) for j, x in enumerate([names[(k + j) % 6] + "." for j in range(k % 5)] + ["node ["] * (k % 2))]
    assert [(r["node_id"], r["ord"], r["sample"]) for r in members.where(own).orderBy("node_id", "ord").collect()] == want
    assert [(r["edge_index"], r["source"], r["target"], r["distance"]) for r in edges.where(own).orderBy("edge_index").collect()] == [
        (k, k, k + 1, k + 1.0) for k in range(39)]
    assert seen[0].where(own).count() > 30


def test_network_sink_writes_parts(spark):
    nodes = spark.range(200).selectExpr("id AS node_id", "concat('H', id) AS label", "1.0D AS frequency")
    members = spark.range(200).selectExpr("id AS node_id", "id AS ord", "concat('s', id) AS sample")
    edges = spark.range(199).selectExpr("id AS edge_index", "id AS source", "id + 1 AS target", "2.0D AS distance")
    path = scratch_path(spark, "gml")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # a few rows would be put together
    spark.conf.set(key, "false")
    try:
        tb.write_network(nodes, members, edges, path)
    finally:
        spark.conf.unset(key)
    assert len(spark.read.text(path).inputFiles()) > 1
    got = tb.read_network(spark, path)
    assert [(r["ord"], r["node_id"], r["label"]) for r in got[0].orderBy("ord").collect()] == [(k, k, f"H{k}") for k in range(200)]
    assert got[1].count() == 200 and got[2].where("distance = 2.0 AND source = edge_index").count() == 199
