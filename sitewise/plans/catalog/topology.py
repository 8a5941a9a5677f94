"""Network topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import topology as tp
from sitewise.operators.blocks import block_scores, cut_points, decompose
from sitewise.operators.graph import shortest_paths as all_shortest_paths
from sitewise.plans import bridge as br
from sitewise.plans.catalog.diversity import rounded
from sitewise.plans.registry import query
from sitewise.storage import cut

_CC = """cc(node, label) USING KEY (node) AS (SELECT node_id, node_id FROM nodes
 UNION SELECT a.v, min(c.label) FROM cc c JOIN arcs a ON a.u = c.node JOIN recurring.cc r ON r.node = a.v
 WHERE c.label < r.label GROUP BY a.v),
comp AS (SELECT node AS node_id, dense_rank() OVER (ORDER BY label) AS component FROM cc)"""
_SP = """sp(src, node, dist) USING KEY (src, node) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM nodes
 UNION SELECT s.src, a.v, min(s.dist + a.w) FROM sp s JOIN arcs a ON a.u = s.node
 LEFT JOIN recurring.sp r ON r.src = s.src AND r.node = a.v
 WHERE r.dist IS NULL OR s.dist + a.w < r.dist GROUP BY s.src, a.v)"""
_MEDIATE = """(frequency <= 0 OR trim(label) = '')"""


def _nodes(spark, d):
    return tp.flag_intermediate(br.nodes(spark, d), "frequency")


def _betweenness(spark, d):
    structure = decompose(br.edges(spark, d))
    return tp.betweenness(br.nodes(spark, d), br.edges(spark, d), structure, block_scores(structure))


@query("connected_components", "WITH RECURSIVE {network}, " + _CC + " SELECT node_id, component FROM comp")
def connected_components(spark, d):
    return tp.connected_components(br.nodes(spark, d), br.edges(spark, d))


@query("graph_metrics", "WITH RECURSIVE {network}, " + _CC + f""",
 k AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m, (SELECT max(component) FROM comp) AS c,
  (SELECT count(*) FROM nodes WHERE {_MEDIATE}) AS i)
 SELECT n AS node_count, m AS edge_count, c AS component_count, round(2.0 * m / (n * (n - 1)), 9) AS density,
 m - n + c AS cycle_rank, n - i AS observed_node_count, i AS intermediate_node_count FROM k""")
def graph_metrics(spark, d):
    nodes, edges = _nodes(spark, d), br.edges(spark, d)
    return rounded(tp.graph_metrics(nodes, edges, tp.connected_components(nodes, edges)), "density")


@query("node_degree", """WITH {network} SELECT node_id, count(u) AS degree, coalesce(sum(w), 0)::DOUBLE AS distance_sum
 FROM nodes LEFT JOIN arcs ON u = node_id GROUP BY node_id""")
def node_degree(spark, d):
    return tp.node_degree(br.nodes(spark, d), br.edges(spark, d))


@query("shortest_paths", "WITH RECURSIVE {network}, " + _SP + " SELECT src, node, dist FROM sp")
def shortest_paths(spark, d):
    return all_shortest_paths(br.nodes(spark, d), br.edges(spark, d))


@query("closeness", "WITH RECURSIVE {network}, " + _SP + """,
 r AS (SELECT src, count(*) - 1 AS r, sum(dist) AS d, (SELECT count(*) FROM nodes) AS n FROM sp GROUP BY src)
 SELECT src AS node_id, CASE WHEN r > 0 AND d > 0 THEN round(r / d * r / (n - 1), 9) ELSE 0.0 END AS closeness FROM r""")
def closeness(spark, d):
    structure = decompose(br.edges(spark, d))
    return rounded(tp.closeness(br.nodes(spark, d), structure, block_scores(structure)), "closeness")


_SIGMA = _SP + """,
 walk(src, node) AS (SELECT node_id, node_id FROM nodes UNION ALL SELECT k.src, a.v FROM walk k JOIN arcs a ON a.u = k.node
  JOIN sp x ON x.src = k.src AND x.node = k.node JOIN sp y ON y.src = k.src AND y.node = a.v WHERE x.dist + a.w = y.dist),
 sg AS MATERIALIZED (SELECT src, node, count(*) AS s, any_value(dist) AS dist FROM walk JOIN sp USING (src, node) GROUP BY ALL)"""


@query("node_betweenness", "WITH RECURSIVE {network}, " + _SIGMA + """,
 b AS (SELECT x.node, sum(x.s * y.s / t.s) AS s FROM sg x JOIN sg y ON x.node = y.src JOIN sg t ON t.src = x.src AND t.node = y.node
  WHERE x.src <> x.node AND y.src <> y.node AND x.src <> y.node AND x.dist + y.dist = t.dist GROUP BY x.node),
 n AS (SELECT count(*) AS n FROM nodes)
 SELECT node_id, round(coalesce(s, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM nodes LEFT JOIN b ON node = node_id, n""")
def node_betweenness(spark, d):
    return rounded(_betweenness(spark, d)[0], "betweenness")


@query("edge_betweenness", "WITH RECURSIVE {network}, " + _SIGMA + """,
 b AS (SELECT a.edge_index, sum(x.s * y.s / t.s) AS s FROM sg x JOIN arcs a ON a.u = x.node JOIN sg y ON y.src = a.v
  JOIN sg t ON t.src = x.src AND t.node = y.node WHERE x.dist + a.w + y.dist = t.dist GROUP BY a.edge_index),
 n AS (SELECT count(*) AS n FROM nodes)
 SELECT edge_index, round(coalesce(s, 0) / (n * (n - 1)), 9) AS betweenness FROM edges LEFT JOIN b USING (edge_index), n""")
def edge_betweenness(spark, d):
    return rounded(_betweenness(spark, d)[1], "betweenness")


_BRIDGES = """br(e, node) AS (SELECT edge_index, source FROM edges UNION SELECT b.e, a.v FROM br b JOIN arcs a ON a.u = b.node AND a.edge_index <> b.e),
 bridge AS (SELECT edge_index FROM edges WHERE NOT EXISTS (SELECT 1 FROM br WHERE e = edge_index AND node = target))"""
_ARTIC = """ar(x, node) AS (SELECT u, min(v) FROM arcs GROUP BY u UNION SELECT r.x, a.v FROM ar r JOIN arcs a ON a.u = r.node AND a.v <> r.x),
 artic AS (SELECT DISTINCT u AS node_id FROM arcs WHERE NOT EXISTS (SELECT 1 FROM ar WHERE x = u AND node = v))"""


@query("bridges", "WITH RECURSIVE {network}, " + _BRIDGES + " SELECT edge_index FROM bridge")
def bridges(spark, d):
    return cut_points(decompose(br.edges(spark, d)))[0]


@query("articulation_points", "WITH RECURSIVE {network}, " + _ARTIC + " SELECT node_id FROM artic")
def articulation_points(spark, d):
    return cut_points(decompose(br.edges(spark, d)))[1]


_RAW_NODES = """raw_nodes AS (SELECT s_suppkey AS node_id, s_acctbal AS frequency FROM supplier
 UNION ALL SELECT cast(n_nationkey AS bigint), cast(n_regionkey AS double) FROM nation)"""
_RAW_EDGES = """raw_edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_index, l_suppkey AS source, l_partkey AS target, l_discount AS distance FROM lineitem)"""


@query("validate_network", f"WITH {_RAW_NODES}, {_RAW_EDGES}" + """
 SELECT 'duplicate_node' AS code, node_id::VARCHAR AS ref FROM raw_nodes GROUP BY node_id HAVING count(*) > 1
 UNION ALL SELECT 'bad_frequency', node_id::VARCHAR FROM raw_nodes WHERE frequency < 0
 UNION ALL SELECT DISTINCT 'dangling_edge', edge_index::VARCHAR FROM raw_edges WHERE source NOT IN (SELECT node_id FROM raw_nodes) OR target NOT IN (SELECT node_id FROM raw_nodes)
 UNION ALL SELECT 'self_loop', edge_index::VARCHAR FROM raw_edges WHERE source = target
 UNION ALL SELECT 'parallel_edge', a || '-' || b FROM (SELECT least(source, target) AS a, greatest(source, target) AS b FROM raw_edges WHERE source <> target) GROUP BY a, b HAVING count(*) > 1
 UNION ALL SELECT 'bad_distance', edge_index::VARCHAR FROM raw_edges WHERE distance <= 0
 UNION ALL SELECT 'duplicate_edge_index', edge_index::VARCHAR FROM raw_edges GROUP BY edge_index HAVING count(*) > 1""")
def validate_network(spark, d):
    supplier, nation = br.table(spark, d, "supplier"), br.table(spark, d, "nation")
    nodes = supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("frequency")).unionByName(
        nation.select(F.col("n_nationkey").cast("bigint").alias("node_id"),
                      F.col("n_regionkey").cast("double").alias("frequency")))
    edges = br.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_index"), F.col("l_suppkey").alias("source"),
        F.col("l_partkey").alias("target"), F.col("l_discount").alias("distance"))
    return tp.validate_network(nodes, edges)


@query("intermediate_by_frequency", f"WITH {{network}} SELECT node_id, {_MEDIATE} AS is_intermediate FROM nodes")
def intermediate_by_frequency(spark, d):
    return _nodes(spark, d).select("node_id", "is_intermediate")


# viewer rule: priority stands in for the group, urgent orders keep the default group,
# and orders whose key hashes low carry the inferred-node prefix
_VIEW = """vm AS (SELECT node_id, ord, CASE WHEN substr(md5(concat('in:', sample)), 1, 1) < '8' THEN concat('IN', sample) ELSE sample END AS sample FROM members),
 vg AS (SELECT vm.sample, CASE WHEN o_orderpriority < '4' THEN 'Default' ELSE o_orderpriority END AS grp FROM vm JOIN orders ON o_orderkey = ord)"""


@query("intermediate_by_viewer", "WITH {network}, {members}, " + _VIEW + """,
 f AS (SELECT node_id, arg_min(sample, ord) AS first FROM vm GROUP BY node_id),
 p AS (SELECT node_id, bool_and(grp = 'Default') AS plain FROM vm JOIN vg USING (sample) GROUP BY node_id)
 SELECT node_id, coalesce(starts_with(first, 'IN') AND plain, false) AS is_intermediate FROM nodes LEFT JOIN f USING (node_id) LEFT JOIN p USING (node_id)""")
def intermediate_by_viewer(spark, d):
    low = F.substring(F.md5(F.concat(F.lit("in:"), F.col("sample"))), 1, 1) < "8"
    members = br.members(spark, d).withColumn("sample", F.when(low, F.concat(F.lit("IN"), "sample")).otherwise(F.col("sample")))
    prio = br.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("p"))
    groups = members.join(prio, "ord").select("sample", F.when(F.col("p") < "4", "Default").otherwise(F.col("p")).alias("grp"))
    return tp.flag_intermediate(br.nodes(spark, d), "viewer", members, groups).select("node_id", "is_intermediate")


_ANN = """per AS (SELECT node_id, min(haplotype) AS lo, max(haplotype) AS hi FROM members JOIN assignments USING (sample) GROUP BY node_id),
 ann AS (SELECT node_id, label, frequency, CASE WHEN lo = hi THEN lo WHEN label IN (SELECT haplotype FROM assignments) THEN label ELSE '' END AS haplotype FROM nodes LEFT JOIN per USING (node_id))"""


def _annotated(spark, d):
    return tp.annotate_nodes(_nodes(spark, d), br.members(spark, d), br.assignments(spark, d))


@query("annotate_nodes", "WITH {network}, {members}, " + _ANN + " SELECT node_id, haplotype FROM ann")
def annotate_nodes(spark, d):
    return _annotated(spark, d).select("node_id", "haplotype")


@query("node_trait_values", """WITH {members} SELECT node_id, trait, trim(value) AS value, min(ord) AS first_ord, count(*) AS n
 FROM members JOIN traits USING (sample) WHERE trim(value) <> '' GROUP BY ALL""")
def node_trait_values(spark, d):
    return tp.node_trait_values(br.members(spark, d), br.traits(spark, d))


@query("label_edges", "WITH {network}, {members}, " + _ANN + """
 SELECT edge_index, s.haplotype AS source_haplotype, t.haplotype AS target_haplotype FROM edges JOIN ann s ON s.node_id = source JOIN ann t ON t.node_id = target""")
def label_edges(spark, d):
    return tp.label_edges(br.edges(spark, d), _annotated(spark, d)).select(
        "edge_index", "source_haplotype", "target_haplotype")


_MET = _ANN + """, deg AS (SELECT node_id, count(u) AS degree FROM nodes LEFT JOIN arcs ON u = node_id GROUP BY node_id),
 met AS (SELECT ann.*, degree FROM ann JOIN deg USING (node_id))"""


@query("structural_role", "WITH RECURSIVE {network}, {members}, " + _ARTIC + ", " + _MET + """,
 mp AS (SELECT met.*, node_id IN (SELECT node_id FROM artic) AS art, max(frequency) OVER () AS f, max(degree) OVER () AS dg FROM met WHERE haplotype <> '')
 SELECT node_id, haplotype, coalesce(nullif(concat_ws('; ', CASE WHEN f > 0 AND frequency = f THEN 'Most frequent' END,
  CASE WHEN dg > 0 AND degree = dg THEN 'Highest-degree node' END, CASE WHEN art THEN 'Articulation/structural bridge' END), ''), 'Peripheral/general') AS role FROM mp""")
def structural_role(spark, d):
    nodes, edges = br.nodes(spark, d), br.edges(spark, d)
    art = cut_points(decompose(edges))[1].withColumn("articulation_point", F.lit(True))
    met = (_annotated(spark, d).join(tp.node_degree(nodes, edges), "node_id").join(art, "node_id", "left")
           .withColumn("articulation_point", F.coalesce("articulation_point", F.lit(False))))
    return tp.structural_role(cut(met, "node-metrics")).select("node_id", "haplotype", "role")


@query("degree_histogram", "WITH {network}, {members}, " + _MET + " SELECT degree, count(*) AS nodes FROM met WHERE haplotype <> '' GROUP BY degree")
def degree_histogram(spark, d):
    return tp.degree_histogram(_annotated(spark, d).join(tp.node_degree(br.nodes(spark, d), br.edges(spark, d)), "node_id"))


@query("hub_ranking", "WITH RECURSIVE {network}, {members}, " + _ANN + ", " + _SIGMA + """,
 b AS (SELECT x.node, sum(x.s * y.s / t.s) AS s FROM sg x JOIN sg y ON x.node = y.src JOIN sg t ON t.src = x.src AND t.node = y.node
  WHERE x.src <> x.node AND y.src <> y.node AND x.src <> y.node AND x.dist + y.dist = t.dist GROUP BY x.node),
 n AS (SELECT count(*) AS n FROM nodes)
 SELECT node_id, haplotype, round(s / ((n - 1) * (n - 2)), 9) AS betweenness FROM ann JOIN b ON node = node_id, n
 WHERE haplotype <> '' AND s > 0 ORDER BY round(s / ((n - 1) * (n - 2)), 9) DESC, node_id LIMIT 20""")
def hub_ranking(spark, d):
    met = rounded(_annotated(spark, d).join(_betweenness(spark, d)[0], "node_id"), "betweenness")
    return tp.hub_ranking(met).select("node_id", "haplotype", "betweenness")


@query("dominant_haplotype", "WITH {network}, {members}, " + _MET + """
 SELECT node_id, haplotype, frequency, degree FROM met WHERE haplotype <> '' ORDER BY frequency DESC, degree DESC, node_id LIMIT 1""")
def dominant_haplotype(spark, d):
    return tp.dominant_haplotype(_annotated(spark, d).join(tp.node_degree(br.nodes(spark, d), br.edges(spark, d)), "node_id"))


@query("mapped_bridges", "WITH RECURSIVE {network}, {members}, " + _ANN + ", " + _BRIDGES + """
 SELECT edge_index, s.haplotype AS source_haplotype, t.haplotype AS target_haplotype FROM edges JOIN ann s ON s.node_id = source JOIN ann t ON t.node_id = target
 WHERE s.haplotype <> '' AND t.haplotype <> '' AND edge_index IN (SELECT edge_index FROM bridge)""")
def mapped_bridges(spark, d):
    edges = br.edges(spark, d)
    return tp.mapped_bridges(tp.label_edges(edges, _annotated(spark, d)), cut_points(decompose(edges))[0]).select(
        "edge_index", "source_haplotype", "target_haplotype")


@query("unmapped_nodes", "WITH {network}, {members}, " + _ANN + f"""
 SELECT count(*) FILTER (NOT {_MEDIATE} AND haplotype = '') AS unmapped_observed, count(*) FILTER (haplotype <> '') AS mapped FROM ann""")
def unmapped_nodes(spark, d):
    return tp.unmapped_nodes(_annotated(spark, d))


@query("search_nodes", "WITH {network}, {members}, " + _ANN + """
 SELECT node_id, haplotype FROM ann WHERE contains(lower(haplotype), 'h14') OR node_id IN (SELECT node_id FROM members WHERE contains(lower(trim(sample)), 'h14')) ORDER BY node_id LIMIT 1""")
def search_nodes(spark, d):
    return tp.search_nodes(_annotated(spark, d), br.members(spark, d), " H14 ").select("node_id", "haplotype")


@query("drop_nodes", """WITH {network}, g AS (SELECT node_id FROM nodes WHERE frequency < 5)
 SELECT edge_index, source, target FROM edges WHERE source NOT IN (SELECT node_id FROM g) AND target NOT IN (SELECT node_id FROM g)""")
def drop_nodes(spark, d):
    nodes = br.nodes(spark, d)
    return tp.drop_nodes(nodes, br.edges(spark, d), nodes.where("frequency < 5").select("node_id"))[1].select(
        "edge_index", "source", "target")


@query("drop_edges", """WITH {network}, g AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders)
 SELECT edge_index, source, target FROM edges WHERE NOT EXISTS (SELECT 1 FROM g WHERE (a = source AND b = target) OR (a = target AND b = source))""")
def drop_edges(spark, d):
    gone = br.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return tp.drop_edges(br.edges(spark, d), gone).select("edge_index", "source", "target")
