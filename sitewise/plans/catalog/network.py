"""Network construction and ordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import distance as ds
from sitewise.operators import network as nw
from sitewise.operators import ordination as od
from sitewise.plans import bridge as br
from sitewise.plans.bridge import samples
from sitewise.plans.catalog.diversity import rounded
from sitewise.plans.catalog.structure import _UNIQ, NODES_CTE
from sitewise.plans.registry import query
from sitewise.storage import cut

_REACH = """lv AS (SELECT DISTINCT diff AS t FROM hd),
 rc(t, src, node) AS (SELECT t, idx, idx FROM lv, nd UNION
  SELECT r.t, r.src, CASE WHEN h.i = r.node THEN h.j ELSE h.i END FROM rc r JOIN hd h ON (h.i = r.node OR h.j = r.node) AND h.diff < r.t - EPS)"""
_REACH = """lv AS (SELECT DISTINCT diff AS t FROM hd), ha AS MATERIALIZED (SELECT i AS u, j AS v, diff FROM hd UNION ALL SELECT j, i, diff FROM hd),
 lb(t, node, label) USING KEY (t, node) AS (SELECT t, idx, idx FROM lv, nd
 UNION SELECT c.t, a.v, min(c.label) FROM lb c JOIN ha a ON a.u = c.node AND a.diff < c.t - EPS
 JOIN recurring.lb r ON r.t = c.t AND r.node = a.v WHERE c.label < r.label GROUP BY c.t, a.v),
 net AS (SELECT i AS u, j AS v, diff AS distance FROM hd JOIN lb x ON x.t = diff AND x.node = i JOIN lb y ON y.t = diff AND y.node = j WHERE x.label <> y.label)"""


@query("spanning_network", "WITH RECURSIVE {cells}, " + NODES_CTE + ", " + _REACH.replace("EPS", "0") + " SELECT u, v, distance FROM net")
def spanning_network(spark, d):
    return nw.spanning_network(ds.network_haplotypes(samples(spark, d))[0])


@query("spanning_network_epsilon", "WITH RECURSIVE {cells}, " + NODES_CTE + ", " + _REACH.replace("EPS", "1") + " SELECT u, v, distance FROM net")
def spanning_network_epsilon(spark, d):
    return nw.spanning_network(ds.network_haplotypes(samples(spark, d))[0], 1)


@query("random_mst_frequency")
def random_mst_frequency(spark, d):
    net = cut(nw.spanning_network(ds.network_haplotypes(samples(spark, d))[0]), "network")
    return nw.random_mst_frequency(net, 100, 1729)


# Kruskal for each replicate: an edge is in the tree if no path of edges before it joins its ends
_DRAWS = """rp AS (SELECT net.*, r, md5('7:' || r || ':' || u) AS mu, md5('7:' || r || ':' || v) AS mv FROM net, range(1, 5) t(r)),
 ro AS MATERIALIZED (SELECT u, v, distance, r, row_number() OVER (PARTITION BY r ORDER BY distance, least(mu, mv), greatest(mu, mv)) AS k FROM rp),
 ra AS MATERIALIZED (SELECT r, k, u, v FROM ro UNION ALL SELECT r, k, v, u FROM ro),
 kb(r, k, node, label) USING KEY (r, k, node) AS (SELECT r, k, idx, idx FROM ro, nd
  UNION SELECT c.r, c.k, a.v, min(c.label) FROM kb c JOIN ra a ON a.r = c.r AND a.u = c.node AND a.k < c.k
  JOIN recurring.kb b ON b.r = c.r AND b.k = c.k AND b.node = a.v WHERE c.label < b.label GROUP BY c.r, c.k, a.v)"""


@query("random_mst_draws", "WITH RECURSIVE {cells}, " + NODES_CTE + ", " + _REACH.replace("EPS", "0") + ", " + _DRAWS + """
 SELECT u, v, distance, count(*) AS count, count(*) / 4.0::DOUBLE AS frequency FROM ro
 JOIN kb x ON x.r = ro.r AND x.k = ro.k AND x.node = u JOIN kb y ON y.r = ro.r AND y.k = ro.k AND y.node = v
 WHERE x.label <> y.label GROUP BY u, v, distance""")
def random_mst_draws(spark, d):
    net = cut(nw.spanning_network(ds.network_haplotypes(samples(spark, d))[0]), "network")
    return nw.random_mst_frequency(net, 4, 7)


_TOKEN = "CASE WHEN {} = '-' THEN 'GAP' ELSE {} END"
_MUT = f"""ref AS (SELECT pos, base FROM cells WHERE sample_idx = (SELECT min(sample_idx) FROM samples)),
 mut AS (SELECT c.sample_idx, c.sample, c.pos, {_TOKEN.format('r.base', 'r.base')} AS ref, {_TOKEN.format('c.base', 'c.base')} AS alt
 FROM cells c JOIN ref r USING (pos) WHERE c.base <> r.base)"""


@query("mutations_from_alignment", "WITH {cells}, " + NODES_CTE + ", " + _MUT + """
 SELECT sample_idx, sample, pos, ref, alt FROM mut WHERE pos IN (SELECT pos FROM mask)""")
def mutations_from_alignment(spark, d):
    s = samples(spark, d)
    return nw.mutations_from_alignment(s, ds.site_mask(s)).select("sample_idx", "sample", "pos", "ref", "alt")


@query("mutation_tokens", "WITH {cells}, " + _MUT + """
 SELECT sample_idx, sample, string_agg(pos || '(SNP:' || ref || '->' || alt || ')', ';' ORDER BY pos) AS tokens FROM mut GROUP BY ALL""")
def mutation_tokens(spark, d):
    return nw.mutation_tokens(nw.mutations_from_alignment(samples(spark, d)))


_SETS = _MUT + """, st AS (SELECT sample_idx AS idx, pos, alt FROM mut WHERE pos IN (SELECT pos FROM mask) AND sample_idx IN (SELECT idx FROM nd))"""


@query("mutation_sets", "WITH {cells}, " + NODES_CTE + ", " + _SETS + " SELECT idx, pos, alt FROM st")
def mutation_sets(spark, d):
    s = samples(spark, d)
    nodes, _ = ds.network_haplotypes(s)
    return nw.mutation_sets(nodes, nw.mutations_from_alignment(s, ds.site_mask(s)))


@query("inclusion_network", "WITH {cells}, " + NODES_CTE + ", " + _SETS + """,
 dt AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS date FROM orders GROUP BY ALL),
 hp AS (SELECT idx, n, coalesce(strftime(date, '%Y-%m-%d'), '9999-12-31') AS date FROM nd LEFT JOIN dt ON k = idx),
 sz AS (SELECT idx, count(*) AS size FROM st GROUP BY idx),
 ov AS (SELECT c.idx AS child, p.idx AS parent, count(*) AS m FROM st c JOIN st p ON c.pos = p.pos AND c.alt = p.alt AND c.idx <> p.idx GROUP BY ALL),
 sub AS (SELECT child, parent, p.size, c.size AS csize FROM ov JOIN sz p ON p.idx = parent JOIN sz c ON c.idx = child WHERE m = p.size AND p.size < c.size),
 rk AS (SELECT sub.*, row_number() OVER (PARTITION BY child ORDER BY size DESC, date, n DESC, parent) AS k FROM sub JOIN hp ON hp.idx = parent)
 SELECT coalesce(parent, (SELECT min(idx) FROM hp WHERE idx NOT IN (SELECT idx FROM sz))) AS parent, sz.idx AS child, sz.size - coalesce(rk.size, 0) AS distance
 FROM sz LEFT JOIN rk ON child = sz.idx AND k = 1""")
def inclusion_network(spark, d):
    s = samples(spark, d)
    nodes, _ = ds.network_haplotypes(s)
    sets = cut(nw.mutation_sets(nodes, nw.mutations_from_alignment(s, ds.site_mask(s))), "sets")
    dates = br.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("idx")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date"))
    haps = nodes.select("idx", "n").join(dates, "idx", "left").withColumn(
        "date", F.coalesce("date", F.lit("9999-12-31")))
    return nw.inclusion_network(haps, sets)


@query("alias_samples", """SELECT c_custkey + 1 AS idx, c_name AS sample, 'S' || lpad((c_custkey + 1)::VARCHAR, 7, '0') AS alias FROM customer""")
def alias_samples(spark, d):
    s = br.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("idx"), F.col("c_name").alias("sample"))
    return nw.alias_samples(s, "idx")


@query("unknown_aliases", """SELECT DISTINCT 'S' || lpad(o_orderkey::VARCHAR, 7, '0') AS alias FROM orders
 WHERE o_orderkey NOT IN (SELECT c_custkey + 1 FROM customer)""")
def unknown_aliases(spark, d):
    names = alias_samples(spark, d)
    used = nw.alias_samples(br.table(spark, d, "orders"), "o_orderkey").select("alias")
    return nw.resolve_aliases(names, used)[1].select("alias")


@query("refresh_metadata", """WITH {members} SELECT a.sample, haplotype,
 coalesce(nullif(trim(s.value), ''), 'Default') AS grp, coalesce(trim(t.value), '') AS value FROM assignments a
 LEFT JOIN traits s ON s.sample = a.sample AND s.trait = 'status' LEFT JOIN traits t ON t.sample = a.sample AND t.trait = 'thousands'""")
def refresh_metadata(spark, d):
    wide = br.traits(spark, d).groupBy("sample").agg(
        F.max(F.when(F.col("trait") == "status", F.col("value"))).alias("discrete"),
        F.max(F.when(F.col("trait") == "thousands", F.col("value"))).alias("continuous"))
    return nw.refresh_metadata(br.assignments(spark, d), wide)


@query("gower_center", "WITH {samples}, " + _UNIQ + """,
 dd AS (SELECT i, j, (diff / valid) ** 2 AS d2 FROM dist UNION ALL SELECT j, i, (diff / valid) ** 2 FROM dist UNION ALL SELECT idx, idx, 0 FROM uniq),
 rm AS (SELECT i, sum(d2 * n) / sum(n) AS r FROM dd JOIN uniq ON idx = j GROUP BY i),
 gm AS (SELECT sum(r * n) / sum(n) AS g FROM rm JOIN uniq ON idx = i)
 SELECT dd.i, dd.j, round(-0.5 * (d2 - a.r - b.r + g), 9) + 0.0 AS b FROM dd JOIN rm a ON a.i = dd.i JOIN rm b ON b.i = dd.j, gm""")
def gower_center(spark, d):
    rows = cut(ds.distinct_sequences(samples(spark, d)), "distinct")
    return rounded(od.gower_center(ds.p_distance(rows), rows), "b")


def _pcoa(spark, d):
    rows = cut(ds.distinct_sequences(samples(spark, d)), "distinct")
    pairs = cut(ds.p_distance(rows).select("i", "j", "distance"), "pairs")
    return od.pcoa(pairs, rows)


@query("pcoa_coordinates")
def pcoa_coordinates(spark, d):
    return _pcoa(spark, d)[0]


@query("pcoa_spectrum")
def pcoa_spectrum(spark, d):
    return _pcoa(spark, d)[1]


@query("pcoa_points")
def pcoa_points(spark, d):
    groups = samples(spark, d).select(F.col("sample_idx").alias("idx"), "grp")
    return od.pcoa_points(_pcoa(spark, d)[0], groups)
