"""Population structure and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import distance as ds
from sitewise.operators import structure as st
from sitewise.plans.bridge import samples
from sitewise.plans.catalog.diversity import _PAIRS, _SCOPED, rounded
from sitewise.plans.registry import query
from sitewise.storage import cut

_GS = """gs AS (SELECT grp, pos, count(*) AS n, bool_and(base IN ('A','C','G','T')) AS complete FROM cells GROUP BY ALL),
gc AS (SELECT grp, pos, base, count(*) AS c FROM cells WHERE base IN ('A','C','G','T') GROUP BY ALL),
oc AS (SELECT pos FROM gs GROUP BY pos HAVING bool_and(complete)),
gw AS (SELECT gs.grp, gs.pos, any_value(gs.n) AS n, any_value(complete) AS complete, (any_value(gs.n) * any_value(gs.n) - sum(c * c)) / 2.0 AS w
 FROM gs JOIN gc USING (grp, pos) GROUP BY ALL),
gb AS (SELECT a.grp AS ga, b.grp AS gb, a.pos, any_value(a.n) AS na, any_value(b.n) AS nb,
 any_value(a.complete AND b.complete) AS complete, any_value(a.w) AS wa, any_value(b.w) AS wb,
 any_value(a.n * b.n) - coalesce(sum(x.c * y.c), 0) AS bt
 FROM gw a JOIN gw b ON a.pos = b.pos AND a.grp < b.grp
 LEFT JOIN gc x ON x.grp = a.grp AND x.pos = a.pos
 LEFT JOIN gc y ON y.grp = b.grp AND y.pos = a.pos AND y.base = x.base GROUP BY ALL),
gpi AS (SELECT grp AS grp_a, grp AS grp_b, CASE WHEN max(n) >= 2 THEN sum(w) / (max(n) * (max(n) - 1) / 2.0) / count(*) END AS pi
 FROM gw WHERE pos IN (SELECT pos FROM oc) GROUP BY grp
 UNION ALL SELECT ga, gb, sum(bt) / (max(na) * max(nb)) / count(*) FROM gb WHERE pos IN (SELECT pos FROM oc) GROUP BY ga, gb)"""
_GPI_PW = "gpi AS (SELECT ga AS grp_a, gb AS grp_b, dist / nullif(pairs, 0) AS pi FROM gp)"
_GLOBAL = """, gg AS (SELECT count(*) FILTER (grp_a = grp_b) AS g, count(pi) FILTER (grp_a = grp_b) AS wn,
 avg(pi) FILTER (grp_a = grp_b) AS w, count(pi) FILTER (grp_a <> grp_b) AS bn, avg(pi) FILTER (grp_a <> grp_b) AS b FROM gpi)
 SELECT g AS group_count, round(w, 9) AS mean_within, round(b, 9) AS mean_between,
 CASE WHEN g >= 2 AND wn = g AND bn * 2 = g * (g - 1) AND b > 0 THEN round(1 - w / b, 9) END AS global_fst FROM gg"""


@query("group_pi", "WITH {cells}, " + _GS + " SELECT grp_a, grp_b, round(pi, 9) AS pi FROM gpi")
def group_pi(spark, d):
    return rounded(st.group_pi(samples(spark, d), "grp"), "pi")


@query("group_pi_pairwise", "WITH {samples}, " + _PAIRS + ", " + _GPI_PW
       + " SELECT grp_a, grp_b, round(pi, 9) AS pi FROM gpi")
def group_pi_pairwise(spark, d):
    return rounded(st.group_pi(samples(spark, d), "grp", "pairwise"), "pi")


_FST = """ SELECT ga AS group_a, gb AS group_b, na AS sample_count_a, nb AS sample_count_b,
 round(pa, 9) AS pi_within_a, round(pb, 9) AS pi_within_b, round(pab, 9) AS pi_between,
 CASE WHEN pab > 0 THEN round(1 - ((pa + pb) / 2) / pab, 9) END AS fst FROM fp"""
_FP = """, fp AS (SELECT ga, gb, max(na) AS na, max(nb) AS nb,
 sum(wa) FILTER (complete) / nullif(max(na) * (max(na) - 1) / 2.0, 0) / nullif(count(*) FILTER (complete), 0) AS pa,
 sum(wb) FILTER (complete) / nullif(max(nb) * (max(nb) - 1) / 2.0, 0) / nullif(count(*) FILTER (complete), 0) AS pb,
 sum(bt) FILTER (complete) / (max(na) * max(nb)) / nullif(count(*) FILTER (complete), 0) AS pab FROM gb GROUP BY ga, gb)"""


@query("pairwise_fst", "WITH {cells}, " + _GS + _FP + _FST)
def pairwise_fst(spark, d):
    return rounded(st.pairwise_fst(samples(spark, d), "grp"),
                   "pi_within_a", "pi_within_b", "pi_between", "fst")


@query("pairwise_fst_pairwise", "WITH {samples}, " + _PAIRS + ", " + _GPI_PW + """,
 sz AS (SELECT grp, sum(n)::BIGINT AS n FROM coll GROUP BY grp),
 fp AS (SELECT m.grp_a AS ga, m.grp_b AS gb, x.n AS na, y.n AS nb, p.pi AS pa, q.pi AS pb, m.pi AS pab FROM gpi m
 JOIN sz x ON x.grp = m.grp_a JOIN sz y ON y.grp = m.grp_b
 LEFT JOIN gpi p ON p.grp_a = m.grp_a AND p.grp_b = m.grp_a LEFT JOIN gpi q ON q.grp_a = m.grp_b AND q.grp_b = m.grp_b
 WHERE m.grp_a <> m.grp_b)""" + _FST)
def pairwise_fst_pairwise(spark, d):
    return rounded(st.pairwise_fst(samples(spark, d), "grp", "pairwise"),
                   "pi_within_a", "pi_within_b", "pi_between", "fst")


@query("global_fst", "WITH {cells}, " + _GS + _GLOBAL)
def global_fst(spark, d):
    return rounded(st.global_fst(samples(spark, d), "grp"), "mean_within", "mean_between", "global_fst")


@query("global_fst_pairwise", "WITH {samples}, " + _PAIRS + ", " + _GPI_PW + _GLOBAL)
def global_fst_pairwise(spark, d):
    return rounded(st.global_fst(samples(spark, d), "grp", "pairwise"),
                   "mean_within", "mean_between", "global_fst")


@query("global_fst_clade", """WITH {samples}, cells AS MATERIALIZED (SELECT sample_idx, clade AS grp, q.pos AS pos,
 substr(sequence, q.pos, 1) AS base FROM samples, (SELECT unnest(range(1, 65))::BIGINT AS pos) q), """ + _GS + _GLOBAL)
def global_fst_clade(spark, d):
    return rounded(st.global_fst(samples(spark, d), "clade"), "mean_within", "mean_between", "global_fst")


_AMOVA_COLS = ("ss_among", "ss_within", "ms_among", "ms_within", "variance_among",
               "variance_within", "percent_among", "percent_within", "phi_st")


@query("amova", "WITH {cells}, " + _GS + """,
 ov AS (SELECT pos, (sum(c) * sum(c) - sum(c * c)) / 2.0 AS d FROM (SELECT pos, base, sum(c) AS c FROM gc WHERE pos IN (SELECT pos FROM oc) GROUP BY ALL) GROUP BY pos),
 sz AS (SELECT grp, max(n) AS n FROM gs GROUP BY grp),
 k AS (SELECT (SELECT sum(n) FROM sz)::DOUBLE AS n, (SELECT count(*) FROM sz) AS g, (SELECT sum(n * n) FROM sz)::DOUBLE AS sq,
  (SELECT count(*) FROM oc) AS l, (SELECT sum(d) FROM ov)::DOUBLE AS td,
  (SELECT sum(x) FROM (SELECT sum(w) / max(n) AS x FROM gw WHERE pos IN (SELECT pos FROM oc) GROUP BY grp))::DOUBLE AS wd),
 ss AS (SELECT *, td / l / n AS tot, wd / l AS wit, (n - sq / n) / (g - 1) AS nc FROM k),
 ms AS (SELECT *, (tot - wit) / (g - 1) AS ma, wit / (n - g) AS mw, ((tot - wit) / (g - 1) - wit / (n - g)) / nc AS va FROM ss)
 SELECT n::BIGINT AS sample_count, g AS group_count, l AS callable_site_count, g - 1 AS df_among, (n - g)::BIGINT AS df_within,
 round(tot - wit, 9) AS ss_among, round(wit, 9) AS ss_within, round(ma, 9) AS ms_among, round(mw, 9) AS ms_within,
 round(va, 9) AS variance_among, round(mw, 9) AS variance_within, round(va / (va + mw) * 100, 9) AS percent_among,
 round(mw / (va + mw) * 100, 9) AS percent_within, round(va / (va + mw), 9) AS phi_st FROM ms""")
def amova(spark, d):
    return rounded(st.amova(samples(spark, d), "grp"), *_AMOVA_COLS)


PERMUTATIONS = 999


def _draws(reps: int) -> str:
    """Group counts of haplotypes drawn down a binary tree: ``mem(grp, hid)`` -> ``sz``, ``lb(rep, grp, hid, n)``.

    A row of ``tr`` is a node with its group counts ``c`` and those of its left child drawn so far,
    ``x``; a step draws the next group or, when all are drawn, replaces the node by its children.
    """
    log_choose = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)".format
    mass = (f"exp({log_choose('kk', 'v')} + {log_choose('(nn - kk)', '(mm - v)')} - ({log_choose('nn', 'mm')}))")
    return f"""sz AS MATERIALIZED (SELECT grp, count(*) AS n FROM mem GROUP BY grp),
 hz AS MATERIALIZED (SELECT hid, n, row_number() OVER (ORDER BY hid) - 1 AS unit FROM (SELECT hid, count(*) AS n FROM mem GROUP BY hid)),
 nd AS MATERIALIZED (SELECT lev, unit >> lev AS k, sum(n)::BIGINT AS s FROM hz, (SELECT unnest(range(0, 33)) AS lev) GROUP BY ALL),
 gl AS (SELECT list(n ORDER BY grp) AS c, list(grp ORDER BY grp) AS names FROM sz),
 tr AS (SELECT r.rep, (SELECT ceil(log2(max(unit) + 1)) FROM hz)::BIGINT AS lev, 0::BIGINT AS k, c, []::BIGINT[] AS x
  FROM gl, (SELECT unnest(range(1, {reps + 1})) AS rep) r
  UNION ALL
  SELECT rep, CASE WHEN full_ THEN lev - 1 ELSE lev END, CASE WHEN full_ THEN 2 * k + side ELSE k END,
   CASE WHEN NOT full_ THEN c WHEN side = 0 THEN x ELSE list_transform(list_zip(c, x), lambda z: z[1] - z[2]) END,
   CASE WHEN full_ THEN []::BIGINT[] ELSE x || [CASE WHEN lo = hi THEN lo ELSE lo + len(list_filter(range(1, hi - lo + 2),
    lambda j: list_sum(p[1:j]) < (('0x' || substr(md5('1729:' || rep || ':' || lev || ':' || k || ':' || len(x)), 1, 13))::BIGINT + 0.5) / 4503599627370496e0)) END] END
  FROM (SELECT *, CASE WHEN lo < hi THEN list_transform(range(lo, hi + 1), lambda v: {mass}) END AS p
   FROM (SELECT *, greatest(0, mm + kk - nn) AS lo, least(mm, kk) AS hi
    FROM (SELECT tr.*, len(x) = len(c) AS full_, c[len(x) + 1] AS kk, list_sum(c[len(x) + 1:])::BIGINT AS nn,
      l.s - coalesce(list_sum(x), 0)::BIGINT AS mm, r.k IS NOT NULL AS two
     FROM tr JOIN nd l ON l.lev = tr.lev - 1 AND l.k = 2 * tr.k LEFT JOIN nd r ON r.lev = tr.lev - 1 AND r.k = 2 * tr.k + 1 WHERE tr.lev > 0))) q,
   (SELECT unnest([0, 1]) AS side) WHERE CASE WHEN full_ THEN side = 0 OR two ELSE side = 0 END),
 lb AS MATERIALIZED (SELECT rep, grp, hid, n FROM (SELECT rep, hid, unnest(names) AS grp, unnest(tr.c) AS n FROM tr JOIN hz ON unit = k, gl WHERE lev = 0) WHERE n > 0
  UNION ALL SELECT 0, grp, hid, count(*) FROM mem GROUP BY ALL)"""


_PERM = f"""hs AS (SELECT sample_idx, grp, string_agg(base, '' ORDER BY pos) FILTER (pos IN (SELECT pos FROM oc)) AS sig FROM cells GROUP BY ALL),
 hid AS (SELECT sig, min(sample_idx) AS hid FROM hs GROUP BY sig),
 mem AS (SELECT sample_idx, grp, hid FROM hs JOIN hid USING (sig)),
 {_draws(PERMUTATIONS)},
 ha AS (SELECT hid, q.i, substr(sig, q.i, 1) AS base FROM hid, (SELECT unnest(range(1, (SELECT count(*) FROM oc) + 1)) AS i) q),
 va AS (SELECT i FROM ha GROUP BY i HAVING count(DISTINCT base) > 1),
 ac AS (SELECT rep, grp, i, base, sum(n)::DOUBLE AS c FROM lb JOIN ha USING (hid) WHERE i IN (SELECT i FROM va) GROUP BY ALL),
 wi AS (SELECT rep, grp, sz.n, sum(sz.n * sz.n - s2) / 2.0 AS d FROM (SELECT rep, grp, i, sum(c * c) AS s2 FROM ac GROUP BY ALL) JOIN sz USING (grp) GROUP BY ALL),
 ws AS (SELECT rep, sum(d / (n * (n - 1) / 2.0)) AS pis, sum(d / n) AS ssw FROM wi GROUP BY rep),
 bs AS (SELECT rep, sum(p * p - q) AS same, count(DISTINCT i) AS sites FROM (SELECT rep, i, base, sum(c / n) AS p, sum((c / n) * (c / n)) AS q FROM ac JOIN sz USING (grp) GROUP BY ALL) GROUP BY rep),
 k AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g, sum(n * n)::DOUBLE AS sq, (SELECT count(*) FROM oc) AS l FROM sz),
 tt AS (SELECT sum((s * s - s2) / 2.0) AS d FROM (SELECT i, sum(c) AS s, sum(c * c) AS s2 FROM (SELECT i, base, sum(c) AS c FROM ac WHERE rep = 0 GROUP BY ALL) GROUP BY i)),
 st AS (SELECT rep, 1 - (pis / g) / ((sites * g * (g - 1) - same) / 2.0 / (g * (g - 1) / 2.0)) AS fst,
  ssw / l AS wit, d / l / n AS tot, n, g, (n - sq / n) / (g - 1) AS nc FROM ws JOIN bs USING (rep), k, tt),
 sv AS (SELECT rep, fst, ((tot - wit) / (g - 1) - wit / (n - g)) / nc AS va, wit / (n - g) AS mw FROM st),
 lg AS (SELECT rep, 'fst' AS statistic, round(fst, 12) AS v FROM sv UNION ALL SELECT rep, 'phi_st', round(va / (va + mw), 12) FROM sv),
 ob AS (SELECT statistic, v AS observed FROM lg WHERE rep = 0)
 SELECT statistic, round(observed, 9) AS observed, count(*) FILTER (rep > 0) AS permutation_count,
 count(*) FILTER (rep > 0 AND v >= observed) AS extreme,
 round((count(*) FILTER (rep > 0 AND v >= observed) + 1) / (count(*) FILTER (rep > 0) + 1), 9) AS p_value
 FROM lg JOIN ob USING (statistic) GROUP BY statistic, observed"""


@query("permutation_test", "WITH RECURSIVE {cells}, " + _GS + ", " + _PERM)
def permutation_test(spark, d):
    return rounded(st.permutation_test(samples(spark, d), "grp", PERMUTATIONS, 1729),
                   "observed", "p_value")


_PERM_PW = f"""mem AS (SELECT sample_idx, coalesce(nullif(trim(grp), ''), '(missing)') AS grp, u.idx AS hid FROM samples s JOIN uniq u USING (sequence)),
 {_draws(99)},
 ps AS (SELECT x.rep, least(x.grp, y.grp) AS a, greatest(x.grp, y.grp) AS b, sum(x.n * y.n) AS w, sum(x.n * y.n * diff / valid) AS d
  FROM dist JOIN lb x ON x.hid = i JOIN lb y ON y.hid = j AND y.rep = x.rep GROUP BY ALL
  UNION ALL SELECT x.rep, x.grp, y.grp, sum(CASE WHEN x.grp = y.grp THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END), 0 FROM lb x JOIN lb y ON x.rep = y.rep AND x.hid = y.hid AND x.grp <= y.grp GROUP BY ALL),
 pi AS (SELECT rep, a, b, sum(d) / sum(w) AS pi FROM ps GROUP BY ALL),
 fs AS (SELECT rep, round(1 - avg(pi) FILTER (a = b) / avg(pi) FILTER (a <> b), 12) AS v FROM pi GROUP BY rep), o AS (SELECT v AS observed FROM fs WHERE rep = 0)
 SELECT 'fst' AS statistic, round(observed, 9) AS observed, count(*) FILTER (rep > 0) AS permutation_count, count(*) FILTER (rep > 0 AND v >= observed) AS extreme,
 round((count(*) FILTER (rep > 0 AND v >= observed) + 1) / (count(*) FILTER (rep > 0) + 1), 9) AS p_value FROM fs, o GROUP BY observed"""


@query("permutation_test_pairwise", "WITH RECURSIVE {samples}, uniq AS (SELECT sequence, min(sample_idx) AS idx, count(*) AS n FROM samples GROUP BY sequence), "
       "uc AS (SELECT idx, q.pos, substr(sequence, q.pos, 1) AS base FROM uniq, (SELECT unnest(range(1, 65)) AS pos) q WHERE substr(sequence, q.pos, 1) IN ('A','C','G','T')), "
       "dist AS MATERIALIZED (SELECT a.idx AS i, b.idx AS j, count(*) AS valid, count(*) FILTER (a.base <> b.base) AS diff FROM uc a JOIN uc b ON a.pos = b.pos AND a.idx < b.idx GROUP BY ALL), " + _PERM_PW)
def permutation_test_pairwise(spark, d):
    out = st.permutation_test(samples(spark, d), "grp", 99, 1729, "pairwise")
    return rounded(out.where("statistic = 'fst'"), "observed", "p_value")


@query("fst_matrix", "WITH {cells}, " + _GS + _FP + """,
 f AS (SELECT ga, gb, CASE WHEN pab > 0 THEN round(1 - ((pa + pb) / 2) / pab, 9) END AS fst FROM fp)
 SELECT ga AS "row", gb AS col, fst AS value FROM f UNION ALL SELECT gb, ga, fst FROM f
 UNION ALL SELECT DISTINCT grp, grp, 0.0::DOUBLE FROM gs""")
def fst_matrix(spark, d):
    s = samples(spark, d)
    pairs = st.pairwise_fst(s, "grp")
    labels = st.grouped(s, "grp").select("grp").distinct()
    return rounded(st.square_matrix(pairs, "group_a", "group_b", "fst", labels), "value")


_UNIQ = """uniq AS (SELECT sequence, min(sample_idx) AS idx, count(*) AS n FROM samples GROUP BY sequence),
uc AS (SELECT idx, q.pos, substr(sequence, q.pos, 1) AS base FROM uniq, (SELECT unnest(range(1, 65)) AS pos) q
 WHERE substr(sequence, q.pos, 1) IN ('A','C','G','T')),
dist AS (SELECT a.idx AS i, b.idx AS j, count(*) AS valid, count(*) FILTER (a.base <> b.base) AS diff
 FROM uc a JOIN uc b ON a.pos = b.pos AND a.idx < b.idx GROUP BY ALL)"""


@query("p_distance", "WITH {samples}, " + _UNIQ + """
 SELECT i, j, valid, diff, CASE WHEN valid >= greatest(1, ceil(64 * 0.5)) THEN round(diff / valid, 9) END AS distance FROM dist""")
def p_distance(spark, d):
    return rounded(ds.p_distance(ds.distinct_sequences(samples(spark, d)), 1, 0.5), "distance")


# 62 of 64 sites must be comparable, so some pairs are unavailable
@query("distance_summary", "WITH {samples}, " + _UNIQ + """
 SELECT count(*) AS pairs, count(*) FILTER (valid < ceil(64 * 0.96)) AS unavailable,
 round(avg(diff / valid) FILTER (valid >= ceil(64 * 0.96)), 9) AS mean_distance,
 round(max(diff / valid) FILTER (valid >= ceil(64 * 0.96)), 9) AS max_distance FROM dist""")
def distance_summary(spark, d):
    pairs = ds.p_distance(ds.distinct_sequences(samples(spark, d)), 1, 0.96)
    return rounded(ds.distance_summary(pairs), "mean_distance", "max_distance")


@query("low_coverage_examples", "WITH {samples}, " + _UNIQ + """
 SELECT i, j, valid FROM dist WHERE valid < 64 ORDER BY i, j LIMIT 5""")
def low_coverage_examples(spark, d):
    return ds.low_coverage_examples(ds.p_distance(ds.distinct_sequences(samples(spark, d)), 1, 1.0))


@query("called_sites", "WITH {samples}, " + _UNIQ + """
 SELECT idx, count(*) AS valid, 0.0::DOUBLE AS distance FROM uc GROUP BY idx""")
def called_sites(spark, d):
    return ds.called_sites(ds.distinct_sequences(samples(spark, d)))


@query("complete_distance", "WITH {cells}, " + _GS + """,
 hs AS (SELECT sample_idx, string_agg(base, '' ORDER BY pos) FILTER (pos IN (SELECT pos FROM oc)) AS sig FROM cells GROUP BY ALL),
 u AS (SELECT sig, min(sample_idx) AS idx FROM hs GROUP BY sig)
 SELECT a.idx AS i, b.idx AS j, hamming(a.sig, b.sig)::BIGINT AS diff, length(a.sig)::BIGINT AS sites,
 round(hamming(a.sig, b.sig) / length(a.sig), 9) AS distance FROM u a JOIN u b ON a.idx < b.idx""")
def complete_distance(spark, d):
    return rounded(ds.complete_distance(samples(spark, d)), "distance")


@query("site_mask", "WITH {cells} SELECT pos FROM cells GROUP BY pos HAVING bool_and(base IN ('A','C','G','T','U','-'))")
def site_mask(spark, d):
    return ds.site_mask(samples(spark, d))


NODES_CTE = """mask AS (SELECT pos FROM cells GROUP BY pos HAVING bool_and(base IN ('A','C','G','T','U','-'))),
ms AS (SELECT sample_idx, string_agg(base, '' ORDER BY pos) FILTER (pos IN (SELECT pos FROM mask)) AS sig FROM cells GROUP BY ALL),
nd AS (SELECT sig, min(sample_idx) AS idx, count(*) AS n FROM ms GROUP BY sig),
hd AS (SELECT a.idx AS i, b.idx AS j, hamming(a.sig, b.sig)::BIGINT AS diff FROM nd a JOIN nd b ON a.idx < b.idx)"""


@query("network_haplotypes", "WITH {cells}, " + NODES_CTE + " SELECT idx, sig AS sequence, n FROM nd")
def network_haplotypes(spark, d):
    return ds.network_haplotypes(samples(spark, d))[0]


@query("haplotype_distances", "WITH {cells}, " + NODES_CTE + " SELECT i, j, diff FROM hd")
def haplotype_distances(spark, d):
    return ds.haplotype_distances(ds.network_haplotypes(samples(spark, d))[0])


# every pair whose distance has an even numerator is turned negative on one side only
@query("validate_distances", "WITH {samples}, " + _UNIQ + """
 SELECT unnest(['asymmetric', 'diagonal', 'negative']) AS code,
 unnest([2 * e, (SELECT count(*) FROM uniq WHERE n > 1), e]) AS cells
 FROM (SELECT count(*) FILTER (diff % 2 = 0 AND diff > 0) AS e FROM dist)""")
def validate_distances(spark, d):
    rows = cut(ds.distinct_sequences(samples(spark, d)), "distinct")
    # the sign is set before the pairs become two cells each, so that no cell is joined with its pair
    signed = ds.p_distance(rows).select("i", "j", F.when(F.col("diff") % 2 == 0, -F.col("distance")).otherwise(F.col("distance")).alias("signed"))
    matrix = st.square_matrix(signed, "i", "j", "signed", rows.select("idx"))
    copies = rows.groupBy("idx").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    row, col = F.col("row"), F.col("col")
    broken = (matrix.join(copies.toDF("row", "a"), "row").join(copies.toDF("col", "b"), "col")
              .join(rows.select(F.col("idx").alias("row"), "n"), "row")
              .withColumn("value", F.when(row < col, F.col("value")).when((row == col) & (F.col("n") > 1), 1.0).otherwise(F.abs("value")))
              # cells of repeated rows come as often as their pair does
              .withColumn("time", F.explode(F.array_repeat(F.lit(0), F.when(row < col, F.col("a") * F.col("b")).otherwise(1)))))
    return ds.validate_distances(broken.select("row", "col", "value"))
