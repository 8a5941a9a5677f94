"""Quality, haplotypes, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.sequence import r9
from sitewise.operators import diversity as dv
from sitewise.operators import haplotypes as hp
from sitewise.operators import quality as ql
from sitewise.plans.bridge import samples
from sitewise.plans.registry import query


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, r9(F.col(name)))
    return df


@query("sample_quality", """
WITH {cells} SELECT sample_idx, sample, count(*) AS length,
 count(*) FILTER (base NOT IN ('A','C','G','T')) AS missing_count,
 count(*) FILTER (base = '-') AS gap_count,
 count(*) FILTER (base IN ('N','?')) AS unknown_count,
 count(*) FILTER (base IN ('R','Y','S','W','K','M','B','D','H','V')) AS ambiguity_count,
 round(count(*) FILTER (base NOT IN ('A','C','G','T')) / count(*), 9) AS missing_rate,
 round(count(*) FILTER (base = '-') / count(*), 9) AS gap_rate,
 round(count(*) FILTER (base IN ('N','?')) / count(*), 9) AS unknown_rate,
 round(count(*) FILTER (base IN ('R','Y','S','W','K','M','B','D','H','V')) / count(*), 9) AS ambiguity_rate
FROM cells GROUP BY ALL""")
def sample_quality(spark, d):
    return rounded(ql.sample_quality(samples(spark, d)),
                   "missing_rate", "gap_rate", "unknown_rate", "ambiguity_rate")


_SITES = """sites AS (SELECT pos, count(*) AS sample_count,
 count(*) FILTER (base IN ('A','C','G','T')) AS callable_count,
 count(*) FILTER (base = '-') AS gap_count, count(*) FILTER (base IN ('N','?')) AS unknown_count,
 count(*) FILTER (base IN ('R','Y','S','W','K','M','B','D','H','V')) AS ambiguity_count FROM cells GROUP BY pos),
al AS (SELECT pos, count(*) AS allele_count, count(*) FILTER (n >= 2) AS shared,
 string_agg(base || ':' || n, ';' ORDER BY base) AS alleles
 FROM (SELECT pos, base, count(*) AS n FROM cells WHERE base IN ('A','C','G','T') GROUP BY ALL) GROUP BY pos),
site_q AS (SELECT s.*, coalesce(allele_count, 0) AS allele_count, coalesce(alleles, '') AS alleles,
 sample_count - callable_count AS missing_count,
 round((sample_count - callable_count) / sample_count, 9) AS missing_rate, EFFECTIVE AS effective,
 (EFFECTIVE) AND coalesce(allele_count, 0) >= 2 AS variable,
 (EFFECTIVE) AND coalesce(allele_count, 0) >= 2 AND coalesce(shared, 0) >= 2 AS parsimony_informative
 FROM sites s LEFT JOIN al USING (pos))"""
_COMPLETE = _SITES.replace("EFFECTIVE", "callable_count = sample_count")
_PAIRWISE = _SITES.replace("EFFECTIVE", "callable_count >= 2")


@query("site_quality", "WITH {cells}, " + _COMPLETE + " SELECT * FROM site_q")
def site_quality(spark, d):
    return rounded(ql.site_quality(samples(spark, d)), "missing_rate")


@query("site_quality_pairwise", "WITH {cells}, " + _PAIRWISE + " SELECT * FROM site_q")
def site_quality_pairwise(spark, d):
    return rounded(ql.site_quality(samples(spark, d), "pairwise"), "missing_rate")


_REPORT = """ SELECT max(sample_count) AS sample_count, count(*) AS alignment_length,
 sum(missing_count)::BIGINT AS total_missing_count,
 round(sum(missing_count) / sum(sample_count), 9) AS total_missing_rate,
 count(*) FILTER (effective) AS effective_site_count, count(*) FILTER (variable) AS variable_site_count,
 count(*) FILTER (parsimony_informative) AS parsimony_informative_site_count FROM site_q"""


@query("quality_report", "WITH {cells}, " + _COMPLETE + _REPORT)
def quality_report(spark, d):
    return rounded(ql.quality_report(samples(spark, d)), "total_missing_rate")


@query("quality_report_pairwise", "WITH {cells}, " + _PAIRWISE + _REPORT)
def quality_report_pairwise(spark, d):
    return rounded(ql.quality_report(samples(spark, d), "pairwise"), "total_missing_rate")


@query("top_missing_samples", """
WITH {cells}, q AS (SELECT sample_idx, sample, count(*) FILTER (base NOT IN ('A','C','G','T')) / count(*) AS rate
 FROM cells GROUP BY ALL)
SELECT sample_idx, sample, round(rate, 9) AS missing_rate,
 CASE WHEN rate < 0.05 THEN 'good' WHEN rate < 0.2 THEN 'warn' ELSE 'bad' END AS tone
FROM q WHERE rate > 0 ORDER BY rate DESC, sample_idx LIMIT 25""")
def top_missing_samples(spark, d):
    return rounded(ql.top_missing_samples(samples(spark, d)), "missing_rate")


@query("sites_of_interest", "WITH {cells}, " + _COMPLETE + """
 SELECT * FROM site_q WHERE missing_count > 0 OR variable ORDER BY pos LIMIT 1000""")
def sites_of_interest(spark, d):
    return rounded(ql.sites_of_interest(samples(spark, d)), "missing_rate")


@query("site_track", "WITH {cells}, " + _COMPLETE + """
 SELECT least(bins - 1, floor((pos - 1) / len * bins))::BIGINT AS bin, count(*) AS sites,
 round(avg(variable::INT), 9) AS variable_fraction,
 round(avg(parsimony_informative::INT), 9) AS informative_fraction,
 round(avg((sample_count - callable_count) / sample_count), 9) AS missing_mean
 FROM site_q, (SELECT max(pos) AS len, least(828, greatest(40, max(pos))) AS bins FROM cells) GROUP BY ALL""")
def site_track(spark, d):
    sites = ql.site_quality(samples(spark, d))
    length = sites.agg(F.max("pos")).scalar()
    return rounded(ql.site_track(sites, length),
                   "variable_fraction", "informative_fraction", "missing_mean")


_HAP = """hap AS (SELECT sequence, min(sample_idx) AS first_idx, count(*) AS n FROM samples GROUP BY sequence),
lab AS (SELECT *, row_number() OVER (ORDER BY first_idx) AS hap_idx FROM hap)"""


@query("haplotypes", "WITH {samples}, " + _HAP + """
 SELECT hap_idx, 'H' || hap_idx AS haplotype, sequence, n, first_idx FROM lab""")
def haplotypes(spark, d):
    return hp.identify_haplotypes(samples(spark, d))[0]


@query("haplotype_assignments", "WITH {samples}, " + _HAP + """
 SELECT sample_idx, sample, hap_idx, 'H' || hap_idx AS haplotype FROM samples JOIN lab USING (sequence)""")
def haplotype_assignments(spark, d):
    return hp.identify_haplotypes(samples(spark, d))[1].select(
        "sample_idx", "sample", "hap_idx", "haplotype")


_CUBE = """cube AS (SELECT 'overall' AS scope, 'Overall' AS grp, pos, base, count(*) AS n FROM cells GROUP BY ALL
 UNION ALL SELECT 'group', grp, pos, base, count(*) FROM cells GROUP BY ALL)"""


@query("site_counts", "WITH {cells}, " + _CUBE + " SELECT * FROM cube")
def site_counts(spark, d):
    return dv.site_counts(samples(spark, d), "grp")


_SCOPED = _CUBE + """, ss AS (SELECT scope, grp, pos, sum(n)::BIGINT AS total,
 coalesce(sum(n) FILTER (base IN ('A','C','G','T')), 0)::BIGINT AS called,
 count(*) FILTER (base IN ('A','C','G','T')) AS alleles,
 coalesce(sum(n * n) FILTER (base IN ('A','C','G','T')), 0) AS sq FROM cube GROUP BY ALL)"""


@query("complete_sites", "WITH {cells}, " + _SCOPED + """
 SELECT scope, grp, pos, alleles FROM ss WHERE called = total""")
def complete_sites(spark, d):
    return dv.complete_sites(samples(spark, d), "grp")


@query("segregating_sites", "WITH {cells}, " + _SCOPED + """
 SELECT scope, grp, max(total) AS sample_count, count(*) FILTER (called = total) AS callable_site_count,
 count(*) FILTER (called = total AND alleles >= 2) AS segregating_site_count FROM ss GROUP BY ALL""")
def segregating_sites(spark, d):
    return dv.segregating_sites(samples(spark, d), "grp", "complete")


@query("segregating_sites_pairwise", "WITH {cells}, " + _SCOPED + """
 SELECT scope, grp, max(total) AS sample_count, count(*) FILTER (called >= 2) AS callable_site_count,
 count(*) FILTER (called >= 2 AND alleles >= 2) AS segregating_site_count FROM ss GROUP BY ALL""")
def segregating_sites_pairwise(spark, d):
    return dv.segregating_sites(samples(spark, d), "grp", "pairwise")


_STATS = _SCOPED + """, st AS (SELECT scope, grp, max(total) AS n, count(*) FILTER (called = total) AS comp,
 count(*) FILTER (called = total AND alleles >= 2) AS seg,
 coalesce(sum((called * called - sq) / 2) FILTER (called = total), 0)::DOUBLE AS diffs,
 count(*) FILTER (called >= 2) AS pw, count(*) FILTER (called >= 2 AND alleles >= 2) AS pw_seg,
 coalesce(sum(1.0 / list_sum(list_transform(range(1, called), lambda i: 1.0::DOUBLE / i))) FILTER (called >= 2 AND alleles >= 2), 0)::DOUBLE AS theta_sum
 FROM ss GROUP BY ALL),
d1 AS (SELECT *, n * (n - 1) / 2.0 AS prs,
 CASE WHEN n >= 2 THEN list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / i)) END AS a1,
 CASE WHEN n >= 2 THEN list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / (i * i))) END AS a2,
 CASE WHEN n >= 2 AND comp > 0 THEN diffs / (n * (n - 1) / 2.0) END AS k FROM st),
d2 AS (SELECT *, (n + 1.0) / (3.0 * (n - 1.0)) - 1.0 / a1 AS c1,
 2.0 * (n * n + n + 3.0) / (9.0 * n * (n - 1.0)) - (n + 2.0) / (a1 * n) + a2 / (a1 * a1) AS c2 FROM d1),
dd AS (SELECT *, CASE WHEN n >= 2 AND seg > 0 AND c1 / a1 * seg + c2 / (a1 * a1 + a2) * seg * (seg - 1) > 0
 THEN (k - seg / a1) / sqrt(c1 / a1 * seg + c2 / (a1 * a1 + a2) * seg * (seg - 1)) END AS td FROM d2)"""


@query("nucleotide_diversity", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, CASE WHEN n >= 2 AND comp > 0 THEN n * (n - 1) // 2 ELSE 0 END AS comparable_pair_count,
 round(k / nullif(comp, 0), 9) AS nucleotide_diversity FROM dd""")
def nucleotide_diversity(spark, d):
    return rounded(dv.nucleotide_diversity(samples(spark, d), "grp", "complete"),
                   "nucleotide_diversity")


_PAIRS = """coll AS (SELECT sequence, coalesce(nullif(trim(grp), ''), '(missing)') AS grp,
 min(sample_idx) AS id, count(*) AS n FROM samples GROUP BY ALL),
pc AS (SELECT id, q.pos, substr(sequence, q.pos, 1) AS base FROM coll, (SELECT unnest(range(1, 65)) AS pos) q
 WHERE substr(sequence, q.pos, 1) IN ('A','C','G','T')),
pd AS (SELECT a.id AS i, b.id AS j, count(*) AS valid, count(*) FILTER (a.base <> b.base) AS diff
 FROM pc a JOIN pc b ON a.pos = b.pos AND a.id < b.id GROUP BY ALL),
gsum AS (SELECT least(x.grp, y.grp) AS ga, greatest(x.grp, y.grp) AS gb, x.n * y.n AS w,
 x.n * y.n * diff / valid AS dist FROM pd JOIN coll x ON x.id = i JOIN coll y ON y.id = j
 UNION ALL SELECT grp, grp, n * (n - 1) // 2, 0 FROM coll WHERE id IN (SELECT id FROM pc)),
gp AS (SELECT ga, gb, sum(w)::BIGINT AS pairs, sum(dist) AS dist FROM gsum GROUP BY ALL)"""
_PI_PAIRWISE = _PAIRS + """, pip AS (
 SELECT 'group' AS scope, ga AS grp, pairs, dist / nullif(pairs, 0) AS pi FROM gp WHERE ga = gb
 UNION ALL SELECT 'overall', 'Overall', sum(pairs)::BIGINT, sum(dist) / sum(pairs) FROM gp)"""


@query("nucleotide_diversity_pairwise", "WITH {samples}, " + _PI_PAIRWISE + """
 SELECT scope, grp, pairs AS comparable_pair_count, round(pi, 9) AS nucleotide_diversity FROM pip""")
def nucleotide_diversity_pairwise(spark, d):
    return rounded(dv.nucleotide_diversity(samples(spark, d), "grp", "pairwise"),
                   "nucleotide_diversity")


@query("watterson_theta", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, CASE WHEN n >= 2 AND comp > 0 THEN round(seg / (a1 * comp), 9) END AS watterson_theta FROM dd""")
def watterson_theta(spark, d):
    return rounded(dv.watterson_theta(samples(spark, d), "grp", "complete"), "watterson_theta")


@query("watterson_theta_pairwise", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, CASE WHEN n >= 2 AND pw > 0 THEN round(theta_sum / pw, 9) END AS watterson_theta FROM dd""")
def watterson_theta_pairwise(spark, d):
    return rounded(dv.watterson_theta(samples(spark, d), "grp", "pairwise"), "watterson_theta")


@query("mean_pairwise_differences", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, round(k, 9) AS mean_pairwise_differences FROM dd""")
def mean_pairwise_differences(spark, d):
    return rounded(dv.mean_pairwise_differences(samples(spark, d), "grp"),
                   "mean_pairwise_differences")


@query("tajimas_d", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, comp AS tajima_callable_site_count, round(td, 9) AS tajima_d FROM dd""")
def tajimas_d(spark, d):
    return rounded(dv.tajimas_d(samples(spark, d), "grp"), "tajima_d")


@query("harmonic_numbers", "WITH {cells}, " + _STATS + """
 SELECT scope, grp, n, round(a1, 9) AS a1, round(a2, 9) AS a2 FROM dd""")
def harmonic_numbers(spark, d):
    from sitewise.functions.sequence import harmonic
    stats = dv.site_statistics(dv.site_counts(samples(spark, d), "grp"))
    return rounded(stats.select("scope", "grp", "n", harmonic(F.col("n")).alias("a1"),
                                harmonic(F.col("n"), 2).alias("a2")), "a1", "a2")


_SIG = """gcomp AS (SELECT pos FROM ss WHERE scope = 'overall' AND called = total),
sig AS (SELECT sample_idx, grp, coalesce(string_agg(base, '' ORDER BY pos) FILTER (pos IN (SELECT pos FROM gcomp)), '') AS sig
 FROM cells GROUP BY sample_idx, grp),
sg AS (SELECT grp, sig, count(*) AS n, min(sample_idx) AS first_idx FROM sig GROUP BY ALL),
sa AS (SELECT sig, sum(n)::BIGINT AS n, count(*) AS groups, min(first_idx) AS first_idx FROM sg GROUP BY sig),
hm AS (SELECT 'group' AS scope, grp, sum(n)::BIGINT AS n, count(*) AS haplotype_richness,
  count(*) FILTER (sig IN (SELECT sig FROM sa WHERE groups = 1)) AS private_haplotype_count,
  CASE WHEN sum(n) >= 2 THEN sum(n) / (sum(n) - 1.0) * (1.0 - sum(n * n) / (sum(n) * sum(n))) END AS hd FROM sg GROUP BY grp
 UNION ALL SELECT 'overall', 'Overall', sum(n)::BIGINT, count(*), NULL,
  CASE WHEN sum(n) >= 2 THEN sum(n) / (sum(n) - 1.0) * (1.0 - sum(n * n) / (sum(n) * sum(n))) END FROM sa)"""


@query("haplotype_diversity", "WITH {cells}, " + _SCOPED + ", " + _SIG + """
 SELECT scope, grp, n, haplotype_richness, private_haplotype_count, round(hd, 9) AS haplotype_diversity FROM hm""")
def haplotype_diversity(spark, d):
    return rounded(dv.haplotype_diversity(samples(spark, d), "grp"), "haplotype_diversity")


@query("private_haplotypes", "WITH {cells}, " + _SCOPED + ", " + _SIG + """
 SELECT grp, 'H' || k AS haplotype, sg.n FROM sg JOIN (SELECT sig, groups, row_number() OVER (ORDER BY first_idx) AS k FROM sa) USING (sig)
 WHERE groups = 1""")
def private_haplotypes(spark, d):
    return dv.private_haplotypes(samples(spark, d), "grp")


_GD = """ SELECT d.grp AS label, d.n AS sample_count, CALL AS callable_site_count, SEG AS segregating_site_count,
 CMP AS comparable_pair_count, (SELECT comp FROM dd WHERE scope = 'overall') AS haplotype_site_count,
 haplotype_richness, private_haplotype_count, round(hd, 9) AS haplotype_diversity, round(PI, 9) AS nucleotide_diversity,
 round(THETA, 9) AS watterson_theta, round(k, 9) AS mean_pairwise_differences, round(td, 9) AS tajima_d,
 comp AS tajima_callable_site_count FROM dd d JOIN hm ON hm.scope = d.scope AND hm.grp = d.grp"""
_GD_COMPLETE = (_GD.replace("CALL", "comp").replace("SEG", "seg")
                .replace("CMP", "CASE WHEN d.n >= 2 AND comp > 0 THEN d.n * (d.n - 1) // 2 ELSE 0 END")
                .replace("PI", "k / nullif(comp, 0)")
                .replace("THETA", "CASE WHEN d.n >= 2 AND comp > 0 THEN seg / (a1 * comp) END"))
_GD_PAIRWISE = (_GD.replace("CALL", "pw").replace("SEG", "pw_seg").replace("CMP", "pairs")
                .replace("PI", "pi")
                .replace("THETA", "CASE WHEN d.n >= 2 AND pw > 0 THEN theta_sum / pw END")
                + " LEFT JOIN pip ON pip.scope = d.scope AND pip.grp = d.grp")


def _gd(df):
    return rounded(df, "haplotype_diversity", "nucleotide_diversity", "watterson_theta",
                   "mean_pairwise_differences", "tajima_d")


@query("group_diversity", "WITH {cells}, " + _STATS + ", " + _SIG + _GD_COMPLETE)
def group_diversity(spark, d):
    return _gd(dv.group_diversity(samples(spark, d), "grp"))


@query("group_diversity_pairwise",
       "WITH {cells}, " + _STATS + ", " + _SIG + ", " + _PI_PAIRWISE + _GD_PAIRWISE)
def group_diversity_pairwise(spark, d):
    return _gd(dv.group_diversity(samples(spark, d), "grp", "pairwise"))


_MISMATCH = """mc AS (SELECT scope, s.grp AS grp, pos, alleles FROM ss s WHERE called = total),
msk AS (SELECT m.scope, m.grp, c.sample_idx, string_agg(base, '' ORDER BY pos) AS sig
 FROM cells c JOIN mc m USING (pos) WHERE m.scope = 'overall' OR m.grp = c.grp GROUP BY ALL),
mu AS (SELECT scope, grp, sig, count(*) AS n, row_number() OVER () AS id FROM msk GROUP BY ALL),
mb AS (SELECT a.scope, a.grp, hamming(a.sig, b.sig) AS differences, sum(a.n * b.n) AS c
 FROM mu a JOIN mu b ON a.scope = b.scope AND a.grp = b.grp AND a.id < b.id GROUP BY ALL
 UNION ALL SELECT scope, grp, 0, sum(n * (n - 1) // 2) FROM mu GROUP BY ALL),
mm AS (SELECT scope, grp, differences::BIGINT AS differences, sum(c)::BIGINT AS pair_count FROM mb
 GROUP BY ALL HAVING sum(c) > 0)"""


@query("mismatch_distribution", "WITH {cells}, " + _SCOPED + ", " + _MISMATCH + """
 SELECT *, round(pair_count / sum(pair_count) OVER (PARTITION BY scope, grp), 9) AS frequency FROM mm""")
def mismatch_distribution(spark, d):
    return rounded(dv.mismatch_distribution(samples(spark, d), "grp"), "frequency")


@query("mismatch_summary", "WITH {cells}, " + _SCOPED + ", " + _MISMATCH + """,
 me AS (SELECT scope, grp, sum(pair_count)::BIGINT AS pair_count, sum(pair_count * differences) / sum(pair_count) AS mean,
  max(pair_count) AS top FROM mm GROUP BY ALL)
 SELECT me.scope, me.grp, any_value(me.pair_count) AS pair_count, round(any_value(mean), 9) AS mean_differences,
 round(sum(mm.pair_count * (differences - mean) ** 2) / sum(mm.pair_count), 9) AS variance_differences,
 min(differences) FILTER (mm.pair_count = top) AS mode_differences
 FROM me JOIN mm ON me.scope = mm.scope AND me.grp = mm.grp GROUP BY me.scope, me.grp""")
def mismatch_summary(spark, d):
    bins = dv.mismatch_distribution(samples(spark, d), "grp")
    return rounded(dv.mismatch_summary(bins), "mean_differences", "variance_differences")
