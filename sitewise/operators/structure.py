"""Population differentiation: within and between diversity, Hudson FST, AMOVA, permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.sequence import site_runs, take_sites
from sitewise.operators.diversity import (
    grouped, overall_complete, scope_sites, site_counts)
from sitewise.operators.draws import drawn_alleles, drawn_labels
from sitewise.operators.pairs import (
    _placed, _split, block_pairs, codes, compare, group_pair_sums)
from sitewise.schema import CALLABLE, COMPLETE, PAIRWISE, check_policy
from sitewise.storage import cut

TIE_DIGITS = 12
# Replicates whose label counts travel together to one block pair.
REPLICATE_SLICE = 50


def _half_pairs(n: Column) -> Column:
    d = n.cast("double")
    return d * (d - 1.0) / 2.0


def group_sites(counts: DataFrame) -> DataFrame:
    """One row per group and site with the four allele counts side by side."""
    one = [F.coalesce(F.sum(F.when(F.col("base") == b, F.col("n"))), F.lit(0)).cast("double").alias(f"c{b}")
           for b in CALLABLE]
    sites = (counts.where("scope = 'group'").groupBy("grp", "pos")
             .agg(F.sum("n").cast("double").alias("n"), *one))
    called = sum((F.col(f"c{b}") for b in CALLABLE), F.lit(0.0))
    squares = sum((F.col(f"c{b}") * F.col(f"c{b}") for b in CALLABLE), F.lit(0.0))
    return (sites.withColumn("complete", called == F.col("n"))
            .withColumn("within", (called * called - squares) / 2.0))


def _group_pairs(sites: DataFrame) -> DataFrame:
    """Group pairs a < b, joined per site; sums over the sites complete in both groups."""
    def side(s: str) -> DataFrame:
        return sites.select("pos", *[F.col(c).alias(f"{s}_{c}") for c in
                                     ("grp", "n", "complete", "within", *(f"c{b}" for b in CALLABLE))])
    joined = side("a").join(side("b"), "pos").where("a_grp < b_grp")
    both = F.col("a_complete") & F.col("b_complete")
    shared = sum((F.col(f"a_c{b}") * F.col(f"b_c{b}") for b in CALLABLE), F.lit(0.0))
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(both, value)), F.lit(0.0))
    return joined.groupBy(F.col("a_grp").alias("group_a"), F.col("b_grp").alias("group_b")).agg(
        F.max("a_n").alias("n_a"), F.max("b_n").alias("n_b"),
        F.count_if(both).alias("sites"),
        total(F.col("a_within")).alias("within_a"), total(F.col("b_within")).alias("within_b"),
        total(F.col("a_n") * F.col("b_n") - shared).alias("between"))


def _mean(total: Column, pairs: Column, sites: Column) -> Column:
    return F.when((pairs > 0) & (sites > 0), total / pairs / sites)


def hudson_fst(within_a: Column, within_b: Column, between: Column) -> Column:
    return F.when(between > 0, 1.0 - ((within_a + within_b) / 2.0) / between)


def group_pi(samples: DataFrame, group: str, policy: str = COMPLETE) -> DataFrame:
    """Mean p-distance within each group and between each pair of groups.

    Complete deletion uses the sites callable in every sample.
    """
    check_policy(policy)
    if policy == PAIRWISE:
        sums = group_pair_sums(grouped(samples, group))
        return sums.select("grp_a", "grp_b",
                           (F.col("distance_sum") / F.nullif("pairs", F.lit(0))).alias("pi"))
    counts = cut(site_counts(samples, group), "site-counts")
    kept = group_sites(counts).join(overall_complete(counts).select("pos"), "pos", "left_semi")
    within = kept.groupBy(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b")).agg(
        _mean(F.sum("within"), _half_pairs(F.max("n")), F.count(F.lit(1))).alias("pi"))
    between = _group_pairs(kept).select(
        F.col("group_a").alias("grp_a"), F.col("group_b").alias("grp_b"),
        _mean(F.col("between"), F.col("n_a") * F.col("n_b"), F.col("sites")).alias("pi"))
    return within.unionByName(between)


def pairwise_fst(samples: DataFrame, group: str, policy: str = COMPLETE) -> DataFrame:
    """Hudson FST per pair of groups; complete deletion uses the sites complete in both groups."""
    check_policy(policy)
    if policy == COMPLETE:
        pairs = _group_pairs(group_sites(cut(site_counts(samples, group), "site-counts")))
        n_a, n_b, sites = F.col("n_a"), F.col("n_b"), F.col("sites")
        out = pairs.select(
            "group_a", "group_b", n_a.cast("bigint").alias("sample_count_a"),
            n_b.cast("bigint").alias("sample_count_b"),
            _mean(F.col("within_a"), _half_pairs(n_a), sites).alias("pi_within_a"),
            _mean(F.col("within_b"), _half_pairs(n_b), sites).alias("pi_within_b"),
            _mean(F.col("between"), n_a * n_b, sites).alias("pi_between"))
    else:
        base = grouped(samples, group)
        sums = cut(group_pair_sums(base), "group-pairs").withColumn(
            "pi", F.col("distance_sum") / F.nullif("pairs", F.lit(0)))
        sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        own = sums.where("grp_a = grp_b").select(F.col("grp_a").alias("g"), "pi").join(
            sizes.withColumnRenamed("grp", "g"), "g", "right")
        def side(s: str) -> DataFrame:
            return own.select(F.col("g").alias(f"group_{s}"), F.col("n").alias(f"sample_count_{s}"),
                              F.col("pi").alias(f"pi_within_{s}"))
        out = (sums.where("grp_a <> grp_b")
               .select(F.col("grp_a").alias("group_a"), F.col("grp_b").alias("group_b"),
                       F.col("pi").alias("pi_between"))
               .join(side("a"), "group_a").join(side("b"), "group_b"))
    return out.withColumn("fst", hudson_fst(F.col("pi_within_a"), F.col("pi_within_b"),
                                            F.col("pi_between")))


def global_fst(samples: DataFrame, group: str, policy: str = COMPLETE) -> DataFrame:
    """Hudson FST over all groups with equal weights; NULL unless every group has two samples."""
    pi = group_pi(samples, group, policy)
    inside = F.col("grp_a") == F.col("grp_b")
    stats = pi.agg(
        F.count_if(inside).alias("groups"),
        F.count_if(inside & F.col("pi").isNotNull()).alias("w_n"),
        F.avg(F.when(inside, F.col("pi"))).alias("within"),
        F.count_if(~inside & F.col("pi").isNotNull()).alias("b_n"),
        F.avg(F.when(~inside, F.col("pi"))).alias("between"))
    g = F.col("groups")
    whole = (g >= 2) & (F.col("w_n") == g) & (F.col("b_n") * 2 == g * (g - 1))
    return stats.select(
        g.alias("group_count"), F.col("within").alias("mean_within"),
        F.col("between").alias("mean_between"),
        F.when(whole & (F.col("between") > 0), 1.0 - F.col("within") / F.col("between"))
        .alias("global_fst"))


def _amova_columns(df: DataFrame) -> DataFrame:
    """Variance components from columns n, g, sum_sq (sum of squared sizes), ss_total, ss_within."""
    n, g = F.col("n"), F.col("g")
    ok = (g >= 2) & (n > g) & F.col("ss_total").isNotNull() & F.col("ss_within").isNotNull()
    df = (df.withColumn("__n_c", F.when(ok, (n - F.col("sum_sq") / n) / (g - 1)))
          .withColumn("__ok", ok & (F.col("__n_c") > 0)))
    keep = F.col("__ok")
    df = (df.withColumn("ss_among", F.when(keep, F.col("ss_total") - F.col("ss_within")))
          .withColumn("ss_within", F.when(keep, F.col("ss_within")))
          .withColumn("ms_among", F.when(keep, F.col("ss_among") / (g - 1)))
          .withColumn("ms_within", F.when(keep, F.col("ss_within") / (n - g)))
          .withColumn("variance_within", F.col("ms_within"))
          .withColumn("variance_among", (F.col("ms_among") - F.col("ms_within")) / F.col("__n_c")))
    total = F.nullif(F.col("variance_among") + F.col("variance_within"), F.lit(0.0))
    return (df.withColumn("percent_among", F.col("variance_among") / total * 100.0)
            .withColumn("percent_within", F.col("variance_within") / total * 100.0)
            .withColumn("phi_st", F.col("variance_among") / total).drop("__n_c", "__ok"))


def amova(samples: DataFrame, group: str) -> DataFrame:
    """One-level AMOVA on p-distances over the sites callable in every sample (one row)."""
    counts = cut(site_counts(samples, group), "site-counts")
    sites = scope_sites(counts)
    kept = sites.join(overall_complete(counts).select("pos"), "pos", "left_semi")
    per_scope = kept.groupBy("scope", "grp").agg(
        F.sum("pair_differences").alias("diffs"), F.count(F.lit(1)).alias("sites"))
    sizes = sites.groupBy("scope", "grp").agg(F.max("total").cast("double").alias("n"))
    rows = sizes.join(per_scope, ["scope", "grp"], "left")
    overall = F.col("scope") == "overall"
    ss = F.col("diffs") / F.col("sites") / F.col("n")
    one = rows.agg(
        F.max(F.when(overall, F.col("n"))).alias("n"),
        F.count_if(~overall).cast("double").alias("g"),
        F.sum(F.when(~overall, F.col("n") * F.col("n"))).alias("sum_sq"),
        F.max(F.when(overall, ss)).alias("ss_total"),
        F.sum(F.when(~overall, ss)).alias("ss_within"),
        F.coalesce(F.max(F.when(overall, F.col("sites"))), F.lit(0)).alias("callable_site_count"))
    n, g = F.col("n"), F.col("g")
    return _amova_columns(one).select(
        n.cast("bigint").alias("sample_count"), g.cast("bigint").alias("group_count"),
        "callable_site_count",
        F.greatest(F.lit(0), (g - 1)).cast("bigint").alias("df_among"),
        F.greatest(F.lit(0), (n - g)).cast("bigint").alias("df_within"),
        "ss_among", "ss_within", "ms_among", "ms_within", "variance_among", "variance_within",
        "percent_among", "percent_within", "phi_st")


def group_sizes(members: DataFrame) -> list[tuple[str, int]]:
    """Groups and their sizes from ``members(grp, n)``, in the order of their names; the labels a permutation deals out."""
    return sorted((r["grp"], r["n"]) for r in members.groupBy("grp").agg(F.sum("n").alias("n")).collect())


def permutation_statistics(samples: DataFrame, group: str, permutations: int, seed: int) -> DataFrame:
    """Global FST and phi_st per replicate (complete deletion); ``rep`` 0 is the observed table.

    A replicate is a draw of group counts for every haplotype (``draws``), and a haplotype is
    represented only by the alleles in which it differs from the most common sequence. Both meet
    inside a task, which returns allele counts; samples never meet replicates.
    """
    if not 0 <= permutations <= 100_000:
        raise ValueError("permutation count must be between 0 and 100000")
    counts = cut(site_counts(samples, group), "site-counts")
    complete = overall_complete(counts)
    variable = complete.where("alleles >= 2").select("pos")
    major = (counts.where("scope = 'overall'").join(variable, "pos", "left_semi")
             .groupBy("pos").agg(F.max(F.struct("n", "base"))["base"].alias("major")))
    runs = site_runs(complete.select("pos"))
    base = grouped(samples, group)
    masked = base.withColumn("__runs", runs).withColumn(
        "signature", take_sites(F.col("sequence"), F.col("__runs"))).withColumn(
        "signature", F.sha2("signature", 256))
    keyed = cut(masked.select("sample_idx", "grp", "signature"), "signatures")
    # the first sample of a haplotype stands for it: a short key that cannot collide
    firsts = keyed.groupBy("signature").agg(F.min("sample_idx").alias("fingerprint"))
    members = cut(keyed.join(firsts, "signature").groupBy("grp", "fingerprint").agg(F.count(F.lit(1)).alias("n")), "members")
    units = firsts.select(F.col("fingerprint").alias("sample_idx"), "fingerprint")
    minor = cut(base.join(units, "sample_idx")
                .select("fingerprint", F.posexplode(F.split("sequence", "")).alias("p", "base"))
                .withColumn("pos", (F.col("p") + 1).cast("bigint"))
                .join(major, "pos").where("base <> major")
                .select("fingerprint", "pos", "base"), "minor-alleles")

    sizes = members.groupBy("grp").agg(F.sum("n").alias("n"))
    groups = group_sizes(members)
    numbered = minor.select("fingerprint", (F.col("pos") * 256 + F.ascii("base")).alias("allele"))
    drawn = members.join(numbered, "fingerprint").select(
        F.lit(0).alias("rep"), "grp", "allele", F.col("n").cast("double").alias("c"))
    if permutations and groups:
        own = numbered.groupBy("fingerprint").agg(F.sort_array(F.collect_list("allele")).alias("alleles"))
        none = F.expr("cast(array() AS array<bigint>)")
        haplotypes = (members.groupBy("fingerprint").agg(F.sum("n").alias("n"))
                      .join(own, "fingerprint", "left")
                      .select("fingerprint", "n", F.coalesce("alleles", none).alias("alleles")))
        drawn = drawn.unionByName(drawn_alleles(
            haplotypes, "fingerprint", "alleles", major.count(), groups, permutations, seed))
    reps = members.sparkSession.range(permutations + 1).select(F.col("id").cast("int").alias("rep"))
    alleles = (drawn.groupBy("rep", "grp", "allele").agg(F.sum("c").alias("c"))
               .select("rep", "grp", F.expr("allele div 256").alias("pos"), F.expr("allele % 256").alias("base"), "c")
               .join(sizes.select("grp", F.col("n").cast("double").alias("size")), "grp"))
    g = float(len(groups))
    per_group_site = alleles.groupBy("rep", "grp", "pos", "size").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    size, m = F.col("size"), F.col("m")
    # differing pairs at the site, with the major count size - m
    differing = (size * size - F.col("sq") - (size - m) * (size - m)) / 2.0
    within = per_group_site.groupBy("rep", "grp", "size").agg(F.sum(differing).alias("diff"))
    within = within.groupBy("rep").agg(
        F.sum(F.col("diff") / F.nullif(size * (size - 1.0) / 2.0, F.lit(0.0))).alias("pi_sum"),
        F.sum(F.col("diff") / size).alias("ss_within"))
    major_part = per_group_site.groupBy("rep", "pos").agg(
        F.sum(m / size).alias("s1"), F.sum((m / size) * (m / size)).alias("s2"))
    p_major = F.lit(g) - F.col("s1")
    q_major = F.lit(g) - 2.0 * F.col("s1") + F.col("s2")
    major_part = major_part.select("rep", (p_major * p_major - q_major).alias("same"), F.lit(1).alias("site"))
    share = F.col("c") / size
    minor_part = (alleles.groupBy("rep", "pos", "base")
                  .agg(F.sum(share).alias("p"), F.sum(share * share).alias("q"))
                  .select("rep", (F.col("p") * F.col("p") - F.col("q")).alias("same"), F.lit(0).alias("site")))
    between = major_part.unionByName(minor_part).groupBy("rep").agg(
        ((F.sum("site") * g * (g - 1.0) - F.sum("same")) / 2.0).alias("between_sum"))
    scope = sizes.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("g"),
                      F.sum(F.col("n").cast("double") * F.col("n")).alias("sum_sq"),
                      F.min("n").alias("smallest"))
    overall = (scope_sites(counts).where("scope = 'overall' AND complete")
               .agg(F.sum("pair_differences").alias("diffs"), F.count(F.lit(1)).alias("sites")))
    constants = {k: scope.select(k).scalar() for k in ("n", "g", "sum_sq", "smallest")}
    constants |= {k: overall.select(k).scalar() for k in ("diffs", "sites")}
    table = reps.join(within, "rep", "left").join(between, "rep", "left")
    for name, value in constants.items():
        table = table.withColumn(name, value)
    zero = F.lit(0.0)
    has = F.col("sites") > 0
    mean_within = F.coalesce("pi_sum", zero) / F.col("g")
    mean_between = F.coalesce("between_sum", zero) / F.nullif(F.col("g") * (F.col("g") - 1.0) / 2.0, zero)
    valid = has & (F.col("g") >= 2) & (F.col("smallest") >= 2) & (mean_between > 0)
    table = (table.withColumn("fst", F.when(valid, 1.0 - mean_within / mean_between))
             .withColumn("ss_total", F.when(has, F.col("diffs") / F.col("sites") / F.col("n")))
             .withColumn("ss_within", F.when(has, F.coalesce("ss_within", zero) / F.col("sites"))))
    return _amova_columns(table).select("rep", "fst", "phi_st")


def pairwise_permutation_fst(samples: DataFrame, group: str, permutations: int, seed: int) -> DataFrame:
    """Global FST per replicate under pairwise deletion: ``rep, fst``; ``rep`` 0 is observed.

    Labels are drawn for distinct sequences (``draws``), not samples. Distances of distinct sequences are compared block by block; a block pair receives the
    label counts of its own sequences for a slice of the replicates and returns group sums.
    """
    base = grouped(samples, group).withColumn("fingerprint", F.sha2("sequence", 256))
    units = cut(base.groupBy("fingerprint").agg(F.min("sample_idx").alias("idx"), F.first("sequence").alias("sequence")), "units")
    copies = cut(base.groupBy("grp", "fingerprint").agg(F.count(F.lit(1)).alias("n")).join(
        units.select("fingerprint", "idx"), "fingerprint"), "members")
    groups = group_sizes(copies)
    dealt = copies.select(F.lit(0).alias("rep"), "grp", "idx", "n")
    if permutations and groups:
        dealt = dealt.unionByName(drawn_labels(
            copies.groupBy("idx").agg(F.sum("n").alias("n")), "idx", groups, permutations, seed))
    placed = cut(_placed(units, "idx"), "units")
    slices = F.explode(F.sequence(F.lit(0), F.lit(permutations // REPLICATE_SLICE))).alias("slice")
    left = block_pairs(placed.select("idx", "sequence", "__block", "__blocks"), "idx", "__block", "__blocks").select("*", slices)
    # fresh columns: both sides of the cogroup come from one table
    where = placed.select(*[F.col(c).alias(c) for c in ("idx", "__block", "__blocks")])
    counts = block_pairs(dealt.join(where, "idx").select(
        "rep", "grp", "idx", "n", "__block", "__blocks", F.expr(f"rep div {REPLICATE_SLICE}").cast("int").alias("slice")),
        "idx", "__block", "__blocks")

    def work(seqs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": [], "a": [], "b": [], "pairs": [], "dist": []})
        if seqs.empty or labels.empty:
            return empty
        lo, hi, same = _split(seqs)
        valid, diff = compare(codes(lo["sequence"]), codes(hi["sequence"]))
        share, known = diff / np.maximum(valid, 1), (valid > 0).astype(float)
        names = np.unique(labels["grp"])
        out = []
        for rep, rows in labels.groupby("rep"):
            def counts_of(side: pd.DataFrame) -> np.ndarray:
                place = pd.Index(side["idx"]).get_indexer(rows["idx"])
                c = np.zeros((len(names), len(side)))
                ok = place >= 0
                np.add.at(c, (np.searchsorted(names, rows["grp"])[ok], place[ok]), rows["n"].to_numpy()[ok])
                return c
            cl = counts_of(lo)
            cr = cl if same else counts_of(hi)
            pairs, dist = cl @ known @ cr.T, cl @ share @ cr.T
            if same:
                own = cl @ np.diag(known)
                pairs, dist = np.triu(pairs), np.triu(dist)
                np.fill_diagonal(pairs, (np.diag(pairs) - own) / 2)
                np.fill_diagonal(dist, np.diag(dist) / 2)
            else:
                pairs = np.triu(pairs) + np.tril(pairs, -1).T
                dist = np.triu(dist) + np.tril(dist, -1).T
            i, j = np.triu_indices(len(names))
            out.append(pd.DataFrame({"rep": int(rep), "a": names[i], "b": names[j], "pairs": pairs[i, j], "dist": dist[i, j]}))
        return pd.concat(out)

    sums = (left.groupBy("__lo", "__hi", "slice").cogroup(counts.groupBy("__lo", "__hi", "slice"))
            .applyInPandas(work, "rep int, a string, b string, pairs double, dist double")
            .groupBy("rep", "a", "b").agg((F.sum("dist") / F.nullif(F.sum("pairs"), F.lit(0.0))).alias("pi")))
    inside = F.col("a") == F.col("b")
    g = len(groups)
    whole = ((F.count_if(inside & F.col("pi").isNotNull()) == g)
             & (F.count_if(~inside & F.col("pi").isNotNull()) == g * (g - 1) // 2))
    within, between = F.avg(F.when(inside, F.col("pi"))), F.avg(F.when(~inside, F.col("pi")))
    usable = F.lit(g >= 2 and min(n for _, n in groups) >= 2)
    return sums.groupBy("rep").agg(
        F.when(usable & whole & (between > 0), 1.0 - within / between).alias("fst"))


def permutation_test(samples: DataFrame, group: str, permutations: int = 999,
                     seed: int = 1729, policy: str = COMPLETE) -> DataFrame:
    """One-sided label-permutation P values of global FST and phi_st.

    P = (extreme + 1) / (valid + 1) with ``>=``; values are compared after rounding to twelve
    digits, so that equal partitions tie whatever the order of summation. The policy concerns
    FST only; AMOVA always uses the sites callable in every sample. Names and sizes of the groups
    are sent to every task.
    """
    check_policy(policy)
    stats = permutation_statistics(samples, group, permutations, seed)
    if policy == PAIRWISE:
        stats = stats.drop("fst").join(pairwise_permutation_fst(samples, group, permutations, seed), "rep", "left")
    stats = cut(stats, "permutations")
    long = stats.select("rep", F.explode(F.array(
        F.struct(F.lit("fst").alias("statistic"), F.round("fst", TIE_DIGITS).alias("value")),
        F.struct(F.lit("phi_st").alias("statistic"), F.round("phi_st", TIE_DIGITS).alias("value"))
    )).alias("s")).select("rep", "s.statistic", "s.value")
    observed = long.where("rep = 0").select("statistic", F.col("value").alias("observed"))
    valid = F.count_if((F.col("rep") > 0) & F.col("value").isNotNull())
    extreme = F.count_if((F.col("rep") > 0) & (F.col("value") >= F.col("observed")))
    return (long.join(observed, "statistic").groupBy("statistic", "observed")
            .agg(valid.alias("permutation_count"), extreme.alias("extreme"))
            .withColumn("p_value", F.when(
                F.col("observed").isNotNull() & (F.col("permutation_count") > 0),
                (F.col("extreme") + 1) / (F.col("permutation_count") + 1))))


def structure_warnings(samples: DataFrame, group: str | None, policy: str) -> DataFrame:
    """Warnings on differentiation; without a group there are fewer than two groups, and none is a singleton."""
    counts = site_counts(samples, group)
    sites = scope_sites(counts)
    overall = F.col("scope") == "overall"
    facts = sites.agg(
        F.count_distinct(F.when(~overall, F.col("grp"))).alias("groups"),
        F.min(F.when(~overall, F.col("total"))).alias("smallest"),
        F.count_if(overall & F.col("complete")).alias("complete"))
    pairwise = F.lit(policy == PAIRWISE)
    rules = [
        ("fewer_than_two_groups", F.col("groups") < 2),
        ("singleton_group", F.lit(group is not None) & (F.col("smallest") < 2)),
        ("amova_without_complete_site", F.col("complete") == 0),
        ("amova_uses_complete_sites", pairwise & (F.col("complete") > 0)),
        ("pairwise_sites_differ", pairwise),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))
    return facts.select(F.lit("structure").alias("scope"), F.explode(codes).alias("code"))


def square_matrix(pairs: DataFrame, left: str, right: str, value: str, labels: DataFrame) -> DataFrame:
    """Symmetric long matrix with a zero diagonal from one row per unordered pair."""
    # both sides come from one reading of the pairs
    sides = F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col")) for r, c in ((left, right), (right, left))])
    both = pairs.select(F.explode(sides).alias("z"), F.col(value).alias("value")).select("z.row", "z.col", "value")
    diagonal = labels.select(F.col(labels.columns[0]).alias("row"),
                             F.col(labels.columns[0]).alias("col"), F.lit(0.0).alias("value"))
    return both.unionByName(diagonal)
