"""File formats, conversions and text rules on hand-written input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sitewise.functions import transforms as tf
from sitewise.operators import network as nw
from sitewise.operators import samples as sm
from sitewise.plans import analyses as an
from sitewise.sources import convert as cv
from sitewise.sources import sequences as sq
from sitewise.sources import tables as tb
from sitewise.sources import vcf
from sitewise.sources.lines import ordered_text, write_lines
from sitewise.storage import scratch_path


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)
    return write


def records(df):
    return [(r["sample"], r["sequence"]) for r in df.orderBy("sample_idx").collect()]


def test_fasta(spark, put):
    path = put("a.fasta", ">one two\r\nac gt\r\nAC\r\n\r\n>b\nNN-\n")
    assert records(sq.read_fasta(spark, path)) == [("one two", "ACGTAC"), ("b", "NN-")]
    assert records(sq.read_fasta(spark, path, clean=True)) == [("one_two", "acgtAC"), ("b", "NN-")]


def test_fasta_order_over_splits(spark, put):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        path = put("big.fasta", "".join(f">r{i}\nACGTACGTAC{'ACGT'[i % 4]}\n" for i in range(300)))
        got = sq.read_fasta(spark, path)
        assert got.rdd.getNumPartitions() > 4
        assert [r["sample"] for r in got.orderBy("sample_idx").collect()] == [f"r{i}" for i in range(300)]
        assert sorted(r["sample_idx"] for r in got.collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_phylip_styles(spark, put):
    want = [("a", "ACGTACGT"), ("b", "ACGAACGA")]
    for name, text in {
        "relaxed": "2 8\na ACGTACGT\nb\tACGA ACGA\n", "interleaved": "2 8\na ACGT\nb ACGA\n\nACGT\nACGA\n",
        "named": "2 8\na ACGT\nb ACGA\na ACGT\nb ACGA\n", "wrapped": "2 8\na ACGT\nACGT\nb ACGA\nACGA\n",
        "strict": "2 8\na         ACGTACGT\nb         ACGAACGA\n"}.items():
        assert records(sq.read_phylip(spark, put(name + ".phy", text))) == want, name
    bad = put("bad.phy", "3 8\na ACGTACGT\nb ACGAACGA\n")
    good = put("good.phy", "1 4\nc ACGT\n")
    with pytest.raises(ValueError, match="bad.phy: record_count"):
        sq.read_phylip(spark, [bad, good])
    sound, issues = sq.read_phylip(spark, [bad, good], on_error="report")
    assert records(sound) == [("c", "ACGT")] and [r["rule"] for r in issues.collect()] == ["record_count"]
    for name, text, rule in (("h", "no header\na ACGT\n", "no_header"), ("l", "1 5\na ACGT\n", "sequence_length"),
                             ("s", "2 4\na ACGT\nb AC\n", "sequence_length"),
                             ("d", "2 4\na ACGT\na ACGG\n", "duplicate_name"), ("e", "2 4\n", "record_count")):
        assert [r["rule"] for r in sq.phylip_issues(spark, put(name + ".phy", text)).collect()] == [rule], name


@pytest.mark.parametrize("write, read, ending", [(sq.write_phylip, sq.read_phylip, "phy"), (sq.write_nexus, sq.read_nexus, "nex")])
def test_parts_of_a_sink_are_one_file(make, spark, write, read, ending):
    rows = [(f"s{i}", "", "ACGTACGT") for i in range(3000)]
    path = f"{scratch_path(spark, 'parts')}.{ending}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write(make(rows), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(path).inputFiles()) >= 4
    assert records(read(spark, path)) == [(s, q) for s, _, q in rows]


def test_nexus_styles(spark, put):
    head = "#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX=2 NCHAR=8;\nFORMAT DATATYPE=DNA MATCHCHAR=.;\nMATRIX\n"
    text = head + "'it''s a' ACGT [c [nested] x]\nb ...A\n\nACGT\n...A\n;\nEND;\n"
    assert records(sq.read_nexus(spark, put("i.nex", text))) == [("it's a", "ACGTACGT"), ("b", "ACGAACGA")]
    deep = head + "[" * 12 + "it's; deep" + "]" * 12 + "'a;[b' ACGTACGT\nb ........\n;\nEND;\n"
    assert records(sq.read_nexus(spark, put("d.nex", deep))) == [("a;[b", "ACGTACGT"), ("b", "ACGTACGT")]
    three = head.replace("NTAX=2", "ntax = 3") + "a ACGTACGT\nb ACGTACGT\n;\nEND;\n"
    for name, broken, rule in (("t", "#NEXUS\nBEGIN TREES;\nEND;\n", "no_matrix"), ("n", "BEGIN DATA;\nEND;\n", "not_nexus"),
                               ("c", head + "a ACGTACGT [open\n;\nEND;\n", "open_comment"), ("k", three, "taxon_count"),
                               ("l", head + "a ACGTACG\nb ACGTACG\n;\nEND;\n", "sequence_length")):
        path = put(name + ".nex", broken)
        assert [r["rule"] for r in sq.nexus_issues(spark, path).collect()] == [rule], name
        with pytest.raises(ValueError, match=f"{name}.nex: {rule}"):
            sq.read_nexus(spark, path)


def test_nexus_sink_rejects_mixed(make, spark):
    with pytest.raises(ValueError):
        sq.write_nexus(make([("a", "", "ACGT"), ("b", "", "ACGU")]), scratch_path(spark, "x"))


def test_vcf_rules(spark, put):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    body = "c\t9\t.\tA\tC\t.\t.\t.\tGT\t0/1\t./.\nc\t2\t.\tg\tGA,T\t.\t.\t.\tDP:GT\t3:1\t4:2\n"
    bad = "c\t0\t.\tA\tC\t.\t.\t.\tGT\t0\t0\nc\tx\t.\tA\tC\t.\t.\t.\tGT\t0\t0\nc\t5\t.\tA\t<DEL>\t.\t.\t.\tGT\t0\t0\nc\t6\t.\tA\t.\t.\t.\t.\tGT\t0\t0\nc\t7\t.\tA\tC\t.\t.\t.\tGT\t0\n"
    variants, genotypes, violations = vcf.read_vcf(spark, put("v.vcf", head + body + bad))
    assert sorted(r["code"] for r in violations.collect()) == ["empty_allele", "incomplete_record", "invalid_position", "position_not_positive", "symbolic_allele"]
    assert records(vcf.vcf_to_alignment(variants, genotypes)) == [("s1", "GAM"), ("s2", "T-N")]
    full = vcf.vcf_to_alignment(variants, genotypes, "TGCCCCCCATT")
    assert records(full) == [("s1", "TGACCCCCCMTT"), ("s2", "TT-CCCCCCNTT")]
    with pytest.raises(ValueError):
        vcf.vcf_to_alignment(variants, genotypes, "TTCCCCCCATT")
    with pytest.raises(ValueError):
        vcf.vcf_to_alignment(variants.withColumn("ref", F.lit("ACGTACGTAC")), genotypes)


@pytest.mark.parametrize("seqs, want", [
    (["ACGTA", "ACTTA", "ACGTA"], [(3, "G", "T", "NS=3;TYPE=SNP")]),
    (["ACGTA", "A--TA"], [(1, "ACG", "A", "NS=2;TYPE=COMPLEX")]),
    (["--GTA", "ACGTC"], [(1, "G", "ACG", "NS=2;TYPE=COMPLEX"), (3, "A", "C", "NS=2;TYPE=SNP")]),
    (["A-CUA", "AGCGA", "ATCGA"], [(1, "A", "AG,AT", "NS=3;TYPE=COMPLEX"), (3, "T", "G", "NS=3;TYPE=SNP")]),
])
def test_variant_calling(make, seqs, want):
    variants, _ = vcf.alignment_to_variants(make([(f"s{i}", "", s) for i, s in enumerate(seqs)]))
    assert [(r["pos"], r["ref"], ",".join(r["alts"]), r["info"]) for r in variants.orderBy("pos").collect()] == want


def test_variant_round_trip_and_errors(make, spark):
    rows = make([("a", "", "ACGTACGT"), ("b", "", "ACTTACGA"), ("c", "", "GCTTACGT")])
    base = scratch_path(spark, "trip")
    sq.write_fasta(rows, base + ".fasta")
    cv.convert(spark, base + ".fasta", base + ".vcf", "vcf")
    back = cv.read_sequences(spark, base + ".vcf", reference="ACGTACGT")
    assert records(back) == [("a", "ACGTACGT"), ("b", "ACTTACGA"), ("c", "GCTTACGT")]
    with pytest.raises(ValueError):
        cv.convert(spark, base + ".fasta", base + "2.fasta", "fasta")
    with pytest.raises(ValueError):
        vcf.alignment_to_variants(make([("a", "", "ACGT"), ("b", "", "ACGT")]))


def test_records_of_one_position_stay_apart(spark, put):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    body = "c\t2\tr1\tA\tC\t7\tq\tX=1\tGT\t1\t0\nc\t2\tr2\tA\tG\t.\tPASS\t.\tGT\t0\t1\n"
    variants, genotypes, _ = vcf.read_vcf(spark, put("p.vcf", head + body))
    got = vcf.decode_genotypes(genotypes, variants).orderBy("record", "sample_idx").collect()
    assert [r["allele"] for r in got] == ["C", "A", "A", "G"]
    path = scratch_path(spark, "records") + ".vcf"
    vcf.write_vcf(variants, genotypes, path)
    assert [r[0] for r in spark.read.text(path).where("value LIKE 'c%'").orderBy("value").collect()] == body.splitlines()


def test_genotypes_of_wide_lines_stay_in_their_tasks(spark, put, monkeypatch):
    """Records are broadcast to the genotypes whatever their lines take; usual and other calls are the same in advance and one by one."""
    calls = {"0": "AC-", "1": "G--", "2": "TTT", ".": "NNN", "./.": "NNN", "0/2": "NNN", "1|1": "G--", "+1": "G--", "0/0/0": "AC-", "1:7": "G--", ":3": "NNN", "0:": "AC-"}
    fields = [list(calls)[i % len(calls)] for i in range(20000)]
    text = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{i}" for i in range(20000)]]) + "\n"
    for pos, ref, alts in ((2, "AC", "G,TTT"), (9, "A", "C")):
        row = fields if pos == 2 else ["0/1" if f == "0/2" else "0" if f == "2" else f for f in fields]
        text += "\t".join(["c", str(pos), ".", ref, alts, ".", "PASS", ".", "GT:DP", *row]) + "\n"
    second = {"AC-": "A", "G--": "C", "TTT": "A", "NNN": "N"}
    want = [(f"s{i}", calls[f] + ("M" if f == "0/2" else second[calls[f]])) for i, f in enumerate(fields)]
    variants, genotypes, _ = vcf.read_vcf(spark, put("wide.vcf", text))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = vcf.vcf_to_alignment(variants, genotypes)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(record" not in plan and "hashpartitioning(chrom" not in plan
        assert sorted(records(out)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(vcf, "PAIRED", 0)
    assert sorted(records(vcf.vcf_to_alignment(variants, genotypes))) == sorted(want)


def test_fields_of_a_record_are_dealt_to_tasks(spark, put, monkeypatch):
    """One line with many samples is decoded by several tasks; ranges of samples are joined in their order."""
    n = 300
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{k}" for k in range(n)]])
    fixed = ["c", "4", ".", "A", "C", ".", ".", ".", "GT"]
    wide = [*fixed, *[str(k % 2) for k in range(n)], "extra", ""]
    path = put("wide.vcf", "\n".join([head, "\t".join(wide), "\t".join(wide[:len(fixed) + n - 1])]) + "\n")
    variants, genotypes, violations = vcf.read_vcf(spark, path)
    rows = sorted((r["sample_idx"], r["sample"], r["field"]) for r in genotypes.where("sample IS NOT NULL").collect())
    assert rows == [(k, f"s{k}", str(k % 2)) for k in range(n)]
    assert [(r["sample_idx"], r["field"]) for r in genotypes.where("sample IS NULL").orderBy("sample_idx").collect()] == [(n, "extra"), (n + 1, "")]
    assert [(r["code"], r["ref"]) for r in violations.collect()] == [("incomplete_record", "2")]
    assert genotypes.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    monkeypatch.setattr(vcf, "CELLS", 7)
    out = scratch_path(spark, "wide") + ".vcf"
    vcf.write_vcf(variants, genotypes.where("sample IS NOT NULL"), out)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert [x for x in lines if x.startswith("#CHROM")] == [head]
    assert [x.split("\t")[9:] for x in lines if x.startswith("c\t")] == [wide[9:9 + n]]


def test_vcf_subset_keeps_records(spark, put):
    head = "##fileformat=VCFv4.2\n##contig=<ID=c>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
    first, second = "c\t9\tr1\tA\t<DEL>\t7\tq\tX=1;Y\tGT:DP", "c\t2\t.\tA\tG\t.\tPASS\t.\tGT"
    src = put("sub.vcf", "\ufeff" + head.replace("\n", "\r\n") + f"{first}\t1:5\t0:6\t./.:\n\n#late\n{second}\t0\t\t1\n{first}\t0:1\t1:1\t0:3\n")
    def wanted(*rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "sample string, alias string, at string")
    dst = scratch_path(spark, "sub") + ".vcf"
    vcf.subset_vcf(spark, src, dst, wanted(("s3", "a"), ("s2", None)))
    got = [r["value"] for r in ordered_text(spark, dst).orderBy("row").collect()]
    title = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    assert got == ["##fileformat=VCFv4.2", "##contig=<ID=c>", title + "\ts2\ta", first + "\t0:6\t./.:", "#late", second + "\t\t1", first + "\t1:1\t0:3"]
    one = wanted(("s1", None))
    for rows, code in ((one.limit(0), "nothing_selected 0"), (wanted(("s1", "a"), ("s1", "b")), "sample_selected_twice s1"),
                       (wanted(("s9", None)), "sample_not_found s9"), (wanted(("POS", None)), "sample_not_found POS"),
                       (wanted(("s1", "s2"), ("s2", None)), "alias_used_twice s2")):
        with pytest.raises(ValueError, match=code):
            vcf.subset_vcf(spark, src, scratch_path(spark, "no"), rows)
    bad = [(title + "\n" + first + "\n", {"no_samples", "sample_not_found"}), (first + "\n", {"no_title", "sample_not_found"}),
           (head + head, {"several_titles", "alias_used_twice"}), (head + second + "\t0\n", {"column_count"}),
           (head.replace("s2", "s1"), {"alias_used_twice"}), ("", {"no_title", "sample_not_found"})]
    for i, (text, codes) in enumerate(bad):
        assert {r["code"] for r in vcf.subset_issues(spark, put(f"bad{i}.vcf", text), one).collect()} == codes


def test_invalid_genotype_and_short_row_raise(spark, put):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    variants, genotypes, _ = vcf.read_vcf(spark, put("w.vcf", head + "c\t2\t.\tA\tC\t.\t.\t.\tGT\t7\t0\n"))
    with pytest.raises(Exception, match="invalid genotype of s1 at 2"):
        vcf.vcf_to_alignment(variants, genotypes).collect()
    with pytest.raises(Exception, match="row 1 has fewer columns"):
        tb.read_six_column(spark, put("s.tsv", "a\tb\t2020\tx\ty\tz\nc\td\n")).collect()


def test_vcf_without_samples_or_records(spark, put):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    record = "\nc\t2\t.\tA\tC\t.\t.\t.\tGT"
    for text, codes in ((head + record + "\n", ["no_samples"]), (head + "\ts1\n", ["no_records"]), (head + "\n", ["no_records", "no_samples"]),
                        (head + "\ts1" + record + "\t1\n", [])):
        path = put(f"n{len(text)}.vcf", text)
        assert sorted(r["code"] for r in vcf.read_vcf(spark, path)[2].collect()) == codes
        if codes:
            with pytest.raises(ValueError):
                cv.read_sequences(spark, path)


def test_metadata_headers_and_faults(spark, put):
    """Each file has its own header; a key given twice, in one line too, and short lines are faults."""
    paths = [put("h1.csv", "\ufeffSample Name,City,Value\na,x,3\nb,,nan\n"), put("h2.tsv", "accession\tstrain\nA1\ts1\n\nA2\t*\n"),
             put("h3.tsv", "n1\tACC1\t2020\tde\t*\tulm\nn2\tACC2\n")]
    got = sorted((r["key"], r["sample"], r["discrete"], r["continuous"]) for r in tb.read_metadata(spark, paths).collect())
    assert got == sorted([("a", "a", "x", "3"), ("b", "b", "", "0"), ("A1", "A1", "", "0"), ("s1", "A1", "", "0"), ("A2", "A2", "", "0"),
                          ("ACC1", "ACC1", "de / ulm", "0"), ("n1", "ACC1", "de / ulm", "0"), ("ACC2", "ACC2", "", "0"), ("n2", "ACC2", "", "0")])
    twice = put("t.csv", "sample,accession,city\na,X1,u\na,X2,v\nb,X1,w\nc,c,x\n")
    assert {(r["rule"], r["ref"]) for r in tb.metadata_issues(spark, twice).collect()} == {("duplicate_key", k) for k in ("a", "X1", "c")}
    with pytest.raises(ValueError, match="duplicate_key"):
        tb.read_metadata(spark, twice)
    assert tb.read_metadata(spark, twice, on_error="keep").count() == 8
    short = put("s.tsv", "one\ttwo\t2020\nlonely\n")
    assert [(r["rule"], r["ref"]) for r in tb.metadata_issues(spark, short).collect()] == [("few_columns", "s.tsv:1")]
    with pytest.raises(ValueError, match="few_columns"):
        tb.read_metadata(spark, short)


def test_mutation_tokens_of_another_form(spark, put):
    path = put("m.tsv", "-\ts\t1(SNP:A->C);7(DEL:AA->GAP); \n-\tt\t2(SNP:GAP->T)\n")
    assert [tuple(r) for r in tb.mutation_issues(spark, path).collect()] == [("s", "7(DEL:AA->GAP)")]
    with pytest.raises(Exception, match="another form"):
        tb.read_mutations(spark, path).count()
    assert tb.read_mutations(spark, path, on_error="skip").count() == 2


def test_network_faults_and_escapes(spark, put):
    node = 'node [ data [ Frequency "{}" ] id {} ]'
    sound = put("ok.gml", "graph [ " + node.format("size 3\n FREQUENCY = +2.5\nA\\\"1\\\\n\n B\\tc [x] ", 1) + ' node [ label "q\\"x" id 2 ]'
                + ' edge [ data [ Changes "changes = 4" ] source 1 target 2 ] edge [ data [ Changes 2.5 ] source 2 target 1 ] edge [ source 1 target 2 data [ Changes "" ] ] ]')
    nodes, members, edges = tb.read_network(spark, sound)
    assert [(r["node_id"], r["label"], r["frequency"]) for r in nodes.orderBy("ord").collect()] == [(1, None, 2.5), (2, 'q"x', 0.0)]
    assert [r["sample"] for r in members.orderBy("ord").collect()] == ['A"1\\n', "B\tc [x]"]
    assert [r["distance"] for r in edges.orderBy("edge_index").collect()] == [4.0, 2.5, 1.0]
    bad = [node.format("no number here", 1), node.format("frequency=-3", 2), 'node [ label "x" ]', 'edge [ data [ Changes "abc" ] source 1 target 2 ]',
           'edge [ data [ Changes "0" ] source 1 target 2 ]', 'edge [ data [ Changes "-1" ] source 1 target 2 ]', "edge [ source 1 ]"]
    want = ["frequency_not_numeric", "frequency_negative", "node_without_id", "changes_not_numeric", "changes_not_positive", "changes_not_numeric",
            "edge_without_end"]
    for k, (entry, rule) in enumerate(zip(bad, want)):
        path = put(f"bad{k}.gml", f"graph [ {entry} ]")
        assert [r["rule"] for r in tb.network_issues(spark, path).collect()] == [rule]
        with pytest.raises(Exception, match=rule):
            nodes, _, edges = tb.read_network(spark, path)
            (nodes if entry.startswith("node") else edges).collect()


def test_guessed_conversions(spark):
    rows = spark.createDataFrame([("2020-01-02", "3 cm", "5", "7.", "x"), (" ", "4", "6.5", ".5e2", "1")],
                                 "sampling_date string, `Plant height` string, depth string, weight string, temperature string")
    want = [("date", None), ("measurement", "length"), ("number", None), ("number", None), ("number", None)]
    for column, (mode, quantity) in zip(rows.columns, want):
        rule = tb.guess_conversion(rows, column)
        assert rule.mode == mode and (quantity is None or rule.quantity == quantity)
    assert tb.column_roles(["id", "Sample", "Height (m)", "city", "日期"]) == [
        ("id", "name"), ("Sample", "discrete"), ("Height (m)", "continuous"), ("city", "discrete"), ("日期", "continuous")]


def test_empty_mask_and_warnings_without_group(spark, make):
    with pytest.raises(ValueError, match="no site is left"):
        an.build_network(make([("a", "", "NA"), ("b", "", "A?")]), "rmst")
    out = an.analyze_diversity(make([("a", "", "ACGT"), ("b", "", "ACGA")]), None, "pairwise", permutations=0)
    codes = {r["code"] for r in out["warnings"].where("scope = 'structure'").collect()}
    assert codes == {"fewer_than_two_groups", "amova_uses_complete_sites", "pairwise_sites_differ"}


def test_interval_and_run_scans(spark):
    rng = random.Random(3)
    spans = [(s, s + rng.randrange(0, 6)) for s in (rng.randrange(300) for _ in range(120))]
    want, reach = [], None
    for start, stop in sorted(spans):
        if reach is None or start >= reach:
            want.append([start, stop])
        else:
            want[-1][1] = max(want[-1][1], stop)
        reach = stop if reach is None else max(reach, stop)
    frame = spark.createDataFrame(spans, "start bigint, stop bigint").repartition(6)
    assert sorted(map(list, vcf.merge_intervals(frame).collect())) == want
    sites = sorted(rng.sample(range(200), 90))
    runs = sorted(tuple(r) for r in vcf.variable_runs(spark.createDataFrame([(p,) for p in sites], "pos bigint").repartition(5)).collect())
    assert [p for a, b in runs for p in range(a, b)] == sites and all(a > prev for (_, prev), (a, _) in zip(runs, runs[1:]))


def test_metadata_quotes_and_ties(spark, put):
    path = put("m.csv", '# note\naccession,haplotype,sampling_locality,Country,value\nx1,h,"a, b","C, D",nan\nx2,h,z,*,7\n')
    got = {r["key"]: (r["discrete"], r["continuous"]) for r in tb.read_metadata(spark, path).collect()}
    assert got == {"x1": ("C, D", "0"), "x2": ("", "7")}


@pytest.mark.parametrize("text, want", [
    ("2022-10-1", "2022-10-01"), ("2022/10/1", "2022-10-01"), ("2022.2", "2022-02-01"), ("2022", "2022-01-01"),
    ("2020-02-29T23:59:59Z", "2020-02-29"), (" 20220131 ", "2022-01-31"), ("2022-02-30", None), ("2022-1/1", None), ("", None)])
def test_parse_date(spark, text, want):
    got = spark.range(1).select(tf.parse_date(F.lit(text)).cast("string").alias("d")).first()["d"]
    assert got == want


@pytest.mark.parametrize("start, end, want", [
    ("2024-01-31", "2024-02-29", 1.0), ("2024-01-31", "2024-03-31", 2.0), ("2024-02-29", "2025-02-28", 12.0),
    ("2024-01-15", "2024-02-01", 17 / 31), ("2024-03-01", "2024-03-01", 0.0)])
def test_elapsed_months(spark, start, end, want):
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    got = spark.range(1).select(tf.elapsed_months(a, b).alias("f"), tf.elapsed_months(b, a).alias("r")).first()
    assert got["f"] == pytest.approx(want) and got["r"] == pytest.approx(-want)


@pytest.mark.parametrize("text, quantity, target, want", [
    ("1.5m", "length", "cm", 150.0), ("120", "length", "m", 1.2), ("3 Feet", "length", "m", 0.9144), ("5 μm", "length", "m", None),
    ("98.6 °F", "temperature", "c", 37.0), ("2公斤", "mass", "g", 2000.0), ("1 kg 2", "mass", "g", None)])
def test_measurement(spark, text, quantity, target, want):
    bare = {"length": "cm", "mass": "g", "temperature": "c"}[quantity]
    got = spark.range(1).select(tf.measurement(F.lit(text), quantity, target, bare).alias("v")).first()["v"]
    assert got is None if want is None else got == pytest.approx(want)


def test_strict_metadata(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    meta = spark.createDataFrame([("a", "x", "1"), ("c", "y", "2")], "sample string, discrete string, continuous string")
    with pytest.raises(ValueError, match="loaded:b"):
        sm.attach_metadata(samples, meta)
    assert sm.attach_metadata(samples, meta, strict=False).where("sample = 'b'").first()["continuous"] == "0"


def test_mutation_tokens(make, spark):
    muts = nw.mutations_from_alignment(make([("r", "", "A-GU"), ("s", "", "ACG-")]))
    row = nw.mutation_tokens(muts).first()
    assert row["tokens"] == "2(SNP:GAP->C);4(SNP:U->GAP)"
    assert tb.parse_mutations(spark.createDataFrame([("s", row["tokens"])], "sample string, tokens string")).count() == 2


def test_standardise_keeps_name_when_index_is_out_of_range(spark):
    rows = spark.createDataFrame([(4, "a.b", "", "0", "ACGT"), (9, "c", "", "0", "ACGN")], "sample_idx bigint, sample string, discrete string, continuous string, sequence string")
    got = sm.standardize(rows, sm.Standardisation(name=sm.Split(".", 1), discrete=sm.Split(".", 0), numbering=False)).orderBy("sample_idx").collect()
    assert [(r["id"], r["sample"], r["discrete"]) for r in got] == [(1, "b", "a"), (2, "c", "c")]
    assert sm.standardize(rows, sm.Standardisation(remove_ambiguous=True, numbering=True, start_id=5)).first()["sample"] == "5"


def test_wrapped_phylip_with_repeated_fragments(spark, put, monkeypatch):
    """Continuation lines that look like repeated names do not meet each other."""
    rows = 60
    text = f"{rows} 30\n" + "".join(f"s{k} ACGTACGTAC\nACGTACGTAC\nACGTACGTA{'CG'[k % 2]}\n" for k in range(rows))
    sizes, assemble = [], sq._assemble

    def counted(parts):
        sizes.append(parts.count())
        return assemble(parts)
    monkeypatch.setattr(sq, "_assemble", counted)
    got = sq.read_phylip(spark, [put("w.phy", text), put("x.phy", "2 6\na ACG\nTTT\nb ACG\nTTA\n")])
    assert max(sizes) <= 3 * rows + 4
    assert records(got) == [(f"s{k}", "ACGTACGTAC" * 2 + "ACGTACGTA" + "CG"[k % 2]) for k in range(rows)] + [("a", "ACGTTT"), ("b", "ACGTTA")]


def test_fingerprints_of_large_files_are_read_in_splits(spark, tmp_path):
    data = bytes(range(256)) * 40 + b"tail\r\n\n"
    names = {"a b+%41{x}.bin": data, "same.bin": data, "cut.bin": data[:-1], "moved.bin": data[256:] + data[:256], "small.bin": b"x"}
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)

    def prints(whole, size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            return {r["file"]: r["fingerprint"] for r in tb.file_fingerprints(spark, f"file://{tmp_path}/*.bin", whole).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert prints(1 << 20, "128m") == {n: hashlib.sha256(c).hexdigest() for n, c in names.items()}
    got = prints(100, "1000")
    assert got == prints(100, "128m") and set(got) == set(names)
    assert got["a b+%41{x}.bin"] == got["same.bin"] and len(set(got.values())) == 4
    assert got["small.bin"] == hashlib.sha256(b"x").hexdigest()


def test_lines_are_made_once(spark):
    """A line that is given as an expression is not made again for the bounds of the sort."""
    made = spark.sparkContext.accumulator(0)
    def line(k):
        made.add(1)
        return f"line {k}"
    path = scratch_path(spark, "lines")
    write_lines(spark.range(50).selectExpr("49 - id AS k"), path, ["k"], F.udf(line, "string")("k"))
    assert made.value == 50
    assert [r["value"] for r in ordered_text(spark, path).orderBy("row").collect()] == [f"line {k}" for k in range(50)]
