"""Scans and sinks, checked by writing derived tables and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import network as nw
from sitewise.operators import topology as tp
from sitewise.plans import bridge as br
from sitewise.plans.bridge import samples, table
from sitewise.plans.registry import query
from sitewise.sources import convert as cv
from sitewise.sources import sequences as sq
from sitewise.sources import tables as tb
from sitewise.sources import vcf
from sitewise.sources.lines import ordered_text, write_lines
from sitewise.storage import cut, scratch_path

_SEQ = "WITH {samples} SELECT sample_idx, sample, sequence FROM samples"


def _plain(spark, d):
    return samples(spark, d).select("sample_idx", "sample", "sequence")


@query("fasta_round_trip", _SEQ)
def fasta_round_trip(spark, d):
    path = scratch_path(spark, "alignment") + ".fasta"
    sq.write_fasta(_plain(spark, d), path, width=30)
    return sq.read_fasta(spark, path)


# document texts as records: whole texts of any length, CR LF line ends, cleaned headers
@query("fasta_scan_clean", """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_idx, regexp_replace(trim(translate(concat(doc_id, ', ', lang, ' "', source, '"=1'), ',="''', '__')), '\\s+', '_', 'g') AS sample,
 sha256(regexp_replace(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), '\\n', '', 'g')) AS fingerprint FROM documents WHERE regexp_matches(text, '[A-Za-z]')""")
def fasta_scan_clean(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("[A-Za-z]"))
    path = scratch_path(spark, "documents") + ".fasta"
    header = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(", "), "lang", F.lit(' "'), "source", F.lit('"=1'))
    # taking out what stays is many times faster on long texts than replacing the rest
    letters = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z\n]+"), 0), "")
    body = F.array_join(F.split(letters, "\n+"), "\r\n")
    write_lines(docs.select("doc_id", "lang", "source", "text"), path, ["doc_id"], F.concat(header, F.lit("\r\n"), body))
    return sq.read_fasta(spark, path, clean=True).select("sample_idx", "sample", F.sha2("sequence", 256).alias("fingerprint"))


@query("record_issues", """SELECT 'empty_name' AS code, c_custkey::VARCHAR AS ref FROM customer WHERE c_nationkey = 3
 UNION ALL SELECT 'empty_sequence', c_custkey::VARCHAR FROM customer WHERE c_nationkey = 4
 UNION ALL SELECT 'duplicate_name', s FROM (SELECT CASE WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment || c_acctbal::INT END AS s FROM customer) GROUP BY s HAVING count(*) > 1""")
def record_issues(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_idx"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.concat("c_mktsegment", F.round("c_acctbal").cast("int").cast("string"))).alias("sample"),
        F.when(F.col("c_nationkey") == 4, "").otherwise("ACGT").alias("sequence"))
    return sq.record_issues(c)


@query("phylip_round_trip", _SEQ)
def phylip_round_trip(spark, d):
    path = scratch_path(spark, "alignment") + ".phy"
    sq.write_phylip(_plain(spark, d), path)
    return sq.read_phylip(spark, path)


# one interleaved and one wrapped file per nation
def _blocked(spark, d, wrapped):
    s = samples(spark, d).select("sample_idx", "nation", "sample", "sequence")
    size = s.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    lines = s.select("nation", "sample_idx", F.posexplode(F.array(
        F.concat("sample", F.lit(" "), F.expr("substring(sequence, 1, 20)")), F.expr("substring(sequence, 21, 22)"), F.expr("substring(sequence, 43)"))).alias("k", "value"))
    order = ["sample_idx", "k"] if wrapped else ["k", "sample_idx"]
    head = size.select("nation", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("sample_idx"), F.lit(0).alias("k"),
                       F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" 64")).alias("value"))
    text = (head.unionByName(lines.withColumn("part", F.lit(1))).where("nation IS NOT NULL AND value IS NOT NULL")
            .repartition("nation").sortWithinPartitions("nation", "part", *order, "value"))
    path = scratch_path(spark, "phylip")
    text.select("nation", "value").write.partitionBy("nation").text(path)
    return sq.read_phylip(spark, path + "/*/*.txt").select("sample", "sequence")


@query("phylip_interleaved", "WITH {samples} SELECT sample, sequence FROM samples")
def phylip_interleaved(spark, d):
    return _blocked(spark, d, False)


@query("phylip_wrapped", "WITH {samples} SELECT sample, sequence FROM samples")
def phylip_wrapped(spark, d):
    return _blocked(spark, d, True)


# one file per nation; nations with an odd number of letters declare one record or site too many
def _broken(spark, d, head, foot):
    s = samples(spark, d).select("sample_idx", "nation", F.concat_ws(" ", "sample", "sequence").alias("value"))
    odd = F.length("nation") % 2
    ends = s.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    lines = ends.select("nation", F.lit(-1).cast("bigint").alias("sample_idx"), head(F.col("n"), odd).alias("value")).unionByName(
        s).unionByName(ends.select("nation", F.lit(1 << 60).alias("sample_idx"), F.lit(foot).alias("value")))
    path = scratch_path(spark, "broken")
    lines.repartition("nation").sortWithinPartitions("nation", "sample_idx").select("nation", "value").write.partitionBy("nation").text(path)
    return path


def _nation(issues):
    return issues.select(F.url_decode(F.regexp_extract("file", "nation=([^/]+)", 1)).alias("nation"), "rule")


@query("phylip_issues", "WITH {samples} SELECT DISTINCT nation, 'record_count' AS rule FROM samples WHERE length(nation) % 2 = 1")
def phylip_issues(spark, d):
    path = _broken(spark, d, lambda n, odd: F.concat_ws(" ", (n + odd).cast("string"), F.lit("64")), "")
    return _nation(sq.phylip_issues(spark, path))


@query("nexus_issues", "WITH {samples} SELECT DISTINCT nation, 'sequence_length' AS rule FROM samples WHERE length(nation) % 2 = 1")
def nexus_issues(spark, d):
    path = _broken(spark, d, lambda n, odd: F.concat(F.lit("#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX="), n.cast("string"), F.lit(" NCHAR="),
                                                     (odd + 64).cast("string"), F.lit(";\nMATRIX [one [nested] note; 'x]")), ";\nEND;")
    return _nation(sq.nexus_issues(spark, path))


@query("nexus_round_trip", _SEQ)
def nexus_round_trip(spark, d):
    path = scratch_path(spark, "alignment") + ".nex"
    sq.write_nexus(_plain(spark, d), path)
    return sq.read_nexus(spark, path)


def _converted(spark, d, fmt, ending, write=sq.write_fasta, source=".fasta"):
    base = scratch_path(spark, "convert")
    write(_plain(spark, d), base + source)
    cv.convert(spark, base + source, base + ending, fmt)
    return cv.read_sequences(spark, base + ending)


@query("convert_fasta_to_phylip", _SEQ)
def convert_fasta_to_phylip(spark, d):
    return _converted(spark, d, "phylip", ".phy")


@query("convert_fasta_to_nexus", _SEQ)
def convert_fasta_to_nexus(spark, d):
    return _converted(spark, d, "nexus", ".nex")


@query("convert_nexus_to_fasta", _SEQ)
def convert_nexus_to_fasta(spark, d):
    return _converted(spark, d, "fasta", ".fasta", sq.write_nexus, ".nex")


@query("expand_matchchar", _SEQ)
def expand_matchchar(spark, d):
    s = _plain(spark, d)
    first = s.agg(F.min_by("sequence", "sample_idx")).scalar()
    packed = s.withColumn("ref", first).withColumn("sequence", F.when(F.col("sample_idx") == 0, F.col("sequence")).otherwise(
        F.array_join(F.zip_with(F.split("sequence", ""), F.split("ref", ""), lambda a, b: F.when(a == b, ".").otherwise(a)), ""))).drop("ref")
    return sq.expand_matchchar(packed, ".")


K4 = """vr AS (SELECT pos FROM cells GROUP BY pos HAVING count(DISTINCT base) > 1),
 ru AS (SELECT min(pos) AS s, max(pos) + 1 AS e FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS isl FROM vr) GROUP BY isl),
 al0 AS (SELECT s, e, replace(substr(sequence, s, e - s), '-', '') AS a FROM samples, ru),
 go AS (SELECT s, e, bool_or(a = '') AS g FROM al0 GROUP BY ALL),
 rs AS (SELECT pos FROM cells WHERE sample_idx = 0 AND base <> '-'),
 an AS (SELECT CASE WHEN g AND p IS NOT NULL THEN p ELSE s END AS s, CASE WHEN g AND p IS NULL THEN q + 1 ELSE e END AS e FROM
  (SELECT *, (SELECT max(pos) FROM rs WHERE pos < s) AS p, (SELECT min(pos) FROM rs WHERE pos >= e) AS q FROM go)),
 mg AS (SELECT min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM
  (SELECT *, CASE WHEN max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s THEN 0 ELSE 1 END AS nw FROM an)) GROUP BY k),
 ga AS MATERIALIZED (SELECT s, e, sample_idx, sample, replace(substr(sequence, s, e - s), '-', '') AS a FROM samples, mg),
 rf AS (SELECT s, a AS ref FROM ga WHERE sample_idx = 0),
 ix AS (SELECT s, a, ref, row_number() OVER (PARTITION BY s ORDER BY (a <> ref)::INT, min(sample_idx)) - 1 AS gt FROM ga JOIN rf USING (s) GROUP BY s, a, ref),
 vv AS (SELECT s, ref, string_agg(a, ',' ORDER BY gt) FILTER (gt > 0) AS alts, 1 + (SELECT count(*) FROM rs WHERE pos < s) AS pos,
  'NS=' || (SELECT count(*) FROM samples) || ';TYPE=' || CASE WHEN length(ref) = 1 AND max(length(a)) = 1 THEN 'SNP' ELSE 'COMPLEX' END AS info,
  max(length(a)) AS w FROM ix GROUP BY s, ref HAVING count(*) > 1)"""


@query("variants_from_alignment", "WITH {cells}, " + K4 + " SELECT pos, ref, alts, info FROM vv")
def variants_from_alignment(spark, d):
    return vcf.alignment_to_variants(_plain(spark, d))[0].select("pos", "ref", F.array_join("alts", ",").alias("alts"), "info")


@query("genotypes_from_alignment", "WITH {cells}, " + K4 + " SELECT pos, sample_idx, sample, gt::VARCHAR AS gt FROM ga JOIN ix USING (s, a) JOIN vv USING (s)")
def genotypes_from_alignment(spark, d):
    return vcf.alignment_to_variants(_plain(spark, d))[1].select("pos", "sample_idx", "sample", F.col("field").alias("gt"))


def _vcf_file(spark, d):
    path = scratch_path(spark, "variants") + ".vcf"
    variants, genotypes = vcf.alignment_to_variants(_plain(spark, d))
    vcf.write_vcf(variants, genotypes, path)
    return path


@query("vcf_scan", "WITH {cells}, " + K4 + " SELECT 'alignment' AS chrom, pos, ref, alts, info, sample, gt::VARCHAR AS field FROM ga JOIN ix USING (s, a) JOIN vv USING (s, ref)")
def vcf_scan(spark, d):
    variants, genotypes, _ = vcf.read_vcf(spark, _vcf_file(spark, d))
    return genotypes.join(variants.drop("chrom", "pos"), "record").select(
        "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), "info", "sample", "field")


@query("vcf_to_alignment", "WITH {cells}, " + K4 + " SELECT sample_idx, sample, string_agg(rpad(ga.a, w::INT, '-'), '' ORDER BY s) AS sequence FROM ga JOIN vv USING (s) GROUP BY ALL")
def vcf_to_alignment(spark, d):
    variants, genotypes, _ = vcf.read_vcf(spark, _vcf_file(spark, d))
    return vcf.vcf_to_alignment(variants, genotypes)


@query("vcf_to_alignment_reference", "WITH {cells}, " + K4 + """,
 rfs AS (SELECT replace(sequence, '-', '') AS r FROM samples WHERE sample_idx = 0),
 lv AS (SELECT *, coalesce(lag(pos + length(ref)) OVER (ORDER BY pos), 1) AS pe FROM vv),
 pc AS (SELECT sample_idx, sample, s, substr(r, pe, pos - pe) || rpad(ga.a, w::INT, '-') AS piece FROM ga JOIN lv USING (s), rfs)
 SELECT sample_idx, sample, string_agg(piece, '' ORDER BY s) || (SELECT substr(r, (SELECT max(pos + length(ref)) FROM vv)) FROM rfs) AS sequence FROM pc GROUP BY ALL""")
def vcf_to_alignment_reference(spark, d):
    s = cut(_plain(spark, d), "samples")
    reference = s.orderBy("sample_idx").select("sequence").first()[0]
    variants, genotypes = vcf.alignment_to_variants(s)
    return vcf.vcf_to_alignment(cut(variants, "variants"), cut(genotypes, "genotypes"), reference)


@query("subset_variants", "WITH {cells}, " + K4 + " SELECT pos, 'Customer_' || sample_idx AS sample, gt::VARCHAR AS field FROM ga JOIN ix USING (s, a) JOIN vv USING (s) WHERE sample_idx IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def subset_variants(spark, d):
    _, genotypes = vcf.alignment_to_variants(_plain(spark, d))
    wanted = table(spark, d, "customer").where("c_acctbal > 5000").select(
        F.col("c_name").alias("sample"), F.concat(F.lit("Customer_"), F.col("c_custkey").cast("string")).alias("alias"))
    return vcf.subset_variants(cut(genotypes, "genotypes"), wanted).select("pos", "sample", "field")


# records of orders over one column for each nation; positions repeat and are in no order
@query("vcf_subset_round_trip", """WITH w AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'N' || n_nationkey ELSE n_name END AS name FROM nation WHERE n_regionkey <> 2),
 fx AS (SELECT '#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT' AS t),
 hd(ord, value) AS (VALUES (-4, '##fileformat=VCFv4.2'), (-3, '##INFO=<ID=P,Number=1,Type=String,Description="priority">'), (-2, '##contig=<ID=c>')),
 tt AS (SELECT -1 AS ord, replace(t, ' ', chr(9)) || chr(9) || (SELECT string_agg(name, chr(9) ORDER BY k) FROM w) AS value FROM fx),
 rc AS (SELECT o_orderkey AS ord, concat_ws(chr(9), 'c', o_custkey + 1, 'rs' || o_orderkey, 'A', 'C,G', o_orderkey % 90, o_orderstatus, 'P=' || o_orderpriority || ';K', 'GT:DP',
  string_agg((o_orderkey + k) % 3 || ':' || k, chr(9) ORDER BY k)) AS value FROM orders, w GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderpriority),
 al AS (SELECT * FROM hd UNION ALL SELECT * FROM tt UNION ALL SELECT * FROM rc)
 SELECT row_number() OVER (ORDER BY ord) - 1 AS row, value FROM al""")
def vcf_subset_round_trip(spark, d):
    src, dst = scratch_path(spark, "records") + ".vcf", scratch_path(spark, "subset") + ".vcf"
    nation = table(spark, d, "nation")
    columns = nation.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n")).scalar()
    fixed = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".replace(" ", "\t")
    head = spark.createDataFrame([(-4, "##fileformat=VCFv4.2"), (-3, '##INFO=<ID=P,Number=1,Type=String,Description="priority">'),
                                  (-2, "##contig=<ID=c>")], "ord bigint, value string")
    title = spark.range(1).select(F.lit(-1).cast("bigint").alias("ord"), F.concat_ws("\t", F.lit(fixed), columns["n_name"]).alias("value"))
    key = F.col("o_orderkey").cast("bigint")
    calls = F.transform("n", lambda c: F.concat_ws(":", ((F.col("o_orderkey") + c["n_nationkey"]) % 3).cast("string"), c["n_nationkey"].cast("string")))
    rows = table(spark, d, "orders").withColumn("n", columns).select(key.alias("ord"), F.concat_ws(
        "\t", F.lit("c"), (F.col("o_custkey") + 1).cast("string"), F.concat(F.lit("rs"), key.cast("string")), F.lit("A"), F.lit("C,G"),
        (key % 90).cast("string"), "o_orderstatus", F.concat(F.lit("P="), "o_orderpriority", F.lit(";K")), F.lit("GT:DP"), calls).alias("value"))
    write_lines(head.unionByName(title).unionByName(rows), src, ["ord"])
    wanted = nation.where("n_regionkey <> 2").select(F.col("n_name").alias("sample"), F.when(
        F.col("n_regionkey") == 1, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("alias"))
    vcf.subset_vcf(spark, src, dst, wanted)
    return ordered_text(spark, dst).select("row", "value")


_GT = """gt0 AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS f, substr(md5(concat('g:', cast(l_orderkey AS string), ':', cast(l_linenumber AS string))), 1, 1) AS h FROM lineitem),
 gt1 AS (SELECT id, f, CASE WHEN h < '2' THEN './.' WHEN h < '4' THEN '0' WHEN h < '6' THEN '1|1' WHEN h < '8' THEN '0/1' WHEN h < 'a' THEN '1/0' WHEN h < 'b' THEN '' WHEN h < 'c' THEN '2' ELSE '0|0' END AS g FROM gt0)"""


@query("decode_genotypes", "WITH " + _GT + """ SELECT id, CASE WHEN g IN ('./.', '') THEN CASE f WHEN 'R' THEN 'NN' ELSE 'N' END WHEN g IN ('0', '0|0') THEN 'A'
 WHEN g = '1|1' THEN CASE f WHEN 'A' THEN 'C' WHEN 'N' THEN 'G' ELSE 'CT' END WHEN g = '2' THEN CASE f WHEN 'N' THEN 'T' WHEN 'R' THEN 'G' END
 ELSE CASE f WHEN 'A' THEN 'M' WHEN 'N' THEN 'R' ELSE 'NN' END END AS allele FROM gt1""")
def decode_genotypes(spark, d):
    raw = spark.sql("WITH " + _GT.replace("FROM lineitem", "FROM {l}") + " SELECT * FROM gt1", l=table(spark, d, "lineitem"))
    genotypes = raw.select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.concat(F.lit("7:"), "g").alias("field"), "f")
    alts = F.when(F.col("f") == "A", F.array(F.lit("C"))).when(F.col("f") == "N", F.array(F.lit("G"), F.lit("T"))).otherwise(F.array(F.lit("CT"), F.lit("G")))
    allele = vcf.genotype_allele(F.col("field"), F.array(F.lit("DP"), F.lit("GT")), F.lit("A"), alts)
    return genotypes.select(F.col("pos").alias("id"), allele.alias("allele"))


# line items as variants on one contig per supplier; long alleles run into their neighbours
_OV = """ov AS (SELECT cast(l_suppkey AS string) AS chrom, l_orderkey AS pos, repeat('A', cast(max(l_quantity) AS int)) AS ref FROM lineitem GROUP BY l_suppkey, l_orderkey)"""


@query("overlapping_variants", "WITH " + _OV + " SELECT chrom, pos, ref FROM (SELECT *, lag(pos + length(ref)) OVER (PARTITION BY chrom ORDER BY pos) AS e FROM ov) WHERE pos < e")
def overlapping_variants(spark, d):
    v = spark.sql(_OV.replace("ov AS (", "", 1).rstrip(")").replace("cast(max(l_quantity) AS int)", "cast(max(l_quantity) AS int)").replace("FROM lineitem", "FROM {l}"), l=table(spark, d, "lineitem"))
    return vcf.overlapping_variants(v)


@query("variable_runs", "WITH v AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS pos FROM lineitem) SELECT min(pos) AS start, max(pos) + 1 AS stop FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM v) GROUP BY g")
def variable_runs(spark, d):
    return vcf.variable_runs(table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")).distinct())


@query("merge_intervals", """WITH i AS (SELECT l_orderkey * 64 + l_linenumber * 8 AS start, l_orderkey * 64 + l_linenumber * 8 + cast(floor(l_quantity / 4) AS bigint) AS stop FROM lineitem),
 m AS (SELECT *, CASE WHEN max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start THEN 0 ELSE 1 END AS n FROM i)
 SELECT min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(n) OVER (ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY g""")
def merge_intervals(spark, d):
    start = F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8
    i = table(spark, d, "lineitem").select(start.alias("start"), (start + F.floor(F.col("l_quantity") / 4)).cast("bigint").alias("stop"))
    return vcf.merge_intervals(i)


@query("ungapped_coordinates", "WITH {cells}, r AS (SELECT pos, base FROM cells WHERE sample_idx = (SELECT min(sample_idx) FROM samples WHERE contains(sequence, '-'))) SELECT pos, 1 + (SELECT count(*) FROM r q WHERE q.pos < r.pos AND base <> '-') AS coordinate FROM r")
def ungapped_coordinates(spark, d):
    from sitewise.functions.sequence import cells
    s = samples(spark, d)
    first = s.where(F.contains("sequence", F.lit("-"))).agg(F.min("sample_idx")).scalar()
    return vcf.ungapped_coordinates(cells(s.withColumn("f", first).where("sample_idx = f"), normalise=False))


def _meta_rows():
    return "SELECT concat('O', cast(o_orderkey AS string)) AS sample, concat('X', cast(o_orderkey AS string)) AS acc, o_orderpriority, o_orderstatus, o_totalprice FROM {o}"


@query("metadata_scan_header", """WITH r AS (SELECT 'O' || o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'X' || o_orderkey END AS acc, o_orderkey, o_orderpriority AS p, o_orderstatus AS s FROM orders),
 v AS (SELECT *, p || CASE WHEN s = 'P' THEN '' ELSE ' / ' || s END AS discrete, CASE WHEN s = 'O' THEN '0' ELSE o_orderkey::VARCHAR END AS continuous FROM r)
 SELECT sample AS key, sample, discrete, continuous FROM v UNION ALL SELECT acc, sample, discrete, continuous FROM v WHERE acc <> ''""")
def metadata_scan_header(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    path = scratch_path(spark, "metadata") + ".csv"
    o.select(F.concat(F.lit("O"), key).alias("Sample Name"), F.when(F.col("o_orderstatus") == "F", "*").otherwise(F.concat(F.lit("X"), key)).alias("Accession-ID"),
             F.col("o_orderpriority").alias("Country"), F.when(F.col("o_orderstatus") == "P", "*").otherwise(F.col("o_orderstatus")).alias("City"),
             F.when(F.col("o_orderstatus") == "O", "not a number").otherwise(key).alias("Value")).write.csv(path, header=True, quoteAll=True)
    return tb.read_metadata(spark, path)


_SIXSQL = """six AS (SELECT o_orderkey AS k, 'O' || o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN '*' ELSE 'X' || o_orderkey END AS accession, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS country, '*' AS state, o_orderstatus AS city FROM orders)"""


def _six_file(spark, d):
    key = F.col("o_orderkey").cast("string")
    path = scratch_path(spark, "six") + ".tsv"
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("O"), key).alias("sample"), F.when(F.col("o_orderstatus") == "F", "*").otherwise(F.concat(F.lit("X"), key)).alias("accession"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("country"), F.lit(" ").alias("state"), F.col("o_orderstatus").alias("city"))
    tb.write_six_column(rows, path, "o_orderkey")
    return path


@query("six_column_scan", "WITH " + _SIXSQL + " SELECT row_number() OVER (ORDER BY k) - 1 AS row, sample, accession, date, country, state, city FROM six".replace(" AS row,", ' AS "row",'))
def six_column_scan(spark, d):
    return tb.read_six_column(spark, _six_file(spark, d))


@query("metadata_scan_headerless", "WITH " + _SIXSQL + """, v AS (SELECT *, CASE WHEN accession = '*' THEN sample ELSE accession END AS first, country || ' / ' || city AS discrete FROM six)
 SELECT sample AS key, first AS sample, discrete, '0' AS continuous FROM v UNION ALL SELECT accession, first, discrete, '0' FROM v WHERE accession <> '*'""")
def metadata_scan_headerless(spark, d):
    return tb.read_metadata(spark, _six_file(spark, d))


_MUT = """mut AS (SELECT c.sample_idx, c.sample, c.pos, CASE WHEN r.base = '-' THEN 'GAP' ELSE r.base END AS ref, CASE WHEN c.base = '-' THEN 'GAP' ELSE c.base END AS alt
 FROM cells c JOIN cells r ON r.pos = c.pos AND r.sample_idx = 0 WHERE c.base <> r.base)"""


@query("mutation_scan", "WITH {cells}, " + _MUT + " SELECT sample, pos, ref, alt FROM mut")
def mutation_scan(spark, d):
    path = scratch_path(spark, "mutations") + ".tsv"
    tokens = nw.mutation_tokens(nw.mutations_from_alignment(samples(spark, d)))
    write_lines(tokens.select("sample_idx", F.concat_ws("\t", F.lit("-"), "sample", "tokens").alias("value")), path, ["sample_idx"])
    return tb.read_mutations(spark, path)


def _network_file(spark, d):
    path = scratch_path(spark, "network")
    tb.write_network(br.nodes(spark, d), br.members(spark, d), br.edges(spark, d), path)
    return tb.read_network(spark, path)


@query("metadata_issues", "SELECT 'duplicate_key' AS rule, 'C' || o_custkey AS ref FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def metadata_issues(spark, d):
    path = scratch_path(spark, "metadata") + ".csv"
    table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sample"), F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("accession"),
        F.col("o_orderpriority").alias("country")).write.csv(path, header=True)
    return tb.metadata_issues(spark, path)


@query("mutation_issues", "SELECT 'O' || l_orderkey AS sample, l_linenumber || '(DEL:AA->GAP)' AS token FROM lineitem WHERE l_linenumber % 2 = 1")
def mutation_issues(spark, d):
    path = scratch_path(spark, "mutations") + ".tsv"
    line = F.col("l_linenumber").cast("string")
    tokens = F.concat(F.col("l_partkey").cast("string"), F.lit("(SNP:A->C);"),
                      F.when(F.col("l_linenumber") % 2 == 1, F.concat(line, F.lit("(DEL:AA->GAP)"))).otherwise(F.concat(line, F.lit("(SNP:GAP->T)"))))
    table(spark, d, "lineitem").select(F.concat_ws("\t", F.lit("-"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")), tokens).alias("value")).write.text(path)
    return tb.mutation_issues(spark, path)


# records of orders; four of five break a rule
@query("vcf_issues", """SELECT ['invalid_position', 'position_not_positive', 'symbolic_allele', 'empty_allele'][k % 5 + 1] AS code, (r + 1)::VARCHAR AS ref
 FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE k % 5 < 4""")
def vcf_issues(spark, d):
    path = scratch_path(spark, "variants") + ".vcf"
    key = F.col("o_orderkey")
    pos = F.when(key % 5 == 0, "x").when(key % 5 == 1, "0").otherwise(key.cast("string"))
    alt = F.when(key % 5 == 2, "<DEL>").when(key % 5 == 3, ".").otherwise("C")
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2")], "key bigint, value string")
    rows = table(spark, d, "orders").select(key.alias("key"), F.concat_ws(
        "\t", F.lit("c"), pos, F.lit("."), F.lit("A"), alt, F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.lit("0"), F.lit("1")).alias("value"))
    write_lines(head.unionByName(rows), path, ["key"])
    return vcf.read_vcf(spark, path)[2]


# one file per nation: balances as frequencies, supplier names, zeros and balances as changes
@query("network_issues", """WITH n AS (SELECT n_name, 'frequency_negative' AS rule, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS ref, c_acctbal < 0 AS bad
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
 e AS (SELECT n_name, CASE s_suppkey % 3 WHEN 0 THEN 'changes_not_positive' ELSE 'changes_not_numeric' END AS rule,
  row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS ref, s_suppkey % 3 < 2 AS bad FROM supplier JOIN nation ON n_nationkey = s_nationkey)
 SELECT n_name AS nation, rule, ref FROM n WHERE bad UNION ALL SELECT n_name, rule, ref FROM e WHERE bad""")
def network_issues(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "nation", F.lit(1).alias("part"), F.col("c_custkey").alias("key"), F.concat(
            F.lit('node [ data [ Frequency "frequency='), F.col("c_acctbal").cast("string"), F.lit("\n"), F.col("c_name"), F.lit('\n" ] id '),
            F.col("c_custkey").cast("string"), F.lit(" ]")).alias("value"))
    change = F.when(F.col("s_suppkey") % 3 == 0, "0").when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).otherwise("changes = 2.5")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "nation", F.lit(2).alias("part"), F.col("s_suppkey").alias("key"), F.concat(
            F.lit('edge [ data [ Changes "'), change, F.lit('" ] source 1 target 2 ]')).alias("value"))
    ends = nation.select("nation", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("key"), F.lit("graph [").alias("value")).unionByName(
        nation.select("nation", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("key"), F.lit("]").alias("value")))
    path = scratch_path(spark, "networks")
    (ends.unionByName(customer).unionByName(supplier).repartition("nation").sortWithinPartitions("nation", "part", "key")
     .select("nation", "value").write.partitionBy("nation").text(path))
    return tb.network_issues(spark, path).select(
        F.url_decode(F.regexp_extract("file", "nation=([^/]+)", 1)).alias("nation"), "rule", "ref")


@query("network_round_trip_nodes", "WITH {network} SELECT node_id, trim(label) AS label, frequency, (frequency <= 0 OR trim(label) = '') AS is_intermediate FROM nodes")
def network_round_trip_nodes(spark, d):
    return _network_file(spark, d)[0].select("node_id", "label", "frequency", "is_intermediate")


@query("network_round_trip_members", "WITH {members} SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY ord) - 1 AS ord, sample FROM members")
def network_round_trip_members(spark, d):
    return _network_file(spark, d)[1].select("node_id", "ord", "sample")


@query("network_round_trip_edges", "WITH {network} SELECT row_number() OVER (ORDER BY edge_index) - 1 AS edge_index, source, target, distance FROM edges")
def network_round_trip_edges(spark, d):
    return _network_file(spark, d)[2].select("edge_index", "source", "target", "distance")


@query("hapconf_round_trip", """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS "row", regexp_replace(v, '[^A-Za-z0-9_]', '_', 'g') AS id, v AS sample, CASE WHEN p_type = 'ECONOMY' THEN 'Default' ELSE p_type END AS grp, replace(p_brand, '#', '_') AS haplotype
 FROM (SELECT *, p_name || '_' || p_partkey AS v FROM part)""")
def hapconf_round_trip(spark, d):
    path = scratch_path(spark, "hapconf") + ".csv"
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(";"), F.col("p_partkey").cast("string")).alias("sample"),
                                          F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.col("p_type")).alias("grp"), F.replace("p_brand", F.lit("#"), F.lit("\n")).alias("haplotype"))
    tb.write_viewer_config(rows, ["sample", "grp", "haplotype"], path, "p_partkey")
    return tb.read_hapconf(spark, path)


@query("groupconf_scan", """WITH f AS (SELECT p_brand AS grp, arg_min(p_size, p_partkey) AS s FROM part GROUP BY p_brand)
 SELECT grp, CASE WHEN s < 25 THEN 'a2ff' || lpad(s::VARCHAR, 2, '0') ELSE '5A9A6E' END AS color, 'none' AS pattern FROM f""")
def groupconf_scan(spark, d):
    path = scratch_path(spark, "groupconf") + ".csv"
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("grp"), F.when(size < 25, F.concat(F.lit("#a2ff"), F.lpad(size.cast("string"), 2, "0"))).otherwise("red").alias("color"))
    tb.write_viewer_config(rows, ["grp", "color"], path, "p_partkey")
    return tb.read_groupconf(spark, path)


@query("traitconf_scan", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "row", 'L' || o_orderkey AS id, o_totalprice AS value FROM orders QUALIFY o_orderstatus <> 'F'""")
def traitconf_scan(spark, d):
    path = scratch_path(spark, "traitconf") + ".csv"
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    tb.write_viewer_config(rows, ["o_orderkey", "value"], path, "o_orderkey")
    return tb.read_traitconf(spark, path)


@query("trait_export", "SELECT c_name AS sample, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer")
def trait_export(spark, d):
    path = scratch_path(spark, "traits") + ".tsv"
    s = table(spark, d, "customer").select(F.col("c_name").alias("sample"), F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("traits"))
    tb.export_traits(s, ["segment", "nation"], path, "\t")
    return spark.read.csv(path, header=True, sep="\t")


@query("variant_export_metadata", "WITH {samples} SELECT sample, coalesce(nullif(grp, ''), 'none') AS discrete, value::VARCHAR AS continuous FROM samples")
def variant_export_metadata(spark, d):
    base = scratch_path(spark, "export")
    s = samples(spark, d).select("sample_idx", "sample", "sequence", F.coalesce(F.nullif("grp", F.lit("")), F.lit("none")).alias("discrete"), F.col("value").cast("string").alias("continuous"))
    cv.export_variants(s, base + ".vcf", base + "_metadata.csv")
    lines = spark.read.text(base + ".vcf").where(F.col("value").startswith(vcf.META_KEY))
    js = F.from_json(F.expr(f"substring(value, {len(vcf.META_KEY) + 1})"), "sample string, discrete_trait string, continuous_trait string")
    return lines.select(js.alias("j")).select("j.sample", F.col("j.discrete_trait").alias("discrete"), F.col("j.continuous_trait").alias("continuous"))


@query("haplotype_outputs", """WITH {samples}, hap AS (SELECT sequence, min(sample_idx) AS f FROM samples GROUP BY sequence), lab AS (SELECT *, row_number() OVER (ORDER BY f) AS k FROM hap)
 SELECT sample AS sequence_name, 'H' || k AS haplotype, CASE WHEN grp = 'BUILDING' THEN '0' ELSE floor(value)::BIGINT::VARCHAR END AS continuous_traits, CASE WHEN grp = 'BUILDING' THEN NULL ELSE nation END AS discrete_traits FROM samples JOIN lab USING (sequence)""")
def haplotype_outputs(spark, d):
    s = samples(spark, d)
    traits = s.where("grp <> 'BUILDING'").select("sample", F.col("nation").alias("discrete"), F.floor("value").cast("string").alias("continuous"))
    prefix = scratch_path(spark, "haplotypes")
    cv.write_haplotype_outputs(s.select("sample_idx", "sample", "sequence"), traits, prefix)
    return spark.read.csv(f"{prefix}_seq.meta.csv", header=True)


@query("convert_fasta_to_vcf", "WITH {cells}, " + K4 + " SELECT pos, sample, gt::VARCHAR AS field FROM ga JOIN ix USING (s, a) JOIN vv USING (s)")
def convert_fasta_to_vcf(spark, d):
    base = scratch_path(spark, "convert")
    sq.write_fasta(_plain(spark, d), base + ".fasta")
    cv.convert(spark, base + ".fasta", base + ".vcf", "vcf")
    return vcf.read_vcf(spark, base + ".vcf")[1].select("pos", "sample", "field")


@query("changed_files", """SELECT 'orders.parquet' AS file, 'content_differs' AS code UNION ALL SELECT 'absent.parquet', 'missing'""")
def changed_files(spark, d):
    now = tb.file_fingerprints(spark, [f"{d}/{t}.parquet" for t in ("orders", "customer", "lineitem", "part")])
    manifest = now.select("file", F.when(F.col("file") == "orders.parquet", "0").otherwise(F.col("fingerprint")).alias("fingerprint")).unionByName(
        spark.createDataFrame([("absent.parquet", "0")], "file string, fingerprint string"))
    return tb.changed_files(now, manifest)


@query("column_roles", """SELECT * FROM (VALUES ('o_orderkey', 'name', 'number'), ('o_custkey', 'discrete', 'number'), ('o_orderstatus', 'discrete', 'number'), ('o_totalprice', 'discrete', 'number'), ('o_orderdate', 'continuous', 'date'), ('o_orderpriority', 'discrete', 'number')) v("column", role, conversion)""")
def column_roles(spark, d):
    o = table(spark, d, "orders")
    rows = [(c, role, tb.guess_conversion(o, c).mode) for c, role in tb.column_roles(o.columns)]
    return spark.createDataFrame(rows, "column string, role string, conversion string")
