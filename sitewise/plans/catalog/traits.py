"""Names, validation, metadata joins, conversions and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import sequence as sq
from sitewise.functions import transforms as tf
from sitewise.operators import haplotypes as hp
from sitewise.operators import rings as rg
from sitewise.operators import samples as sm
from sitewise.operators import topology as tp
from sitewise.plans import bridge as br
from sitewise.plans.bridge import samples, table
from sitewise.plans.catalog.diversity import _HAP, rounded
from sitewise.plans.registry import query

# names with every kind of character the cleaning rules touch
_RAW = """raw AS (SELECT p_partkey AS id, concat('  ', p_name, ', "', p_brand, '"=', '''', p_type, ' x  ', cast(p_size AS string), ' ') AS name FROM part)"""


def _raw_names(spark, d):
    return spark.sql("SELECT p_partkey AS id, concat('  ', p_name, ', \"', p_brand, '\"=', '\\'', p_type, ' x  ', "
                     "cast(p_size AS string), ' ') AS name FROM {t}", t=table(spark, d, "part"))


@query("clean_name", "WITH " + _RAW + """ SELECT id, regexp_replace(trim(translate(name, ',="''', '__')), '\\s+', '_', 'g') AS name FROM raw""")
def clean_name(spark, d):
    return _raw_names(spark, d).select("id", sq.clean_name(F.col("name")).alias("name"))


@query("viewer_id", """WITH n AS (SELECT p_partkey AS id, concat(CASE WHEN p_size < 20 THEN cast(p_size AS string) ELSE '' END, p_name, '|', p_brand) AS name FROM part),
 s AS (SELECT id, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM n)
 SELECT id, CASE WHEN regexp_matches(name, '^[0-9]') THEN 'L' || name ELSE name END AS name FROM s""")
def viewer_id(spark, d):
    raw = F.concat(F.when(F.col("p_size") < 20, F.col("p_size").cast("string")).otherwise(""), "p_name", F.lit("|"), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tf.viewer_id(raw).alias("name"))


@query("classify_base", "WITH {cells} " + """SELECT CASE WHEN base IN ('A','C','G','T') THEN 'callable' WHEN base = '-' THEN 'gap' WHEN base IN ('N','?') THEN 'unknown'
 WHEN base IN ('R','Y','S','W','K','M','B','D','H','V') THEN 'ambiguity' ELSE 'unsupported' END AS class, count(*) AS n FROM cells GROUP BY ALL""")
def classify_base(spark, d):
    return sq.cells(samples(spark, d)).groupBy(sq.classify_base(F.col("base")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# composite header name|group|value
_COMPOSITE = """cmp AS (SELECT sample_idx, sequence, sample || '|' || grp || '|' || value AS sample, '' AS discrete, '0' AS continuous FROM samples)"""


@query("standardize", "WITH {samples}, " + _COMPOSITE + """,
 k AS (SELECT *, row_number() OVER (ORDER BY sample_idx) + 100 AS id, string_split(replace(sample, 'Customer#', 'c-'), '|') AS p FROM cmp WHERE NOT regexp_matches(sequence, '[RYSWKMBDHVN]'))
 SELECT sample_idx, id, trim(p[1]) AS sample, trim(p[2]) AS discrete, trim(p[3]) AS continuous, sequence FROM k""")
def standardize(spark, d):
    s = samples(spark, d).select(
        "sample_idx", "sequence", F.concat_ws("|", "sample", "grp", F.col("value").cast("string")).alias("sample"),
        F.lit("").alias("discrete"), F.lit("0").alias("continuous"))
    rules = sm.Standardisation(remove_ambiguous=True, replace_from="Customer#", replace_to="c-",
                               name=sm.Split("|", 0), discrete=sm.Split("|", 1), continuous=sm.Split("|", 2), start_id=101)
    return sm.standardize(s, rules)


@query("selected_samples", "WITH {samples} SELECT sample_idx, sample FROM samples WHERE value > 0")
def selected_samples(spark, d):
    return sm.selected(samples(spark, d).withColumn("selected", F.col("value") > 0)).select("sample_idx", "sample")


# parts as samples: repeated names, blank names, blank sequences and unreadable numbers
_PARTS = """pt AS (SELECT p_partkey AS sample_idx, CASE WHEN p_size < 5 THEN '' WHEN p_size < 25 THEN replace(p_name, ' ', '_') ELSE p_name END AS sample,
 CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_brand END AS sequence, CASE WHEN p_brand = 'Brand#2' THEN 'n/a' ELSE cast(p_size AS string) END AS continuous FROM part)"""


def _parts(spark, d):
    return spark.sql(_PARTS.replace("pt AS (", "", 1).rstrip(")").replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


_ISSUES = _PARTS + """, iss AS (SELECT sample_idx, sample AS ref, CASE WHEN trim(sample) = '' THEN 'empty_name' WHEN regexp_matches(trim(sample), '\\s') THEN 'invalid_name_whitespace'
 WHEN trim(sequence) = '' THEN 'empty_sequence' WHEN continuous = 'n/a' THEN 'invalid_continuous' END AS code FROM pt),
 allv AS (SELECT * FROM iss WHERE code IS NOT NULL UNION ALL SELECT NULL, trim(sample), 'duplicate_names' FROM pt GROUP BY trim(sample) HAVING count(*) > 1)"""


@query("validate_samples", "WITH " + _ISSUES + " SELECT sample_idx, ref, code FROM allv")
def validate_samples(spark, d):
    return sm.validate_samples(_parts(spark, d))


@query("first_issue", "WITH " + _ISSUES + " SELECT sample_idx, ref, code FROM allv ORDER BY sample_idx IS NULL, sample_idx, ref LIMIT 1")
def first_issue(spark, d):
    return sm.first_issue(sm.validate_samples(_parts(spark, d)))


@query("validate_alignment", "WITH " + _PARTS + """ SELECT count(*) AS samples, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length,
 count(*) FILTER (trim(sample) = '') AS blank_names, (SELECT count(*) FROM (SELECT trim(sample) FROM pt GROUP BY ALL HAVING count(*) > 1)) AS duplicate_names, false AS aligned FROM pt""")
def validate_alignment(spark, d):
    return sm.validate_alignment(_parts(spark, d))


@query("validate_alignment_ok", "WITH {samples} SELECT count(*) AS samples, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, 0::BIGINT AS blank_names, 0::BIGINT AS duplicate_names, true AS aligned FROM samples")
def validate_alignment_ok(spark, d):
    return sm.validate_alignment(samples(spark, d))


# document texts are no sequences: every alphabet has something to report
_VIOL = """SELECT doc_id AS sample_idx, lang AS sample, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '[^{}]'))), ',') AS symbols FROM documents WHERE regexp_matches(upper(text), '[^{}]')"""


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_idx"), F.col("lang").alias("sample"), F.col("text").alias("sequence"))


@query("symbol_violations", "WITH {samples} SELECT sample_idx, sample, array_to_string(list_sort(list_distinct(regexp_extract_all(sequence, '[^ACGTU-]'))), ',') AS symbols FROM samples WHERE regexp_matches(sequence, '[^ACGTU-]')")
def symbol_violations(spark, d):
    return sm.symbol_violations(samples(spark, d), "network")


@query("symbol_violations_haplotype", """SELECT p_partkey AS sample_idx, p_brand AS sample, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[^ACGTURYSWKMBDHVN?-]'))), ',') AS symbols FROM part WHERE regexp_matches(upper(p_name), '[^ACGTURYSWKMBDHVN?-]')""")
def symbol_violations_haplotype(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("sample_idx"), F.col("p_brand").alias("sample"), F.col("p_name").alias("sequence"))
    return sm.symbol_violations(s, "haplotype")


@query("meaningful_values", """WITH {members} SELECT sample, coalesce(try_cast(trim(value) AS DOUBLE) <> 0, false) AS meaningful FROM traits WHERE trait = 'thousands'""")
def meaningful_values(spark, d):
    return br.traits(spark, d).where("trait = 'thousands'").select("sample", tf.is_meaningful(F.col("value")).alias("meaningful"))


@query("trait_completeness", "WITH {samples} SELECT bool_or(trim(grp) <> '') AS has_discrete, bool_or(value <> 0) AS has_continuous FROM samples")
def trait_completeness(spark, d):
    return sm.trait_completeness(samples(spark, d).select(F.col("grp").alias("discrete"), F.col("value").cast("string").alias("continuous")))


@query("preview", "WITH {samples} SELECT sample_idx, sample, substr(sequence, 1, 500) AS sequence, (SELECT count(*) FROM samples) AS total_rows, (SELECT max(length(sequence)) FROM samples) AS total_positions FROM samples ORDER BY sample_idx LIMIT 200")
def preview(spark, d):
    return sm.preview(samples(spark, d))


# metadata: customers that placed orders, under their own name or under an order number
_META = """meta AS (SELECT concat('Customer#', lpad(cast(o_custkey AS string), 9, '0')) AS sample, max(o_orderstatus) AS discrete, cast(count(*) AS string) AS continuous FROM orders GROUP BY o_custkey)"""


def _meta(spark, d):
    return spark.sql(_META.replace("meta AS (", "", 1).rstrip(")") .replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_name").alias("sample"))


@query("name_differences", "WITH " + _META + """, s2 AS (SELECT s_name AS sample FROM supplier UNION ALL SELECT c_name FROM customer)
 SELECT 'loaded' AS side, sample FROM s2 WHERE sample NOT IN (SELECT sample FROM meta) UNION ALL SELECT 'metadata', sample FROM meta WHERE sample NOT IN (SELECT sample FROM s2)""")
def name_differences(spark, d):
    loaded = table(spark, d, "supplier").select(F.col("s_name").alias("sample")).unionByName(_customers(spark, d).select("sample"))
    return sm.name_differences(loaded, _meta(spark, d))


@query("attach_metadata_strict", "WITH " + _META + " SELECT c_custkey AS sample_idx, c_name AS sample, discrete, continuous FROM customer JOIN meta ON sample = c_name")
def attach_metadata_strict(spark, d):
    meta = _meta(spark, d)
    return sm.attach_metadata(_customers(spark, d).join(meta.select("sample"), "sample", "left_semi"), meta).select(
        "sample_idx", "sample", "discrete", "continuous")


@query("attach_metadata_lenient", "WITH " + _META + " SELECT c_custkey AS sample_idx, c_name AS sample, coalesce(discrete, '') AS discrete, coalesce(continuous, '0') AS continuous FROM customer LEFT JOIN meta ON sample = c_name")
def attach_metadata_lenient(spark, d):
    return sm.attach_metadata(_customers(spark, d), _meta(spark, d), strict=False).select("sample_idx", "sample", "discrete", "continuous")


# order numbers as samples, with the customer name as a second key for every order
_KEYS = """m6 AS (SELECT concat('O', cast(o_orderkey AS string)) AS sample, CASE WHEN o_orderstatus = 'F' THEN '*' WHEN o_orderstatus = 'P' THEN concat('C', cast(o_custkey AS string)) ELSE concat('A', cast(o_orderkey AS string)) END AS accession, o_orderpriority AS state FROM orders)"""


def _m6(spark, d):
    return spark.sql(_KEYS.replace("m6 AS (", "", 1).rstrip(")").replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query("metadata_duplicate_keys", "WITH " + _KEYS + """, k AS (SELECT sample AS key FROM m6 UNION ALL SELECT accession FROM m6 WHERE accession <> '*')
 SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1""")
def metadata_duplicate_keys(spark, d):
    return sm.metadata_keys(_m6(spark, d), ["sample", "accession"])[1]


_WANT = """w AS (SELECT l_orderkey * 10 + l_linenumber AS ord, concat(CASE WHEN l_linenumber < 4 THEN 'O' ELSE 'A' END, cast(l_orderkey AS string)) AS sample FROM lineitem)"""


def _wanted(spark, d):
    return spark.sql(_WANT.replace("w AS (", "", 1).rstrip(")").replace("FROM lineitem", "FROM {l}"), l=table(spark, d, "lineitem"))


@query("join_any_key", "WITH " + _KEYS + ", " + _WANT + """, k AS (SELECT sample AS key, state FROM m6 UNION ALL SELECT accession, state FROM m6 WHERE accession <> '*')
 SELECT ord, w.sample, state FROM w LEFT JOIN k ON key = w.sample""")
def join_any_key(spark, d):
    return sm.join_any_key(_wanted(spark, d), _m6(spark, d), ["sample", "accession"]).select(
        "ord", "sample", F.col("meta_state").alias("state"))


@query("subset_metadata", "WITH " + _KEYS + ", " + _WANT + """, k AS (SELECT sample AS key, state FROM m6 UNION ALL SELECT accession, state FROM m6 WHERE accession <> '*')
 SELECT ord, 'S' || ord AS sample, 'S' || ord AS accession, state FROM w JOIN k ON key = w.sample""")
def subset_metadata(spark, d):
    wanted = _wanted(spark, d).withColumn("alias", F.concat(F.lit("S"), F.col("ord").cast("string")))
    return sm.subset_metadata(_m6(spark, d), wanted).select("ord", "sample", "accession", "state")


@query("metadata_missing", "WITH " + _KEYS + ", " + _WANT + """, k AS (SELECT sample AS key FROM m6 UNION ALL SELECT accession FROM m6 WHERE accession <> '*')
 SELECT sample FROM w WHERE sample NOT IN (SELECT key FROM k)""")
def metadata_missing(spark, d):
    return sm.metadata_missing(_m6(spark, d), _wanted(spark, d))


_HT = _HAP + """, tr AS (SELECT sample, nation AS discrete, cast(floor(value / 100) AS BIGINT)::VARCHAR AS continuous FROM samples WHERE grp <> 'BUILDING'),
 ht AS (SELECT s.sample_idx, s.sample, hap_idx, 'H' || hap_idx AS haplotype, coalesce(continuous, '0') AS continuous, coalesce(discrete, '') AS discrete FROM samples s JOIN lab USING (sequence) LEFT JOIN tr ON tr.sample = s.sample),
 hv AS (SELECT hap_idx, haplotype, 'continuous' AS kind, continuous AS value, min(sample_idx) AS first_idx, count(*) AS n FROM ht GROUP BY ALL
  UNION ALL SELECT hap_idx, haplotype, 'discrete', discrete, min(sample_idx), count(*) FROM ht WHERE discrete <> '' GROUP BY ALL)"""


def _with_traits(spark, d):
    s = samples(spark, d)
    traits = s.where("grp <> 'BUILDING'").select(
        "sample", F.col("nation").alias("discrete"), F.floor(F.col("value") / 100).cast("string").alias("continuous"))
    return hp.haplotype_traits(hp.identify_haplotypes(s)[1], traits)


@query("haplotype_traits", "WITH {samples}, " + _HT + " SELECT * FROM ht")
def haplotype_traits(spark, d):
    return _with_traits(spark, d)


@query("haplotype_trait_values", "WITH {samples}, " + _HT + " SELECT * FROM hv")
def haplotype_trait_values(spark, d):
    return hp.haplotype_trait_values(_with_traits(spark, d))


@query("haplotype_summary", "WITH {samples}, " + _HT + """ SELECT hap_idx, haplotype, count(*) AS total_quantity, min(sample_idx) AS first_idx,
 count(DISTINCT continuous) AS continuous_values, count(DISTINCT discrete) FILTER (discrete <> '') AS discrete_values FROM ht GROUP BY ALL""")
def haplotype_summary(spark, d):
    return hp.haplotype_summary(_with_traits(spark, d))


@query("duplicate_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, d):
    return sm.duplicates(table(spark, d, "part").select(F.col("p_name").alias("name")), "name")


@query("distinct_names", "SELECT DISTINCT p_name AS name FROM part")
def distinct_names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


@query("merge_traits", """WITH {members}, nw AS (SELECT concat('O', l_orderkey) AS sample, CASE WHEN l_linenumber = 1 THEN 'status' ELSE 'line' || l_linenumber END AS trait, l_returnflag AS value FROM lineitem),
 f AS (SELECT sample, trait, max(value) AS value FROM nw GROUP BY ALL)
 SELECT coalesce(f.sample, t.sample) AS sample, coalesce(f.trait, t.trait) AS trait, coalesce(f.value, t.value) AS value FROM traits t FULL JOIN f ON f.sample = t.sample AND f.trait = t.trait""")
def merge_traits(spark, d):
    new = table(spark, d, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("sample"),
        F.when(F.col("l_linenumber") == 1, "status").otherwise(F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))).alias("trait"),
        F.col("l_returnflag").alias("value")).groupBy("sample", "trait").agg(F.max("value").alias("value"))
    return sm.merge_traits(br.traits(spark, d).select("sample", "trait", "value"), new)


@query("merge_definitions", """WITH o AS (SELECT p_brand AS trait, 'discrete' AS kind, row_number() OVER (ORDER BY min(p_partkey)) AS ord FROM part WHERE p_size < 5 GROUP BY p_brand),
 n AS (SELECT p_brand AS trait, 'continuous' AS kind, min(p_partkey) AS ord FROM part GROUP BY p_brand)
 SELECT * FROM o UNION ALL SELECT trait, kind, row_number() OVER (ORDER BY ord) + (SELECT max(ord) FROM o) FROM n WHERE trait NOT IN (SELECT trait FROM o)""")
def merge_definitions(spark, d):
    part = table(spark, d, "part")
    from sitewise.storage import dense_index
    old = dense_index(part.where("p_size < 5").groupBy(F.col("p_brand").alias("trait")).agg(F.min("p_partkey").alias("k")), "k", "ord").select(
        "trait", F.lit("discrete").alias("kind"), "ord")
    new = part.groupBy(F.col("p_brand").alias("trait")).agg(F.min("p_partkey").alias("ord")).select(
        "trait", F.lit("continuous").alias("kind"), "ord")
    return sm.merge_definitions(old, new)


@query("primary_traits", """WITH {samples} SELECT sample_idx, nation AS discrete, CASE WHEN value < 0 THEN '0' ELSE cast(floor(value) AS BIGINT)::VARCHAR END AS continuous FROM samples""")
def primary_traits(spark, d):
    s = samples(spark, d).withColumn("traits", F.create_map(
        F.lit("nation"), F.col("nation"), F.lit("value"),
        F.when(F.col("value") < 0, "").otherwise(F.floor("value").cast("string"))))
    return sm.primary_traits(s, "nation", "value").select("sample_idx", "discrete", "continuous")


@query("traits_to_long", """SELECT c_custkey AS sample_idx, unnest(['segment', 'nation']) AS trait, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer""")
def traits_to_long(spark, d):
    wide = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return sm.to_long(wide, ["sample_idx"], ["segment", "nation"])


@query("traits_to_wide", """WITH {members} SELECT sample, max(value) FILTER (trait = 'status') AS status, max(value) FILTER (trait = 'priority') AS priority FROM traits GROUP BY sample""")
def traits_to_wide(spark, d):
    return sm.to_wide(br.traits(spark, d), ["sample"], ["status", "priority"])


@query("plain_number", """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber WHEN 1 THEN cast(l_orderkey AS string) WHEN 2 THEN concat(' +', cast(l_orderkey AS string), '.5 ') WHEN 3 THEN concat('-', cast(l_orderkey AS string), 'e-2')
 WHEN 4 THEN '' WHEN 5 THEN concat(cast(l_orderkey AS string), ' m') WHEN 6 THEN '1e999' ELSE '.5.' END AS value FROM lineitem)
 SELECT id, CASE WHEN regexp_full_match(trim(value), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND value <> '1e999' THEN round(cast(trim(value) AS DOUBLE), 9) END AS number FROM t""")
def plain_number(spark, d):
    key = F.col("l_orderkey").cast("string")
    n = F.col("l_linenumber")
    value = (F.when(n == 1, key).when(n == 2, F.concat(F.lit(" +"), key, F.lit(".5 "))).when(n == 3, F.concat(F.lit("-"), key, F.lit("e-2")))
             .when(n == 4, "").when(n == 5, F.concat(key, F.lit(" m"))).when(n == 6, "1e999").otherwise(".5."))
    return rounded(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), tf.plain_number(value).alias("number")), "number")


# order dates written in seven styles, some unreadable
_DATES = """dt AS (SELECT o_orderkey AS id, o_orderdate::DATE AS dd, substr(md5(concat('d:', o_orderkey)), 1, 1) AS h FROM orders),
 dv AS (SELECT id, CASE WHEN h < '2' THEN dd WHEN h < '6' THEN dd WHEN h < '8' THEN dd WHEN h < 'a' THEN date_trunc('month', dd)::DATE WHEN h < 'c' THEN date_trunc('year', dd)::DATE WHEN h < 'e' THEN dd END AS value FROM dt)"""


def _date_text(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    h = F.substring(F.md5(F.concat(F.lit("d:"), F.col("o_orderkey").cast("string"))), 1, 1)
    written = (F.when(h < "2", F.date_format(day, "yyyy-MM-dd")).when(h < "6", F.date_format(day, "yyyy/M/d"))
               .when(h < "8", F.date_format(day, "yyyy.MM.dd")).when(h < "a", F.date_format(day, "yyyy-M"))
               .when(h < "c", F.date_format(day, "yyyy")).when(h < "e", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00Z")))
               .when(h < "f", "").otherwise("soon"))
    return o.select(F.col("o_orderkey").alias("id"), written.alias("value"))


@query("parse_date", "WITH " + _DATES + " SELECT id, strftime(value, '%Y-%m-%d') AS date FROM dv")
def parse_date(spark, d):
    return _date_text(spark, d).select("id", F.date_format(tf.parse_date(F.col("value")), "yyyy-MM-dd").alias("date"))


@query("elapsed_days", "WITH " + _DATES + " SELECT id, date_diff('day', (SELECT min(value) FROM dv), value)::DOUBLE AS days FROM dv")
def elapsed_days(spark, d):
    return tf.convert_column(_date_text(spark, d), "value", tf.Conversion("date", "days"), "days").select("id", "days")


_MONTHS = """fm AS (SELECT id, value, least(value, DATE '1997-08-31') AS a, greatest(value, DATE '1997-08-31') AS b FROM dv),
 fw AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN (a + to_months(((year(b) - year(a)) * 12 + month(b) - month(a))::INT))::DATE > b THEN 1 ELSE 0 END AS w FROM fm),
 fe AS (SELECT id, CASE WHEN value < DATE '1997-08-31' THEN -1 ELSE 1 END * (w + date_diff('day', (a + to_months(w::INT))::DATE, b) / date_diff('day', (a + to_months(w::INT))::DATE, (a + to_months(w::INT + 1))::DATE)) AS m FROM fw WHERE value IS NOT NULL)"""


@query("elapsed_months", "WITH " + _DATES + ", " + _MONTHS + " SELECT id, round(m, 9) + 0.0 AS months FROM dv LEFT JOIN fe USING (id)")
def elapsed_months(spark, d):
    rule = tf.Conversion("date", "months", "1997-08-31")
    return rounded(tf.convert_column(_date_text(spark, d), "value", rule, "months").select("id", "months"), "months")


@query("elapsed_years", "WITH " + _DATES + ", " + _MONTHS + " SELECT id, round(m / 12, 9) + 0.0 AS years FROM dv LEFT JOIN fe USING (id)")
def elapsed_years(spark, d):
    rule = tf.Conversion("date", "years", "1997/8/31")
    return rounded(tf.convert_column(_date_text(spark, d), "value", rule, "years").select("id", "years"), "years")


@query("conversion_errors", """WITH dt AS (SELECT o_orderkey AS id, substr(md5(concat('d:', o_orderkey)), 1, 1) AS h FROM orders) SELECT id AS "row", 'soon' AS value FROM dt WHERE h = 'f'""")
def conversion_errors(spark, d):
    done = tf.convert_column(_date_text(spark, d), "value", tf.Conversion("date"), "years")
    return tf.conversion_errors(done, "value", "years", "id")


_SUFFIX = "CASE l_linenumber WHEN 1 THEN ' cm' WHEN 2 THEN 'FT' WHEN 3 THEN ' metres' WHEN 4 THEN '' WHEN 5 THEN ' km' WHEN 6 THEN ' parsec' ELSE 'in' END"


@query("measurement_length", f"""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, {_SUFFIX} AS s FROM lineitem)
 SELECT id, round(CASE s WHEN ' cm' THEN q * 0.01 WHEN 'FT' THEN q * 0.3048 WHEN ' metres' THEN q WHEN '' THEN q * 0.001 WHEN ' km' THEN q * 1000 WHEN 'in' THEN q * 0.0254 END, 9) AS metres FROM t""")
def measurement_length(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                                            F.concat(F.col("l_quantity").cast("string"), F.expr(_SUFFIX)).alias("value"))
    rule = tf.Conversion("measurement", quantity="length", target_unit="m", bare_unit="mm")
    return rounded(tf.convert_column(li, "value", rule, "metres").select("id", "metres"), "metres")


@query("measurement_temperature", """SELECT c_custkey AS id, round(CASE WHEN c_nationkey < 8 THEN c_acctbal WHEN c_nationkey < 16 THEN (c_acctbal - 32) * 5 / 9 ELSE c_acctbal - 273.15 END, 7) + 0.0 AS celsius FROM customer""")
def measurement_temperature(spark, d):
    unit = F.when(F.col("c_nationkey") < 8, " °C").when(F.col("c_nationkey") < 16, "°F").otherwise(" Kelvin")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_acctbal").cast("string"), unit).alias("value"))
    rule = tf.Conversion("measurement", quantity="temperature", target_unit="c", bare_unit="c")
    return tf.convert_column(c, "value", rule, "celsius").select("id", (F.round("celsius", 7) + F.lit(0.0)).alias("celsius"))


@query("measurement_mass", """SELECT p_partkey AS id, round(CASE WHEN p_size < 10 THEN p_retailprice * 1000 WHEN p_size < 20 THEN p_retailprice / 1000 ELSE p_retailprice END, 9) AS grams FROM part""")
def measurement_mass(spark, d):
    unit = F.when(F.col("p_size") < 10, "kg").when(F.col("p_size") < 20, " 毫克").otherwise(" grams")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_retailprice").cast("string"), unit).alias("value"))
    rule = tf.Conversion("measurement", quantity="mass", target_unit="g", bare_unit="g")
    return rounded(tf.convert_column(p, "value", rule, "grams").select("id", "grams"), "grams")


@query("edge_change_value", """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber WHEN 1 THEN cast(l_quantity AS string) WHEN 2 THEN concat('-', cast(l_quantity AS string)) WHEN 3 THEN '' ELSE concat(l_returnflag, '1, ', l_linestatus, '2;', cast(l_linenumber AS string), ' ') END AS v FROM lineitem)
 SELECT id, CASE WHEN v = '' THEN 0.0 WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN greatest(0.0, try_cast(v AS DOUBLE)) ELSE len(list_filter(regexp_split_to_array(trim(v), '[\\s,;]+'), lambda x: x <> ''))::DOUBLE END AS changes FROM t""")
def edge_change_value(spark, d):
    v = F.expr("CASE l_linenumber WHEN 1 THEN cast(l_quantity AS string) WHEN 2 THEN concat('-', cast(l_quantity AS string)) WHEN 3 THEN '' "
               "ELSE concat(l_returnflag, '1, ', l_linestatus, '2;', cast(l_linenumber AS string), ' ') END")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), tf.edge_change_value(v).alias("changes"))


@query("sequence_fingerprint", "SELECT doc_id AS id, sha256(text) AS fingerprint FROM documents")
def sequence_fingerprint(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))


# labelled documents changed after the snapshot, French ones were added later, German ones removed
@query("snapshot_drift", """SELECT doc_id AS "row", CASE WHEN lang = 'fr' THEN 'extra_row' WHEN lang = 'de' THEN 'missing_row' ELSE 'content_differs' END AS code FROM documents
 WHERE lang IN ('fr', 'de') OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def snapshot_drift(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    current = docs.where("lang <> 'de'").select(F.col("doc_id").alias("row"), F.col("text").alias("sequence"))
    before = F.when(F.col("quality") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    saved = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("row"), F.sha2(before, 256).alias("fingerprint"))
    return sm.snapshot_drift(current, saved)


@query("same_content", """WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')
 SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, false AS unchanged""")
def same_content(spark, d):
    li = table(spark, d, "lineitem")
    return sm.same_content(li.select("l_orderkey", "l_partkey"), li.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey"))


@query("trait_categories", """WITH {members} SELECT trim(value) AS value, min(ord) AS first_ord, count(*) AS n FROM traits JOIN members USING (sample) WHERE trait = 'priority' AND trim(value) <> '' GROUP BY ALL""")
def trait_categories(spark, d):
    t = br.traits(spark, d).where("trait = 'priority'").join(br.members(spark, d), "sample")
    return rg.trait_categories(t)


_SHOWN = """shown AS (SELECT node_id, unnest({}) AS trait FROM nodes WHERE NOT (frequency <= 0 OR trim(label) = '')),
 mv AS (SELECT s.node_id, s.trait, m.sample, m.ord, trim(t.value) AS value FROM shown s LEFT JOIN members m ON m.node_id = s.node_id LEFT JOIN traits t ON t.sample = m.sample AND t.trait = s.trait)"""


@query("discrete_rings", "WITH {network}, {members}, " + _SHOWN.format("['status', 'priority']") + """,
 c AS (SELECT node_id, trait, coalesce(value, '') AS label, greatest(count(sample), 1) AS n, min(ord) AS f FROM mv GROUP BY ALL)
 SELECT node_id, trait, label, n, row_number() OVER (PARTITION BY node_id, trait ORDER BY CASE WHEN trait = 'status' AND label = 'P' THEN 0 WHEN trait = 'status' AND label = 'O' THEN 1 WHEN label = '' THEN 9 ELSE 8 END, f, label) AS ord FROM c""")
def discrete_rings(spark, d):
    nodes = tp.flag_intermediate(br.nodes(spark, d), "frequency")
    return rg.discrete_rings(nodes, br.members(spark, d), br.traits(spark, d), {"status": ["P", "O"], "priority": []})


@query("continuous_rings", "WITH {network}, {members}, " + _SHOWN.format("['thousands']") + """,
 r AS (SELECT min(try_cast(value AS DOUBLE)) AS lo, max(try_cast(value AS DOUBLE)) AS hi FROM traits WHERE trait = 'thousands'),
 c AS (SELECT node_id, trait, try_cast(value AS DOUBLE) AS label, greatest(count(sample), 1) AS n FROM mv GROUP BY ALL),
 w AS (SELECT *, sum(label * n) OVER (PARTITION BY node_id) / sum(n) FILTER (label IS NOT NULL) OVER (PARTITION BY node_id) AS mean, row_number() OVER (PARTITION BY node_id ORDER BY label NULLS LAST) AS ord FROM c)
 SELECT node_id, trait, label, n, ord, round(mean, 9) AS mean, round((label - lo) / (hi - lo), 9) AS position, round((mean - lo) / (hi - lo), 9) AS mean_position FROM w, r""")
def continuous_rings(spark, d):
    nodes = tp.flag_intermediate(br.nodes(spark, d), "frequency")
    return rounded(rg.continuous_rings(nodes, br.members(spark, d), br.traits(spark, d), ["thousands"]), "mean", "position", "mean_position")


@query("trait_range", """WITH {members} SELECT 'thousands' AS trait, min(try_cast(value AS DOUBLE)) AS vmin, max(try_cast(value AS DOUBLE)) AS vmax FROM traits WHERE trait = 'thousands'
 UNION ALL SELECT 'status', 0.0::DOUBLE, 1.0::DOUBLE""")
def trait_range(spark, d):
    return rg.trait_range(br.members(spark, d), br.traits(spark, d), ["thousands", "status"])


@query("trait_legend", """WITH {members}, a AS (SELECT sample, unnest(['status', 'priority']) AS trait FROM members)
 SELECT a.trait, coalesce(trim(value), '') AS label, count(*) AS n, coalesce(trim(value), '') = '' AS is_missing FROM a LEFT JOIN traits t ON t.sample = a.sample AND t.trait = a.trait GROUP BY ALL""")
def trait_legend(spark, d):
    return rg.trait_legend(br.members(spark, d), br.traits(spark, d), ["status", "priority"])


@query("reassign_group", """WITH {members}, g AS (SELECT m.node_id, m.sample, coalesce(nullif(trim(CASE WHEN l.l_orderkey IS NOT NULL THEN 'returned' ELSE t.value END), ''), 'Default') AS grp FROM members m JOIN traits t ON t.sample = m.sample AND t.trait = 'status'
 LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON l.l_orderkey = m.ord)
 SELECT node_id, CASE WHEN grp = 'F' THEN 'Filled' ELSE grp END AS grp, count(*) AS n FROM g GROUP BY ALL""")
def reassign_group(spark, d):
    groups = br.traits(spark, d).where("trait = 'status'").select("sample", F.col("value").alias("grp"))
    changes = (table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
               .select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("sample"), F.lit("returned").alias("grp")))
    return rg.group_counts(br.members(spark, d), rg.rename_group(rg.reassign_group(groups, changes), "F", "Filled"))
