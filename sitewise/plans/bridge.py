"""Alignments, traits and networks that Spark derives from the given tables.

Each source table is read whole; every derived column is a row expression, so the work grows
with the table. The same SQL text feeds Spark and the SQL check.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from sitewise.storage import spread

SITES = 64


def _hex(tag: str, chunks: int) -> str:
    return "".join(md5(f"{tag}:{i}".encode()).hexdigest() for i in range(chunks))


ROOT = _hex("root", 2)
MESSY = _hex("messy", 2)
HEX, BASES, NEXT = "0123456789abcdef", "ACGTACGTACGTACGT", "CGTACGTACGTACGTA"


def _clade_sequence(clade: str) -> str:
    """Ancestral sequence of a clade: the root with a few sites replaced."""
    h = _hex(f"clade:{clade}", 4)
    return "".join(NEXT[int(h[2 * p + 1], 16)] if h[2 * p:2 * p + 2] < "0c" else BASES[int(ROOT[p], 16)]
                   for p in range(SITES))


# A customer carries the sequence of its clade (the largest holds over a third of them) and up to
# two private events: on a "messy" site an unknown, gap or ambiguity code or a mutation, on other
# sites a mutation, on conserved sites nothing.
_CLADE = ("CASE WHEN substr(md5(concat('c:', c_name)), 1, 1) < '6' THEN '0' "
          "ELSE substr(md5(concat('c:', c_name)), 1, 1) END")
_FOUNDER = "CASE clade " + " ".join(f"WHEN '{c}' THEN '{_clade_sequence(c)}'" for c in HEX) + " END"
_FIELDS = ("c_custkey AS sample_idx, c_name AS sample, "
           "CASE WHEN c_nationkey = 7 THEN '' ELSE c_mktsegment END AS grp, "
           "concat('NATION_', cast(c_nationkey AS string)) AS nation, "
           "c_acctbal AS value, clade")


def _hex_int(text: str, engine: str) -> str:
    return f"cast(conv({text}, 16, 10) AS bigint)" if engine == "spark" else f"('0x' || {text})::BIGINT"


def _samples_sql(engine: str, customer: str = "customer") -> str:
    def place(digits: int) -> str:  # 1..64, or beyond the alignment for three quarters of the rows
        return f"1 + cast(floor({_hex_int(f'substr(h, {digits}, 3)', engine)} / 16e0) AS int)"
    def event(site: str, digit: int) -> str:
        sign = f"substr(h, {digit}, 1)"
        return (f"CASE WHEN substr('{MESSY}', {site}, 1) >= 'a' THEN substr(s, {site}, 1) "
                f"WHEN substr('{MESSY}', {site}, 1) < '6' AND {sign} < '3' THEN 'N' "
                f"WHEN substr('{MESSY}', {site}, 1) < '6' AND {sign} < '5' THEN '-' "
                f"WHEN substr('{MESSY}', {site}, 1) < '6' AND {sign} < '6' THEN 'R' "
                f"ELSE translate(substr(h, {digit + 1}, 1), '{HEX}', '{BASES}') END")
    def put(s: str, site: str, symbol: str) -> str:
        return (f"CASE WHEN {site} <= {SITES} THEN concat(substr({s}, 1, {site} - 1), {symbol}, "
                f"substr({s}, {site} + 1, {SITES})) ELSE {s} END")
    founder = (f"SELECT *, {_FOUNDER} AS s, {place(1)} AS p1, {place(4)} AS p2 FROM "
               f"(SELECT *, md5(concat('e:', c_name)) AS h, {_CLADE} AS clade FROM {customer})")
    once = f"SELECT *, {put('s', 'p1', event('p1', 7))} AS s1 FROM ({founder})"
    return f"SELECT {_FIELDS}, {put('s1', 'p2', event('p2', 9))} AS sequence FROM ({once})"


DUCK_SAMPLES = _samples_sql("duckdb")
SPARK_SAMPLES = _samples_sql("spark", "{customer}")

SAMPLES_CTE = f"samples AS MATERIALIZED ({DUCK_SAMPLES})"
CELLS_CTE = (
    f"{SAMPLES_CTE}, cells AS MATERIALIZED (SELECT sample_idx, sample, "
    "coalesce(nullif(trim(grp), ''), '(missing)') AS grp, q.pos AS pos, "
    f"substr(sequence, q.pos, 1) AS base FROM samples, "
    f"(SELECT unnest(range(1, {SITES + 1}))::BIGINT AS pos) q)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned sequences, one per customer, with a group, a nation and a numeric trait."""
    customer = spread(table(spark, sf_dir, "customer"))
    return spark.sql(SPARK_SAMPLES, customer=customer)


# --- network over customers: every customer hangs off an earlier one (or starts a component),
# --- and some close a cycle with an ancestor two or three steps up
def _parent(k: str, engine: str) -> str:
    key = f"cast({k} AS string)"
    share = _hex_int(f"substr(md5(concat('net:', {key})), 1, 4)", engine)
    return (f"CASE WHEN {k} IS NULL OR {k} = 0 OR substr(md5(concat('root:', {key})), 1, 1) < '4' THEN NULL "
            f"ELSE cast(floor({k} * {share} / 65536e0) AS bigint) END")


def _edges_sql(engine: str, customer: str = "customer") -> str:
    weight = lambda tag: (
        "1e0 + floor(" + _hex_int(f"substr(md5(concat('{tag}:', cast(k AS string))), 1, 1)", engine) + " / 4e0)")
    par = f"(SELECT c_custkey AS k, {_parent('c_custkey', engine)} AS p FROM {customer})"
    up = (f"SELECT a.k, a.p AS p1, b.p AS p2, c.p AS p3, substr(md5(concat('x:', cast(a.k AS string))), 1, 1) AS x "
          f"FROM {par} a LEFT JOIN {par} b ON b.k = a.p LEFT JOIN {par} c ON c.k = b.p")
    ends = ("stack(2, 0L, p1, 1L, CASE WHEN x < '3' THEN p2 WHEN x < '5' THEN p3 END) AS (slot, target)"
            if engine == "spark" else
            "unnest([0, 1]) AS slot, unnest([p1, CASE WHEN x < '3' THEN p2 WHEN x < '5' THEN p3 END]) AS target")
    return (f"SELECT 2 * k + slot AS edge_index, k AS source, target, "
            f"CASE WHEN slot = 0 THEN {weight('w1')} ELSE {weight('w2')} END AS distance "
            f"FROM (SELECT k, {ends} FROM ({up})) WHERE target IS NOT NULL")


_NODES_SQL = ("SELECT c_custkey AS node_id, CASE WHEN substr(md5(concat('lab:', c_name)), 1, 1) = '0' THEN '' "
              "ELSE concat('H', cast(c_custkey + 1 AS string)) END AS label, coalesce(f, 0e0) AS frequency "
              "FROM {c} LEFT JOIN (SELECT o_custkey, cast(count(*) AS double) AS f FROM {o} GROUP BY o_custkey) "
              "ON o_custkey = c_custkey")
_MEMBERS_SQL = ("SELECT o_custkey AS node_id, o_orderkey AS ord, concat('O', cast(o_orderkey AS string)) AS sample FROM {o}")
_ASSIGN_SQL = ("SELECT concat('O', cast(o_orderkey AS string)) AS sample, concat('H', cast(o_custkey + "
               "CASE WHEN substr(md5(concat('hap:', cast(o_orderkey AS string))), 1, 2) < '10' THEN 2 ELSE 1 END AS string)) AS haplotype "
               "FROM {o} WHERE substr(md5(concat('hap:', cast(o_orderkey AS string))), 1, 2) <> 'ff'")
# status and priority are categories (some blank), price is numeric (some not a number)
_TRAITS_SQL = ("SELECT concat('O', cast(o_orderkey AS string)) AS sample, 'status' AS trait, 'discrete' AS kind, "
               "CASE WHEN substr(md5(concat('s:', cast(o_orderkey AS string))), 1, 1) = '0' THEN ' ' ELSE o_orderstatus END AS value FROM {o} "
               "UNION ALL SELECT concat('O', cast(o_orderkey AS string)), 'priority', 'discrete', o_orderpriority FROM {o} "
               "UNION ALL SELECT concat('O', cast(o_orderkey AS string)), 'thousands', 'continuous', "
               "CASE WHEN substr(md5(concat('t:', cast(o_orderkey AS string))), 1, 1) = '0' THEN 'n/a' "
               "ELSE cast(cast(floor(o_totalprice / 1000e0) AS bigint) AS string) END FROM {o}")

NETWORK_CTE = (
    f"nodes AS MATERIALIZED ({_NODES_SQL.format(c='customer', o='orders')}), "
    f"edges AS MATERIALIZED ({_edges_sql('duckdb')}), "
    "arcs AS MATERIALIZED (SELECT edge_index, source AS u, target AS v, distance AS w FROM edges "
    "UNION ALL SELECT edge_index, target, source, distance FROM edges)")
MEMBERS_CTE = (
    f"members AS MATERIALIZED ({_MEMBERS_SQL.format(o='orders')}), "
    f"assignments AS MATERIALIZED ({_ASSIGN_SQL.format(o='orders')}), "
    f"traits AS MATERIALIZED ({_TRAITS_SQL.format(o='orders')})")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NODES_SQL.format(c="{c}", o="{o}"), c=table(spark, sf_dir, "customer"),
                     o=table(spark, sf_dir, "orders"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_edges_sql("spark", "{customer}"), customer=table(spark, sf_dir, "customer"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MEMBERS_SQL.format(o="{o}"), o=table(spark, sf_dir, "orders"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ASSIGN_SQL.format(o="{o}"), o=table(spark, sf_dir, "orders"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TRAITS_SQL.format(o="{o}"), o=table(spark, sf_dir, "orders"))
