"""Secret scan that weighs candidates by how many owners and repositories hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.storage import cut

# (kind, pattern, least length, group whose length counts)
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KINDS = (
    ("assign", ASSIGN, 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
)
CANDIDATE = ("token", r"[A-Za-z0-9+/_-]{20,}", 20, 0)
SPREAD_OWNERS = 3
_OPEN, _SHUT = "\u0001", "\u0002"


def _matches(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Array of (start, end, rank, kind, value) of the leftmost non-overlapping matches.

    SQL has no function for positions of matches. Matches are put between two control
    characters; the lengths of the pieces then add up to the positions. Control characters of the
    text itself are replaced one for one before, which moves nothing and which no pattern matches.
    """
    marked = F.regexp_replace(text, f"(?s){pattern}", f"{_OPEN}$0{_SHUT}")
    pieces = F.split(marked, _OPEN)
    rank = [k for k, *_ in (*KINDS, CANDIDATE)].index(kind)

    def step(state: Column, piece: Column) -> Column:
        value = F.substring_index(piece, _SHUT, 1)
        size = F.length(value).cast("bigint")
        start = state["at"]
        counted = F.regexp_extract(value, pattern, group) if group else value
        found = F.struct(start.alias("start"), (start + size).alias("end"), F.lit(rank).alias("rank"),
                         F.lit(kind).alias("kind"), counted.alias("value"))
        return F.struct(
            (start + F.length(piece) - 1).cast("bigint").alias("at"),
            F.when(F.length(counted) >= least, F.concat(state["found"], F.array(found)))
            .otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,kind:string,value:string>>")
    first = F.struct(F.length(F.get(pieces, F.lit(0))).cast("bigint").alias("at"), none.alias("found"))
    spans = F.aggregate(F.slice(pieces, 2, F.size(pieces)), first, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its base spans and the method's own candidates.

    A candidate is a run of 20 or more key characters that mixes digits with letters and touches
    no base span. The table is written without the texts, so they are scanned once; ``row`` is
    fixed by the writing.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _OPEN + _SHUT, "\u0003\u0003")
    read = docs.select("doc_id", "source", "lang", text.alias("text"))
    base = F.flatten(F.array(*[_matches(F.col("text"), *k) for k in KINDS]))
    wide = _matches(F.col("text"), *CANDIDATE)
    found = read.select("doc_id", "source", "lang", base.alias("base"), wide.alias("wide"))
    apart = F.filter("wide", lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "lang", "base",
                            apart.alias("extra")), "secret-spans")


def ownership(found: DataFrame, owner: list[str] | None = None, repository: list[str] | None = None) -> DataFrame:
    """Per hashed value the distinct owners and repositories that hold it.

    Values are reduced to distinct (hash, owner, repository) rows inside tasks before anything is
    shuffled, so a value copied into a third of all rows sends one row per task and owner.
    """
    owner, repository = owner or ["source"], repository or ["source", "lang"]
    values = found.select(*dict.fromkeys([*owner, *repository]), F.explode(F.concat("base", "extra")).alias("s"))
    held = values.select(F.sha2(F.col("s.value"), 256).alias("secret"), F.struct(*owner).alias("owner"),
                         F.struct(*repository).alias("repository"))
    pairs = held.distinct()
    owners = pairs.select("secret", "owner").distinct().groupBy("secret").agg(F.count(F.lit(1)).alias("owners"))
    repositories = pairs.groupBy("secret").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "secret")


def scan(docs: DataFrame, spread: int = SPREAD_OWNERS) -> DataFrame:
    """Spans of every row of ``docs`` with their ownership verdicts.

    Columns: doc_id, ``base`` and ``added`` (arrays of spans), ``n_live`` and ``n_example``.
    A value held by ``spread`` or more owners is a widely copied example; a rarer one is
    owner-specific and counts as live. Base spans stay whatever the verdict; a candidate of the
    method becomes a span only if it is live. A null text is empty and has no span; null owners
    count as one owner; repeated rows each get their row; an empty table gives none; only doc_id,
    text, source and lang are read, so other columns cannot clash.
    """
    found = candidates(docs)
    held = found.select("row", F.explode(F.concat(
        F.transform("base", lambda s: F.struct(s.alias("span"), F.lit(False).alias("added"))),
        F.transform("extra", lambda s: F.struct(s.alias("span"), F.lit(True).alias("added"))))).alias("x"))
    judged = held.select("row", "x.span", "x.added", F.sha2(F.col("x.span.value"), 256).alias("secret")).join(
        ownership(found), "secret")
    live = F.col("owners") < spread
    verdicts = judged.groupBy("row").agg(
        F.collect_list(F.when(live & F.col("added"), F.col("span"))).alias("added"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))
    none = F.array().cast(found.schema["base"].dataType)
    return (found.join(verdicts, "row", "left")
            .select("doc_id", "base", F.coalesce("added", none).alias("added"),
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_example")]))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans of ``scan``."""
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    count = [of_kind(kind) for kind, *_ in KINDS]
    return scanned.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                          listed(F.concat("base", "added")).alias("spans"), "n_live", "n_example")
