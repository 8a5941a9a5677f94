"""URL filter: host rules, then a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.storage import cut

# Bits per block are those of one long; the filter has at most this many blocks, whatever the list.
BLOCKS = 1 << 14
PROBES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``where`` is a host, a slash and the start of a path."""
    where: str
    verdict: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def host_of(url: Column) -> Column:
    """Lower-cased host; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and ``m.``, path without ``.html`` and a slash at the end."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as a struct, or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.where), r.where)):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = F.when(own & F.startswith(path, F.lit(rule.path)),
                      F.struct(F.lit(rule.where).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fits)
    return fits


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key and its bits there: one bit for each probe, six hash bits apiece."""
    place, bits = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    mask = F.lit(0).cast("bigint")
    for k in range(PROBES):
        bit = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(place, F.lit(blocks)), mask


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Blocked filter of column ``url``: at most ``blocks`` rows of (block, bits)."""
    block, mask = _block_and_mask(F.col("url"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, blocks: int = BLOCKS,
          listed_verdict: str = "block", other: str = "allow") -> DataFrame:
    """``pages`` keys (page_id, url) with host, path, rule and verdict.

    A rule that fits decides. For the rest, a page whose canonical URL is in ``listed`` (column
    url) gets ``listed_verdict``. The filter is broadcast: it never has more than ``blocks``
    rows, however long the list; a longer list only lets more URLs through to the join, which is
    exact. Pages that the filter rejects skip the join and its shuffle. Null or malformed URLs
    have empty host and path, fit no rule and are never listed; repeated rows are judged alike;
    empty pages or an empty list give no row or no hit.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    read = read.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "key", F.when((F.col("host") != "") & F.col("fit").isNull(), canonical(F.col("host"), F.col("path"))))
    known = cut(listed.select("url").filter(F.col("url").isNotNull()).distinct(), "listed-urls")
    block, mask = _block_and_mask(F.col("key"), blocks)
    probed = (read.withColumn("block", F.when(F.col("key").isNotNull(), block)).withColumn("mask", mask)
              .join(F.broadcast(bloom(known, blocks)), "block", "left"))
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    hits = (probed.filter(maybe)
            .join(known.select(F.col("url").alias("key"), F.lit(True).alias("exact")).hint("shuffle_hash"),
                  "key", "left"))
    misses = probed.filter(~maybe).withColumn("exact", F.lit(None).cast("boolean"))
    out = hits.select(*misses.columns).unionAll(misses)
    own = F.when(F.col("exact"), listed_verdict).otherwise(other)
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"),
                      F.coalesce("fit.verdict", own).alias("verdict"))


def reported(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages on ``spam`` hosts and of pages that came in through a feed link."""
    host = host_of(F.col("url"))
    found = pages.filter(F.startswith(host, F.lit("spam")) | F.contains("url", F.lit("utm_source=feed")))
    return found.select(canonical(host, path_of(F.col("url"))).alias("url"))
