"""URL filters in DataFrame functions only: a blocked Bloom filter, then an exact hash join.

Listed keys are rules (host, path prefix, verdict) and whole canonical URLs. Every key a URL could match (the last labels
of its host, as many as some rule's host has, with each listed path length, and its own canonical form) is probed
against a Bloom filter whose bits for one key lie in one 64-bit block, so a probe reads one block. The few keys that pass are joined with the list
itself, which removes the false positives; the longest rule decides, then the listing, else the URL is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the filter: bits set for a key, and the largest number of 64-bit blocks (32 MB as rows)
BITS, MOST_BLOCKS = 4, 1 << 20

KEY_COLUMNS = ("key", "kind", "host", "path", "verdict")


def url_host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What stands after the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL: host without a leading `www.` and a port, path without trailing slashes."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":[0-9]*$", ""), F.regexp_replace(path, r"/+$", ""))


def rule_keys(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path prefix, verdict) as listed keys."""
    made = [F.struct(*[F.lit(x).alias(n) for n, x in zip(KEY_COLUMNS, (f"rule {h} {p}", "rule", h, p, v), strict=True)]) for h, p, v in rules]
    rows = spark.range(1).select(F.explode(F.array(*made)).alias("r")) if made else spark.range(0).select(F.struct(*[F.lit("").alias(n) for n in KEY_COLUMNS]).alias("r"))
    return rows.select("r.*")


def url_keys(listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Listed whole URLs, made canonical, as listed keys with verdict block."""
    url = F.col(url_col)
    form = canonical(url_host(url), url_path(url))
    return listed.select(F.concat(F.lit("url "), form).alias("key"), F.lit("url").alias("kind"), form.alias("host"), F.lit("").alias("path"), F.lit("block").alias("verdict")).distinct()


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)).cast("int")


def _mask(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, bits), one row for each block that has a bit set; at most `blocks` rows of 12 bytes."""
    h = _hash(F.col("key"))
    return keys.select(_block(h, blocks).alias("block"), _mask(h).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def _rule_probe(labels: int, n: int) -> Column:
    """Key of a rule for the last `labels` labels of the host and `n` characters of the path; null if the host has fewer."""
    has = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1 >= labels
    return F.when(has, F.concat(F.lit("rule "), F.substring_index("host", ".", -labels), F.lit(" "), F.substring("path", 1, n)))


def filter_urls(
    pages: DataFrame, keys: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None
) -> DataFrame:
    """Return id, host, path, rule (host + path prefix of the rule that decided, else null) and verdict of every row.

    keys: rule_keys() and url_keys() united. A rule fits its host and all subdomains if the path starts with its
    path; the longest host + path wins, at equal length the longer host, then the later in code
    point order. Without a rule the verdict is block for a listed canonical URL and allow for any other. Null URLs and those without `://` have an empty host and path and are
    allowed. Repeated and null ids keep a row each; other columns are ignored; empty tables give an empty one.

    The filter has a block for every 4 keys, at most MOST_BLOCKS, and is broadcast at that proven size; beyond that it
    lets more keys through to the join, and results stay exact. Probing is done on distinct (host, path), so a very
    common URL is probed once. A URL makes as many probes as there are pairs of a rule's label count and path length,
    and one more, however long its host and path are.
    """
    if blocks is None:
        blocks = min(MOST_BLOCKS, max(64, keys.count() // 4))
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    shapes = sorted((r[0], r[1]) for r in keys.filter("kind = 'rule'").select(labels, F.length("path")).distinct().collect())
    rows = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    forms = rows.select("host", "path").distinct().filter("host <> ''")
    own = F.concat(F.lit("url "), canonical(F.col("host"), F.col("path")))
    probes = forms.select("host", "path", F.explode(F.array_distinct(F.array_compact(F.array(own, *[_rule_probe(*x) for x in shapes])))).alias("key"))
    h = _hash(F.col("key"))
    probes = probes.select("*", _block(h, blocks).alias("block"), _mask(h).alias("mask"))
    passed = probes.join(F.broadcast(bloom_blocks(keys, blocks)), "block").filter(F.col("mask").bitwiseAND(F.col("bits")) == F.col("mask"))
    listed = keys.select("key", F.col("kind").alias("_kind"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    hits = passed.select("host", "path", "key").join(listed, "key")
    rank = F.struct((F.col("_kind") == "rule").alias("r"), F.length(F.concat("_host", "_path")).alias("n"), F.length("_host").alias("m"), F.col("_host").alias("h"), F.col("_path").alias("p"), F.col("_verdict").alias("v"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    out = rows.join(best, ["host", "path"], "left")
    rule = F.when(F.col("_best.r"), F.concat("_best.h", "_best.p"))
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce("_best.v", F.lit("allow")).alias("verdict"))
