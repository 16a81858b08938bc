"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles (64-bit hashes). All sets are read in one order: shingles seen
often come last, the rest by hash. Two sets whose Jaccard similarity reaches the threshold share at least `l` of the
first |x| - ceil(threshold |x|) + l shingles of each, for every l. The prefix of l = 1 is the usual one; where it
holds frequent shingles, a longer prefix is chosen that demands l shared shingles, by the least estimated cost:
entries in the prefix with their frequencies, plus a comparison for every candidate, of which there are at most the
sum of frequencies over l. A pair is a candidate if it shares min(l of one, l of the other) prefix shingles, and as
many as the rest of the sets cannot make up for.

Equal sets are one node. Nodes first meet one node of each shingle's list only; verified links give
components, and then every pair that shares enough prefix shingles and still lies in two components is verified too.
So components are exact, while a group of thousands of near copies costs a few comparisons for each member.

The result rests on 64-bit hashes of shingles and of whole sets being free of collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .components import checkpoint_dir, connected_components, release
from .keyfilter import key_filter

#: shingles held by a task before it passes them on
FLUSH = 2_000_000
#: prefix entries in a bucket
BUCKET = 400_000
#: the list of frequent shingles has at most so many rows, and none seen less often than LEAST_FREQUENT times
MOST_FREQUENT, LEAST_FREQUENT = 1 << 22, 32
LEVELS = (1, 2, 3, 4, 6, 8)


def set_key(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def choose_prefix(n: int, frequency: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, prefix length) for a set of n shingles, given the frequencies of its first ones in the common order."""
    most = -(-percent * n // 100)
    if not frequency[: n - most + 1].any():
        return 1, n - most + 1
    cost = np.cumsum(np.maximum(frequency, 1))
    best = (np.inf, 1)
    for level in LEVELS:
        if level <= most:
            total = float(cost[n - most + level - 1])
            best = min(best, (total * (1 + n / 32 / level), level))
    return best[1], n - most + best[1]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for lo, hi, data, offsets in tx.blocks(column):
            yield batch.slice(lo, hi - lo), tx.shingle_sets(data, offsets, width)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (kind 0: id, n, key) of all documents, and rows (kind 1: key = shingle, n = count) seen twice in a task."""
    kind = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch | None:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            if not len(values):
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(values), np.int32)), pa.nulls(len(values), id_type), pa.array(counts.astype(np.int64)), pa.array(values.view(np.int64))], ["kind", "id", "n", "key"]
            )

        id_type = pa.int64()
        for batch, sets in _sets(batches, width):
            id_type = batch.column(0).type
            keys = [set_key(h) if len(h) else None for h in sets]
            for h, k in zip(sets, keys, strict=True):
                if k is not None and k not in seen:
                    seen.add(k)
                    held.append(h)
                    size += len(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.int64())], ["kind", "id", "n", "key"]
            )
            if size >= FLUSH:
                if (out := often()) is not None:
                    yield out
                held, size = [], 0
        if held and (out := often()) is not None:
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, kind)


class Frequent:
    """The bounded list of frequent shingles."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


_ENTRY = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("hot", pa.bool_())])


def prefix_entries(docs: DataFrame, text_col: str, width: int, percent: int, frequent, buckets: int) -> DataFrame:
    """Entries (token, key, n, level, hot) of all prefixes whose shingle stands in another prefix of a set of fitting size.

    Entries travel as packed arrays, a row for each task and bucket. Frequent shingles are known to recur: their
    entries are dealt by document, so that no bucket gathers one.
    """
    packed = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("key", pa.binary()), ("n", pa.binary()), ("level", pa.binary()), ("sure", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: Frequent = frequent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, int, int, int]] = []
        size = 0

        def deal() -> pa.RecordBatch:
            sizes = [len(x[0]) for x in held]
            token, sure = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            key, n, level = (np.repeat(np.array([x[k] for x in held], t), sizes) for k, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
            bucket = (tx.mix64(np.where(sure, key.view(np.uint64), token)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            part = lambda x: [x[order[edges[b] : edges[b + 1]]].tobytes() for b in rows]
            return _rows(packed, bucket=rows, token=part(token), key=part(key), n=part(n), level=part(level), sure=part(sure))

        for _, sets in _sets(batches, width):
            for h in sets:
                if not len(h) or (k := set_key(h)) in seen:
                    continue
                seen.add(k)
                f = often(h)
                if f.any():
                    order = np.lexsort((h, f))
                    h, f = h[order], f[order]
                level, p = choose_prefix(len(h), f, percent)
                held.append((h[:p], f[:p] > 0, k, len(h), level))
                size += p
            if size >= FLUSH // 2:
                yield deal()
                held, size = [], 0
        if held:
            yield deal()

    def join(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        token, key, n, level, sure = get("token", np.int64), get("key", np.int64), get("n", np.int32), get("level", np.int32), get("sure", bool)
        order = np.lexsort((key, n, token))
        token, key, n, level, sure = (x[order] for x in (token, key, n, level, sure))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))
        token, key, n, level, sure = (x[new] for x in (token, key, n, level, sure))
        # by size, the next smaller or larger set of the list must be of a fitting size, or none is
        fits = np.zeros(len(token) + 1, bool)
        fits[1:-1] = (token[1:] == token[:-1]) & (n[:-1] * np.int64(100) >= n[1:] * np.int64(percent))
        kept = sure | fits[1:] | fits[:-1]
        return pa.Table.from_arrays([pa.array(x[kept], f.type) for x, f in zip((token, key, n, level, sure), _ENTRY, strict=True)], schema=_ENTRY)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(make, "bucket int, token binary, key binary, n binary, level binary, sure binary")
    return rows.groupBy("bucket").applyInArrow(join, "token long, key long, n int, level int, hot boolean")


def wanted_sets(docs: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, shingles packed) of the sets named in `wanted` (key); some others may be among them.

    A Bloom filter of bounded size, broadcast, saves shuffling the sets of most other documents.
    """
    shared = key_filter(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, seen = shared.value, set()
        for _, sets in _sets(batches, width):
            keys, values = [], []
            for h in sets:
                if not len(h) or (k := set_key(h)) in seen:
                    continue
                if k in filter_:
                    seen.add(k)
                    keys.append(k)
                    values.append(h.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["key", "shingles"])

    made = docs.select(F.col(text_col).alias("text")).mapInArrow(make, "key long, shingles binary")
    return made.groupBy("key").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, pairs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of set names, those with 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = wanted_sets(docs, wanted, text_col, width)
    both = pairs.join(sets.withColumnsRenamed({"key": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"key": "b", "shingles": "y"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                h = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                n = len(h)
                h.sort(kind="stable")
                shared = int((h[1:] == h[:-1]).sum())
                good.append(100 * shared >= percent * (n - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5
) -> DataFrame:
    """Return id, n_shingles, component_id (smallest id reachable by links, itself included), set_key (null: no words).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document with fewer than `width`
    words has its whole sequence as one shingle; null, empty and blank texts have none and link with nothing. Repeated
    rows and equal texts are linked. Null ids keep their rows and are nobody's component unless no other id is
    reached. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))
    made = document_sets(docs, id_col, text_col, width).checkpoint()
    rows = made.filter("kind = 0").select("id", "n", "key")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"))
    total = made.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    # counts add up to `total` at most, so at most MOST_FREQUENT shingles reach this threshold
    threshold = max(LEAST_FREQUENT, -(-total // MOST_FREQUENT))
    hot = made.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold).toPandas()
    frequent = spark.sparkContext.broadcast(Frequent(hot["key"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)))
    buckets = int(max(16, total * (100 - percent) // 100 // BUCKET))
    entries = prefix_entries(docs, text_col, width, percent, frequent, buckets)
    # m: prefix shingles of a set that stand in another prefix too; i: place among them, frequent ones last
    own = Window.partitionBy("key")
    entries = entries.withColumn("m", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("hot", "token")))
    # n (30 bits), m (28) and level (4) travel as one number: entries are what is shuffled most
    stat = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("m"), 4)).bitwiseOR(F.col("level").cast("long"))
    entries = entries.select("token", "key", "i", stat.alias("stat")).checkpoint()
    release(spark)
    n_of = lambda c: F.shiftrightunsigned(c, 32)
    m_of = lambda c: F.shiftrightunsigned(c, 4).bitwiseAND(F.lit((1 << 28) - 1))
    level_of = lambda c: F.col(c).bitwiseAND(F.lit(15))

    def need() -> Column:
        """Prefix shingles that sets a and b must share; what lies behind the prefixes adds at most the longer rest."""
        overlap = F.ceil((n_of("stat_a") + n_of("stat_b")) * percent / (100 + percent))
        rest = F.greatest(*[F.ceil(n_of(c) * percent / 100) - level_of(c) for c in ("stat_a", "stat_b")])
        return F.greatest(F.least(level_of("stat_a"), level_of("stat_b")), overlap - rest)

    n_both = n_of("stat_a"), n_of("stat_b")
    near = (F.least(*n_both) * 100 >= F.greatest(*n_both) * percent) & (F.least(m_of("stat_a"), m_of("stat_b")) >= need())

    def distinct(met: DataFrame) -> DataFrame:
        return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("stat_a").alias("stat_a"), F.max("stat_b").alias("stat_b"))

    # the set met first in a list is the one with the fewest shingles of its own: the likeliest to be the common source
    alone = (n_of("stat") - F.ceil(n_of("stat") * percent / 100) + level_of("stat") - m_of("stat")).alias("alone")
    heads = entries.groupBy("token").agg(F.min(F.struct(alone, "key", "stat")).alias("head"))
    star = entries.join(heads, "token").filter("key <> head.key")
    star = star.select(F.col("head.key").alias("a"), F.col("key").alias("b"), F.col("head.stat").alias("stat_a"), F.col("stat").alias("stat_b"))
    star = distinct(star.filter(near)).filter(F.col("shared") >= need()).select("a", "b").checkpoint()
    links = verified(docs, star, text_col, width, percent).checkpoint()
    release(spark)
    first = connected_components(links)
    # whatever shares enough prefix shingles and is not yet together
    placed = entries.join(first, entries["key"] == first["node"], "left").select("token", "key", "i", "stat", F.coalesce("component", "key").alias("comp"))
    split = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    placed = placed.join(split, "token").checkpoint()
    side = lambda x: placed.select("token", F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("stat", "i", "comp")])
    # sets that share k of their m shingles share one of the first m - k + 1 of each; what they share is counted then
    early = (F.col("i_a") <= m_of("stat_a") - need() + 1) & (F.col("i_b") <= m_of("stat_b") - need() + 1)
    cross = distinct(side("a").join(side("b"), "token").filter((F.col("comp_a") < F.col("comp_b")) & near & early))
    # a shingle that sets of two components share stands in a list that is split
    lists = placed.groupBy("key").agg(F.collect_list("token").alias("t"))
    for x in "ab":
        cross = cross.join(lists.withColumnsRenamed({"key": x, "t": "t_" + x}), x)
    cross = cross.filter(F.size(F.array_intersect("t_a", "t_b")) >= need()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cross.join(star, ["a", "b"], "left_anti").checkpoint()
    release(spark)
    more = verified(docs, cross, text_col, width, percent)
    linked = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    release(spark)
    named = classes.join(linked, classes["key"] == linked["node"], "left").select(F.col("key").alias("k"), "least", F.coalesce("component", "key").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "comp").select("k", "component_id")
    out = rows.join(named, rows["key"] == named["k"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("set_key"))


def one_per_group(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """Keep one row of each component and every row without words; columns as they are.

    The row with the smallest doc_id stays (null is larger than any), among equal ids the one with the smallest text
    hash, of repeated rows one. Ids need not be unique: a row is named by its id and the hash of its text. Texts are
    shuffled once: the window needs the partitioning that the join leaves.
    """
    names = docs.columns
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = jaccard_components(docs.select(own.alias("row"), "text"), "row", "text", percent, width)
    key = lambda c: [F.col(f"{c}.none").alias("_n"), F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("")).alias("_k"), F.col(f"{c}.hash").alias("_h")]
    kept = found.filter(F.col("component_id").eqNullSafe(F.col("row"))).select(*key("row"), F.col("set_key").isNull().alias("blank")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), own.alias("_own")).select("_row", *key("_own"))
    both = rows.join(kept, ["_n", "_k", "_h"])
    both = both.withColumn("_j", F.row_number().over(Window.partitionBy("_n", "_k", "_h").orderBy("blank")))
    return both.filter("_j = 1 or blank").select("_row.*")
