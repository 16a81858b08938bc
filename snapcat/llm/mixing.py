"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size, so prefix sums of expected copies
are multiples of the document's rank. One random offset a source is added, and a document is emitted once for each
integer that its stretch of the prefix sum crosses. Ranking by size makes the sample follow the sizes, so the words
taken come near the target.

Ranks come from two levels: documents are counted by (source, size, slice of ids), the counts are summed up along each
source, and documents are ranked within their small group only. A source with a third of all rows is therefore never
sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpoint_dir

#: words are separated by these characters only
WORD = r"[^\x20\x09-\x0D]+"
#: groups of one source and size are cut into so many slices of ids
SLICES = 64


def word_count(text: Column) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of sources given as rows (source, source_size).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes; a target above
    `cap` times its source's size stops there and the excess is shared again by weight until none is above. That is
    one level L with target = min(weight * L, cap * size): it is found from running sums over the sources in order of
    size / weight. The windows without a partition run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    by = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("_all"),
        F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_left")
    rows = rows.select("*", F.when(level * F.col("_w") <= F.col("_cap"), level).alias("_level"))
    rows = rows.select("*", F.max("_level").over(everything).alias("_l"))
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_l") * F.col("_w"), F.col("_cap"))).alias("target"))


def source_offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): 32 bits of a digest of seed and name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def id_slice(doc_id: Column) -> Column:
    """Slice of an id, from 0 to SLICES - 1, by a digest."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("long") % SLICES


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cap: float = 3.0, seed: int = 42
) -> DataFrame:
    """Return per document: id, size, source_size, target, copies, taken (words taken, copies counted).

    Size is the number of words (null text: 0). Null is a source of its own, last in order. Rows that tie in
    size and id get the ranks of their group in any order among equal rows; repeated rows count each. Extra columns
    are ignored. A source without words has target 0 and its documents no copies; an empty table gives an empty one.
    Reruns agree, the offset being a digest of seed and source.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return mix_sizes(rows, cap, seed).withColumnRenamed("_id", id_col)


def mix_sizes(rows: DataFrame, cap: float = 3.0, seed: int = 42) -> DataFrame:
    """mix_sources() for rows (_id, source, size); texts are counted once, the small rows are checkpointed."""
    checkpoint_dir(rows.sparkSession)
    rows = rows.withColumn("_slice", id_slice(F.col("_id"))).checkpoint()
    groups = rows.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    targets = source_targets(sizes, cap)
    # prefix sums of the counts along a source: first over sizes, then over the slices of a size
    by_size = groups.groupBy("source", "size").agg(F.sum("_n").alias("_m"))
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("_before", F.coalesce(F.sum("_m").over(along), F.lit(0)))
    targets = targets.withColumnRenamed("source", "_s")
    by_size = by_size.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_m")
    inside = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    starts = groups.withColumnsRenamed({"source": "_s", "size": "_z", "_slice": "_k"}).join(
        by_size.withColumnsRenamed({"source": "_s2", "size": "_z2"}), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_z") == F.col("_z2"))
    )
    starts = starts.select("_s", "_z", "_k", (F.col("_before") + F.col("_inside")).alias("_start"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "_slice").orderBy("_id"))
    out = rows.withColumn("_rank", rank.cast("long")).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_slice") == F.col("_k"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("_start") + F.col("_rank")).cast("double")
    u = source_offset(F.col("source"), seed)
    copies = F.floor(place * rate + u) - F.floor((place - 1) * rate + u)
    out = out.withColumn("copies", F.least(copies, F.lit(int(cap)).cast("long")))
    return out.select("_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42, cap: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as in `docs` (text, source and doc_id needed).

    A document's copies are whole rows. Rows alike in doc_id, source and size (repeated rows) take the copies of their
    group in turn. The texts are shuffled once: the window needs the partitioning that the join leaves.
    """
    names = docs.columns
    key = lambda i, t, z: F.xxhash64(i, F.coalesce(t, F.lit("")), t.isNull(), z)
    size = word_count(F.col("text"))
    taken = mix_sizes(docs.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("source"), size.alias("size")), cap, seed)
    taken = taken.groupBy(key(F.col("_id"), F.col("source"), F.col("size")).alias("_key")).agg(F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_m"))
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    keyed = docs.select(row, key(F.col("doc_id"), F.col("source").cast("string"), size).alias("_key"))
    both = keyed.join(taken.filter("_total > 0"), "_key")
    place = Window.partitionBy("_key").orderBy(F.xxhash64("_row.text"))
    both = both.withColumn("_j", F.row_number().over(place).cast("long"))
    copies = (F.expr("_j * _total div _m") - F.expr("(_j - 1) * _total div _m")).cast("int")
    both = both.withColumn("_copies", copies).filter("_copies > 0")
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).select("_row.*")
