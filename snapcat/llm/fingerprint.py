"""Threshold-scaled sketches in DataFrame functions only.

A fingerprint keeps every distinct hash of a text's 5-word shingles that falls below one fixed fraction (1 / SCALE) of
the hash range, whatever the text's length, and the text's smallest hash, so that no text with words has an empty one.
Both rules hold for any set of shingles, so the sketches of parts merge to the sketch of their union, and containment
is estimated without bias between texts of very unequal lengths: the share of the smaller sketch's hashes below the
bound that the other one has. Texts of a few shingles have few hashes or only the smallest one, so their estimates are
coarse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, WIDTH = 4, 5
#: hashes are signed 64-bit numbers; those below this bound are the lowest 1 / SCALE
BOUND = -(1 << 63) + (1 << 64) // SCALE
#: bounds of id ranges: at most FANOUT * FANOUT, taken from a sample of at most SAMPLED keys
FANOUT, SAMPLED = 64, 1 << 17


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(word_hashes: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of `width` words, given the words' hashes; of a shorter text its whole sequence, if any."""
    n = F.size(word_hashes)
    run = lambda k: F.slice(word_hashes, F.lit(k + 1), F.greatest(n - (width - 1), F.lit(0)))
    out = run(0)
    for k in range(1, width):
        out = F.zip_with(out, run(k), lambda a, b: F.xxhash64(a, b))
    short = F.when(n > 0, F.array(F.xxhash64(word_hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= width, out).otherwise(short)


def _kept(hashes: Column) -> Column:
    """Of distinct hashes those below the bound and the smallest one, sorted."""
    low = F.filter(hashes, lambda h: h < BOUND)
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()))


def sketch(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Add the sketch of a text column: its kept hashes, sorted. Null counts as empty; a text without words has none."""
    df = df.withColumn("_w", F.transform(words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", F.array_distinct(shingle_hashes(F.col("_w"))))
    return df.withColumn(out_col, _kept(F.col("_s"))).drop("_w", "_s")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other one has, 0 to 1.

    Hashes below the bound decide. If one of the sketches has none there, its smallest hash stands for it: 1 if both
    sketches have the same smallest hash, else 0. Two empty sketches are alike.
    """
    low = lambda s: F.filter(s, lambda h: h < BOUND)
    least = F.least(F.size(low(a)), F.size(low(b)))
    share = F.size(F.array_intersect(low(a), low(b))) / F.nullif(least, F.lit(0))
    return F.when(least > 0, share).when(F.array_min(a).eqNullSafe(F.array_min(b)), F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two texts' shingles (those across the seam of a concatenation are not in it)."""
    return _kept(F.array_union(a, b))


def sketch_text(s: Column) -> Column:
    """A sketch as a string: scale, colon, the hashes as 16 hex digits each."""
    return F.concat(F.lit(f"{SCALE}:"), F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _bounds(rows: DataFrame, ranges: int) -> Column:
    """Sorted keys (struct of _id, _h): `coarse` begin a group of ranges each, `fine` of each group its further ranges.

    The keys are quantiles of a sample: those with the smallest hashes, SAMPLED at most. Any keys give right results;
    these make the ranges alike in size whatever the ids are.
    """
    # nulls go first in structs, as the last in descending order
    key = F.struct("_id", "_h")
    sample = rows.select(key.alias("_k"), F.xxhash64(F.lit(17), "_id", "_h").alias("_x")).orderBy("_x", "_k").limit(min(SAMPLED, 64 * ranges))
    keys = sample.agg(F.sort_array(F.collect_list("_k")).alias("_ks"))
    fan = min(FANOUT, ranges)
    groups = -(-ranges // fan)
    at = lambda i, of: F.get("_ks", F.floor(i * F.size("_ks") / of).cast("int"))
    known = lambda c: F.filter(c, lambda k: k.isNotNull())
    coarse = known(F.transform(F.sequence(F.lit(1), F.lit(groups)), lambda g: F.when(g < groups, at(g * fan, groups * fan))))
    fine = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: known(F.transform(F.sequence(F.lit(1), F.lit(fan)), lambda f: F.when(f < fan, at(g * fan + f, groups * fan)))),
    )
    return keys.select(F.struct(coarse.alias("coarse"), fine.alias("fine"))).scalar()


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows (_id, _text, _h) with their range, `_range`."""
    if ranges == 1:
        return rows.withColumn("_range", F.lit(0).cast("long"))
    rows = rows.withColumn("_b", _bounds(rows, ranges))
    not_above = lambda keys: F.size(F.filter(keys, lambda k: k <= F.struct("_id", "_h")))
    rows = rows.withColumn("_c", not_above(F.col("_b.coarse"))).withColumn("_f", not_above(F.get("_b.fine", F.col("_c"))))
    return rows.select("_id", "_text", "_h", (F.col("_c") * min(FANOUT, ranges) + F.col("_f")).cast("long").alias("_range"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> DataFrame:
    """(_id, _text, _sketch, _next_text, _next_sketch): each text beside the next in descending order of id.

    After the last row comes the first. Rows with equal ids go by a hash of the text; null ids come last. Ids may be
    of any type that has an order, however they are spread. Texts are shuffled once: keys (id, hash) are cut into
    ranges at sampled quantiles, each range gets a copy of the row that follows it, and the order is taken within
    ranges only. Repeated rows (same id, same text) share a range. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))
    n = rows.count()
    # as many ranges as shuffle partitions, more where they would pass `most_rows` rows, fewer for small tables
    ranges = min(FANOUT * FANOUT, max(1, n // most_rows, min(n // 500, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    rows = _ranged(rows, ranges)
    tops = rows.groupBy("_range").agg(F.max(F.struct("_id", "_h")).alias("_top"))
    by_range = Window.orderBy("_range")  # one row per range
    heirs = tops.select(
        F.col("_top._id").alias("_tid"), F.col("_top._h").alias("_th"), F.coalesce(F.lead("_range").over(by_range), F.min("_range").over(Window.partitionBy())).alias("_to")
    )
    edges = rows.join(F.broadcast(heirs), F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_h") == F.col("_th")))
    edges = edges.select("_id", "_text", "_h", F.col("_to").alias("_range")).dropDuplicates(["_range"])
    both = rows.withColumn("_edge", F.lit(False)).union(edges.withColumn("_edge", F.lit(True))).repartition(ranges, "_range")
    both = sketch(both, "_text", "_sketch")
    order = Window.partitionBy("_range").orderBy(F.col("_edge"), F.col("_id").desc_nulls_last(), F.col("_h").desc())
    both = both.withColumn("_next_text", F.lead("_text").over(order)).withColumn("_next_sketch", F.lead("_sketch").over(order))
    return both.filter(~F.col("_edge")).select("_id", "_text", "_sketch", "_next_text", "_next_sketch")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; equal texts have equal fingerprints. Null and empty texts have an empty one."""
    return sketch(docs.select(id_col, text_col), text_col, "_f").select(id_col, sketch_text(F.col("_f")).alias("fingerprint"))
