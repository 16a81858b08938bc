"""Operators over snapshots and the object index: grouping, incremental deduplication, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .numbering import number_rows


def files(snapshot: DataFrame) -> DataFrame:
    """File rows that name an object."""
    return snapshot.filter((F.col("type") == "file") & F.col("object_id").isNotNull())


def walk_order(entries: DataFrame, path: str = "path", name: str = "seq", start: int = 0) -> DataFrame:
    """Number entries in depth-first order, siblings by bytes."""
    return number_rows(entries, [s.walk_key(F.col(path))], name, start)


def latest_snapshot(labels: DataFrame, label: str = "label") -> DataFrame:
    """The label whose file name `<label>.jsonl` is the largest by bytes; one row, null without labels."""
    return labels.filter(F.length(label) > 0).agg(F.max(F.concat(F.col(label), F.lit(".jsonl"))).alias("m")).select(F.expr("substring(m, 1, length(m) - 6)").alias("label"))


def first_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """For each key the row that comes first; a minimum per key with partial aggregation, not a sort."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in (order, *rest)])


def unique_objects(snapshot: DataFrame) -> DataFrame:
    """Each object of a snapshot once, with the metadata of the first row that names it."""
    return first_by(files(snapshot), ["object_id"])


def inodes(scanned: DataFrame) -> DataFrame:
    """Each (dev, ino) once, as its first name has it, with the number of names."""
    names = scanned.groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("n_names"))
    return first_by(scanned, ["dev", "ino"]).join(names, ["dev", "ino"])


def link_groups(snapshot: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Paths of each object in order of appearance, with the first row's metadata.

    With keys (object_id, dev, ino) only names of one inode are grouped, so copies are not turned into hard links.
    """
    rows, keys = files(snapshot), keys or ["object_id"]
    rest = [c for c in rows.columns if c not in (*keys, "seq", "path")]
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("_p"), F.min(F.struct("seq", *rest)).alias("_f"))
    return groups.select(*keys, F.col("_f.seq").alias("seq"), F.col("_p.path").alias("paths"), *[F.col(f"_f.{c}").alias(c) for c in rest])


def link_names(groups: DataFrame) -> DataFrame:
    """The further names of each group (object_id, position, path) with the name they are linked to."""
    rows = groups.select("object_id", F.posexplode("paths").alias("position", "path"), F.col("paths")[0].alias("target"))
    return rows.filter("position > 0")


def next_id(index: DataFrame) -> DataFrame:
    """The first free object number: one row."""
    return index.agg((F.coalesce(F.max(s.id_number(F.col("object_id"))), F.lit(0)) + 1).cast("long").alias("next_id"))


def next_id_of(*relations: DataFrame) -> int:
    """The first free object number over the index and all snapshots, so unpacked scans never share ids."""
    return max([1, *(next_id(r).first()[0] for r in relations)])


def lowest_id(index: DataFrame, keys: list[str]) -> DataFrame:
    """One index row per key: that with the lowest object number, so a lookup never multiplies rows."""
    rows = index.select(*keys, "object_id").withColumn("_n", s.id_number(F.col("object_id")))
    return rows.groupBy(*keys).agg(F.min(F.struct("_n", "object_id")).alias("_f")).select(*keys, F.col("_f.object_id").alias("object_id"))


FAST_KEYS = ["path", "size", "mtime_sec", "mtime_nsec"]


def fast_dedup(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """Add object_id of the index row with equal path, size and modification time, else null."""
    return scanned.drop("object_id").join(lowest_id(index, FAST_KEYS), FAST_KEYS, "left")


def hash_dedup(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """Add object_id of the index row with the same digest, else null; an empty or missing digest never matches."""
    known = lowest_id(index.filter("sha256 <> ''"), ["sha256"])
    probe = scanned.drop("object_id").withColumn("_key", F.when(F.col("sha256") != "", F.col("sha256")))
    return probe.join(known.withColumnRenamed("sha256", "_key"), "_key", "left").drop("_key")


def assign_ids(unmatched: DataFrame, start: int, order: str = "seq") -> DataFrame:
    """Give objects without an id consecutive ones from `start`, in order."""
    numbered = number_rows(unmatched.drop("object_id"), [order], "_n", start)
    return numbered.withColumn("object_id", s.object_id(F.col("_n"))).drop("_n")


def scan_summary(resolved: DataFrame) -> DataFrame:
    """Counts of known and new inodes: one row."""
    known = F.col("object_id").isNotNull()
    return resolved.agg(F.count_if(known).cast("long").alias("n_known"), F.count_if(~known).cast("long").alias("n_new"))


def new_objects(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Objects the index does not hold."""
    return objects.join(index.select("object_id").distinct(), "object_id", "left_anti")


def resolve_objects(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Objects with the pack, member path and digest the index has for them; null where it has none."""
    rows = index.select("object_id", "pack", F.col("path").alias("member_path"), F.col("size").alias("packed_size"), F.col("sha256").alias("packed_sha256"))
    by = Window.partitionBy("object_id").orderBy("pack", "member_path")
    rows = rows.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")
    return objects.join(rows, "object_id", "left")


def with_owner_names(entries: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Add uname and gname from (uid, uname) and (gid, gname); null for unknown ids."""
    return entries.join(users, "uid", "left").join(groups, "gid", "left")


def paths_unsafe(entries: DataFrame, path: str = "path") -> Column:
    """Number of paths that may not be restored."""
    return F.count_if(~s.safe_path(F.col(path))).cast("long")
