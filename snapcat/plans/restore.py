"""Restore plans: every action of a restore as a row, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.catalog import files, link_groups, resolve_objects

#: phases in the order they run
MAKE_DIR, EXTRACT, LINK, SYMLINK, FILE_META, DIR_META = range(1, 7)
_COLUMNS = ["phase", "ord", "action", "path", "target", "pack", "member_path"]


def preflight(snapshot: DataFrame, index: DataFrame) -> DataFrame:
    """(n_unsafe, n_missing): unsafe paths and objects the index lacks; a restore starts only if both are 0."""
    unsafe = snapshot.agg(F.count_if(~s.safe_path(F.col("path"))).cast("long").alias("n_unsafe"))
    missing = files(snapshot).select("object_id").distinct().join(index.select("object_id").distinct(), "object_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return unsafe.join(F.broadcast(missing), F.lit(True))


def _falling(path: Column) -> Column:
    """A key whose rising order is the falling byte order of paths: hex digits mirrored, longer ones before their prefixes."""
    return F.concat(F.translate(F.hex(F.encode(path, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def restore_plan(snapshot: DataFrame, index: DataFrame, parity: bool = False) -> DataFrame:
    """Rows (phase, ord, action, path, target, pack, member_path, ...) that rebuild a snapshot.

    Directories in walk order; one body per object, by pack and object id, so that a pack is read once; further names
    of an inode as links to its first; other files with the same object as copies (with parity they are links too);
    symbolic links; file metadata; directory metadata by falling path bytes, so that what lies in a directory comes before
    it. `ord` orders rows within a phase.
    """
    groups = link_groups(snapshot) if parity else link_groups(snapshot, ["object_id", "dev", "ino"])
    heads = groups.groupBy("object_id").agg(F.min("seq").alias("_head"), F.min(F.struct("seq", F.col("paths")[0].alias("path"))).alias("_first"))
    groups = resolve_objects(groups.join(heads, "object_id"), index)
    null = F.lit(None).cast("string")
    path = F.col("paths")[0]
    dirs = snapshot.filter("type = 'dir'")
    links = groups.select("object_id", "seq", F.posexplode("paths").alias("pos", "path"), path.alias("target")).filter("pos > 0")
    rows = [
        dirs.select(F.lit(MAKE_DIR), s.walk_key(F.col("path")), F.lit("mkdir"), "path", null, null, null),
        groups.filter("seq = _head").select(F.lit(EXTRACT), F.concat_ws("\0", "pack", "object_id"), F.when(F.col("pack").isNull(), "missing").otherwise("extract"), path, null, "pack", "member_path"),
        groups.filter("seq <> _head").select(F.lit(EXTRACT), F.concat_ws("\0", "pack", "object_id", F.lit("copy"), path), F.lit("copy"), path, F.col("_first.path"), "pack", "member_path"),
        links.select(F.lit(LINK), s.walk_key(F.col("path")), F.lit("link"), "path", "target", null, null),
        snapshot.filter("type = 'symlink'").select(F.lit(SYMLINK), s.walk_key(F.col("path")), F.lit("symlink"), "path", "target", null, null),
        groups.select(F.lit(FILE_META), s.walk_key(path), F.lit("file metadata"), path, null, null, null),
        dirs.select(F.lit(DIR_META), _falling(F.col("path")), F.lit("dir metadata"), "path", null, null, null),
    ]
    plan = rows[0].toDF(*_COLUMNS)
    for r in rows[1:]:
        plan = plan.union(r.toDF(*_COLUMNS))
    return plan


def restore_work(plan: DataFrame) -> DataFrame:
    """The extraction rows, a pack's together and in object order: one sequential pass per pack."""
    return plan.filter(F.col("action") == "extract").repartition("pack").sortWithinPartitions("pack", "ord")
