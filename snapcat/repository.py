"""The five commands over a repository folder: scan, pack, verify, restore, upload.

The folder holds snapshots/<label>.jsonl, packs/pack-NNNNNN.tar.zst with a .json manifest each, objects/objects.jsonl
and checksums/SHA256SUMS. Plans are DataFrames; only file operations whose order matters run on the driver. Trees and
repositories are local or mounted folders that driver and executors share.
"""

from __future__ import annotations

import grp
import hashlib
import logging
import os
import pwd
import shutil
import time
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scalars as s
from .functions.entropy import byte_entropy
from .operators import catalog as ops
from .operators import integrity, recovery
from .operators.numbering import ensure_checkpoint_dir, number_rows
from .plans import binning
from .plans import restore as restoring
from .schema import DEFAULT_TARGET, ENTROPY_BITS, ENTROPY_SAMPLE, ENTRY
from .sources import catalog
from .sources.files import repair_tail, replace_file
from .sources.packs import PackSource, iter_members
from .sources.tree import TreeSource, digest_file

log = logging.getLogger("snapcat")


class Fatal(RuntimeError):
    """The command cannot go on; nothing more is written."""


@dataclass
class Result:
    """What a command did: counts or names, and its warnings."""

    value: object
    warnings: list[str]


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(PackSource)
    ensure_checkpoint_dir(spark)


def default_label(at: float | None = None) -> str:
    """UTC time as a label."""
    return time.strftime("%Y-%m-%dT%H-%M-%S", time.gmtime(at))


def _index_path(repo: str) -> str:
    return os.path.join(repo, "objects", "objects.jsonl")


def scan_entries(spark: SparkSession, root: str, repo: str | None = None, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries in walk order, warnings) of a tree; the repository folder itself is left out."""
    _register(spark)
    reader = spark.read.format("snapcat_tree").option("root", root).option("hash", str(hashed).lower())
    rows = (reader.option("exclude", repo) if repo else reader).load().checkpoint()
    key = s.walk_key(F.col("path_bytes").cast("string"))
    entries = number_rows(rows.filter("warning is null").withColumn("path", F.col("path_bytes").cast("string")), [key])
    return entries, rows.filter("warning is not null").select("path_bytes", "warning", "severity")


def resolve_scan(entries: DataFrame, index: DataFrame, start: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries with object_id, objects): known objects by path, size and time, then by digest; new ids from `start`.

    An inode is looked up by its first name only.
    """
    first = ops.inodes(entries.filter("type = 'file'")).drop("object_id")
    fast = ops.fast_dedup(first, index)
    found = fast.filter("object_id is not null")
    missed = fast.filter("object_id is null")
    if hashed:
        missed = ops.hash_dedup(missed, index)
        found, missed = found.unionByName(missed.filter("object_id is not null")), missed.filter("object_id is null")
    objects = found.unionByName(ops.assign_ids(missed, start)).select("dev", "ino", "object_id")
    known = found.select("dev", "ino", F.lit(True).alias("known"))
    return entries.drop("object_id").join(objects, ["dev", "ino"], "left"), objects.join(known, ["dev", "ino"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def scan(spark: SparkSession, root: str, repo: str, label: str | None = None, hashed: bool = False) -> Result:
    """Write a snapshot of a tree; value: label, entries, inodes known and new."""
    if not os.path.isdir(root):
        raise Fatal(f"{root} is not a directory")
    label = label or default_label()
    os.makedirs(os.path.join(repo, "snapshots"), exist_ok=True)
    entries, warnings = scan_entries(spark, root, repo, hashed)
    index = catalog.read_index(spark, _index_path(repo))
    # ids start behind the index and behind every snapshot, so unpacked scans never share one
    earlier = [catalog.read_snapshot(spark, os.path.join(repo, "snapshots", n))[1] for n in catalog.list_names(os.path.join(repo, "snapshots"), ".jsonl")]
    resolved, objects = resolve_scan(entries, index, ops.next_id_of(index, *[e.filter("object_id is not null") for e in earlier]), hashed)
    resolved = resolved.withColumn("object_id", F.when(F.col("type") == "file", F.col("object_id")))
    resolved = resolved.withColumn("target", F.col("target_bytes").cast("string"))
    names = [f.name for f in ENTRY.fields]
    resolved = resolved.select(*[F.col(n) for n in names]).checkpoint()
    n = catalog.write_snapshot(resolved, os.path.join(repo, "snapshots", f"{label}.jsonl"), os.path.abspath(root), int(time.time()))
    log.info("scanned %s: %d entries", root, n)
    known, new = objects.agg(F.count_if("known"), F.count_if(~F.col("known"))).first()
    said = [f"{bytes(w['path_bytes']).decode(errors='replace')}: {w['warning']}" for w in warnings.filter("severity > 0").toLocalIterator()]
    return Result({"label": label, "entries": n, "known": known, "new": new}, said)


def latest_label(repo: str) -> str:
    """The snapshot whose file name is the largest by bytes."""
    names = catalog.list_names(os.path.join(repo, "snapshots"), ".jsonl")
    if not names:
        raise Fatal("there is no snapshot")
    return max(names, key=os.fsencode)[: -len(".jsonl")]


def _snapshot(spark: SparkSession, repo: str, label: str | None) -> tuple[dict, DataFrame]:
    try:
        header, rows = catalog.read_snapshot(spark, os.path.join(repo, "snapshots", f"{label or latest_label(repo)}.jsonl"))
    except (FileNotFoundError, catalog.CatalogError) as e:
        raise Fatal(str(e)) from e
    return header, rows


def recover(spark: SparkSession, repo: str) -> list[str]:
    """Repair what a crash left: the torn index tail, unfinished and unindexed packs, stale checksum lines."""
    done = []
    if cut := repair_tail(_index_path(repo)):
        done.append(f"cut {cut} bytes of the index")
    packs = os.path.join(repo, "packs")
    names = catalog.list_names(packs)
    index = catalog.read_index(spark, _index_path(repo))
    found = spark.createDataFrame([(n,) for n in names], "name string")
    for row in recovery.recovery_plan(found, index).orderBy("name").collect():
        os.remove(os.path.join(packs, row["name"]))
        done.append(f"removed {row['name']}: {row['reason']}")
    path = os.path.join(repo, "checksums", "SHA256SUMS")
    if os.path.exists(path):
        repair_tail(path)
        sums = catalog.read_checksums(spark, path)
        disk = spark.createDataFrame([(f"packs/{n}",) for n in catalog.list_names(packs)], "relpath string")
        kept, dropped = recovery.prune_summary(sums, disk).first()
        if dropped:
            lines = [r["value"] for r in catalog.checksum_lines(recovery.prune_checksums(sums, disk)).orderBy(F.substring("value", 67, 1000)).collect()]
            replace_file(path, "".join(x + "\n" for x in lines).encode())
            done.append(f"dropped {dropped} checksum lines, kept {kept}")
    return done


def _owners(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(uid, uname) and (gid, gname) of this machine."""
    users = {u.pw_uid: u.pw_name for u in reversed(pwd.getpwall())}
    groups = {g.gr_gid: g.gr_name for g in reversed(grp.getgrall())}
    return spark.createDataFrame(list(users.items()), "uid long, uname string"), spark.createDataFrame(list(groups.items()), "gid long, gname string")


def _sampled(root: str):
    def classify(paths: pd.Series) -> pd.Series:
        def one(p: bytes) -> float:
            try:
                with open(os.path.join(os.fsencode(root), p), "rb") as f:
                    head = f.read(ENTROPY_SAMPLE)
            except OSError:
                return 0.0
            return byte_entropy(head) if len(head) == ENTROPY_SAMPLE else 0.0

        return pd.Series([one(p) for p in paths], dtype="float64")

    return classify


def pack_plan(spark: SparkSession, objects: DataFrame, root: str, target: int, algorithm: str, first_pack: int) -> DataFrame:
    """Objects with their class and pack. Only bodies as long as the sample are read, and only that far."""
    bits = F.pandas_udf(_sampled(root), T.DoubleType())
    large = objects.filter(F.col("size") >= ENTROPY_SAMPLE).select("object_id", bits("path_bytes").alias("bits"))
    items = objects.join(large, "object_id", "left").withColumn("bits", F.coalesce("bits", F.lit(0.0)))
    items = items.withColumn("cost", s.entry_cost(F.col("size"))).withColumn("cls", F.when(F.col("bits") >= ENTROPY_BITS, "store").otherwise("normal"))
    binned = binning.bins_by_class(items.checkpoint(), target, algorithm)
    return binned.withColumn("pack", s.pack_name(F.col("bin") + first_pack))


def pack(spark: SparkSession, repo: str, label: str | None = None, target: int = DEFAULT_TARGET, algorithm: str = "next-fit", first_pack: int = 1) -> Result:
    """Pack the objects of a snapshot that the index does not hold; value: names of the packs written, numbered from the next free number, `first_pack` at least."""
    if target < 1:
        raise Fatal("the target size must be positive")
    _register(spark)
    header, snapshot = _snapshot(spark, repo, label)
    if not header["root"]:
        raise Fatal("the snapshot names no root")
    os.makedirs(os.path.join(repo, "packs"), exist_ok=True)
    warnings = recover(spark, repo)
    index = catalog.read_index(spark, _index_path(repo))
    objects = ops.new_objects(ops.unique_objects(snapshot), index).checkpoint()
    if objects.isEmpty():
        return Result([], warnings)
    numbers = spark.createDataFrame([(n,) for n in catalog.list_names(os.path.join(repo, "packs"))], "name string")
    planned = pack_plan(spark, objects, header["root"], target, algorithm, max(first_pack, recovery.next_pack(numbers).first()[0])).checkpoint()
    names = [r["pack"] for r in planned.select("pack").distinct().orderBy("pack").collect()]
    times = [f"{t}_{u}" for t in ("mtime", "atime", "ctime", "btime") for u in ("sec", "nsec")]
    named = ops.with_owner_names(planned, *_owners(spark))
    rows = named.select("pack", "seq", "object_id", "path_bytes", "size", "mode", "uid", "gid", "uname", "gname", *times, "cls")
    rows = rows.repartition(len(names), "pack").sortWithinPartitions("pack", "seq")
    try:
        rows.write.format("snapcat_packs").mode("append").option("repo", repo).option("root", header["root"]).save()
    except Exception as e:
        raise Fatal(f"packing failed: {str(e)[:500]}") from e
    for name in names:
        log.info("packed %s", name)
    sizes = catalog.read_index(spark, _index_path(repo)).filter(F.col("pack").isin(names)).select("object_id", F.col("size").alias("packed"))
    for r in planned.join(sizes, "object_id").filter("packed <> size").select("path").toLocalIterator():
        warnings.append(f"{r['path']}: changed since the scan")
    return Result(names, warnings)


def _digests(spark: SparkSession, repo: str, relpaths: list[str]) -> DataFrame:
    """(relpath, sha256) of files; those missing or unreadable are left out. Files are hashed by the executors."""
    paths = spark.createDataFrame([(p,) for p in relpaths], "relpath string").repartition(max(1, len(relpaths)))

    def digest(batches):
        for b in batches:
            out = []
            for p in b["relpath"]:
                try:
                    out.append((p, digest_file(os.path.join(repo, p))))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["relpath", "sha256"])

    return paths.mapInPandas(digest, "relpath string, sha256 string")


def verify_findings(spark: SparkSession, repo: str, deep: bool = False) -> DataFrame:
    """(subject, status) of all checks; see operators.integrity."""
    _register(spark)
    sums = catalog.read_checksums(spark, os.path.join(repo, "checksums", "SHA256SUMS"))
    names = catalog.list_names(os.path.join(repo, "packs"))
    listed = [r["relpath"] for r in sums.select("relpath").distinct().toLocalIterator()]
    found = integrity.verify_checksums(sums, _digests(spark, repo, listed)).toDF("subject", "status")
    here = [f"packs/{n}" for n in names if n.endswith((".tar.zst", ".json"))]
    found = found.union(integrity.verify_untracked(spark.createDataFrame([(p,) for p in here], "relpath string"), sums))
    packs = spark.createDataFrame([(n.removesuffix(".tar.zst"),) for n in names if n.endswith(".tar.zst")], "pack string")
    index = catalog.read_index(spark, _index_path(repo))
    found = found.union(integrity.verify_dangling(index, packs).select(F.concat_ws("/", "pack", "object_id"), "status"))
    if deep:
        members = spark.read.format("snapcat_packs").option("dir", os.path.join(repo, "packs")).load().checkpoint()
        broken = members.filter("path_bytes is null").select("pack", F.col("error").alias("status"))
        members = members.filter("path_bytes is not null").withColumn("path", F.hex("path_bytes"))
        manifest = catalog.read_manifests(spark, os.path.join(repo, "packs", "*.json")) if any(n.endswith(".json") for n in names) else None
        if manifest is None:
            return found.union(packs.select("pack", F.lit("unreadable manifest")))
        manifest = manifest.withColumn("path", F.hex("path_bytes"))
        checked = integrity.verify_objects(members, manifest).join(broken.select("pack").distinct(), "pack", "left_anti")
        found = found.union(checked.select(F.concat("pack", F.lit("/"), F.unhex("path").cast("string")), "status")).union(broken.toDF("subject", "status"))
    return found


def verify(spark: SparkSession, repo: str, deep: bool = False) -> Result:
    """value: whether nothing was found wrong; warnings: the findings that are not OK."""
    bad = verify_findings(spark, repo, deep).filter(F.col("status") != integrity.OK)
    said = [f"{r['subject']}: {r['status']}" for r in bad.orderBy("subject", "status").toLocalIterator()]
    return Result(not said, said)


def _extract(repo: str, dest: str):
    """A function over batches of (pack, path, member_path): writes the bodies, returns (pack, member_path, size, sha256)."""

    def run(batches):
        rows = [r for b in batches for r in b.itertuples(index=False)]
        by_pack: dict[str, dict[bytes, list[str]]] = {}
        for r in rows:
            by_pack.setdefault(r.pack, {}).setdefault(r.member_path.encode("latin-1"), []).append(r.path)
        out = []
        for name, wanted in by_pack.items():
            left = sum(map(len, wanted.values()))
            for member, _, _, chunks in iter_members(os.path.join(repo, "packs", f"{name}.tar.zst")):
                if todo := wanted.get(member):
                    digest, size = hashlib.sha256(), 0
                    with open(os.path.join(os.fsencode(dest), todo.pop(0).encode("latin-1")), "wb") as f:
                        for c in chunks:
                            f.write(c)
                            digest.update(c)
                            size += len(c)
                    out.append((name, member.decode("latin-1"), size, digest.hexdigest()))
                    left -= 1
                if not left:
                    break  # nothing more is needed from this pack
        yield pd.DataFrame(out, columns=["pack", "member_path", "size", "sha256"])

    return run


def _finish_body(path: bytes, row, dest: str) -> str | None:
    """Empty files need no body; any other that is not there was not in its pack."""
    if not os.path.lexists(path):
        if not row["empty"]:
            return f"{row['path']}: not found in its pack"
        open(path, "wb").close()
    return None


def _below(dest: str, path: str) -> bytes:
    return os.path.join(os.fsencode(dest), path.encode("latin-1"))


def _copy_body(path: bytes, row, dest: str) -> None:
    shutil.copyfile(_below(dest, row["target"]), path)


def _link(path: bytes, row, dest: str) -> None:
    if os.path.lexists(path):
        os.remove(path)
    os.link(_below(dest, row["target"]), path)


def _symlink(path: bytes, row, dest: str) -> None:
    if os.path.lexists(path):
        os.remove(path)
    os.symlink(row["target"].encode("latin-1"), path)


def _set_metadata(path: bytes, row, dest: str) -> None:
    if not os.path.lexists(path):
        return
    if os.geteuid() == 0:
        os.chown(path, int(row["uid"]), int(row["gid"]))
    os.chmod(path, int(row["mode"], 8))
    mtime = int(row["mtime_sec"]) * 10**9 + int(row["mtime_nsec"])
    atime = mtime if row["atime_sec"] is None else int(row["atime_sec"]) * 10**9 + int(row["atime_nsec"] or 0)
    os.utime(path, ns=(atime, mtime))


def _each(step, dest: str):
    """A function over batches that does one step for every row and returns the warnings. A step done twice does no harm."""

    def run(batches):
        for b in batches:
            rows = b.astype(object).where(b.notna(), None).to_dict("records")
            said = [step(_below(dest, r["path"]), r, dest) for r in rows]
            yield pd.DataFrame({"warning": [x for x in said if x]}, dtype="object")

    return run


def restore(spark: SparkSession, repo: str, dest: str, label: str | None = None, parity: bool = False) -> Result:
    """Rebuild a snapshot's tree; checks all paths and objects before it writes anything. value: files restored."""
    _register(spark)
    _, snapshot = _snapshot(spark, repo, label)
    # paths as one character per byte: they reach Python unharmed and keep their order
    plain = lambda c: F.decode(c, "ISO-8859-1")
    snapshot = snapshot.withColumn("path", plain("path_bytes")).withColumn("target", plain("target_bytes")).checkpoint()
    index = catalog.read_index(spark, _index_path(repo)).withColumn("path", plain("path_bytes")).checkpoint()
    unsafe, missing = restoring.preflight(snapshot, index).first()
    if unsafe or missing:
        raise Fatal(f"{unsafe} unsafe paths, {missing} objects missing from the index")
    plan = restoring.restore_plan(snapshot, index, parity).checkpoint()
    full = lambda p: _below(dest, p)
    ordered = lambda phase: plan.filter(F.col("phase") == phase).orderBy("ord").toLocalIterator()
    os.makedirs(dest, exist_ok=True)
    for r in ordered(restoring.MAKE_DIR):
        os.makedirs(full(r["path"]), mode=0o700, exist_ok=True)
    work = restoring.restore_work(plan).select("pack", "path", "member_path")
    written = work.mapInPandas(_extract(repo, dest), "pack string, member_path string, size long, sha256 string").checkpoint()
    packed = index.select("pack", F.col("path").alias("member_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    differs = (F.col("size") != F.col("_size")) | ((F.col("_sha") != "") & (F.col("sha256") != F.col("_sha")))
    wrong = written.join(packed, ["pack", "member_path"]).filter(differs)
    warnings, n = [f"{r['member_path']}: size or digest differs from the index" for r in wrong.toLocalIterator()], 0
    empty = snapshot.filter("type = 'file' and size = 0").select("path", F.lit(True).alias("empty"))
    bodies = plan.filter("action = 'extract'").select("path").join(empty, "path", "left")
    n += bodies.count() + plan.filter("action = 'copy'").count()
    # a phase is done by the executors, path by path, before the next begins
    meta = snapshot.select("path", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "atime_sec", "atime_nsec")
    with_meta = lambda phase: plan.filter(F.col("phase") == phase).select("path", "ord").join(meta, "path")
    steps = [
        (_finish_body, bodies.select("path", F.coalesce("empty", F.lit(False)).alias("empty"))),
        (_copy_body, plan.filter("action = 'copy'").select("path", "target")),
        (_link, plan.filter(F.col("phase") == restoring.LINK).select("path", "target")),
        (_symlink, plan.filter(F.col("phase") == restoring.SYMLINK).select("path", "target")),
        (_set_metadata, with_meta(restoring.FILE_META).drop("ord")),
    ]
    for step, rows in steps:
        warnings += [r["warning"] for r in rows.mapInPandas(_each(step, dest), "warning string").collect()]
    for r in bodies.select("path").toLocalIterator() if log.isEnabledFor(logging.INFO) else ():
        log.info("restored %s", r["path"])
    # directories in order: what lies in one comes before it
    for r in with_meta(restoring.DIR_META).orderBy("ord").toLocalIterator():
        _set_metadata(full(r["path"]), r, dest)
    return Result(n, warnings)
