from pyspark.sql import functions as F

from snapcat.operators import catalog as ops
from snapcat.operators import integrity, recovery
from snapcat.operators.numbering import number_rows
from snapcat.plans import publish, restore

LINKS = [
    (0, "file", "first.txt", "O1", 100), (1, "file", "link_a", "O2", 200), (2, "dir", "sub", None, None), (3, "file", "sub/link_b", "O2", 201),
    (4, "file", "link_c", "O2", 202), (5, "symlink", "ptr", None, None), (6, "file", "last.txt", "O3", 0),
]


def snapshot(spark, rows=LINKS):
    return spark.createDataFrame(rows, "seq long, type string, path string, object_id string, size long").withColumn("dev", F.lit(1)).withColumn("ino", F.coalesce(F.expr("cast(substring(object_id, 2) as int)"), F.lit(0)))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "v int").repartition(5)
    assert [(r.v, r.n) for r in number_rows(df, ["v"], "n", 3).orderBy("v").collect()] == [(i, i + 3) for i in range(100)]
    assert number_rows(df.filter("v < 0"), ["v"], "n").count() == 0


def test_first_seen_and_links(spark):
    s = snapshot(spark)
    assert rows(ops.unique_objects(s), "object_id", "path", "size") == [("O1", "first.txt", 100), ("O2", "link_a", 200), ("O3", "last.txt", 0)]
    groups = {r.object_id: r.paths for r in ops.link_groups(s).collect()}
    assert groups == {"O1": ["first.txt"], "O2": ["link_a", "sub/link_b", "link_c"], "O3": ["last.txt"]}
    assert rows(ops.link_names(ops.link_groups(s)), "position", "path", "target") == [(1, "sub/link_b", "link_a"), (2, "link_c", "link_a")]


def test_ids(spark):
    index = spark.createDataFrame([("O2",), ("O7",), ("odd",)], "object_id string")
    assert ops.next_id(index).first()[0] == 8
    assert ops.next_id(index.limit(0)).first()[0] == 1
    assert ops.next_id_of(index, index.limit(0)) == 8
    new = spark.createDataFrame([(5, "x"), (2, "y")], "seq long, path string")
    assert rows(ops.assign_ids(new.withColumn("object_id", F.lit(None).cast("string")), 8), "path", "object_id") == [("x", "O9"), ("y", "O8")]


def test_dedup_lookups(spark):
    index = spark.createDataFrame(
        [("O10", "a", 1, 5, 6, "d1"), ("O9", "a", 1, 5, 6, "d1"), ("O3", "b", 2, 5, 6, "")], "object_id string, path string, size long, mtime_sec long, mtime_nsec int, sha256 string"
    )
    scanned = spark.createDataFrame(
        [("a", 1, 5, 6, "d1"), ("a", 2, 5, 6, "d1"), ("a", 1, 5, 7, ""), ("c", 9, 9, 9, None)], "path string, size long, mtime_sec long, mtime_nsec int, sha256 string"
    ).withColumn("object_id", F.lit(None).cast("string"))
    assert rows(ops.fast_dedup(scanned, index), "size", "mtime_nsec", "object_id")[0] == (1, 6, "O9")
    assert ops.fast_dedup(scanned, index).filter("object_id is null").count() == 3
    assert ops.fast_dedup(scanned, index).count() == ops.hash_dedup(scanned, index).count() == 4
    assert ops.hash_dedup(scanned, index).filter("object_id = 'O9'").count() == 2


def test_latest_snapshot_compares_file_names(spark):
    labels = spark.createDataFrame([("a",), ("a-b",), ("",)], "label string")
    assert ops.latest_snapshot(labels).first()[0] == "a"
    assert ops.latest_snapshot(labels.limit(0)).first()[0] is None


def test_integrity(spark):
    sums = spark.createDataFrame([("aa", "p1"), ("bb", "p2"), ("cc", "p3")], "sha256 string, relpath string")
    disk = spark.createDataFrame([("aa", "p1"), ("BB", "p2"), ("dd", "p4")], "sha256 string, relpath string")
    assert rows(integrity.verify_checksums(sums, disk), "relpath", "status") == [("p1", "OK"), ("p2", "FAILED"), ("p3", "FAILED open or read")]
    assert rows(integrity.verify_untracked(disk, sums), "relpath") == [("p4",)]
    assert integrity.verdict(integrity.verify_checksums(sums, disk)).first()[0] is True
    assert integrity.verdict(integrity.verify_checksums(sums.limit(0), disk)).first()[0] is False
    index = spark.createDataFrame([("O1", "pack-1"), ("O2", "pack-2"), ("O3", "pack-2")], "object_id string, pack string")
    packs = spark.createDataFrame([("pack-1",)], "pack string")
    assert rows(integrity.verify_dangling(index, packs), "object_id") == [("O2",), ("O3",)]


def test_deep_findings(spark):
    m = spark.createDataFrame(
        [("p", "ok", 1, 1, "a", None), ("p", "extra", 1, 1, "a", None), ("p", "both", 2, 3, "x", None), ("p", "sha", 1, 1, "x", None), ("p", "bad", 1, 0, "x", "cut")],
        "pack string, path string, size long, n_read long, sha256 string, error string",
    )
    e = spark.createDataFrame([("p", n, 2 if n == "both" else 1, "a") for n in ("ok", "both", "sha", "bad", "gone")], "pack string, path string, size long, sha256 string")
    assert rows(integrity.verify_objects(m, e), "path", "status") == [
        ("bad", "read error"), ("both", "sha256 mismatch"), ("both", "size mismatch"), ("extra", "present in archive, not in manifest"), ("gone", "in manifest, missing from archive"), ("ok", "OK"), ("sha", "sha256 mismatch"),
    ]
    assert rows(integrity.membership_drift(m, e), "path", "side") == [("extra", "archive"), ("gone", "manifest")]


def test_recovery(spark):
    text = spark.createDataFrame([("a\nb\n",), ("a\nbé",), ("abc",), ("",)], "t string")
    assert [r[0] for r in text.select(recovery.torn_tail(F.col("t"))).collect()] == [4, 2, 0, 0]
    names = spark.createDataFrame([(n,) for n in ("pack-000001.tar.zst", "pack-000001.json", "pack-000002.tar.zst", "pack-000002.json", "pack-000003.tar.zst.part")], "name string")
    index = spark.createDataFrame([("pack-000001",)], "pack string")
    assert rows(recovery.recovery_plan(names, index), "name") == [("pack-000002.json",), ("pack-000002.tar.zst",), ("pack-000003.tar.zst.part",)]
    assert recovery.next_pack(names).first()[0] == 3
    assert recovery.next_pack(names.limit(0)).first()[0] == 1


def test_recovery_plan_of_repeated_names(spark):
    names = spark.createDataFrame([(n,) for n in ("pack-000002.tar.zst", "pack-000002.tar.zst", "pack-000002.json", "pack-000004.json", "a.part", "a.part")], "name string")
    index = spark.createDataFrame([("pack-000001",)], "pack string")
    assert rows(recovery.recovery_plan(names, index), "name") == [("a.part",), ("a.part",), ("pack-000002.json",), ("pack-000002.tar.zst",), ("pack-000002.tar.zst",)]


def test_restore_plan(spark):
    s = snapshot(spark).withColumn("target", F.when(F.col("type") == "symlink", "first.txt"))
    index = spark.createDataFrame([("O1", "pack-1", "first.txt", 100, ""), ("O2", "pack-1", "old_a", 200, ""), ("O3", "pack-2", "last.txt", 0, "")], "object_id string, pack string, path string, size long, sha256 string")
    plan = restore.restore_plan(s, index)
    assert rows(plan.filter("action = 'extract'"), "ord", "path", "member_path") == [("pack-1\0O1", "first.txt", "first.txt"), ("pack-1\0O2", "link_a", "old_a"), ("pack-2\0O3", "last.txt", "last.txt")]
    assert rows(plan.filter("action = 'link'"), "path", "target") == [("link_c", "link_a"), ("sub/link_b", "link_a")]
    assert rows(plan.filter("action = 'symlink'"), "path", "target") == [("ptr", "first.txt")]
    assert tuple(restore.preflight(s, index.filter("object_id <> 'O3'")).first()) == (0, 1)


def test_copies_are_not_linked(spark):
    s = snapshot(spark, [(0, "file", "a", "O1", 1), (1, "file", "b", "O1", 1)]).withColumn("ino", F.col("seq") + 5).withColumn("target", F.lit(None).cast("string"))
    index = spark.createDataFrame([("O1", "pack-1", "a", 1, "")], "object_id string, pack string, path string, size long, sha256 string")
    assert rows(restore.restore_plan(s, index).filter("phase in (2, 3)"), "action", "path", "target") == [("copy", "b", "a"), ("extract", "a", None)]
    assert rows(restore.restore_plan(s, index, parity=True).filter("phase in (2, 3)"), "action", "path", "target") == [("extract", "a", None), ("link", "b", "a")]


def test_upload_plan():
    steps = publish.upload_steps("/repo/", "cold:b/")
    assert [s[1:] for s in steps] == [(f"/repo/{f}", f"cold:b/{f}") for f in ("packs", "checksums", "snapshots", "objects")]
    for bad in (("", "x"), ("x", "")):
        try:
            publish.upload_steps(*bad)
        except ValueError:
            continue
        raise AssertionError
