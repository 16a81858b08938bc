import grp
import json
import os
import pwd
import stat

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from snapcat import cli, repository
from snapcat.plans import publish
from snapcat.schema import ENTRY
from snapcat.sources import catalog, files, packs
from snapcat.sources.lines import LinesSource
from snapcat.sources.tree import TreeReader, birth_ns


def write(root, name, data):
    path = os.path.join(os.fsencode(root), name if isinstance(name, bytes) else name.encode())
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def tree(root):
    rng = np.random.default_rng(0)
    write(root, "b/first.txt", b"hello\n" * 100)
    write(root, "b/" + "n" * 120, rng.bytes(3000))
    write(root, "empty", b"")
    write(root, "café/ü", b"unicode")
    write(root, b"raw\xff/x", b"bytes that are not UTF-8")
    write(root, "a.txt", rng.bytes(70_000))
    os.link(os.path.join(root, "b/first.txt"), os.path.join(root, "a-link"))
    os.link(os.path.join(root, "b/first.txt"), os.path.join(root, "z-link"))
    os.symlink("nowhere", os.path.join(root, "dangling"))
    os.symlink("b/first.txt", os.path.join(root, "good"))
    os.mkfifo(os.path.join(root, "pipe"))
    os.makedirs(os.path.join(root, "nothing/inside"))
    for k, (d, _, fs) in enumerate(os.walk(os.fsencode(root), topdown=False)):
        for f in fs:
            if not os.path.islink(os.path.join(d, f)):
                os.chmod(os.path.join(d, f), 0o640)
                os.utime(os.path.join(d, f), ns=(1_600_000_000_000_000_123 + k, 1_500_000_000_123_456_789 + k))
        os.chmod(d, 0o750)
        os.utime(d, ns=(1_600_000_000_000_000_001, 1_400_000_000_000_000_007 + k))


def facts(root):
    out = {}
    for d, ds, fs in os.walk(os.fsencode(root)):
        for n in [*ds, *fs]:
            path = os.path.join(d, n)
            st = os.lstat(path)
            rel = os.path.relpath(path, os.fsencode(root))
            if stat.S_ISLNK(st.st_mode):
                out[rel] = ("link", os.readlink(path))
            elif stat.S_ISDIR(st.st_mode):
                out[rel] = ("dir", st.st_mode, st.st_mtime_ns)
            elif stat.S_ISREG(st.st_mode):
                with open(path, "rb") as f:
                    out[rel] = ("file", st.st_mode, st.st_mtime_ns, st.st_nlink, f.read())
    return out


@pytest.fixture
def place(tmp_path):
    root, repo = tmp_path / "tree", tmp_path / "repo"
    root.mkdir()
    tree(str(root))
    return str(root), str(repo), str(tmp_path / "back")


def test_round_trip(spark, place):
    root, repo, back = place
    done = repository.scan(spark, root, repo, "one")
    assert done.value["new"] == 6 and done.value["known"] == 0 and done.warnings == []
    header, rows = catalog.read_snapshot(spark, os.path.join(repo, "snapshots/one.jsonl"))
    assert header["root"] == root
    paths = [bytes(r.path_bytes) for r in rows.orderBy("seq").collect()]
    assert paths == sorted(paths, key=lambda p: p.split(b"/")) and set(paths) == set(facts(root))
    names = repository.pack(spark, repo, target=4096).value
    assert len(names) >= 3
    assert repository.pack(spark, repo, target=4096).value == []
    assert repository.verify(spark, repo, deep=True).value
    index = catalog.read_index(spark, os.path.join(repo, "objects/objects.jsonl")).collect()
    for r in index:  # the offset seeks to the body in the decompressed stream
        with open(os.path.join(os.fsencode(root), bytes(r.path_bytes)), "rb") as f:
            assert packs.open_body(os.path.join(repo, "packs", f"{r.pack}.tar.zst"), r.offset, r.size) == f.read()
    assert repository.restore(spark, repo, back).value == 6
    assert facts(back) == facts(root)
    assert os.stat(os.path.join(back, "a-link")).st_ino == os.stat(os.path.join(back, "z-link")).st_ino


def test_incremental_runs(spark, place):
    root, repo, _ = place
    repository.scan(spark, root, repo, "1")
    repository.pack(spark, repo)
    write(root, "new", b"new file")
    write(root, "copy", b"unicode")
    with open(os.path.join(root, "empty"), "wb") as f:
        f.write(b"grown")
    second = repository.scan(spark, root, repo, "2").value
    assert (second["new"], second["known"]) == (3, 5)
    hashed = repository.scan(spark, root, repo, "3", hashed=True).value
    assert (hashed["new"], hashed["known"]) == (2, 6)  # the copy is known by its digest
    assert len(repository.pack(spark, repo, "3").value) == 1
    assert repository.pack(spark, repo, "3").value == []
    ids = [r.object_id for r in catalog.read_index(spark, os.path.join(repo, "objects/objects.jsonl")).collect()]
    assert len(ids) == len(set(ids)) == 8


def test_scans_before_a_pack_do_not_share_ids(spark, place):
    root, repo, back = place
    repository.scan(spark, root, repo, "1")
    write(root, "other", b"other body")
    repository.scan(spark, root, repo, "2")
    repository.pack(spark, repo, "1")
    repository.pack(spark, repo, "2")
    repository.restore(spark, repo, back, "2")
    assert facts(back) == facts(root)


def test_damage_is_found(spark, place):
    root, repo, back = place
    repository.scan(spark, root, repo, "1")
    names = repository.pack(spark, repo, target=4096).value
    path = os.path.join(repo, "packs", f"{names[0]}.tar.zst")
    with open(path, "rb") as f:
        good = f.read()
    with open(path, "wb") as f:
        f.write(good[:-20] + bytes([good[-20] ^ 255]) + good[-19:])
    assert any(f"packs/{names[0]}.tar.zst: FAILED" in w for w in repository.verify(spark, repo).warnings)
    assert not repository.verify(spark, repo, deep=True).value
    os.remove(path)
    said = repository.verify(spark, repo).warnings
    assert any("FAILED open or read" in w for w in said) and any("PACK MISSING" in w for w in said)
    with open(path, "wb") as f:
        f.write(good)
    write(repo, "packs/pack-000077.tar.zst", zstandard.compress(b""))
    assert any("pack-000077.tar.zst: MISSING FROM SHA256SUMS" in w for w in repository.verify(spark, repo).warnings)


def test_crash_recovery(spark, place):
    root, repo, back = place
    repository.scan(spark, root, repo, "1")
    write(repo, "packs/pack-000001.tar.zst", b"left over")
    write(repo, "packs/pack-000002.tar.zst.part", b"cut")
    write(repo, "objects/objects.jsonl", b'{"object_id":"O1","pack":"pack-0')
    write(repo, "checksums/SHA256SUMS", b"0" * 64 + b"  packs/pack-000001.tar.zst\n")
    said = repository.pack(spark, repo, target=4096).warnings
    assert len(said) == 4
    assert repository.verify(spark, repo, deep=True).value
    repository.restore(spark, repo, back)
    assert facts(back) == facts(root)


def test_restore_checks_before_it_writes(spark, place):
    root, repo, back = place
    repository.scan(spark, root, repo, "1")
    with pytest.raises(repository.Fatal, match="6 objects missing"):
        repository.restore(spark, repo, back)
    path = os.path.join(repo, "snapshots/1.jsonl")
    with open(path, "a") as f:
        f.write(json.dumps({"type": "dir", "path": "../evil", "mode": "0755"}) + "\n")
    repository.pack(spark, repo)
    with pytest.raises(repository.Fatal, match="1 unsafe"):
        repository.restore(spark, repo, back)
    assert not os.path.exists(back)


def test_restore_compares_with_the_index(spark, place):
    root, repo, back = place
    repository.scan(spark, root, repo, "1")
    repository.pack(spark, repo)
    path = os.path.join(repo, "objects/objects.jsonl")
    with open(path) as f:
        lines = [json.loads(x) for x in f]
    next(x for x in lines if x.get("path") == "a.txt")["sha256"] = "0" * 64
    with open(path, "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    assert repository.restore(spark, repo, back).warnings == ["a.txt: size or digest differs from the index"]


def test_latest_label(tmp_path):
    for n in ("a.jsonl", "a-b.jsonl", ".jsonl", "zzz.txt"):
        write(str(tmp_path), f"snapshots/{n}", b"")
    assert repository.latest_label(str(tmp_path)) == "a"
    with pytest.raises(repository.Fatal):
        repository.latest_label(str(tmp_path / "none"))


def test_catalog_files(spark, tmp_path):
    index = str(tmp_path / "objects.jsonl")
    assert catalog.read_index(spark, index).count() == 0
    files.append_lines(index, [json.dumps({"object_id": "O2", "pack": "p", "offset": 1.15e18, "size": 3, "sha256": "x" * 70, "path_b64": "Yf8=", "mtime_sec": 5})])
    row = catalog.read_index(spark, index).first()
    assert (row.offset, row.sha256, bytes(row.path_bytes), row.mtime_nsec) == (1150000000000000000, "x" * 64, b"a\xff", 0)
    with open(index, "ab") as f:
        f.write(b'{"object_id": "O3"')
    assert catalog.read_index(spark, index).count() == 1
    assert files.repair_tail(index) == 18 and files.repair_tail(index) == 0 and files.repair_tail(index + "x") == 0
    files.append_lines(index, ["not json"])
    with pytest.raises(catalog.CatalogError):
        catalog.read_index(spark, index)
    sums = str(tmp_path / "SHA256SUMS")
    assert catalog.read_checksums(spark, sums).count() == 0
    files.append_lines(sums, ["a" * 64 + "  one", "", "b" * 64 + "  two words\r"])
    assert [tuple(r) for r in catalog.read_checksums(spark, sums).collect()] == [("a" * 64, "one"), ("b" * 64, "two words")]
    files.append_lines(sums, ["short"])
    with pytest.raises(catalog.CatalogError):
        catalog.read_checksums(spark, sums)
    with pytest.raises(FileNotFoundError):
        catalog.read_snapshot(spark, str(tmp_path / "none.jsonl"))


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(0, "dir", "d", b"d", None), (1, "file", "d/f", b"d/f", 2**53 + 1), (2, "symlink", "l", b"l", None)]
    df = spark.createDataFrame(rows, "seq long, type string, path string, path_bytes binary, size long")
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY.fields])
    path = str(tmp_path / "s.jsonl")
    assert catalog.write_snapshot(full, path, "/r", 7) == 3
    header, back = catalog.read_snapshot(spark, path)
    got = back.orderBy("seq").collect()
    assert [(r.type, r.path, r.size) for r in got] == [("dir", "d", None), ("file", "d/f", 2**53 + 1), ("symlink", "l", None)]
    assert got[1].atime_sec is None and got[1].uid == 0 and header["created"] == "7"
    with open(path, "a") as f:
        f.write('{"type":"door","path":"x"}\n')
    with pytest.raises(catalog.CatalogError, match="unknown entry type"):
        catalog.read_snapshot(spark, path)


def test_command_line(spark, place, capsys):
    root, repo, back = place
    assert cli.main([], spark) == cli.main(["pack"], spark) == cli.main(["pack", "--repo", repo, "--target-size", "0"], spark) == 64
    assert cli.main(["pack", "--repo", repo, "--pack-algo", "x"], spark) == 64
    assert cli.main(["pack", "--repo", repo], spark) == 2
    assert cli.main(["scan", root + "-none", "--repo", repo], spark) == 2
    assert cli.main(["scan", root, "--repo", repo, "--label", "x"], spark) == 0
    assert cli.main(["pack", "--repo", repo, "--pack-algo", "ffd", "--target-size", "8K"], spark) == 0
    assert cli.main(["pack", "--repo", repo], spark) == 0 and "nothing to pack" in capsys.readouterr().out
    assert cli.main(["verify", "--repo", repo, "--objects"], spark) == 0
    assert cli.main(["restore", "--repo", repo, "--dest", back], spark) == 0
    assert cli.main(["upload", "--repo", repo, "--remote", back + "-far"], spark) == 0
    assert sorted(os.listdir(back + "-far")) == sorted(publish.FOLDERS)
    os.remove(os.path.join(repo, "packs/pack-000001.tar.zst"))
    assert cli.main(["verify", "--repo", repo], spark) == 1


def test_lines_are_read_by_byte_ranges(spark, tmp_path):
    """Every line once with its offset, whatever the ranges; the last one without a line feed too."""
    lines = ["", "a", "é" * 30, "x" * 200, "", "last"]
    (tmp_path / "f").write_bytes("\n".join(lines).encode())
    spark.dataSource.register(LinesSource)
    at = [sum(len(x.encode()) + 1 for x in lines[:k]) for k in range(len(lines))]
    for split in (1, 7, 64, 10**6):
        rows = spark.read.format("snapcat_lines").option("path", str(tmp_path / "f")).option("split", split).load().collect()
        assert sorted(map(tuple, rows)) == list(zip(at, lines, strict=True))


def test_one_folder_that_holds_all_is_dealt_to_many_tasks(spark, tmp_path):
    top = tmp_path / "only"
    for k in range(40):
        (top / f"d{k}" / "deep" / "er").mkdir(parents=True)
        (top / f"d{k}" / "deep" / "er" / "f").write_text("x")
    reader = TreeReader({"root": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 40 and max(len(p.entries) for p in parts) < 4
    found = sorted(r[1] for p in parts for r in reader.read(p))
    assert found == sorted(os.fsencode(os.path.relpath(os.path.join(d, n), tmp_path)) for d, ds, fs in os.walk(tmp_path) for n in (*ds, *fs))


def test_members_keep_owners_and_all_times(spark, tmp_path):
    """Names of owner and group and the four times stand in the archive's headers; unfinished files have names of their own."""
    tree, repo = tmp_path / "tree", tmp_path / "repo"
    tree.mkdir()
    (tree / "f").write_text("body")
    os.utime(tree / "f", ns=(1_600_000_000_000_000_007, 1_500_000_000_000_000_009))
    repository.scan(spark, str(tree), str(repo), "a")
    os.utime(tree / "f", ns=(1_600_000_000_000_000_007, 1_500_000_000_000_000_009))
    repository.pack(spark, str(repo))
    r = spark.read.format("snapcat_packs").option("dir", str(repo / "packs")).load().first()
    assert (r.mtime_sec, r.mtime_nsec) == (1_500_000_000, 9) and r.atime_sec >= 1_600_000_000 and r.ctime_sec > 1_700_000_000
    assert (r.uid, r.gid) == (os.getuid(), os.getgid()) and r.uname == pwd.getpwuid(os.getuid()).pw_name and r.gname == grp.getgrgid(os.getgid()).gr_name
    st = os.stat(tree / "f")
    born = birth_ns(os.fsencode(tree / "f"), st)
    assert born is None or (r.btime_sec, r.btime_nsec) == divmod(born, 10**9) and born <= st.st_ctime_ns
    assert sorted(os.listdir(repo / "packs")) == ["pack-000001.json", "pack-000001.tar.zst"]
