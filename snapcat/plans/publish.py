"""Publication: ordered copies of a repository's folders, bulk data first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: fixed values: the folders in the order they are copied
FOLDERS = ("packs", "checksums", "snapshots", "objects")


def upload_steps(repo: str, remote: str) -> list[tuple[int, str, str]]:
    """(step, source, destination) for every folder."""
    if not repo or not remote:
        raise ValueError("repository and remote must be given")
    return [(k, f"{repo.rstrip('/') or '/'}/{f}".replace("//", "/", 1) if repo.startswith("/") else f"{repo.rstrip('/')}/{f}", f"{remote.rstrip('/')}/{f}") for k, f in enumerate(FOLDERS, 1)]


def upload_plan(spark: SparkSession, repo: str, remote: str) -> DataFrame:
    """The steps as rows."""
    return spark.createDataFrame(upload_steps(repo, remote), "step int, src string, dst string")


def upload(spark: SparkSession, repo: str, remote: str) -> list[str]:
    """Copy folder after folder by Hadoop's file systems (any remote they reach); stops at the first failure."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for _, src, dst in upload_steps(repo, remote):
        a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
        fa, fb = a.getFileSystem(conf), b.getFileSystem(conf)
        if not fa.exists(a):
            continue
        fb.mkdirs(b)
        for f in sorted(fa.listStatus(a), key=lambda x: x.getPath().getName()):
            if f.isFile():
                to = jvm.org.apache.hadoop.fs.Path(b, f.getPath().getName())
                if not jvm.org.apache.hadoop.fs.FileUtil.copy(fa, f.getPath(), fb, to, False, True, conf):
                    raise OSError(f"copying {f.getPath()} failed")
        done.append(dst)
    return done
