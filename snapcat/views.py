"""Catalog views derived from the driver's tables, as DataFrames and as SQL with the same rows.

Documents are files: path from lang, source and id, body = text. A first run and an index after it hold all documents;
modulo rules give some a second name, and make a smaller early run, a second run with new files, edits and renames, and
injected faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import catalog as ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, size, sha256 of every document as a file."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("", "lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "text")


def _names(df: DataFrame) -> DataFrame:
    """Every file under its path and, for some, under a second name of the same inode."""
    second = df.filter("doc_id % 20 = 0").withColumn("path", F.concat(F.lit("links/d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return df.union(second)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bodies(spark, sf_dir).drop("text")
    d = d.withColumn("mtime_sec", F.col("doc_id") + 1_700_000_000).withColumn("mtime_nsec", F.col("doc_id") * 7919 % 1_000_000_000)
    return _names(d.withColumn("dev", F.lit(1).cast("long")).withColumn("ino", F.col("doc_id") + 1000))


def run1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files."""
    return ops.walk_order(_first(spark, sf_dir))


def run0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An early run: a quarter of the files is not there yet, so that the second run finds new ones."""
    return ops.walk_order(_first(spark, sf_dir).filter("doc_id % 4 <> 3"))


def run2(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.col("doc_id") % 10 == 5
    d = bodies(spark, sf_dir).withColumn("sha256", F.when(edited, F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256)).otherwise(F.col("sha256"))).drop("text")
    d = d.withColumn("size", F.when(edited, F.col("size") + 1).otherwise(F.col("size")))
    d = d.withColumn("mtime_sec", F.col("doc_id") + 1_700_000_000 + F.when(edited, 1).otherwise(0)).withColumn("mtime_nsec", F.col("doc_id") * 7919 % 1_000_000_000)
    d = d.withColumn("path", F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return ops.walk_order(_names(d.withColumn("dev", F.lit(1).cast("long")).withColumn("ino", F.col("doc_id") + 5000)))


def _index(run: DataFrame) -> DataFrame:
    obj = ops.assign_ids(ops.inodes(run), 1)
    return obj.withColumn("pack", s.pack_name(F.floor(s.id_number(F.col("object_id")) / 10) + 1))


def index1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object index after the first run; packs by ten objects."""
    return _index(run1(spark, sf_dir))


def index0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object index after the early run."""
    return _index(run0(spark, sf_dir))


def catalog1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(file rows of the first run with their object ids, the index after it); the run is numbered once."""
    run = run1(spark, sf_dir)
    index = _index(run).checkpoint()
    return run.join(index.select("dev", "ino", "object_id"), ["dev", "ino"]).withColumn("type", F.lit("file")), index


def snapshot1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of the first run with their object ids."""
    return catalog1(spark, sf_dir)[0]


RUNS_SQL = """
    bodies AS (
        SELECT doc_id, lang || '/' || source || '/d' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, text FROM documents
    ), r1 AS (
        SELECT doc_id, path, size, sha256, doc_id + 1700000000 AS mtime_sec, doc_id * 7919 % 1000000000 AS mtime_nsec, CAST(1 AS BIGINT) AS dev, doc_id + 1000 AS ino
        FROM bodies
    ), run1 AS (
        SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS seq
        FROM (SELECT * FROM r1 UNION ALL SELECT * REPLACE ('links/d' || doc_id || '.txt' AS path) FROM r1 WHERE doc_id % 20 = 0)
    ), obj1 AS (
        SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY seq) AS k, count(*) OVER (PARTITION BY dev, ino) AS n_names FROM run1) WHERE k = 1
    ), idx AS (
        SELECT *, 'O' || n AS object_id, 'pack-' || lpad(CAST(n // 10 + 1 AS VARCHAR), 6, '0') AS pack FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM obj1)
    ), snap AS (
        SELECT run1.*, idx.object_id FROM run1 JOIN idx USING (dev, ino)
    ), run0 AS (
        SELECT * REPLACE (row_number() OVER (ORDER BY seq) - 1 AS seq) FROM run1 WHERE doc_id % 4 <> 3
    ), idx0 AS (
        SELECT *, 'O' || n AS object_id FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY seq) AS k FROM run0) WHERE k = 1)
    ), idxsha AS (
        SELECT sha256, arg_min(object_id, n) AS object_id FROM idx0 GROUP BY sha256
    ), r2 AS (
        SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'moved/' || path ELSE path END AS path, size + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS size,
            CASE WHEN doc_id % 10 = 5 THEN sha256(text || '!') ELSE sha256 END AS sha256,
            doc_id + 1700000000 + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS mtime_sec, doc_id * 7919 % 1000000000 AS mtime_nsec, CAST(1 AS BIGINT) AS dev, doc_id + 5000 AS ino
        FROM bodies
    ), run2 AS (
        SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS seq
        FROM (SELECT * FROM r2 UNION ALL SELECT * REPLACE ('links/d' || doc_id || '.txt' AS path) FROM r2 WHERE doc_id % 20 = 0)
    ), obj2 AS (
        SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY seq) AS k FROM run2) WHERE k = 1
    ), fast AS (
        SELECT obj2.*, idx0.object_id FROM obj2 LEFT JOIN idx0 USING (path, size, mtime_sec, mtime_nsec)
    ), hashed AS (
        SELECT fast.* EXCLUDE object_id, idxsha.object_id FROM fast LEFT JOIN idxsha USING (sha256) WHERE fast.object_id IS NULL
    )"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum list of the documents, some lines with a wrong digest, some files unlisted."""
    d = bodies(spark, sf_dir)
    wrong = F.when(F.col("doc_id") % 50 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))
    return d.filter("doc_id % 50 <> 3").select(F.col("path").alias("relpath"), wrong.alias("sha256"))


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found: some of the listed ones are gone."""
    return bodies(spark, sf_dir).filter("doc_id % 50 <> 2").select(F.col("path").alias("relpath"), "sha256")


SUMS_SQL = """
    bodies AS (
        SELECT doc_id, lang || '/' || source || '/d' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents
    ), sums AS (
        SELECT path AS relpath, CASE WHEN doc_id % 50 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM bodies WHERE doc_id % 50 <> 3
    ), disk AS (SELECT path AS relpath, sha256 FROM bodies WHERE doc_id % 50 <> 2)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: some dropped, some with another digest, a size that differs or a body that could not be read."""
    d = bodies(spark, sf_dir).filter("doc_id % 50 <> 2")
    return d.select(
        s.pack_name(F.floor(F.col("doc_id") / 100) + 1).alias("pack"), "path", "size", (F.col("size") + F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).alias("n_read"),
        F.when(F.col("doc_id") % 50 <= 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 50 == 4, F.lit("cut short")).alias("error"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries: some dropped."""
    d = bodies(spark, sf_dir).filter("doc_id % 50 <> 3")
    return d.select(s.pack_name(F.floor(F.col("doc_id") / 100) + 1).alias("pack"), "path", "size", "sha256")


MEMBERS_SQL = SUMS_SQL + """, members AS (
        SELECT 'pack-' || lpad(CAST(doc_id // 100 + 1 AS VARCHAR), 6, '0') AS pack, path, size, size + CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS n_read,
            CASE WHEN doc_id % 50 <= 1 THEN reverse(sha256) ELSE sha256 END AS sha256, CASE WHEN doc_id % 50 = 4 THEN 'cut short' END AS error
        FROM bodies WHERE doc_id % 50 <> 2
    ), manifest AS (
        SELECT 'pack-' || lpad(CAST(doc_id // 100 + 1 AS VARCHAR), 6, '0') AS pack, path, size, sha256 FROM bodies WHERE doc_id % 50 <> 3
    ), findings AS (
        SELECT pack, path, unnest(CASE
            WHEN e.sha256 IS NULL THEN ['present in archive, not in manifest'] WHEN m.sha256 IS NULL THEN ['in manifest, missing from archive']
            WHEN m.error IS NOT NULL THEN ['read error']
            WHEN (e.size <> m.size OR e.size <> m.n_read) AND e.sha256 <> m.sha256 THEN ['size mismatch', 'sha256 mismatch']
            WHEN e.size <> m.size OR e.size <> m.n_read THEN ['size mismatch'] WHEN e.sha256 <> m.sha256 THEN ['sha256 mismatch'] ELSE ['OK'] END) AS status
        FROM members m FULL JOIN manifest e USING (pack, path)
    )"""
