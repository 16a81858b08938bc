"""Schemas of the four relations, explicit everywhere; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: fixed values of the formats
SNAPSHOT_FORMAT = "snapcat-snapshot-v1"
PACK_FORMAT = "snapcat-pack-v1"
ENTRY_TYPES = ("file", "dir", "symlink")
BLOCK = 512
HEADER_BYTES, PAX_BYTES = 512, 1536
DEFAULT_TARGET = 50 << 30
ENTROPY_SAMPLE, ENTROPY_BITS = 65536, 7.5
STORE_LEVEL, NORMAL_LEVEL = 1, 3


def _struct(ddl: str) -> T.StructType:
    kinds = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "BINARY": T.BinaryType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


#: numbers are read as text first: writers may print large ones in scientific notation
SNAPSHOT_LINE = _struct(
    "format STRING, created STRING, root STRING, root_b64 STRING, type STRING, path STRING, path_b64 STRING, uid STRING, gid STRING, mtime_sec STRING, "
    "mtime_nsec STRING, atime_sec STRING, atime_nsec STRING, btime_sec STRING, btime_nsec STRING, ctime_sec STRING, ctime_nsec STRING, dev STRING, "
    "ino STRING, object_id STRING, nlink STRING, size STRING, sha256 STRING, mode STRING, target STRING, target_b64 STRING"
)
ENTRY = _struct(
    "seq BIGINT, type STRING, path STRING, path_bytes BINARY, uid BIGINT, gid BIGINT, mtime_sec BIGINT, mtime_nsec INT, atime_sec BIGINT, atime_nsec INT, "
    "btime_sec BIGINT, btime_nsec INT, ctime_sec BIGINT, ctime_nsec INT, dev BIGINT, ino BIGINT, object_id STRING, nlink BIGINT, size BIGINT, "
    "sha256 STRING, mode STRING, target STRING, target_bytes BINARY"
)
INDEX_LINE = _struct("object_id STRING, pack STRING, offset STRING, size STRING, sha256 STRING, path STRING, path_b64 STRING, mtime_sec STRING, mtime_nsec STRING")
INDEX = _struct("object_id STRING, pack STRING, offset BIGINT, size BIGINT, sha256 STRING, path STRING, path_bytes BINARY, mtime_sec BIGINT, mtime_nsec INT")
PACK_ENTRY = _struct("object_id STRING, path STRING, path_b64 STRING, offset BIGINT, size BIGINT, sha256 STRING")
PACK_DOCUMENT = T.StructType(
    [T.StructField("format", T.StringType()), T.StructField("pack", T.StringType()), T.StructField("created", T.LongType()), T.StructField("entries", T.ArrayType(PACK_ENTRY))]
)
CHECKSUM = _struct("sha256 STRING, relpath STRING")
#: what the tree source yields; `warning` and `severity` are set on rows that are not entries
TREE = _struct(
    "type STRING, path_bytes BINARY, uid BIGINT, gid BIGINT, mtime_sec BIGINT, mtime_nsec INT, atime_sec BIGINT, atime_nsec INT, btime_sec BIGINT, btime_nsec INT, "
    "ctime_sec BIGINT, ctime_nsec INT, dev BIGINT, ino BIGINT, nlink BIGINT, size BIGINT, mode STRING, target_bytes BINARY, sha256 STRING, head BINARY, warning STRING, severity INT"
)
#: what the pack source yields
MEMBER = _struct(
    "pack STRING, member BIGINT, path_bytes BINARY, offset BIGINT, size BIGINT, n_read BIGINT, sha256 STRING, error STRING, mode STRING, uid BIGINT, gid BIGINT, uname STRING, gname STRING, "
    "mtime_sec BIGINT, mtime_nsec INT, atime_sec BIGINT, atime_nsec INT, ctime_sec BIGINT, ctime_nsec INT, btime_sec BIGINT, btime_nsec INT"
)
