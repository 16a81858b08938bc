"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCK, HEADER_BYTES, PAX_BYTES


def parse_size(text: Column) -> Column:
    """Bytes of a size literal: digits, then at most one of K, M, G (either case, base 1024); null if malformed or above 2^63 - 1."""
    digits = F.regexp_extract(text, "^([0-9]+)[KkMmGg]?$", 1)
    unit = F.lower(F.regexp_extract(text, "^[0-9]+([KkMmGg]?)$", 1))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("long")
    return F.when(text.rlike("^[0-9]+[KkMmGg]?$"), F.try_multiply(digits.try_cast("long"), factor))


def entry_cost(size: Column) -> Column:
    """Archive bytes that an object is counted with: header, body in whole blocks, extended header."""
    return F.lit(HEADER_BYTES + PAX_BYTES).cast("long") + F.floor((size + (BLOCK - 1)) / BLOCK).cast("long") * BLOCK


def utf8_valid(data: Column) -> Column:
    """Strict UTF-8: no overlong forms, surrogates, code points above U+10FFFF or cut sequences."""
    return F.is_valid_utf8(data)


def to_base64(data: Column) -> Column:
    """Padded base64 in one line, whatever the session's line setting."""
    return F.translate(F.base64(data), "\r\n", "")


def from_base64(text: Column) -> Column:
    """Bytes of a padded base64 string; null if malformed or if its length is not a multiple of 4."""
    return F.when((F.length(text) % 4 == 0) & text.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(text, F.lit("base64")))


def path_fields(data: Column, name: str = "path") -> list[Column]:
    """Wire form of a byte path: (path, path_b64), exactly one not null."""
    valid = utf8_valid(data)
    return [F.when(valid, data.cast("string")).alias(name), F.when(~valid, to_base64(data)).alias(f"{name}_b64")]


def path_value(plain: Column, encoded: Column) -> Column:
    """Byte path of a wire form; the plain field wins."""
    return F.coalesce(F.to_binary(plain, F.lit("utf-8")), from_base64(encoded))


def format_mode(mode: Column) -> Column:
    """Permission bits as four octal digits."""
    return F.lpad(F.conv(mode.cast("long").bitwiseAND(F.lit(0o7777).cast("long")).cast("string"), 10, 8), 4, "0")


def parse_mode(text: Column) -> Column:
    """Number of an octal text."""
    return F.conv(text, 8, 10).cast("long")


def safe_path(path: Column) -> Column:
    """Whether a path may be restored below a destination: not empty, not absolute, no component `..`."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def join_path(base: Column, name: Column) -> Column:
    """base/name; an empty base gives name; trailing slashes of base do not count."""
    trimmed = F.regexp_replace(base, "/+$", "")
    return F.when(base == "", name).otherwise(F.concat(trimmed, F.lit("/"), name))


def walk_key(path: Column) -> Column:
    """Sort key of depth-first order with siblings by bytes: a directory's contents stand right after it."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def id_number(object_id: Column) -> Column:
    """Number of an object id `O<n>`, else 0."""
    return F.coalesce(F.regexp_extract(object_id, "^O([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long"))


def object_id(number: Column) -> Column:
    """Object id of a number."""
    return F.concat(F.lit("O"), number.cast("string"))


def pack_name(number: Column) -> Column:
    """Pack name of a number, padded to six digits."""
    return F.concat(F.lit("pack-"), F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string")))


def pack_number(name: Column) -> Column:
    """Number of a committed archive's file name, null for any other name and for numbers above six digits."""
    return F.regexp_extract(name, "^pack-([0-9]{1,6})[.]tar[.]zst$", 1).try_cast("long")


def default_label(at: Column) -> Column:
    """Snapshot label of an instant (UTC session)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss")


def sha256_hex(data: Column) -> Column:
    """Lower-case digest."""
    return F.sha2(data, 256)


def to_hex(data: Column) -> Column:
    """Lower-case hex."""
    return F.lower(F.hex(data))


def number(text: Column, kind: str = "long") -> Column:
    """A JSON number read as text: whole numbers exactly, others by way of double; null if neither."""
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))


def number_or(text: Column, default: int = 0, kind: str = "long") -> Column:
    """number() with a default for missing or malformed values."""
    return F.coalesce(number(text, kind), F.lit(default).cast(kind))


def has_suffix(name: Column, suffix: str) -> Column:
    """Whether a file name ends in a suffix and is longer than it."""
    return F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix))
