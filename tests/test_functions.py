import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapcat.functions import entropy
from snapcat.functions import scalars as s


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_parse_size(spark):
    good = {"1024": 1024, "0": 0, "100M": 104857600, "50G": 53687091200, "512K": 524288, "100m": 104857600, "9223372036854775807": 2**63 - 1}
    bad = ["", "abc", "100X", "100M5", "-5", "9" * 23, None, "9223372036854775808", "9007199254740992K", " 1", "1 "]
    assert column(spark, [*good, *bad], "string", s.parse_size) == [*good.values(), *[None] * len(bad)]


def test_entry_cost(spark):
    assert column(spark, [0, 1, 512, 513, 1024], "long", s.entry_cost) == [2048, 2560, 2560, 3072, 3072]


def test_utf8(spark):
    valid = [b"ascii", b"", bytes.fromhex("636166C3A9E282ACF09F9880")]
    invalid = [bytes.fromhex(x) for x in ("C328", "C080", "E08080", "EDA080", "F4908080", "626164FF6E616D65")]
    assert column(spark, valid + invalid, "binary", s.utf8_valid) == [True] * 3 + [False] * 6


def test_base64(spark):
    words = [b"foobar"[:k] for k in range(7)] + [bytes(range(256)) * 2]
    coded = column(spark, words, "binary", s.to_base64)
    assert coded[:7] == ["", "Zg==", "Zm8=", "Zm9v", "Zm9vYg==", "Zm9vYmE=", "Zm9vYmFy"]
    assert "\n" not in coded[7] and "\r" not in coded[7]
    assert [bytes(x) for x in column(spark, coded, "string", s.from_base64)] == words
    assert column(spark, ["Zg=", "Z", "Zg==\n", "Z!==", None], "string", s.from_base64) == [None] * 5


def test_modes(spark):
    modes = [0, 0o644, 0o755, 0o7777, 0o100644]
    text = column(spark, modes, "int", s.format_mode)
    assert text == ["0000", "0644", "0755", "7777", "0644"]
    assert column(spark, text, "string", s.parse_mode) == [0, 0o644, 0o755, 0o7777, 0o644]


UNSAFE = ["", "/etc/passwd", "..", "../secret", "a/../b", "a/b/..", "../../x"]
SAFE = ["a.txt", "sub/dir/file", "...", "a..b", "..a", "a../b", ".hidden", "a b", "a'b\"c", "café/é", "./ok"]


def test_safe_path(spark):
    assert column(spark, UNSAFE + SAFE, "string", s.safe_path) == [False] * 7 + [True] * 11


def test_walk_key_orders_depth_first(spark):
    paths = ["a-b", "a", "a.txt", "a/b", "a/b/c", "b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(s.walk_key(F.col("p")))
    assert [r[0] for r in df.collect()] == sorted(paths, key=lambda p: [x.encode() for x in p.split("/")])


def test_names(spark):
    assert column(spark, ["O7", "O", "x7", None, "O12a"], "string", s.id_number) == [7, 0, 0, 0, 0]
    assert column(spark, [1, 999999, 1234567], "long", s.pack_name) == ["pack-000001", "pack-999999", "pack-1234567"]
    assert column(spark, ["pack-000012.tar.zst", "pack-000012.json", "pack-1234567.tar.zst", "xpack-000001.tar.zst"], "string", s.pack_number) == [12, None, None, None]
    assert column(spark, ["a.jsonl", ".jsonl", "a.json"], "string", lambda c: s.has_suffix(c, ".jsonl")) == [True, False, False]
    assert column(spark, ["", "r", "r//"], "string", lambda c: s.join_path(c, F.lit("x"))) == ["x", "r/x", "r/x"]


def test_numbers_written_as_text(spark):
    assert column(spark, ["7", "1.15e+18", "x", None], "string", s.number) == [7, 1150000000000000000, None, None]
    assert column(spark, ["7", None, "x"], "string", s.number_or) == [7, 0, 0]


@pytest.mark.parametrize(
    ("text", "digest"),
    [("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")],
)
def test_sha256(spark, text, digest):
    assert column(spark, [text.encode()], "binary", s.sha256_hex) == [digest]


def test_entropy(spark):
    rng = np.random.default_rng(1)
    text = (b"the quick brown fox jumps over the lazy dog. " * 2000)[:65536]
    bodies = [bytes(65536), text, rng.bytes(131072), rng.bytes(4096), None]
    df = spark.createDataFrame([(i, b, len(b) if b else 70000) for i, b in enumerate(bodies)], "i int, b binary, n long")
    rows = df.select("i", entropy.sample_entropy(F.col("b"), F.col("n")).alias("bits")).withColumn("cls", entropy.storage_class(F.col("bits"))).orderBy("i").collect()
    assert rows[0].bits < 0.01 and 1 < rows[1].bits < 6 and rows[2].bits >= 7.9 and rows[3].bits == rows[4].bits == 0
    assert [r.cls for r in rows] == ["normal", "normal", "store", "normal", "normal"]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_byte_entropy_is_shannons(data):
    n = len(data)
    expected = -sum(c / n * math.log2(c / n) for c in (data.count(b) for b in set(data))) if n else 0
    assert abs(entropy.byte_entropy(data) - expected) < 1e-9
