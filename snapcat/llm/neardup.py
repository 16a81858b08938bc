"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are scaled to unit length and turned by independent random rotations. Under rotation r a vector u has a code,
the signs of its coordinates, that is the nearest corner x_r of the cube inscribed in the sphere, and a correction factor
f_r = <x_r, u>. Then x_r / f_r = u + e with e orthogonal to u, of known length g = sqrt(1 / f_r^2 - 1) and of uniformly
random direction. With two independent rotations, <x_1(u), x_2(v)> / (f_1(u) f_2(v)) is an unbiased estimate of <u, v>;
the mean of it and its mirror image is used. What is stored, dealt and compared is the table (key, code, factors).

Which pairs are recomputed is decided by a confidence bound: for a pair at the threshold t the estimate's standard
deviation is at most sqrt((1 - t^2) g_1^2 + (1 / f_1^2 - t^2) g_2^2) / sqrt(dim - 1), and pairs whose estimate plus
SIGMAS of it stays below t are ruled out. A normal deviate of 5 has a chance of 3 in 10 million. In few dimensions, where
that is no smaller than the largest error possible, the largest error is the bound and none is missed. Exact vectors are
fetched only for members of pairs that remain, and compared in double precision.

A label with few vectors is compared whole, code by code. Beyond WHOLE blocks, vectors meet only where a band of k code
bits agrees; k follows the size of the label, and the number of bands is such that a pair at the threshold agrees in
none with a chance of MISS at most. Blocks that are still large are split, so no task holds a large group, and a task
returns counts and a spanning forest of its links, never the pairs themselves. Equal vectors are one with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import checkpoint_dir, connected_components, release

#: vectors in a block; a label of at most WHOLE blocks is compared whole
BLOCK, WHOLE = 2048, 8
#: width of the confidence bound, and the chance that a pair at the threshold agrees in no band
SIGMAS, MISS = 5.0, 1e-4
MOST_BITS = 24
SLACK = 1e-4


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as bool, correction factors) of unit vectors under a rotation."""
    z = unit @ turn
    return z >= 0, np.abs(z).sum(1) / np.sqrt(z.shape[1])


def corrected(packed: np.ndarray, factor: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """x / f of packed codes, turned back, as float32: unbiased stand-ins for the vectors."""
    dim = len(turn)
    corner = (np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    return (corner @ turn.T.astype(np.float32)) / factor[:, None].astype(np.float32)


class Codes:
    """Codes of some vectors of one length, ready for estimates."""

    def __init__(self, packed: np.ndarray, factors: np.ndarray, dim: int):
        """packed: rows of the codes under rotations 0 and 1, one after the other; factors: rows of two."""
        width = packed.shape[1] // 2
        self.dim, self.factors = dim, factors.astype(np.float32)
        self.stand = [corrected(packed[:, r * width : (r + 1) * width], factors[:, r], rotation(dim, r)) for r in range(2)]

    def __getitem__(self, at: slice) -> Codes:
        out = object.__new__(Codes)
        out.dim, out.factors, out.stand = self.dim, self.factors[at], [s[at] for s in self.stand]
        return out


def estimates(a: Codes, b: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products, and how far below the truth they may be for pairs at the threshold."""
    est = (a.stand[0] @ b.stand[1].T + a.stand[1] @ b.stand[0].T) / 2
    one = 1 / a.factors.astype(np.float64) ** 2  # 1 / f^2 under either rotation
    two = 1 / b.factors.astype(np.float64) ** 2
    t = min(max(threshold, 0.0), 1.0)
    spread = SIGMAS / math.sqrt(a.dim - 1) if a.dim > 1 else 1.0
    low = 0.0
    for r in range(2):
        g1, g2 = np.maximum(one[:, r] - 1, 0)[:, None], np.maximum(two[:, 1 - r] - 1, 0)[None, :]
        if spread < 1:
            low = low + spread * np.sqrt((1 - t * t) * g1 + np.maximum(one[:, r] - t * t, 0)[:, None] * g2) / 2
        else:
            low = low + (np.sqrt((1 - t * t) * g1) + np.sqrt(one[:, r][:, None] * g2)) / 2
    return est, low


def candidates(a: Codes, b: Codes, threshold: float, same: bool, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of the pairs that the bound does not rule out; in the same block, each pair once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(a.factors), rows):
        est, low = estimates(a[lo : lo + rows], b, threshold)
        i, j = np.nonzero(est + low >= threshold - SLACK)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def bands_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Bands of `bits` code bits such that a pair at the threshold agrees in none with a chance of `miss` at most.

    A bit of two vectors differs with a chance of their angle over pi.
    """
    if not bits:
        return 1
    p = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** bits
    return 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; scaled by the largest component first, so nothing overflows."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs that form a spanning forest over n nodes."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


_CODE = "label string, n int, key long, m long, code binary, f0 float, f1 float, bands array<int>"


def code_table(classes: DataFrame, threshold: float) -> DataFrame:
    """(label, n, key, m, code, f0, f1, bands) from rows (label, n, key, m, v, bits)."""
    schema = pa.schema([("label", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("m", pa.int64()), ("code", pa.binary()), ("f0", pa.float32()), ("f1", pa.float32()), ("bands", pa.list_(pa.int32()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n", "bits"))
            for dim, k in sorted({*zip(n.tolist(), bits.tolist(), strict=True)}):
                part = batch.take(pa.array(np.flatnonzero((n == dim) & (bits == k))))
                unit = unit_rows(part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                many = bands_for(k, threshold)
                signs, factors = zip(*[encode(unit, rotation(dim, r)) for r in range(max(2, -(-many * k // dim)))], strict=True)
                code = np.concatenate([np.packbits(s, axis=1) for s in signs[:2]], axis=1)
                if k:
                    flat = np.concatenate(signs, axis=1)[:, : many * k].reshape(len(unit), many, k)
                    bands = (flat << np.arange(k, dtype=np.int32)).sum(2).astype(np.int32)
                else:
                    bands = np.zeros((len(unit), 1), np.int32)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * many)
                yield pa.RecordBatch.from_arrays(
                    [column("label"), column("n").cast(pa.int32()), column("key"), column("m"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factors[0], pa.float32()), pa.array(factors[1], pa.float32()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                    schema=schema,
                )

    return classes.mapInArrow(make, _CODE)


_GROUP = ["label", "n", "band", "value", "x", "y"]


def _pairs(table: pa.Table, threshold: float):
    """For each block pair of a table: (rows of the left block, rows of the right one, is it one block, places of candidates in both)."""
    column = lambda c: table.column(c).combine_chunks()
    left, factors = column("left").to_numpy(zero_copy_only=False), np.stack([column("f0").to_numpy(), column("f1").to_numpy()], axis=1)
    key, code, bands = column("key").to_numpy(), column("code"), column("bands")
    frame = table.select(_GROUP).to_pandas()
    for (_, n, band, _, x, y), at in frame.groupby(_GROUP, sort=False).indices.items():
        at = at[np.argsort(key[at], kind="stable")]
        same = x == y
        a = at if same else at[left[at]]
        b = a if same else at[~left[at]]
        if not len(a) or not len(b) or (same and len(a) < 2):
            continue

        def codes(rows: np.ndarray) -> Codes:
            packed = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in code.take(pa.array(rows))])
            return Codes(packed, factors[rows], int(n))  # noqa: B023

        ca = codes(a)
        i, j = candidates(ca, ca if same else codes(b), threshold, same)
        if band and len(i):
            # a pair counts in the first band in which it agrees
            get = lambda rows: bands.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)[:, : int(band)]  # noqa: B023, E731
            new = ~(get(a[i]) == get(b[j])).any(1)
            i, j = i[new], j[new]
        if len(i):
            yield a, b, same, i, j


def embedding_neardups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = BLOCK, whole: int = WHOLE
) -> DataFrame:
    """Return id, n_links, component_id (smallest id reachable, itself included), kept (is that smallest id itself).

    Vectors with equal labels that are not null are compared by cosine in double precision; pairs with cosine >=
    threshold are linked. Vectors that are null, empty, zero or hold null or non-finite components, those with a null
    label, and vectors of different lengths link with nothing (of each other). Equal vectors are linked always.
    Repeated rows are vectors of their own with the same id. Null ids keep their rows, as a smallest id only where no
    other is reached. Other columns are ignored; an empty table gives an empty one. Vectors are named by two 64-bit
    hashes together. See the module's text for the chance of missing a link; none below the threshold is made.
    """
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    kind = vectors.schema[vec_col].dataType.elementType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(T.ArrayType(kind)).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value: adding 0.0 makes equal vectors equal as keys
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn("v", F.when(F.col("_ok"), F.transform("v", lambda x: x + F.lit(0.0).cast(kind))))
    rows = rows.select("_id", "label", "v", "_ok", *[F.when(F.col("_ok"), F.xxhash64(F.lit(k), "label", "v")).alias(f"h{k}") for k in (1, 2)])
    # equal vectors: one class each, named by its smallest id; partial sums before the shuffle keep large classes small
    classes = rows.filter("_ok").groupBy("label", "v", "h1", "h2").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("m"))
    classes = classes.select("*", F.size("v").alias("n"), F.monotonically_increasing_id().alias("key")).checkpoint()
    bits = F.when(F.col("g") <= block * whole, F.lit(0)).otherwise(F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.col("g") / block)))).cast("int")
    groups = classes.groupBy("label", "n").agg(F.count(F.lit(1)).alias("g")).select("label", "n", bits.alias("bits"))
    codes = code_table(classes.select("label", "n", "key", "m", "v").join(groups, ["label", "n"]), threshold).checkpoint()
    release(spark)
    dealt = codes.select("*", F.posexplode("bands").alias("band", "value"))
    buckets = dealt.groupBy("label", "n", "band", "value").agg(F.count(F.lit(1)).alias("c"))
    total = buckets.agg(F.sum(F.col("c") * F.ceil(F.col("c") / block))).first()[0] or 0
    slots = max(1, total // (4 * block))
    large = buckets.filter(F.col("c") > block).select("label", "n", "band", "value", F.ceil(F.col("c") / block).alias("s"))
    # block b meets every block from b on: as the left side for (b, k), as the right one for (k, b)
    dealt = dealt.join(large, ["label", "n", "band", "value"], "left").withColumn("s", F.coalesce("s", F.lit(1).cast("long")))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("key"), F.col("s"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    dealt = dealt.select("label", "n", "key", "m", "code", "f0", "f1", "bands", "band", "value", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), (F.col("b") <= F.col("o")).alias("left"))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64(*_GROUP), F.lit(slots)))
    fields = dealt.schema

    def screen(table: pa.Table) -> pa.Table:
        kept = np.zeros(table.num_rows, bool)
        for a, b, _, i, j in _pairs(table, threshold):
            kept[a[i]] = kept[b[j]] = True
        return table.filter(pa.array(kept))

    def verify(table: pa.Table) -> pa.Table:
        key, m = table.column("key").to_numpy(), table.column("m").to_numpy()
        v = table.column("v").combine_chunks()
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b, same, i, j in _pairs(table, threshold):
            unit = lambda rows: unit_rows(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1))
            p = unit(a)
            q = p if same else unit(b)
            hits = [np.einsum("ij,ij->i", p[i[k : k + 65536]], q[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
            hit = np.concatenate(hits)
            i, j = i[hit], j[hit]
            na, nb = np.bincount(i, weights=m[b][j], minlength=len(a)), np.bincount(j, weights=m[a][i], minlength=len(b))
            shift = 0 if same else len(a)
            f = _forest(i, j + shift, len(a) + shift + len(b))
            out += [(key[a[i[f]]], key[b[j[f]]], np.zeros(len(f))), (key[a[na > 0]], key[a[na > 0]], na[na > 0]), (key[b[nb > 0]], key[b[nb > 0]], nb[nb > 0])]
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k, c in enumerate(("key", "other", "links"))})

    met = dealt.groupBy("slot").applyInArrow(screen, fields).checkpoint()
    release(spark)
    met = met.join(classes.select("key", "v"), "key")
    found = met.groupBy("slot").applyInArrow(verify, "key long, other long, links long").checkpoint()
    links = found.groupBy("key").agg(F.sum("links").alias("_l"))
    linked = connected_components(found.filter("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
    # the smallest id of a component, from the smallest ids of its classes
    small = classes.select("key", "h1", "h2", "m", "least")
    heads = small.join(linked, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "key"))
    least = heads.groupBy("comp").agg(F.min("least").alias("_least"))
    info = heads.select("key", "h1", "h2", "m", "comp").join(least, "comp").join(links, "key", "left")
    info = info.select(F.col("h1").alias("_i1"), F.col("h2").alias("_i2"), "_least", (F.coalesce("_l", F.lit(0)) + F.col("m") - 1).alias("_links"))
    out = rows.select("_id", "h1", "h2").join(info, (F.col("h1") == F.col("_i1")) & (F.col("h2") == F.col("_i2")), "left")
    component = F.coalesce("_least", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept")
    )
