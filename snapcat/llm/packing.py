"""Best-fit packing into bins of several permitted capacities.

Documents are cut into pieces of at most the largest capacity and dealt to shards by a hash of their id; the pieces of
a shard are packed by one task, so memory is bounded by the shard. Pieces go by falling size. A piece goes to the open
bin with the least room left that still holds it. If none does, a new bin is opened at the capacity with the least
cost a token: each permitted capacity is priced as if it were filled on from the pieces still waiting, and the one
whose cost (capacity + a fixed cost a bin) per token placed is least is opened. At the end every bin is downsized to
the smallest permitted capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import checkpoint_dir

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 16
SHARD_PIECES = 8192


class _Waiting:
    """Counts of the sizes still waiting, with the largest size up to a bound."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, counts = np.unique(sizes, return_counts=True)
        self.counts = dict(zip(self.sizes.tolist(), counts.tolist(), strict=True))
        self.live = self.sizes.tolist()

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            del self.live[bisect_left(self.live, size)]

    def fill(self, room: int, rest: dict[int, int]) -> int:
        """Tokens that a greedy fill by falling size would place in `room`, without taking them."""
        placed, at = 0, len(self.live)
        while room > 0:
            at = bisect_left(self.live, room + 1, 0, at) - 1
            if at < 0:
                break
            size = self.live[at]
            n = min(room // size, self.counts[size] - rest.get(size, 0))
            placed += n * size
            room -= n * size
            if at == 0:
                break
        return placed


def pack_sizes(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[np.ndarray, list[int]]:
    """(bin of each piece, capacity of each bin) for pieces of at most the largest capacity; order breaks ties.

    Pieces of size 0 share bins like any other and take no room.
    """
    sizes = np.asarray(sizes, np.int64)
    caps = sorted(capacities)
    bins = np.full(len(sizes), -1, np.int64)
    used: list[int] = []
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    waiting = _Waiting(sizes[sizes > 0])
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        size = int(sizes[i])
        at = bisect_left(open_, (size, -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            best = None
            for cap in caps:
                if cap >= size:
                    tokens = size + waiting.fill(cap - size, {size: 1})
                    cost = (cap + bin_cost) / max(tokens, 1)
                    if best is None or cost < best[0]:
                        best = (cost, cap)
            room, b = best[1], len(used)
            used.append(0)
        bins[i] = b
        used[b] += size
        if room > size or not size:
            insort(open_, (room - size, b))
        if size:
            waiting.take(size)
    return bins, [caps[bisect_left(caps, u)] for u in used]


def pack_documents(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    bin_cost: int = BIN_COST,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Return a row per piece: id, piece (from 0), start, n_tokens, shard, bin, capacity, used (tokens in the bin).

    A document above the largest capacity is cut into pieces of that size and a rest, so nothing is lost. Size 0 or
    null (null and empty texts) makes no piece. Bins are numbered within a shard. Null ids and
    repeated rows are packed each for itself; ties go by (id, copy, piece), so reruns agree. An empty table gives an
    empty one; other columns are ignored. Shards hold about `shard_pieces` pieces: their number follows the data, ids
    are spread by a hash salted with the piece, so neither a long document nor a repeated id fills one.
    """
    most = max(capacities)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("_n")).filter("_n > 0")
    # repeated rows are told apart by counting them
    checkpoint_dir(docs.sparkSession)
    rows = rows.groupBy("_id", "_n").agg(F.count(F.lit(1)).alias("_copies")).checkpoint()
    total = rows.agg(F.sum(F.col("_copies") * F.ceil(F.col("_n") / most))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))))
    rows = rows.select(
        "_id", "_copy", F.col("_piece").alias("piece"), (F.col("_piece") * most).alias("start"),
        F.least(F.col("_n") - F.col("_piece") * most, F.lit(most)).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("_id", "_copy", "_piece"), F.lit(shards)).alias("shard"),
    )
    caps = tuple(capacities)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_copy", "piece"], na_position="last", kind="stable").reset_index(drop=True)
        bins, made = pack_sizes(pdf["n_tokens"].to_numpy(), caps, bin_cost)
        pdf["bin"] = bins
        pdf["capacity"] = np.asarray(made, np.int64)[bins]
        pdf["used"] = np.bincount(bins, weights=pdf["n_tokens"], minlength=len(made)).astype(np.int64)[bins]
        return pdf

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, _copy long, piece long, start long, n_tokens long, shard long, bin long, capacity long, used long"
    out = rows.groupBy("shard").applyInPandas(pack, schema)
    return out.drop("_copy").withColumnRenamed("_id", id_col)


def packed_bins(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per bin: shard, bin, capacity, used, n_pieces, pieces (array of id, start, n_tokens, in packing order)."""
    item = F.struct((-F.col("n_tokens")).alias("k"), F.col(id_col), F.col("start"), F.col("n_tokens"))
    bins = pieces.groupBy("shard", "bin").agg(
        F.max("capacity").alias("capacity"), F.max("used").alias("used"), F.count(F.lit(1)).alias("n_pieces"), F.array_sort(F.collect_list(item)).alias("p")
    )
    return bins.select("shard", "bin", "capacity", "used", "n_pieces", F.transform("p", lambda p: p.dropFields("k")).alias("pieces"))


