"""Size-bounded bin assignment.

Next-fit is a fold in order whose state is two numbers: the rows, only (class, seq, cost) wide, stream through one task
in order and each batch is cut by binary search in its running sums, so a row costs some nanoseconds. First-fit
decreasing depends on costs alone, so it is folded over (cost, count) pairs, of which there are few, and the items
look up their bin by their rank within a cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s


class NextFit:
    """State of the fold: bins opened so far, room taken in the open one (None: no bin is open)."""

    def __init__(self, target: int):
        if target <= 0:
            raise ValueError("the target size must be positive")
        self.target, self.bins, self.used = target, 0, None

    def assign(self, costs: np.ndarray) -> np.ndarray:
        """Bins of the next items."""
        costs = np.asarray(costs, np.int64)
        out = np.empty(len(costs), np.int64)
        total = np.concatenate(([0], np.cumsum(costs)))
        large = np.concatenate((np.flatnonzero(costs > self.target), [len(costs)]))
        i, k = 0, 0
        while i < len(costs):
            if i == large[k]:
                out[i], self.used = self.bins, None
                self.bins, i, k = self.bins + 1, i + 1, k + 1
                continue
            if self.used is None or self.used + costs[i] > self.target:
                self.bins, self.used = self.bins + 1, 0
            room = total[i] + self.target - self.used
            j = min(int(large[k]), int(np.searchsorted(total, room, "right")) - 1)
            out[i:j] = self.bins - 1
            self.used += int(total[j] - total[i])
            i = j
        return out


def ffd_runs(costs: list[int], counts: list[int], target: int) -> list[tuple[int, int, int, int]]:
    """First-fit decreasing over distinct costs with their counts.

    Returns (cost, first rank, end rank, bin): items of one cost are filled into the lowest bins with room, in rank
    order. Items above the target get a full bin each.
    """
    if target <= 0:
        raise ValueError("the target size must be positive")
    group = 256
    room: list[int] = []
    most: list[int] = []  # largest room in each group of bins
    out = []

    def put(b: int, value: int) -> None:
        if b == len(room):
            room.append(value)
            if b % group == 0:
                most.append(value)
            else:
                most[-1] = max(most[-1], value)
            return
        room[b] = value
        g = b // group
        most[g] = max(room[g * group : (g + 1) * group])

    for cost, count in sorted(zip(costs, counts, strict=True), reverse=True):
        rank, at = 0, 0
        while rank < count:
            b = None
            for g in range(at // group, len(most)):
                if most[g] >= cost:
                    b = next((x for x in range(max(at, g * group), min(len(room), (g + 1) * group)) if room[x] >= cost), None)
                    if b is not None:
                        break
            if b is None:
                b, space = len(room), target if cost <= target else cost
                at = b
            else:
                space, at = room[b], b
            n = count - rank if cost == 0 else min(count - rank, space // cost)
            put(b, space - n * cost)
            out.append((cost, rank, rank + n, b))
            rank += n
    return out


def bins_next_fit(items: DataFrame, target: int) -> DataFrame:
    """Add `bin` by next-fit to items (cls, seq, cost, ...), each class for itself in the order of seq, from 0."""
    if target <= 0:
        raise ValueError("the target size must be positive")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, name = None, None
        for batch in batches:
            cls = np.asarray(batch.column(0).to_pylist(), object)
            costs = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(cls[1:] != cls[:-1]) + 1).tolist(), len(cls)]
            bins = np.empty(len(cls), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if state is None or cls[a] != name:
                    state, name = NextFit(target), cls[a]
                bins[a:b] = state.assign(costs[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], ["cls", "seq", "bin"])

    order = items.select("cls", F.col("seq").cast("long").alias("seq"), F.col("cost").cast("long").alias("cost"))
    # one task: the fold's state is two numbers, and the rows that stream through it are three columns wide
    order = order.repartition(1).sortWithinPartitions("cls", "seq")
    return items.join(order.mapInArrow(fold, "cls string, seq long, bin long"), ["cls", "seq"])


def bins_ffd(items: DataFrame, target: int) -> DataFrame:
    """Add `bin` by first-fit decreasing to items (cls, seq, cost, ...), each class for itself; ties go by seq."""
    if target <= 0:
        raise ValueError("the target size must be positive")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = ffd_runs(pdf["cost"].tolist(), pdf["n"].tolist(), target)
        out = pd.DataFrame(runs, columns=["cost", "lo", "hi", "bin"])
        out.insert(0, "cls", pdf["cls"].iloc[0])
        return out

    counts = items.groupBy("cls", F.col("cost").cast("long").alias("cost")).agg(F.count(F.lit(1)).alias("n"))
    runs = counts.groupBy("cls").applyInPandas(fold, "cls string, cost long, lo long, hi long, bin long")
    rank = F.row_number().over(Window.partitionBy("cls", "cost").orderBy("seq")) - 1
    return items.withColumn("_rank", rank).join(runs, ["cls", "cost"]).filter("_rank >= lo and _rank < hi").drop("_rank", "lo", "hi")


def bins_by_class(items: DataFrame, target: int, algorithm: str = "next-fit") -> DataFrame:
    """Add `bin`, numbered over all classes: those of class `normal` first, then those of `store`."""
    binned = {"next-fit": bins_next_fit, "ffd": bins_ffd}[algorithm](items, target)
    sizes = binned.groupBy("cls").agg((F.max("bin") + 1).alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("cls", shift.alias("_shift"))  # one row per class
    return binned.join(F.broadcast(sizes), "cls").withColumn("bin", F.col("bin") + F.col("_shift")).drop("_shift")


def pack_items(objects: DataFrame, bits=None) -> DataFrame:
    """Objects as items: cost by size, class by entropy (all normal without bits)."""
    from ..functions.entropy import storage_class

    cls = storage_class(bits) if bits is not None else F.lit("normal")
    return objects.withColumn("cost", s.entry_cost(F.col("size"))).withColumn("cls", cls)


def pack_layout(binned: DataFrame, first_pack: int) -> DataFrame:
    """(pack, n_members, total_cost, members as one string in packing order) of each bin."""
    member = F.struct("seq", "object_id", "path")
    rows = binned.groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("n_members"), F.sum("cost").cast("long").alias("total_cost"), F.array_sort(F.collect_list(member)).alias("_m"))
    text = F.array_join(F.transform("_m", lambda m: F.concat(m["object_id"], F.lit("="), m["path"])), ";")
    return rows.select(s.pack_name(F.col("bin") + first_pack).alias("pack"), "n_members", "total_cost", text.alias("members"))


