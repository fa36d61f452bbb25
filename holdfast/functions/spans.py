"""Order statistics of very many windows of series, by blocks of time: no pair of a window and a value is made."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.ranges import PART, PLACE, ranged
from holdfast.functions.tables import broadcast_if_small, written

#: Values of a block, and windows that one task answers from it, about.
BLOCK_ROWS = 1 << 19
_FOUND = ["n", "unusable", "low", "high", "less", "below", "above"]


class Ordered:
    """Values in order of time: ranks of their values by bits (a wavelet matrix), so that the k-th value of any run and the
    number of its values below a bound take a step a bit, for all windows at once."""

    def __init__(self, t: np.ndarray, v: np.ndarray):
        order = np.argsort(t, kind="stable")
        self.every, v = t[order], v[order]
        good = np.isfinite(v)
        self.t, v = self.every[good], v[good]
        order = np.argsort(v, kind="stable")
        self.sorted = v[order]
        rank = np.empty(len(v), np.int64)
        rank[order] = np.arange(len(v))
        self.bits = max(len(v) - 1, 1).bit_length()
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (rank >> b & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            rank = np.append(rank[~one], rank[one])

    def kth(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` among those from i to j, NaN where there is none."""
        there = (k >= 0) & (k < j - i)
        k, found = np.where(there, k, 0), np.zeros(len(i), np.int64)
        for zeros in self.zeros:
            a, e = zeros[i].astype(np.int64), zeros[j].astype(np.int64)
            up = k >= e - a
            k = np.where(up, k - (e - a), k)
            i, j = np.where(up, zeros[-1] + i - a, a), np.where(up, zeros[-1] + j - e, e)
            found = found * 2 + up
        return np.where(there, self.sorted[np.where(there, found, 0)], np.nan) if len(self.sorted) else np.full(len(i), np.nan)

    def less(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values from i to j are below ``bound``."""
        r = np.searchsorted(self.sorted, bound, "left")
        every, count = np.where(r >= len(self.sorted), j - i, 0), np.zeros(len(i), np.int64)
        within = r < len(self.sorted)
        for level, zeros in enumerate(self.zeros):
            a, e = zeros[i].astype(np.int64), zeros[j].astype(np.int64)
            up = (r >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(up, e - a, 0)
            i, j = np.where(up, zeros[-1] + i - a, a), np.where(up, zeros[-1] + j - e, e)
        return np.where(within, count, every)

    def windows(self, t0: np.ndarray, t1: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """_FOUND of closed windows."""
        i, j = np.searchsorted(self.t, t0, "left"), np.searchsorted(self.t, t1, "right")
        n = np.searchsorted(self.every, t1, "right") - np.searchsorted(self.every, t0, "left")
        less = self.less(i, j, bound)
        return [n, n - (j - i), self.kth(i, j, np.zeros(len(i), np.int64)), self.kth(i, j, j - i - 1), less, self.kth(i, j, less - 1), self.kth(i, j, less)]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, part, asked): the values of a block are held, its windows pass."""
    key, held, block = None, [], None
    for batch in batches:
        a, b, v, of, part, asked, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "v", "block", "part", "asked", "id"))
        new = (of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (asked[1:] != asked[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(of)] if len(of) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if key != (of[x], part[x]):
                key, held, block = (of[x], part[x]), [], None
            if not asked[x]:
                held.append((a[x:y], v[x:y]))
                continue
            if block is None:
                block = Ordered(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held = []
            found = block.windows(a[x:y], b[x:y], v[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(c) if c.dtype.kind == "i" else pa.array(c, from_pandas=True) for c in (name[x:y], *found)], ["id", *_FOUND])


def window_orders(points: DataFrame, windows: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, unusable, low, high, less, below, above) of each of ``windows`` (id, key, t0, t1, closed, bound) that meets any of
    ``points`` (key, t, value): how many rows, how many of them no finite number, the smallest and largest value, how
    many values are below the window's bound, the largest of these and the smallest of the others.

    Points are dealt into blocks by ranges of (key, t, value); a window is a row for each block that it meets, and what is
    found in these is added up. So the work grows with points and windows, not with their pairs, however many points a
    window holds. A block that very many windows meet is answered in several tasks.
    """
    dated = points.select(key, "t", F.col("value").cast("double").alias("value")).where(F.col("t").isNotNull() & F.col(key).isNotNull())
    n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(dated.count() / block_rows))
    placed = ranged(dated, [key], ["t", "value"], n)
    blocks = written(placed.groupBy(key, PART).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min(PLACE).alias("block")).coalesce(1))
    reach = F.broadcast(blocks.select(key, "block", "first", "last"))  # a row per block: keys and ranges together at most
    met = written(windows.where("t1 >= t0").join(reach, key).where("t0 <= last and t1 >= first").select("id", "block", "t0", "t1", F.coalesce(F.col("bound").cast("double"), F.lit(float("nan"))).alias("bound")))
    parts = written(met.groupBy("block").agg(F.ceil(F.count("*") / block_rows).alias("parts")))
    asked = met.join(broadcast_if_small(parts), "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(1).alias("asked"), "id", F.col("t0").alias("a"), F.col("t1").alias("b"), F.col("bound").alias("v"))
    named = blocks.join(parts, "block").select(key, PART, "block", F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("part"))
    held = placed.join(broadcast_if_small(named), [key, PART]).withColumn("part", F.explode("part"))
    held = held.select("block", "part", F.lit(0).alias("asked"), F.lit(0).cast("long").alias("id"), F.col("t").alias("a"), F.col("t").alias("b"), F.coalesce("value", F.lit(float("nan"))).alias("v"))
    dealt = held.union(asked).repartition(n, "block", "part").sortWithinPartitions("block", "part", "asked")
    found = dealt.mapInArrow(_answered, "id long, n long, unusable long, low double, high double, less long, below double, above double")
    sums = [F.sum(c).alias(c) for c in ("n", "unusable", "less")]
    return found.groupBy("id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.max("below").alias("below"), F.min("above").alias("above")).select("id", *_FOUND)
