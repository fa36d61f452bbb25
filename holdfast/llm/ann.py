"""Approximate nearest neighbours by collision counting over query-centred windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.store import materialize


@dataclass(frozen=True)
class Windows:
    """Parameters. Each block of ``block_rows`` vectors (at most 65 535) has ``projections`` sorted arrays, or
    as many as vectors have components. A vector is verified once it stands in the windows of ``threshold`` of
    them (a share). Half-widths start at ``first`` standard deviations and grow by ``growth`` until ``share``
    of the block is verified, and 15 times as many as are asked for."""

    projections: int = 64
    threshold: float = 0.85
    share: float = 0.05
    first: float = 1.3
    growth: float = 1.12
    block_rows: int = 8192
    query_rows: int = 4096
    seed: int = 11


def takes_part(embedding: str) -> Column:
    """Whether a vector (an array of doubles) is not null, not zero and of finite components only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, vec_id: str, embedding: str, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part: not null, not zero, of finite components
    only, and of the given or the commonest length."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & takes_part("embedding"))
    if dim is None:
        lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = lengths[0] if lengths else 0
    return v.where(F.size("embedding") == dim)


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, top: float, k: int, p: Windows, copies: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` nearest found of each query in one block; ``top``: the largest squared norm anywhere.

    Largest inner product becomes smallest distance by one more component, which fills every vector up to the
    same norm and is 0 in queries. Each of the orthogonal projections of the block is a sorted array; a query's
    window around its own projection is a run of ranks in it. Where too few vectors collide in enough windows, the
    windows widen step by step at both ends and only the new ends are counted (virtual rehashing). First windows are
    as wide as nearly all queries before needed. Vectors in enough windows are verified with their inner product.
    ``copies``: rows alike in id and vector that each row of the block stands for (else 1); ``copies`` of the result are
    those other than the query's own row.
    """
    copies = np.ones(len(ids), np.int64) if copies is None else copies
    n, size = x.shape
    axes = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((size + 1, size + 1)))[0][:, : p.projections]
    m = axes.shape[1]
    lifted = np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]) @ axes
    order = np.ascontiguousarray(np.argsort(lifted, axis=0, kind="stable").T)
    sorted_ = np.take_along_axis(lifted.T, order, 1)
    ranks = np.empty((m, n), np.uint16)
    np.put_along_axis(ranks, order, np.arange(n, dtype=np.uint16)[None, :], 1)
    center, spread = q @ axes[:-1], lifted.std(0)
    least, enough = int(np.ceil(p.threshold * m)), min(n, max(15 * k, int(np.ceil(p.share * n))))
    out, first = [], p.first
    low, high = np.empty((32, m), np.int64), np.empty((32, m), np.int64)

    def window(i: int, width: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = center[i] - width * spread, center[i] + width * spread
        return np.array([np.searchsorted(sorted_[j], a[j], "left") for j in range(m)]), np.array([np.searchsorted(sorted_[j], b[j], "right") for j in range(m)])

    for a in range(0, len(q), 32):
        block = range(a, min(a + 32, len(q)))
        hits, widths = np.zeros((len(block), n), np.uint8), []
        for j in range(m):
            low[: len(block), j] = np.searchsorted(sorted_[j], center[a : a + 32, j] - first * spread[j], "left")
            high[: len(block), j] = np.searchsorted(sorted_[j], center[a : a + 32, j] + first * spread[j], "right")
            lo, wide = low[: len(block), j].astype(np.uint16), (high - low)[: len(block), j]
            hits += (ranks[j] - lo[:, None]) < np.minimum(wide, 65535).astype(np.uint16)[:, None]
        for row, i in enumerate(block):
            width, lo, hi = first, low[row], high[row]
            while np.count_nonzero(hits[row] >= least) < enough and width <= 20:
                width *= p.growth
                new_lo, new_hi = window(i, width)
                ends = [order[j, s:e] for j in range(m) for s, e in ((new_lo[j], lo[j]), (hi[j], new_hi[j])) if s < e]
                if ends:
                    hits[row] += np.bincount(np.concatenate(ends), minlength=n).astype(np.uint8)
                lo, hi = new_lo, new_hi
            widths.append(width)
            at = np.flatnonzero(hits[row] >= least) if width <= 20 else np.arange(n)
            own = (ids[at] == q_ids[i]) & (x[at] == q[i]).all(1)
            many = copies[at] - own
            at, many = at[many > 0], many[many > 0]  # all but the query's own row
            score = x[at] @ q[i]
            if len(at) > k:
                keep = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score, many = at[keep], score[keep], many[keep]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), i), ids[at[best]], score[best], many[best]))
        first = max(p.first, float(np.quantile(widths, 0.2)) / p.growth) if max(widths) <= 20 else p.first
    parts = list(zip(*out, strict=True)) or [(), (), (), ()]
    cat = lambda part, kind: np.concatenate([np.zeros(0, kind), *part])
    return pd.DataFrame({"query": cat(parts[0], np.int64), "vec_id": cat(parts[1], np.int64), "score": cat(parts[2], np.float64), "copies": cat(parts[3], np.int64)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", params: Windows = Windows()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query among the rows of
    ``vectors`` other than its own, ties to smaller vec_id.

    Vectors are dealt by hash into blocks of about ``block_rows`` and queries into blocks of ``query_rows``;
    each pair of blocks is one task of bounded size. Recall is that of the window parameters; every vector is
    indexed. Null, zero, non-finite and odd-length vectors take no part; rows alike in id and vector are candidates each
    and give repeated results, though they are compared once; different vectors with one vec_id are candidates of each
    other's queries too; queries without any candidate give no rows.
    """
    grouped = lambda v: v.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))
    base = materialize(grouped(usable(vectors, vec_id, embedding)))
    stats = base.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    asked = materialize(grouped(usable(queries, vec_id, embedding, stats[1] or 0)).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "embedding", F.col("copies").alias("asked")))
    blocks, q_blocks, top = -(-(stats[0] or 1) // params.block_rows), -(-max(asked.count(), 1) // params.query_rows), float(stats[2] or 0)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = base.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), every(q_blocks, "q_block"), "vec_id", "embedding", "copies")
    right = asked.select(every(blocks, "block"), F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int").alias("q_block"), "query", "query_id", "embedding", "asked")

    names = ["query", "query_id", "asked", "vec_id", "score", "copies"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: np.zeros(0, np.float64 if c == "score" else np.int64) for c in names})
        a, b = a.sort_values("vec_id", kind="stable"), b.sort_values("query")
        x, q = np.stack(a["embedding"].to_list()), np.stack(b["embedding"].to_list())
        found = search_block(x, a["vec_id"].to_numpy(), q, b["query_id"].to_numpy(), top, k, params, a["copies"].to_numpy())
        place = found["query"].to_numpy()
        return found.assign(**{c: b[c].to_numpy()[place] for c in ("query", "query_id", "asked")})[names]

    found = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInPandas(run, "query long, query_id long, asked long, vec_id long, score double, copies long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # k different rows hold the k nearest
    ahead = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = ranked.withColumn("ahead", ahead).where(F.col("ahead") < k).withColumn("rank", F.explode(F.sequence((F.col("ahead") + 1).cast("int"), F.least(F.lit(k), F.col("ahead") + F.col("copies")).cast("int"))))
    repeated = F.explode(F.array_repeat("rank", F.col("asked").cast("int")))
    return each.select("query_id", repeated.alias("rank"), "vec_id", "score")
