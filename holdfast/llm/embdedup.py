"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.ann import takes_part
from holdfast.llm.graph import components, forest
from holdfast.llm.store import broadcast_if_small, join_hot, materialize


@dataclass(frozen=True)
class Cells:
    """Parameters. One cell per ``cell_rows`` vectors, ``most_cells`` at most (their centres are broadcast),
    fitted on at most ``sample`` vectors; products are made in blocks of at most ``block_rows`` squared."""

    least_cosine: float = 0.98
    cell_rows: int = 8192
    most_cells: int = 4096
    sample: int = 8192
    passes: int = 8
    block_rows: int = 2048
    seed: int = 3


def spherical_kmeans(x: np.ndarray, k: int, passes: int, seed: int) -> np.ndarray:
    """Unit centres of ``k`` cells of the unit vectors ``x``."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(passes):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _apart(centres: np.ndarray) -> np.ndarray:
    """Distances of unit centres from each other."""
    return np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))


def _cells(unit: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's own, for each cell that holds a row or may hold a neighbour of it.

    A vector whose distance to the border between its own cell and another is over ``reach`` has no vector
    within ``reach`` on the other side."""
    near = unit @ centres.T
    own = near.argmax(1)
    gap = near[np.arange(len(unit)), own][:, None] - near
    row, cell = np.nonzero(gap <= (reach + 1e-9) * apart[own] + 1e-12)
    return row, cell, cell == own[row]


def links(distinct: DataFrame, params: Cells = Cells()) -> DataFrame:
    """(id, links, root) rows over ``distinct`` (id, label, w copies, unit vector; one row for each different
    vector of a label). The sum of links by id is the number of other rows' copies within ``least_cosine`` of
    it; (id, root) pairs join all that are linked.

    Every vector is compared, in its own cell, with all vectors of its label that stand in the cell or come
    close enough to its border, so no link is lost. Cells are those of the commonest length of vectors; vectors of
    another length are compared with all of their length and label. Labels are told apart as text.
    """
    spark = distinct.sparkSession
    lengths = distinct.groupBy(F.size("unit").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (lengths[0], lengths[1]) if lengths else (0, 0)
    k = min(max(1, n // params.cell_rows), params.most_cells)
    sample = distinct.where(F.size("unit") == size).select("unit", F.xxhash64("id", F.lit(params.seed)).alias("h")).orderBy("h").limit(params.sample).toPandas()["unit"].to_list()
    schema = "id long, label string, w long, unit array<double>, cell int, own boolean"
    if not sample:
        return spark.createDataFrame([], "id long, links long, root long")
    centres = spark.sparkContext.broadcast(spherical_kmeans(np.stack(sample), k, params.passes, params.seed))
    reach = float(np.sqrt(2 - 2 * params.least_cosine))

    def place(parts):
        apart = _apart(centres.value)  # once a task
        for pdf in parts:
            usual = pdf["unit"].map(len).to_numpy() == size
            if not usual.all():
                yield pdf[~usual].assign(cell=np.int32(-1), own=True)
            if usual.any():
                pdf = pdf[usual]
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a : a + 1024]
                    row, cell, own = _cells(np.stack(part["unit"].to_list()), centres.value, apart, reach)
                    yield part.iloc[row].assign(cell=cell.astype(np.int32), own=own)

    label = F.concat(F.size("unit").cast("string"), F.lit(":"), F.col("label").cast("string"))
    placed = distinct.select("id", label.alias("label"), "w", "unit").mapInPandas(place, schema)
    placed = materialize(placed)
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count_if("own") / params.block_rows).cast("int").alias("own_blocks"), F.ceil(F.count("*") / params.block_rows).cast("int").alias("blocks")).where("own_blocks > 0")
    dealt = placed.join(broadcast_if_small(blocks), ["label", "cell"])
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    home = dealt.where("own").select("label", "cell", part("own_blocks").alias("i"), every("blocks", "j"), "id", "w", "unit")
    again = lambda c: F.col(c).alias(c)  # noqa: E731  both sides come from one table; columns of their own tell them apart
    other = dealt.select(again("label"), again("cell"), every("own_blocks", "i"), part("blocks").alias("j"), again("id"), again("w"), again("unit"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        x, y = np.stack(a["unit"].to_list()), np.stack(b["unit"].to_list())
        near = x @ y.T >= params.least_cosine
        ids_a, ids_b, w = a["id"].to_numpy(), b["id"].to_numpy(), b["w"].to_numpy()
        near &= ids_a[:, None] != ids_b[None, :]
        count = near @ w
        ids = np.unique(np.concatenate([ids_a, ids_b]))  # ascending, so the smallest place is the smallest id
        p, q = np.nonzero(near)
        root = forest(len(ids), np.searchsorted(ids, ids_a[p]), np.searchsorted(ids, ids_b[q]))
        inner = np.flatnonzero(root != np.arange(len(ids)))
        some = np.flatnonzero(count)
        return pd.DataFrame({"id": np.concatenate([ids_a[some], ids[inner]]), "links": np.concatenate([count[some], np.zeros(len(inner), np.int64)]), "root": np.concatenate([ids_a[some], ids[root[inner]]])})

    keys = ["label", "cell", "i", "j"]
    return home.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(compare, "id long, links long, root long")


def _unit(vector: Column) -> Column:
    """The unit vector of a vector that is not zero. It is divided by its largest component first, so that no square
    overflows or vanishes. ``bound`` evaluates a value once for all components."""
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    divided = lambda v, by: F.transform(v, lambda x: x / by)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    largest = F.array_max(F.transform(vector, F.abs))
    return bound(bound(largest, lambda m: divided(vector, m)), lambda v: bound(norm(v), lambda n: divided(v, n)))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", params: Cells = Cells()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors of one label, not null, and one length link at ``least_cosine`` or more. component_id is the smallest
    vec_id reachable, itself included; kept marks those. Copies of a vector are one node, counted but never compared
    with each other. Null, zero and non-finite vectors link with nothing, rows without label or vec_id too; all others
    can, as tiny or huge as they are: vectors are divided by their largest component before they are squared. Every
    row gives one row, whatever other rows share its vec_id; repeated vec_ids count as vectors each.
    """
    rows = materialize(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label")))
    links_at_all = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & takes_part("embedding")
    good = rows.where(links_at_all)
    groups = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()))
    unit = groups.select("id", "label", "w", _unit(F.col("embedding")).alias("unit"))
    found = materialize(links(unit, params))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = groups.join(counted, "id", "left").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    known = materialize(known.select("label", "embedding", "lowest", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    least = materialize(known.groupBy("component").agg(F.min("lowest").alias("component_id"), F.count("*").alias("n")))
    of = materialize(join_hot(known, least, ["component"]).select("label", "embedding", "n_links", "component_id", F.col("w").alias("n")))
    linked = join_hot(good, of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~links_at_all).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
