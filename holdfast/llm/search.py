"""Ranked lexical search: exact top scores by a dual tree over items and documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.tables import broadcast_if_small, with_rank
from holdfast.llm.arrow import add_columns, mapped
from holdfast.llm.store import materialize
from holdfast.llm.textscan import CHUNK_BYTES, LOWER, chunks, column, packed_words

_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[97:123] = True


@dataclass(frozen=True)
class Search:
    """Parameters. ``k``: documents of an item. ``items``, ``item_bytes``: items handled at once and bytes of their terms
    together, at most (one item is handled whatever its size): they are broadcast; more items are searched block by
    block. ``group``: documents that a task holds as one tree. ``leaf``: documents of a leaf (a leaf of items is one item), ``sample``: documents whose
    scores give the first bounds, about so many."""

    k: int = 50
    items: int = 4096
    item_bytes: int = 16 << 20
    group: int = 8192
    leaf: int = 8
    sample: int = 4096


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    data = LOWER[data]
    return packed_words(data, _TERM[data], offsets)


def terms(rows: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """``rows`` with the different terms of each whole text, in order, instead of ``text``."""
    k = rows.columns.index(text)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        many, found = [], [pa.array([], pa.string())]
        for i, j, d, o in chunks(*column(batch.column(k))):
            words, row = _terms(d, o)
            for r in range(j - i):
                different = pc.unique(words.slice(*_slice(row, r)))
                many.append(len(different))
                found.append(different)
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.concat_arrays(found))]

    return add_columns(rows, one, [T.StructField(out, T.ArrayType(T.StringType()))], drop=(text,))


def _slice(row: np.ndarray, r: int) -> tuple[int, int]:
    a, b = np.searchsorted(row, [r, r + 1])
    return int(a), int(b - a)


def vectors(docs: DataFrame, known: list[str], text: str = "text") -> DataFrame:
    """``docs`` with n, the terms of each whole text, and of the terms in ``known`` (a bounded list, broadcast) which
    places of the list occur in it (term) and how often (tf), instead of ``text``."""
    k = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(known)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        asked = pa.array(held.value, pa.string())
        n, many, term, tf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, j, d, o in chunks(*column(batch.column(k)), limit=4 * CHUNK_BYTES):
            words, row = _terms(d, o)
            n.append(np.bincount(row, minlength=j - i))
            at = pc.index_in(words, value_set=asked).fill_null(-1).to_numpy().astype(np.int64)
            some = at >= 0
            pair, times = np.unique(row[some] * len(asked) + at[some], return_counts=True)
            many.append(np.bincount(pair // max(len(asked), 1), minlength=j - i))
            term.append((pair % max(len(asked), 1)).astype(np.int32))
            tf.append(times)
        off = pa.array(np.append(0, np.cumsum(np.concatenate(many))), pa.int32())
        return [pa.array(np.concatenate(n)), pa.ListArray.from_arrays(off, pa.array(np.concatenate(term))), pa.ListArray.from_arrays(off, pa.array(np.concatenate(tf)))]

    fields = [T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))]
    return add_columns(docs, one, fields, drop=(text,))


@dataclass
class Tree:
    """Rows in the order of a hierarchy of halves. ``levels``: from the root down, the first row of each node, and its
    coordinate maxima as sparse rows (at, cols, vals); node i of a level has nodes child[i] to child[i + 1] below."""

    order: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    child: list[np.ndarray]


def _gather(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some sparse rows, and how many each has."""
    many = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())), many


def _maxima(at: np.ndarray, cols: np.ndarray, vals: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest value of each coordinate over the rows of each node; ``first`` has the nodes' first rows and the end."""
    node = np.repeat(np.arange(len(first) - 1), np.diff(at[first]))
    key = node * size + cols
    by = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])) if len(by) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(vals[by], start) if len(by) else vals
    key = key[by][start]
    return np.searchsorted(key, np.arange(len(first)) * size), key % max(size, 1), top


def tree(at: np.ndarray, cols: np.ndarray, vals: np.ndarray, weight: np.ndarray, size: int, leaf: int) -> Tree:
    """A hierarchy of sparse rows. A node of more than ``leaf`` rows is halved along the coordinate whose weighted values
    vary most in it: the rows with the larger values there, and the others."""
    n = len(at) - 1
    order, first, levels, child = np.arange(n), np.array([0, n]), [], []
    while True:
        place, many = _gather(at, order)
        c, v = cols[place], vals[place]
        own = np.append(0, np.cumsum(many))
        levels.append((first, *_maxima(own, c, v, first, size)))
        rows = np.diff(first)
        if (rows <= leaf).all():
            return Tree(order, levels, child)
        node = np.repeat(np.arange(len(rows)), np.diff(own[first]))
        key, where = np.unique(node * size + c, return_inverse=True)
        x = (v * weight[c]).astype(np.float64)
        total, square = np.bincount(where, x, len(key)), np.bincount(where, x * x, len(key))
        of = key // size
        spread = square - total * total / rows[of]
        by = np.lexsort((-spread, of))
        best = by[np.flatnonzero(np.append(True, of[by][1:] != of[by][:-1]))]  # of each node that has any entry
        axis = np.full(len(rows), -1, np.int64)
        axis[of[best]] = key[best] % size
        value = np.zeros(n)
        entry = np.flatnonzero(c == axis[node])
        value[np.repeat(np.arange(n), many)[entry]] = x[entry]
        owner = np.repeat(np.arange(len(rows)), rows)
        by = np.lexsort((-value, owner))
        order = order[by]
        halves = np.where(rows > leaf, 2, 1)
        child.append(np.append(0, np.cumsum(halves)))
        cut = first[:-1] + rows // 2
        first = np.unique(np.concatenate([first, cut[rows > leaf]]))


class Best:
    """The ``k`` best rows of each item so far: larger score, then smaller id, then smaller row."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.found = [(np.zeros(0, np.int64),) * 2 for _ in floor]  # score, row
        self.weakest = np.maximum(floor, 1)  # a score of 0 is none

    def add(self, item: int, score: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.weakest[item]
        if not some.any():
            return
        s, r = np.concatenate([self.found[item][0], score[some]]), np.concatenate([self.found[item][1], rows[some]])
        by = np.lexsort((r, ids[r], -s))[: self.k]
        self.found[item] = s[by], r[by]
        if len(by) == self.k:
            self.weakest[item] = max(self.weakest[item], s[by[-1]])


def search(docs: tuple, ids: np.ndarray, items: tuple, item_tree: Tree, size: int, floor: np.ndarray, p: Search) -> Best:
    """The best of the documents ``docs`` (sparse rows at, cols, vals) for each of the ``items`` (alike), from ``floor``
    on, a score that each item reaches ``p.k`` times at least.

    Nodes of both trees go down together. The product of their coordinate maxima bounds the score of every pair below
    them; where it is less than the weakest kth score of the node's items, no pair below is looked at.
    """
    at, cols, vals = docs
    best = Best(floor, p.k)
    weight = np.zeros(size, np.int64)
    np.maximum.at(weight, items[1], items[2])
    hierarchy = tree(at, cols, vals, weight, size, p.leaf)
    dense = np.zeros(size, np.int64)

    def products(sparse: tuple, rows: np.ndarray) -> np.ndarray:
        """Of the vector in ``dense`` with some sparse rows."""
        place, many = _gather(sparse[0], rows)
        total = np.append(0, np.cumsum(dense[sparse[1][place]] * sparse[2][place]))
        end = np.cumsum(many)
        return total[end] - total[end - many]

    def bounds(level: int, node: int, deep: int, below: np.ndarray) -> np.ndarray:
        _, a, c, v = item_tree.levels[level]
        own = c[a[node] : a[node + 1]]
        dense[own] = v[a[node] : a[node + 1]]
        out = products(hierarchy.levels[deep][1:], below)
        dense[own] = 0
        return out

    def visit(level: int, node: int, deep: int, below: np.ndarray) -> None:
        first = item_tree.levels[level][0]
        of = item_tree.order[first[node] : first[node + 1]]
        limit = bounds(level, node, deep, below)
        near = limit >= best.weakest[of].min()
        below, limit = below[near], limit[near]
        if not len(below):
            return
        if level < len(item_tree.child):
            below, deeper = descend(deep, below)
            for child in range(item_tree.child[level][node], item_tree.child[level][node + 1]):
                visit(level + 1, child, deeper, below)
        elif deep < len(hierarchy.child):
            below, deeper = descend(deep, below)
            visit(level, node, deeper, below)
        else:
            below = below[np.argsort(-limit, kind="stable")]
            limit = np.sort(limit)[::-1]
            for a in range(0, len(below), 16):
                if limit[a] < best.weakest[of].min():
                    break
                compare(of, below[a : a + 16])

    def descend(deep: int, nodes: np.ndarray) -> tuple[np.ndarray, int]:
        if deep == len(hierarchy.child):
            return nodes, deep
        return _gather(hierarchy.child[deep], nodes)[0], deep + 1

    def compare(of: np.ndarray, leaves: np.ndarray) -> None:
        first = hierarchy.levels[-1][0]
        rows = hierarchy.order[_gather(first, leaves)[0]]
        for item in of.tolist():
            own = items[1][items[0][item] : items[0][item + 1]]
            dense[own] = items[2][items[0][item] : items[0][item + 1]]
            best.add(item, products(docs, rows), rows, ids)
            dense[own] = 0

    if len(at) > 1 and len(items[0]) > 1:
        visit(0, 0, 0, np.array([0]))
    return best


def _sparse(batch: pa.Table, of: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols, vals = batch.column(of).combine_chunks(), batch.column(value).combine_chunks()
    many = pc.list_value_length(cols).to_numpy()
    return np.append(0, np.cumsum(many)).astype(np.int64), cols.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(np.int64)


def _found(placed: DataFrame, items: tuple, size: int, floor: np.ndarray, p: Search) -> DataFrame:
    """(item, row, doc_id, score): of each group of documents of a task, the best for each item."""
    held = placed.sparkSession.sparkContext.broadcast((items, tree(*items, np.ones(size, np.int64), size, 1), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, item_tree, floor = held.value
        floor, waiting = floor.copy(), []

        def searched():
            table = pa.Table.from_batches(waiting)
            ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else table.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
            best = search(_sparse(table, "term", "impact"), ids, items, item_tree, size, floor, p)
            many = [len(s) for s, _ in best.found]
            rows = np.concatenate([r for _, r in best.found])
            scores = np.concatenate([s for s, _ in best.found])
            full = np.array([k for k, m in enumerate(many) if m == p.k], np.int64)
            floor[full] = np.maximum(floor[full], best.weakest[full])
            picked = table.select(["row", "doc_id"]).take(pa.array(rows))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(many)), many)), picked.column(0).combine_chunks(), picked.column(1).combine_chunks(), pa.array(scores)], ["item", "row", "doc_id", "score"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= p.group:
                yield searched()
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield searched()

    return mapped(placed.select("row", "doc_id", "term", "impact"), run, "item long, row long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, p: Search) -> Iterator[DataFrame]:
    """The items (item_id, terms) in blocks that may be broadcast."""
    ranked = materialize(with_rank(items, "item_id", "terms", name="place").withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16)))
    n, first = ranked.count(), 0
    while first < n:
        end = min(first + p.items, n)
        while True:
            block = ranked.where((F.col("place") >= first) & (F.col("place") < end))
            if end - first == 1 or block.agg(F.sum("bytes")).first()[0] <= p.item_bytes:
                break
            end = first + (end - first) // 2
        yield block.withColumn("item", (F.col("place") - first).cast("long"))
        first = end


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", params: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``params.k`` documents with the highest scores above 0 for each of ``items``.

    Terms are runs of A-Z, a-z, 0-9 and all signs beyond ASCII, only A-Z lower-cased. A term that df of the N documents
    with any term hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n terms, of L in all, that holds it
    tf times scores w (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L, summed over the item's different terms.

    Equal scores are ranked by doc_id, null ids last, then by row. Each row of ``items`` is an item and each row of
    ``docs`` a document, whatever other rows share its id; null texts have no terms. Other columns are unread. Counts
    are taken over all documents; every task prunes its own documents by a dual tree, exactly (``search``), from bounds
    that a sample of the documents gives; of a task's documents ``k`` per item at most are shuffled.
    """
    p = params
    spark = docs.sparkSession
    asked = terms(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "text")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(asked, p):
        own = block.select("item", "terms").orderBy("item").toArrow()  # bounded by ``items`` and ``item_bytes``
        words = own.column("terms").combine_chunks()
        known = pc.unique(words.flatten())
        at = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy())).astype(np.int64)
        which = pc.index_in(words.flatten(), value_set=known).to_numpy().astype(np.int64)

        held = materialize(vectors(plain, known.to_pylist()).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        n_terms = max(n_terms or 0, 1)
        df = np.zeros(len(known), np.int64)
        counted = held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row per known term
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        by = np.lexsort((which, np.repeat(np.arange(len(at) - 1), np.diff(at))))
        vectors_of_items = (at, which[by], weight[which[by]])

        length = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
        placed = held.withColumn("m", length).where(F.size("term") > 0).withColumn("impact", F.expr("transform(tf, x -> (1000000000L * x) div (1000L * x + 20L * m))"))
        floor = np.zeros(len(at) - 1, np.int64)
        part = max(1, n_docs // p.sample)
        if part > 1:
            some = placed.where(F.pmod(F.xxhash64("row"), F.lit(part)) == 0)
            first = _top(_found(some.coalesce(4), vectors_of_items, len(known), floor, p), p.k).where(F.col("rank") == p.k).select("item", "score").toArrow()
            floor[first.column("item").to_numpy()] = first.column("score").to_numpy()
        found = _top(_found(placed, vectors_of_items, len(known), floor, p), p.k)
        named = found.join(broadcast_if_small(materialize(block.select("item", "item_id"))), "item").select("item_id", "rank", "doc_id", "score")
        out = materialize(named) if out is None else out.union(materialize(named))
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
