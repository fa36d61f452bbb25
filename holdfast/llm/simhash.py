"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import nearcopies
from holdfast.llm.arrow import add_columns, mapped, sorted_groups
from holdfast.llm.graph import components, forest
from holdfast.llm.store import join_hot, materialize
from holdfast.llm.textscan import LOWER, NOT_SPACE, chunks, column, spans

SEGMENTS, WIDTH = 4, 16
MAX_DISTANCE = 2
#: Rows that share a key are compared with each other up to this many; larger groups get longer keys.
LARGEST_GROUP = 2048
#: Larger groups are compared by flipped bits, not pair by pair.
BY_FLIPS = 2048
PAIRS = list(combinations(range(SEGMENTS), 2))


def _fingerprints(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    data = LOWER[data]
    starts, ends, at = spans(NOT_SPACE[data], offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    new_start = np.cumsum(size + 1) - size - 1  # words with one space between
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    shift = np.repeat(new_start - starts, size)
    within = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    joined[within + shift] = data[within]
    raw, new_end = joined.tobytes(), new_start + size
    per = np.diff(at)
    grams = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
    total = int(grams.sum())
    first = np.repeat(at[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(total)
    last = np.minimum(first + words - 1, np.repeat(at[1:], grams) - 1)
    h = np.fromiter((xxh64_intdigest(raw[a:b], seed) for a, b in zip(new_start[first].tolist(), new_end[last].tolist(), strict=True)), np.uint64, total)
    have = np.flatnonzero(grams)
    cut = (np.cumsum(grams) - grams)[have]
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), cut)
        out[have] |= (2 * ones > grams[have]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with a 64-bit SimHash (long) of each whole text.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are ``words`` of them
    with one space between, repeats included; a shorter text is one shingle. A bit is 1 if more than half
    of the shingles' XXH64 have it. Null, empty and blank texts: 0.
    """
    k = docs.columns.index(text)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = column(batch.column(k))
        parts = [_fingerprints(d, o, words, seed) for _, _, d, o in chunks(data, offsets)]
        return [pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))]

    return add_columns(docs, one, [T.StructField(out, T.LongType())])


def _by_pairs(fp: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """The first row of each row's component, of sorted groups: rows are compared with all behind them in their group,
    pigeonring chains first, the full distance on what is left."""
    end = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
    at, a, b = np.arange(len(fp)), [], []
    root = np.arange(len(fp))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        near = at[nearcopies.chain(x, most, SEGMENTS)]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= most]
        a.append(near)
        b.append(near + step)
        if sum(map(len, a)) > 1_000_000:
            root = forest(len(fp), np.concatenate([np.arange(len(fp)), *a]), np.concatenate([root, *b]))
            a, b = [], []
        step += 1
    return forest(len(fp), np.concatenate([np.arange(len(fp)), *a]), np.concatenate([root, *b]))


def _by_flips(fp: np.ndarray, most: int) -> np.ndarray:
    """The same of one large group, whose rows agree in most bits: each row looks up those that differ from it in up to
    ``most`` of the bits in which any rows of the group differ. Rows times the square of these bits, not of the rows."""
    order = np.argsort(fp)
    held, root = fp[order], np.arange(len(fp))
    differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << b for b in range(64) if differ >> b & 1]
    for flip in (sum(c) for n in range(1, most + 1) for c in combinations(bits, n)):
        asked = fp ^ np.uint64(flip)
        place = np.minimum(np.searchsorted(held, asked), len(fp) - 1)
        hit = np.flatnonzero(held[place] == asked)
        root = forest(len(fp), np.concatenate([np.arange(len(fp)), hit]), np.concatenate([root, order[place[hit]]]))
    return root


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted groups: a spanning forest of each, never all pairs."""
    for table, starts in sorted_groups(batches, 3):
        fp = table.column("fp").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        size = np.diff(np.append(starts, len(fp)))
        large = np.repeat(size > BY_FLIPS, size)
        root = np.arange(len(fp))
        small = np.flatnonzero(~large)
        if len(small):
            few = size[size <= BY_FLIPS]
            root[small] = small[_by_pairs(fp[small], np.cumsum(few) - few, most)]
        for a, n in zip(starts[size > BY_FLIPS].tolist(), size[size > BY_FLIPS].tolist(), strict=True):
            root[a : a + n] = a + _by_flips(fp[a : a + n], most)
        inner = np.flatnonzero(root != np.arange(len(fp)))
        if len(inner):
            yield pa.RecordBatch.from_arrays([pa.array(node[root[inner]]), pa.array(node[inner])], ["a", "b"])


def links(distinct: DataFrame, most: int = MAX_DISTANCE, largest: int = LARGEST_GROUP) -> DataFrame:
    """(a, b) links that connect all of ``distinct`` (long node, long fp, no fp twice) at ``most`` or fewer
    differing bits.

    With at most 2 differing bits, two of four 16-bit segments are equal: those 32 bits and which segments
    they are form a key. Rows of one key are compared in numpy: pigeonring chains first, the full distance
    on what is left. A key with more than ``largest`` rows is split by six longer keys, which agree in two
    of the four quarters of the other 32 bits; at most 2**16 fingerprints can share one of these, and they look each
    other up by flipped bits. Rows of a key that is too common for one task are joined with its count where they lie
    (``join_hot``), and split before they are sent anywhere. ``distinct`` is read several times and must be alike each time.
    """
    if not 0 <= most <= 2:
        raise ValueError("two equal segments of four are certain only up to 2 differing bits")
    seg = lambda s, width=WIDTH: F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit((1 << width) - 1))
    keys = [F.struct(F.lit(i).alias("kind"), (F.shiftleft(seg(x), WIDTH) + seg(y)).alias("key"), F.lit(0).cast("long").alias("more")) for i, (x, y) in enumerate(PAIRS)]
    rows = lambda df, made: df.select("node", "fp", F.explode(F.array(*made)).alias("k")).select("k.kind", "k.key", "k.more", "node", "fp")
    group = ["kind", "key", "more"]
    counted = lambda df: join_hot(df, materialize(df.groupBy(*group).agg(F.count("*").alias("many")).where("many > 1").withColumn("n", F.col("many"))), group)
    first = counted(rows(distinct, keys))

    longer = []
    for i, pair in enumerate(PAIRS):
        rest = [s for s in range(SEGMENTS) if s not in pair]
        eighths = [e for s in rest for e in (2 * s, 2 * s + 1)]
        for j, (x, y) in enumerate(combinations(eighths, 2)):
            longer.append(F.when(F.col("kind") == i, F.struct(F.lit(6 * i + j).alias("kind"), F.col("key"), (F.shiftleft(seg(x, 8), 8) + seg(y, 8)).alias("more"))))
    hot = first.where(F.col("many") > largest).select("kind", "key", "node", "fp", F.explode(F.array_compact(F.array(*longer))).alias("k"))
    second = counted(hot.select(F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), F.col("k.more").alias("more"), "node", "fp"))

    def run(batches):
        return _links(batches, most)

    ordered = lambda df: mapped(df.select(*group, "node", "fp").repartition(*group).sortWithinPartitions(*group), run, "a long, b long")
    return ordered(first.where(F.col("many") <= largest)).union(ordered(second))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, most: int = MAX_DISTANCE, largest: int = LARGEST_GROUP) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable by links between fingerprints that differ in ``most``
    bits or fewer. Equal fingerprints are one node however many rows have them, and copies are never
    expanded into pairs. Rows whose doc_id is null link like all others; a component without any doc_id has a null
    component_id. Repeated rows give repeated results; other columns are unread.
    """
    prints = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words=words, seed=seed).select("doc_id", "fingerprint"))
    nodes = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("lowest"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    linked = components(links(nodes.select("node", "fp"), most, largest))
    known = materialize(nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = materialize(known.groupBy("component").agg(F.min("lowest").alias("component_id"), F.count("*").alias("n")))
    found = materialize(join_hot(known, least, ["component"]).select(F.col("fp").alias("fingerprint"), "component_id", F.col("copies").alias("n")))
    return join_hot(prints, found, ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = nearcopies.WORDS) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near copies: texts whose ``words``-word shingles have a
    Jaccard similarity of 0.8 or more, found at a wide Hamming distance and then compared whole (see
    ``nearcopies``). Groups are of rows, not of doc_ids: a repeated or null doc_id loses and joins nothing."""
    return nearcopies.deduplicate(docs, doc_id, text, words)
