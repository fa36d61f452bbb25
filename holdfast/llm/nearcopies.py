"""SimHash near copies at a wide distance, held to an exact Jaccard similarity of word shingles.

At a similarity of 0.8 the 64-bit fingerprints of two texts differ in about ten bits, too many for keys made of
equal segments. Groups of texts that may be near copies therefore come from bands of MinHash; within a group,
fingerprints must pass the pigeonring chains and the Hamming distance, then whole sets of shingles are compared,
so no pair is linked wrongly.

Chances that a pair of similarity 0.8 is missed: no band in common, (1 - 0.8**ROWS)**BANDS = 8e-5; more than MOST
differing bits, below 1e-5. Both fall fast above 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.arrow import free_name, mapped, sorted_groups
from holdfast.llm.graph import components, forest
from holdfast.llm.store import materialize
from holdfast.llm.textscan import LOWER, NOT_SPACE, U64, chunks, column, mix, prefix_hash, range_hash, spans

WORDS = 5
#: Two sets are near copies if their intersection is at least this share of their union (a fraction, so that it is exact).
SHARE = (4, 5)
BANDS, ROWS = 40, 7
#: Differing bits of the fingerprints of near copies, at most, and the segments of the pigeonring.
MOST, RING = 26, 8
#: Members of a group that are compared with each other; larger groups are cut into blocks, and each pair of blocks
#: is a group of its own. Members of bands with more than LARGEST are grouped by their rarest shingles instead, which
#: loses no pair.
BLOCK, LARGEST = 512, 8192
_SEEDS = np.random.default_rng(20240307).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | U64(1)
_STEP = U64(0xC2B2AE3D27D4EB4F)


def chain(x: np.ndarray, most: int, segments: int) -> np.ndarray:
    """Pigeonring: of the segments of differing bits ``x`` in a ring, some start has every run of l segments
    within l * most / segments differing bits. Necessary for ``most`` differing bits in all."""
    width = 64 // segments
    seg = np.stack([np.bitwise_count((x >> U64(width * s)) & U64((1 << width) - 1)) for s in range(segments)]).astype(np.int64)
    found = np.zeros(len(x), bool)
    for start in range(segments):
        ok, run = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for length in range(1, segments):
            run = run + seg[(start + length - 1) % segments]
            ok &= run * segments <= length * most
        found |= ok
    return found


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each row, and n + 1 offsets of rows in them.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a shorter text is one shingle, a blank
    one has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, at = spans(NOT_SPACE[data], offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    word = range_hash(prefix_hash(data), starts, ends)
    per = np.diff(at)
    many = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
    row = np.repeat(np.arange(n), many)
    first = np.repeat(at[:-1] - (np.cumsum(many) - many), many) + np.arange(len(row))
    h = np.zeros(len(row), U64)
    for k in range(words):
        there = first + k < at[row + 1]
        h = np.where(there, h * _STEP + word[np.minimum(first + k, len(word) - 1)], h)
    h = mix(h + np.minimum(per[row], words).astype(U64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _instead(docs: DataFrame, text: str, fn: Callable[[np.ndarray, np.ndarray], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``docs`` with the columns that ``fn`` makes of each chunk of ``text`` instead of it, in batches of a chunk."""
    k = docs.columns.index(text)
    rest = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in chunks(*column(batch.column(k))):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([c for n, c in enumerate(part.columns) if n != k] + fn(d, o), [f.name for f in (*rest, *fields)])

    return mapped(docs, run, T.StructType([*rest, *fields]))


def _sketches(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` with size, two content hashes and SimHash of each set, and its band keys (none for an empty set)."""

    def one(d: np.ndarray, o: np.ndarray) -> list[pa.Array]:
        h, at = _shingles(d, o, words)
        size = np.diff(at)
        have = np.flatnonzero(size)
        cut = at[have]
        sums = np.zeros((3, len(size)), U64)
        keys = np.zeros((len(have), BANDS), U64)
        if len(have):
            sums[0, have], sums[1, have] = np.add.reduceat(h, cut), np.add.reduceat(mix(h ^ _STEP), cut)
            for bit in range(64):
                ones = np.add.reduceat(((h >> U64(bit)) & U64(1)).astype(np.int32), cut)
                sums[2, have] |= (2 * ones > size[have]).astype(U64) << U64(bit)
            for band in range(BANDS):
                key = np.full(len(have), U64(band))
                for m in range(band * ROWS, band * ROWS + ROWS):
                    key = mix(key * _STEP + np.minimum.reduceat((h ^ _SEEDS[0, m]) * _SEEDS[1, m], cut))
                keys[:, band] = key
        bands = np.append(0, np.cumsum(size > 0) * BANDS)
        return [pa.array(size), *(pa.array(x.view(np.int64)) for x in sums), _lists(keys.ravel(), bands)]

    fields = [T.StructField(c, T.LongType()) for c in ("size", "s1", "s2", "fp")]
    return _instead(docs, text, one, [*fields, T.StructField("bands", T.ArrayType(T.LongType()))])


_GROUP = "grp long, part long, node long, component long, fp long, block int, set array<long>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members of groups sorted by (grp, part): a spanning forest of each. Members of one component
    are not compared; of two blocks, only members of different ones are; block -1 holds a leader, whom all
    others are compared with instead of each other."""
    for table, starts in sorted_groups(batches, 2):
        bounds = np.append(starts, table.num_rows).tolist()
        node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        fp = table.column("fp").to_numpy().view(U64)
        lists = table.column("set").combine_chunks()
        at = np.asarray(lists.offsets).astype(np.int64)
        at = at - at[0]
        _, ids = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        marked = np.zeros(len(ids) + 1, bool)
        size = np.diff(at)
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            lead = np.flatnonzero(block[low:high] < 0) + low
            rows = lead.tolist() if len(lead) else range(low, high - 1)
            pairwise = not len(lead)
            two = pairwise and block[low:high].min() != block[low:high].max()
            for i in rows:
                j = np.arange(i + 1, high) if pairwise else np.arange(low, high)
                ok = component[j] != component[i]
                if two:
                    ok &= block[j] != block[i]
                j = j[ok]
                j = j[np.minimum(size[j], size[i]) * SHARE[1] >= np.maximum(size[j], size[i]) * SHARE[0]]
                x = fp[j] ^ fp[i]
                j = j[chain(x, MOST, RING) & (np.bitwise_count(x) <= MOST)] if len(j) else j
                if not len(j):
                    continue
                marked[ids[at[i] : at[i + 1]]] = True
                n = size[j]
                cut = np.cumsum(n) - n
                both = np.add.reduceat(marked[ids[np.repeat(at[j] - cut, n) + np.arange(int(n.sum()))]].astype(np.int64), cut)
                marked[ids[at[i] : at[i + 1]]] = False
                j = j[both * SHARE[1] >= (size[i] + n - both) * SHARE[0]]
                a.append(np.full(len(j), i))
                b.append(j)
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        if len(a):
            names, place = np.unique(node, return_inverse=True)
            root = forest(len(names), place[a], place[b])
            inner = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[root[inner]]), pa.array(names[inner])], ["a", "b"])


def _checked(groups: DataFrame) -> DataFrame:
    """The links within ``groups`` (columns of _GROUP), written."""
    dealt = groups.repartition("grp", "part").sortWithinPartitions("grp", "part")
    return materialize(mapped(dealt, _compared, "a long, b long"))


def _blocks(members: DataFrame, rows: int) -> DataFrame:
    """``members`` (grp, node, ...) of groups of n members, once for each pair of blocks of about ``rows`` that theirs is in."""
    many = F.ceil(F.col("n") / rows).cast("int")
    own = members.withColumn("many", many).withColumn("block", F.pmod(F.xxhash64("node", "grp"), F.col("many")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    part = F.least("block", "other").cast("long") * F.col("many") + F.greatest("block", "other")
    return other.withColumn("part", part).drop("many", "other", "n")


def _rarest(members: DataFrame) -> DataFrame:
    """``members`` (node, component, set) in groups (grp, node, component, n) of those that share one of their rarest shingles.

    Near copies have SHARE of the larger set in common. So if each set is in one order, that of how many members hold a
    shingle, both hold a shingle that is among the first size - ceil(size * SHARE) + 1 of each: no pair is lost, and
    shingles that most members hold are rarely among these.
    """
    rows = materialize(members.select("node", "component", F.size("set").alias("size"), F.explode("set").alias("shingle")))
    held = rows.groupBy("shingle").agg(F.count("*").alias("held"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    most = F.expr(f"size - int(ceil(size * {SHARE[0]}L / {SHARE[1]}L)) + 1")
    first = rows.join(held, "shingle").withColumn("turn", turn).where((F.col("turn") <= most) & (F.col("held") > 1))
    named = materialize(first.select(F.xxhash64("shingle", F.lit("rarest")).alias("grp"), "node", "component"))
    split = named.groupBy("grp").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return named.join(split.select("grp", "n"), "grp").select("grp", "node", "component", "n")


def _linked(nodes: DataFrame, texts: DataFrame, words: int, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(node, component) of the near copies among ``nodes`` (key, size, fp, bands), whose sets all differ.

    Each node first meets one other, the busiest that it shares a band with, so that a large group of near copies
    falls into few components. Of bands that still hold several components, members are then compared across these.
    """
    rows = nodes.select(F.col("key").alias("node"), F.posexplode("bands").alias("at", "band"))
    busy = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(rows.join(busy, "band").select("band", "at", "node", "n"))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ahead = F.struct("weight", "node")
    met = members.join(weight, "node").select("band", "node", "weight")
    leads = met.groupBy("band").agg(F.max(ahead).alias("lead"))
    pick = materialize(met.join(leads, "band").groupBy("node").agg(F.max("lead").alias("lead")).select("node", F.col("lead.node").alias("grp")).where("node <> grp"))
    one = lambda d, o: [_lists(*_shingles(d, o, words))]
    named = members.select(F.col("node").alias("key")).distinct()
    sets = materialize(_instead(texts.join(named, "key", "left_semi"), "text", one, [T.StructField("set", T.ArrayType(T.LongType()))]).join(nodes.select("key", "fp"), "key").select(F.col("key").alias("node"), "fp", "set"))

    parts = pick.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("parts"))
    spread = pick.join(parts, "grp").select("node", "grp", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(0).alias("block"))
    headed = parts.select(F.col("grp").alias("node"), "grp", F.lit(-1).alias("block"), "parts").join(sets, "node")
    headed = headed.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", F.col("node").alias("component"), "fp", "block", "set")
    follow = spread.join(sets, "node").select("grp", "part", "node", F.col("node").alias("component"), "fp", "block", "set")
    found = _checked(follow.union(headed))
    labels = components(found)

    now = materialize(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    split = now.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    open_ = materialize(now.join(split, "band", "left_semi"))
    small = open_.where(F.col("n") <= largest).select(F.col("band").alias("grp"), "node", "component", "n")
    hot = open_.where(F.col("n") > largest).select("node", "component").distinct()
    if not hot.isEmpty():
        small = small.union(_rarest(hot.join(sets.select("node", "set"), "node")))
    rest = _blocks(small, block).join(sets, "node").select("grp", "part", "node", "component", "fp", "block", "set")
    return components(found.union(_checked(rest)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, **how) -> DataFrame:
    """The rows of ``docs`` with one row of each group that near copies connect: that of the smallest doc_id, rows
    without one last, ties by text.

    Near copies are rows whose sets of ``words``-word shingles have a Jaccard similarity of 0.8 or more, or are
    equal; blank and null texts are equal. Rows are told apart by a key of their own, so a doc_id that is
    null or used again loses and joins nothing. Columns of any name pass; an empty table gives no rows.
    """
    key = free_name("__key", docs.columns)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    named = rows.select(F.col(key).alias("key"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    prints = materialize(_sketches(named, "text", words))
    same = materialize(prints.groupBy("s1", "s2", "size").agg(F.min("key").alias("node"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "key")).alias("best")))
    nodes = prints.select("key", "size", "fp", "bands").join(same.select(F.col("node").alias("key")), "key", "left_semi")
    groups = same.join(_linked(nodes, texts, words, **how), "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    kept = groups.agg(F.min("best").alias("best")).select(F.col("best.key").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
