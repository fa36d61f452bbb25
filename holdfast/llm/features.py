"""Hashed word n-grams of whole texts as sparse counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.arrow import add_columns, bounded_batches, mapped, release
from holdfast.llm.store import materialize
from holdfast.llm.textscan import LOWER, U64, chunks, column, mix, prefix_hash, range_hash

BITS = 18
#: Class of each byte: 0 white space and controls, 1 letters, digits and all of UTF-8's longer characters,
#: else the byte itself, so that a run of one sign is a word.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[:33] = 0
_KIND[127:] = 1
_KIND[48:58] = _KIND[97:123] = 1


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, orders: int = 2, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature number of each n-gram of a chunk, and the number of words of each row.

    Words are runs of letters and digits, or of one sign, A-Z lower-cased. ``orders`` 2 adds pairs of
    neighbours, and one feature of its own for a word next to its like; ``prefixes`` the first so many bytes
    of longer words, which inflected forms share.
    """
    data = LOWER[data]
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    row = np.searchsorted(offsets, starts, "right") - 1
    sums = prefix_hash(data)
    h = range_hash(sums, starts, ends)
    found, rows = [h], [row]
    if orders > 1 and len(h) > 1:
        same = row[1:] == row[:-1]
        pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + (h[1:] ^ U64(0x5851F42D4C957F2D)))
        pair[h[1:] == h[:-1]] = U64(0x2545F4914F6CDD1D)
        found.append(pair[same])
        rows.append(row[1:][same])
    for k in prefixes:
        long = np.flatnonzero(ends - starts > k)
        found.append(mix(range_hash(sums, starts[long], starts[long] + k) ^ U64(0xD1B54A32D192ED03)))
        rows.append(row[long])
    words = np.bincount(row, minlength=len(offsets) - 1)
    return np.concatenate(rows), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), words


def counts(rows: np.ndarray, features: np.ndarray, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n + 1 offsets of the rows, their features in ascending order, and how often each occurs."""
    key, many = np.unique((rows.astype(np.int64) << bits) | features, return_counts=True)
    return np.searchsorted(key, np.arange(n + 1) << bits), key & ((1 << bits) - 1), many


def by_count(many: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Value of a feature: grows with the logarithm of its count."""
    return 1.0 + np.log(many)


def by_share(many: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Value of a feature: grows with its share of the text's words, so that one chance word in a long text
    counts for little."""
    return np.log1p(200.0 * many / words)


def valued(data, offsets, bits, orders, prefixes, weigh, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, features and values of the rows of a chunk; of the features for which ``only`` is not 0."""
    rows, feature, words = hashed(data, offsets, bits, orders, prefixes)
    if only is not None:
        some = np.flatnonzero(only[feature])
        rows, feature = rows[some], feature[some]
    at, feature, many = counts(rows, feature, len(offsets) - 1, bits)
    return at, feature, weigh(many, np.repeat(words, np.diff(at)))


def sparse(docs: DataFrame, text: str, bits: int, orders: int, prefixes: tuple[int, ...] = (), weigh=by_count) -> DataFrame:
    """``docs`` with arrays ``feature`` and ``value`` instead of ``text`` (and of columns of these names)."""
    k = docs.columns.index(text)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        at, feature, value, base = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], 0
        for _, _, d, o in chunks(*column(batch.column(k))):
            a, f, v = valued(d, o, bits, orders, prefixes, weigh)
            at.append(a[1:] + base)
            base += int(a[-1])
            feature.append(f.astype(np.int32))
            value.append(v.astype(np.float32))
        off = pa.array(np.concatenate(at), pa.int32())
        return [pa.ListArray.from_arrays(off, pa.array(np.concatenate(feature))), pa.ListArray.from_arrays(off, pa.array(np.concatenate(value)))]

    return add_columns(docs, one, [T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))], drop=(text,))


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str, out: str, bits: int = BITS, orders: int = 2, prefixes: tuple[int, ...] = (), weigh=by_count) -> DataFrame:
    """``docs`` with the logistic score of each whole text: a sparse dot product with ``weights``, which are
    broadcast (2**bits numbers, whatever the corpus). Each text is summed by itself in the order of its features,
    so equal texts score alike wherever they stand. Only texts go to Python; ``out`` replaces a column of its name."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = held.value
        try:
            for col in texts:
                parts = [np.zeros(0)]
                for i, j, d, o in chunks(*column(col)):
                    at, feature, value = valued(d, o, bits, orders, prefixes, weigh, only=w)
                    parts.append(np.bincount(np.repeat(np.arange(j - i), np.diff(at)), w[feature] * value, j - i))
                yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(parts) + bias, -500, 500))))
        finally:
            release()

    return docs.withColumn(out, scored(F.col(text)))


@dataclass
class Sample:
    """Rows to learn from: those of row i have the features and values at[i] to at[i + 1]."""

    at: np.ndarray
    features: np.ndarray
    values: np.ndarray
    labels: np.ndarray


def fit(sample: DataFrame, train: Callable[[Sample], tuple[np.ndarray, float]], bits: int) -> tuple[np.ndarray, float]:
    """Weights and bias that ``train`` makes of a sample in one task. ``sample`` (columns label, feature, value,
    order) is bounded in rows and bytes (``bounded_sample``); only weights other than zero, at most 2**bits, come to
    the driver."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("order", "ascending"), ("label", "ascending")]).combine_chunks()
        del held
        f = table.column("feature").combine_chunks()
        at = np.asarray(f.offsets).astype(np.int64)
        w, bias = train(Sample(at - at[0], np.asarray(f.flatten()), np.asarray(table.column("value").combine_chunks().flatten()), table.column("label").to_numpy()))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some], bias))], ["at", "weight"])

    rows = mapped(sample.select("label", "feature", "value", "order").repartition(1), run, "at long, weight double").toPandas()
    weights = np.zeros(1 << bits)
    real = rows["at"] >= 0
    weights[rows["at"][real].to_numpy()] = rows["weight"][real].to_numpy()
    return weights, float(rows["weight"][~real].sum())


def smallest_hashes(ids: DataFrame, doc_id: str, seed: int, most: int) -> DataFrame:
    """At most ``most`` of the distinct ``ids``, those with the smallest hashes, with these as ``order``. Every task
    keeps that many at most before the shuffle."""
    return ids.select(doc_id).distinct().withColumn("order", F.xxhash64(doc_id, F.lit(seed))).orderBy("order", doc_id).limit(most)


#: A text longer than this share of a sample's bytes is no sample text.
TEXT_SHARE = 1 / 16


def bounded_sample(texts: DataFrame, picked: DataFrame, most_bytes: int) -> DataFrame:
    """(label, order, text): one text for each row of ``picked`` (doc_id, label, order; a bounded number of rows,
    broadcast) of ``texts`` (doc_id, text), the one of the smallest hash where an id has several; in their order, whole
    texts that ``most_bytes`` hold together. A text that does not fit into what is left, or needs more than a sixteenth
    of ``most_bytes``, is left out and the next ones are tried; if that leaves nothing of a label, it is an error."""
    own = F.struct(F.xxhash64("text").alias("hash"), "text")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "order").agg(F.min(own).alias("own"))
    rows = materialize(rows.select("doc_id", "label", "order", F.col("own.text").alias("text")).withColumn("place", F.monotonically_increasing_id()))
    sizes = rows.select("label", "place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("order", "label", "doc_id").toPandas()  # as many as picked
    left, places = most_bytes, []
    for size, place in zip(sizes["size"].tolist(), sizes["place"].tolist(), strict=True):
        if size <= min(left, most_bytes * TEXT_SHARE):
            places.append(place)
            left -= size
    kept = sizes["place"].isin(places)
    if set(sizes["label"]) - set(sizes["label"][kept]):
        raise ValueError(f"no text of a label fits into a sample of {most_bytes} bytes")
    few = texts.sparkSession.createDataFrame([(p,) for p in places], "place long")
    return rows.join(F.broadcast(few), "place").select("label", "order", "text")
