"""Spelling variants: words within one edit of each other, found by pivotal grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.arrow import mapped
from holdfast.llm.store import materialize
from holdfast.llm.textscan import LOWER, chunks, column, packed_words

#: Code points and occurrences of a word, at least.
LENGTH, TIMES = 5, 3
#: One run in so many loses a code point.
DAMAGED = 97
#: Different words that a task holds before it hands their counts on.
HELD = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8, and of nothing else


def _crc_table() -> np.ndarray:
    """Remainders of the reflected CRC-32 polynomial, by byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc(words: pa.Array, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes behind a text whose CRC-32 is ``before``."""
    at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data, size = np.frombuffer(words.buffers()[2], np.uint8), np.diff(at)
    crc = ~before
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        crc[live] = _CRC[(crc[live] ^ data[at[live] + k]) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
        k += 1
        live = live[size[live] > k]
    return ~crc


def _runs(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Words of a chunk of rows, one in ``DAMAGED`` of its runs without one of its code points."""
    data = LOWER[data]
    lead = data == _LEAD
    member = _LETTER[data] | lead
    member[1:] |= lead[:-1]
    words, row = packed_words(data, member, offsets)
    if not len(words):
        return words
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _crc(words, before[row])
    hit = np.flatnonzero(crc % DAMAGED == 0)
    cut = []
    for word, h in zip(words.take(pa.array(hit)).to_pylist(), crc[hit].tolist(), strict=True):
        at = h % len(word)
        cut.append(word[:at] + word[at + 1 :])
    whole = np.ones(len(words), bool)
    whole[hit] = False
    return pa.concat_arrays([words.filter(pa.array(whole)), pa.array(cut, pa.string())])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): the different words of all whole texts with at least ``length`` code points and ``times`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. A run whose CRC-32 (of
    ``<doc_id>:<run>``) 97 divides loses the code point at that number modulo its length. Null texts have none; a null
    doc_id counts as an empty text. Each task counts before the shuffle, so a common word is a row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            data, offsets = column(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j, d, o in chunks(data, offsets):
                words = _runs(ids[i:j], d, o)
                words = words.filter(pc.greater_equal(pc.utf8_length(words), length))
                counted = pc.value_counts(words)
                held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
            if sum(t.num_rows for t in held) > HELD:
                held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    counted = mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _pivots(place: np.ndarray, cost: np.ndarray, word: np.ndarray, q: int, n_words: int) -> np.ndarray:
    """Which rows are the two disjoint grams of least joint cost of each word. Rows are the prefix grams of words in
    order of (word, place); grams are disjoint if their places differ by ``q`` or more.

    The best single gram up to each place is known before the pair that ends there is looked at, so the choice is a
    dynamic programme of one step back, run over all words at once, a place of the prefix at a time.
    """
    first = np.searchsorted(word, np.arange(n_words))
    count = np.diff(np.append(first, len(word)))
    best_pair = np.full(n_words, np.iinfo(np.int64).max)
    pair = np.zeros((n_words, 2), np.int64)
    one = np.full((n_words,), np.iinfo(np.int64).max // 4)  # cheapest gram that ends before the current one, and where
    one_at = np.full(n_words, -1)
    behind = first.copy()  # next gram to enter ``one``
    for k in range(int(count.max(initial=0))):
        w = np.flatnonzero(count > k)
        row = first[w] + k
        while True:  # grams that are disjoint from this one by now
            enter = w[(behind[w] < first[w] + k) & (place[np.minimum(behind[w], len(place) - 1)] + q <= place[row])]
            if not len(enter):
                break
            cheaper = enter[cost[behind[enter]] < one[enter]]
            one[cheaper] = cost[behind[cheaper]]
            one_at[cheaper] = behind[cheaper]
            behind[enter] += 1
        joint = cost[row] + one[w]
        better = (one_at[w] >= 0) & (joint < best_pair[w])
        best_pair[w[better]] = joint[better]
        pair[w[better]] = np.stack([one_at[w[better]], row[better]], 1)
    chosen = np.zeros(len(word), bool)
    chosen[pair[best_pair < np.iinfo(np.int64).max].ravel()] = True
    return chosen


def _keys(shorter: list[Column], other_size: Column) -> Column:
    """Hashes of what words share that hold a gram, here at ``place`` of a word of ``size`` code points, and are one edit
    apart: the size of the probed word, the gram's place from the unchanged end, and what stands unchanged before the gram
    if the edit is behind it, or behind it if the edit is before. One sign there, or none, says little; then one half of
    the other part is unchanged too, halves being those of the word in ``shorter``: of the two words' sizes, those that can
    be the lesser."""

    def side(name: str, at: Column, same: str, other: str) -> list[Column]:
        key = lambda when, half, *rest: F.when(when, F.xxhash64(F.lit(name), at, other_size, half, F.expr(same), *rest))
        many = F.char_length(F.expr(same))
        out = [key(many > 1, F.lit(0))]
        for size in shorter:
            first = F.floor((size - 2 - many) / 2).cast("int")
            out.append(key(many <= 1, 2 * size, F.substring(F.expr(other), F.lit(1), first)))
            out.append(key(many <= 1, 2 * size + 1, F.right(F.expr(other), size - 2 - many - first)))
        return out

    before = side("before", F.col("place"), "substring(word, 1, place)", "substring(word, place + 3)")
    behind = side("behind", F.col("size") - F.col("place"), "substring(word, place + 3)", "substring(word, 1, place)")
    return F.array_compact(F.array(*before, *behind))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, b_n) for each ordered pair of different ``words`` (word of four code points or more, each once; n) that
    differ by exactly one inserted, deleted or replaced code point.

    Bigrams are ranked by the words that hold them, rare first. A word's prefix is its three rarest grams, and all of
    its grams as rare as the third; one edit destroys two grams at most. Two disjoint grams of the prefix, of least joint
    frequency, are its pivots; one edit leaves at least one of them whole. Of two near words, the one whose prefix ends
    no later in the rank has a pivot that the other's prefix holds. That pivot stands at the same place from the start
    or from the end of both, and what stands there is unchanged: gram, place, lengths and that part of the word are the
    keys (``_keys``), and candidates are then verified whole. So a gram that very many words share is no key by itself.
    """
    # a row per different bigram: of the 90 letters of ``vocabulary``, 8100 at most
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, 2))
    counts = words.where("char_length(word) > 1").select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("cost")).toPandas().sort_values(["cost", "gram"])
    held = words.sparkSession.sparkContext.broadcast((counts["gram"].to_list(), counts["cost"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, costs = held.value
        known = pa.array(names, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, 16384):
                yield _placed(batch.slice(a, 16384), known, costs)

    placed = materialize(mapped(words.select("word", "n"), run, "word string, n long, size int, last int, gram int, place int, pivot boolean"))
    pivots = placed.where("pivot").withColumn("other_size", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)))
    lesser = F.least("size", "other_size")
    pivots = pivots.select("gram", F.explode(_keys([lesser], F.col("other_size"))).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"))
    others = placed.select("gram", F.explode(_keys([F.col("size"), F.col("size") - 1], F.col("size"))).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"))
    both = pivots.join(others, ["gram", "key"]).where("a_last <= b_last and a <> b and levenshtein(a, b, 1) = 1")
    turned = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    found = materialize(both.select(pick("a", "b", "a"), pick("a_n", "b_n", "a_n"), pick("b", "a", "b"), pick("b_n", "a_n", "b_n")).distinct())
    return found.select("a", "b", "b_n").union(found.select("b", "a", "a_n"))


def _placed(batch: pa.RecordBatch, known: pa.Array, costs: np.ndarray) -> pa.RecordBatch:
    """Prefix grams of some words with their ranks, which are their places in ``known``, and which are pivots."""
    words = batch.column(0).to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    many = np.maximum(size - 1, 0)
    word = np.repeat(np.arange(len(words)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(size) - size)[word] + place
    different, where = np.unique(signs[at] << 21 | signs[at + 1], return_inverse=True)
    names = pa.array([chr(p >> 21) + chr(p & 0x1FFFFF) for p in different.tolist()], pa.string())
    rank = pc.index_in(names, value_set=known).to_numpy().astype(np.int64)[where]
    some = np.flatnonzero(many)
    third = (np.cumsum(many) - many + np.minimum(many, 3) - 1)[some]  # among each word's grams in order of rank
    last = np.zeros(len(words), np.int64)
    last[some] = rank[np.lexsort((rank, word))][third]
    kept = np.flatnonzero(rank <= last[word])
    word, place, rank = word[kept], place[kept], rank[kept]
    pivot = _pivots(place, costs[rank], word, 2, len(words))
    small = lambda x: pa.array(x.astype(np.int32))
    rows = pa.array(word)
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), small(size[word]), small(last[word]), small(rank), small(place), pa.array(pivot)], ["word", "n", "size", "last", "gram", "place", "pivot"])


def group(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n; each word once, none null).

    form is the near word of the largest n (ties: the first in code-point order) if that is at least twice the word's
    own, else null; root follows forms to the last one. n doubles with each step, so pointer doubling ends after a few
    rounds. An empty table gives an empty one.
    """
    words = materialize(words.select("word", "n"))
    best = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    formed = F.col("form_n") >= 2 * F.col("n")
    joined = materialize(joined.select("word", F.when(formed, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")))
    up = joined.where("form is not null").select("word", F.col("form").alias("root"))
    moved = 1
    while moved:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved, up = step.where("moved").limit(1).count(), step.select("word", "root")
    return joined.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """``group`` over the ``vocabulary`` of ``docs``. Rows of a repeated doc_id count each; other columns are unread."""
    if length < 4:
        raise ValueError("two disjoint grams need four code points")
    return group(vocabulary(docs, doc_id, text, length, times))
