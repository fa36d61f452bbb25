"""Exact-substring dedup by suffix arrays over shards of candidate text.

Only text that can repeat is sorted. Every string of ``length`` bytes is filed under the smallest hash of the
64-byte grams inside it; equal strings have equal smallest grams, at the same place in them. Neighbouring
starts that share this gram form a segment. Segments whose gram occurs once in the corpus cannot hold a
repeat. The others are dealt by gram to shards; each shard has a suffix array, and a gram with very many
different segments is spread over several shards whose sorted strings are merged by binary search.

Texts and segments are told apart by 128 bits of hashes each; strings inside shards and across them are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.arrow import add_columns, free_name, mapped, sorted_groups
from holdfast.llm.store import broadcast_if_small, join_hot, materialize
from holdfast.llm.textscan import U64, chunks, column, powers, prefix_hash, range_hash

GRAM = 64
#: Bytes that are scanned together, at most; longer texts are scanned in overlapping parts.
PART = 1 << 20
_POSITION = 21
#: Different segments of one gram that one shard takes, and bytes that one suffix array covers.
SHARD_SEGMENTS, SHARD_BYTES = 512, 1 << 20
#: Rows of one gram, one segment or one text that a join may send to one task.
HOT_ROWS = 1 << 15
_SEGMENT = ["gram", "content", "more"]


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, start in its text, number of starts, gram and two content hashes of the segments of a chunk."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, U64))
    if len(data) < length:
        return none
    sums = prefix_hash(data)
    h = (sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(sums) - GRAM]
    h = (h ^ (h >> U64(32))) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    low = U64((1 << _POSITION) - 1)
    at = (_window_min((h & ~low) | np.arange(len(h), dtype=U64), length - GRAM + 1) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + length <= offsets[row + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & valid)  # within a row valid starts come first, so runs stay whole
    edge = np.flatnonzero(new | ~valid)
    after = np.append(edge, len(at))[np.searchsorted(edge, first, "right")]
    ends = after + length - 1
    return row[first], first - offsets[row[first]], after - first, h[at[first]], range_hash(sums, first, ends), range_hash(prefix_hash(data, 1), first, ends)


def _parts(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    for i, j, d, o in chunks(data, offsets, PART):
        if len(d) <= PART + length:
            row, *rest = _segments(d, o, length)
            yield row + i, *rest
        else:  # one long text
            for a in range(0, len(d) - length + 1, PART):
                part = d[a : a + PART + length - 1]
                row, start, *rest = _segments(part, np.array([0, len(part)]), length)
                yield row + i, start + a, *rest


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts; copies of a text within a batch count together (column w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(2))
            doc, doc2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, first, many = np.unique(np.rec.fromarrays([doc, doc2]), return_index=True, return_counts=True)
            weight = np.zeros(len(doc), np.int64)
            weight[first] = many
            for row, start, n, gram, content, more in _parts(data, offsets, length):
                keep = weight[row] > 0
                row = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[keep].view(np.int64), content[keep].view(np.int64), more[keep].view(np.int64), doc[row], doc2[row], start[keep], n[keep].astype(np.int32), weight[row])], [*_SEGMENT, "doc", "doc2", "start", "n", "w"])

    return mapped(docs, run, "gram long, content long, more long, doc long, doc2 long, start long, n int, w long")


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of segments laid end to end (``ends`` per segment); each suffix ends with its
    segment, a shorter one before a longer one that continues it, ties in order of segments.

    Larsson-Sadakane: suffixes sorted by ``h`` bytes are sorted by 2 h with the ranks ``h`` further on as
    second keys; only groups not yet told apart are sorted again.
    """
    n, segments = len(data), len(ends)
    seg = np.repeat(np.arange(segments, dtype=np.int32), np.diff(np.append(0, ends)))
    left = (ends[seg] - np.arange(n)).astype(np.int32)
    padded = np.append(data, np.zeros(8, np.uint8))
    key = np.zeros(n, U64)
    for b in range(7):
        key = (key << U64(8)) | np.where(b < left, padded[b : b + n], 0).astype(U64)
    key = (key << U64(8)) | np.minimum(left, 7).astype(U64)
    order = np.argsort(key).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    del key, padded
    rank = np.empty(n, np.int32)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts.astype(np.int32), np.diff(np.append(starts, n)))  # a group's rank: its first place
    h = 7
    while True:
        size = np.diff(np.append(starts, n))
        places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(places):
            return order, rank
        at = order[places]
        second = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + segments, seg[at])
        both = rank[at].astype(np.int64) * (n + segments) + second
        turn = np.argsort(both)
        at, both = at[turn], both[turn]
        order[places] = at
        cut = np.ones(len(at), bool)
        cut[1:] = both[1:] != both[:-1]
        new[places] = cut
        starts = np.flatnonzero(new)
        cut = np.flatnonzero(cut)
        rank[at] = np.repeat(places[cut].astype(np.int32), np.diff(np.append(cut, len(at))))
        h *= 2


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length that each suffix shares with its predecessor in ``order``, by place in the text.

    Kasai's lemma: where the bytes before a suffix and before its predecessor agree, its common prefix is one
    shorter than that of the suffix before; all others are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    seg = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    end = ends[seg]
    first = np.zeros(n, bool)
    first[np.append(0, ends[:-1])] = True
    at = np.arange(n)
    follows = (before >= 0) & ~first
    follows &= ~first[np.maximum(before, 0)]
    follows[follows] = data[at[follows] - 1] == data[before[follows] - 1]
    todo = np.flatnonzero(~follows & (before >= 0))
    most = np.minimum(end[todo] - todo, end[before[todo]] - before[todo])
    other, have = before[todo], np.zeros(len(todo), np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.arange(len(todo))
    while len(live):
        diff = words[todo[live] + have[live]] != words[other[live] + have[live]]
        step = np.where(diff.any(1), diff.argmax(1), 8)
        have[live] = np.minimum(have[live] + step, most[live])
        live = live[(step == 8) & (have[live] < most[live])]
    out = np.zeros(n, np.int64)
    out[todo] = have
    base = np.maximum.accumulate(np.where(follows, 0, at))
    out[follows] = np.maximum(out[base[follows]] - (at[follows] - base[follows]), 0)
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ``length`` bytes at each place also start elsewhere in the shard, and the number of the
    string there (equal strings have equal numbers, -1 where a segment ends before)."""
    order, _ = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order)
    alike = shared[order] >= length  # with the predecessor
    hit = alike.copy()
    hit[:-1] |= alike[1:]
    out, number = np.zeros(len(data), bool), np.empty(len(data), np.int64)
    out[order] = hit
    number[order] = np.cumsum(~alike)
    seg = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    number[ends[seg] - np.arange(len(data)) < length] = -1
    return out, number


def _ranges(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], member.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MARKS = "gram long, content long, more long, a int, b int"
#: What a shard of a gram that has several gives besides: its different strings by bucket (hashes, and the strings end
#: to end), and one row with all its starts (bucket null; segment, place and hash of each).
_RUNS = _MARKS + ", shard int, bucket int, hashes array<long>, strings binary, contents array<long>, mores array<long>, places array<int>"
_NAMES = _RUNS.replace(",", "").split()[::2]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
_TYPES = [_KINDS[k] for k in _RUNS.replace(",", "").split()[1::2]]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of _RUNS with the given columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Marks [a, b) of repeated starts of segments sorted by (gram, shard), and the runs of shards of which their
    gram has several."""
    for table, starts in sorted_groups(batches, 2):
        data, offsets = column(table.column("bytes"))
        gram, content, more, spread = (table.column(c).to_numpy() for c in (*_SEGMENT, "shards"))
        shard = table.column("shard").to_numpy()
        bounds, a = np.append(starts, table.num_rows), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(offsets[bounds], offsets[bounds[a]] + SHARD_BYTES, "right")) - 1)
            b = min(b, len(starts))
            groups, lo, hi = range(a, b), bounds[a], bounds[b]
            a = b
            text, ends = data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
            hit, number = repeated_starts(text, ends, length)
            x, y = _ranges(hit)
            seg = np.searchsorted(ends, x, "right") + lo
            # a range of marks never crosses segments: the last length - 1 places of each are not starts
            base = offsets[seg] - offsets[lo]
            yield _rows(len(x), gram=gram[seg], content=content[seg], more=more[seg], a=(x - base).astype(np.int32), b=(y - base).astype(np.int32))
            sums = None
            for g in groups:
                first, last = bounds[g], bounds[g + 1]
                buckets = int(spread[first])
                if buckets < 2:
                    continue
                sums = prefix_hash(text) if sums is None else sums
                at = np.arange(offsets[first] - offsets[lo], offsets[last] - offsets[lo])
                at = at[number[at] >= 0]
                seg = np.searchsorted(ends, at, "right") + lo
                h = range_hash(sums, at, at + length)
                one = {"gram": gram[first : first + 1], "shard": shard[first : first + 1]}
                place = (at - (offsets[seg] - offsets[lo])).astype(np.int32)
                yield _rows(1, **one, hashes=[h.view(np.int64)], contents=[content[seg]], mores=[more[seg]], places=[place])
                _, lead = np.unique(number[at], return_index=True)
                bucket = (h[lead] % U64(buckets)).astype(np.int32)
                for k in np.unique(bucket).tolist():
                    mine = lead[bucket == k]
                    strings = text[at[mine][:, None] + np.arange(length)].tobytes()
                    yield _rows(1, **one, bucket=[k], hashes=[h[mine].view(np.int64)], strings=[strings])


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of the runs of one gram and bucket, a row for each shard, the hashes of strings that other shards have too:
    sorted strings of every run are looked up in those before it by binary search. Rows come sorted by (gram, bucket)."""
    for table, starts in sorted_groups(batches, 2):
        bounds = np.append(starts, table.num_rows)
        gram, shard = table.column("gram").to_numpy(), table.column("shard").to_numpy()
        lists = table.column("hashes").combine_chunks()
        at, hashes = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        data, _ = column(table.column("strings"))
        strings = np.ascontiguousarray(data).view(f"S{length}")  # all of one length, so zeros at ends do not matter
        base = at[0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            seen, found = np.zeros(0, strings.dtype), [np.zeros(0, np.int64)]
            for i in range(a, b):
                mine, own = strings[at[i] - base : at[i + 1] - base], hashes[at[i] : at[i + 1]]
                order = np.argsort(mine, kind="stable")
                run = mine[order]
                where = np.searchsorted(seen, run)
                have = np.zeros(len(run), bool)
                inside = where < len(seen)
                have[inside] = seen[where[inside]] == run[inside]
                found.append(own[order[have]])
                seen = np.insert(seen, where[~have], run[~have])
            hit = np.unique(np.concatenate(found))
            if not len(hit):
                continue
            some = [hashes[at[i] : at[i + 1]][np.isin(hashes[at[i] : at[i + 1]], hit)] for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[a:b]), pa.array(shard[a:b]), pa.array(some, pa.list_(pa.int64()))], ["gram", "shard", "hits"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the starts of shards whose strings other shards have too (``hits``)."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c))[i].values)  # noqa: E731, B023
            some = np.isin(get("hashes"), get("hits"))
            content, more, place = get("contents")[some], get("mores")[some], get("places")[some]
            new = np.append(True, (content[1:] != content[:-1]) | (more[1:] != more[:-1]) | (place[1:] != place[:-1] + 1))[: len(place)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place))[: len(first)] - 1
            gram = np.full(len(first), batch.column(batch.schema.get_field_index("gram"))[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, content[first], more[first], place[first].astype(np.int32), (place[last] + 1).astype(np.int32))], ["gram", "content", "more", "a", "b"])


def repeats(docs: DataFrame, length: int = 200, shard_segments: int = SHARD_SEGMENTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc, doc2, spans) of the texts of ``docs`` (longs doc and doc2, alike for copies; text) that have bytes to
    remove: spans is an array of (a, b) ranges of starts, so that bytes a to b + length - 1 go."""
    text_id = ["doc", "doc2"]
    found = materialize(_scan(docs.select(*text_id, "text"), length))
    grams = materialize(found.groupBy("gram").agg(F.sum("w").alias("times"), F.count("*").alias("n")).where("times > 1").drop("times"))
    live = materialize(join_hot(found.select(*_SEGMENT, *text_id, "start", F.col("n").alias("starts"), "w"), grams, ["gram"], hot_rows).groupBy(*_SEGMENT, *text_id, "start", "starts").agg(F.sum("w").alias("w")))
    one = materialize(live.groupBy(*_SEGMENT).agg(F.sum("w").alias("w"), F.count("*").alias("rows"), F.min(F.struct(*text_id, "start", "starts")).alias("of")))
    different = one.groupBy("gram").agg(F.count("*").alias("n"))
    copies = one.where("w > 1").select(*_SEGMENT, F.lit(0).alias("a"), F.col("of.starts").alias("b"))

    several = materialize(different.where("n > 1").select("gram", "n", F.ceil(F.col("n") / shard_segments).cast("int").alias("shards")))
    wanted = join_hot(one, several, ["gram"], hot_rows).select("gram", F.pmod("content", "shards").cast("int").alias("shard"), "shards", "content", "more", *(F.col(f"of.{c}").alias(c) for c in (*text_id, "start", "starts")))
    wanted = wanted.groupBy(*text_id).agg(F.collect_list(F.struct("gram", "shard", "shards", "content", "more", "start", "starts")).alias("cuts"))
    texts = docs.select(*text_id, "text").dropDuplicates(text_id).join(wanted, text_id).select(F.encode("text", "UTF-8").alias("raw"), F.explode("cuts").alias("c"))
    cut = texts.select("c.gram", "c.shard", "c.shards", "c.content", "c.more", F.expr(f"substring(raw, cast(c.start as int) + 1, c.starts + {length - 1})").alias("bytes"))
    dealt = cut.repartition("gram", "shard").sortWithinPartitions("gram", "shard")

    def shards(batches):
        return _shards(batches, length)

    def merge(batches):
        return _merge(batches, length)

    sorted_ = materialize(mapped(dealt, shards, _RUNS))
    runs = sorted_.where("strings is not null").select("gram", "bucket", "shard", "hashes", "strings")
    across = mapped(runs.repartition("gram", "bucket").sortWithinPartitions("gram", "bucket", "shard"), merge, "gram long, shard int, hits array<long>")
    hits = across.groupBy("gram", "shard").agg(F.flatten(F.collect_list("hits")).alias("hits"))  # as many as a shard has strings, at most
    starts = sorted_.where("places is not null").select("gram", "shard", "contents", "mores", "places", "hashes")
    merged = mapped(starts.join(hits, ["gram", "shard"]), _placed, _MARKS)
    marks = copies.union(sorted_.where("a is not null").select(*_SEGMENT, "a", "b")).union(merged)
    ranges = marks.groupBy(*_SEGMENT).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # as many as a segment has starts, at most
    ranges = materialize(ranges.join(one.select(*_SEGMENT, F.col("rows").alias("n")), _SEGMENT))
    spans = join_hot(live, ranges, _SEGMENT, hot_rows).select(*text_id, "start", F.explode("ranges").alias("r"))
    return spans.groupBy(*text_id).agg(F.collect_list(F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))).alias("spans"))


def _keep(data: np.ndarray, offsets: np.ndarray, spans: pa.ListArray, length: int, text: bool) -> tuple[list, list, list]:
    at = np.asarray(spans.offsets)
    flat = spans.values
    a_all, b_all = (np.asarray(flat.field(k)) for k in ("a", "b"))
    removed, runs, out = [], [], []
    valid = spans.is_valid().to_pylist()
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = data[lo:hi]
        if valid[i] and at[i + 1] > at[i]:
            edge = np.zeros(len(own) + 1, np.int32)
            np.add.at(edge, a_all[at[i] : at[i + 1]], 1)
            np.add.at(edge, np.minimum(b_all[at[i] : at[i + 1]] + length - 1, len(own)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            own = own[~gone]
        else:
            removed.append(0)
            runs.append(0)
        raw = own.tobytes()
        out.append(raw.decode("utf-8", "ignore") if text else hashlib.sha256(raw).hexdigest())
    return removed, runs, out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, digest: bool = False, **how) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, and the text without every byte that is covered by a string
    of ``length`` bytes which starts anywhere else too, in the same text or another; or, with ``digest``, the
    column kept_sha256 of the bytes left instead of the text.

    Strings are judged on the input and never cross rows; rows with equal texts repeat each other. Null texts
    are empty and shorter ones lose nothing; a cut inside a character takes the whole character from a text,
    while digests are those of the exact bytes. Other columns pass unread; the new ones replace those of their names.
    """
    doc, doc2, spans = (free_name(c, docs.columns) for c in ("__doc", "__doc2", "__spans"))
    content = F.coalesce(F.col(text), F.lit(""))
    named = lambda a, b: [F.xxhash64(content, F.length(content)).alias(a), F.xxhash64(F.lit(1), content).alias(b)]
    long_enough = F.octet_length(content) >= length
    some = docs.where(long_enough)
    found = materialize(repeats(some.select(*named("doc", "doc2"), content.alias("text")), length, **how)).select(F.col("doc").alias(doc), F.col("doc2").alias(doc2), F.col("spans").alias(spans))
    # texts with very many copies, and those too short to lose anything, stay where they lie
    many = some.select(*named(doc, doc2)).groupBy(doc, doc2).count().where(F.col("count") > how.get("hot_rows", HOT_ROWS))
    hot = broadcast_if_small(materialize(many.select(doc, doc2).join(found, [doc, doc2])))
    keyed = some.select("*", *named(doc, doc2))
    cold = keyed.join(hot.select(doc, doc2), [doc, doc2], "left_anti").join(found, [doc, doc2], "left")
    short = docs.where(~long_enough).withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))
    both = keyed.join(hot, [doc, doc2]).select(*docs.columns, spans).union(cold.select(*docs.columns, spans)).union(short)
    k, m = both.columns.index(text), both.columns.index(spans)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = column(batch.column(k))
        removed, runs, out = _keep(data, offsets, batch.column(m), length, not digest)
        return [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, pa.string())]

    counts = ["n_bytes", "n_removed", "n_spans"]
    if digest:
        fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("kept_sha256", T.StringType())]
        return add_columns(both, one, fields, drop=(text, spans))
    # the text's own name carries the rest of it; an untouched null stays null
    rest, null = free_name("__kept", both.columns), free_name("__null", both.columns)
    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(rest, T.StringType())]
    made = add_columns(both.withColumn(null, F.col(text).isNull()), one, fields, drop=(text, spans))
    new = F.when(~F.col(null), F.col(rest)).alias(text)
    return made.select(*(new if c == text else c for c in docs.columns if c.lower() not in counts), *counts)
