"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.arrow import mapped
from holdfast.llm.store import materialize
from holdfast.llm.textscan import chunks, column

#: Documents that one task packs together.
GROUP_ROWS = 50_000
#: Sequences filled less than this give their documents to the next round.
FULL = 0.985

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
_encoders: dict = {}


def _encoder(path: str):
    from holdfast.llm.tokens import Encoder

    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end: int = 0) -> DataFrame:
    """Token pieces of each whole text: its ids and then ``end``, cut only if longer than ``length``; the
    first piece is then the short one. Null texts are empty, so each row gives one piece at least. ``salt`` is a
    number of the piece's own, from 0: its task and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, done = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = column(batch.column(1))
            for i, j, d, o in chunks(data, offsets):
                ids, at = encode.chunk(d, o)
                total = np.diff(at) + 1
                count = -(-total // length)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                first = (total - (count - 1) * length)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * length)
                size = np.where(piece == 0, first, length)
                closed = np.full(len(ids) + j - i, end, "<u4")  # each document's ids, then the end
                closed[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(at))] = ids
                raw, base = closed.tobytes(), (at[:-1] + np.arange(j - i))[row] + start
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(base.tolist(), size.tolist(), strict=True)), np.int64, len(row))
                salt = (task << 40) + done + np.arange(len(row))
                done += len(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc), pa.array(salt)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, PIECES)


def best_fit_decreasing(size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; larger items first, each into the fullest bin that still holds it."""
    order = np.argsort(-size, kind="stable").tolist()
    where, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    free: list[list[int]] = [[] for _ in range(length + 1)]  # bins by the room they have
    mask, bins, sizes = 0, 0, size.tolist()
    for i in order:
        n = sizes[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            bin_, room, bins = bins, length, bins + 1
        where[i], offset[i] = bin_, length - room
        if left := room - n:
            free[left].append(bin_)
            mask |= 1 << left
    return where, offset


def lower_bound(size: np.ndarray, length: int) -> int:
    """No packing has fewer bins: the best of three families of dual-feasible functions (the identity,
    thresholds that round large items up and drop small ones, and rounded multiples)."""
    if not len(size):
        return 0
    values, counts = np.unique(size, return_counts=True)
    best = -(-int((values * counts).sum()) // length)
    for low in np.unique(np.concatenate([values[2 * values <= length], [length // 2]])).tolist():
        big, mid = values > length - low, (values >= low) & (values <= length - low)
        best = max(best, int(counts[big].sum()) + -(-int((values * counts)[mid].sum()) // length))
    for k in range(1, 21):
        whole = (k + 1) * values % length == 0
        scaled = np.where(whole, values * k, (k + 1) * values // length * length)  # times k * length
        best = max(best, -(-int((scaled * counts).sum()) // (k * length)))
    return best


_PACKED = ("sequence_id", "offset", "group_sequences", "group_bound")


def _packer(names: list[str], length: int, turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("salt", kind="stable")
        size = pdf["length"].to_numpy(np.int64)
        where, offset = best_fit_decreasing(size, length)
        filled = np.bincount(where, size).astype(np.int64)
        base = ((turn << 20) + int(pdf["group"].iloc[0])) << 32
        return pdf[names].assign(sequence_id=base + where, offset=offset, group_sequences=len(filled), group_bound=lower_bound(size, length), filled=filled[where])

    return run


def pack(items: DataFrame, length: int = 2048, group_rows: int = GROUP_ROWS, rounds: int = 3, full: float = FULL) -> DataFrame:
    """``items`` (a table read again alike, with columns length, and salt: numbers from 0, each different) with
    sequence_id, offset, and the number of sequences of the group it was packed in beside its lower bound.

    Items of the full length take a sequence each. The others are dealt at random to groups of about
    ``group_rows``, each packed best-fit decreasing and held against its own lower bound. A group that meets the
    bound is certified: no packing of it is better, and it stays as it is. Groups above theirs keep the sequences
    filled to ``full``; documents of their sequences with gaps are dealt anew among each other and packed again, for
    ``rounds`` rounds or until every group is certified or one group is left. Items must have 1 to ``length`` tokens.
    """
    names = [c for c in items.columns if c not in (*_PACKED, "group", "filled")]
    items = items.select(*names)
    long = lambda n: F.lit(n).cast("long")
    schema = items.withColumns({c: long(0) for c in (*_PACKED, "filled")}).schema
    whole = items.where(F.col("length") == length).select(*names, F.bitwise_not("salt").alias("sequence_id"), long(0).alias("offset"), long(1).alias("group_sequences"), long(1).alias("group_bound"))
    done, left = [whole], items.where(F.col("length") < length)
    for turn in range(rounds + 1):
        count = left.count()
        if not count:
            break
        groups = -(-count // group_rows)

        dealt = left.withColumn("group", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(_packer(names, length, turn), schema))
        stays = (F.col("group_sequences") == F.col("group_bound")) | (F.col("filled") >= int(full * length))
        last = turn == rounds or (turn and groups == 1)
        done.append(packed.where(F.lit(bool(last)) | stays).select(*names, *_PACKED))
        if last:
            break
        left = packed.where(~stays).select(*names)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end: int = 0, **how) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    group_sequences and group_bound, the certificate of the group that the piece was packed in. Repeated rows are packed each; an empty table gives no rows; other columns are unread."""
    made = materialize(pieces(docs, tokenizer, doc_id, text, length, end))
    return pack(made, length, **how).drop("salt")
