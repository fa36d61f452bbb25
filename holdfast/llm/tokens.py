"""Token ids of a byte-level BPE for whole Arrow batches.

The pre-tokenizer of the vocabulary splits a text into words whose ids do not depend on each
other. For texts of ASCII and Latin letters the split is done for a chunk at once with numpy and
only words not met before go through the tokenizer; every other text goes through it whole. The
ids are the same either way (tests compare them).
"""

from __future__ import annotations

import os

import numpy as np

from holdfast.llm.textscan import prefix_hash, range_hash

SPACE, LETTER, DIGIT, OTHER, UNSAFE = range(5)
_CLASS = np.full(256, UNSAFE, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[0x80:0xC0] = _CLASS[[0xC3, 0xC4, 0xC5]] = LETTER  # two-byte Latin letters, U+00C0 to U+017F
_ENDING = np.zeros(256, bool)
_ENDING[list(b"stmdrvl")] = True

#: Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_VISIBLE = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def load(path: str):
    """The tokenizer; special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Ids of chunks of texts. Words met are remembered, at most ``remember`` of them."""

    def __init__(self, path: str, remember: int = 400_000, split: bool = True):
        self.tok, self.remember, self.split = load(path), remember, split
        self.model = self.tok.model
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words, given with byte-level characters and in the order of their hashes."""
        ids = [[t.id for t in self.model.tokenize(w)] for w in words]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        at = (self.filled + np.cumsum(size) - size).astype(np.int32)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        where = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def _whole(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and n + 1 offsets of the rows in them."""
        n, kind = len(offsets) - 1, _CLASS[data]
        bad = kind == UNSAFE
        if len(data):
            bad[:-1] |= (data[:-1] == 39) & _ENDING[data[1:]]  # contractions have rules of their own
            bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        odd = np.add.reduceat(np.append(bad, False).astype(np.int64), offsets[:-1]) > 0 if n else np.zeros(0, bool)
        odd &= offsets[1:] > offsets[:-1]
        if not self.split:
            odd = offsets[1:] > offsets[:-1]
        flag = self._starts(data, kind, offsets)
        row_of = np.repeat(np.arange(n), np.diff(offsets))
        if odd.any():
            flag &= ~odd[row_of]
        starts = np.flatnonzero(flag)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if odd.any() and len(starts):
            ends = np.minimum(ends, offsets[row_of[starts] + 1])
        hashes = range_hash(prefix_hash(data), starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = self.known[where] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > self.remember:
                self.forget()
                new[:] = True
            raw = data.tobytes().decode("latin-1").translate(_VISIBLE)
            self._learn(unique[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            where = np.searchsorted(self.known, unique)
        at, size = self.at[where][back].astype(np.int64), self.size[where][back].astype(np.int64)
        row = row_of[starts] if len(starts) else starts
        per_row = np.bincount(row, size, n).astype(np.int64) if len(starts) else np.zeros(n, np.int64)
        whole = dict(zip(rows := np.flatnonzero(odd), self._whole(data, offsets, rows), strict=True)) if odd.any() else {}
        for i, x in whole.items():
            per_row[i] = len(x)
        out_at = np.concatenate([[0], np.cumsum(per_row)])
        total = int(size.sum())
        ids = self.pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        if whole:
            mixed, taken = np.empty(out_at[-1], np.uint32), 0
            keep = np.repeat(~odd, per_row)
            mixed[keep] = ids
            for i, x in whole.items():
                mixed[out_at[i] : out_at[i + 1]] = x
            ids = mixed
        return ids, out_at

    @staticmethod
    def _starts(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words of the split start. Runs of one class are words; one space before a run belongs to it."""
        flag = np.zeros(len(data), bool)
        if not len(data):
            return flag
        edge = np.empty(len(data), bool)
        edge[0] = True
        edge[1:] = kind[1:] != kind[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge[inner] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        space = kind[starts] == SPACE
        row_end = np.zeros(len(data) + 1, bool)
        row_end[offsets] = True
        follows = space & ~row_end[ends]  # white space with more text behind it in the same row
        flag[starts] = True
        last = ends[follows] - 1
        flag[last] = True  # the last white-space character starts a word: alone, or as the space before a run
        joined = last[data[last] == 32]
        flag[joined + 1] = False
        return flag
