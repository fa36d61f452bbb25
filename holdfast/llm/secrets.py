"""Secret scans: Aho-Corasick keywords, anchored patterns at their hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.arrow import add_columns
from holdfast.llm.textscan import chunks, column, spans

# Digits of the number systems that public token formats use for their checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def crc_base62(token: bytes) -> bool:
    """The last six digits in base 62 are the CRC-32 of the thirty signs before them, behind a prefix with ``_``."""
    body = token.rpartition(b"_")[2]
    n, digits = zlib.crc32(body[:-6]), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.encode() == body[-6:]


def base58_check(token: bytes) -> bool:
    """The last four bytes of the number in base 58 start the double SHA-256 of the others."""
    n = 0
    for c in token.decode("ascii"):
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: bytes) -> bool:
    """The polynomial remainder of prefix and data, behind the last digit 1, is 1."""
    prefix, _, data = token.decode("ascii").lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


@dataclass(frozen=True)
class Kind:
    """A kind of secret. ``keywords``: lower-case ASCII, each match of ``pattern`` starts with one of them in some
    case; none: a match is a maximal run of hexadecimal digits. ``least``: signs that the pattern's last group needs, or the match where it has none. ``check``: decides on
    matches of enough signs, by what is embedded in them."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    least: int = 1
    check: Callable[[bytes], bool] | None = None


#: Patterns of bytes: all of them are ASCII, so matches are the same as on code points. Order is that of ``spans``.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 6),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), 20),
    Kind("hex", (), re.compile(rb"[0-9a-f]+"), 24),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[opusr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), check=crc_base62),
    Kind("npm", ("npm_",), re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), check=crc_base62),
    Kind("wallet", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), check=base58_check),
    Kind("age", ("age-secret-key-1",), re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![0-9A-Z])"), check=bech32_check),
)
BASE = ("assign", "access", "hex")
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789abcdef")] = True


def _automaton(kinds: tuple[Kind, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    of: dict[str, list[int]] = {}
    for i, kind in enumerate(kinds):
        for word in kind.keywords:
            of.setdefault(word, []).append(i)
    for word, at in of.items():
        found.add_word(word, (len(word), at))
    if of:
        found.make_automaton()
    return found if of else None


def _hits(raw: bytes, data: np.ndarray, offsets: np.ndarray, kinds: tuple[Kind, ...], automaton) -> list[tuple[int, int]]:
    """(kind, place) where a match may start, in order: keywords, and runs of enough hexadecimal digits."""
    hits = set()
    if automaton is not None:
        for end, (length, at) in automaton.iter(raw.lower().decode("latin-1")):  # a byte is a sign; lower() of bytes is ASCII's
            hits.update((i, end + 1 - length) for i in at)
    for i, kind in enumerate(kinds):
        if not kind.keywords:
            starts, ends, _ = spans(_DIGIT[data], offsets)
            hits.update((i, at) for at in starts[ends - starts >= kind.least].tolist())
    return sorted(hits)


def _scan(data: np.ndarray, offsets: np.ndarray, kinds: tuple[Kind, ...], automaton) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end), in bytes of the chunk, of what a chunk of rows holds."""
    raw = data.tobytes()
    out, done = [], (-1, 0)
    hits = _hits(raw, data, offsets, kinds, automaton)
    rows = np.searchsorted(offsets, [at for _, at in hits], "right") - 1
    for (i, at), row in zip(hits, rows.tolist(), strict=True):
        kind = kinds[i]
        if done[0] == i and at < done[1]:
            continue  # inside a match
        found = kind.pattern.match(raw, at, int(offsets[row + 1]))
        if found is None:
            continue
        done = (i, found.end())
        size = found.end(found.re.groups) - found.start(found.re.groups)
        if size >= kind.least and (kind.check is None or kind.check(found[0])):
            out.append((row, at, i, found.end()))
    return sorted(out)


def find(docs: DataFrame, text: str = "text", out: str = "secrets", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``out``: the secrets of each whole text as an array of (kind, start, end), in code points, the end
    exclusive, by start and then by the order of ``kinds``.

    Matches of a kind are leftmost and do not overlap; those too short, or with a wrong checksum, are dropped after
    they were matched. One pass of an Aho-Corasick automaton over lower-cased text finds keywords, and patterns are
    tried at these places only. Null and empty texts give empty arrays; repeated rows give repeated results; other
    columns pass unread, a column named ``out`` is replaced.
    """
    k = docs.columns.index(text)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = column(batch.column(k))
        automaton = _automaton(kinds)
        many = np.zeros(batch.num_rows, np.int64)
        names, starts, ends = [], [], []
        for first, _, d, o in chunks(data, offsets):
            found = _scan(d, o, kinds, automaton)
            if not found:
                continue
            signs = np.cumsum(np.append(0, (d & 0xC0) != 0x80))  # code points before each byte
            for row, a, i, b in found:
                many[first + row] += 1
                names.append(kinds[i].name)
                starts.append(int(signs[a] - signs[o[row]]))
                ends.append(int(signs[b] - signs[o[row]]))
        values = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), values)]

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return add_columns(docs, one, [T.StructField(out, T.ArrayType(span))])


def listed(found: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row: counts of the base kinds, digest of their
    places and the places of all kinds. See ``find`` for nulls, ties and repeated rows."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "secrets").drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
