"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.arrow import add_columns, mapped
from holdfast.llm.textscan import LOWER, chunks, column, prefix_hash, range_hash, spans

# Phrases whose consecutive words give a label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of common license notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
}
# Whole public license texts, by label.
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
        at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program.""",
}
#: Wordings that set a label's template apart from others that share nearly all of its words.
TELLING = {
    "cc-by-nc": ("noncommercial", "non commercial"),
    "cc-by-sa": ("sharealike", "share alike"),
}

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


@dataclass(frozen=True)
class Scan:
    """Parameters: share of a template's words that a block must hold; words in a block, at least (twice as many as
    a whole license text has); words from one block to the next, where blocks do not start at every word."""

    containment: float = 0.8
    block: int = 64
    step: int = 32


class _Vocabulary:
    """Words of phrases and templates, known by their hashes; all others are word -1."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for x in texts for w in x.split()})
        text = " ".join(self.words).encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in self.words]) - 1
        starts = np.append(0, ends[:-1] + 1)
        hashes = range_hash(prefix_hash(np.frombuffer(text, np.uint8)), starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids(self, text: str) -> np.ndarray:
        return np.array([self.words.index(w) for w in text.split()])

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a chunk, and n + 1 offsets of its rows in them."""
        data = LOWER[data]
        starts, ends, at = spans(_WORD[data], offsets)
        h = range_hash(prefix_hash(data), starts, ends)
        where = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[where] == h, self.order[where], -1), at


def frequencies(docs: DataFrame, text: str, words: _Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary stands in all texts; counts are summed by Spark."""
    n = len(words.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, _, d, o in chunks(*column(batch.column(0))):
                ids, _ = words.read(d, o)
                total += np.bincount(ids[ids >= 0], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["word", "times"])

    out = np.zeros(n, np.int64)
    for row in mapped(docs.select(text), run, "word long, times long").groupBy("word").agg(F.sum("times")).collect():
        out[row[0]] = row[1]
    return out


def matches(ids: np.ndarray, at: np.ndarray, templates: list[np.ndarray], rank: np.ndarray, p: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, template and containment of each block that holds ``containment`` of a template's words.

    Words stand in order of global frequency, rarest first. A block can qualify only if it holds as many known
    words as are needed (length filter), one of the template's first words (prefix filter), and enough words
    from there on, in both (positional filter). The words of what is left are counted.
    """
    row = [np.zeros(0, np.int64)]
    known = np.flatnonzero(ids >= 0)
    of = np.searchsorted(at, known, "right") - 1
    inside = known - at[of]
    count = np.maximum(1, -(-(np.diff(at) - p.block) // p.step) + 1)  # blocks of each row
    first = np.append(0, np.cumsum(count))
    blocks, found = [], []
    for back in range(-(-p.block // p.step)):
        b = inside // p.step - back
        ok = (b >= 0) & (b < count[of]) & (inside - b * p.step < p.block)
        blocks.append(first[of[ok]] + b[ok])
        found.append(rank[ids[known[ok]]])
    size = len(rank)
    pair = np.unique(np.concatenate([np.zeros(0, np.int64), *blocks]) * size + np.concatenate([np.zeros(0, np.int64), *found]))
    block, word = pair // size, pair % size
    hold = np.searchsorted(block, np.arange(first[-1] + 1))
    many = np.diff(hold)
    kinds, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, template in enumerate(templates):
        mine = np.sort(rank[template])
        need = int(np.ceil(p.containment * len(mine) - 1e-9))
        prefix = mine[: len(mine) - need + 1]
        hit = np.flatnonzero(np.isin(word, prefix))
        cand, lead = np.unique(block[hit], return_index=True)
        lead = hit[lead]  # the block's first word among the template's prefix
        bound = np.minimum(len(mine) - np.searchsorted(mine, word[lead]), hold[cand + 1] - lead)
        cand = cand[(many[cand] >= need) & (bound >= need)]
        inner = np.isin(word, mine)
        sums = np.append(0, np.cumsum(inner))
        overlap = sums[hold[cand + 1]] - sums[hold[cand]]
        cand, overlap = cand[overlap >= need], overlap[overlap >= need]
        row.append(np.searchsorted(first, cand, "right") - 1)
        kinds.append(np.full(len(cand), k))
        shares.append(overlap / len(mine))
    return np.concatenate(row), np.concatenate(kinds), np.concatenate(shares)


def places(ids: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``phrase`` stand consecutively in one row, and those rows."""
    hit = np.arange(max(0, len(ids) - len(phrase) + 1))
    for step, w in enumerate(phrase):
        hit = hit[ids[hit + step] == w]
    of = np.searchsorted(at, hit, "right") - 1
    same = hit + len(phrase) <= at[of + 1]
    return hit[same], of[same]


def everywhere(ids: np.ndarray, at: np.ndarray, templates: list[np.ndarray], telling: list[list[np.ndarray]], blocks: list[int], rank: np.ndarray, p: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, template and largest containment where a block that starts at any word qualifies: it holds
    ``containment`` of the template's words and, where the template has telling wordings, one of these.

    A template's words stand in order of global frequency, rarest first. Only rows that hold enough of them are looked
    at (length filter), whose rarest one leaves enough behind it in that order (positional filter), and there only
    places within a block of one of the template's first words (prefix filter): a block without these can't qualify.
    Each place of a word counts for the starts from which it is the word's first place in the block, so sums give all
    blocks.
    """
    n, size = len(ids), len(rank)
    sums = lambda low, last: np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n]
    row, kinds, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, (template, tells, width) in enumerate(zip(templates, telling, blocks, strict=True)):
        need = int(np.ceil(p.containment * len(template) - 1e-9))
        place = np.full(size + 1, -1)  # in order of frequency; the last is word -1
        place[template[np.argsort(rank[template])]] = np.arange(len(template))
        pos = np.flatnonzero(place[ids] >= 0)
        if not len(pos):
            continue
        of = np.searchsorted(at, pos, "right") - 1
        many = np.bincount(np.unique(of * size + ids[pos]) // size, minlength=len(at) - 1)
        rarest = np.full(len(at) - 1, len(template))
        np.minimum.at(rarest, of, place[ids[pos]])
        some = (many >= need) & (len(template) - rarest >= need)
        pos, of = pos[some[of]], of[some[of]]
        lead = pos[place[ids[pos]] <= len(template) - need]
        if not len(lead):
            continue
        after = np.searchsorted(lead, pos)
        near = np.minimum(np.abs(lead[np.minimum(after, len(lead) - 1)] - pos), np.abs(pos - lead[np.maximum(after - 1, 0)])) < width
        pos, of = pos[near], of[near]
        order = np.lexsort((pos, ids[pos]))
        pos, of, word = pos[order], of[order], ids[pos[order]]
        again = np.append(False, (word[1:] == word[:-1]) & (of[1:] == of[:-1]))
        after = np.where(again, np.append(0, pos[:-1]) + 1, 0)
        held = sums(np.maximum(np.maximum(after, pos - width + 1), at[of]), pos)
        ok = held >= need
        if tells:
            told = np.zeros(n, bool)
            for phrase in tells:
                hit, r = places(ids, at, phrase)
                told |= sums(np.maximum(hit + len(phrase) - width, at[r]), hit) > 0
            ok &= told
        start = np.flatnonzero(ok)
        if len(start):
            rows, first = np.unique(np.searchsorted(at, start, "right") - 1, return_index=True)
            row.append(rows)
            kinds.append(np.full(len(rows), k))
            shares.append(np.maximum.reduceat(held[start], first) / len(template))
    return np.concatenate(row), np.concatenate(kinds), np.concatenate(shares)


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, params: Scan = Scan(), telling: dict[str, tuple[str, ...]] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score of each whole text
    instead of ``text``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Base places are those where
    a phrase's words stand consecutively; labels adds those of templates of which a block of words holds
    ``containment``. score is the largest share of a template in a block that qualifies, 1 where a phrase
    stands, else 0. Null and empty texts have no words and no labels; copies give like rows. Columns of ``docs`` with
    the names of new ones are replaced by these; all others pass.

    With ``telling`` (wordings by label, perhaps none) blocks start at every word, and a block gives one of these
    labels only if it holds one of its wordings too; ``texts`` are whole license texts besides, in blocks of twice
    their words. Without it blocks start every ``step`` words, and templates that share most words give each other's
    labels.
    """
    spell = lambda x: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()))
    whole = {label: spell(x) for label, x in (texts or {}).items()} if telling is not None else {}
    tells = [x for found in (telling or {}).values() for x in found]
    words = _Vocabulary([*phrases, *templates.values(), *whole.values(), *tells])
    spelled = [(words.ids(x), label) for x, label in phrases.items()]
    sets = [np.unique(words.ids(x)) for x in (*templates.values(), *whole.values())]
    names = [*templates, *whole]
    blocks = [params.block] * len(templates) + [max(params.block, 2 * len(x.split())) for x in whole.values()]
    times = frequencies(docs, text, words)
    rank = np.empty(len(times), np.int64)
    rank[np.lexsort((np.arange(len(times)), times))] = np.arange(len(times))
    told = [[words.ids(x) for x in (telling or {}).get(label, ())] for label in templates] + [[]] * len(whole)
    k = docs.columns.index(text)

    def one(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[list] = [[] for _ in range(7)]
        for i, j, d, o in chunks(*column(batch.column(k))):
            ids, at = words.read(d, o)
            n = j - i
            base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            labels: dict[int, set] = {}
            extra: dict[int, set] = {}
            score = np.zeros(n)
            for phrase, label in spelled:
                hit, of = places(ids, at, phrase)
                base += np.bincount(of, minlength=n)
                place = hit - at[of]
                for r, x in zip(of.tolist(), place.tolist(), strict=True):
                    labels.setdefault(r, set()).add(label)
                    first[r] = x if first[r] < 0 else min(first[r], x)
                    last[r] = max(last[r], x)
            score[list(labels)] = 1.0
            found = matches(ids, at, sets, rank, params) if telling is None else everywhere(ids, at, sets, told, blocks, rank, params)
            for r, kind, share in zip(*(x.tolist() for x in found), strict=True):
                extra.setdefault(r, set()).add(names[kind])
                score[r] = max(score[r], share)
            join = lambda found: ",".join(sorted(found))
            out[0].append(pa.array(np.diff(at)))
            out[1].append(pa.array(base))
            out[2].append(pa.array(first, mask=first < 0))
            out[3].append(pa.array(last, mask=last < 0))
            out[4].append(pa.array([join(labels.get(r, ())) for r in range(n)], pa.string()))
            out[5].append(pa.array([join(labels.get(r, set()) | extra.get(r, set())) for r in range(n)], pa.string()))
            out[6].append(pa.array(score))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return [pa.concat_arrays(x) if x else pa.nulls(0, t) for x, t in zip(out, kinds, strict=True)]

    fields = [T.StructField(c, t) for c, t in zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType()], strict=True)]
    return add_columns(docs, one, fields, drop=(text,))
