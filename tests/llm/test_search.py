"""Ranked search against brute force, with odd rows, ties and blocks of items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import search

FOLDER = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        rows = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1):
            out[(item, rank, doc, -score)] += 1
    return out


ODD = [(None, "the word of no id"), (None, "the word of no id"), (7, "the word of no id"), (7, "the word of no id"), (8, None), (9, ""), (10, " -- "), (11, "\x01été\x7fNaïve_x " * 20000), (12, "longest " * 9 + "the of and")]


@pytest.mark.parametrize("params", [search.Search(k=7), search.Search(k=7, items=5, group=32, leaf=2, sample=40), search.Search(k=50, item_bytes=3000)])
def test_ranked_search(spark, params):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 as n", "2 as term", "'x' as score", "3 as item_id", "4 as row")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").where("item_id < 12")
    items = items.union(spark.createDataFrame([(900, None), (901, ""), (902, "nowhere-at-all-zzzz"), (903, "the"), (903, "of no ID id"), (None, "été longest"), (904, "the THE word of")], "item_id long, text string")).selectExpr("*", "1 as terms", "2 as place")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], params.k)
    assert Counter(tuple(r) for r in search.ranked(docs, items, params=params).collect()) == want
    assert search.ranked(docs.limit(0), items, params=params).count() == 0
    assert search.ranked(docs, items.limit(0), params=params).count() == 0


def test_trees_hold_maxima_and_prune():
    rng = np.random.default_rng(0)
    n, size = 400, 60
    rows = [np.sort(rng.choice(30, 8, replace=False)) + 30 * (i % 2) for i in range(n)]
    at, cols = np.arange(n + 1) * 8, np.concatenate(rows)
    vals = rng.integers(1, 1000, len(cols))
    tree = search.tree(at, cols, vals, np.ones(size, np.int64), size, 4)
    assert sorted(tree.order) == list(range(n)) and len(tree.child) == len(tree.levels) - 1
    dense = np.zeros((n, size), np.int64)
    dense[np.repeat(np.arange(n), 8), cols] = vals
    for first, a, c, v in (level for level in tree.levels if len(level[0]) > 1):
        for node in range(len(first) - 1):
            most = dense[tree.order[first[node] : first[node + 1]]].max(0) if len(tree.levels[-1][0]) == len(first) else None
            if most is not None:
                assert (np.flatnonzero(most) == c[a[node] : a[node + 1]]).all() and (most[most > 0] == v[a[node] : a[node + 1]]).all()
    items = (np.array([0, 3, 6]), np.array([1, 5, 9, 31, 40, 59]), np.array([7, 5, 3, 2, 9, 4]))
    found = search.search((at, cols, vals), np.arange(n), items, search.tree(*items, np.ones(size, np.int64), size, 1), size, np.zeros(2, np.int64), search.Search(k=5, leaf=4))
    for i in range(2):
        q = np.zeros(size, np.int64)
        q[items[1][3 * i : 3 * i + 3]] = items[2][3 * i : 3 * i + 3]
        best = sorted(range(n), key=lambda r: (-(dense[r] @ q), r))[:5]
        assert found.found[i][1].tolist() == best
