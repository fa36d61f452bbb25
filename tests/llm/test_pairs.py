"""Neighbours, vector copies, SimHash and suffix dedup against brute force, with odd rows among them."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from holdfast.llm import ann, embdedup, graph, simhash, suffixes

FOLDER = "/root/testdata/sf0.001"


def vectors(spark, n=300, dim=16, extra=()):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((n, dim))
    base[50:90] = base[50] + 0.02 * rng.standard_normal((40, dim))
    base[90:95] = base[90]
    rows = [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(base)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0] * 3, 1), (905, [float("inf")] * 16, 1)]


def test_neighbours_have_recall_and_exact_scores(spark):
    v = vectors(spark, extra=ODD)
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), k=5).collect()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in v.where("vec_id < 900").collect()}
    right = 0
    for q in [i for i in x if i % 20 == 0]:
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 for r in mine)
        right += len({r["vec_id"] for r in mine} & set(best))
    assert right >= 0.9 * 5 * 15
    assert not {r["query_id"] for r in got} & {r[0] for r in ODD}


def test_neighbours_of_few_and_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(v, v.where("vec_id = 1"), k=20).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0)]
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    v = spark.createDataFrame([(20, [1.0, 1.0]), (20, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    want = [(1, 2, 3.0), (2, 2, 3.0), (3, 20, 2.0), (4, 3, 1.0)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(v, v.where("vec_id = 20"), k=20).collect())
    assert got == sorted(want * 2)
    assert sorted(r["vec_id"] for r in ann.nearest(v, v.where("vec_id = 20").limit(1), k=3).collect()) == [2, 2, 20]


@pytest.mark.parametrize("params", [embdedup.Cells(), embdedup.Cells(cell_rows=20, block_rows=16)])
def test_vector_copies(spark, params):
    v = vectors(spark, extra=[*ODD, (906, [1.0] * 16, None)]).selectExpr("*", "1 as id", "'x' as unit", "2 as w")
    rows = [r for r in v.collect()]
    good = [r for r in rows if r["vec_id"] < 900 and r["label"] is not None]
    u = {r["vec_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in good}
    label = {r["vec_id"]: r["label"] for r in good}
    near = {i: {j for j in u if j != i and label[i] == label[j] and u[i] @ u[j] >= 0.98} for i in u}
    assert sum(map(len, near.values())) > 100

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    want = sorted((r["vec_id"], len(near.get(r["vec_id"], ())), reach(r["vec_id"]), reach(r["vec_id"]) == r["vec_id"]) for r in rows)
    assert sorted(tuple(r) for r in embdedup.near_duplicates(v, params=params).collect()) == want
    assert embdedup.near_duplicates(v.limit(0)).count() == 0


def test_vector_copies_of_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1.0, 0.0]), (4, [1e200, 0.0]), (5, [2e200, 1e190]), (6, [0.0, 1.7e308]), (7, [0.0, 5e-324]), (8, [1e308, 1e308]), (9, [-1e-300, 0.0]), (3, [4.0, 0.0])]
    got = embdedup.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    want = [(i, {1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 6: 1, 7: 1, 8: 0, 9: 0}[i], {2: 1, 3: 1, 4: 1, 5: 1, 7: 6}.get(i, i), i in (1, 6, 8, 9)) for i, _ in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_forest_of_random_links():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n, m = 400, int(rng.integers(1, 700))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        up = list(range(n))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        assert graph.forest(n, a, b).tolist() == [top(x) for x in range(n)]


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [(1, "The quick  brown\tfox"), (2, "the QUICK brown fox"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "One two"), (8, "É é   x y"), (9, "a b c " * 30000), (None, "no id at all"), (9, "a b c " * 30000), (10, "x\x00y z \x1c w")]


def documents(spark):
    extra = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").selectExpr("doc_id + 100 as doc_id", "text").union(extra).selectExpr("*", "'c' as fingerprint", "1 as component_id", "2 as node")


@pytest.mark.parametrize("largest, flips", [(2048, 2048), (1, 2048), (2048, 2)])
def test_simhash(spark, largest, flips, monkeypatch):
    monkeypatch.setattr(simhash, "BY_FLIPS", flips)
    docs = documents(spark)
    want = Counter((r["doc_id"], fingerprint(r["text"])) for r in docs.collect())
    got = simhash.near_duplicates(docs, largest=largest).collect()
    assert Counter((r["doc_id"], r["fingerprint"] % 2**64) for r in got) == want
    prints = sorted({f for _, f in want})
    near = {f: [g for g in prints if (f ^ g).bit_count() <= 2] for f in prints}
    owner = {}
    for (i, f), _ in want.items():
        if i is not None:
            owner[f] = min(owner.get(f, i), i)

    def reach(f):
        seen, todo = {f}, [f]
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        return min((owner[g] for g in seen if g in owner), default=None)

    assert all(r["component_id"] == reach(r["fingerprint"] % 2**64) for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    planted = set(base)
    for f in base[:20]:
        for _ in range(6):
            a, b = rng.integers(0, 64, 2)
            planted.add(f ^ (1 << int(a)) ^ (1 << int(b)))
    prints = sorted(planted)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(prints)], "node long, fp long")
    want = graph.forest(len(prints), *map(np.array, zip(*[(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], strict=True)))
    for largest in (2048, 1):
        got = {r["node"]: r["component"] for r in graph.components(simhash.links(df, largest=largest)).collect()}
        assert all(got.get(i, i) == want[i] for i in range(len(prints)))


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    a, b, c = 0b1, 0b111, 0b1111  # two bits, one bit, three bits apart
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_, **__: docs.selectExpr("doc_id", "cast(text as long) as fingerprint"))
    rows = [(1, str(a)), (None, str(b)), (3, str(c)), (9, str(7 << 40)), (None, str(7 << 50))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["fingerprint"], r["doc_id"], r["component_id"]) for r in got) == [(a, 1, 1), (b, None, 1), (c, 3, 1), (7 << 40, 9, 9), (7 << 50, None, None)]


def test_large_groups_by_flipped_bits():
    rng = np.random.default_rng(5)
    for width, n in ((16, 900), (10, 300), (32, 400)):
        fp = np.unique(np.uint64(77) << np.uint64(50) | rng.integers(0, 1 << width, n).astype(np.uint64))
        rng.shuffle(fp)
        assert (simhash._by_flips(fp, 2) == simhash._by_pairs(fp, np.array([0]), 2)).all()


def test_simhash_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8), (2, "a b c d e", 8), (3, "quite another text than that", 9), (None, "x", 1)], "doc_id long, text string, __turn int")
    assert sorted((r["doc_id"] or 0, r["__turn"]) for r in simhash.deduplicate(docs).collect()) == [(0, 1), (1, 7), (3, 9)]


@pytest.mark.parametrize("cap", [4096, 3])
def test_suffix_dedup(spark, cap):
    extra = [(10001, "ab" * 400), (10002, None), (10003, ""), (10004, "x" * 199), (10005, "é" * 150), (10006, "q" * 200 + "z"), (10007, "x" * 20000), (10008, "ab" * 300 + "c" * 250), (10009, "y" * 201)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).union(docs.where("doc_id = 7")).selectExpr("*", "1 as __doc", "2 as spans")
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    times = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if times[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        want[(i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    got = suffixes.remove_repeats(docs, digest=True, shard_segments=cap)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    parts = [b"banana", b"bandana", b"banana", b"a"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    suffix = [(parts[np.searchsorted(ends, i, "right")][i - ([0, *ends][np.searchsorted(ends, i, "right")]) :], int(np.searchsorted(ends, i, "right"))) for i in range(len(data))]
    order, rank = suffixes.suffix_array(data, ends)
    assert [suffix[i] for i in order] == sorted(suffix)
    shared = suffixes.common_prefixes(data, ends, order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = suffix[a][0], suffix[b][0]
        assert shared[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
