"""The near-copy stage of the pipeline against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from holdfast.llm import nearcopies

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """Smallest (doc_id is null, doc_id) of each group that five-word Jaccard 0.8 connects."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append((d is None, d or 0))
    return Counter(min(g) for g in groups.values())


def planted():
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows, i = [], 1000
    for size in (30, 60, 120, 400, 1000):
        base = [word() for _ in range(size)]
        rows.append((i, " ".join(base)))
        for changed in range(1, 8):
            copy = list(base)
            for at in rng.choice(size, min(changed * size // 150 + 1, size), replace=False):
                copy[at] = word()
            rows.append((i + changed, " ".join(copy).upper() if changed == 3 else "  ".join(copy)))
        i += 100
    rows += [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (5, " \n"), (6, "a b c d e"), (7, "a b c d e f"), (8, "reused one"), (8, "reused other"), (8, "reused other"), (None, "no id at all"), (None, "no id at all"), (None, "another without id"), (9, "é " * 30000)]
    return rows


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    old = [(r["doc_id"] + 10000, r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = old + planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __key", "2 as size", "3 as node").repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == brute_kept(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), FOLDER).count() == 0


def test_stage_links_members_that_do_not_match_the_first(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):  # neighbours in the chain are near copies, ends are not
        copy = list(base)
        copy[: 5 * k : 5] = [f"x{i}" for i in range(len(copy[: 5 * k : 5]))]
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((False, r["doc_id"]) for r in nearcopies.deduplicate(docs).collect())
    assert kept == brute_kept(rows) == Counter([(False, 0)])


def test_members_of_large_bands_are_grouped_without_loss(spark):
    rng = np.random.default_rng(8)
    common = list(range(1, 400))
    sets = []
    for i in range(60):
        base = set(rng.choice(common, int(rng.integers(1, 120)), replace=False).tolist()) | {1000 + i // 3}
        sets += [base, base | set(rng.integers(5000, 9000, len(base) // 8).tolist()), set(sorted(base)[: max(1, len(base) * 4 // 5)])]
    frame = spark.createDataFrame([(i, i, [int(x) for x in s]) for i, s in enumerate(sets)], "node long, component long, set array<long>")
    groups = {}
    for r in nearcopies._rarest(frame).collect():
        groups.setdefault(r["grp"], []).append(r["node"])
        assert r["n"] > 1
    together = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    near = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 5 * len(x & y) >= 4 * len(x | y)}
    assert near and near <= together


def test_stage_with_only_large_bands(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in nearcopies.deduplicate(docs, largest=1, block=4).collect())
    assert kept == brute_kept(rows)
