"""The stages of the corpus pipeline, each against a plain form, and all of them together."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from holdfast.llm import mixing, queries, tokens

FOLDER = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "é " * 30000), (9005, "one"), (9005, "another with the same id"), (None, "no id"), (None, "no id either")]


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents and odd rows, with columns that clash with names in use inside the stages."""
    old = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in ODD], old.schema)
    return old.union(odd).selectExpr("*", "1 as __key", "2 as row", "3 as n_removed", "4 as spans", "5 as score", "6 as size")


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxicity(spark, docs):
    got = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert got.columns == docs.columns
    toxic = {r["doc_id"] for r in queries.op5_toxicity(spark, FOLDER).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in got.where("doc_id < 9000").collect()}
    every = {r["doc_id"] for r in docs.where("doc_id < 9000").collect()}
    assert len((every - toxic) ^ kept) <= 2  # the model here is fitted with the odd rows beside the others
    assert rows(got.where("doc_id > 9000 or doc_id is null")) == rows(docs.where("doc_id > 9000 or doc_id is null"))
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), FOLDER).count() == 0


def test_repeats(spark, docs):
    some = docs.where("length(text) < 4000 or text is null")
    got = corpus_pipeline.drop_repeats(spark, some, FOLDER)
    assert got.columns == some.columns
    texts = [(r["doc_id"], r["text"]) for r in some.collect()]
    times = Counter(b[i : i + 200] for _, t in texts for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not gone.any():
            want[(i, t)] += 1
        elif left.strip(" "):
            want[(i, left)] += 1
    assert rows(got) == want and {r["n_removed"] for r in got.collect()} == {3}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_mixing(spark, docs):
    got = corpus_pipeline.mix_sources(spark, docs, FOLDER)
    assert got.columns == docs.columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = {(r["doc_id"], r["size"]): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["size"])] += r["taken"]
    by_id, taken = Counter(), Counter()
    for (i, _), n in want.items():
        by_id[i] += n
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r["doc_id"]].append(words(r["text"]))
    for r in got.collect():
        own = words(r["text"])
        taken[r["doc_id"]] += len(own)
        assert any(own == w[: len(own)] for w in whole[r["doc_id"]])
    assert all(taken[i] == by_id[i] for i in by_id)


def test_packing(spark, docs):
    got = corpus_pipeline.pack_sequences(spark, docs.where("doc_id > 9000"), FOLDER).collect()
    plain = tokens.load(queries.tokenizer_path())
    pieces = Counter()
    for i, t in [x for x in ODD if x[0]]:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            pieces[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces


def test_all_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known, fill = {r["doc_id"] for r in docs.collect()}, defaultdict(list)
    for r in got:
        assert r["doc_id"] in known
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(fill) <= -(-total // 2048) + 2
    # step by step gives the same documents
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), step.schema)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in step.collect())
