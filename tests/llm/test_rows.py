"""Classifiers, mixing, licenses, packing and chat on odd rows, and the queries against SQL."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import chat, licenses, mixing, packing, quality, queries, tokens, toxicity
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name,label,folds,fold", [("op2_quality", "quality", 4, 2), ("op5_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, folds, fold):
    folder = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


ODD = [(1, None), (2, ""), (3, " "), (4, "word " * 40000), (5, "good text"), (5, "good text"), (None, "no id"), (6, "\x00\x01 ퟿")]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_any_rows(spark, module, label):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 as feature", "2 as label", "3 as `order`")
    labels = spark.createDataFrame([(5, 1), (5, 0), (2, 0), (3, None), (None, 1), (77, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        scored = module.classify(docs, module.train(docs, known, label=label), out="s").collect()
        assert len(scored) == len(ODD) and all(0 <= r["s"] <= 1 for r in scored)
        assert len({r["s"] for r in scored if r["doc_id"] in (1, 2, 3)}) == 1
    model = module.train(docs.limit(0), labels, label=label)
    assert module.classify(docs.limit(0), model, out="s").count() == 0


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        share = sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / share > most * sizes[n]]
        for n in over or free:
            out[n] = most * sizes[n] if over else left * w[n] / share
        left -= sum(out[n] for n in over)
        free = [n for n in free if n not in out]
    return out


def mixed_docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), "a" if i % 2 else str(rng.choice(["b", "c", "é"])), 9) for i in range(400)]
    rows += [(1000, "x " * 5000, "tiny", 1), (1001, None, None, 1), (1002, "q r s", None, 1), (1002, "q r s", None, 1), (1003, "", "void", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


@pytest.mark.parametrize("range_rows", [4096, 16])
def test_mix(spark, range_rows):
    docs = mixed_docs(spark)
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    got = mixing.mix(docs, range_rows=range_rows).collect()
    words = Counter()
    for r in docs.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken = waterfill(words), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == words[of[r["doc_id"]]]
        assert abs(r["target"] - want[of[r["doc_id"]]]) < 1e-6
        taken[of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1.001 for s in words)
    again = mixing.mix(docs.repartition(3), range_rows=range_rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_takes_the_rows_that_it_says(spark):
    docs = mixed_docs(spark)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken


def brute_license(text, p=licenses.Scan()):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, base, extra, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        for k in range(len(words) - len(own) + 1):
            if words[k : k + len(own)] == own:
                places.append(k)
                base.add(label)
                score = 1.0
    for a in range(0, max(1, len(words) - p.block + p.step), p.step):
        block = set(words[a : a + p.block])
        for label, template in licenses.TEMPLATES.items():
            own = set(template.split())
            if len(own & block) >= np.ceil(p.containment * len(own) - 1e-9):
                extra.add(label)
                score = max(score, len(own & block) / len(own))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | extra)), score


def test_licenses(spark):
    t = licenses.TEMPLATES
    drop = lambda s, n: " ".join(w for i, w in enumerate(s.split()) if i % n)
    texts = [None, "", "Under the MIT License!", "under the mit", "license. CC-BY-NC cc by nc", *t.values(), *(drop(s, 6) for s in t.values()), *(drop(s, 3) for s in t.values())]
    texts += ["filler " * k + s + " filler" * 50 for k in (1, 30, 63, 100) for s in t.values()] + ["é " * 50000 + "apache license, version 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as n_base")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute_license(text), text
    assert licenses.scan(docs.limit(0)).count() == 0


PIECES = ["a'b don't x  y\n\n z ", "  ", "\n a", "é×ç", "a \t b", "x y", " lead", "trail  \n", "日本 text", "", "a1b2!!c  !", "<|endoftext|>", "'s 'll''d", "É" * 300, "\x1c \x85 ʼn ǆ"]


def test_split_words_give_the_ids_of_the_tokenizer():
    import pyarrow as pa

    from holdfast.llm.textscan import column

    path = queries.tokenizer_path()
    plain, encoder = tokens.load(path), tokens.Encoder(path, remember=50)
    for _ in range(2):
        ids, at = encoder.chunk(*column(pa.array([*PIECES, None])))
        for k, text in enumerate([*PIECES, ""]):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    texts = [(i, t) for i, t in enumerate(PIECES)] + [(50, None), (51, "word " * 9000), (52, "w " * 2046), (53, "w " * 2047), (7, "again"), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' as salt", "1 as length")
    plain = tokens.load(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    ids = Counter()
    for i, text in texts:
        one = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        count = -(-len(one) // 2048)
        first = len(one) - (count - 1) * 2048
        for p in range(count):
            a, b = (0, first) if p == 0 else (first + (p - 1) * 2048, first + p * 2048)
            ids[(i, p, a, b - a, zlib.crc32(one[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_bounds_and_rounds(spark):
    rng = np.random.default_rng(4)
    for high in (50, 100):
        for _ in range(20):
            size = rng.integers(1, high + 1, 60)
            where, offset = packing.best_fit_decreasing(size, 100)
            assert np.bincount(where, size).max() <= 100 and packing.lower_bound(size, 100) <= where.max() + 1
    assert packing.lower_bound(np.array([60] * 9), 100) == 9 and packing.lower_bound(np.array([34, 34, 34]), 100) == 2
    sizes = rng.integers(1, 700, 3000)
    items = spark.createDataFrame([(i, int(s), int(h)) for i, (s, h) in enumerate(zip(sizes, rng.integers(0, 2**62, 3000), strict=True))], "doc_id long, length long, salt long").cache()
    out = packing.pack(items, 1000, group_rows=200).collect()
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == 3000 and max(fill.values()) <= 1000 and len(fill) <= -(-int(sizes.sum()) // 1000) * 1.01


SCHEMAS = [("f", "a", "string", True), ("f", "b", "integer", False)]


def test_calls_are_linked_ordered_and_validated(spark):
    calls = spark.createDataFrame([
        (1, "x", 0, "f", '{"b":2,"a":"q\\"é"}', ["z"]), (1, "z", 1, "f", '{"a":1}', None), (1, "z", 1, "f", '{"a":1}', None), (1, "y", 2, "g", "{}", ["x", "gone"]),
        (2, "p", 0, "f", "not json", ["q"]), (2, "q", 1, "f", "{}", ["p"]), (3, "a", 5, "f", '{"a":"1","b":null}', []), (3, "b", 6, "f", "[1]", ["a"]), (3, None, 7, "f", "{}", []), (None, "n", 1, "f", "{}", []),
    ], "conv_id long, call_id string, position long, tool string, arguments string, after array<string>").selectExpr("*", "1 as level", "2 as status")
    results = spark.createDataFrame([(1, "x", 9, "first"), (1, "x", 10, "second"), (1, "lost", 3, None), (3, "a", 8, "line\nbreak")], "conv_id long, call_id string, position long, content string")
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls, results, schemas).collect()}
    level = {k: r["level"] for k, r in got.items()}
    assert level == {(1, "z"): 0, (1, "x"): 1, (1, "y"): 2, (2, "p"): None, (2, "q"): None, (3, "a"): 0, (3, "b"): 1, (1, "lost"): None}
    assert {k: (r["status"], r["problems"]) for k, r in got.items()} == {
        (1, "x"): ("linked", ""), (1, "z"): ("no result", "type of a"), (1, "y"): ("no result", "unknown tool"), (2, "p"): ("no result", "arguments are no object"), (2, "q"): ("no result", "missing a"),
        (3, "a"): ("linked", ""), (3, "b"): ("no result", "arguments are no object"), (1, "lost"): ("no call", None),
    }
    assert got[(1, "x")]["message"] == '{"arguments":{"a":"q\\"é","b":2},"call_id":"x","content":"first","level":1,"tool":"f"}'
    assert got[(2, "p")]["message"] == '{"arguments":"not json","call_id":"p","content":null,"level":null,"tool":"f"}'
    assert chat.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_turns_of_odd_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, "user", "x"), (None, 1, "user", "x"), (2, 1, "assistant", "alone"), (3, 0, "user", "a " * 50000), (3, 2, None, "z")], "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["call_id"], r["status"], r["valid"]) for r in chat.link(*chat.calls_of_turns(turns)).collect())
    assert got == [(1, "call-0", "linked", True), (2, "call-0", "no call", False), (3, "call-0", "no result", True)]
