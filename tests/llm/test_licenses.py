"""License labels of the registered query: notices get only their own labels, wherever they stand."""

import re

import numpy as np

from holdfast.llm import licenses, queries

FOLDER = "/root/testdata/sf0.001"


def brute(text, p=licenses.Scan()):
    """Labels of templates, and the largest share, over blocks that start at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    labels, score = set(), 0.0
    for label, template in licenses.TEMPLATES.items():
        own = set(template.split())
        for a in range(len(words)):
            block = words[a : a + p.block]
            share = len(own & set(block)) / len(own)
            told = [f" {x} " in f" {' '.join(block)} " for x in licenses.TELLING.get(label, ())]
            if share * len(own) >= np.ceil(p.containment * len(own) - 1e-9) and (any(told) or not told):
                labels.add(label)
                score = max(score, share)
    return labels, score


def test_query_gives_notices_only_their_own_labels(spark, tmp_path):
    cc = "This work is licensed under a Creative Commons Attribution{} License."
    want = {cc.format(""): "", cc.format("-ShareAlike"): "cc-by-sa", cc.format("-NonCommercial"): "cc-by-nc", cc.format("-Share-Alike"): "cc-by-sa", cc.format(" Non-Commercial"): "cc-by-nc", cc.format("-NonCommercial-ShareAlike"): "cc-by-nc,cc-by-sa"}
    spread = lambda s, n: (" filler" * n + " ").join(s.split())
    mpl = licenses.TEMPLATES["mpl-2"]
    want |= {"filler " * k + spread(mpl, 2) + " filler" * 90: "mpl-2" for k in range(0, 64, 7)}
    want |= {cc.format("") + " filler" * 70 + " noncommercial sharealike": "", spread(mpl, 9): ""}
    texts = [*want, None, "", *licenses.TEMPLATES.values(), *(spread(t, 2) for t in licenses.TEMPLATES.values())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_licenses(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        labels, score = brute(text)
        assert got[i]["labels"] == want.get(text, got[i]["labels"]), text
        assert set(got[i]["labels"].split(",")) - {""} == labels | set(got[i]["base_labels"].split(",")) - {""}, text
        assert got[i]["base_labels"] or abs(got[i]["score"] - score) < 1e-12, text


def test_whole_texts_are_found_despite_changes(spark):
    words = {label: re.findall(r"[a-z0-9]+", t.lower()) for label, t in licenses.TEXTS.items()}
    drop = lambda ws, n: " ".join(w for i, w in enumerate(ws) if i % n)
    rows = [(label, " ".join(ws)) for label, ws in words.items()] + [(label, "filler " * 700 + drop(ws, 9).upper() + " filler" * 90) for label, ws in words.items()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(99, " ".join(words["zlib"][::2]))], "doc_id long, text string")
    clash = docs.selectExpr("*", *(f"1 as {c}" for c in ("n_words", "N_BASE", "first_word", "last_word", "base_labels", "labels", "score")))
    got = {r["doc_id"]: r for r in licenses.scan(clash, telling=licenses.TELLING, texts=licenses.TEXTS).collect()}
    for i, (label, text) in enumerate(rows):
        assert label in got[i]["labels"].split(",") and got[i]["n_words"] == len(text.split())
    assert got[99]["labels"] == ""
    # every block of twice a text's words, by brute force
    size = {label: len(set(ws)) for label, ws in words.items()}
    for i, (_, text) in enumerate(rows):
        ws = text.lower().split()
        for label, own in words.items():
            best = max(len(set(own) & set(ws[a : a + 2 * len(own)])) for a in range(0, len(ws)))
            if best >= np.ceil(0.8 * size[label] - 1e-9):
                assert label in got[i]["labels"].split(",") and got[i]["score"] >= best / size[label] - 1e-12
