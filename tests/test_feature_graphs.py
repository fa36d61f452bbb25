"""Feature graphs with reads and model calls, case by case."""

import hashlib
import json

from pyspark.sql import functions as F

from holdfast.operators import features as rep

GRAPH = {"nodes": [
    {"id": "raw", "op": "raw_get", "inputs": ["at"]},
    {"id": "text", "op": "decode_text", "inputs": ["raw"]},
    {"id": "one", "op": "llm_call", "inputs": ["text", "kind"], "args": {"model": "m", "params": {"b": 1, "a": 2}, "prompt_template": "{kind}: {text}", "input_names": ["text", "kind"]}},
    {"id": "two", "op": "llm_call", "inputs": ["one"], "args": {"model": "n", "params": {}, "prompt_template": "Again {x}", "input_names": ["x"]}},
    {"id": "never", "op": "raw_get", "args": {"hash": "gone"}}], "output": "two"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def answer(model, params, prompt, text):
    p = sha(f'{{"model":"{model}","params":{params}}}')
    body = json.dumps({"model": model, "prompt_hash": sha(prompt), "params_hash": p, "response": {"text": text, "input_tokens": 3, "output_tokens": 4}})
    return {"model_id": model, "prompt_hash": sha(prompt), "params_hash": p, "bytes_hash": sha(body), "first_written": 1}, body


def run(spark, rows, answers):
    texts = {sha(t): t for t in ("alpha", "beta", "late")}
    blobs = spark.createDataFrame(list(texts.items()) + [(sha("alpha"), "alpha")], "hash string, text string")
    times = [(h, 50 if t == "late" else 5) for h, t in texts.items()] + [("no bytes", 1)] + [(c["bytes_hash"], 9) for c, _ in answers]
    provenance = spark.createDataFrame(times, "hash string, vendor_timestamp long")
    cache = spark.createDataFrame([tuple(c.values()) for c, _ in answers], "model_id string, prompt_hash string, params_hash string, bytes_hash string, first_written long")
    bodies = spark.createDataFrame([(c["bytes_hash"], b) for c, b in answers], "hash string, body string")
    runs = spark.createDataFrame(rows, "run_id long, query_time long, at string, kind string, deps array<string>, value string, row int, hash string, outcome string, __error string")
    out, calls = rep.run_graph(runs, GRAPH, {"at": F.col("at"), "kind": F.col("kind")}, blobs, provenance, cache, bodies)
    return {r["run_id"]: r for r in out.collect()}, calls.collect()


def row(i, time, text, kind="k", deps=None):
    at = sha(text) if text in ("alpha", "beta", "late") else text
    return (i, time, at, kind, [at] if deps is None else deps, "own", 7, "own", "own", "own")


def test_first_failure_ends_a_run_and_ends_its_reads(spark):
    answers = [answer("m", '{"a":2,"b":1}', "k: alpha", "A"), answer("n", "{}", "Again A", "done"), answer("m", '{"a":2,"b":1}', "k: beta", "B")]
    rows = [row(1, 10, "alpha"), row(2, 10, "beta"), row(3, 10, "late"), row(4, 10, "nowhere"), row(5, 10, "alpha", deps=[]), row(6, 10, "alpha", None), row(7, 7, "alpha"), row(8, 10, "no bytes"), row(9, 10, None, deps=[])]
    got, calls = run(spark, rows, answers)
    assert {i: (r["value"], r["error"], r["data_reads"]) for i, r in got.items()} == {
        1: ("done", None, 5), 2: (None, "miss", 4), 3: (None, "future_denied", 1), 4: (None, "unknown", 1), 5: (None, "undeclared", 0),
        6: (None, "null input", 1), 7: (None, "future_denied", 3), 8: (None, "no content", 1), 9: (None, "undeclared", 0)}
    assert got[1]["read_hashes"] == sorted([sha("alpha"), answers[0][0]["bytes_hash"], answers[1][0]["bytes_hash"]])
    assert got[5]["read_hashes"] == [] and got[7]["read_hashes"] == [sha("alpha")]
    assert sorted((c["run_id"], c["node"], c["outcome"]) for c in calls) == [(1, 0, "hit"), (1, 1, "hit"), (2, 0, "hit"), (2, 1, "miss"), (7, 0, "future_denied")]
    assert [(c["model_id"], c["prompt_hash"]) for c in calls if c["outcome"] == "miss"] == [("n", sha("Again B"))]


def test_bodies_of_other_requests_are_refused(spark):
    key, body = answer("m", '{"a":2,"b":1}', "k: alpha", "A")
    got, calls = run(spark, [row(1, 10, "alpha")], [(key, body.replace('"m"', '"n"'))])
    assert got[1]["error"] == "mismatch" and got[1]["value"] is None and [c["outcome"] for c in calls] == ["mismatch"]


def test_no_runs(spark):
    assert run(spark, [], [answer("m", "{}", "x", "y")]) == ({}, [])
