"""Levels of tool calls against brute force."""

import numpy as np
import pytest

from holdfast.llm import chat


def brute(deps):
    """Longest way to a call that waits for nothing; None in and behind circles."""
    level = {}
    while True:
        now = {c: 1 + max((level[d] for d in ds if d in deps), default=-1) for c, ds in deps.items() if c not in level and all(d in level for d in ds if d in deps)}
        if not now:
            return {c: level.get(c) for c in deps}
        level |= now


@pytest.mark.parametrize("largest", [1 << 17, 20])
def test_levels(spark, largest):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for conv in range(12):
        n = int(rng.integers(1, 40))
        turn = rng.permutation(n)  # a random order in which calls may wait for each other
        deps = {f"c{i}": [f"c{j}" for j in rng.choice(n, int(rng.integers(0, 3))) if turn[j] < turn[i] or (conv == 3 and rng.random() < 0.1)] + (["gone"] if i % 9 == 0 else []) for i in range(n)}
        want |= {(conv, c): x for c, x in brute(deps).items()}
        rows += [(conv, c, i, d) for i, (c, d) in enumerate(deps.items())]
    chain = {f"k{i}": [f"k{i + 1}"] + ([f"k{i + 2}"] if i % 3 else []) for i in range(60)} | {"k60": [], "k61": None}
    want |= {(99, c): x for c, x in brute({c: d or [] for c, d in chain.items()}).items()}
    rows += [(99, c, i, d) for i, (c, d) in enumerate(chain.items())] + [(100, "self", 0, ["self"]), (100, "behind", 1, ["self"]), (100, "free", 2, [None])]
    want |= {(100, "self"): None, (100, "behind"): None, (100, "free"): 0}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, position int, after array<string>").repartition(3)
    got = chat.ordered(calls.withColumn("after", chat.F.coalesce("after", chat.F.array().cast("array<string>"))), largest).collect()
    assert len(got) == len(rows) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want


def test_long_chains_take_a_round_a_range(spark, monkeypatch):
    n, rounds = 10_000, []
    whole = chat._in_tasks
    monkeypatch.setattr(chat, "_in_tasks", lambda rows, part: rounds.append(part) or whole(rows, part))
    rows = [(1, f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(n)] + [(2, f"c{i}", i, [f"c{i + 1}"]) for i in range(n)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, position int, after array<string>").repartition(4)
    got = {(r["conv_id"], r["position"]): r["level"] for r in chat.ordered(calls, 2500).collect()}
    assert got == {(1, i): i for i in range(n)} | {(2, i): n - 1 - i for i in range(n)}
    assert sum(part == ["conv_id", "range"] for part in rounds) == 5  # four ranges and a round that adds nothing
