"""Rows that share an id: none is lost, none decides for another."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import ann, embdedup, features, mixing, packing, quality, simhash, toxicity


def test_near_copies_are_rows_not_ids(spark):
    texts = {"A": "one two three four five six seven", "B": "quite another text with words of its own"}
    docs = spark.createDataFrame([(1, texts["A"]), (5, texts["A"]), (5, texts["B"])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(docs).collect())) == [(1, texts["A"]), (5, texts["B"])]
    many = spark.createDataFrame([(None, f"text number {i} of those without any id") for i in range(20)] * 2, "doc_id long, text string")
    assert simhash.deduplicate(many).count() == 20


def test_neighbours_take_every_row(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [5.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(v, v.where("vec_id = 1 and embedding[0] = 1")).collect())
    assert got == [(1, 1, 2, 5.0), (1, 2, 1, 3.0), (1, 3, 2, 1.0)]


def test_vector_copies_give_one_row_each(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, None, 1), (3, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], None), (6, [2.0], 1), (7, [4.0], 1), (None, [1.0, 0.0], 1)]
    rows += [(10 + i, [0.0, 1.0 + i], 1) for i in range(3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(map(tuple, embdedup.near_duplicates(v).collect()))
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 0, None, None)]
    assert got == Counter([*want, (10, 2, 10, True), (11, 2, 10, False), (12, 2, 10, False)])


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 7, f"w{i} " * (3 + i % 5), "a") for i in range(60)] + [(None, "x y z", "a")] * 9 + [(3, "p q r s", "b"), (3, "t u v w", "b")] * 4
    one = spark.createDataFrame(rows, "doc_id long, text string, source string")
    two = spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3)
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(mixing.mix(one)) == key(mixing.mix(two)) and key(mixing.apply_mix(one)) == key(mixing.apply_mix(two))
    assert mixing.apply_mix(one).columns == one.columns


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_equal_texts_score_alike(spark, module, label):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = module.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), label=label)
    twice = docs.union(docs.repartition(5).where("doc_id % 3 > 0")).repartition(7)
    assert module.classify(twice, model, out="s").groupBy("text").agg(F.count_distinct("s").alias("n")).where("n > 1").count() == 0


def test_one_long_text_does_not_empty_a_sample(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} words number {i % 7} of a text") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(201)], "doc_id long, quality int")
    params = quality.Ftrl(sample_bytes=20_000, l1=0.1)
    plain = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, params=params)
    longer = spark.createDataFrame([*rows, (200, "long " * 5000)], "doc_id long, text string")
    assert (plain[0] != 0).sum() > 0
    for seed in range(3):  # whatever the place of the long text among the hashes
        kept = quality.train(longer, labels, params=quality.Ftrl(sample_bytes=20_000, l1=0.1, seed=seed))
        assert (kept[0] != 0).sum() > 0 and np.sign(kept[0]).any()
    with pytest.raises(ValueError, match="fits"):
        quality.train(spark.createDataFrame([(0, "x" * 99), (1, "y" * 99)], "doc_id long, text string"), labels, params=quality.Ftrl(sample_bytes=100))
    picked = features.smallest_hashes(longer, "doc_id", 5, 1000).withColumn("label", F.lit(1.0))
    sizes = [len(r["text"]) for r in features.bounded_sample(longer, picked, 3000).collect()]
    assert sum(sizes) <= 3000 and len(sizes) > 80 and max(sizes) <= 3000 // 16


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(300)] + [(2, "two"), (3, "three " * 100)], "doc_id long, text string")
    picked = features.smallest_hashes(docs, "doc_id", 5, 10).withColumn("label", F.lit(1.0))
    assert sorted(r["doc_id"] for r in picked.collect()) == [1, 2, 3]
    assert features.bounded_sample(docs, picked, 10**6).count() == 3
    assert features.bounded_sample(docs, picked, 100).agg(F.sum(F.octet_length("text"))).first()[0] <= 100


def brute_ftrl(rows, p):
    """Plain follow-the-regularised-leader over (features, values, label), a coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == "bias":
            return -zi / ((p.beta + ni**0.5) / p.alpha)
        return 0.0 if abs(zi) <= p.l1 else -(zi - np.sign(zi) * p.l1) / ((p.beta + ni**0.5) / p.alpha + p.l2)

    for _ in range(p.passes):
        for f, v, y in rows:
            at = [*zip(f, v, strict=True), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in at}
            error = 1 / (1 + np.exp(-sum(w[i] * x for i, x in at))) - y
            for i, x in at:
                g, old = error * x, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / p.alpha * w[i]
    return weight


def _sample(seed, n):
    rng = np.random.default_rng(seed)
    labels = (rng.random(n) < 0.4).astype(float)
    rows = [(sorted({int(x) for x in rng.integers(0, 40, 12)} | ({50 + int(rng.integers(0, 3))} if y else {60})), y) for y in labels]
    at = np.append(0, np.cumsum([len(f) for f, _ in rows]))
    values = rng.random(at[-1]).astype(np.float32)
    return features.Sample(at, np.array([i for f, _ in rows for i in f], np.int32), values, labels), [(f, values[a:b].astype(float), y) for (f, y), a, b in zip(rows, at[:-1], at[1:], strict=True)]


def test_ftrl_against_the_plain_form():
    p = quality.Ftrl(bits=7, l1=0.05)
    sample, rows = _sample(1, 200)
    w, bias = quality.ftrl(sample, p)
    plain = brute_ftrl(rows, p)
    assert abs(bias - plain("bias")) < 1e-9 and all(abs(w[i] - plain(i)) < 1e-9 for i in range(128)) and np.abs(w[50:53]).min() > 0.01


def test_positive_unlabelled_learning_against_the_plain_form():
    p = toxicity.NonNegative(bits=7, screen=2.0, steps=40)
    sample, rows = _sample(2, 300)
    prior = 0.3
    w, bias = toxicity.nnpu(sample, prior, p)
    used = np.flatnonzero(w)
    dense = np.zeros((len(rows), len(used) + 1))
    dense[:, -1] = 1
    for r, (f, v, _) in enumerate(rows):
        for i, x in zip(f, v, strict=True):
            if i in used:
                dense[r, list(used).index(i)] = x
    pos = sample.labels > 0
    theta, m, s = np.zeros(len(used) + 1), 0, 0
    theta[-1] = np.log(prior / (1 - prior))
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, p.steps + 1):
        zp, zu = dense[pos] @ theta, dense[~pos] @ theta
        rest = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()  # risk of the rest as negative
        minus = (dense[~pos] * logistic(zu)[:, None]).mean(0) - prior * (dense[pos] * logistic(zp)[:, None]).mean(0)
        plus = prior * (dense[pos] * (logistic(zp) - 1)[:, None]).mean(0)
        g = plus + minus if rest >= 0 else -minus
        g[:-1] += p.l2 * theta[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta = theta - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    assert len(used) and np.abs(np.append(w[used], bias) - theta).max() < 1e-3


def test_held_out_toxic_rows_are_found(spark):
    from holdfast.llm import queries

    folder = "/root/testdata/sf0.1"
    held = queries.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right, said, real = held.agg(*(F.count_if(F.expr(c)) for c in ("predicted = 1 and toxic = 1", "predicted = 1", "toxic = 1"))).first()
    assert right >= 0.8 * real and right >= 0.9 * said


def test_full_pieces_have_sequences_of_their_own(spark):
    items = spark.createDataFrame([(8, 10), (9, 10), (0, 10), (1, 4), (2, 6)], "salt long, length long")
    got = packing.pack(items, 10).collect()
    assert len({r["sequence_id"] for r in got}) == 4 and all(r["offset"] == 0 for r in got if r["length"] == 10)


def test_certified_groups_stay(spark):
    # groups of only sixes meet their bound (one each); a group of thirds and halves does not
    rng = np.random.default_rng(6)
    sizes = rng.integers(300, 480, 4000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "salt long, length long").cache()
    one = packing.pack(items, 1000, group_rows=500, rounds=0).collect()
    more = packing.pack(items, 1000, group_rows=500, rounds=3).collect()
    certified = {r["salt"]: (r["sequence_id"], r["offset"]) for r in one if r["group_sequences"] == r["group_bound"]}
    after = {r["salt"]: (r["sequence_id"], r["offset"]) for r in more}
    assert len(after) == 4000 and all(after[s] == place for s, place in certified.items())
    assert all(r["group_sequences"] >= r["group_bound"] > 0 for r in more)
    assert len({r["sequence_id"] for r in more}) <= len({r["sequence_id"] for r in one})
    sixes = spark.createDataFrame([(i, 600) for i in range(2000)], "salt long, length long").cache()
    assert all(r["sequence_id"] >> 52 == 0 and r["group_sequences"] == r["group_bound"] for r in packing.pack(sixes, 1000, group_rows=500).collect())  # all of round 0
