"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.features import BITS, Sample, bounded_sample, by_share, fit, score, smallest_hashes, sparse
from holdfast.llm.store import materialize


@dataclass(frozen=True)
class NonNegative:
    """Parameters. ``positives`` and ``unlabelled``: documents to learn from, at most (those of the smallest
    hashes), with ``sample_bytes`` of text together at most. ``prior``: share of toxic texts among the unlabelled; None takes their share among labels.
    ``features`` and ``screen``: see ``nnpu``. ``steps``, ``rate``: of Adam over all rows; ``l2``: shrinkage."""

    bits: int = BITS
    prefixes: tuple[int, ...] = (4, 6)
    positives: int = 4096
    unlabelled: int = 12288
    sample_bytes: int = 48 << 20
    prior: float | None = None
    features: int = 512
    screen: float = 4.0
    steps: int = 300
    rate: float = 0.2
    l2: float = 3e-5
    seed: int = 7


def nnpu(sample: Sample, prior: float, p: NonNegative) -> tuple[np.ndarray, float]:
    """Linear classifier of least non-negative risk  prior * R+(positives) + max(0, R-(unlabelled) - prior *
    R-(positives))  under logistic loss.

    Only features whose means among positives and unlabelled rows differ by ``screen`` standard errors take
    part, the ``features`` clearest of them. Where the second part of the risk falls below zero, the step goes
    against it, so that the classifier does not learn unlabelled rows by heart.
    """
    size, at, pos = 1 << p.bits, sample.at, sample.labels > 0
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    n_pos, n_unl = int(pos.sum()), int((~pos).sum())
    if not n_pos or not n_unl:
        return weights, bias
    total, square = np.zeros((2, size)), np.zeros((2, size))
    blocks = [(a, min(a + 512, len(pos))) for a in range(0, len(pos), 512)]  # of rows, so that little is held at once
    for a, b in blocks:
        ids, v = sample.features[at[a] : at[b]], sample.values[at[a] : at[b]].astype(np.float64)
        of = np.repeat(pos[a:b], np.diff(at[a : b + 1]))
        for k, which in ((0, of), (1, ~of)):
            total[k] += np.bincount(ids[which], v[which], size)
            square[k] += np.bincount(ids[which], v[which] ** 2, size)
    n = np.array([[n_pos], [n_unl]])
    mean, var = total / n, (square / n - (total / n) ** 2) / n
    clear = (mean[0] - mean[1]) / np.sqrt(var[0] + var[1] + 1 / n_pos**2)
    used = np.argsort(-np.abs(clear), kind="stable")[: p.features]
    used = used[np.abs(clear[used]) >= p.screen]
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    x = np.zeros((len(pos), len(used) + 1), np.float32)
    x[:, -1] = 1
    for a, b in blocks:
        ids, row = sample.features[at[a] : at[b]], np.repeat(np.arange(a, b), np.diff(at[a : b + 1]))
        some = np.flatnonzero(place[ids] >= 0)
        x[row[some], place[ids[some]]] = sample.values[at[a] : at[b]][some]
    xp, xu = x[pos], x[~pos]
    w, first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, p.steps + 1):
        zu, zp = xu @ w, xp @ w
        toxic = xp.T @ sigmoid(zp) / n_pos
        below = xu.T @ sigmoid(zu) / n_unl - prior * toxic
        if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
            g = below + prior * (toxic - xp.mean(0))
        else:
            g = -below
        g[:-1] += p.l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= p.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, learn: str = "true", doc_id: str = "doc_id", text: str = "text", label: str = "toxic", params: NonNegative = NonNegative()) -> tuple[np.ndarray, float]:
    """Weights and bias from confirmed toxic rows and unlabelled text among the rows of ``docs`` for which
    the SQL condition ``learn`` on doc_id holds. A doc_id with several labels counts with the largest, one with
    several texts with one of these; without toxic or other rows the score is the prior's alone."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    prior = params.prior
    if prior is None:
        prior = known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.01
    prior = min(max(prior, 0.001), 0.5)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    toxic = known.where("label > 0").join(texts.select("doc_id"), "doc_id", "left_semi")
    pos = smallest_hashes(toxic, "doc_id", params.seed, params.positives).withColumn("label", F.lit(1.0))
    rest = smallest_hashes(texts.where(learn), "doc_id", params.seed + 1, params.unlabelled).withColumn("label", F.lit(0.0))
    picked = materialize(pos.union(rest))  # at most positives + unlabelled narrow rows
    rows = bounded_sample(texts, picked, params.sample_bytes)
    return fit(sparse(rows, "text", params.bits, 1, params.prefixes, by_share), lambda s: nnpu(s, prior, params), params.bits)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "toxic_score", params: NonNegative = NonNegative()) -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text. Null and empty texts score by the bias alone;
    equal texts score alike wherever they stand; other columns pass unread, ``out`` replaces one of its name."""
    return score(docs, *model, text, out, params.bits, 1, params.prefixes, by_share)
