"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.features import BITS, Sample, bounded_sample, fit, score, smallest_hashes, sparse
from holdfast.llm.store import materialize


@dataclass(frozen=True)
class Ftrl:
    """Parameters. ``sample`` and ``sample_bytes``: labelled rows to learn from, at most, and bytes of their texts
    together (those of the smallest hashes)."""

    bits: int = BITS
    orders: int = 2
    sample: int = 8192
    sample_bytes: int = 48 << 20
    passes: int = 4
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    seed: int = 5


def ftrl(sample: Sample, p: Ftrl) -> tuple[np.ndarray, float]:
    """FTRL-proximal with learning rates per coordinate; a row touches only its own coordinates."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias = 1 << p.bits  # last coordinate, not regularised

    def weights(i: np.ndarray) -> np.ndarray:
        zi, rate = z[i], (p.beta + np.sqrt(n[i])) / p.alpha + p.l2
        w = -(zi - np.sign(zi) * p.l1) / rate
        w[np.abs(zi) <= p.l1] = 0
        last = i == bias
        w[last] = -zi[last] / (rate[last] - p.l2)
        return w

    at, labels = sample.at.tolist(), sample.labels.tolist()
    for _ in range(p.passes):
        for a, b, y in zip(at[:-1], at[1:], labels, strict=True):
            i, x = np.append(sample.features[a:b], bias), np.append(sample.values[a:b].astype(np.float64), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - y) * x
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / p.alpha * w
            n[i] = more
    w = weights(np.arange(len(z)))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", params: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled documents. A doc_id with several labels counts with the largest, one with
    several texts with one of these; null labels and ids count not at all; no labelled rows at all give weights
    of zero (score 0.5)."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("label"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    known = materialize(known.join(texts.select("doc_id"), "doc_id", "left_semi"))
    picked = smallest_hashes(known, "doc_id", params.seed, params.sample).join(known, "doc_id")
    rows = bounded_sample(texts, picked, params.sample_bytes)
    return fit(sparse(rows, "text", params.bits, params.orders), lambda s: ftrl(s, params), params.bits)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "quality_score", params: Ftrl = Ftrl()) -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text. Null and empty texts score by the bias alone;
    equal texts score alike wherever they stand; other columns pass unread, ``out`` replaces one of its name."""
    return score(docs, *model, text, out, params.bits, params.orders)
