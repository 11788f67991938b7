"""Operator 9: language identification by sparse multinomial logistic regression.

Features are character n-grams hashed into a fixed number of buckets, weighted by
TF-IDF and scaled to length one.  Weights are learned with follow-the-regularised-
leader (per-coordinate rates) under an elastic-net penalty, so most of them are
zero; a temperature fitted on rows kept from training calibrates the scores.

The classifier is fitted on a bounded sample (``TRAIN_ROWS`` documents, the same
number for each language, chosen by hash); each of them is read whole, and at most
``BUCKETS`` counts of each reach the driver.  Predictions read every whole text.

Edge cases: a null text and one without letters is ``und`` with score 0; a null
doc_id is never learned from and not held out; without any row to learn from,
everything is ``und``; ties go to the first language in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import arrow_map, crc_mod

#: Documents learned from, at most about; shortest and longest n-gram; buckets (a power of two).
TRAIN_ROWS, ORDERS, BUCKETS = 2_400, (1, 2, 3), 1 << 15
#: Step size, smoothing, L1 and L2 penalty, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
#: Characters counted at a time, so that a very long text needs no more memory.
SPAN = 1 << 20
LETTER = r"\p{L}"


def gram_counts(text: str) -> np.ndarray:
    """How often the n-grams of a whole text fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    bits = BUCKETS.bit_length() - 1
    text = text.lower()
    for start in range(0, len(text), SPAN):
        part = text[max(0, start - max(ORDERS) + 1):start + SPAN]
        skip = start - max(0, start - max(ORDERS) + 1)
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for n in ORDERS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + points[k:k + m]
            # A gram belongs to the span where it ends.
            h = h[max(0, skip - n + 1):]
            total += np.bincount((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits), minlength=BUCKETS)
    return total


def sparse_counts(batch: pa.RecordBatch) -> dict:
    at, n = [], []
    for text in batch.column("text").to_pylist():
        counts = gram_counts(text or "")
        held = np.flatnonzero(counts)
        at.append(held.astype("<u2").tobytes())
        n.append(counts[held].astype("<u4").tobytes())
    return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "at": at, "n": n}


@dataclass
class LanguageModel:
    """Weights by bucket and language, inverse document frequencies, temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.features(at, n) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not regex.search(LETTER, text):
            return "und", 0.0
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        p = softmax(self.logits(at, counts[at]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Fit on (language, buckets, counts), in the order given; every fifth row only calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.ones(BUCKETS))
    df = np.zeros(BUCKETS)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    c = len(languages)
    z, n = np.zeros((BUCKETS, c)), np.zeros((BUCKETS, c))
    model = LanguageModel(languages, np.zeros((BUCKETS, c)), idf)
    target = np.eye(c)[[languages.index(r[0]) for r in rows]]

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        small = np.abs(zs) <= L1
        return np.where(small, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    kept = [k for k in range(len(rows)) if k % 5 == 4] if len(rows) >= 50 else []
    learned = sorted(set(range(len(rows))) - set(kept))
    for _ in range(EPOCHS):
        for k in learned:
            _, at, counts = rows[k]
            if not len(at):
                continue
            x = model.features(at, counts)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = x[:, None] * (softmax(x @ w) - target[k])
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    model.weights = weights(z, n)
    if kept:
        logits = np.array([model.logits(rows[k][1], rows[k][2]) for k in kept])
        truth = target[kept].argmax(axis=1)
        grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
        # A little doubt is left, so that a sample without a mistake does not make every score 1.
        loss = [-np.log(0.999 * softmax(logits / t)[np.arange(len(kept)), truth] + 0.001 / c).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, eligible=None, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) for which ``eligible`` holds and lang is known."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if eligible is None else rows.where(eligible)
    # One row for each language.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = max(1, train_rows // max(1, len(sizes)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    below = F.lit(0)
    for lang, n in sizes.items():
        below = F.when(F.col("lang") == lang, int(min(1, share / n) * (1 << 30))).otherwise(below)
    sample = rows.where(place < below).limit(2 * train_rows + 100)
    made = arrow_map(sample, "text", "doc_id long, lang string, at binary, n binary", sparse_counts)
    got = made.collect()
    got.sort(key=lambda r: (hash_order(r["doc_id"]), r["lang"], bytes(r["at"]), bytes(r["n"])))
    return train([(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in got])


def hash_order(doc_id: int | None) -> int:
    return ((doc_id or 0) * 0x9E3779B97F4A7C15 + 1) % (1 << 64) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 20


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` but any of the same names, with lang_pred and score; one pass, no shuffle."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def make(batch: pa.RecordBatch) -> dict:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        return {**{c: batch.column(c) for c in names}, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return arrow_map(docs, "text", f"{fields}, lang_pred string, score double", make)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; every fourth share of ids is never learned from."""
    fold = crc_mod("doc_id", 4)
    model = fit(docs, fold != 2)
    rows = predict(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
