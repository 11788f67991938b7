"""Operator 3: quality classifier with supervised subword embeddings.

Every word and every character n-gram of it is hashed to a learned vector; a
document is the average of its vectors, followed by a softmax over two classes.
Training is plain stochastic gradient descent in numpy on a bounded sample of
labelled documents (``TRAIN_ROWS``, chosen by hash, each read whole; at most
``BUCKETS`` counts of each reach the driver).  As the average is linear, scoring
needs one number for each vector, and each distinct word is summed up once.

Besides its words a text has one end mark, and one repeat mark for each word that
equals the word before it.

Edge cases: a null or empty text has the end mark only, so it gets the score of
that; a null doc_id is never learned from and not held out; without labels every
score is 0.5.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import RecentCache, arrow_map, crc_mod

#: Labelled documents learned from, at most about; hashed vectors (a power of two) and their length.
TRAIN_ROWS, BUCKETS, WIDTH = 2_400, 1 << 16, 12
#: Character n-grams of a word, with its boundary marks.
ORDERS = (3, 4, 5)
RATE, EPOCHS, SEED = 0.4, 5, 7
CACHE_WORDS = 300_000
#: Marks; no word holds a space.
END, REPEAT = " end", " repeat"


def word_vectors_at(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and their character n-grams, and for each the index of its word."""
    bits = np.uint64(64 - (BUCKETS.bit_length() - 1))
    own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    where, which = [own * np.uint64(0x9E3779B97F4A7C15) >> bits], [np.arange(len(words))]
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), sizes)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside = np.flatnonzero(of[:m] == of[n - 1:])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + points[inside + k]
        where.append(h * np.uint64(0x9E3779B97F4A7C15) >> bits)
        which.append(of[inside])
    return np.concatenate(where).astype(np.int64), np.concatenate(which)


def tokens(text: str | None) -> list[str]:
    words = (text or "").split()
    return words + [REPEAT] * sum(map(operator.eq, words, words[1:])) + [END]


def sparse_counts(batch: pa.RecordBatch) -> dict:
    at, n = [], []
    for text in batch.column("text").to_pylist():
        words, times = np.unique(np.array(tokens(text), object), return_counts=True)
        where, which = word_vectors_at(words.tolist())
        counts = np.bincount(where, weights=times[which], minlength=BUCKETS)
        held = np.flatnonzero(counts)
        # Packed: a bucket takes two bytes, a count four.
        at.append(held.astype("<u2").tobytes())
        n.append(counts[held].astype("<u4").tobytes())
    return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": at, "n": n}


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each bucket what its vector adds to the logit of class 1 over class 0."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, 2))
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, at, n = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = n / n.sum()
            own = vectors[at]
            mean = share @ own
            score = mean @ out
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            # As in plain gradient descent on the average, but scaled up by the number of its parts.
            vectors[at] = own - rate * np.minimum(share * len(at), 10.0)[:, None] * back
    return vectors @ (out[:, 1] - out[:, 0])


@dataclass
class QualityScorer:
    """Scores texts; each task keeps its own bounded cache of words."""

    logit: np.ndarray
    cache: RecentCache | None = field(default=None, repr=False)

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.cache is None:
            self.cache = RecentCache(CACHE_WORDS, len)
        rows = [tokens(t) for t in texts]
        absent = self.cache.absent(w for row in rows for w in row)
        for start in range(0, len(absent), 100_000):
            some = absent[start:start + 100_000]
            where, which = word_vectors_at(some)
            sums = np.bincount(which, self.logit[where], len(some)) + 1j * np.bincount(which, minlength=len(some))
            self.cache.update(zip(some, sums.tolist(), strict=True))
        get = self.cache.__getitem__
        totals = np.array([sum(map(get, row)) for row in rows], complex)
        return (1 / (1 + np.exp(-totals.real / totals.imag))).tolist() if len(rows) else []


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityScorer:
    """Learn from labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (crc_mod("doc_id", 5) != 0))
    share = min(1.0, train_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * train_rows)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    made = arrow_map(rows, "text", "doc_id long, label int, at binary, n binary", sparse_counts)
    got = made.limit(4 * train_rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["at"]), bytes(r["n"])))
    return QualityScorer(train([(r["label"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in got]))


def score_documents(docs: DataFrame, scorer: QualityScorer, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; one pass, no shuffle."""
    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": scorer.scores(batch.column("text").to_pylist())}

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, score double", make)
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= least).cast("int").alias("predicted"))
