"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A document is two sequences: its words in lower case, and their shapes (letter runs by case,
digits, punctuation kept; a word equal to the one before it has a shape of its own). Their n-grams
are hashed into one weight vector, each sequence's counts divided by their number, and the score
is the logistic of the sparse dot product. Training reads at most MAX_TRAIN labelled documents,
chosen by a hash of doc_id; scoring reads every text whole.

Nulls and other cases: a null or empty text scores the bias; rows with null labels or a null
doc_id are not trained on, and are scored like any other; repeated rows get equal scores; with no
labelled row every score is 0.5; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import MAX_CACHED_WORDS, mix64, slices, texts

#: Labelled documents that training reads at most.
MAX_TRAIN = 4000
#: Weights, as a power of two.
BITS = 18
#: n-gram lengths of words and of shapes.
WORD_GRAMS, SHAPE_GRAMS = (1, 2), (1, 2, 3)
#: FTRL-proximal: learning rate, its offset, L1 and L2; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 1.0, 4
#: What a sequence's relative counts are multiplied by.
SCALE = 10.0
#: A score from here on predicts label 1.
THRESHOLD = 0.3

_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Aa0])\1+"), rb"\1\1")]


def shape(word: bytes) -> bytes:
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


class Grams:
    """Hashed n-grams of texts; remembers words it has met."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)
        self.shapes = np.zeros(1024, np.uint64)

    def number(self, word: bytes) -> int:
        n = len(self.ids)
        if n == len(self.hashes):
            self.hashes, self.shapes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.shapes))
        self.ids[word] = n
        self.hashes[n], self.shapes[n] = xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape(word), 1)
        return n

    def streams(self, text: bytes) -> list[np.ndarray]:
        """Weight indices of the word and the shape n-grams."""
        words = text.split()
        if len(self.ids) > MAX_CACHED_WORDS:
            self.ids.clear()
        ids, number = self.ids, self.number
        at = np.fromiter((ids[w] if w in ids else number(w) for w in words), np.int64, len(words))
        shapes = self.shapes[at]
        if len(at) > 1:
            shapes[1:][at[1:] == at[:-1]] = np.uint64(0x5EED)
        return [self.grams(self.hashes[at], WORD_GRAMS, 11), self.grams(shapes, SHAPE_GRAMS, 23)]

    @staticmethod
    def grams(h: np.ndarray, lengths, salt: int) -> np.ndarray:
        out = []
        for n in lengths:
            if len(h) < n:
                break
            g = np.full(len(h) - n + 1, salt * 64 + n, np.uint64)
            for k in range(n):
                g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
            out.append((g >> np.uint64(64 - BITS)).astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def score_text(grams: Grams, text: bytes, weights: np.ndarray, bias: float) -> float:
    z = bias
    for at in grams.streams(text):
        if len(at):
            z += SCALE * float(weights[at].sum(dtype=np.float64)) / len(at)
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, z))))


def train_ftrl(samples: list[tuple[bytes, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes of FTRL-proximal over (text, label)."""
    size = (1 << BITS) + 1
    z, n, grams = np.zeros(size), np.zeros(size), Grams()
    rows = []
    for text, label in samples:
        at, x = [np.array([size - 1])], [np.array([1.0])]
        for g in grams.streams(text):
            if len(g):
                u, c = np.unique(g, return_counts=True)
                at.append(u)
                x.append(SCALE * c / len(g))
        u, back = np.unique(np.concatenate(at), return_inverse=True)
        rows.append((u, np.bincount(back, np.concatenate(x)), float(label)))

    def lazy(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i, x, label in rows:
            w = lazy(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = lazy(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> list[tuple[bytes, int]]:
    """At most so many (text, label) of documents outside the held-out fold, in an order fixed by hashes; repeated rows count once."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held_out)).select("doc_id", F.col(label).cast("int").alias("label"))
    texts_of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    picked = texts_of.select("doc_id", "hash").join(marked.distinct(), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label", "hash").limit(most)
    rows = texts_of.join(F.broadcast(picked), ["doc_id", "hash"]).groupBy("doc_id", "hash", "label").agg(F.first("text").alias("text"))  # at most `most` rows
    got = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", "hash", "text").toPandas()
    got = got.sort_values(["h", "doc_id", "label", "hash"], kind="stable")
    return [(t.encode(), int(y)) for t, y in zip(got["text"], got["label"], strict=True)]


def scored(docs: DataFrame, make_scorer, model) -> DataFrame:
    """doc_id and score of every document; make_scorer(model) gives a function of a text's bytes."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = make_scorer(held.value)
        for b in slices(batches):
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array([score(t) for t in texts(b.column(1))], pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, score double")


def with_folds(scores: DataFrame, folds: int, held_out: int, *keep: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return scores.select(
        "doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *keep
    )


def _scorer(model):
    grams, (weights, bias) = Grams(), model
    return lambda text: score_text(grams, text, weights, bias)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model trained on the other folds."""
    model = train_ftrl(labelled_sample(docs, labels, "quality", folds, held_out, most))
    return with_folds(scored(docs, _scorer, model), folds, held_out)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5, held_out: int = 0, most: int = MAX_TRAIN) -> DataFrame:
    """The input's rows whose quality score is threshold at least."""
    model = train_ftrl(labelled_sample(docs, labels, "quality", folds, held_out, most))
    held, names = docs.sparkSession.sparkContext.broadcast(model), list(docs.columns)
    at = names.index("text")

    def run(batches):
        score = _scorer(held.value)
        for b in slices(batches):
            yield b.filter(pa.array([score(t) >= threshold for t in texts(b.column(at))], pa.bool_()))

    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, types).toDF(*names)
