"""Toxic spans by a linear-chain conditional random field.

Each line of a text is a chain of words with two states. A word's emission is the sum of the
weights of its hashed features (the word, its prefixes and its suffix), and the chain's marginals
come from forward and backward passes, run for many chains at once on the ratio of the two states.
A document's score is a logistic of its expected number of toxic words, their density and the
highest marginal; its spans are the runs of words whose marginal is at least a half.

Training reads at most MAX_TRAIN labelled documents. Their words are labelled by distant
supervision: in toxic documents, a word is toxic if one of its features is much more frequent in
toxic documents than in clean ones; in clean documents no word is.

Nulls and other cases: a null or empty text has no spans and scores as a document without toxic
words; rows with null labels or a null doc_id are not trained on; repeated rows get equal scores;
without labels of both kinds every score is 0; an empty table gives an empty result; other columns
are passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import MAX_CACHED_WORDS, slices, texts
from skylattice.llm.quality import labelled_sample, with_folds

#: Labelled documents that training reads at most, and clean ones among them whose chains are fitted.
MAX_TRAIN, MAX_CLEAN = 4000, 800
#: Feature weights, as a power of two; lengths of prefixes in characters.
BITS, PREFIXES = 16, (3, 4, 5, 6, 7)
#: A feature is toxic if it is in so many toxic documents, as a share of them and at least, and so much likelier there (log ratio).
SEED_SHARE, SEED_LEAST, SEED_RATIO = 0.03, 4, 2.0
#: Passes over the chains, learning rate, L2.
STEPS, RATE, L2 = 60, 0.3, 1e-3
STRIP = b".,;:!?\"'()[]{}*#$%&<>|-_/\\"


def features(word: bytes) -> list[bytes]:
    """What stands for a word: itself, its prefixes and its suffix, each once."""
    s = word.decode("utf-8", "replace")
    out = [b"w" + word] + [b"p" + s[:n].encode() for n in PREFIXES if len(s) > n]
    if len(s) > 3:
        out.append(b"s" + s[-3:].encode())
    return out


def indices(word: bytes) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f) >> (64 - BITS) for f in features(word)]


def chains(text: bytes) -> list[list[bytes]]:
    """The words of every line that has some: lower case, without punctuation around them."""
    return [[w.strip(STRIP) for w in line.split()] for line in text.lower().split(b"\n") if not line.isspace() and line]


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratio, backward ratio and P(state 1) of every word; emission is the log ratio, chains stand one after another.

    trans holds exp of the transition weights, [from, to]."""
    e = np.exp(np.clip(emission, -30, 30))
    r, b = np.empty_like(e), np.ones_like(e)
    if len(lengths) == 0:
        return r, b, r
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains with a word at step j
    (t00, t01), (t10, t11) = trans
    r[first] = e[first]
    for j in range(1, size[0]):
        at = first[: live[j]] + j
        x = r[at - 1]
        r[at] = np.clip(e[at] * (t01 + t11 * x) / (t00 + t10 * x), 1e-13, 1e13)
    for j in range(size[0] - 2, -1, -1):
        at = first[: live[j + 1]] + j
        x = e[at + 1] * b[at + 1]
        b[at] = np.clip((t10 + t11 * x) / (t00 + t01 * x), 1e-13, 1e13)
    odds = r * b
    return r, b, odds / (1 + odds)


def gradients(theta: np.ndarray, bias: np.ndarray, trans: np.ndarray, chained: tuple, worded: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the chains' negative log likelihood, with the penalty on theta, by feature weights, bias and transition weights.

    chained: the word number and the label of every place, and the chains' lengths; worded: feature and word number of every pair, and the number of words."""
    (at, gold, lengths), (flat, who, n_words) = chained, worded
    inner = np.ones(len(at), bool)
    inner[np.cumsum(lengths) - 1] = False
    here = np.flatnonzero(inner)
    g0, g1 = gold[here].astype(int), gold[here + 1].astype(int)
    seen = np.array([[np.sum((g0 == i) & (g1 == j)) for j in (0, 1)] for i in (0, 1)], float)
    word = np.bincount(who, theta[flat], n_words) + bias[0]
    t = np.exp(trans)
    r, b, p = marginals(word[at], lengths, t)
    e = np.exp(np.clip(word[at], -30, 30))
    x, y = r[here], e[here + 1] * b[here + 1]
    pair = np.stack([np.full_like(x, t[0, 0]), t[0, 1] * y, t[1, 0] * x, t[1, 1] * x * y])
    expected = (pair / pair.sum(0)).sum(1).reshape(2, 2)
    by_word = np.bincount(at, p - gold, n_words)
    return np.bincount(flat, by_word[who], len(theta)) + L2 * len(at) / 1000 * theta, np.array([by_word.sum()]), expected - seen


def seed_features(docs: list[tuple[set[bytes], int]]) -> set[bytes]:
    """Features that mark toxic documents; docs: the distinct words of each and its label."""
    counts, n = (Counter(), Counter()), [0, 0]
    for words, label in docs:
        n[label] += 1
        counts[label].update({f for w in words for f in features(w) if f[:1] != b"s"})
    least = max(SEED_LEAST, SEED_SHARE * n[1])
    ratio = lambda f, a: np.log((a + 0.5) / (n[1] + 1)) - np.log((counts[0][f] + 0.5) / (n[0] + 1))
    return {f for f, a in counts[1].items() if a >= least and ratio(f, a) >= SEED_RATIO}


def document_features(p: np.ndarray) -> np.ndarray:
    total = float(p.sum())
    return np.array([1.0, np.log1p(total), np.log1p(300.0 * total / max(len(p), 1)), float(p.max()) if len(p) else 0.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def train(samples: list[tuple[bytes, int]]):
    """(feature weights, exp of transitions, document weights), or None without both labels."""
    samples = list(dict.fromkeys(samples))  # copies would vouch for each other's words
    parsed = [(chains(t), y) for t, y in samples]
    if len({y for _, y in parsed}) < 2:
        return None
    seeds = seed_features([({w for c in cs for w in c}, y) for cs, y in parsed])
    ids: dict[bytes, int] = {}
    words, gold, lengths, clean = [], [], [], 0
    for cs, y in parsed:
        clean += y == 0
        if y == 0 and clean > MAX_CLEAN:
            continue
        for c in cs:
            lengths.append(len(c))
            for w in c:
                words.append(ids.setdefault(w, len(ids)))
                gold.append(y == 1 and any(f in seeds for f in features(w)))
    at, gold, lengths = np.array(words), np.array(gold, float), np.array(lengths)
    flat = [indices(w) for w in ids]
    who = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    flat = np.concatenate([np.array(f) for f in flat])
    theta, bias, trans = np.zeros(1 << BITS), np.array([-2.0]), np.zeros((2, 2))
    sums = [np.full_like(x, 1e-8) for x in (theta, bias, trans)]
    for _ in range(STEPS):
        grads = gradients(theta, bias, trans, (at, gold, lengths), (flat, who, len(ids)))
        for value, g, s in zip((theta, bias, trans), grads, sums, strict=True):
            s += g * g
            value -= RATE * g / np.sqrt(s)
    model = [theta.astype(np.float32), float(bias[0]), np.exp(trans), None]
    score = Tagger(model)
    x = np.array([document_features(score.marginals(t)) for t, _ in samples])
    model[3] = fit_logistic(x, np.array([y for _, y in samples], float))
    return model


class Tagger:
    """Scores texts; remembers the emissions of words it has met."""

    def __init__(self, model) -> None:
        self.theta, self.bias, self.trans, self.weights = model
        self.known: dict[bytes, float] = {}

    def emission(self, word: bytes) -> float:
        if len(self.known) >= MAX_CACHED_WORDS:
            self.known.clear()
        self.known[word] = s = float(self.theta[indices(word)].sum()) + self.bias
        return s

    def marginals(self, text: bytes) -> np.ndarray:
        return self.many([text])[0]

    def many(self, batch: list[bytes]) -> list[np.ndarray]:
        """P(toxic) of every word of each text; the chains of all of them run together."""
        known, emission, scores, lengths, sizes = self.known, self.emission, [], [], []
        for text in batch:
            before = len(scores)
            for c in chains(text):
                lengths.append(len(c))
                scores += [known[w] if w in known else emission(w) for w in c]
            sizes.append(len(scores) - before)
        p = marginals(np.array(scores, float), np.array(lengths, np.int64), self.trans)[2]
        return np.split(p, np.cumsum(sizes)[:-1]) if sizes else []

    def score(self, p: np.ndarray) -> float:
        z = float(document_features(p) @ self.weights)
        return 1 / (1 + np.exp(-min(35.0, max(-35.0, z))))


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def spans(p: np.ndarray, text: bytes) -> list[dict]:
    """Runs of words with a marginal of a half at least: first and last word, first character and the one after the last, and the sum of marginals."""
    on = np.flatnonzero(np.diff(np.concatenate([[False], p >= 0.5, [False]]).astype(np.int8))).reshape(-1, 2)
    if not len(on):
        return []
    edges = [(w.start(), w.end()) for w in _WORDS.finditer(text)]
    out, at, n = [], 0, 0  # n: characters before byte at

    def characters(byte: int) -> int:
        nonlocal at, n
        n, at = n + len(text[at:byte].decode("utf-8", "replace")), byte
        return n

    for a, z in on.tolist():
        first = characters(edges[a][0])
        out.append({"first_word": a, "last_word": z - 1, "first": first, "end": characters(edges[z - 1][1]), "mass": float(p[a:z].sum())})
    return out


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, score and spans (first_word, last_word, mass; first and end, in characters of the text) of every document."""
    model = train(labelled_sample(docs, labels, "toxic", folds, held_out, most))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "last_word", "first", "end")] + [("mass", pa.float64())]))

    def run(batches):
        tagger = held.value and Tagger(held.value)
        for b in slices(batches, 250):
            batch = texts(b.column(1))
            found = tagger.many(batch) if tagger else []
            scores = [tagger.score(p) for p in found] or [0.0] * b.num_rows
            runs = [spans(p, t) for p, t in zip(found, batch, strict=False)] or [[]] * b.num_rows
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(scores, pa.float64()), "spans": pa.array(runs, kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<first_word:long,last_word:long,first:long,end:long,mass:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and offsets (first, end: characters of the toxic spans) of every document."""
    offsets = F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))
    return with_folds(toxicity(docs, labels, folds, held_out).withColumn("offsets", offsets), folds, held_out, "offsets")
