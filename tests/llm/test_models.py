"""Held-out accuracy, and invariance, of the two classifiers."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import quality, toxicity
from skylattice.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("scores, label, least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.88)])
def test_held_out_accuracy(spark, scores, label, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = scores(docs, labels).collect()
    y = {r.doc_id: r[label] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert auc([(r.score, y[r.doc_id]) for r in got if r.held_out and y.get(r.doc_id) is not None]) >= least


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_held_out_labels_do_not_matter(spark, scores, label):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    folds, out = (5, 0) if label == "quality" else (4, 2)
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out
    changed = labels.withColumn(label, F.when(hidden, 1 - F.col(label)).otherwise(F.col(label)))
    rows = lambda ls: sorted((r.doc_id, r.score) for r in scores(docs, ls).collect())
    assert rows(labels) == rows(changed)


@pytest.mark.parametrize("scores, columns", [(quality.quality_scores, "quality int"), (toxicity.toxicity_scores, "toxic int")])
def test_odd_rows(spark, odd_docs, docs_of, scores, columns):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (6, None), (99, 1)], f"doc_id long, {columns}")
    got = scores(odd_docs.withColumn("score", F.lit("clash")).withColumn("label", F.lit(3)), labels).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite(r.score) for r in got)
    assert scores(docs_of([]), labels).count() == 0
    assert scores(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_accepted_keeps_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == good


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    emission, trans = rng.normal(size=5), np.exp(rng.normal(size=(2, 2)))
    weight = np.zeros((5, 2))
    for path in range(32):
        states = [path >> k & 1 for k in range(5)]
        w = np.exp(sum(e for e, s in zip(emission, states, strict=True) if s)) * np.prod([trans[a, b] for a, b in zip(states, states[1:], strict=False)])
        for k, s in enumerate(states):
            weight[k, s] += w
    got = toxicity.marginals(np.concatenate([emission, emission[:1]]), np.array([5, 1]), trans)[2]
    assert got[:5] == pytest.approx(weight[:, 1] / weight.sum(1)) and got[5] == pytest.approx(1 / (1 + np.exp(-emission[0])))


def test_toxic_spans(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity(docs, labels).where("size(spans) > 0").collect()
    assert rows and all(s.first_word <= s.last_word and s.mass > 0 for r in rows for s in r.spans)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:  # characters and words name the same places
        for s in r.spans:
            assert text[r.doc_id][s.first : s.end].split() == brute.words(text[r.doc_id])[s.first_word : s.last_word + 1]
    scored = {r.doc_id: r.offsets for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all([(o.first, o.end) for o in scored[r.doc_id]] == [(s.first, s.end) for s in r.spans] for r in rows) and len(scored) == docs.count()


def test_offsets_count_characters():
    text = "  Ünï böse  wörter 😀 da\n\n böse".encode()
    got = toxicity.spans(np.array([0.1, 0.9, 0.8, 0.2, 0.3, 0.6]), text)
    assert [(s["first_word"], s["last_word"], text.decode()[s["first"] : s["end"]]) for s in got] == [(1, 2, "böse  wörter"), (5, 5, "böse")]


def plain_ftrl(samples):
    """The same training, number by number."""
    z, n, bias = {}, {}, 1 << quality.BITS
    grams, rows = quality.Grams(), []
    for text, label in samples:
        x = {bias: 1.0}
        for g in grams.streams(text):
            for i in g.tolist():
                x[i] = x.get(i, 0.0) + quality.SCALE / len(g)
        rows.append((x, label))

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != bias}, weight(bias)


def test_ftrl_updates_are_those_of_a_plain_loop():
    samples = [(b"good plain words here. Good again", 1), (b"BUY NOW!!! click click 1234", 0), (b"plain words, and more of them", 1), (b"", 0), (b"1234 $$$ BUY", 0)]
    weights, bias = quality.train_ftrl(samples)
    want, want_bias = plain_ftrl(samples)
    assert bias == pytest.approx(want_bias) and np.flatnonzero(weights).tolist() == sorted(i for i, w in want.items() if w)
    assert all(weights[i] == pytest.approx(w, abs=1e-6) for i, w in want.items())


def test_words_that_differ_late_have_shapes_of_their_own():
    a, b = b"a1" * 20 + b"!", b"a1" * 20 + b"?"
    assert quality.shape(a) != quality.shape(b)


def test_labels_of_absent_documents_do_not_shrink_the_sample(spark, docs_of):
    docs = docs_of([(1000 + i, f"text {i % 7} of words") for i in range(60)] + [(1000, "another text")] * 3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(1001, 1)] * 5, "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 5, 0, 40)
    assert len(got) == 40 and quality.labelled_sample(docs.repartition(7), labels, "quality", 5, 0, 40) == got


def test_crf_gradients_are_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    lengths, n_words = np.array([4, 1, 3]), 5
    at, gold = rng.integers(0, n_words, 8), rng.integers(0, 2, 8).astype(float)
    flat, who = rng.integers(0, 6, 12), np.concatenate([np.arange(n_words), rng.integers(0, n_words, 7)])
    theta, bias, trans = rng.normal(size=6), rng.normal(size=1), rng.normal(size=(2, 2))

    def loss(theta, bias, trans):
        word = np.bincount(who, theta[flat], n_words) + bias[0]
        total, start = toxicity.L2 * len(at) / 1000 * (theta @ theta) / 2, 0
        for n in lengths:
            e, g = word[at[start : start + n]], gold[start : start + n].astype(int)
            score = lambda s: sum(x for x, k in zip(e, s, strict=True) if k) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
            total += np.log(sum(np.exp(score([path >> k & 1 for k in range(n)])) for path in range(1 << n))) - score(g.tolist())
            start += n
        return total

    got = toxicity.gradients(theta, bias, trans, (at, gold, lengths), (flat, who, n_words))
    for k, value in enumerate((theta, bias, trans)):
        for i in np.ndindex(value.shape):
            up, down = ([x.copy() for x in (theta, bias, trans)] for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert got[k][i] == pytest.approx((loss(*up) - loss(*down)) / 2e-5, abs=1e-6)


def test_document_scores_follow_the_marginals():
    model = [np.zeros(1 << toxicity.BITS, np.float32), -2.0, np.ones((2, 2)), np.array([-1.0, 2.0, 0.5, 1.0])]
    tagger, p = toxicity.Tagger(model), np.array([0.1, 0.8, 0.3])
    z = -1 + 2 * np.log1p(1.2) + 0.5 * np.log1p(300 * 1.2 / 3) + 0.8
    assert tagger.score(p) == pytest.approx(1 / (1 + np.exp(-z))) and tagger.score(np.zeros(0)) == pytest.approx(1 / (1 + np.e))
