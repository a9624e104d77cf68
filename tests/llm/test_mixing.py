import collections
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import mixing


def test_fitting_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        top = rng.choice([8, 40, 300, 3000])
        sizes = list({rng.randrange(top) * rng.choice([1, 1, 3]) for _ in range(rng.randrange(1, 8))})
        counts = [rng.randrange(rng.choice([2, 6, 30])) for _ in sizes]
        budget = rng.randrange(sum(a * b for a, b in zip(sizes, counts, strict=True)) + 10)
        take = mixing.fit_counts(np.array(sizes), np.array(counts), budget)
        assert (take >= 0).all() and (take <= np.array(counts)).all()
        assert int((take * np.array(sizes)).sum()) == brute.largest_sum(sizes, counts, budget), (sizes, counts, budget)


def test_few_long_documents_are_fitted_whole():
    sizes, counts = np.array([68511, 73145, 84535, 86903]), np.array([1, 1, 1, 3])
    assert int((mixing.fit_counts(sizes, counts, 154986) * sizes).sum()) == 153046
    sizes, counts = np.array([1_003, 1_033, 1_999]), np.array([10**9, 10**9, 10**9])
    assert int((mixing.fit_counts(sizes, counts, 10**12 + 7) * sizes).sum()) == 10**12 + 7


def mix_rows(n, seed, longest=60):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, longest))), rng.choice(["a", "b", "c", None])) for i in range(n)]


def test_mix_meets_targets(spark):
    rows = mix_rows(800, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(800))
    source = {r[0]: r[2] for r in rows}
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in ("a", "b", "c", None)]
    for s, size, target in zip(("a", "b", "c", None), sizes, brute.targets(sizes, [1, 2, 3, 1]), strict=True):
        mine = [r for r in got if source[r.doc_id] == s]
        assert mine[0].source_size == size and mine[0].target == pytest.approx(target) and abs(sum(r.taken for r in mine) - target) <= 1
        assert all(r.size == len(rows[r.doc_id][1].split()) and r.taken <= 3 * r.size and r.taken % r.size == 0 for r in mine)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_reruns_agree_with_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 4 if i % 3 == 1 else i, t, s, i % 2) for i, t, s in mix_rows(400, 5, 6)] + [(None, "same words here", "b", 1)] * 60 + [(9, "same words here", "a", 1)] * 61
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    mixes = [collections.Counter(map(tuple, mixing.mixed_documents(docs.repartition(k)).collect())) for k in (1, 3, 7)]
    assert mixes[0] == mixes[1] == mixes[2]
    words = collections.Counter()
    for row, n in mixes[0].items():
        words[row[2]] += n * len(row[1].split())
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in ("a", "b", "c", None)]
    for s, target in zip(("a", "b", "c", None), brute.targets(sizes, [1, 2, 3, 1]), strict=True):
        assert abs(words[s] - target) <= 1
    taken = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    again = collections.Counter()
    for row, n in mixes[0].items():
        again[row[0]] += n * len(row[1].split())
    assert +taken == +again


def test_odd_rows(spark, odd_docs, docs_of):
    got = mixing.mix_sources(odd_docs.withColumn("size", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))).collect()
    assert len(got) == odd_docs.count()
    assert mixing.mix_sources(docs_of([])).count() == 0 and mixing.mixed_documents(docs_of([])).count() == 0
    assert mixing.mix_sources(docs_of([None, ""])).first().target == 0


def test_mixed_documents_keep_columns_of_any_name(spark, docs_of):
    docs = docs_of(["a b c", "d e"], source="x").unionByName(docs_of([(7, "f " * 40)], source="y"))
    clash = docs
    for k, c in enumerate(("copies", "nth_copy", "row", "col", "bins", "limit", "to_source", "side", "a.b")):
        clash = clash.withColumn(c, F.lit(k + 7))
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {tuple(r)[5:] for r in mixed.collect()} == {tuple(range(7, 16))}
    taken = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_sources(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}


def test_targets_of_many_sources(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(mixing, "RANGED", 20)
    names = sorted([*{f"host{rng.randrange(10**6)}" for _ in range(120)}, "", "￮", "\U0001f30d"]) + [None]
    sizes = [int(rng.paretovariate(0.7)) for _ in names]
    totals = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(3)
    got = {r.t_source: r.target for r in mixing.plan_targets(totals).collect()}
    want = brute.targets(sizes, [1 + k % 3 for k in range(len(names))])
    assert [got[n] for n in names] == pytest.approx(want)
    assert any(w == 3 * s for w, s in zip(want, sizes, strict=True)) and any(w < 3 * s for w, s in zip(want, sizes, strict=True))
