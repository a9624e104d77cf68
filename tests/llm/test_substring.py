import random

import brute
from pyspark.sql import functions as F

from skylattice.llm import substring
from skylattice.llm.common import table


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(substring.removed_substrings(docs)) == brute.substrings([(r.doc_id, r.text) for r in docs.collect()])


def test_overlapping_passages(spark, docs_of):
    rng = random.Random(9)
    passages = [[f"p{rng.randrange(40)}" for _ in range(rng.randrange(15, 70))] for _ in range(8)]
    pairs = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, 60)] if rng.random() < 0.7 else [f"u{rng.randrange(30)}" for _ in range(rng.randrange(30))]
        pairs.append((i * 3, " ".join(w)))
    pairs += [(1000 + k, " ".join(["again"] * (19 + k))) for k in range(4)] + [(2000, " ".join(["ab", "cd"] * 60))]
    assert found(substring.removed_substrings(docs_of(pairs))) == brute.substrings(pairs)


def test_odd_rows(spark, odd_docs, docs_of):
    got = substring.removed_substrings(odd_docs.withColumn("id", F.lit("clash")).withColumn("firsts", F.lit(1))).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[8].n_removed == by[8].n_words == 30_000
    assert by[5].n_removed == brute.substrings([(5, " ".join(f"word{i % 977}" for i in range(30_000)))])[5][1]
    assert substring.removed_substrings(docs_of([])).count() == 0


def test_texts_without_passages(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = docs_of([(1, passage + " tail"), (2, "head " + passage + " other"), (3, passage), (4, None), (5, "")])
    got = {r.doc_id: r for r in substring.without_substrings(docs).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1].text == passage + " tail" and got[2].text == "head other" and got[2].n_chars == 10
    cut = {r.doc_id: [(s.first, s.end) for s in r.spans] for r in substring.removed_substrings(docs).collect()}
    assert cut == {1: [], 2: [(1, 26)], 3: [(0, 25)], 4: [], 5: []}


def test_stage_keeps_columns_of_any_name(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)]).withColumns({"id": F.lit(7), "firsts": F.lit("x"), "first_windows": F.lit(1), "c0": F.lit(2), "own_id": F.lit(3)})
    got = substring.without_substrings(docs)
    assert got.columns == docs.columns and {tuple(r)[5:] for r in got.collect()} == {(7, "x", 1, 2, 3)}
    assert substring.without_substrings(docs.limit(0)).count() == 0
