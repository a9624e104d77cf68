import random

import brute
from pyspark.sql import functions as F

from skylattice.llm import neardup
from skylattice.llm.common import table

SF = "/root/testdata/sf0.001"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(neardup.near_duplicates(docs)) == brute.near_duplicates(pairs, 3, 85)
    assert found(neardup.near_duplicates(docs, 5, 80)) == brute.near_duplicates(pairs, 5, 80)


def family(rng, n, words, edits):
    """Texts with random words changed, and a chain in which each differs a little from the one before."""
    base = [f"b{rng.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
        if k % 2:
            base[rng.randrange(words)] = f"c{rng.randrange(10**6)}"
    return out


def test_groups_of_borderline_copies(spark, docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3000)
    rng = random.Random(6)
    texts = family(rng, 120, 90, 5) + family(rng, 90, 150, 12) + ["same text again and again here"] * 40 + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(30)]
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    got, want = found(neardup.near_duplicates(docs_of(pairs))), brute.near_duplicates(pairs, 3, 85)
    assert got == want and len({c for _, c in want.values()}) < len(pairs) - 60


def test_late_links_are_emitted_once_a_component(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[: 195 - k % 3], rng.integers(0, 1 << 60, 2, dtype=np.uint64)])) for k in range(60)] * 2
    sigs = np.frombuffer(b"".join(neardup.signature(s) for s in sets), np.uint8).reshape(len(sets), -1)
    ids, n = np.arange(120) % 60, np.array([len(s) for s in sets])
    m = {"id": ids, "component": ids, "side": np.arange(120) // 60, "n": n, "at": np.zeros(120, np.int64), "sig": sigs, "shingles": [s.tobytes() for s in sets]}
    links = neardup._linked_members(m, neardup.agreeing(85), 85)
    assert len(links) == 59  # a tree, not all pairs
    seen, reach = {0}, 1
    while True:
        seen |= {y for p in links for x, y in (p, p[::-1]) if x in seen}
        if len(seen) == reach:
            break
        reach = len(seen)
    assert seen == set(range(60))


def test_linked_sets_share_a_rare_shingle(spark):
    """Every two sets at the threshold meet in a shingle at places that leave enough after it; sets that share a template only don't meet."""
    import numpy as np

    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sets, template = [], draw(300)
    for k in range(40):
        base = draw(int(rng.integers(1, 120)))
        sets += [np.unique(np.concatenate([base[: len(base) - int(rng.integers(0, 1 + len(base) // 8))], draw(int(rng.integers(0, 1 + len(base) // 10)))])) for _ in range(4)]
    pages = [np.unique(np.concatenate([template, draw(60)])) for _ in range(150)]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets + pages)], "id long, shingles binary")
    for percent in (80, 85):
        by: dict = {}
        for r in neardup._rare_shingles(df, percent).collect():
            by.setdefault(r.key, []).append(r)
        met = {(a.id, b.id) for g in by.values() for a in g for b in g if (100 + percent) * min(a.n - a["at"], b.n - b["at"]) >= percent * (a.n + b.n)}
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                assert 100 * both < percent * (len(x) + len(y) - both) or (i, j) in met
        first = len(sets)
        assert not any(a != b for a, b in met if a >= first and b >= first)


def test_template_pages_are_kept_apart(spark, docs_of):
    """Pages of a common template with words of their own (similarity 0.7): more of them than a block, no two linked, but for a planted pair."""
    rng = random.Random(8)
    shared = [f"t{i}" for i in range(85)]
    pairs = [(i, " ".join(shared + [f"o{rng.randrange(10**6)}" for _ in range(15)])) for i in range(700)]
    pairs.append((9000, pairs[40][1] + " end"))
    assert found(neardup.near_duplicates(docs_of(pairs))) == {i: (98 + (i == 9000), 40 if i == 9000 else i) for i, _ in pairs}


def test_recall_on_more_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for width, percent in ((3, 85), (5, 80)):
        assert found(neardup.near_duplicates(docs, width, percent)) == brute.near_duplicates(pairs, width, percent)


def test_components_of_long_chains(spark):
    n = 300
    rng = random.Random(5)
    ids = rng.sample(range(10**6), n)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(7_000_000, 7_000_001)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(edges, "chain").collect()}
    assert got == {i: min(ids) for i in ids if i != min(ids)} | {7_000_001: 7_000_000}


def test_repeated_ids_are_told_apart_by_text(spark, docs_of):
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    docs = docs_of([(1, text), (1, other), (2, other), (3, text + " end"), (1, other), (4, "short"), (4, "text"), (None, other)])
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    kept = sorted((r.doc_id, r.text) for r in neardup.deduplicated(docs.withColumn("h", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))).collect())
    assert kept == sorted([(1, text), (1, other), (4, "short"), (4, "text")])
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def test_odd_rows(spark, odd_docs, docs_of):
    got = neardup.near_duplicates(odd_docs.withColumn("id", F.lit("clash"))).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].kept and by[3].kept
    assert by[8].component_id == 5 and not by[8].kept and by[7].n_shingles == 1 and by[4].n_shingles == 1
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_deduplicated_keeps_one_of_each_group(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(80))
    docs = docs_of([(3, text), (1, text), (1, text), (9, text + " more"), (4, None), (5, ""), (6, "other words"), (None, text)])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
