import re

from pyspark.sql import functions as F

from skylattice.llm import licenses
from skylattice.llm.common import table


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(docs):
    got = licenses.license_scan(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(map(repr, ((r.doc_id, *brute_scan(r.text)) for r in docs.collect())))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    return {r.doc_id: r for r in got}


def test_base_places_on_documents(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents"))


def test_notices_with_changes(spark, docs_of):
    mit = licenses.NOTICES[1][1]
    changed = mit.replace("copy of", "copy, dated 2020, of").replace("obtaining", "acquiring")
    got = check(docs_of([(1, "intro words " + mit + " outro"), (2, changed), (3, " ".join(mit.split()[:9])), (4, "Licensed under CC BY-NC 4.0."), (5, "All RIGHTS\nreserved. all rights reserved"), (6, "free of charge")]))
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.9 <= got[2].score < 1
    assert got[3].labels == got[6].labels == "" and got[4].labels == "cc-by,cc-by-nc" and got[5].n_base == 2


def test_spans_are_where_the_notice_stands(spark, docs_of):
    mit = licenses.NOTICES[1][1]
    spans = licenses.license_spans(docs_of([(1, "a b c " + mit + " d e")])).where("not phrase").collect()
    assert [(s.first, s.end, s.label) for s in spans] == [(3, 3 + len(licenses.words_of(mit.encode())), "mit")]


def test_many_candidates_are_shuffled(spark, docs_of, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 1)
    got = check(docs_of([(i, f"t{i} Released under the MIT License.") for i in range(6)]))
    assert {r.labels for r in got.values()} == {"mit"}


def test_odd_rows(spark, odd_docs, docs_of):
    assert len(licenses.license_scan(odd_docs.withColumn("gram", F.lit(1)).withColumn("key_a", F.lit(2))).collect()) == odd_docs.count()
    assert licenses.license_scan(docs_of([])).count() == 0
    twice = licenses.license_scan(docs_of([(1, "all rights reserved")] * 3)).collect()
    assert [r.n_base for r in twice] == [1, 1, 1]


def test_common_words():
    assert licenses.common_words([b"a", b"b", b"c", b"b"], [b"a", b"x", b"b", b"b"]) == 3
    assert licenses.common_words([b"a"], []) == 0
