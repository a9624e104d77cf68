import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import pieces
from skylattice.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def check(docs, library):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pieces.encoding_report(docs).collect():
        ids = library.encode(text[r.doc_id])
        assert r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), text[r.doc_id][:80]
        assert r.round_trip or pieces.MARK in text[r.doc_id]


def test_ids_of_the_library_on_documents(spark, library):
    check(table(spark, "/root/testdata/sf0.001", "documents"), library)


def test_ids_of_the_library_on_odd_texts(spark, library, docs_of):
    rng = random.Random(4)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "日", "本", "😀", ".", "##", "0", "19", "▁", " ", "​", "X", "\\", "ﬁ"]
    check(docs_of([(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(300)] + [(999, "a" * 5000), (998, " " * 40), (997, "\n\n")]), library)


def test_odd_rows(spark, odd_docs, docs_of):
    got = pieces.encoding_report(odd_docs.withColumn("ids", F.lit(1))).collect()
    assert len(got) == odd_docs.count() and {r.doc_id: r.n_pieces for r in got}[1] == 0
    assert pieces.encoding_report(docs_of([])).count() == 0


def test_encoded_and_decoded_tables(spark, docs_of):
    docs = docs_of(["plain text", "", None, "zwei Wörter"])
    rows = pieces.encoded(docs, checked=True)
    assert rows.columns == ["ids", "n_pieces", "round_trip", "doc_id", "lang", "source", "n_chars"]
    back = {r.doc_id: r.text for r in pieces.decoded(rows.drop("n_pieces", "round_trip")).collect()}
    assert back == {0: "plain text", 1: "", 2: "", 3: "zwei Wörter"} and all(r.round_trip for r in rows.collect())


def test_columns_with_names_of_results_are_replaced(spark, docs_of):
    docs = docs_of(["plain text", None]).withColumns({"ids": F.lit("x"), "n_pieces": F.lit("x"), "round_trip": F.lit("x"), "a.b": F.lit(1)})
    rows = pieces.encoded(docs, checked=True)
    assert rows.columns == ["ids", "n_pieces", "round_trip", "doc_id", "lang", "source", "n_chars", "a.b"] and {r.round_trip for r in rows.collect()} == {True}
    back = pieces.decoded(rows.withColumn("text", F.lit("old")))
    assert {r.text for r in back.collect()} == {"plain text", ""} and pieces.encoded(docs.limit(0)).count() == pieces.decoded(rows.limit(0)).count() == 0


def test_models_beyond_the_method_are_refused(spark, docs_of, tmp_path):
    field = lambda n, raw: bytes([n << 3 | 2, len(raw)]) + raw
    piece = lambda text, kind: field(1, field(1, text.encode()) + bytes([3 << 3, kind]))
    bpe, plain = field(2, bytes([3 << 3, 2])), field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    good = piece("<unk>", 2) + piece("a", 1) + piece("\u2581a", 1)
    assert pieces.unsupported(good + bpe + plain, pieces.read_pieces(good)) is None
    for data in (good + plain, good + bpe + field(3, bytes([4 << 3, 1])), good + piece("b\u2581", 1) + bpe + plain, good + piece("u", 4) + bpe + plain):
        assert pieces.unsupported(data, pieces.read_pieces(data))
    (tmp_path / "m.model").write_bytes(good + plain)
    with pytest.raises(ValueError, match="BPE"):
        pieces.encoded(docs_of(["a"]), str(tmp_path / "m.model"))


def test_a_task_remembers_cuts_that_come_again_and_leaves_none_in_its_worker(spark, docs_of):
    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(pieces.Vocabulary(f.read()))
    batches = [["again once\nline"], ["again twice\nline"], ["again once"]]
    got = [e.encode_batch(b) for b in batches]
    assert set(e.known[1]) == {"again", "once"} and set(e.known[0]) == {"\n", "line"}
    assert [pieces.Encoder(e.v).encode_batch(b) for b in batches] == got == [e.encode_batch(b) for b in batches]
    e.forget()
    assert not any([*e.known, *e.before, *e.met]) and [e.encode_batch(b) for b in batches] == got

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            sizes = [len(x) for e in pieces._ENCODERS.values() for x in [*e.known, *e.before]]
            yield pa.record_batch({"workers": pa.array([len(pieces._ENCODERS)]), "cuts": pa.array([sum(sizes)])})

    docs = docs_of([f"some words {i}" for i in range(100)]).repartition(4)
    assert pieces.encoded(docs, checked=True).where("round_trip").count() == 100
    rows = spark.range(0, 40, 1, 4).mapInArrow(held, "workers long, cuts long").collect()
    assert any(r.workers for r in rows) and not any(r.cuts for r in rows)


def test_ids_are_decoded_in_parts(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        v = pieces.Vocabulary(f.read())
    texts = ["", "one two", "three " * 50, "", "four"]
    ids = pieces.Encoder(v).encode_batch(texts)
    for size in (1, 12, 1 << 18):
        monkeypatch.setattr(pieces, "DECODED", size)
        assert pieces.decode_batch(ids, v) == [t.encode() for t in texts] and pieces.decode_batch([], v) == []
