import random

import brute
from conftest import SCHEMA
from pyspark.sql import functions as F

from skylattice.llm import manifest
from skylattice.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def compared(docs):
    got = sorted(map(tuple, manifest.audited(docs).collect()), key=repr)
    assert got == sorted(brute.manifest([tuple(r[c] for c in COLUMNS) for r in docs.collect()]), key=repr)
    return got


def test_manifest_of_documents(spark):
    got = compared(table(spark, "/root/testdata/sf0.01", "documents"))
    assert 0 < sum(r[-1] for r in got) < len(got) and len({r[3] for r in got}) == 1


def test_odd_manifests(spark, odd_docs, docs_of):
    compared(odd_docs.withColumns({"g": F.lit("clash"), "idx": F.lit(1), "siblings": F.lit(2), "leaf": F.lit("x")}))
    assert manifest.audited(docs_of([])).count() == 0
    assert compared(docs_of([(5, "Alone")]))[0][2:4] == (compared(docs_of([(5, "Alone")]))[0][1],) * 2


def test_sparse_ids_crowds_and_many_languages(spark):
    """Ids of any distance, negative ones, hundreds of rows of one id or without one, equal rows, a run of one, many groups."""
    rng = random.Random(4)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [-1, 0, 1, (1 << 63) - 1, -(1 << 63)]
    rows = [(i, f"Text {i}", rng.choice(["en", "de", None, "", "En"]), None, None) for i in ids]
    rows += [(77, f"T{k % 290}", "en", "s", 1) for k in range(900)] + [(None, f"N{k}", "fr", "s", 1) for k in range(700)] + [(None, "same", "fr", "s", 1)] * 1200
    rows += [(k, "One", f"language-{k % 90}", "s", 3) for k in range(200)] + [(k, "x", "nine", None, 1) for k in range(9)]
    compared(spark.createDataFrame(rows, SCHEMA))


def test_a_proof_is_read_by_itself(spark, docs_of):
    rows = docs_of([(i, f"text {i}") for i in range(1100)]).select(F.lit("g").alias("g"), F.col("doc_id").alias("key"), manifest.leaf_digest().alias("leaf"), "doc_id")
    out = manifest.manifest(rows).withColumns({"again": manifest.folded(F.col("leaf"), F.col("siblings")), "other": manifest.folded(F.reverse("leaf"), F.col("siblings"))})
    assert out.where("again = root and other <> root").count() == 1100 and {len(r.siblings) for r in out.select("siblings").collect()} == {4}
