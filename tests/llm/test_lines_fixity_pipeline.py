import collections
import glob
import os
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import fixity, lines, queries
from skylattice.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_odd_lines(spark, odd_docs, docs_of):
    got = lines.clean_lines(odd_docs.withColumn("words", F.lit(1)))
    assert got.count() == odd_docs.count() and not any(r.kept for r in got.where("n_words < 50").collect())
    assert lines.clean_lines(docs_of([])).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_navigation_lines_go(spark, docs_of):
    prose = "\n".join(" ".join(f"plain{i * 9 + k}" for k in range(9)) + "." for i in range(8))
    row = lines.clean_lines(docs_of([(1, "Home | About | News | Contact\n" + prose + "\nClick here to subscribe"), (2, "\n".join(["Home | About | News | Contact now please"] * 9))])).orderBy("doc_id").collect()
    assert row[0].kept and row[0].clean_text == prose and not row[1].kept


PAGES = "page_id long, url string, html string"


def faults(ours, theirs):
    """(record id, fault) that the audit of two replicas finds, and by comparing all records."""
    trees = [stored(fixity.merkle_tree(x), "tree") for x in (ours, theirs)]
    found = {(r.node, r.fault) for r in fixity.audit(*trees).collect()}
    a, b = ({(r.file, r.record_id): r.record_sha256 for r in x.collect()} for x in (ours, theirs))
    want = {(k[1], "missing" if k not in b else "extra" if k not in a else "corrupt") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    return found, want


def test_audit_finds_each_fault_where_it_is(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (1 + i % 7) if i % 5 else None) for i in range(1500)], PAGES)
    held = fixity.archive(pages)
    ours = stored(fixity.described(held, "page_id", "record_id"), "warc")
    assert ours.count() == 1500 and faults(ours, fixity.warc_records(pages.repartition(7))) == (set(), set())
    record = F.when(F.col("page_id") == 700, F.overlay("record", F.lit("#"), F.length("record") - 4)).when(F.col("page_id") == 720, F.concat("record", F.lit("more"))).otherwise(F.col("record"))
    other = held.where("page_id = 740").withColumn("record_id", F.lit("urn:uuid:other")).withColumn("record", F.lit("inserted"))
    theirs = stored(fixity.described(held.where("page_id <> 760").withColumn("record", record).unionByName(other), "page_id", "record_id"), "warc")
    found, want = faults(ours, theirs)
    assert found == want and sorted(f for _, f in found) == ["corrupt", "corrupt", "extra", "missing"]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_comparison_of_all_records(spark, seed):
    rng = random.Random(seed)
    pages = spark.createDataFrame([(i, None, "x" * rng.randrange(50)) for i in range(3000)], PAGES)
    ours = stored(fixity.warc_records(pages), "warc")
    gone, worse = set(rng.sample(range(3000), 200)), set(rng.sample(range(3000), 100))
    longer = F.when(F.col("page_id").isin(worse), F.concat("record", F.lit("."))).otherwise(F.col("record"))
    theirs = fixity.described(fixity.archive(pages).where(~F.col("page_id").isin(gone)).withColumn("record", longer), "page_id", "record_id")
    found, want = faults(ours, stored(theirs, "warc"))
    assert found == want and faults(theirs, ours)[0] == {(n, {"missing": "extra", "extra": "missing"}.get(f, f)) for n, f in want}


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FILE_IDS", 16)
    long = "<p>very long</p>" * 20_000
    rows = [(None, None, f"null {i}") for i in range(200)] + [(5, "http://x/5", f"again {i}") for i in range(100)] + [(6, "", "same")] * 50 + [(7, "a\r\nb", long), (8, None, None), (-3, "u", "")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES + ", nth int, file string")
    ours = stored(fixity.warc_records(pages), "warc").collect()
    assert len(ours) == len(rows) and len({r.record_id for r in ours}) == len(rows)
    sizes = collections.Counter(r.file for r in ours)
    assert max(sizes.values()) <= 40 and sum(n for f, n in sizes.items() if f.startswith("none")) == 200
    again = fixity.warc_records(pages.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, ours))
    none = fixity.merkle_tree(fixity.warc_records(pages.limit(0)))
    assert fixity.audit(none, none).count() == 0
    tree = fixity.merkle_tree(fixity.warc_records(pages))
    assert {r.fault for r in fixity.audit(tree, none).collect()} == {"missing"}


def test_warc_files_are_read_again(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>WARC/1.0\r\n {i}</p>\r\n\r\n" if i % 3 else "ü" * i) for i in range(1100)], PAGES)
    held = fixity.archive(pages)
    fixity.write_warc(held, str(tmp_path / "a"))
    back = {(r.file, r.record_id): r for r in fixity.read_warc(spark, str(tmp_path / "a")).collect()}
    ours = fixity.warc_records(pages).collect()
    assert len(back) == len(ours) == 1100
    for r in ours:
        b = back[r.file, r.record_id]
        assert (b.record_at, b.n_bytes, b.record_sha256) == (r.record_at, r.n_bytes, r.record_sha256)
    one = next(iter(back.values())).record.decode()
    assert one.startswith("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:") and "WARC-Date: 2" in one
    parts = [bytes(back[k].record) for k in sorted(back, key=lambda k: back[k].record_at) if k[0] == "0-0"]
    broken = b"".join(parts[:3]) + parts[3][:-9] + b"".join(parts[4:6])
    assert [len(r) for _, _, r in fixity.parse_records(broken)] == [*(len(p) for p in parts[:3]), len(parts[3]) - 9, len(parts[4]), len(parts[5])] and not list(fixity.parse_records(b""))


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
        kept[name] = len(rows)
        if name == "near duplicates":
            want = brute.near_duplicates(before, 5, 80)
            assert {r.doc_id for r in rows} == {c for _, c in want.values()}
        if name == "substring dedup":
            want = brute.substrings(before)
            assert {r.doc_id: (len(brute.words(r.text))) for r in rows} == {i: n - gone for i, (n, gone, _) in want.items() if n > gone or not gone}
        if name == "source mixing":
            assert {r.doc_id for r in rows} <= {i for i, _ in before} and all(rows.count(r) <= 3 for r in rows[:20])
        if name == "sentencepiece":
            assert len(rows) == len(before) and all(r.round_trip and len(r.ids) == r.n_pieces for r in rows)
    assert all(kept.values()) and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() == kept["sentencepiece"]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, odd_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    clash = ("copies", "ids", "n_pieces", "row", "id", "h", "score", "label", "size", "firsts", "c1")
    docs = odd_docs.withColumns({c: F.lit(5) for c in clash})
    for table_in in (docs, docs.limit(0)):
        got = stage(spark, table_in, SF)
        rows = got.collect()
        assert len(rows) <= 3 * odd_docs.count()
        if k < 4:
            assert got.columns == docs.columns and all(r[c] == 5 for r in rows for c in clash)
        else:
            assert len(rows) == table_in.count() and all(r.copies == 5 and len(r.ids) == r.n_pieces for r in rows)
