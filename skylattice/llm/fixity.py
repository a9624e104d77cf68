"""WARC records and a Merkle audit of their replicas.

Pages become WARC/1.0 resource records with record ids made of their content, dealt to files of a
bounded number of records, and can be written as WARC files and parsed again. A replica is described
by a Merkle tree over each file's records in offset order: a leaf holds a record's length and digest,
and every level above hashes the lengths and hashes of a range of neighbours, so a node stands for an
offset range counted from its own beginning. Ranges are cut by content: a record begins a range of
level k if its id's hash ends with k octal zeros, so an inserted, lost or lengthened record changes
the range that it lies in and no other. An audit compares the roots of two replicas file by file and
descends level by level, each time joining only the children of nodes that differ, until it holds the
records, which are matched by id.

Nulls and other cases: a null url or html counts as empty (a record without url has its own id for a
target); rows with null page_ids are filed by a hash of their record ids, in as many files as they
need, and so are page_ids that repeat too often for a file; repeated rows are records of their own,
numbered within input partitions; an empty table gives empty trees; a file or record that only one
replica has counts as missing or extra there, a second copy of a record id in a file too; records
that are only in another order are no fault; other columns are passed over.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stored, stored

#: Page ids to a WARC file; a range of ids with more than twice as many records gets several files.
FILE_IDS = 512
#: Children of a tree node, on average; a power of two.
FANOUT = 8
#: Levels above the leaves: the top one has a node a file.
LEVELS = 4
#: The date of records, as pages have none.
DATE = "2024-01-01T00:00:00Z"

_KEYS = ("page_id", "url", "digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, from 0, among those with equal keys: only rows that repeat are dealt by their keys and input partition."""
    counts = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = stored(counts.select(*[F.col(c).alias(f"k_{c}") for c in _KEYS]), "warc-repeated")
    if again.isEmpty():
        drop_stored(again)
        return rows.withColumn("nth", F.lit(0).cast("long"))
    on = F.lit(True)
    for c in _KEYS:
        on &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    single = rows.join(again, on, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    many = stored(rows.join(again, on, "left_semi").withColumn("part", F.spark_partition_id()), "warc-copies")
    sizes = many.groupBy(*_KEYS, "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy(*_KEYS).orderBy("part")) - F.col("m")
    starts = sizes.select(*[F.col(c).alias(f"k_{c}") for c in _KEYS], F.col("part").alias("k_part"), before.alias("before"))
    nth = F.row_number().over(W.partitionBy(*_KEYS, "part").orderBy("digest")) - 1
    placed = many.withColumn("own", nth).join(starts, on & (F.col("part") == F.col("k_part")))
    return single.unionByName(placed.select(*rows.columns, (F.col("before") + F.col("own")).alias("nth")))


def named_id(*parts):
    """A record id made of strings."""
    made = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(made, a, n) for a, n in cuts]))


def record_text(record_id, url, html, digest, date: str = DATE):
    """A WARC/1.0 resource record; its block is the page."""
    target = F.coalesce(F.nullif(F.regexp_replace(url, r"[\r\n]", " "), F.lit("")), record_id)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), digest,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, file, record_id and record (the whole WARC record) of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    record_id = named_id(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("url"), F.col("digest"), F.col("nth").cast("string"))
    span = F.coalesce(F.floor(F.col("page_id") / FILE_IDS).cast("string"), F.lit("none"))
    named = _numbered(rows).withColumn("record_id", record_id).withColumn("span", span)
    crowd = rows.groupBy(span.alias("k_span")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * FILE_IDS)
    crowd = stored(crowd.select("k_span", F.ceil(F.col("n") / FILE_IDS).alias("files")), "warc-crowded")
    part = F.coalesce(F.pmod(F.xxhash64("record_id"), F.col("files")), F.lit(0))
    out = named.join(crowd, F.col("span") == F.col("k_span"), "left").select(
        "page_id", F.concat("span", F.lit("-"), part.cast("string")).alias("file"), "record_id",
        record_text(F.col("record_id"), F.col("url"), F.col("html"), F.col("digest"), date).alias("record"),
    )
    out.stored_path = crowd.stored_path  # what it reads
    return out


def described(records: DataFrame, *order: str) -> DataFrame:
    """The records without their text: record_no and record_at in their file, n_bytes and record_sha256."""
    rest = [c for c in records.columns if c != "record"]
    sized = records.select(*rest, F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))
    by = W.partitionBy("file").orderBy(*order)
    end = F.sum("n_bytes").over(by.rowsBetween(W.unboundedPreceding, 0))
    return sized.select(*rest, (F.row_number().over(by) - 1).cast("long").alias("record_no"), (end - F.col("n_bytes")).alias("record_at"), "n_bytes", "record_sha256")


def warc_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, file, record_id, record_no, record_at (byte offset in the file), n_bytes, record_sha256 of every page's record."""
    return described(archive(pages, date), "page_id", "record_id")


def merkle_tree(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """file, level, node, parent, n_bytes and hash. Level 0 has a leaf for each record; the top level has one node a file.

    A node is named after the record id that it begins with; what comes before a file's first cut begins with ''."""
    by = W.partitionBy("file").orderBy("record_at", "record_id")
    cut = F.xxhash64("record_id")
    copy = F.row_number().over(W.partitionBy("file", "record_id").orderBy("record_at"))
    name = F.when(copy == 1, F.col("record_id")).otherwise(F.concat("record_id", F.lit("#"), copy.cast("string")))
    rows = records.select("file", "record_id", "record_at", "n_bytes", "record_sha256", name.alias("at_0"))
    for k in range(1, levels):
        begins = F.when(F.pmod(cut, F.lit(FANOUT**k)) == 0, F.col("record_id"))
        rows = rows.withColumn(f"at_{k}", F.coalesce(F.last(begins, ignorenulls=True).over(by), F.lit("")))
    rows = stored(rows.withColumn(f"at_{levels}", F.lit("")), "merkle-leaves")
    above = [f"at_{k}" for k in range(levels + 1)]
    leaf = F.sha2(F.concat_ws(":", F.col("n_bytes").cast("string"), "record_sha256"), 256)
    level = rows.select("file", *above, "record_at", "n_bytes", leaf.alias("hash"))
    tree = None
    for k in range(levels + 1):
        if k:
            children = F.array_sort(F.collect_list(F.struct("record_at", "n_bytes", "hash")))
            joined = F.concat_ws("|", F.transform(children, lambda c: F.concat_ws(":", c["n_bytes"].cast("string"), c["hash"])))
            level = level.groupBy("file", *above[k:]).agg(F.min("record_at").alias("record_at"), F.sum("n_bytes").alias("n_bytes"), F.sha2(joined, 256).alias("hash"))
        parent = F.col(above[k + 1]) if k < levels else F.lit(None).cast("string")
        part = level.select("file", F.lit(k).alias("level"), F.col(above[k]).alias("node"), parent.alias("parent"), "n_bytes", "hash")
        tree = part if tree is None else tree.unionByName(part)
    tree.stored_path = rows.stored_path  # what it reads
    return tree


def audit(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Records (file, node, fault) whose trees differ, by descending mismatching branches from the roots.

    fault is corrupt, missing (from the right) or extra (there)."""

    def at(tree: DataFrame, k: int, side: str) -> DataFrame:
        return tree.where(F.col("level") == k).select("file", "node", "parent", F.col("hash").alias(f"{side}_hash"))

    bad = None
    for k in range(levels, -1, -1):
        a, b = at(left, k, "l"), at(right, k, "r")
        if bad is not None:
            parents = bad.select("file", F.col("node").alias("parent"))
            a, b = (x.join(parents, ["file", "parent"], "left_semi") for x in (a, b))
        differ = a.drop("parent").join(b.drop("parent"), ["file", "node"], "full_outer").where(~F.col("l_hash").eqNullSafe(F.col("r_hash")))
        above, bad = bad, stored(differ, "fixity-differ")  # read for both replicas at the next level
        if above is not None:
            drop_stored(above)
    fault = F.when(F.col("r_hash").isNull(), "missing").when(F.col("l_hash").isNull(), "extra").otherwise("corrupt")
    return bad.select("file", "node", fault.alias("fault"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write an archive as WARC files, one below path/file=<file> each."""
    text = F.expr("substring(record, 1, length(record) - 2)")  # the writer ends each record with the last line break
    rows = records.repartition("file").sortWithinPartitions("file", "page_id", "record_id").select("file", text.alias("value"))
    rows.write.partitionBy("file").option("lineSep", "\r\n").text(path)


_MAGIC = b"WARC/1.0\r\n"
_LENGTH = re.compile(rb"(?mi)^Content-Length: *(\d+)\r?$")
_ID = re.compile(rb"(?mi)^WARC-Record-ID: *<([^>\r\n]*)>")


def parse_records(data: bytes):
    """(offset, record id, record) of the records of a WARC file; a record whose length is wrong ends before the next one."""
    at = max(0, data.find(_MAGIC))
    while at < len(data):
        blank = data.find(b"\r\n\r\n", at)
        head = data[at : blank + 2] if blank >= 0 else data[at:]
        length = _LENGTH.search(head)
        end = blank + 4 + int(length[1]) + 4 if blank >= 0 and length else -1
        if end < 0 or data[end - 4 : end] != b"\r\n\r\n" or end < len(data) and not data.startswith(_MAGIC, end):
            nxt = data.find(_MAGIC, at + 1)
            end = nxt if nxt >= 0 else len(data)
        found = _ID.search(head)
        yield at, found[1].decode("utf-8", "replace") if found else "", data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, record_id, record_at, n_bytes, record_sha256 and record (bytes) of the records of WARC files; a file is read by one task."""
    import hashlib

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, size = [], 0
                for at, name, record in parse_records(data.as_py()):
                    held.append((str(file), name, at, len(record), hashlib.sha256(record).hexdigest(), record))
                    size += len(record)
                    if size > 1 << 22:
                        yield _table(held)
                        held, size = [], 0
                if held:
                    yield _table(held)

    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("string"), "content")
    return files.mapInArrow(run, "file string, record_id string, record_at long, n_bytes long, record_sha256 string, record binary")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["file", "record_id", "record_at", "n_bytes", "record_sha256", "record"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
