"""Merkle manifest of a dataset, over a trie of radix ranks.

A row becomes a leaf, a digest of its columns. The leaves of a group stand in the order of their ids,
and every FANOUT consecutive nodes become one node until one is left, the group's subroot; subroots in
the order of group names give the root in the same way. No global sort ranks the rows:

1. Ranks. Rows are counted by id without its low digit, counts are summed digit by digit up to the highest digit
   that differs, and going down again each digit adds the rows of its smaller siblings. A row then only has to
   be placed within its bucket of RADIX ids. A bucket that holds more rows than that has repeated
   ids: its rows are counted by content and ranked by the digits of their leaf in the same way, equal rows as one.
2. Trie. The base-FANOUT digits of a rank are a leaf's place in the trie. Nodes that share all but the
   last LEVELS digits make a block, which one task reduces; block roots are the leaves of the next
   round, so a round leaves 1 / FANOUT ** LEVELS of the rows.
3. Proofs. Going down, every block gets its siblings up to the root once, and each leaf adds those within the block.

Nulls and other cases: a null column is written `-`; null ids come first in their group and null groups first
of all; rows of one id stand in the order of their leaves, and equal rows, which have equal leaves, are
leaves each; an empty table gives an empty manifest; a group of one row has that leaf as its subroot, and
one group has its subroot as the root; columns of other names are passed over. Names of groups are ranked
by their first eight bytes, and those that share them within one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stored, stored

#: Children of a node; levels of a block.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Bits of a digit of the ids, and ids of a bucket.
BITS = 8
RADIX = 1 << BITS
#: Columns of a document's leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def netstring(value: Column) -> Column:
    """`-` for null, else the length of the value in bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row of documents, with some of its columns changed."""
    return digest(*[netstring(changed.get(c, F.col(c))) for c in COLUMNS])


def preceding(counts: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """counts (group, key, n) with before, the rows of the group that have a smaller key, and total, all rows of the group.

    Keys are longs in unsigned order, one row each; group columns hold no nulls. A window holds RADIX rows at most."""
    bits = counts.agg(F.bit_or(key).bitwiseXOR(F.bit_and(key))).first()[0]
    digits = 1 if not bits else -(-(bits & (2**64 - 1)).bit_length() // BITS)
    up = lambda c: F.shiftrightunsigned(F.col(c), BITS)
    tables = [counts.select(*group, F.col(key).alias("p"), "n")]
    for _ in range(digits - 1):
        tables.append(stored(tables[-1].groupBy(*group, up("p").alias("q")).agg(F.sum("n").alias("n")).withColumnRenamed("q", "p"), name))
    place = W.partitionBy(*group).orderBy(F.col("p").bitwiseAND(RADIX - 1))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = tables[-1].withColumns({"before": earlier(place), "total": F.sum("n").over(W.partitionBy(*group))})
    for k in range(digits - 2, -1, -1):
        above = out.select(*group, F.col("p").alias("q"), F.col("before").alias("base"), "total")
        below = tables[k].withColumn("q", up("p"))
        own = earlier(W.partitionBy(*group, "q").orderBy(F.col("p").bitwiseAND(RADIX - 1)))
        out = below.withColumn("own", own).join(above, [*group, "q"]).select(*group, "p", "n", (F.col("base") + F.col("own")).alias("before"), "total")
    out = stored(out.withColumnRenamed("p", key), name)
    drop_stored(*tables[1:])
    return out


def _unfolded(rows: DataFrame, counts: Column) -> DataFrame:
    """Every row counts times, at idx, idx + 1, ..., dealt out in blocks before it is written out."""
    parts = rows.withColumn("times", counts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BLOCK))))
    parts = parts.withColumn("idx", F.col("idx") + F.col("part") * BLOCK).withColumn("times", F.least(F.lit(BLOCK), F.col("times") - F.col("part") * BLOCK))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    return parts.repartition("g", "idx").withColumn("k", each).withColumn("idx", F.col("idx") + F.col("k")).drop("times", "part", "k")


def ranked(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """leaves (g, key, leaf, further columns) with idx, a row's place in its group, and total; keys are longs, null first. Also the stored tables that this reads."""
    more = [c for c in leaves.columns if c not in ("g", "key", "leaf")]
    flipped = F.col("key").bitwiseXOR(-(1 << 63))  # unsigned order
    rows = stored(leaves.withColumn("bucket", F.coalesce(F.shiftrightunsigned(flipped, BITS) + 1, F.lit(0))), "manifest-leaves")
    counts = stored(rows.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")), "manifest-counts")
    placed = preceding(counts, ["g"], "bucket", "manifest-buckets")
    drop_stored(counts)
    at = ["g", "bucket"]
    within = F.row_number().over(W.partitionBy(*at).orderBy("key", "leaf")) - 1
    few = rows.join(placed.where(F.col("n") <= RADIX), at).withColumn("idx", F.col("before") + within)
    columns = ["g", "idx", "total", "leaf", *more]
    crowded = placed.where(F.col("n") > RADIX).withColumnRenamed("n", "rows")
    if crowded.isEmpty():
        return few.select(*columns), [rows, placed]
    first = F.conv(F.substring("leaf", 1, 14), 16, 10).cast("long")
    place = F.shiftleft(F.coalesce(F.col("key").bitwiseAND(RADIX - 1), F.lit(0)), 56).bitwiseOR(first)
    once = rows.groupBy(*at, "key", "leaf", *more).agg(F.count(F.lit(1)).alias("m")).withColumn("place", place)
    once = stored(once.join(crowded, at), "manifest-crowded")
    counts = stored(once.groupBy(*at, "place").agg(F.sum("m").alias("n")), "manifest-counts")
    places = preceding(counts, at, "place", "manifest-places")
    drop_stored(counts)
    inner = places.select(*at, "place", F.col("before").alias("inner"))
    own = F.coalesce(F.sum("m").over(W.partitionBy(*at, "place").orderBy("key", "leaf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = once.withColumn("own", own).join(inner, [*at, "place"]).withColumn("idx", F.col("before") + F.col("inner") + F.col("own"))
    return few.select(*columns).unionByName(_unfolded(many, F.col("m")).select(*columns)), [rows, placed, once, places]


def depth_of(total: Column) -> Column:
    """Levels above so many leaves: the base-FANOUT digits of the largest rank."""
    return F.when(total > 1, F.length(F.conv((total - 1).cast("string"), 10, FANOUT))).otherwise(0)


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Blocks (g, block, depth, items, l0 to l<LEVELS>) of nodes (g, idx, node, depth, carry); l<k> lists the nodes at level k, and the last one is the block's root."""
    item = F.sort_array(F.collect_list(F.struct("idx", "node", *carry)))
    out = nodes.groupBy("g", F.floor(F.col("idx") / BLOCK).alias("block")).agg(item.alias("items"), F.max("depth").alias("depth"))
    out = out.withColumn("l0", F.col("items.node"))
    for k in range(LEVELS):
        below = F.col(f"l{k}")
        run = lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256)  # noqa: B023, E731
        last = F.floor((F.size(below) - 1) / FANOUT).cast("int")
        out = out.withColumn(f"l{k + 1}", F.when(F.col("depth") > k, F.transform(F.sequence(F.lit(0), last), run)).otherwise(below))
    return stored(out, "manifest-blocks")


def _rounds(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and (g, node): what is left of each group."""
    rounds = []
    while not rounds or nodes.where("depth > 0").limit(1).count():
        rounds.append(_blocks(nodes, [] if rounds else carry))
        nodes = rounds[-1].select("g", F.col("block").alias("idx"), F.col(f"l{LEVELS}")[0].alias("node"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"))
    return rounds, nodes.select("g", "node")


def _siblings(position: Column) -> Column:
    """The siblings of the item at a position of a block, level by level: those to the left of it and those to the right, joined."""

    def level(k: int) -> Column:
        at = F.floor(position / FANOUT**k).cast("int")
        run = F.slice(F.col(f"l{k}"), F.floor(at / FANOUT).cast("int") * FANOUT + 1, FANOUT)
        own = F.pmod(at, F.lit(FANOUT))
        join = lambda x: F.array_join(x, "")
        return F.when(F.col("depth") > k, F.struct(join(F.slice(run, 1, own)).alias("left"), join(F.slice(run, own + 2, FANOUT)).alias("right")))

    return F.filter(F.array(*[level(k) for k in range(LEVELS)]), lambda s: s.isNotNull())


def _descend(rounds: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """g, node, carry, siblings and the further columns of tops (g, siblings, ...) for every leaf of the first round."""
    more = [c for c in tops.columns if c not in ("g", "siblings")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(rounds))):
        own = F.transform("items", lambda x, i: F.struct(x["idx"].alias("idx"), x["node"].alias("node"), *[x[c].alias(c) for c in (() if k else carry)], F.concat(_siblings(i), F.col("siblings")).alias("siblings")))  # noqa: B023
        out = blocks.join(above, ["g", "block"]).select("g", *more, F.inline(own))
        above = out.select("g", *more, F.col("idx").alias("block"), "siblings")
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """Every leaf with its group's subroot, the root and its proof.

    leaves: g (name of the group, null for the group without one), key (long), leaf and further columns, which stay.
    siblings: an array of (left, right), level by level up to the root."""
    carry = [c for c in leaves.columns if c not in ("g", "key", "leaf")]
    named = F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit("="), F.col("g")))  # null first
    at, read = ranked(leaves.withColumn("g", named))
    rounds, subroots = _rounds(at.select("g", "idx", F.col("leaf").alias("node"), depth_of(F.col("total")).alias("depth"), *carry), carry)
    subroots = stored(subroots, "manifest-subroots")
    drop_stored(*read)
    head = F.rpad(F.substring(F.hex(F.encode("g", "UTF-8")), 1, 16), 16, "0")
    key = F.shiftleft(F.conv(F.substring(head, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(head, 9, 8), 16, 10).cast("long"))
    names = subroots.withColumn("head", key).withColumn("all", F.lit(0))
    counts = stored(names.groupBy("all", "head").agg(F.count(F.lit(1)).alias("n")), "manifest-counts")
    places = preceding(counts, ["all"], "head", "manifest-names")
    drop_stored(counts)
    own = F.row_number().over(W.partitionBy("head").orderBy("g")) - 1
    top = names.withColumn("own", own).join(places, ["all", "head"]).select(F.lit("").alias("g"), (F.col("before") + F.col("own")).alias("idx"), "node", depth_of(F.col("total")).alias("depth"), F.col("g").alias("group"))
    top_rounds, roots = _rounds(top, ["group"])
    nothing = F.filter(F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))), lambda s: F.lit(False))
    tops = _descend(top_rounds, roots.select("g", F.col("node").alias("root"), nothing.alias("siblings")), ["group"])
    tops = stored(tops.select(F.col("group").alias("g"), F.col("node").alias("subroot"), "root", "siblings"), "manifest-tops")
    out = _descend(rounds, tops, carry)
    drop_stored(subroots, places, *top_rounds)
    return out.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("g"), F.col("node").alias("leaf"), *carry, "subroot", "root", "siblings")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy whose texts are lower-cased where 3 divides the CRC of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(hit, leaf_digest(text=lowered(F.col("text"))))
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").cast("long").alias("key"), leaf_digest().alias("leaf"), F.col("doc_id"), changed.alias("copy"))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = manifest(rows).withColumn("folded_root", folded(F.coalesce("copy", "leaf"), F.col("siblings")))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
