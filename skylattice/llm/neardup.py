"""MinHash near-duplicate classes.

Texts become sets of hashed word shingles. Rows with equal sets form one class, a node, so exact
copies of any number cost one row. Nodes get many universal-hash minima, of which a byte each is
kept, and rows of bands put them into buckets. Links are found in rounds, none of which emits the
pairs of a bucket, each with rows in proportion to the members:

1. every member is paired with the best-connected member of one of its buckets, the one it
   shares most bands with;
2. in buckets that still hold several components, every member outside the largest of them is
   compared, by signature, with one member of each of its buckets that a hash of the round picks
   among a few; the pair that agrees best is tried. This goes on while it links a good part of them;
3. what is left outside the largest component of a bucket is compared with those that share one of its rarest shingles:
   texts at the threshold that are put in one order share one of the first few, so none is missed, and
   texts that only have a common template in common don't meet. Groups of one shingle are compared block by
   block inside tasks: sizes and places first, signatures then, and those that agree on their full shingle sets. A task
   keeps the components that it has found so far and emits only links that join two of them.

Pairs are always confirmed on full shingle sets, and components come from alternating large-star
and small-star steps, written to the shared folder between rounds. With BANDS x ROWS minima two texts
of similarity 0.85 meet in no bucket with probability 2.4e-7, and texts that meet fail the signature
test with probability 1.1e-5; for 0.8 these are 3.3e-5 and 1.4e-5.

Nulls and other cases: a null or empty text has no shingles, links with nothing and is its own
component; a text shorter than a shingle is one shingle; rows with a null doc_id link like others
through surrogate ids that sort last and are returned as null; rows that share a doc_id are told
apart by their text, so one may stay where another goes; of repeated rows deduplicated() keeps one; an
empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import BASE, drop_stored, gathered, hashed_words, mix64, row_hash, slices, stored, texts

#: Bands of minima, and minima a band.
BANDS, ROWS = 26, 5
#: Standard deviations below the expected number of equal signature bytes at which a pair is still confirmed.
MARGIN = 4.3
#: Members of a group that are compared at once, and their shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Slots that shingles are counted in to tell rare ones; it decides only how many texts meet, not which links are found.
SLOTS = 1 << 20
#: Members of a bucket of which one is picked to be compared with the others of them in a round.
PICKED = 8
#: Rounds go on while one links this share of the members that are still apart; it decides only who finds a link.
YIELD = 0.25
#: Bytes of text that a task cuts into shingles together.
GATHER = 1 << 20
#: Surrogate ids of rows without doc_id start here.
NO_ID = 1 << 62

_RNG = np.random.default_rng(20240501)
_MULT = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(batch: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    h, counts = hashed_words([t.lower() for t in batch])
    g = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        g = mix64(g * np.uint64(BASE) + h[k : len(h) - width + 1 + k]) if len(g) else g
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(g[at : at + n - width + 1]))
        else:
            short = np.full(min(n, 1), n, np.uint64)
            for k in range(n):
                short = mix64(short * np.uint64(BASE) + h[at + k])
            out.append(short)
        at += n
    return out


def signature(s: np.ndarray) -> bytes:
    """The low byte of the minimum of every universal hash (multiply and add modulo 2^64, high half)."""
    low = None
    for i in range(0, len(s), 1024):
        x = np.multiply.outer(_MULT, s[i : i + 1024])
        x += _ADD[:, None]
        m = x.min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return ((low >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()


def node_id(doc_id, text):
    """doc_id, or a surrogate by content that sorts after every real id."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 60)))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, no_id, h (hash of the text), n_shingles, fp1, fp2 (of the set) and sig of every row."""

    def run(batches):
        for b in gathered(batches, 3, GATHER):
            n, f1, f2, sigs = [], [], [], []
            for s in shingles(texts(b.column(3)), width):
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                f1.append(int.from_bytes(d[:8], "little", signed=True))
                f2.append(int.from_bytes(d[8:], "little", signed=True))
                sigs.append(signature(s) if len(s) else None)
            yield pa.record_batch({"id": b.column(0), "no_id": b.column(1), "h": b.column(2), "n_shingles": pa.array(n, pa.int64()), "fp1": pa.array(f1, pa.int64()), "fp2": pa.array(f2, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    rows = docs.select(node_id(F.col("doc_id"), F.col("text")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), F.col("text"))
    return rows.mapInArrow(run, "id long, no_id boolean, h long, n_shingles long, fp1 long, fp2 long, sig binary")


def _bands(sigs: np.ndarray) -> np.ndarray:
    """Bucket keys (rows x BANDS) of signatures (rows x BANDS*ROWS)."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sigs), 0)
    cut = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        key = key * np.uint64(256) + cut[:, :, k]
    return mix64(key).view(np.int64)


def buckets(nodes: DataFrame) -> DataFrame:
    """key, band and id of every bucket of every node."""

    def run(batches):
        for b in slices(batches, 5000):
            if b.num_rows:
                keys = _bands(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch({"key": keys.ravel(), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), "id": np.repeat(ids, BANDS)})

    return nodes.select("id", "sig").mapInArrow(run, "key long, band int, id long")


def confirmed(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of percent at least; held: id and text."""

    def run(batches):
        for batch in gathered(batches, 2, GATHER):
            keep, last = [], None
            for b, set_a, tb in zip(batch.column(1).to_pylist(), shingles(texts(batch.column(2)), width), texts(batch.column(3)), strict=True):
                if last != b:
                    last, (set_b,) = b, shingles([tb], width)
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda k: held.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every node of the edges (a, b): alternating large-star and small-star until no edge changes."""
    edges = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), name)
    size = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v is a neighbour of u
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stored(small.distinct(), name)
        n = new.count()
        done = n == size and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_stored(edges)
        edges, size = new, n
        if done:
            found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
            found.stored_path = edges.stored_path
            return found


def agreeing(percent: int) -> int:
    """Equal signature bytes from which a pair is confirmed: all but 1e-5 of the pairs at the threshold have them."""
    p = percent / 100
    return int(BANDS * ROWS * p - MARGIN * (BANDS * ROWS * p * (1 - p)) ** 0.5)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of each signature of a are those of each of b."""
    if len(a) * len(b) < 4096:
        return (a[:, None] == b[None]).sum(axis=2, dtype=np.uint8)
    out, columns = np.zeros((len(a), len(b)), np.uint8), np.ascontiguousarray(b.T)
    for k in range(a.shape[1]):  # a byte of all pairs at a time
        out += a[:, k, None] == columns[k]
    return out


def _agreement(m: dict, left: np.ndarray, right: np.ndarray, comps: np.ndarray, least: int, percent: int):
    """Chunks (left members, matrix of which right members may link with them: in another component, of a size and with as much
    left after the shingle where they meet that the threshold can be reached, and with an agreeing signature)."""
    n, room = m["n"], m["n"] - m["at"]
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        rest = np.minimum(room[x][:, None], room[right][None])
        agree = ((100 + percent) * rest >= percent * (n[x][:, None] + n[right][None])) & (comps[x][:, None] != comps[right][None])
        there, here = np.flatnonzero(agree.any(axis=1)), np.flatnonzero(agree.any(axis=0))
        if len(there):
            agree[np.ix_(there, here)] &= _scores(m["sig"][x[there]], m["sig"][right[here]]) >= least
        yield x, agree


_BY = ("key", "i", "j")
#: Numbers of a member in a group: its set size and where in the order of rarity its shingle of the group stands.
_MEMBER = ("side", "id", "component", "n", "at")


def _groups(batches, more: tuple[str, ...] = ()):
    """(key, members by column) of every group of rows, from batches sorted by _BY; more: binary columns besides sig."""
    last, held = None, []

    def joined():
        out = {c: np.concatenate([h[c] for h in held]) for c in (*_MEMBER, "sig")}
        return last, out | {c: [x for h in held for x in h[c]] for c in more}

    for b in batches:
        if not b.num_rows:
            continue
        column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        number = lambda c: column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        keys = np.stack([number(c) for c in _BY], 1)
        data = {c: number(c) for c in _MEMBER} | {"sig": np.frombuffer(b"".join(column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)} | {c: column(c).to_pylist() for c in more}
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[at].tolist())
            if key != last and held:
                yield joined()
                held = []
            last = key
            held.append({c: x[at:end] for c, x in data.items()})
    if held:
        yield joined()


def _agreeing_members(m: dict, least: int, percent: int) -> list[np.ndarray]:
    """Members of a block that is apart (side 0) and of a block of the group (side 1) that may link with one on the other side: those that hang together, in an array each."""
    left, right = np.flatnonzero(m["side"] == 0), np.flatnonzero(m["side"] == 1)
    number = np.unique(m["id"], return_inverse=True)[1]
    part = np.arange(number.max() + 1)  # of every id; the same for ids that hang together
    met = np.zeros(len(m["id"]), bool)
    for x, agree in _agreement(m, left, right, m["component"], least, percent):
        for i in np.flatnonzero(agree.any(axis=1)):
            met[x[i]] = True
            met[right[agree[i]]] = True
            own = np.unique(part[np.append(number[right[agree[i]]], number[x[i]])])
            part[np.isin(part, own)] = own[0]
    at = np.flatnonzero(met)
    of = part[number[at]]
    return [at[of == k] for k in np.unique(of)]


def _linked_members(m: dict, least: int, percent: int) -> list[tuple[int, int]]:
    """Links between members of two blocks, judged on full shingle sets; only those that join components."""
    sets = [np.frombuffer(x, np.uint64) for x in m["shingles"]]
    sizes = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.split(number, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(number.max()) + 1, bool)
    _, now = np.unique(m["component"], return_inverse=True)
    left, right = np.flatnonzero(m["side"] == 0), np.flatnonzero(m["side"] == 1)
    out = []
    for chunk, agree in _agreement(m, left, right, m["component"], least, percent):
        for x, row in zip(chunk, agree, strict=True):
            partners = right[row]
            partners = partners[now[partners] != now[x]]
            if not len(partners):
                continue
            mark[cut[x]] = True
            ends = np.cumsum(sizes[partners])
            both = np.add.reduceat(mark[np.concatenate([cut[y] for y in partners])].astype(np.int64), ends - sizes[partners])
            mark[cut[x]] = False
            for y in partners[100 * both >= percent * (sizes[x] + sizes[partners] - both)]:
                if now[y] != now[x]:
                    now[now == now[y]] = now[x]
                    out.append((int(m["id"][x]), int(m["id"][y])))
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) of every node after more links (a, b)."""
    to = lambda k: comp.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    lifted = links.join(to("a"), "a").join(to("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    found = components(lifted, "neardup-edges")
    top = found.select(F.col("id").alias("component"), F.col("component").alias("top"))
    new = stored(comp.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "neardup-components")
    drop_stored(comp, found)
    return new


def _apart(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets or groups (key, id and further columns) that hold several components, with component and whether they are outside the largest of them (apart)."""
    placed = shared.join(comp, "id")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count(F.lit(1)).alias("several")).where("several > 1")
    return stored(placed.join(largest.select("key", "largest"), "key").withColumn("apart", F.col("component") != F.col("largest")).drop("largest"), "neardup-apart")


def _tried(members: DataFrame, sigs: DataFrame, turn: int, least: int) -> DataFrame:
    """One pair (a, b) of each member that is apart: with the picked member of one of its buckets that it agrees with best, if it does well enough."""

    def run(batches):
        for b in slices(batches, 5000):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
                agree = (x == y).sum(axis=1)
                out = pa.record_batch([b.column(0), b.column(1), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])
                yield out.filter(pa.array(agree >= least))

    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / PICKED).cast("long"))
    dealt = members.withColumn("part", part)
    picked = dealt.groupBy("key", "part").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(-turn))).alias("p"))
    pairs = dealt.where("apart").join(picked, ["key", "part"]).where(F.col("component") != F.col("p.component")).select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()
    of = lambda k: sigs.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"))
    judged = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, agree int")
    return judged.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _commonness(sets: DataFrame) -> bytes:
    """How common the shingles of each of SLOTS slots are, a byte on a logarithmic scale: what tasks count is added up by Spark."""

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                seen += np.bincount(_slots(np.frombuffer(x, np.uint64)), minlength=SLOTS)
        there = np.flatnonzero(seen)
        yield pa.record_batch({"slot": pa.array(there, pa.int64()), "n": pa.array(seen[there])})

    counts = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    level = np.zeros(SLOTS, np.uint8)
    for b in counts.select("slot", F.least(F.lit(255), F.round(F.log2("n") * 6)).cast("int").alias("level")).toArrow().to_batches():  # SLOTS rows at most
        level[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return level.tobytes()


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n (size of the set) and at (place in the order): the rarest shingles of every set (id, shingles), as many that sets at the threshold share one of them.

    Two such sets have percent of the larger one in common at least, so if both are put in the same order, one of
    those shared is among the first n - ceil(percent * n / 100) + 1 of each. In the order of rarity these are what a text has of its own:
    texts that only share what many have don't meet."""
    level = _commonness(sets)

    def run(batches):
        common = np.frombuffer(level, np.uint8)
        for b in slices(batches, 500):
            keys, n, sizes = [], [], []
            for x in b.column(1).to_pylist():
                h = np.frombuffer(x, np.uint64)
                first = len(h) + (-percent * len(h)) // 100 + 1
                keys.append(h[np.lexsort((h, common[_slots(h)]))[:first]])
                n.append(len(keys[-1]))
                sizes.append(len(h))
            if keys:
                at = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch(
                    {"key": np.concatenate(keys).view(np.int64), "id": np.repeat(b.column(0).to_numpy(zero_copy_only=False), n), "n": np.repeat(np.array(sizes, np.int32), n), "at": at.astype(np.int32)}
                )

    return sets.mapInArrow(run, "key long, id long, n int, at int")


def _shingle_sets(held: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and shingles (sorted hashes) of the texts of some ids."""

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in shingles(texts(b.column(1)), width)], pa.binary())], ["id", "shingles"])

    return stored(held.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, shingles binary"), "neardup-sets")


def _late_links(members: DataFrame, comp: DataFrame, sigs: DataFrame, held: DataFrame, percent: int, width: int, least: int) -> DataFrame:
    """Links (a, b) of the members that are apart with all those that share a rare shingle with them, block by block."""
    sets = _shingle_sets(held, members.select("id").distinct(), width)
    rare = _rare_shingles(sets, percent)
    sizes = rare.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    meeting = stored(rare.join(sizes, "key"), "neardup-rare")
    members = _apart(meeting, comp)
    drop_stored(meeting)
    signed = members.join(sigs.select("id", "sig"), "id")
    blocks = lambda where: F.greatest(F.lit(1), F.ceil(F.count(where) / BLOCK), F.ceil(F.sum(F.when(where.isNotNull(), F.col("n").cast("long"))) / BLOCK_SHINGLES))
    sizes = members.groupBy("key").agg(blocks(F.when(F.col("apart"), 1)).alias("n_i"), blocks(F.lit(1)).alias("n_j"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    columns = (*_BY, *_MEMBER, "sig")
    sized = signed.join(sizes, "key")
    left = sized.where("apart").withColumns({"i": own("n_i"), "j": numbers("n_j"), "side": F.lit(0)}).select(*columns)
    right = sized.withColumns({"j": own("n_j"), "i": numbers("n_i"), "side": F.lit(1)}).select(*columns)
    sort = lambda df: df.repartition(*_BY).sortWithinPartitions(*_BY)

    def agreeing_rows(batches):
        for _, m in _groups(batches):
            for there in _agreeing_members(m, least, percent):
                there = there[np.lexsort((m["side"][there], m["id"][there]))]
                ids, side = m["id"][there], m["side"][there]
                name = xxhash.xxh3_64_intdigest(ids.tobytes() + side.tobytes()) >> 1  # texts that meet by many shingles are one group
                rows = {"key": np.full(len(ids), name, np.int64), "side": side.astype(np.int32), "id": ids, "component": m["component"][there], "n": m["n"][there].astype(np.int32)}
                yield pa.record_batch(rows | {"sig": pa.array([x.tobytes() for x in m["sig"][there]], pa.binary())})

    def linking_rows(batches):
        for _, m in _groups(batches, ("shingles",)):
            found = _linked_members(m, least, percent)
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    schema = "key long, side int, id long, component long, n int, sig binary"
    involved = stored(sort(left.unionByName(right)).mapInArrow(agreeing_rows, schema), "neardup-involved")
    once = involved.groupBy("key", "id", "side").agg(*[F.first(c).alias(c) for c in ("component", "n", "sig")])
    once = once.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "at": F.lit(0)})
    links = stored(sort(once.join(sets, "id")).mapInArrow(linking_rows, "a long, b long"), "neardup-late")
    drop_stored(members, involved, sets)
    return links


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, no_id, h, n_shingles and found (id and h of the first row of its component) of every row."""
    least = agreeing(percent)
    rows = stored(sketches(docs, width), "neardup-rows")
    known = rows.where("n_shingles > 0")
    classes = known.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("id", "h")).alias("rep"))
    crowd = classes.groupBy("rep.id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("many"))
    node = F.when(F.col("many").isNull(), F.col("rep.id")).otherwise(F.lit(NO_ID) + F.pmod(F.xxhash64("fp1", "fp2", F.lit(1)), F.lit(1 << 60)))
    classes = stored(classes.join(crowd, F.col("rep.id") == F.col("many"), "left").withColumn("node", node).drop("many"), "neardup-classes")
    reps = classes.select("node", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    sigs = known.select("id", "h", "sig", "n_shingles").join(reps, ["id", "h"]).groupBy("id", "h").agg(F.first("node").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    sigs = stored(sigs.select(F.col("node").alias("id"), "sig", "n_shingles"), "neardup-nodes")
    banded = stored(buckets(sigs).distinct(), "neardup-bands")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(banded.join(sizes, "key"), "neardup-shared")
    drop_stored(banded)
    wanted = reps.join(shared.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    held = docs.select(node_id(F.col("doc_id"), F.col("text")).alias("id"), F.xxhash64("text").alias("h"), "text").join(wanted, ["id", "h"])
    held = held.groupBy("id", "h").agg(F.first("node").alias("node"), F.first("text").alias("text"))  # dealt as joined: repeated rows go without another shuffle
    held = stored(held.select(F.col("node").alias("id"), "text"), "neardup-texts")

    # round 1: one pair a member, with the best-connected member of its buckets
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"), F.col("top.degree").alias("degree"))
    met = shared.select("key", "id").join(centre, "key").where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("bands"), F.max("degree").alias("degree"))
    best = met.groupBy("id").agg(F.max(F.struct("bands", "degree", "centre")).alias("best")).select(F.col("id").alias("a"), F.col("best.centre").alias("b"))
    comp = stored(shared.select("id", F.col("id").alias("component")).distinct(), "neardup-components")
    comp = _merged(comp, confirmed(best, held, width, percent))

    # round 2: members that are apart, each with picked members of its buckets
    turn = 1
    while True:
        members = _apart(shared, comp)
        apart = members.where("apart").select("id").distinct().count()
        if not apart:
            break
        links = stored(confirmed(_tried(members, sigs, turn, least), held, width, percent), "neardup-tried")
        n = links.count()
        if n:
            comp = _merged(comp, links)
        drop_stored(links)
        if n < YIELD * apart:
            if n:
                drop_stored(members)
                members = _apart(shared, comp)
            break
        drop_stored(members)
        turn += 1

    # round 3: what is still apart, with everything in its buckets
    if apart:
        links = _late_links(members, comp, sigs, held, percent, width, least)
        comp = _merged(comp, links)
        drop_stored(links)
    drop_stored(members, sigs, shared, held)

    of = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = of.groupBy("component").agg(F.min("rep").alias("found"))
    of = of.join(first, "component").select("n_shingles", "fp1", "fp2", "found")
    out = rows.select("id", "no_id", "h", "n_shingles", "fp1", "fp2").join(of, ["n_shingles", "fp1", "fp2"], "left")
    return out.select("id", "no_id", "h", "n_shingles", F.coalesce("found", F.struct("id", "h")).alias("found"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return _placed(docs, width, percent).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_shingles", real("found.id").alias("component_id"), (F.col("id") == F.col("found.id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows without those that another row of their component stands for; of repeated rows one stays."""
    placed = stored(_placed(docs, width, percent), "neardup-placed")
    first = F.col("found") == F.struct("id", "h")
    gone = placed.where(~first).select("id", "h").distinct()
    twice = stored(placed.where(first & (F.col("n_shingles") > 0)).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "h"), "neardup-twice")
    names = list(docs.columns)
    every = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(node_id(F.col("doc_id"), F.col("text")).alias("id"), F.xxhash64("text").alias("h"), every.alias("row"), row_hash(docs).alias("rest")).join(gone, ["id", "h"], "left_anti")
    if not twice.isEmpty():
        once = rows.join(twice, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", "rest").alias("row"))
        rows = rows.drop("rest").join(twice, ["id", "h"], "left_anti").unionByName(once)
    return rows.select(*[F.col("row")[c].alias(c) for c in names])
