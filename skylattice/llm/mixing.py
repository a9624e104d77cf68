"""Mix sources to target weights by fitting each source's word budget as a subset sum.

A source's budget is first spent in whole epochs; what is left over (less than the source's
size) picks documents by exact size. A proportional share of the documents of every size, the
largest sizes first and with the rounding carried on, leaves less than the longest document; a
balanced bounded-knapsack dynamic program over the documents that may be added and taken out then
gives the largest sum that any choice of the source's documents can have within the budget. Its
table is as wide as two longest documents, whatever the budget, and only the histogram of sizes
enters it, so a hot source costs no more than any other. Which documents of a size are taken is
decided by a seeded hash of doc_id and text, then of the whole row: the limit of a size is found in
as many bins as the square root of its documents, so no task ranks more than one bin.

Nulls and other cases: a null text has size 0; null sources form a source of their own, last in
order; rows with a null or repeated doc_id are rows like any other, told apart by their text and
further columns, and equal rows are numbered within input partitions; a source without words gets
target 0; an empty table gives an empty result; further columns may have any name, and are passed
over by mix_sources and kept by mixed_documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stored, row_hash, stored, words_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source's target is at most this many times its size, and so is a document's share.
MAX_REPEATS = 3
#: Sources of one range when they are numbered.
RANGED = 50_000
#: Pairs of a sum and a document that the dynamic program handles at once.
PAIRS = 1 << 20


def _chunks(sizes: np.ndarray, counts: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(size number, copies) of chunks that make up every count from 0 on; none wider than the widest document."""
    which, copies = [], []
    for i, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        k = 1
        while left > 0:
            k = min(k, left)
            which.append(i)
            copies.append(k)
            left -= k
            if 2 * k * size <= widest:
                k *= 2
    return np.array(which, np.int64), np.array(copies, np.int64)


def _balanced(sizes: np.ndarray, add: np.ndarray, drop: np.ndarray, gap: int) -> tuple[np.ndarray, int]:
    """Changes of counts whose sizes come to gap at most, as near as can be, and what is left of gap.

    A sum at or below the budget only ever grows and one above it only ever shrinks, so all sums stay within
    a longest document of it. keeps[sum] is the most chunks at the front that are still untouched by removals."""
    widest = int(sizes.max())
    more, more_n = _chunks(sizes, add, widest)
    less, less_n = _chunks(sizes, drop, widest)
    less_size = sizes[less] * less_n
    keeps = np.full(2 * widest + 1, -1, np.int64)
    event = np.full(2 * widest + 1, -1, np.int64)
    keeps[widest - gap], event[widest - gap] = len(less), 0
    parents, moves, known = [np.array([-1])], [np.array([0])], 1

    def log(at: np.ndarray, parent: np.ndarray, move: np.ndarray) -> None:
        nonlocal known
        event[at] = known + np.arange(len(at))
        parents.append(parent)
        moves.append(move)
        known += len(at)

    def shrink(at: np.ndarray, low: np.ndarray) -> None:
        """Remove from sums above the budget whichever chunks may go now and could not before."""
        while len(at):
            mixed = np.random.default_rng(len(at)).permutation(len(at))  # some of any height early on: the budget is met sooner
            at, low = at[mixed], low[mixed]
            ends = np.cumsum(keeps[at] - low)
            again, again_low, done = [], [], 0
            while done < len(at) and keeps[widest] < 0:  # the budget itself is the best sum
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                x, lo = at[done:stop], low[done:stop]
                n = keeps[x] - lo
                chunk = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
                to, origin = np.repeat(x, n) - less_size[chunk], np.repeat(x, n)
                better = np.flatnonzero(chunk > keeps[to])
                better = better[np.lexsort((chunk[better], to[better]))]
                better = better[np.append(np.flatnonzero(np.diff(to[better])), len(better) - 1)] if len(better) else better
                new = to[better]
                above = new > widest
                again.append(new[above])
                again_low.append(np.maximum(keeps[new[above]], 0))
                keeps[new] = chunk[better]
                log(new, event[origin[better]], -1 - chunk[better])
                done = stop
            if keeps[widest] >= 0:
                return
            at, first = np.unique(np.concatenate(again), return_index=True)  # a sum met twice: from its first mark on
            low = np.concatenate(again_low)[first]

    for t, (i, k) in enumerate(zip(more.tolist(), more_n.tolist(), strict=True)):
        if keeps[widest] >= 0:
            break
        size = int(sizes[i]) * k
        before = keeps[: widest + 1].copy()
        here = np.flatnonzero(before > keeps[size : size + widest + 1])
        there = here + size
        old = keeps[there]
        parent = event[here]
        keeps[there] = before[here]
        log(there, parent, np.full(len(here), 1 + t))
        above = there > widest
        shrink(there[above], np.maximum(old[above], 0))
    best = int(np.flatnonzero(keeps[: widest + 1] >= 0)[-1])
    parent, move, change, e = np.concatenate(parents), np.concatenate(moves), np.zeros(len(sizes), np.int64), int(event[best])
    while e > 0:
        m = int(move[e])
        if m > 0:
            change[more[m - 1]] += more_n[m - 1]
        else:
            change[less[-1 - m]] -= less_n[-1 - m]
        e = int(parent[e])
    return change, widest - best


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take for the largest sum of sizes that is not above budget."""
    out = np.zeros(len(sizes), np.int64)
    live = (sizes > 0) & (counts > 0)
    size, count = sizes[live].astype(np.int64), counts[live].astype(np.int64)
    total = int((size * count).sum())
    if budget <= 0 or total == 0:
        return out
    if total <= budget:
        out[live] = count
        return out
    unit = int(np.gcd.reduce(size))
    size, total, budget = size // unit, total // unit, budget // unit
    take, seen, taken = np.zeros(len(size), np.int64), 0, 0
    for i in np.argsort(-size, kind="stable").tolist():
        s, n = int(size[i]), int(count[i])
        seen += s * n
        take[i] = min(n, (budget * seen // total - taken) // s)
        taken += s * int(take[i])
    copies = 1  # of each size that may be added or taken out; few are enough unless there are few sizes
    while taken < budget:
        add, drop = np.minimum(count - take, copies), np.minimum(take, copies)
        change, left = _balanced(size, add, drop, budget - taken)
        if left == 0 or copies >= int(count.max()):
            take += change
            break
        copies *= 4
    out[live] = take
    return out


def numbered_sources(totals: DataFrame) -> DataFrame:
    """totals with the number k of each source from 0: code-point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = max(2, -(-totals.count() // RANGED))
    dealt = totals.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "mix-ranges")  # the limits of the ranges are sampled: fixed from here on
    starts, start = [], 0
    for k, n in sorted((r[0], r[1]) for r in dealt.groupBy("range").agg(F.count(F.lit(1))).collect()):
        starts.append((k, start))
        start += n
    first = dealt.sparkSession.createDataFrame(starts, "range int, start long")
    nth = F.row_number().over(W.partitionBy("range").orderBy(*order))
    out = dealt.withColumn("nth", nth).join(F.broadcast(first), "range").select("source", "source_size", (F.col("start") + F.col("nth") - 1).alias("k"))
    out.stored_path = dealt.stored_path  # what it reads
    return out


def plan_targets(totals: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """t_source, source_size and target of every source of totals (source, source_size).

    Shares by weight above cap x size stop there and the excess is shared again. The water level only rises
    from round to round, so it alone says which sources are capped; a round returns a row a weight."""
    numbered = numbered_sources(totals)
    sources = stored(numbered.select(F.col("source").alias("t_source"), "source_size", F.pmod("k", F.lit(len(weights))).cast("int").alias("w")), "mix-sources")
    drop_stored(numbered)
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("w") + 1)
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else weight * F.lit(level) > cap * F.col("source_size")
        sums = sources.groupBy("w").agg(F.count_if(~over), F.count_if(over), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0))).collect()
        found = sum(r[2] for r in sums)
        if found == capped:
            break
        capped, free = found, sum(r[1] * float(weights[r[0]]) for r in sorted(sums))
        if not free:
            break
        level = (float(whole) - sum(r[3] for r in sums)) / free
    target = F.least(weight * F.lit(level or 0.0), (cap * F.col("source_size")).cast("double"))
    out = sources.select("t_source", "source_size", target.alias("target"))
    out.stored_path = sources.stored_path
    return out


def _quotas(batches):
    """Adds epochs and quotas to rows of source, source_size, target and the sizes and counts of a source."""
    for b in batches:
        epochs, quotas = [], []
        for whole, target, sizes, counts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            times = min(MAX_REPEATS, int(target // whole)) if whole else 0
            extra = 0 if times == MAX_REPEATS else int(round(target - times * whole))
            epochs.append(times)
            quotas.append(fit_counts(np.array(sizes, np.int64), np.array(counts, np.int64), extra))
        yield pa.record_batch([*b.columns, pa.array(epochs, pa.int32()), pa.array(quotas, pa.list_(pa.int64()))], [*b.schema.names, "epochs", "quotas"])


def _keyed(docs: DataFrame, seed: int, *keep) -> DataFrame:
    """The columns kept, and source, size, and rank and rest, by which the rows of a size are ordered."""
    return docs.select(
        *keep, F.col("source"), words_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("rank"), row_hash(docs, seed).alias("rest"),
    )


def _to(table: DataFrame, *names: str) -> DataFrame:
    """table with its key columns renamed."""
    return table.withColumnsRenamed({c: f"to_{c}" for c in names})


def _joined(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """A null-safe join on columns of these names; those of the left stay."""
    on = F.lit(True)
    for c in names:
        on &= F.col(c).eqNullSafe(F.col(f"to_{c}"))
    return left.join(_to(right, *names), on, how).drop(*[f"to_{c}" for c in names])


def _plan(base: DataFrame, weights) -> DataFrame:
    """source, size, source_size, target, epochs and which documents of the size are taken once more.

    Rows are ordered by (bin of bins, rank, rest): those before the limit are taken, and so are `last` of the `tied` rows at it."""
    hist = stored(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    totals = stored(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-totals")
    lists = hist.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))
    targets = plan_targets(totals, weights)
    whole = targets.join(lists, F.col("source").eqNullSafe(F.col("t_source")))
    fits = whole.select("source", "source_size", "target", F.col("sizes.size").alias("sizes"), F.col("sizes.n").alias("counts")).mapInArrow(
        _quotas, "source string, source_size long, target double, sizes array<long>, counts array<long>, epochs int, quotas array<long>"
    )
    one = F.explode(F.arrays_zip("sizes", "counts", "quotas"))
    fitted = fits.select("source", "source_size", "target", "epochs", one.alias("x")).select(
        "source", F.col("x.sizes").alias("size"), F.col("x.counts").alias("n"), F.col("x.quotas").alias("quota"), "source_size", "target", "epochs",
        F.ceil(F.sqrt(F.col("x.counts"))).cast("long").alias("bins"),
    )
    fitted = stored(fitted, "mix-quotas")
    key = ("source", "size")
    cut = fitted.where("quota > 0 and quota < n").select(*key, "quota", "bins")
    placed = _joined(base, cut, *key).withColumn("bin", F.pmod("rank", F.col("bins")))
    counts = placed.groupBy(*key, "quota", "bin").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy(*key).orderBy("bin"))
    reached = counts.withColumn("upto", upto).where("upto >= quota and upto - m < quota")
    edge = stored(reached.select(*key, "bin", (F.col("quota") - F.col("upto") + F.col("m")).alias("need")), "mix-bins")
    at_edge = _joined(placed, edge, *key, "bin")
    rows = at_edge.groupBy(*key, "bin", "rank", "rest", "need").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy(*key).orderBy("rank", "rest"))
    limit = rows.withColumn("upto", upto).where("upto >= need and upto - m < need").select(
        *key, F.struct("bin", "rank", "rest").alias("limit"), (F.col("need") - F.col("upto") + F.col("m")).alias("last"), F.col("m").alias("tied")
    )
    plan = stored(_joined(fitted.drop("n"), limit, *key, how="left"), "mix-plan")
    drop_stored(hist, totals, targets, fitted, edge)
    return plan


def _copies(rows: DataFrame, plan: DataFrame, tag: str) -> DataFrame:
    """rows with source_size, target and copies, how often each is taken."""
    at = F.struct(F.pmod("rank", F.col("bins")).alias("bin"), "rank", "rest")
    level = F.when(F.col("quota") == 0, 1).when(F.col("limit").isNull() | (at < F.col("limit")), -1).when(at == F.col("limit"), 0).otherwise(1)
    found = _joined(rows, plan, "source", "size").withColumn("side", level)
    split = "side = 0 and last < tied"  # equal rows, of which some are taken
    more = (F.col("side") < 0) | ((F.col("side") == 0) & (F.col("last") == F.col("tied")))
    keep = [*rows.columns, "source_size", "target"]
    sure = found.where(f"not ({split})").select(*keep, (F.col("epochs") + more.cast("long")).alias("copies"))
    if plan.where("last < tied").isEmpty():
        return sure
    tied = stored(found.where(split).withColumn("part", F.spark_partition_id()), f"mix-tied-{tag}")
    parts = tied.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(W.partitionBy("source", "size").orderBy("part")) - F.col("m")
    nth = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("rank"))
    dealt = _joined(tied.withColumn("nth", nth), parts.select("source", "size", "part", before.alias("before")), "source", "size", "part")
    taken = (F.col("before") + F.col("nth") <= F.col("last")).cast("long")
    return sure.unionByName(dealt.select(*keep, (F.col("epochs") + taken).alias("copies")))


def mix_sources(docs: DataFrame, seed: int = 17, weights=WEIGHTS) -> DataFrame:
    """Every document with the words that the mix takes of it: doc_id, size, source_size, target, taken."""
    base = stored(_keyed(docs, seed, F.col("doc_id")), "mix-base")
    out = _copies(base, _plan(base, weights), "ids")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, weights=WEIGHTS) -> DataFrame:
    """The mix itself: the input's rows, each as often as it is taken."""
    base = stored(_keyed(docs, seed), "mix-base")
    rows = _keyed(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _copies(rows, _plan(base, weights), "rows")
    times = out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return times.select(*[F.col("row")[c].alias(c) for c in docs.columns])
