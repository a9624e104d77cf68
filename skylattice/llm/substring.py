"""Substring deduplication: words that stand in a window which starts earlier in the corpus go.

The corpus in doc_id order is the reference, cut into phrases by content: every window of WINDOW words is
anchored at the smallest hash of GRAM words in it, and the run of consecutive windows with one anchor is a
phrase. Phrases are dealt by hash into blocks, and a block knows the first document that holds each. A
document's phrases that start elsewhere earlier are copies. Where a copy may end inside a phrase, which is
when another phrase with the same anchor exists, the phrase's windows are looked up one by one, so copies are exact at
their ends. Adjoining copies are united to spans afterwards.

This is not the greedy relative Lempel-Ziv parse: no factor is extended to its longest match in one reference block, and a span
has no source. The words found are the same, as a word is covered by a long enough factor just when it is in such a window; README says
why the parse itself is left out.

Every window belongs to exactly one phrase, and equal windows have equal anchors, so this finds
all windows whose words start earlier, and no key ever holds more than a minimum: copies of any
number meet in a partial aggregate.

Nulls and other cases: a null or empty text has no words and keeps none; texts shorter than a
window are kept whole; rows with a null doc_id come after all others, in an order by content;
rows that share a doc_id count as one document and don't remove each other's words; an empty
table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import BASE, gathered, hashed_words, mix64, powers, stored, texts
from skylattice.llm.neardup import node_id

#: Words of a window, and words of the hashes that anchor it.
WINDOW, GRAM = 20, 5
#: Bytes of text that a task parses together.
GATHER = 1 << 20

def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of every window of so many values."""
    n = len(g) - width + 1
    at, span = np.arange(len(g)), 1
    while span < width:  # doubling, and at last an overlapping step
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        span += step
    return at[:n]


class Batch:
    """The phrases of many texts, whose words stand one after another: run [start, stop) of windows, doc, anchor and key of each."""

    def __init__(self, batch: list[bytes]) -> None:
        h, self.counts = hashed_words(batch)
        self.ends = np.cumsum(self.counts)
        n = self.size = int(self.ends[-1]) if len(batch) else 0
        self.start = self.stop = self.doc = np.zeros(0, np.int64)
        self.anchor = self.key = self.sums = self.down = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        g = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            g = g * np.uint64(BASE) + h[k : n - GRAM + 1 + k]
        g = mix64(g)
        at = sliding_argmin(g, WINDOW - GRAM + 1)
        of = np.repeat(np.arange(len(batch)), self.counts)
        windows = np.flatnonzero(of[: n - WINDOW + 1] == of[WINDOW - 1 :])  # within a text
        if not len(windows):
            return
        least, of = at[windows], of[windows]
        cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])]))
        self.start, self.stop = windows[cut], windows[np.append(cut[1:], len(windows)) - 1] + 1
        self.doc, self.anchor = of[cut], g[least[cut]]
        up, self.down = powers(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
        length = (self.stop - self.start).astype(np.uint64)
        self.key = mix64(mix64(self.span(self.start, self.stop + WINDOW - 1)) + self.anchor + length) & ~np.uint64(1)

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [first, end)."""
        return (self.sums[end] - self.sums[first]) * self.down[first]

    @staticmethod
    def tagged(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Keys told apart by text."""
        return mix64(key + mix64(doc.astype(np.uint64) + np.uint64(1)))

    def firsts(self) -> np.ndarray:
        """Which phrases are the first of their key in their text."""
        return _first_seen(self.tagged(self.key, self.doc))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, start and key of every window of the phrases at which."""
        size = (self.stop - self.start)[which]
        phrase = np.repeat(which, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.start[phrase]
        return phrase, at, mix64(mix64(self.span(at, at + WINDOW)) + self.anchor[phrase])


def _first_seen(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _listed(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of an Arrow list<long> column; nulls are empty."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]
    return np.repeat(np.arange(len(column)), np.diff(ends)), values


ROWS = "anchor long, key long, id long"


def phrase_rows(docs: DataFrame) -> DataFrame:
    """anchor, key and id of every phrase of every text, once a text; docs: id, text."""

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            p = Batch(texts(b.column(1)))
            one = p.firsts()
            yield pa.record_batch({"anchor": _signed(p.anchor[one]), "key": _signed(p.key[one]), "id": b.column(0).take(pa.array(p.doc[one]))})

    return docs.select("id", "text").mapInArrow(run, ROWS)


def _here(p: Batch, column) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases start here first, and which of those share their anchor with others, so that parts of them may be copies.

    column: the keys of a text's first phrases, with the lowest bit set for a shared anchor."""
    row, value = _listed(column)
    shared = (value & np.uint64(1)).astype(bool)
    tags, mine = Batch.tagged(value & ~np.uint64(1), row), Batch.tagged(p.key, p.doc)
    one = _first_seen(mine)
    return one & np.isin(mine, tags), np.flatnonzero(one & np.isin(mine, tags[shared]))


def window_rows(parsed: DataFrame) -> DataFrame:
    """anchor, key and id of the windows where copies may end, once a text; takes all columns, so that both readers of parsed share one shuffle."""
    columns = parsed.columns

    def run(batches):
        at = {c: columns.index(c) for c in ("id", "text", "firsts")}
        for b in gathered(batches, at["text"], GATHER):
            p = Batch(texts(b.column(at["text"])))
            phrase, _, key = p.windows(_here(p, b.column(at["firsts"]))[1])
            one = _first_seen(Batch.tagged(key, p.doc[phrase]))
            phrase = phrase[one]
            yield pa.record_batch({"anchor": _signed(p.anchor[phrase]), "key": _signed(key[one]), "id": b.column(at["id"]).take(pa.array(p.doc[phrase]))})

    return parsed.mapInArrow(run, ROWS)


def removed_words(p: Batch, firsts, first_windows) -> np.ndarray:
    """Which of the words are covered by a window that starts elsewhere earlier, given what starts here first."""
    here, open_phrases = _here(p, firsts)
    copied = np.zeros(p.size + 1, bool)
    length = p.stop - p.start
    at = np.repeat(p.start - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else p.start, length) + np.arange(length.sum())
    copied[at] = np.repeat(~here, length)
    if len(open_phrases):
        phrase, at, key = p.windows(open_phrases)
        row, value = _listed(first_windows)
        tag = Batch.tagged(key, p.doc[phrase])
        copied[at[~(_first_seen(tag) & np.isin(tag, Batch.tagged(value, row)))]] = True
    starts = np.flatnonzero(copied)
    change = np.bincount(starts, minlength=p.size + 1) - np.bincount(starts + WINDOW, minlength=p.size + 1)[: p.size + 1]
    return np.cumsum(change)[: p.size] > 0


def _parsed(docs: DataFrame, extra: list) -> DataFrame:
    """Every row with what its text has first: its phrases (firsts; the lowest bit marks those to be looked into) and their windows."""
    rows = docs.select(node_id(F.col("doc_id"), F.col("text")).alias("id"), "text", *extra)
    classes = stored(phrase_rows(rows).groupBy("anchor", "key").agg(F.min("id").alias("id")), "substring-phrases")
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(1).cast("long").alias("edge"))
    value = F.col("key") + F.coalesce("edge", F.lit(0).cast("long"))
    firsts = classes.join(shared, "anchor", "left").groupBy("id").agg(F.collect_list(value).alias("firsts"))
    parsed = rows.join(firsts, "id", "left")
    windows = window_rows(parsed).groupBy("anchor", "key").agg(F.min("id").alias("id"))
    return parsed.join(windows.groupBy("id").agg(F.collect_list("key").alias("first_windows")), "id", "left")


def _cleaned(b):
    """The phrases of a batch of id, text, firsts, first_windows, and which words of each text go."""
    p = Batch(texts(b.column(1)))
    gone = removed_words(p, b.column(2), b.column(3))
    return p, np.split(gone, p.ends[:-1]) if len(p.ends) else []


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join(compress(words, (~gone).tolist()) if gone.any() else words)


def spans(gone: np.ndarray) -> list[dict]:
    """Copies (first word, end), adjoining and overlapping ones joined."""
    on = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"first": int(a), "end": int(z)} for a, z in on.reshape(-1, 2)]


INPUT = ("id", "text", "firsts", "first_windows")


def removed_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (first, end) of every row."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            p, gone = _cleaned(b)
            sha = [hashlib.sha256(_kept(t, g)).hexdigest() for t, g in zip(texts(b.column(1)), gone, strict=True)]
            cut = [spans(g) if g.any() else [] for g in gone]
            yield pa.record_batch({"doc_id": b.column(4), "n_words": pa.array(p.counts), "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(cut, kind)})

    out = _parsed(docs, [F.col("doc_id").cast("long").alias("own_id")]).select(*INPUT, "own_id")
    return out.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>")


def without_substrings(docs: DataFrame) -> DataFrame:
    """The input's rows, each text without its removed words; rows that lose their last word go. n_chars follows the text."""
    names = list(docs.columns)
    schema = docs.schema

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            _, gone = _cleaned(b)
            new = [(_kept(t, g) if g.any() else t).decode() for t, g in zip(texts(b.column(1)), gone, strict=True)]
            keep = [not len(g) or not g.all() for g in gone]
            cols = {c: b.column(4 + i) for i, c in enumerate(names)}
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in new], pa.int64()).cast(cols["n_chars"].type)
            yield pa.record_batch(list(cols.values()), [f"c{i}" for i in range(len(names))]).filter(pa.array(keep, pa.bool_()))

    extra = [(F.lit(None).cast("string") if c == "text" else F.col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    out = _parsed(docs, extra).select(*INPUT, *[f"c{i}" for i in range(len(names))]).mapInArrow(run, types)
    return out.toDF(*names)
