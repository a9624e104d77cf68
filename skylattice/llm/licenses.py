"""License scan by diagonal voting.

All rolling word k-grams of every text are hashed and joined in Spark to the positions of the
same k-grams in license templates. A hit votes for the diagonal (place in the text minus place in
the template) it lies on; the votes of a diagonal are gathered as a bit mask of template places, so
repeated hits count once. Diagonals of a template that lie close together, as words put in or left
out shift them, are merged, and those with enough votes become candidate spans, which are verified
word by word (longest common subsequence) on the text itself.

Short phrases are templates of a single k-gram: a vote is an occurrence, and all are counted.

Nulls and other cases: a null or empty text has no words, places or labels; rows are kept apart by
hashes of doc_id and text, so null and repeated doc_ids are rows like any other and get the result
of their text; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import BASE, gathered, hashed_words, mix64, slices, stored, texts

#: A word is a run of digits, letters and non-ASCII characters; texts are lower-cased in A-Z first.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Phrases whose occurrences are counted, and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License notices and their labels (fixed values: the notices' own wording).
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of a k-gram of a notice; a shorter template is one k-gram.
GRAM = 3
#: Diagonals of a template no further apart than this are merged.
DRIFT = 4
#: Share of a notice's k-grams that must vote for a candidate, and of its words that must stand in its span in order.
VOTES, VERIFIED = 0.4, 0.9
#: k-grams that a row carries to the join.
CHUNK = 4096
#: Bytes of text that a task cuts into k-grams together.
GATHER = 1 << 20
#: Candidate texts and spans together up to which they are broadcast to the texts; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def folded(text: bytes) -> bytes:
    """The text in lower case, with blanks for what isn't part of a word."""
    return text.translate(_FOLD)


def words_of(text: bytes) -> list[bytes]:
    return folded(text).split()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k words."""
    if len(h) < k:
        return h[:0]
    g = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        g = mix64(g * np.uint64(BASE) + h[i : len(h) - k + 1 + i])
    return g


class Templates:
    """Notices and phrases with their k-grams; a template's number is its place in all."""

    def __init__(self, phrases=PHRASES, notices=NOTICES) -> None:
        self.all = [(label, words_of(p.encode()), True) for p, label in phrases] + [(label, words_of(p.encode()), False) for label, p in notices]
        self.k = [len(w) if whole else min(GRAM, len(w)) for _, w, whole in self.all]
        self.lengths = sorted(set(self.k))

    def rows(self) -> list[tuple[int, int, int]]:
        """(k-gram hash, template, place) of every k-gram of every template."""
        hashes = [hashed_words([b" ".join(w)])[0] for _, w, _ in self.all]
        return [(g, t, i) for t, h in enumerate(hashes) for i, g in enumerate(gram_hashes(h, self.k[t]).view(np.int64).tolist())]

    def grams(self, t: int) -> int:
        return len(self.all[t][1]) - self.k[t] + 1


def _keys():
    """Two hashes that tell rows apart by doc_id and text."""
    return [F.xxhash64(F.lit(i), F.col("doc_id"), F.col("text")).alias(c) for i, c in enumerate(("key_a", "key_b"))]


def gram_rows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """key_a, key_b, place and gram of every rolling k-gram of every text."""

    def run(batches):
        for b in gathered(batches, 2, GATHER):
            a, z, at, grams = [], [], [], []
            h, counts = hashed_words([folded(t) for t in texts(b.column(2))])
            for x, y, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), np.split(h, np.cumsum(counts)[:-1]), strict=True):
                for k in lengths:
                    g = gram_hashes(h, k)
                    for i in range(0, len(g), CHUNK):
                        a.append(x)
                        z.append(y)
                        at.append(i)
                        grams.append(g[i : i + CHUNK])
            ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            yield pa.record_batch({"key_a": pa.array(a, pa.int64()), "key_b": pa.array(z, pa.int64()), "at": pa.array(at, pa.int64()), "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    chunks = docs.select(*_keys(), "text").mapInArrow(run, "key_a long, key_b long, at long, grams array<long>")
    return chunks.select("key_a", "key_b", "at", F.posexplode("grams").alias("nth", "gram")).select("key_a", "key_b", (F.col("at") + F.col("nth")).alias("place"), "gram")


def diagonals(docs: DataFrame, templates: Templates) -> DataFrame:
    """key_a, key_b, template, diagonal and votes (template places that hit it)."""
    spark = docs.sparkSession
    where = spark.createDataFrame(templates.rows(), "gram long, template int, tpos int")  # a few hundred rows, fixed
    hits = gram_rows(docs, templates.lengths).join(F.broadcast(where), "gram")
    masks = (
        hits.withColumn("diagonal", F.col("place") - F.col("tpos"))
        .groupBy("key_a", "key_b", "template", "diagonal", F.floor(F.col("tpos") / 64).alias("part"))
        .agg(F.bit_or(F.expr("shiftleft(1L, tpos % 64)")).alias("mask"))
    )
    return masks.groupBy("key_a", "key_b", "template", "diagonal").agg(F.sum(F.bit_count("mask")).alias("votes"))


def candidates(diagonal_votes: DataFrame, templates: Templates) -> DataFrame:
    """key_a, key_b and spans (template, first word, end) whose merged diagonals have votes enough."""
    spark = diagonal_votes.sparkSession
    sizes = spark.createDataFrame([(t, len(w), templates.grams(t)) for t, (_, w, whole) in enumerate(templates.all) if not whole], "template int, n_words int, n_grams int")
    by = W.partitionBy("key_a", "key_b", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    run = F.sum(F.when(gap > DRIFT, 1).otherwise(0)).over(by)
    merged = (
        diagonal_votes.join(F.broadcast(sizes), "template").withColumn("run", run)
        .groupBy("key_a", "key_b", "template", "run")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.first("n_words").alias("n_words"), F.first("n_grams").alias("n_grams"))
        .where(F.col("votes") >= VOTES * F.col("n_grams"))
    )
    span = F.struct("template", F.greatest(F.col("lo"), F.lit(0).cast("long")).alias("first"), (F.col("hi") + F.col("n_words")).alias("end"))
    return merged.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def common_words(template: list[bytes], span: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each template word."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in span:
        here = row & places.get(w, 0)
        row = ((row + here) | (row - here)) & full
    return len(template) - row.bit_count()


def verified(docs: DataFrame, found: DataFrame, templates: Templates) -> DataFrame:
    """key_a, key_b, label, first, end and share of every candidate span that holds its template."""
    found = stored(found, "license-candidates")
    n_texts, n_spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    few = n_texts + n_spans <= MAX_BROADCAST
    held = templates.all

    def run(batches):
        for b in slices(batches, 250):
            out: list[tuple] = []
            for x, y, t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = words_of(t)
                for s in spans:
                    label, template, _ = held[s["template"]]
                    share = common_words(template, words[s["first"] : s["end"]]) / len(template)
                    if share >= VERIFIED:
                        out.append((x, y, label, s["first"], min(s["end"], len(words)), share))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key_a", "key_b", "label", "first", "end", "share"])

    rows = docs.select(*_keys(), "text")
    joined = rows.join(F.broadcast(found) if few else found, ["key_a", "key_b"]).select("key_a", "key_b", "text", "spans")
    return joined.mapInArrow(run, "key_a long, key_b long, label string, first long, end long, share double")


def license_spans(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """key_a, key_b, label, first, end, share and phrase of every place of a phrase and every verified notice."""
    templates = templates or Templates()
    votes = stored(diagonals(docs, templates), "license-votes")
    phrases = docs.sparkSession.createDataFrame([(t, label, len(w)) for t, (label, w, whole) in enumerate(templates.all) if whole], "template int, label string, n_words int")
    places = votes.join(F.broadcast(phrases), "template").select(
        "key_a", "key_b", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_words")).alias("end"), F.lit(1.0).alias("share"), F.lit(True).alias("phrase")
    )
    return places.unionByName(verified(docs, candidates(votes, templates), templates).distinct().withColumn("phrase", F.lit(False)))


def license_scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = license_spans(docs, templates).groupBy("key_a", "key_b").agg(
        F.count(base("first")).alias("n_base"), F.min(base("first")).alias("first_word"), F.max(base("first")).alias("last_word"),
        joined(base("label")).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words, *_keys()).join(found, ["key_a", "key_b"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
