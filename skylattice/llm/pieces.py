"""SentencePiece encoding and decoding by suffix-array matching.

Encodes with the BPE pieces of a SentencePiece model file, to the ids that the library gives.
No piece has a space mark after another character, so a text is cut before every run of marks
(and around line feeds, which no piece holds) without changing its encoding. The distinct cuts
of a batch that a task doesn't remember are concatenated and indexed by a suffix array; every
piece is looked up in it by binary search, which gives the range of its occurrences. These edges
are sorted by position (into a bucket for each place and length) and relaxed from left to right, in
all cuts together: of the pieces that end at a place exactly one can follow the piece that ends
where it begins, namely the one with which it would not merge again, and that one is the last piece
of the encoding up to there. Characters without a piece become bytes. Decoding joins pieces and bytes and turns marks into spaces.

Nulls and other cases: a null or empty text has no ids and decodes to an empty text; texts that
hold the space mark itself come back with spaces and say so in round_trip; null or repeated
doc_ids are rows like any other; an empty table gives an empty result; other columns are passed
over, or kept as they are, but for those with the names of results, which are replaced. A model file
that is no BPE model, rewrites texts or has pieces beyond this method is refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import gathered, give_back, slices

#: The model file; a parameter, as tokenizers are never part of this repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space.
MARK = "▁"
CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Pair checks that a task remembers, as a power of two.
PAIR_BITS = 20
#: Longer cuts are relaxed one by one.
LONG_CUT = 400
#: Bytes of text that a task encodes together.
GATHER = 1 << 20
#: Characters of new cuts that are indexed at once, about.
LEARNED = 1 << 18
#: Cuts that a task remembers in a generation; it keeps two, and cuts met again move to the newer.
MAX_CUTS = 200_000
#: Marks by which a task knows that it met a cut in an earlier batch; only such cuts are remembered, as most never come again.
MET = 1 << 20
#: Bytes of ids that are decoded at once, about.
DECODED = 1 << 18


def _fields(buf: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            c = buf[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, buf[at : at + size]
            at += size


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id of a model file."""
    out = []
    for n, value in _fields(data):
        if n == 1:
            f = dict(_fields(value))
            out.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


def unsupported(data: bytes, every: list[tuple[str, float, int]]) -> str | None:
    """Why a model file can't be encoded with here, if it can't."""
    spec = dict(_fields(data))
    trainer, normalizer = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
    if trainer.get(3, 1) != 2:
        return "only BPE models are supported"
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        return "only models that leave texts as they are, but for marks in place of spaces and one before the text, are supported"
    if any(kind in (USER, UNUSED) for _, _, kind in every):
        return "user-defined and unused pieces are not supported"
    if any(kind == NORMAL and (MARK in p.lstrip(MARK) or "\n" in p) for p, _, kind in every):
        return "pieces with a space mark after another character, or with a line feed, are not supported"
    return None


class Vocabulary:
    """Pieces by rank: single characters first, then merged pieces from the best score on."""

    def __init__(self, data: bytes) -> None:
        every = read_pieces(data)
        if why := unsupported(data, every):
            raise ValueError(why)
        normal = [(len(p) > 1, -score, i) for i, (p, score, kind) in enumerate(every) if kind == NORMAL and p]
        order = [i for _, _, i in sorted(normal)]
        self.ids = order
        self.pieces = [every[i][0] for i in order]
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(every) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(every) if kind == UNKNOWN)
        plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in every]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_size = np.array([len(p) for p in plain])
        self.plain_at = np.cumsum(self.plain_size) - self.plain_size
        self.merges, self.split = {}, [(r, r) for r in range(len(self.pieces))]
        for r, p in enumerate(self.pieces):
            for k in range(1, len(p)):
                a, b = self.rank.get(p[:k]), self.rank.get(p[k:])
                if a is not None and b is not None:
                    self.merges[a, b] = r
        self.reached = [True] * len(self.pieces)
        for r, p in enumerate(self.pieces):
            if len(p) > 1:
                parts = self.merged(p, r)
                self.reached[r] = len(parts) == 2
                if self.reached[r]:
                    self.split[r] = (parts[0], parts[1])

    def merged(self, text: str, below: int) -> list[int]:
        """Ranks after all merges of rank less than below, best first, leftmost first."""
        parts = [self.rank.get(c, -1) for c in text]
        while len(parts) > 1:
            best = min(((self.merges.get((a, b), below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of piece a and then b is just these two: undo merges on both sides of the border."""
        limit = len(self.pieces) + 1
        merges, split = self.merges, self.split
        while True:
            if merges.get((a, b), limit) < limit:
                return False
            left, right = split[a][1], split[b][0]
            if a > b and left != a or right == b:
                if left == a:
                    return True
                limit, a = a, left
            else:
                limit, b = b + 1, right


def packed(codes: np.ndarray) -> np.ndarray:
    """Every three characters in one integer; blanks of 0 beyond the end."""
    c = np.concatenate([codes, np.zeros(2, np.int64)])
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text's suffixes in the order of their first depth characters (prefix doubling from three on)."""
    rank = np.unique(packed(codes), return_inverse=True)[1].astype(np.int64) + 1
    step = 3
    while step < depth:
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


class Encoder:
    """Encodes texts; remembers the cuts and pairs of pieces that it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.v = vocabulary
        self.depth = max(map(len, v.pieces))
        usable = [r for r, ok in enumerate(v.reached) if ok]
        self.ranks = np.array(usable)
        self.sizes = np.array([len(v.pieces[r]) for r in usable])
        self.codes = np.full((len(usable), self.depth), -1, np.int64)
        for k, r in enumerate(usable):
            self.codes[k, : self.sizes[k]] = [ord(c) for c in v.pieces[r]]
        head = np.maximum(self.codes[:, :3], 0)
        self.head = head[:, 0] << 42 | head[:, 1] << 21 | head[:, 2]
        self.head_end = self.head + np.array([0, 1 << 42, 1 << 21, 1])[np.minimum(self.sizes, 3)]
        self.forget()
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << PAIR_BITS, bool)

    def forget(self) -> None:
        """Drop what was remembered of texts: a worker outlives its tasks, and the next one may belong to another job."""
        self.known: list[dict[str, bytes]] = [{}, {}]  # ids of cuts as they stand, and of words after a mark
        self.before: list[dict[str, bytes]] = [{}, {}]  # the older generation of each
        self.met = [bytearray(), bytearray()]

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that begin with each piece begin and end in the suffix array."""
        heads = packed(codes)[order]
        first, last = np.searchsorted(heads, self.head), np.searchsorted(heads, self.head_end)
        more = np.flatnonzero((self.sizes > 3) & (first < last))
        rest = np.concatenate([codes, np.zeros(self.depth, np.int64)])
        want_all, beyond = self.codes[more, 3:], np.arange(3, self.depth)
        out = []
        for upper in (False, True):
            lo, hi = first[more], last[more]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) >> 1
                have, want = rest[order[mid][:, None] + beyond], want_all[live]
                differs = (have != want) & (want >= 0)
                at = differs.argmax(axis=1)
                row = np.arange(len(live))
                less = np.where(differs[row, at], have[row, at] < want[row, at], upper)
                lo[live] = np.where(less, mid + 1, lo[live])
                hi[live] = np.where(less, hi[live], mid)
            out.append(lo)
        first[more], last[more] = out
        return first, last

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece a may stand before its b."""
        key = a << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            judged = np.array([self.v.follows(k >> 20, k & 0xFFFFF) for k in new.tolist()])
            ok[miss] = judged[back]
            self.pair_keys[slot[miss]], self.pair_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def learn(self, cuts: list[str]) -> list[bytes]:
        """The ids of cuts."""
        codes = np.frombuffer("\uffff".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        order = suffix_array(codes, self.depth)
        lo, hi = self.ranges(codes, order)
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        start = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + lo[piece]]
        edges = np.full((len(codes) + 1, self.depth + 1), -1, np.int32)  # by end and length
        edges[start + self.sizes[piece], self.sizes[piece]] = self.ranks[piece]
        size = np.array([len(c) for c in cuts])
        base = np.cumsum(size + 1) - size - 1
        last, begin = np.full(len(codes) + 1, -1, np.int64), np.arange(-1, len(codes))
        self._relax(edges, base[size <= LONG_CUT], size[size <= LONG_CUT], last, begin)
        for k in np.flatnonzero(size > LONG_CUT):
            self._relax_long(edges, int(base[k]), int(size[k]), last, begin)
        del codes, order, lo, hi, count, piece, start, edges
        last, begin, ids, out = last.tolist(), begin.tolist(), self.v.ids, []
        for cut, at, n in zip(cuts, base.tolist(), size.tolist(), strict=True):
            found, e = [], at + n
            while e > at:
                if last[e] >= 0:
                    found.append(ids[last[e]])
                else:
                    found += [self.v.bytes.get(c, self.v.unknown) for c in reversed(cut[e - 1 - at].encode("utf-8", "replace"))]
                e = begin[e]
            out.append(array("i", found[::-1]).tobytes())
        return out

    def _relax(self, edges, base, size, last, begin) -> None:
        """Find the last piece up to every place of every cut: place by place, the longest piece first, all cuts together."""
        for e in range(1, int(size.max(initial=0)) + 1):
            at = base[size >= e] + e
            left = np.arange(len(at))
            for n in range(min(e, self.depth), 0, -1):
                rank = edges[at[left], n]
                there = np.flatnonzero(rank >= 0)
                if not len(there):
                    continue
                rank, place = rank[there].astype(np.int64), at[left[there]]
                before = last[place - n]
                ok = before < 0
                check = np.flatnonzero(~ok)
                if len(check):
                    ok[check] = self.follow(before[check], rank[check])
                last[place[ok]], begin[place[ok]] = rank[ok], place[ok] - n
                left = np.delete(left, there[ok])
                if not len(left):
                    break

    def _relax_long(self, edges, base: int, size: int, last, begin) -> None:
        """The same for one cut."""
        pairs: dict[tuple[int, int], bool] = {}
        for at in range(base + 1, base + size + 1):
            row = edges[at].tolist()
            for n in range(min(at - base, self.depth), 0, -1):
                if row[n] >= 0:
                    pair = int(last[at - n]), row[n]
                    ok = pair[0] < 0 or pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = self.v.follows(*pair)
                    if ok:
                        last[at], begin[at] = row[n], at - n
                        break

    @staticmethod
    def cuts(text: str) -> list[tuple[int, list[str]]]:
        """Runs of (0, cuts as they stand) and (1, words that each follow a mark)."""
        if not text:
            return []
        if MARK in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return [(0, CUT.findall(MARK + text.replace(" ", MARK)))]
        head, *lines = text.split("\n")
        out = [(1, head.split(" ")) if head else (0, [MARK])]
        for line in lines:
            first, _, rest = line.partition(" ")
            out.append((0, ["\n", first] if first else ["\n"]))
            if rest:
                out.append((1, rest.split(" ")))
        return out

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        texts, found = [self.cuts(t) for t in batch], []
        for which in (0, 1):
            if len(self.known[which]) > MAX_CUTS:
                self.before[which], self.known[which], self.met[which] = self.known[which], {}, bytearray()
            self.met[which] = met = self.met[which] or bytearray(MET)
            known, before, here, new = self.known[which], self.before[which], {}, []
            for c in dict.fromkeys(chain.from_iterable(cs for t in texts for w, cs in t if w == which)):
                if c in known:
                    here[c] = known[c]
                elif c in before:
                    here[c] = known[c] = before[c]
                else:
                    new.append(c)
            at = size = 0
            for k, c in enumerate(new):
                size += len(c) + 2
                if size >= LEARNED or k + 1 == len(new):
                    part = new[at : k + 1]
                    here.update(zip(part, self.learn([MARK + c for c in part] if which else part), strict=True))
                    at, size = k + 1, 0
            for c in new:
                mark = hash(c) % MET
                if met[mark]:
                    known[c] = here[c]
                met[mark] = 1
            found.append(here)
        plain, marked = (k.__getitem__ for k in found)
        return [b"".join([b"".join(map(marked if w else plain, cs)) for w, cs in t]) for t in texts]


def decode_batch(batch: list[bytes], v: Vocabulary) -> list[bytes]:
    """The UTF-8 texts of ids."""
    ends, out = np.cumsum([0] + [len(b) for b in batch]), []
    while len(out) < len(batch):
        stop = max(len(out) + 1, int(np.searchsorted(ends, ends[len(out)] + DECODED, "right")) - 1)
        out += _decoded(batch[len(out) : stop], v)
    return out


def _decoded(batch: list[bytes], v: Vocabulary) -> list[bytes]:
    ids = np.frombuffer(b"".join(batch), "<i4")
    size = v.plain_size[ids]
    ends = np.cumsum(size)
    flat = v.plain[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.plain_at[ids] - ends + size, size)].tobytes()
    ends = np.concatenate([[0], ends])[np.cumsum([0] + [len(b) // 4 for b in batch])].tolist()
    return [flat[a + (flat[a : a + 1] == b" ") : z] if z > a else b"" for a, z in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(held) -> Encoder:
    """The encoder of a model file's bytes; a worker keeps the one that it used last."""
    if held.value not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[held.value] = Encoder(Vocabulary(held.value))
    return _ENCODERS[held.value]


def _forgetting(batches):
    """The batches of a task; what its encoder remembers of them goes with the last one."""
    try:
        yield from batches
    finally:
        for e in _ENCODERS.values():
            e.forget()
        give_back()


def vocabulary(docs: DataFrame, model: str):
    """The model file, broadcast: half a megabyte from which each worker builds its encoder."""
    with open(model, "rb") as f:
        data = f.read()
    if why := unsupported(data, read_pieces(data)):
        raise ValueError(f"{model}: {why}")
    return docs.sparkSession.sparkContext.broadcast(data)


def encoded(docs: DataFrame, model: str = MODEL, checked: bool = False) -> DataFrame:
    """The rows with ids, and without their text; checked adds n_pieces and round_trip (whether decoding gives the text).

    Columns of the input that have these names are replaced."""
    held = vocabulary(docs, model)
    more = ["n_pieces", "round_trip"] if checked else []
    rest = [c for c in docs.columns if c not in ("text", "ids", *more)]

    def run(batches):
        for b in _forgetting(gathered(batches, 0, GATHER)):
            batch = [t or "" for t in b.column(0).to_pylist()]
            ids = _encoder(held).encode_batch(batch)
            flat = np.frombuffer(b"".join(ids), np.int32)
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            extra = []
            if checked:
                same = [x == t.encode() for x, t in zip(decode_batch(ids, _encoder(held).v), batch, strict=True)]
                extra = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *extra, *b.columns[1:]], ["ids", *[f"x{i}" for i in range(len(extra))], *[f"c{i}" for i in range(len(rest))]])

    types = ", ".join(["ids array<int>", *(["x0 long", "x1 boolean"] if checked else []), *[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]])
    return docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).mapInArrow(run, types).toDF("ids", *more, *rest)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids, and without the ids; an input column text is replaced."""
    held = vocabulary(rows, model)
    rest = [c for c in rows.columns if c not in ("ids", "text")]

    def run(batches):
        for b in slices(batches, 1000):
            ids = [array("i", x or []).tobytes() for x in b.column(0).to_pylist()]
            new = [x.decode("utf-8", "replace") for x in decode_batch(ids, _encoder(held).v)]
            yield pa.record_batch([pa.array(new, pa.string()), *b.columns[1:]], ["text", *[f"c{i}" for i in range(len(rest))]])

    types = ", ".join(["text string", *[f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]])
    return rows.select("ids", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).mapInArrow(run, types).toDF("text", *rest)


def encoding_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip of every row."""
    held = vocabulary(docs, model)

    def run(batches):
        for b in _forgetting(gathered(batches, 1, GATHER)):
            batch = [t or "" for t in b.column(1).to_pylist()]
            size, n, sha, same = [], [], [], []
            coded = _encoder(held).encode_batch(batch)
            for t, ids, back in zip(batch, coded, decode_batch(coded, _encoder(held).v), strict=True):
                raw = t.encode()
                size.append(len(raw))
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                same.append(back == raw)
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(size, pa.int64()), "n_pieces": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(same, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean")
