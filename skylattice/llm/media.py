"""Media columns: baseline JPEG files, decoded to DC-only luminance thumbnails in numpy.

jpeg_features() reads a binary column of baseline JPEG files: markers are parsed, scans are
Huffman-decoded (all restart intervals of a batch of files step by step together), and the DC
coefficients of the first component give a thumbnail with a pixel for each block of 8 x 8. The
frame's dimensions and hashes of the thumbnail are kept.

stored_texts() puts texts into such files without loss. The unit of the format is the quantised
coefficient: every 64 bytes of a text become the coefficients of a block, as signed bytes in zigzag
order, and a comment segment holds how many bytes are payload. The files are read back through
the same decoder.

Nulls and other cases: a null or empty text is 64 zero bytes; null or repeated doc_ids are rows
like any other; bytes that are no baseline JPEG file, and nulls, give null features and say why
in error; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import gathered, texts

#: Coefficients of a block; samples along the side of a block.
UNIT, SIDE = 64, 8
#: Restart intervals that are decoded, and blocks that are coded, at once.
LANES, CODED = 1 << 14, 1 << 11
#: Payload bytes that a task gathers before it codes them.
GATHER = 2 << 20
#: Blocks in a row of a frame at most; a side of a frame has at most 65,535 samples.
MAX_ROW = 8191
#: The quantiser of DC coefficients (a thumbnail's pixel is then the coefficient + 128) and of the others.
DC_STEP, AC_STEP = 8, 1
#: Side of the reduced thumbnail that the average hash compares.
HASH_SIDE = 8


class NotJpeg(ValueError):
    """The bytes are no baseline JPEG file, or a damaged one."""


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a DHT table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _own_table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(lengths[s] == n for s in order) for n in range(1, 17)], order


#: Tables of the files written here: short codes for what text bytes give (sizes 6 and 7 without a run), 12 bits for runs.
DC_TABLE = _own_table({7: 1, 6: 2} | {s: 4 for s in (0, 5, 8)} | {s: 7 for s in (1, 2, 3)} | {4: 5})
AC_TABLE = _own_table({run << 4 | size: 12 for run in range(16) for size in range(1, 9)} | {0xF0: 12, 0x07: 1, 0x06: 2, 0x00: 5, 0x05: 5, 0x08: 5} | {s: 7 for s in (1, 2, 3, 4)})


def _code_arrays(table) -> tuple[np.ndarray, np.ndarray]:
    codes, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (code, n) in _canonical(*table).items():
        codes[s], bits[s] = code, n
    return codes, bits


_DC_CODES, _AC_CODES = _code_arrays(DC_TABLE), _code_arrays(AC_TABLE)
#: Bits of the magnitude of every signed byte.
_SIZES = np.array([abs(b - 256 if b > 127 else b).bit_length() for b in range(256)])


def _byte_arrays(codes) -> tuple[np.ndarray, np.ndarray]:
    """(code and magnitude bits, their number) of every signed byte without a run."""
    value, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for b in range(256):
        x = b - 256 if b > 127 else b
        size = abs(x).bit_length()
        value[b], bits[b] = int(codes[0][size]) << size | (x if x >= 0 else x + (1 << size) - 1), codes[1][size] + size
    return value, bits


_DC_BYTES, _AC_BYTES = _byte_arrays(_DC_CODES), _byte_arrays(_AC_CODES)
_AC_BYTES[1][0] = 0  # a zero is coded by what follows it


# ---------------------------------------------------------------- writing


def _with_runs(blocks: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Correct the codes of blocks that hold zeros: runs, 16 zeros in a row, end of block."""
    there = blocks != 0
    there[:, 0] = True  # the DC coefficient is always coded
    column = np.arange(UNIT)
    seen = np.maximum.accumulate(np.where(there, column, 0), axis=1)
    row, at = np.nonzero(there[:, 1:] & ~there[:, :-1])  # after at least one zero
    run = at - seen[row, at]
    at += 1
    size = _SIZES[blocks[row, at]]
    symbol = run % 16 << 4 | size
    extra = value[row, at] & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))
    value[row, at], bits[row, at] = _AC_CODES[0][symbol] << size.astype(np.uint64) | extra, _AC_CODES[1][symbol] + size
    gap = column - seen
    zeros16 = (gap % 16 == 0) & (gap > 0) & (column < seen[:, -1:])
    value[:, :UNIT][zeros16], bits[:, :UNIT][zeros16] = _AC_CODES[0][0xF0], _AC_CODES[1][0xF0]
    ends = seen[:, -1] < UNIT - 1
    value[ends, UNIT], bits[ends, UNIT] = _AC_CODES[0][0], _AC_CODES[1][0]


def _entropy(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman-coded bytes of every block (one restart interval each, not yet stuffed) and how many each has."""
    m = len(blocks)
    value, bits = np.zeros((m, UNIT + 2), np.uint64), np.zeros((m, UNIT + 2), np.int64)
    value[:, :UNIT], bits[:, :UNIT] = _AC_BYTES[0].take(blocks), _AC_BYTES[1].take(blocks)
    value[:, 0], bits[:, 0] = _DC_BYTES[0][blocks[:, 0]], _DC_BYTES[1][blocks[:, 0]]
    gaps = np.flatnonzero((blocks[:, 1:] == 0).any(axis=1))
    if len(gaps):
        v, b = value[gaps], bits[gaps]
        _with_runs(blocks[gaps], v, b)
        value[gaps], bits[gaps] = v, b
    offset = np.cumsum(bits, axis=1)
    pad = -offset[:, -1] % 8
    value[:, -1], bits[:, -1] = (1 << pad) - 1, pad
    length = (offset[:, -1] + pad) // 8
    base = np.cumsum(length) - length
    at = offset - bits
    at[:, -1] = offset[:, -1]  # the padding
    at += 8 * base[:, None]
    at, bits = at.ravel(), bits.ravel()
    wide = value.ravel() << (64 - (at & 31) - bits).astype(np.uint64)
    wide[bits == 0] = 0
    at >>= 5
    n = int(base[-1] + length[-1])
    words = np.bincount(at, (wide >> np.uint64(32)).astype(float), n // 4 + 3)
    words[1:] += np.bincount(at, (wide & np.uint64(0xFFFFFFFF)).astype(float), n // 4 + 3)[:-1]
    return words.astype(np.uint64).astype(">u4").view(np.uint8)[:n], length


def _scans(blocks: np.ndarray, per_file: np.ndarray) -> list[bytes]:
    """The entropy-coded data of every file: stuffed, with a restart marker after each block but the last."""
    chunks, lengths = zip(*(_entropy(blocks[i : i + CODED]) for i in range(0, len(blocks), CODED)), strict=True)
    data, length = np.concatenate(chunks), np.concatenate(lengths)
    stuffed = data == 0xFF
    end = np.cumsum(length)
    last = np.cumsum(per_file) - 1
    nth = np.arange(len(length)) - np.repeat(last + 1 - per_file, per_file)
    marked = np.ones(len(length), np.int64)
    marked[last] = 0
    markers = np.cumsum(marked) - marked  # before the block
    before = np.concatenate([[0], np.cumsum(stuffed)])
    at = np.arange(len(data)) + before[:-1] + 2 * np.repeat(markers, length)
    out = np.zeros(len(data) + before[-1] + 2 * int(marked.sum()), np.uint8)
    out[at] = data
    stop = end + before[end] + 2 * markers  # where the block's bytes end
    has = marked.astype(bool)
    out[stop[has]] = 0xFF
    out[stop[has] + 1] = 0xD0 + nth[has] % 8
    ends = stop[last]
    return [out[a:z].tobytes() for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, bytes([0, DC_STEP] + [AC_STEP] * (UNIT - 1)))
    + _segment(0xC4, bytes([0x00, *DC_TABLE[0], *DC_TABLE[1]]))
    + _segment(0xC4, bytes([0x10, *AC_TABLE[0], *AC_TABLE[1]]))
    + _segment(0xDD, (1).to_bytes(2, "big"))
)
_START_OF_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, UNIT - 1, 0]))


def frame_size(blocks: int) -> tuple[int, int]:
    """Blocks across and down of the frame for so many blocks: nearly square."""
    wide = min(MAX_ROW, int(np.ceil(np.sqrt(blocks))))
    return wide, -(-blocks // wide)


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A baseline greyscale file for every payload; each is a positive multiple of 64 bytes."""
    if not payloads:
        return []
    sizes = [frame_size(len(p) // UNIT) for p in payloads]
    filled = b"".join(p.ljust(w * h * UNIT, b"\0") for p, (w, h) in zip(payloads, sizes, strict=True))
    scans = _scans(np.frombuffer(filled, np.uint8).reshape(-1, UNIT), np.array([w * h for w, h in sizes]))
    out = []
    for p, (w, h), scan in zip(payloads, sizes, scans, strict=True):
        frame = bytes([8]) + (h * SIDE).to_bytes(2, "big") + (w * SIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
        out.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES + _segment(0xC0, frame) + _START_OF_SCAN + scan + b"\xff\xd9")
    return out


# ---------------------------------------------------------------- reading


class Parsed:
    """The markers of a file: width, height, components (id -> h, v, quantiser), steps, comments and scans."""

    def __init__(self, data: bytes) -> None:
        self.width = self.height = 0
        self.components: dict[int, tuple[int, int, int]] = {}
        self.steps: dict[int, list[int]] = {}
        self.comments: list[bytes] = []
        self.scans: list[dict] = []
        tables: dict[int, tuple[bytes, bytes]] = {}
        interval, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise NotJpeg("no start of image")
        while True:
            while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1  # fill bytes
            if at + 4 > len(data) or data[at] != 0xFF:
                if self.scans and data[at : at + 2] == b"\xff\xd9":
                    break
                raise NotJpeg("marker expected")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise NotJpeg("short segment")
            at += 2 + size
            try:
                if marker == 0xDB:
                    self._quantisers(body)
                elif marker == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
                elif marker == 0xDD:
                    interval = int.from_bytes(body[:2], "big")
                elif marker in (0xC0, 0xC1):
                    if body[0] != 8:
                        raise NotJpeg("8-bit samples expected")
                    self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                    for k in range(body[5]):
                        c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                        self.components[c] = (hv >> 4, hv & 15, q)
                elif marker in range(0xC2, 0xD0) and marker != 0xC8 and marker != 0xCC:
                    raise NotJpeg("no baseline frame")
                elif marker == 0xFE:
                    self.comments.append(body)
                elif marker == 0xDA:
                    if not self.width or not self.height:
                        raise NotJpeg("no frame before the scan")
                    parts = [(body[1 + 2 * k], tables[body[2 + 2 * k] >> 4], tables[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])]
                    stop = self._scan_end(data, at)
                    self.scans.append({"parts": parts, "at": at, "stop": stop, "interval": interval})
                    at = stop
            except (IndexError, KeyError, ValueError) as e:
                raise NotJpeg(f"damaged segment {marker:#x}: {e}") from e
        if not self.scans:
            raise NotJpeg("no scan")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = UNIT * (1 + wide)
            self.steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(int).tolist()
            body = body[1 + n :]

    @staticmethod
    def _scan_end(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise NotJpeg("scan without an end")
            if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                return at
            # a long scan is mostly markers and stuffing: skip them at C speed
            piece = np.frombuffer(data, np.uint8, min(len(data) - at, 1 << 20), at)
            mark = np.flatnonzero((piece[:-1] == 0xFF) & (piece[1:] != 0) & ~((piece[1:] >= 0xD0) & (piece[1:] <= 0xD7)))
            if len(mark):
                return at + int(mark[0])
            at += max(1, len(piece) - 1)

    def grid(self, c: int) -> tuple[int, int]:
        """Blocks across and down of a component, as a scan of its own has them."""
        h, v, _ = self.components[c]
        hm, vm = (max(x[k] for x in self.components.values()) for k in (0, 1))
        return -(-self.width * h // (hm * SIDE)), -(-self.height * v // (vm * SIDE))


#: Bits of a table entry for the bits used and for the step in coefficients; above them stands the value.
USED, STEP = 5, 8
#: The step of an end of block.
END = 128


class _Tables:
    """Huffman look-up tables by 16 bits: value, coefficients to step on and bits used, or 0 bits where 16 are too few."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []

    def number(self, table: tuple[bytes, bytes], dc: bool) -> int:
        if (table, dc) not in self.known:
            row, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            for s, (code, n) in _canonical(list(table[0]), list(table[1])).items():
                at = np.arange(code << (16 - n), (code + 1) << (16 - n))
                symbols[at] = n << 8 | s
                size = s & 15
                if n + size <= 16:
                    row[at] = _entry((at >> (16 - n - size)) & ((1 << size) - 1), size, s, dc) | n + size
            self.known[table, dc] = len(self.rows)
            self.rows.append(row)
            self.symbols.append(symbols)
        return self.known[table, dc]


def _entry(extra, size, symbol, dc):
    """Value and step of a symbol with these magnitude bits, without the bits used."""
    value = np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1) * (size > 0)
    step = np.where(dc, 1, np.where(symbol == 0, END, (symbol >> 4) + 1))
    return value << (USED + STEP) | step << USED


def _units(scan: dict, parsed: Parsed) -> tuple[list[int], int]:
    """Which part each block of an MCU belongs to, and how many MCUs the scan has."""
    parts = scan["parts"]
    if len(parts) == 1:
        w, h = parsed.grid(parts[0][0])
        return [0], w * h
    hm, vm = (max(x[k] for x in parsed.components.values()) for k in (0, 1))
    pattern = [k for k, (c, _, _) in enumerate(parts) for _ in range(parsed.components[c][0] * parsed.components[c][1])]
    return pattern, -(-parsed.width // (SIDE * hm)) * -(-parsed.height // (SIDE * vm))


#: Lanes from which on decoding them together is faster than one after another.
FEW = 24


def _finish(data: bytes, lookup: list[int], symbols: np.ndarray, out: np.ndarray, bit: int, k: int, left: int, limit: int, base: int, unit: int, pattern: int, dc: list[int], ac: list[int]) -> None:
    """Decode what is left of one lane, symbol by symbol: files without restart markers are one lane each."""
    table = (dc if k == 0 else ac)[unit] << 16
    number = int.from_bytes
    while left:
        at, shift = bit >> 3, 24 - (bit & 7)
        near = number(data[at : at + 5], "big")
        code = table + (near >> shift & 0xFFFF)
        entry = lookup[code]
        used = entry & 31
        if not used:
            s = int(symbols[code])
            n, size = s >> 8, s & 15
            if n == 0:
                raise NotJpeg("unknown code")
            extra = near >> (shift + 16 - n - size) & ((1 << size) - 1)
            entry, used = int(_entry(np.int64(extra), np.int64(size), np.int64(s & 255), k == 0)), n + size
        bit += used
        if k == 0:
            table = ac[unit] << 16
        k += entry >> USED & 255
        value = entry >> (USED + STEP)
        if bit > limit or UNIT < k < END:
            raise NotJpeg("damaged scan")
        if k >= UNIT:
            if value:
                out[base + UNIT - 1] = value
            left, k, base, unit = left - 1, 0, base + UNIT, (unit + 1) % pattern
            table = dc[unit] << 16
        elif value:
            out[base + k - 1] = value


def _decode(windows: np.ndarray, data: np.ndarray, tables: _Tables, begin, stop, n_blocks, pattern, dc_of, ac_of) -> np.ndarray:
    """Coefficients (blocks x 64, DC as coded), all lanes at once while there are many, then those left one by one; a lane is a restart interval.

    pattern: how many blocks an MCU of the lane has; dc_of, ac_of: tables by lane and block of its MCU."""
    lookup, symbols = np.concatenate(tables.rows), np.concatenate(tables.symbols)
    first = np.cumsum(n_blocks) - n_blocks
    out = np.zeros(int(n_blocks.sum()) * UNIT, np.int16)
    bit, k = begin * 8, np.zeros(len(begin), np.int64)
    lane, left, limit, base, unit = np.arange(len(begin)), n_blocks.copy(), stop * 8, first * UNIT, np.zeros(len(begin), np.int64)
    dc, ac = dc_of[:, 0] << 16, ac_of[:, 0] << 16
    any_dc = True
    while len(lane) >= FEW:
        table = np.where(k == 0, dc, ac) if any_dc else ac
        near, shift = windows.take(bit >> 3), 24 - (bit & 7)
        code = (near >> shift) & 0xFFFF
        code += table
        entry = lookup.take(code)
        used = entry & 31
        long = np.flatnonzero(used == 0)
        if len(long):
            s = symbols[code[long]]
            n, size = s >> 8, s & 15
            if (n == 0).any():
                raise NotJpeg("unknown code")
            extra = (near[long] >> (shift[long] + 16 - n - size)) & ((1 << size) - 1)
            entry[long], used[long] = _entry(extra, size, s & 255, k[long] == 0), n + size
        bit += used
        k += entry >> USED & 255
        if ((k > UNIT) & (k < END)).any() or (bit > limit).any():
            raise NotJpeg("damaged scan")
        np.minimum(k, UNIT, out=k)
        out[base + k - 1] = entry >> (USED + STEP)
        done = k == UNIT
        any_dc = bool(done.any())
        if any_dc:
            left -= done
            k[done] = 0
            base += done * UNIT
            if pattern.max() > 1:
                unit = (unit + done) % pattern
                dc, ac = dc_of[lane, unit] << 16, ac_of[lane, unit] << 16
            go = left > 0
            if not go.all():
                lane, bit, k, left, limit, base, unit, pattern, dc, ac = (x[go] for x in (lane, bit, k, left, limit, base, unit, pattern, dc, ac))
                any_dc = bool((k == 0).any())
    if len(lane):
        raw, quick = data.tobytes(), lookup.tolist()
        for i, who in enumerate(lane.tolist()):
            state = (int(x[i]) for x in (bit, k, left, limit, base, unit, pattern))
            _finish(raw, quick, symbols, out, *state, dc_of[who].tolist(), ac_of[who].tolist())
    return out.reshape(-1, UNIT)


def read_jpegs(files: list[bytes]) -> list[dict | str]:
    """For every file: width, height, comments, steps and blocks (component -> its blocks across and down, coefficients), or what is wrong."""
    parsed: list[Parsed | str] = []
    for f in files:
        try:
            parsed.append(Parsed(f))
        except NotJpeg as e:
            parsed.append(str(e))
    good = [i for i, p in enumerate(parsed) if not isinstance(p, str)]
    try:
        found = _read(files, parsed, good)
    except NotJpeg:  # which file is damaged shows when each is read alone
        found = {}
        for i in good:
            try:
                found |= _read(files, parsed, [i])
            except NotJpeg as e:
                found[i] = str(e)
    return [found.get(i, p) for i, p in enumerate(parsed)]


def _read(files: list[bytes], parsed: list, which: list[int]) -> dict[int, dict]:
    tables = _Tables()
    lanes, owner, bytes_of = [], [], []
    at = 0
    for i in which:
        p = parsed[i]
        for scan in p.scans:
            pattern, mcus = _units(scan, p)
            each = scan["interval"] or mcus
            raw = np.frombuffer(files[i], np.uint8, scan["stop"] - scan["at"], scan["at"])
            ff = np.flatnonzero(raw == 0xFF)
            following = raw[np.minimum(ff + 1, len(raw) - 1)]
            restart = ff[(following >= 0xD0) & (following <= 0xD7)]
            drop = np.zeros(len(raw), bool)
            drop[ff[following == 0] + 1] = True
            drop[restart] = drop[restart + 1] = True
            clean = raw[~drop]
            gone = np.cumsum(drop)
            starts = np.concatenate([[0], restart + 2 - gone[restart + 1]]) if len(restart) else np.array([0])
            stops = np.append(starts[1:], len(clean))
            if len(starts) != -(-mcus // each):
                raise NotJpeg("restart intervals are missing")
            n = np.full(len(starts), each)
            n[-1] = mcus - each * (len(starts) - 1)
            number = [(tables.number(d, True), tables.number(a, False)) for _, d, a in scan["parts"]]
            lanes.append((starts + at, stops + at, n * len(pattern), len(pattern), [number[k][0] for k in pattern], [number[k][1] for k in pattern]))
            owner.append((i, scan, pattern, mcus))
            bytes_of.append(clean)
            at += len(clean)
    out = {i: {"width": parsed[i].width, "height": parsed[i].height, "comments": parsed[i].comments, "steps": parsed[i].steps, "components": parsed[i].components, "blocks": {}} for i in which}
    if not lanes:
        return out
    data = np.concatenate([*bytes_of, np.zeros(8, np.uint8)])
    wide = data.astype(np.int64)
    windows = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]
    begin, stop, n_blocks = (np.concatenate([x[k] for x in lanes]) for k in range(3))
    length = np.repeat([x[3] for x in lanes], [len(x[0]) for x in lanes])
    widest = int(length.max())
    dc_of, ac_of = (np.repeat(np.array([x[k] + [0] * (widest - len(x[k])) for x in lanes]), [len(x[0]) for x in lanes], axis=0) for k in (4, 5))
    coded = []
    for a in range(0, len(begin), LANES):
        z = a + LANES
        coded.append(_decode(windows, data, tables, begin[a:z], stop[a:z], n_blocks[a:z], length[a:z], dc_of[a:z], ac_of[a:z]))
    coefficients, first = np.concatenate(coded), 0
    for i, scan, pattern, mcus in owner:
        n = mcus * len(pattern)
        _place(out[i], parsed[i], scan, pattern, mcus, coefficients[first : first + n])
        first += n
    return out


def _place(out: dict, parsed: Parsed, scan: dict, pattern: list[int], mcus: int, coded: np.ndarray) -> None:
    """Undo the DC prediction of each restart interval and put the blocks of a scan into their components' grids."""
    each = scan["interval"] or mcus
    coded = coded.reshape(mcus, len(pattern), UNIT)
    for part, (c, _, _) in enumerate(scan["parts"]):
        blocks = coded[:, [k for k, x in enumerate(pattern) if x == part]] if len(pattern) > 1 else coded
        if each > 1 or blocks.shape[1] > 1:
            dc = blocks[:, :, 0].astype(np.int64)
            run = np.cumsum(dc.ravel()).reshape(dc.shape)
            start = np.arange(mcus) // each * each
            run -= (run[start, 0] - dc[start, 0])[:, None]
            blocks[:, :, 0] = run
        wide, high = parsed.grid(c)
        h, v, _ = parsed.components[c]
        if len(pattern) > 1:  # MCUs of h x v blocks
            across = -(-parsed.width // (SIDE * max(x[0] for x in parsed.components.values())))
            blocks = blocks.reshape(-1, across, v, h, UNIT).transpose(0, 2, 1, 3, 4)
            blocks = blocks.reshape(-1, across * h, UNIT)[:high, :wide]
        out["blocks"][c] = (wide, high, blocks.reshape(-1, UNIT))


def thumbnail(image: dict) -> np.ndarray:
    """A pixel for every block of the first component, from its DC coefficient."""
    c = next(iter(image["components"]))
    if c not in image["blocks"]:
        raise NotJpeg("no scan of the first component")
    wide, high, blocks = image["blocks"][c]
    step = image["steps"].get(image["components"][c][2], [1])[0]
    return np.clip((blocks[:, 0].astype(np.int32) * step + 4) // 8 + 128, 0, 255).astype(np.uint8).reshape(high, wide)


def average_hash(thumb: np.ndarray, side: int = HASH_SIDE) -> str:
    """Which of side x side areas are brighter than their mean, as hexadecimal digits; small thumbnails repeat pixels."""
    h, w = thumb.shape
    rows, cols = (np.arange(side) * n // side for n in (h, w))
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    y1, x1 = np.maximum(rows + 1, np.arange(1, side + 1) * h // side), np.maximum(cols + 1, np.arange(1, side + 1) * w // side)
    area = (y1 - rows)[:, None] * (x1 - cols)[None]
    mean = (sums[np.ix_(y1, x1)] - sums[np.ix_(rows, x1)] - sums[np.ix_(y1, cols)] + sums[np.ix_(rows, cols)]) / area
    return np.packbits(mean > mean.mean()).tobytes().hex()


def feature(image: dict) -> str:
    """Dimensions, a hash of the thumbnail and its average hash."""
    thumb = thumbnail(image)
    return f"{image['width']}x{image['height']} {hashlib.sha256(thumb.tobytes()).hexdigest()[:16]} {average_hash(thumb)}"


def payload(image: dict) -> bytes:
    """The payload of a file of write_jpegs()."""
    size = next((int(c[8:]) for c in image["comments"] if c.startswith(b"payload ")), None)
    if size is None:
        raise NotJpeg("no payload")
    return next(iter(image["blocks"].values()))[2].astype(np.int8).tobytes()[:size]


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def jpeg_features(images: DataFrame, column: str = "image", key: str = "image_id") -> DataFrame:
    """key, width, height, feature and error of every file in a binary column."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        for b in gathered(batches, 1, GATHER):
            files = b.column(1).to_pylist()
            got = iter(read_jpegs([f for f in files if f is not None]))
            w, h, what, wrong = [], [], [], []
            for f in files:
                image = "no bytes" if f is None else next(got)
                seen = None
                if not isinstance(image, str):
                    try:
                        seen = feature(image)
                    except NotJpeg as e:
                        image = str(e)
                bad = isinstance(image, str)
                w.append(None if bad else image["width"])
                h.append(None if bad else image["height"])
                what.append(seen)
                wrong.append(image if bad else None)
            yield pa.record_batch({key: b.column(0), "width": pa.array(w, pa.int32()), "height": pa.array(h, pa.int32()), "feature": pa.array(what, pa.string()), "error": pa.array(wrong, pa.string())})

    return images.select(key, column).mapInArrow(run, f"`{key}` {kind}, width int, height int, feature string, error string")


def _stored(docs: DataFrame, with_media: bool) -> DataFrame:
    def run(batches):
        for b in gathered(batches, 1, GATHER):
            raw = texts(b.column(1))
            files = write_jpegs([padded(t) for t in raw])
            cols: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for f, image in zip(files, read_jpegs(files), strict=True):
                if isinstance(image, str):
                    raise NotJpeg(image)
                p = payload(image)
                for c, x in zip(cols, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature(image)), strict=True):
                    cols[c].append(x)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                {"doc_id": b.column(0), "n_bytes": pa.array([len(t) for t in raw], pa.int64())}
                | {c: pa.array(x, t) for (c, x), t in zip(cols.items(), types, strict=True)}
                | ({"media": pa.array(files, pa.binary())} if with_media else {})
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + ", media binary" * with_media)


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the digest columns and the file itself (media) of every text."""
    return _stored(docs, True)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every text."""
    return _stored(docs, False)
