"""Block rasters as cloud-optimised GeoTIFF files, and back.

A raster goes to one file for each square of `side` cells (aligned to multiples of it), so that no task holds more than
one square: tasks put blocks together to tiles of TILE cells and code them, and one task a file lays out the headers, the offsets
of all tiles, the overviews and the coded tiles. Overviews take every second cell, again and again, until one fits a
tile, and are in the file. Cells are the centres of pixels, rows run from north to south, an empty cell is NaN (0 in
files of bytes), layers are interleaved by pixel, and three or four layers of bytes are colours.

Layouts, tags and codes are those of TIFF 6.0, BigTIFF and GeoTIFF 1.1.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.blocks import ROWS, SIDE, _lists, _values

#: Cells a side of a tile and of a file (at most; a multiple of TILE).
TILE, FILE_SIDE = 256, 4096
_PER = TILE // SIDE
# Tags, compressions and kinds of fields.
TAGS = {"subfile": 254, "width": 256, "length": 257, "bits": 258, "compression": 259, "photometric": 262, "samples": 277, "planar": 284, "tile_width": 322, "tile_length": 323, "offsets": 324, "counts": 325, "extra": 338, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113}
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}
TYPES = {"uint8": ("u1", 1), "float32": ("<f4", 3), "float64": ("<f8", 3)}
SHORT, LONG, DOUBLE, ASCII, LONG8 = 3, 4, 12, 2, 16
_CLEAR, _END, _FIRST = 256, 257, 258


def lzw_coded(data: bytes) -> bytes:
    """LZW codes of bytes, most significant bit first, 9 to 12 bits wide."""
    out, held, bits, width = bytearray(), _CLEAR, 9, 9
    table: dict[int, int] = {}
    new, prefix = _FIRST, -1

    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[key] = new
        if new in (511, 1023, 2047):
            width += 1
        elif new == 4094:
            held, bits = held << width | _CLEAR, bits + width
            table, new, width = {}, _FIRST - 1, 9
        new, prefix = new + 1, byte
        if bits > 256:
            rest = bits & 7
            out += (held >> rest).to_bytes(bits >> 3, "big")
            held, bits = held & ((1 << rest) - 1), rest
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        if new in (511, 1023, 2047):  # the reader adds an entry here too
            width += 1
    held, bits = held << width | _END, bits + width
    pad = -bits % 8
    return bytes(out + (held << pad).to_bytes((bits + pad) >> 3, "big"))


def lzw_read(data: bytes) -> bytes:
    """The bytes of LZW codes."""
    out, width, at, held, bits = [], 9, 0, 0, 0
    table: list[bytes] = []
    last = b""
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        code = held >> (bits - width)
        bits -= width
        held &= (1 << bits) - 1
        if code == _END:
            return b"".join(out)
        if code == _CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) in (511, 1023, 2047):
            width += 1


_CODERS = {"none": (bytes, bytes), "lzw": (lzw_coded, lzw_read), "deflate": (lambda b: zlib.compress(b, 6), zlib.decompress)}


def _pixels(tile: np.ndarray, kind: str) -> bytes:
    """A tile (layers, rows, columns; NaN is empty) as the bytes of its pixels."""
    values = np.moveaxis(tile, 0, -1)
    if kind == "uint8":
        values = np.clip(np.nan_to_num(np.floor(values + 0.5), nan=0.0), 0, 255)
    return np.ascontiguousarray(values.astype(TYPES[kind][0])).tobytes()


class _Layout:
    """Bytes of a file: header, directories with the values that don't fit in them, then tiles."""

    def __init__(self, big: bool) -> None:
        self.big = big
        self.size = struct.Struct("<Q" if big else "<I")

    def directory(self, at: int, fields: dict[int, tuple[int, list]], following: bool) -> bytes:
        """One directory that starts at a place; the one that follows comes right after it."""
        inline, entry = (8, 20) if self.big else (4, 12)
        count = struct.Struct("<Q" if self.big else "<H")
        end = at + count.size + entry * len(fields) + self.size.size
        head, rest = count.pack(len(fields)), b""
        for tag, (kind, values) in sorted(fields.items()):
            raw = values if kind == ASCII else struct.pack(f"<{len(values)}{ {SHORT: 'H', LONG: 'I', DOUBLE: 'd', LONG8: 'Q'}[kind] }", *values)
            head += struct.pack("<HH", tag, kind) + self.size.pack(len(values))
            if len(raw) <= inline:
                head += raw.ljust(inline, b"\0")
            else:
                head += self.size.pack(end + len(rest))
                rest += raw + b"\0" * (len(raw) % 2)
        return head + self.size.pack(end + len(rest) if following else 0) + rest


def _file(levels: list[tuple[int, int, dict]], kind: str, layers: int, compression: str, corner: tuple[float, float], res: float, epsg: int) -> bytes:
    """A TIFF file of levels (columns, rows, {(row, column): coded tile}), the finest first; missing tiles are left out (offset and size 0)."""
    dtype, sample = TYPES[kind]
    bits = 8 * np.dtype(dtype).itemsize
    total = sum(len(t) for _, _, tiles in levels for t in tiles.values())
    layout = _Layout(total > 3_500_000_000)
    offset_kind = LONG8 if layout.big else LONG
    colours = kind == "uint8" and layers in (3, 4)

    def fields(k: int, places: list[int]) -> dict:
        columns, rows, tiles = levels[k]
        across, down = -(-columns // TILE), -(-rows // TILE)
        out = {
            "subfile": (LONG, [int(k > 0)]), "width": (LONG, [columns]), "length": (LONG, [rows]), "bits": (SHORT, [bits] * layers), "compression": (SHORT, [COMPRESSIONS[compression]]),
            "photometric": (SHORT, [2 if colours else 1]), "samples": (SHORT, [layers]), "planar": (SHORT, [1]), "tile_width": (SHORT, [TILE]), "tile_length": (SHORT, [TILE]),
            "offsets": (offset_kind, places), "counts": (LONG, [len(tiles.get((r, c), b"")) for r in range(down) for c in range(across)]), "format": (SHORT, [sample] * layers),
            "nodata": (ASCII, b"0\0" if kind == "uint8" else b"nan\0"),
        }
        if layers > 3 - 2 * (not colours):
            out["extra"] = (SHORT, [0] * (layers - (3 if colours else 1)))
        if k == 0:
            geographic = epsg in (4326,)
            keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
            out |= {"scale": (DOUBLE, [res, res, 0.0]), "tie": (DOUBLE, [0.0, 0.0, 0.0, *corner, 0.0]), "keys": (SHORT, keys)}
        return {TAGS[name]: value for name, value in out.items()}

    header = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if layout.big else struct.pack("<2sHI", b"II", 42, 8)
    blank = [[0] * (-(-c // TILE) * -(-r // TILE)) for c, r, _ in levels]
    at = len(header) + sum(len(layout.directory(0, fields(k, blank[k]), False)) for k in range(len(levels)))
    places, body = [[] for _ in levels], []
    for k in range(len(levels) - 1, -1, -1):  # small overviews first
        columns, rows, tiles = levels[k]
        for r in range(-(-rows // TILE)):
            for c in range(-(-columns // TILE)):
                coded = tiles.get((r, c), b"")
                places[k].append(at if coded else 0)
                body.append(coded)
                at += len(coded)
    out = header
    for k in range(len(levels)):
        out += layout.directory(len(out), fields(k, places[k]), k + 1 < len(levels))
    return b"".join([out, *body])


def _halved(tiles: dict[tuple[int, int], np.ndarray], layers: int) -> dict[tuple[int, int], np.ndarray]:
    """Tiles of a raster of every second cell, from parts of TILE / 2 by (row, column) of the tiles that they are of."""
    out: dict[tuple[int, int], np.ndarray] = {}
    half = TILE // 2
    for (r, c), part in tiles.items():
        table = out.setdefault((r // 2, c // 2), np.full((layers, TILE, TILE), np.nan))
        table[:, r % 2 * half : r % 2 * half + half, c % 2 * half : c % 2 * half + half] = part
    return out


def geotiffs(blocks: DataFrame, layers: list[str], res: float, epsg: int, prefix: str = "map", kind: str = "float32", compression: str = "lzw", side: int = FILE_SIDE, overviews: bool = True) -> DataFrame:
    """name and content of the files of a raster; its cells lie at gx * res, gy * res of a projected reference system."""
    if side % TILE or side <= 0:
        raise ValueError(f"side has to be a multiple of {TILE}")
    item = F.struct("tx", "ty", *[F.col(c).alias(f"v{k}") for k, c in enumerate(layers)])
    down = lambda c, n: F.floor(F.col(c) / n).cast("long")
    tiles = blocks.groupBy(down("tx", _PER).alias("x"), down("ty", _PER).alias("y")).agg(F.collect_list(item).alias("parts"))

    def coded(batches):
        code = _CODERS[compression][0]
        for whole in batches:
            for first in range(0, whole.num_rows, 4):
                b = whole.slice(first, 4)
                lists = b.column(2)
                ends, items = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
                tx, ty = items.field("tx").to_numpy(), items.field("ty").to_numpy()
                values = [_values(items.field(f"v{k}")).reshape(-1, SIDE, SIDE) for k in range(len(layers))]
                out, halves = [], []
                for i in range(b.num_rows):
                    tile = np.full((len(layers), TILE, TILE), np.nan)
                    for j in range(ends[i], ends[i + 1]):
                        r, c = (_PER - 1 - ty[j] % _PER) * SIDE, tx[j] % _PER * SIDE
                        for k in range(len(layers)):
                            tile[k, r : r + SIDE, c : c + SIDE] = values[k][j][::-1]
                    out.append(code(_pixels(tile, kind)))
                    halves.append(tile[:, ::2, ::2].ravel())
                yield pa.record_batch({"x": b.column(0), "y": b.column(1), "coded": pa.array(out, pa.binary()), "half": _lists(np.concatenate(halves), [len(h) for h in halves])})

    parts = tiles.mapInArrow(coded, "x long, y long, coded binary, half array<double>")
    n = side // TILE
    files = parts.groupBy(down("x", n).alias("fx"), down("y", n).alias("fy")).agg(F.collect_list(F.struct("x", "y", "coded", "half")).alias("tiles"))

    def laid_out(batches):
        code = _CODERS[compression][0]
        for b in batches:
            for i in range(b.num_rows):
                lists = b.column(2).slice(i, 1).flatten()
                x, y = lists.field("x").to_numpy(), lists.field("y").to_numpy()
                x0, x1, y1, y0 = int(x.min()), int(x.max()), int(y.max()), int(y.min())
                place = [(y1 - int(r), int(c) - x0) for r, c in zip(y, x, strict=True)]
                columns, rows = (x1 - x0 + 1) * TILE, (y1 - y0 + 1) * TILE
                levels = [(columns, rows, dict(zip(place, lists.field("coded").to_pylist(), strict=True)))]
                halves = _values(lists.field("half")).reshape(len(x), len(layers), TILE // 2, TILE // 2)
                reduced = dict(zip(place, halves, strict=True))
                while overviews and max(columns, rows) > TILE:
                    columns, rows = -(-columns // 2), -(-rows // 2)
                    full = _halved(reduced, len(layers))
                    levels.append((columns, rows, {p: code(_pixels(t, kind)) for p, t in full.items()}))
                    reduced = {p: t[:, ::2, ::2] for p, t in full.items()}
                corner = ((x0 * TILE - 0.5) * res, ((y1 + 1) * TILE - 0.5) * res)
                content = _file(levels, kind, len(layers), compression, corner, res, epsg)
                name = f"{prefix}_{b.column(0)[i].as_py()}_{b.column(1)[i].as_py()}.tif"
                yield pa.record_batch({"name": pa.array([name]), "content": pa.array([content], pa.binary())})

    return files.mapInArrow(laid_out, "name string, content binary")


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) to a folder that all executors mount, each under another name first; name, path and n_bytes of each."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path, part = os.path.join(folder, name), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                yield pa.record_batch({"name": pa.array([name]), "path": pa.array([path]), "n_bytes": pa.array([len(content)], pa.int64())})

    return files.select("name", "content").mapInArrow(run, "name string, path string, n_bytes long")


def _read_fields(data: bytes, at: int) -> tuple[dict, int]:
    """Fields of the directory at a place, and where the next one is."""
    big = data[2] == 43
    size, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    (n,) = struct.unpack_from("<Q" if big else "<H", data, at)
    at += 8 if big else 2
    out = {}
    for i in range(n):
        tag, kind = struct.unpack_from("<HH", data, at + entry * i)
        (count,) = struct.unpack_from("<" + size, data, at + entry * i + 4)
        code = {SHORT: "H", LONG: "I", DOUBLE: "d", LONG8: "Q", ASCII: "s"}.get(kind)
        if code is None:
            continue
        place = at + entry * i + 4 + struct.calcsize(size)
        if struct.calcsize("<" + code) * count > inline:
            (place,) = struct.unpack_from("<" + size, data, place)
        out[tag] = struct.unpack_from(f"<{count}{code}", data, place)
    return out, struct.unpack_from("<" + size, data, at + entry * n)[0]


def directories(data: bytes) -> list[dict]:
    """The directories of a little-endian tiled file: fields by name."""
    if data[:2] != b"II" or data[2] not in (42, 43):
        raise ValueError("no little-endian TIFF file")
    (at,) = struct.unpack_from("<Q", data, 8) if data[2] == 43 else struct.unpack_from("<I", data, 4)
    names, out = {v: k for k, v in TAGS.items()}, []
    while at:
        fields, at = _read_fields(data, at)
        out.append({names[t]: v for t, v in fields.items() if t in names})
    return out


def _tiles_of(data: bytes, level: int):
    """x, y of the first cell (upper left), cells a pixel and pixels (rows, columns, layers; NaN is empty) of every tile of a level."""
    every = directories(data)
    if level >= len(every):
        return
    d, top = every[level], every[0]
    read = _CODERS[{v: k for k, v in COMPRESSIONS.items()}[d["compression"][0]]][1]
    kind = "uint8" if d["format"][0] == 1 else f"float{d['bits'][0]}"
    res, scale = top["scale"][0], 2**level
    x0, y_top = round(top["tie"][3] / res + 0.5), round(top["tie"][4] / res - 0.5)
    across = -(-d["width"][0] // TILE)
    for i, (at, n) in enumerate(zip(d["offsets"], d["counts"], strict=True)):
        if n:
            raw = np.frombuffer(read(data[at : at + n]), TYPES[kind][0]).reshape(TILE, TILE, -1).astype(np.float64)
            r, c = divmod(i, across)
            yield x0 + c * TILE * scale, y_top - r * TILE * scale, scale, np.where(raw == 0, np.nan, raw) if kind == "uint8" else raw


def read_blocks(files: DataFrame, layers: list[str]) -> DataFrame:
    """name, tx, ty and layers: the raster that files (name, content) of geotiffs() hold, as blocks."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x, top, _, raw in _tiles_of(data, 0):
                    tiles = {(j, i): raw[j * SIDE : j * SIDE + SIDE, i * SIDE : i * SIDE + SIDE][::-1] for j in range(_PER) for i in range(_PER)}
                    own = [p for p, t in tiles.items() if not np.isnan(t).all()]
                    if own:
                        cols = [_lists(np.concatenate([tiles[p][:, :, k].ravel() for p in own]), [SIDE * SIDE] * len(own)) for k in range(len(layers))]
                        tx, ty = [x // SIDE + i for _, i in own], [(top + 1) // SIDE - 1 - j for j, _ in own]
                        yield pa.record_batch([pa.array([name] * len(own)), pa.array(tx, pa.int64()), pa.array(ty, pa.int64()), *cols], ["name", "tx", "ty", *layers])

    return files.select("name", "content").mapInArrow(run, "name string, tx long, ty long, " + ", ".join(f"`{c}` array<double>" for c in layers))


def read_cells(files: DataFrame, layers: list[str], level: int = 0) -> DataFrame:
    """name, gx, gy and layers of the pixels of a level that have a value, at the cell that each stands on."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x, top, step, raw in _tiles_of(data, level):
                    r, c = np.nonzero(~np.isnan(raw).all(axis=2))
                    values = [pa.array(raw[r, c, k], pa.float64(), mask=np.isnan(raw[r, c, k])) for k in range(len(layers))]
                    yield pa.record_batch([pa.array([name] * len(r), pa.string()), pa.array(x + c * step), pa.array(top - r * step), *values], ["name", "gx", "gy", *layers])

    return files.select("name", "content").mapInArrow(run, "name string, gx long, gy long, " + ", ".join(f"`{c}` double" for c in layers))
