"""GeoTIFF files, read by a parser of the test's own."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import blocks as B
from skylattice.sources import geotiff as G


def unpacked(data):
    """LZW after the description in TIFF 6.0: one bit after another."""
    bits = "".join(f"{b:08b}" for b in data)
    at, width, table, out, old = 0, 9, {}, b"", None
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, width, old = {i: bytes([i]) for i in range(256)}, 9, None
            size = 258
            continue
        if old is None:
            word = table[code]
        else:
            word = table[code] if code in table else table[old] + table[old][:1]
            table[size] = table[old] + word[:1]
            size += 1
            width = 9 + sum(size >= n for n in (511, 1023, 2047))
        out += word
        old = code


def parsed(data):
    """Every directory's tags, and its image (layers, rows, columns) with None for missing tiles."""
    assert data[:2] == b"II"
    big = struct.unpack_from("<H", data, 2)[0] == 43
    at, out = struct.unpack_from("<Q" if big else "<I", data, 8 if big else 4)[0], []
    kinds = {3: "H", 4: "I", 12: "d", 2: "c", 16: "Q"}
    while at:
        n = struct.unpack_from("<Q" if big else "<H", data, at)[0]
        start, size = at + (8 if big else 2), 20 if big else 12
        tags = {}
        for i in range(n):
            tag, kind = struct.unpack_from("<HH", data, start + size * i)
            count = struct.unpack_from("<Q" if big else "<I", data, start + size * i + 4)[0]
            place = start + size * i + (12 if big else 8)
            if struct.calcsize(kinds[kind]) * count > (8 if big else 4):
                place = struct.unpack_from("<Q" if big else "<I", data, place)[0]
            tags[tag] = struct.unpack_from(f"<{count}{kinds[kind]}", data, place)
        assert list(tags) == sorted(tags)
        at = struct.unpack_from("<Q" if big else "<I", data, start + size * n)[0]
        w, h, s = tags[256][0], tags[257][0], tags[277][0]
        across = -(-w // tags[322][0])
        image = np.full((h, w, s), np.nan)
        for i, (o, c) in enumerate(zip(tags[324], tags[325], strict=True)):
            if c:
                raw = {1: lambda x: x, 5: unpacked, 8: zlib.decompress}[tags[259][0]](data[o : o + c])
                tile = np.frombuffer(raw, {(8, 1): "u1", (32, 3): "<f4", (64, 3): "<f8"}[tags[258][0], tags[339][0]]).reshape(256, 256, s)
                r, k = divmod(i, across)
                part = tile[: h - r * 256, : w - k * 256]
                image[r * 256 : r * 256 + part.shape[0], k * 256 : k * 256 + part.shape[1]] = part
        out.append((tags, image))
    return out


def test_codes_come_back():
    for seed in range(40):
        rng = random.Random(seed)
        data = bytes(rng.randrange(rng.choice([1, 2, 5, 256])) for _ in range(rng.choice([0, 1, 2, 300, 9000])))
        assert unpacked(G.lzw_coded(data)) == data == G.lzw_read(G.lzw_coded(data))


@pytest.mark.parametrize(("kind", "compression"), [("float32", "lzw"), ("float64", "deflate"), ("uint8", "none")])
def test_files_hold_the_raster(spark, tmp_path, kind, compression):
    rng = random.Random(1)
    cells = {(rng.randrange(-300, 900), rng.randrange(-100, 700)): (float(rng.randrange(1, 255)), float(rng.randrange(1, 255)), float(rng.randrange(1, 255))) for _ in range(900)}
    df = spark.createDataFrame([(x, y, *v) for (x, y), v in cells.items()], "gx long, gy long, r double, g double, b double").withColumn("g", F.when(F.col("gx") % 5 != 0, F.col("g")))
    layers = ["r", "g", "b"]
    files = G.geotiffs(B.to_blocks(df, layers), layers, 0.5, 32632, "ortho", kind, compression, side=512)
    done = {r.name: r for r in G.saved(files, str(tmp_path / "out")).collect()}
    assert set(done) == {f"ortho_{x // 512}_{y // 512}.tif" for x, y in cells} and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(done)
    seen = {}
    for r in done.values():
        data = open(r.path, "rb").read()
        assert len(data) == r.n_bytes
        images = parsed(data)
        tags, full = images[0]
        assert tags[33550] == (0.5, 0.5, 0.0) and tags[34735][-1] == 32632 and tags[262][0] == (2 if kind == "uint8" else 1) and tags[254][0] == 0
        x0, top = tags[33922][3] / 0.5 + 0.5, tags[33922][4] / 0.5 - 0.5
        empty = np.isnan(full) | (full == 0) if kind == "uint8" else np.isnan(full)
        for row, column in zip(*np.nonzero(~empty.all(axis=2)), strict=True):
            seen[int(x0 + column), int(top - row)] = tuple(None if e else float(v) for v, e in zip(full[row, column], empty[row, column], strict=True))
        size = max(full.shape[:2])
        for tags, image in images[1:]:  # every second pixel of the one before
            assert tags[254][0] == 1 and 33550 not in tags
            assert np.array_equal(image, full[::2, ::2], equal_nan=True) or kind == "uint8" and np.array_equal(np.nan_to_num(image), np.nan_to_num(full[::2, ::2]))
            full = image
        assert max(full.shape[:2]) <= 256 and len(images) == 1 + (size > 256) + (size > 512)
    assert seen == {(r.gx, r.gy): (r.r, r.g, r.b) for r in df.collect()}
    again = B.to_cells(G.read_blocks(files, layers), layers).collect()
    assert {(r.gx, r.gy): (r.r, r.g, r.b) for r in again} == seen


def test_large_files_are_big_ones():
    tiles = {(0, 0): b"abc", (1, 0): b"de"}
    one = G._file([(256, 512, tiles)], "float32", 1, "none", (0.0, 0.0), 1.0, 3857)
    assert one[2] == 42 and one.endswith(b"abcde") and G.directories(one)[0]["offsets"] == (len(one) - 5, len(one) - 2)
    layout = G._Layout(True)
    assert len(layout.directory(16, {256: (G.LONG, [3]), 324: (G.LONG8, [1, 2, 3])}, False)) == 8 + 2 * 20 + 8 + 24
    with pytest.raises(ValueError, match="multiple"):
        G.geotiffs(None, [], 1.0, 3857, side=100)
    with pytest.raises(ValueError, match="TIFF"):
        G.directories(b"MM\0*" + b"\0" * 8)
