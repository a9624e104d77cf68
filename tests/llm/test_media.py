import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import media


def payloads():
    rng = random.Random(0)
    out = [b"", b"a", b"\0" * 130, b"\xff" * 320, b"ab" + b"\0" * 40 + b"c"]
    out += [bytes(rng.randrange(256) for _ in range(n)) for n in (63, 64, 65, 1000, 5000)]
    out += [bytes(rng.randrange(256) if rng.random() < 0.05 else 0 for _ in range(n)) for n in (700, 3000)]
    return [media.padded(p) for p in out]


def test_files_round_trip():
    ps = payloads()
    files = media.write_jpegs(ps)
    for p, f, image in zip(ps, files, media.read_jpegs(files), strict=True):
        assert media.payload(image) == p
        assert media.write_jpegs([p]) == [f] and f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        w, h = media.frame_size(len(p) // 64)
        assert (image["width"], image["height"]) == (8 * w, 8 * h) and media.thumbnail(image).shape == (h, w)


def test_thumbnail_is_the_dc_coefficient():
    p = bytes([5] + [0] * 63 + [250] + [0] * 63)
    image = media.read_jpegs(media.write_jpegs([p]))[0]
    assert media.thumbnail(image).ravel().tolist() == [133, 122]


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code, n):
        self.text += format(code, f"0{n}b") if n else ""

    def bytes(self):
        full = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(full[i : i + 8], 2) for i in range(0, len(full), 8)).replace(b"\xff", b"\xff\x00")


def color_file(w, h, dc, interval):
    """A three-component file with 2 x 2 luminance sampling: only DC coefficients; dc(component, x, y)."""
    codes = media._canonical(*media.DC_TABLE)
    end = media._canonical(*media.AC_TABLE)[0]
    across, down = -(-w // 16), -(-h // 16)
    parts, bits, last = [], Bits(), [0, 0, 0]
    for m in range(across * down):
        if interval and m and m % interval == 0:
            parts.append(bits.bytes())
            bits, last = Bits(), [0, 0, 0]
        mx, my = m % across, m // across
        blocks = [(0, 2 * mx + i, 2 * my + j) for j in (0, 1) for i in (0, 1)] + [(1, mx, my), (2, mx, my)]
        for c, x, y in blocks:
            v = dc(c, x, y) - last[c]
            last[c] += v
            size = abs(v).bit_length()
            bits.put(*codes[size])
            bits.put(v if v >= 0 else v + (1 << size) - 1, size)
            bits.put(*end)
    parts.append(bits.bytes())
    scan = b"".join(p + bytes([0xFF, 0xD0 + i % 8]) for i, p in enumerate(parts[:-1])) + parts[-1]
    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = media._segment(0xDB, bytes([0] + [8] * 64)) + media._segment(0xC4, bytes([0, *media.DC_TABLE[0], *media.DC_TABLE[1]])) + media._segment(0xC4, bytes([16, *media.AC_TABLE[0], *media.AC_TABLE[1]]))
    restart = media._segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    return b"\xff\xd8" + tables + restart + media._segment(0xC0, frame) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_color_file_with_sampling(interval):
    luminance = lambda x, y: (x * 7 + y * 13) % 50 - 25
    f = color_file(50, 37, lambda c, x, y: luminance(x, y) if c == 0 else 3, interval)
    image = media.read_jpegs([f])[0]
    assert media.thumbnail(image).tolist() == [[128 + luminance(x, y) for x in range(7)] for y in range(5)]


def test_damaged_files_say_so(spark):
    good = media.write_jpegs([media.padded(b"x" * 500)])[0]
    rng = random.Random(3)
    broken = [bytearray(good) for _ in range(30)]
    for b in broken:
        b[rng.randrange(200, len(b))] ^= 1 << rng.randrange(8)
    for image in media.read_jpegs([bytes(b) for b in broken] + [good[:n] for n in range(0, len(good), 37)]):
        assert isinstance(image, (str, dict))
    df = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, b"")], "image_id long, image binary")
    got = {r.image_id: r for r in media.jpeg_features(df).collect()}
    assert got[1].error is None and got[1].width == 24 and got[2].feature is None and got[2].error and got[3].error and got[4].error


def test_texts_are_read_back(odd_docs, docs_of):
    rows = odd_docs.select("text", F.monotonically_increasing_id().alias("doc_id"), F.lit(1).alias("feature"))
    texts = {r.doc_id: (r.text or "").encode() for r in rows.collect()}
    for r in media.stored_texts(rows).collect():
        p = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(p), zlib.crc32(p[-64:]))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert media.payload(media.read_jpegs([bytes(r.media)])[0]) == p
    assert media.text_digests(docs_of([])).count() == 0


def test_average_hash():
    assert media.average_hash(np.zeros((3, 5), np.uint8)) == "0" * 16
    half = np.zeros((16, 16), np.uint8)
    half[:, 8:] = 200
    assert media.average_hash(half) == "0f" * 8


# The luminance tables of the JPEG standard (annex K.3), as lengths and symbols.
STANDARD_DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
STANDARD_AC = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)


def codes_of(table):
    """Symbol -> (code, length), counted up length by length."""
    code, out, symbols = 0, {}, iter(table[1])
    for n, many in enumerate(table[0], 1):
        for _ in range(many):
            out[next(symbols)] = (code, n)
            code += 1
        code <<= 1
    return out


def ordinary_file(w, h, blocks, interval, sampling=2):
    """A file as cameras write them: standard tables, AC runs, three components; blocks(component, x, y) gives 64 coefficients in zigzag order."""
    dc, ac = codes_of(STANDARD_DC), codes_of(STANDARD_AC)
    across, down = -(-w // (8 * sampling)), -(-h // (8 * sampling))
    parts, bits, last = [], Bits(), [0, 0, 0]
    number = lambda v, size: v if v >= 0 else v + (1 << size) - 1
    for m in range(across * down):
        if interval and m and m % interval == 0:
            parts.append(bits.bytes())
            bits, last = Bits(), [0, 0, 0]
        mx, my = m % across, m // across
        for c, x, y in [(0, sampling * mx + i, sampling * my + j) for j in range(sampling) for i in range(sampling)] + [(1, mx, my), (2, mx, my)]:
            z = blocks(c, x, y)
            size = abs(z[0] - last[c]).bit_length()
            bits.put(*dc[size])
            bits.put(number(z[0] - last[c], size), size)
            last[c], run = z[0], 0
            for v in z[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*ac[0xF0])
                    run -= 16
                size = abs(v).bit_length()
                bits.put(*ac[run << 4 | size])
                bits.put(number(v, size), size)
                run = 0
            if run:
                bits.put(*ac[0])
    parts.append(bits.bytes())
    scan = b"".join(p + bytes([0xFF, 0xD0 + i % 8]) for i, p in enumerate(parts[:-1])) + parts[-1]
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    tables = segment(0xDB, bytes([0] + [16] * 64)) + segment(0xC4, bytes([0, *STANDARD_DC[0], *STANDARD_DC[1]]) + bytes([16, *STANDARD_AC[0], *STANDARD_AC[1]]))
    frame = segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 16 * sampling + sampling, 0, 2, 17, 0, 3, 17, 0]))
    restart = segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    return b"\xff\xd8" + tables + restart + frame + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def random_blocks(seed):
    known = {}

    def block(c, x, y):
        if (c, x, y) not in known:
            rng = random.Random(seed * 1_000_003 + c * 10_007 + x * 101 + y)
            z = [rng.randrange(-500, 500)] + [0] * 63
            for _ in range(rng.choice([0, 1, 3, 10, 63])):
                z[rng.randrange(1, 64)] = rng.choice([-1, 1, 2, -7, 100, -1023, 1023])
            known[c, x, y] = z
        return known[c, x, y]

    return block


@pytest.mark.parametrize(("w", "h", "interval", "sampling"), [(70, 45, 0, 2), (70, 45, 3, 2), (64, 64, 1, 1), (9, 8, 0, 1), (200, 120, 2, 2)])
def test_ordinary_files(w, h, interval, sampling):
    blocks = random_blocks(w + interval)
    image = media.read_jpegs([ordinary_file(w, h, blocks, interval, sampling)])[0]
    for c in range(3):
        wide, high, got = image["blocks"][c + 1]
        scale = 8 if c == 0 else 8 * sampling
        assert (wide, high) == (-(-w // scale), -(-h // scale))
        assert got.reshape(high, wide, 64).tolist() == [[blocks(c, x, y) for x in range(wide)] for y in range(high)]
    dc = np.array([[blocks(0, x, y)[0] for x in range(-(-w // 8))] for y in range(-(-h // 8))])
    assert media.thumbnail(image).tolist() == np.clip(np.floor(128 + dc * 16 / 8 + 0.5), 0, 255).astype(int).tolist()


def test_files_without_markers_take_no_longer():
    """800 x 600 pixels in one lane, with a symbol or two a block."""
    import time

    f = ordinary_file(800, 600, lambda c, x, y: [(x * 3 + y * 5 + c) % 200 - 100] + [0] * 63, 0)
    began = time.perf_counter()
    image = media.read_jpegs([f])[0]
    assert media.thumbnail(image).shape == (75, 100) and time.perf_counter() - began < 0.6
