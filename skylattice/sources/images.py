"""Image files as frames: EXIF position, time and heading, and raw matrices.

Files are read by Spark's binaryFile source; each task parses the bytes of its own files.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.export import frame_number

#: Tags of the camera, date and GPS directories (fixed values).
GPS_POINTER, DATE, MODEL = 0x8825, 0x0132, 0x0110
LAT_REF, LAT, LON_REF, LON, ALT, HEADING = 1, 2, 3, 4, 6, 17
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Numpy types of raw matrices, by depth code (fixed values).
DEPTHS = {0: np.uint8, 2: np.uint16, 5: np.float32, 6: np.float64}


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Paths and lengths of all files below a folder with a suffix; in no order, as a table has none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", "length")


def _directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * i)[0]
        raw = tiff[place : place + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.rstrip(b"\0").decode("latin-1")
        elif kind in (5, 10):
            v = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        elif kind in (3, 4, 9):
            out[tag] = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw))
        else:
            out[tag] = list(raw)
    return out


def exif(data: bytes) -> dict[str, object]:
    """camera, taken, latitude, longitude, altitude and heading of a JPEG file's EXIF segment; 0 where a tag is missing."""
    got: dict[str, object] = {"camera": None, "taken": None, "latitude": 0.0, "longitude": 0.0, "altitude": 0.0, "heading": 0.0}
    at = data.find(b"Exif\0\0")
    if at < 0:
        return got
    tiff = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return got
    try:
        main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        gps = _directory(tiff, main[GPS_POINTER][0], order) if GPS_POINTER in main else {}
    except struct.error:
        return got
    degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
    got["camera"], got["taken"] = main.get(MODEL), main.get(DATE)
    if len(gps.get(LAT, ())) == 3:
        got["latitude"] = degrees(gps[LAT]) * (-1 if gps.get(LAT_REF) == "S" else 1)
    if len(gps.get(LON, ())) == 3:
        got["longitude"] = degrees(gps[LON]) * (-1 if gps.get(LON_REF) == "W" else 1)
    got["altitude"] = gps.get(ALT, [0.0])[0]
    got["heading"] = gps.get(HEADING, [0.0])[0]
    return got


def read_frames(spark: SparkSession, folder: str, suffix: str = ".jpg") -> DataFrame:
    """path, frame_no, camera, taken, latitude, longitude, altitude and heading of every image of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)

    def parse(batches):
        for pdf in batches:
            rows = [exif(bytes(b)) for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], **{k: [r[k] for r in rows] for k in ("camera", "taken", "latitude", "longitude", "altitude", "heading")}})

    got = files.select("path", "content").mapInPandas(parse, "path string, camera string, taken string, latitude double, longitude double, altitude double, heading double")
    return got.withColumn("frame_no", frame_number("path"))


def matrix_bytes(m: np.ndarray) -> bytes:
    """A matrix (rows x cols or rows x cols x channels) with its header of four integers: cols, rows, size of an element, type."""
    channels = 1 if m.ndim == 2 else m.shape[2]
    depth = next(k for k, t in DEPTHS.items() if m.dtype == t)
    return struct.pack("<4i", m.shape[1], m.shape[0], m.dtype.itemsize * channels, depth + ((channels - 1) << 3)) + np.ascontiguousarray(m).tobytes()


def read_matrix_bytes(data: bytes) -> np.ndarray:
    cols, rows, _, kind = struct.unpack_from("<4i", data)
    channels = (kind >> 3) + 1
    m = np.frombuffer(data, DEPTHS[kind & 7], rows * cols * channels, 16)
    return m.reshape(rows, cols) if channels == 1 else m.reshape(rows, cols, channels)


def read_matrices(spark: SparkSession, folder: str, suffix: str = ".bin") -> DataFrame:
    """path, r, c, channel and value of every pixel of the raw matrices of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)

    def parse(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                m = np.atleast_3d(read_matrix_bytes(bytes(data)))
                r, c, k = (x.ravel() for x in np.indices(m.shape))
                yield pd.DataFrame({"path": path, "r": r, "c": c, "channel": k, "value": m.ravel().astype(float)})

    return files.select("path", "content").mapInPandas(parse, "path string, r long, c long, channel long, value double")


def present_tags(spark: SparkSession, folder: str, suffix: str = ".jpg") -> DataFrame:
    """path and a map of which values an image's EXIF segment has."""
    f = read_frames(spark, folder, suffix)
    there = [x for c in ("camera", "taken") for x in (F.lit(c), F.col(c).isNotNull())] + [x for c in ("latitude", "longitude", "altitude", "heading") for x in (F.lit(c), F.col(c) != 0)]
    return f.select("path", F.create_map(*there).alias("tags"))
