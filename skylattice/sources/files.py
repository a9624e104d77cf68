"""Data sources for raster and mesh files: "gridbin" (read, write), "ply", "plymesh" and "matrix" (write).

Register with register(spark). A task reads whole files or writes its own file, named by its
partition, into a folder that all executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from skylattice.sources.images import DEPTHS, matrix_bytes


def grid_bytes(roi: tuple[float, float, float, float], res: float, layers: dict[str, tuple[np.ndarray, int]]) -> bytes:
    """A grid file: rectangle, resolution, and for each layer its name, interpolation flag and matrix."""
    out = [struct.pack("<5di", *roi, res, len(layers))]
    for name, (m, interpolation) in layers.items():
        raw = name.encode()
        depth = next(k for k, t in DEPTHS.items() if m.dtype == t)
        out += [struct.pack("<i", len(raw)), raw, struct.pack("<i", interpolation), struct.pack("<4i", m.shape[1], m.shape[0], m.dtype.itemsize, depth), np.ascontiguousarray(m).tobytes()]
    return b"".join(out)


def read_grid(data: bytes) -> tuple[tuple[float, ...], float, dict[str, tuple[np.ndarray, int]]]:
    *roi, res, n = struct.unpack_from("<5di", data)
    at, layers = 44, {}
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 4 + size].decode()
        interpolation, cols, rows, element, kind = struct.unpack_from("<5i", data, at + 4 + size)
        at += 24 + size
        layers[name] = (np.frombuffer(data, DEPTHS[kind & 7], rows * cols, at).reshape(rows, cols), interpolation)
        at += rows * cols * element
    return tuple(roi), res, layers


@dataclass
class _File(InputPartition):
    path: str


def _files(path: str, suffix: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    found = sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(suffix))
    if not found:
        raise FileNotFoundError(path)
    return found


class _GridReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [_File(p) for p in _files(self.path, ".grid.bin")]

    def read(self, partition):
        """Cells (gx, gy of the global lattice), a row for each layer; NaN is no data."""
        with open(partition.path, "rb") as f:
            roi, res, layers = read_grid(f.read())
        for name, (m, _) in layers.items():
            for r in range(m.shape[0]):
                gy = round((roi[1] + roi[3]) / res) - r
                for c, v in enumerate(m[r].tolist()):
                    if v == v:
                        yield (partition.path, name, round(roi[0] / res) + c, gy, float(v), res)


class _Writer(DataSourceWriter):
    suffix = ""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:8]

    def encode(self, rows: list) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        from pyspark import TaskContext

        rows = list(iterator)
        message = WriterCommitMessage()
        message.path = ""
        if rows:
            os.makedirs(self.path, exist_ok=True)
            context = TaskContext.get()
            name = f"part-{context.partitionId():05d}-{self.run}{self.suffix}"
            temporary = os.path.join(self.path, f".{name}.{context.taskAttemptId()}")
            with open(temporary, "wb") as f:
                f.write(self.encode(rows))
            os.replace(temporary, os.path.join(self.path, name))  # a second attempt replaces the first
            message.path = name
        return message

    def commit(self, messages):
        if self.overwrite:
            keep = {m.path for m in messages if m}
            for n in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if n.endswith(self.suffix) and n not in keep:
                    os.remove(os.path.join(self.path, n))

    def abort(self, messages):
        for m in messages:
            if m and m.path:
                os.remove(os.path.join(self.path, m.path))


class _GridWriter(_Writer):
    """Rows (layer, gx, gy, value, res) of one partition become a grid file over their bounding box."""

    suffix = ".grid.bin"

    def encode(self, rows: list) -> bytes:
        res = float(rows[0]["res"])
        gx, gy = (np.array([r[c] for r in rows]) for c in ("gx", "gy"))
        x0, y1, cols, high = gx.min(), gy.max(), int(np.ptp(gx)) + 1, int(np.ptp(gy)) + 1
        layers: dict[str, tuple[np.ndarray, int]] = {}
        for r in rows:
            m = layers.setdefault(r["layer"], (np.full((high, cols), np.nan), 1))[0]
            m[y1 - r["gy"], r["gx"] - x0] = r["value"]
        return grid_bytes((x0 * res, (y1 - high + 1) * res, (cols - 1) * res, (high - 1) * res), res, layers)


class _PlyWriter(_Writer):
    """Points x, y, z and, where there are such columns, nx, ny, nz and red, green, blue become the vertices of a binary PLY file."""

    suffix = ".ply"

    def encode(self, rows: list) -> bytes:
        names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in rows[0].asDict()]
        colors = [c for c in ("red", "green", "blue") if c in rows[0].asDict()]
        head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(rows)}\n" + "".join(f"property float {c}\n" for c in names) + "".join(f"property uchar {c}\n" for c in colors) + "end_header\n"
        kind = np.dtype([(c, "<f4") for c in names] + [(c, "u1") for c in colors])
        return head.encode() + np.array([tuple(r[c] for c in names) + tuple(int(r[c]) for c in colors) for r in rows], kind).tobytes()


class _NamedWriter(_Writer):
    """Rows sorted by a name become a file for each name; only one name's rows are held."""

    key = ""

    def write(self, iterator):
        from itertools import groupby

        from pyspark import TaskContext

        message = WriterCommitMessage()
        message.path, message.names = "", []
        for name, rows in groupby(iterator, lambda r: r[self.key]):
            os.makedirs(self.path, exist_ok=True)
            file = f"{name}{self.suffix}"
            temporary = os.path.join(self.path, f".{file}.{TaskContext.get().taskAttemptId()}")
            with open(temporary, "wb") as f:
                f.write(self.encode(list(rows)))
            os.replace(temporary, os.path.join(self.path, file))
            message.names.append(file)
        return message

    def commit(self, messages):
        pass

    def abort(self, messages):
        for m in messages:
            for n in m.names if m else []:
                os.remove(os.path.join(self.path, n))


class _MeshWriter(_NamedWriter):
    """Vertices (kind 0: x, y, z and, where they are, red, green, blue, nx, ny, nz) and faces (kind 1: a, b, c) of a mesh become a binary PLY file."""

    suffix, key = ".ply", "mesh"

    def encode(self, rows: list) -> bytes:
        there = rows[0].asDict()
        names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in there]
        colors = [c for c in ("red", "green", "blue") if c in there]
        vertices, faces = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in names), *(f"property uchar {c}" for c in colors)]
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header", ""]
        kind = np.dtype([(c, "<f4") for c in names] + [(c, "u1") for c in colors])
        points = np.array([tuple(r[c] for c in names) + tuple(int(r[c]) for c in colors) for r in vertices], kind)
        sides = np.array([(3, r["a"], r["b"], r["c"]) for r in faces], np.dtype([("n", "u1"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")]))
        return "\n".join(head).encode() + points.tobytes() + sides.tobytes()


class _MatrixWriter(_NamedWriter):
    """Pixels (name, r, c, value) become a raw matrix file of 32-bit floats for each name; missing pixels are NaN."""

    suffix, key = ".bin", "name"

    def encode(self, rows: list) -> bytes:
        r, c = (np.array([x[k] for x in rows]) for k in ("r", "c"))
        m = np.full((r.max() + 1, c.max() + 1), np.nan, np.float32)
        m[r, c] = [np.nan if x["value"] is None else x["value"] for x in rows]
        return matrix_bytes(m)


class MeshSource(DataSource):
    @classmethod
    def name(cls):
        return "plymesh"

    def writer(self, schema, overwrite):
        return _MeshWriter(self.options["path"], overwrite)


class MatrixSource(DataSource):
    @classmethod
    def name(cls):
        return "matrix"

    def writer(self, schema, overwrite):
        return _MatrixWriter(self.options["path"], overwrite)


class GridSource(DataSource):
    @classmethod
    def name(cls):
        return "gridbin"

    def schema(self):
        return "path string, layer string, gx long, gy long, value double, res double"

    def reader(self, schema):
        return _GridReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _GridWriter(self.options["path"], overwrite)


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "ply"

    def writer(self, schema, overwrite):
        return _PlyWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)
    spark.dataSource.register(PlySource)
    spark.dataSource.register(MeshSource)
    spark.dataSource.register(MatrixSource)
