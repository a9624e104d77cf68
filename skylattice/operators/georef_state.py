"""A georeference whose measurements are kept as sums, so that one more costs one row and not a new fit of all.

A measurement is a vector of 24 numbers: visual position and axes, GNSS position and axes. Number, mean and co-moments
of these vectors merge in any order, and hold all that the similarity fit over four points a measurement needs,
whatever transform and weight of the z axis it starts from: the points are linear in the vector. A camera's state is
such a row with its newest measurement and transform; tables of states merge by one aggregation, and a stream keeps them by camera.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylattice.operators.georef import GIS, GROT, MIN_GIS, VIS, VROT

#: Columns of a measurement's vector: positions, then axes column by column.
VECTOR = [*VIS, *[f"v{i}{j}" for j in range(3) for i in range(3)], *GIS, *[f"g{i}{j}" for j in range(3) for i in range(3)]]
assert sorted(VECTOR) == sorted([*VIS, *VROT, *GIS, *GROT])
_N = len(VECTOR)
Moments = tuple[int, np.ndarray, np.ndarray]


def moments(z: np.ndarray) -> Moments:
    """Number, mean and co-moments of vectors (rows)."""
    if not len(z):
        return 0, np.zeros(_N), np.zeros((_N, _N))
    mean = z.mean(0)
    return len(z), mean, (z - mean).T @ (z - mean)


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of both."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def refitted(state: Moments, t: np.ndarray, z_weight: float) -> np.ndarray:
    """A transform (4 x 4) improved by a similarity fit over the origin and the ends of the axes of every measurement."""
    n, mean, co = state
    turn = t[:3, :3] / np.linalg.norm(t[:3, :3], axis=0)
    sees, knows = [], []
    for k, size in enumerate((0.0, 1.0, 1.0, z_weight)):
        a, b = np.zeros((3, _N)), np.zeros((3, _N))
        a[:, 0:3], b[:, 12:15] = t[:3, :3], np.eye(3)
        if k:
            a[:, 3 * k : 3 * k + 3], b[:, 12 + 3 * k : 15 + 3 * k] = size * turn, size * np.eye(3)
        sees.append(a)
        knows.append(b)
    x, y = [a @ mean + t[:3, 3] for a in sees], [b @ mean for b in knows]
    mx, my = np.mean(x, 0), np.mean(y, 0)
    cov = sum(b @ co @ a.T / n + np.outer(q - my, p - mx) for a, b, p, q in zip(sees, knows, x, y, strict=True)) / 4
    spread = sum(np.trace(a @ co @ a.T) / n + (p - mx) @ (p - mx) for a, p in zip(sees, x, strict=True)) / 4
    u, d, vt = np.linalg.svd(cov)
    s = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ s @ vt
    scale = float(np.trace(np.diag(d) @ s) / spread) if spread > 0 else 1.0
    step = np.eye(4)
    step[:3, :3], step[:3, 3] = scale * r, my - scale * r @ mx
    return step @ t


def counts(new: np.ndarray, last: np.ndarray, least_visual: float) -> bool:
    """Whether a measurement gives a scale against the newest one kept."""
    return bool(np.linalg.norm(new[12:15] - last[12:15]) > MIN_GIS and np.linalg.norm(new[:3] - last[:3]) > least_visual)


_SUMS = "camera_id long, n long, mean array<double>, co array<double>"


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in VECTOR], 1).astype(float)


def pose_moments(poses: DataFrame) -> DataFrame:
    """camera_id, n, mean and co of the measurements of each camera: tasks sum up their own rows first."""

    def run(batches):
        held: dict[int, Moments] = {}
        for b in batches:
            who = b.column(0).to_numpy(zero_copy_only=False)
            z = _vectors(b)
            for camera in np.unique(who):
                held[int(camera)] = merged(held.get(int(camera), moments(z[:0])), moments(z[who == camera]))
            if len(held) > 1000:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    rows = poses.where(F.col("camera_id").isNotNull()).select(F.col("camera_id").cast("long").alias("camera_id"), *VECTOR)
    return merged_states(rows.mapInArrow(run, _SUMS))


def _rows(held: dict[int, Moments]) -> pa.RecordBatch:
    lists = lambda k: pa.array([m[k].ravel().tolist() for m in held.values()], pa.list_(pa.float64()))
    return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([m[0] for m in held.values()], pa.int64()), lists(1), lists(2)], ["camera_id", "n", "mean", "co"])


def merged_states(states: DataFrame) -> DataFrame:
    """One row (camera_id, n, mean, co) a camera of a table that may have several."""

    def run(batches):
        for b in batches:
            out: dict[int, Moments] = {}
            for row in b.to_pylist():
                own: Moments = (0, np.zeros(_N), np.zeros((_N, _N)))
                for p in sorted(row["parts"], key=lambda p: (p["n"], p["mean"])):  # in an order of their own: results don't depend on tasks
                    own = merged(own, (p["n"], np.array(p["mean"]), np.array(p["co"]).reshape(_N, _N)))
                out[row["camera_id"]] = own
            if out:
                yield _rows(out)

    return states.groupBy("camera_id").agg(F.collect_list(F.struct("n", "mean", "co")).alias("parts")).mapInArrow(run, _SUMS)


def refined_by_moments(states: DataFrame, transforms: DataFrame, z_weight: float) -> DataFrame:
    """transforms (camera_id, t) improved by the fit that georef.refined makes of all measurements, from their moments."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                state = (row["n"], np.array(row["mean"]), np.array(row["co"]).reshape(_N, _N))
                out.append(refitted(state, np.array(row["t"], float).reshape(4, 4), z_weight).ravel().tolist())
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["camera_id", "t"])

    return states.join(transforms, "camera_id").select("camera_id", "n", "mean", "co", "t").mapInArrow(run, "camera_id long, t array<double>")


class _Update(StatefulProcessor):
    """The georeference of a camera, improved by each measurement that counts."""

    def __init__(self, least_visual: float, z_weight: float) -> None:
        self.least, self.z_weight = least_visual, z_weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("georeference", "n long, mean array<double>, co array<double>, last array<double>, t array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["n"]), *[[float(x) for x in r[c]] for c in ("mean", "co", "last", "t")]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            n, mean, co, last, t = self.state.get()
            sums, last, t = (n, np.array(mean), np.array(co).reshape(_N, _N)), np.array(last), np.array(t).reshape(4, 4)
            new = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
            for seq, z in zip(new["seq"].tolist(), new[VECTOR].to_numpy(float), strict=True):
                if counts(z, last, self.least):
                    sums, last = merged(sums, (1, z, np.zeros((_N, _N)))), z
                    t = refitted(sums, t, self.z_weight)
                    out.append((key[0], seq, sums[0], t.ravel().tolist()))
            self.state.update((sums[0], *[x.ravel().tolist() for x in (sums[1], sums[2], last, t)]))
        yield pd.DataFrame(out, columns=["camera_id", "seq", "n", "t"])

    def close(self) -> None:
        pass


def first_states(kept: DataFrame, transforms: DataFrame) -> DataFrame:
    """camera_id, n, mean, co, last and t of cameras whose georeference stands: their measurements kept and their transforms."""
    newest = kept.groupBy("camera_id").agg(F.max_by(F.array(*[F.col(c).cast("double") for c in VECTOR]), "seq").alias("last"))
    return pose_moments(kept).join(newest, "camera_id").join(transforms, "camera_id").select("camera_id", "n", "mean", "co", "last", "t")


def updated_stream(poses: DataFrame, first: DataFrame, least_visual: float, z_weight: float = 3.0) -> DataFrame:
    """camera_id, seq, n and t after each measurement of a stream that counts; first holds the states (first_states) that a new query starts from.

    Cameras without a state have no georeference to improve. The session's state store has to be RocksDB's."""
    rows = poses.where(F.col("camera_id").isNotNull()).select(F.col("camera_id").cast("long").alias("camera_id"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in VECTOR])
    return rows.groupBy("camera_id").transformWithStateInPandas(_Update(least_visual, z_weight), "camera_id long, seq long, n long, t array<double>", "append", "None", first.groupBy("camera_id"))
