"""Pinhole cameras and poses as Column expressions.

A pose is a struct of rotation columns r00..r22 (camera to world) and a position; cameras look down.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pi as the elevation angle has it (fixed value).
COARSE_PI = 3.1415


@dataclass(frozen=True)
class Pinhole:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    k1: float = 0.0
    k2: float = 0.0
    p1: float = 0.0
    p2: float = 0.0
    k3: float = 0.0

    def resized(self, factor: float) -> Pinhole:
        """Intrinsics of the image scaled by a factor."""
        if factor <= 0:
            raise ValueError("a camera is scaled by a factor above 0")
        return replace(
            self, fx=self.fx * factor, fy=self.fy * factor, cx=self.cx * factor, cy=self.cy * factor,
            width=round(self.width * factor), height=round(self.height * factor),
        )

    def resized_to(self, width: int, height: int) -> Pinhole:
        factor = width / self.width
        if abs(factor - height / self.height) > 0.1:
            raise ValueError("sides are scaled differently")
        return self.resized(factor)

    def to_image(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Pixel of a point in the camera's frame; NULL behind it."""
        ahead = F.when(z > 0, z)
        return self.fx * x / ahead + self.cx, self.fy * y / ahead + self.cy

    def distorted(self, u: Column, v: Column) -> tuple[Column, Column]:
        """Pixel where the lens shows an ideal pixel (radial and tangential terms)."""
        x, y = (u - self.cx) / self.fx, (v - self.cy) / self.fy
        r2 = x * x + y * y
        radial = 1 + r2 * (self.k1 + r2 * (self.k2 + r2 * self.k3))
        dx = x * radial + 2 * self.p1 * x * y + self.p2 * (r2 + 2 * x * x)
        dy = y * radial + self.p1 * (r2 + 2 * y * y) + 2 * self.p2 * x * y
        return dx * self.fx + self.cx, dy * self.fy + self.cy

    def undistorted(self, u: Column, v: Column, rounds: int = 5) -> tuple[Column, Column]:
        """Ideal pixel of a pixel seen through the lens, by fixed-point rounds."""

        def step(at, _):
            a, b = self.distorted(at["x"], at["y"])
            return F.struct((u - a + at["x"]).alias("x"), (v - b + at["y"]).alias("y"))

        first = F.struct(u.cast("double").alias("x"), v.cast("double").alias("y"))
        got = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
        return got["x"], got["y"]

    def ray(self, u: Column, v: Column, depth: Column) -> tuple[Column, Column, Column]:
        """Point in the camera's frame at a depth; NULL where the depth is not above 0."""
        d = F.when(depth > 0, depth)
        return (u - self.cx) / self.fx * d, (v - self.cy) / self.fy * d, d

    def undistorted_corners(self) -> list[tuple[Column, Column]]:
        """Ideal pixels of the corners of the image as the lens shows it."""
        return [self.undistorted(F.lit(u), F.lit(v)) for u, v in self.corners()]

    def corners(self) -> list[tuple[float, float]]:
        return [(0.0, 0.0), (0.0, float(self.height)), (float(self.width), float(self.height)), (float(self.width), 0.0)]


def heading_rotation(heading: Column) -> list[list[Column]]:
    """Camera-to-world rotation of a downward camera: Rz(-heading) * diag(1, -1, -1)."""
    c, s = F.cos(F.radians(-heading)), F.sin(F.radians(-heading))
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[c, s, zero], [s, -c, zero], [zero, zero, -one]]


def to_world(r: list[list[Column]], t: tuple, p: tuple) -> tuple[Column, ...]:
    """R p + t."""
    return tuple(r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3))


def to_camera(r: list[list[Column]], t: tuple, p: tuple) -> tuple[Column, ...]:
    """R' (p - t)."""
    d = [p[i] - t[i] for i in range(3)]
    return tuple(r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3))


def projection_matrix(camera: Pinhole, r: list[list[Column]], t: tuple) -> list[list[Column]]:
    """K [R' | -R' t] as three rows of four columns."""
    k = ((camera.fx, 0.0, camera.cx), (0.0, camera.fy, camera.cy), (0.0, 0.0, 1.0))
    ext = [[r[j][i] for j in range(3)] + [-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])] for i in range(3)]
    return [[sum((k[i][m] * ext[m][j] for m in range(3) if k[i][m]), F.lit(0.0)) for j in range(4)] for i in range(3)]


def plane_hit(r: list[list[Column]], t: tuple, camera: Pinhole, u: float | Column, v: float | Column, z: Column) -> tuple[Column, Column]:
    """Where the ray of a pixel meets the horizontal plane at height z."""
    d = ((u - camera.cx) / camera.fx, (v - camera.cy) / camera.fy, 1.0)
    w = [r[i][0] * d[0] + r[i][1] * d[1] + r[i][2] * d[2] for i in range(3)]
    scale = (z - t[2]) / F.when(w[2] != 0, w[2])
    return t[0] + w[0] * scale, t[1] + w[1] * scale


def distance(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def elevation_angle(eye: tuple, p: tuple) -> Column:
    """Angle in degrees under which a point is seen, 90 from straight above."""
    v = [eye[i] - p[i] for i in range(3)]
    flat = F.sqrt(v[0] * v[0] + v[1] * v[1])
    full = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.acos(flat / F.when(full > 0, full)) * 180.0 / COARSE_PI


def frame_pose(posed: Column, visual: tuple, default: tuple) -> tuple[Column, ...]:
    """The pose that a frame is used with: the visual one where it is known, else the one of its geotag."""
    return tuple(F.when(posed, v).otherwise(d) for v, d in zip(visual, default, strict=True))
