"""Lattice arithmetic as Column expressions: snapping, indices, positions, rectangles.

A grid is a rectangle (x0, y0, width, height) sampled every res metres. Row 0 is its north edge.
Absent data are NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a remainder or an area counts as zero.
EPSILON = 1e-5


def snap(v: Column, res: float) -> Column:
    """The next multiple of res that isn't below v; values within EPSILON of a multiple stay."""
    rest = v % F.lit(float(res))
    up = F.when(rest < 0, -rest).otherwise(F.lit(float(res)) - rest)
    return F.when(F.abs(rest) < EPSILON, v).otherwise(v + up)


@dataclass(frozen=True)
class GridSpec:
    """Geometry of a grid; columns of it are expressions, so it may also stand for many grids."""

    x0: float
    y0: float
    width: float
    height: float
    res: float

    @property
    def cols(self) -> int:
        return round(self.width / self.res) + 1

    @property
    def rows(self) -> int:
        return round(self.height / self.res) + 1

    def inside(self, x: Column, y: Column) -> Column:
        """Whether a position lies in the grid, half a cell around it included."""
        half = self.res / 2
        return x.between(self.x0 - half, self.x0 + self.width + half) & y.between(self.y0 - half, self.y0 + self.height + half)

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(column, row) of a position."""
        col = F.round((snap(x, self.res) - self.x0) / self.res)
        row = F.round((self.y0 + self.height - snap(y, self.res)) / self.res)
        return col.cast("int"), row.cast("int")

    def position(self, col: Column, row: Column) -> tuple[Column, Column]:
        """World position of a (column, row)."""
        return self.x0 + col * self.res, self.y0 + self.height - row * self.res


def snapped_size(extent: Column, res: float) -> Column:
    """Samples along a snapped side of a rectangle."""
    return (F.round(snap(extent, res) / res) + 1).cast("int")


def intersection_area(a: tuple, b: tuple) -> Column:
    """Area shared by two rectangles (x, y, width, height)."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def contains(a: tuple, b: tuple) -> Column:
    """Whether rectangle a holds all of b."""
    return F.abs(intersection_area(a, b) - b[2] * b[3]) < EPSILON
