"""Delaunay triangulation of the valid cells of a lattice, across holes and out to the hull.

Four corners of a square lie on one circle, and so do many other cells, so that what is Delaunay is not unique: circles are
taken a hair out of round, in the same way everywhere (`beyond`), which settles every tie by whole numbers alone.
Then every triangle can be found from the cells around it, wherever the work is cut:

1. Lattice squares with three or four valid corners give their triangles by arithmetic, in blocks with a border of two cells.
   Cells with such triangles all around are done; what is left are the cells at edges of the mask.
2. These are dealt to blocks, with a margin of a quarter of a block, later of half a block. A task holds the cells of one block at a time
   and triangulates them by divide and conquer, and a triangle whose circle lies within block and margin is one of the whole map. Edges that have a triangle on one side only
   (the front) tell which sides of a cell are still open; triangles on a side that is closed are what
   step 1 or a finer round has covered, and are left out.
3. Cells that are still open go on to blocks GROWTH times as wide, until one block holds the map. Only cells at the
   rim of voids as wide as a block are left by then: the last task gets those at the outer hull and the widest voids.

Repeated and null cells count once and not at all; fewer than three cells, or cells on one line, have no triangle.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.blocks import Extent, extent_of
from skylattice.operators.folds import runs
from skylattice.operators.tables import dropped, written

#: Cells a side of the blocks of the first round, and how much wider those of the next are.
SIDE, GROWTH = 64, 4
CORNERS = ("ax", "ay", "bx", "by", "cx", "cy")


def _turn(a, b, c) -> int:
    """Above 0 if c lies left of the way from a to b."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def beyond(a, b, c, d) -> bool:
    """Whether d lies within the circle of a, b, c (counter-clockwise); on it, whether it does once circles are a hair out of round."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    for fa, fb, fc in ((ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy), (ax * ay, bx * by, cx * cy), (ay * ay, by * by, cy * cy)):
        det = fa * (bx * cy - cx * by) - fb * (ax * cy - cx * ay) + fc * (ax * by - bx * ay)
        if det:
            return det > 0
    return False


class _Mesh:
    """Edges of a triangulation: e and e ^ 1 are the two directions of one, after and before its neighbours around its origin."""

    def __init__(self, points: list[tuple[int, int]]) -> None:
        self.p, self.origin, self.after, self.before, self.alive = points, [], [], [], []

    def edge(self, a: int, b: int) -> int:
        e = len(self.origin)
        self.origin += [a, b]
        self.after += [e, e + 1]
        self.before += [e, e + 1]
        self.alive += [True, True]
        return e

    def splice(self, a: int, b: int) -> None:
        x, y = self.after[a], self.after[b]
        self.after[a], self.after[b] = y, x
        self.before[y], self.before[x] = a, b

    def connect(self, a: int, b: int) -> int:
        """An edge from the end of a to the origin of b, with a, b and itself around one face."""
        e = self.edge(self.origin[a ^ 1], self.origin[b])
        self.splice(e, self.before[a ^ 1])
        self.splice(e ^ 1, b)
        return e

    def remove(self, e: int) -> None:
        self.splice(e, self.before[e])
        self.splice(e ^ 1, self.before[e ^ 1])
        self.alive[e] = self.alive[e ^ 1] = False

    def left_of(self, k: int, e: int) -> bool:
        return _turn(self.p[self.origin[e]], self.p[self.origin[e ^ 1]], self.p[k]) > 0

    def right_of(self, k: int, e: int) -> bool:
        return _turn(self.p[self.origin[e ^ 1]], self.p[self.origin[e]], self.p[k]) > 0

    def within(self, a: int, b: int, c: int, d: int) -> bool:
        return beyond(self.p[a], self.p[b], self.p[c], self.p[d])

    def build(self, low: int, high: int) -> tuple[int, int]:
        """Triangulate the points low .. high - 1 (sorted); the outer edges from the leftmost and to the rightmost."""
        o = self.origin
        if high - low == 2:
            e = self.edge(low, low + 1)
            return e, e ^ 1
        if high - low == 3:
            a, b = self.edge(low, low + 1), self.edge(low + 1, low + 2)
            self.splice(a ^ 1, b)
            side = _turn(self.p[low], self.p[low + 1], self.p[low + 2])
            if side > 0:
                self.connect(b, a)
            elif side < 0:
                c = self.connect(b, a)
                return c ^ 1, c
            return a, b ^ 1
        middle = (low + high) // 2
        left_out, left = self.build(low, middle)
        right, right_out = self.build(middle, high)
        while True:  # down to the lower common tangent
            if self.left_of(o[right], left):
                left = self.before[left ^ 1]
            elif self.right_of(o[left], right):
                right = self.after[right ^ 1]
            else:
                break
        base = self.connect(right ^ 1, left)
        if o[left] == o[left_out]:
            left_out = base ^ 1
        if o[right] == o[right_out]:
            right_out = base
        while True:  # and up, stitch by stitch
            a, b = self.after[base ^ 1], self.before[base]
            if self.right_of(o[a ^ 1], base):
                while self.right_of(o[self.after[a] ^ 1], base) and self.within(o[base ^ 1], o[base], o[a ^ 1], o[self.after[a] ^ 1]):
                    a, gone = self.after[a], a
                    self.remove(gone)
            if self.right_of(o[b ^ 1], base):
                while self.right_of(o[self.before[b] ^ 1], base) and self.within(o[base ^ 1], o[base], o[b ^ 1], o[self.before[b] ^ 1]):
                    b, gone = self.before[b], b
                    self.remove(gone)
            on_left, on_right = self.right_of(o[a ^ 1], base), self.right_of(o[b ^ 1], base)
            if not on_left and not on_right:
                return left_out, right_out
            if not on_left or (on_right and self.within(o[a ^ 1], o[a], o[b], o[b ^ 1])):
                base = self.connect(b, base ^ 1)
            else:
                base = self.connect(base ^ 1, a ^ 1)

    def triangles(self):
        """Every triangle as three point numbers, counter-clockwise."""
        for e, alive in enumerate(self.alive):
            if alive:
                f = self.before[e ^ 1]
                g = self.before[f ^ 1]
                if e < f and e < g and self.before[g ^ 1] == e and self.left_of(self.origin[g], e):
                    yield self.origin[e], self.origin[f], self.origin[g]


def triangulate(points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of sorted distinct points of whole numbers."""
    if len(points) < 3:
        return []
    mesh = _Mesh(points)
    mesh.build(0, len(points))
    return list(mesh.triangles())


def _reach(a, b, c, extent: Extent) -> tuple[float, float, float, float]:
    """A rectangle around the part of the circle of three cells that lies in the extent."""
    d = 2 * _turn(a, b, c)
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    r = math.hypot(ux, uy) * (1 + 1e-9) + 1e-6
    ux, uy = ux + a[0], uy + a[1]
    x0, x1, y0, y1 = extent.x, extent.x + extent.width - 1, extent.y, extent.y + extent.height - 1
    for _ in range(3):  # where the disc leaves the rectangle, it is narrower within
        near = min(max(uy, y0), y1) - uy
        half = math.sqrt(max(r * r - near * near, 0))
        x0, x1 = max(x0, ux - half), min(x1, ux + half)
        near = min(max(ux, x0), x1) - ux
        half = math.sqrt(max(r * r - near * near, 0))
        y0, y1 = max(y0, uy - half), min(y1, uy + half)
    return x0, y0, x1, y1


def _open_sides(x, y, outs, ins) -> tuple[list, list, list]:
    """Angles around each cell where front edges leave (outs) and come in (ins), whether what follows is still open, and where each cell's begin."""
    cell, angle, opens = [], [], []
    for ends, is_open in ((outs, False), (ins, True)):
        at = np.repeat(np.arange(len(x)), np.diff(ends.offsets.to_numpy()))
        flat = ends.flatten()
        cell.append(at)
        angle.append(np.arctan2(flat.field("y").to_numpy() - y[at], flat.field("x").to_numpy() - x[at]))
        opens.append(np.full(len(at), is_open))
    cell, angle, opens = np.concatenate(cell), np.concatenate(angle), np.concatenate(opens)
    order = np.lexsort((opens, angle, cell))
    return angle[order].tolist(), opens[order].tolist(), np.searchsorted(cell[order], np.arange(len(x) + 1)).tolist()


def _is_open(k, at, p, q, sides) -> bool:
    """Whether the side of cell k between two others (counter-clockwise) has no triangle yet."""
    angles, opens, starts = sides
    low, high = starts[k], starts[k + 1]
    if low == high:
        return True
    first = math.atan2(p[1] - at[1], p[0] - at[0])
    wide = math.atan2(_turn(at, p, q), (p[0] - at[0]) * (q[0] - at[0]) + (p[1] - at[1]) * (q[1] - at[1]))
    middle = first + wide / 2
    if middle > math.pi:
        middle -= 2 * math.pi
    before = bisect.bisect_right(angles, middle, low, high) - 1
    return opens[before if before >= low else high - 1]


def _block_triangles(cells: pa.Table, tx: int, ty: int, side: int, margin: int, extent: Extent, last: bool) -> list[tuple]:
    """Triangles of the map that a block finds in its cells (x, y, outs, ins, in order) and margin, and that no other block or earlier round does."""
    x, y = (cells.column(c).to_numpy() for c in ("x", "y"))
    points = list(zip(x.tolist(), y.tolist(), strict=True))
    sides = _open_sides(x, y, *[cells.column(c).combine_chunks() for c in ("outs", "ins")])
    x0, y0 = tx * side, ty * side
    out = []
    for i, j, k in triangulate(points):
        a, b, c = points[i], points[j], points[k]
        if not last:
            left, low, right, top = _reach(a, b, c, extent)
            if left < x0 - margin or low < y0 - margin or right > x0 + side + margin - 1 or top > y0 + side + margin - 1:
                continue
            if math.floor((left + right) / 2 / side) != tx or math.floor((low + top) / 2 / side) != ty:
                continue
        if _is_open(i, a, b, c, sides) and _is_open(j, b, c, a, sides) and _is_open(k, c, a, b, sides):
            out.append((*a, *b, *c))
    return out


def _unpaired(ox, oy, px, py) -> np.ndarray:
    """Which directed edges don't have their other direction beside them."""
    back = (ox > px) | ((ox == px) & (oy > py))
    keys = [np.where(back, a, b) for a, b in ((oy, py), (ox, px), (py, oy), (px, ox))]
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    alone = np.ones(len(order), bool)
    alone[order[1:][same]] = alone[order[:-1][same]] = False
    return alone


#: Triangles of a lattice square by its valid corners, bits 1 (0, 0), 2 (1, 0), 4 (0, 1) and 8 (1, 1).
_FULL = [((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))] if beyond((0, 0), (1, 0), (0, 1), (1, 1)) else [((0, 0), (1, 0), (0, 1)), ((1, 0), (1, 1), (0, 1))]
_KINDS = {15: _FULL, 7: [((0, 0), (1, 0), (0, 1))], 11: [((0, 0), (1, 0), (1, 1))], 13: [((0, 0), (1, 1), (0, 1))], 14: [((1, 0), (1, 1), (0, 1))]}


def _block_squares(x: np.ndarray, y: np.ndarray, x0: int, y0: int, side: int):
    """Of the squares of a block, whose cells and border are given: triangles (ax .. cy), front edges (ox, oy, px, py), and cells (x, y) without a triangle."""
    valid = np.zeros((side + 3, side + 3), np.int64)
    valid[x - x0 + 1, y - y0 + 1] = 1
    kinds = valid[:-1, :-1] + 2 * valid[1:, :-1] + 4 * valid[:-1, 1:] + 8 * valid[1:, 1:]
    found = []
    for kind, shapes in _KINDS.items():
        i, j = np.nonzero(kinds == kind)
        for shape in shapes:
            found.append(np.stack([v for dx, dy in shape for v in (i + dx + x0 - 1, j + dy + y0 - 1)] + [(i > 0) & (i <= side) & (j > 0) & (j <= side)]))
    all_, own = (lambda f: (f[:6], f[6].astype(bool)))(np.concatenate(found, 1))
    edges = np.concatenate([np.stack([all_[2 * k], all_[2 * k + 1], all_[(2 * k + 2) % 6], all_[(2 * k + 3) % 6]]) for k in range(3)], 1)
    front = edges[:, _unpaired(*edges) & np.tile(own, 3)]
    some = np.isin(kinds, list(_KINDS))
    lone = (valid[1:-2, 1:-2] == 1) & ~(some[:-1, :-1] | some[1:, :-1] | some[:-1, 1:] | some[1:, 1:])[:side, :side]
    i, j = np.nonzero(lone)
    return all_[:, own], front, np.stack([i + x0, j + y0])


def _squares(cells: DataFrame, side: int) -> DataFrame:
    """Triangles of the lattice squares that have three or four valid corners (kind 0), the edges around them (kind 1: a to b) and cells without any (kind 2: a)."""
    blocks = lambda c: F.sequence(F.floor((F.col(c) - 2) / side), F.floor((F.col(c) + 1) / side))
    dealt = cells.select(F.explode(blocks("x")).alias("tx"), "x", "y").select("tx", F.explode(blocks("y")).alias("ty"), "x", "y")

    def run(batches):
        for (tx, ty), block in runs(batches, 2):
            x, y = (block.column(c).to_numpy() for c in ("x", "y"))
            for kind, found in enumerate(_block_squares(x, y, tx * side, ty * side, side)):
                n = found.shape[1]
                if n:
                    yield pa.record_batch([pa.array(np.full(n, kind, np.int32)), *[pa.array(c) for c in found], *[pa.nulls(n, pa.int64())] * (6 - len(found))], ["kind", *CORNERS])

    return dealt.repartition("tx", "ty").sortWithinPartitions("tx", "ty").mapInArrow(run, "kind int, " + ", ".join(f"{c} long" for c in CORNERS))


def _edges(triangles: DataFrame) -> DataFrame:
    """The directed edges (ox, oy, px, py) around triangles, which lie to their left; most of those with both directions are left out, as they meet within a batch."""

    def run(batches):
        for b in batches:
            t = [b.column(k).to_numpy() for k in range(6)]
            edges = [np.concatenate([t[(2 * k + c) % 6] for k in range(3)]) for c in range(4)]
            alone = _unpaired(*edges)
            yield pa.record_batch([pa.array(e[alone]) for e in edges], ["ox", "oy", "px", "py"])

    return triangles.select(*CORNERS).mapInArrow(run, "ox long, oy long, px long, py long")


def _front(edges: DataFrame) -> DataFrame:
    """The edges without their other direction."""
    back = (F.col("ox") > F.col("px")) | ((F.col("ox") == F.col("px")) & (F.col("oy") > F.col("py")))
    low = edges.select(back.alias("back"), *[F.when(back, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("px", "ox", "lx"), ("py", "oy", "ly"), ("ox", "px", "hx"), ("oy", "py", "hy"))])
    once = low.groupBy("lx", "ly", "hx", "hy").agg(F.count(F.lit(1)).alias("n"), F.first("back").alias("back")).where("n = 1")
    return once.select(*[F.when(F.col("back"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("hx", "lx", "ox"), ("hy", "ly", "oy"), ("lx", "hx", "px"), ("ly", "hy", "py"))])


def _open_cells(front: DataFrame, alone: DataFrame, extent: Extent) -> DataFrame:
    """Cells (x, y) with an open side, and the other ends of the front edges from (outs) and to them (ins). Beyond the extent's own edges nothing is open."""
    right, top = extent.x + extent.width - 1, extent.y + extent.height - 1
    rim = [(F.col(o) == z) & (F.col(p) == z) for o, p, z in (("ox", "px", extent.x), ("ox", "px", right), ("oy", "py", extent.y), ("oy", "py", top))]
    inner = ~(rim[0] | rim[1] | rim[2] | rim[3])
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    none = F.lit(None).cast("struct<x:bigint,y:bigint>")
    leaving = front.select(F.col("ox").alias("x"), F.col("oy").alias("y"), end("px", "py").alias("out"), none.alias("in"), inner.alias("inner"))
    coming = front.select(F.col("px").alias("x"), F.col("py").alias("y"), none.alias("out"), end("ox", "oy").alias("in"), inner.alias("inner"))
    lone = alone.select("x", "y", none.alias("out"), none.alias("in"), F.lit(True).alias("inner"))
    ends = leaving.unionByName(coming).unionByName(lone).groupBy("x", "y").agg(F.collect_list("out").alias("outs"), F.collect_list("in").alias("ins"), F.max("inner").alias("open"))
    return ends.where("open").drop("open")


def _round(cells: DataFrame, side: int, margin: int, extent: Extent, last: bool) -> DataFrame:
    """New triangles of the open cells, by blocks of a side and their margin; a task sees its blocks one after another."""
    within = lambda at, n, value: F.greatest(F.lit(at // side), F.least(F.lit((at + n - 1) // side), value)).cast("long")
    blocks = lambda c, at, n: F.sequence(*[within(at, n, F.floor((F.col(c) + far) / side)) for far in (-margin, margin)])
    if last:
        dealt = cells.select(F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), "x", "y", "outs", "ins")
    else:
        wide = cells.select(F.explode(blocks("x", extent.x, extent.width)).alias("tx"), "x", "y", "outs", "ins")
        dealt = wide.select("tx", F.explode(blocks("y", extent.y, extent.height)).alias("ty"), "x", "y", "outs", "ins")

    def run(batches):
        for (tx, ty), block in runs(batches, 2):
            found = _block_triangles(block, tx, ty, side, margin, extent, last)
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], list(CORNERS))

    return dealt.repartition("tx", "ty").sortWithinPartitions("tx", "ty", "x", "y").mapInArrow(run, ", ".join(f"{c} long" for c in CORNERS))


def delaunay(cells: DataFrame, x: str = "gx", y: str = "gy", side: int = SIDE) -> DataFrame:
    """The triangles (ax, ay, bx, by, cx, cy, counter-clockwise) of all cells of a table."""
    valid = written(cells.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).dropna(), "delaunay-cells")
    extent = extent_of(valid, "x", "y")
    squares = written(_squares(valid, side), "delaunay-triangles")
    rounds = [squares.where("kind = 0").select(*CORNERS)]
    front = squares.where("kind = 1").select(*[F.col(a).alias(b) for a, b in zip(CORNERS, ("ox", "oy", "px", "py"), strict=False)])
    alone = squares.where("kind = 2").select(F.col("ax").alias("x"), F.col("ay").alias("y"))
    touched = lambda t: t.select(F.inline(F.array(*[F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y")) for c in "abc"])))
    dropped(valid)
    old = []
    margin = side // 4  # voids are small at first, and cells in margins are dealt more than once
    while True:
        open_cells = written(_open_cells(front, alone, extent), "delaunay-open")
        last = side >= max(extent.width, extent.height)
        if open_cells.isEmpty():
            dropped(open_cells)
            break
        found = written(_round(open_cells, side, margin, extent, last), "delaunay-triangles")
        rounds.append(found)
        dropped(open_cells)
        if last:
            break
        newer = written(_front(front.unionByName(_edges(found))), "delaunay-front")
        left = written(alone.join(touched(found).join(alone, ["x", "y"], "left_semi").distinct(), ["x", "y"], "left_anti"), "delaunay-alone")
        dropped(*old)
        front, alone, side, margin = newer, left, side * GROWTH, side * GROWTH // 2
        old = [front, alone]
    dropped(*old)
    out = rounds[0]
    for t in rounds[1:]:
        out = out.unionByName(t)
    return out.select(*CORNERS)


def raised(triangles: DataFrame, cells: DataFrame, layer: str, x: str = "gx", y: str = "gy") -> DataFrame:
    """Triangles with a layer's value at each corner (az, bz, cz): corners are looked up by one join and put together again."""
    corner = lambda c: F.struct(F.lit(c).alias("corner"), F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y"))
    each = triangles.select(*CORNERS, F.inline(F.array(*[corner(c) for c in "abc"])))
    known = cells.where(F.col(layer).isNotNull()).select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(layer).alias("z"))
    z = lambda c: F.max(F.when(F.col("corner") == c, F.col("z"))).alias(f"{c}z")
    return each.join(known, ["x", "y"]).groupBy(*CORNERS).agg(*[z(c) for c in "abc"])


def counted(triangles: DataFrame) -> DataFrame:
    """One row: n_triangles, n_hull (edges of the hull, which are as many as its cells) and area2, twice the area."""
    twice = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    whole = triangles.agg(F.count(F.lit(1)).alias("n_triangles"), F.coalesce(F.sum(twice), F.lit(0)).alias("area2"))
    return whole.crossJoin(_front(_edges(triangles)).agg(F.count(F.lit(1)).alias("n_hull")))  # a row and a row
