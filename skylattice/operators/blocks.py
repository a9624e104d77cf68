"""Dense rasters as blocks: a row holds SIDE x SIDE cells of every layer, in arrays.

A block table has the columns of `by` (a frame, or nothing for one map), tx, ty and one array<double> a
layer, row after row; the cell (gx, gy) is in block (gx div SIDE, gy div SIDE), and an empty cell is null.
Blocks without any value are left out. Cells of a raster lie at whole numbers gx, gy; its extent is the
rectangle of cells that it may have.

Images are resampled by gathering. A target block says which cells of which source blocks its places fall
on; those are joined, cut out, dealt to the target and put together to a window there, so a task holds
one target block and what it looks at, and only cut-outs are moved to targets. Areas go the other way: a source block sends
its sums to the few target blocks that it covers, added up within a task first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a side of a block, a power of two.
SIDE = 64
_BITS = SIDE.bit_length() - 1
#: Steepness of the cubic kernel (fixed value).
CUBIC = -0.75
#: Taps of each kernel, from the cell at or below a place.
TAPS = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2)}
#: Rows of blocks that go out of a task together, and target blocks whose sums it adds up.
ROWS, SUMMED = 32, 64


@dataclass(frozen=True)
class Extent:
    """Cells x .. x + width - 1 and y .. y + height - 1."""

    x: int
    y: int
    width: int
    height: int

    def resized(self, width: int, height: int) -> Extent:
        """The extent with another number of cells, from its own corner on. Both sides must change alike."""
        across, down = ((n - 1) / (m - 1) if m > 1 else float(n == 1) for n, m in ((width, self.width), (height, self.height)))
        if abs(across - down) > 1e-5:
            raise ValueError("sides are scaled differently")
        return Extent(self.x, self.y, width, height)


def extent_of(cells: DataFrame, x: str = "gx", y: str = "gy") -> Extent:
    """The smallest extent that holds all cells; one row comes to the driver."""
    r = cells.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return Extent(0, 0, 0, 0) if r[0] is None else Extent(r[0], r[1], r[2] - r[0] + 1, r[3] - r[1] + 1)


def _lists(flat: np.ndarray, sizes) -> pa.ListArray:
    """A list column of values one after another; NaN is null."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def _values(column) -> np.ndarray:
    """The values of a list column one after another; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _schema(df: DataFrame, names, more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in names], more])


def to_blocks(cells: DataFrame, layers: list[str], by: tuple[str, ...] = (), x: str = "gx", y: str = "gy") -> DataFrame:
    """Blocks of a table with a row a cell; a cell has one row."""
    low = lambda c: F.col(c).bitwiseAND(SIDE - 1)
    place = (low(y) * SIDE + low(x)).cast("int")
    item = F.struct(place.alias("place"), *[F.col(c).cast("double").alias(f"l{k}") for k, c in enumerate(layers)])
    rows = cells.groupBy(*by, F.shiftright(x, _BITS).cast("long").alias("tx"), F.shiftright(y, _BITS).cast("long").alias("ty")).agg(F.collect_list(item).alias("cells"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                lists = b.column(b.schema.get_field_index("cells"))
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                items = lists.flatten()
                flat = row * SIDE * SIDE + items.field("place").to_numpy()
                out = []
                for k in range(len(layers)):
                    values = np.full(b.num_rows * SIDE * SIDE, np.nan)
                    values[flat] = items.field(f"l{k}").to_numpy(zero_copy_only=False)
                    out.append(_lists(values, [SIDE * SIDE] * b.num_rows))
                yield pa.record_batch([*b.columns[:-1], *out], [*b.schema.names[:-1], *layers])

    return rows.mapInArrow(run, _schema(rows, [*by, "tx", "ty"], ", ".join(f"`{c}` array<double>" for c in layers)))


def to_cells(blocks: DataFrame, layers: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The cells of blocks that have a value in any layer, a row each."""
    zipped = F.posexplode(F.arrays_zip(*layers)).alias("place", "v")
    cell = blocks.select(*by, "tx", "ty", zipped).where(F.greatest(*[F.col("v")[c].isNotNull() for c in layers]) if len(layers) > 1 else F.col("v")[layers[0]].isNotNull())
    gx, gy = F.col("tx") * SIDE + F.col("place").bitwiseAND(SIDE - 1), F.col("ty") * SIDE + F.shiftright("place", _BITS)
    return cell.select(*by, gx.alias("gx"), gy.alias("gy"), *[F.col("v")[c].alias(c) for c in layers])


def target_blocks(rows: DataFrame, extent: Extent) -> DataFrame:
    """rows, each once for every block (tx, ty) of an extent."""
    span = lambda at, n: F.explode(F.sequence(F.lit(at >> _BITS).cast("long"), F.lit((at + n - 1) >> _BITS).cast("long")))
    if not extent.width or not extent.height:
        return rows.withColumns({"tx": F.lit(0).cast("long"), "ty": F.lit(0).cast("long")}).limit(0)
    return rows.withColumn("tx", span(extent.x, extent.width)).withColumn("ty", span(extent.y, extent.height))


def _places(tx: int, ty: int, extent: Extent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of a block's cells, and which of them are in the extent."""
    y, x = np.divmod(np.arange(SIDE * SIDE), SIDE)
    x, y = x + tx * SIDE, y + ty * SIDE
    return x.astype(np.float64), y.astype(np.float64), (x >= extent.x) & (x < extent.x + extent.width) & (y >= extent.y) & (y < extent.y + extent.height)


def _kernel(f: np.ndarray, kernel: str) -> list[np.ndarray]:
    """Weights of the taps of a place that is f beyond a cell."""
    if kernel == "nearest":
        return [np.ones_like(f)]
    if kernel == "bilinear":
        return [1 - f, f]
    a, g = CUBIC, 1 - f
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(1 + f), near(f), near(g), far(1 + g)]


def _base(u: np.ndarray, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """The cell that a place's taps are counted from, and how far beyond it the place is."""
    at = np.floor(u + 0.5) if kernel == "nearest" else np.floor(u)
    return at, u - at


def sampled(window: np.ndarray, x0: int, y0: int, u: np.ndarray, v: np.ndarray, kernel: str, extent: Extent, border: str, holes: str) -> np.ndarray:
    """Values of a window, whose first cell is (x0, y0), at places; NaN where there is none.

    border: taps beyond the extent take its edge ("edge") or are empty ("empty"). holes: a place is empty if
    any of its taps is ("spread"), or, where the nearest cell has a value, takes the taps that have one ("skip";
    a cubic place with an empty tap becomes bilinear)."""
    bx, fx = _base(u, kernel)
    by, fy = _base(v, kernel)
    total, weight, empty = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u), bool)
    first = TAPS[kernel][0]

    def at(ix, iy):
        out = (ix < extent.x) | (ix >= extent.x + extent.width) | (iy < extent.y) | (iy >= extent.y + extent.height)
        if border == "edge":
            ix, iy = np.clip(ix, extent.x, extent.x + extent.width - 1), np.clip(iy, extent.y, extent.y + extent.height - 1)
        jx, jy = ix - x0, iy - y0
        known = (jx >= 0) & (jx < window.shape[1]) & (jy >= 0) & (jy < window.shape[0])
        if border == "empty":
            known &= ~out
        return np.where(known, window[np.where(known, jy, 0).astype(np.int64), np.where(known, jx, 0).astype(np.int64)], np.nan)

    for j, wy in enumerate(_kernel(fy, kernel)):
        for i, wx in enumerate(_kernel(fx, kernel)):
            w = wx * wy
            value = at(bx + first + i, by + first + j)
            there = ~np.isnan(value)
            total += np.where(there, w * np.where(there, value, 0), 0)
            weight += np.where(there, w, 0)
            empty |= ~there & (w != 0)
    if holes == "spread" or kernel == "nearest":
        return np.where(empty, np.nan, total)
    own = ~np.isnan(at(np.floor(u + 0.5), np.floor(v + 0.5)))
    if kernel == "cubic":
        out = np.where(empty, np.nan, total)
        some = np.flatnonzero(empty & own)
        if len(some):
            out[some] = sampled(window, x0, y0, u[some], v[some], "bilinear", extent, border, holes)
        return out
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(own & (weight > 1e-9), np.where(empty, total / weight, total), np.nan)


#: Source places (u, v) of target cells (x, y), given the target's row.
Inverse = Callable[[np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray]]


def resampled(
    blocks: DataFrame, layers: list[str], targets: DataFrame, inverse: Inverse, source: Extent, target: Extent, kernel: str = "bilinear", border: str = "empty", holes: str = "spread", by: tuple[str, ...] = (), keep: tuple[str, ...] = (),
) -> DataFrame:
    """Blocks (by, keep, tx, ty, layers) of the targets: each cell takes the source at the place that the inverse map gives.

    targets: by, tx, ty, and in columns keep what the inverse map needs. by names the source; keep tells targets of one source apart."""
    names = [*by, *keep, "tx", "ty"]
    low, high = TAPS[kernel]

    def places(row: dict):
        x, y, inside = _places(row["tx"], row["ty"], target)
        u, v = inverse(x, y, row)
        inside = inside & np.isfinite(u) & np.isfinite(v)
        if border == "empty":  # nothing beyond a cell outside
            inside &= (u > source.x - 1) & (u < source.x + source.width) & (v > source.y - 1) & (v < source.y + source.height)
        return np.where(inside, u, source.x), np.where(inside, v, source.y), inside

    def wanted(batches):
        for b in batches:
            rows, boxes = [], []
            for i, row in enumerate(b.to_pylist()):
                u, v, inside = places(row)
                if not inside.any() or not source.width or not source.height:
                    continue
                u, v = _base(u[inside], kernel)[0], _base(v[inside], kernel)[0]
                x0, x1 = (int(np.clip(z, source.x, source.x + source.width - 1)) for z in (u.min() + low, u.max() + high))
                y0, y1 = (int(np.clip(z, source.y, source.y + source.height - 1)) for z in (v.min() + low, v.max() + high))
                if holes == "skip" or border == "edge":
                    x0, y0, x1, y1 = max(source.x, x0 - 1), max(source.y, y0 - 1), min(source.x + source.width - 1, x1 + 1), min(source.y + source.height - 1, y1 + 1)
                for sy in range(y0 >> _BITS, (y1 >> _BITS) + 1):
                    for sx in range(x0 >> _BITS, (x1 >> _BITS) + 1):
                        rows.append(i)
                        boxes.append((sx, sy, max(x0, sx * SIDE), max(y0, sy * SIDE), min(x1, sx * SIDE + SIDE - 1), min(y1, sy * SIDE + SIDE - 1)))
            found = b.take(pa.array(rows, pa.int64()))
            cols = list(zip(*boxes, strict=True)) or [[]] * 6
            yield pa.record_batch([*found.columns, *[pa.array(c, pa.int64()) for c in cols]], [*found.schema.names, "s_x", "s_y", "x0", "y0", "x1", "y1"])

    asked = targets.select(*names).mapInArrow(wanted, _schema(targets, names, ", ".join(f"{c} long" for c in ("s_x", "s_y", "x0", "y0", "x1", "y1"))))
    on = [F.col("s_x") == F.col("b_tx"), F.col("s_y") == F.col("b_ty"), *[F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in by]]
    held = blocks.select(*[F.col(c).alias(f"b_{c}") for c in (*by, "tx", "ty")], *[F.col(c).alias(f"v{k}") for k, c in enumerate(layers)])
    pairs = asked.join(held, on).select(*names, "x0", "y0", "x1", "y1", *[f"v{k}" for k in range(len(layers))])
    box = "x0 long, y0 long, x1 long, y1 long, "

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x0, y0, x1, y1 = (b.column(len(names) + k).to_numpy() for k in range(4))
                rect = [(slice(a & (SIDE - 1), (c & (SIDE - 1)) + 1), slice(d & (SIDE - 1), (e & (SIDE - 1)) + 1)) for a, c, d, e in zip(y0, y1, x0, x1, strict=True)]
                out = []
                for k in range(len(layers)):
                    tiles = _values(b.column(len(names) + 4 + k)).reshape(-1, SIDE, SIDE)
                    parts = [t[r].ravel() for t, r in zip(tiles, rect, strict=True)]
                    out.append(_lists(np.concatenate(parts) if parts else np.zeros(0), [len(p) for p in parts]))
                yield pa.record_batch([*b.columns[: len(names) + 4], *out], b.schema.names)

    pieces = pairs.mapInArrow(cut, _schema(pairs, names, box + ", ".join(f"v{k} array<double>" for k in range(len(layers)))))
    grouped = pieces.groupBy(*names).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", *[f"v{k}" for k in range(len(layers))])).alias("pieces"))

    def put_together(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                lists = b.column(len(names))
                ends, items = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
                boxes = np.stack([items.field(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], 1)
                values = [items.field(f"v{k}") for k in range(len(layers))]
                starts = [np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))]) for x in values]
                flat = [_values(x) for x in values]
                out = [[] for _ in layers]
                for i, row in enumerate(b.select(names).to_pylist()):
                    own = boxes[ends[i] : ends[i + 1]]
                    (x0, y0), (x1, y1) = own[:, :2].min(0), own[:, 2:].max(0)
                    u, v, inside = places(row)
                    for k in range(len(layers)):
                        window = np.full((y1 - y0 + 1, x1 - x0 + 1), np.nan)
                        for j in range(ends[i], ends[i + 1]):
                            a, c, d, e = boxes[j]
                            window[c - y0 : e - y0 + 1, a - x0 : d - x0 + 1] = flat[k][starts[k][j] : starts[k][j + 1]].reshape(e - c + 1, d - a + 1)
                        out[k].append(np.where(inside, sampled(window, int(x0), int(y0), u, v, kernel, source, border, holes), np.nan))
                full = np.array([any(not np.isnan(o[i]).all() for o in out) for i in range(b.num_rows)], bool)
                done = pa.record_batch([*b.columns[:-1], *[_lists(np.concatenate(o), [SIDE * SIDE] * len(o)) for o in out]], [*names, *layers])
                yield done.filter(pa.array(full))

    return grouped.mapInArrow(put_together, _schema(grouped, names, ", ".join(f"`{c}` array<double>" for c in layers)))


def changed_size(blocks: DataFrame, layers: list[str], source: Extent, target: Extent, kernel: str = "cubic", by: tuple[str, ...] = (), holes: str = "spread") -> DataFrame:
    """A raster with another number of cells over the same ground: cell edges meet at the raster's edges, and taps beyond them take the edge."""
    if kernel == "area":
        return shrunk(blocks, layers, source, target, by)
    sx, sy = source.width / max(1, target.width), source.height / max(1, target.height)

    def inverse(x, y, _):
        return (x - target.x + 0.5) * sx - 0.5 + source.x, (y - target.y + 0.5) * sy - 0.5 + source.y

    rows = blocks.select(*by).distinct() if by else blocks.sparkSession.range(1).select()
    return resampled(blocks, layers, target_blocks(rows, target), inverse, source, target, kernel, "edge", holes, by)


def _shares(at: int, source_at: int, source_n: int, target_at: int, target_n: int) -> tuple[int, np.ndarray]:
    """The first target cell that a block's cells from at on lie on, and what share each of them (columns) has of each target cell (rows)."""
    scale = source_n / target_n
    edges = np.clip(np.arange(at, at + SIDE + 1) - source_at, 0, source_n).astype(np.float64)
    first, last = int(edges[0] / scale), max(int(edges[0] / scale), int(np.ceil(edges[-1] / scale)) - 1)
    cells = np.arange(first, min(last, target_n - 1) + 1)[:, None]
    over = np.minimum(edges[None, 1:], (cells + 1) * scale) - np.maximum(edges[None, :-1], cells * scale)
    return first + target_at, np.maximum(over, 0)


def shrunk(blocks: DataFrame, layers: list[str], source: Extent, target: Extent, by: tuple[str, ...] = ()) -> DataFrame:
    """A raster of fewer cells over the same ground: each is the mean of the source by area, of the part that has values."""
    if target.width > source.width or target.height > source.height:
        raise ValueError("an area mean takes fewer cells than there are")
    names = [*by, "tx", "ty"]

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            keys, tables = list(held), list(held.values())
            held.clear()
            cols = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            return pa.record_batch([*cols, pa.array([t.ravel().tolist() for t in tables], pa.list_(pa.float64()))], [*names, "sums"])

        kinds: list = []
        for b in batches:
            kinds = [b.schema.field(c).type for c in names]
            tiles = [_values(b.column(len(names) + k)).reshape(-1, SIDE, SIDE) for k in range(len(layers))]
            for i, row in enumerate(b.select(names).to_pylist()):
                x0, across = _shares(row["tx"] * SIDE, source.x, source.width, target.x, target.width)
                y0, down = _shares(row["ty"] * SIDE, source.y, source.height, target.y, target.height)
                for k in range(len(layers)):
                    there = ~np.isnan(tiles[k][i])
                    got = np.stack([down @ np.where(there, tiles[k][i], 0) @ across.T, down @ there.astype(np.float64) @ across.T])
                    for ty in range(y0 >> _BITS, ((y0 + got.shape[1] - 1) >> _BITS) + 1):
                        for tx in range(x0 >> _BITS, ((x0 + got.shape[2] - 1) >> _BITS) + 1):
                            ys, xs = slice(max(y0, ty * SIDE) - y0, min(y0 + got.shape[1], ty * SIDE + SIDE) - y0), slice(max(x0, tx * SIDE) - x0, min(x0 + got.shape[2], tx * SIDE + SIDE) - x0)
                            part = got[:, ys, xs]
                            if part.size and part[1].any():
                                table = held.setdefault((*[row[c] for c in by], tx, ty), np.zeros((len(layers), 2, SIDE, SIDE)))
                                top, left = ys.start + y0 - ty * SIDE, xs.start + x0 - tx * SIDE
                                table[k, :, top : top + part.shape[1], left : left + part.shape[2]] += part
                if len(held) >= SUMMED:
                    yield out()
        if held:
            yield out()

    parts = blocks.select(*names, *layers).mapInArrow(sums, _schema(blocks, names, "sums array<double>"))
    lists = parts.groupBy(*names).agg(F.collect_list("sums").alias("sums"))

    def means(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                tables = [np.sum(np.array(x).reshape(-1, len(layers), 2, SIDE * SIDE), 0) for x in b.column(len(names)).to_pylist()]
                with np.errstate(invalid="ignore", divide="ignore"):
                    out = [np.concatenate([np.where(t[k, 1] > 1e-12, t[k, 0] / t[k, 1], np.nan) for t in tables]) if tables else np.zeros(0) for k in range(len(layers))]
                yield pa.record_batch([*b.columns[:-1], *[_lists(o, [SIDE * SIDE] * b.num_rows) for o in out]], [*names, *layers])

    return lists.mapInArrow(means, _schema(lists, names, ", ".join(f"`{c}` array<double>" for c in layers)))
