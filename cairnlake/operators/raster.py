"""Grids in tiles and polygons on them: stencils with copied edges, scan-line spans, labels of what touches, inner points.

A tile is a row with its place (ty, tx) in a grid and its values row by row; a cell is a square of a given size.  Everything
works a tile or a shape at a time; only a tile's edges, and the spans of a shape, ever move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .jobs import checkpoint

_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _strip(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """What the tile at (dy, dx) from this one needs of it: the edge, or the corner, that faces it."""
    rows = slice(-1, None) if dy > 0 else slice(0, 1) if dy < 0 else slice(None)
    columns = slice(-1, None) if dx > 0 else slice(0, 1) if dx < 0 else slice(None)
    return grid[rows, columns]


def _spread(side: int, keys: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in (*keys, "ty", "tx", "dy", "dx", "strip")}
            held = batch.to_pydict()
            for i in range(batch.num_rows):
                grid = np.array(held["values"][i], float).reshape(side, side)
                for dy, dx in _AROUND:
                    for k in keys:
                        out[k].append(held[k][i])
                    out["ty"].append(held["ty"][i] + dy)
                    out["tx"].append(held["tx"][i] + dx)
                    out["dy"].append(-dy)
                    out["dx"].append(-dx)
                    out["strip"].append(_strip(grid, dy, dx).ravel())
            yield pa.RecordBatch.from_pydict({**{k: pa.array(out[k], batch.schema.field(k).type) for k in keys}, **{c: pa.array(out[c], pa.int64()) for c in ("ty", "tx", "dy", "dx")}, "strip": pa.array(out["strip"], pa.list_(pa.float64()))})

    return run


def padded(strips: dict[tuple[int, int], np.ndarray], side: int) -> np.ndarray:
    """A tile with a frame of the cells around it; where no tile is, of its own nearest ones."""
    own = strips[0, 0].reshape(side, side)
    out = np.pad(own, 1, mode="edge")
    for (dy, dx), strip in strips.items():
        if (dy, dx) != (0, 0):
            rows = slice(0, 1) if dy < 0 else slice(-1, None) if dy > 0 else slice(1, -1)
            columns = slice(0, 1) if dx < 0 else slice(-1, None) if dx > 0 else slice(1, -1)
            out[rows, columns] = strip.reshape(out[rows, columns].shape)
    return out


def horn(around: np.ndarray, cell_m: float) -> np.ndarray:
    """Slope in degrees at the inner cells, by the weighted differences over the eight neighbours."""
    a, b, c, d, _, f, g, h, i = (around[y : around.shape[0] - 2 + y, x : around.shape[1] - 2 + x] for y in range(3) for x in range(3))
    east, south = ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * cell_m), ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * cell_m)
    return np.degrees(np.arctan(np.hypot(east, south)))


def stencil(tiles: DataFrame, keys: Sequence[str], side: int, compute: Callable[[np.ndarray], np.ndarray], name: str = "result") -> DataFrame:
    """keys, ty, tx, values and an array with compute() of each tile's values framed by its neighbours'.

    tiles: keys, ty, tx and values, ``side`` squared of them.  A tile sends each neighbour the edge that faces it, so what moves
    is nine small rows a tile, and a group has nine at most.  Tiles must be unique; nulls among values are not numbers.
    """
    rows = tiles.select(*keys, F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), F.transform("values", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("values"))
    schema = T.StructType([rows.schema[k] for k in keys])
    for c in ("ty", "tx", "dy", "dx"):
        schema = schema.add(c, "long")
    sent = rows.where(F.size("values") == side * side).mapInArrow(_spread(side, keys), schema.add("strip", T.ArrayType(T.DoubleType())))
    gathered = sent.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "strip")).alias("strips")).where(F.exists("strips", lambda s: (s["dy"] == 0) & (s["dx"] == 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, made = [], []
            for strips in batch.column("strips").to_pylist():
                found = {(s["dy"], s["dx"]): np.array(s["strip"], float) for s in strips}
                own.append(found[0, 0])
                made.append(compute(padded(found, side)).ravel())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "ty", "tx")), pa.array(own, kind), pa.array(made, kind)], [*keys, "ty", "tx", "values", name])

    out = T.StructType([rows.schema[k] for k in keys]).add("ty", "long").add("tx", "long").add("values", T.ArrayType(T.DoubleType())).add(name, T.ArrayType(T.DoubleType()))
    return gathered.mapInArrow(run, out)


def slopes(tiles: DataFrame, keys: Sequence[str], side: int, cell_m: float) -> DataFrame:
    """keys, gy, gx, elevation and slope in degrees of each cell of the grid."""
    made = stencil(tiles, keys, side, lambda around: horn(around, cell_m), "slope")
    cells = made.select(*keys, "ty", "tx", F.posexplode(F.arrays_zip("values", "slope")).alias("i", "c"))
    return cells.select(*keys, (F.col("ty") * side + F.floor(F.col("i") / side)).alias("gy"), (F.col("tx") * side + F.col("i") % side).alias("gx"), F.col("c.values").alias("elevation"), F.col("c.slope").alias("slope"))


def crossings(rings: list[np.ndarray], y: float) -> np.ndarray:
    """Where the edges of a shape's rings cross a line, in order; an edge has its lower end but not its upper one."""
    out = []
    for p in rings:
        a, b = p, np.roll(p, -1, 0)
        over = (a[:, 1] <= y) != (b[:, 1] <= y)
        a, b = a[over], b[over]
        out.append(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0)


def _rings(value: list | None) -> list[np.ndarray]:
    """Rings of at least three points without a repeated last one."""
    rings = [np.array([q for q in r if q is not None and None not in q], float).reshape(-1, 2) for r in value or [] if r]
    rings = [p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p for p in rings]
    return [p for p in rings if len(p) >= 3 and np.isfinite(p).all()]


def spans(shapes: DataFrame, key: str, rings: str, size: float, west: float = 0.0, south: float = 0.0) -> DataFrame:
    """key, row, low and high: the runs of cells, both ends included, whose middles lie in a shape, by scan lines.

    rings: an array of rings of [x, y], holes among them, by the even-odd rule.  Shapes are dealt evenly first, since a small file
    of them makes many cells, and the edges of some hundreds are worked off together; what comes out is as many rows as the
    outlines cross scan lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [_edges(value) for value in batch.column(rings).to_pylist()]
            lines = np.array([2 + (np.abs(e[:, 3] - e[:, 1]).sum() / size if len(e) else 0) for e in edges]).cumsum()
            for part in np.split(np.arange(len(edges)), np.flatnonzero(np.diff(lines // SCANNED)) + 1):
                if len(part) and sum(len(edges[i]) for i in part):
                    which, row, low, high = _runs([edges[i] for i in part], size, west, south)
                    for first in range(0, len(which), SCANNED):
                        cut = slice(first, first + SCANNED)
                        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(part[which[cut]])), *(pa.array(x[cut]) for x in (row, low, high))], [key, "row", "low", "high"])

    schema = T.StructType([shapes.schema[key]]).add("row", "long").add("low", "long").add("high", "long")
    dealt = shapes.select(key, rings).repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, schema)


#: Crossings that are sorted together, about.
SCANNED = 1 << 18


def _edges(value: list | None) -> np.ndarray:
    """x and y of both ends of each edge of a shape."""
    shape = _rings(value)
    return np.concatenate([np.hstack([p, np.roll(p, -1, 0)]) for p in shape]) if shape else np.zeros((0, 4))


def _runs(edges: list[np.ndarray], size: float, west: float, south: float) -> tuple[np.ndarray, ...]:
    """Place of the shape, row, low and high of the runs of cells of some shapes, by their edges."""
    which = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    x1, y1, x2, y2 = np.concatenate(edges).T
    # A row more on either side, for rounding; the crossing itself is tested below.
    first = np.ceil((np.minimum(y1, y2) - south) / size - 0.5).astype(np.int64) - 1
    number = np.floor((np.maximum(y1, y2) - south) / size - 0.5).astype(np.int64) + 2 - first
    edge = np.repeat(np.arange(len(number)), number)
    row = first[edge] + np.arange(len(edge)) - np.repeat(number.cumsum() - number, number)
    y = south + (row + 0.5) * size
    over = (y1[edge] <= y) != (y2[edge] <= y)
    edge, row, y = edge[over], row[over], y[over]
    xs = x1[edge] + (y - y1[edge]) / (y2[edge] - y1[edge]) * (x2[edge] - x1[edge])
    order = np.lexsort((xs, row, which[edge]))
    # A middle on a crossing belongs to what is east of it.  A ring crosses a line an even number of times.
    starts = np.ceil((xs[order] - west) / size - 0.5).astype(np.int64)
    which, row, low, high = which[edge[order]][::2], row[order][::2], starts[::2], starts[1::2]
    some = low < high
    which, row, low, high = which[some], row[some], low[some], high[some]
    begins = np.ones(len(low), bool)
    begins[1:] = (which[1:] != which[:-1]) | (row[1:] != row[:-1]) | (low[1:] != high[:-1])  # runs that meet are one
    return which[begins], row[begins], low[begins], high[np.roll(begins, -1)] - 1


def areas(found: DataFrame, key: str, size: float) -> DataFrame:
    """key, cells, area and shore, the length of the outline along cells, of each shape's spans.

    The shore is both ends of each span, and what the spans of the rows above and below leave open of it.
    """
    found = checkpoint(found)  # three times read
    cells = F.col("high") - F.col("low") + 1
    one = found.groupBy(key).agg(F.sum(cells).alias("cells"), F.count("*").alias("n"))
    touching = _overlaps(found, key).groupBy(key).agg(F.sum("shared").alias("shared"))
    whole = one.join(touching, key, "left")
    shore = 2 * F.col("n") + 2 * F.col("cells") - 2 * F.coalesce("shared", F.lit(0))
    return whole.select(key, "cells", (F.col("cells") * size * size).alias("area"), (shore * size).alias("shore"))


#: Columns of a block, by which spans of neighbouring rows are brought together.
BLOCK = 256
#: Spans of a task, about.
SPANS = 1 << 20


def _overlaps(found: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of a shape in neighbouring rows that share columns, with how many; each pair once.

    found is stored.  Spans meet by shape, row and block of columns, so a row of very many spans isn't compared with the whole next one.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK)))
    a = found.select(key, "row", "low", "high").withColumn("block", blocks)
    b = a.select(key, (F.col("row") - 1).alias("row"), F.col("low").alias("low2"), F.col("high").alias("high2"), "block")
    first = F.greatest("low", "low2")
    # Spans are a few bytes once packed, so Spark would leave very many of them to a task.
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(found.count() / SPANS))
    a, b = (side.repartition(tasks, key, "row", "block") for side in (a, b))
    met = a.hint("merge").join(b, [key, "row", "block"]).where((first <= F.least("high", "high2")) & (F.floor(first / BLOCK) == F.col("block")))
    return met.select(key, "row", "low", "high", "low2", "high2", (F.least("high", "high2") - first + 1).alias("shared"))


def components(found: DataFrame, key: str) -> DataFrame:
    """The spans with part: one name for all spans of a shape that touch along cell edges, directly or over others."""
    stored = checkpoint(found)
    node = lambda row, low: F.concat_ws(":", F.col(key).cast("string"), row.cast("string"), low.cast("string"))
    ties = _overlaps(stored, key).select(node(F.col("row"), F.col("low")).alias("a"), node(F.col("row") + 1, F.col("low2")).alias("b"))
    labels = connected_components(ties, "a", "b")
    named = stored.withColumn("__node", node(F.col("row"), F.col("low")))
    return named.join(labels, named["__node"] == labels["node"], "left").select(key, "row", "low", "high", F.coalesce("component", "__node").alias("part"))


def inner_points(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """key, x and y of a point inside each shape: the middle of the widest part of a line through its middle height.

    A line through a vertex is moved half way to the next height that a vertex has.  Null for a shape without area.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [_inside(_rings(value)) for value in batch.column(rings).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([p[i] for p in points], pa.float64()) for i in range(2))], [key, "x", "y"])

    return shapes.select(key, rings).mapInArrow(run, T.StructType([shapes.schema[key]]).add("x", "double").add("y", "double"))


def _inside(rings: list[np.ndarray]) -> tuple[float | None, float | None]:
    if not rings:
        return None, None
    heights = np.unique(np.concatenate([p[:, 1] for p in rings]))
    middle = (heights[0] + heights[-1]) / 2
    if middle in heights and len(heights) > 2:
        middle = (middle + heights[np.searchsorted(heights, middle) + 1]) / 2
    xs = crossings(rings, middle)
    width = xs[1::2] - xs[::2]
    if not len(width) or width.max() <= 0:
        return None, None
    best = int(width.argmax())
    return float((xs[2 * best] + xs[2 * best + 1]) / 2), float(middle)
