"""Stencils over tiles, spans of polygons, labels of touching spans and inner points, against whole arrays."""

import numpy as np
import pytest

from cairnlake.operators import raster

RINGS = "id long, rings array<array<array<double>>>"


def brute_cells(rings, size, n):
    """Middles of cells that lie inside by the even-odd rule."""
    out = set()
    for row in range(-n, n):
        for col in range(-n, n):
            x, y, inside = (col + 0.5) * size, (row + 0.5) * size, False
            for r in rings:
                for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
                    if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x:
                        inside = not inside
            if inside:
                out.add((row, col))
    return out


def brute_parts(cells):
    left, parts = set(cells), 0
    while left:
        parts += 1
        todo = [left.pop()]
        while todo:
            y, x = todo.pop()
            for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
    return parts


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(3)
    square = [[-2.0, -2.0], [2.0, -2.0], [2.0, 2.0], [-2.0, 2.0]]
    out = [
        [square], [square, [[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]]], [[*square, square[0]]], [[[0.0, 0.0], [5.0, 5.0]]], [], None, [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]],
        [[[-4.0, -4.0], [-3.0, -4.0], [-3.0, 4.0], [-4.0, 4.0]], [[3.0, -4.0], [4.0, -4.0], [4.0, 4.0], [3.0, 4.0]]],  # two parts
        [[[-4.0, 0.0], [0.0, 4.0], [4.0, 0.0], [3.0, 0.0], [0.0, 3.0], [-3.0, 0.0]]],  # an arch
        [[[-5.0, -5.0], [5.0, -5.0], [5.0, 5.0], [4.0, 5.0], [4.0, -4.0], [-4.0, -4.0], [-4.0, 5.0], [-5.0, 5.0]]],  # a cup
    ]
    for _ in range(25):
        n = int(rng.integers(3, 12))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = rng.uniform(1, 7, n)
        out.append([np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1).tolist()])
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "block"), [(0.5, 256), (0.5, 2), (0.3, 3)])
def test_spans_and_parts(spark, shapes, monkeypatch, size, block):
    monkeypatch.setattr(raster, "BLOCK", block)
    df = spark.createDataFrame(shapes, RINGS)
    found = raster.spans(df, "id", "rings", size).cache()
    cells = {i: set() for i, _ in shapes}
    for r in found.collect():
        cells[r.id] |= {(r.row, c) for c in range(r.low, r.high + 1)}
    want = {i: brute_cells([r for r in s or [] if len(r) > 2], size, 30) for i, s in shapes}
    assert cells == want
    told = {r.id: r for r in raster.areas(found, "id", size).collect()}
    assert set(told) == {i for i, c in want.items() if c}
    for i, r in told.items():
        open_sides = sum(n not in want[i] for y, x in want[i] for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)))
        assert (r.cells, round(r.area, 9), round(r.shore, 9)) == (len(want[i]), round(len(want[i]) * size**2, 9), round(open_sides * size, 9))
    parts = {}
    for r in raster.components(found, "id").collect():
        parts.setdefault(r.id, set()).add(r.part)
    assert {i: len(p) for i, p in parts.items()} == {i: brute_parts(c) for i, c in want.items() if c}
    assert raster.areas(raster.spans(df.limit(0), "id", "rings", size), "id", size).count() == 0


def test_inner_points(spark, shapes):
    got = {r.id: (r.x, r.y) for r in raster.inner_points(spark.createDataFrame(shapes, RINGS), "id", "rings").collect()}
    for i, s in shapes:
        rings = [r for r in s or [] if len(r) > 2]
        x, y = got[i]
        if i in (3, 4, 5, 6):
            assert (x, y) == (None, None)
            continue
        inside = False
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
                if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x:
                    inside = not inside
        assert inside, (i, x, y)


def test_slopes_over_tiles(spark):
    """Six tiles of a whole array, without copies at their seams; and a tile alone."""
    rng = np.random.default_rng(5)
    grid = rng.uniform(0, 100, (8, 12))
    rows = [("a", y, x, grid[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].ravel().tolist()) for y in range(2) for x in range(3)]
    rows += [("b", 5, 5, [float(v) for v in range(16)]), ("c", 0, 0, [1.0])]
    df = spark.createDataFrame(rows, "k string, ty int, tx int, values array<double>")
    got = {(r.k, r.gy, r.gx): (r.elevation, r.slope) for r in raster.slopes(df, ["k"], 4, 30.0).collect()}
    want = raster.horn(np.pad(grid, 1, mode="edge"), 30.0)
    for y in range(8):
        for x in range(12):
            seam = (y in (0, 7) and x in (3, 4, 7, 8)) or (x in (0, 11) and y in (3, 4))  # the corner cell there is of the tile's own nearest ones
            assert seam or got["a", y, x] == pytest.approx((grid[y, x], want[y, x]))
    alone = raster.horn(np.pad(np.arange(16.0).reshape(4, 4), 1, mode="edge"), 30.0)
    assert [got["b", 20 + y, 20 + x][1] for y in range(4) for x in range(4)] == pytest.approx(alone.ravel().tolist())
    assert len(got) == 96 + 16
    plane = raster.horn(np.add.outer(np.zeros(6), np.arange(6) * 30.0), 30.0)
    assert np.allclose(plane, 45)
