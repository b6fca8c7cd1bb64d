"""Scenes in tiles against the same scenes as one row, and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators.components import component_roots
from furrow.operators.patches import mask_above, patch_graphs
from furrow.operators.rasters import edge_density
from furrow.operators.tiles import tile_boundaries, tile_edge_density, tile_patch_sizes, tile_quantiles

TILE_SCHEMA = "scene_id string, top int, left int, height int, width int, data array<double>"


def cut_up(scene_id, pixels, heights, widths):
    """Tiles of the given heights and widths."""
    rows, top = [], 0
    for h in heights:
        left = 0
        for w in widths:
            part = pixels[top : top + h, left : left + w]
            rows.append((scene_id, top, left, h, w, [None if v != v else float(v) for v in part.ravel()]))
            left += w
        top += h
    assert (top, left) == pixels.shape
    return rows


def spiral(side):
    grid = np.zeros((side, side))
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(side * side):
        grid[y, x] = 1.0
        ahead = (y + 2 * dy, x + 2 * dx)
        near = (y + dy, x + dx)
        if not (0 <= near[0] < side and 0 <= near[1] < side) or (0 <= ahead[0] < side and 0 <= ahead[1] < side and grid[ahead]):
            dy, dx = dx, -dy
            near = (y + dy, x + dx)
            ahead = (y + 2 * dy, x + 2 * dx)
            if not (0 <= near[0] < side and 0 <= near[1] < side) or (0 <= ahead[0] < side and 0 <= ahead[1] < side and grid[ahead]):
                break
        y, x = near
    return grid


def plain_patches(grid, threshold):
    left, out = {(y, x) for y, x in zip(*np.nonzero(grid > threshold))}, []
    for first in sorted(left):
        if first not in left:
            continue
        left.discard(first)
        stack, area = [first], 0
        while stack:
            y, x = stack.pop()
            area += 1
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out.append((int(first[0]), int(first[1]), area))
    return sorted(out)


def scenes():
    rng = np.random.default_rng(5)
    noise, gaps = rng.random((13, 17)), rng.random((9, 9))
    gaps[rng.random((9, 9)) < 0.3] = np.nan
    return {
        "spiral": (spiral(24), [6] * 4, [6] * 4),
        "noise": (noise, [1, 4, 8], [5, 1, 1, 10]),
        "gaps": (gaps, [3, 3, 3], [9]),
        "full": (np.ones((8, 8)), [4, 4], [2, 2, 4]),
        "none": (np.zeros((4, 4)), [2, 2], [4]),
        "thin": (np.ones((1, 7)), [1], [1, 2, 1, 3]),
    }


@pytest.fixture(scope="module")
def tiles(spark):
    rows = [row for name, cut in scenes().items() for row in cut_up(name, *cut)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), TILE_SCHEMA).repartition(5)


def test_patches_cross_tiles(tiles):
    got = {}
    for r in tile_patch_sizes(tiles, 0.5).collect():
        got.setdefault(r["scene_id"], []).append((r["y"], r["x"], r["area"]))
    for name, (pixels, _, _) in scenes().items():
        assert sorted(got.get(name, [])) == plain_patches(pixels, 0.5), name
    assert len(got["spiral"]) == 1 and got["spiral"][0][2] > 200


def test_stencils_equal_untiled_ones(spark, tiles):
    levels = tiles.withColumn("data", F.transform("data", lambda v: F.floor(F.coalesce(v, F.lit(0.0)) * 99).cast("int")))
    whole = []
    for name, (pixels, _, _) in scenes().items():
        flat = [None if v != v else float(v) for v in pixels.ravel()]
        whole.append((name, *pixels.shape, flat))
    frame = spark.createDataFrame(whole, "scene_id string, height int, width int, data array<double>")
    greys = frame.withColumn("data", F.transform("data", lambda v: F.floor(F.coalesce(v, F.lit(0.0)) * 99).cast("int")))
    assert dict(map(tuple, tile_edge_density(levels).collect())) == pytest.approx(dict(map(tuple, edge_density(greys).collect())))
    want = {r["scene_id"]: r["boundary_pixels"] for r in patch_graphs(mask_above(frame, 0.4)).collect()}
    got = {r["scene_id"]: r["boundary_pixels"] for r in tile_boundaries(tiles, 0.4).collect()}
    assert got == {**dict.fromkeys(got, 0), **want} and len(got) == 6


@pytest.mark.parametrize("digits", [(22, 21, 21), (8,) * 8])
def test_quantiles_are_exact(spark, tiles, digits):
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(-3, 3), -0.0, 0.0, 0.25, 5e-324, -0.2, 1.0]) for _ in range(600)]
    rows = [("wild", i, 0, 1, 60, values[60 * i : 60 * i + 60]) for i in range(10)]
    rows += [("one", 0, 0, 1, 1, [0.5]), ("two", 0, 0, 1, 2, [0.5, None]), ("two", 1, 0, 1, 1, [0.75]), ("empty", 0, 0, 1, 1, [7.0]), ("null", 0, 0, 1, 1, None)]
    frame = tiles.unionByName(spark.createDataFrame(rows, TILE_SCHEMA))
    got = {r["scene_id"]: (r["q25"], r["q50"], r["q75"]) for r in tile_quantiles(frame, digits=digits).collect()}
    held = {"wild": values, "one": [0.5], "two": [0.5, 0.75], **{n: list(p.ravel()) for n, (p, _, _) in scenes().items()}}
    for name, pixels in held.items():
        valid = [v for v in pixels if v == v and -0.2 <= v <= 1.0]
        assert got.pop(name) == pytest.approx(tuple(np.quantile(valid, [0.25, 0.5, 0.75])), abs=1e-12), name
    assert got == {}
    with pytest.raises(ValueError):
        tile_quantiles(frame, digits=(30, 30))


def test_components(spark):
    rng = random.Random(8)
    chain = list(range(40))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(100, 100 + i) for i in range(30)], (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, component_roots(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(chain, 0), **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0
