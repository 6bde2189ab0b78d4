"""Tiles: sampling and labels on frames of any size equal the same work on one grid."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firmament.operators import regions as RG
from firmament.operators import tiles as T


def upper_median(values):
    v = sorted(x for x in values if x is not None and x == x)
    return v[len(v) // 2] if v else None


def median_by_hand(lum, width, height, x, y, win):
    gh, gw = lum.shape
    seen = []
    for i in range(-3, 4):
        for j in range(-3, 4):
            px, py = x + i * (win / 3.0), y + j * (win / 3.0)
            if 0 <= px < width and 0 <= py < height:
                seen.append(lum[int(np.floor(py / height * gh)), int(np.floor(px / width * gw))])
    return upper_median(seen)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(4)
    grids = {1: rng.uniform(0, 200, (70, 90)), 2: rng.uniform(0, 200, (8, 8)), 3: rng.uniform(0, 200, (33, 32))}
    sizes = {1: (1800, 1400), 2: (800, 800), 3: (320, 330)}
    rasters = spark.createDataFrame([(f, g.shape[1], g.shape[0], [float(v) for v in g.ravel()], *sizes[f]) for f, g in grids.items()],
                                    "fid long, gw int, gh int, lum array<double>, width int, height int")
    pixels = spark.createDataFrame([(f, x, y, float(g[y, x])) for f, g in grids.items() for y in range(g.shape[0]) for x in range(g.shape[1])], "fid long, gx int, gy int, lum double")
    points = []
    for f in (1, 1, 1, 2, 3, 9):
        w, h = sizes.get(f, (100, 100))
        n = int(rng.integers(1, 40))
        points.append((f, len(points), [(float(x), float(y)) for x, y in zip(rng.uniform(-60, w + 60, n), rng.uniform(-60, h + 60, n))], float(rng.uniform(8, 130))))
    points += [(1, 50, [], 20.0), (1, 51, [(5000.0, 1.0), (3.0, 3.0)], 30.0)]
    objects = spark.createDataFrame(points, "fid long, id long, _pts array<struct<x:double,y:double>>, win double")
    return grids, sizes, rasters, pixels, points, objects


@pytest.mark.parametrize("form", ["rasters", "pixels"])
@pytest.mark.parametrize("tile", [16, 256])
def test_window_medians(spark, scene, form, tile, monkeypatch):
    grids, sizes, rasters, pixels, points, objects = scene
    monkeypatch.setattr(T, "GROUP_POINTS", 25)  # several groups a frame
    pictures = T.Pictures.of_rasters(rasters, tile) if form == "rasters" else T.Pictures.of_pixels(pixels, rasters, tile)
    got = {r.id: r for r in T.window_medians(objects, pictures, ["id"]).collect()}
    assert len(got) == len(points)
    for f, i, pts, win in points:
        want = [median_by_hand(grids[f], *sizes[f], x, y, win) if f in grids else None for x, y in pts]
        assert got[i]["_m"] == want
        assert [tuple(p) for p in got[i]["_pts"]] == pts


def test_samplers_do_not_join_pictures_to_points(spark, scene):
    _, _, rasters, _, _, objects = scene
    plan = T.window_medians(objects, T.Pictures.of_rasters(rasters), ["id"])._jdf.queryExecution().optimizedPlan()
    cogroup, todo = None, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("FlatMapCoGroups"):
            cogroup = node
        todo += [node.children().apply(i) for i in range(node.children().size())]
    asks = cogroup.children().apply(0)
    assert "lum" not in asks.output().mkString(",") and "lum" not in plan.output().mkString(",")
    joins, todo = 0, [asks]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Join"):
            joins += 1
            assert "lum#" not in node.output().mkString(",")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert joins


def test_backgrounds_and_missing_cells(spark, scene):
    grids, _, rasters, pixels, _, objects = scene
    both = [dict(map(tuple, T.background_levels(p).collect())) for p in (T.Pictures.of_rasters(rasters), T.Pictures.of_pixels(pixels, rasters))]
    assert both[0] == both[1] and set(both[0]) == {1, 2, 3}
    for f, g in grids.items():
        gh, gw = g.shape
        assert both[0][f] == upper_median([g[int(j / 24 * gh + 1e-12), int(i / 24 * gw + 1e-12)] for i in range(1, 24) for j in range(1, 24)])
    gaps = pixels.where("fid <> 1 OR (gx + gy) % 3 > 0")
    holed = grids[1].copy()
    y, x = np.mgrid[0:holed.shape[0], 0:holed.shape[1]]
    holed[(x + y) % 3 == 0] = np.nan
    got = {r.id: r["_m"] for r in T.window_medians(objects, T.Pictures.of_pixels(gaps, rasters, 16), ["id"]).collect()}
    p = next(r for r in objects.collect() if r.fid == 1 and r["_pts"])
    assert got[p.id] == [median_by_hand(holed, 1800, 1400, q.x, q.y, p.win) for q in p["_pts"]]


def regions_by_hand(mask, min_size, fill_below):
    def flood(grid):
        lab, n = np.zeros(grid.shape, int), 0
        for sy, sx in zip(*np.nonzero(grid)):
            if lab[sy, sx]:
                continue
            n += 1
            stack = [(sy, sx)]
            lab[sy, sx] = n
            while stack:
                y, x = stack.pop()
                for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= b < grid.shape[0] and 0 <= a < grid.shape[1] and grid[b, a] and not lab[b, a]:
                        lab[b, a] = n
                        stack.append((b, a))
        return lab, n

    mask = mask.copy()
    if fill_below:
        lab, n = flood(~mask)
        for k in range(1, n + 1):
            y, x = np.nonzero(lab == k)
            if len(y) < fill_below and y.min() > 0 and x.min() > 0 and y.max() < mask.shape[0] - 1 and x.max() < mask.shape[1] - 1:
                mask[lab == k] = True
    lab, n = flood(mask)
    return {(int(x), int(y), int(lab[y, x])) for y, x in zip(*np.nonzero(lab)) if (lab == lab[y, x]).sum() >= min_size}


@pytest.mark.parametrize("fill, size", [(0, 1), (6, 1), (40, 4)])
def test_labels_join_across_tiles(spark, fill, size):
    rng = np.random.default_rng(9)
    masks = {f: rng.uniform(size=s) < p for f, (s, p) in enumerate([((37, 45), 0.55), ((20, 16), 0.62), ((50, 9), 0.4), ((24, 24), 0.9)], 1)}
    ring = np.zeros((40, 40), bool)
    ring[2:38, 2:38] = True
    ring[8:33, 8:33] = False   # a hole that holds whole tiles without any set cell
    ring[36, 3] = False        # and one of a single cell
    masks[7] = ring
    rows = pd.DataFrame([(f, int(x), int(y), m.shape[1], m.shape[0]) for f, m in masks.items() for y, x in zip(*np.nonzero(m))], columns=["fid", "gx", "gy", "gw", "gh"])
    got = RG.label_regions(spark.createDataFrame(rows), size, fill, tile=8)
    found = {f: set() for f in masks}
    for r in got.collect():
        found[r.fid].add((r.gx, r.gy, r.label))
    for f, m in masks.items():
        assert found[f] == regions_by_hand(m, size, fill), f


def test_a_large_frame_labels_as_one_grid(spark):
    """Stripes and a diagonal over 1,500 x 1,500 cells, more than a raster row may hold."""
    n = 1500
    y, x = np.mgrid[0:n, 0:n]
    mask = (x % 50 == 3) | ((y % 700 == 11) & (x < 300)) | ((np.abs(x - y) < 2) & (x < 900))
    ys, xs = np.nonzero(mask)
    d = spark.createDataFrame(pd.DataFrame({"fid": 1, "gx": xs.astype(np.int32), "gy": ys.astype(np.int32), "gw": n, "gh": n}))
    got = {(r.label): (r.n, r.a, r.b) for r in RG.label_regions(d).groupBy("label").agg(F.count("*").alias("n"), F.min("gx").alias("a"), F.max("gx").alias("b")).collect()}
    lab = T._grid_components(mask)
    ids, counts = np.unique(lab[lab > 0], return_counts=True)
    assert sorted(c for c, _, _ in got.values()) == sorted(counts.tolist()) and len(got) == len(ids) > 1
    assert sum(c for c, _, _ in got.values()) == int(mask.sum())
    assert T.label_regions(d.limit(0)).count() == 0


def test_brightness_of_candidates(spark, scene):
    """Every candidate gets the median at its place and its frame's background; frames without picture get neither."""
    from firmament.plans.identify import with_brightness

    grids, sizes, rasters, _, _, _ = scene
    rows = [(f, s, i, 30.0 * i, 25.0 * i, *sizes.get(f, (100, 100))) for f in (1, 3, 9) for s in (0, 2) for i in range(12)]
    gated = spark.createDataFrame(rows, "fid long, src_rank int, row_idx long, px double, py double, width int, height int")
    levels = {r.fid: r.bg for r in T.background_levels(T.Pictures.of_rasters(rasters)).collect()}
    got = with_brightness(gated, rasters.select("fid", "gw", "gh", "lum")).collect()
    assert len(got) == len(rows)
    for r in got:
        win = max(8.0, np.floor(min(r.width, r.height) / 50.0 + 0.5))
        assert r.background == levels.get(r.fid)
        assert r.lum == (median_by_hand(grids[r.fid], r.width, r.height, r.px, r.py, win) if r.fid in grids else None)
