"""Nothing is dropped for being many: bubbles in a frame, stars in a cone, frames of many sizes."""

import numpy as np
from pyspark.sql import functions as F

from firmament.operators import pixels as P
from firmament.operators import select as S


def test_many_bubbles_each_get_a_star(spark):
    """Twelve bubbles share one place and fourteen stars: each takes its nearest free star, in rank order."""
    bubbles = [(1, k, k, "emission_nebula", ["NGC 6888"], 600.0, 10.0, 0.0, "HII", 0, k) for k in range(1, 13)]
    stars = [(1, 100 + k, None, "star", ["s"], None, 10.0 + 0.01 * k, 0.0, "WR*", 0, 100 + k) for k in range(1, 15)]
    schema = "fid long, obj_id long, rank int, category string, names array<string>, size_major double, ra_deg double, dec_deg double, otype string, src_rank int, row_idx long"
    rows = spark.createDataFrame(bubbles + stars, schema)
    got = S.bubble_star(rows.where("rank is not null"), rows.drop("rank"))
    assert sorted(r.obj_id for r in got.collect()) == [100 + k for k in range(1, 13)]


def test_box_means_with_a_radius_per_frame(spark):
    draw = np.random.default_rng(4)
    sizes = {1: (9, 7, 2), 2: (30, 40, 3), 3: (90, 25, 7)}
    rasters = {f: draw.integers(0, 255, (h, w)).astype(float) for f, (w, h, _) in sizes.items()}
    rows = [(f, x, y, float(a[y, x]), sizes[f][2]) for f, a in rasters.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    pixels = spark.createDataFrame(rows, "fid long, gx int, gy int, lum double, k int")
    got = {(r.fid, r.gx, r.gy): r.smooth for r in P.smooth_mean(pixels).collect()}
    want = {(f, x, y): a[y - k:y + k + 1, x - k:x + k + 1].mean() for f, a in rasters.items() for k in [sizes[f][2]]
            for y in range(k, a.shape[0] - k) for x in range(k, a.shape[1] - k)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_no_pixels_no_comets(spark):
    pixels = spark.createDataFrame([], "fid long, gx int, gy int, lum double, r double, g double, b double")
    frames = spark.createDataFrame([], "fid long, width double, height double, pixscale double, ra0 double, dec0 double, crpix_x double, crpix_y double, scale_deg double, orientation_deg double, parity int")
    assert P.detect_comets(pixels, frames).count() == 0


def test_cone_rows_are_cut_only_when_asked(spark):
    cone = spark.createDataFrame([(1, k, float(k), 0, k) for k in range(300)], "fid long, obj_id long, size_major double, src_rank int, row_idx long")
    assert S.sized_objects_topn(cone).count() == 300 and S.sized_objects_topn(cone, 100).count() == 100
    assert S.capped_fetch(cone, ["fid"], [F.col("obj_id")]).count() == 300
