import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firmament.operators import pixels as P
from firmament.operators import regions as RG
from firmament.operators import tiles as T


def comet_grid(kind):
    w, h = 200, 150
    y, x = np.mgrid[0:h, 0:w]
    lum = np.full((h, w), 20.0)
    blue, red = lum.copy(), lum.copy()
    if kind == "flat":
        lum[:] = 120.0
    else:
        d = np.hypot(x - 60, y - 75)
        if kind == "comet":
            tail = (x > 68) & (x < 160) & (np.abs(y - 75) < 3)
            lum[tail] = 48.0
            red[tail], blue[tail] = 20.0, 80.0
        lum = np.where(d < 8, 240 - 8 * d, lum)
    return pd.DataFrame({"fid": 1, "gx": x.ravel(), "gy": y.ravel(), "lum": lum.ravel(), "r": red.ravel(), "g": lum.ravel(), "b": blue.ravel()})


def detect(spark, kind):
    fr = spark.createDataFrame([(1, 2000, 1500, 2.0, 10.0, 20.0, 1000.0, 750.0, 2.0 / 3600, 0.0, 1)],
                               "fid long, width int, height int, pixscale double, ra0 double, dec0 double, crpix_x double, crpix_y double, scale_deg double, orientation_deg double, parity int")
    return P.detect_comets(spark.createDataFrame(comet_grid(kind)), fr)


def test_comet_found_with_blue_tail(spark):
    d = detect(spark, "comet")
    r = d.collect()
    assert len(r) == 1
    assert abs(r[0].nucleus_x - 605) < 30 and abs(r[0].nucleus_y - 755) < 30
    assert r[0].tails[0].kind == "ion" and r[0].tails[0].tip_x > 1400
    assert {x.id for x in P.comet_objects(d).collect()} == {"comet1", "comet_coma", "comet_nuc", "comet_tail1"}


def test_blob_and_flat_are_no_comets(spark):
    assert detect(spark, "blob").count() == 0 and detect(spark, "flat").count() == 0


def glow(spark, lit=True):
    """A 4000 x 3000 frame at 1/20 scale: disc of radius 600 and a bright knot."""
    gw, gh = 200, 150
    y, x = np.mgrid[0:gh, 0:gw]
    fx, fy = (x + 0.5) * 20, (y + 0.5) * 20
    lum = np.full((gh, gw), 20.0)
    if lit:
        lum = np.where(np.hypot(fx - 2000, fy - 1500) < 600, 120.0, lum)
        lum = np.where(np.hypot(fx - 2400, fy - 1500) < 150, 240.0, lum)
    return spark.createDataFrame([(1, gw, gh, [float(v) for v in lum.ravel()], 4000, 3000, 2.0 / 3600)], "fid long, gw int, gh int, lum array<double>, width int, height int, scale_deg double")


def test_rim_front_lands_on_the_knot(spark):
    o = spark.createDataFrame([(1, 1, "obj1", "emission_nebula", 2000.0, 1500.0, 120.0)], "fid long, ord long, id string, category string, px double, py double, size_major double")
    fronts = lambda r: P.rim_fronts(o, T.Pictures.of_rasters(r), r)
    r = fronts(glow(spark)).collect()
    assert len(r) == 1 and abs(r[0].px - 2400) < 200 and abs(r[0].py - 1500) < 200
    assert fronts(glow(spark, False)).count() == 0


def test_holes_fill_and_small_regions_drop(spark):
    cells = [(x, y) for x in range(1, 6) for y in range(1, 6) if (x, y) != (3, 3)] + [(8, 8)]
    d = spark.createDataFrame([(1, x, y, 10, 10) for x, y in cells], "fid long, gx int, gy int, gw int, gh int")
    assert RG.label_regions(d, min_size=2).count() == 24
    assert RG.label_regions(d, min_size=2, fill_below=5).count() == 25


def test_ray_runs_gap(spark):
    bright = [1, 2, 6, 11]
    s = spark.createDataFrame([(1, 0, i, i in bright) for i in range(1, 15)], "fid long, ray int, step int, bright boolean")
    assert P.ray_runs(s, 4).first().extent == 6
    assert P.ray_runs(s, 5).first().extent == 11


def test_illumination_prior(spark):
    reg = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 180.0), (2, 3, 0.0, 0.0, 180.0), (1, 4, 0.0, 0.0, None)], "fid long, rid int, cx double, cy double, illum_deg double")
    anchors = spark.createDataFrame([(1, 0, 100.0, 0.0)], "fid long, anchor_ord int, ax double, ay double")
    assert sorted(r.rid for r in RG.illumination_prior(reg, anchors).select("rid").collect()) == [1, 3]
    assert F is not None


@pytest.mark.parametrize("p", [0.0, 37.5, 100.0])
def test_percentile_by_counting_is_exact(spark, p):
    rng = np.random.default_rng(3)
    frames = {1: rng.normal(size=5000), 2: np.round(rng.exponential(2, 4000)), 3: np.array([7.0]), 4: np.array([1.0, 2.0]), 5: 10.0 ** rng.uniform(-300, 300, 999), 6: np.full(50, 3.25),
              7: np.array([-1.7e308, 1.7e308, 0.0])}
    d = spark.createDataFrame(pd.DataFrame([(f, float(v)) for f, vs in frames.items() for v in vs], columns=["fid", "lum"]))
    d = d.unionByName(spark.createDataFrame([(1, None), (2, float("nan")), (8, None)], "fid long, lum double"))
    got = {r.fid: r.cut for r in RG.exact_percentile(d, p, few=1000).collect()}
    assert set(got) == set(frames)
    for f, vs in frames.items():
        s = np.sort(vs)
        k = (len(s) - 1) * (p / 100.0)
        a, b = s[int(k)], s[min(int(k) + 1, len(s) - 1)]
        assert got[f] == pytest.approx(a if k == int(k) else (1 - (k - int(k))) * a + (k - int(k)) * b, rel=1e-12)


def test_frames_of_one_small_file_are_dealt_over_all_partitions(spark, tmp_path):
    from firmament.queries import imaging

    spark.createDataFrame([(k, [0.01 * k] * 64) for k in range(40)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    r = imaging.rasters(spark, str(tmp_path))
    assert r.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and r.count() == 40


def test_cell_medians_are_lists_only_where_some_are_unknown():
    known = P._cell_medians(np.arange(16.0), 4, 4, [0, 3, 9], [0, 2, 9])
    assert isinstance(known, np.ndarray) and known.tolist() == [1.0, 11.0, 15.0]
    assert P._cell_medians([None] * 16, 4, 4, [1], [1]) == [None]
