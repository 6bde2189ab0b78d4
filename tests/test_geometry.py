import random

import pytest
from pyspark.sql import functions as F

from firmament.functions import coords, geo
from firmament.operators import spatial
from firmament.operators.frames import graticule

A = dict(ra0=83.82, dec0=-5.39, crpix_x=3000.0, crpix_y=2000.0, scale_deg=1.8 / 3600, orientation_deg=30.0, parity=-1, width=6000, height=4000)
B = dict(A, parity=1, orientation_deg=-110.0, crpix_x=1234.0, crpix_y=2345.0)


def frame(spark, w, points=((0.0, 0.0),)):
    return spark.createDataFrame([dict(fid=1, x=float(x), y=float(y), **w) for x, y in points])


@pytest.mark.parametrize("w", [A, B])
def test_round_trip(spark, w):
    pts = [(100, 100), (5900, 3900), (3000, 2000), (4200, 1500)]
    wcs = geo.wcs_of()
    d = frame(spark, w, pts).withColumn("s", geo.pixel_to_world(wcs, F.col("x"), F.col("y")))
    d = d.withColumn("p", geo.world_to_pixel(wcs, F.col("s.ra"), F.col("s.dec")))
    for r in d.collect():
        assert r.p.px == pytest.approx(r.x, abs=1e-4)
        assert r.p.py == pytest.approx(r.y, abs=1e-4)


def test_centre_and_behind(spark):
    wcs = geo.wcs_of()
    r = frame(spark, A).select(
        geo.world_to_pixel(wcs, F.lit(83.82), F.lit(-5.39)).alias("c"),
        geo.world_to_pixel(wcs, F.lit(83.82 + 180), F.lit(5.39)).alias("b"),
        geo.pixel_to_world(wcs, F.lit(3000.0), F.lit(2000.0)).alias("o")).first()
    assert (round(r.c.px, 6), round(r.c.py, 6)) == (3000, 2000)
    assert r.b is None
    assert (r.o.ra, r.o.dec) == (83.82, -5.39)


def test_sexagesimal(spark):
    r = spark.range(1).select(
        coords.format_ra_hms(F.lit(359.9999)).alias("a"), coords.format_dec_dms(F.lit(-45.9999)).alias("b"),
        coords.hms_to_deg(F.lit("11:11:31.67")).alias("c"), coords.dms_to_deg(F.lit("-61:21:46.8")).alias("d"),
        coords.dms_to_deg(F.lit("-0:30:00")).alias("e"), coords.hms_to_deg(F.lit("x")).alias("f")).first()
    assert r.a == "00h00m00s" and r.b == "−46°00′00″"
    assert r.c == pytest.approx(167.88196, abs=1e-4) and r.d == pytest.approx(-61.363, abs=1e-4) and r.e == -0.5 and r.f is None


def test_cone_join_equals_brute_force(spark):
    rnd = random.Random(3)
    cat = [dict(obj_id=i, ra_deg=rnd.choice([0.01, 359.98, rnd.uniform(0, 360)]), dec_deg=rnd.choice([89.9, -89.7, rnd.uniform(-90, 90)])) for i in range(600)]
    fr = [dict(fid=i, ra0=rnd.choice([0.0, 359.9, rnd.uniform(0, 360)]), dec0=rnd.choice([89.5, -90.0, 88.0, rnd.uniform(-90, 90)]), r=rnd.uniform(0.5, 9)) for i in range(60)]
    c, f = spark.createDataFrame(cat), spark.createDataFrame(fr)
    got = spatial.cone_search_join(f, c, radius=F.col("r")).select("fid", "obj_id")
    want = f.crossJoin(c).where(geo.ang_sep_deg(F.col("ra0"), F.col("dec0"), F.col("ra_deg"), F.col("dec_deg")) <= F.col("r")).select("fid", "obj_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _wanted_cone(spark, seed, n=900):
    """A crowded spot, poles, the seam, nulls and repeated rows, with every pair of the cones by brute force."""
    rnd = random.Random(seed)
    place = lambda: rnd.choice([(50 + rnd.uniform(0, 0.4), 20 + rnd.uniform(0, 0.4)), (rnd.choice([0.01, 359.98]), rnd.uniform(-2, 2)), (rnd.uniform(0, 360), rnd.choice([89.9, -89.7])), (rnd.uniform(0, 360), rnd.uniform(-90, 90))])
    cat = [(i, *place(), rnd.choice(["a", "b", "b", "b", None]), rnd.choice([None, rnd.uniform(0, 12)])) for i in range(n)]
    cat += [cat[5], (n, None, 3.0, "a", 1.0)]
    fr = [(rnd.choice([i, None]) if i % 9 == 0 else i, *place(), rnd.choice([0.05, rnd.uniform(0.2, 9)])) for i in range(70)]
    c = spark.createDataFrame(cat, "obj_id long, ra_deg double, dec_deg double, source string, mag double").withColumn("no_mag", F.col("mag").isNull())
    f = spark.createDataFrame(fr, "fid long, ra0 double, dec0 double, r double")
    sep = geo.ang_sep_deg(F.col("ra0"), F.col("dec0"), F.col("ra_deg"), F.col("dec_deg"))
    return f, c, f.crossJoin(c.where("ra_deg IS NOT NULL")).withColumn("sep_deg", sep).where(F.col("sep_deg") <= F.col("r"))


@pytest.mark.parametrize("seed", [1, 2])
def test_first_and_nearest_of_a_cone_equal_those_of_the_whole_cone(spark, seed):
    from firmament.operators import select as S

    f, c, whole = _wanted_cone(spark, seed)
    order = ["no_mag", "mag", "obj_id"]
    rows = lambda d, *cols: sorted(map(str, d.select("fid", "obj_id", *cols).collect()))
    first = spatial.cone_search_join(f, c, F.col("r"), first=(2, ["source"], order))
    assert rows(S.capped_fetch(first, ["fid", "source"], order, 2), "source", "fetch_rank") == rows(S.capped_fetch(whole, ["fid", "source"], order, 2), "source", "fetch_rank")
    near = spatial.cone_search_join(f, c, F.col("r"), nearest=1)
    assert rows(S.first_hit(near, ["fid"], ["sep_deg", "obj_id"], F.lit(True))) == rows(S.first_hit(whole, ["fid"], ["sep_deg", "obj_id"], F.lit(True)))


def test_a_capped_cone_does_not_form_its_rows(spark):
    c = spark.range(4000).selectExpr("id AS obj_id", "50 + id % 63 / 100.0D AS ra_deg", "20 + id % 61 / 100.0D AS dec_deg")
    f = spark.range(5).selectExpr("id AS fid", "50.3D AS ra0", "20.3D AS dec0", "5D AS r")
    assert spatial.cone_search_join(f, c, F.col("r")).count() == 20000
    assert spatial.cone_search_join(f, c, F.col("r"), first=(2, [], ["obj_id"])).count() == 10
    assert 5 <= spatial.cone_search_join(f, c, F.col("r"), nearest=1).count() <= 50


def test_cone_plan_has_no_nested_loop(spark, sf):
    from firmament.queries.kit import catalog, frames

    plan = spatial.in_frame_join(frames(spark, sf), catalog(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "EvalPython" not in plan


def test_stored_catalog_is_pruned_to_touched_cells(spark, tmp_path):
    """Cones of 3 arcminutes and of 10 degrees in one search equal brute force, and files of other cells are not opened."""
    rnd = random.Random(11)
    cat = [dict(obj_id=i, ra_deg=rnd.choice([0.0, 359.999, rnd.uniform(0, 360)]), dec_deg=rnd.choice([90.0, -90.0, rnd.uniform(-90, 90)])) for i in range(3000)]
    cat += [dict(obj_id=5000 + i, ra_deg=200.0 + rnd.uniform(-0.1, 0.1), dec_deg=33.0) for i in range(500)]
    c = spark.createDataFrame(cat + [dict(obj_id=-1, ra_deg=None, dec_deg=1.0)])
    path = str(tmp_path / "zoned")
    spatial.write_zoned_catalog(c, path)
    stored = spatial.read_zoned_catalog(spark, path)
    rest = [(1, 200.0, 33.0, 0.05), (2, 200.05, 33.02, 10.0), (3, 0.0, 89.99, 0.05), (4, 359.99, 0.0, 10.0), (5, 10.0, -90.0, 8.0), (6, 90.0, 45.0, 0.0), (7, None, 3.0, 1.0)]
    f = spark.createDataFrame(rest, "fid long, ra0 double, dec0 double, r double")
    got = spatial.cone_search_join(f, stored, radius=F.col("r"))
    pairs = f.crossJoin(c).where("ra0 IS NOT NULL AND ra_deg IS NOT NULL")
    want = pairs.where(geo.ang_sep_deg(F.col("ra0"), F.col("dec0"), F.col("ra_deg"), F.col("dec_deg")) <= F.col("r")).select("fid", "obj_id")
    assert sorted(map(tuple, got.select("fid", "obj_id").collect())) == sorted(map(tuple, want.collect()))

    one = spatial.cone_search_join(f.where("fid = 1"), stored, radius=F.col("r"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "sky_cell" in plan
    assert one.count() >= 100
    scans = [p for p in _plan_nodes(one) if p.nodeName().startswith("Scan parquet")]
    opened = sum(int(p.metrics().apply("numFiles").value()) for p in scans)
    assert 0 < opened < len(stored.inputFiles()) / 20


def _plan_nodes(df):
    """The executed plan of `df` after it ran, adaptive parts included."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            out.append(p)
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_cell_depth_follows_the_radius(spark):
    f = spark.createDataFrame([(i, 200.0, dec, r) for i, (dec, r) in enumerate((d, r) for d in (0.0, 60.0, -85.0) for r in (0.01, 0.05, 0.4, 3.0, 10.0))],
                              "fid long, ra0 double, dec0 double, r double")
    cells = spatial._with_cone_cells(f, F.col("r")).groupBy("fid", "r").agg(F.count("*").alias("n"), F.max("_depth").alias("depth")).collect()
    assert {round(c.r, 2): c.depth for c in cells} == {0.01: 8, 0.05: 7, 0.4: 4, 3.0: 1, 10.0: 0}
    assert max(c.n for c in cells if c.r < 10) <= 40


def test_graticule_labels(spark):
    g = graticule(frame(spark, A)).collect()
    assert {x.kind for x in g} == {"ra", "dec"}
    assert all(len(x.points) >= 2 for x in g)
    assert any(x.label and x.label.startswith("RA ") for x in g) and any(x.label and x.label.startswith("Dec ") for x in g)
