import random

import pytest
from pyspark.sql import functions as F

from firmament.functions import geo
from firmament.operators import merge as M
from firmament.operators import spatial

SCHEMA = ("fid long, src_rank int, row_idx long, main_id string, names array<string>, otype string, ra_deg double, dec_deg double, "
          "size_major double, size_minor double, mag double, catalog_ids map<string,string>, source string, common_name struct<zh:string,en:string>")


def row(i, name, otype, ra, dec, size=None, mag=None, ids=None, source="SIMBAD", fid=1):
    return (fid, 0, i, name, [name], otype, ra, dec, size, size, mag, ids or {}, source, None)


def merged(spark, rows, **kw):
    return M.merge_catalogs(spark.createDataFrame(rows, SCHEMA), **kw).orderBy("merge_key").collect()


def test_same_complex_merges_across_mechanisms(spark):
    out = merged(spark, [row(1, "NGC 3372", "HII", 161.27, -59.66, 210.0, ids={"ngc": "NGC 3372"}),
                         row(2, "Ced 109", "RNe", 161.27, -59.66, 120.0, ids={"cederblad": "Ced 109"}, source="VizieR:x")])
    assert len(out) == 1 and out[0].otype == "HII" and out[0].cross_match[0].id == "Ced 109"


def test_small_embedded_reflection_stays(spark):
    assert len(merged(spark, [row(1, "NGC 3372", "HII", 161.27, -59.66, 210.0, ids={"ngc": "NGC 3372"}), row(2, "x", "RNe", 161.27, -59.66, 8.0)])) == 2


def test_two_catalogues_one_nebula(spark):
    out = merged(spark, [row(1, "Sh 2-308", "HII", 103.5405, -23.9421, 35.0, ids={"sharpless": "Sh 2-308"}, source="VizieR:a"),
                         row(2, "RCW 11", "HII", 103.5221, -23.6472, 35.0, ids={"rcw": "RCW 11"}, source="VizieR:b")])
    assert len(out) == 1 and out[0].catalog_ids == {"sharpless": "Sh 2-308", "rcw": "RCW 11"} and out[0].main_id == "Sh 2-308"


def test_star_and_nebula_stay_apart_and_binary_keeps_the_bright_one(spark):
    assert len(merged(spark, [row(1, "s", "*", 10.0, 10.0, mag=5.0), row(2, "n", "HII", 10.0, 10.0, 30.0)])) == 2
    out = merged(spark, [row(1, "B", "*", 10.0, 10.0, mag=5.4), row(2, "A", "*", 10.001, 10.0, mag=0.91)])
    assert len(out) == 1 and out[0].mag == 0.91


def sky(seed, n, spread):
    rnd = random.Random(seed)
    kinds = ["HII", "RNe", "DNe", "G"]
    rows = []
    for i in range(n):
        copy = i % 3 == 0  # a third of all rows are copies of one object
        ra, dec = (50.0, 20.0) if copy else (50 + rnd.uniform(0, spread), 20 + rnd.uniform(0, spread))
        ids = rnd.choice([{}, {"ngc": f"NGC {i}"}, {"rcw": f"RCW {i}"}, {"messier": f"M {i}"}])
        rows.append(row(i, f"o{i}", "HII" if copy else rnd.choice(kinds), ra, dec, rnd.choice([None, 3.0, 12.0, rnd.uniform(1, 60)]), None, ids, rnd.choice(["SIMBAD", "VizieR:x"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_large_group_path_equals_fold(spark, seed):
    d = spark.createDataFrame(sky(seed, 240, 3.0), SCHEMA)
    small = {(r.row_idx): (r.size_major, tuple(sorted(r.names))) for r in M.merge_catalogs(d).collect()}
    large = {(r.row_idx): (r.size_major, tuple(sorted(r.names))) for r in M.merge_catalogs(d, max_group=10, chunk=20).collect()}
    assert small == large


def test_groups_folded_side_by_side_equal_one_fold(spark):
    """Many groups, some longer than an Arrow batch, growing survivors, null sizes: the hosts of the row-by-row fold."""
    from firmament.operators.spatial import merge_block

    cells = [[(fid, *r[1:]) for r in sky(100 + fid, 20 + 40 * (fid % 4), 0.5 + fid % 5)] for fid in range(8)]
    d = spark.createDataFrame([r for c in cells for r in c], SCHEMA).withColumn("rid", F.col("row_idx"))
    d = d.withColumn("key", M.prestige_sort(F.col("catalog_ids"), F.col("source"), F.lit(False), F.col("size_major"), F.col("mag"), F.col("src_rank"), F.col("row_idx")))
    rows = merge_block(d).select("fid", "block", "rid", "key", F.col("ra_deg").alias("ra"), F.col("dec_deg").alias("dec"),
                                 F.coalesce("size_major", F.lit(0.0)).alias("major"), "category")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = sorted(map(tuple, M._fold_groups(rows, ["fid", "block"], False).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    folded = rows.groupBy("fid", "block").agg(M._ordered_rows().alias("rows")).select("fid", "block", M._fold(F.col("rows"), F.array(), False).alias("f"))
    assert got == sorted(map(tuple, folded.select("fid", "block", F.inline("f.hosts")).collect()))
    assert any(rid != host for _, _, rid, host in got)
    plan = M._fold_groups(rows, ["fid", "block"], False)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # no group is gathered in one row


def test_components_hold_every_interacting_pair(spark):
    rnd = random.Random(5)
    rows = [row(i, f"o{i}", rnd.choice(["HII", "RNe", "DNe"]), rnd.choice([0.02, 359.97, rnd.uniform(0, 4)]), rnd.choice([89.95, rnd.uniform(-2, 2)]), rnd.choice([None, 5.0, rnd.uniform(1, 90)])) for i in range(120)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("obj_id", F.col("row_idx"))
    comp = {r.obj_id: r.component for r in spatial.duplicate_components(d).collect()}
    c = spatial.merge_block(d).withColumn("m", F.coalesce("size_major", F.lit(0.0)))
    a, b = c.alias("a"), c.alias("b")
    near = geo.flat_sep_arcmin(F.col("a.ra_deg"), F.col("a.dec_deg"), F.col("b.ra_deg"), F.col("b.dec_deg")) <= F.greatest(F.lit(10.0), 1.2 * F.greatest("a.m", "b.m"))
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.obj_id") != F.col("b.obj_id")) & near).select(F.col("a.obj_id").alias("x"), F.col("b.obj_id").alias("y")).collect()
    assert pairs and len(comp) == 120
    assert all(comp[p.x] == comp[p.y] for p in pairs)


def test_components_are_found_on_patches_of_cells(spark, monkeypatch):
    """A field of many neighbouring cells is a graph of a few patches; a component is still named by the least of its cells."""
    rows = [row(i, f"o{i}", "HII" if i < 400 else "DNe", 10 + (i % 20) * 0.25, (i // 20 % 20) * 0.25, 5.0) for i in range(400)]
    rows += [row(400 + i, f"p{i}", "DNe", 100.0 + 90 * i, 0.0, 5.0) for i in range(3)] + [row(403, "big", "DNe", 100.3, 0.0, 400.0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("obj_id", F.col("row_idx"))
    nodes = []
    whole = spatial.connected_components

    def counted(edges, **more):
        nodes.append(edges.select("a").union(edges.select("b")).distinct().count())
        return whole(edges, **more)

    monkeypatch.setattr(spatial, "connected_components", counted)
    comp = {r.obj_id: r.component for r in spatial.duplicate_components(d).collect()}
    assert len(comp) == 404 and len({comp[i] for i in range(400)}) == 1
    assert comp[400] == comp[403] and len({comp[400], comp[401], comp[402], comp[0]}) == 4
    assert nodes[0] < 150  # of 400 cells


def _cones(spark, monkeypatch=None):
    """Frames around crowded fields, on the seam, at a pole, without a place, sharing a number or without one; rows without a place or number, or sharing one."""
    rnd = random.Random(8)
    at = lambda fid, ra, dec: (fid, ra, dec, 400, 300, 0.004)
    frames = [at(i, 50 + rnd.uniform(0, 4), 20 + rnd.uniform(0, 4)) for i in range(30)] + [at(40 + i, 359.5 + i * 0.2, 89.3 - i) for i in range(6)]
    frames += [at(60, None, 20.0), at(61, 51.0, 21.0), at(61, 53.0, 22.0), at(62, 52.0, 22.0), at(62, 52.0, 22.0), at(None, 51.0, 22.0), at(63, 120.0, -40.0)]
    rows = [r[1:] for r in sky(9, 500, 5.0)]
    rows += [row(600 + i, f"p{i}", rnd.choice(["HII", "G", "odd"]), rnd.choice([rnd.uniform(0, 360), 359.99, 0.01]), rnd.uniform(85, 90), rnd.uniform(1, 40), 3.0, {"ngc": f"NGC {i % 9}", "ic": ""},
                 "VizieR:x")[1:] for i in range(300)]
    rows += [rows[3], rows[4], rows[4], (0, None, "m", ["m"], "HII", 51.0, 21.0, 9.0, 9.0, None, {}, "SIMBAD", None), (0, 950, "q", ["q"], "HII", None, 21.0, 9.0, 9.0, None, {}, "SIMBAD", None),
             (0, 951, "r", ["r", "r", None, "o1"], "HII", 51.0, 21.0, None, 9.0, None, {"ngc": "NGC 1", "rcw": "R", "ic": "B"}, "SIMBAD", ("z", "Great")),
             (0, 952, None, None, "HII", 51.01, 21.0, 70.0, None, None, None, "SIMBAD", ("", "")), (0, 953, "s", [], None, 51.0, 21.0, 5.0, 5.0, None, {}, "x", None)]
    frames = spark.createDataFrame(frames, "fid long, ra0 double, dec0 double, width int, height int, scale_deg double")
    return frames, spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[1:]))


def _texts(d, columns):
    return sorted(str([r[c] if not isinstance(r[c], dict) else list(r[c].items()) for c in columns]) for r in d.collect())


@pytest.mark.parametrize("limits", [(8192, 250_000, 2_000_000), (3, 20, 900)])
def test_whole_cones_merge_as_their_rows_do(spark, monkeypatch, limits):
    """Cones merged where they are formed give what their rows give, in homes of any size; rows and ids come in the same order."""
    for name, limit in zip(("FULL", "CROWDED", "CANDIDATES"), limits):
        monkeypatch.setattr(spatial.Cones, name, limit)
    frames, sky_rows = _cones(spark)
    rows = spatial.cone_search_join(frames, sky_rows).drop("ra0", "dec0", "width", "height", "scale_deg")
    whole = spatial.cone_search_join(frames, sky_rows, whole=True)
    want, got = M.merge_catalogs(rows), M.merge_catalogs(whole)
    columns = [c for c in want.columns if c != "sep_deg"]
    assert sorted(columns) == sorted(got.columns) and want.count() > 500
    assert _texts(got, columns) == _texts(want, columns)
    slim = M.merge_catalogs(whole, keep=("main_id", "names"))
    assert _texts(slim, ["fid", "main_id", "names", "cross_match"]) == _texts(want, ["fid", "main_id", "names", "cross_match"])
    keyed = sky_rows.withColumn("rid", F.col("row_idx")).withColumn("key", M.prestige_sort(
        F.col("catalog_ids"), F.col("source"), F.lit(False), F.col("size_major"), F.col("mag"), F.col("src_rank"), F.col("row_idx")))
    hosts = M.assign_hosts(spatial.cone_search_join(frames, keyed)), M.assign_hosts(spatial.cone_search_join(frames, keyed, whole=True))
    assert _texts(hosts[0], ["fid", "rid", "host"]) == _texts(hosts[1], ["fid", "rid", "host"])


def test_pairs_of_whole_cones_are_not_shuffled(spark):
    """Shuffled rows are frames and copies of catalogue rows; every pair comes after the last exchange."""
    frames, sky_rows = _cones(spark)
    alone = frames.where("fid < 60")
    plan = M.merge_catalogs(spatial.cone_search_join(alone, sky_rows, whole=True))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    formed = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Exchange" in line for line in lines[:formed]) and "SortMergeJoin" not in plan


@pytest.mark.parametrize("limits", [(8192, 250_000, 2_000_000), (3, 20, 900)])
def test_cones_are_counted_without_their_rows(spark, monkeypatch, limits):
    from firmament.operators.factsheet import catalog_coverage

    for name, limit in zip(("FULL", "CROWDED", "CANDIDATES"), limits):
        monkeypatch.setattr(spatial.Cones, name, limit)
    frames, sky_rows = _cones(spark)
    sky_rows = sky_rows.withColumn("source", F.when(F.col("row_idx") % 7 == 0, None).when(F.col("row_idx") % 5 == 0, F.concat(F.lit("s"), F.col("row_idx") % 30)).otherwise(F.col("source")))
    wide = frames.withColumn("scale_deg", F.when(F.col("fid") == 5, 1.0).otherwise(F.col("scale_deg")))  # one cone holds the whole sky
    want, got = catalog_coverage(spatial.cone_search_join(wide, sky_rows)), catalog_coverage(spatial.cone_search_join(wide, sky_rows, whole=True))
    assert want.count() > 100 and _texts(got, ["fid", "source", "n"]) == _texts(want, ["fid", "source", "n"])
    plan = catalog_coverage(spatial.cone_search_join(frames.where("fid < 60"), sky_rows, whole=True))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortMergeJoin" not in plan
