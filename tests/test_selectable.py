"""A search that forms only what a selection may pick selects what the whole cones do."""

import random

import pytest
from pyspark.sql import functions as F

from firmament.operators import select as S
from firmament.operators import spatial

FRAMES = "fid long, ra0 double, dec0 double, crpix_x double, crpix_y double, scale_deg double, orientation_deg double, parity int, width int, height int"
ROWS = ("src_rank int, row_idx long, main_id string, names array<string>, otype string, ra_deg double, dec_deg double, size_major double, mag double, "
        "catalog_ids map<string,string>, common_name struct<zh:string,en:string>")


def _tables(spark):
    rnd = random.Random(11)
    frames = [(i, 80 + rnd.uniform(0, 4), 10 + rnd.uniform(0, 4), 2000.0, 1500.0, 2.33 / 3600, rnd.uniform(0, 360), rnd.choice([1, -1]), 4000, 3000) for i in range(25)]
    frames += [(30, 80.0, 89.5, 500.0, 500.0, 0.002, 10.0, 1, 1000, 1000), (31, 200.0, -50.0, 2000.0, 1500.0, 0.0006, 0.0, 1, 4000, 3000), (32, 82.0, 12.0, None, 1500.0, 0.0006, 0.0, 1, 4000, 3000),
               (33, 82.0, 12.0, 2000.0, 1500.0, 0.0006, 0.0, 1, 4000, 3000), (33, 83.0, 12.0, 2000.0, 1500.0, 0.0006, 0.0, 1, 4000, 3000), (None, 82.0, 12.0, 2000.0, 1500.0, 0.0006, 0.0, 1, 4000, 3000)]
    rows = []
    for i in range(1500):
        ids = rnd.choice([{}, {"messier": f"M {i}"}, {"ngc": f"NGC {i}"}, {"sharpless": f"Sh {i}"}, {"x": "y"}])
        polar = i % 10 == 0
        rows.append((i % 3, i, next(iter(ids.values()), f"o{i}"), [f"o{i}"], rnd.choice(["HII", "RNe", "G", "*", "WR*", "GlC", "PN", "Rad", "zz"]), rnd.uniform(0, 360) if polar else 78 + rnd.uniform(0, 8),
                     rnd.uniform(87, 90) if polar else 8 + rnd.uniform(0, 8), rnd.choice([None, 0.0, 4.0, 12.0, 12.0, rnd.uniform(1, 90), -3.0]), rnd.choice([None, 1.0, 3.5, 9.0]), ids, None))
    rows += [(0, 2000, "NGC 6888", ["NGC 6888"], "HII", 82.0, 12.0, 290.0, 0.0, {"messier": "M 0", "ngc": "NGC 6888"}, None), (0, 2001, "w", ["w"], "WR*", 82.0001, 12.0, None, 9.0, {}, None),
             (0, 2002, "n", ["n"], "HII", 82.1, 12.1, float("nan"), float("nan"), {}, None), (0, 2003, "n", ["n"], "G", None, 12.1, 5.0, 5.0, {}, None),
             (0, 2004, "IC 434", ["Horsehead Nebula"], "DNe", 82.2, 12.1, 8.0, None, {"ic": "B 33"}, None), (0, 2006, "NGC 1", ["NGC 1"], "HII", 82.15, 12.0, 30.0, float("nan"), {"ngc": "NGC 1"}, None), (0, 2005, None, None, "HII", 82.1, 12.1, 20.0, None, None, None)]
    return spark.createDataFrame(frames, FRAMES), spark.createDataFrame(rows, ROWS).withColumn("obj_id", F.col("row_idx"))


@pytest.mark.parametrize("start, together", [(512, 4096), (4, 3)])
def test_what_a_selection_may_pick_gives_the_selection(spark, monkeypatch, start, together):
    monkeypatch.setattr(S.Selectable, "START", start)
    monkeypatch.setattr(S.Selectable, "TOGETHER", together)
    frames, rows = _tables(spark)
    sky = S.appraise(S.nickname_overlay(rows))
    gated = S.gate_candidates(spatial.in_frame_join(frames, sky), appraised=True)
    picked = S.gate_candidates(spatial.in_frame_join(frames, sky, pick=S.Selectable()), appraised=True)
    columns = ["fid", "obj_id", "main_id", "category", "score", "rank", "px", "py", "sep_deg"]
    want, got = S.select_objects(gated), S.select_objects(picked, few=True)
    read = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert read(got) == read(want) and want.count() > 150
    assert want.where("obj_id = 2001 AND fid < 25").count() > 0  # the star of a bubble
    assert read(S.select_objects(S.shortlist(gated), few=True)) == read(want)
    assert S.shortlist(gated.coalesce(1).sortWithinPartitions("fid")).count() < gated.count()
    alone = F.col("fid") < 30
    assert picked.where(alone).count() < gated.where(alone).count() / (2 if start < 512 else 1)


def test_a_selection_reads_its_candidates_once(spark):
    frames, rows = _tables(spark)
    picked = S.gate_candidates(spatial.in_frame_join(frames.where("fid < 30"), S.appraise(S.nickname_overlay(rows)), pick=S.Selectable()), appraised=True)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan.split("MapInArrow")[0]
