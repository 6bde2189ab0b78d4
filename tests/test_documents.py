import json
import tempfile

import pytest
from pyspark.sql import functions as F

from firmament.operators import annotate as AN
from firmament.operators import contracts as CT
from firmament.operators import modelio as MI
from firmament.sources import readers as R
from firmament.sources import sinks as K

NGC = "Name;Type;RA;Dec;MajAx;MinAx;V-Mag;B-Mag;M;Common names\n" \
      "NGC3576;HII;11:11:31.67;-61:21:46.8;3.0;;;;;\nNGC0224;G;00:42:44.35;+41:16:08.6;177.83;69.66;3.44;4.36;031;Andromeda Galaxy\n" \
      "IC0434;EmN;05:41:00.88;-02:27:13.6;60.0;10.0;;;;the Flame Region,Orion B\nNGC0001;Dup;00:07:15.8;+27:42:29;1;;;;;\nMESSIER031;G;00:42:44;+41:16:08;1;;;;;\n"


def test_ngc_file(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{base}/ngc.csv", "w") as f:
        f.write(NGC)
    r = {x.main_id: x for x in R.scan_ngc_csv(spark, f"{base}/ngc.csv").collect()}
    assert set(r) == {"NGC 3576", "M 31", "IC 434"}
    assert r["M 31"].names == ["M 31", "NGC 224"] and r["M 31"].mag == 3.44 and r["M 31"].common_name.en == "Andromeda Galaxy"
    assert r["NGC 3576"].size_minor == 3.0 and r["IC 434"].otype == "EmO" and r["IC 434"].common_name.en == "Flame Region"


def test_asu_file_and_empty(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for n, t in (("a", "#c\n#d\n_RAJ2000\t_DEJ2000\tSh2\tDiam\ndeg\tdeg\t\tarcmin\n---\t---\t---\t---\n103.5 \t-23.9\t 308\t 35\n1.0\t2.0\t9\t \n"), ("b", "#no rows\n")):
        with open(f"{base}/{n}.tsv", "w") as f:
            f.write(t)
    rows = R.scan_nebula_catalogs({"sharpless": R.scan_asu_tsv(spark, base)}).orderBy("row_idx").collect()
    assert [(x.main_id, x.size_major) for x in rows] == [("Sh 2-308", 35.0), ("Sh 2-9", None)]


def test_registry_layers_missing_and_malformed(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{base}/r.json", "w") as f:
        json.dump({"schema_version": 1, "objects": [{"primary_id": "M 1", "annotations": []}]}, f)
    with open(f"{base}/bad.json", "w") as f:
        f.write("{not json")
    assert R.scan_registry(spark, [f"{base}/r.json", f"{base}/none.json"]).count() == 1
    assert R.scan_atlas(spark, f"{base}/none.json").count() == 0
    with pytest.raises(Exception):
        R.scan_registry(spark, [f"{base}/bad.json"]).collect()


def test_legacy_reading_name(spark):
    d = spark.createDataFrame([('{"object":{"name":"NGC 1","type":{"zh":"a","en":"b"}},"narrative":"old"}',), ('{"object":{"name":{"zh":"x","en":"y"},"type":"t"}}',)], "text string")
    r = R.readings(d).collect()
    assert (r[0].name.zh, r[0].name.en, r[0].narrative.en) == ("NGC 1", "NGC 1", "old") and (r[1].name.zh, r[1].type.en) == ("x", "t")


def test_model_output_variants(spark):
    good = '{"narrative":{"zh":"a","en":"b"},"features":[{"id":"obj1","explanation":{"zh":"c","en":"d"}}]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, good[:-1] + ",}"), (4, '{"narrative":{"zh":"a"},"features":[]}'), (5, "sorry")]
    ok, bad = MI.parse_model_output(spark.createDataFrame(rows, "k int, raw string"), MI.TAILORING, MI.tailoring_contract)
    assert sorted(r.k for r in ok.collect()) == [1, 2, 3]
    assert {r.k: r.error for r in bad.collect()} == {4: "contract violated", 5: "not valid JSON"}


def test_atlas_write_swaps_and_refuses_bad_rows(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    K.write_atlas(spark, spark.range(3), f"{base}/atlas")
    K.write_atlas(spark, spark.range(5), f"{base}/atlas")
    assert K.read_atlas(spark, f"{base}/atlas").count() == 5
    with pytest.raises(Exception):
        K.write_atlas(spark, spark.range(9), f"{base}/atlas", F.col("id") > 3)
    assert K.read_atlas(spark, f"{base}/atlas").count() == 5


def test_quarantine_reasons(spark):
    d = spark.createDataFrame([(1, 0.5, "galaxy", "2.0"), (2, 1.5, "blob", "1.0")], "k int, confidence double, category string, version string")
    good, bad = CT.validate_rows(d, version=("version", "reading"))
    assert [r.k for r in good.collect()] == [1] and len(bad.first().reasons) == 3


OBJECT = "fid long, id string, parent_object_id string, anchor_ref string, px double, py double, size_major double, names array<string>, ord int"


def test_links_meet_in_the_frame(spark):
    """Repeated, null and missing ids and refs give the rows of two left joins, from rows dealt by frame alone."""
    rows = [(1, "a", None, "b", 1.0, 2.0, 3.0, ["A", "x"], 0), (1, "b", "a", "a", 4.0, None, None, [], 1), (1, "b", "zz", None, 6.0, 7.0, 8.0, None, 2),
            (1, None, "b", "b", 9.0, 1.0, 1.0, ["N"], 3), (2, "a", "a", "b", None, None, None, ["C"], 4), (None, "a", "a", "a", 1.0, 1.0, 1.0, ["D"], 5),
            (1, "c", "b", "b", 2.0, 2.0, 2.0, ["E"], 6)]
    o = spark.createDataFrame(rows, OBJECT)
    got = AN.parent_links(o)
    want = []
    at = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            at.setdefault((r[0], r[1]), []).append((r[4], r[5], r[6], r[7][0] if r[7] else None, True))
    missing = [(None,) * 5]
    for r in rows:
        want += [(r[8], *p, *a) for p in at.get((r[0], r[2]), missing) for a in at.get((r[0], r[3]), missing)]
    found = [f"{p}_{c}" for p in ("parent", "anchor") for c in ("px", "py", "size", "name", "found")]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("ord", *found).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = AN.badge_numbers(AN.parent_links(o.withColumn("category", F.lit("star")).withColumn("tier", F.lit("B"))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 1


def test_nebula_cells_are_read_once(spark):
    """Bad numbers are no position and no size; each cell of a row is looked up once, whatever the filters and sizes mention."""
    cells = [{"VdB": "1", "_RAJ2000": " 10.5", "_DEJ2000": "-3", "BRadMax": "2", "RRadMax": "4"}, {"VdB": "2", "_RAJ2000": "1", "_DEJ2000": "2", "BRadMax": "NaN", "RRadMax": "x"},
             {"VdB": "", "_RAJ2000": "1", "_DEJ2000": "2"}, {"VdB": "4", "_RAJ2000": "Infinity", "_DEJ2000": "2"}, {"VdB": "5", "_DEJ2000": "2"}, {"_RAJ2000": "1", "_DEJ2000": "2"}, None]
    d = R.nebula_catalog(spark.createDataFrame(list(enumerate(cells)), "row_idx int, cells map<string,string>"), "vdb")
    assert [(r.row_idx, r.main_id, r.ra_deg, r.dec_deg, r.size_major, r.size_minor) for r in d.orderBy("row_idx").collect()] == [
        (0, "vdB 1", 10.5, -3.0, 8.0, 8.0), (1, "vdB 2", 1.0, 2.0, None, None)]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("element_at(") == 5
