"""The trigram index finds what a scan finds, and reads the postings of the needle alone."""

import random

import pytest
from pyspark.sql import functions as F

from firmament.operators import textindex as X


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abN 星云1") for _ in range(draw.randint(0, 14))) for _ in range(400)]
    texts += ["NGC 7000"] * 150 + [None, "", "ab", "aaaaaaa", "a\nb\nc", "x\U0001F30Cy\U0001F30Cz", "NGC%7000_", "long " * 4000 + "tail"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("index"))
    frame = spark.createDataFrame(rows, "key long, name string, n string")
    X.write_substring_index(frame, F.col("name"), path)
    return path, rows


@pytest.mark.parametrize("needle", ["", "a", "星", "ab", "NGC", "ngc 7000", "aaa", "aaaa", "b\nc", "\U0001F30Cy\U0001F30C", "c%7", "tail", "long long", "not there", "zzz"])
def test_index_equals_scan(spark, stored, needle):
    path, rows = stored
    want = sorted(i for i, t, _ in rows if needle.lower() in (t or "").lower())
    for rarest in (1, 4):
        found = X.search_substring(spark, path, needle, rarest)
        assert found.columns == ["key", "name", "n"] and sorted(r.key for r in found.collect()) == want


def test_search_reads_the_needles_postings_only(spark, stored):
    path, rows = stored
    found = X.candidate_texts(spark, path, "ngc 7000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    assert found.count() == 1  # copies are one text
    scanned = X.search_substring(spark, path, "7000")._jdf.queryExecution().executedPlan().toString()
    assert "contains" in scanned.lower()


def test_empty_table(spark, tmp_path):
    X.write_substring_index(spark.createDataFrame([], "key long, name string"), F.col("name"), str(tmp_path))
    assert X.search_substring(spark, str(tmp_path), "abc").count() == 0 and X.search_substring(spark, str(tmp_path), "a").count() == 0
