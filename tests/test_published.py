"""Paths into raw documents, the shipped rules' cases and what they reach, by literal cases."""

import pytest
from pyspark.sql import functions as F

from lumenwatch.functions.predicates import Documents, compile_selection
from lumenwatch.functions.published import PUBLISHED
from lumenwatch.operators import detection

DOC = '{"url": "/A", "n": 5, "f": 0.5, "s": "5", "on": true, "x": {"y": {"z": "deep"}}, "list": [{"y": 1}], "none": null}'


@pytest.mark.parametrize(
    ("selection", "fires"),
    [
        ({"raw.url": "/A"}, True), ({"raw.URL": "/A"}, False), ({"raw.url": {"contains": "a"}}, True), ({"raw.n": 5}, True), ({"raw.n": "5"}, False), ({"raw.s": 5}, False), ({"raw.s": "5"}, True),
        ({"raw.n": {"regex": "^5$"}}, True), ({"raw.n": {"in": [4, 5]}}, True), ({"raw.n": {"not_in": ["5"]}}, True), ({"raw.f": 0.5}, True), ({"raw.on": True}, True), ({"raw.on": False}, False), ({"raw.x.y.z": "deep"}, True),
        ({"raw.x.y.z.w": {"exists": True}}, False), ({"raw.list.y": {"exists": True}}, False), ({"raw.none": {"exists": False}}, True), ({"raw.none": None}, True), ({"raw.absent": {"not_contains": "a"}}, True), ({"gone": {"exists": False}}, True),
        ({"raw.url": ["/B", "/A"]}, True), ({"gone": "v"}, False),
    ],
)
def test_paths(spark, selection, fires):
    rows = spark.createDataFrame([(DOC,)], "doc string").select(F.parse_json("doc").alias("raw"))
    assert rows.where(compile_selection(selection, Documents(rows.columns))).count() == int(fires)


def test_rules_are_whole():
    ids = [r["rule_id"] for r in PUBLISHED]
    assert len(ids) == len(set(ids)) == 27
    assert {r["severity"] for r in PUBLISHED} <= {25, 50, 75, 100}


def _events(spark, rows):
    return spark.createDataFrame(rows, "meant string, fires boolean, doc string").withColumn("raw", F.parse_json("doc"))


def test_case_counts(spark):
    rule = {"rule_id": "r", "selection": {"raw.a": 1}}
    rows = [("r", True, '{"a": 1}'), ("r", True, '{"a": 2}'), ("r", False, '{"a": 1}'), ("r", None, "{}"), ("other", True, '{"a": 1}'), (None, True, '{"a": 1}')]
    assert [tuple(r) for r in detection.case_counts(_events(spark, rows), [rule], "meant", "fires").collect()] == [("r", 1, 1, 1, 1)]
    assert detection.case_counts(_events(spark, []), [rule], "meant", "fires").count() == 0


def test_missing_fields(spark):
    rules = [{"rule_id": "a", "selection": {"raw.a": 1, "raw.b": 1, "gone": 1}}, {"rule_id": "b", "selection": {"gone": 1, "zone": 2}}]
    got = detection.missing_fields(_events(spark, [("r", True, '{"a": 1}')]), rules, 2)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [("gone", 2, 1), ("raw.b", 1, 2)]
    assert detection.missing_fields(_events(spark, []), rules).count() == 4


def test_reach(spark):
    matrix = spark.createDataFrame([("T1",), ("T1.001",), ("T2",), ("T3.001",), ("T4",)], "technique string")
    found = spark.createDataFrame([([" t1.001 ", "T9"],), ([],), (None,), (["T3.001", "T9", ""],)], "techniques array<string>")
    got = detection.reach(found, matrix, ["T1", "T9", "T4"]).first()
    assert (got.technique_total, got.technique_covered, got.technique_percent) == (5, 2, 40.0)
    assert (got.parent_total, got.parent_covered, got.parent_percent) == (3, 1, 33.3)
    assert got.unknown_ids == ["T9"] and got.gaps == ["T1", "T4"]
    none = detection.reach(found.limit(0), matrix.limit(0), []).first()
    assert (none.technique_percent, none.parent_percent, none.gaps) == (0.0, 0.0, [])
