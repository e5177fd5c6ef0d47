"""Scripts, scenes, plans and manifests with nulls, empty tables and odd JSON."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators import planning, scripts

REQUEST = "request_id long, elements array<string>, script string, facts string, scene string, tables string"


def problems(spark, elements, script, facts=None, scene=None, tables=None) -> list[str]:
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    row = (1, elements, text(script), text(facts), text(scene), text(tables))
    return scripts.script_problems(spark.createDataFrame([row], REQUEST)).first()["problems"]


def test_nothing_is_promised_without_elements(spark):
    assert problems(spark, None, None) == problems(spark, [], "no json") == []
    assert problems(spark, ["fallback"], None) == problems(spark, ["fallback"], "[]") == problems(spark, ["fallback"], "{") == ["script is missing"]


@pytest.mark.parametrize(
    ("element", "script", "facts", "scene", "tables", "good"),
    [
        ("wrong_first", {"wrong_first": {"id": "W2"}}, {"id": "W1"}, None, {"t": [{"id": "W1"}]}, True),
        ("wrong_first", {"wrong_first": {"id": "W2"}}, {"id": "W1"}, None, {"t": [{"id": "W2"}]}, False),
        ("wrong_first", {"wrong_first": {"id": 2}}, {"id": "W1"}, None, None, False),
        ("wrong_first", {"wrong_first": {"a": "x", "b": "y"}}, {"a": "1"}, None, None, False),
        ("wrong_first", {"wrong_first": {"other": "x"}}, {"id": "W1"}, None, None, False),
        ("pushback", {"pushback": {"demand": "d", "rounds": "2", "then": "accept"}}, {}, None, None, False),
        ("ambiguous", {"ambiguous": {"phrase": "it", "fact": "id"}}, {"id": "W1"}, {"known": {"x": "y"}}, None, True),
        ("ambiguous", {"ambiguous": {"phrase": "it", "fact": "id"}}, {"id": "W1"}, {"known": {"x": "my W1"}}, None, False),
        ("identity", {}, {"id": 77}, {"known": {"n": 78}}, None, True),
        ("identity", {}, {"id": 77, "approve_x": True}, {"known": {"n": 77}}, None, False),
        ("forgotten", {"forgotten": ["mail"]}, {"id": "W1"}, {"known": {}}, None, True),
        ("forgotten", {"forgotten": ["mail"]}, {"id": "W1"}, {"known": {"mail": 1}}, None, False),
        ("clarify", {"clarify": {"options": ["a", "b"], "decides_by": "x"}}, {"approve_a": True, "approve_b": True}, None, None, True),
        ("clarify", {"clarify": {"options": ["a", "b"], "decides_by": ""}}, {"approve_a": True, "approve_b": True}, None, None, False),
    ],
)
def test_elements(spark, element, script, facts, scene, tables, good):
    found = problems(spark, [element], {"traits": ["calm"], **script}, facts, scene, tables)
    assert (found == []) if good else (len(found) == 1 and found[0].startswith(f"{element}: "))


def test_scenes_and_their_numbers(spark):
    rows = spark.createDataFrame([(None,), ("nope",), ("{}",), ('{"situation": "a", "goal": "b", "known": {"k \\"1": [2, {"3": -4.5e1}]}, "wants_to_know": [1, 2, 3, 4]}',)], "s string")
    out = [r["p"] for r in rows.select(scripts.scene_problems(F.col("s")).alias("p")).collect()]
    assert out[0] == out[1] == ["scene is missing"] and len(out[2]) == 4 and out[3] == ["more than 3 wishes"]
    assert [r["n"] for r in rows.select(scripts.numbers_of(F.get_json_object("s", "$.known")).alias("n")).collect()] == [[], [], [], [2.0, -45.0]]


def test_plans_of_small_and_of_poor_worlds(spark):
    kind = "world string, process string, kind string, approval string"
    worlds = spark.createDataFrame([("a", "p1", "inquiry", None), ("a", "p2", None, "approve_x"), ("b", "q", "advice", None)], kind)
    counts = spark.createDataFrame([("a", 1), ("b", 40), ("c", 5)], "world string, tasks int")
    out = planning.task_plan(worlds, counts).collect()
    assert sorted((r["world"], r["place"]) for r in out) == [("a", 0), *[("b", k) for k in range(40)]]
    assert all(p == ["q"] for p in (r["processes"] for r in out if r["world"] == "b"))
    assert planning.task_plan(worlds.limit(0), counts).count() == 0


def test_manifest_names_the_first_reason(spark):
    tasks = spark.createDataFrame([("w-t-t1", True, None, None), ("w-t-t2", None, "gates", None), ("x-t1", True, None, None), ("v-t9", True, "s", "p")], "task_id string, passed boolean, stage string, problems string")
    worlds = spark.createDataFrame([("w-t", None, True), ("v", None, True), ("u", "x", True)], "world string, id string, ready boolean")
    out = {r["task_id"]: (r["split"], r["reason"]) for r in planning.task_manifest(tasks, worlds, eval_worlds=1).collect()}
    assert out == {"w-t-t1": ("eval", None), "w-t-t2": (None, "gates: None"), "x-t1": ("train", None), "v-t9": ("train", None)}
    images = spark.createDataFrame([("v", None), ("w-t", "broken")], "world string, error string")
    verdicts = spark.createDataFrame([("v-t9", "failed"), ("w-t-t1", "failed")], "task_id string, verdict string")
    out = {r["task_id"]: r["reason"] for r in planning.task_manifest(tasks, worlds, images, verdicts).collect()}
    assert out == {"w-t-t1": "no verified image", "w-t-t2": "gates: None", "x-t1": "no verified image", "v-t9": "policy gate failed"}
    assert planning.task_manifest(tasks.limit(0), worlds.limit(0)).count() == 0
