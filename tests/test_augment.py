from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.operators import augment
from tidewright.sources import readers

TYPE = "episode_id string, messages array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,name:string,context_only:boolean>>"


@pytest.fixture
def one(spark):
    call = [("c1", "get_order", '{"order_id": "W123"}')]
    rows = [
        ("system", "Be kind. Use get_order first.\n\nPolicy:\nNo refunds.\n\nCurrent time: 1", None, None, None, None), ("user", "Where is W123?", None, None, None, None), ("assistant", "", call, None, None, None),
        ("tool", '{"ok": true, "result": {"id": "W123"}}', None, "c1", "get_order", None), ("assistant", "On its way.", None, None, None, None),
    ]
    return spark.createDataFrame([("e", rows), ("empty", [])], TYPE)


def messages(frame, id="e"):
    return frame.where(F.col("episode_id") == id).first()["messages"]


@pytest.mark.parametrize(("content", "style", "want"), [('{"ok": true, "result": "x"}', "raw", "x"), ('{"ok": true, "result": {"a": 1}}', "text", '{"a":1}'), ('{"ok": false, "error": "no"}', "raw", "Error: no"), ('{"ok": false, "error": "no"}', "text", "no"), ('{"ok": false}', "raw", "Error: request failed"), ("plain", "raw", "plain"), ('{"ok": true, "result": "x"}', "envelope", '{"ok": true, "result": "x"}')])
def test_rendered_result(spark, content, style, want):
    assert spark.range(1).select(augment.rendered_result(F.lit(content), F.lit(style)).alias("x")).first()["x"] == want


def test_greet_comes_before_the_first_user(one):
    out = messages(augment.greet(one))
    assert [m["role"] for m in out] == ["system", "assistant", "user", "assistant", "tool", "assistant"] and out[1]["context_only"]
    assert len(messages(augment.greet(augment.greet(one)))) == 6 and messages(augment.greet(one), "empty") == []


def test_layouts_keep_instructions_and_policy(one):
    for layout in ("tags", "markdown", "policy_first"):
        text = one.where("episode_id = 'e'").select(augment.laid_out(F.get("messages", 0)["content"], F.lit(layout)).alias("x")).first()["x"]
        assert "Be kind. Use get_order first." in text and "No refunds." in text and text.endswith("\n\nCurrent time: 1")
    assert messages(augment.relayout(one))[0]["content"] != messages(one)[0]["content"]


def test_rename_is_consistent(one):
    out = messages(augment.rename_tools(one, seed=3))
    name = out[2]["tool_calls"][0]["name"]
    assert name != "get_order" and out[3]["name"] == name and f"Use {name} first" in out[0]["content"]
    assert messages(augment.rename_tools(one, keep=("get_order",))) == messages(one)


def test_injected_error(one):
    out = messages(augment.inject_errors(one))
    assert [m["role"] for m in out] == ["system", "user", "assistant", "tool", "assistant", "user", "assistant", "tool", "assistant"]
    wrong = out[2]["tool_calls"][0]["arguments"]
    assert "W123" not in wrong and out[2]["context_only"] and out[3]["content"] == '{"ok": false, "kind": "business", "error": "Order not found"}'
    assert out[3]["tool_call_id"] == out[2]["tool_calls"][0]["id"] and "W123" in out[5]["content"] and out[6]["tool_calls"][0]["arguments"] == '{"order_id": "W123"}'
    assert messages(augment.inject_errors(one, ask_share=0.0))[4]["tool_calls"][0]["id"] == "c1"
    assert messages(augment.inject_errors(one, limit=0)) == messages(one) and messages(augment.inject_errors(one), "empty") == []


def test_several_errors_and_what_they_leave(spark):
    """Two of three lookups get an error; removing what was inserted gives the episode back; values of results are not asked for."""
    call = lambda i, name, value: ("assistant", "", [(f"c{i}", name, f'{{"order_id": "{value}"}}')], None, None, None)
    rows = [("user", "W111 and W222", None, None, None, None), call(1, "get_order", "W111"), ("tool", "see W333", None, "c1", "get_order", None), call(2, "find_order", "W222"), ("tool", "ok", None, "c2", "find_order", None), call(3, "get_order", "W333"), call(4, "cancel_order", "W111"), call(5, "get_order", "W999")]
    frame = spark.createDataFrame([("e", rows)], TYPE)
    for limit, many in ((1, 1), (2, 2), (9, 3)):
        out = messages(augment.inject_errors(frame, seed=limit, limit=limit))
        assert sum(bool(m["context_only"]) for m in out) == many
        kept, skip = [], 0
        for k, m in enumerate(out):
            if m["context_only"]:
                asked = out[k + 2]["role"] == "assistant" and not out[k + 2]["tool_calls"]
                assert out[k + 1]["content"] == "Error: Order not found" and asked == ("W333" not in out[k + 2 + 2 * asked]["tool_calls"][0]["arguments"])
                skip = 2 + 2 * asked
            if skip:
                skip -= 1
            else:
                kept.append(m)
        assert kept == messages(frame)
    made = augment.example_values(frame)
    examples = {(r["tool"], r["example"]) for r in made.collect()}
    out = messages(augment.inject_errors(frame, limit=9, examples=made))
    assert len(examples) >= 2 and not any(x in str(rows) for _, x in examples) and sum(bool(m["context_only"]) for m in out) == 3


def test_examples_are_never_real(one):
    row = augment.example_values(one).first()
    assert row["parameter"] == "order_id" and row["example"].startswith("W") and row["example"] != "W123"


def test_steps_by_share(spark, one):
    out = augment.in_order(one, {"greet": augment.greet, "vary": augment.vary_results}, {"greet": 1.0, "vary": 0.0})
    assert len(messages(out)) == 6 and out.count() == 2
    parts = F.array(F.struct(F.lit(2).alias("n"), F.lit(False).alias("trained")), F.struct(F.lit(1).alias("n"), F.lit(True).alias("trained")))
    assert spark.range(1).select(augment.loss_mask(parts).alias("m")).first()["m"] == [0, 0, 1]


def test_plans(spark):
    mix = {"direct": 0.1, "simple": 0.2, "ordinary": 0.15, "single_write": 0.25, "complex": 0.3}
    counts = {r["shape"]: r["count"] for r in augment.slot_plan(spark, ["a", "b"], 30, mix).groupBy("shape").count().collect()}
    assert counts == {"direct": 3, "simple": 6, "ordinary": 4, "single_write": 8, "complex": 9}
    spread = [r["x"] for r in spark.range(10).select(augment.even_spread(F.col("id"), 10, 0.3).alias("x")).collect()]
    assert sum(spread) == 3


def test_readers(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/m.jsonl").write_text('{"a": 1}\n{"b": 2}\n{"cut": ')
    assert readers.metric_rows(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "t.json").write_text('{"tasks": [{"id": "a", "split": "train", "weight": 1.0, "identity": "x"}, {"id": "a", "split": "other", "weight": -1.0, "identity": "y"}]}')
    bad = [set(r["problems"]) for r in readers.task_manifest(spark, str(tmp_path / "t.json")).collect()]
    assert bad == [{"repeated id"}, {"repeated id", "bad weight", "unknown split"}]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/f.txt").write_text("abc")
    found = readers.file_hashes(spark, str(tmp_path / "b"))
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    manifest = spark.createDataFrame([("f.txt", good), ("g.txt", "0")], "name string, sha256 string")
    assert [r["name"] for r in readers.changed_files(manifest, found).collect()] == ["g.txt"]
    (tmp_path / "teacher.jsonl").write_text('{"id": "t", "success": true, "messages": [{"role": "user", "content": "x"}]}\n{"id": "t", "success": false, "messages": []}\n{"id": "n", "success": false, "state_ok": true, "reward": 0.9, "field_scores": {"a": 0.5}, "messages": []}\n')
    assert readers.teacher_rows(spark, [str(tmp_path / "teacher.jsonl")]).count() == 1
    assert [r["id"] for r in readers.near_misses(spark, [str(tmp_path / "teacher.jsonl")]).collect()] == ["n"]
    readers.append_journal(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), str(tmp_path / "out"))
    assert sorted(str(r["x"]) for r in spark.read.schema("x double").json(str(tmp_path / "out")).collect()) == ["1.0", "None"]
    calls = spark.createDataFrame([("[f(a=1, b='x')]",), ("nope(",)], "t string").select(readers.pythonic_calls(F.col("t")).alias("c")).collect()
    assert calls[0]["c"][0]["arguments"] == '{"a": 1, "b": "x"}' and calls[1]["c"] is None
    turns = readers.chat_turns(spark.createDataFrame([("USER: hi\nASSISTANT: yo",)], "t string"), F.col("t")).first()["turns"]
    assert [(t["role"], t["content"]) for t in turns] == [("user", "hi"), ("assistant", "yo")]
