from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.functions import speech
from tidewright.operators import certify


@pytest.mark.parametrize(("text", "value", "said"), [("on May 31, 2024", "2024-05-31T18:00", True), ("5月31日", "2024-05-31", True), ("the 31st of May", "2024-05-31", True), ("you may 31 times", "2024-05-31", False), ("5/31", "2024-05-31", True), ("2024.05.31", "2024-05-31", True), ("May 31, 2023", "2024-05-31", False), ("May 30", "2024-05-31", False)])
def test_dates(spark, text, value, said):
    row = spark.createDataFrame([(text, value)], "t string, v string").withColumn("s", speech.stated(F.col("t")))
    assert row.select(speech.says_date(F.col("s"), F.col("v")).alias("x")).first()["x"] is said


@pytest.mark.parametrize(("text", "value", "said"), [("at 6 pm", "18:00", True), ("6:30 PM", "18:30", True), ("18点", "18:00", True), ("下午6点半", "18:30", True), ("6点", "06:00", True), ("下午6点", "06:00", False), ("6 am", "18:00", False)])
def test_times(spark, text, value, said):
    row = spark.createDataFrame([(text, value)], "t string, v string").withColumn("s", speech.stated(F.col("t")))
    assert row.select(speech.says_time(F.col("s"), F.col("v")).alias("x")).first()["x"] is said


@pytest.mark.parametrize(("text", "value", "said"), [("to Manchester", "MAN", False), ("via MAN today", "man", True), ("尾号 1028", "尾号1028", True), ("a.b", "a+b", False), ("Gift Card", "giftcard", True)])
def test_texts(spark, text, value, said):
    row = spark.createDataFrame([(text, value)], "t string, v string").withColumn("s", speech.stated(F.col("t")))
    assert row.select(speech.says_text(F.col("s"), F.col("v")).alias("x")).first()["x"] is said


def test_verified(spark):
    rows = spark.createDataFrame([("I refund $12.50 on May 3", k, v) for k, v in (("integer", "1250"), ("integer", "99"), ("string", "2024-05-03"), ("enum", "refused"))], "t string, k string, v string")
    out = rows.withColumn("s", speech.stated(F.col("t"))).select(speech.verified(F.col("t"), F.col("s"), F.col("k"), F.col("v")).alias("x")).collect()
    assert [r["x"] for r in out] == ["1250", None, "2024-05-03", "refused"]


@pytest.mark.parametrize(("text", "error", "calls"), [('<think>a</think>ok<tool_call>{"name": "f"}</tool_call>', None, 1), ("<think>a", "incomplete reasoning block", 0), ('x<tool_call>{"name": "f"}', "incomplete tool call", 1), ('<tool_call>{"name": "f"}</tool_call> more', "unexpected text after tool call", 1), ("<tool_call>{}</tool_call>", "tool call requires a function name", 1), ("x</tool_call>", "unexpected tool call end", 0), ("  ", "empty assistant response", 0), ("hi", None, 0)])
def test_parsed_reply(spark, text, error, calls):
    out = spark.createDataFrame([(text,)], "t string").select(certify.parsed_reply(F.col("t")).alias("p")).first()["p"]
    assert out["error"] == error and len(out["calls"]) == calls


def test_tools_policies_and_goals(spark):
    tools = spark.createDataFrame([("read_orders", False, [("id", "str")]), ("refund", True, [("terms", "dict"), ("id", "str")]), ("get_order", False, [("id", "str")])], "name string, write boolean, arguments array<struct<name:string,type:string>>")
    assert {(r["tool"], r["problem"]) for r in certify.tool_problems(tools, ["orders"]).collect()} == {("read_orders", "a generic table reader"), ("refund", "argument terms is an object")}
    policy = spark.createDataFrame([(1, "call get_order for Ann Lee", ["get_order"], ["Ann Lee"])], "policy_id int, text string, names array<string>, facts array<string>")
    assert certify.policy_leaks(policy).first()["leaks"] == ["Ann Lee", "get_order"]
    goals = "g array<struct<process:string,params:map<string,string>>>"
    rows = spark.createDataFrame([([("quote", {"paid": "12345"})],), ([("quote", {"paid": "10999"})],), ([("quote", {"paid": "20999"})],)], goals)
    keys = [r["k"] for r in rows.select(certify.goal_signature(F.col("g")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_reports(spark):
    m = spark.createDataFrame([("e", 0, "user", "hi", 0), ("e", 1, "assistant", "which?", 0), ("e", 2, "user", "A", 0), ("e", 3, "assistant", "", 1), ("e", 4, "tool", "x" * 900, 0)], "episode_id string, msg_idx int, role string, content string, n_calls int")
    stats = certify.dialogue_stats(m)
    assert tuple(stats.first())[1:] == (1, 2, True)
    assert certify.dialogue_report(stats, {"user_replies": 2}).first()["passed"] is False
    assert len(certify.transcripts(m, limit=100).first()["transcript"]) < 120
    gates = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True)], "task_id int, gate string, passed boolean")
    assert {r["task_id"]: (r["qualified"], r["failed"]) for r in certify.qualification(gates).collect()} == {1: (False, ["b"]), 2: (True, [])}
    sims = spark.createDataFrame([(["get_x", "cancel_x"], ["let me check"], True), ([], ["ok"], True)], "calls array<string>, texts array<string>, needs_write boolean")
    assert tuple(certify.tool_health(sims).first()) == (1.0, 0.5, 0.5, 0.5)


def test_masked_created(spark):
    kind = "table string, row_id string, cells map<string,string>"
    rows = spark.createDataFrame([("r", "new-7", {"order": "o1"}), ("o", "o1", {"refund": "new-7"})], kind)
    out = {r["row_id"]: r["cells"] for r in certify.masked_created(rows, spark.createDataFrame([("o", "o1", {})], kind)).collect()}
    assert out == {"<new>": {"order": "o1"}, "o1": {"refund": "<new>"}}
