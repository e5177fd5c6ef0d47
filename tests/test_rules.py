"""Rules that were once wrong: numerals, clocks and months, renames, injected errors, new rows, line numbers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import numerals, speech
from tidewright.operators import augment, certify, grading, joins, records
from tidewright.sources import readers, shared

MESSAGE = "role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, name string, context_only boolean"


@pytest.mark.parametrize(
    ("text", "found"),
    [("3.5万", [3.5]), ("百分之五", [5]), ("百", []), ("一百", [100]), ("十", [10]), ("十二", [12]), ("一百八", [180]), ("一万二", [12_000]), ("千万", []), ("两千零五", [2005]), ("二十", [20]), ("三百一十", [310]), ("一千万", [10_000_000])],
)
def test_chinese_units_need_a_sign(text, found):
    assert numerals.numbers_in(text) == [float(x) for x in found]


def test_midnight_and_may():
    assert speech.times_in("凌晨12点") == ["00:00", "12:00"] and speech.times_in("中午12点") == ["12:00"] and speech.times_in("凌晨3点") == ["03:00"]
    assert speech.dates_in("May 3") == ["0000-05-03"] and speech.dates_in("MAY 3") == [] and speech.dates_in("you may 3 times") == []
    assert speech.dates_in("MARCH 3") == ["0000-03-03"]


def episode(spark, calls: list[tuple[str, str]], prompt: str = ""):
    rows = [("system", prompt, [], None, None, False), ("user", "I am W123.", [], None, None, False)]
    for i, (name, arguments) in enumerate(calls):
        rows += [("assistant", "", [(f"c{i}", name, arguments)], None, None, False), ("tool", "ok", [], f"c{i}", name, False)]
    return spark.createDataFrame([(f"e{k}", rows) for k in range(40)], f"episode_id string, messages array<struct<{MESSAGE.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>")


def test_errors_are_injected_before_lookups_only(spark):
    arguments = '{"order_id": "W123"}'
    for name, more in (("cancel_order", 0), ("get_order", 4), ("lookup", 4), ("order", 0)):
        out = augment.inject_error(episode(spark, [(name, arguments)])).select(F.size("messages").alias("n")).collect()
        assert {r["n"] for r in out} == {4 + more}, name


def test_renames_never_chain(spark):
    names = ["get_order", "fetch_order", "lookup_order", "read_order", "show_order", "retrieve_order"]
    out = augment.rename_tools(episode(spark, [(n, "{}") for n in names], "Tools: " + ", ".join(names) + "."))
    for r in out.collect():
        called = [m["tool_calls"][0]["name"] for m in r["messages"] if m["role"] == "assistant"]
        assert r["messages"][0]["content"] == "Tools: " + ", ".join(called) + "."
        assert len(set(called)) == 6 and not set(called) & set(names)


def test_parameters_are_renamed_with_their_values(spark):
    given = ['{"order_id": "W1", "item_ids": ["a", 2], "consent": true}', '{"order_id": "W2"}', "no json"]
    out = augment.rename_parameters(episode(spark, [("get_order", a) for a in given])).collect()
    kinds = set()
    for r in out:
        first, second, third = (m["tool_calls"][0]["arguments"] for m in r["messages"] if m["role"] == "assistant")
        a, b = json.loads(first), json.loads(second)
        names = list(a)
        assert sorted(map(str, a.values())) == sorted(map(str, ["W1", ["a", 2], True])) and a["consent"] is True and third == "no json"
        assert list(b.values()) == ["W2"] and set(b) <= set(names) and len(names) == 3
        kinds.add(next(iter(b)))
    assert len(kinds) > 1


def test_new_ids_are_new_in_their_table_only(spark):
    kind = "table string, row_id string, cells map<string,string>"
    initial = spark.createDataFrame([("b", "1", {"id": "1"})], kind)
    rows = spark.createDataFrame([("a", "1", {"id": "1"}), ("b", "1", {"id": "1", "a_id": "1", "b_id": "1", "note": "1"})], kind)
    out = {r["table"]: (r["row_id"], r["cells"]) for r in certify.masked_created(rows, initial, references={"a_id": "a", "b_id": "b"}).collect()}
    assert out == {"a": ("<new>", {"id": "<new>"}), "b": ("1", {"id": "1", "a_id": "<new>", "b_id": "1", "note": "1"})}


def test_lines_are_numbered_whatever_the_pieces(spark, tmp_path):
    for name, first in (("a.json", 0), ("b.json", 500)):
        (tmp_path / name).write_text("".join(f'{{"v": {i}}}\n' for i in range(first, first + 500)))
    digests = []
    for size in ("128m", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = readers.numbered_lines(spark, str(tmp_path))
        assert [(r["number"], r["value"]) for r in lines.orderBy("number").collect()] == [(i, f'{{"v": {i}}}') for i in range(1000)]
        digests.append(readers.journal_digest(lines).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert digests[0] == digests[1] and readers.metric_rows(spark, str(tmp_path)).count() == 1000


def test_overlap_keeps_repeated_rows(spark):
    kind = "k long, start long, end long, tag string"
    left = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 5, "a"), (1, 20, 30, "b"), (2, 0, 5, "c")], kind)
    out = joins.overlapping(left, spark.createDataFrame([(1, 4, 6, "x")], kind), ["k"], width=3).collect()
    assert [r["tag"] for r in out] == ["a", "a"]


def test_other_names_of_the_expected_record(spark):
    names = joins.aliases(spark.createDataFrame([("r1", "name", "Basic Saver"), ("r2", "name", "Twin"), ("r3", "name", "Twin")], "row_id string, column string, value string"))
    leaves = spark.createDataFrame([("r1", "basic saver"), ("r1", "BASIC SAVER"), ("r1", "Twin"), ("r2", "Twin"), ("r1", None)], "expected string, actual string")
    assert [r["renamed"] for r in records.alias_matches(leaves, names).collect()].count(True) == 2


def test_persona_is_stable(spark):
    out = spark.range(200).select(records.persona(F.col("id"), 7).alias("p")).collect()
    assert {r["p"] for r in out} == set(range(7))


def test_shared_folder_is_wanted_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Session)


SCHEMA = {"fields": {"refund": {"type": "object", "properties": {"id": {"type": "string"}, "cents": {"type": "integer"}, "status": {"type": "string", "enum": ["done", "refused"]}}}, "ids": {"type": "array", "order": "any", "items": {"type": "string"}}, "days": {"type": "array", "items": {"type": "string"}}}}


@pytest.mark.parametrize(
    ("want", "got", "known", "names", "scores"),
    [
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": "r_1", "cents": 5, "status": "done"}, None, None, 1.0),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": "r_1", "cents": 6, "status": "done"}, None, None, 0.5),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": "r_1", "cents": 6, "status": "refused"}, None, None, 0.25),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": None, "cents": 5, "status": "done"}, ["nothing"], None, 1.0),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": None, "cents": 5, "status": "done"}, ["my r_1"], None, 0.5),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": "Basic  Saver", "cents": 5, "status": "done"}, None, {"basic saver": "r_1"}, 1.0),
        ({"id": "r_1", "cents": 5, "status": "done"}, {"id": "Basic Saver", "cents": 5, "status": "done"}, None, {"basic saver": "r_2"}, 0.5),
        ({"id": None, "cents": None, "status": "done"}, {"id": "x", "cents": None, "status": "done"}, None, None, 1 / 3),
        ({"id": None, "cents": None, "status": "done"}, {"id": None, "cents": None, "status": "refused"}, None, None, 0.0),
    ],
)
def test_partial_credit_of_an_object(spark, want, got, known, names, scores):
    rows = spark.createDataFrame([(json.dumps({"refund": want}), json.dumps({"refund": got}), known, names)], "expected string, actual string, known array<string>, names map<string,string>")
    out = grading.deep_scores(rows, SCHEMA, known="known", names="names").first()["scores"]
    assert out["refund"] == pytest.approx(scores) and out["ids"] == 0.0


def test_lists_by_order_and_as_bags(spark):
    cases = [(["a", "b"], ["b", "a"], 1.0, 0.0), (["a", "b"], ["a", "c"], 0.0, 0.5), (["a"], ["a", "a"], 0.0, 0.0), ([], [], 1.0, 1.0), (["a_1", "b"], ["b", ""], 1.0, 0.0)]
    rows = spark.createDataFrame([(json.dumps({"ids": w, "days": w}), json.dumps({"ids": g, "days": g}), ["b"]) for w, g, _, _ in cases], "expected string, actual string, known array<string>")
    for r, (_, _, bag, row) in zip(grading.deep_scores(rows, SCHEMA, known="known").collect(), cases, strict=True):
        assert (r["scores"]["ids"], r["scores"]["days"]) == (bag, row)
