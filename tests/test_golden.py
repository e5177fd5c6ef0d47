"""Values worked out by hand for single operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import numerals, rl
from tidewright.functions import scalars as S
from tidewright.operators import credit, episodes, grading, graph, joins, metrics, selection, statistics, text, validators, worlds


def one(spark, column, data="1", schema="x string"):
    return spark.createDataFrame([(data,)], schema).select(column.alias("y")).first()["y"]


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    ("r", "v", "t", "boot", "advantages"),
    [([0, 1], [0.2, 0.3], [False, True], 99, [0.8, 0.7]), ([0], [0.2], [False], 0.8, [0.6]), ([0], [0.2], [True], 0.8, [-0.2])],
)
def test_gae(spark, r, v, t, boot, advantages):
    flat = doubles(*[1] * len(r))
    out = one(spark, rl.gae(doubles(*r), doubles(*v), F.array(*map(F.lit, t)), F.lit(float(boot)), flat, flat))
    assert out == pytest.approx(advantages)


def test_group_advantages(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", 0.5), ("c", 1.0)], "g string, r double")
    out = sorted((r["g"], round(r["advantage"], 6)) for r in credit.group_advantages(rows, "g", "r").collect())
    assert out == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 0.0)]


def test_importance_diagnostics(spark):
    out = one(spark, rl.importance_diagnostics(doubles(0, -1000), doubles(-1000, -1000)))
    assert out["effective_sample_fraction"] == pytest.approx(0.5)
    assert one(spark, rl.importance_diagnostics(doubles(0, 0), doubles(0, 0)))["effective_sample_fraction"] == pytest.approx(1)
    clip = one(spark, rl.importance_diagnostics(doubles(math.log(0.7), math.log(1.3), 0), doubles(0, 0, 0), 0.2))
    assert clip["importance_clip_fraction"] == pytest.approx(2 / 3)


def test_low_probability_mask_and_weights(spark):
    logp = doubles(*map(math.log, (0.99, 0.4, 0.99, 0.4)))
    ones = F.array(*[F.lit(1)] * 4)
    assert one(spark, rl.spread_weight(F.lit(1.0), rl.low_probability_mask(logp, ones, 0.9))) == [0, 0.5, 0, 0.5]
    sure = doubles(*[math.log(0.99)] * 4)
    assert one(spark, rl.spread_weight(F.lit(1.0), rl.low_probability_mask(sure, ones, 0.9))) == [0.25] * 4


def test_sample_weights(spark):
    rows = spark.createDataFrame([("g", 1, 8), ("g", 2, 2)], "g string, e int, n int")
    weights = lambda kind: [r["weight"] for r in credit.sample_weights(rows, "g", "e", F.col("n"), aggregation=kind).orderBy("e").collect()]
    assert weights("token") == pytest.approx([0.8, 0.2])
    assert weights("sequence") == pytest.approx([0.5, 0.5])


TREE = "group_id string, episode_id int, role string, trunk int, fork_step int, reward double, n_actions int, trainable boolean"


def test_tree_segments(spark):
    rows = [("g", 0, "trunk", None, None, 0.0, 4, True), ("g", 1, "trunk", None, None, 1.0, 3, True), ("g", 2, "branch", 0, 2, 1.0, 2, True), ("g", 3, "branch", 0, 2, 1.0, 2, True)]
    out = {r["episode_id"]: r["advantages"] for r in credit.tree_advantages(spark.createDataFrame(rows, TREE)).collect()}
    spread, fork, root = math.sqrt(3 / 16), 2 / 3, 1 / 2
    first, second = 2 * (fork - root) / spread, ((0 - fork) + (0 - root)) / spread
    assert out[0] == pytest.approx([first, first, second, second])
    assert out[1] == pytest.approx([2 * (1 - root) / spread] * 3)
    assert out[2] == pytest.approx([((1 - fork) + (1 - root)) / spread] * 2)


def test_tree_grpo_leaves_untrainable_branches_out(spark):
    rows = [("g", 0, "trunk", None, None, 0.0, 4, True), ("g", 1, "trunk", None, None, 1.0, 3, True), ("g", 2, "branch", 0, 2, 1.0, 2, True), ("g", 3, "branch", 0, 2, 1.0, 2, False)]
    out = {r["episode_id"]: r["advantages"] for r in credit.tree_advantages(spark.createDataFrame(rows, TREE), mode="tree_grpo").collect()}
    spread, overall = math.sqrt(2 / 9), 2 / 3
    trunk, branch = (0 - 0.5) + (0 - overall), (1 - 0.5) + (1 - overall)
    assert out[0] == pytest.approx([(trunk + branch) / 2 / spread] * 2 + [trunk / spread] * 2)
    assert out[2] == pytest.approx([branch / spread] * 2)
    assert out[3] == [0.0, 0.0]


def test_choose_forks(spark):
    rows = spark.createDataFrame([("g", 0, 1, 0.9), ("g", 0, 2, 0.8), ("g", 1, 2, 0.5), ("g", 1, 0, 0.4)], "group_id string, trunk int, step int, score double")
    assert [(r["trunk"], r["step"]) for r in credit.choose_forks(rows, 2).orderBy("place").collect()] == [(0, 1), (1, 2)]


def test_task_scale(spark):
    rows = spark.createDataFrame([("t", 1, 1, 1.0), ("t", 1, 2, 0.0), ("t", 2, 3, 1.0), ("t", 2, 4, 0.0)], "t string, g int, i int, r double")
    out = credit.task_scale(rows, "t", "g", ["i"], "r", minimum=4).orderBy("g").collect()
    assert [r["scale"] for r in out] == [None, 0.5]


def test_epoch_schedule(spark):
    tasks = spark.createDataFrame([(i,) for i in range(5)], "id long")
    out = selection.epoch_schedule(tasks, "id", epochs=3, batch=2).cache()
    sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [2, 2, 1] * 3
    assert [r["n"] for r in out.groupBy("epoch").agg(F.count_distinct("id").alias("n")).collect()] == [5] * 3
    assert selection.prefetch_limit(out, 0).first()["limit"] == 4 and selection.prefetch_limit(out, 2).first()["limit"] == 7


def test_reward_of_a_half_right_answer(spark):
    lit = F.lit
    graded = grading.reward(has_effects=lit(True), state_ok=lit(True), fields=lit(2), scores=lit(1.0), all_right=lit(False), calls=lit(1), reference=lit(1), violations=lit(0), well_formed=lit(True))
    assert one(spark, graded["reward"]) == pytest.approx(0.475 + 0.2375)
    assert one(spark, graded["success"]) is False


def leaves(spark, *rows):
    schema = "k int, expected string, actual string, required boolean, internal boolean"
    return grading.object_scores(grading.leaf_matches(spark.createDataFrame([(1, *r) for r in rows], schema)), ["k"]).first()["score"]


def test_object_scores(spark):
    right, wrong = ("a", "a", False, False), ("a", "b", False, False)
    assert leaves(spark, right, right, wrong, ("done", "done", True, False)) == pytest.approx(2 / 3)
    assert leaves(spark, right, right, right, ("done", "refused", True, False)) == pytest.approx(0.5)
    assert leaves(spark, wrong, wrong, wrong, ("done", "done", True, False)) == 0
    assert leaves(spark, ("r1", None, False, True), right) == 1


SCHEMA = {
    "fields": {
        "refund": {
            "type": "object",
            "properties": {
                "return_id": {"type": "string"},
                "amount_cents": {"type": "integer"},
                "destination": {"type": "string"},
                "status": {"type": "string", "enum": ["done", "refused"]},
            },
        },
        "ids": {"type": "array", "items": {"type": "string"}, "order": "any"},
    }
}


def test_deep_scores_agree_with_the_flat_ones(spark):
    want = '{"refund": {"return_id": "R1", "amount_cents": 500, "destination": "card", "status": "done"}, "ids": ["a", "b"]}'
    cases = {
        want: (1.0, 1.0),
        '{"refund": {"return_id": "R1", "amount_cents": "5.00", "destination": "Card", "status": "done"}, "ids": ["b", "a"]}': (2 / 3, 1.0),
        '{"refund": {"return_id": "R1", "amount_cents": 500, "destination": "card", "status": "refused"}, "ids": ["a"]}': (0.5, 0.0),
        '{"refund": {"return_id": "", "amount_cents": 1, "destination": "x", "status": "done"}, "ids": ["a", "a"]}': (0.0, 0.0),
        "no json": (0.0, 0.0),
    }
    rows = spark.createDataFrame([(want, a) for a in cases], "expected string, actual string")
    for r in grading.deep_scores(rows, SCHEMA).collect():
        assert (r["scores"]["refund"], r["scores"]["ids"]) == pytest.approx(cases[r["actual"]])


def test_answer_problems():
    from tidewright.functions.answers import problems

    spec = SCHEMA["fields"]["refund"]
    assert problems(spec, {"return_id": "R", "amount_cents": 5.0, "destination": "d", "status": "done"}) == []
    assert problems(spec, {"return_id": "R", "amount_cents": True, "destination": "d", "status": "no"}) == ["answer.amount_cents: expected integer", "answer.status: 'no' not in enum"]
    assert problems({"type": "integer", "nullable": True}, None) == []


@pytest.mark.parametrize(("a", "b", "equal"), [("12.5", "$12.50", True), ("12.50", "12.5", True), ("12.51", "12.5", False), ("1,250", "1250", True), ("2024-05-31T18:00", "2024-05-31 18:00:00", True), ("2024-05-31", "2024-05-30", False), ("New York", "newyork ", True)])
def test_normal_text(spark, a, b, equal):
    assert one(spark, S.normal_text(F.lit(a)) == S.normal_text(F.lit(b))) is equal


@pytest.mark.parametrize(("text", "failed"), [("Error: no", True), ('{"ok": false}', True), ('{"ok": true}', False), ("fine", False), (None, False), ("[1]", False)])
def test_is_failure(spark, text, failed):
    assert one(spark, S.is_failure(F.col("x")), text) is failed


def test_calendar_and_clock(spark):
    assert [one(spark, S.is_calendar(F.lit(x))) for x in ("2024-02-29", "2023-02-29", "2024-05-31T18:00", "soon")] == [True, False, True, False]
    assert one(spark, S.shift(F.lit("2024-02-28T23:30"), F.lit(60))) == "2024-02-29T00:30"
    assert one(spark, S.shift(F.lit("2024-03-01"), F.lit(-1440))) == "2024-02-29"
    assert one(spark, S.clock_text(F.lit("2024-05-15 15:00:00").cast("timestamp"))) == "Current time: 2024-05-15 15:00 (Wednesday)"
    peak = lambda t: one(spark, S.is_peak(F.lit(t).cast("timestamp")))
    assert [peak("2024-05-15 01:00:00"), peak("2024-05-15 04:00:00"), peak("2024-05-18 02:00:00")] == [True, False, False]
    assert one(spark, S.seconds_to_switch(F.lit("2024-05-15 03:30:00").cast("timestamp"))) == 1800


@pytest.mark.parametrize(("text", "number", "said"), [("twelve offers", 12, True), ("it costs $12.50", 1250, True), ("一百八", 180, True), ("两个", 2, True), ("about 15%", 0.15, True), ("1块8", 180, True), ("you owe 5", -5, True), ("order 123", 12, False), ("1,234.50", 123450, True), ("十二", 12, True)])
def test_said(spark, text, number, said):
    assert one(spark, numerals.says(numerals.stated_numbers(F.col("x")), F.lit(float(number))), text) is said


def test_flags_and_grams(spark):
    assert one(spark, S.red_flags(F.lit("Please check with me first, it is 500 cents, then roll back"))) == sorted(["amount in cents (users say dollars)", "dictates the confirmation protocol", "transaction semantics"])
    assert one(spark, S.red_flags(F.lit("先告诉我再确认，500分"), "zh")) != []
    assert one(spark, S.character_grams(F.lit("ab c d"))) == ["abc", "bcd"]
    assert one(spark, S.character_grams(F.lit("ab"))) == ["ab"]
    assert one(spark, S.word_grams(F.lit("A b c"), 2)) == ["a b", "b c"]
    assert one(spark, S.word_grams(F.lit("A"), 2)) == []


def test_state_diff_lists_and_pure_counts(spark):
    a = spark.createDataFrame([("t", "x"), ("t", "x"), ("t", "y"), ("u", "z"), ("u", "z")], "t string, row string")
    b = spark.createDataFrame([("t", "x"), ("t", "w"), ("t", "x"), ("u", "z")], "t string, row string")
    out = {r["t"]: (r["missing"], r["unexpected"]) for r in joins.state_diff(a, b, ["t"], "row").collect()}
    assert out == {"t": (["y"], ["w"]), "u": ([], [])}


def test_scheduled_event_order(spark):
    rows = spark.createDataFrame([("c", "1", {"active": "true"})], "table string, row_id string, cells map<string,string>")
    events = spark.createDataFrame([("e1", 30, "c", "1", {"active": "false"})], "event_id string, at int, table string, row_id string, set map<string,string>")
    states = [worlds.apply_events(rows, events, now).first()["cells"]["active"] for now in (10, 25, 30)]
    assert states == ["true", "true", "false"]


def test_components_and_kept_splits(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (7, 7), (8, 99)], "a long, b long")
    labels = graph.components(nodes, edges)
    assert {r["id"]: r["root"] for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8}
    known = spark.createDataFrame([(3, "holdout-2")], "id long, split string")
    out = {r["id"]: r["split"] for r in graph.assign_splits(labels, known).collect()}
    assert out[1] == out[4] == "holdout-2" and out[5] == out[7] == "dev" and out[8] == "holdout-1"


def test_long_chain_is_one_component(spark):
    nodes = spark.range(300)
    edges = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(nodes, edges).select("root").distinct().count() == 1


def test_walks_stay_on_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    out = graph.walks(edges, spark.createDataFrame([(0, 1)], "walk int, id long"), 5).first()["path"]
    assert sorted(out) == [1, 2, 3]


def test_wilcoxon(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, -3.0, 4.0, 0.0)], "difference double")
    out = statistics.wilcoxon(rows).first()
    z = (7 - 5) / math.sqrt(4 * 5 * 9 / 24)
    assert (out["n"], out["w"]) == (4, 7) and out["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert statistics.wilcoxon(rows.where("difference = 0")).first()["p"] == 1.0


def test_group_metrics(spark):
    rows = spark.createDataFrame([("g", 0.0, True, None, False, 1, 2, 1, 0, 0), ("g", 1.0, True, None, False, 1, 2, 2, 0, 0)], "g string, reward double, terminated boolean, truncated boolean, context_limit boolean, actions int, tokens int, tool_calls int, token_limited int, protocol_errors int")
    out = metrics.group_metrics(rows, "g").first()
    assert (out["reward_mean"], out["reward_std"], out["generated_tokens"], out["success_rate"], out["truncation_rate"]) == (0.5, 0.5, 4, 0.5, 0.0)


def test_episode_operators(spark):
    m = "role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
    call = lambda i, name, args: [(i, name, args)]
    msgs = [
        ("user", "my id is A12", None, None), ("assistant", "", call("1", "get", '{"user_id": "A12"}'), None), ("tool", '{"ok": false}', None, "1"), ("assistant", "", call("2", "get", '{"user_id": "A12"}'), None),
        ("tool", '{"ok": true, "plan": "P9x"}', None, "2"), ("assistant", "Shall I change P9x?", None, None), ("user", "yes", None, None), ("assistant", "", call("3", "set", '{"order_id": "Z77"}'), None), ("tool", '{"ok": true}', None, "3"), ("assistant", "Done.", None, None),
    ]
    rows = spark.createDataFrame([("e", msgs)], f"episode_id string, messages array<struct<{', '.join(p.replace(' ', ':', 1) for p in m.split(', '))}>>")
    messages, calls = episodes.explode_messages(rows)
    calls = episodes.calls_with_results(calls, messages).withColumn("failed", S.is_failure(F.col("result"))).withColumn("write", F.col("name") == "set")
    assert [r["repeats"] for r in episodes.repeated_failures(calls).orderBy("msg_idx").collect()] == [False, True, False]
    assert [r["redundant"] for r in episodes.redundant_turns(calls).orderBy("msg_idx").collect()] == [False, True, False]
    assert [r["msg_idx"] for r in episodes.failed_turns(messages).collect()] == [1]
    assert episodes.last_words_before(messages, calls).first()["asked"] is True
    assert episodes.recoveries(messages).first()["recovered"] is True
    profile = episodes.call_profile(messages, calls).first()
    assert (profile["lookups"], profile["unused"], profile["invented"]) == (1, 0, 1)
    assert episodes.signature(messages, calls).first()["key"] == "get,get,set\ndone."
    assert [r["turn"] for r in episodes.training_examples(rows).orderBy("turn").collect()] == [2, 4, 6, 8, 10]


def test_idle_closure(spark):
    rows = spark.createDataFrame([("e", i, k) for i, k in enumerate(["chat", "chat", "tool", "chat", "chat", "chat", "chat"])], "episode_id string, seq int, kind string")
    out = episodes.idle_closure(rows).orderBy("seq").collect()
    assert [r["warned"] for r in out].index(True) == 5 and out[6]["closed"]


def test_validators(spark):
    rows = spark.createDataFrame([("a", "simple_agentic", "t", "r", ["x"], "en", None), ("", "odd", "t", None, [], "en", "soon")], "id string, category string, title string, user_request string, rules array<string>, language string, clock string")
    out = [r["problems"] for r in validators.requests(rows).orderBy(F.desc("id")).collect()]
    assert out[0] == [] and set(out[1]) == {"id is missing", "user request is missing", "unknown category", "no rules", "bad clock"}
    act = lambda r, p, a: one(spark, validators.rejection_action(F.lit(r), F.lit(p), F.lit(a), 3))
    assert [act("context_limit_empty", "fail", 0), act("policy_age", "skip", 0), act("policy_age", "skip", 2), act("zero_reward_variance", "retry_skip", 2), act("zero_reward_variance", "skip", 0)] == ["skip", "retry", "fail", "skip", "skip"]


def test_training_groups(spark):
    schema = "schema_version int, task_identity string, wanted_identity string, split string, policy_version int, episodes array<struct<seed:int,reward:double,terminated:boolean,bootstrap_prompt:array<int>,finish_reason:string,actions:array<struct<prompt:array<int>,tokens:array<int>,logp:array<double>>>>>"
    good = (2, "x", "x", "train", 0, [(1, 1.0, True, None, None, [([1], [2, 3], [-0.1, 0.0])])])
    bad = (1, "x", "y", "eval", 0, [(1, float("nan"), False, None, None, [([1], [2, 3], [-0.1])]), (2, 0.0, True, None, None, [])])
    out = [r["problems"] for r in validators.groups(spark.createDataFrame([good, bad], schema)).collect()]
    assert out[0] == [] and len(out[1]) == 7


def test_screen(spark):
    proposals = spark.createDataFrame([(1, True, "city library loans", "renew books"), (2, True, "bicycle repair", "fix a bike"), (3, False, "zoo", "animals"), (4, True, "casino chips", "bets")], "id long, accepted boolean, name string, detail string")
    taken = spark.createDataFrame([("city library loan", "lend items")], "name string, detail string")
    out = {r["id"]: r["reason"] for r in text.screen(proposals, taken, blocked="casino").collect()}
    assert out == {1: "too similar", 2: None, 3: "not accepted", 4: "blocked term"}


def test_generated_table_and_flips(spark):
    out = worlds.generated_table(spark, 3, {"id": {"kind": "sequence", "start": 1, "prefix": "A", "width": 3}, "c": {"kind": "cycle", "values": ["x", "y"]}}).collect()
    assert [(r["id"], r["c"]) for r in out] == [("A001", "x"), ("A002", "y"), ("A003", "x")]
    with pytest.raises(ValueError, match="unknown generator"):
        worlds.generated_table(spark, 1, {"id": {"kind": "magic"}})
    facts = spark.createDataFrame([(1, {"approve_a": "true", "reader": "R1", "approve_b": "false"})], "request_id int, facts map<string,string>")
    flips = {r["world"]: r["facts"] for r in worlds.approval_flips(facts).collect()}
    assert flips["flip:approve_a"]["approve_a"] == "false" and flips["flip:approve_b"]["approve_a"] == "true" and len(flips) == 2
