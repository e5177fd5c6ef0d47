"""Rules on user scripts and scenes, held as JSON of any shape: each element of a script promises something that its facts bear out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers and wishes that a user states in one opening, and items that an interactive task opens with.
MAX_NUMBERS, MAX_WANTS, MAX_KNOWN = 8, 3, 2


class Json:
    """A variant column with tests on what stands at a path; a missing value fails them all."""

    def __init__(self, value: Column):
        self.value = value

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.at(path)), F.lit("VOID"))

    def text(self, path: str) -> Column:
        """The text at a path, null where there is none or only white space."""
        found = F.try_variant_get(self.value, f"$.{path}", "string")
        return F.when((self.kind(path) == "STRING") & (F.trim(found) != ""), found)

    def number(self, path: str) -> Column:
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.value, f"$.{path}", "bigint"))

    def given(self, path: str) -> Column:
        """Whether the value is neither missing nor null, false, zero nor empty."""
        shown = F.try_variant_get(self.value, f"$.{path}", "string")
        return F.coalesce(~self.kind(path).isin("VOID") & ~shown.isin("", "false", "0", "[]", "{}"), F.lit(False))

    def items(self, path: str) -> Column:
        """Number of items of a list, null for others."""
        return F.size(F.try_variant_get(self.value, f"$.{path}", "array<variant>"))

    def strings(self, path: str) -> Column:
        return F.transform(F.try_variant_get(self.value, f"$.{path}", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))

    def is_object(self, path: str) -> Column:
        return self.kind(path).startswith("OBJECT")

    def entries(self, path: str) -> Column:
        """key, text and kind of the entries of an object, in order; null for others."""
        found = F.when(self.is_object(path), F.map_entries(F.try_variant_get(self.value, f"$.{path}", "map<string,variant>")))
        return F.transform(found, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("text"), F.schema_of_variant(e["value"]).alias("kind")))


def numbers_of(json: Column) -> Column:
    """The numbers of a JSON text in order, at any depth; texts and keys are skipped."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "")
    found = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), F.lit(0))
    return F.transform(F.coalesce(found, F.expr("cast(array() as array<string>)")), lambda n: n.try_cast("double"))


def scene_problems(scene: Column) -> Column:
    """What is wrong with a scene (JSON text): an object with a situation, a goal, known facts and a list of wishes, three at most."""
    whole = F.try_parse_json(F.concat(F.lit('{"scene":'), F.coalesce(scene, F.lit("null")), F.lit("}")))
    j, size = Json(whole), F.coalesce(Json(whole).items("scene.wants_to_know"), F.lit(-1))
    found = F.array_compact(
        F.array(
            *[F.when(j.text(f"scene.{key}").isNull(), f"{key} must be a text") for key in ("situation", "goal")],
            F.when(~j.is_object("scene.known"), "known must be an object"),
            F.when(size < 0, "wants_to_know must be a list"),
            F.when(size > MAX_WANTS, f"more than {MAX_WANTS} wishes"),
        )
    )
    return F.when(j.is_object("scene"), found).otherwise(F.array(F.lit("scene is missing")))


def script_problems(requests: DataFrame) -> DataFrame:
    """request_id and the problems of its script, in the order of the rules.

    ``requests``: request_id, elements (array), shape, script, facts, scene, tables (JSON texts; facts is an object). Without elements
    nothing is promised; without a script that is the only problem. Approvals are facts whose keys begin with approve.
    """
    parsed = F.try_parse_json(F.concat(*[x for name in ("script", "facts", "scene") for x in (F.lit(f'{"{" if name == "script" else ","}"{name}":'), F.coalesce(F.col(name), F.lit("null")))], F.lit("}")))
    rows = requests.withColumn("__j", parsed)
    j = Json(F.col("__j"))
    rows = rows.withColumn("__facts", F.coalesce(j.entries("facts"), F.expr("cast(array() as array<struct<key:string,text:string,kind:string>>)"))).withColumn("__known", F.coalesce(j.entries("scene.known"), F.expr("cast(array() as array<struct<key:string,text:string,kind:string>>)")))
    facts, known = F.col("__facts"), F.col("__known")
    keys, revealed = F.transform(facts, lambda e: e["key"]), F.coalesce(F.to_json(j.at("scene.known")), F.lit("{}"))
    approvals = F.size(F.filter(keys, lambda k: k.startswith("approve")))
    fact = lambda key: F.get(F.filter(facts, lambda e: e["key"] == key), 0)["text"]
    least = lambda path, n: F.coalesce(j.items(path) >= n, F.lit(False))
    wrong = j.entries("script.wrong_first")
    right, value = F.get(wrong, 0)["key"], F.get(wrong, 0)["text"]
    is_text = F.get(wrong, 0)["kind"] == "STRING"
    stands = F.contains(F.coalesce("tables", F.lit("")), F.concat(F.lit('"'), value, F.lit('"')))
    meant = j.text("script.ambiguous.fact")
    secret = lambda e: ~e["key"].startswith("approve") & e["kind"].isin("STRING", "BIGINT", "BOOLEAN") & ((e["kind"] == "BOOLEAN") | ~F.contains(revealed, e["text"]))
    lost = j.strings("script.forgotten")
    rules: list[tuple[str, Column, str]] = [
        ("fallback", ~(least("script.fallbacks", 2) & (approvals >= 2)), "two options or more, with an approval each"),
        ("pushback", ~(j.text("script.pushback.demand").isNotNull() & j.number("script.pushback.rounds").between(1, 3) & (j.text("script.pushback.then") == "accept")), "a demand, one to three rounds, and acceptance"),
        ("multi_goal", ~least("script.goals", 2), "two goals or more"),
        ("out_of_scope", ~(j.text("script.out_of_scope").isNotNull() & F.array_contains(j.strings("script.goals"), j.text("script.out_of_scope"))), "a request that is also a goal"),
        ("wrong_first", ~(F.size(wrong) == 1), "one fact and its wrong value"),
        ("wrong_first", (F.size(wrong) == 1) & ~F.array_contains(keys, right), "the fact is unknown"),
        ("wrong_first", (F.size(wrong) == 1) & F.array_contains(keys, right) & ~F.coalesce(is_text & (value != "") & ~value.eqNullSafe(fact(right)) & ~stands, F.lit(False)), "the wrong value must differ and stand nowhere"),
        ("inquisitive", ~least("script.inquisitive", 1), "a list of questions"),
        ("change_of_mind", ~(j.given("script.change_of_mind.from") & j.given("script.change_of_mind.to") & j.given("script.change_of_mind.after") & (approvals >= 2)), "from, to and after, with an approval each"),
        ("ambiguous", ~(j.text("script.ambiguous.phrase").isNotNull() & F.array_contains(keys, meant)), "a phrase and a known fact"),
        ("ambiguous", j.text("script.ambiguous.phrase").isNotNull() & F.array_contains(keys, meant) & F.contains(revealed, fact(meant)), "the opening reveals the fact"),
        ("clarify", ~(j.items("script.clarify.options").between(2, 3) & j.given("script.clarify.decides_by") & (approvals >= 2)), "two or three options, what decides, and an approval each"),
        ("identity", ~F.exists(facts, secret), "an identifier that the opening does not reveal"),
        ("forgotten", ~least("script.forgotten", 1), "the name of what is forgotten"),
        ("forgotten", least("script.forgotten", 1) & F.exists(lost, lambda name: F.array_contains(keys, name) | F.array_contains(F.transform(known, lambda e: e["key"]), name)), "what is forgotten must be known nowhere"),
    ]
    promised = lambda name: F.array_contains("elements", name)
    traits = F.when(~least("script.traits", 1), "traits: a list of traits")
    opening = F.when(~promised("direct") & (F.size(known) > MAX_KNOWN), f"known: more than {MAX_KNOWN} items")
    found = F.array_compact(F.array(traits, *[F.when(promised(name) & F.coalesce(broken, F.lit(True)), f"{name}: {text}") for name, broken, text in rules], opening))
    none = F.expr("cast(array() as array<string>)")
    problems = F.when(F.coalesce(F.size("elements"), F.lit(0)) <= 0, none).when(~j.is_object("script"), F.array(F.lit("script is missing"))).otherwise(found)
    return rows.select("request_id", problems.alias("problems"))


def request_problems(requests: DataFrame) -> DataFrame:
    """request_id and problems of requests: those of the scene alone if it has any, else of the shape and of the script.

    Beside the columns of ``script_problems``: shape, category and wanted_category, reward_type, language and wanted_language.
    A direct task has no table rows and one to eight numbers in its scene; single writes need an approval, complex tasks two.
    """
    scene = scene_problems(F.col("scene"))
    facts = F.map_entries(F.from_json("facts", "map<string,string>"))
    approvals = F.filter(facts, lambda e: e["key"].startswith("approve"))
    known = F.coalesce(F.get_json_object("scene", "$.known"), F.lit("{}"))
    numbers, direct = F.size(numbers_of(known)), F.col("shape") == "direct"
    filled = F.coalesce(F.regexp_like("tables", F.lit(r"\[\s*[^\]\s]")), F.lit(False))
    wanted = F.when(F.col("shape") == "subjective", "rubric").otherwise("business")
    own = F.array_compact(
        F.array(
            F.when(F.exists(approvals, lambda e: ~e["value"].isin("true", "false")), "an approval is no truth"),
            F.when(~F.coalesce("wanted_language", F.lit("zh")).eqNullSafe(F.coalesce("language", F.lit("zh"))), "another language"),
            F.when(F.col("wanted_category") != F.col("category"), "another category"),
            F.when(F.coalesce("reward_type", F.lit("business")) != wanted, "another reward"),
            F.when((F.col("shape") == "single_write") & (F.size(approvals) == 0), "a single write needs an approval"),
            F.when((F.col("shape") == "complex") & (F.size(approvals) < 2), "a complex task needs two approvals"),
            F.when(direct & filled, "a direct task needs no rows"),
            F.when(direct & (numbers == 0), "a direct task needs its numbers"),
            F.when(direct & (numbers > MAX_NUMBERS), f"more than {MAX_NUMBERS} numbers"),
        )
    )
    rows = requests.select("request_id", scene.alias("__scene"), own.alias("__own")).join(script_problems(requests), "request_id")
    return rows.select("request_id", F.when(F.size("__scene") > 0, F.col("__scene")).otherwise(F.concat("__own", "problems")).alias("problems"))
