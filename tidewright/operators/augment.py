"""Augmentation of episodes as transforms of their message arrays, by deterministic hash draws.

``episodes`` has episode_id and messages (array of role, content, tool_calls(id, name, arguments), tool_call_id, name,
context_only). Each operator returns the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.functions.ordering import hash_choice, hash_number, hash_uniform

# Synonym groups, prefixes, greetings, layouts and replies.
SYNONYMS = (
    ("get", "fetch", "lookup", "retrieve", "read", "show"),
    ("list", "enumerate", "browse", "show_all"),
    ("search", "find", "query", "locate"),
    ("check", "verify", "validate", "inspect", "evaluate"),
    ("create", "open", "add", "make", "register"),
    ("update", "modify", "change", "edit", "amend"),
    ("cancel", "void", "revoke", "withdraw"),
    ("delete", "remove", "drop"),
    ("book", "reserve", "schedule"),
    ("refund", "reimburse", "repay"),
    ("submit", "file", "send"),
    ("apply", "use", "redeem"),
    ("customer", "client", "member", "account_holder"),
    ("user", "person", "profile"),
    ("order", "purchase"),
    ("booking", "reservation"),
    ("item", "product", "line_item"),
    ("details", "info", "record", "summary"),
    ("status", "state"),
    ("quote", "estimate", "price_check"),
    ("payment", "charge"),
    ("policy", "rules"),
    ("request", "ticket", "case"),
)
PREFIXES = ("do", "run", "svc", "api", "tool")
GREETINGS = {
    "en": ("Hi! How can I help you today?", "Hello, how can I help you?", "Hi there, what can I do for you today?"),
    "zh": ("您好，请问有什么可以帮您？", "你好，有什么需要帮忙的吗？"),
}
READ_WORDS = tuple(w for group in SYNONYMS[:4] for w in group) + ("view", "calculate", "compute", "quote", "estimate")
POLICY_LABELS = ("\n\nPolicy:\n", "\n\n业务规则：\n")
TURN_RULE = "In each turn either send one message to the user or make tool calls."
ASK_AGAIN = {
    "en": (
        "I couldn't find a {entity} with {wrong}. Could you double-check it for me?",
        "Sorry, {wrong} doesn't match any {entity} on our side. Could you check the number again?",
        "I'm not finding {wrong} in our system. Could you confirm the {entity} once more?",
    ),
    "zh": ("没有查到 {wrong}，麻烦您再核对一下这个编号？", "系统里没有 {wrong} 的记录，请您再确认一下好吗？"),
}
CORRECTED = {
    "en": ("Sorry, it's {value}.", "Oops, my mistake: {value}.", "Let me check... it's {value}."),
    "zh": ("不好意思，是 {value}。", "抱歉说错了，是 {value}。"),
}
STYLES = ("envelope", "raw", "raw", "text")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rendered_result(content: Column, style: Column) -> Column:
    """A tool result as the agent reads it.

    ``envelope`` leaves it; ``raw`` gives the result, or ``Error: <message>``; ``text`` the result, or the message. Texts
    that are no envelope stay as they are; a notice goes on a line of its own.
    """
    v = F.try_parse_json(content)
    ok = F.try_variant_get(v, "$.ok", "boolean")
    text = F.coalesce(F.try_variant_get(v, "$.result", "string"), F.lit("null"))
    notice = F.coalesce(F.concat(F.lit("\n"), F.try_variant_get(v, "$.notice", "string")), F.lit(""))
    error = F.concat(F.coalesce(F.nullif(F.try_variant_get(v, "$.error", "string"), F.lit("")), F.lit("request failed")), notice)
    changed = F.when(ok, F.concat(text, notice)).when(style == "raw", F.concat(F.lit("Error: "), error)).otherwise(error)
    return F.when(ok.isNull() | (style == "envelope"), content).otherwise(changed)


def map_messages(episodes: DataFrame, change) -> DataFrame:
    """episodes with change(message) in place of each message; change returns a dict of new fields."""
    fields = [f.name for f in episodes.schema["messages"].dataType.elementType.fields]

    def one(m: Column) -> Column:
        new = change(m)
        return F.struct(*[new.get(f, m[f]).alias(f) for f in fields])

    return episodes.withColumn("messages", F.transform("messages", one))


def vary_results(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """All tool results of an episode in one style, drawn by episode."""
    styled = episodes.withColumn("__s", hash_choice(seed, "envelope", _strings(STYLES), "episode_id"))
    return map_messages(styled, lambda m: {"content": F.when(m["role"] == "tool", rendered_result(m["content"], F.col("__s"))).otherwise(m["content"])}).drop("__s")


def greet(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """A greeting, for context only, before the first user message, unless the assistant spoke first or no user does."""
    roles = F.transform("messages", lambda m: m["role"])
    at = F.array_position(roles, "user").cast("int")
    first = F.get("messages", at - 1)["content"]
    greeting = F.when(F.regexp_like(F.coalesce(first, F.lit("")), F.lit("[一-鿿]")), hash_choice(seed, "greet", _strings(GREETINGS["zh"]), "episode_id")).otherwise(
        hash_choice(seed, "greet", _strings(GREETINGS["en"]), "episode_id")
    )
    kind = episodes.schema["messages"].dataType.elementType
    new = {"role": F.lit("assistant"), "content": greeting, "context_only": F.lit(True)}
    message = F.struct(*[new.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    opened = F.concat(F.slice("messages", F.lit(1), at - 1), F.array(message), F.slice("messages", F.greatest(at, F.lit(1)), F.size("messages")))
    silent = ~F.array_contains(F.slice(roles, F.lit(1), F.greatest(at - 1, F.lit(0))), "assistant")
    return episodes.withColumn("messages", F.when((at > 0) & silent, opened).otherwise(F.col("messages")))


def system_parts(content: Column) -> Column:
    """instructions, label, policy and clock of a system prompt; null where it has no policy."""
    label = F.when(content.contains(POLICY_LABELS[0]), POLICY_LABELS[0]).when(content.contains(POLICY_LABELS[1]), POLICY_LABELS[1])
    at = F.locate(POLICY_LABELS[0], content)
    at = F.when(at > 0, at).otherwise(F.locate(POLICY_LABELS[1], content))
    rest = F.substring(content, at + F.length(label), F.length(content))
    clock = F.substring_index(rest, "\n\n", -1)
    split = rest.contains("\n\n") & (F.length(clock) + 2 < F.length(rest))
    return F.when(
        label.isNotNull(),
        F.struct(
            F.substring(content, F.lit(1), at - 1).alias("instructions"),
            F.regexp_replace(label, r"^\s+|\s+$", "").alias("label"),
            F.when(split, F.substring(rest, F.lit(1), F.length(rest) - F.length(clock) - 2)).otherwise(rest).alias("policy"),
            F.when(split, F.concat(F.lit("\n\n"), clock)).otherwise("").alias("clock"),
        ),
    )


def laid_out(content: Column, layout: Column) -> Column:
    """A system prompt in another layout (tags, markdown or policy_first); unchanged where it has no policy."""
    p = system_parts(content)
    tags = F.concat(F.lit("<instructions>\n"), p["instructions"], F.lit(f"\n{TURN_RULE}\n</instructions>\n<policy>\n"), p["policy"], F.lit("\n</policy>"), p["clock"])
    markdown = F.concat(F.lit("# Role\n"), p["instructions"], F.lit("\n\n# Policy\n"), p["policy"], p["clock"])
    first = F.concat(p["label"], F.lit("\n"), p["policy"], F.lit("\n\n"), p["instructions"], p["clock"])
    return F.when(p.isNull(), content).when(layout == "tags", tags).when(layout == "markdown", markdown).when(layout == "policy_first", first).otherwise(content)


def relayout(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """The system prompt of an episode in a layout drawn by episode."""
    drawn = episodes.withColumn("__l", hash_choice(seed, "layout", _strings(("markdown", "policy_first", "tags")), "episode_id"))
    return map_messages(drawn, lambda m: {"content": F.when(m["role"] == "system", laid_out(m["content"], F.col("__l"))).otherwise(m["content"])}).drop("__l")


def renamed(names: DataFrame, seed: int = 0, by: tuple[str, ...] = ("episode_id",), must: bool = True) -> DataFrame:
    """The keys ``by``, name and new: names under other names, each word by a synonym with four chances in five.

    A name that would stay gets a prefix if it ``must`` change; one that another name of the keys has, or had, a number.
    """
    keys = list(by)
    words = F.split("name", "_")
    table = F.create_map(*[x for group in SYNONYMS for w in group for x in (F.lit(w), _strings([o for o in group if o != w]))])

    def swap(w: Column, i: Column) -> Column:
        others = F.try_element_at(table, w)
        draw = hash_number(seed, "word", *keys, "name", i)
        chosen = F.get(others, F.pmod(F.shiftright(draw, 8), F.size(others)).cast("int"))
        return F.when(others.isNotNull() & (F.pmod(draw, F.lit(5)) < 4), chosen).otherwise(w)

    new = F.array_join(F.transform(words, swap), "_")
    prefix = hash_choice(seed, "prefix", _strings(PREFIXES), *keys, "name")
    rows = names.select(*keys, "name").distinct()
    rows = rows.join(rows.groupBy(*keys).agg(F.collect_set("name").alias("__old")), keys)
    rows = rows.withColumn("new", F.when((new == F.col("name")) & F.lit(must), F.concat_ws("_", prefix, "name")).otherwise(new))
    place = F.row_number().over(Window.partitionBy(*keys, "new").orderBy("name"))
    number = place + (F.array_contains("__old", F.col("new")) & (F.col("new") != F.col("name"))).cast("int")
    return rows.withColumn("new", F.when(number > 1, F.concat_ws("_", "new", number.cast("string"))).otherwise(F.col("new"))).drop("__old")


def rename_parameters(episodes: DataFrame, seed: int = 0, keep: tuple[str, ...] = ("consent",)) -> DataFrame:
    """Parameters renamed in the arguments of calls, the same way for a tool all through an episode; names in ``keep`` stay.

    Values are kept as JSON values; arguments that are no JSON object stay as they are.
    """
    calls = episodes.select("episode_id", F.explode("messages").alias("m")).select("episode_id", F.explode("m.tool_calls").alias("c"))
    kind = "map<string,variant>"
    used = calls.select("episode_id", F.col("c.name").alias("tool"), F.explode(F.map_keys(F.from_json("c.arguments", kind))).alias("name"))
    mapping = renamed(used.where(~F.col("name").isin(list(keep) or [""])), seed, ("episode_id", "tool"), must=False)
    held = mapping.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n", "tool", "name"), "new"))).alias("__m"))
    rows = episodes.join(held, "episode_id", "left").withColumn("__m", F.coalesce("__m", F.expr("cast(map() as map<string,string>)")))
    fields = episodes.schema["messages"].dataType.elementType["tool_calls"].dataType.elementType.fields

    def call(c: Column) -> Column:
        moved = F.transform_keys(F.from_json(c["arguments"], kind), lambda k, v: F.coalesce(F.try_element_at("__m", F.concat_ws("\n", c["name"], k)), k))
        return F.struct(*[(F.coalesce(F.to_json(moved), c["arguments"]) if f.name == "arguments" else c[f.name]).alias(f.name) for f in fields])

    return map_messages(rows, lambda m: {"tool_calls": F.transform(m["tool_calls"], call)}).drop("__m")


def rename_tools(episodes: DataFrame, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tools renamed in calls, results and system prompts, the same way all through an episode; names in ``keep`` stay.

    A prompt is rewritten word by word in one pass, so a new name is never renamed again.
    """
    called = episodes.select("episode_id", F.explode(F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["name"]), F.expr("cast(array() as array<string>)"))))).alias("name"))
    mapping = renamed(called.where(~F.col("name").isin(list(keep) or [""])), seed).groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "new")))).alias("__m"))
    rows = episodes.join(mapping, "episode_id", "left").withColumn("__m", F.coalesce("__m", F.expr("cast(map() as map<string,string>)")))
    new = lambda n: F.coalesce(F.try_element_at("__m", n), n)
    kind = episodes.schema["messages"].dataType.elementType["tool_calls"].dataType.elementType
    call = lambda c: F.struct(*[(new(c[f.name]) if f.name == "name" else c[f.name]).alias(f.name) for f in kind.fields])
    text = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\w+|\W+"), F.lit(0)), new), "")

    def change(m: Column) -> dict[str, Column]:
        return {
            "tool_calls": F.transform(m["tool_calls"], call),
            "name": F.when(m["role"] == "tool", new(m["name"])).otherwise(m["name"]),
            "content": F.when(m["role"] == "system", text(m["content"])).otherwise(m["content"]),
        }

    return map_messages(rows, change).drop("__m")


def other_digits(value: Column, taken: Column, *keys: Column | str, seed: int = 0) -> Column:
    """A value of the same shape that ``taken`` (a text) does not hold: null if there is none.

    In one half of the draws all digits as zeros come first; then all moved by one to nine, from a drawn step on.
    """
    digits = "0123456789"
    moved = F.array(*[F.translate(value, digits, digits[k:] + digits[:k]) for k in range(1, 10)])
    step = F.pmod(hash_number(seed, "digits", *keys), F.lit(9)).cast("int")
    turned = F.concat(F.slice(moved, step + 1, F.lit(9)), F.slice(moved, F.lit(1), step))
    zeros = F.when(hash_uniform(seed, "zeros", *keys) < 0.5, F.array(F.regexp_replace(value, "[0-9]", "0"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.get(F.filter(F.concat(zeros, turned), lambda x: (x != value) & ~F.contains(taken, x)), 0)


def id_values(episodes: DataFrame) -> DataFrame:
    """episode_id, tool, parameter and the first value that a call gave an identifier parameter (a digit, three characters)."""
    m = episodes.select("episode_id", F.posexplode("messages").alias("i", "m")).select("episode_id", "i", F.posexplode("m.tool_calls").alias("j", "c"))
    pairs = m.select("episode_id", "i", "j", F.col("c.name").alias("tool"), F.posexplode(F.map_entries(F.from_json("c.arguments", "map<string,string>"))).alias("k", "e"))
    kept = pairs.where(F.regexp_like("e.key", F.lit(S.ID_KEY)) & F.regexp_like("e.value", F.lit("[0-9]")) & (F.length("e.value") >= 3))
    return kept.groupBy("episode_id", "tool", F.col("e.key").alias("parameter")).agg(F.min_by("e.value", F.struct("i", "j", "k")).alias("value"))


def example_values(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """episode_id, tool, parameter and example: a made-up value for its description that the episode never uses."""
    used = episodes.select("episode_id", F.to_json("messages").alias("t"))
    rows = id_values(episodes).where(F.regexp_like("value", F.lit("[0-9]"))).join(used, "episode_id")
    made = other_digits(F.col("value"), F.col("t"), "episode_id", "tool", "parameter", seed=seed)
    return rows.withColumn("example", made).where("example is not null").select("episode_id", "tool", "parameter", "example")


def is_lookup(name: Column) -> Column:
    """Whether a word of a tool's name reads."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(name), "_"), _strings(READ_WORDS)), F.lit(False))


def inject_errors(episodes: DataFrame, seed: int = 0, limit: int = 1, ask_share: float = 1.0, examples: DataFrame | None = None) -> DataFrame:
    """Before up to ``limit`` lookups with an identifier that the episode has seen: the same call with a wrong one, and its error.

    A lookup is a tool with a reading word in its name: a wrong identifier in a write would mean something else. Turns of a
    single call without words come before others, each kind in a hash order, one call a turn. The wrong identifier is, three
    times in five, the example of ``examples`` (as ``example_values`` gives them), else the right one with another digit; one
    that the episode holds is not used, and its turn stays as it is. The wrong call is context. Where the user was the first to
    say the right one, the agent asks again with the share ``ask_share`` of chances, which is trained, and the user corrects.
    """
    kind = episodes.schema["messages"].dataType.elementType
    calls = kind["tool_calls"].dataType.elementType
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in kind.fields}
    message = lambda **x: F.struct(*[x.get(f.name, nothing[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    rows = episodes.withColumn("__taken", F.to_json("messages"))
    rows = rows.withColumn("__texts", F.transform("messages", lambda m: F.concat_ws("\n", m["role"], m["content"], F.to_json(m["tool_calls"]))))
    if examples is not None:
        held = examples.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n", "tool", "parameter"), "example"))).alias("__examples"))
        rows = rows.join(held, "episode_id", "left")
    else:
        rows = rows.withColumn("__examples", F.expr("cast(null as map<string,string>)"))

    def candidate(m: Column, i: Column) -> Column:
        """The first identifier of the first fitting call of a message, if it has any."""
        seen = F.array_join(F.slice("__texts", F.lit(1), i), "\n")
        entries = lambda c: F.map_entries(F.from_json(c["arguments"], "map<string,variant>"))
        text = lambda e: F.try_variant_get(e["value"], "$", "string")
        fits = lambda e: (F.schema_of_variant(e["value"]) == "STRING") & F.regexp_like(e["key"], F.lit(S.ID_KEY)) & F.regexp_like(text(e), F.lit("[0-9]")) & (F.length(text(e)) >= 3) & F.contains(seen, text(e))
        found = F.flatten(F.transform(F.filter(m["tool_calls"], lambda c: is_lookup(c["name"])), lambda c: F.transform(F.slice(F.filter(F.coalesce(entries(c), F.map_entries(F.from_json(F.lit("{}"), "map<string,variant>"))), fits), 1, 1), lambda e: F.struct(c["name"].alias("tool"), c["arguments"].alias("arguments"), e["key"].alias("parameter"), text(e).alias("value")))))
        mixed = (F.size(m["tool_calls"]) != 1) | (F.trim(F.coalesce(m["content"], F.lit(""))) != "")
        usable = (m["role"] == "assistant") & ~F.coalesce(m["context_only"], F.lit(False)) & (F.size(found) > 0)
        return F.when(usable, F.struct(mixed.alias("mixed"), hash_number(seed, "inject", "episode_id", i).alias("draw"), i.alias("at"), F.get(found, 0).alias("c")))

    chosen = F.slice(F.array_sort(F.array_compact(F.transform("messages", candidate))), 1, limit)
    rows = rows.withColumn("__chosen", chosen).withColumn("__envelope", F.exists("messages", lambda m: F.coalesce((m["role"] == "tool") & m["content"].startswith('{"ok"'), F.lit(False))))

    def wrong(x: Column) -> Column:
        value, at = x["c"]["value"], x["at"]
        places = F.filter(F.sequence(F.lit(1), F.length(value)), lambda p: F.regexp_like(F.substring(value, p, F.lit(1)), F.lit("[0-9]")))
        place = F.get(places, F.pmod(hash_number(seed, "place", "episode_id", at), F.size(places)).cast("int"))
        digit = (F.substring(value, place, F.lit(1)).cast("int") + 1 + F.pmod(hash_number(seed, "digit", "episode_id", at), F.lit(9))) % 10
        changed = F.concat(F.substring(value, F.lit(1), place - 1), digit.cast("int").cast("string"), F.substring(value, place + 1, F.length(value)))
        example = F.when(hash_uniform(seed, "example", "episode_id", at) < 0.6, F.try_element_at("__examples", F.concat_ws("\n", x["c"]["tool"], x["c"]["parameter"])))
        return F.coalesce(example, changed)

    rows = rows.withColumn("__wrong", F.transform("__chosen", lambda x: F.struct(x["at"].alias("at"), x["c"].alias("c"), wrong(x).alias("wrong"))))
    rows = rows.withColumn("__wrong", F.filter("__wrong", lambda x: ~F.contains("__taken", x["wrong"])))

    def inserted(x: Column) -> Column:
        value, bad, at = x["c"]["value"], x["wrong"], x["at"]
        entity = F.trim(F.replace(F.regexp_replace(x["c"]["parameter"], S.ID_KEY, ""), F.lit("_"), F.lit(" ")))
        entity = F.when(entity == "", "record").otherwise(entity)
        error = F.concat(F.upper(F.substring(entity, 1, 1)), F.lower(F.substring(entity, 2, 200)), F.lit(" not found"))
        call_id = F.concat(F.lit("call_inj_"), F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "episode_id", at), 256), 1, 8))
        fields = {"id": call_id, "name": x["c"]["tool"], "arguments": F.replace(x["c"]["arguments"], value, bad)}
        call = F.array(F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in calls.fields]))
        shown = F.when(F.col("__envelope"), F.concat(F.lit('{"ok": false, "kind": "business", "error": "'), error, F.lit('"}'))).otherwise(F.concat(F.lit("Error: "), error))
        said = F.filter(F.slice("messages", F.lit(1), at), lambda m: m["role"].isin("user", "tool") & F.contains(F.coalesce(m["content"], F.lit("")), value))
        language = F.regexp_like(F.get(said, 0)["content"], F.lit("[一-鿿]"))
        filled = lambda options, draw: F.replace(F.replace(F.replace(hash_choice(seed, draw, _strings(options), "episode_id", at), F.lit("{entity}"), entity), F.lit("{wrong}"), bad), F.lit("{value}"), value)
        words = lambda options, draw: F.when(language, filled(options["zh"], draw)).otherwise(filled(options["en"], draw))
        failed = F.array(message(role=F.lit("assistant"), content=F.lit(""), context_only=F.lit(True), tool_calls=call), message(role=F.lit("tool"), tool_call_id=call_id, name=x["c"]["tool"], content=shown))
        asked = F.array(message(role=F.lit("assistant"), content=words(ASK_AGAIN, "ask")), message(role=F.lit("user"), content=words(CORRECTED, "correct")))
        asks = (F.get(said, 0)["role"] == "user") & (hash_uniform(seed, "asks", "episode_id", at) < ask_share)
        return F.when(F.coalesce(asks, F.lit(False)), F.concat(failed, asked)).otherwise(failed)

    spread = F.transform("messages", lambda m, i: F.concat(F.flatten(F.transform(F.filter("__wrong", lambda x: x["at"] == i), inserted)), F.array(m)))
    return rows.withColumn("messages", F.flatten(spread)).select(*episodes.columns)


def inject_error(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """``inject_errors`` with one error at most, of which the agent always asks."""
    return inject_errors(episodes, seed)


def in_order(episodes: DataFrame, steps: dict, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """The steps (name to operator) in their order, each on the share of episodes that its hash draws."""
    out = episodes
    for name, step in steps.items():
        drawn = hash_uniform(seed, name, "episode_id") < shares.get(name, 0.0)
        out = step(out.where(drawn)).select(*episodes.columns).unionByName(out.where(~drawn))
    return out


def loss_mask(parts: Column) -> Column:
    """Token mask of rendered parts (array of n tokens, trained): 1 for the tokens of trained parts."""
    return F.flatten(F.transform(parts, lambda p: F.array_repeat(p["trained"].cast("int"), p["n"])))


def without_notices(episodes: DataFrame, pattern: str = r"\n?\[notice\][^\n]*") -> DataFrame:
    return map_messages(episodes, lambda m: {"content": F.regexp_replace(m["content"], pattern, "")})


def even_spread(index: Column, count: int, share: float) -> Column:
    """Whether place ``index`` of ``count`` is one of round(count * share) places spread evenly."""
    many = round(count * share)
    return F.floor(index * many / count) != F.floor((index + 1) * many / count)


def slot_plan(spark, domains: list[str], count: int, mix: dict[str, float]) -> DataFrame:
    """place, domain and shape of ``count`` slots: shapes by rounded shares in their order, the last fills up, domains in turn."""
    shapes = [s for s, share in mix.items() for _ in range(round(count * share))]
    shapes = (shapes + [list(mix)[-1]] * count)[:count]
    return spark.createDataFrame([(i, domains[i % len(domains)], s) for i, s in enumerate(shapes)], "place int, domain string, shape string")
