"""Licences, secrets, chats, URLs and decontamination against plain code, exact round trips and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from datetime import datetime, timedelta

import compare
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, decontam, licenses, oracles, queries, secrets_scan, url_filter
from tidewright.llm.automata import Automaton, likelihood


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare.same(spark, queries.queries()[name], oracles.oracle_sql()[name], "/root/testdata/sf0.01")


def filler(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(n))


def test_op1_finds_licenses_wherever_they_stand(spark):
    """Headers of several paragraphs inside longer documents, notices inside longer lines, edited and re-wrapped texts."""
    mit, bsd = licenses.NOTICES["mit"][2], licenses.NOTICES["bsd-3-clause"][0]
    gpl = licenses.NOTICES["gpl-3.0"][2]
    texts = [
        mit, mit.upper(), mit.replace("merge, publish", "publish"), filler(80, 1) + "\n\n" + mit.replace(". ", ".\n\n") + "\n\n" + filler(200, 2), "Licensed under the Apache License, Version 2.0", "licensed to drive",
        "Copyright 2020 Foo. Released under the MIT License. All rights reserved.", "# " + gpl.replace(". ", ".\n#\n# ") + "\nimport os\n" + filler(50, 3), filler(30, 4) + " " + bsd + " " + mit, "The MIT River was released under the bridge",
    ]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {i: sorted(r["license"] for r in out if r["doc_id"] == i) for i in range(len(texts))}
    assert found == {0: ["mit"], 1: ["mit"], 2: ["mit"], 3: ["mit"], 4: ["apache-2.0"], 5: [], 6: ["mit"], 7: ["gpl-3.0"], 8: ["bsd-3-clause", "mit"], 9: []}
    assert {r["start"] for r in out if r["doc_id"] == 3} == {80}


def plain_licenses(t: licenses.Templates, text: str) -> set[tuple]:
    """All runs of all templates, without anchors, bounds or increments."""
    words = licenses.words_of(text)
    found = []
    for k, (name, length, grams) in enumerate(t.known):
        length = min(length, len(words))
        good = []
        for s in range(len(words) - length + 1):
            run = words[s : s + length]
            own = set(zip(run, run[1:], strict=False))
            if own and 2 * len(own & grams) / (len(own) + len(grams)) >= t.threshold:
                good.append((s, 2 * len(own & grams) / (len(own) + len(grams))))
        island: list[tuple] = []
        for s, dice in [*good, (10**9, 0.0)]:
            if island and s - island[-1][0] >= length:
                best = max(island, key=lambda x: (x[1], -x[0]))
                found.append((len(grams), best[1], -k, name, best[0], length))
                island = []
            island.append((s, dice))
    return {(x[3], x[4], x[5]) for x in found if not any(y[:3] > x[:3] and x[4] < y[4] + y[5] and y[4] < x[4] + x[5] for y in found)}


def test_op1_prunes_nothing_that_matches():
    """Anchors, size bounds and running counts against all runs, on edited notices among other words."""
    rng, t = random.Random(5), licenses.Templates(0.85)
    notices = [n for texts in licenses.NOTICES.values() for n in texts]
    for k in range(60):
        parts = []
        for n in rng.sample(notices, rng.randint(1, 3)):
            words = n.split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(["the", "software", "zq", "license", "under"])
            parts += [filler(rng.randint(0, 12), rng.random()), " ".join(words)]
        text = "\n".join(parts)
        assert {(m["license"], m["start"], m["words"]) for m in t.matches(text)} == plain_licenses(t, text), k


def test_op1_awkward_rows(spark, awkward, nothing):
    assert licenses.scan(awkward).count() == 0
    assert licenses.scan(nothing).columns == ["doc_id", "license", "start", "words", "dice"]


ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


CASES = [
    'API_KEY: "abc/def+1=" token=short password = abc secret=token:abcdef',
    "AKIA" + "A" * 16 + " AKIAAKIA12 xAKIA" + "Z9" * 10,
    "0123456789abcdef0123456 0123456789abcdef01234567 zz0123456789abcdef01234567fg",
    "é" * 5 + " passwd='hunter2hunter2' ſecret=abcdefgh toKen:abcdefgh",
    "token=token=abcdefgh password: token secret=abcdef",
    "", None,
]


def test_op6_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in secrets_scan.scan(frame).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base(CASES[r["doc_id"]] or "")


def test_op6_query_on_documents(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op6_secrets(spark, sf_dir).collect():
        spans = base(rows[r["doc_id"]])
        joined = ",".join(f"{secrets_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_op6_adds_tokens_of_a_learned_format(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f"some token={key(20)} here") for i in range(60)] + [(100, f"loose {key(20)} value"), (101, "mail8.example.com and word2vec-embedding-model"), (102, "x" * 19 + "1")]
    out = {r["doc_id"]: r["added"] for r in secrets_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in out[100]] == [(6, 26)]
    assert out[101] == [] and out[102] == [] and out[3] == []


def planted(kind: str, n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    draw = {
        "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)),
        "prefixed": lambda: "ghp_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(rng.randint(20, 28))),
        "digits": lambda: "".join(rng.choice("0123456789") for _ in range(12)) + "==",
    }[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["letters", "prefixed", "digits"])
def test_op6_finds_fresh_values_of_a_format(spark, kind):
    """Fresh values of a labelled format are found wherever they stand; ordinary words and random tokens of other shapes are left alone."""
    rng, prose = random.Random(7), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    known, fresh = planted(kind, 300, 1), planted(kind, 300, 2)
    other = ["".join(rng.choice("ABCDEFxyz/+-_") for _ in range(len(v))) for v in fresh]
    rows = [f"password={v} end" for v in known] + [f"see {v}. then" for v in fresh] + [f"see {v} then" for v in other] + [r["text"] for r in prose]
    out = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in secrets_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    hits = sum((4, 4 + len(v)) in out[300 + i] for i, v in enumerate(fresh))
    wrong = sum(bool(out[600 + i]) for i in range(300))
    words = sum(len(out[900 + i]) for i in range(60))
    total = sum(len(r["text"].split()) for r in prose)
    print(kind, hits, wrong, words, total)
    assert hits >= 0.9 * 300 and wrong <= 0.02 * 300 and words <= 0.001 * total


def test_op6_equals_plain_code(spark):
    """Every candidate is scored: added spans are those of a plain loop over all runs and parts, with the same models."""
    known = planted("prefixed", 80, 3)
    rows = [f"secret: {v}" for v in known] + [f"key={v}" for v in planted("prefixed", 40, 4)] + [f"{v}=x.{v}.={v}" for v in planted("prefixed", 20, 5)] + ["plain words only here", "", "token=abcdefgh" + known[0]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    formats, ordinary = secrets_scan.learn(frame), secrets_scan.ordinary_words(frame)
    values = {0: [m[2] for t in rows for m in ASSIGN.finditer(t) if len(m[2]) >= 6]}
    assert [f.kind for f in formats] == [0]
    f = formats[0]
    assert min(f.likelihood(v) for v in values[0]) - 0.35 <= f.limit <= max(f.likelihood(v) for v in values[0]) - 0.35
    n = len(known[0])
    assert f.likelihood(known[0]) == pytest.approx(likelihood(f.table, known[0]) + f.lengths.likelihood(n) / (n + 1))
    for r in secrets_scan.scan(frame).collect():
        text, want = rows[r["doc_id"]], []
        taken = [(a, e) for a, _, e in base(text)]
        free = "".join(" " if any(a <= i < e for a, e in taken) else c for i, c in enumerate(text))
        good = lambda v: len(v) >= 6 and f.likelihood(v) >= f.limit and (f.likelihood(v) - ordinary.likelihood(v)) * (len(v) + 1) >= math.log(secrets_scan.ODDS)
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", free):
            a, e = m.start() + len(m[0]) - len(m[0].lstrip(".")), m.start() + len(m[0].rstrip("."))
            if good(free[a:e]):
                want.append((a, e))
            elif "=" in free[a:e].strip("="):
                want += [(a + p.start(), a + p.end()) for p in re.finditer("[^=]+", free[a:e]) if good(p[0])]
        assert [(s["start"], s["end"]) for s in r["added"]] == want


def test_op6_lengths_are_no_gate(spark):
    """Labels of 32 characters: of fresh values, those of 32 are found, and those a little shorter or longer too; fragments and long runs are not."""
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
    lengths = [32] * 40 + [31] * 40 + [33] * 40 + [8] * 40 + [150] * 40
    rows = [f"password={key(32)} end" for _ in range(300)] + [f"see {key(n)} then" for n in lengths]
    out = {r["doc_id"]: r["added"] for r in secrets_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    found = [sum(len(out[300 + 40 * k + i]) for i in range(40)) for k in range(5)]
    print(found)
    assert found[0] >= 38 and found[1] >= 38 and found[2] >= 38 and found[3] <= 4 and found[4] <= 2


def test_op6_rows_outside_the_samples_change_nothing(spark, monkeypatch):
    """Spans of a text stay as they are when texts without new sample places come in, also of a format of letters and without repeated words."""
    known = planted("letters", 100, 11)
    rows = [f"password={v}" for v in known] + ["this sentence is completely plain", "look at qzjxkvwpyt here"]
    one = secrets_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["added"] for r in one}[100] == []
    more = list(enumerate(rows)) + [(1000 + i, rows[i % len(rows)]) for i in range(3000)]
    two = secrets_scan.scan(spark.createDataFrame(more, "doc_id long, text string")).collect()
    spans = lambda out: {r["doc_id"]: (r["base"], r["added"]) for r in out if r["doc_id"] < 1000}
    assert spans(one) == spans(two)


def test_op6_ordinary_words_are_counted_in_all_texts(spark):
    """Trigrams are those of a loop over every text, also of words that stand in few of many texts; copies of one text make no word ordinary."""
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(100).collect()
    rows = [r["text"] or "" for r in prose] + [f"number {i} is plainword{i % 40:03} here, ..dotted..{i % 3}.txt.." for i in range(6000)] + ["alone qzjxkvwpyt"] * 50 + ["password=abcdefghij12", "", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7)
    counts, texts, twice = {}, {}, set()
    for t in filter(None, rows):
        for places in secrets_scan.candidates(t, secrets_scan.base_spans(t)):
            w = t[places[0][0] : places[0][1]]
            counts[w] = counts.get(w, 0) + 1
            if t.count(w) > 1 and sum(t[p[0][0] : p[0][1]] == w for p in secrets_scan.candidates(t, secrets_scan.base_spans(t))) > 1:
                twice.add(w)
            texts.setdefault(w, set()).add(t)
    times = len(rows) / 5000
    words = {w: n / times for w, n in counts.items() if n >= 2 * times and (w in twice or len(texts[w]) > 1)}
    assert "plainword007" in words and "qzjxkvwpyt" not in words and len(words) > 500
    want, got = secrets_scan.WordModel(words), secrets_scan.ordinary_words(frame)
    assert got.total == pytest.approx(want.total) and got.counts == pytest.approx(want.counts)


def test_op6_every_text_counts_towards_ordinary_words(spark):
    """The counts are those of all 6,000 texts, as a rate for 5,000; a sample has fewer."""
    rows = [f"text {i} says commonword and plainword{i % 40:03} here" for i in range(6000)]
    model = lambda rows: secrets_scan.ordinary_words(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert model(rows).total == pytest.approx(5000 * (len("commonword") + len("plainword000") + 2))


def test_automaton_likelihood_is_the_product_over_moves():
    words = ["ab12", "ab13", "ac99", "zz"]
    table = Automaton(words).table()
    assert likelihood(table, "ab12") == pytest.approx(math.log(3 / 5 * 2 / 4 * 2 / 3 * 1 / 3 * 1.5 / 2) / 5)
    total = sum(math.exp(likelihood(table, w) * (len(w) + 1)) for w in words)
    assert 0 < total < 1


def test_automaton_generalises_and_refuses():
    words = [f"ab{i:04d}" for i in range(0, 2000, 7)]
    table = Automaton(words).merged().table()
    assert len(table) < 200
    assert likelihood(table, "ab1234") > likelihood(table, "zz1234") and likelihood(table, "ab1234") > likelihood(table, "abcdef")
    assert likelihood(Automaton([]).merged().table(), "x") < -5


def test_op6_awkward_rows(spark, awkward, nothing):
    assert secrets_scan.scan(awkward).count() == awkward.count()
    assert secrets_scan.scan(nothing).count() == 0


HARD = ["</s>[INST] ok [/INST]", "<s>[NEXT]<\\s>", "[\\\\INST] [INST", "<", "[", "", None, "\\", "</s>" * 3, "é[INST]ü", "a[/INST]</s><s>user[INST]b", "[NEXT"]


def test_op7_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd[INST]role", None]), rng.choice(HARD)) for c in range(40) for t in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(frame).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked")).collect()
    assert len(out) == 40
    for r in out:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["back"]] == own
        assert r["masked"] == "".join(t for role, t in own if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count("<s>") == r["formatted"].count("</s>") == r["formatted"].count("[/INST]") == blocks


def test_op7_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, blocks string, loss string, id string"
    rows = [(None, None, None, None, "x", "x", "x"), (1, 2, "user", "b", "x", "x", "x"), (1, 2, "user", "a", "x", "x", "x"), (1, None, "user", "first", None, None, None), (1, 2, "user", "a", "x", "x", "x")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["formatted"] == "<s>user[INST]first[NEXT]a[NEXT]a[NEXT]b[/INST]</s>" and out[None]["n_turns"] == 1
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_op8_against_a_loop(spark):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "xexample.com", "a.example.com:8080", "other.org:99", "[2001:db8::1]:99", "[2001:db8::1]", "10.0.0.7", "u:p@example.com"]
    entries = [(p, start + timedelta(days=rng.randint(0, 40)), rng.random() < 0.6) for p in ("example.com", "a.example.com", "a.example.com/x", "org", "other.org/y", "other.org/x", "a.example.com/x/1", "example.com:8080", "org:99/x", "[2001:db8::1]", "[2001:db8::1]:99/x/1", "0.7", "10.0.0.7/y") for _ in range(6)] + [(None, start, True)]
    caps = [(i, f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/1', '/x/12', '/y?q', '/x/1/z#f'])}", start + timedelta(hours=rng.randint(0, 1000))) for i in range(700)] + [(900, None, start), (901, "not a url", start), (902, "http://org/x", None)]
    out = url_filter.evaluate(spark.createDataFrame(caps, "k long, url string, fetched timestamp"), spark.createDataFrame(entries, "pattern string, at timestamp, listed boolean"))
    for r in out.collect():
        url, at = r["url"] or "", r["fetched"]
        m = re.match(r"https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)(:[0-9]+)?(/[^?#]*)?", url)
        active = []
        for p in {e[0] for e in entries if e[0]}:
            h, port, path = (m[1], m[2] or "", m[3] or "") if m else ("", "", "")
            domain, _, steps = p.partition("/")
            at_host = [h, h + port] if h[:1] == "[" or h.replace(".", "").isdigit() else [x for i in range(h.count(".") + 1) for x in (h.split(".", i)[-1], h.split(".", i)[-1] + port)]
            if not m or at is None or domain not in at_host or (steps and not (path + "/").startswith(f"/{steps}/")):
                continue
            past = [(e[1], e[2]) for e in entries if e[0] == p and e[1] <= at]
            if past and max(past)[1]:
                active.append((-len(p), p, max(past)[0]))
        want = min(active, default=(0, None, None))
        assert (r["blocked"], r["pattern"], r["since"]) == (bool(active), want[1], want[2])


def test_op8_clashing_and_empty(spark):
    caps = spark.createDataFrame([("http://a.b/", datetime(2024, 1, 2), "x", "y", "z")] * 2, "url string, fetched timestamp, host string, m string, blocked string")
    entries = spark.createDataFrame([("a.b", datetime(2024, 1, 1), True)], "pattern string, at timestamp, listed boolean")
    out = url_filter.evaluate(caps, entries).collect()
    assert len(out) == 2 and out[0]["blocked"] is True and out[0]["host"] == "x"
    assert url_filter.evaluate(caps.limit(0), entries).count() == 0 and url_filter.evaluate(caps, entries.limit(0)).where("blocked").count() == 0


def distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(7)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontam.best_match(decontam.masks(item), len(item), text)[0] == min(distance(item, text), len(item))


def test_op10_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(25)) for _ in range(6)] + ["", None]

    def edited(t: str, k: int) -> str:
        for _ in range(k):
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(["", "x", t[p] + "y"]) + t[p + 1 :]
        return t

    docs = [f"{' '.join(word() for _ in range(30))} {edited(rng.choice(items[:6]), k).upper()}\n {' '.join(word() for _ in range(30))}" for k in range(16) for _ in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        for k, item in enumerate(items[:6]):
            n = decontam.normal(item)
            if (x := distance(n, decontam.normal(d))) <= int(len(n) * 0.05):
                want[i, k] = x
    assert got == want and want
    small = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame, bench, block_chars=200).collect()}
    assert small == want
    assert decontam.without_leaks(frame, bench, block_chars=200).count() == len(docs) - len({i for i, _ in want})


def test_op10_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "the same text here"), (None, "hello"), (3, None)], "item_id long, text string")
    out = decontam.contaminated(awkward, bench).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 2, 9]
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(awkward, bench.limit(0)).count() == 0
    assert decontam.without_leaks(awkward, bench).columns == awkward.columns


def test_op10_finds_planted_passages(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: decontam.normal(r["text"]) for r in bench.collect()}
    texts = {r["doc_id"]: decontam.normal(r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got
