"""Conversations and transcripts."""

import random

import pytest

from loomline.llm import conversations, transcripts
from loomline.llm.sides import side

TURNS = "id long, session_id string, speaker string, text string, spoken_at double, is_final boolean, side string, usable string"


@pytest.mark.parametrize(
    ("label", "named"),
    [("agent", "agent"), ("AGENT:", "agent"), ("[agent]", "agent"), ("agnet", "agent"), ("Agent 1", "agent"), ("mic", "agent"), ("CSR", "agent"), ("Adviser", "agent"), ("cutsomer", "customer"), ("the customer", "customer"),
     ("system", "customer"), ("customer_2", "customer"), ("policyholder", "customer"), ("both", None), ("", None), (None, None), ("?", None), ("unknown", None), ("speaker", None), ("agent and customer", None), (" Customer　", "customer")],
)
def test_sides(label, named):
    assert side(label) == named


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def broken(spark, rows):
    return {r["session_id"] for r in conversations.broken_sessions(turns(spark, rows)).collect()}


def test_broken_sessions(spark):
    nan = float("nan")
    rows, n = [], 0
    cases = {
        "whole": [("customer", "a", 1.0, True), ("agent", "b", 2.0, True)],
        "customer_last": [("agent", "a", 1.0, True), ("customer", "b", 2.0, True)],
        "late": [("agent", "b", 9.0, True), ("customer", "a", 1.0, True)],
        "no_usable": [("agent", "a", 1.0, False), ("customer", " 　", 2.0, True), ("customer", None, 3.0, True)],
        "one_side": [("agent", "a", 1.0, True)],
        "nobody": [("customer", "a", 1.0, True), ("both", "b", 2.0, True), ("agent", "c", 3.0, True)],
        "nobody_unusable": [("customer", "a", 1.0, True), ("both", " ", 2.0, True), ("agent", "c", 3.0, True)],
        "no_time": [("customer", "a", None, True), ("agent", "c", 3.0, True)],
        "nan_time": [("customer", "a", nan, True), ("agent", "c", 3.0, True)],
        "null_final": [("customer", "a", 1.0, None), ("agent", "c", 3.0, True)],
        "tie": [("agent", "a", 1.0, True), ("customer", "b", 1.0, True)],
    }
    for name, own in cases.items():
        for speaker, text, at, final in own:
            n += 1
            rows.append((n, name, speaker, text, at, final))
    rows.append((n + 1, None, "agent", "x", 5.0, True))
    assert broken(spark, rows) == set(cases) - {"whole", "late", "nobody_unusable"}


def test_rows_without_session_find_theirs(spark):
    rows = [(1, "s", "customer", "a", 1.0, True), (2, "s", "agent", "b", 2.0, True), (3, None, "AGT", "b", 2.0, True), (4, None, "customer", "c", 100.0, True), (5, None, "agent", "d", 105.0, True), (6, None, "agent", "e", 9000.0, True)]
    found = {r["id"]: r["conversation_id"] for r in conversations.grouped(turns(spark, rows)).collect()}
    assert found[3] == "s" and found[4] == found[5] and found[6] not in (found[5], "s")
    whole = [(r["conversation_id"], r["turn_no"], r["id"]) for r in conversations.rebuild(turns(spark, rows)).orderBy("conversation_id", "turn_no").collect()]
    assert [(n, i) for c, n, i in whole if c == "s"] == [(1, 1), (2, 2)] and [(n, i) for c, n, i in whole if c != "s"] == [(1, 4), (2, 5)]


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    links = [(f"n{rng.randint(0, 300):03d}", f"n{rng.randint(0, 300):03d}") for _ in range(220)] + [("n000", f"h{i:03d}") for i in range(100)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = {r["node"]: r["root"] for r in conversations.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert found == {x: find(x) for x in root}
    assert conversations.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_empty_turns(spark):
    none = turns(spark, []).limit(0)
    assert conversations.broken_sessions(none).count() == 0 and conversations.rebuild(none).count() == 0 and transcripts.clean_turns(none).count() == 0


@pytest.mark.parametrize(
    ("text", "kinds", "said"),
    [
        ("I called at 17:30 and was told.", (), "I called at 17:30 and was told."),
        ("[00:06 -] Agent: Um, please wait [[door slams]] now.", ("label", "clock", "sound", "filler"), "please wait now."),
        ("The copy [part two] costs (rupees 40,000 rupees).", (), "The copy [part two] costs (rupees 40,000 rupees)."),
        ("They took her through the ER at night, you know.", ("filler",), "They took her through the ER at night."),
        ("Do you know if I would like that?", (), "Do you know if I would like that?"),
        ("What I mean is this.", (), "What I mean is this."),
        ("Premium, sort of like, kitna banega?", ("filler",), "Premium kitna banega?"),
        ("[clears throat I already sent it.", ("sound",), "I already sent it."),
        ("I sent it. [door slams", ("sound",), "I sent it."),
        ("{00:00:45.052} Hello. 1m15s:", ("clock",), "Hello."),
        ("00:02:30,205 --> 00:02:31,205 Hello.", ("clock",), "Hello."),
        ("@17306s Hello <t=44.0> there.", ("clock",), "Hello there."),
        ("~STATIC~ hello /crosstalk/ *beep* -- sighs -- ♪ music ♪ 🔔", ("sound",), "hello"),
        ("[inaudible 00:45] hello", ("sound",), "hello"),
        ("[Caller] hello", ("label",), "hello"),
        ("AGENT >> नमस्ते, जी।", ("label",), "नमस्ते, जी।"),
        ("A: Hello. Part A: is next.", ("label",), "Hello. Part A: is next."),
        ("The music academy laughs at u-um, me.", ("filler",), "The music academy laughs at me."),
        ("", (), ""),
        ("((a [b {c", (), "((a [b {c"),
    ],
)
def test_grammar(text, kinds, said):
    found = transcripts.read(text)
    assert (found[0], found[1]) == (kinds, said)


def test_long_text_ends():
    assert transcripts.read("[" * 200 + "word " * 20_000)[0] == ()


def test_kinds_and_turns(spark):
    rows = [(1, "s", "agent", "Um, hello.", 2.0, True), (2, "s", None, None, None, True), (3, "s", "AGT", "Hello.", 1.0, False), (4, "s", "customer", "Hi. [noise]", 1.0, True), (5, "s", "Customer", "Hi.", 1.0, True), (6, None, "x", "agent: yes", float("nan"), True)]
    found = {(r["id"], r["kind"]) for r in transcripts.noise_kinds(turns(spark, rows + rows)).collect()}
    assert found == {(1, "filler"), (2, "label"), (3, "label"), (4, "sound"), (5, "label"), (6, "label")}
    clean = [(r["session_id"], r["turn_no"], r["id"], r["role"], r["said"]) for r in transcripts.clean_turns(turns(spark, rows)).orderBy("session_id", "turn_no").collect()]
    assert clean == [(None, 1, 6, "agent", "yes"), ("s", 1, 4, "customer", "Hi."), ("s", 2, 1, "agent", "hello.")]


@pytest.mark.parametrize(
    ("text", "kinds", "said"),
    [
        ("Hello [a very long note about music that is playing in the background for well over sixty characters in all] there.", ("sound",), "Hello there."),
        ("Hello " + "[" * 40 + "door slams" + "]" * 40 + " there.", ("sound",), "Hello there."),
        ("~" + "static " * 30 + "~ hello", ("sound",), "hello"),
        ("Hello [the agent said that it would be on the music desk of the customer] x", ("sound",), "Hello x"),
        ("It is [the agent who told the customer about it] x", (), "It is [the agent who told the customer about it] x"),
        ("(a [b) c] d", (), "(a [b) c] d"),
        ("It costs 30,000 or 1m15s: at 10:20", ("clock",), "It costs 30,000 or at 10:20"),
    ],
)
def test_no_length_or_depth_is_too_much(text, kinds, said):
    found = transcripts.read(text)
    assert (found[0], found[1]) == (kinds, said)


def test_blanked_sessions_are_found_again(spark, data):
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{data}/turns.parquet")
    blanked = given.withColumn("session_id", F.when(F.xxhash64("id") % 4 != 0, F.col("session_id")))
    rows = conversations.grouped(blanked).join(given.select("id", F.col("session_id").alias("true")), "id").where("not own and true is not null and usable and spoken_at is not null").collect()
    right = sum(r["conversation_id"] == r["true"] for r in rows)
    assert len(rows) > 80 and right >= 0.9 * len(rows)
    assert right >= 0.95 * sum(r["reaches"] for r in rows)


def test_overlapping_calls_are_not_joined(spark):
    # two calls at the same time: a row without session between them could be of either, and stays alone
    rows = [(i, "s" if i % 2 else "z", ("agent", "customer")[i // 2 % 2], f"t{i}", 5.0 * i, True) for i in range(8)]
    rows += [(100, None, "agent", "x", 17.0, True)]
    # two calls without session at the same time do not take turns
    rows += [(200 + i, None, "agent" if i < 2 else "customer", f"u{i}", 900.0 + 5 * i, True) for i in range(4)]
    found = {r["id"]: r["conversation_id"] for r in conversations.grouped(turns(spark, rows)).collect()}
    assert len({found[i] for i in (100, 200, 201, 202, 203)}) == 5
    assert {found[i] for i in range(8)} == {"s", "z"}


def test_unfinished_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(conversations, "MOST_ROUNDS", 1)
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    with pytest.raises(RuntimeError):
        conversations.connected_components(spark.createDataFrame(links, "a string, b string"))
