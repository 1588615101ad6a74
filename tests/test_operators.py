"""Hand-derived cases, and properties against one-row-at-a-time versions."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import documents, gate, memory, retrieval, segments, timeline, voice


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TURNS = "id long, session_id string, speaker string, text string, spoken_at double, is_final boolean"


def turns(spark, rows):
    return frame(spark, [(i, "s", speaker, text, at, True) for i, (speaker, text, at) in enumerate(rows)], TURNS)


def kept(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_repeats(spark):
    assert kept(segments.without_repeats(turns(spark, [("a", "a", 0.0), ("a", "a", 0.4), ("a", "a", 0.8)]))) == [0, 2]
    mixed = turns(spark, [("a", "a", 0.0), ("a", "b", 0.1), ("a", "a", 0.2)])
    assert kept(segments.without_repeats(mixed)) == [0, 1, 2]
    assert kept(segments.without_echoes(mixed, at="spoken_at", key="id")) == [0, 1]
    edge = turns(spark, [("a", "a", 0.0), ("a", " a ", 0.5), ("b", "a", 0.1)])
    assert kept(segments.without_repeats(edge)) == [0, 2]
    assert kept(segments.without_echoes(edge, at="spoken_at", key="id")) == [0, 2]


def test_customer_turns(spark):
    rows = turns(spark, [("customer", "a", 0.0), ("customer", "b", 1.0), ("agent", "x", 1.2), ("customer", "c", 1.3), ("customer", "d", 2.8), ("customer", "e", 4.4)])
    found = {r["island"]: r["text"] for r in segments.customer_turns(rows, at="spoken_at", key="id").collect()}
    assert found == {0: "a b", 3: "c d", 5: "e"}


def decided(spark, rows):
    return [r["reason"] for r in gate.decide(turns(spark, rows)).orderBy("id").collect()]


def test_gate(spark):
    hit = "too expensive"
    assert decided(spark, [("agent", hit, 0.0), ("agent", hit, 2.9), ("agent", hit, 3.0)]) == ["intent", "cooldown", "intent"]
    assert decided(spark, [("agent", hit, 0.0), ("agent", "rephrase", 1.0), ("customer", hit, 3.0)]) == ["intent", "refinement", "intent"]
    six, seven = "one two three four five six", "one two three four five six seven"
    assert decided(spark, [("a", hit, 0.0), ("a", hit, 4.0), ("a", six, 8.0), ("a", seven, 12.0)]) == ["intent", "intent", "follow_up", "no match"]
    assert decided(spark, [("a", hit, 0.0), ("a", six, 4.0)]) == ["intent", "no match"]


def test_gate_one_row_at_a_time(spark):
    rng, rows = random.Random(7), []
    for i in range(600):
        rows.append((rng.choice(["agent", "customer"]), rng.choice(["too expensive", "ok", "rephrase please", "a b c d e f g h", "exclusion"]), round(rng.uniform(0, 4000), 2)))
    expected, last, fires = {}, None, 0
    for i, (speaker, text, at) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        if speaker == "agent" and "rephrase" in text:
            expected[i] = "refinement"
        elif last is not None and at - last < 3.0:
            expected[i] = "cooldown"
        elif text in ("too expensive", "exclusion") or (fires >= 2 and len(text.split()) <= 6):
            expected[i] = "intent" if text in ("too expensive", "exclusion") else "follow_up"
            last, fires = at, fires + 1
        else:
            expected[i] = "no match"
    found = {r["id"]: r["reason"] for r in gate.decide(turns(spark, rows)).collect()}
    assert found == expected


def test_timeline_over_slices(spark):
    rng = random.Random(1)
    rows = sorted((rng.choice("ab"), round(rng.uniform(0, 50_000), 1), i) for i in range(500))
    df = frame(spark, rows, "k string, at double, id long").withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id")))
    before = {r["id"]: r["prev"] and r["prev"]["id"] for r in timeline.with_previous(df, ["k"], "at", "id", ["at", "id"]).collect()}
    sums = {r["id"]: r["s"] for r in timeline.running_sum(df, ["k"], "at", "id", F.col("id"), "s").collect()}
    carried = {r["id"]: r["c"] for r in timeline.carried(df, ["k"], "at", "id", F.col("v"), "c", current=False).collect()}
    for key in "ab":
        last, total, value = None, 0, None
        for _, _, i in [r for r in rows if r[0] == key]:
            total += i
            assert (before[i], sums[i], carried[i]) == (last, total, value)
            last, value = i, i if i % 5 == 0 else value


@pytest.mark.parametrize(("n", "evictions", "live"), [(20, 0, 20), (21, 1, 16), (25, 1, 20), (26, 2, 16)])
def test_evictions(spark, n, evictions, live):
    df = frame(spark, [("s",)] * n, "session_id string")
    row = memory.evictions(df).first()
    assert (row["n_evictions"], row["n_live"]) == (evictions, live)


def test_chunker():
    assert [len(documents.chunks_of("x" * n)) for n in (0, 999, 1000, 3000)] == [0, 1, 2, 4]
    early = "x" * 40 + " " + "y" * 2000
    assert len(documents.chunks_of(early)[0]) == 1000
    assert documents.chunks_of(None) == []


def test_pages_and_upserts(spark):
    pages = frame(spark, [("f", 1, "a"), ("f", 2, " "), ("f", 3, "c"), ("f", 4, "d")], "file string, page int, text string")
    found = {r["batch_num"]: (r["text"], r["page_range"]) for r in documents.pages_joined(pages).collect()}
    assert found == {1: ("a\n\nc", "1-3"), 2: ("d", "4-4")}
    old = frame(spark, [(1, "a"), (2, "b")], "chunk_index int, text string")
    new = frame(spark, [(2, "B"), (3, "C")], "chunk_index int, text string")
    assert sorted(map(tuple, documents.upserted(old, new).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_nearest_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(400)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int")
    asked = retrieval.asked_of(df)
    for within in (None, "label"):
        small = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.nearest(df, asked, within=within).collect())
        monkeypatch.setattr(retrieval, "MOST_BROADCAST_VALUES", 1)
        assert small == sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.nearest(df, asked, within=within).collect())
        monkeypatch.undo()
        unit = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
        unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
        for q in [i for i, _, _ in rows if i % 50 == 0]:
            best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i, _, lab in rows if within is None or lab == q % 3)[:4]
            assert [i for _, i in best] == [v for a, _, v in small if a == q]


def test_empty_tables(spark):
    none = turns(spark, []).limit(0)
    assert segments.without_repeats(none).count() == 0
    assert gate.decide(none).count() == 0
    vectors = frame(spark, [], "vec_id long, embedding array<float>, label int")
    assert retrieval.nearest(vectors, retrieval.asked_of(vectors)).count() == 0
    assert voice.detect(frame(spark, [], "frame_id long, channel long, at double, level double")).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    from loomline.sources import sinks, tables

    (tmp_path / "s.env").write_text("# c\nA=b=c\n\nX = 1\n")
    assert {r["key"]: r["value"] for r in tables.settings(spark, str(tmp_path / "s.env")).collect()} == {"A": "b=c", "X": "1"}
    (tmp_path / "q.json").write_text('{"p": [{"id": 2, "question": "b"}, {"id": 1, "question": "a"}]}')
    assert [(r["id"], r["question"]) for r in tables.questions(spark, str(tmp_path / "q.json")).orderBy("id").collect()] == [(1, "a"), (2, "b")]
    (tmp_path / "t.txt").write_text("a\n\n b \n\n\n\nc")
    assert [r["paragraph"] for r in tables.text_paragraphs(spark, str(tmp_path / "t.txt")).orderBy("place").collect()] == ["a", "b", "c"]
    for path in ("root/pension/kml-a-1/x.pdf", "root/insurance/cat/kml-b-2/y.pdf", "root/other/kml-c/z.pdf", "root/insurance/kml-d/w.pdf"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    found = tables.document_files(spark, str(tmp_path / "root"), ["pension", "insurance"], ["insurance"]).collect()
    assert [(r["product_type"], r["category"], r["source_folder"], r["source_file"]) for r in found] == [("insurance", "cat", "kml-b-2", "y.pdf"), ("pension", "", "kml-a-1", "x.pdf")]
    rows = frame(spark, [(1, "f", 'a "q"\nb'), (2, "f", None)], "chunk_index int, source_file string, text string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["text"] for r in back.collect()} == {'a "q"\nb', None}
    sinks.write_dump(rows, str(tmp_path / "dump"))
    assert "=== CHUNK 1 (from f) ===" in {r["value"] for r in spark.read.text(str(tmp_path / "dump")).collect()}
    cells = frame(spark, [(1, 1, 0, ["a", None]), (1, 2, 0, ["b"])], "page int, table_index int, row_no int, cells array<string>")
    sinks.write_tables(cells, str(tmp_path / "tables"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "tables")).collect()} == {'"a",""', '"b"'}


def test_second_tier(spark):
    from loomline.operators import models

    rows = turns(spark, [("a", "how do I file a claim", 0.0), ("a", "too expensive", 4.0), ("a", "", 8.0), ("a", "another company offers more", 12.0)])
    found = [(r["reason"], r["intents"]) for r in gate.decide(rows, models.second_tier).orderBy("id").collect()]
    assert found == [("intent", "claim_question"), ("intent", "objection"), ("follow_up", "follow_up"), ("embedding", "objection")]
    named = {r["id"]: r["intent"] for r in models.intents_by_embedding(rows).collect()}
    assert named[0] == "claim_question" and 2 not in named


def test_evaluation_and_vectors(spark):
    from loomline.operators import models

    assert np.allclose(np.linalg.norm(models.hashed(["a b", "x"]), axis=1), 1) and not models.hashed(["", None]).any()
    at = datetime(2026, 1, 1)
    rows = [(50, "s", "customer", "what of the bonus", 1.0, True, at), (51, "s", "agent", "the bonus is paid", 2.0, True, at), (52, "t", "agent", "the bonus is paid", 2.0, True, at)]
    chunks = frame(spark, [(1, "the bonus"), (2, None)], "chunk_index long, text string")
    past = frame(spark, [(7, "s", "an old bonus", at), (8, "t", "another", at)], "id long, session_id string, summary_text string, created_at timestamp")
    now = F.lit("2026-01-08 00:00:00").cast("timestamp")
    for embedder in (models.letter_counts, models.by_function(models.hashed)):
        row = models.evaluation(frame(spark, rows, TURNS + ", created_at timestamp"), past, chunks, now, embedder).first()
        assert row["id"] == 50 and row["docs_retrieval"].endswith("] the bonus") and len(row["history_retrieval"].split("\n")) == 2
        # the question itself is nearest, and a week old: 0.7 + 0.3 / e
        assert row["history_retrieval_rerank"].startswith("[0.8104] what of the bonus")
        assert row["summary_retrieval"].endswith("an old bonus") and row["context_docs_only"] == "--- Insurance document knowledge ---\n  • the bonus"
        assert row["context_all"].startswith("--- Last conversation turns (chronological) ---\n  [customer]: what of the bonus\n  [agent]: the bonus is paid\n--- Sem")
        assert len(row) == 13


def test_session_end_is_what_evictions_left(spark):
    rows = [(i, "s", "agent", f"t{i}", datetime(2026, 1, 1, 0, i), True, False, float(i)) for i in range(30)]
    turns = spark.createDataFrame(rows, "id long, session_id string, speaker string, text string, created_at timestamp, is_final boolean, is_important boolean, spoken_at double")
    # 30 turns: evictions at 21 and 26 take ten
    assert [r["lines"].count("]: t") for r in memory.evicted_turns(turns).orderBy("eviction_no").collect()] == [5, 5]
    end = memory.session_end(turns).first()
    assert end["n_turns"] == 20 and end["lines"].startswith("[agent]: t10\n---\n[agent]: t11")
    assert memory.session_end(turns.limit(0)).count() == 0


def test_last_of_two_new_rows_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_index int, text string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "chunk_index int, text string").coalesce(1)
    assert sorted(map(tuple, documents.upserted(old, new).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_blocks_of_queries_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, vectors[i].tolist(), "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(900, None, "hot"), (901, [1.0, 0.0, 0.0, 0.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    monkeypatch.setattr(retrieval, "GROUP_ROWS", 40)
    monkeypatch.setattr(retrieval, "GROUP_QUERIES", 16)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST_VALUES", 0)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    near = np.round(unit @ unit.T, 9)
    for within in ("label", None):
        found = {}
        for r in retrieval.nearest(table.where("vec_id <> 901"), table.where("vec_id % 5 = 0 and vec_id < 300"), 3, within=within).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for q in range(0, 300, 5):
            own = [i for i in range(300) if within is None or rows[i][2] == rows[q][2]]
            best = sorted(own, key=lambda i: (-near[q, i], i))[:3]
            assert [i for _, i in sorted(found[q])] == best


def test_pages_run_on_over_batches(spark):
    pages = spark.createDataFrame([("f", 1, "a" * 999), ("f", 2, "b" * 2_000), ("g", 1, None), ("g", 2, " "), (None, 1, "x")], "file string, page int, text string")
    found = [(r["file"], r["place"], len(r["text"])) for r in documents.chunk_pages(pages).orderBy("place").collect()]
    # the page's end is a line end, so the first chunk is cut at 1000 and stripped; each next one repeats 50
    assert found == [("f", 0, 999), ("f", 1, 1000), ("f", 2, 1000), ("f", 3, 151)]


def test_scratch_files_have_an_owner(spark):
    from loomline.session import materialise, released

    before = materialise(spark.range(3), "kept")
    with released(spark):
        held = materialise(spark.range(5), "owned")
        assert held.count() == 5
    assert before.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found|no such file"):
        spark.read.parquet(held.inputFiles()[0]).count()


def test_folds_over_slices_equal_one_pass(spark, monkeypatch):
    """One key holds most rows and is cut into slices; the rows are those of a pass in one task."""
    from loomline.operators import folds

    rng = random.Random(5)
    words = [" ".join(rng.choice(["premium", "is", "due", "on", "a", "", "settlement"]) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    said = [(i, "hot" if i % 5 else f"s{i % 7}", datetime.fromtimestamp(1_700_000_000 + i), rng.choice([None, "", words[i]])) for i in range(3_000)]
    turns_ = frame(spark, said, "id long, session_id string, created_at timestamp, text string")
    frames = frame(spark, [(i, 1 if i % 5 else i % 7, float(i), rng.choice([20.0, 40.0, 90.0, 200.0])) for i in range(12_000)], "frame_id long, channel long, at double, level double")
    pages = frame(spark, [("hot" if i % 5 else f"f{i % 7}", i, words[i]) for i in range(3_000)], "file string, page int, text string")

    def found() -> list:
        own = [memory.compactions(turns_), voice.detect(frames), documents.chunk_pages(pages)]
        return [sorted(map(tuple, df.collect())) for df in own]

    expected = found()
    assert max(len(x) for x in expected) == 12_000 and max(r[1] for r in expected[0]) > 30
    monkeypatch.setattr(documents, "SLICE_PAGES", 400)
    for rows, rounds in ((600, 4), (3_000, 4), (600, 0)):
        monkeypatch.setattr(folds, "SLICE_ROWS", rows)
        monkeypatch.setattr(folds, "ROUNDS", rounds)
        assert found() == expected


def test_folds_that_never_settle(spark):
    """Turns of one size: where an epoch ends depends on the first turn for ever, so the key streams through one task."""
    from loomline.operators.folds import folded

    rows = frame(spark, [(i, "s", 30) for i in range(1_000)], "id long, session_id string, tokens int")
    one, cut = (sorted(map(tuple, folded(rows, "session_id", ["id"], ["id", "tokens"], memory._FOLD, n, 2).collect())) for n in (1_000, 130))
    assert len(one) > 90 and one == cut


def test_scores_of_many_queries_are_never_held_at_once():
    """4,000 queries over a batch of 10,000 rows: 320 MB of scores, if all were kept."""
    import tracemalloc

    import pyarrow as pa

    class Local:
        def __init__(self, names, ids, vectors):
            self.table = pa.table({names[0]: ids, names[1]: pa.FixedSizeListArray.from_arrays(vectors.ravel(), vectors.shape[1])})

        def select(self, *_):
            return self

        def toArrow(self):  # noqa: N802
            return self.table

        def mapInArrow(self, run, _):  # noqa: N802
            return pa.Table.from_batches(run(iter(self.table.to_batches(max_chunksize=10_000))))

    rng = np.random.default_rng(5)
    vectors, asked = rng.integers(0, 9, (10_000, 26)).astype(float), rng.integers(0, 9, (4_000, 26)).astype(float)
    vectors[5_000:6_000], vectors[77], asked[100:200] = vectors[4_000:5_000], 0, 0
    asked[:100] = vectors[4_950:5_050]
    rows, queries = Local(("vec_id", "embedding"), np.arange(10_000)[::-1], vectors), Local(("query_id", "query"), np.arange(4_000), asked)
    tracemalloc.start()
    found = retrieval._to_all(rows, queries, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    near = np.round(retrieval._unit(queries.table.column(1))[:250] @ retrieval._unit(rows.table.column(1)).T, 9)
    best = {}
    for row in found.to_pylist():
        best.setdefault(row["query_id"], []).append((-round(row["score"], 9), row["vec_id"]))
    ids = np.arange(10_000)[::-1]
    for q in range(250):
        assert [i for _, i in sorted(best[q])] == ids[np.lexsort((ids, -near[q]))[:10]].tolist()


def test_letters_in_one_pass_are_those_of_letter_counts(spark):
    from loomline.operators import models

    texts = ["Does this Cover", "", None, "\u212a\u0130 \u00c5 \u0915 zZ", "a" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(models.letter_counts(F.col("t")).alias("a"), models.letters_in_one_pass(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[4]["b"][0] == 300


def test_only_what_is_asked_for_is_looked_for(spark, data, monkeypatch):
    from loomline.operators import models
    from loomline.plans import registry

    made = []
    monkeypatch.setattr(models, "nearest", lambda *a, nearest=models.nearest, **k: made.append(k["within"]) or nearest(*a, **k))
    assert registry.QUERIES["docs_unranked"](spark, data).count() > 0 and made == [None]


def test_scores_of_one_long_session_are_never_held_at_once(spark, monkeypatch):
    """4,000 questions and 20,000 turns of one session in one group: 640 MB of scores, if all were kept."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    held, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, meet, schema: held.append(meet) or apply(self, meet, schema))
    table = frame(spark, [(i, [1.0, float(i)], "s") for i in range(3)], "vec_id long, embedding array<double>, session_id string")
    assert retrieval.nearest(table, table, 2, within="session_id").count() == 6
    rng = np.random.default_rng(6)
    vectors = rng.integers(0, 9, (20_000, 26)).astype(float)
    lists = pa.FixedSizeListArray.from_arrays(vectors.ravel(), 26)
    rows = pa.table({"key": ["s"] * 20_000, "vec_id": np.arange(20_000), "embedding": lists})
    tracemalloc.start()
    found = held[0](rows, pa.table({"key": ["s"] * 4_000, "query_id": np.arange(4_000), "query": lists[:4_000]}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and found.num_rows == 8_000
    assert set(range(4_000)) <= {r["vec_id"] for r in found.to_pylist() if r["score"] > 1 - 1e-9}


def joins_of(df) -> int:
    return sum(line.lstrip(" :+-").startswith("Join ") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_sections_are_counted_without_a_join_for_each(spark, data):
    from loomline.plans import registry

    used = registry.QUERIES["context_usage"](spark, data)
    assert joins_of(used) == 1
    assert all("loomline-" in path for path in used.inputFiles())  # the tables are not read again


def test_vectors_of_a_large_key_are_not_gathered_by_key(spark, monkeypatch):
    """Rows of large keys meet what is known of their key by broadcast, and go straight to the cells."""
    vectors = frame(spark, [(i, [1.0, float(i % 7)], "hot" if i % 3 else f"s{i % 30}") for i in range(300)], "vec_id long, embedding array<double>, session_id string")
    asked = retrieval.asked_of(vectors)
    expected = sorted(map(tuple, retrieval.nearest(vectors, asked, within="session_id").collect()))
    monkeypatch.setattr(retrieval, "GROUP_ROWS", 40)
    found = retrieval.nearest(vectors, asked, within="session_id")
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == expected


def test_lists_and_contexts_of_a_question_meet_in_one_join(spark, data):
    from loomline.plans import registry

    rows = registry.QUERIES["evaluation_rows"](spark, data)
    assert joins_of(rows) == 1
    assert all("loomline-" in path for path in rows.inputFiles())
