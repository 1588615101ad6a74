import json
import random
import unicodedata

import pytest

from loomline.llm import hidden_copies, pieces
from loomline.llm.registry import ORACLE, QUERIES
from tests.compare import rows_of, sql_rows

SEGMENTS = "segment_id long, session_id string, speaker string, text string, timestamp double, key string"
RAW = "segment_id long, session_id string, payload string, id long"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == sql_rows(data, ORACLE[name])


def by_force(segments, raw):
    plain = lambda x: "".join(c for c in x.casefold() if not c.isspace() and unicodedata.category(c)[0] != "P")
    groups = {}
    for i, s, sp, t, at, _ in segments:
        groups.setdefault((s, sp, t, at), []).append(i)
    for i, s, p, _ in raw:
        try:
            o = json.loads(p)
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            groups.setdefault((s, o.get("speaker"), o.get("text"), o.get("timestamp")), []).append(i)
    merged = {}
    for (s, sp, t, at), ids in groups.items():
        if None not in (s, sp, t, at) and at == at:
            merged.setdefault((s, plain(sp), plain(t), float(at)), []).extend(ids)
    return {(min(v), i) for v in merged.values() for i in v if i != min(v)}


@pytest.mark.parametrize("limit", [3, 50_000])
def test_pairs(spark, limit):
    rng, segments, raw = random.Random(3), [], []
    base = ["Hello, world", "hello world!", "HELLO—WORLD…", "", " ", "x" * 20_000, "X" * 20_000, "नमस्ते।", "नमस्ते", None, "a", "ß", "ss"]
    for i in range(1, 400):
        hot = i % 3 == 0
        speaker, text, at = rng.choice(["agent", "Agent:", " AGENT", "customer", None]), "Hello, world" if hot else rng.choice(base), 1.5 if hot else rng.choice([1.5, 0.0, -0.0, float("nan"), None, 2])
        if i % 5:
            segments.append((i, rng.choice(["s1", "s2", None]), speaker, text, None if at is None else float(at), "k"))
        else:
            payload = {"speaker": speaker, "text": text, "timestamp": at if at == at else None, "extra": [1]}
            raw.append((i, rng.choice(["s1", "s2"]), rng.choice([json.dumps(payload), json.dumps(payload, indent=1, ensure_ascii=False), json.dumps(payload)[:-1], "null", "[]", "", None]), 9))
    found = hidden_copies.copy_pairs(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(raw, RAW), limit)
    assert {tuple(r) for r in found.collect()} == by_force(segments, raw)
    counted = hidden_copies.collapse(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(raw, RAW), limit).collect()
    assert len({r["keep_id"] for r in counted}) == len(counted)


def test_buckets_fit_or_end(spark):
    rows = [(f"{'p' * (i % 4) * 9}{i:05d}".encode(), i, 1) for i in range(500)] + [(b"same", i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "key binary, keep_id long, copies long")
    sizes = {}
    for r in hidden_copies._bucketed(df, 10)[0].collect():
        assert bytes(r["key"]).startswith(bytes(r["bucket"]))
        sizes.setdefault(bytes(r["bucket"]), []).append(bytes(r["key"]))
    assert all(len(v) <= 10 or set(v) == {b"same"} for v in sizes.values())


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], SEGMENTS), spark.createDataFrame([], RAW)
    assert hidden_copies.copy_pairs(a, b).count() == 0 and hidden_copies.collapse(a, b).count() == 0


CHUNKS = "chunk_index int, source_file string, page_range string, chunk_length int, text string, piece string"


def chunks(spark, texts):
    return spark.createDataFrame([(i, "f", None, 5, t, "x") for i, t in enumerate(texts)], CHUNKS)


def test_pieces_hold_the_limit():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "x" * 30, ". ", "\n\n", "\n", ", ", "é́́"]) for _ in range(rng.randint(1, 400))).strip()
        limit, overlap = rng.choice([(100, 10), (50, 0), (37, 20)])
        spans = pieces.split(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b in spans)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(q[0] == p[1] - overlap for p, q in zip(spans, spans[1:]))
        assert len(spans) >= -(-(len(text) - overlap) // (limit - overlap)) or len(text) <= limit


def test_natural_places():
    text = ("A sentence of some words. " * 80).strip()
    assert all(text[:b].rstrip().endswith(".") for _, b in pieces.split(text))
    paragraphs = "\n\n".join(["word " * 150] * 6).strip()
    assert sum(paragraphs[:b].endswith("\n\n") for _, b in pieces.split(paragraphs)[:-1]) >= 1


def test_oversized_rows(spark):
    texts = [None, "", "x" * 1000, "x" * 1001, " " * 600 + "x" * 500, "　" + "y" * 1000 + "\n", "word " * 50_000]
    assert sorted(r["chunk_index"] for r in pieces.oversized_rows(chunks(spark, texts)).collect()) == [3, 6]
    rows = pieces.oversized_pieces(chunks(spark, texts)).where("chunk_index = 3").orderBy("piece_no").collect()
    assert [len(r["piece"]) for r in rows] == [r["n_pieces"] and len(r["piece"]) for r in rows] and rows[1]["piece"][:50] == rows[0]["piece"][-50:]
    assert rows[0]["source_file"] == "f" and rows[0]["page_range"] is None
    assert pieces.cut_texts(chunks(spark, texts)).where("chunk_index = 5").count() == 1
    assert pieces.oversized_rows(chunks(spark, []).limit(0)).count() == 0


def test_one_key_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(hidden_copies, "BUCKET_KEYS", 2)
    rows = [(i, f"{i // 6:04d}".encode() if i % 3 else b"0000hot") for i in range(600)]
    keyed = spark.createDataFrame(rows, "id long, key binary").repartition(30)
    counts = {}
    for i, own in rows:
        held = counts.setdefault(own, [i, 0])
        held[0], held[1] = min(held[0], i), held[1] + 1
    found = {bytes(r["key"]): [r["keep_id"], r["copies"]] for r in hidden_copies.count_copies(keyed, 2).collect()}
    assert found == counts
    # the hot key's entries are not one bucket of a trie
    entries = keyed.select("key", "id").mapInArrow(hidden_copies._merge_local, "key binary, keep_id long, copies long")
    _, same = hidden_copies._bucketed(entries, 2)
    assert b"0000hot" in {bytes(r["full"]) for r in same.collect()}
