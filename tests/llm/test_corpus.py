"""Encoding and filling, against the tokenizer itself and against exact conditions."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import containers, corpus_tokens

TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b \n c", "\n\n", "x y", "a  b", "don't we'll I'VE", "<|endoftext|> x", "नमस्ते दुनिया", "😀🙏 👨‍👩‍👧", "a\x1cb \x1c c", "tab\t\tx", "x" * 5000, "1234 567", "a \x85b", "é é", "ab " * 4000, "﻿a", "वी ி"]


def rule():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=corpus_tokens.PATTERN, mergeable_ranks=corpus_tokens.token_bytes(), special_tokens={})


def documents(spark, texts):
    rows = [(i, t, i, "w", b"u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block long, words string, units binary")


@pytest.mark.parametrize("block_chars", [50, 16_000_000])
def test_ids_equal_whole_text_encoding(spark, block_chars):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab \n\t' 1.é,s") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = {r["doc_id"]: r["ids"] for r in corpus_tokens.encode_corpus(documents(spark, texts), block_chars=block_chars).collect()}
    own = rule()
    assert found == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counted = {r["doc_id"]: r["n_tokens"] for r in corpus_tokens.count_tokens(documents(spark, texts), block_chars=block_chars).collect()}
    assert counted == {i: len(ids) for i, ids in found.items()}


def test_round_trip_and_repeats(spark):
    df = documents(spark, TEXTS)
    twice = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    encoded = corpus_tokens.encode_corpus(twice)
    assert encoded.count() == 2 * len(TEXTS)
    back = sorted(r["text"] for r in corpus_tokens.decode_corpus(encoded).collect())
    assert back == sorted(2 * [t or "" for t in TEXTS])
    assert corpus_tokens.decode_corpus(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None


def test_empty(spark):
    assert corpus_tokens.encode_corpus(documents(spark, []).limit(0)).count() == 0
    assert containers.pack_documents(documents(spark, []).limit(0)).count() == 0


def closest_by_force(counts, room):
    sums = {0}
    for size, n in counts.items():
        sums = {s + k * size for s in sums for k in range(n + 1)}
    return max(s for s in sums if s <= room)


def test_closest_multiset():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        used = containers._closest(counts, room)
        assert all(used[s] <= counts[s] for s in used)
        assert sum(s * n for s, n in used.items()) == closest_by_force(counts, room)


def test_filling(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 3, 7, 50, 99, 100, 101, 250, 300]) if i % 3 else 40 for i in range(900)] + [None]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, salt string")
    rows = containers.fill_containers(df, "doc_id", "n_tokens", 100).collect()
    load, by_doc = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert max(load.values()) <= 100 and set(by_doc) == set(range(901))
    assert all(sum(r["n_tokens"] for r in by_doc[i]) == (n or 0) for i, n in enumerate(sizes))
    assert all(len(by_doc[i]) == max(1, -(-(n or 0) // 100)) for i, n in enumerate(sizes))
    least = -(-sum(n or 0 for n in sizes) // 100)
    assert len([c for c in load.values() if c]) <= least * 1.1
    assert set(load) <= set(range(len(load)))


def test_only_empty_items(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, n_tokens long")
    assert {r["container_id"] for r in containers.fill_containers(df, "doc_id", "n_tokens").collect()} == {0}
