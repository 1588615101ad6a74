"""Encoding a corpus with a public byte-level BPE, each distinct word once.

Words are cut only where the tokenizer itself always starts a new pre-token: before a blank that is followed by a
character other than white space. Such a word can be encoded on its own, and the ids of a text are the ids of its words
in order. The job has four steps:

1. every block of documents lists its distinct words, and every document becomes positions in that list;
2. the distinct words of all blocks are shuffled by word and each is encoded once;
3. the ids are joined back to the lists of the blocks;
4. each block's documents are put together again by position.

A word that fills a third of the corpus is one row per block in step 2, so no key is hot. A block holds a bounded amount
of text (``BLOCK_CHARS``, or one document if that is longer), so step 4 needs bounded memory.

Defined results: null and empty texts give an empty list; repeated rows and repeated ids give a row each; a null id stays
null; names of special tokens are ordinary text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import materialise, spread

#: Where the vocabulary files lie; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
BLOCK_CHARS = 16_000_000

#: The pre-token pattern that the vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLANK = re.compile(r" (?=\S)")
_BLOCKS = "block long, id long, size int, units binary, words array<string>"


@lru_cache(maxsize=4)
def token_bytes(name: str = VOCABULARY, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The bytes of each token and its id."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


@lru_cache(maxsize=4)
def _encoding(name: str, folder: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=token_bytes(name, folder), special_tokens={})


def _sent(spark: SparkSession, name: str, folder: str) -> None:
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_loomline_files", set())
    if (name, folder) not in sent:
        context.addFile(str(Path(folder, f"{name}.tiktoken")))
        sent.add((name, folder))


class _Codes(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class _Block:
    """Documents whose words share one list. Words after the first of a text carry an unwritten blank."""

    def __init__(self) -> None:
        self.later, self.first, self.ids, self.texts, self.units, self.chars = _Codes(), _Codes(), [], [], [], 0

    def add(self, key: int | None, text: str | None) -> None:
        self.ids.append(key)
        self.texts.append(text or "")
        self.chars += len(text or "")

    def _code(self, pieces: list[str]) -> np.ndarray:
        """Even codes: a word after a blank; odd codes: the first word of a text."""
        head, tail = pieces[0], pieces[1:]
        own = np.fromiter(map(self.later.__getitem__, tail), np.uint32, len(tail)) << np.uint32(1)
        return np.concatenate([[np.uint32(2 * self.first[head] + 1)], own]).astype(np.uint32) if head else own

    def rows(self, block: int) -> Iterator[dict]:
        coded = [self._code(text.split(" ")) if text else np.zeros(0, np.uint32) for text in self.texts]
        # a piece that is empty or begins with white space was cut inside a run of white space: cut those texts anew
        wrong = np.array([2 * code for word, code in self.later.items() if not word or word[0].isspace()], np.uint32)
        if wrong.size:
            bad = np.zeros(2 * len(self.later) + 2, bool)
            bad[wrong] = True
            for i, units in enumerate(coded):
                even = units[1:] if units.size and units[0] & 1 else units
                if bad[even].any():
                    coded[i] = self._code(_BLANK.split(self.texts[i]))
        skip = set(wrong.tolist())
        words = [(2 * c, " " + w) for w, c in self.later.items() if 2 * c not in skip]
        words += [(2 * c + 1, w) for w, c in self.first.items()]
        order = np.full(2 * max(len(self.later), len(self.first), 1) + 2, -1, np.int64)
        order[[c for c, _ in words]] = np.arange(len(words))
        narrow = np.uint16 if len(words) < 65536 else np.uint32
        yield {"block": block, "id": None, "size": None, "units": None, "words": [w for _, w in words]}
        for key, units in zip(self.ids, coded, strict=True):
            place = order[units].astype(narrow)
            yield {"block": block, "id": key, "size": narrow().itemsize, "units": place.tobytes(), "words": None}


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("units", pa.binary()), ("words", pa.list_(pa.string()))]
)


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, block, n = TaskContext.get().partitionId() << 32, _Block(), 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(key, text)
                if block.chars >= limit or len(block.ids) >= 200_000:
                    yield pa.RecordBatch.from_pylist(list(block.rows(base + n)), schema=_BLOCK_SCHEMA)
                    block, n = _Block(), n + 1
        if block.ids:
            yield pa.RecordBatch.from_pylist(list(block.rows(base + n)), schema=_BLOCK_SCHEMA)

    return run


def word_ids(words: DataFrame, column: str, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """Add ``token_ids`` to distinct words. The vocabulary goes to the workers as a file of the job."""
    _sent(words.sparkSession, name, folder)

    @F.pandas_udf("array<int>")
    def encode(batch: pd.Series) -> pd.Series:
        own = _encoding(name, SparkFiles.getRootDirectory())
        return pd.Series([np.array(own.encode_ordinary(word), np.int32) for word in batch])

    return words.withColumn("token_ids", encode(column))


def _encoded_blocks(documents: DataFrame, id_column: str, text_column: str, name: str, folder: str, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """The documents as positions in their block's words; the ids of each block's words by position."""
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    blocks = materialise(spread(source).mapInArrow(_blocks(block_chars), _BLOCKS), "token-blocks")
    listed = blocks.where("words is not null").select(F.col("block").alias("owner"), F.posexplode("words").alias("place", "word"))
    encoded = word_ids(listed.select("word").distinct(), "word", name, folder)
    return blocks.where("words is null").select("block", "id", "size", "units"), listed.join(encoded, "word").select("owner", "place", "token_ids")


def _dictionary(words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words of a block in one array, with the start and the length of each word by position."""
    ids = words.column("token_ids").combine_chunks()
    ids = ids if isinstance(ids, pa.ListArray) else pa.concat_arrays(ids.chunks)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    place = words.column("place").to_numpy()
    start, length = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    start[place], length[place] = offsets[:-1], np.diff(offsets)
    return ids.values.to_numpy(), start, length


def _units(row_size: int, units: bytes) -> np.ndarray:
    return np.frombuffer(units, np.uint16 if row_size == 2 else np.uint32)


def _assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
    values, start, length = _dictionary(words)
    sizes, stored = documents.column("size").to_pylist(), documents.column("units").to_pylist()
    ends, parts, total = [0], [], 0
    for size, units in zip(sizes, stored, strict=True):
        place = _units(size, units)
        n = length[place]
        if place.size:
            before = np.cumsum(n) - n
            parts.append(values[np.repeat(start[place] - before, n) + np.arange(int(n.sum()))])
            total += int(n.sum())
        ends.append(total)
    flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
    return pa.table({"id": documents.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})


def _count(documents: pa.Table, words: pa.Table) -> pa.Table:
    _, _, length = _dictionary(words)
    stored = zip(documents.column("size").to_pylist(), documents.column("units").to_pylist(), strict=True)
    return pa.table({"id": documents.column("id"), "n_tokens": pa.array([int(length[_units(*x)].sum()) for x in stored], pa.int64())})


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, name: str = VOCABULARY, folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id_column, ids)``: every row's token ids in order."""
    rows, words = _encoded_blocks(documents, id_column, text_column, name, folder, block_chars)
    done = rows.groupBy("block").cogroup(words.groupBy("owner")).applyInArrow(_assemble, "id long, ids array<int>")
    return done.select(F.col("id").alias(id_column), "ids")


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, name: str = VOCABULARY, folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id_column, n_tokens)`` by the same steps, without writing the ids."""
    rows, words = _encoded_blocks(documents, id_column, text_column, name, folder, block_chars)
    done = rows.groupBy("block").cogroup(words.groupBy("owner")).applyInArrow(_count, "id long, n_tokens long")
    return done.select(F.col("id").alias(id_column), "n_tokens")


def token_table(spark, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The vocabulary as rows ``(token_id, token_bytes)``; its size is that of the vocabulary, whatever the corpus."""
    rows = [(rank, bytearray(token)) for token, rank in token_bytes(name, folder).items()]
    return spark.createDataFrame(rows, "token_id int, token_bytes binary")


def decode_corpus(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", *, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``(id_column, text)`` from token ids, by joining the table of token bytes and putting them in order.

    Each row is decoded on its own, so repeated ids and null ids stay rows of their own; a null list gives null.
    """
    tagged = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    held = materialise(tagged, "decode")
    places = held.select("row", F.posexplode("ids").alias("place", "token_id"))
    parts = places.join(F.broadcast(token_table(encoded.sparkSession, name, folder)), "token_id")
    text = (
        parts.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.hex("token_bytes").alias("h")))).alias("p"))
        .select("row", F.decode(F.unhex(F.array_join(F.col("p.h"), "")), "UTF-8").alias("text"))
    )
    joined = held.select("row", "id", F.col("ids").isNull().alias("none")).join(text, "row", "left")
    return joined.select(F.col("id").alias(id_column), F.when(~F.col("none"), F.coalesce("text", F.lit(""))).alias("text"))
