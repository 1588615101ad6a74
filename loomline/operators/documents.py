"""From folders and pages to chunks with ids and a mirror with fixed columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.rules import doc_type, folder_parts, title_of
from loomline.functions.text import strip
from loomline.operators.folds import Fold, folded
from loomline.operators.ordering import number_within

CHUNK, OVERLAP, PAGES = 1_000, 50, 3
STRINGS = ("text", "source_file", "product_type", "category", "sub_category", "plan_no", "uin", "doc_type", "page_range", "processed_at")
INTEGERS = ("chunk_index", "batch_num", "chunk_length", "total_pages")


def chunks_of(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size``, cut back to a blank if that lies beyond ``overlap``; each repeats ``overlap`` characters."""
    found, at = [], 0
    text = text or ""
    while len(text) - at >= size:
        end = at + size
        if end < len(text) and text[end] not in " \n":
            blank = text.rfind(" ", at, end)
            if blank - at > overlap:
                end = blank
        if piece := text[at:end].strip():
            found.append(piece)
        at = max(at, end - overlap)
    if rest := text[at:].strip():
        found.append(rest)
    return found


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, places, texts = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = chunks_of(text)
            ids += [key] * len(own)
            places += range(len(own))
            texts += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "place", "text"])


def chunk_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, place, text)``. Nothing is shuffled: a text is cut where it lies."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunked, "doc_id long, place int, text string")


def next_index(stored: DataFrame, key: str = "chunk_index") -> int:
    """One more than the largest stored id; 0 where nothing is stored."""
    return int(stored.agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0])


def numbered(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Add ``chunk_index`` from ``start`` on, in the order of document and place."""
    return number_within(chunks, [], ["doc_id", "place"], "_n").withColumn("chunk_index", F.col("_n") - 1 + start).drop("_n")


def inserted(stored: DataFrame, new: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``new`` with the ids it gets when it is stored: on from the largest one, in the order given."""
    return number_within(new, [], order, "_n").withColumn(key, F.col("_n") - 1 + next_index(stored, key)).drop("_n")


def chunk_statistics(documents: DataFrame) -> DataFrame:
    """Characters and chunks of each document."""
    own = chunk_documents(documents).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"))
    return documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_characters")).join(own, "doc_id", "left").select("doc_id", "n_characters", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def mirror(chunks: DataFrame) -> DataFrame:
    """Fixed columns with defaults: empty strings and zeros; ``chunk_length`` is counted anew."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in STRINGS]
    numbers = [(F.coalesce(F.length("text"), F.lit(0)) if c == "chunk_length" else F.coalesce(F.col(c).cast("int"), F.lit(0))).cast("int").alias(c) for c in INTEGERS]
    return chunks.select(*numbers, *texts)


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_index") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of several new ones the last."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_at").desc()))
    kept = new.withColumn("_at", F.monotonically_increasing_id()).withColumn("_at", last).where("_at = 1").drop("_at")
    return old.join(kept.select(key), key, "left_anti").unionByName(kept)


def without_range(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    return df.where(~F.col(key).between(first, last))


def deletion_counts(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """``(n_before, n_deleted, n_after)`` of a deletion, in one pass."""
    hit = F.coalesce(F.col(key).between(first, last), F.lit(False)).cast("long")
    return df.agg(F.count("*").alias("n_before"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_deleted"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("n_after"))


def folders(plan_folders: DataFrame) -> DataFrame:
    """What each folder's name tells."""
    return plan_folders.select("folder_id", folder_parts(F.col("source_folder")).alias("p")).select("folder_id", "p.sub_category", "p.plan_no", "p.uin")


def file_types(chunks: DataFrame) -> DataFrame:
    """The kind of each file, from its name and its first text."""
    first = F.min(F.struct("batch_num", "chunk_index", F.coalesce("text", F.lit("")).alias("text"))).alias("f")
    name = F.regexp_replace(strip("source_file"), r"^(\./)+", "")
    files = chunks.where("source_file is not null").groupBy(name.alias("file")).agg(first, F.max("total_pages").alias("total_pages"), F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_characters"))
    title = title_of(F.lit(None).cast("string"), F.col("f.text"))
    return files.select("file", doc_type(F.col("file"), title, F.col("f.text")).alias("doc_type"), "total_pages", "n_chunks", "n_characters")


def with_folder(chunks: DataFrame, plan_folders: DataFrame) -> DataFrame:
    """Each chunk with its folder's metadata; the folder table has a fixed number of rows."""
    side = plan_folders.select(F.col("uin").alias("_uin"), "source_folder", F.col("sub_category").alias("plan_name"))
    return chunks.join(F.broadcast(side), F.upper(F.trim("uin")) == F.col("_uin"), "left").select("chunk_index", "uin", "source_folder", "plan_name")


def pages_joined(pages: DataFrame, per_batch: int = PAGES) -> DataFrame:
    """Pages ``(file, page, text)`` as batches of ``per_batch``: texts that are not blank, joined by blank lines."""
    rows = F.array_sort(F.collect_list(F.when(strip("text") != "", F.struct("page", "text"))))
    joined = F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n")
    batch = (F.floor((F.col("page") - 1) / per_batch) + 1).cast("int")
    span = F.concat(F.min("page").cast("string"), F.lit("-"), F.max("page").cast("string"))
    return pages.groupBy("file", batch.alias("batch_num")).agg(joined.alias("text"), span.alias("page_range")).where("text <> ''")


def paragraphs(documents: DataFrame) -> DataFrame:
    """Parts between blank lines, stripped, without empty ones."""
    parts = documents.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("place", "part"))
    return parts.select("doc_id", "place", strip("part").alias("paragraph")).where("paragraph <> ''")


def _cut(state: dict, pages: Iterator[tuple]) -> tuple[list[tuple], dict]:
    """Pages of a file in order; what is held is the rest of a chunk and one page."""
    held, n, out = state["held"], state["n"], []
    for (text,) in pages:
        held = f"{held}\n\n{text or ''}" if held else text or ""
        while len(held) >= CHUNK:
            end = CHUNK
            if end < len(held) and held[end] not in " \n" and (blank := held.rfind(" ", 0, end)) > OVERLAP:
                end = blank
            if piece := held[:end].strip():
                out.append((n, piece))
                n += 1
            held = held[max(0, end - OVERLAP) :]
    return out, {"held": held, "n": n}


_FOLD = Fold(
    "file string, place int, text string",
    lambda: {"held": "", "n": 0},
    _cut,
    core=lambda state: state["held"],
    carried=lambda begin, guessed, end: end | {"n": begin["n"] + end["n"] - guessed["n"]},
    finish=lambda state: [(state["n"], rest)] if (rest := state["held"].strip()) else [],
)
#: Pages of a slice; a task holds those of one.
SLICE_PAGES = 20_000


def chunk_pages(pages: DataFrame) -> DataFrame:
    """``(file, place, text)`` of pages ``(file, page, text)``: chunks that run on over the pages of a file.

    Where a chunk ends depends on all pages before it, through the part of a chunk that is held.
    """
    return folded(pages.where("file is not null"), "file", ["page"], ["text"], _FOLD, SLICE_PAGES)


def run_totals(chunks: DataFrame) -> DataFrame:
    """One row for each file ``(filename, total_pages, total_chars, num_chunks)`` and one with a null name for all of them."""
    name = F.regexp_replace(strip("source_file"), r"^(\./)+", "")
    by_file = chunks.where("source_file is not null").groupBy(name.alias("filename")).agg(F.max("total_pages").cast("long").alias("total_pages"), F.sum(F.length("text")).alias("total_chars"), F.count("*").alias("num_chunks"))
    sums = by_file.agg(F.lit(None).cast("string").alias("filename"), *[F.sum(c).alias(c) for c in ("total_pages", "total_chars", "num_chunks")])
    return by_file.unionByName(sums)
