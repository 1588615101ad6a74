"""Writing what the jobs make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.documents import mirror


def write_mirror(chunks: DataFrame, path: str) -> None:
    """The Parquet mirror, rebuilt as a whole."""
    mirror(chunks).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_dump(chunks: DataFrame, path: str) -> None:
    """Chunks as text, each under a line with its number and file."""
    head = F.format_string("=== CHUNK %d (from %s) ===", "chunk_index", "source_file")
    chunks.select(F.concat_ws("\n", head, F.coalesce("text", F.lit("")), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quoted, so that texts may hold line ends and blanks at their ends; nulls as empty strings."""
    df.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").csv(path)


def write_tables(cells: DataFrame, path: str) -> None:
    """Extracted tables ``(page, table_index, row_no, cells array<string>)``, one folder for each."""
    lines = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    cells.select("page", "table_index", lines.alias("value")).write.mode("overwrite").partitionBy("page", "table_index").text(path)


def frames(segments: DataFrame) -> DataFrame:
    """What is pushed to a screen: one JSON text for each row."""
    return segments.select("segment_id", F.to_json(F.struct(F.lit("transcript").alias("type"), "speaker", "text", "is_final", "timestamp")).alias("frame"))


def suggestion_frames(decisions: DataFrame) -> DataFrame:
    """The other kind of frame: one for each decision that calls for an answer."""
    called = decisions.where("action in ('fire', 'refine')")
    return called.select("id", F.to_json(F.struct(F.lit("suggestion").alias("type"), "session_id", "reason", "intents")).alias("frame"))
