"""Cleaning of transcript streams: finals, two kinds of repeats, customer turns, partials and latency.

Decisions that depend on earlier ones are folds over islands: runs of rows so close in time that one can matter for the
next. Islands of any key are folded in parallel and inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import has_text, strip
from loomline.operators.timeline import islands, running_sum, with_previous

REPEAT_SECONDS = 0.5
SILENCE_SECONDS = 1.5


def finals(segments: DataFrame) -> DataFrame:
    """Final rows with text."""
    return segments.where(F.coalesce("is_final", F.lit(False)) & has_text("text"))


def _thinned(cut: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Keys of the rows that stay: the first of an island, and each next one over ``REPEAT_SECONDS`` after the last that stayed.

    An island holds only rows of the same words, each at most ``REPEAT_SECONDS`` after the one before, so it is short.
    """
    none = F.expr("cast(array() as array<struct<at:double,key:bigint>>)")
    free = lambda held, x: (F.size(held) == 0) | (x["at"] - F.try_element_at(held, F.lit(-1))["at"] > REPEAT_SECONDS)
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "key"))), none, lambda held, x: F.when(free(held, x), F.concat(held, F.array(x))).otherwise(held))
    return cut.groupBy(*keys, "island").agg(fold.alias("kept")).select(F.explode(F.col("kept.key")).alias(key))


def _said(df: DataFrame, session: str, at: str, key: str) -> DataFrame:
    return df.select(session, "speaker", strip("text").alias("said"), F.col(at).alias("at"), F.col(key).alias("key"))


def without_echoes(segments: DataFrame, session: str = "session_id", at: str = "timestamp", key: str = "segment_id") -> DataFrame:
    """Drop a row whose text a kept row of its speaker had at most ``REPEAT_SECONDS`` before. ``(key)`` of the kept rows.

    Only rows of the same words matter for each other, so words are part of the key and a busy session is spread.
    """
    keys = [session, "speaker", "said"]
    return _thinned(islands(_said(segments, session, at, key), keys, "at", "key", lambda p: F.col("at") - p["at"] > REPEAT_SECONDS), keys, key)


def without_repeats(turns: DataFrame, session: str = "session_id", at: str = "spoken_at", key: str = "id") -> DataFrame:
    """Drop a row that says what the last kept row of its speaker said at most ``REPEAT_SECONDS`` before.

    A row with other words than the last kept one is kept, so only runs of the same words have to be thinned.
    """
    new = lambda p: (F.col("at") - p["at"] > REPEAT_SECONDS) | (F.col("said") != p["said"])
    keys = [session, "speaker"]
    return _thinned(islands(_said(turns, session, at, key), keys, "at", "key", new, ["said"]), keys, key)


def customer_turns(segments: DataFrame, session: str = "session_id", at: str = "timestamp", key: str = "segment_id") -> DataFrame:
    """Customer rows joined until an agent's row or ``SILENCE_SECONDS`` without speech."""
    rows = _said(segments, session, at, key)
    new = lambda p: (p["speaker"] != F.col("speaker")) | (F.col("at") - p["at"] > SILENCE_SECONDS)
    cut = islands(rows, [session], "at", "key", new, ["speaker"]).where(F.col("speaker") == "customer")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "said"))), lambda x: x["said"]), " ")
    return cut.groupBy(session, "island").agg(F.count("*").alias("n_segments"), joined.alias("text"), F.min("at").alias("start_at"), F.max("at").alias("end_at"))


def text_by_window(segments: DataFrame, session: str = "session_id", at: str = "timestamp", key: str = "segment_id", seconds: float = 5.0) -> DataFrame:
    """The text of each fixed window of a session."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(key), strip("text").alias("said")))), lambda x: x["said"]), " ")
    return segments.groupBy(session, F.floor(F.col(at) / seconds).alias("window_no")).agg(joined.alias("text")).where(has_text("text"))


def latest_partials(segments: DataFrame) -> DataFrame:
    """The last partial row of each session and speaker. An aggregate: no key is gathered."""
    last = F.max(F.struct("timestamp", "segment_id", "text")).alias("last")
    partial = segments.where(~F.coalesce("is_final", F.lit(False)) & F.col("timestamp").isNotNull())
    return partial.groupBy("session_id", "speaker").agg(last).select("session_id", "speaker", F.col("last.segment_id").alias("segment_id"), F.col("last.text").alias("text"))


def with_latency(segments: DataFrame) -> DataFrame:
    """Latency in milliseconds, from when the words were said and when they were written down."""
    return segments.select("segment_id", "session_id", F.round((F.col("transcribed_at") - F.col("spoken_at")) * 1000, 3).alias("latency_ms"))


def spoken_times(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """When each row was said: its session's start, ``starts(session_id, start)``, and its seconds in the stream; 0 where these are unknown."""
    at = F.col("start") + F.coalesce(F.col("timestamp"), F.lit(0.0))
    joined = segments.join(starts, "session_id", "left").withColumn("said_at", at)
    return joined.select("segment_id", "session_id", F.round("said_at", 3).alias("said_at"), F.round((F.col("transcribed_at") - F.col("said_at")) * 1000, 1).alias("latency_ms"))


def running_latency(segments: DataFrame) -> DataFrame:
    """Mean latency of each session so far, to the nearest millisecond."""
    rows = segments.where("timestamp is not null").select("segment_id", "session_id", F.col("timestamp").alias("at"), F.col("latency_ms").cast("decimal(20,3)").alias("ms"))
    summed = running_sum(rows, ["session_id"], "at", "segment_id", F.coalesce("ms", F.lit(0).cast("decimal(20,3)")), "total")
    counted = running_sum(summed, ["session_id"], "at", "segment_id", F.col("ms").isNotNull().cast("long"), "n")
    return counted.where("n > 0").select("segment_id", "session_id", F.round(F.col("total").cast("double") / F.col("n"), 3).alias("mean_ms"))


def silences(segments: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Rows that follow ``seconds`` or more without any row of their session: where a connection had to be held open."""
    rows = segments.where("timestamp is not null").select("segment_id", "session_id", F.col("timestamp").alias("at"))
    gaps = with_previous(rows, ["session_id"], "at", "segment_id", ["at"])
    return gaps.withColumn("gap", F.round(F.col("at") - F.col("prev.at"), 3)).where(F.col("gap") >= seconds).select("segment_id", "session_id", "gap")


def latest(df: DataFrame, keys: list[str], order: list[str], n: int, *, newest: bool) -> DataFrame:
    """The first or last ``n`` rows of each key. Ranked below the shuffle first, so large keys are cut early."""
    by = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)
