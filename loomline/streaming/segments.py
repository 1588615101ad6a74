"""Structured Streaming forms of the steps over segments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.functions.rules import intents_of, is_refinement
from loomline.functions.text import strip, token_estimate, word_count
from loomline.operators import memory
from loomline.operators.gate import ANSWERS, COOLDOWN_SECONDS, FOLLOW_UP_WORDS
from loomline.operators.segments import REPEAT_SECONDS, SILENCE_SECONDS, finals
from loomline.session import scratch_dir

#: The most that one micro-batch reads.
BATCH_BYTES = 256 << 20


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    stream, jvm = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", BATCH_BYTES), spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def turn_windows(segments: DataFrame, gap: str = "1500 milliseconds", late: str | None = "10 minutes") -> DataFrame:
    """Customer speech by session windows; rows later than ``late`` are dropped by the watermark, without one (complete mode) none are."""
    rows = finals(segments).where("speaker = 'customer' and spoken_at is not null").select("session_id", "segment_id", F.timestamp_seconds("spoken_at").alias("at"))
    cut = (rows.withWatermark("at", late) if late else rows).groupBy("session_id", F.session_window("at", gap).alias("w"))
    return cut.agg(F.count("*").alias("n_segments"), F.min("segment_id").alias("first_id")).select("session_id", "first_id", "n_segments", F.unix_micros("w.start").alias("start_us"))


# ------------------------------------------------------------------------------------------------- folds with a state


def _folded(rows: DataFrame, keys: list[str], names: list[str], out: str, start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]]) -> DataFrame:
    """``step`` over the rows of each key in the order of their first two ``names``; what it returns is written at once.

    Arrival order between micro-batches is truth. The state is a small JSON text for each key. A micro-batch holds at most
    ``BATCH_BYTES`` of files, which bounds the rows of a key that are sorted in memory.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else start()
        table = pd.concat(list(batches)).sort_values(names[:2], kind="stable")
        made = [(*key, *one) for row in zip(*(table[n].tolist() for n in names), strict=True) for one in step(held, row)]
        state.update((json.dumps(held),))
        yield pd.DataFrame(made, columns=columns)

    columns = [part.split()[0] for part in out.split(", ")]
    return rows.select(*keys, *names).groupBy(*keys).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.NoTimeout)


def left_open(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """The state that a drained stream has left for each key, as ``(keys, held)``: read where the stream keeps it."""
    return spark.read.format("statestore").load(f"{base}/state").select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.groupState.held").alias("held"))


def _repeat_step(held: dict, row: tuple) -> list[tuple]:
    at, key, said = row
    if held and at - held["at"] <= REPEAT_SECONDS and said == held["said"]:
        return []
    held.update(at=at, said=said)
    return [(key,)]


def without_repeats(turns: DataFrame) -> DataFrame:
    """``(session_id, speaker, id)`` of the rows that stay; the last kept row of each session and speaker is the state."""
    rows = turns.where("is_final and session_id is not null and speaker is not null and spoken_at is not null and not isnan(spoken_at) and text is not null")
    rows = rows.select("session_id", "speaker", "id", strip("text").alias("said"), F.col("spoken_at").alias("at"))
    return _folded(rows, ["session_id", "speaker"], ["at", "id", "said"], "session_id string, speaker string, id long", dict, _repeat_step)


TURNS = "session_id string, island long, n_segments long, text string, start_at double, end_at double"


def _turn_step(held: dict, row: tuple) -> list[tuple]:
    at, key, speaker, said = row
    made = []
    if held and (speaker != held["speaker"] or at - held["end"] > SILENCE_SECONDS):
        made = _closed(held)
        held.clear()
    if held:
        held["end"] = at
        if speaker == "customer":
            held["said"].append(said)
    else:
        held.update(speaker=speaker, island=key, start=at, end=at, said=[said] if speaker == "customer" else [])
    return made


def _closed(held: dict) -> list[tuple]:
    return [(held["island"], len(held["said"]), " ".join(held["said"]), held["start"], held["end"])] if held and held["speaker"] == "customer" else []


def customer_turns(segments: DataFrame) -> DataFrame:
    """Customer turns as they close: by ``SILENCE_SECONDS`` without speech or, at once, by another speaker. The open turn is the state."""
    rows = finals(segments).where("session_id is not null and speaker is not null and timestamp is not null")
    rows = rows.select("session_id", F.col("timestamp").alias("at"), F.col("segment_id").alias("key"), "speaker", strip("text").alias("said"))
    return _folded(rows, ["session_id"], ["at", "key", "speaker", "said"], TURNS, dict, _turn_step)


def open_turns(spark: SparkSession, base: str) -> DataFrame:
    """The turns that the end of the input closes."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(session, *turn) for session, held in zip(batch["session_id"], batch["held"], strict=True) for turn in _closed(json.loads(held))]
            yield pd.DataFrame(made, columns=[part.split()[0] for part in TURNS.split(", ")])

    return left_open(spark, base, ["session_id"]).mapInPandas(close, TURNS)


def _gate_step(held: dict, row: tuple) -> list[tuple]:
    at, key, final, refine, hits, short = row
    cooling = held["last"] is not None and at - held["last"] < COOLDOWN_SECONDS
    if not final:
        return [(key, "no_trigger", "not final", "")]
    if refine:
        return [(key, "refine", "refinement", "")]
    if cooling:
        return [(key, "no_trigger", "cooldown", "")]
    reason = "intent" if hits else "follow_up" if held["fires"] >= ANSWERS and short else None
    if reason is None:
        return [(key, "no_trigger", "no match", "")]
    held.update(last=at, fires=held["fires"] + 1)
    return [(key, "fire", reason, hits or reason)]


def decisions(turns: DataFrame) -> DataFrame:
    """The gate over a stream of turns: patterns are columns, the last fire and the number of fires are the state."""
    timed = turns.where("spoken_at is not null and not isnan(spoken_at) and session_id is not null")
    final = F.coalesce("is_final", F.lit(False))
    said = F.coalesce("text", F.lit(""))
    rows = timed.select(
        "session_id", F.col("spoken_at").alias("at"), "id", final.alias("final"),
        (final & F.coalesce(is_refinement(F.col("speaker"), F.col("text")), F.lit(False))).alias("refine"),
        F.array_join(intents_of(said), ",").alias("hits"),
        (F.col("text").isNotNull() & (word_count("text") <= FOLLOW_UP_WORDS)).alias("short"),
    )
    return _folded(rows, ["session_id"], ["at", "id", "final", "refine", "hits", "short"], "session_id string, id long, action string, reason string, intents string", lambda: {"last": None, "fires": 0}, _gate_step)


def _epoch_step(held: dict, row: tuple) -> list[tuple]:
    made = memory.add_turn(held, row[1], row[2])
    return [made] if made else []


def compactions(turns: DataFrame) -> DataFrame:
    """Epochs of compaction as the budget overflows; the state is what the window holds."""
    rows = turns.where("session_id is not null").select("session_id", F.unix_micros("created_at").alias("at"), "id", token_estimate("text").alias("tokens"))
    return _folded(rows, ["session_id"], ["at", "id", "tokens"], memory.EPOCH_TYPES, memory.fresh, _epoch_step)


def drained(stream: DataFrame, name: str, mode: str = "append", rest: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote, with the ``rest`` that its state still holds at the end.

    In append mode what a watermark has not closed stays in the state. In complete mode each micro-batch writes the whole
    result, and that of the last one is read.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{scratch_dir(spark).rstrip('/')}/loomline-stream-{name}-{uuid.uuid4().hex}"
    if mode == "complete":
        last = []

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{base}/out/{batch}")
            last[:] = [batch]

        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out/{last[0]}") if last else spark.createDataFrame([], stream.schema)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return out.unionByName(rest(spark, base)) if rest else out
