from loomline.streaming import segments as streaming
from loomline.plans.registry import QUERIES
from tests.compare import rows_of


def test_stream_equals_batch(spark, data):
    assert rows_of(QUERIES["stream_dedup_tracker"](spark, data)) == rows_of(QUERIES["dedup_tracker"](spark, data))


def test_session_windows(spark, tmp_path):
    spark.createDataFrame(
        [(1, "s", "customer", "a", True, 0.0), (2, "s", "customer", "b", True, 1.0), (3, "s", "customer", "c", True, 10.0), (4, "z", "agent", "x", True, 2000.0), (5, "z", "customer", "y", True, 2000.0)],
        "segment_id long, session_id string, speaker string, text string, is_final boolean, spoken_at double",
    ).write.parquet(str(tmp_path / "transcript_segments.parquet"))
    stream = streaming.read_stream(spark, str(tmp_path), "transcript_segments")
    found = {(r["first_id"], r["n_segments"]) for r in streaming.drained(streaming.turn_windows(stream), "test").collect()}
    assert {(1, 2), (3, 1)} <= found


def test_all_session_windows(spark, data, tmp_path):
    batch = streaming.turn_windows(spark.read.parquet(f"{data}/transcript_segments.parquet"))
    assert rows_of(QUERIES["stream_turn_windows"](spark, data)) == rows_of(batch)
    # several micro-batches, the last one a late row that joins two windows, and a window at the very end
    schema = "segment_id long, session_id string, speaker string, text string, is_final boolean, spoken_at double"
    path = str(tmp_path / "transcript_segments.parquet")
    for rows in ([(1, "s", "customer", "a", True, 0.0), (2, "s", "customer", "b", True, 2.0)], [(5, "z", "customer", "y", True, 9000.0)], [(6, "s", "customer", "c", True, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = {(r["first_id"], r["n_segments"]) for r in streaming.drained(streaming.turn_windows(stream, late=None), "all", "complete").collect()}
    assert found == {(1, 3), (5, 1)}


def test_turns_close_by_speaker_silence_and_end(spark, tmp_path):
    rows = [(1, "s", "customer", "a", True, 0.0), (2, "s", "customer", "b", True, 1.0), (3, "s", "agent", "x", True, 1.2), (4, "s", "customer", "c", True, 1.3), (5, "s", "customer", "d", True, 9.0)]
    path = str(tmp_path / "transcript_segments.parquet")
    for row in rows:  # one micro-batch each
        spark.createDataFrame([row], "segment_id long, session_id string, speaker string, text string, is_final boolean, timestamp double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 5).parquet(path)
    found = {(r["island"], r["text"]) for r in streaming.drained(streaming.customer_turns(stream), "turns", rest=streaming.open_turns).collect()}
    assert found == {(1, "a b"), (4, "c"), (5, "d")}
