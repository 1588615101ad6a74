from pyspark.sql import functions as F

from loomline.functions import rules, text, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.strip("t"), t="  a b　\n") == "a b"
    assert one(spark, text.word_count("t"), t=" a  b c ") == 3
    assert one(spark, text.first_words("t", 2), t="a b c") == "a b ..."
    assert one(spark, text.first_words("t", 3), t="a b c") == "a b c"
    assert [one(spark, text.token_estimate("t"), t=t) for t in ("", "abc", "abcdefgh")] == [0, 1, 2]
    assert one(spark, text.humanized("t"), t="money_back-plans") == "Money Back Plans"
    assert one(spark, text.first_words("t", 3), t=" a  b\n") == "a b"
    assert one(spark, text.event_payload("t"), t="data: {}") == "{}"
    assert one(spark, text.event_payload("t"), t=" word ") == " word "
    assert one(spark, text.event_payload("t"), t="data:  word ") == "word "
    assert one(spark, text.event_payload("t"), t=" ") == " " and one(spark, text.event_payload("t"), t="data: ") is None
    assert one(spark, text.event_payload("t"), t="data: [DONE]") is None
    assert one(spark, text.setting("t"), t="A = b=c") == ("A", "b=c")
    assert one(spark, text.setting("t"), t="# A=b") is None
    assert one(spark, text.clock(F.lit(3661.5))) == "01:01:01.500"
    assert one(spark, text.prompt(F.lit(" "), F.lit("q"))) == "q"
    assert one(spark, text.history_prompt(F.array(F.lit("a"), F.lit("b")), F.lit("q"))) == "Relevant conversation history:\n  - a\n  - b\n\nCustomer question: q"
    assert one(spark, text.history_prompt(F.array().cast("array<string>"), F.lit("q"))) == "Customer question: q"
    assert one(spark, text.suggestion_prompt(F.lit("a"), F.lit(None).cast("string"))) == "Conversation:\na\n\nPolicy context:\n"
    assert one(spark, text.last_space_before(F.lit("ab cd ef"), 6)) == 5
    assert one(spark, text.tagged(F.lit("agent"), F.lit("x"), F.lit(True))) == "[AGENT — IMPORTANT]: x"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == 1.0
    assert one(spark, vectors.cosine(a, b)) == 0.0
    assert one(spark, vectors.normalized(a)) == [0.6, 0.8]
    assert round(one(spark, vectors.rms(a)), 6) == 3.535534
    assert one(spark, vectors.pcm16(F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.5)))) == [32767, -32768, 16384]
    assert one(spark, vectors.pcm16_asymmetric(F.array(F.lit(1.0), F.lit(-1.0)))) == [32767, -32768]
    assert one(spark, vectors.resampled(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), 3, 5)) == [0.0, 0.5, 1.0, 1.5, 2.0]
    assert one(spark, vectors.resampled(F.array(F.lit(0.0), F.lit(3.0), F.lit(6.0)), 5, 3)) == [0.0]  # 1.8 samples are one


def test_rules(spark):
    said = F.lit("Too expensive, what's included, and let's proceed")
    assert one(spark, rules.intents_of(said)) == ["buying_signal", "policy_inquiry", "objection"]
    assert one(spark, rules.is_refinement(F.lit("agent"), F.lit("Please REPHRASE it")))
    assert not one(spark, rules.is_refinement(F.lit("customer"), F.lit("rephrase")))
    assert one(spark, rules.folder_parts(F.lit("kml-nivesh-plus-plan-749-512L317v02"))) == ("Nivesh Plus", "749", "512L317V02")
    assert one(spark, rules.folder_parts(F.lit("kml-accident-benefit-rider-512b203v03"))) == ("Accident Benefit Rider", "", "512B203V03")
    assert one(spark, rules.doc_type(F.lit("CIS_X.pdf"), F.lit(""), F.lit(""))) == "Customer Information Sheet"
    assert one(spark, rules.doc_type(F.lit("x.pdf"), F.lit("A title"), F.lit(None).cast("string"))) == "A title"
    assert one(spark, rules.title_of(F.lit("Untitled"), F.lit("ab\n  A long line"))) == "A long line"
    assert [one(spark, rules.error_action(F.lit(c))) for c in (401, 403, 500)] == ["fatal", "fatal", "retry"]
    assert one(spark, rules.error_action(F.lit(None).cast("int"))) == "retry"
    assert one(spark, rules.retry_delays(F.lit(5))) == [1.0, 2.0, 4.0, 8.0]
    assert one(spark, rules.answer_text(F.lit('{"answer": 5, "text": "x"}'))) == "x"
    assert one(spark, rules.answer_text(F.lit('{"text": "x", "result": "y"}'))) == "y"
    assert one(spark, rules.answer_text(F.lit('{"content": "x"}'))) == '{"content": "x"}'
    assert one(spark, rules.answer_text(F.lit('{"other": 5}'))) == '{"other": 5}'
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    assert [one(spark, rules.age_hours(F.lit(t), now)) for t in ("2026-01-01T00:00:00", "2026-01-01T05:30:00+05:30", "no time")] == [24.0, 24.0, None]
    assert one(spark, rules.recency(F.lit(None).cast("double"))) == 1.0
    assert round(one(spark, rules.recency(F.lit(168.0))), 6) == 0.367879
