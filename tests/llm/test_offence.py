import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import offence
from loomline.llm.offence_text import passages, squeezed, words

DOCUMENTS = "doc_id long, text string, source string, block long, score double, texts string"
LABELS = "doc_id long, verdict string, text string"


@pytest.mark.parametrize(
    ("text", "term"),
    [("you d_i_m_w_i_t", "dimwit"), ("you s c u m b a g!", "scumbag"), ("h@lfw1t!", "halfwit"), ("$w1n3", "swine"), ("сrеtіn", "cretin"), ("bittttch", "bitch"), ("b*tch", "b*tch"), ("1d10t.", "idiot"), ("mor​on", "moron"), ("ＭＯＲＯＮ", "moron"), ("सूअर।", "सूअर")],
)
def test_disguises(text, term):
    assert term in [squeezed(w) for w in words(text)]


def test_passages():
    assert passages("[10:01] agent Hello there. How? \n\nCustomer: Yes") == ["Hello there.", "How?", "Yes"]
    assert passages(None) == [] and passages(" \n ") == []
    assert words("for 12,000 rupees at 17:30 KML12345") == ["for", "0", "rupees", "at", "0", "ref"]


def corpus(spark):
    rng = random.Random(9)
    fine = ["The claim was sent on Monday.", "How much is the premium?", "The grace period is 15 days.", "A bloody discharge was noted in the summary.", "He felt stupid for losing the form."]
    bad = ["You are a complete {}.", "Please pay the claim, you {}!", "What a {} you are.", "Shut your mouth, you {}."]
    names = ["dimwit", "halfwit", "scumbag", "zorgon"]
    documents, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(fine) for _ in range(6))
        is_bad = i % 4 == 0
        if is_bad:
            text += " " + rng.choice(bad).format(rng.choice(names))
        documents.append((i, text, rng.choice(["e-mail", "E-Mail "]), 1, 0.5, "t"))
        if i < 300:
            labels.append((i, "abusive" if is_bad else "none", "t"))
    documents += [(1000, "How much is it, you z0rg0n?", "x", 1, 0.5, "t"), (1001, "z*rg*n!", "x", 1, 0.5, "t"), (1002, None, None, 1, 0.5, "t"), (1003, "", "x", 1, 0.5, "t"), (None, "The claim was sent.", "x", 1, 0.5, "t"), (1004, "The claim. " * 20_000 + "You z o r g o n.", "x", 1, 0.5, "t")]
    documents.append(documents[0])
    labels += [(0, "abusive", "t"), (999_999, "abusive", "t"), (3, "odd", "t"), (None, "none", "t"), (1, None, "t")]
    return spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(labels, LABELS)


def test_scores(spark):
    documents, labels = corpus(spark)
    rows = offence.score_documents(documents, labels).collect()
    assert len(rows) == documents.count()
    score = {r["doc_id"]: r["score"] for r in rows}
    held_out = range(300, 400)
    right = sum((score[i] >= offence.DECISION) == (i % 4 == 0) for i in held_out)
    assert right >= 98
    assert all(score[i] >= offence.DECISION for i in (1000, 1001, 1004))
    assert score[1002] == score[1003] == score[None] == 0
    found = {r["doc_id"] for r in offence.offensive_documents(documents, labels).collect()}
    assert found == {i for i, s in score.items() if s >= offence.DECISION}
    rates = {r["source"]: r["n_documents"] for r in offence.source_rates(offence.score_documents(documents, labels)).collect()}
    assert rates == {"e_mail": 401, "x": 5, "unknown": 1}


def test_no_labels_and_no_documents(spark):
    documents, labels = corpus(spark)
    one = spark.createDataFrame([(1, "Go to hell, you moron.", "x", 1, 0.0, "t"), (2, "The claim was sent.", "x", 1, 0.0, "t")], DOCUMENTS)
    # without a verdict there is no example, and no list stands in for it
    assert {r["score"] for r in offence.score_documents(one, labels.limit(0)).collect()} == {0.0}
    assert offence.score_documents(documents.limit(0), labels).count() == 0


def test_nearest_is_exact():
    rng = random.Random(2)
    terms = [f"t{i}" for i in range(40)]
    windows = sorted({("t0", tuple(rng.choice(terms) for _ in range(4)) + ("t0",), rng.random()) for _ in range(700)})
    examples = offence.Examples({"t0"}, {}, windows, {t: rng.randint(1, 50) for t in terms}, 100)
    index, stored = examples.indexes["t0"], [examples.vector(w) for _, w, _ in sorted(windows)]
    for _ in range(50):
        query = examples.vector(tuple(rng.choice(terms) for _ in range(5)))
        scores = np.array([sum(w * v.get(t, 0.0) for t, w in query.items()) for v in stored])
        best, near = index.nearest(query)
        assert np.allclose(sorted(near), sorted(scores)[-offence.NEIGHBOURS :])
        assert np.allclose(scores[best], near)


def test_several_verdicts(spark):
    labels = spark.createDataFrame([(1, "abusive", ""), (1, "none", ""), (2, "None ", ""), (2, "SEXUAL", "")], LABELS)
    assert {r["judged"]: r["share"] for r in offence._judged_share(labels).collect()} == {1: 0.5, 2: 0.5}
    assert offence._judged_share(labels.where(F.lit(False))).count() == 0


def test_passage_without_telling_word(spark):
    fine = ["The claim was sent on Monday.", "How much is the premium?", "The grace period is 15 days.", "The branch opens at ten."]
    documents = [(i, " ".join(fine[: 1 + i % 4]), "x", 1, 0.5, "t") for i in range(40)]
    documents += [(100, "The claim was sent on Monday. Only a wretched blorkling would swallow that soup.", "x", 1, 0.5, "t"), (101, "The claim was late.", "x", 1, 0.5, "t")]
    documents += [(200, "How much is the premium? Only a wretched blorkling would swallow that soup!", "x", 1, 0.5, "t"), (201, "The claim was sent on Friday.", "x", 1, 0.5, "t")]
    # one document of each kind is judged offensive; the verdict on 101 is wrong
    labels = [(i, "none", "t") for i in range(40)] + [(100, "abusive", "t"), (101, "abusive", "t")]
    rows = offence.score_documents(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(labels, LABELS)).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[100] > 0.8 and score[200] > 0.8
    assert score[201] < offence.DECISION and all(score[i] < offence.DECISION for i in range(40))


def test_calibration():
    rng = np.random.default_rng(5)
    votes = rng.random(4_000)
    slope, intercept = offence.calibrated(votes, (rng.random(4_000) < 1 / (1 + np.exp(-(6 * votes - 2)))).astype(float))
    assert abs(slope - 6) < 0.8 and abs(intercept + 2) < 0.5
    # without verdicts the prior decides: a vote over a half is offensive
    slope, intercept = offence.calibrated(np.zeros(0), np.zeros(0))
    assert slope > 0 and abs(-intercept / slope - 0.5) < 0.05


def test_only_the_nearest_examples_are_sorted(monkeypatch):
    import numpy as np

    from loomline.llm import offence

    rng = np.random.default_rng(8)
    draw = lambda: {f"t{t}": 1 / np.sqrt(3) for t in rng.choice(60, 3, replace=False)}
    rows = [(draw(), float(rng.integers(0, 3)) / 2, str(i)) for i in range(3_000)]
    index, labels, sort, sorted_ = offence._Index(rows), np.array([r[1] for r in rows]), np.lexsort, []
    for _ in range(50):
        query = draw()
        near = np.array([sum(w * own.get(t, 0.0) for t, w in query.items()) for own, _, _ in rows])
        expected = sort((np.arange(3_000), -labels, -np.round(near, 9)))[:5]
        monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or sort(keys))
        best, found = index.nearest(query)
        monkeypatch.undo()
        assert best.tolist() == expected.tolist() and np.allclose(found, near[expected])
    assert np.median(sorted_) < 300


def test_breaks_codes_and_numbers():
    from loomline.llm.offence_text import passages, words

    assert passages("Agent: a b. \u200bc\r\n\nd  e!\u2028 [00:12] customer x") == ["a b.", "c", "d  e!", "x"]
    assert words("KML24702 paid 1,200.50 on 3/4, b1tch ref980B470V03x") == ["ref", "paid", "0", "on", "0", "bitch", "ref98obatovoex"]
