"""Scores of documents for abusive, hateful or sexually explicit language, by nearest labelled examples.

All examples come from people's verdicts on whole documents; no word or phrase is written here. Two indexes of them are
searched by exact TF-IDF cosine over block-max inverted lists, and each of the nearest examples votes for its share of
offensive verdicts with the power ``SHARPNESS`` of its similarity, against one vote of ``BACKGROUND`` for nothing offensive:

* Every distinct passage of the corpus is looked up among the labelled passages, over all their terms. A verdict is on a
  whole document, so a passage counts as offensive only if no document judged ordinary holds it or one as near to it as
  ``APART``, or half of that where a telling word explains the verdict, and no other passage of the document is much
  farther from all ordinary ones; very short ones need two documents. A vote needs an offensive neighbour of ``NEAR``.
* An insult may be the end of an ordinary sentence, so windows of a few words around telling words are looked up among
  the labelled windows around the same word. A word is telling if it stands more often in offensive documents than chance
  gives, or, however rare, if only passages that explain a verdict hold it; then a vote needs a window of ``NEAR_WINDOW``.
  A window around any other word has no offensive example and its vote is 0.

The higher vote counts, and a document has that of its highest passage. Votes over 0 become scores by a logistic curve
fitted to the judged documents of a held-out half, voted on by examples of the other half only; then all examples vote.

Bounds: at most ``MOST_JUDGED`` judged documents, the smallest by a hash of their id, are examples. Every document, passage
and window of the corpus is scored, and inverse document frequencies count every distinct passage.

As in the encoding job, distinct passages are listed by block, shuffled by passage and scored once; scores are joined
back to the blocks. A passage that fills a third of the corpus is one row per block.

Defined results: null and empty texts have score 0 and no evidence; several verdicts on one document are averaged and
ties count as offensive; verdicts in other spellings than the four names and verdicts on unknown documents are ignored;
repeated rows give a row each; null ids stay; without any verdict nothing is offensive; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.offence_text import masks, passages, squeezed, words
from loomline.session import materialise, spread

#: Words on either side of the word that a window is about.
REACH = 2
NEIGHBOURS = 5
SHARPNESS = 8
DECISION = 0.5
#: Cosines: below ``APART`` of all ordinary passages is offensive by its verdict; from ``NEAR`` on a labelled passage, and from ``NEAR_WINDOW`` on a window around a rare word, may vote.
APART = 0.45
NEAR = 0.5
NEAR_WINDOW = 0.6
#: Similarity at which an example weighs as much as the assumption that nothing offensive was said.
BACKGROUND = 0.3
#: Passages of fewer terms say too little by themselves.
LEAST_TERMS = 3
MOST_JUDGED = 20_000
#: Documents that the prior of the calibration counts for, and the weight that keeps its curve from being endlessly steep.
PRIOR_WEIGHT, RIDGE = 8, 0.01
BLOCK_CHARS = 16_000_000
POSTINGS_BLOCK = 64
OFFENSIVE = ("abusive", "hateful", "sexual")


def _windows(terms: list[str], telling: dict[str, int] | set[str]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Each telling word with the words around it."""
    for i, term in enumerate(terms):
        if term in telling:
            yield term, tuple(terms[max(0, i - REACH) : i + REACH + 1])


# ---------------------------------------------------------------------------------------------------- blocks of passages

_BLOCKS = "block long, id long, source string, places array<int>, texts array<string>"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("source", pa.string()), ("places", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))])


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, chars, raw, listed, rows = TaskContext.get().partitionId() << 32, 0, 0, {}, {}, []

        def block() -> pa.RecordBatch:
            head = {"block": base + n, "id": None, "source": None, "places": None, "texts": list(listed)}
            return pa.RecordBatch.from_pylist([head, *({"block": base + n, **row, "texts": None} for row in rows)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for key, text, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = set()
                for passage in passages(text):
                    at = raw.get(passage)
                    if at is None:
                        terms = " ".join(words(passage))
                        at = raw[passage] = listed.setdefault(terms, len(listed)) if terms else -1
                    places.add(at)
                rows.append({"id": key, "source": source, "places": sorted(places - {-1})})
                chars += len(text or "")
                if chars >= limit or len(rows) >= 200_000:
                    yield block()
                    n, chars, raw, listed, rows = n + 1, 0, {}, {}, []
        if rows:
            yield block()

    return run


# -------------------------------------------------------------------------------------------------------- the examples


class _Index:
    """Labelled windows around one word, as a block-max inverted index."""

    def __init__(self, rows: list[tuple[dict[str, float], float, str]]) -> None:
        self.labels, self.texts = np.array([label for _, label, _ in rows]), [text for _, _, text in rows]
        held: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for i, (vector, _, _) in enumerate(rows):
            for term, weight in vector.items():
                held[term][0].append(i)
                held[term][1].append(weight)
        self.n_blocks, self.postings = -(-len(rows) // POSTINGS_BLOCK), {}
        for term, (at, weight) in held.items():
            place, value = np.array(at), np.array(weight)
            highest = np.zeros(self.n_blocks)
            np.maximum.at(highest, place // POSTINGS_BLOCK, value)
            self.postings[term] = (place, value, highest)

    def highest(self, query: dict[str, float]) -> float:
        """The similarity of the nearest example."""
        near = np.zeros(len(self.labels))
        for term, w in query.items():
            if term in self.postings:
                place, value, _ = self.postings[term]
                near[place] += w * value
        return float(near.max(initial=0.0))

    def nearest(self, query: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples and their similarity. Blocks are scored from the best bound down, until none can enter."""
        lists = [(w, *self.postings[t]) for t, w in query.items() if t in self.postings]
        bound = sum((w * highest for w, _, _, highest in lists), np.zeros(self.n_blocks))
        near, least, done = np.zeros(len(self.labels)), 0.0, np.zeros(self.n_blocks, bool)
        order = np.argsort(-bound, kind="stable")
        start, step = 0, 8
        while start < len(order):
            blocks = order[start : start + step]
            start, step = start + step, 2 * step
            blocks = blocks[bound[blocks] >= least]
            if not blocks.size:
                break
            done[:] = False
            done[blocks] = True
            for w, place, value, _ in lists:
                own = done[place // POSTINGS_BLOCK]
                near[place[own]] += w * value[own]
            if len(near) >= NEIGHBOURS:
                least = np.partition(near, -NEIGHBOURS)[-NEIGHBOURS]
        rounded = np.round(near, 9)
        own = np.arange(len(near))
        if len(near) > NEIGHBOURS:  # all as near as the last one that enters, so that ties are decided below
            own = np.flatnonzero(rounded >= np.partition(rounded, -NEIGHBOURS)[-NEIGHBOURS])
        best = own[np.lexsort((own, -self.labels[own], -rounded[own]))[:NEIGHBOURS]]
        return best, near[best]


class Examples:
    """Telling words, masked spellings, the labelled windows of each word and the labelled passages."""

    def __init__(self, telling: set[str], masked: dict[str, str], windows: list[tuple[str, tuple[str, ...], float]], frequency: dict[str, int], total: int, said: list[tuple[str, float]] = [], rare: set[str] = frozenset()) -> None:  # noqa: B006
        self.telling, self.masked, self.frequency, self.total, self.rare, self.line = telling, masked, frequency, max(total, 1), rare, (1.0, 0.0)
        by_word = defaultdict(list)
        for word, window, label in sorted(windows):
            by_word[word].append((self.vector(window), label, " ".join(window)))
        self.indexes = {word: _Index(rows) for word, rows in by_word.items()}
        rows = [(self.vector(tuple(text.split(" "))), label, text) for text, label in sorted(said)]
        self.said, self.doors, self.offensive = _Index(rows), defaultdict(list), {}
        for i, (vector, label, _) in enumerate(rows):
            if label >= DECISION:
                self.offensive[i] = vector
                for term in vector:
                    self.doors[term].append(i)

    def vote_of_passage(self, terms: list[str]) -> tuple[float, str | None]:
        """The vote of the nearest labelled passages, if an offensive one is as near as ``NEAR``; without that it is 0."""
        # a cosine of NEAR needs that length in shared terms, and one of the first terms, without which the others are too short
        query = self.vector(tuple(terms)) if any(t in self.doors for t in terms) else {}
        shared = sorted(((w, t) for t, w in query.items() if t in self.doors), key=lambda x: (-x[0], x[1]))
        left, met = sum(w * w for w, _ in shared), set()
        for w, term in shared:
            if left < NEAR * NEAR - 1e-9:
                break
            met.update(self.doors[term])
            left -= w * w
        if not any(sum(w * self.offensive[i].get(t, 0.0) for w, t in shared) >= NEAR - 1e-9 for i in met):
            return 0.0, None
        return self._voted(self.said, *self.said.nearest(query))

    def vector(self, window: tuple[str, ...]) -> dict[str, float]:
        """Term weights of unit length."""
        idf = lambda t: math.log(1 + self.total / (1 + self.frequency.get(t, 0)))
        weights = {t: (1 + math.log(n)) * idf(t) for t, n in Counter(window).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def vote(self, word: str, window: tuple[str, ...]) -> tuple[float, str | None]:
        """The offensive share of the nearest examples' votes, and the nearest example that was mostly offensive."""
        index = self.indexes.get(word)
        if index is None:
            return 0.0, None
        best, near = index.nearest(self.vector(window))
        if word in self.rare and near[0] < NEAR_WINDOW - 1e-9:
            return 0.0, None
        return self._voted(index, best, near)

    @staticmethod
    def _voted(index: _Index, best: np.ndarray, near: np.ndarray) -> tuple[float, str | None]:
        power = near**SHARPNESS
        if not power.sum():
            return 0.0, None
        labels = index.labels[best]
        bad = best[labels >= 0.5]
        return float((power * labels).sum() / (power.sum() + BACKGROUND**SHARPNESS)), index.texts[bad[0]] if bad.size else None

    def resolved(self, terms: list[str]) -> list[str]:
        """Terms without repeated letters, masks and articles that were caught with a spaced-out word."""
        out = []
        for term in terms:
            if term[0] == "¤":
                whole, rest = squeezed(term[1:]), squeezed(term[2:])
                out += [term[1], rest] if rest in self.telling and whole not in self.telling else [whole]
            elif "*" in term or "#" in term:
                out.append(self.masked.get(term) or self.masked.get(term.rstrip("s")) or term)
            else:
                out.append(squeezed(term))
        return out


def _evidence(examples: Examples, shares: dict[str, list[float]], held: dict[int, set[str]]) -> tuple[dict[str, float], set[str]]:
    """Labels of the judged passages, and the rare words. ``shares``: those of each passage's documents; ``held``: passages of offensive documents."""
    ordinary = {text for text, own in shares.items() if min(own) < 0.5}
    index = _Index([(examples.vector(tuple(text.split(" "))), 0.0, text) for text in sorted(ordinary)])
    known = {term for text in ordinary for term in text.split(" ")}
    labels = dict.fromkeys(shares, 0.0)
    near = {text: index.highest(examples.vector(tuple(text.split(" ")))) for text in shares.keys() - ordinary}
    for texts in held.values():
        # one passage is enough for the verdict: others count only if they are as far from all ordinary ones
        own = {text: near[text] for text in texts if text in near and (len(shares[text]) > 1 or text.count(" ") >= LEAST_TERMS - 1)}
        explained = any(examples.telling & set(text.split(" ")) for text in texts if text in near)
        most = APART / 2 if explained else min(APART, min(own.values(), default=0.0) + APART / 3)
        labels.update(dict.fromkeys((text for text, least in own.items() if least < most), 1.0))
    rare = {term for text, label in labels.items() if label for term in text.split(" ")}
    for texts in held.values():
        if not any(labels[text] or examples.telling & set(text.split(" ")) for text in texts):
            rare |= {term for text in texts for term in text.split(" ")}
    return labels, {term for term in rare - known - examples.telling if not term.isdecimal() and len(term) > 2}


def learn(judged: list[tuple[int, float, str]], frequency: dict[str, int], total: int) -> Examples:
    """Examples from ``(id, share of offensive verdicts, passage)`` of the bounded sample of judged documents."""
    offensive = {i: share >= 0.5 for i, share, _ in judged}
    spelled, held = Counter(), defaultdict(set)
    for i, _, text in judged:
        for raw in text.split(" "):
            spelled[raw] += 1
            held[raw].add(i)
    own: dict[str, set[int]] = defaultdict(set)
    for raw, ids in held.items():
        own[squeezed(raw)] |= ids
    base = max(sum(offensive.values()) / max(len(offensive), 1), 1e-3)
    telling = {term for term, ids in own.items() if _tells(sum(offensive[i] for i in ids), len(ids), base)}
    masked: dict[str, str] = {}

    def mask(words_: Iterable[tuple[str, int]]) -> None:
        for word, _ in sorted(words_, key=lambda x: (-x[1], x[0])):
            for hidden in masks(word) if word.isalpha() else ():
                masked.setdefault(hidden, squeezed(word))

    mask((raw, n) for raw, n in spelled.items() if squeezed(raw) in telling)
    draft = Examples(telling, masked, [], frequency, total)
    plain = {text: " ".join(draft.resolved(text.split(" "))) for _, _, text in judged}
    shares, by_document = defaultdict(dict), defaultdict(set)
    for i, share, text in judged:
        shares[plain[text]][i] = share
        if share >= 0.5:
            by_document[i].add(plain[text])
    labels, rare = _evidence(draft, {text: list(s.values()) for text, s in shares.items()}, by_document)
    telling |= rare
    mask((word, 1) for word in rare)

    draft = Examples(telling, masked, [], {}, 1)
    votes: dict[tuple[str, tuple[str, ...]], list[int]] = defaultdict(lambda: [0, 0])
    for i, share, text in judged:
        for seen in set(_windows(draft.resolved(text.split(" ")), telling)):
            votes[seen][0] += share >= 0.5
            votes[seen][1] += 1
    windows = [(word, window, bad / n) for (word, window), (bad, n) in votes.items()]
    return Examples(telling, masked, windows, frequency, total, list(labels.items()), rare)


def _tells(bad: int, n: int, base: float) -> bool:
    """Whether a word stands in offensive documents more often than chance gives, by the log-likelihood ratio of its rate."""
    part = lambda k, p: k * math.log(k / n / p) if k else 0.0
    rate, sure = (bad + base) / (n + 1), part(bad, base) + part(n - bad, 1 - min(base, 0.99))
    return rate > 1.5 * base and (sure > 8 or (rate > 0.8 and sure > 5.5))


def calibrated(votes: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a vote into the rate of offensive verdicts, by regularised logistic regression.

    The prior, of ``PRIOR_WEIGHT`` documents, says that the vote is right; where verdicts are few it decides.
    """
    at = np.concatenate([votes, np.linspace(0, 1, 2 * PRIOR_WEIGHT)])
    is_bad = np.concatenate([shares >= 0.5, np.linspace(0, 1, 2 * PRIOR_WEIGHT) >= 0.5]).astype(float)
    x, beta = np.stack([at, np.ones_like(at)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2), x.T @ (is_bad - p) - RIDGE * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], RIDGE)), float(beta[1])


def examples_of(judged: DataFrame, distinct: DataFrame) -> Examples:
    """``judged``: (id, share of offensive verdicts, passage) of the sample; ``distinct``: all passages of the corpus."""
    spark, plain = judged.sparkSession, F.regexp_replace("raw", r"(\p{L})\1+", "$1")
    rows = [(r["id"], r["share"], r["passage"]) for r in judged.distinct().orderBy("id", "passage").collect()]  # bounded by MOST_JUDGED documents
    known = spark.createDataFrame([(t,) for t in sorted({squeezed(t) for _, _, text in rows for t in text.split(" ")} | {"a", "i"})], "term string")
    terms = distinct.select(F.explode(F.array_distinct(F.split("passage", " "))).alias("raw")).select(plain.alias("term"))
    counted = terms.join(F.broadcast(known), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    frequency, total = {r["term"]: r["n"] for r in counted.collect()}, distinct.count()
    # calibration on the half of the judged documents whose examples do not vote
    draft = learn([r for r in rows if not _held_out(r[0])], frequency, total)
    scored = spark.createDataFrame([r for r in rows if _held_out(r[0])], "id long, share double, passage string").repartition(spark.sparkContext.defaultParallelism)
    held_out = scored.mapInArrow(_score(draft, ("id", "share")), "id long, share double, passage string, score double, example string").groupBy("id").agg(F.max("share"), F.max("score")).collect()
    examples = learn(rows, frequency, total)
    seen = [(r[2], r[1]) for r in held_out if r[2] > 0]
    examples.line = calibrated(np.array([vote for vote, _ in seen], float), np.array([share for _, share in seen], float))
    return examples


def _held_out(key: int) -> bool:
    return bool(zlib.crc32(str(key).encode()) & 1)


def _score(examples: Examples, kept: tuple[str, ...] = ()):
    """The vote on each passage; ``kept`` names the columns before it that stay."""
    packed = pickle.dumps(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = pickle.loads(packed), {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(len(kept)).to_pylist():
                terms = own.resolved(text.split(" "))
                best = own.vote_of_passage(terms)
                for word, window in _windows(terms, own.telling):
                    vote = memory.get((word, window))
                    if vote is None:
                        if len(memory) > 500_000:
                            memory.clear()
                        vote = memory[word, window] = own.vote(word, window)
                    best = max(best, vote, key=lambda v: v[0])
                scores.append(best[0])
                evidence.append(best[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.string())], [*kept, "passage", "score", "example"])

    return run


# ------------------------------------------------------------------------------------------------------------- the job


def _judged_share(labels: DataFrame) -> DataFrame:
    """The share of offensive verdicts of each document, for the documents that are taken as examples."""
    verdict = F.lower(F.trim("verdict"))
    known = labels.where(verdict.isin(*OFFENSIVE, "none") & F.col("doc_id").isNotNull())
    share = known.groupBy(F.col("doc_id").cast("long").alias("judged")).agg(F.avg(verdict.isin(*OFFENSIVE).cast("double")).alias("share"))
    return share.orderBy(F.xxhash64("judged"), "judged").limit(MOST_JUDGED)


def _collect(line: tuple[float, float]):
    """Each document's highest vote as a score, with the passages that are offensive by it."""
    slope, intercept = line
    score_of = lambda vote: np.where(vote > 0, 1 / (1 + np.exp(-(slope * vote + intercept))), 0.0)

    def run(documents: pa.Table, scored: pa.Table) -> pa.Table:
        place = scored.column("place").to_numpy()
        votes = np.zeros(int(place.max()) + 1 if len(place) else 1)
        votes[place] = scored.column("score").to_numpy()
        texts = dict(zip(place.tolist(), zip(scored.column("passage").to_pylist(), scored.column("example").to_pylist(), strict=True), strict=True))
        best, n_bad, passage, example = [], [], [], []
        for places in documents.column("places").to_pylist():
            own = np.array([p for p in places if p < len(votes)], np.int64)
            top = int(own[np.argmax(votes[own])]) if own.size else -1
            value = float(votes[top]) if own.size else 0.0
            best.append(float(score_of(value)))
            n_bad.append(int((score_of(votes[own]) >= DECISION).sum()) if own.size else 0)
            shown = texts.get(top, (None, None)) if value > 0 else (None, None)
            passage.append(shown[0])
            example.append(shown[1])
        return pa.table({"id": documents.column("id"), "source": documents.column("source"), "score": pa.array(best, pa.float64()), "n_passages": pa.array(n_bad, pa.int32()), "passage": pa.array(passage, pa.string()), "example": pa.array(example, pa.string())})

    return run


def score_documents(documents: DataFrame, labels: DataFrame, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, source, score, n_passages, passage, example)``: the score, the worst passage and its nearest example."""
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    blocks = materialise(spread(source).mapInArrow(_blocks(block_chars), _BLOCKS), "offence-blocks")
    listed = blocks.where("texts is not null").select(F.col("block").alias("owner"), F.posexplode("texts").alias("place", "passage"))
    distinct = materialise(listed.select("passage").distinct(), "offence-passages")

    # bounded by MOST_JUDGED documents
    judged = blocks.where("texts is null").join(F.broadcast(_judged_share(labels)), F.col("id") == F.col("judged")).select("block", "id", "share", F.explode("places").alias("at"))
    said = judged.join(listed, (F.col("owner") == F.col("block")) & (F.col("at") == F.col("place"))).select("id", "share", "passage")
    examples = examples_of(materialise(said, "offence-judged"), distinct)

    scored = distinct.mapInArrow(_score(examples), "passage string, score double, example string").where("score > 0")
    back = listed.join(scored, "passage").select("owner", "place", "passage", "score", "example")
    kept = blocks.where("texts is null").select("block", "id", "source", "places")
    done = kept.groupBy("block").cogroup(back.groupBy("owner")).applyInArrow(_collect(examples.line), "id long, source string, score double, n_passages int, passage string, example string")
    return done.withColumnRenamed("id", "doc_id")


def offensive_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents with at least one passage that the vote finds offensive."""
    return score_documents(documents, labels).where(F.col("score") >= DECISION).select("doc_id")


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents, offensive documents and their rate by source, whatever a source's spelling."""
    name = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[\s_-]+", "_"), F.lit("unknown"))
    bad = F.sum((F.col("score") >= DECISION).cast("long"))
    return scored.groupBy(name.alias("source")).agg(F.count("*").alias("n_documents"), bad.alias("n_offensive")).withColumn("rate", F.round(F.col("n_offensive") / F.col("n_documents"), 6))
