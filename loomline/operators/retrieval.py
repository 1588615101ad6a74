"""Exact nearest neighbours by cosine, reranking by age, and contexts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.rules import final_score
from loomline.functions.vectors import dot
from loomline.session import materialise

#: Values of queries that are sent to every task; more meet the rows in blocks.
MOST_BROADCAST_VALUES = 4_000_000
#: Queries and rows that meet in one group where queries are not broadcast.
GROUP_QUERIES, GROUP_ROWS = 4_096, 50_000
#: Queries and rows whose scores are held at once.
TILE_QUERIES, TILE_ROWS = 512, 2_048
ASKED_EVERY = 50

_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_SHAPE = "query_id long, vec_id long, score double"


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of unit length; 0 where a norm is 0 or no finite number."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
        vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=(size > 0) & np.isfinite(size)) + 0.0  # no -0.0


def _some_of_equal(ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the same vector those with the ``k`` smallest ids: the others are behind them for any query."""
    _, same = np.unique(own.view(f"V{own.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    place = np.arange(len(ids)) - np.searchsorted(same[order], same[order], "left")
    kept = order[place < k]
    return ids[kept], own[kept]


class _Best:
    """The best ``k`` rows so far of each query; ties by the smaller id.

    Queries and rows meet in tiles of a fixed size. A tile is scored in single precision first; only rows that are within
    that precision's error of a query's best ``k``, so that they may be among them, are scored again in double.
    """

    def __init__(self, query_ids: np.ndarray, asked: np.ndarray, k: int) -> None:
        _, first, self.same = np.unique(asked.view(f"V{asked.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.query_ids, self.asked, self.k = query_ids, asked[first], k
        self.rough = self.asked.astype(np.float32)
        self.error = 2 * (asked.shape[1] + 4) * float(np.finfo(np.float32).eps)
        self.ids = np.full((len(first), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(first), k), -np.inf)
        self.least = np.full(len(first), -np.inf, np.float32)

    def add(self, ids: np.ndarray, own: np.ndarray) -> None:
        ids, own = _some_of_equal(ids, own, self.k)
        rough = own.astype(np.float32)
        for q in range(0, len(self.asked), TILE_QUERIES):
            for r in range(0, len(ids), TILE_ROWS):
                self._meet(q, ids[r : r + TILE_ROWS], own[r : r + TILE_ROWS], rough[r : r + TILE_ROWS])

    def _meet(self, start: int, ids: np.ndarray, own: np.ndarray, rough: np.ndarray) -> None:
        scores, least = self.rough[start : start + TILE_QUERIES] @ rough.T, self.least[start : start + TILE_QUERIES]
        hit = np.flatnonzero(scores.max(1) >= least)
        if not hit.size:
            return
        scores, least = scores[hit], least[hit]
        if len(ids) > self.k:
            new = np.flatnonzero(np.isneginf(least))
            at = len(ids) - self.k
            least[new] = np.partition(scores[new], at, axis=1)[:, at] - np.float32(self.error)
        q, r = np.nonzero(scores >= least[:, None])
        hit += start
        exact = np.einsum("ij,ij->i", self.asked[hit[q]], own[r])
        q = np.concatenate([np.repeat(np.arange(len(hit)), self.k), q])
        found, exact = np.concatenate([self.ids[hit].ravel(), ids[r]]), np.concatenate([self.scores[hit].ravel(), exact])
        near = np.round(exact, 9)
        order = np.lexsort((found, -near, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order], "left") < self.k].reshape(-1, self.k)
        self.ids[hit], self.scores[hit], self.least[hit] = found[order], exact[order], near[order[:, -1]] - self.error

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.same), 10_000):
            same = self.same[at : at + 10_000]
            q, place = np.nonzero(np.isfinite(self.scores[same]))
            yield pa.RecordBatch.from_arrays([pa.array(self.query_ids[at + q]), pa.array(self.ids[same[q], place]), pa.array(self.scores[same[q], place])], schema=_NEAR)


def _to_all(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Queries of a checked size, sent to every task; each task sends on only its best ``k`` for each."""
    held = asked.select("query_id", "query").toArrow()
    packed = pickle.dumps((held.column(0).to_numpy(), _unit(held.column(1)))) if held.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if packed is None:
            return
        best = _Best(*pickle.loads(packed), k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(), _unit(batch.column(1)))
        yield from best.batches()

    return rows.select("vec_id", "embedding").mapInArrow(run, _SHAPE)


def _in_blocks(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Queries meet the rows with their key, and no others. A large key is cut into blocks of queries and parts of rows; small keys share a group."""
    sizes = asked.groupBy("key").agg(F.count("*").alias("nq")).join(rows.groupBy("key").agg(F.count("*").alias("nr")), "key")
    cut = sizes.select("key", F.ceil(F.col("nq") / GROUP_QUERIES).cast("int").alias("blocks"), F.ceil(F.col("nr") / GROUP_ROWS).cast("int").alias("parts"), "nr")
    cut = materialise(cut.withColumn("small", (F.col("blocks") == 1) & (F.col("parts") == 1)), "keys")
    together = int(cut.where("small").agg(F.coalesce(F.sum("nr"), F.lit(0))).first()[0]) // GROUP_ROWS + rows.sparkSession.sparkContext.defaultParallelism
    cell = F.when(F.col("small"), F.concat(F.lit("s"), F.pmod(F.xxhash64("key"), F.lit(together)).cast("string"))).otherwise(F.concat(F.lit("k"), "key"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    # large keys are few, so they are sent to the rows: no task gathers all vectors of one
    large, zero = F.broadcast(cut.where("not small")), F.lit(0)
    few = rows.join(F.broadcast(cut.where("not small").select("key")), "key", "left_anti").join(cut.where("small"), "key").withColumn("part", zero).withColumn("block", zero)
    many = rows.join(large, "key").withColumn("part", own("vec_id", "parts")).withColumn("block", upto("blocks"))
    left = few.unionByName(many).select(cell.alias("cell"), "block", "part", "key", "vec_id", "embedding")
    right = asked.join(cut, "key").withColumn("block", own("query_id", "blocks")).withColumn("part", upto("parts")).select(cell.alias("cell"), "block", "part", "key", "query_id", "query")

    def meet(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        if not rows_.num_rows or not asked_.num_rows:
            return pa.Table.from_batches([], schema=_NEAR)
        rows_, asked_ = rows_.sort_by("key"), asked_.sort_by("key")
        keys, names = rows_.column("key").to_numpy(), asked_.column("key").to_numpy()
        ids, query_ids, matrix, queries = rows_.column("vec_id").to_numpy(), asked_.column("query_id").to_numpy(), _unit(rows_.column("embedding")), _unit(asked_.column("query"))
        found = []
        for name in dict.fromkeys(names.tolist()):
            r = slice(*np.searchsorted(keys, name, "left").reshape(1), *np.searchsorted(keys, name, "right").reshape(1))
            q = slice(*np.searchsorted(names, name, "left").reshape(1), *np.searchsorted(names, name, "right").reshape(1))
            if r.stop > r.start:
                best = _Best(query_ids[q], queries[q], k)
                best.add(ids[r], matrix[r])
                found.extend(best.batches())
        return pa.Table.from_batches(found, schema=_NEAR)

    by = ("cell", "block", "part")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, _SHAPE)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 4, *, within: str | None = None) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` nearest rows of each query, among those with its ``within`` if given.

    Null vectors and null keys match nothing. Every group sends on only its best ``k`` for each query.
    """
    key = F.col(within).cast("string") if within else F.lit("")
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("query"), key.alias("key"))
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding", key.alias("key"))
    size = 0 if within else asked.agg(F.coalesce(F.sum(F.size("query")), F.lit(0))).first()[0]
    found = _in_blocks(rows, asked, k) if within or size > MOST_BROADCAST_VALUES else _to_all(rows, asked, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def asked_of(vectors: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by ``ASKED_EVERY``."""
    return vectors.where(F.col("vec_id") % ASKED_EVERY == 0)


def scores_against_first(vectors: DataFrame) -> DataFrame:
    """A hundred times the inner product of the first vector by id with each other one: ``(vec_id, score)``."""
    first = vectors.where("embedding is not null").orderBy("vec_id").limit(1).select(F.col("vec_id").alias("first_id"), F.col("embedding").alias("first"))
    rows = vectors.join(F.broadcast(first), F.col("vec_id") > F.col("first_id"))
    return rows.select("vec_id", (dot(F.col("first"), F.col("embedding")) * 100).alias("score"))


def reranked(found: DataFrame, ages: DataFrame, kept: int = 3) -> DataFrame:
    """The ``kept`` best of what was found, by similarity and age together; among equals the order of similarity."""
    scored = found.join(ages, "vec_id", "left").withColumn("final", final_score(F.col("score"), F.col("age_hours")))
    order = Window.partitionBy("query_id").orderBy(F.round("final", 9).desc(), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= kept).select("query_id", "vec_id", "rank", "final_rank", F.round("score", 6).alias("score"), F.round("final", 6).alias("final"))


def contexts(sections: list[tuple[str, str, DataFrame]], key: str) -> DataFrame:
    """One text for each key: of each ``(title, mark, rows(key, place, line))`` that has rows, the title and its lines in order."""
    parts = []
    for i, (title, mark, rows) in enumerate(sections):
        parts.append(rows.select(key, F.lit(i).alias("section"), F.col("place").cast("long"), F.concat(F.lit(f"  {mark}"), "line").alias("line")))
        parts.append(rows.select(key).distinct().select(key, F.lit(i).alias("section"), F.lit(-1).cast("long").alias("place"), F.lit(f"--- {title} ---").alias("line")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    lines = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return union.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"), F.sum((F.col("place") >= 0).cast("long")).alias("n_lines"))
