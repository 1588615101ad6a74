"""Steps whose state runs on from row to row, over keys of any size.

A key of at most ``SLICE_ROWS`` rows streams through one task. A larger one is cut into slices of its order that run side
by side, each from a guessed state. What a slice ends with seldom depends on what it began with, so one row per slice
tells what each slice should have begun with; slices run again until every one began as the one before it ended, and then
write their rows. Rows are the same as those of one pass. A key whose slices do not settle in ``ROUNDS`` streams through one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import materialise

SLICE_ROWS, ROUNDS = 500_000, 4


@dataclass(frozen=True)
class Fold:
    """``walk`` reads rows in order from a state (plain JSON values) and gives output rows and the state after them.

    ``core`` is the part of a state that decides about later rows. ``carried`` takes over what is only counted: the end of a
    slice that was run from a guess (arguments: true begin, guessed begin, end of the run from there).
    """

    schema: str
    fresh: Callable[[], Any]
    walk: Callable[[Any, Iterator[tuple]], tuple[list[tuple], Any]]
    guess: Callable[[], Any] | None = None
    core: Callable[[Any], Any] = lambda state: state
    carried: Callable[[Any, Any, Any], Any] = lambda begin, guessed, end: end
    finish: Callable[[Any], list[tuple]] = lambda state: []

    @property
    def names(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]


def _same(fold: Fold, a: Any, b: Any) -> bool:
    return json.dumps(fold.core(a)) == json.dumps(fold.core(b))


def _streamed(rows: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        none = object()
        held, state = none, None
        for batch in batches:
            out = []
            for own, part in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), itemgetter(0)):
                if own != held:
                    out += [(held, *one) for one in fold.finish(state)] if held is not none else []
                    held, state = own, fold.fresh()
                made, state = fold.walk(state, (row[1:] for row in part))
                out += [(own, *one) for one in made]
            yield from _batch(out)
        if held is not none:
            yield from _batch([(held, *one) for one in fold.finish(state)])

    def _batch(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types, strict=True)], names=fold.names)

    types = _arrow_types(rows, fold)
    ordered = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)
    return ordered.mapInArrow(run, fold.schema)


def _arrow_types(rows: DataFrame, fold: Fold) -> list[pa.DataType]:
    return list(rows.sparkSession.createDataFrame([], fold.schema).toArrow().schema.types)


def _run(placed: DataFrame, begins: DataFrame, key: str, columns: list[str], fold: Fold, *, write: bool) -> DataFrame:
    """Each slice from its begin: its rows, or with ``write`` off the state that it ends with."""

    def run(own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        begin, last = json.loads(side["begin"].iloc[0]), bool(side["last"].iloc[0])
        own = own.sort_values("_n", kind="stable")
        made, end = fold.walk(begin, zip(*(own[c].tolist() for c in columns), strict=True))
        name = side[key].iloc[0]
        if not write:
            return pd.DataFrame([(name, side["_part"].iloc[0], side["begin"].iloc[0], json.dumps(end))], columns=[key, "_part", "begin", "end"])
        return pd.DataFrame([(name, *one) for one in [*made, *(fold.finish(end) if last else [])]], columns=fold.names)

    kind = dict(placed.dtypes)[key]
    schema = fold.schema if write else f"{key} {kind}, _part int, begin string, end string"
    return placed.groupBy(key, "_part").cogroup(begins.groupBy(key, "_part")).applyInPandas(run, schema)


def _linked(ends: DataFrame, key: str, fold: Fold) -> DataFrame:
    """What each slice should begin with, and whether all of its key began with the right core. One row per slice is read."""

    def link(side: pd.DataFrame) -> pd.DataFrame:
        out, begin, settled = [], fold.fresh(), True
        for part, ran, end in side.sort_values("_part")[["_part", "begin", "end"]].itertuples(index=False):
            ran = json.loads(ran)
            settled &= _same(fold, begin, ran)
            out.append((side[key].iloc[0], part, json.dumps(begin)))
            begin = fold.carried(begin, ran, json.loads(end))
        made = pd.DataFrame(out, columns=[key, "_part", "begin"])
        return made.assign(last=made["_part"] == made["_part"].max(), settled=settled)

    return ends.groupBy(key).applyInPandas(link, f"{key} {dict(ends.dtypes)[key]}, _part int, begin string, last boolean, settled boolean")


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], fold: Fold, slice_rows: int | None = None, rounds: int | None = None) -> DataFrame:
    """``fold`` over the rows of each ``key`` by ``order``; its first output column is the key. Rows with a null key are one key."""
    slice_rows, rounds = slice_rows or SLICE_ROWS, ROUNDS if rounds is None else rounds
    # one row for each key that is larger than a slice
    large = rows.groupBy(key).count().where((F.col("count") > slice_rows) & F.col(key).isNotNull())
    total = large.agg(F.sum("count")).first()[0]
    if not total:
        return _streamed(rows, key, order, columns, fold)
    large = materialise(large.select(key), "large")
    narrow = rows.select(*dict.fromkeys([key, *order, *columns]))
    part = narrow.join(large, key, "left_semi").repartitionByRange(ceil(total / slice_rows) + 1, key, *order).withColumn("_part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    placed = materialise(part.withColumn("_n", number).select(key, "_part", "_n", *[c for c in columns if c != key]), "slices")
    first = F.col("_part") == F.min("_part").over(Window.partitionBy(key))
    guess = json.dumps((fold.guess or fold.fresh)())
    begins = placed.select(key, "_part").distinct().select(key, "_part", F.when(first, json.dumps(fold.fresh())).otherwise(guess).alias("begin"), F.lit(False).alias("last"))
    settled = large.limit(0)
    for _ in range(rounds):
        begins = materialise(_linked(_run(placed, begins, key, columns, fold, write=False), key, fold), "begins")
        settled = begins.where("settled").select(key).distinct()
        if begins.where("not settled").isEmpty():
            break
    one_task = _streamed(rows.join(settled, key, "left_anti"), key, order, columns, fold)
    if rounds == 0:
        return one_task
    right = begins.where("settled")
    return one_task.unionByName(_run(placed.join(right.select(key).distinct(), key, "left_semi"), right, key, columns, fold, write=True))
