"""Filling containers of fixed capacity by minimum bin slack.

Only the sizes matter for filling, so the search runs on the histogram of sizes, which has at most ``capacity`` rows
whatever the corpus: the largest size left opens a container, a bitset subset-sum over the sizes left finds the multiset
that comes closest to the rest of the capacity, and going back through the stored bitsets gives how many of each size it
takes. The same filling is repeated as long as the counts allow, so each filling uses up at least one size. Items get
their containers by rank within their size; ranks are counted in salted groups, so a size that a third of all items
share is spread over many tasks.

Defined results: an item larger than the capacity is cut into full containers and a rest; an item of size zero (null and
empty texts) goes to some existing container, or to container 0 if there is none; repeated rows are items of their own;
a null size counts as zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.corpus_tokens import TOKENIZERS, VOCABULARY, count_tokens
from loomline.session import materialise

CAPACITY = 2048
#: Items that one task ranks at a time.
GROUP_ITEMS = 250_000


def _closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes with the largest sum up to ``room``, larger sizes first among equals."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for size in sorted((s for s, n in counts.items() if n and s <= room), reverse=True):
        left, part = min(counts[size], room // size), 1
        while left:
            take = min(part, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & full
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] += take
            at -= size * take
    return used


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of sizes and how many containers are filled by each, until no item is left."""
    left, done = {s: n for s, n in counts.items() if s > 0 and n > 0}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        used = _closest(left, capacity - largest)
        left[largest] += 1
        used[largest] += 1
        times = min(left[s] // n for s, n in used.items())
        done.append((dict(used), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return done


def fill_containers(items: DataFrame, id_column: str, size_column: str, capacity: int = CAPACITY) -> DataFrame:
    """``(id_column, piece, first_token, n_tokens, container_id)``: one row for each piece of each item."""
    size = F.coalesce(F.col(size_column).cast("long"), F.lit(0))
    pieces = (
        items.select(F.col(id_column).alias("id"), size.alias("total"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (total - 1) div {capacity}))")))
        .withColumn("n", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity))
    )
    held = materialise(pieces, "items")
    counts = {r["n"]: r["count"] for r in held.groupBy("n").count().collect()}  # at most capacity + 1 rows
    plan, spans, base = fillings(counts, capacity), defaultdict(list), 0
    start: dict[int, int] = defaultdict(int)
    for used, times in plan:
        for s, n in used.items():
            spans[s].append((start[s], base, n))
            start[s] += n * times
        base += times
    table = {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in spans.items()}
    containers = max(base, 1)

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        sizes, ranks, out = n.to_numpy(), rank.to_numpy(), np.zeros(len(n), np.int64)
        for s in np.unique(sizes):
            own = sizes == s
            if s == 0:
                out[own] = ranks[own] % containers
                continue
            begins, bases, uses = table[int(s)]
            at = np.searchsorted(begins, ranks[own], "right") - 1
            out[own] = bases[at] + (ranks[own] - begins[at]) // uses[at]
        return pd.Series(out)

    salts = int(max(8, sum(counts.values()) // GROUP_ITEMS))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    by_size = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("n", "salt").count().select("n", "salt", F.coalesce(F.sum("count").over(by_size), F.lit(0)).alias("before"))
    in_group = Window.partitionBy("n", "salt").orderBy("id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(in_group) - 1).join(before, ["n", "salt"])
    return ranked.select(
        F.col("id").alias(id_column),
        "piece",
        (F.col("piece") * capacity).alias("first_token"),
        F.col("n").alias("n_tokens"),
        container("n", F.col("rank") + F.col("before")).alias("container_id"),
    )


def pack_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, *, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """Documents sized in tokens of a public tokenizer, in containers of ``capacity`` tokens."""
    return fill_containers(count_tokens(documents, id_column, text_column, name=name, folder=folder), id_column, "n_tokens", capacity)
