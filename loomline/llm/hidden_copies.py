"""Records that differ only in formatting, collapsed with a count of their copies.

A record's canonical bytes are its session, its timestamp as a number, and its speaker and text without letter case,
white space and punctuation (Unicode P). The job has four steps:

1. each partition merges its own equal records in a trie, so a group that a third of all rows belong to becomes one
   entry per partition before anything is shuffled;
2. entries are partitioned by the first bytes of their key; a bucket with more than ``BUCKET_KEYS`` entries is split by
   further bytes, again and again, until each fits or the key ends: then its entries are one key and are summed at once;
3. buckets are counted in tries whose terminal nodes hold the number of copies and the smallest id; small buckets share one;
4. for pairs, groups of more than one are joined back to the records by key; adaptive execution splits a hot key there.

Defined results: a record with a null in session, speaker, text or timestamp, a timestamp that is no number (NaN), and a
payload that is no JSON object are in no group; a field that a payload lacks is null; empty texts are equal to each
other; repeated rows with one id count as copies but give one pair at most; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import gc
import json
import math
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import materialise, spread

#: Entries that a task holds in one trie.
BUCKET_KEYS = 50_000
#: Bytes of the first split, and of each next one as a multiple of the one before.
FIRST_BYTES, WIDER = 1, 2
#: Bytes on the first edge of a trie; what follows is one edge, since below it chains without a branch are the rule.
EDGE = 36

_PUNCTUATION = {i: None for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "P"}
_ASCII = {i: None for i in range(128) if i in _PUNCTUATION or chr(i).isspace()}
_SPACE = re.compile(r"\s+")


def canonical(text: str) -> str:
    """Without letter case, white space and punctuation."""
    if text.isascii():
        return text.lower().translate(_ASCII)
    return _SPACE.sub("", text.casefold().translate(_PUNCTUATION))


#: Speakers are few.
_canonical_speaker = lru_cache(maxsize=10_000)(canonical)


def _number(value: object) -> float | None:
    if value is None or isinstance(value, bool):
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(number) else number + 0.0


def _refused(name: str) -> float:
    raise ValueError(name)


def parsed(payload: str | None) -> tuple[object, object, object]:
    """Speaker, text and timestamp of a payload; nulls if it is no JSON object."""
    try:
        found = json.loads(payload or "", parse_constant=_refused)
    except (ValueError, RecursionError):
        return None, None, None
    return (found.get("speaker"), found.get("text"), found.get("timestamp")) if isinstance(found, dict) else (None, None, None)


def key(session: str | None, speaker: object, text: object, timestamp: object) -> bytes | None:
    """The canonical bytes, or None for a record that is in no group."""
    number = _number(timestamp)
    if session is None or not isinstance(speaker, str) or not isinstance(text, str) or number is None:
        return None
    # the number's bits, so that equal numbers have equal bytes
    return b"\0".join([session.encode(), struct.pack(">d", number).hex().encode(), _canonical_speaker(speaker).encode("utf-8", "surrogatepass"), canonical(text).encode("utf-8", "surrogatepass")])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for i, session, speaker, text, timestamp, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if payload is not None:
                speaker, text, timestamp = parsed(payload)
            own = key(session, speaker, text, timestamp)
            if own is not None:
                ids.append(i)
                keys.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])


class Trie:
    """Keys on two edges; terminal nodes hold the smallest id and the number of copies."""

    def __init__(self) -> None:
        self.root, self.size = {}, 0

    def add(self, own: bytes, smallest: int | None, copies: int) -> None:
        head = own[:EDGE]
        node = self.root.get(head)
        if node is None:
            node = self.root[head] = {}
        held = node.get(own[EDGE:])
        if held is None:
            node[own[EDGE:]] = [smallest, copies]
            self.size += 1
        else:
            held[0] = smallest if held[0] is None else held[0] if smallest is None else min(held[0], smallest)
            held[1] += copies

    def columns(self) -> tuple[list, list, list]:
        """Keys, smallest ids and numbers of copies of all terminal nodes."""
        keys = [head + tail for head, node in self.root.items() for tail in node]
        held = [own for node in self.root.values() for own in node.values()]
        return keys, [own[0] for own in held], [own[1] for own in held]


@contextmanager
def _uncollected() -> Iterator[None]:
    """Tries hold no cycles: looking for some after every few hundred new nodes would take most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _entries(trie: Trie) -> pa.RecordBatch:
    keys, ids, counts = trie.columns()
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["key", "keep_id", "copies"])


def _merge_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        with _uncollected():
            for own, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie.add(own, i, 1)
        if trie.size >= 2 * BUCKET_KEYS:
            yield _entries(trie)
            trie = Trie()
    yield _entries(trie)


def _count_bucket(bucket: pa.Table) -> pa.Table:
    trie = Trie()
    with _uncollected():
        for own, i, copies in zip(*(bucket.column(c).to_pylist() for c in ("key", "keep_id", "copies")), strict=True):
            trie.add(own, i, copies)
        return pa.Table.from_batches([_entries(trie)])


def _bucketed(entries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Add ``bucket``: as many first bytes of the key as it takes for at most ``limit`` entries.

    What no further byte can split are entries of one and the same key; such keys are returned beside it as ``(full)``.
    """
    longest = entries.agg(F.max(F.length("key"))).first()[0] or 0
    prefix = lambda n: F.expr(f"substring(key, 1, {n})")
    depth, inside, levels, same = FIRST_BYTES, entries.select("key"), [], None
    while longest:
        sizes = inside.groupBy(prefix(depth).alias("full")).count()
        over = materialise(sizes.where(F.col("count") > limit).select("full"), "radix")
        n_over = over.count()
        if not n_over:
            break
        over = F.broadcast(over) if n_over <= 10_000 else over
        if depth >= longest:
            same = over
            break
        levels.append((depth, over))
        # what lies in an oversized bucket lies in oversized ones at all lesser depths: one join finds it
        inside = entries.select("key").join(over, prefix(depth) == F.col("full"), "left_semi")
        depth *= WIDER
    held = entries.withColumn("depth", F.lit(FIRST_BYTES))
    for depth, over in levels:
        hit = held.join(over, (F.col("depth") == depth) & (prefix(depth) == F.col("full")), "left")
        held = hit.withColumn("depth", F.when(F.col("full").isNotNull(), F.lit(depth * WIDER)).otherwise(F.col("depth"))).drop("full")
    return held.withColumn("bucket", F.expr("substring(key, 1, depth)")).drop("depth"), same


def keyed_records(segments: DataFrame, raw: DataFrame) -> DataFrame:
    """``(id, key)`` of the parsed and the raw records that can be in a group."""
    none = F.lit(None).cast("string")
    given = segments.select(F.col("segment_id").cast("long"), "session_id", "speaker", "text", F.col("timestamp").cast("double"), none.alias("payload"))
    bare = raw.select(F.col("segment_id").cast("long"), "session_id", none, none, F.lit(None).cast("double"), F.coalesce("payload", F.lit("")))
    return spread(given.unionAll(bare)).mapInArrow(_keys, "id long, key binary")


def count_copies(keyed: DataFrame, limit: int = BUCKET_KEYS) -> DataFrame:
    """``(key, keep_id, copies)``: each distinct key with its smallest id and the number of records."""
    entries = materialise(keyed.select("key", "id").mapInArrow(_merge_local, "key binary, keep_id long, copies long"), "local-tries")
    split, same = _bucketed(entries, limit)
    # many small buckets share a task's trie: hashed into bins of half the limit on average
    bins = 2 * entries.count() // limit + 1
    split = split.withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(bins)))
    if same is None:
        return split.groupBy("bin").applyInArrow(_count_bucket, "key binary, keep_id long, copies long")
    # a key that fills buckets by itself needs no trie: its entries are summed, partly before they are shuffled
    hot = entries.join(same, F.col("key") == F.col("full"), "left_semi").groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    rest = split.join(same, F.col("key") == F.col("full"), "left_anti")
    return rest.groupBy("bin").applyInArrow(_count_bucket, "key binary, keep_id long, copies long").unionByName(hot)


def collapse(segments: DataFrame, raw: DataFrame, limit: int = BUCKET_KEYS) -> DataFrame:
    """``(keep_id, copies)``: one row for each distinct record that can be in a group."""
    return count_copies(keyed_records(segments, raw), limit).select("keep_id", "copies")


def copy_pairs(segments: DataFrame, raw: DataFrame, limit: int = BUCKET_KEYS) -> DataFrame:
    """``(keep_id, copy_id)``: each record of a group but the one with the smallest id."""
    keyed = materialise(keyed_records(segments, raw), "keyed")
    groups = count_copies(keyed, limit).where("copies > 1").select("key", "keep_id")
    return keyed.join(groups, "key").where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id")).distinct()
