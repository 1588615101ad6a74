"""Whole conversations from message rows.

Every row and every session is a node, and the conversations of all rows are connected components, found by alternating
large-star and small-star joins. Links are:

* own: a row and its session;
* quote: a row without session and any row with the same words, side and time (the same words stored again);
* reply: a row without session and the session heard around it, if no other session is heard within ``REPLY_SECONDS`` (in
  steps of ``STEP_SECONDS``); where none is heard, the row without session before it, if that is the other side's, not
  older than ``REPLY_SECONDS``, and all such rows about it take turns. Where calls overlap, none of this holds, and a row
  stays alone rather than going to a call at random.

A component that reaches a session is that session's (the smallest, if quotes tie several); another is a conversation of
its own. Conversations are then ordered and validated.

A conversation is broken if it has no usable turn, a usable turn whose speaker names neither side or that has no
``spoken_at`` (null or NaN), only one side among its usable turns, or the customer's turn last. A usable turn is final
and its text is not null or only white space. The last turn is that with the latest time; among equals, the largest id.

Defined results: rows stored twice (same conversation, side, text and time) give one turn, with the smallest id; a
session is judged by the rows stored under it only; rows with one id are one node, and tie their sessions; empty tables give no rows; a null
``is_final`` is not final; other columns are ignored. Components that are not found after ``MOST_ROUNDS`` rounds are an
error, never a partial result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.sides import side
from loomline.operators.ordering import number_within
from loomline.operators.timeline import islands, with_previous
from loomline.session import materialise

REPLY_SECONDS, STEP_SECONDS = 30.0, 10.0
#: Sessions are nodes below all rows, so that they become roots; row ids lie between minus and plus half of this.
SESSIONS_BELOW = 1 << 62
#: Rounds grow with the logarithm of the longest chain, so more than these tell of a fault.
MOST_ROUNDS = 60


@F.pandas_udf(T.StringType())
def _side(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: side(x if isinstance(x, str) else None))


def _has_text(column: str) -> F.Column:
    return F.col(column).isNotNull() & F.col(column).rlike(r"[^\s\p{Z}\x1c-\x1f\x85]")


def prepared(turns: DataFrame) -> DataFrame:
    """Rows with their side and whether they are usable."""
    at = F.col("spoken_at").cast("double")
    return turns.select(
        F.col("id").cast("long"),
        F.col("session_id").cast("string"),
        _side("speaker").alias("side"),
        F.col("text").cast("string"),
        F.when(F.isnan(at), None).otherwise(at).alias("spoken_at"),
        (F.coalesce(F.col("is_final"), F.lit(False)) & _has_text("text")).alias("usable"),
    )


def _print_of(edges: DataFrame) -> tuple:
    """Tells whether a round has changed the links."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node it is connected with.

    Large-star links the larger neighbours of a node to its smallest neighbour, small-star the smaller ones; both keep
    the number of links and shorten paths until every node is linked to its root. Minima are aggregated before the
    shuffle and joined back, so no task holds the neighbours of a node.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links")
    seen = _print_of(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lowest, "high").select("m", F.explode(F.array("low", "high")).alias("v")).where("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        edges = materialise(small, "stars")
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    roots = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
    return roots.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _quotes(rows: DataFrame, bare: DataFrame) -> DataFrame:
    said = ["text", "side", "spoken_at"]
    # the smallest node with the same words stands for all of them
    asked = bare.select(*said).where("text is not null and spoken_at is not null").distinct()
    same = rows.join(asked, said, "left_semi").groupBy(*said).agg(F.min(F.coalesce("session_node", "id")).alias("b"))
    return bare.join(same, said).select(F.col("id").alias("a"), "b")


def _replies(rows: DataFrame, bare: DataFrame) -> DataFrame:
    step, reach = F.floor(F.col("spoken_at") / STEP_SECONDS), round(REPLY_SECONDS / STEP_SECONDS)
    timed = bare.where("usable and spoken_at is not null")
    # one row for each step of time, however many calls there are in it
    heard = rows.where("usable and spoken_at is not null and session_id is not null").groupBy(step.alias("step")).agg(F.min("session_node").alias("first"), F.max("session_node").alias("last"))
    around = timed.select("id", F.explode(F.sequence(step - reach, step + reach)).alias("step")).join(heard, "step")
    near = materialise(around.groupBy("id").agg(F.min("first").alias("first"), F.max("last").alias("last")), "near")
    # where no session is heard, rows without session that take turns
    alone = timed.where("side is not null").join(near, "id", "left_anti").select("id", "side", "spoken_at").dropDuplicates(["id"])
    runs = islands(alone, [], "spoken_at", "id", lambda p: F.col("spoken_at") - p["spoken_at"] > REPLY_SECONDS)
    before = materialise(with_previous(runs, [], "spoken_at", "id", ["id", "side", "island"]), "runs").where("prev.island = island")
    mixed = before.where("prev.side = side").select("island").distinct()
    turns = before.join(mixed, "island", "left_anti").select(F.col("id").alias("a"), F.col("prev.id").alias("b"))
    return near.where("first = last").select(F.col("id").alias("a"), F.col("first").alias("b")).union(turns)


def grouped(turns: DataFrame) -> DataFrame:
    """Prepared rows with ``conversation_id``, whether its component reaches a session, and whether the row had its session from the start (``own``)."""
    given = prepared(turns)
    # numbers are joined faster than names: a session's node is its smallest row id, moved below all row ids
    names = materialise(given.where("session_id is not null").groupBy("session_id").agg((F.coalesce(F.min("id"), F.lit(0)) - SESSIONS_BELOW).alias("session_node")), "sessions")
    rows = materialise(given.join(names, "session_id", "left").select(*given.columns, "session_node"), "turns")
    bare = rows.where("session_id is null")
    own = rows.where("session_id is not null").select(F.col("id").alias("a"), F.col("session_node").alias("b"))
    roots = connected_components(own.union(_quotes(rows, bare)).union(_replies(rows, bare)))
    found = rows.join(roots, F.coalesce("id", "session_node") == F.col("node"), "left").withColumn("root", F.coalesce("root", "session_node", "id"))
    named = names.groupBy(F.col("session_node").alias("root")).agg(F.min("session_id").alias("name"))
    name = F.coalesce("name", F.concat(F.lit("row:"), F.col("root").cast("string")), F.lit("row:"))
    return found.join(named, "root", "left").select(*given.columns, name.alias("conversation_id"), F.col("name").isNotNull().alias("reaches"), F.col("session_id").isNotNull().alias("own"))


def _judged(rows: DataFrame, key: str) -> DataFrame:
    """``(key, broken)``. Aggregates only, so a conversation of any size is judged."""
    use = F.col("usable")
    judged = rows.groupBy(key).agg(
        F.sum(use.cast("long")).alias("n"),
        F.sum((use & (F.col("side").isNull() | F.col("spoken_at").isNull())).cast("long")).alias("n_bad"),
        F.sum((use & (F.col("side") == "agent")).cast("long")).alias("n_agent"),
        F.sum((use & (F.col("side") == "customer")).cast("long")).alias("n_customer"),
        F.max(F.when(use & F.col("spoken_at").isNotNull(), F.struct("spoken_at", "id", "side"))).alias("last"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    broken = none("n") | ~none("n_bad") | none("n_agent") | none("n_customer") | (F.col("last.side") == "customer")
    return judged.select(key, F.coalesce(broken, F.lit(True)).alias("broken"))


def broken_sessions(turns: DataFrame) -> DataFrame:
    """``(session_id)`` of the sessions to drop, each judged by the rows of its conversation that are stored under it."""
    return _judged(grouped(turns).where("own and reaches"), "session_id").where("broken").select("session_id")


def whole_conversations(rows: DataFrame) -> DataFrame:
    """Those of sessions that are not broken, and those without session that are not."""
    sessions = rows.where("own").groupBy("conversation_id").agg(F.lit(True).alias("has_session"))
    broken = _judged(rows.where("own"), "session_id").where("broken").select(F.col("session_id").alias("conversation_id"))
    free = _judged(rows.join(sessions, "conversation_id", "left_anti"), "conversation_id").where("not broken").select("conversation_id")
    return sessions.select("conversation_id").join(broken, "conversation_id", "left_anti").unionByName(free)


def rebuild(turns: DataFrame) -> DataFrame:
    """``(conversation_id, turn_no, id, role, text, spoken_at)``: the turns of whole conversations in spoken order."""
    rows = materialise(grouped(turns), "grouped")
    usable = rows.where("usable and side is not null and spoken_at is not null").join(whole_conversations(rows), "conversation_id", "left_semi")
    once = usable.groupBy("conversation_id", "side", "text", "spoken_at").agg(F.min("id").alias("id"))
    kept = once.select("conversation_id", "id", F.col("side").alias("role"), "text", "spoken_at")
    numbered = number_within(kept, ["conversation_id"], ["spoken_at", "id"], "turn_no")
    return numbered.select("conversation_id", "turn_no", "id", "role", "text", "spoken_at")
