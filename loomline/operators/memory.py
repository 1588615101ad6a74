"""Session memory: recent turns, eviction, roll-ups at a session's end, and two-level compaction under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import strip, tagged, token_estimate
from loomline.operators.folds import Fold, folded
from loomline.operators.ordering import number_within
from loomline.operators.segments import latest

RECENT, CAP, EVICTED, END_LIMIT = 5, 20, 5, 35
BUDGET, SUMMARY_TOKENS, TURNS_PER_EPOCH, MOST_SUMMARIES = 1_000, 75, 500, 10


def recent_turns(turns: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` turns of each session, oldest first as ``place``."""
    rows = latest(turns.where("session_id is not null"), ["session_id"], ["created_at", "id"], n, newest=True)
    size = F.count("*").over(Window.partitionBy("session_id"))
    return rows.select("session_id", "id", (size - F.col("rank") + 1).alias("place"), "speaker", "text")


def history_of(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """The stored turns of the sessions named, each with its ``place`` in the order of storing."""
    rows = turns.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return number_within(rows, ["session_id"], ["created_at", "id"], "place")


def evictions(turns: DataFrame) -> DataFrame:
    """How often each session's history overflowed and what is left of it.

    Eviction number e comes with insert ``CAP + 1 + EVICTED (e - 1)``, so counts give all of it without state.
    """
    m = turns.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n_turns"))
    n = F.when(F.col("n_turns") <= CAP, F.lit(0)).otherwise(F.floor((F.col("n_turns") - CAP - 1) / EVICTED) + 1).cast("long")
    counted = m.withColumn("n_evictions", n).withColumn("n_live", F.col("n_turns") - EVICTED * F.col("n_evictions"))
    return counted.withColumn("n_summarised_at_end", F.least("n_live", F.lit(END_LIMIT).cast("long")))


def _lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``[speaker]: text`` of the rows of each key by ``rank``, as one text."""
    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("")), F.lit("]: "), F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n---\n")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_turns"), joined.alias("lines"))


def live_turns(turns: DataFrame) -> DataFrame:
    """The turns that evictions leave in each session's history, with ``rank`` 1, 2, ... from the oldest.

    At most ``CAP`` are left and they are the newest, so each session is cut to that before the shuffle.
    """
    newest = latest(turns.where("session_id is not null"), ["session_id"], ["created_at", "id"], CAP, newest=True)
    kept = newest.join(evictions(turns).select("session_id", "n_live"), "session_id").where(F.col("rank") <= F.col("n_live"))
    return kept.withColumn("rank", F.col("n_live") - F.col("rank") + 1).drop("n_live")


def evicted_turns(turns: DataFrame) -> DataFrame:
    """``(session_id, eviction_no, n_turns, lines)``: what each eviction takes out, oldest first, as its summary's input."""
    rows = turns.where("session_id is not null").select("session_id", "created_at", "id", "speaker", "text")
    ranked = number_within(rows, ["session_id"], ["created_at", "id"], "rank").withColumn("eviction_no", F.floor((F.col("rank") - 1) / EVICTED) + 1)
    due = evictions(turns).where("n_evictions > 0").select("session_id", "n_evictions")
    return _lines(ranked.join(due, "session_id").where("eviction_no <= n_evictions"), ["session_id", "eviction_no"])


def session_end(turns: DataFrame, limit: int = END_LIMIT) -> DataFrame:
    """The lines that a session's closing summary is made from: the first ``limit`` turns that evictions have left."""
    return _lines(live_turns(turns).where(F.col("rank") <= limit), ["session_id"])


def add_turn(state: dict, key: int, n_tokens: int) -> tuple | None:
    """One turn more: ``(epoch, turn, covered, merged, summaries, last covered turn)`` if the budget is exceeded by it.

    Of the summaries' sizes only the newest are kept one by one; the rest of ``covered`` is what the merged one in front covers.
    """
    state["held"].append((n_tokens, key))
    state["tokens"] += n_tokens
    if state["tokens"] + SUMMARY_TOKENS * min(state["epoch"], MOST_SUMMARIES) <= BUDGET:
        return None
    taken, state["held"] = state["held"][:TURNS_PER_EPOCH], state["held"][TURNS_PER_EPOCH:]
    state["tokens"] -= sum(n for n, _ in taken)
    state["epoch"] += 1
    state["covered"] += len(taken)
    state["newest"] = [*state["newest"], len(taken)][-(MOST_SUMMARIES - 1) :]
    merged = state["covered"] - sum(state["newest"]) if state["epoch"] > MOST_SUMMARIES else 0
    return state["epoch"] - 1, key, len(taken), merged, min(state["epoch"], MOST_SUMMARIES), taken[-1][1]


def fresh() -> dict:
    return {"held": [], "tokens": 0, "epoch": 0, "covered": 0, "newest": []}


EPOCHS = ("epoch_index", "last_id", "covers_turn_count", "merged_turn_count", "n_summaries", "last_covered_id")
EPOCH_TYPES = "session_id string, epoch_index int, last_id long, covers_turn_count int, merged_turn_count int, n_summaries int, last_covered_id long"


def _compact(state: dict, turns: Iterator[tuple]) -> tuple[list[tuple], dict]:
    return [made for key, n_tokens in turns if (made := add_turn(state, key, n_tokens))], state


def _carried(begin: dict, guessed: dict, end: dict) -> dict:
    """The end of a slice with epochs and covered turns counted from its true begin."""
    n = end["epoch"] - guessed["epoch"]
    own = end["newest"][max(0, len(end["newest"]) - n) :]
    return end | {"epoch": begin["epoch"] + n, "covered": begin["covered"] + end["covered"] - guessed["covered"], "newest": [*begin["newest"], *own][-(MOST_SUMMARIES - 1) :]}


_FOLD = Fold(
    EPOCH_TYPES,
    fresh,
    _compact,
    guess=lambda: fresh() | {"epoch": MOST_SUMMARIES},  # a slice begins where summaries have long been merged
    core=lambda state: [state["held"], state["tokens"], min(state["epoch"], MOST_SUMMARIES)],
    carried=_carried,
)


def compactions(turns: DataFrame) -> DataFrame:
    """The epochs of each session: when its turns and summaries exceed the budget, its turns become a summary.

    ``merged_turn_count`` is what the two oldest summaries cover together when they are merged, else 0. Whether a turn
    overflows depends on all before it, through what the window holds.
    """
    rows = turns.where("session_id is not null").select("session_id", "created_at", "id", token_estimate("text").alias("tokens"))
    return folded(rows, "session_id", ["created_at", "id"], ["id", "tokens"], _FOLD)


def held_turns(turns: DataFrame) -> DataFrame:
    """The turns that compaction has left in each session's window: those after the last one an epoch covers."""
    covered = compactions(turns).groupBy("session_id").agg(F.max_by("last_covered_id", "epoch_index").alias("id"))
    ends = turns.select("session_id", "id", F.struct("created_at", "id").alias("_end")).join(covered, ["session_id", "id"]).select("session_id", "_end")
    return turns.where("session_id is not null").join(ends, "session_id", "left").where(F.col("_end").isNull() | (F.struct("created_at", "id") > F.col("_end"))).drop("_end")


def restored(turns: DataFrame) -> DataFrame:
    """Each session's window as it is rebuilt from the stored turns: turns held, their tokens, and the next epoch.

    Turns that an epoch has covered stay out of it, so a session goes on after a restart as it would have without one.
    """
    next_epoch = compactions(turns).groupBy("session_id").agg((F.max("epoch_index") + 1).cast("long").alias("next_epoch"))
    held = held_turns(turns).groupBy("session_id").agg(F.count("*").alias("n_held"), F.sum(token_estimate("text")).alias("held_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return held.join(next_epoch, "session_id", "full").select("session_id", zero("n_held"), zero("held_tokens"), zero("next_epoch"))


def session_tokens(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """Tokens of each session's turns and live summaries."""
    a = turns.where("session_id is not null").groupBy("session_id").agg(F.sum(token_estimate("text")).alias("turn_tokens"))
    b = summaries.where("not superseded").groupBy("session_id").agg(F.sum(token_estimate("summary_text")).alias("summary_tokens"), F.sum("covers_turn_count").alias("covered_turns"), (F.max("epoch_index") + 1).alias("next_epoch"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = a.join(b, "session_id", "full")
    return joined.select("session_id", zero("turn_tokens"), zero("summary_tokens"), zero("covered_turns"), zero("next_epoch"), (zero("turn_tokens") + zero("summary_tokens") > BUDGET).alias("over_budget"))


def formatted_context(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """All live summaries by epoch, then the usable turns that compaction has left, as one text for each session."""
    live = summaries.where("not superseded").select("session_id", F.lit(0).alias("part"), F.col("epoch_index").cast("long").alias("place"), "id", F.concat(F.lit("[SESSION HISTORY]: "), "summary_text").alias("line"))
    usable = turns.where("is_final and session_id is not null and speaker is not null and text is not null")
    said = held_turns(usable).select("session_id", F.lit(1).alias("part"), F.unix_micros("created_at").alias("place"), "id", tagged("speaker", strip("text"), "is_important").alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "id", "line"))), lambda x: x["line"]), "\n")
    return live.unionByName(said).groupBy("session_id").agg(F.count("*").alias("n_lines"), joined.alias("context"))


def superseded(summaries: DataFrame, merged: DataFrame) -> DataFrame:
    """``summaries`` with those marked that ``merged`` names by id."""
    named = merged.select("id").distinct().withColumn("_named", F.lit(True))
    return summaries.join(named, "id", "left").withColumn("superseded", F.coalesce("_named", F.col("superseded"), F.lit(False))).drop("_named")
