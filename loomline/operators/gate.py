"""When a turn calls for an answer: refinement, cooldown, intents, and short follow-ups after two answers.

A decision depends on the fires before it in two ways only: through the last fire, as long as the cooldown lasts, and
through the number of fires as long as it is under ``ANSWERS``. So fires are found in two rounds over islands of
candidates: first without follow-ups, which can only come after the ``ANSWERS``-th fire, then with those after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.rules import intents_of, is_refinement
from loomline.functions.text import word_count
from loomline.operators.segments import latest
from loomline.operators.timeline import carried, islands, with_previous
from loomline.session import materialise, spread

COOLDOWN_SECONDS = 3.0
ANSWERS = 2
FOLLOW_UP_WORDS = 6
ANSWER_SECONDS = 10.0
CONFIDENT = 0.5


def _fires(candidates: DataFrame) -> DataFrame:
    """Candidates that fire: the first, and each next one that is ``COOLDOWN_SECONDS`` or more after the last fire."""
    cut = islands(candidates.select("session_id", "at", "id"), ["session_id"], "at", "id", lambda p: F.col("at") - p["at"] >= COOLDOWN_SECONDS)
    none = F.expr("cast(array() as array<struct<at:double,id:bigint>>)")
    free = lambda held, x: (F.size(held) == 0) | (x["at"] - F.try_element_at(held, F.lit(-1))["at"] >= COOLDOWN_SECONDS)
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "id"))), none, lambda held, x: F.when(free(held, x), F.concat(held, F.array(x))).otherwise(held))
    return cut.groupBy("session_id", "island").agg(fold.alias("fired")).select("session_id", F.explode("fired").alias("f")).select("session_id", "f.at", "f.id")


def decide(turns: DataFrame, second: Callable[[Column], Column] | None = None, confident: float = CONFIDENT) -> DataFrame:
    """``(id, session_id, at, action, reason, intents)`` for every turn with a time. Event time is the clock.

    ``second`` gives ``(intent, confidence)`` of a text, and is asked only where no pattern matched.
    """
    final = F.coalesce("is_final", F.lit(False))
    timed = turns.where(F.col("spoken_at").isNotNull() & ~F.isnan("spoken_at") & F.col("session_id").isNotNull())
    rows = spread(timed.select("id", "session_id", F.col("spoken_at").alias("at"), "speaker", "text", final.alias("final")))
    rows = rows.withColumn("refine", F.col("final") & F.coalesce(is_refinement(F.col("speaker"), F.col("text")), F.lit(False)))
    open_ = F.col("final") & ~F.col("refine") & F.col("text").isNotNull()
    rows = rows.withColumn("intents", F.when(open_, intents_of(F.col("text"))).otherwise(F.expr("cast(array() as array<string>)")))
    if second is not None:
        asked = second(F.when(open_ & (F.size("intents") == 0), F.col("text")))
        sure = open_ & (F.size("intents") == 0) & F.coalesce(F.col("m.confidence") >= confident, F.lit(False))
        rows = rows.withColumn("m", asked).withColumn("by_phrase", F.when(sure, F.col("m.intent"))).drop("m")
    else:
        rows = rows.withColumn("by_phrase", F.lit(None).cast("string"))
    rows = rows.withColumn("hit", (F.size("intents") > 0) | F.col("by_phrase").isNotNull()).withColumn("short", open_ & (word_count("text") <= FOLLOW_UP_WORDS))
    # the patterns are searched once; what both rounds read is narrow
    rows = materialise(rows.drop("speaker", "text"), "gate")

    early = _fires(rows.where("hit"))
    ready = latest(early, ["session_id"], ["at", "id"], ANSWERS, newest=False).where(F.col("rank") == ANSWERS).select("session_id", F.struct("at", "id").alias("ready"))
    joined = rows.join(ready, "session_id", "left")
    follows = F.col("short") & F.coalesce(F.struct("at", "id") > F.col("ready"), F.lit(False))
    joined = joined.withColumn("follows", follows)
    fired = _fires(joined.where("hit or follows")).select("id", F.lit(True).alias("fired"))
    marked = joined.join(fired, "id", "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    last = carried(materialise(marked, "fires"), ["session_id"], "at", "id", F.when(F.col("fired"), F.col("at")), "last_fire", current=False)
    cooling = F.coalesce(F.col("at") - F.col("last_fire") < COOLDOWN_SECONDS, F.lit(False))
    reason = F.when(~F.col("final"), "not final").when(F.col("refine"), "refinement").when(cooling, "cooldown").when(F.col("fired") & (F.size("intents") > 0), "intent").when(F.col("fired") & F.col("hit"), "embedding").when(F.col("fired"), "follow_up").otherwise("no match")
    action = F.when(F.col("refine"), "refine").when(F.col("fired"), "fire").otherwise("no_trigger")
    shown = F.when(reason == "intent", F.array_join("intents", ",")).when(reason == "embedding", F.col("by_phrase")).when(reason == "follow_up", "follow_up").otherwise("")
    return last.select("id", "session_id", "at", action.alias("action"), reason.alias("reason"), shown.alias("intents"))


def marked_important(turns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Turns with ``is_important`` set where one fired."""
    fired = decisions.where("action = 'fire'").select("id", F.lit(True).alias("fired"))
    return turns.join(fired, "id", "left").withColumn("is_important", F.coalesce("fired", F.col("is_important"), F.lit(False))).drop("fired")


def aborted(decisions: DataFrame, seconds: float = ANSWER_SECONDS) -> DataFrame:
    """Answers and whether the next one of the session began before they could end."""
    runs = decisions.where("action in ('fire', 'refine')").select("id", "session_id", (-F.col("at")).alias("back"), "at")
    after = with_previous(runs.withColumn("neg", -F.col("id")), ["session_id"], "back", "neg", ["at"], "next")
    return after.select("id", "session_id", F.coalesce(F.col("next.at") - F.col("at") < seconds, F.lit(False)).alias("aborted"))
