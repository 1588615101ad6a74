"""Column expressions over text. White space is Unicode's, as in the behaviour that is matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def has_text(c: ColumnOrName) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def words(c: ColumnOrName) -> Column:
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def word_count(c: ColumnOrName) -> Column:
    """Words between white space; null gives 0."""
    return F.coalesce(F.size(words(c)), F.lit(0)) * F.when(_col(c).isNull(), 0).otherwise(1)


def first_words(c: ColumnOrName, n: int = 30) -> Column:
    """At most ``n`` words joined by single blanks, with `` ...`` where some are left out."""
    all_words = words(c)
    return F.concat(F.array_join(F.slice(all_words, 1, n), " "), F.when(F.size(all_words) > n, " ...").otherwise(""))


def one_line(c: ColumnOrName, n: int = 250) -> Column:
    """White space collapsed, first ``n`` characters."""
    return F.substring(strip(F.regexp_replace(_col(c), r"(?U)\s+", " ")), 1, n)


def scored_line(score: ColumnOrName, c: ColumnOrName, n: int = 250) -> Column:
    return F.format_string("[%.4f] %s", _col(score), one_line(c, n))


def humanized(c: ColumnOrName) -> Column:
    """``money_back_plans`` as ``Money Back Plans``."""
    return F.initcap(F.array_join(F.filter(F.split(_col(c), "[-_]+"), lambda x: x != ""), " "))


def token_estimate(c: ColumnOrName) -> Column:
    """A quarter of the characters, at least 1; 0 for null and empty text."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def tagged(speaker: ColumnOrName, text: ColumnOrName, important: ColumnOrName | None = None) -> Column:
    """``[AGENT — IMPORTANT]: text``."""
    mark = F.when(_col(important), F.lit(" — IMPORTANT")).otherwise(F.lit("")) if important is not None else F.lit("")
    return F.concat(F.lit("["), F.upper(_col(speaker)), mark, F.lit("]: "), _col(text))


def last_space_before(c: ColumnOrName, n: int) -> Column:
    """0-based place of the last blank among the first ``n`` characters, -1 if none."""
    head = F.substring(_col(c), 1, n)
    at = F.instr(F.reverse(head), " ")
    return F.when(at == 0, -1).otherwise(F.length(head) - at)


def event_payload(line: ColumnOrName) -> Column:
    """The payload of a server-sent chunk: without ``data:`` and the white space after it; other chunks stay as they are,
    blanks included. Null for what is then empty, and for ``[DONE]``."""
    chunk = _col(line)
    body = F.when(chunk.startswith("data:"), F.regexp_replace(chunk, r"(?U)^data:\s*", "")).otherwise(chunk)
    return F.when((body == "") | (strip(body) == "[DONE]"), None).otherwise(body)


def setting(line: ColumnOrName) -> Column:
    """``KEY=VALUE`` as a struct; null for comments and lines without a sign."""
    text = strip(line)
    parts = F.split(text, "=", 2)
    return F.when(text.startswith("#") | ~F.contains(text, F.lit("=")), None).otherwise(F.struct(strip(parts[0]).alias("key"), strip(parts[1]).alias("value")))


def clock(seconds: ColumnOrName) -> Column:
    """Epoch seconds as ``HH:MM:SS.mmm``, UTC."""
    return F.date_format(F.timestamp_seconds(_col(seconds)), "HH:mm:ss.SSS")


def prompt(context: ColumnOrName, question: ColumnOrName) -> Column:
    block = F.concat(F.lit("Context:\n"), _col(context), F.lit("\n\nCustomer question: "), _col(question))
    return F.when(has_text(context), block).otherwise(_col(question))


def history_prompt(lines: Column, question: ColumnOrName) -> Column:
    """A question after a list of lines, or by itself where there are none."""
    listed = F.concat(F.lit("Relevant conversation history:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit("\n\n"))
    return F.concat(F.when(F.size(lines) > 0, listed).otherwise(""), F.lit("Customer question: "), _col(question))


def suggestion_prompt(said: ColumnOrName, context: ColumnOrName) -> Column:
    """What was said last, with what the policies say about it."""
    return F.concat(F.lit("Conversation:\n"), _col(said), F.lit("\n\nPolicy context:\n"), F.coalesce(_col(context), F.lit("")))
