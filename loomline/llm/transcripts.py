"""Clean speaker turns from transcripts.

A parsing-expression grammar reads a turn as labels, stamps, notes (which may hold other notes), hesitations and words;
the parse tree is then turned into the words said. What a note is depends on its content: a stamp if it is only a time, a
label if it only names a side, a sound if it tells of something heard or not heard, and otherwise words that were said in
brackets.

Defined results: a null or empty text has no kinds but ``label``, which a null speaker gives; a note that is not closed
ends with the words for its sound; rows stored twice and rows that are not final have their kinds but make no turn twice
(same conversation, side, text and time: the smallest id stays); turns whose words are all removed, or whose speaker
names neither side in its column and in its text, are left out of the clean turns; rows without session or time come
last in their group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.grammar import Node, bracketed, choice, many, node, optional, sequence, starting, token
from loomline.operators.ordering import number_within
from loomline.llm.sides import side
from loomline.session import spread

KINDS = ("label", "clock", "sound", "filler")

#: Stems of words for things heard or not heard, and phrases put in that say nothing (fixed values).
SOUND_STEMS = (
    "applau bark beep breath buzz chatter cheer chuckl clap clear click cough cries cross cry dial disconnect dog echo footstep giggl groan gasp "
    "hiccup hold\\smusic hum\\b inaudible indistinct knock laugh line\\sbreaks line\\scut music mumbl mutter noise no\\saudio overlap paus phone "
    "ring siren sigh silen sing slam sneez sniff snort sob static tap\\b throat tone traffic typing unclear unintelligible wind\\b whisper whistl yawn"
).split()
PHRASES = ("you know", "i mean", "you see", "basically like", "sort of like", "kind of like", "sort of", "kind of", "basically", "like", "मतलब", "matlab")

#: A label names a side in so many words; more of them tell something.
LABEL_WORDS = 4

_SOUND = re.compile(rf"(?<!\w)(?:{'|'.join(SOUND_STEMS)})", re.I)
_TIME = re.compile(r"\s*(?:t\s*=\s*\d+(?:[.,]\d+)?|\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d+)?(?:\s*(?:-->|–|-)\s*\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d+)?)?)\s*[-–]?\s*s?\s*$", re.I)
_EDGES = "[](){}<>~*/♪♫🎵🎶🔔📞🔊🔇🔕- "
_ROLE = r"(?:the\s+)?(?:call\s+)?[^\W\d_]{2,}\.?(?:[\s_#]*\d{1,3})?"


def _content(note: str) -> str:
    return note.strip(_EDGES)


def _is_time(note: str) -> bool:
    return bool(_TIME.match(_content(note)))


def _is_side(note: str) -> bool:
    inner = _content(note)
    return 2 <= sum(c.isalpha() for c in inner) and len(inner.split()) <= LABEL_WORDS and side(inner) is not None


def _is_sound(note: str) -> bool:
    inner = _content(note)
    return not inner or bool(_SOUND.search(inner))


# --------------------------------------------------------------------------------------------------------- the grammar

_space = token(r"\s+")


#: A note that nothing closes: the longest run of words for sounds after the opening mark.
_UNCLOSED = rf"[\[({{<]{{1,2}}(?:(?:background|long|short|loud|heavy|distant|door|dog|baby|phone|line|clears?)\s+)?(?:{'|'.join(SOUND_STEMS)})\w*(?:\s+(?:throat|playing|ringing|barking|crying|slams|noise|breaks|up|from\s+tv|\d{{1,2}}:\d\d)\b)*(?=\s|$)"
_nested = starting("[({<", bracketed())
#: Marks that open and close alike; what is between them must be a sound.
_paired = choice(
    token(r"~[^~]+~"), token(r"\*[^*]+\*"), token(r"(?<![\w/])/[^/\d][^/]*/(?!\w)"), token(r"--\s[^-]+\s--"), token(r"♪[^♪]*♪|[♪♫🎵🎶]+"), token(r"[🔔📞🔊🔇🔕]+")
)

_stamp = starting("0123456789@", choice(
    token(r"\d{1,2}:\d\d:\d\d[.,]\d{1,3}\s*-->\s*\d{1,2}:\d\d:\d\d[.,]\d{1,3}", "clock"),
    token(r"(?<![\w:])\d{1,2}:\d\d:\d\d(?:[.,]\d{1,3})?(?![\w:])", "clock"),
    token(r"(?<!\w)@\s?\d+(?:\.\d+)?s(?:ec)?\b", "clock"),
    token(r"(?<!\w)(?:\d{1,2}h)?\d{1,3}m\d{1,2}s:?(?!\w)", "clock"),
))
_note = starting("[({<~*/-♪♫🎵🎶🔔📞🔊🔇🔕", choice(
    node("clock", _nested, _is_time),
    node("label", _nested, _is_side),
    node("sound", _nested, _is_sound),
    node("sound", _paired, _is_sound),
    token(_UNCLOSED, "sound", re.I),
))
_end = r"(?=\s*(?:[,.?!;:।…\[({<~*/♪🔔]|--|$))"
_HESITATION = (
    r"(?<![\w'’-])(?:[Uu]+-[Uu]*[Mm]+|[Uu]+[Hh]+[Mm]*|[Uu]+[Mm]+|UH+M*|UM+|[Ee]r+m*|[Hh][Mm]{2,}|[Mm]{3,}|[Mm]m-?h[m]+)(?![\w'’]|-\w)(?:\.{3}|…|,)?"
)
_hesitation = starting("UuEeHhMm", token(_HESITATION, "filler"))
_phrase = r"(?:" + "|".join(p.replace(" ", r"\s+") for p in sorted(PHRASES, key=len, reverse=True)) + r")(?!\w)"
#: A phrase between commas, or between a comma and the end of a sentence.
_inserted = starting(",", token(r",\s*" + _phrase + r"(?:\s*,\s*" + _phrase + r")*" + _end + r",?", "filler", re.I))
#: A phrase at the start of a sentence, with a comma after it.
_opening = token(_phrase + r"(?:,|(?=\s*(?:\.?\s*$|[\[({<~*/♪🔔]|--)))", "filler", re.I)
_label = sequence(node("label", choice(token(_ROLE + r"\s*(?::|>{1,2}|\s-)(?=\s|$)"), token(r"[AC]\s*(?::|>{1,2})(?=\s|$)")), lambda t: side(t) is not None))
_lead = many(choice(_space, _stamp, _note, _label, _hesitation, _opening))
#: After these a phrase may open a sentence.
_gap = token(r"\s+", "space")
_pause = sequence(choice(_stamp, _note, _hesitation, starting(".?!।", token(r"[.?!।]+(?=\s)", "word"))), many(choice(_gap, _stamp, _note, _hesitation)), optional(_opening))
_letters = r"(?:[^\W\d_]|[ऀ-ॣ०-෿])+"
_plain = token(_letters + rf"(?:['’-]{_letters})*", "word")
#: Words that are no hesitation, at once.
_run = token(rf"(?:(?!{_HESITATION}){_letters}(?:['’-]{_letters})*(?:[ \t]+|(?=[,.?!])))+", "word")
_digits = token(r"\d+", "word")
_item = choice(_run, _inserted, _pause, _gap, _plain, _digits, token(r"(?s).", "word"))
_turn = sequence(_lead, many(_item))


def parse(text: str) -> list[Node]:
    """The parse tree's top nodes."""
    return _turn(text, 0)[1]


@lru_cache(maxsize=20_000)
def read(text: str) -> tuple[tuple[str, ...], str, str | None]:
    """The kinds in a text, the words said, and the side its label names."""
    found, words, named = set(), [], None
    for kind, part, _ in parse(text):
        if kind in KINDS:
            found.add(kind)
            words.append(" ")
            if kind == "label":
                named = named or side(_content(part))
            if kind == "filler" and part.startswith(",") and not part.endswith(","):
                continue
        else:
            words.append(part)
    said = re.sub(r"\s+", " ", "".join(words)).strip()
    said = re.sub(r"\s+([,.?!;:।…])", r"\1", said)
    said = re.sub(r"^[,;:\s]+", "", said)
    return tuple(k for k in KINDS if k in found), said, named


# ------------------------------------------------------------------------------------------------------------- the job

_READ = "id long, session_id string, speaker string, spoken_at double, usable boolean, kinds array<string>, role string, said string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("session_id", pa.string()), ("speaker", pa.string()), ("spoken_at", pa.float64()), ("usable", pa.bool_()), ("kinds", pa.list_(pa.string())), ("role", pa.string()), ("said", pa.string())])
    for batch in batches:
        kinds, roles, said = [], [], []
        for speaker, text in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
            own, words, named = read(text or "")
            if speaker not in ("agent", "customer") and "label" not in own:
                own = ("label", *own)
            kinds.append(list(own))
            roles.append(side(speaker) or named)
            said.append(words)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(kinds, pa.list_(pa.string())), pa.array(roles, pa.string()), pa.array(said, pa.string())], schema=schema)


def read_turns(turns: DataFrame) -> DataFrame:
    """Every row with the kinds of noise in it, its role and the words said."""
    at = F.col("spoken_at").cast("double")
    columns = [F.col("id").cast("long"), F.col("session_id").cast("string"), F.col("speaker").cast("string"), F.when(~F.isnan(at), at).alias("spoken_at"), F.coalesce("is_final", F.lit(False)).alias("usable"), F.col("text").cast("string")]
    return spread(turns.select(*columns)).mapInArrow(_rows, _READ)


def noise_kinds(turns: DataFrame) -> DataFrame:
    """``(id, kind)`` for each kind of noise in each row."""
    return read_turns(turns).select("id", F.explode("kinds").alias("kind")).distinct()


def clean_turns(turns: DataFrame) -> DataFrame:
    """``(session_id, turn_no, id, role, said, spoken_at)``: what was said, in the order of ``spoken_at``."""
    rows = read_turns(turns).where("usable and role is not null and said <> ''")
    once = rows.groupBy("session_id", "role", "said", "spoken_at").agg(F.min("id").alias("id"))
    numbered = number_within(once.select("session_id", "id", "role", "said", "spoken_at"), ["session_id"], ["spoken_at", "id"], "turn_no")
    return numbered.select("session_id", "turn_no", "id", "role", "said", "spoken_at")
