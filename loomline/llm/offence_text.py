"""Passages of a text, and the words of a passage as they would be without disguise.

A word may be disguised by letters of another script that look alike, digits and signs in place of letters, letters
spaced out by blanks, dots, hyphens or underscores, letters repeated, marks without width, or masked letters. All but the
masks are undone here; masked words keep ``*`` and ``#`` and are resolved against words of the labelled examples.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKES = str.maketrans("абвгеёзіјкмнорстухѕԁһӏαβεικνορτυχ", "abbreezijkmhopctyxsdhlabeiknoptux")
#: Digits and signs that stand for letters (fixed values).
STAND_INS = str.maketrans("@$!013457|", "asioieastl")

#: Blanks after the end of a sentence, or ends of lines. It begins with one class, which the engine finds without trying every place.
_BREAK = re.compile(r"[\s\u200b](?:(?<=[.!?।][\s\u200b])[\s\u200b]*|(?<=[\n\r\u2028\u2029])[\n\r\u2028\u2029]*)")
_SPEAKER = re.compile(r"^\s*(?:\[\d\d:\d\d(?::\d\d)?\]\s*)?(?:(?:customer|agent|client|caller|advisor|q|a)\b[:.]|(?<=\])\s*(?:customer|agent)\b)\s*", re.I)
_CODE = re.compile(r"\b(?:[A-Za-z]{2,}\d{3,}|\d{3}[A-Za-z]\d{3}[A-Za-z]\d{2})\b")
_NUMBER = re.compile(r"(?<![^\W\d_])(?<![@$*#])\d+(?:[:,./]\d+)*(?![^\W_])(?![@$*#])")
_SPACED = re.compile(r"(?<![^\W_])(?<![@$*#])([^\W_]|[@$*])(([ ._\-])(?: ?-)?(?:[^\W_]|[@$*])(?:\3(?:[^\W_]|[@$*]))+)(?![^\W_])(?![@$*#])")
#: Marks without width, control characters, pictures and unassigned places.
_UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}\p{So}\p{Co}\p{Cn}]+")
_DIGIT = re.compile(r"\d")
_GAP = re.compile(r"[ ._\-]+")
_WORD = re.compile(r"[^\s!\"%-)+-/:-?\[-`{-~।॥“”‘’…—–¿¡<>]+")
_LEET = re.compile(r"(?=.*[^\W\d_])[\w@$!|]*[@$!013457|][\w@$!|]*$")
_RUN = re.compile(r"([^\W\d_])\1+")
_VOWEL = re.compile(r"[aeiou]")
_BARE = re.compile(r"[a-z0 ,.'?;:()/-]*$")
#: Digits among letters, or letters on their own one after another.
_ODD = re.compile(r"[a-z]0|0[a-z]|\b[a-z]([ .\-])[a-z]\1[a-z]\b")


def passages(text: str | None) -> list[str]:
    """Sentences and lines, without time stamps and names of speakers at their start."""
    if not text:
        return []
    return [cut for part in _BREAK.split(text) if part and (cut := (part[named.end() :] if (named := _SPEAKER.match(part)) else part).strip())]


def _joined(match: re.Match) -> str:
    first, rest = match.group(1), _GAP.sub("", match.group(2))
    # an article before a spaced-out word may have been caught with it; the mark lets the words of examples decide
    return f"\u00a4{first}{rest}" if first in "ai" and match.group(2)[0] == " " else first + rest


def _in_words_with_digits(by: Callable[[str], str], text: str) -> str:
    """The substitution in the few words that hold a digit."""
    if not _DIGIT.search(text):
        return text
    return " ".join([part if part.isalpha() or not _DIGIT.search(part) else by(part) for part in text.split(" ")])


def _coded(text: str) -> str:
    return _CODE.sub(" ref ", text)


def _numbered(text: str) -> str:
    return _NUMBER.sub("0", text)


def words(passage: str) -> list[str]:
    """Lower-case words without disguise; numbers become ``0`` and reference codes ``ref``."""
    if passage.isascii():
        text = _in_words_with_digits(lambda part: _numbered(_coded(part).lower()), passage).lower()
    else:
        text = unicodedata.normalize("NFKC", _in_words_with_digits(_coded, passage))
        text = _UNSEEN.sub("", text)
        if re.search("[A-Za-z]", text):
            text = text.lower().translate(LOOK_ALIKES)
        text = _in_words_with_digits(_numbered, text.lower())
    if not _BARE.match(text) or _ODD.search(text):
        text = _SPACED.sub(_joined, text)
        found = [w.rstrip("!|") for w in _WORD.findall(text.replace("!", "! "))]
        return [w.translate(STAND_INS) if _LEET.match(w) and w != "0" else w for w in found if w]
    return _WORD.findall(text)


@lru_cache(50_000)
def squeezed(word: str) -> str:
    """Without repeated letters, so that ``swiiine`` and ``swine`` are one term."""
    return _RUN.sub(r"\1", word)


def masks(word: str) -> list[str]:
    """How a word looks with its vowels, or all letters between the first and the last, masked."""
    if len(word) < 3:
        return []
    return [_VOWEL.sub("*", word), word[0] + "#" * (len(word) - 2) + word[-1]]
