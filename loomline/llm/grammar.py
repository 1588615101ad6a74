"""Parsing-expression rules: each takes a text and a place and gives the end and a list of nodes, or None.

A node is ``(kind, text, children)``. Choice is ordered and there is no going back into a rule that has matched.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple[str, str, tuple]
Rule = Callable[[str, int], tuple[int, list[Node]] | None]


def token(pattern: str, kind: str = "", flags: int = 0) -> Rule:
    """A regular expression as a terminal; without a kind it leaves no node."""
    match = re.compile(pattern, flags).match

    def rule(text: str, at: int):
        found = match(text, at)
        return None if found is None else (found.end(), [(kind, found.group(), ())] if kind else [])

    return rule


def sequence(*rules: Rule) -> Rule:
    def rule(text: str, at: int):
        nodes: list[Node] = []
        for part in rules:
            found = part(text, at)
            if found is None:
                return None
            at = found[0]
            nodes += found[1]
        return at, nodes

    return rule


def choice(*rules: Rule) -> Rule:
    def rule(text: str, at: int):
        for part in rules:
            found = part(text, at)
            if found is not None:
                return found
        return None

    return rule


def starting(characters: str, part: Rule) -> Rule:
    """The rule, asked only where one of the characters stands: it could begin with no other."""
    own = frozenset(characters)
    return lambda text, at: part(text, at) if text[at : at + 1] in own else None


_OPENED = re.compile(r"[\[({\])}>]|<(?=[^\s<>=\d])|<(?=t=)")
_CLOSES = {"]": "[", ")": "(", "}": "{", ">": "<"}


def brackets(text: str) -> dict[int, int]:
    """Where each bracket that is closed ends; notes may lie in notes to any depth. One that is not closed is a plain character."""
    ends, opened = {}, {"[": [], "(": [], "{": [], "<": []}
    for found in _OPENED.finditer(text):
        mark, at = found.group(), found.start()
        if mark in opened:
            opened[mark].append(at)
            continue
        own = opened[_CLOSES[mark]]
        if own:
            start = own.pop()
            ends[start] = at + 1
            # what was opened inside and not closed stays plain
            for others in opened.values():
                while others and others[-1] > start:
                    others.pop()
    return ends


def bracketed() -> Rule:
    """A note in brackets, from its opening mark to where it is closed."""
    held: dict = {"text": None, "ends": {}}

    def rule(text: str, at: int):
        if held["text"] is not text:
            held.update(text=text, ends=brackets(text))
        end = held["ends"].get(at)
        return None if end is None else (end, [])

    return rule


def many(part: Rule) -> Rule:
    """As often as it matches and moves on."""

    def rule(text: str, at: int):
        nodes: list[Node] = []
        while (found := part(text, at)) is not None and found[0] > at:
            at = found[0]
            nodes += found[1]
        return at, nodes

    return rule


def optional(part: Rule) -> Rule:
    return lambda text, at: part(text, at) or (at, [])


def ahead(part: Rule) -> Rule:
    """Matches without taking anything."""
    return lambda text, at: None if part(text, at) is None else (at, [])


def unless(part: Rule) -> Rule:
    return lambda text, at: (at, []) if part(text, at) is None else None


def node(kind: str, part: Rule, accept: Callable[[str], bool] = lambda _: True) -> Rule:
    """One node with the rule's nodes below it, if its text is accepted."""

    def rule(text: str, at: int):
        found = part(text, at)
        if found is None or not accept(text[at : found[0]]):
            return None
        return found[0], [(kind, text[at : found[0]], tuple(found[1]))]

    return rule
