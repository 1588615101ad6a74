"""Readable paragraphs from the text of scanned pages.

1. Each block of rows lists its distinct words, with the words that hyphenated line ends, and odd words joined with their
   neighbours, would give.
2. Words are counted over the corpus. Every distinct word once gets its best other reading: misread characters undone, or
   two words set apart, if the corpus has those words often enough.
3. The readings go back to the blocks, and each row is decoded there: lines are chained where a hyphen at the end of one
   goes on in another, and the cheapest path through the chain is taken. Its steps are a word as it is; its other
   reading; an odd word's characters as several words of the block, misread or not; two or three words, one of them odd,
   put together over blanks; and at a hyphen both parts joined, kept with the hyphen, or left apart.
4. A line is a running header or footer if its file has it in at least two different texts, whatever its spelling, and
   it is set like one: it starts with a capital or a number, most of its words do, and it does not end a sentence or go
   on in the next line. Lines are compared after step 3, so misread headers count.
5. A line that gives only a number of one of the row's pages, in any numerals, is a page number.
6. Paragraphs: the best set of breaks by dynamic programming over the lines that are left.

Costs are negative logarithms of corpus frequencies, so they behave alike at every size; odd words are those rarer than
``ODD_COST``, or seen once. The path's costs are those of single words: no word's cost depends on the word before it.

Defined results: null and empty texts have no kinds and null or empty text; a row with no readable ``page_range`` has the
pages of its batch; rows ingested twice count once for headers; a null ``source_file`` is a file of its own; a run of over
``WORD_CHARS`` characters is no word and stays as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import materialise, spread

BLOCK_CHARS = 8_000_000
PAGES_PER_BATCH = 3
#: Costs, in logarithms of frequency: of the first and of each further misread place, of two words set apart, of a joint, and of a blank inside a word.
FIRST_MISREAD, MORE_MISREAD, APART, JOINT, BLANK = 2.0, 1.5, 6.0, 0.5, 4.0
#: Words rarer than this are odd; as they are, they cost at least so much a character against several words in their place.
ODD_COST, ODD_CHARACTER = 11.0, 2.0
#: The shortest word that an odd word is taken apart into, and how many words are put together.
LEAST_PART, MOST_PARTS = 3, 3
MOST_MISREAD = 3
#: Longer runs of characters without a blank are no words.
WORD_CHARS = 40
HEADER_TEXTS = 2
SHORT_PARAGRAPH = 40
HEADER_CAPITALS = 0.6
#: The most that is left of a page number's line when white space is collapsed.
PAGE_NUMBER_CHARS = 60

#: What scanners make of letters (fixed values): as read, as printed.
MISREADINGS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("|i", "h"), ("ri", "n"), ("r1", "n"), ("r!", "n"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"),
    ("+", "t"), ("€", "e"), ("$", "s"), ("£", "e"), ("¢", "c"), ("h", "b"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("l", "t"), ("tl", "d"), ("nn", "m"),
)
#: Misreadings of one plain letter as another are believed only against this many times the frequency of the rest.
_LETTERS = frozenset(a + b for a, b in (("h", "b"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("l", "t")))
_LETTER_COST = 3.0
_SIGNS = tuple((read, printed) for read, printed in MISREADINGS if read + printed not in _LETTERS)

_HYPHENS = "\u00ad\u2010\u2011\u00ac-"
_SOFT = "\u00ad\u2010\u00ac"
_STRIP = ".,;:()[]{}\"'“”‘’?•·…<>"
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_PAGE = re.compile(r"(?:(?:p\s*a\s*g\s*e|p\s*g|p)\s*\.?\s*(?:no\.?)?\s*)?[\[({\-–—|•·~*\s]*(\d{1,6}|[ivxlcdm]{1,9})[\])}\-–—|•·~*\s]*(?:(?:of|/|out of)\s*\d{1,6}[\])}\-–—|•·~*\s]*)?$", re.I)
_PAGE_WORD = re.compile(r"[/|\-–—•·]+$|(?:page|pg|p)\.?$", re.I)
_DECOR = "[](){}-–—|•·~*_=# \t\r"


def word(token: str) -> str:
    """A token in lower case, without marks at its ends."""
    return token.strip(_STRIP).lower()


def pages(page_range: str | None, batch: int | None) -> range:
    """The pages of a row, by its range in either order, or else by its batch."""
    found = [int(x) for x in re.findall(r"\d{1,6}", page_range or "")][:2]
    if found:
        return range(min(found), max(found) + 1)
    return range(PAGES_PER_BATCH * (batch - 1) + 1, PAGES_PER_BATCH * batch + 1) if batch and batch > 0 else range(0)


def _roman(text: str) -> int:
    values, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}, 0
    for a, b in zip(text, text[1:] + " ", strict=False):
        total += values[a] if values[a] >= values.get(b, 0) else -values[a]
    return total


def is_page_number(line: str, of: range) -> bool:
    bare = line.strip(_DECOR)
    if len(bare) > PAGE_NUMBER_CHARS and "  " in bare:
        bare = " ".join(bare.split())
    found = _PAGE.match(bare) if len(bare) <= PAGE_NUMBER_CHARS else None
    if not found:
        return False
    number = found.group(1).lower()
    if number.isdigit():
        return int(number) in of
    return bool(number) and bool(_ROMAN.match(number)) and _roman(number) in of


def _continuation(lines: list[str], at: int, of: range) -> int | None:
    """The line that goes on after a hyphen: the next one in small letters, over page numbers, blank lines and lines set like headers."""
    for i in range(at + 1, len(lines)):
        line = lines[i].strip()
        if not line or is_page_number(line, of):
            continue
        if line[0].islower() or line[0] in "!|@+€0156" or unicodedata.category(line[0]) in ("Lo", "Mn", "Mc"):
            return i
        if header_key(line, of, line) is None:
            return None
    return None


def _joints(lines: list[str], of: range) -> dict[int, tuple[int, str, str, str]]:
    """Hyphenated line ends: the line that goes on, the parts and the hyphen."""
    found = {}
    for i, line in enumerate(lines):
        bare = line.rstrip()
        if bare and bare[-1] in _HYPHENS:
            token = bare.rsplit(None, 1)[-1].rstrip(_HYPHENS)
            if any(c.isalpha() for c in token):
                to = _continuation(lines, i, of)
                follows = lines[to].split(None, 1)[0] if to is not None else ""
                found[i] = (-1 if to is None else to, word(token), word(follows), bare[-1])
    return found


# ------------------------------------------------------------------------------------------------------ words of blocks

_BLOCKS = "block long, id long, file string, page_range string, batch int, text string, words array<string>, counts array<long>"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("file", pa.string()), ("page_range", pa.string()), ("batch", pa.int32()), ("text", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _listed(text: str, of: range, tokens: Counter, asked: set[str]) -> None:
    """Count a row's tokens, but not those at hyphenated line ends; what these could give is asked for."""
    lines = text.split("\n")
    tokens.update(text.split())
    joints = _joints(lines, of)
    for i, (to, left, right, _) in joints.items():
        tokens[lines[i].split()[-1]] -= 1
        if to >= 0:
            tokens[lines[to].split(None, 1)[0]] -= 1
        asked.update((left, right, left + right, f"{left}-{right}") if right else (left,))


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, chars, tokens, asked, rows = TaskContext.get().partitionId() << 32, 0, 0, Counter(), set(), []

        def block() -> pa.RecordBatch:
            words = Counter(dict.fromkeys(asked, 0))
            for token, k in tokens.items():
                if (own := word(token)):
                    words[own] += max(k, 0)
            rare = max(1.0, sum(words.values()) * math.exp(-ODD_COST))
            odd = {token for token in tokens if (own := word(token)).isalpha() and words[own] <= rare}
            for row in rows:
                for line in (row["text"] or "").split("\n"):
                    parts = line.split()
                    if odd.isdisjoint(parts):
                        continue
                    for j in (j for j, part in enumerate(parts) if part in odd):
                        for first in range(max(0, j - MOST_PARTS + 1), j + 1):
                            for last in range(max(j, first + 1), min(first + MOST_PARTS, len(parts))):
                                if whole := together(parts[first : last + 1]):
                                    words.setdefault(whole, 0)
            head = {"block": base + n, "words": list(words), "counts": list(words.values())}
            return pa.RecordBatch.from_pylist([head, *({"block": base + n, **row} for row in rows)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for i, file, page_range, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _listed(text or "", pages(page_range, number), tokens, asked)
                rows.append({"id": i, "file": file, "page_range": page_range, "batch": number, "text": text})
                chars += len(text or "")
                if chars >= limit:
                    yield block()
                    n, chars, tokens, asked, rows = n + 1, 0, Counter(), set(), []
        if rows:
            yield block()

    return run


def readings(own: str) -> dict[str, float]:
    """Other words that a scanner may have read as this one, with their cost."""
    if len(own) < 3 or not any(c.isalpha() for c in own) or len(own) > WORD_CHARS:
        return {}
    found, edge = {own: 0.0}, [own]
    for depth in range(MOST_MISREAD):
        grown = []
        for held in edge:
            for read, printed in MISREADINGS:
                letters = read + printed in _LETTERS
                if letters and depth:
                    continue
                at = held.find(read)
                while at >= 0:
                    made = held[:at] + printed + held[at + len(read) :]
                    cost = found[held] + (MORE_MISREAD if depth else FIRST_MISREAD) + (_LETTER_COST if letters else 0)
                    if made not in found:
                        found[made] = cost
                        grown.append(made)
                    at = held.find(read, at + 1)
        # a second place is sought only where a character that is no letter is left, or the first one was such a character
        odd = any(not c.isalpha() for c in own)
        edge = [m for m in grown if odd or depth == 0] if len(grown) <= 400 else [m for m in grown if any(not c.isalpha() for c in m)]
    del found[own]
    return {m: c for m, c in found.items() if m.isalpha() or "-" in m}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("left", pa.string()), ("right", pa.string()), ("cost", pa.float64())])
    for batch in batches:
        rows = []
        for own in batch.column(0).to_pylist():
            rows += [{"word": own, "left": made, "right": None, "cost": cost} for made, cost in readings(own).items()]
            if own.isalpha() and 5 <= len(own) <= WORD_CHARS:
                rows += [{"word": own, "left": own[:i], "right": own[i:], "cost": APART} for i in range(2, len(own) - 1)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _best_readings(counts: DataFrame) -> DataFrame:
    """``(word, n, fix, cost)``: each distinct word, how often it occurs, and its cheapest other reading if it has one."""
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    price = lambda n: -F.log(n / F.lit(float(total)))
    lexicon = counts.where("n > 0")
    made = counts.select("word").mapInArrow(_candidates, "word string, left string, right string, cost double")
    one = lexicon.select(F.col("word").alias("left"), F.col("n").alias("n_left"))
    two = lexicon.select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    # parts of two letters and more, both words of the corpus
    known = made.join(one, "left").join(two, "right", "left").where("right is null or n_right is not null")
    priced = known.select(
        "word",
        F.when(F.col("right").isNull(), F.col("left")).otherwise(F.concat_ws(" ", "left", "right")).alias("fix"),
        (F.col("cost") + price(F.col("n_left")) + F.when(F.col("right").isNull(), 0.0).otherwise(price(F.col("n_right")))).alias("cost"),
    )
    best = priced.groupBy("word").agg(F.min(F.struct("cost", "fix")).alias("best"))
    own = price(F.greatest(F.col("n").cast("double"), F.lit(0.1)))
    return counts.join(best, "word", "left").select("word", "n", own.alias("own_cost"), "best.fix", F.col("best.cost").alias("fix_cost"))


# ----------------------------------------------------------------------------------------------------- reading one row


def together(tokens: list[str]) -> str | None:
    """The word that these tokens give without the blanks between them, if no marks part them."""
    cores = [word(t) for t in tokens]
    if not all(core.isalpha() for core in cores) or tokens[0].rstrip(_STRIP) != tokens[0] or tokens[-1].lstrip(_STRIP) != tokens[-1] or any(t.strip(_STRIP) != t for t in tokens[1:-1]):
        return None
    return "".join(cores)


def _shown(token: str, own: str, reading: str) -> str:
    """The token with another reading, in its spelling of capitals and with its marks."""
    head = token[: len(token) - len(token.lstrip(_STRIP))]
    tail = token[len(token.rstrip(_STRIP)) :] if token.strip(_STRIP) else ""
    core = token.strip(_STRIP)
    upper = sum(c.isupper() for c in core) > 1 and not any(c.islower() for c in core)
    return head + (reading.upper() if upper else reading.capitalize() if core[:1].isupper() else reading) + tail


class Reader:
    """Decodes rows with the words of their block: ``held`` gives a word's count, cost, other reading and its cost."""

    def __init__(self, held: dict[str, tuple[int, float, str | None, float | None]]) -> None:
        self.held, self.known, self.plain = held, {}, set()
        seen = [own + math.log(n) for n, own, _, _ in held.values() if n]
        self.once = max(seen, default=12.0)
        self.odd_from = min(ODD_COST, self.once - 1e-9)
        self.longest = max((len(w) for w, (n, *_) in held.items() if n and len(w) <= WORD_CHARS), default=0)

    def price(self, own: str) -> tuple[float, str, bool]:
        """Cost, reading, and whether that is another reading."""
        _, own_cost, fix, fix_cost = self.held.get(own, (0, 30.0, None, None))
        return (fix_cost, fix, True) if fix is not None and fix_cost < own_cost else (own_cost, own, False)

    def _common(self, own: str) -> float | None:
        n, cost, _, _ = self.held.get(own, (0, 0.0, None, None))
        return cost if n and cost < self.odd_from else None

    def _part(self, part: str) -> tuple[float, str, bool] | None:
        """A stretch of characters as a word of the block that is not odd, with at most one place undone."""
        cost = self._common(part)
        best = None if cost is None else (cost, part, False)
        for read, printed in _SIGNS:
            at = part.find(read)
            while at >= 0:
                made = part[:at] + printed + part[at + len(read) :]
                cost = self._common(made)
                if cost is not None and (best is None or cost + FIRST_MISREAD < best[0]):
                    best = (cost + FIRST_MISREAD, made, True)
                at = part.find(read, at + 1)
        return best

    def taken_apart(self, own: str) -> tuple[float, str, bool] | None:
        """The cheapest path over an odd word's characters by two words or more."""
        n, paths = len(own), {0: (0.0, (), False)}
        for end in range(LEAST_PART, n + 1):
            for start in range(max(0, end - self.longest), end - LEAST_PART + 1):
                before = paths.get(start)
                if before is None or (start == 0 and end == n):
                    continue
                part = self._part(own[start:end])
                if part is not None:
                    cost = before[0] + part[0] + (APART if start else 0.0)
                    if end not in paths or cost < paths[end][0]:
                        paths[end] = (cost, (*before[1], part[1]), before[2] or part[2])
        return (paths[n][0], " ".join(paths[n][1]), paths[n][2]) if n in paths else None

    def single(self, token: str) -> tuple[float, str | None, bool, bool]:
        """Cost of a token by itself, what it becomes if not itself, whether it was misread, and whether it is odd."""
        made = self.known.get(token)
        if made is None:
            own = word(token)
            if not own:
                made = (0.0, None, False, False)
            else:
                cost, reading, other = self.price(own)
                odd = own.isalpha() and cost >= self.odd_from and not other
                misread = other and " " not in reading
                if not other and cost >= self.odd_from and 2 * LEAST_PART <= len(own) <= WORD_CHARS:
                    apart = self.taken_apart(own)
                    if apart is not None and apart[0] < max(cost, ODD_CHARACTER * len(own)):
                        cost, reading, misread, other, odd = apart[0], apart[1], apart[2], True, False
                made = (cost, _shown(token, own, reading) if other else None, misread, odd)
            self.known[token] = made
        return made

    def _joined(self, left: str, right: str, mark: str) -> list[tuple[float, str, str, bool]]:
        """What may become of a hyphen between two parts: cost, ``joined`` or ``kept``, reading, misread. Left apart is a path of its own."""
        joined, kept = self.price(left + right), self.held.get(f"{left}-{right}", (0, 99.0, None, None))[1]
        apart = self.price(left)[0] + self.price(right)[0]
        if kept <= joined[0] + JOINT:
            return [(min(kept, apart - 1e-6), "kept", "", False)]
        # a soft hyphen stands only where a word was broken
        return [(min(joined[0] + JOINT, apart - 1e-6) if mark in _SOFT else joined[0] + JOINT, "joined", joined[1], joined[2])]

    def chain(self, out: list[list], at: list[tuple[int, int]], hyphens: dict[int, tuple[int, str, str, str]], kinds: set[str]) -> None:
        """Decode one chain of lines in place: tokens that went into others become None."""
        tokens = [out[i][j] for i, j in at]
        made = [self.single(t) for t in tokens]
        if not hyphens and not any(m[3] for m in made):
            for (i, j), (_, shown, misread, _) in zip(at, made, strict=True):
                if shown is not None:
                    out[i][j] = shown
                    if misread:
                        kinds.add("misread")
            return
        paths: list[tuple[float, int, tuple]] = [(0.0, -1, ())] + [(math.inf, -1, ())] * len(tokens)

        def step(start: int, end: int, cost: float, what: tuple) -> None:
            cost += paths[start][0]
            if cost < paths[end][0]:
                paths[end] = (cost, start, what)

        for k, token in enumerate(tokens):
            joint = hyphens.get(k)
            if joint is None:
                step(k, k + 1, made[k][0], ("single",))
            else:
                _, left, right, mark = joint
                step(k, k + 1, self.price(left)[0] if right else 0.0, ("end",))
                if right:
                    for cost, how, reading, misread in self._joined(left, right, mark):
                        step(k, k + 2, cost, (how, reading, misread))
            for size in range(2, min(MOST_PARTS, len(tokens) - k) + 1):
                if not any(m[3] for m in made[k : k + size]) or any(k + x in hyphens for x in range(size)):
                    continue
                whole = together(tokens[k : k + size])
                if whole and self.held.get(whole, (0,))[0] > 0:
                    cost, reading, other = self.price(whole)
                    step(k, k + size, cost + BLANK * (size - 1), ("blanks", reading, other and " " not in reading))
        k = len(tokens)
        while k:
            _, start, what = paths[k]
            (i, j), token = at[start], tokens[start]
            if what[0] == "single":
                if made[start][1] is not None:
                    out[i][j] = made[start][1]
                    if made[start][2]:
                        kinds.add("misread")
            elif what[0] == "end":
                _, left, right, mark = hyphens[start]
                if not right and (mark in _SOFT or self.price(left)[0] > self.once - 0.7):
                    kinds.add("hyphen")
                    out[i][j] = token
            else:
                tail, (a, b) = tokens[k - 1], at[k - 1]
                marks = tail[len(tail.rstrip(_STRIP)) :]
                if what[0] == "kept":
                    out[i][j] = token.rstrip(_HYPHENS) + "-" + tail
                else:
                    out[i][j] = _shown(token.rstrip(_HYPHENS), "", what[1]).rstrip(_STRIP) + marks
                    if what[0] == "joined":
                        kinds.add("hyphen")
                    if what[2]:
                        kinds.add("misread")
                for a, b in at[start + 1 : k]:
                    out[a][b] = None
            k = start

    def line(self, tokens: list, kinds: set[str]) -> bool:
        """Decode a line by itself, if no word in it is odd: then each word's own best reading is the path."""
        found = []
        for j, token in enumerate(tokens):
            if token in self.plain:
                continue
            made = self.single(token)
            if made[3]:
                return False
            if made[1] is not None:
                found.append((j, made))
            else:
                self.plain.add(token)
        for j, made in found:
            tokens[j] = made[1]
            if made[2]:
                kinds.add("misread")
        return True

    def row(self, text: str, of: range) -> tuple[list[str], set[str], list[bool]]:
        """Lines as read, the kinds found, and which lines are page numbers."""
        lines, kinds = text.split("\n"), set()
        page = [bool(line.strip()) and is_page_number(line, of) for line in lines]
        if any(page):
            kinds.add("page_no")
        joints = {i: joint for i, joint in _joints(lines, of).items() if not page[i]}
        out: list[list] = [line.split() for line in lines]
        done: set[int] = set()
        for i, tokens in enumerate(out):
            if page[i] or i in done:
                continue
            if i not in joints and self.line(tokens, kinds):
                continue
            at, hyphens, line = [], {}, i
            while line is not None:
                done.add(line)
                at += [(line, j) for j in range(len(out[line]))]
                joint, line = joints.get(line), None
                if joint is not None:
                    goes_on = joint[0] >= 0 and joint[0] not in done
                    hyphens[len(at) - 1] = joint if goes_on else (-1, joint[1], "", joint[3])
                    line = joint[0] if goes_on else None
            self.chain(out, at, hyphens, kinds)
        return [" ".join(t for t in tokens if t is not None) for tokens in out], kinds, page


def _bare(tokens: list[str], of: range) -> list[str]:
    """Without a page number at either end and what sets it apart."""
    while len(tokens) > 1 and (is_page_number(tokens[-1], of) or _PAGE_WORD.match(tokens[-1])):
        tokens = tokens[:-1]
    while len(tokens) > 1 and (is_page_number(tokens[0], of) or _PAGE_WORD.match(tokens[0])):
        tokens = tokens[1:]
    return tokens


def header_key(line: str, of: range, raw: str) -> str | None:
    """What is compared of a line that is set like a header; None for others. How it is set is seen in the raw line, where a misread capital is a sign."""
    if raw.lstrip()[:1].islower():
        return None
    tokens = raw.split()
    if len(tokens) > 1 and _PAGE_WORD.match(tokens[-1]) and not is_page_number(tokens[-2], of):
        return None  # a dash at the end that sets no page number apart: the line goes on
    tokens = _bare(tokens, of)
    text = " ".join(tokens)
    if len(text) < 4 or text[0].islower() or text[-1] in ".,;:–—" + _HYPHENS or sum(not t[0].islower() for t in tokens) < HEADER_CAPITALS * len(tokens):
        return None
    if sum(c.isalpha() for c in text) < 4:
        return None
    return "".join(c for c in "".join(_bare(line.split(), of)).lower() if c.isalnum()) or None


def _decode(rows: pa.Table, words: pa.Table) -> pa.Table:
    reader = Reader({w: own for w, *own in zip(*(words.column(c).to_pylist() for c in ("word", "n", "own_cost", "fix", "fix_cost")), strict=True)})
    made = []
    for i, file, page_range, number, text in zip(*(rows.column(c).to_pylist() for c in ("id", "file", "page_range", "batch", "text")), strict=True):
        of = pages(page_range, number)
        lines, kinds, page = reader.row(text, of) if text else ([], set(), [])
        keys = [None if p else header_key(line, of, raw) for line, p, raw in zip(lines, page, (text or "").split("\n"), strict=bool(lines))]
        made.append({"id": i, "file": file, "is_null": text is None, "kinds": sorted(kinds), "lines": lines, "page": page, "keys": keys})
    schema = pa.schema([("id", pa.int64()), ("file", pa.string()), ("is_null", pa.bool_()), ("kinds", pa.list_(pa.string())), ("lines", pa.list_(pa.string())), ("page", pa.list_(pa.bool_())), ("keys", pa.list_(pa.string()))])
    return pa.Table.from_pylist(made, schema=schema)


# ------------------------------------------------------------------------------------------------------------- the job


def file_key() -> F.Column:
    """A file's name, whatever its spelling."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace("source_file", r"\\", "/"))), r"^(\./)+", "")
    return F.regexp_replace(name, r"[\s_]+", "_")


def read_chunks(chunks: DataFrame) -> DataFrame:
    """``(id, file, is_null, kinds, lines, page, keys, headers)``: every row as read; ``headers`` are the keys that its file repeats."""
    source = chunks.select(F.col("chunk_index").cast("long"), file_key().alias("file"), F.col("page_range").cast("string"), F.col("batch_num").cast("int"), F.col("text").cast("string"))
    blocks = materialise(spread(source).mapInArrow(_blocks(BLOCK_CHARS), _BLOCKS), "scan-blocks")
    listed = blocks.where("words is not null").select(F.col("block").alias("owner"), F.explode(F.arrays_zip("words", "counts")).alias("w")).select("owner", F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    counts = materialise(listed.groupBy("word").agg(F.sum("k").alias("n")), "scan-words")
    best = listed.select("owner", "word").join(_best_readings(counts), "word").select("owner", "word", "n", "own_cost", "fix", "fix_cost")
    rows = blocks.where("words is null").select("block", "id", "file", "page_range", "batch", "text")
    shape = "id long, file string, is_null boolean, kinds array<string>, lines array<string>, page array<boolean>, keys array<string>"
    read = materialise(rows.groupBy("block").cogroup(best.groupBy("owner")).applyInArrow(_decode, shape), "scan-read")
    # distinct texts of a file that hold a key; the text itself stands for rows ingested twice
    held = read.select("file", F.xxhash64("lines").alias("t"), F.explode("keys").alias("key")).where("key is not null")
    again = held.groupBy("file", "key").agg(F.countDistinct("t").alias("n")).where(F.col("n") >= HEADER_TEXTS)
    found = read.select("id", "file", F.explode("keys").alias("key")).where("key is not null").join(again, ["file", "key"], "left_semi")
    by_row = found.groupBy("id").agg(F.collect_set("key").alias("headers"))
    return read.join(by_row, "id", "left")


def noise_kinds(chunks: DataFrame) -> DataFrame:
    """``(chunk_index, kind)`` for each kind of noise in each row."""
    read = read_chunks(chunks)
    kinds = F.when(F.size("headers") > 0, F.array_union("kinds", F.array(F.lit("header")))).otherwise(F.col("kinds"))
    return read.select(F.col("id").cast("int").alias("chunk_index"), F.explode(kinds).alias("kind")).distinct()


def paragraphs(lines: list[str]) -> list[str]:
    """The cheapest breaks between lines: a break should follow the end of a sentence and a blank line, and a joint not."""
    kept, blank_before, blank = [], [], False
    for line in lines:
        if line.strip():
            kept.append(line.strip())
            blank_before.append(blank)
        blank = not line.strip()
    if not kept:
        return []
    ends = [line[-1] in ".!?:।…" for line in kept]
    # lines that are joined although a blank line and a sentence's end stand between them: summed from the first line on
    inner = [0.0]
    for k in range(1, len(kept)):
        inner.append(inner[-1] + ((2.5 if ends[k - 1] else -0.5) if blank_before[k] else 0.0))
    length = [0]
    for line in kept:
        length.append(length[-1] + len(line) + 1)
    costs, back, entry = [0.0], [0], []
    best, first_short = (math.inf, 0), 0
    for i in range(1, len(kept) + 1):
        # a break before line i - 1, without what follows it
        j = i - 1
        entry.append(costs[j] - inner[j] + ((0.0 if blank_before[j] else 3.0) + (0.0 if ends[j - 1] else 2.5) + (1.5 if kept[j][0].islower() else 0.0) if j else 0.0))
        while length[i] - length[first_short] >= SHORT_PARAGRAPH and first_short < i:
            best = min(best, (entry[first_short], -first_short))
            first_short += 1
        # paragraphs under SHORT_PARAGRAPH characters cost more; only the last few breaks make such
        short = min(((entry[j] + 2.0, -j) for j in range(first_short, i)), default=(math.inf, 0))
        cost, j = min(best, short)
        costs.append(cost + inner[i - 1])
        back.append(-j)
    out, i = [], len(kept)
    while i:
        out.append(" ".join(kept[back[i] : i]))
        i = back[i]
    return out[::-1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for is_null, lines, page, keys, headers in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            names = set(headers or ())
            left = [line for line, p, key in zip(lines, page, keys, strict=True) if not p and key not in names] if not is_null else []
            texts.append(None if is_null else "\n\n".join(paragraphs(left)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["chunk_index", "text"])


def clean_texts(chunks: DataFrame) -> DataFrame:
    """``(chunk_index, text)``: every row's text in paragraphs, without what the scan put in."""
    return read_chunks(chunks).select("id", "is_null", "lines", "page", "keys", "headers").mapInArrow(_texts, "chunk_index long, text string")
