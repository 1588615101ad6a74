"""Cutting oversized texts at natural boundaries, by balanced targets.

The least number of pieces that the limit and the overlap allow is taken, cuts are aimed at equal distances, and each is
moved to the strongest boundary near its target: a blank line, the end of a sentence, a line, a clause, a word, a separating mark, and last
any place that does not part a letter from its marks. If a piece is over the limit then, one more piece is taken. Every
piece after the first repeats the last ``overlap`` characters before its own.

Defined results: white space of any kind at the ends of a text is left out first; a text that is not over the limit then
is one piece; null, empty and blank texts give no piece; lengths are in code points; ``chunk_length`` as stored is
ignored; repeated rows give their pieces each; other columns named in ``keep`` are repeated with each piece; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1_000
OVERLAP = 50

#: Boundaries, strongest first; a cut is at the end of the match.
_BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"[.!?।…][\"'”’)\]]*\s+|[.!?।](?=\S)(?<=।)", r"\n", r"[;:,—–]\s+", r"\s+", r"[|/\\]+", r"[_-]+")]


def _cut(text: str, target: int, low: int, high: int) -> int:
    """The place in ``low..high`` of the strongest boundary, the nearest to the target among equals."""
    for boundary in _BOUNDARIES:
        found = [m.end() for m in boundary.finditer(text, max(low - 3, 0), high) if low <= m.end() <= high]
        if found:
            return min(found, key=lambda at: (abs(at - target), at))
    at = target
    while at > low and unicodedata.category(text[at])[0] == "M":
        at -= 1
    return at


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece in ``text``, which has no white space at its ends."""
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    room = limit - overlap
    for count in range(-(-(size - overlap) // room), size + 1):
        step, cuts = (size - overlap) / count, [0]
        slack = max(1, int(step // 4))
        for i in range(1, count):
            target = overlap + round(i * step)
            reach = cuts[-1] + (limit if i == 1 else room)  # a cut beyond this makes the piece too long
            low = max(target - slack, cuts[-1] + 1)
            # what is left must fit into the pieces that are left
            low = max(low, size - (count - i) * room)
            high = min(target + slack, reach, size - 1)
            if low > high:
                break
            cuts.append(_cut(text, min(max(target, low), high), low, high))
        cuts.append(size)
        spans = [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        if len(spans) == count and all(b - a <= limit for a, b in spans):
            return spans
    raise ValueError("overlap must be less than limit")


def _rows(schema: pa.Schema, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, number, of, starts, texts = [], [], [], [], []
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                text = (raw or "").strip()
                begin = len(raw or "") - len((raw or "").lstrip())
                spans = split(text, limit, overlap)
                for n, (a, b) in enumerate(spans):
                    kept.append(i)
                    number.append(n)
                    of.append(len(spans))
                    starts.append(begin + a)
                    texts.append(text[a:b])
            columns = [c.take(pa.array(kept, pa.int64())) for c in batch.columns[:-1]]
            made = [pa.array(number, pa.int32()), pa.array(of, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema=schema)

    return run


def cut_texts(rows: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("chunk_index", "source_file", "page_range"), *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(*keep, piece_no, n_pieces, start, piece)`` of every row. Rows are cut where they lie; nothing is shuffled."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    from pyspark.sql.pandas.types import to_arrow_schema

    source = rows.select(*keep, F.col(text_column).cast("string").alias("_text"))
    shape = rows.sparkSession.createDataFrame([], rows.select(*keep).schema).select(*keep, F.lit(0).alias("piece_no"), F.lit(0).alias("n_pieces"), F.lit(0).alias("start"), F.lit("").alias("piece")).schema
    return source.mapInArrow(_rows(to_arrow_schema(shape), limit, overlap), shape)


def oversized_pieces(chunks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the rows over the limit. A text that is short with its white space is not sent to Python."""
    return cut_texts(chunks.where(F.length("text") > limit), limit=limit, overlap=overlap).where("n_pieces > 1")


def oversized_rows(chunks: DataFrame) -> DataFrame:
    """``(chunk_index)`` of the rows that are cut."""
    return oversized_pieces(chunks).where("piece_no = 0").select("chunk_index")
