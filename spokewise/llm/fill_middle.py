"""Fill-in-the-middle training texts, cut by two lazy passes of a matcher.

A text is a sequence of units, the matches of a pattern. The first pass only counts them; the second advances a
fresh iterator of matches to the two ranks at which the text is cut, and stops there. No list of units or of
their places exists at any time, so beyond the text itself the memory is the same for every length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: One code point, line ends included.
CODE_POINT = r"(?s:.)"
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: the number of matches."""
    n = count()
    deque(zip(unit.finditer(text) if text else (), n), maxlen=0)
    return next(n)


def cut_places(unit: re.Pattern, text: str, first: int, last: int) -> tuple[int, int]:
    """Second pass: where the units of ranks ``first`` <= ``last`` end; rank 0 is the start of the text."""
    matches = unit.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, last - first - 1, None)).end() if last > first else a
    return a, b


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that no cut can make or hide: each opens with a letter that stands nowhere else in any of them."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    if any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("a sentinel's first letter may not stand within a sentinel")
    return sentinels


def fill_middle(docs: DataFrame, unit: str = CODE_POINT, plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: each whole text cut in three and put in another order.

    ``h1`` to ``h4``: the first four groups of eight digits of the hex SHA-256 of ``1:`` and the id. The prefix ends
    after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` of the text's ``n`` units, the middle after the
    larger one; what matches no unit goes with the unit after it, or with the suffix. ``form``: ``plain`` (the text
    as it is) if it is empty or holds a sentinel, or if ``h3 % 100 >= plain_from``; else ``spm`` (suffix, prefix,
    middle) if ``h4 % 100 < spm_below``, else ``psm``. Lengths are in code points, null where plain.

    One row for each row (repeated ones alike); a null text counts as empty, a null id as no digits; an empty table
    gives no rows; other columns are not read. No shuffle; a worker holds one slice of texts.
    """
    marks = checked(sentinels)
    pattern = re.compile(unit)

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in text_slices(batches, "text"):
            rows = [one(*r) for r in zip(*(b.column(c).to_pylist() for c in ("text", "plain", "spm", "h1", "h2")))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))], names)

    def one(text: str | None, plain: bool, spm: bool, h1: int, h2: int) -> tuple:
        text = text or ""
        n = count_units(pattern, text)
        if plain or not text or any(m in text for m in marks):
            return n, "plain", None, None, text
        a, b = cut_places(pattern, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
        p, s, m = marks
        if spm:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (h[2] % 100 >= plain_from).alias("plain"), (h[3] % 100 < spm_below).alias("spm"), h[0].alias("h1"), h[1].alias("h2"))
    return rows.mapInArrow(formed, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a form's output was made of, from these two alone; null where either is."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = checked(sentinels)
    # the parts hold no sentinel, so three cuts find all of them
    parts = F.split(output, "|".join(map(re.escape, (p, s, m))), -1)
    put = lambda *at: F.concat(*(F.element_at(parts, k + 1) for k in at))
    return F.when(form == "psm", put(1, 3, 2)).when(form == "spm", put(2, 3, 1)).otherwise(F.when(form.isNotNull(), output))
