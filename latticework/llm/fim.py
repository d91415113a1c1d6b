"""Fill-in-the-middle: texts cut at two units and put in another order, by two passes of a lazy matcher.

A unit is a match of a regular expression, taken from left to right. The first pass runs the matches
through and keeps nothing but their number; two ranks are drawn from it; the second pass advances a
fresh iterator to the smaller rank and on to the larger one, and reads the place where it stands. No
list of units or of their places exists at any time, so beside the text and its output a task holds one
match, however long the text is.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: the number of matches; of them only the last is held."""
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends_of(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the unit of rank ``first`` ends, and that of rank ``second`` (not smaller); rank 0 ends at 0."""
    matches, place, found = unit.finditer(text), 0, []
    for steps in (first, second - first):
        if steps:
            place = next(islice(matches, steps - 1, None)).end()
        found.append(place)
    return found[0], found[1]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on the id and the seed alone, so that a task run again draws the same."""
    name = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, unit: re.Pattern, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    n, (h1, h2, h3, h4) = count_units(unit, text), draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = ends_of(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(
    df: DataFrame, unit: str = CODE_POINT, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of ``df``.

    The prefix ends after the smaller of two ranks drawn from the id, the middle after the larger one. Text that no
    unit covers goes with the unit after it, and behind the last unit it belongs to the suffix. ``form`` is plain, psm or spm: a text that is empty or holds a mark stays plain, and so do
    100 - ``fim_percent`` of a hundred others; of the rest ``spm_percent`` are put as suffix, prefix, middle. ``n`` counts units,
    the lengths count code points and are null for plain texts.

    A null text is empty. A null id draws as the empty string does; equal ids draw equally, so repeated rows give repeated
    results. An empty table gives no row. Other columns of ``df`` are not read, whatever their names. Texts are read
    whole, one at a time; there is no shuffle.
    """
    pattern = re.compile(unit)
    if pattern.match(""):
        raise ValueError("a unit may not be empty")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator) -> Iterator:
        for part in pieces(batches, n_bytes=1 << 23):
            ids, found = part.column("doc_id"), part.column("text")
            rows = [(ids[k].as_py(), *transformed(found[k].as_py() or "", ids[k].as_py(), pattern, seed, fim_percent, spm_percent)) for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Each mark stands once in it, as texts that hold one stay plain."""
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: DuckDB's substring and length count code points, as the query's unit does.
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, length(t) AS n, {', '.join(f"CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || substring(t, 1, a) || '{SUFFIX}' || substring(t, b + 1) || '{MIDDLE}' || substring(t, a + 1, b - a)
  ELSE '{SUFFIX}' || substring(t, b + 1) || '{PREFIX}' || substring(t, 1, a) || '{MIDDLE}' || substring(t, a + 1, b - a) END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM c"""
