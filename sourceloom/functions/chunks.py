"""Line-aligned chunks of a text, limited by bytes.

A chunk is the shortest run of whole lines holding at least ``max_bytes`` bytes, so
where a chunk starts depends on where the one before it ended. One lazy regular
expression says exactly that ("at least n-1 of anything, as few as possible, then a
line end"), and the JVM matcher walks the text once. To count bytes, not characters,
text with multi-byte characters is read as one character per byte; cuts fall on line
ends, so every piece decodes back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.paths import as_col

_BLOCK = 256


def _running(values: Column, start: Column) -> Column:
    """``[start, start+v1, start+v1+v2, ...]``."""
    return F.aggregate(
        values,
        F.array(start),
        lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)),
    )


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of a non-empty array, in blocks.

    Appending to an array copies it; summing per block first keeps the cost near
    linear for texts with very many chunks.
    """
    starts = F.sequence(F.lit(1), F.size(values), F.lit(_BLOCK))
    totals = F.transform(
        starts, lambda s: F.aggregate(F.slice(values, s, F.lit(_BLOCK)), F.lit(0), lambda a, v: a + v)
    )
    offsets = F.slice(_running(totals, F.lit(0)), F.lit(1), F.size(starts))
    return F.flatten(
        F.zip_with(
            starts,
            offsets,
            lambda s, o: F.slice(
                _running(F.slice(values, s, F.lit(_BLOCK)), o), F.lit(2), F.lit(_BLOCK)
            ),
        )
    )


def chunk_contents(text: Column | str, max_bytes: int) -> Column:
    """``array<string>``: the chunks in order; joined they equal text plus a line end."""
    t = as_col(text)
    pattern = F.lit(f"(?s).{{{max(max_bytes - 1, 0)},}}?\\n|.+")
    body = F.concat(t, F.lit("\n"))
    as_bytes = F.decode(F.encode(body, "UTF-8"), "ISO-8859-1")
    wide = F.transform(
        F.regexp_extract_all(as_bytes, pattern, F.lit(0)),
        lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"),
    )
    plain = F.regexp_extract_all(body, pattern, F.lit(0))
    return F.when(F.octet_length(t) == F.length(t), plain).otherwise(wide)


def line_count(chunk: Column) -> Column:
    return F.length(chunk) - F.length(F.translate(chunk, "\n", ""))
