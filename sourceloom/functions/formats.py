"""Display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.paths import as_col

# A word starts after anything in ASCII that is no letter, digit or underscore,
# and after any other Unicode space.
_WORD_START = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F\x{85}\p{Z}])"


def format_type(name: Column | str) -> Column:
    """Underscores to spaces and a capital at each word start; the rest is kept."""
    words = F.split(F.translate(as_col(name), "_", " "), _WORD_START)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""
    )


def format_date(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "MMMM d, yyyy")


def impact_class(impact: Column | str) -> Column:
    level = F.lower(as_col(impact))
    return (
        F.when(level == "high", "badge-danger")
        .when(level == "medium", "badge-warning")
        .when(level == "low", "badge-info")
        .otherwise("badge-secondary")
    )


def metric_band(value: Column | str) -> Column:
    v = as_col(value)
    return F.when(v >= 80, "high").when(v >= 60, "medium").otherwise("low")


def metric_text(value: Column | str) -> Column:
    """One decimal, ties to even on the exact binary value (``0.25`` gives ``0.2``)."""
    return F.call_function("format_number", as_col(value), F.lit("0.0"))
