"""Relation labels and the key of a reference edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.paths import as_col

# Relation label -> normalised type, in the order partial matches are tried.
RELATION_TYPES = {
    "instantiation": "creates",
    "instantiates": "creates",
    "usage": "uses",
    "uses": "uses",
    "method call": "calls",
    "method invocation": "calls",
    "invokes": "calls",
    "calls": "calls",
    "containment": "contains",
    "method-of": "belongs-to",
    "method-to-struct": "belongs-to",
    "method-belongs-to": "belongs-to",
    "method-belongs-to-struct": "belongs-to",
    "association": "relates",
    "has-method": "defines",
    "defines method": "defines",
    "implements": "implements",
}

# White space trimmed from both ends of a label (Unicode White_Space).
LABEL_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def relation_type(label: Column | str) -> Column:
    """Exact label first, then the first known label contained in it, else itself."""
    text = F.btrim(F.lower(as_col(label)), F.lit(LABEL_SPACE))
    known = F.create_map(*[F.lit(x) for pair in RELATION_TYPES.items() for x in pair])
    partial = F.coalesce(
        *[F.when(F.contains(text, F.lit(k)), v) for k, v in RELATION_TYPES.items()]
    )
    return F.coalesce(F.try_element_at(known, text), partial, text)


def edge_key(source: Column | str, target: Column | str, normalised: Column | str) -> Column:
    """32 hex characters over ``source:target:type``; the type is already normalised."""
    joined = F.concat(as_col(source), F.lit(":"), as_col(target), F.lit(":"), as_col(normalised))
    return F.substring(F.sha2(joined, 256), 1, 32)
