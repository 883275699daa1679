"""Token counts per section: documents are encoded whole, once, and tokens are joined to
sections by their character spans.

A section is a line with its line end. A byte-level token covers the characters that any
of its bytes belongs to. A token inside a section counts for it. A token over a boundary
counts for the section that holds most of its characters, and of equal ones for the first,
so the sections' counts always add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.words import slices

COUNTED = "n_tokens bigint, sections array<struct<section:bigint,first:bigint,last:bigint,n_tokens:bigint>>"

_encodings: dict[tuple[int, str], tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ``base64-token rank`` lines; made once per process."""
    key = (hash(ranks), pattern)
    if key not in _encodings:
        table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def spans(text: str, tokens: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of each token."""
    ends = np.cumsum(length[tokens])
    starts = ends - length[tokens]
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=upto[1:])  # characters begun before a byte
    whole = np.append((data & 0xC0) != 0x80, True)
    return upto[starts] - ~whole[starts], upto[ends]


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, n_chars: int) -> np.ndarray:
    """Section of each token: interval join of ``[first, last)`` with sections that start at
    ``begins`` (ascending, from 0) and end at ``n_chars``."""
    own = np.searchsorted(begins, first, "right") - 1
    end = np.searchsorted(begins, last - 1, "right") - 1
    bounds = np.append(begins, n_chars)
    for t in np.flatnonzero(own != end).tolist():
        parts = np.arange(own[t], end[t] + 1)
        overlap = np.minimum(bounds[parts + 1], last[t]) - np.maximum(bounds[parts], first[t])
        own[t] = parts[np.argmax(overlap)]
    return own


def count_batches(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str, schema: pa.DataType) -> Iterator[pa.RecordBatch]:
    coder = encoding(ranks, pattern)
    length = np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)], np.int64)
    for batch in slices(batches, "text", 8 << 20):
        totals, sections = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            tokens = np.array(coder.encode_ordinary(text), np.int64)
            begins = np.flatnonzero(np.array([c == "\n" for c in text[:-1]], bool)) + 1 if "\n" in text[:-1] else np.empty(0, np.int64)
            begins = np.concatenate([[0], begins]).astype(np.int64)
            n = np.bincount(attribute(*spans(text, tokens, length), begins, len(text)), minlength=len(begins)) if len(tokens) else np.zeros(len(begins), np.int64)
            ends = np.append(begins[1:], len(text))
            totals.append(len(tokens))
            sections.append([{"section": i, "first": a, "last": b, "n_tokens": k} for i, (a, b, k) in enumerate(zip(begins.tolist(), ends.tolist(), n.tolist(), strict=True))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(sections, schema)], names=["doc_id", "n_tokens", "sections"])


def section_tokens(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Token counts of every document (``doc_id``, ``text``) and of each of its lines.

    One row per input row: ``doc_id, n_tokens, sections``; a section is its number from 0,
    its first and last-plus-one character, and its tokens. Null and empty texts have one
    empty section and no token. Repeated rows give repeated results. Other columns are
    ignored. ``ranks_file`` is read by the driver and broadcast (a vocabulary is bounded).
    """
    with open(ranks_file, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("section", "first", "last", "n_tokens")]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda it: count_batches(it, held.value, pattern, kind), f"doc_id bigint, {COUNTED}")
