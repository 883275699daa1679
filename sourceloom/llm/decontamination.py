"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item (all words of a shorter item). Seen as
a set, it holds its shingles of ``shingle`` words. A document contains a window only if it
contains all its shingles, so for full containment the necessary prefix is one shingle: the
rarest, by counts over the whole corpus. Documents meet windows on that prefix token alone.
The token's place gives the only possible place of the window in the document (positional
bound), which must lie inside the document (length bound); there all words are compared.

The benchmark is the small side by role, but nothing relies on it: its windows are dealt
into blocks of at most about ``BLOCK_WINDOWS`` windows, each block is broadcast by itself,
and documents pass one block after the other. There is no shuffle of documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.words import BASE, LETTERS, Words, mix, shingles, slices, words

BLOCK_WINDOWS = 200_000

SHINGLES = "item_id bigint, width int, words binary, whole bigint, size int, at int, token bigint"
FOUND = "array<struct<first:bigint,last:bigint>>"


def item_shingles(batches: Iterator[pa.RecordBatch], window: int, shingle: int, unnamed: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 256 << 10):
        found = words(batch.column("text"), LETTERS)
        ids = batch.column("item_id").to_pylist()
        rows = []
        for i, n in enumerate(found.counts):
            if not n or (ids[i] is None and not unnamed):
                continue
            own = batch.slice(i, 1).column("text")
            item = words(own, LETTERS)
            width = min(int(n), window)
            size = min(width, shingle)
            whole, _ = shingles(item, width)
            tokens, _ = shingles(item, size)
            for start in range(int(n) - width + 1):
                text = item.text(start, start + width)
                for at in range(width - size + 1):
                    rows.append((ids[i], width, text, whole[start].view(np.int64), size, at, tokens[start + at].view(np.int64)))
        if rows:
            names = [x.split()[0] for x in SHINGLES.split(", ")]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


class Lookup:
    """Sorted tokens with a bitmap in front, so that most misses cost one byte read."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.bits = np.uint64(64 - max(10, int(np.ceil(np.log2(max(1, len(tokens)) * 32)))))
        self.bitmap = np.zeros(1 << (64 - int(self.bits)), bool)
        self.bitmap[(mix(tokens) >> self.bits).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the values that are tokens, and those tokens' indices."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.flatnonzero(self.bitmap[(mix(values) >> self.bits).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.tokens, values[near]), len(self.tokens) - 1)
        same = self.tokens[at] == values[near]
        return near[same], at[same]


def count_tokens(batches: Iterator[pa.RecordBatch], tokens: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    lookup, counts = Lookup(tokens), np.zeros(len(tokens), np.int64)
    for batch in slices(batches, "text"):
        found = words(batch.column("text"), LETTERS)
        for size in sizes:
            values, _ = shingles(found, size)
            _, at = lookup.find(values)
            counts += np.bincount(at, minlength=len(tokens))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(tokens[seen].view(np.int64)), pa.array(counts[seen])], names=["token", "n"])


class Windows:
    """The windows of one block, by prefix token."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.assign(token=rows.token.to_numpy(np.int64).view(np.uint64)).sort_values("token", kind="stable")
        self.lookup = Lookup(np.unique(rows.token.to_numpy(np.uint64)))
        self.begin = np.searchsorted(rows.token.to_numpy(np.uint64), np.append(self.lookup.tokens, np.uint64(0)), "left")
        self.begin[-1] = len(rows)
        self.at, self.width = rows["at"].to_numpy(np.int64), rows["width"].to_numpy(np.int64)
        self.whole = rows.whole.to_numpy(np.int64).view(np.uint64)
        self.words, self.items = list(rows.words), list(rows["items"])
        self.sizes = sorted(set(rows["size"].astype(int)))

    def matches(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and window numbers of all occurrences."""
        doc, starts, numbers = found.doc, [], []
        for size in self.sizes:
            values, place = shingles(found, size)
            hit, token = self.lookup.find(values)
            n = self.begin[token + 1] - self.begin[token]
            number = np.repeat(self.begin[token], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(place[hit], n)
            start = where - self.at[number]
            last = start + self.width[number] - 1
            good = (start >= 0) & (last < len(doc))
            start, last, number, where = start[good], last[good], number[good], where[good]
            good = (doc[start] == doc[where]) & (doc[last] == doc[where])
            starts.append(start[good])
            numbers.append(number[good])
        start, number = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, numbers))
        same = np.zeros(len(start), bool)
        for width in np.unique(self.width[number]):
            values, place = shingles(found, int(width))
            own = np.flatnonzero(self.width[number] == width)
            at = np.searchsorted(place, start[own])
            same[own] = values[at] == self.whole[number[own]]
        start, number = start[same], number[same]
        known: dict[tuple[int, bytes], bool] = {}
        for i, (s, k) in enumerate(zip(start.tolist(), number.tolist(), strict=True)):
            raw = found.data[found.starts[s] : found.ends[s + self.width[k] - 1]].tobytes()
            if (k, raw) not in known:
                known[k, raw] = found.text(s, s + int(self.width[k])) == self.words[k]
            same[i] = known[k, raw]
        same = same[: len(start)]
        return start[same], number[same]


def match(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = words(batch.column("text"), LETTERS)
        start, number = windows.matches(found)
        order = np.argsort(start, kind="stable")
        start, number = start[order], number[order]
        runs = [r or [] for r in batch.column("runs").to_pylist()]
        items = [r or [] for r in batch.column("items").to_pylist()]
        bounds = np.searchsorted(start, found.first)
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[d], bounds[d + 1]
            runs[d] = merged(runs[d], start[a:b] - found.first[d], windows.width[number[a:b]])
            own = {*items[d], *(x["item_id"] for k in set(number[a:b].tolist()) for x in windows.items[k])}
            items[d] = sorted(own - {None}) + [None] * (None in own)
        columns = {n: batch.column(n) for n in batch.schema.names}
        columns["n_words"] = pa.array(found.counts, pa.int64())
        columns["runs"] = pa.array(runs, batch.schema.field("runs").type)
        columns["items"] = pa.array(items, batch.schema.field("items").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def merged(runs: list[dict], starts: np.ndarray, widths: np.ndarray) -> list[dict]:
    """Runs of hit words, joined where they touch; ``last`` is inclusive."""
    spans = [(r["first"], r["last"] + 1) for r in runs]
    spans += zip(starts.tolist(), (starts + widths).tolist(), strict=True)
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b - 1} for a, b in out]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 5,
    block_windows: int = BLOCK_WINDOWS,
    carry: Sequence[str] = (),
    unnamed: bool = False,
) -> DataFrame:
    """Which words of each document (``doc_id``, ``text``) belong to a benchmark item
    (``item_id``, ``text``).

    One row per input row: ``row, n_words, runs, items``; ``row`` is a struct of ``doc_id`` and
    the columns named in ``carry``. ``runs`` are the maximal runs of
    hit words by index, ``items`` the ids of items with an occurring window, ascending.

    Null and empty texts have no words, so nothing is hit; an item without words
    matches nothing, nor does one without an id, unless ``unnamed`` is set: then its windows hit
    words, and all such items count as one null at the end of ``items``. Repeated documents and equal ids are judged row by row. Repeated
    items count once per id. Other columns are ignored, whatever their names. An empty
    benchmark hits nothing.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    shingled = items.mapInArrow(lambda it: item_shingles(it, window, shingle, unnamed), SHINGLES)
    row = F.struct("doc_id", *(f"`{c}`" for c in carry if c != "doc_id"))
    texts = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    n, sizes = shingled.agg(F.count_if(F.col("at") == 0), F.collect_set("size")).first()
    blocks = max(1, -(-n // block_windows))
    block = F.pmod(F.xxhash64("words"), F.lit(blocks))
    out = texts.withColumns({"n_words": F.lit(0).cast("bigint"), "runs": F.lit(None).cast(FOUND), "items": F.lit(None).cast("array<bigint>")})
    for b in range(blocks):
        own = shingled.where(block == b)
        tokens = own.select("token").distinct().toPandas().token.to_numpy(np.int64).view(np.uint64)
        tokens = np.sort(tokens)
        counts = (
            texts.select("text")
            .mapInArrow(lambda it, t=tokens: count_tokens(it, t, sizes), "token bigint, n bigint")
            .groupBy("token").agg(F.sum("n").alias("n"))
        )
        rarest = F.min_by(F.struct("size", "at", "token"), F.struct(F.coalesce("n", F.lit(0)), "token", "at"))
        windows = (
            own.join(counts, "token", "left")
            .groupBy("words", "width", "whole")
            .agg(rarest.alias("prefix"), F.collect_set(F.struct("item_id")).alias("items"))
            .select("words", "width", "whole", "items", "prefix.*")
            .toPandas()
        )
        held = docs.sparkSession.sparkContext.broadcast(Windows(windows))
        out = out.mapInArrow(lambda it, w=held: match(it, w.value), out.schema)
    return out.select("row", "n_words", F.coalesce("runs", F.array().cast(FOUND)).alias("runs"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
