"""Ranked lexical search for many items at once, with shared work evaluated once.

All items of a block are evaluated together. Sets of terms that several items share are
mined first: terms that the same items hold the same number of times are one set, and sets
that stand side by side in several items (commonest first) are joined to larger ones, round
by round. They form a DAG whose leaves are terms. Tasks go through their documents in
batches; in a batch, every set of the DAG that an item needs is added up once, as a partial
accumulator ``documents, sums``, and items are sums of a few accumulators. A task keeps the
best documents of each item, so only those are shuffled, and no document is.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.shared import kept
from sourceloom.llm.words import LETTERS, slices, word_spans

# Distinct terms of items that are held together, on the driver and in a task.
BLOCK_TERMS = 1_000_000
BATCH_BYTES = 8 << 20
# A task's best documents are merged by so many tasks before one per item ranks them.
MERGERS = 64


def word_array(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts as one array, and where each text's words begin."""
    data, starts, ends, first = word_spans(column, LETTERS)
    places = np.empty(2 * len(starts) + 1, np.int64)
    places[:-1:2], places[1::2], places[-1] = starts, ends, len(data)
    # Every other element is what lies between two words.
    all_of = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])
    return all_of, first


def coded(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words that are terms: text and term; and the number of words of each text."""
    found, first = word_array(column)
    counts = np.diff(first)
    code = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy(zero_copy_only=False)[::2]
    at = np.flatnonzero(code >= 0)
    return np.repeat(np.arange(len(counts)), counts)[at], code[at].astype(np.int64), counts


@dataclass
class Plan:
    """``sets``: for each node, its members; nodes below ``leaves`` are (term, times in the
    item), members of others are nodes before them. ``items``: item number and its nodes."""

    terms: pa.Array
    leaves: list[tuple[int, int]]
    sets: list[list[int]]
    items: list[tuple[int, list[int]]]


def shared_sets(held: dict[int, list[tuple[int, int]]], terms: pa.Array) -> Plan:
    """The DAG over items given as lists of (term, times)."""
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for item in sorted(held):
        for leaf in held[item]:
            holders[leaf].append(item)
    leaves = sorted(holders)
    number = {leaf: k for k, leaf in enumerate(leaves)}
    sets: list[list[int]] = [[] for _ in leaves]
    same: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for leaf in leaves:
        same[tuple(holders[leaf])].append(number[leaf])
    lists: dict[int, list[int]] = {item: [] for item in held}
    for who in sorted(same, key=lambda who: (-len(who), who)):
        node = same[who][0]
        if len(same[who]) > 1:
            node = len(sets)
            sets.append(same[who])
        for item in who:
            lists[item].append(node)
    while True:
        seen = Counter(pair for nodes in lists.values() for pair in zip(nodes, nodes[1:], strict=False))
        joined: dict[tuple[int, int], int] = {}
        for item, nodes in lists.items():
            out, k = [], 0
            while k < len(nodes):
                pair = tuple(nodes[k : k + 2])
                if seen.get(pair, 0) < 2:
                    out.append(nodes[k])
                    k += 1
                    continue
                if pair not in joined:
                    joined[pair] = len(sets)
                    sets.append(list(pair))
                out.append(joined[pair])
                k += 2
            lists[item] = out
        if not joined:
            return Plan(terms, leaves, sets, sorted(lists.items()))


def counted(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """Per task: documents holding each term, at -1 documents with any word, at -2 words."""
    holding, documents, total = np.zeros(len(terms), np.int64), 0, 0
    for batch in slices(batches, "text", BATCH_BYTES):
        text, code, counts = coded(batch.column("text"), terms)
        holding += np.bincount(np.unique(code * len(counts) + text) // max(len(counts), 1), minlength=len(terms))
        documents += int((counts > 0).sum())
        total += int(counts.sum())
    code = np.flatnonzero(holding)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([code, [-1, -2]])), pa.array(np.concatenate([holding[code], [documents, total]]))], names=["code", "n"])


def accumulators(plan: Plan, text: np.ndarray, value: np.ndarray, first: np.ndarray, n_texts: int) -> Iterator[np.ndarray]:
    """The score of every text for one item after the other. ``text, value``: what each term
    adds to each text, by term; ``first``: where each term begins."""
    made: list[tuple[np.ndarray, np.ndarray]] = []
    row = np.zeros(n_texts, np.int64)

    def added(nodes: list[int]) -> None:
        for k in nodes:
            row[made[k][0]] += made[k][1]

    for node, members in enumerate(plan.sets):
        if node < len(plan.leaves):
            term, times = plan.leaves[node]
            part = slice(first[term], first[term + 1])
            made.append((text[part], value[part] * times))
            continue
        added(members)
        at = np.flatnonzero(row)
        made.append((at, row[at]))
        row[at] = 0
    for _, nodes in plan.items:
        added(nodes)
        yield row
        row[:] = 0


def best(batches: Iterator[pa.RecordBatch], plan: Plan, weight: np.ndarray, documents: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of a task for each item."""
    top = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in plan.items]
    for batch in slices(batches, "text", BATCH_BYTES):
        text, code, counts = coded(batch.column("text"), plan.terms)
        cell, times = np.unique(code * len(counts) + text, return_counts=True)
        code, text = np.divmod(cell, max(len(counts), 1))
        length = 75 + (25 * counts * documents) // max(total, 1)
        value = weight[code] * ((1_000_000_000 * times) // (1000 * times + 12 * length[text]))
        first = np.searchsorted(code, np.arange(len(plan.terms) + 1))
        missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
        for i, score in enumerate(accumulators(plan, text, value, first, len(counts))):
            held = top[i]
            least = max(1, int(held[0][k - 1])) if len(held[0]) >= k else 1
            new = np.flatnonzero(score >= least)
            if len(new) > 4 * k:  # all that tie with the last that counts stay for now
                new = new[score[new] >= np.partition(score[new], len(new) - k)[len(new) - k]]
            if len(new):
                both = [np.concatenate([a, b]) for a, b in zip(held, (score[new], ids[new], missing[new]), strict=True)]
                order = np.lexsort((both[1], both[2], -both[0]))[:k]
                top[i] = tuple(x[order] for x in both)
    size = [len(t[0]) for t in top]
    score, ids, missing = (np.concatenate([t[j] for t in top] or [np.empty(0)]) for j in range(3))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([i for i, _ in plan.items], size).astype(np.int64)), pa.array(ids.astype(np.int64), mask=missing.astype(bool)), pa.array(score.astype(np.int64))],
        names=["item", "doc_id", "score"],
    )


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        found, first = word_array(batch.column("text"))
        item = np.repeat(batch.column("item").to_numpy(), np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(item), found.take(pa.array(np.arange(0, len(found), 2))).cast(pa.binary())], names=["item", "term"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ranks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", "merger").orderBy(*order)
    found = found.withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    found = found.withColumn("place", F.row_number().over(some)).where(F.col("place") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest scores above 0 of ``docs`` (``doc_id, text``) for each of ``items``
    (``item_id, text``): ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z
    lower-cased, over whole texts. Equal scores rank by ascending ``doc_id``, null last. Every
    row of both tables stands for itself, so repeated documents take a place each, and
    repeated items (or items without id) get the same places each. Null and empty texts
    hold nothing and match nothing; items without terms get no rows. Whole texts are read
    in batches of ``BATCH_BYTES``, or one text if that is longer. Other columns are ignored,
    whatever their names. With an empty table on either side there are no rows.

    Items come in blocks with ``BLOCK_TERMS`` distinct terms (expected), each a pass for counts and
    one for scores; only a block's terms are on the driver and broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    items = kept(items)
    held = items.select("item", "text").mapInArrow(item_terms, "item bigint, term binary")
    held = kept(held.groupBy("item", "term").agg(F.count("*").alias("times")))
    n_blocks = -(-held.count() // BLOCK_TERMS)
    found = None
    for block in range(n_blocks):
        rows = held.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()
        terms = pa.array(sorted({r.term for r in rows}), pa.large_binary())
        code = {t: i for i, t in enumerate(terms.to_pylist())}
        lists: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r in rows:
            lists[r.item].append((code[r.term], r.times))
        shared = spark.sparkContext.broadcast(shared_sets(lists, terms))
        counts = docs.select("text").mapInArrow(lambda it, s=shared: counted(it, s.value.terms), "code bigint, n bigint")
        counts = kept(counts.groupBy("code").agg(F.sum("n").alias("n")))
        sums = {r.code: r.n for r in counts.where("code < 0").collect()}
        documents, total = sums.get(-1, 0), sums.get(-2, 0)
        rarity = F.floor(1000 * F.ln((2 * F.lit(documents) + 2) / (2 * F.col("n") + 1))).cast("bigint")
        weight = np.zeros(len(terms), np.int64)
        for r in counts.where("code >= 0").select("code", rarity.alias("w")).collect():
            weight[r.code] = r.w
        weights = spark.sparkContext.broadcast(weight)
        part = docs.mapInArrow(
            lambda it, s=shared, w=weights, d=documents, n=total: best(it, s.value, w.value, d, n, k), "item bigint, doc_id bigint, score bigint"
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    return ranked(found, k).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
