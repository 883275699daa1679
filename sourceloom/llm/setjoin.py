"""Exact similarity join of documents as sets of word shingles, with set-relation skipping.

Equal sets are one node. A global order of shingles, rare ones first, comes from counters of
all documents, hashed to a fixed number (the order only has to be the same everywhere).
Similar sets share a shingle among the first few of that order (the prefix), so the index
has prefixes alone: lists of the sets that hold a shingle, with sizes and positions.
Lists with the same members are one list. Prefixes are deleted as soon as the lists are made of them.

A set's answers lead to those of sets much like it. First every list has one leader, whose
pairs with the members are verified; sets linked so far are related. Sets outside a list's
largest class are then compared with all of the list, in cells of bounded bytes. There the
list is cut into blocks by size and position that are skipped whole. Members of a class come
one after the other, and the overlaps of one with the list give bounds for the next, from
the shingles in which the two differ: most pairs are decided by the bounds, others by looking
up only those shingles. Only links between classes matter, so pairs of one class are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.components import components
from sourceloom.llm.near import shingle_sets
from sourceloom.llm.shared import dropped, kept
from sourceloom.llm.words import NON_SPACE, mix, slices, words

# Counters of shingles: 2**24 of them, and how many lie in a row.
COUNTER_BITS = 24
ROW_BITS = 16
# Tasks whose counters are added up together.
ADDED = 64
# Ids of documents are broadcast up to so many (16 MB), beyond that they are shuffled.
BROADCAST_ROWS = 1_000_000
# Shingles (8 bytes each) of either side of a cell, as expected.
CELL = 500_000
# Sets of either side of a cell, as expected.
CELL_SETS = 4_096
SKIP = 32
# Profiles of sets count their shingles by their first bits: at least and at most so many, else
# as many as make about two counters for each shingle.
LEAST_BITS, MOST_BITS = 8, 14


def counters(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents the shingles of each counter are (255: or more)."""
    counts = np.zeros(1 << COUNTER_BITS, np.uint8)
    for batch in slices(batches, "text"):
        value, _ = shingle_sets(words(batch.column("text"), NON_SPACE), size)
        which, n = np.unique(value >> np.uint64(64 - COUNTER_BITS), return_counts=True)
        counts[which] = np.minimum(counts[which] + n, 255)
    rows = counts.reshape(-1, 1 << ROW_BITS)
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[r].tobytes() for r in some], pa.binary())], names=["row", "counts"])


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """For each counter its count on a logarithmic scale of 256 steps."""
    added = docs.select("text").mapInArrow(lambda it: counters(it, size), "row int, counts binary")

    def total(kind: type, shown: Callable[[np.ndarray], np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def add(group: pd.DataFrame) -> pd.DataFrame:
            counts = np.zeros(1 << ROW_BITS, np.uint64)
            for c in group.counts:
                counts += np.frombuffer(c, kind)
            return pd.DataFrame({"row": group.row.iloc[:1], "counts": [shown(counts).tobytes()]})

        return add

    added = added.withColumn("part", F.call_function("div", F.spark_partition_id(), F.lit(ADDED)))
    added = added.groupBy("row", "part").applyInPandas(total(np.uint8, lambda counts: counts), "row int, counts binary")
    level = lambda counts: np.minimum(16 * np.log2(1 + counts), 255).astype(np.uint8)
    levels = added.groupBy("row").applyInPandas(total(np.uint64, level), "row int, counts binary")
    out = np.zeros((1 << (COUNTER_BITS - ROW_BITS), 1 << ROW_BITS), np.uint8)
    for r in levels.collect():  # 16 MB, whatever the input
        out[r.row] = np.frombuffer(r.counts, np.uint8)
    return out.reshape(-1)


def digests(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, whatever the order of its shingles."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's number of shingles, digest, and the rarest shingles that one of any
    set similar to it is among."""
    for batch in slices(batches, "text"):
        value, first = shingle_sets(words(batch.column("text"), NON_SPACE), size)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((value, level[value >> np.uint64(64 - COUNTER_BITS)], doc))
        length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
        chosen = order[(np.arange(len(value)) - first[:-1][doc]) < length[doc]]
        ends = np.concatenate([[0], np.cumsum(length)])
        hi, lo = digests(value, first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(hi), pa.array(lo),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[chosen].view(np.int64)))],
            names=["doc_id", "n", "hi", "lo", "prefix"],
        )


def hash_lists(value: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))


def profiles(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """How many shingles of each set have each value of their first bits."""
    n = np.diff(first)
    bits = np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))), LEAST_BITS, MOST_BITS).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    cell = np.repeat(begin[:-1], n) + (value >> np.repeat(64 - bits, n).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(cell, minlength=begin[-1]).astype(np.uint16)
    return pa.array([counts[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """A profile by fewer first bits."""
    return counts.reshape(width, -1).sum(axis=1, dtype=np.int64)


def at_most(a: bytes, b: bytes) -> int:
    """Two sets share no more shingles than the lesser counts of their profiles."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    width = min(len(x), len(y))
    return int(np.minimum(folded(x, width), folded(y, width)).sum())


def digested(batches: Iterator[pa.RecordBatch], size: int, of: Callable[[np.ndarray, np.ndarray], pa.Array], name: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        value, first = shingle_sets(words(batch.column("text"), NON_SPACE), size)
        hi, lo = digests(value, first)
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), of(value, first)], names=["hi", "lo", name])


def fetched(
    wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int,
    of: Callable[[np.ndarray, np.ndarray], pa.Array] = hash_lists, name: str = "hashes", kind: str = "array<bigint>",
) -> DataFrame:
    """``node`` and what ``of`` makes of its set, for the wanted nodes, of one document each: the
    ``hashes``, ascending as unsigned numbers. Documents are sought by id, then by digest, so
    rows that share an id (or have none) do."""
    wanted = kept(nodes.join(wanted, "node", "left_semi").select("node", "hi", "lo", F.col("rep").alias("wanted_id")))
    ids = wanted.select("wanted_id").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    found = texts.mapInArrow(lambda it: digested(it, size, of, name), f"hi bigint, lo bigint, {name} {kind}")
    out = kept(found.dropDuplicates(["hi", "lo"]).join(wanted, ["hi", "lo"]).select("node", name))
    dropped(docs.sparkSession, wanted)
    return out


def needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles two sets of these sizes must share."""
    return F.ceil(percent * (n_a + n_b) / (100 + percent))


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """In each list its members beside the leader, the one that is in most lists, where
    sizes and positions allow a link."""
    degrees = lists.groupBy("node").agg(F.count("*").alias("degree"))
    known = lists.join(degrees, "node")
    chosen = known.groupBy("token").agg(F.max_by(F.struct("node", "n", "at"), F.struct("degree", -F.col("node"))).alias("leader"))
    met = lists.join(chosen, "token").where(F.col("node") != F.col("leader.node"))
    n, at = F.col("leader.n"), F.col("leader.at")
    most = 1 + F.least("at", at) + F.least(F.col("n") - F.col("at") - 1, n - at - 1)
    fits = (100 * F.least("n", n) >= percent * F.greatest("n", n)) & (most >= needed(F.col("n"), n, percent))
    return met.where(fits).select(
        F.col("leader.node").alias("a"), F.col("node").alias("b"), n.alias("n_a"), F.col("n").alias("n_b")
    ).distinct()


def likely(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """Whether two profiles allow as many shared shingles as are needed."""
    return pd.Series([at_most(x, y) >= k for x, y, k in zip(a, b, need, strict=True)], dtype=bool)


def verified(pairs: DataFrame, known: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are similar: by profiles (``known``) first, then by the full sets."""
    side = lambda rows, x, column: rows.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}"))
    with_both = lambda rows, found, column: rows.join(side(found, "a", column), "a").join(side(found, "b", column), "b")
    may = F.pandas_udf(likely, "boolean")
    profiled = with_both(pairs, known, "profile")
    near = kept(profiled.where(may("profile_a", "profile_b", needed(F.col("n_a"), F.col("n_b"), percent))).select(*pairs.columns))
    involved = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = fetched(involved, nodes, docs, size)
    both = with_both(near, sets, "hashes")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    out = kept(both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))
    dropped(docs.sparkSession, near, sets)
    return out


def overlap(small: np.ndarray, large: np.ndarray) -> int:
    if len(small) > len(large):
        small, large = large, small
    if not len(small):
        return 0
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[place] == small).sum())


@dataclass
class Blocks:
    """One side of a cell, by size and position, cut into blocks of ``SKIP`` sets."""

    n: np.ndarray
    at: np.ndarray
    percent: int

    def __post_init__(self) -> None:
        starts = np.arange(0, len(self.n), SKIP)
        self.least_n, self.most_n = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
        self.most_at, self.most_rest = np.maximum.reduceat(self.at, starts), np.maximum.reduceat(self.n - self.at - 1, starts)

    def need(self, n: int, sizes: np.ndarray) -> np.ndarray:
        """How many shingles a set of ``n`` must share with sets of these sizes."""
        return -(-self.percent * (n + sizes) // (100 + self.percent))

    def allowed(self, n: int, at: int) -> np.ndarray:
        """Whether sizes and positions allow a link: of whole blocks first, then of their sets."""
        most = 1 + np.minimum(at, self.most_at) + np.minimum(n - at - 1, self.most_rest)
        fits = (100 * self.most_n >= self.percent * n) & (self.percent * self.least_n <= 100 * n) & (most >= self.need(n, self.least_n))
        out = np.repeat(fits, SKIP)[: len(self.n)]
        k = np.flatnonzero(out)
        size, place = self.n[k], self.at[k]
        most = 1 + np.minimum(at, place) + np.minimum(n - at - 1, size - place - 1)
        out[k] = (100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)) & (most >= self.need(n, size))
        return out


def by_cell(batches: Iterator[pd.DataFrame], of: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ``of`` makes of each cell; rows come in the order of cells."""
    open_ = None
    for batch in batches:
        rows = batch if open_ is None else pd.concat([open_, batch], ignore_index=True)
        if not len(rows):
            continue
        keys = [rows[c].to_numpy() for c in ("token", "i", "j")]
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        starts = np.concatenate([[0], edges])
        done = [of(rows.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if done:
            yield pd.concat(done, ignore_index=True)
        open_ = rows.iloc[starts[-1] :]
    if open_ is not None:
        yield of(open_)


def sides(group: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, Blocks]:
    """Rows of a cell inside, by size and position, and outside, one class after the other."""
    n, at, out = group.n.to_numpy(), group["at"].to_numpy(), group.outside.to_numpy(bool)
    inside, outside = np.flatnonzero(~out), np.flatnonzero(out)
    inside = inside[np.lexsort((at[inside], n[inside]))]
    outside = outside[np.lexsort((group.node.to_numpy()[outside], n[outside], group.component.to_numpy()[outside]))]
    return inside, outside, Blocks(n[inside], at[inside], percent)


def coarse(column: pd.Series) -> pd.Series:
    """Profiles by ``LEAST_BITS`` bits."""
    return column.map(lambda p: folded(np.frombuffer(p, np.uint16), 1 << LEAST_BITS).astype(np.uint16).tobytes())


def possible(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows of a cell that may have a link with a set of another class, by sizes, positions
    and profiles (coarse or fine)."""
    narrow = group.drop(columns="profile")
    if group.outside.all() or not group.outside.any():
        return narrow.iloc[:0]
    inside, outside, blocks = sides(group, percent)
    component, kept_rows = group.component.to_numpy(), np.zeros(len(group), bool)
    n, at = group.n.to_numpy(), group["at"].to_numpy()
    fine = list(group.profile)
    even = np.stack([folded(np.frombuffer(p, np.uint16), 1 << LEAST_BITS) for p in fine]).astype(np.int32)
    finer = np.array([len(p) for p in fine]) > 2 << LEAST_BITS
    for x in outside.tolist():
        k = inside[blocks.allowed(n[x], at[x])]
        k = k[component[k] != component[x]]
        k = k[np.minimum(even[k], even[x]).sum(axis=1) >= blocks.need(n[x], n[k])]
        if finer[x] and len(k):
            k = k[np.array([at_most(fine[z], fine[x]) >= blocks.need(n[x], n[z]) for z in k.tolist()], bool)]
        kept_rows[k] = True
        kept_rows[x] = len(k) > 0
    return narrow[kept_rows]


def compared(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of a cell that join its classes: of the sets outside with those inside."""
    if group.outside.all() or not group.outside.any():
        return []
    inside, outside, blocks = sides(group, percent)
    node, component, n, at = group.node.to_numpy(), group.component.to_numpy().copy(), group.n.to_numpy(), group["at"].to_numpy()
    sizes = blocks.n
    sets = [np.asarray(h).view(np.uint64) for h in group.hashes]
    links, base, family = [], None, component.copy()
    for x in outside.tolist():
        if base is not None and family[base] == family[x]:
            new = np.setdiff1d(sets[x], sets[base], assume_unique=True)
            gone = np.setdiff1d(sets[base], sets[x], assume_unique=True)
            low, high = np.maximum(low - len(gone), 0), np.minimum(high + len(new), np.minimum(sizes, n[x]))  # noqa: F821
            answers = known if len(new) + len(gone) < len(sets[x]) else np.full(len(inside), -1)  # noqa: F821
        else:
            low, high, answers = np.zeros(len(inside), np.int64), np.minimum(sizes, n[x]), np.full(len(inside), -1)
        base, known = x, np.full(len(inside), -1)
        need = blocks.need(n[x], sizes)
        for k in np.flatnonzero(blocks.allowed(n[x], at[x]) & (high >= need)).tolist():
            z = inside[k]
            if component[z] == component[x]:
                continue
            if low[k] < need[k]:
                if answers[k] >= 0:
                    known[k] = answers[k] + overlap(new, sets[z]) - overlap(gone, sets[z])
                else:
                    known[k] = overlap(sets[x], sets[z])
                low[k] = high[k] = known[k]
                if known[k] < need[k]:
                    continue
            links.append((min(node[x], node[z]), max(node[x], node[z])))
            component[component == component[z]] = component[x]
    return links


def remaining_links(
    lists: DataFrame, known: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int
) -> DataFrame | None:
    """Links between different classes of a list (``token, node, n, at, component``). Cells
    are dealt three times: with coarse profiles and then with fine ones (``known``) in place of the
    sets, to leave out rows without a possible partner, and the rest with their sets. What a
    step has read is deleted after it."""
    spark = docs.sparkSession
    classes = lists.groupBy("token", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    mixed = classes.groupBy("token").agg(
        F.max_by("component", F.struct("shingles", "component")).alias("top"), F.max_by("members", F.struct("shingles", "component")).alias("top_members"),
        F.max("shingles").alias("top_shingles"), F.sum("shingles").alias("shingles"), F.sum("members").alias("members"), F.count("*").alias("classes"),
    ).where("classes > 1")
    cells = lambda shingles, members: F.ceil(F.greatest(shingles / CELL, members / CELL_SETS)).cast("int")
    mixed = mixed.select(
        "token", "top", cells(F.col("shingles"), F.col("members")).alias("rows"),
        cells(F.col("shingles") - F.col("top_shingles"), F.col("members") - F.col("top_members")).alias("columns"),
    )
    own = kept(lists.join(mixed, "token"))
    if own.isEmpty():
        return None
    dealt = lambda count: F.pmod(F.xxhash64("node", F.lit(11)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    cell, columns = ["token", "i", "j"], ["token", "node", "component", "n", "at"]
    inside = own.select(*columns, dealt("rows").alias("i"), every("columns").alias("j"), F.lit(False).alias("outside"))
    outside = own.where("component <> top").select(*columns, every("rows").alias("i"), dealt("columns").alias("j"), F.lit(True).alias("outside"))
    together = lambda rows: rows.repartition(*cell).sortWithinPartitions(*cell)
    members, read = inside.unionByName(outside), own
    narrow = lambda it: by_cell(it, lambda group: possible(group, percent))
    rough = known.select("node", F.pandas_udf(coarse, "binary")("profile").alias("profile"))
    for profile in (rough, known):
        profiled = members.join(profile, "node")
        members = kept(together(profiled).mapInPandas(narrow, profiled.drop("profile").schema))
        dropped(spark, read)
        read = members
    if members.isEmpty():
        return None
    members = kept(one_of_alike(members, cell, ["node", "outside"]))
    dropped(spark, read)
    sets = fetched(members.select("node").distinct(), nodes, docs, size)
    held = members.join(sets, "node")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(compared(group, percent), columns=["a", "b"], dtype="int64")

    out = kept(together(held).mapInPandas(lambda it: by_cell(it, links), "a bigint, b bigint").distinct())
    dropped(spark, members, sets)
    return out


def one_of_alike(rows: DataFrame, group: list[str], member: list[str]) -> DataFrame:
    """The rows of one of all groups that have the same members, by 128 bits of hash."""
    mixed = lambda k: F.bit_xor(F.xxhash64(*member, F.lit(k)))
    digest = rows.groupBy(*group).agg(F.count("*").alias("members"), mixed(1).alias("x"), mixed(2).alias("y"))
    chosen = digest.groupBy("members", "x", "y").agg(F.min(F.struct(*group)).alias("chosen")).select("chosen.*")
    return rows.join(chosen, group, "left_semi")


def shared_lists(nodes: DataFrame) -> DataFrame:
    """``token, node, n, at`` of the lists with several members, one of those with the same ones."""
    postings = nodes.select("node", F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    lists = kept(postings.join(shared, "token", "left_semi").join(nodes.select("node", "n"), "node"))
    out = kept(one_of_alike(lists, ["token"], ["node"]))
    dropped(nodes.sparkSession, lists)
    return out


def linked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents (``doc_id, text``) linked by ``100 * intersection >= percent *
    union`` of their sets of ``size``-word shingles (A-Z lower-cased, words without ASCII
    white space; of fewer words than ``size`` the whole text is one shingle).

    One row per input row: ``doc_id, n_shingles, component_id``, the smallest id reachable.
    No link is missed: shingles are compared as 64-bit hashes, but for that the join is exact.
    Null and empty texts and texts without words are linked with nothing and have their own
    id. Rows that share an id or have none are told apart by their sets; a null id
    is the smallest only of a class that has no other. Ties need no rule. A very long text
    is held by one task with its set (8 bytes a shingle). Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    level = spark.sparkContext.broadcast(rarity(docs, size))
    dropped(spark)
    schema = "doc_id bigint, n bigint, hi bigint, lo bigint, prefix array<bigint>"
    found = kept(docs.mapInArrow(lambda it: prefixes(it, size, percent, level.value), schema))
    some = found.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    with_prefix = kept(some.withColumn("node", F.monotonically_increasing_id()))
    rows = kept(found.drop("prefix"))
    dropped(spark, found)
    lists = shared_lists(with_prefix)
    nodes = kept(with_prefix.drop("prefix"))
    dropped(spark, with_prefix)
    known = fetched(lists.select("node").distinct(), nodes, docs, size, profiles, "profile", "binary")
    pairs = kept(leader_pairs(lists, percent))
    edges = verified(pairs, known, nodes, docs, size, percent)
    linked_nodes = kept(components(edges))
    classed = lists.join(linked_nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = remaining_links(classed, known, nodes, docs, size, percent)
    dropped(spark, pairs, lists, known)
    if more is not None and not more.isEmpty():
        linked_nodes = kept(components(edges.unionByName(more)))
    classes = linked_nodes.join(nodes.select("node", "hi", "lo", "rep"), "node")
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "component").select("hi", "lo", "component_id")
    rows = rows.join(nodes.select("hi", "lo", "rep"), ["hi", "lo"], "left").join(classes, ["hi", "lo"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
