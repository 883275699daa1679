"""MinHash near-dedup with HyperMinHash registers.

Documents are sets of word shingles. One hash function deals shingles to ``BUCKETS``
buckets; of the smallest value in a bucket the register keeps the leading zeros and the
``MANTISSA`` bits after the first one, 16 bits in all. Registers are banded; an empty
bucket borrows from another by a fixed order, which keeps the chance that two documents
agree at their similarity, also for tiny sets. Documents that share a band are candidates;
the collision-corrected estimate and the sizes drop most false ones, and the rest is
confirmed on the full sets of 64-bit shingle hashes.

Equal sets are one node from the start. In a band, all nodes are compared with one leader,
not with each other. Where that leaves several components in a band, the nodes outside its
largest one are compared with all others, in blocks of ``BLOCK`` by ``BLOCK`` nodes, so no
component is missed and no task holds a whole band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.components import components
from sourceloom.llm.shared import kept
from sourceloom.llm.words import NON_SPACE, Words, mix, shingles, slices, words

BANDS, ROWS = 32, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
BLOCK = 256
SIGMAS = 5
# Fixed value: expected share of accidental collisions of HyperMinHash registers.
COLLISIONS = 0.169919487159739093975315012348


def shingle_sets(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, ascending in each, and where each begins.
    A document with fewer words than ``size``, but not none, has all of them as one."""
    value, at = shingles(found, size)
    doc = found.doc[at]
    for d in np.flatnonzero((found.counts > 0) & (found.counts < size)).tolist():
        whole = Words(found.data, found.starts[found.first[d] : found.first[d + 1]], found.ends[found.first[d] : found.first[d + 1]],
                      np.array([0, found.counts[d]]), found.hash[found.first[d] : found.first[d + 1]])
        value, doc = np.append(value, shingles(whole, int(found.counts[d]))[0]), np.append(doc, d)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(found.first)))


def registers(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents by buckets: 0 if empty, else leading zeros plus one, then the mantissa."""
    out = np.zeros((len(first) - 1, BUCKETS), np.uint16)
    value = mix(value)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bucket = ((value >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    rest = mix(value) | np.uint64(1)
    cell = doc * BUCKETS + bucket.astype(np.int64)
    order = np.lexsort((rest, cell))
    cell, rest = cell[order], rest[order]
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    cell, least = cell[lead], rest[lead]
    bits = np.floor(np.log2(least.astype(np.float64) + 0.5)).astype(np.int64)
    bits -= (np.uint64(1) << np.clip(bits, 0, 63).astype(np.uint64)) > least  # rounding of large values
    zeros = 63 - bits
    below = np.where(zeros < 63, least << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0))
    out.reshape(-1)[cell] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | (below >> np.uint64(64 - MANTISSA))
    return out


PROBES = (mix(np.arange(BUCKETS * 64, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, 64)


def filled(held: np.ndarray) -> np.ndarray:
    """Registers with empty buckets borrowing from the first filled one of their probes."""
    out = held.copy()
    row, column = np.nonzero(held == 0)
    for k in range(PROBES.shape[1] + BUCKETS):
        if not len(row):
            break
        source = PROBES[column, k] if k < PROBES.shape[1] else (column + k) % BUCKETS
        got = held[row, source]
        out[row, column] = got
        row, column = row[got == 0], column[got == 0]
    return out


def band_keys(held: np.ndarray) -> np.ndarray:
    parts = filled(held).astype(np.uint64).reshape(len(held), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(held), 1))
    for i in range(ROWS):
        key = mix(key * np.uint64(1 << 16 | 1) + parts[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of register rows, and how many buckets it rests on."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    load_a, load_b = n_a / BUCKETS, n_b / BUCKETS
    low, high = np.minimum(load_a, load_b), np.maximum(load_a, load_b)
    by_chance = COLLISIONS * BUCKETS / 2**MANTISSA * 4 * high / (1 + high) ** 2 * (low / np.maximum(high, 1e-9))
    return (same - by_chance) / np.maximum(used, 1), used


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that the sizes allow and whose estimate is not ``SIGMAS`` deviations too low."""
    share = percent / 100
    guess, used = estimate(a, b, n_a, n_b)
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (guess >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(used, 1)))


def as_rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), BUCKETS)


def sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        value, first = shingle_sets(words(batch.column("text"), NON_SPACE), size)
        held = registers(value, first)
        n = np.diff(first)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
        digest = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([r.tobytes() for r in held], pa.binary())],
            names=["doc_id", "n", "digest", "registers"],
        )


def sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        value, first = shingle_sets(words(batch.column("text"), NON_SPACE), size)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(k)), dtype=np.uint64)]) for k in (1, 2)]
        digest = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in digest], pa.binary()), lists], names=["digest", "hashes"])


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, hashes`` (ascending) of the wanted nodes, from one document of each. Documents
    are sought by id, null like any other, and told apart by the digest of their set."""
    asked = nodes.join(wanted, "node", "left_semi").select("node", "digest", "rep")
    ids = asked.select(F.col("rep").alias("asked_id")).distinct()
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi").select("text")
    found = texts.mapInArrow(lambda it: sets(it, size), "digest binary, hashes array<bigint>")
    return kept(found.dropDuplicates(["digest"]).join(asked, "digest").select("node", "hashes"))


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes that are similar enough by their full sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"))
    passes = F.pandas_udf(
        lambda ra, rb, na, nb: pd.Series(likely(as_rows(ra), as_rows(rb), na.to_numpy(), nb.to_numpy(), percent)), "boolean"
    )
    near = kept(pairs.join(side("a"), "a").join(side("b"), "b").where(passes("r_a", "r_b", "n_a", "n_b")).select("a", "b", "n_a", "n_b"))
    involved = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    found = full_sets(involved, nodes, docs, size)
    both = near.join(found.select(F.col("node").alias("a"), F.col("hashes").alias("h_a")), "a")
    both = both.join(found.select(F.col("node").alias("b"), F.col("hashes").alias("h_b")), "b")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    return kept(both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))


def leader_pairs(bands: DataFrame) -> DataFrame:
    """In each band its nodes beside the leader, the one that meets most nodes in all its
    bands. In a family of edited copies that is the text they were made from."""
    chosen = bands.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("leader"))
    met = bands.join(chosen, "key").where("node <> leader")
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def remaining_links(bands: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between different components of a band, found by comparing every node outside
    the band's largest component with all of another one, in blocks. A block gives links
    that join its components, not all of them."""
    counts = bands.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most")
    ).where("all > most")
    mixed = mixed.withColumns({
        "rows": F.ceil(F.col("all") / BLOCK).cast("int"), "columns": F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    })
    own = kept(bands.select("key", "node", "component").join(mixed.select("key", "top", "rows", "columns"), "key"))
    if own.isEmpty():
        return None
    found = full_sets(own.select("node").distinct(), nodes, docs, size)
    held = own.join(nodes.select("node", "registers", "n"), "node").join(found, "node")
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = ["key", "node", "component", "registers", "n", "hashes"]
    members = held.select(*cells, at("rows").alias("i"), every("columns").alias("j"), F.lit(False).alias("outside"))
    outside = held.where("component <> top").select(*cells, every("rows").alias("i"), at("columns").alias("j"), F.lit(True).alias("outside"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        held, n = as_rows(group.registers), group.n.to_numpy()
        node, component, out = group.node.to_numpy(), group.component.to_numpy().copy(), group.outside.to_numpy(bool)
        hashes = [np.asarray(h).view(np.uint64) for h in group.hashes]  # the order they are sorted in
        inside, links = np.flatnonzero(~out), []
        for k in np.flatnonzero(out).tolist():
            good = inside[likely(held[k][None], held[inside], np.full(len(inside), n[k]), n[inside], percent)]
            for m in good[component[good] != component[k]].tolist():
                if component[m] == component[k]:
                    continue
                small, large = sorted((hashes[k], hashes[m]), key=len)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[place] == small).sum())
                if 100 * shared >= percent * (n[k] + n[m] - shared):
                    links.append((min(node[k], node[m]), max(node[k], node[m])))
                    component[component == component[m]] = component[k]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return kept(members.unionByName(outside).groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents (``doc_id``, ``text``) linked by ``100 * intersection >= percent
    * union`` of their sets of ``size``-word shingles (A-Z lower-cased, words without ASCII
    white space).

    One row per input row: ``doc_id, n_shingles, component_id, kept``; ``component_id`` is the
    smallest id reachable, ``kept`` whether it is the row's own. Null and empty texts and
    texts without words are linked with nothing and kept. Repeated rows of an id get the
    same class if their texts do. A null id is never the smallest one of a class that has
    others; such rows are kept only if the class has none. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = kept(docs.mapInArrow(lambda it: sketches(it, size), "doc_id bigint, n bigint, digest binary, registers binary"))
    some = found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = kept(some.withColumn("node", F.monotonically_increasing_id()))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": band_keys(as_rows(batch.registers)).reshape(-1), "node": np.repeat(batch.node.to_numpy(), BANDS)})

    # Only bands that several nodes share matter from here on.
    bands = nodes.select("node", "registers").mapInPandas(keys, "key bigint, node bigint")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = kept(bands.join(shared, "key"))
    bands = bands.join(bands.groupBy("node").agg(F.sum("size").alias("degree")), "node").select("key", "node", "degree")
    links, edges = None, confirmed(kept(leader_pairs(bands)), nodes, docs, size, percent)
    if not edges.isEmpty():
        links = kept(components(edges))
        bands = bands.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        bands = bands.withColumn("component", F.col("node"))
    more = remaining_links(bands, nodes, docs, size, percent)
    if more is not None and not more.isEmpty():
        links = kept(components(edges.unionByName(more)))
    if links is None:
        ends = nodes.select("digest", F.col("rep").alias("component_id"))
    else:
        whole = nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
        ends = whole.join(least, "component").select("digest", "component_id")
    out = found.select("doc_id", "n", "digest").join(ends, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
