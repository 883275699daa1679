"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about ``SHARD`` by hash. Each shard becomes one row
of flat arrays: vectors, and per layer the nodes and their neighbours in fixed-width lists.
Queries pass all shards in blocks of ``QUERIES``; each shard answers with its best and the
answers are merged and scored in double precision. Graph nearness is the inner product
after one more component has brought all vectors of the shard to the same length, so the
graph's order for a query is exactly the order by inner product.

Insertion and search run in lockstep over many rows at a time: nodes join in batches that
double up to ``BATCH``, and all rows of a batch take each step of the beam search together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.shared import kept
from sourceloom.llm.words import mix

SHARD = 4_096
QUERIES = 10_000
BATCH = 256
DEGREE = 32  # at the ground; half of it above
BUILD_BEAM = 64
SEARCH_BEAM = 128
STEP = 4  # entries of the beam opened at a time


def beam(near: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes found for each query from its entry node, best first; -1
    where there are fewer. ``near``: neighbours of each node, filled up with -1."""
    rows = np.arange(len(queries))
    best = np.full((len(rows), width), -1)
    score = np.full((len(rows), width), -np.inf, np.float32)
    opened = np.zeros((len(rows), width), bool)
    seen = np.zeros((len(rows), len(vectors) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    best[:, 0] = entry
    score[:, 0] = np.einsum("ij,ij->i", queries, vectors[entry])
    seen[rows, entry] = True
    step = min(STEP, width)
    while len(rows):
        waiting = np.where(opened[rows] | (best[rows] < 0), -np.inf, score[rows])
        pick = np.argsort(-waiting, axis=1)[:, :step] if step > 1 else np.argmax(waiting, axis=1)[:, None]
        live = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        more = live.any(axis=1)
        rows, pick, live = rows[more], pick[more], live[more]
        if not len(rows):
            break
        opened[rows[:, None], pick] |= live
        nodes = np.where(live, best[rows[:, None], pick], -1)
        found = np.where((nodes >= 0)[:, :, None], near[nodes], -1).reshape(len(rows), -1)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[rows[:, None], found]] = -1
        seen[rows[:, None], found] = True
        use = (found >= 0).any(axis=0)
        found = found[:, use]
        got = np.matmul(vectors[found], queries[rows][:, :, None])[:, :, 0]
        got[found < 0] = -np.inf
        all_score = np.concatenate([score[rows], got], axis=1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :width]
        best[rows] = np.take_along_axis(np.concatenate([best[rows], found], axis=1), order, axis=1)
        score[rows] = np.take_along_axis(all_score, order, axis=1)
        flags = np.concatenate([opened[rows], np.zeros(found.shape, bool)], axis=1)
        opened[rows] = np.take_along_axis(flags, order, axis=1)
    return best, score


def diverse(vectors: np.ndarray, nodes: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
    """Choose ``degree`` neighbours of each row from ``nodes`` (best first, -1 for none): first
    those nearer to the row than to any chosen before, then the best of the rest."""
    there = nodes >= 0
    held = vectors[nodes]
    mutual = np.matmul(held, held.transpose(0, 2, 1))
    chosen = np.zeros(nodes.shape, bool)
    for j in range(nodes.shape[1]):
        nearest = np.where(chosen, mutual[:, j, :], -np.inf).max(axis=1)
        chosen[:, j] = there[:, j] & (nearest < score[:, j]) & (chosen.sum(axis=1) < degree)
    place = np.where(chosen, 0, np.where(there, 1, 2)) * nodes.shape[1] + np.arange(nodes.shape[1])
    order = np.argsort(place, axis=1)[:, :degree]
    out = np.full((len(nodes), degree), -1)
    out[:, : order.shape[1]] = np.take_along_axis(np.where(there, nodes, -1), order, axis=1)
    return out


def link(near: np.ndarray, vectors: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Give ``new`` nodes their ``chosen`` neighbours, and those the way back."""
    near[new] = chosen
    source = np.repeat(new, chosen.shape[1])[chosen.reshape(-1) >= 0]
    target = chosen.reshape(-1)[chosen.reshape(-1) >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    wide = np.full((len(nodes), near.shape[1] + count.max()), -1)
    wide[:, : near.shape[1]] = near[nodes]
    row = np.repeat(np.arange(len(nodes)), count)
    wide[row, near.shape[1] + np.arange(len(target)) - np.repeat(first, count)] = source
    score = np.matmul(vectors[wide], vectors[nodes][:, :, None])[:, :, 0]
    score[wide < 0] = -np.inf
    order = np.argsort(-score, axis=1, kind="stable")
    wide, score = np.take_along_axis(wide, order, axis=1), np.take_along_axis(score, order, axis=1)
    wide = wide[:, : max(near.shape[1], int((wide >= 0).sum(axis=1).max()))]
    near[nodes] = diverse(vectors, wide, score[:, : wide.shape[1]], near.shape[1])


@dataclass
class Graph:
    vectors: np.ndarray  # brought to one length
    layers: list[np.ndarray]  # neighbours of all nodes, the ground first
    entry: int

    @classmethod
    def build(cls, raw: np.ndarray) -> Graph:
        length = (raw.astype(np.float64) ** 2).sum(axis=1)
        vectors = np.column_stack([raw, np.sqrt(np.maximum(length.max() - length, 0))]).astype(np.float32)
        chance = (mix(np.arange(1, len(raw) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(chance + 1e-18) / np.log(DEGREE / 2)).astype(np.int64)
        layers = [np.full((len(raw), DEGREE if k == 0 else DEGREE // 2), -1) for k in range(level.max() + 1)]
        graph, done = cls(vectors, layers, 0), 1
        while done < len(raw):
            new = np.arange(done, min(len(raw), done + min(done, BATCH)))
            entry = np.full(len(new), graph.entry)
            for k in range(level[graph.entry], -1, -1):
                joins = level[new] >= k
                for own, width in ((np.flatnonzero(~joins), 1), (np.flatnonzero(joins), BUILD_BEAM)):
                    if len(own):
                        best, score = beam(layers[k], vectors, vectors[new[own]], entry[own], width)
                        entry[own] = best[:, 0]
                        if width > 1:
                            use = max(1, int((best >= 0).sum(axis=1).max()))
                            link(layers[k], vectors, new[own], diverse(vectors, best[:, :use], score[:, :use], layers[k].shape[1]))
            done = int(new[-1]) + 1
            graph.entry = int(np.argmax(level[:done]))
        return graph

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        wide = np.column_stack([queries, np.zeros(len(queries), np.float32)])
        entry = np.full(len(queries), self.entry)
        for near in self.layers[:0:-1]:
            if (near[self.entry] >= 0).any():
                entry = beam(near, self.vectors, wide, entry, 1)[0][:, 0]
        return beam(self.layers[0], self.vectors, wide, entry, width)[0]


INDEX = "dim int, vectors binary, ids array<bigint>, entry int, nodes array<binary>, near array<binary>"


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id", kind="stable")
    raw = np.stack(rows["vector"].to_numpy()).astype(np.float32)
    graph = Graph.build(raw)
    nodes = [np.flatnonzero((near >= 0).any(axis=1)).astype(np.int32) for near in graph.layers]
    return pd.DataFrame({
        "dim": [raw.shape[1]], "vectors": [graph.vectors.tobytes()], "ids": [rows["id"].to_numpy()], "entry": [graph.entry],
        "nodes": [[n.tobytes() for n in nodes]],
        "near": [[near[n].astype(np.int32).tobytes() for n, near in zip(nodes, graph.layers, strict=True)]],
    })


def opened(row) -> tuple[Graph, np.ndarray]:
    vectors = np.frombuffer(row.vectors, np.float32).reshape(-1, row.dim + 1)
    layers = []
    for k, (nodes, near) in enumerate(zip(row.nodes, row.near, strict=True)):
        wide = np.full((len(vectors), DEGREE if k == 0 else DEGREE // 2), -1)
        wide[np.frombuffer(nodes, np.int32)] = np.frombuffer(near, np.int32).reshape(-1, wide.shape[1])
        layers.append(wide)
    return Graph(vectors, layers, int(row.entry)), np.asarray(row.ids)


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, shard: int = SHARD, width: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` rows of ``vectors`` (``vec_id``, ``embedding``) with the largest inner product
    for each row that ``queries`` (a condition on ``id``) selects, itself apart.

    ``query_id, rank, vec_id, score``, rank from 1, ties to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do null ids.
    Equal vectors are indexed once and answered with all that can matter of their ids.
    Repeated ids are answered for their first vector in order. Vectors of another length are
    no candidates. Other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    # Of equal vectors the k + 1 smallest ids can be among the nearest of a query.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    some = rows.withColumn("place", order).where(F.col("place") <= k + 1)
    distinct = kept(some.groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("same")))
    shards = max(1, -(-distinct.count() // shard))
    dealt = distinct.select("vector", "id", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"))
    index = kept(dealt.repartition(min(shards, 10_000), "shard").groupBy("dim", "shard").applyInPandas(build_shard, INDEX))
    asked = rows.where(queries)
    blocks = max(1, -(-asked.count() // QUERIES))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        held = vectors.sparkSession.sparkContext.broadcast(block)
        part = index.mapInPandas(lambda it, h=held: answers(it, h.value, k, width), "query_id bigint, id bigint, score double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    hits = found.join(distinct.select("id", "same"), "id").select("query_id", "score", F.explode("same").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answers(batches: Iterator[pd.DataFrame], asked: pd.DataFrame, k: int, width: int) -> Iterator[pd.DataFrame]:
    dims = asked["vector"].map(len).to_numpy() if len(asked) else np.empty(0)
    for batch in batches:
        for row in batch.itertuples(index=False):
            graph, ids = opened(row)
            own = np.flatnonzero(dims == row.dim)
            for at in range(0, len(own), BATCH):
                part = asked.iloc[own[at : at + BATCH]]
                queries = np.stack(part["vector"].to_numpy()).astype(np.float32)
                best = graph.search(queries, max(width, k + 1))[:, : k + 1]
                query, place = np.nonzero(best >= 0)
                node = best[query, place]
                raw = graph.vectors[node, : row.dim].astype(np.float64)
                score = np.einsum("ij,ij->i", raw, queries[query].astype(np.float64))
                yield pd.DataFrame({"query_id": part["id"].to_numpy()[query], "id": ids[node], "score": score})
