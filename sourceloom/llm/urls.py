"""URL filters: exact membership of listed keys by a cascade of Bloom filters.

A rule is ``host/path``: it fits its host and all subdomains, if the path starts with the
rule's. The keys of a url are all strings that could be a rule fitting it: each of its host
suffixes with each path prefix of a length that some rule has. Level 0 of a cascade holds
the listed keys. Keys of the corpus that pass it without being listed are held by level 1,
listed keys that pass level 1 by level 2, and so on until nothing passes wrongly. Because
the wrong passes are sought over all keys of the corpus, the cascade is exact there, and
urls are judged without a join.

Listed keys are dealt into shards of about ``SHARD_KEYS``; each shard has its own cascade,
whose levels are as large as its listed keys need, so what is broadcast at a time is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.shared import kept
from sourceloom.llm.words import mix

SHARD_KEYS = 1_000_000
KEY = "struct<key:string,host:int,a:bigint,b:bigint>"


@dataclass
class Level:
    """A Bloom filter of ``bits`` bits with ``probes`` probes, salted by its depth."""

    depth: int
    bits: int
    probes: int
    held: np.ndarray

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        salt = np.uint64(self.depth * 2 + 1)
        first, step = mix(a + salt), mix(b ^ mix(np.array([salt]))[0]) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) % np.uint64(self.bits) for i in range(self.probes)])

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b).astype(np.int64)
        return ((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        listed = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.ones(len(a), bool)
        for level in self.levels:
            at = np.flatnonzero(open_)
            out = at[~level.has(a[at], b[at])]
            listed[out] = level.depth % 2 == 1
            open_[out] = False
        return listed


def numbers(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def bloom(keys: DataFrame, depth: int, n: int, share: float) -> Level:
    """Filter over ``n`` keys (``a``, ``b``) that lets ``share`` of other keys pass."""
    bits = max(64, math.ceil(n * math.log(1 / share) / math.log(2) ** 2))
    level = Level(depth, bits, max(1, round(bits / n * math.log(2))), np.zeros((bits + 7) // 8, np.uint8))

    def places(batches):
        for batch in batches:
            at = np.unique(level.places(numbers(batch.a), numbers(batch.b)))
            yield pd.DataFrame({"byte": (at >> np.uint64(3)).astype(np.int64), "bit": 1 << (at & np.uint64(7)).astype(np.int32)})

    found = keys.select("a", "b").mapInPandas(places, "byte bigint, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    level.held[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return level


def passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)
    has = F.pandas_udf(lambda a, b: pd.Series(held.value.has(numbers(a), numbers(b)).astype(bool)), "boolean")
    return keys.where(has("a", "b"))


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade over ``listed`` keys, exact for all of ``universe`` (both distinct ``a, b``)."""
    out, n = Cascade(), listed.count()
    if not n:
        return out
    share = min(0.5, n / max(1, universe.count()))
    out.levels.append(bloom(listed, 0, n, share))
    inside, outside = listed, kept(passing(universe, out.levels[0]).join(listed, ["a", "b"], "left_anti"))
    while n := outside.count():
        out.levels.append(bloom(outside, len(out.levels), n, 0.5))
        inside, outside = outside, kept(passing(inside, out.levels[-1]))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand in the url; empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys a rule fitting this url could have, with their hashes."""
    labels = F.split(host, "\\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fitting = F.filter(F.array([F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    paths = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(
        F.concat(h, p).alias("key"), F.length(h).alias("host"), F.xxhash64(F.concat(h, p)).alias("a"), F.xxhash64(F.lit(1), F.concat(h, p)).alias("b")))))
    return F.when(host != "", keys).otherwise(F.array().cast(f"array<{KEY}>"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict for each page (``page_id``, ``url``) under ``rules`` (``rule``, ``verdict``).

    One row per input row: ``page_id, host, path, rule, verdict``. The longest fitting rule
    wins (of equal ones, that with the longer host); a url that no rule fits is allowed and
    has no rule. Null urls and urls without ``://`` have empty host and path and fit no
    rule. Repeated rows are judged alike. A rule listed as both is a block. Rules without
    ``/`` or with a null part are ignored. Other columns are ignored, whatever their names.
    """
    at = F.instr("rule", "/")
    ruled = rules.where((at > 0) & F.col("verdict").isin("allow", "block")).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    ruled = kept(ruled.select("rule", "verdict", F.xxhash64("rule").alias("a"), F.xxhash64(F.lit(1), "rule").alias("b"), (F.length("rule") - at + 1).alias("length")))
    lengths = sorted(r[0] for r in ruled.select("length").distinct().collect()) or [1]
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = out.withColumn("keys", url_keys(F.col("host"), F.col("path"), [int(x) for x in lengths]))
    universe = kept(out.select(F.explode("keys").alias("k")).select("k.a", "k.b").distinct())
    shards = max(1, -(-ruled.count() // SHARD_KEYS))
    out = out.select("page_id", "host", "path", "keys", F.lit(None).cast(KEY).alias("best"), F.lit(None).cast("string").alias("verdict"))
    for shard in range(shards):
        own = lambda df, s=shard: df.where(F.pmod("a", F.lit(shards)) == s)
        both = {v: cascade(own(ruled.where(F.col("verdict") == v)).select("a", "b"), own(universe)) for v in ("allow", "block")}
        held = pages.sparkSession.sparkContext.broadcast((both, shard, shards))
        out = out.mapInPandas(lambda it, h=held: judged(it, *h.value), out.schema)
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def judged(batches, both: dict[str, Cascade], shard: int, shards: int):
    """Take the longest key that a cascade of this shard knows, if it beats the one so far."""
    for batch in batches:
        sizes = batch["keys"].map(len).to_numpy(np.int64)
        row = np.repeat(np.arange(len(batch)), sizes)
        keys = [k for ks in batch["keys"] for k in ks]
        a = np.array([k["a"] for k in keys], np.int64)
        own = np.flatnonzero(a % shards == shard)
        b = np.array([k["b"] for k in keys], np.int64)[own].view(np.uint64) if keys else np.empty(0, np.uint64)
        best, verdict = list(batch["best"]), list(batch["verdict"])
        for name, filters in both.items():
            for at in own[filters.has(a[own].view(np.uint64), b)].tolist():
                r, k = row[at], keys[at]
                rank = lambda x: (len(x["key"]), x["host"])
                if best[r] is None or rank(k) > rank(best[r]):
                    best[r], verdict[r] = k, name
        yield batch.assign(best=best, verdict=verdict)
