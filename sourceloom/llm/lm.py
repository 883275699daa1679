"""LM scoring with a hierarchical Pitman-Yor model of words.

Every token is a customer of its context's restaurant; the context is the token before it,
by its 64-bit hash (the start of a text is a context of its own). All context restaurants
share one parent, the restaurant of single words: each table opened in a context is a
customer there. Its own base is uniform over the training vocabulary and one unknown word.

Counts are gathered in packed arrays: each task merges its tokens, and a word's counts of
all tasks meet in the word's part. A part numbers its contexts: those of its training tokens
and of the held-out tokens it will score. A context's customers and tables are summed over
all parts where its hash is dealt to, and joined to every part that has it; there are as many
ranges of hashes as parts.

The seating is sampled by Gibbs: customers are taken out of their tables (which go with
their last one) and seated again among the others, at a table of ``n`` with odds ``n - d`` or
at a new one with odds ``(theta + d * T) * parent``. ``T`` counts the tables of the context, its
own of the word as they stand, others as of the sweep before; the word's probability in the
parent is that of the sweep before (parallel Gibbs: what other customers of the same turn do
is seen in the next). Probabilities need only how many tables a pair has, so all customers of
a pair are taken out at once (blocked Gibbs), and their tables drawn from the distribution that
seating one by one again and again would reach: generalised Stirling numbers times the odds of
new tables. Those of pairs with more than ``DRAWN`` are seated one by one, and come in one after
the other before the first sweep. Tables opened or gone are customers come or gone in the
parent, whose customers are then seated likewise. Sweeps run where the counts lie; between the
two rounds all totals are summed anew. Probabilities are the mean of those of the second
round's sweeps.

A part keeps where each pack's pairs are in it. It answers every pack with the probabilities
of its pairs, and these meet the pack's documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.shared import dropped, kept
from sourceloom.llm.words import NON_SPACE, mix, slices, words

# A part's number of a context is stored in two columns: so many low bits, and the rest.
CONTEXT_BITS = 14
CONTEXTS = 1 << CONTEXT_BITS
PART_BYTES = 8 << 20
PACK_TOKENS = 1_000_000
BLOCK_PAIRS = 100_000
# Customers that are held one by one at a time (or those of one pair, if they are more).
BLOCK_CUSTOMERS = 1_000_000
# So few pairs that still have customers to seat are taken one after the other.
FEW = 24
# Customers of a pair and contexts of a word up to which tables are drawn at once; how many tables are
# thought of at first; ratios that are held of other widths, and odds that are held at a time.
DRAWN, PARENT_DRAWN = 1 << 12, 1 << 13
WIDTH = 64
RATIOS = 1 << 20
ODDS = 1 << 17
# Odds that no draw of a double meets.
NO_ODDS = 1e-18
BURN_IN, SAMPLES = 1, 3
THETA = 1.0
END, START = (mix(np.array([k], np.uint64))[0] for k in (0xE17D, 0x57A7))

# Rows of packs (``own`` is -1), merged ones of parts, and what a pack keeps of its documents (``own``: its number).
COUNTS = (
    "part int, own bigint, pack bigint, words binary, sizes binary, keys binary, contexts binary, upper binary, counts binary, "
    "packs binary, lengths binary, places binary, ids binary, docs binary, times binary"
)
STATE = "seats binary, tables binary, parent_seats binary, parent_tables binary, samples binary, parent_samples binary"
SWEPT = "part int, words binary, sizes binary, keys binary, contexts binary, upper binary, counts binary, " + STATE
ASKED = "range int, part int, keys binary, customers binary, tables binary"
FOUND = "part int, range int, customers binary, tables binary"
PREDICTED = "part int, sizes binary, logs binary, known binary"
ANSWERS = "pack bigint, part int, logs binary, known binary"
SCORES = "doc_id bigint, n bigint, known bigint, base double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and document index of all tokens; each text has one end."""
    found = words(column, NON_SPACE)
    n_docs = len(found.first) - 1
    token = np.empty(len(found.hash) + n_docs, np.uint64)
    doc = found.doc
    token[np.arange(len(found.hash)) + doc] = found.hash
    ends = found.first[1:] + np.arange(n_docs)
    token[ends] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])[:n_docs]] = START
    return token, mix(before + np.uint64(1)), np.repeat(np.arange(n_docs), found.counts + 1)


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes."""
    return ((word >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + count[i] - 1``, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def order_of(x: np.ndarray) -> np.ndarray:
    """Places of 64-bit numbers, ascending: their first bits and places are sorted as one number,
    and all bits only where the first ones do not tell them apart."""
    bits = np.uint64(len(x).bit_length())
    place = np.sort(x >> bits << bits | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    order = place.astype(np.int64)
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else np.argsort(x, kind="stable")


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the number of each one's."""
    order = order_of(x)
    y, number = x[order], np.empty(len(x), np.int64)
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    number[order] = np.cumsum(new) - 1
    return y[new], number


def order_of_pairs(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Places by word, then context."""
    (words_, word), (contexts, context) = numbered(word), numbered(context)
    bits = len(contexts).bit_length()
    key = (word << bits | context).astype(np.uint64)
    return order_of(key << np.uint64(64 - bits - len(words_).bit_length()))


def count_pairs(word: np.ndarray, context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct words ascending, how many contexts each has, and contexts (numbers) with counts."""
    unique, at = np.unique(word, return_inverse=True)
    key = at << 32 | context
    order = np.argsort(key, kind="stable")
    key, n = key[order], counts[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    pair, n = key[head], np.add.reduceat(n, head) if len(n) else n
    sizes = np.bincount(pair >> 32, minlength=len(unique))
    return unique, sizes, pair & 0xFFFFFFFF, n


def two_columns(number: np.ndarray) -> tuple[bytes, bytes]:
    return (number & (CONTEXTS - 1)).astype(np.int16).tobytes(), (number >> CONTEXT_BITS).astype(np.int32).tobytes()


def numbers(row) -> np.ndarray:
    """The part's number of each pair's context."""
    return as_array(row.contexts, np.int16) | as_array(row.upper, np.int32) << CONTEXT_BITS


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs; first bytes come
    first, then second ones, as zstandard likes it."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()
    return bytes([kind.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def wide(data: bytes, kind: type = np.int64) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"u{size}").reshape(n).astype(kind)


def narrow_steps(x: np.ndarray) -> bytes:
    """Ascending hashes by their differences."""
    return narrow(np.diff(x, prepend=np.uint64(0)))


def wide_steps(data: bytes) -> np.ndarray:
    return np.cumsum(wide(data, np.uint64), dtype=np.uint64)


def frame_of(schema: str, **columns) -> pd.DataFrame:
    """One row."""
    return pd.DataFrame({n: [columns.get(n)] for n in (c.split()[0] for c in schema.split(", "))})


def count_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of the training rows (``text``), one row for each part and pack. Rows that
    are ``held`` (if there is such a column) count as 0: only their pairs are met. With
    ``doc_id``, one more row for each pack: its documents, and to which each token belongs."""
    names, seq = [c.split()[0] for c in COUNTS.split(", ")], TaskContext.get().partitionId() << 24
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 3)]

    def pack(held: list[tuple[np.ndarray, ...]], ids: list[np.ndarray]) -> pa.RecordBatch:
        token, context, once, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = order_of_pairs(token, context)
        token, context = token[order], context[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        pair = np.flatnonzero(new | np.concatenate([[True], context[1:] != context[:-1]]))
        begin = np.flatnonzero(new[pair])
        sizes, unique, key = np.diff(np.append(begin, len(pair))), token[pair[begin]], context[pair]
        n = np.add.reduceat(once[order], pair)
        edges = np.searchsorted(part_of(unique, parts), np.arange(parts + 1))
        rows, first = [], np.append(begin, len(pair))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own, pairs = slice(edges[p], edges[p + 1]), slice(first[edges[p]], first[edges[p + 1]])
            met, local = numbered(key[pairs])
            rows.append({
                "part": p, "own": -1, "pack": seq, "words": narrow_steps(unique[own]), "sizes": narrow(sizes[own]),
                "keys": narrow_steps(met), "contexts": narrow(local), "counts": narrow(n[pairs]),
            })
        if ids:
            rows.append({
                "part": -1, "own": seq, "pack": seq, "sizes": narrow(sizes), "times": narrow(np.diff(np.append(pair, len(token)))),
                "docs": narrow(doc[order]), "ids": np.concatenate(ids).tobytes(),
            })
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    held, ids, n, docs = [], [], 0, 0
    for batch in slices(batches, "text"):
        token, context, doc = tokens(batch.column("text"))
        once = np.ones(len(token), np.int64)
        if "held" in batch.schema.names:
            once = (~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)[doc]
        if "doc_id" in batch.schema.names:
            ids.append(batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
        held.append((token, context, once, doc + docs))
        n, docs = n + len(token), docs + batch.num_rows
        if n >= PACK_TOKENS:
            yield pack(held, ids)
            held, ids, n, docs, seq = [], [], 0, 0, seq + 1
    if n:
        yield pack(held, ids)


def as_array(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.uint64 if kind is np.uint64 else np.int64)


def merge(group: pd.DataFrame) -> pd.DataFrame:
    """All counts of a part, merged for one range of word hashes after the other, and where
    each pack's pairs are among them. Pairs of held-out rows alone have the count 0."""
    if group.own.iloc[0] >= 0:
        return group
    met = [wide_steps(k) for k in group["keys"]]
    keys, at = numbered(np.concatenate(met))
    packs = []
    for r, own in zip(group.itertuples(), np.split(at, np.cumsum([len(k) for k in met])[:-1]), strict=True):
        number = own.astype(np.int32)
        packs.append((wide_steps(r.words), wide(r.sizes, np.int32), number[wide(r.contexts)], wide(r.counts, np.int32)))
    firsts = [np.concatenate([[0], np.cumsum(p[1], dtype=np.int64)]) for p in packs]
    blocks = max(1, sum(len(p[2]) for p in packs) // BLOCK_PAIRS)
    steps = [int(k * (1 << 64) // blocks) for k in range(1, blocks)]
    edges = [[0, *np.searchsorted(p[0], np.array(steps, np.uint64)).tolist(), len(p[0])] for p in packs]
    out, places, before = [], [[] for _ in packs], 0
    for k in range(blocks):
        word, context, counts = [], [], []
        for pack, first, edge in zip(packs, firsts, edges, strict=True):
            a, b = edge[k], edge[k + 1]
            word.append(np.repeat(pack[0][a:b], pack[1][a:b]))
            context.append(pack[2][first[a] : first[b]].astype(np.int64))
            counts.append(pack[3][first[a] : first[b]].astype(np.int64))
        unique, sizes, ctx, n = count_pairs(np.concatenate(word), np.concatenate(context), np.concatenate(counts))
        pairs = np.repeat(np.arange(len(unique)), sizes) << 32 | ctx
        for own, w, c in zip(places, word, context, strict=True):
            own.append(before + np.searchsorted(pairs, np.searchsorted(unique, w) << 32 | c))
        before += len(pairs)
        out.append((unique.tobytes(), sizes.astype(np.int32).tobytes(), *two_columns(ctx), n.astype(np.int64).tobytes()))
    columns = [b"".join(c) for c in zip(*out, strict=True)]
    steps = [np.diff(np.concatenate(own), prepend=0) for own in places]
    return frame_of(
        COUNTS, part=group.part.iloc[0], own=-1, pack=-1, keys=keys.tobytes(),
        **dict(zip(["words", "sizes", "contexts", "upper", "counts"], columns, strict=True)),
        packs=group["pack"].to_numpy(np.int64).tobytes(), lengths=narrow(np.array([len(x) for x in steps])), places=narrow(np.concatenate(steps)),
    )


@dataclass
class Totals:
    """Sums over all parts: of each context (by a part's numbers) its customers and tables; of
    the parent its customers and tables; the vocabulary; the discounts of both levels."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    vocabulary: int
    discount: float
    parent_discount: float

    def of(self, row) -> Totals:
        """With the contexts' sums that are joined to a part, if they are."""
        found = getattr(row, "found", None)
        if found is None:
            return self
        customers = np.concatenate([np.empty(0), *(np.frombuffer(x["customers"]) for x in found)])
        tables = [wide(x["tables"], float).reshape(-1, len(x["customers"]) // 8) for x in found]
        return replace(self, customers=customers, tables=np.concatenate(tables, axis=1))

    def sample(self, k: int) -> Totals:
        """With the contexts' tables of one sampled sweep."""
        return replace(self, tables=self.tables[k]) if self.tables.ndim == 2 else self

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there."""
        rest = (THETA + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)
        seated = np.where(customers > 0, customers - self.parent_discount * tables, 0)
        return (seated + rest) / (THETA + self.parent_customers)


class Seating:
    """Customers of some pairs (or words; by descending number), each at a table of its own pair.
    Tables are slots, of which a pair has as many as customers; ``at`` is the slot of each customer."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, chance: np.random.Generator) -> None:
        """``sizes`` of the ``tables`` of all pairs. Where there are more customers, they still have
        to come in; where there are fewer, random ones leave."""
        self.n, self.chance = customers, chance
        self.slots = np.maximum(customers, tables)
        self.first = np.cumsum(self.slots) - self.slots
        pair = np.repeat(np.repeat(np.arange(len(customers)), tables), sizes)
        slot = np.repeat(np.arange(len(sizes)) - np.repeat(np.cumsum(tables) - tables, tables), sizes)
        there = np.bincount(pair, minlength=len(customers))
        slot = slot[np.argsort(pair + chance.random(len(pair)))]  # who sits where is random, given the tables
        rank = np.arange(len(pair)) - (np.cumsum(there) - there)[pair]
        pair, slot, rank = (x[rank < customers[pair]] for x in (pair, slot, rank))
        self.seated = np.minimum(there, customers)
        self.at = np.zeros(self.slots.sum(), np.int32)
        self.at[self.first[pair] + rank] = slot
        self.size = np.bincount(self.first[pair] + slot, minlength=len(self.at)).astype(np.int32)
        self.tables = np.add.reduceat(self.size > 0, self.first, dtype=np.int64)

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        return self.tables, self.size[self.size > 0]

    def turn(self, mass: np.ndarray, slope: np.ndarray, discount: float, again: bool) -> None:
        """Seat those who come in, or (``again``) take every customer out and seat it again. A
        new table has odds ``mass + slope * tables``."""
        who = np.arange(len(self.n)) if again else np.flatnonzero(self.n > self.seated)
        counts, k = -self.n[who], 0
        while left := int(np.searchsorted(counts, -k)):
            if left < FEW:
                for p in who[:left].tolist():
                    self.rest(p, k if again else max(k, int(self.seated[p])), float(mass[p]), float(slope[p]), discount, again)
                break
            now = slice(0, left) if again else who[:left][self.seated[who[:left]] <= k]
            self.step(now, k, mass, slope, discount, again)
            k += 1
        self.seated = self.n

    def step(self, p: np.ndarray | slice, k: int, mass: np.ndarray, slope: np.ndarray, discount: float, again: bool) -> None:
        """The customer ``k`` of each of these pairs."""
        first, others, random = self.first[p], k, self.chance.random
        own = first + k
        slot = np.where(self.size[own] == 0, k, -1)
        if again:
            last, others = self.at[own], self.n[p] - 1
            size = self.size[first + last] - 1
            self.size[first + last] = size
            self.tables[p] -= size == 0
            slot = np.where(size == 0, last, slot)
        tables = self.tables[p]
        odds = mass[p] + slope[p] * tables
        new = random(len(own)) * (odds + others - discount * tables) < odds
        self.tables[p] += new
        seek = np.flatnonzero(new & (slot < 0))
        while len(seek):
            guess = (random(len(seek)) * self.slots[p][seek]).astype(np.int64)
            free = self.size[first[seek] + guess] == 0
            slot[seek[free]] = guess[free]
            seek = seek[~free]
        seek = np.flatnonzero(~new)
        while len(seek):  # a table by its customers, taken with n - d of n
            guess = (random(len(seek)) * (others[seek] if again else others)).astype(np.int64)
            if again:
                guess += guess >= k
            guess = self.at[first[seek] + guess]
            size = self.size[first[seek] + guess]
            taken = random(len(seek)) * size < size - discount
            slot[seek[taken]] = guess[taken]
            seek = seek[~taken]
        self.at[own] = slot
        self.size[first + slot] += 1

    def rest(self, p: int, k: int, mass: float, slope: float, discount: float, again: bool) -> None:
        """The customers of one pair from ``k`` on, as ``step`` does."""
        a, n = int(self.first[p]), int(self.n[p])
        b = a + int(self.slots[p])
        at, size, tables = self.at[a:b].tolist(), self.size[a:b].tolist(), int(self.tables[p])
        random = Random(int(self.chance.integers(1 << 62))).random
        for i in range(k, n):
            slot, others = i, i
            if again:
                last, others = at[i], n - 1
                size[last] -= 1
                if not size[last]:
                    tables -= 1
                    slot = last
            odds = mass + slope * tables
            if random() * (odds + others - discount * tables) < odds:
                tables += 1
                while size[slot]:
                    slot = int(random() * len(size))
            else:
                while True:
                    guess = int(random() * others)
                    slot = at[guess + (again and guess >= i)]
                    if random() * size[slot] < size[slot] - discount:
                        break
            at[i] = slot
            size[slot] += 1
        self.at[a:b], self.size[a:b], self.tables[p] = at, size, tables


def reseated(
    customers: np.ndarray, state: tuple[np.ndarray, np.ndarray], mass: np.ndarray, slope: np.ndarray, discount: float,
    chance: np.random.Generator, again: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each pair, and the sizes of all, after customers came or left and (``again``)
    each was taken out and seated again."""
    tables, sizes = state
    many = np.flatnonzero(customers > 1)
    order, first = many[np.argsort(-customers[many], kind="stable")], np.cumsum(tables) - tables
    weight, now, done, a = np.cumsum(customers[order]), np.minimum(customers, 1).astype(np.int64), [], 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + BLOCK_CUSTOMERS, "right")))
        own = order[a:b]
        seating = Seating(customers[own], tables[own], sizes[ranges(first[own], tables[own])], chance)
        for turn in (False, True)[: 1 + again]:
            seating.turn(mass[own], slope[own], discount, turn)
        now[own], more = seating.state()
        done.append(more)
        a = b
    out = np.ones(now.sum(), np.int64)
    out[ranges((np.cumsum(now) - now)[order], now[order])] = np.concatenate([np.empty(0, np.int64), *done])
    return now, out


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, chance: np.random.Generator) -> np.ndarray:
    """Tables after seating ``customers`` one after the other; a new one has odds ``mass``."""
    empty = np.zeros(len(customers), np.int64), np.empty(0, np.int64)
    return reseated(customers, empty, mass, np.zeros(len(customers)), discount, chance, again=False)[0]


def ratios(n: np.ndarray, width: int, discount: float) -> np.ndarray:
    """``S(m, t + 1) / S(m, t)`` for the numbers ``m`` (ascending, a column each) and ``t`` from 1
    to ``width`` (a row each). ``S``, a generalised Stirling number, sums up all ways to seat ``m``
    customers at ``t`` tables: ``S(m + 1, t) = S(m, t - 1) + (m - discount * t) * S(m, t)``."""
    out, now, m = np.zeros((width, len(n))), np.zeros(width), 1
    own, below, above = discount * np.arange(1, width + 1), np.empty(width), np.empty(width)
    for column, last in enumerate(n.tolist()):
        while m < last:
            k = min(m, width)
            now_, own_, below_, above_ = (now, own, below, above) if k == width else (x[:k] for x in (now, own, below, above))
            np.subtract(m, own_, out=below_)
            np.subtract(below_, discount, out=above_)
            above_ *= now_
            above_ += 1
            below_[1:] += np.reciprocal(now_[:-1], out=now_[:-1])
            np.divide(above_, below_, out=now_)
            m += 1
        out[:, column] = now
    return out


@lru_cache(maxsize=2)
def first_ratios(discount: float) -> np.ndarray:
    """Those of all numbers up to twice ``PARENT_DRAWN`` and of ``WIDTH``, the number less 2 as the column."""
    return ratios(np.arange(2, 2 * PARENT_DRAWN + 1), WIDTH, discount)


class Drawing:
    """Tables of pairs, all customers seated anew at once: ``t`` tables have the odds
    ``S(customers, t) * mass * (mass + slope) * .. * (mass + slope * (t - 1))``."""

    def __init__(self, discount: float, chance: np.random.Generator) -> None:
        self.discount, self.chance, self.last = discount, chance, {}

    def ratios(self, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and the column of each of the numbers ``n``; those asked for last are kept."""
        if width == WIDTH and n[-1] <= 2 * PARENT_DRAWN:
            return first_ratios(self.discount), n - 2
        if width not in self.last or not np.array_equal(self.last[width][0], n):
            self.last[width] = n, ratios(n, width, self.discount)
        return self.last[width][1], np.arange(len(n))

    def tables(self, customers: np.ndarray, mass: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Pairs whose odds have not run out at ``width`` tables are drawn from more."""
        now, width = np.minimum(customers, 1).astype(np.int64), WIDTH
        left = np.flatnonzero(customers > 1)
        left = left[np.argsort(customers[left], kind="stable")]
        while len(left):
            own, wider, columns = customers[left], [], max(1, RATIOS // width)
            n, number = np.unique(own, return_inverse=True)
            for begin in range(0, len(n), columns):
                a, end = np.searchsorted(number, [begin, begin + columns]).tolist()
                ratio, column = self.ratios(n[begin : begin + columns], width)
                while a < end:
                    b = min(end, int(np.searchsorted(own, 2 * own[a])), a + max(1, ODDS // min(width, 2 * int(own[a]))))
                    pair, most = left[a:b], min(width, int(own[b - 1]))
                    now[pair], done = self.draw(own[a:b], mass[pair], slope[pair], ratio[: most - 1, column[number[a:b] - begin]])
                    wider.append(pair[~done])
                    a = b
            left, width = np.concatenate(wider), 8 * width
        return now

    def draw(self, customers: np.ndarray, mass: np.ndarray, slope: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of pairs with such ratios (a column each), and whether there are no odds for more."""
        most = len(ratio) + 1
        odds = np.zeros((most, len(customers)))
        with np.errstate(divide="ignore"):
            np.log((mass + slope * np.arange(1, most)[:, None]) * ratio, out=odds[1:])
        falling = odds[-1] < 0
        np.cumsum(odds, axis=0, out=odds)
        np.exp(odds - odds.max(axis=0), out=odds)
        done = (customers <= most) | ((odds[-1] < NO_ODDS) & falling)
        np.cumsum(odds, axis=0, out=odds)
        above = (odds[:-1] <= self.chance.random(len(customers)) * odds[-1]).sum(axis=0)
        return np.minimum(1 + above, customers), done


def sampled(
    customers: np.ndarray, many: np.ndarray, state: tuple[np.ndarray, np.ndarray], mass: np.ndarray, slope: np.ndarray, drawing: Drawing
) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each pair after all its customers were seated again, and the sizes of the tables
    of those that have ``many``."""
    tables = drawing.tables(np.where(many, 0, customers), mass, slope)
    tables[many], sizes = reseated(customers[many], (state[0][many], state[1]), mass[many], slope[many], drawing.discount, drawing.chance)
    return tables, sizes


def sweep(batches: Iterator[pd.DataFrame], totals: Totals, sweeps: int, discard: int, turn: int) -> Iterator[pd.DataFrame]:
    """Sample the seating ``sweeps`` times, from the one before (``seats``, ``parent_seats``) if
    there is one. ``samples`` are the tables after each sweep but the first ``discard``, ``tables`` their mean."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            sizes, number, counts = as_array(row.sizes, np.int32), numbers(row), np.frombuffer(row.counts, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            context_tables = totals.of(row).sample(0).tables[number]
            chance = np.random.default_rng([int(row.part), turn])
            tables, parent_tables = seats(row, "tables")[-1], seats(row, "parent_tables")[-1]
            if getattr(row, "seats", None) is None:
                state, parent_state = ((np.zeros(len(x), np.int64), np.empty(0, np.int64)) for x in (tables, parent_tables))
            else:
                state, parent_state = (tables, wide(row.seats)), (parent_tables, wide(row.parent_seats))
            # Of other words; this word's tables are counted as they stand.
            others, parent_others = context_tables - tables, totals.parent_tables - parent_tables
            many, parent_many = counts > DRAWN, np.bincount(owner[counts > 0], minlength=len(sizes)) > PARENT_DRAWN
            drawing, parent_drawing = Drawing(totals.discount, chance), Drawing(totals.parent_discount, chance)
            share, samples, parent_samples = 1 / (totals.vocabulary + 1), [], []
            for k in range(sweeps):
                parent = totals.parent(np.bincount(owner, tables, len(sizes)), parent_tables)[owner]
                mass, slope = (THETA + totals.discount * others) * parent, totals.discount * parent
                state = sampled(counts, many, state, mass, slope, drawing)
                tables = state[0]
                customers = np.bincount(owner, tables, len(sizes)).astype(np.int64)
                mass = (THETA + totals.parent_discount * parent_others) * share
                slope = np.full(len(sizes), totals.parent_discount * share)
                parent_state = sampled(customers, parent_many, parent_state, mass, slope, parent_drawing)
                parent_tables = parent_state[0]
                if k >= discard:
                    samples.append(tables)
                    parent_samples.append(parent_tables)
            mean = lambda x: np.mean(x, axis=0).astype(np.float32).tobytes()
            static = {c: getattr(row, c, None) for c in ("part", "words", "sizes", "keys", "contexts", "upper", "counts")}
            yield frame_of(
                SWEPT, **static, seats=narrow(state[1]), parent_seats=narrow(parent_state[1]), tables=mean(samples), parent_tables=mean(parent_samples),
                samples=narrow(np.concatenate(samples)), parent_samples=narrow(np.concatenate(parent_samples)),
            )


def seats(row, column: str) -> np.ndarray:
    """A part's tables, of each sampled sweep; before any sweep there is one where there are customers."""
    counts, sizes = np.frombuffer(row.counts, np.int64), as_array(row.sizes, np.int32)
    samples = getattr(row, {"tables": "samples", "parent_tables": "parent_samples"}[column], None)
    n = len(counts) if column == "tables" else len(sizes)
    if samples is not None:
        return wide(samples).reshape(-1, n)
    if column == "parent_tables":
        counts = np.bincount(np.repeat(np.arange(n), sizes), counts, n)
    return np.minimum(counts, 1).astype(np.int64).reshape(1, n)


def total(parts: DataFrame, discounts: tuple[float, float] | None = None, samples: int = 1) -> tuple[list[Totals], int]:
    """Sum up all parts but their contexts, for each sampled sweep; also the number of training tokens."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes, counts = as_array(row.sizes, np.int32), np.frombuffer(row.counts, np.int64)
                live = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[counts > 0], minlength=len(sizes))
                few = [float((x == k).sum()) for x in (counts, live) for k in (1, 2)]
                tables = [float(x.sum()) for c in ("tables", "parent_tables") for x in seats(row, c)]
                yield pd.DataFrame([(float(counts.sum()), float((live > 0).sum()), *few, *tables)], columns=names)

    names = ["tokens", "words", "pairs_1", "pairs_2", "words_1", "words_2", *(f"{c}_{k}" for c in ("tables", "parents") for k in range(samples))]
    rows = parts.mapInPandas(sums, ", ".join(f"{n} double" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names)).first()
    if discounts is None:
        ones_twos = ((rows[f"{x}_1"], rows[f"{x}_2"]) for x in ("pairs", "words"))
        discounts = tuple(min(0.95, max(0.05, one / max(1.0, one + 2 * two))) for one, two in ones_twos)
    none = np.empty(0)
    made = [Totals(none, none, rows[f"tables_{k}"], rows[f"parents_{k}"], int(rows.words), *discounts) for k in range(samples)]
    return made, int(rows.tokens)


def ask(batches: Iterator[pd.DataFrame], n_ranges: int) -> Iterator[pd.DataFrame]:
    """The customers and tables (of each sampled sweep) of a part's contexts, for each range of hashes."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            keys, number, counts = np.frombuffer(row.keys, np.uint64), numbers(row), np.frombuffer(row.counts, np.int64)
            customers = np.bincount(number, counts, len(keys)).astype(np.int64)
            tables = np.stack([np.bincount(number, x, len(keys)).astype(np.int64) for x in seats(row, "tables")])
            edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32), np.arange(n_ranges + 1))
            made = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                made.append((k, row.part, narrow_steps(keys[own]), narrow(customers[own]), narrow(tables[:, own].ravel())))
            yield pd.DataFrame(made, columns=["range", "part", "keys", "customers", "tables"])


def add_up(group: pd.DataFrame) -> pd.DataFrame:
    """The sums of a range's contexts over all parts, for each part that has them."""
    keys = [wide_steps(x) for x in group["keys"]]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    edges = np.cumsum([len(x) for x in keys])
    customers = np.concatenate([wide(x) for x in group.customers])
    tables = np.concatenate([wide(x).reshape(-1, len(k)) for x, k in zip(group.tables, keys, strict=True)], axis=1)
    sums = [np.bincount(at, w, len(unique))[at] for w in (customers, *tables)]
    cut = [np.split(x, edges[:-1]) for x in sums]
    return pd.DataFrame({
        "part": group.part.to_numpy(), "range": group["range"].to_numpy(), "customers": [x.tobytes() for x in cut[0]],
        "tables": [narrow(np.concatenate(x)) for x in zip(*cut[1:], strict=True)],
    })


def with_contexts(parts: DataFrame, n_ranges: int) -> DataFrame:
    """Parts with the sums of their contexts (``found``), in the order of the numbers."""
    asked = parts.mapInPandas(lambda it: ask(it, n_ranges), ASKED)
    sums = asked.groupBy("range").applyInPandas(add_up, FOUND)
    return parts.join(sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("range", "customers", "tables"))).alias("found")), "part")


def predicted(batches: Iterator[pd.DataFrame], totals: list[Totals]) -> Iterator[pd.DataFrame]:
    """Of each pair its log10 probability (the mean over the sampled sweeps), of each word its count."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            sizes, number, p = as_array(row.sizes, np.int32), numbers(row), 0.0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for k, (tables, parent_tables) in enumerate(zip(seats(row, "tables"), seats(row, "parent_tables"), strict=True)):
                now = totals[k].of(row).sample(k)
                model = Model.of(row, now, tables, parent_tables)
                room = (THETA + now.discount * now.tables) / (THETA + now.customers)
                p = p + model.seated(owner, number) / (THETA + now.customers[number]) + room[number] * model.parent[owner]
            logs = np.log10(p / len(totals)).astype(np.float32)
            yield pd.DataFrame({"part": [row.part], "sizes": [narrow(sizes)], "logs": [logs.tobytes()], "known": [narrow(model.count.astype(np.int64))]})


def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pack that has pairs of a part, their probabilities and the counts of their words."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            sizes, logs, known = wide(row.sizes), np.frombuffer(row.logs, np.float32), wide(row.known)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            made = []
            for pack, own in zip(np.frombuffer(row.packs, np.int64).tolist(), np.split(wide(row.places), np.cumsum(wide(row.lengths))[:-1]), strict=True):
                place = np.cumsum(own)
                word = owner[place]
                made.append((pack, row.part, logs[place].tobytes(), narrow(known[word[np.flatnonzero(np.diff(word, prepend=-1))]])))
            yield pd.DataFrame(made, columns=["pack", "part", "logs", "known"])


def summed(batches: Iterator[pd.DataFrame], vocabulary: int, train_tokens: int) -> Iterator[pd.DataFrame]:
    """Scores of a pack's documents, of the answers of all parts in their order."""
    denominator = np.log10(train_tokens + vocabulary + 1)
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids, doc, times = np.frombuffer(row.ids, np.int64), wide(row.docs), wide(row.times)
            count = np.repeat(np.concatenate([wide(x["known"]) for x in row.answers]), wide(row.sizes))
            log = np.concatenate([np.frombuffer(x["logs"], np.float32) for x in row.answers]).astype(np.float64)
            base, score, known = (np.repeat(x, times) for x in (np.log10(count + 1.0) - denominator, log, (count > 0).astype(float)))
            total_ = lambda x, d=doc, m=len(ids): np.bincount(d, x, m)
            yield pd.DataFrame({"doc_id": ids, "n": total_(None), "known": total_(known).astype(np.int64), "base": total_(base), "score": total_(score)})


@dataclass
class Model:
    count: np.ndarray
    parent: np.ndarray
    pairs: np.ndarray
    seats: np.ndarray

    @classmethod
    def of(cls, row, totals: Totals, tables: np.ndarray | None = None, parent_tables: np.ndarray | None = None) -> Model:
        """Of a part and tables of a sweep, else its mean ones."""
        sizes, context, counts = as_array(row.sizes, np.int32), numbers(row), np.frombuffer(row.counts, np.int64)
        if tables is None:
            tables, parent_tables = np.frombuffer(row.tables, np.float32), np.frombuffer(row.parent_tables, np.float32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        customers = np.bincount(owner, tables, len(sizes))
        return cls(
            np.bincount(owner, counts, len(sizes)), totals.parent(customers, parent_tables),
            owner << 32 | context, (counts - totals.discount * tables).astype(np.float32),
        )

    def seated(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.zeros(len(word))
        key = np.where(word >= 0, word << 32 | context, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.seats[at], 0.0)


def scores(docs: DataFrame) -> DataFrame:
    """Score every text (``doc_id``, ``text``) by a model of the rows that are not held out.

    One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Null and empty texts consist of their end. Null ids are held out. Repeated rows
    count and are scored as often as they stand. Without training rows the vocabulary is
    empty and every token has the probability 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-n_bytes // PART_BYTES))
    packed = texts.withColumn("held", held_out(F.col("doc_id"))).mapInArrow(lambda it: count_batches(it, parts), COUNTS)
    merged = kept(packed.groupBy("part", "own").applyInPandas(merge, COUNTS).drop("words"), "zstd")
    dropped(spark)
    counted = merged.where("own < 0")
    static, state = ["part", "sizes", "keys", "contexts", "upper", "counts"], ["seats", "parent_seats", "samples", "parent_samples"]
    first = counted.select(*static, *(F.lit(None).cast("binary").alias(c) for c in state))
    start, train_tokens = total(first)
    discounts = (start[0].discount, start[0].parent_discount)
    held = spark.sparkContext.broadcast

    def swept(parts_: DataFrame, totals: list[Totals], sweeps: int, discard: int, turn: int, columns: list[str]) -> DataFrame:
        last = held(totals[-1])
        return kept(with_contexts(parts_, parts).mapInPandas(lambda it: sweep(it, last.value, sweeps, discard, turn), SWEPT).select(*columns), "zstd")

    seated = swept(first, start, BURN_IN, BURN_IN - 1, 1, static + state)
    model = swept(seated, total(seated, discounts)[0], SAMPLES, 0, 2, static + state[2:])
    dropped(spark, seated)
    totals = held(total(model, discounts, SAMPLES)[0])
    pairs = kept(with_contexts(model, parts).mapInPandas(lambda it: predicted(it, totals.value), PREDICTED), "zstd")
    dropped(spark, model)
    places = counted.select("part", "packs", "lengths", "places")
    answered = pairs.join(places, "part").mapInPandas(answers, ANSWERS)
    by_pack = answered.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("part", "logs", "known"))).alias("answers"))
    own = merged.where("own >= 0").select(F.col("own").alias("pack"), "sizes", "times", "docs", "ids")
    vocabulary = start[0].vocabulary
    out = own.join(by_pack, "pack").mapInPandas(lambda it: summed(it, vocabulary, train_tokens), SCORES)
    doc_id = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    return out.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
