import collections
import math
import pathlib
import zlib

import numpy as np

from sourceloom.llm import lm
from sourceloom.llm.shared import shared_folder
from tests.llm import brute
from tests.llm.conftest import prose


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def check_base(rows, got):
    counts = collections.Counter()
    for i, text in rows:
        if not held_out(i):
            counts.update([*brute.spaced(text), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        own = [*brute.spaced(text), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.append((i, held_out(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted(want, key=repr) == sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr)


def test_base_and_held_out_perplexity(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 20_000)
    monkeypatch.setattr(lm, "PACK_TOKENS", 700)
    words = [f"w{int(k)}" for k in np.random.default_rng(1).zipf(1.5, 40_000)]
    following = {w: f"f{len(w) * 7 % 5}" for w in words}
    rows = [(k, " ".join(x for w in words[k * 100 : k * 100 + 100] for x in (w, following[w]))) for k in range(300)]
    got = lm.scores(docs_of(rows)).collect()
    check_base(rows, got)
    out = [r for r in got if r.held_out]
    assert len(out) > 20
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(odd, docs_of):
    got = lm.scores(odd).collect()
    check_base([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.scores(docs_of([(1, "x")]).limit(0)).count() == 0
    assert [r.score for r in lm.scores(docs_of([(None, "a b")])).collect()] == [0.0]


def test_probabilities_of_a_context_sum_to_one(docs_of):
    """Over all words of the vocabulary and the unknown one."""
    rows = [(k, prose(k, 60)) for k in range(30)]
    texts = docs_of(rows).select("text")
    packed = texts.mapInArrow(lambda it: lm.count_batches(it, 1), lm.COUNTS)
    merged = packed.groupBy("part").applyInPandas(lm.merge, lm.COUNTS).toPandas().assign(tables=None, parent_tables=None)
    row = next(merged.itertuples())
    sizes, contexts, counts = (np.frombuffer(getattr(row, n), t).astype(np.int64) for n, t in (("sizes", np.int32), ("contexts", np.int16), ("counts", np.int64)))
    customers = np.bincount(contexts, counts, lm.CONTEXTS)
    tables = np.bincount(contexts, minlength=lm.CONTEXTS).astype(float)
    start = lm.Totals(customers, tables, tables.sum(), len(sizes), len(sizes), 0.7, 0.6)
    seated = next(lm.sweep(iter([merged]), start, 3, 1, 0))
    t, s = np.frombuffer(seated.tables[0], np.float32), np.frombuffer(seated.parent_tables[0], np.float32)
    assert ((t >= 1) & (t <= counts)).all()
    totals = lm.Totals(customers, np.bincount(contexts, t, lm.CONTEXTS), t.sum(), s.sum(), len(sizes), 0.7, 0.6)
    model = lm.Model.of(next(seated.itertuples()), totals)
    unknown = totals.parent(np.zeros(1), np.zeros(1))[0]
    words = np.arange(len(sizes))
    for c in [*np.flatnonzero(customers)[:20].tolist(), int(np.flatnonzero(customers == 0)[0])]:
        room = (lm.THETA + totals.discount * totals.tables[c]) / (lm.THETA + customers[c])
        p = model.seated(words, np.full(len(words), c)) / (lm.THETA + customers[c]) + room * model.parent
        assert abs(p.sum() + room * unknown - 1) < 1e-4


def test_seating_follows_its_odds():
    """Expected tables of the one-by-one rule, also where customers come in blocks."""
    chance = np.random.default_rng(3)
    for customers, mass in ((5, 0.3), (31, 2.0), (400, 1.5)):
        expect, tables = [], np.ones(4_000)
        for k in range(1, customers):
            tables += chance.random(4_000) < mass / (mass + k - 0.5 * tables)
        expect = tables.mean()
        got = lm.seat(np.full(4_000, customers), np.full(4_000, mass), 0.5, chance).mean()
        assert abs(got - expect) < 0.05 * expect + 0.05


def test_every_word_before_is_a_context_of_its_own(docs_of, monkeypatch):
    """40,000 different words, each always followed by one of its own: as many contexts."""
    monkeypatch.setattr(lm, "PART_BYTES", 300_000)
    train = [k for k in range(400) if not held_out(k)]
    out = [k for k in range(400, 500) if held_out(k)][:3]
    text = lambda a, b: " ".join(f"a{k} b{k}" for k in range(a, b))
    step = -(-40_000 // len(train))
    rows = [(i, " ".join([text(k * step, (k + 1) * step)] * 3)) for k, i in enumerate(train)]
    rows += [(i, text(k * 900, k * 900 + 800)) for k, i in enumerate(out)]
    packed = docs_of(rows[:-3]).select("text").mapInArrow(lambda it: lm.count_batches(it, 1), lm.COUNTS)
    row = next(packed.groupBy("part").applyInPandas(lm.merge, lm.COUNTS).toPandas().itertuples())
    assert len(np.frombuffer(row.keys, np.uint64)) > 80_000
    sizes, number = np.frombuffer(row.sizes, np.int32), lm.numbers(row)
    customers = np.bincount(number, np.frombuffer(row.counts, np.int64))
    assert len(sizes) > 80_000 and np.median(customers) == 3  # not those of other words before
    got = {r.doc_id: r for r in lm.scores(docs_of(rows)).collect()}
    check_base(rows, got.values())
    for i in out:
        # Of each two tokens, the second is sure once the first is known.
        assert got[i].score - got[i].base_score > got[i].n_tokens


def test_sums_of_contexts_over_all_parts(docs_of):
    rows = [(k, prose(k, 60)) for k in range(30)]
    texts = docs_of(rows).selectExpr("text", "doc_id % 5 = 0 as held")
    packed = texts.mapInArrow(lambda it: lm.count_batches(it, 7), lm.COUNTS)
    merged = packed.groupBy("part").applyInPandas(lm.merge, lm.COUNTS).selectExpr("*", "cast(null as binary) tables", "cast(null as binary) parent_tables")
    customers, asked = collections.Counter(), []
    for row in lm.with_contexts(merged, 5).toPandas().itertuples():
        keys, number = np.frombuffer(row.keys, np.uint64), lm.numbers(row)
        sums = np.concatenate([np.frombuffer(x["customers"]) for x in row.found])
        assert len(sums) == len(keys)
        asked += zip(keys.tolist(), sums.tolist(), strict=True)
        for k, n in zip(keys[number].tolist(), np.frombuffer(row.counts, np.int64).tolist(), strict=True):
            customers[k] += n
    assert all(customers[k] == n for k, n in asked) and sum(n for _, n in {*asked}) == 24 * 61


def exact_tables(customers, mass, discount):
    """Expected tables where ``t`` of them have the odds ``mass ** t`` times a generalised Stirling number."""
    ways = np.zeros(customers + 2)
    ways[1] = 1.0
    for n in range(1, customers):
        t = np.arange(1, customers + 2)
        ways[1:] = ways[:-1] + np.maximum(n - discount * t, 0) * ways[1:]
        ways /= ways.sum()
    odds = ways * mass ** np.arange(customers + 2)
    return (odds * np.arange(customers + 2)).sum() / odds.sum()


def test_customers_are_taken_out_and_seated_again():
    """Many turns reach the distribution that leaves every customer's odds given the others as they are."""
    chance = np.random.default_rng(5)
    for customers, mass, pairs in ((2, 0.4, 4_000), (3, 2.0, 4_000), (12, 0.3, 4_000), (60, 1.5, lm.FEW - 1), (60, 1.5, 600)):
        n = np.full(pairs, customers)
        state, seen = (np.zeros(pairs, np.int64), np.empty(0, np.int64)), []
        turns = 80 if pairs > lm.FEW else 400
        for k in range(turns):
            state = lm.reseated(n, state, np.full(pairs, mass), np.zeros(pairs), 0.5, chance)
            first = np.cumsum(state[0]) - state[0]
            assert (np.add.reduceat(state[1], first) == n).all() and (state[1] > 0).all()
            if k >= turns // 4:
                seen.append(state[0].mean())
        want = exact_tables(customers, mass, 0.5)
        assert abs(np.mean(seen) - want) < 0.05 * want


def test_one_turn_starts_from_the_seating_before():
    """From one large table a turn with little odds for new ones opens few; customers come and leave."""
    chance, pairs = np.random.default_rng(6), 500
    start = np.ones(pairs, np.int64), np.full(pairs, 40)
    nothing = np.zeros(pairs)
    assert (lm.reseated(np.full(pairs, 40), start, nothing, nothing, 0.5, chance)[0] == 1).all()
    for n in (25, 40, 55):
        tables, sizes = lm.reseated(np.full(pairs, n), (np.full(pairs, 20), np.full(pairs * 20, 2)), nothing, nothing, 0.5, chance, again=False)
        assert sizes.sum() == n * pairs and (tables <= 20).all() and tables.mean() > 12


def test_copies_of_earlier_rounds_are_deleted(spark, docs_of):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {*folder.glob("sourceloom-*")}
    got = lm.scores(docs_of([(k, prose(k, 60)) for k in range(20)]))
    assert got.count() == 20 and len({*folder.glob("sourceloom-*")} - before) == 2
    assert got.count() == 20  # what is left can be read again


def exact_odds(customers, mass, slope, discount):
    """Of each number of tables, where ``t`` have the odds ``mass * (mass + slope) * ..`` times a generalised Stirling number."""
    ways = [0.0, 1.0]
    for n in range(1, customers):
        ways = [0.0, *(ways[t - 1] + (n - discount * t) * (ways[t] if t <= n else 0.0) for t in range(1, n + 2))]
        ways = [w / sum(ways) for w in ways]
    odds = np.array(ways) * np.cumprod([1.0, mass, *(mass + slope * t for t in range(1, customers))])
    return odds / odds.sum()


def test_tables_drawn_at_once_have_their_exact_odds(monkeypatch):
    """Also where the odds run out only beyond the first width, and of mixed numbers of customers."""
    chance = np.random.default_rng(8)
    kinds = [(1, 0.5, 0.1), (2, 0.4, 0.1), (3, 2.0, 0.0), (7, 1e-9, 1e-9), (12, 0.3, 0.2), (60, 1.5, 0.3), (90, 9.0, 0.4), (70, 80.0, 0.0)]
    customers, mass, slope = (np.repeat(x, 8_000) for x in zip(*kinds, strict=True))
    for width, ratios in ((lm.WIDTH, lm.RATIOS), (4, 40)):
        monkeypatch.setattr(lm, "WIDTH", width)
        monkeypatch.setattr(lm, "RATIOS", ratios)
        lm.first_ratios.cache_clear()
        mixed = chance.permutation(len(customers))
        got = np.empty(len(customers), np.int64)
        got[mixed] = lm.Drawing(0.5, chance).tables(customers[mixed], mass[mixed], slope[mixed])
        for k, kind in enumerate(kinds):
            want = exact_odds(*kind, 0.5)
            seen = np.bincount(got[k * 8_000 : (k + 1) * 8_000], minlength=len(want)) / 8_000
            assert len(seen) == len(want) and np.abs(np.cumsum(seen) - np.cumsum(want)).max() < 0.025
    lm.first_ratios.cache_clear()


def test_pairs_are_seated_one_by_one_only_if_large(docs_of, monkeypatch):
    rows = [(k, " ".join(["a b"] * 300) + " " + prose(k, 60)) for k in range(30)]
    seated, one_by_one = [], lm.Seating.turn

    def counted(self, *how):
        seated.append(self.n)
        return one_by_one(self, *how)

    packed = docs_of(rows).select("text").mapInArrow(lambda it: lm.count_batches(it, 1), lm.COUNTS)
    merged = packed.groupBy("part").applyInPandas(lm.merge, lm.COUNTS).toPandas().assign(tables=None, parent_tables=None)
    counts, number = np.frombuffer(merged.counts[0], np.int64), lm.numbers(next(merged.itertuples()))
    tables, vocabulary = np.bincount(number).astype(float), len(np.frombuffer(merged.sizes[0], np.int32))
    totals = lm.Totals(np.bincount(number, counts), tables, tables.sum(), vocabulary, vocabulary, 0.7, 0.6)
    monkeypatch.setattr(lm.Seating, "turn", counted)
    first = next(lm.sweep(iter([merged]), totals, 1, 0, 1))
    list(lm.sweep(iter([first]), totals, 2, 0, 2))
    assert sum((counts > lm.DRAWN).tolist()) == 2 and [n.tolist() for n in seated] == [sorted(counts[counts > lm.DRAWN].tolist(), reverse=True)] * 6


def test_order_of_hashes_whose_first_bits_are_alike():
    chance = np.random.default_rng(9)
    for x in (chance.integers(0, 1 << 64, 5_000, np.uint64), chance.integers(0, 40, 5_000).astype(np.uint64), np.empty(0, np.uint64), np.full(3, (1 << 64) - 1, np.uint64)):
        order = lm.order_of(x)
        assert (x[order] == np.sort(x)).all() and sorted(order.tolist()) == list(range(len(x)))
        distinct, number = lm.numbered(x)
        assert distinct.tolist() == sorted({*x.tolist()}) and (distinct[number] == x).all()
        other = np.roll(x, 1) // np.uint64(3)
        assert (lm.order_of_pairs(x, other) == np.lexsort((other, x))).all()
