import random

import numpy as np
import pyarrow as pa
import pytest

from sourceloom.llm import near
from sourceloom.llm.words import NON_SPACE, words
from tests.llm import brute
from tests.llm.conftest import prose


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
    return " ".join(w)


def corpus(seed):
    """Copies, near copies around the limit, chains of edits, tiny sets and strangers."""
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "ONE", "two", "a b", "A  b", "b a", "a b c d e f", "a b c d e f g"]
    for k in range(6):
        base = prose(k, rng.choice([12, 40, 120]))
        texts += [base, base] + [edited(base, rng, rng.randint(1, 6)) for _ in range(6)]
        chained = base
        for _ in range(6):
            chained = edited(chained, rng, 2)
            texts.append(chained)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("size", "leaders", "block"), [(2, True, 256), (5, True, 256), (2, False, 3)])
def test_like_brute_force(docs_of, monkeypatch, size, leaders, block):
    """Also without leaders, when only the comparison in blocks is left."""
    if not leaders:
        plain = near.leader_pairs
        monkeypatch.setattr(near, "leader_pairs", lambda bands: plain(bands).limit(0))
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus(size)
    want = brute.classes(dict(rows), size)
    got = near.near_duplicates(docs_of(rows), size=size).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute.shingle_set(t, size)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(odd, docs_of):
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near.near_duplicates(odd, size=2).collect()), key=repr)
    want = [(1, True, 1, True), (2, False, 2, True), (3, False, 3, True), (4, False, 4, True), (5, True, 5, True), (1, True, 1, True), (6, True, 6, True),
            (7, True, 6, False), (8, True, 1, False), (None, True, None, True), (9, True, 9, True), (6, True, 6, True)]
    assert got == sorted(want, key=repr)
    assert near.near_duplicates(docs_of([(1, "x")]).limit(0)).count() == 0


def test_registers_and_estimate():
    rng = random.Random(1)
    base = [f"w{k}" for k in range(3_000)]
    other = [w if rng.random() < 0.9 else f"x{w}" for w in base]
    value, first = near.shingle_sets(words(pa.array([" ".join(base), " ".join(other), "a b", "", "q"]), NON_SPACE), 2)
    held = near.registers(value, first)
    n = np.diff(first)
    assert n.tolist() == [2_999, len({tuple(other[i : i + 2]) for i in range(2_999)}), 1, 0, 1]
    a, b = set(value[first[0] : first[1]].tolist()), set(value[first[1] : first[2]].tolist())
    guess, used = near.estimate(held[:1], held[1:2], n[:1], n[1:2])
    assert used[0] == near.BUCKETS and abs(guess[0] - len(a & b) / len(a | b)) < 0.2
    assert (held[2] > 0).sum() == 1 and (near.filled(held)[2] > 0).all() and not near.filled(held)[3].any()
    # Leading zeros and mantissa are those of the least value of the bucket.
    rest = near.mix(near.mix(value[first[2] : first[3]])) | np.uint64(1)
    bits = f"{int(rest[0]):064b}"
    zeros = bits.index("1")
    assert held[2].max() == (zeros + 1) << near.MANTISSA | int((bits[zeros + 1 :] + "0" * 64)[: near.MANTISSA], 2)


def test_rows_without_id_keep_their_links(docs_of):
    """A near copy whose only id is null is linked, and bridges others."""
    a = prose(900, 200).split()
    b = [*a[:90], "changed", *a[91:]]
    c = [*b[:20], "more", *b[21:40], "words", *b[41:]]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (None, prose(901, 60)), (None, prose(901, 60))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs_of(rows), size=2).collect()), key=repr)
    assert {(i, c) for i, _, c in got} == {(1, 1), (None, 1), (7, 1), (None, None)}


def test_long_words_are_told_apart(docs_of):
    """Two words of 1,024 letters that sums of powers modulo 2**64 cannot tell apart."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs_of([(10, a), (11, b), (12, a)])).collect()}
    assert got == {10: 10, 11: 11, 12: 10}
