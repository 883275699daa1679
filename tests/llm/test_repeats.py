import random

import pytest

from sourceloom.llm import repeats
from sourceloom.llm.suffixes import suffix_array
from tests.llm import brute
from tests.llm.conftest import prose


def test_suffix_array_like_sorting():
    rng = random.Random(7)
    for _ in range(1_500):
        top = rng.choice([0, 1, 2, 6])
        text = [rng.randint(0, top) for _ in range(rng.randint(0, 50))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in ([3] * 300, [1, 2] * 150, list(range(200)), list(range(200, 0, -1))):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def corpus():
    rng = random.Random(3)
    shared = [prose(k, rng.choice([14, 20, 60])) for k in range(5)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 700), (5, "ab" * 300), (6, prose(9, 40) * 3), (70, "é漢" * 60), (71, "x" + "é漢" * 60)]
    for k in range(40):
        parts = [prose(100 + k, 8)]
        for _ in range(rng.randint(1, 3)):
            text = rng.choice(shared)
            cut = rng.randint(0, 30)
            parts += [text[cut : len(text) - rng.randint(0, 30)], prose(200 + k, rng.randint(0, 6))]
        rows.append((100 + k, " ".join(parts)))
    return rows + [(300, rows[9][1]), (301, rows[9][1][:-1] + "!")]


def check(found, rows, length=100):
    ordered = sorted(rows)
    hits = brute.covered([t for _, t in ordered], length)
    want = {}
    for (i, text), hit in zip(ordered, hits, strict=True):
        data = (text or "").encode()
        want[i] = (len(data), brute.span_list(hit), bytes(b for p, b in enumerate(data) if p not in hit))
    got = {r.row.doc_id: (r.n_bytes, [(s["first"], s["last"]) for s in r.spans], bytes(r.rest)) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize(("group", "piece"), [(256 << 10, 1 << 20), (0, 1 << 20), (256 << 10, 64)])
def test_like_brute_force(docs_of, monkeypatch, group, piece):
    """With one group, with all windows dealt by hash, and with texts in small pieces."""
    if not group:
        monkeypatch.setattr(repeats, "GROUP_BYTES", 1)
    plain = repeats.text_pieces
    monkeypatch.setattr(repeats, "text_pieces", lambda data, length: plain(data, length, piece))
    rows = corpus()
    random.Random(1).shuffle(rows)
    check(repeats.without_repeats(docs_of(rows)), rows)


def test_odd_rows(odd, docs_of):
    got = [(r.row.doc_id, r.n_bytes, [tuple(s) for s in r.spans], len(r.rest)) for r in repeats.without_repeats(odd, carry=odd.columns).collect()]
    one = len(prose(1, 80))
    assert sorted(x for x in got if x[0] in (1, 8)) == [(1, one, [], one), (1, one, [], one), (8, one, [(0, one)], 0)]
    assert sum(x[1] for x in got) == sum(len((r.text or "").encode()) for r in odd.collect())
    assert repeats.without_repeats(odd, carry=odd.columns).select("row.*").columns == ["doc_id", *(c for c in odd.columns if c != "doc_id")]
    assert repeats.without_repeats(docs_of([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [5, None])
@pytest.mark.parametrize("group", [1 << 20, 1])
def test_texts_with_one_id_and_a_shared_opening(docs_of, monkeypatch, doc_id, group):
    """Both lose what also starts in an earlier document."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", group)
    opening = prose(1, 60)
    first = "x " + opening[50:300]
    texts = [opening + prose(k, 40) for k in (2, 3, 4)]
    got = repeats.without_repeats(docs_of([(1, first), *((doc_id, t) for t in texts)]), carry=["text"])
    want = {t: brute.span_list(brute.covered([first, t], 100)[1]) for t in texts}
    assert all(want.values())
    assert {r.row.text: [tuple(s) for s in r.spans] for r in got.collect() if r.row.doc_id == doc_id} == want


def test_rest_as_text(docs_of):
    """As text, the rest is its bytes without broken characters."""
    shared = "é漢" * 60
    rows = [(1, "a" + shared), (2, "é" + shared + "z"), (3, None), (4, "x" * 99 + "é")]
    as_bytes = {r.row.doc_id: r.rest for r in repeats.without_repeats(docs_of(rows)).collect()}
    as_text = {r.row.doc_id: r.rest for r in repeats.without_repeats(docs_of(rows), as_text=True).collect()}
    assert as_text == {i: bytes(b).decode("utf-8", "ignore") for i, b in as_bytes.items()}
    assert as_text[3] == "" and as_text[4] == rows[3][1] and len(as_text[2]) < len(rows[1][1])
