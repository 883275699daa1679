import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from sourceloom.llm.pieces import SuffixArray, decoded, encoded, vocabulary

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_are_the_model_s_own(plain):
    rng = random.Random(2)
    letters = " abcdeithe.nsr  \n\t▁é漢\u0000\U0001f600<s>"
    texts = ["", None, " ", "</s> x", "<0x41>", "a" * 20_000, "汉字" * 5_000, " " * 1_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2_000)]
    vocab = vocabulary(open(MODEL, "rb").read())
    for part in (texts[:900], texts[900:], texts[:50]):  # known and new segments
        ids, first = vocab.encoder.encode(pa.array(part))
        want = plain.encode([t or "" for t in part], num_threads=1)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
        vocab.encoder.forget()


def test_suffix_array_finds_all_occurrences():
    rng = random.Random(5)
    text = np.array([rng.randint(1, 3) for _ in range(400)])
    index = SuffixArray(text, 6)
    patterns = [[rng.randint(1, 4) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    wide = np.array([p + [-1] * (6 - len(p)) for p in patterns])
    low, high = index.find(wide, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.order[a:b].tolist()) == want


def test_rows(spark, odd, docs_of, plain):
    rows = decoded(encoded(odd, MODEL), MODEL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    for r in rows:
        assert r.ids == plain.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    both = encoded(odd, MODEL, back=True).select("doc_id", "ids", "decoded").collect()
    assert sorted(map(repr, both)) == sorted(repr(r) for r in decoded(encoded(odd, MODEL), MODEL).select("doc_id", "ids", "decoded").collect())
    assert encoded(docs_of([(1, "x")]).limit(0), MODEL).count() == 0
    lists = spark.createDataFrame([(1, None, "z"), (2, [], "z"), (3, [1, 259, 0, 264, 13], "z")], "doc_id bigint, ids array<int>, decoded string")
    assert [r.decoded for r in decoded(lists, MODEL).orderBy("doc_id").collect()] == ["", "", plain.decode([1, 259, 0, 264, 13])]


def test_long_segments_are_told_apart(spark, docs_of):
    """Two words of 1,024 letters that sums of powers modulo 2**64 cannot tell apart."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.ids, r.decoded) for r in encoded(docs_of([(1, a), (2, b), (3, f"{a} {b}")]), MODEL, back=True).collect()}
    assert got == {i: (plain.encode(t), t) for i, t in [(1, a), (2, b), (3, f"{a} {b}")]}
