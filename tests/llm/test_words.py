import random

import pyarrow as pa
import pytest

from sourceloom.llm.words import LETTERS, NON_SPACE, shingles, slices, words
from tests.llm import brute

CASES = ["", None, "a", " a ", "Ab9 c-d\u00a0e\n\tf", "漢字 É\x85é", "x" * 3_000_000, "a b", "b"]


@pytest.mark.parametrize(("letters", "plain"), [(NON_SPACE, brute.spaced), (LETTERS, brute.lettered)])
def test_words_are_those_of_the_pattern(letters, plain):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("aB 9\t\n-\u00e9\u6f22.") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = words(pa.array(texts), letters)
    hashes = {}
    for i, text in enumerate(texts):
        own = [found.text(k, k + 1).decode() for k in range(found.first[i], found.first[i + 1])]
        assert own == plain(text)
        for k, w in enumerate(own):
            assert hashes.setdefault(w, found.hash[found.first[i] + k]) == found.hash[found.first[i] + k]
    assert len(set(hashes.values())) == len(hashes)


def test_shingles_stay_in_their_document():
    found = words(pa.array(["a b c", "b c", "d"]), NON_SPACE)
    value, at = shingles(found, 2)
    assert at.tolist() == [0, 1, 3]
    assert value[1] == value[2] != value[0]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 50, "", "d"]})
    parts = list(slices(iter([batch]), "text", 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == ["ab", None, "c" * 50, "", "d"]
    assert len(parts) > 1
