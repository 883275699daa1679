import numpy as np
import pytest

from sourceloom.llm import queries
from sourceloom.llm.tokens import attribute, encoding, section_tokens

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize(("first", "last", "want"), [(0, 3, 0), (3, 6, 1), (2, 4, 0), (1, 4, 0), (2, 5, 1), (2, 9, 1), (5, 8, 2), (6, 9, 2)])
def test_rule_for_boundaries(first, last, want):
    """Sections [0, 3), [3, 6), [6, 9): most characters count, of equal ones the first."""
    assert attribute(np.array([first]), np.array([last]), np.array([0, 3, 6]), 9).tolist() == [want]


def brute(text, coder):
    """Sections by characters, and for each token the section of most of its characters."""
    text, owner, starts, section = text or "", [], [0], 0
    for i, c in enumerate(text):
        owner.append(section)
        if c == "\n" and i + 1 < len(text):
            section += 1
            starts.append(i + 1)
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, at = [0] * len(starts), 0
    for t in coder.encode_ordinary(text):
        size = len(coder.decode_single_token_bytes(t))
        chars = [owner[i] for i in sorted(set(of_byte[at : at + size]))]
        counts[max(sorted(set(chars)), key=lambda s: (chars.count(s), -s))] += 1
        at += size
    return [(k, a, b, n) for k, (a, b, n) in enumerate(zip(starts, [*starts[1:], len(text)], counts, strict=True))]


def test_like_brute_force(spark, odd, docs_of):
    coder = encoding(open(RANKS, "rb").read(), queries.BYTE_BPE_PATTERN)
    more = docs_of([(20, "a\n\n\n\nb\n"), (21, "\n"), (22, "\n\n \n\t\n\n\n x"), (23, "漢字\n\U0001f600\n é\n"), (24, "é" * 40 + "\n" * 40)])
    rows = odd.union(more)
    got = section_tokens(rows, RANKS, queries.BYTE_BPE_PATTERN).collect()
    want = [(r.doc_id, brute(r.text, coder)) for r in rows.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, [tuple(s) for s in r.sections]) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == sum(s.n_tokens for s in r.sections) for r in got)
    assert section_tokens(rows.limit(0), RANKS, queries.BYTE_BPE_PATTERN).count() == 0
