import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sourceloom.llm import manifest
from tests.llm.conftest import LONG, prose

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [None if v is None else str(v) for v in row]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climbed(nodes, at):
    """Root of a list of hashes, and for one of them the hashes beside it, level by level."""
    steps = []
    while len(nodes) > 1:
        run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
        steps.append((run[: at % 3], run[at % 3 + 1 :]))
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], steps


def expected(rows):
    """Sorted result rows by a plain version."""
    groups = {}
    for row in rows:
        groups.setdefault("" if row[1] is None else "=" + row[1], []).append(row)
    names = sorted(groups, key=lambda k: k.encode())
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in names}
    roots = [climbed([leaf(r) for r in ordered[k]], 0)[0] for k in names]
    out = []
    for g, k in enumerate(names):
        leaves = [leaf(r) for r in ordered[k]]
        root, upper = climbed(roots, g)
        for i, r in enumerate(ordered[k]):
            path = climbed(leaves, i)[1] + upper
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].replace("\n", "") if changed else r[4]))
            for left, right in path:
                h = digest("".join(left) + h + "".join(right))
            proof = digest("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaves[i], roots[g], root, proof, h, h == root))
    return sorted(out, key=repr)


def result(docs):
    text = F.replace("text", F.lit("\n"), F.lit(""))
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, text).otherwise(F.col("text"))
    tampered = manifest.leaf_hash(*(F.col(c) for c in COLUMNS[:-1]), other)
    rows = manifest.manifest(docs, COLUMNS, "source", "doc_id", {"doc_id": F.col("doc_id"), "tampered": tampered})
    rows = rows.withColumn("folded", manifest.folded(F.col("tampered"), F.col("path")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256), "folded", F.expr("folded = root"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def frame(spark, rows):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, at int, node int, hash string, rank int, path int"
    return spark.createDataFrame([(*r, "k", 1, 2, "h", 3, 4) for r in rows], schema)


def test_odd_rows(spark):
    rows = [
        (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, None, "de", 0, ""), (None, "a", "en", 1, "z"), (None, None, None, None, None),
        (5, "b", "en", 4, LONG + "\n"), (5, "b", "en", 4, LONG + "\n"), (5, "b", "en", 5, "tie\n"), (7, "Z", "en", 1, "1"), (8, "é", "en", 1, "\n"), (9, "", "x", 9, "-"),
    ]
    assert result(frame(spark, rows)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    rows = [(i * 7 % 31, "s", "en", i, prose(i, 5) + "\n") for i in range(n)]
    assert result(frame(spark, rows)) == expected(rows)


def test_many_tiers_and_split_ranks(spark, monkeypatch):
    """Blocks of nine rows and ranges of ten: three tiers, and ranks of a hot group in several tasks."""
    monkeypatch.setattr(manifest, "DIGITS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    monkeypatch.setattr(manifest, "RANGES", manifest.SkewPolicy(max_rows=10))
    monkeypatch.setattr(manifest.leaves_below, "__defaults__", (2,))
    rows = [(i % 190, "hot" if i % 3 else f"s{i % 33}", "en", i, f"text {i}\n") for i in range(300)] + [(4, "hot", "en", 1, "same\n")] * 30
    assert result(frame(spark, rows)) == expected(rows)


def test_empty(spark):
    assert result(frame(spark, [])) == []


def test_leaf_bytes(spark):
    got = spark.range(1).select(manifest.leaf_hash(F.lit("é"), F.lit(None).cast("string"), F.lit(12))).first()[0]
    assert got == digest("2:é-2:12")
