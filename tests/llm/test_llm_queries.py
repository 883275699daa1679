"""The registered queries: against SQL where there is some, else against plain versions."""

import hashlib

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as entry
import check_sql
from sourceloom.llm import queries
from tests.llm import brute
from tests.llm.test_ann import exact
from tests.llm.test_html import text
from tests.llm.test_lm import check_base
from tests.llm.test_tokens import RANKS, encoding
from tests.llm.test_tokens import brute as section_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in check_sql.TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    return {"documents": read("documents", "doc_id", "text"), "pages": read("pages", "page_id", "html"), "embeddings": read("embeddings", "vec_id", "embedding")}


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, database, name):
    got, want = run(spark, name).toPandas(), database.execute(queries.SQL[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert check_sql.rows(got) == check_sql.rows(want)


def test_html(spark, tables):
    got = {r.page_id: (r.text, r.n_chars) for r in run(spark, "op2_html_extraction").collect()}
    assert got == {i: (text(h), len(text(h))) for i, h in tables["pages"]}


def test_pieces(spark, tables):
    plain = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    got = {r.doc_id: (r.ids, r.n_ids, r.decoded_sha256, r.round_trip) for r in run(spark, "op4_sentencepiece").collect()}
    assert got == {i: (ids := plain.encode(t), len(ids), hashlib.sha256(t.encode()).hexdigest(), True) for i, t in tables["documents"]}


def test_repeats(spark, tables):
    rows = sorted(tables["documents"])
    want = {}
    for (i, t), hit in zip(rows, brute.covered([t for _, t in rows], 100), strict=True):
        data = t.encode()
        rest = bytes(b for p, b in enumerate(data) if p not in hit)
        want[i] = (len(data), len(hit), len(brute.span_list(hit)), hashlib.sha256(rest).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op6_suffix_array_dedup").collect()} == want


def test_tokens(spark, tables):
    coder = encoding(open(RANKS, "rb").read(), queries.BYTE_BPE_PATTERN)
    want = sorted((i, s, a, b, n) for i, t in tables["documents"] for s, a, b, n in section_counts(t, coder))
    got = run(spark, "op7_token_counts")
    assert sorted((r.doc_id, r.section, r["first"], r["last"], r.n_tokens) for r in got.collect()) == want
    sums = {i: sum(n for k, *_, n in want if k == i) for i, _ in tables["documents"]}
    assert {r.doc_id: r.doc_tokens for r in got.select("doc_id", "doc_tokens").distinct().collect()} == sums


def test_neighbours(spark, tables):
    want = exact(tables["embeddings"], 20)
    got = [tuple(r) for r in run(spark, "op8_nearest_neighbours").collect()]
    assert len(got) == len(want) and len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)


def test_lm(spark, tables):
    got = run(spark, "op9_lm_scoring").collect()
    check_base(tables["documents"], got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_quality(spark, tables):
    got = {r.doc_id: r for r in run(spark, "op10_quality_classifier").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == {i for i, _ in tables["documents"]}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == q for i, q in labels.items()) >= 0.85 * len(labels)
