"""The registered queries: their columns and rows, over the smallest tables."""

import os

import duckdb
import pytest

from mapquarry.llm import queries

DIR = os.environ.get("MAPQUARRY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")

CONTRACT = {
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, DIR)
    for column in CONTRACT.get(name, "").split(", "):
        if column:
            n, kind = column.split()
            assert dict(got.dtypes)[n] == kind, column
    rows = got.collect()
    if name == "op9_decontamination":
        assert rows
    else:
        table = "pages" if name.startswith("op7") else "documents"
        assert len(rows) == duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if sql := queries.oracle_sql().get(name):
        want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)


def test_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}


def test_benchmark_passages_are_found(spark, duck):
    """Every document that holds an item word for word is reported with it."""
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op9_decontamination"](spark, DIR).collect()}
    want = set(duck.sql("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    assert want and want <= got


def test_clean_documents_are_kept(spark, duck):
    """Quality labels: hardly a good document that passes the base rules is rejected, and most bad ones are."""
    kept = {r.doc_id: r for r in queries.queries()["op2_quality_rules"](spark, DIR).collect()}
    good = [kept[i] for (i,) in duck.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()]
    bad = [kept[i] for (i,) in duck.sql("SELECT doc_id FROM labels WHERE quality = 0").fetchall()]
    assert all(r.kept for r in good if not r.base_failed)
    assert sum(not r.kept for r in bad) >= 0.75 * len(bad)
