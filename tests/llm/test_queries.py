"""The registered queries, and DuckDB's answer where there is one."""

import duckdb

from ledgerlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_rotation_like_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(ORACLES["op8_rotation"])
    got = QUERIES["op8_rotation"](spark, SF).select(*want.columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall()))


def test_every_document_has_its_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_hilbert_shards", "op3_merkle", "op6_media", "op7_chosen_path", "op10_word_bpe"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n
    assert QUERIES["op4_language_id"](spark, SF).count() == QUERIES["op9_html_text"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
