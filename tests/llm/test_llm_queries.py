"""The registered queries against their SQL, and the pipeline stage by stage."""

import glob
import os

import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F

import corpus_pipeline
from depot.llm.decontam import contamination
from depot.llm.queries import QUERIES, captured_pages
from depot.operators.durable import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = {
    "op1_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_kneser_ney": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_vector_join": ["vec_id", "n_links", "component_id", "kept"],
    "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op13_hard_negatives": [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ],
}
#: Where the rows of a query come from, if not one for each document; none for those that select rows.
TABLES = {
    "op8_warc": ("pages", "page_id"),
    "op11_vector_join": ("embeddings", "vec_id"),
    "op12_ranked_search": (None, None),
    "op13_hard_negatives": (None, None),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_a_row_for_every_row(spark, name):
    df = QUERIES[name][0](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table, of = TABLES.get(name, ("documents", "doc_id"))
    if of is None:
        return
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(of).collect()}
    got = [r[0] for r in df.select(of).collect()]
    assert set(got) == want and (len(got) == len(want) or name == "op2_packing")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(QUERIES[name][1])
    names = [d[0] for d in result.description]
    df = QUERIES[name][0](spark, SF)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_pages_of_any_id_have_a_time(spark, tmp_path):
    html = "<p>" + "same " * 40
    pages = [(i, f"http://h/{i}", html) for i in (5 * 10**12, 2**62, -(2**63), 0, None, 10**9 + 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op8_warc"][0](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[-(2**63)].record_type == "response"
    assert {r.refers_to for r in got.values()} == {None, -(2**63)}
    own = df.withColumns({"captured": F.lit("20200102030405"), "digest": F.lit("x"), "key_range": F.lit(1)})
    times = {r.captured for r in captured_pages(own).collect()}
    assert times == {"20200102030405"}
    broken = captured_pages(own.withColumn("captured", F.lit("x"))).select("captured").collect()
    assert all(len(r.captured) == 14 and r.captured[:2] == "20" for r in broken)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            want = contamination(before, items).where("not contaminated").select("doc_id")
            assert docs.select("doc_id").exceptAll(want).isEmpty() and want.count() == counts[-1]
        if name == "personal_data":
            assert docs.where(F.col("text").contains("[EMAIL]")).count() > 0
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_of_awkward_rows(spark, awkward):
    docs = awkward.withColumn("n_chars", F.length("text"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
    assert 0 < docs.count() < len(AWKWARD)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), f"empty-{name}")
        assert empty.isEmpty()
