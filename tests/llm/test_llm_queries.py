"""The registered queries on the smallest tables: names, columns, whole results, and SQL where there is some."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seismopair.llm import queries

COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_ann": "query_id rank vec_id score",
    "op3_minhash": "doc_id class_id component_id kept",
    "op4_langid": "doc_id held_out lang_pred score",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_quality": "doc_id held_out score predicted",
    "op9_covertree": "vec_id n_links component_id kept",
    "op10_toxicity": "doc_id held_out score predicted",
}


def test_every_operator_has_a_query():
    assert set(queries.QUERIES) == set(COLUMNS) and set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    assert found.columns == COLUMNS[name].split()
    rows = found.collect()
    tables = {"op1_warc": "pages", "op9_covertree": "embeddings"}
    whole = spark.read.parquet(f"{sf}/{tables.get(name, 'documents')}.parquet").count()
    if name not in ("op2_ann", "op5_packing"):
        assert len(rows) == whole
    if name in queries.ORACLES:
        c = duckdb.connect()
        for p in glob.glob(f"{sf}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        told = c.execute(queries.ORACLES[name])
        assert [d[0] for d in told.description] == found.columns
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, told.fetchall()))


def test_pipeline_keeps_its_promises(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "repeats", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, sf)
        assert after.columns == docs.columns
        n = after.count()
        assert 0 < n <= before and (name != "repeats" or n == before)
        docs, before = after, n
    pieces = corpus_pipeline.run(spark, sf)
    sizes = {r.doc_id: (r.n, r.t) for r in pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
    assert len(sizes) == before and all(n == t for n, t in sizes.values())


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text " * 40, "en", "s", 400), (3, "same text " * 40, "en", "s", 400), (4, "same text " * 40, "en", "s", 400), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 2, 3, 3]
    assert corpus_pipeline.drop_repeats(spark, docs, str(tmp_path)).count() == 6
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0
