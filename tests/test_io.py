import json

from pyspark.sql import functions as F

from tamarack.operators import sparse
from tamarack.sources import readers, writers
from tamarack.streaming import incremental


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "d" / "fr").mkdir(parents=True)
    (tmp_path / "d" / "fr" / "health_fr.txt").write_text("===== Organisation 1: A =====\nx")
    (tmp_path / "d" / "page.html").write_text("<p>hi</p>")
    (tmp_path / "d" / "skip.bin").write_bytes(b"\x00")
    got = {r.file_name: r for r in readers.files(spark, str(tmp_path / "d")).collect()}
    assert set(got) == {"health_fr.txt", "page.html"} and got["page.html"].content == "hi"
    assert (got["health_fr.txt"].language, got["health_fr.txt"].topic, got["health_fr.txt"].organization_count) == ("fr", "health", 1)
    (tmp_path / "c.json").write_text(json.dumps([{"text": "a", "chunk_id": 7}, {"content": "b"}, {}]))
    assert [(r.chunk_id, r.content) for r in readers.chunk_json(spark, str(tmp_path / "c.json")).orderBy("chunk_id").collect()] == [("c_chunk_1", "b"), ("c_chunk_2", ""), ("c_chunk_7", "a")]


def test_judgements_and_runs(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td1\t2\nq2\td2\t0\n")
    assert sorted(tuple(r) for r in readers.qrels_tsv(spark, str(tmp_path / "q.tsv")).collect()) == [("q1", "d1", 2), ("q2", "d2", 0)]
    (tmp_path / "run.txt").write_text("q1 Q0 d1 1 2.5 t\nq1 Q0 d2 9 1.0 t\nbad line\n")
    run = readers.trec_run(spark, str(tmp_path / "run.txt"), 5)
    assert [tuple(r) for r in run.collect()] == [("q1", "d1", 1, 2.5)]
    assert run.select(writers.run_line("x").alias("l")).first().l == "q1\tQ0\td1\t1\t2.500000\tx"


def test_index_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    index = sparse.build(corpus)
    writers.save_index(index, str(tmp_path / "ix"))
    q = sparse.query_terms(spark.createDataFrame([(1, "a c")], "qid long, text string"))
    both = [sorted(tuple(r) for r in sparse.bm25(i, q).collect()) for i in (index, writers.load_index(spark, str(tmp_path / "ix")))]
    assert both[0] == both[1] and len(both[0]) == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b", "2024-01-01 00:00:00"), (1, "a b", "2024-01-01 00:00:01"), (2, "b", "2024-01-02 00:00:00")], "doc_id long, text string, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string, arrived timestamp").parquet(src)
    incremental.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r.doc_id, r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a", 1), (1, "b", 1), (2, "b", 1)]
