"""Readers, writers and small operators on fixtures, by round trip or by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tamarack.operators import dense, metrics, prompts, ranking, sparse, structure, training
from tamarack.plans import dispatch
from tamarack.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_corpus_queries_and_judgements(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "T", "a"), (2, None, "b"), (3, "U", None)], "doc_id long, title string, text string")
    writers.corpus_lines(corpus).write.text(str(tmp_path / "c"))
    assert rows(readers.corpus_jsonl(spark, str(tmp_path / "c"))) == [("1", "T", "a"), ("2", "", "b"), ("3", "U", "")]
    (tmp_path / "q.jsonl").write_text('{"_id": "q1", "text": "x"}\n{"_id": "q2", "text": "y"}\n')
    queries = readers.queries_jsonl(spark, str(tmp_path / "q.jsonl"))
    qrels = spark.createDataFrame([("q1", "1", 2)], "qid string, doc_id string, score int")
    assert rows(readers.judged(corpus, queries, qrels)[1]) == [("q1", "x")]
    writers.write_tsv(writers.qrels_table(qrels), str(tmp_path / "qrels"))
    assert rows(readers.qrels_tsv(spark, str(tmp_path / "qrels"))) == [("q1", "1", 2)]
    assert rows(writers.gold_rows(spark.createDataFrame([("q", ["a", "b", "a"])], "qid string, golds array<string>"), "qid", "golds")) == [("q", "a"), ("q", "b")]
    assert rows(writers.first_of_ids(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "id string, n int"), "id", ["n"])) == [("a", 1), ("b", 3)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.qrels").write_text("q1 0 d1 1\nshort line\nq2 0 d2 x\n")
    assert [tuple(r) for r in readers.trec_qrels(spark, str(tmp_path / "t.qrels")).orderBy("qid").collect()] == [("q1", "d1", 1), ("q2", "d2", None)]
    (tmp_path / "q.tsv").write_text("1\tfirst\nnothing\n2\tsecond\n")
    assert rows(readers.tsv_queries(spark, str(tmp_path / "q.tsv"))) == [("1", "first"), ("2", "second")]
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n1\tbody\tT\n")
    assert rows(readers.tsv_passages(spark, str(tmp_path / "p.tsv"))) == [("body",)]
    (tmp_path / "m.tsv").write_text("d1\t0\nd2\t1\n")
    assert rows(readers.id_map(spark, str(tmp_path / "m.tsv"))) == [("d1", 0), ("d2", 1)]
    with gzip.open(tmp_path / "h.jsonl.gz", "wt") as f:
        f.write(json.dumps({"qid": "1", "pos": [{"pid": "p", "ce-score": 3.5}], "neg": {"bm25": [{"pid": "n", "ce-score": 0.5}]}}) + "\n")
    r = readers.hard_negative_jsonl(spark, str(tmp_path / "h.jsonl.gz")).first()
    assert r.qid == "1" and r.pos[0].pid == "p" and r.neg["bm25"][0]["ce-score"] == 0.5
    assert [(p.page_number, p.text) for p in spark.createDataFrame([("a\fb",)], "t string").select(readers.pages_of(F.col("t")).alias("p")).first().p] == [(1, "a"), (2, "b")]


def test_records_and_results(spark, tmp_path):
    df = spark.createDataFrame([("7", "x", 1), (None, None, 2)], "id string, text string, n int")
    got = {r.text: r.doc_id for r in readers.records(df).collect()}
    assert got["x"] == "7" and got[""] and rows(readers.records(df.select("n")), "text") == [("",), ("",)]
    writers.write_results(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_results(df, str(tmp_path / "out"))
    v = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 1)], "doc_id long, v array<double>, cell int")
    writers.save_vectors(v, str(tmp_path / "v"), "cell")
    assert rows(spark.read.parquet(str(tmp_path / "v")), "doc_id", "cell") == [(1, 0), (2, 1)]


def test_answers_and_training(spark):
    df = spark.createDataFrame([(1, "a cat", "the cat"), (1, "a cat", "dog"), (2, "x", None)], "k int, p string, g string")
    assert [tuple(r) for r in metrics.best_answer(df, ["k"], "p", "g").orderBy("k").collect()][0] == (1, 1, 1.0, 1.0, 1.0)
    t = spark.createDataFrame([(["a", "b", "c"], ["b"], ["c"])], "top array<string>, own array<string>, stop array<string>")
    assert t.select(training.expansion_terms(F.col("top"), F.col("own"), F.col("stop")).alias("x")).first().x == ["a"]
    g = training.generated_queries(spark.createDataFrame([(1, [" q ", "q", "", "r"]), (2, ["q"])], "doc_id long, q array<string>"), F.col("q"))
    assert rows(g) == [("genQ1", 1, "q"), ("genQ2", 1, "r"), ("genQ3", 2, "q")]
    d = spark.createDataFrame([(1.0, 0.5), (2.0, 2.0)], "delta double, label double")
    assert d.select(training.margin_mse(F.col("delta"), F.col("label")).alias("x")).first().x == 0.125
    triplets = spark.createDataFrame([("q", "p", "n", k) for k in (2, 1)] + [("q", "p", "m", 3)], "query string, pos string, neg string, at int")
    assert rows(training.without_repeats(triplets, ["at"]), "neg", "at") == [("m", 3), ("n", 1)]
    b = training.batches_without_duplicates(spark.createDataFrame([(k % 5, k) for k in range(50)], "key int, n int"), 10, "key")
    assert b.groupBy("batch", "key").count().agg(F.max("count")).first()[0] <= 2 and b.count() == 50


def test_prompts(spark):
    d = spark.createDataFrame([(["D1"], "q", ["doc"])], "demos array<string>, q string, docs array<string>")
    assert d.select(prompts.plain_prompt(F.col("demos"), F.col("q")).alias("x")).first().x == "D1\n\nQuestion: q\nAnswer:"
    assert d.select(prompts.step_prompt(F.array().cast("array<string>"), F.col("docs"), F.col("q"), F.lit("so")).alias("x")).first().x.endswith("Question: q\nAnswer: so")
    s = spark.createDataFrame([("a b", "a", 2), ("a", "a", 1), ("x the answer is y", "x", 3), ("a b c", "a", 99)], "t string, b string, n int")
    assert [r.x for r in s.select(prompts.stopped(F.col("t"), F.col("b"), F.col("n"), 10).alias("x")).collect()] == [False, True, True, True]
    trace = spark.createDataFrame([(1, 0, "Good", -0.01), (1, 1, "one.", -0.01), (1, 2, "Bad", -3.0), (1, 3, "one.", -0.1), (2, 0, "Fine.", 0.0)], "qid int, pos int, token string, logprob double")
    got = {r.qid: r for r in prompts.first_unsure(trace, 0.4).collect()}
    assert (got[1].sentence_no, got[1].before, got[1].masked) == (1, "Good one.", "[xxx] one.") and (got[2].unsure, got[2].before, got[2].masked) == (False, "Fine.", None)


def test_chunks_without_header_and_recursive(spark):
    text = "intro\n===== Organisation 1: A =====\n" + "word " * 60 + "\n===== Organisation 2: B =====\nshort"
    df = spark.createDataFrame([("f", text), ("g", "no header here"), ("h", None)], "k string, t string")
    got = [tuple(r) for r in structure.chunk_organisations(df, "k", "t", 100).orderBy("k", "chunk_index").collect()]
    assert got[-1] == ("g", "g_chunk_0", None, 0, "no header here") and got[-2][1:] == ("f_org_3", "B", 3, "short") and got[0][1] == "f_org_0_sub_0"
    cut = structure.chunk_organisations(df, "k", "t", 100, 10, recursive=True).collect()
    assert all(len(r.content) <= 100 for r in cut) and {r.k for r in cut} == {"f", "g"}


def test_ranks_metrics_and_samples(spark):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "q", 9.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "b", 1)], "qid string, doc_id string, score int")
    assert metrics.rank_metrics(run, qrels, [1]).first()["map"] == 1.0  # ties by falling id, the query's own id is no hit
    assert metrics.rank_metrics(run, qrels, [1], ignore_identical_ids=False).first()["map"] == 0.0
    assert metrics.custom_metric(run, qrels, [3], "MRR@k").first().value > 0 and metrics.custom_metric(run, qrels, [3], "none") is None
    corpus = spark.range(5000).withColumnRenamed("id", "doc_id")
    judged = corpus.where("doc_id < 10")
    for n in (0, 10, 11, 137, 4999, 5000, 9000):
        got = {r.doc_id for r in ranking.judged_sample(corpus, judged, n).collect()}
        assert len(got) == min(5000, max(n, 10)) and set(range(10)) <= got
    order = [r.doc_id for r in corpus.where("doc_id >= 10").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(127).collect()]
    assert set(order) == {r.doc_id for r in ranking.judged_sample(corpus, judged, 137).collect()} - set(range(10))
    assert [r.doc_id for r in ranking.shuffled(corpus, "doc_id", 5, 3).collect()] == [r.doc_id for r in ranking.shuffled(corpus, "doc_id", 5, 3).collect()]


def test_kept_vector_indexes(spark):
    import numpy as np

    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 16)) * 4
    x = centres[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16))
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "doc_id long, v array<float>")
    queries = corpus.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "v")
    exact = {(t.qid, t.doc_id) for t in dense.search(corpus, queries, 10, dense.l2_scores).collect()}
    index, seen = dense.build_cells(corpus, 40), []
    assert index.table.count() == 3000

    def counted(q, x):
        return dense.l2_scores(q, x)

    got = {(t.qid, t.doc_id) for t in dense.search_cells(index, queries, 10, 6, counted).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    near = np.argsort(-dense.l2_scores(np.array([t.v for t in queries.orderBy("qid").collect()], float), index.centroids), axis=1)[:, :6]
    size = {t.cell: t["count"] for t in index.table.groupBy("cell").count().collect()}
    seen = [sum(size.get(int(c), 0) for c in cells) for cells in near]
    assert np.mean(seen) < 0.2 * 3000  # rows scored for a query
    codes = dense.build_codes(corpus, 8, 6)
    dot = {(t.qid, t.doc_id) for t in dense.search(corpus, queries, 10).collect()}
    hits = dense.reranked(dense.search_codes(codes, queries, 100).select("qid", "doc_id"), corpus, queries, 10)
    assert len({(t.qid, t.doc_id) for t in hits.collect()} & dot) >= 0.9 * len(dot)
    empty = corpus.limit(0)
    assert dense.search_cells(dense.build_cells(empty), queries.limit(0), 5).count() == 0 and dense.search_codes(dense.build_codes(empty), queries, 5).count() == 0


def test_dispatch_and_generated_queries(spark):
    with pytest.raises(NotImplementedError):
        dispatch.retrieve("other", spark, "", None)
    corpus = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    made = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z"), (2, None)], "doc_id long, query string")
    assert rows(sparse.with_generated(corpus, made)) == [(1, "a x y"), (2, "z")]
