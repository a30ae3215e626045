import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import components, dense, metrics, models, prompts, ranking, sparse, structure, training
from tamarack.plans.strategy import Strategy, broadcast_setting


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_metric_goldens(spark):
    run = spark.createDataFrame([("q", "d3", 3.0), ("q", "d1", 2.0), ("q", "d2", 1.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d9", 1)], "qid string, doc_id string, score int")
    m = {r.k: r for r in metrics.rank_metrics(run, qrels, [1, 3]).collect()}
    assert (m[3].precision, m[3].recall, m[3].map, m[3].ndcg) == (0.33333, 0.5, 0.25, 0.38685)
    j = {r.k: r for r in metrics.judged_metrics(run, qrels, [1, 3]).collect()}
    assert (j[3].mrr, j[1].accuracy, j[3].accuracy, j[1].r_cap, j[3].r_cap) == (0.5, 0.0, 1.0, 0.0, 0.5)
    assert {r.k: r.hole for r in metrics.hole(run, qrels, [3]).collect()} == {3: 0.66667}
    assert metrics.rank_metrics(run.limit(0), qrels, [3]).count() == 0


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "the cat sat", "a cat"), (2, "yes", "no"), (3, None, "x"), (4, "b b c", "b c c")], "k int, p string, g string")
    f = {r.k: r.f for r in df.select("k", metrics.token_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    assert (f[1].precision, f[1].recall, round(f[1].f1, 5)) == (0.5, 1.0, 0.66667) and f[2].f1 == 0 and f[3].f1 == 0 and round(f[4].f1, 5) == 0.66667


def test_bm25_against_brute_force(spark):
    r = random.Random(1)
    docs = [(k, " ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(0, 12)))) for k in range(40)] + [(99, None)]
    corpus, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "aa bb aa zz"), (2, "")], "qid long, text string")
    words = {k: (t or "").split() for k, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else eps for t, x in idf.items()}
    want = {}
    for k, w in words.items():
        s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ["aa", "bb", "aa"] if t in w)
        if any(t in w for t in ("aa", "bb")):
            want[1, k] = round(s, 6)
    got = {(x.qid, x.doc_id): x.score for x in sparse.bm25(sparse.build(corpus), sparse.query_terms(queries)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert sparse.bm25(sparse.build(corpus.limit(0)), sparse.query_terms(queries)).count() == 0


def test_bundle_merge(spark):
    hits = spark.createDataFrame([(1, "en", 1, 2.0, "same"), (1, "fr", 2, 3.0, "same"), (1, "en", 3, 1.0, " "), (1, "en", 4, 0.0, "zero"), (1, "en", 5, 0.5, "low")], "qid int, bundle string, doc_id int, score double, text string")
    assert rows(ranking.merge_bundles(hits, 3), "rank", "doc_id") == [(1, 2), (2, 5)]
    p = ranking.padded(spark.createDataFrame([(1,), (2,)], "qid int"), ranking.merge_bundles(hits, 3), 3)
    assert rows(p, "qid", "rank", "text", "score")[2:4] == [(1, 3, "", 0.0), (2, 1, "", 0.0)]


def vectors(spark, n=600, dims=32):
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, dims))
    x = centres[r.integers(0, 12, n)] + 0.5 * r.standard_normal((n, dims))
    c = spark.createDataFrame([(int(k), [float(y) for y in v]) for k, v in enumerate(x)] + [(9999, None)], "doc_id long, v array<float>")
    return x.astype(np.float32).astype(float), c, c.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "v")


def test_exact_search_and_recall_of_approximate_ones(spark):
    x, c, q = vectors(spark)
    want = {}
    for i in range(0, 600, 20):
        s = np.round(1 / (1 + ((x - x[i]) ** 2).sum(1)), 6)
        want[i] = [j for j in sorted(range(600), key=lambda j: (-s[j], j)) if j != i][:10]
    got = {}
    for r in dense.search(c, q, 10, dense.l2_scores, block=7).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == want
    ivf = {(r.qid, r.doc_id) for r in dense.ivf_search(c, q, 10, probes=16).collect()}
    assert sum((i, j) in ivf for i in want for j in want[i]) >= 0.9 * 300
    cos = {(r.qid, r.doc_id) for r in dense.search(c, q, 10, dense.cosine_scores).collect()}
    assert len(cos & {(r.qid, r.doc_id) for r in dense.pca_search(c, q, 10, 28).collect()}) >= 0.8 * 300
    dot = {(r.qid, r.doc_id) for r in dense.search(c, q, 10).collect()}
    assert len(dot & {(r.qid, r.doc_id) for r in dense.pq_search(c, q, 10, 8).collect()}) >= 0.6 * 300
    assert dense.search(c.limit(0), q, 5).count() == 0 and dense.search(c, q.limit(0), 5).count() == 0


def test_binary_search_of_all_candidates_is_the_full_ranking(spark):
    x, c, q = vectors(spark, 80)
    got = {}
    for r in dense.binary_search(c, q, 5, 80).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    for i in got:
        s = np.round(np.where(x > 0, 1.0, -1.0) @ x[i], 6)
        assert got[i] == [j for j in sorted(range(80), key=lambda j: (-s[j], j)) if j != i][:5]


def test_recursive_splitter():
    t = "\n\n".join("word " * n for n in (30, 90, 5, 200)) + "x" * 900
    chunks = structure.split_recursive(t, 200, 40)
    assert all(0 < len(x) <= 200 for x in chunks) and set("".join(chunks).split()) >= {"word"}
    assert structure.split_recursive(None) == [] and structure.split_recursive("") == [] and structure.split_recursive(" \n ") == []
    assert structure.split_recursive("y" * 900, 200, 0, ("\n\n", " ")) == ["y" * 900]
    assert structure.split_recursive("a b c d", 3, 1) == ["a b", "c d"] or all(len(x) <= 3 for x in structure.split_recursive("a b c d", 3, 1))


def test_page_intervals(spark):
    c = spark.createDataFrame([(1, "A", "a", 2), (1, "A", "b", 12), (2, "B", "c", 36)], "category_id int, category_name string, subcategory string, start_page int")
    i = structure.page_intervals(c)
    assert rows(i, "start_page", "end_page") == [(2, 11), (12, 35), (36, 10000)]
    p = spark.createDataFrame([(1,), (2,), (11,), (40,), (None,)], "page_number int")
    got = {r.page_number: r.subcategory for r in structure.categorise(p, i).collect()}
    assert got == {1: None, 2: "a", 11: "a", 40: "c", None: None}
    assert structure.categorise(p.limit(0), i).count() == 0


def test_organisation_chunks(spark):
    t = "intro\n===== Organisation 1: A =====\nshort\n===== Organization 2: B =====\n" + "x" * 50
    df = spark.createDataFrame([("f", t), ("g", "none"), ("h", None)], "file string, t string")
    got = rows(structure.chunk_organisations(df, "file", "t", 20), "chunk_index", "chunk_id", "organization_name")
    assert got == [(0, "f_org_0", "A"), (0, "g_chunk_0", None), (1, "f_org_1_sub_0", "B"), (2, "f_org_2_sub_1", "B"), (3, "f_org_3_sub_2", "B")]


def test_packing_and_numbers(spark):
    df = spark.createDataFrame([("\n\n".join("p" * n for n in (10, 10, 30, 3)),), (None,)], "t string")
    packs = df.select(structure.pack_paragraphs(F.col("t"), 25).alias("p")).first().p
    assert packs == ["p" * 10 + "\n\n" + "p" * 10, "p" * 30, "ppp"]
    n = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "k int")
    assert [r.i for r in structure.running_ids(n, ["k"], "i").orderBy("k").collect()] == list(range(1, 102))


def test_components(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    want = {(x, find(x)) for x in up}
    got = {tuple(x) for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([(["a", "bb", "c"], [1.0, 3.0, 1.0], ["x", "y"], "Q?")], "w array<string>, s array<double>, d array<string>, q string")
    r = df.select(prompts.keep_words(F.col("w"), F.col("s"), 2).alias("k"), prompts.context_prompt(F.array(F.lit("demo")), F.col("d"), F.col("q")).alias("p")).first()
    assert r.k == "a bb" and r.p.startswith("demo\nContext:\n[1] x\n[2] y\nAnswer") and r.p.endswith("Question: Q?\nAnswer:")
    nested = spark.createDataFrame([({"Persona 1": {"Simple": ["a", "b"]}},)], "m map<string, map<string, array<string>>>")
    assert rows(prompts.flatten_queries(nested, "m"), "qid", "question") == [("persona_1_simple_0", "a"), ("persona_1_simple_1", "b")]
    trace = spark.createDataFrame([(1, 0, "▁he", -1.0, 0.0), (1, 1, "llo", -3.0, 1.0), (1, 2, "▁you", -0.5, 0.0)], "qid int, pos int, token string, logprob double, entropy double")
    assert rows(prompts.merge_tokens(trace), "word", "logprob") == [("hello", -2.0), ("you", -0.5)]


def test_margin_negatives(spark):
    pos = spark.createDataFrame([(1, 10, 5.0)], "qid int, doc_id int, ce double")
    s = spark.createDataFrame([(1, 20, "a", 1, 4.9), (1, 21, "a", 2, 1.0), (1, 21, "b", 1, 1.0), (1, 22, "b", 2, 0.5), (1, 23, "b", 3, 0.1)], "qid int, doc_id int, system string, place int, ce double")
    assert rows(training.margin_negatives(s, pos, 1.0, 1), "doc_id", "system") == [(21, "a"), (22, "b")]


def test_models(spark):
    df = spark.createDataFrame([("a b c", "b c d", "We met Ana Maria in Paris", ["Ana", "Paris"], [-3.0, -0.01])], "q string, p string, t string, w array<string>, l array<double>")
    tagger = models.CapitalTagger()
    r = df.select(models.OverlapReranker().predict(F.col("q"), F.col("p")).alias("o"), models.HashEncoder(8).encode(F.col("q")).alias("v"), tagger.spans(F.col("t")).alias("e"), models.unsure_entities(tagger.spans(F.col("t")), F.col("w"), F.col("l"), 0.5).alias("u")).first()
    assert r.o == 0.5 and sum(r.v) == 3 and "Ana Maria" in r.e and r.u == ["Ana Maria"]


def test_rounds_stop(spark):
    s = spark.createDataFrame([(1, 0), (2, 5)], "k int, n int")
    out = models.rounds(s, lambda d: d.withColumn("n", F.col("n") + 2), F.col("n") >= 5, 10)
    assert rows(out, "k", "n") == [(1, 6), (2, 5)]


def test_upsert_and_weights(spark):
    index = sparse.build(spark.createDataFrame([(1, "a a b"), (2, "c")], "doc_id long, text string"))
    new = sparse.upsert(index, spark.createDataFrame([(2, "d d"), (3, "a")], "doc_id long, text string"))
    got = rows(new.postings, "doc_id", "term", "tf")
    assert rows(new.terms, "term", "df") == [("a", 2), ("b", 1), ("d", 1)] and rows(new.stats, "n", "avgdl") == [(3, 2.0)]
    less = sparse.without(new, spark.createDataFrame([(1,), (7,)], "doc_id long"))
    assert rows(less.terms, "term", "df") == [("a", 1), ("d", 1)] and rows(less.stats, "n", "avgdl") == [(2, 1.5)]
    assert got == [(1, "a", 2), (1, "b", 1), (2, "d", 2), (3, "a", 1)]
    w = sparse.weighted_terms(index.postings, spark.createDataFrame([(1, "a", 4.0), (1, "b", 0.0)], "doc_id long, term string, weight double"))
    assert rows(w, "doc_id", "term", "tf", "dl") == [(1, "a", 4.0, 4.0)]


def test_strategy():
    s = Strategy.of({"method": "dragin", "fewshot": 7, "index_paths": "x", "other": 1}, retrieve_topk=4)
    assert s.fewshot == 5 and s.index_paths == ("x",) and s.retrieve_topk == 4
    assert broadcast_setting("en", 3) == ["en"] * 3
    for bad in ({}, {"method": "none-such"}, {"method": "token", "query_formulation": "?"}):
        with pytest.raises(ValueError):
            Strategy.of(bad)


def test_pooling_and_late_interaction(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [1.0, 1.0])], "h array<array<double>>, m array<double>")
    r = df.select(dense.weighted_mean_pool(F.col("h"), F.col("m")).alias("p"), dense.max_sim(F.col("h"), F.col("h")).alias("s")).first()
    assert np.allclose(r.p, [1 / 3, 2 / 3]) and r.s == 2.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_registered_approximate_searches_keep_nine_of_ten(spark):
    from tamarack.plans import vectors as plans

    d = "/root/testdata/sf0.1"
    pairs = lambda df: {(r.qid, r.doc_id) for r in df.collect()}
    for found, score in ((plans.dense_ivf_topk, dense.l2_scores), (plans.dense_pq_topk, dense.dot_scores), (plans.dense_pca_topk, dense.cosine_scores)):
        want = pairs(plans.exact(spark, d, score=score))
        share = len(want & pairs(found(spark, d))) / len(want)
        print(found.__name__, round(share, 3))
        assert share >= 0.9
