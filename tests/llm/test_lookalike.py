from tamarack.llm import lookalike as L


def test_classes_are_transitive_and_rewriting_is_stable():
    run = L.Rewriter(L.rewriting({}))
    for a, b in [("ｃａｆé", "café"), ("сору", "copy"), ("a b", "a b"), ("a b", "a b"), ("ze​ro", "zero"), ("co­op", "coop"), ("co‐op", "co-op"), ("wait…", "wait..."), ("ﬁn", "fin"), ("е́", "é"), ("ё", "ë"), ("Ａ", "А")]:
        assert run(a) == run(b), (a, b)
        assert run(run(a)) == run(a)
    for a, b in [("é", "e"), ("a  b", "a b"), ("l", "I"), ("0", "O"), ("A", "a"), ("–", "-"), ("ß", "ss"), ("1", "l")]:
        assert run(a) != run(b), (a, b)
    assert run(None) is None and run("") == ""


def test_representative_follows_frequency():
    assert L.Rewriter(L.rewriting({"а": 9, "a": 2}))("a") == "а"
    assert L.Rewriter(L.rewriting({"e": 50, "́": 40, "é": 1}))("é") == "é"


def test_pairs(spark):
    rows = [(1, "copy that"), (2, "сopy that"), (3, "copy that"), (4, None), (5, ""), (6, "Copy that"), (7, "copy that"), (8, "  "), (9, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in L.same_looking_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert L.same_looking_pairs(df.limit(0)).count() == 0
    assert L.canonicalise(df.withColumn("canonical", df.doc_id)).count() == 9


def test_a_hot_text_with_one_variant_is_linear_and_repeated_rows_count_once(spark):
    df = spark.range(100_000).selectExpr("id as doc_id", "if(id = 77777, 'сopy of it', 'copy of it') as text", "id as k", "'x' as raw")
    got = L.same_looking_pairs(df.unionByName(df.where("doc_id = 77777")))
    assert got.count() == 99_999 and got.where("doc_id_a = 77777 or doc_id_b = 77777").count() == 99_999
    assert got.where("doc_id_a >= doc_id_b").count() == 0
