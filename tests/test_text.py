import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import letters


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("query", "lang"), [("get free food at cote des neiges", "en"), ("wifi gratuit cote des neiges", "fr"), ("", "en"), (None, "en"), ("Où manger?", "fr"), ("pizza in NDG", "en"), ("est-ce loin", "fr")])
def test_query_language(spark, query, lang):
    assert one(spark, T.query_language, query) == lang


def test_query_language_without_signal(spark):
    french = "Les familles trouvent une aide alimentaire et une banque de vêtements dans chaque quartier de la ville. Le centre communautaire ouvre ses portes aux enfants et aux personnes âgées."
    english = "Families find a food counter and a clothing bank in every part of the town. The community house opens its doors to children and older people."
    rows = spark.createDataFrame([(french, "fr"), (english, "en"), (None, "fr"), ("x", None)], "text string, lang string")
    model = letters.fit_letters(rows, "text", "lang")
    ask = lambda q: one(spark, lambda c: T.query_language(c, model.column(c)), q)
    assert ask("banque alimentaire") == "fr" and ask("community food bank") == "en"
    assert ask(None) == "en" and ask("12 34") == "en" and ask("où") == "fr"
    assert letters.fit_letters(rows.limit(0), "text", "lang").guess("banque", "en") == "en"


def test_articles_go_at_word_boundaries_and_entities_are_decoded(spark):
    assert one(spark, T.normalize_answer, "The theatre, d’a b: créa the a tea") == "theatre d’ b créa tea"
    assert one(spark, T.html_text, "<p>Caf&eacute; &#233;t&#xe9; &amp;lt; &hellip;</p>") == "Café été &lt; …" and one(spark, T.html_text, "<b>x</b>") == "x"
    assert one(spark, T.html_text, None) is None


def test_paths(spark):
    assert one(spark, T.path_language, "/x/FR/a.txt") == "fr" and one(spark, T.path_language, "a_french.txt") == "fr" and one(spark, T.path_language, None) == "unknown"
    assert one(spark, T.bundle_language, "/data/en/fr/x") == "en" and one(spark, T.bundle_language, "/data_en/x") == "unknown"
    assert one(spark, T.path_topic, "/a/health_fr_en.txt") == "health_fr" and one(spark, T.path_topic, "/a/b_fr.c.txt") == "b_fr.c"
    assert one(spark, T.url_topic, "https://x/?a=1&mc_thematiques=sante-mentale") == "sante_mentale" and one(spark, T.url_topic, "https://x/") == "unknown"


def test_cleaning(spark):
    assert one(spark, T.clean_card, "Name\n\nEnvoyer un message\nText\nPartager la fiche: x") == "Name\nText"
    assert one(spark, T.clean_answer, " Paris.<|eot_id|> question : next") == "Paris."
    assert one(spark, T.normalize_answer, "The  cat, a DOG!") == "cat dog"
    assert one(spark, T.first_sentence, "One. Two! Three") == "One." and one(spark, T.last_sentence, "One. Two! Three") == "Three"
    assert one(spark, T.first_sentence, "") == "" and one(spark, lambda c: T.last_tokens(c, 2), "a b  c d") == "c d"
    assert one(spark, lambda c: T.stable_seed(c, 42), "abc") == 2248124040
    assert one(spark, T.html_text, "<p>a &amp;lt; b<script>x<y</script><!-- c --></p>") == "a &lt; b"
    assert one(spark, T.count_organisations, "===== Organisation 1: A =====\n===== Organization 22: B =====") == 2
    assert one(spark, T.valid_index_name, "ok-1") and not one(spark, T.valid_index_name, "_x") and not one(spark, T.valid_index_name, "A")


def test_tokens(spark):
    assert one(spark, T.tokens, " A b\tC. ") == ["a", "b", "c."] and one(spark, T.tokens, None) == []
    assert one(spark, T.tokens_fr, "l;a,b.c:d") == ["l", "a", "b", "c", "d"] and one(spark, T.tokens_chars, "né") == ["n", "é"] and one(spark, T.tokens_word, "A bc d_e é1") == ["bc", "d_e", "é1"]
