import random

from pyspark.sql import functions as F

from tamarack.llm import language as L

PARTS = {
    "en": (["the people of", "we offer to", "you can find", "our house has"], ["a food bank counter", "help with the rent", "weekly swimming lessons", "advice for workers"], ["every monday", "without any appointment", "near the old station", "until next winter"]),
    "fr": (["les gens de", "nous offrons aussi", "vous trouverez ici", "notre maison propose"], ["une aide alimentaire", "des conseils sur le bail", "des cours de natation", "un soutien aux travailleurs"], ["tous les lundis", "sans rendez-vous préalable", "près de la vieille gare", "jusqu'à l'hiver prochain"]),
    "de": (["die leute von", "wir bieten auch", "sie finden hier", "unser haus hat"], ["eine kostenlose beratung", "hilfe bei der miete", "wöchentliche schwimmkurse", "rat für die arbeiter"], ["an jedem montag", "ohne einen termin", "neben dem alten bahnhof", "bis zum nächsten winter"]),
}


def sentence(r, lang):
    return " ".join(r.choice(p) for p in PARTS[lang]).capitalize() + "."


def rows(n=600):
    r = random.Random(1)
    out = []
    for k in range(n):
        lang = r.choice(list(PARTS))
        text = " ".join(sentence(r, lang) for _ in range(4))
        true = {lang}
        if k % 10 == 0:
            other = r.choice([x for x in PARTS if x != lang])
            text += " " + sentence(r, other)
            true.add(other)
        label = r.choice(list(PARTS)) if k % 7 == 0 else None if k % 11 == 0 else lang
        out.append((k, text, label, true))
    return out


def test_labels(spark):
    want = {"EN": "en", "en-CA": "en", " English ": "en", "anglais": "en", "pt-BR": "pt", "deu": "de", "العربية": "ar", "und": None, "": None, None: None, "auto": None, "klingon": "klingon"}
    df = spark.createDataFrame([(k,) for k in want], "label string")
    assert {r.label: r.l for r in df.select("label", L.label_language(F.col("label")).alias("l")).collect()} == want


def test_held_out_accuracy(spark):
    data = rows()
    raw = L.fit_dictionaries([(label, t) for _, t, label, _ in data[:300] if label], ("en", "fr", "de", "es"))
    d = L.Detector(raw)
    found = d.languages([t for _, t, _, _ in data[300:]])
    right = sum({x for x, _ in one} == true for one, (_, _, _, true) in zip(found, data[300:]))
    assert right >= 0.98 * 300
    df = spark.createDataFrame([(k, t, label) for k, t, label, _ in data] + [(9999, None, "en"), (9998, "", None), (9997, "555-0172", None)], "id long, text string, lang string")
    got = {(r.id, r.lang) for r in L.mislabelled(df, raw, "id", "text", "lang").collect()}
    want = {(k, x) for k, _, label, true in data if len(true) > 1 or label not in true for x in true}
    assert len(got ^ want) <= 0.02 * len(want)
    assert L.detected(df, raw, "id", "text", segments=True).where("id = 9999").count() == 0


def test_degenerate(spark):
    df = spark.createDataFrame([], "id long, text string, lang string")
    assert L.fit([(df, "id", "text", "lang")]) == {}
    assert L.detected(df, {}, "id", "text").count() == 0
    assert L.units("") == [] and L.Detector({"en": b"a b", "fr": b"c d"}).segments([None, ""]) == [[], []]


def test_a_change_within_a_clause_is_found_at_any_depth():
    data = rows()
    d = L.Detector(L.fit_dictionaries([(label, t) for _, t, label, _ in data[:300] if label], ("en", "fr", "de")))
    r = random.Random(5)
    for _ in range(40):
        langs = [r.choice(list(PARTS)) for _ in range(6)]
        langs = [x for k, x in enumerate(langs) if not k or langs[k - 1] != x]
        clause = " ".join(" ".join(r.choice(p) for p in PARTS[x][:2]) for x in langs)
        cut = d.pieces([clause])[clause]
        assert " ".join(p for p, _ in cut) == clause
        assert {x for x, _ in d.languages([" ".join(sentence(r, x) for x in langs)])[0]} == set(langs)


def test_one_batch_or_many_make_no_difference():
    data = rows(200)
    raw = L.fit_dictionaries([(label, t) for _, t, label, _ in data if label], ("en", "fr", "de"))
    texts = [t for _, t, _, _ in data]
    assert L.Detector(raw).segments(texts) == [L.Detector(raw).segments([t])[0] for t in texts]


def test_columns_of_the_same_names_and_repeated_rows(spark):
    data = rows(60)
    raw = L.fit_dictionaries([(label, t) for _, t, label, _ in data if label], ("en", "fr", "de"))
    df = spark.createDataFrame([(k, t, None, "x") for k, t, _, _ in data] * 2, "k long, t string, l string, label string")
    got = L.mislabelled(df, raw, "k", "t", "l")
    assert got.count() == got.select("k", "lang").distinct().count() >= 60
