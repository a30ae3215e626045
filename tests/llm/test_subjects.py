import random

import numpy as np

from tamarack.llm import subjects as S

_R = random.Random(9)
WORDS = {k: [" ".join("".join(_R.choice("abcdefghij") for _ in range(7)) for _ in range(2)) for _ in range(14)] for k in (1, 2, 3)}
FILL = ["We offer {} every Monday.", "Many people asked for {} last year.", "The leaflet explains {} in detail.", "Thanks to a grant {} will continue."]
NONE = ["Founded by a few neighbours it stays small.", "The door is open on weekdays.", "Small gifts pay the phone bill."]


def pages(n=900):
    r = random.Random(3)
    out = []
    for k in range(n):
        main, other = r.sample(list(WORDS), 2)
        s = [r.choice(FILL).format(r.choice(WORDS[main])) for _ in range(5)]
        two = k % 3 == 0
        s += [r.choice(FILL).format(r.choice(WORDS[other])) for _ in range(3 if two else 1)] + [r.choice(NONE) for _ in range(2)]
        r.shuffle(s)
        label = main if r.random() < 0.7 else r.choice(list(WORDS)) if r.random() < 0.4 else None
        out.append((k, " ".join(s), label, None if label is None else f"Area {label}", None, {main, other} if two else {main}))
    return out


def test_found_on_held_out_truth(spark):
    data = pages()
    df = spark.createDataFrame([d[:5] for d in data] + [(9000, None, 1, "Area 1", None), (9001, "", 2, None, None), (9002, "stub", None, None, "")], "page_id long, text string, category_id int, category_name string, subcategory string")
    cats = spark.createDataFrame([(k, f"Area {k}", f"part {k}") for k in WORDS], "category_id int, category_name string, subcategory string")
    model = S.fit(df, cats)
    got = {(r.page_id, r.category_id) for r in S.subjects_of(df.union(df.limit(5)), model).collect()}
    want = {(d[0], c) for d in data for c in d[5]}
    assert len(got ^ want) <= 0.02 * len(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, text string, category_id int, category_name string, subcategory string")
    cats = spark.createDataFrame([(1, "A", "b")], "category_id int, category_name string, subcategory string")
    assert S.subjects_of(df, S.fit(df, cats)).count() == 0
    assert S.subjects_of(df, S.fit(df, cats.limit(0))).count() == 0


def test_truncated_svd_matches_numpy():
    x = np.random.default_rng(1).random((60, 25)) * (np.random.default_rng(2).random((60, 25)) < 0.3)
    start = np.concatenate(([0], np.cumsum((x != 0).sum(1))))
    s, v = S.truncated_svd(start, np.nonzero(x)[1], x[x != 0].astype(np.float32), 25, 5, rounds=30)
    assert np.allclose(s, np.linalg.svd(x)[1][:5], rtol=1e-2)


def test_statements_without_full_stops():
    t = "Header 1: x\n" + " - ".join("Our house offers bread and soup to people who live alone near the river this year" for _ in range(4))
    assert len(S.statements(t)) == 4
