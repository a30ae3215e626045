import random

from tamarack.llm import leakage as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_wu_manber_finds_every_occurrence():
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choice("abc ") for _ in range(120))
        strings = ["".join(r.choice("abc ") for _ in range(r.randint(3, 6))) for _ in range(8)]
        want = sorted((k, s) for s in set(strings) for k in range(len(text)) if text.startswith(s, k))
        search = L.WuManber(strings)
        begins, numbers = search.search(text)
        assert sorted((b, search.strings[n]) for b, n in zip(begins.tolist(), numbers.tolist())) == want
    assert L.WuManber([]).search("abc")[0].size == 0 and L.WuManber(["abcd"]).search("ab")[0].size == 0
    search = L.WuManber(["ありがとう", "abcdefghij"])
    assert sorted(search.search("xxありがとうabcdefghijありがとう")[0].tolist()) == [2, 7, 17]


def test_common_length():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(1, 25))] for _ in range(2))
        masks = {x: sum(1 << k for k, y in enumerate(a) if y == x) for x in a}
        assert L.common_length(masks, b, len(a)) == lcs(a, b)


ITEM = "the caretaker of number 101 found a bag of forms marked LO870 behind the green counter why was the appointment shifted from the evening and who wrote the short apology note"


def test_passages(spark):
    w = ITEM.split()
    part = lambda n: " ".join(w[:n])
    thin = " ".join(x if k % 3 else "zzz" for k, x in enumerate(w))
    spread = " ".join(x + " filler words in between here" for x in w)
    docs = [(1, f"before. {ITEM.upper()}! after"), (2, "x " * 50 + thin.replace("e", "е")), (3, part(12)), (4, None), (5, ""), (6, spread), (7, ITEM.replace(" ", "\n")), (8, " ".join(reversed(w)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, "!!"), (12, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaked(df, items).collect()}
    assert got == {(d, i) for d in (1, 2, 7) for i in (9, 12)}
    assert got == {(r.doc_id, r.item_id) for r in L.leaked(df, items, block=1).collect()}
    assert L.leaked(df, items.limit(0)).count() == 0 and L.leaked(df.limit(0), items).count() == 0


def test_search_loses_nothing_against_scanning_all():
    r = random.Random(5)
    vocabulary = [f"word{k}" for k in range(60)] + ["a", "of", "to"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(30))) for k in range(6)]
    ready = L.Items(items)
    texts = []
    for _ in range(150):
        i = r.randrange(6)
        w = [r.choice(vocabulary) if r.random() < 0.3 else x for x in ready.words[i]]
        texts.append(" ".join([r.choice(vocabulary) for _ in range(20)] + w + [r.choice(vocabulary) for _ in range(20)]))
    texts += [None, "", "!"]
    want = {(n, k) for n, t in enumerate(texts) for k in ready.words if ready.best_passage(k, L.words_of(t)) >= ready.need[k]}
    assert {(n, k) for n, k, _ in ready.in_texts(texts)} == want and len(want) > 60
    ready.AT_ONCE = 700
    assert {(n, k) for n, k, _ in ready.in_texts(texts)} == want
