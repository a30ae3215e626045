import random
import re

from tamarack.llm import partenum as P


def sets(rows):
    out = {}
    for k, t in rows:
        w = re.findall(r"\w+", t.lower()) if t else []
        if len(w) >= 20:
            out[k] = set(zip(w, w[1:], w[2:]))
    return out


def brute(rows):
    s, up = sets(rows), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a in s:
        for b in s:
            if a < b and P.similarity(s[a], s[b]) >= 0.5:
                up[find(b)] = find(a)
    return {(a, b) for a in s for b in s if a < b and find(a) == find(b)}


def make():
    r = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(60, 260)))) for k in range(60)]
    for k in range(60):
        w = rows[k][1].split()
        for _ in range(r.randint(0, len(w) // 14)):
            w[r.randrange(len(w))] = r.choice(words)
        if k % 3 == 0:
            w[10:10] = [r.choice(words) for _ in range(12)]
        if k % 5 == 0:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        rows.append((100 + k, " ".join(w)))
    rows += [(300, rows[0][1].upper() + "!"), (301, None), (302, ""), (303, "too short"), (304, "same " * 30), (305, "same " * 40)]
    return rows


def test_groups_match_brute_force(spark):
    rows = make()
    groups = P.near_duplicate_groups(spark.createDataFrame(rows, "page_id long, text string"))
    got = {tuple(r) for r in P.pairs_within_groups(groups).collect()}
    assert got == brute(rows)
    assert {r.page_id for r in groups.collect()} == set(sets(rows))


def test_splitting_hot_runs_compares_the_same_pairs():
    import numpy as np

    r = np.random.default_rng(2)
    sizes = r.integers(18, 60, 400)
    sets = [np.unique(P.mixed(r.integers(0, 70, n).astype(np.uint64))) for n in sizes]
    sizes = np.array([len(x) for x in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    node = P.digests(h, row, len(sets))[0]
    heads = np.stack((node, sizes.astype(np.uint64), *P.sketches(h, row, len(sets)).T))
    common, often = np.unique(h, return_counts=True)
    entries = P.rare_first(h, row, sizes, common, often, 0.5)
    found = []
    for block in (10_000, 37, 10):
        run, at, limit = P.split_hot(*entries, node, common, often, block)
        assert len(run) >= len(entries[0])
        found.append({tuple(x) for x in np.stack(P.similar_pairs(heads, at, (run >> np.uint64(32)).astype(np.uint32), limit.astype(np.uint32), 200), 1).tolist()})
    # runs of one 32-bit number in a prefix may bring a few pairs more
    assert len(found[0]) > 500 and all(found[0] <= x and len(x) < 1.01 * len(found[0]) for x in found)


def test_unequal_sets_of_equal_sketches_stay_apart(monkeypatch, spark):
    import numpy as np

    monkeypatch.setattr(P, "sketches", lambda h, row, n: np.zeros((n, P.WORDS), np.uint64))
    a, b = P.digests(np.array([1, 2, 3, 1, 2, 4], np.uint64), np.array([0, 0, 0, 1, 1, 1]), 2).T
    assert a[0] != b[0] and a[1] != b[1]


def test_hot_runs_over_many_blocks(spark):
    r = random.Random(6)
    standing = [" ".join(f"s{p}x{k}" for k in range(12)) for p in range(16)]
    rows = [(k, " ".join(standing[p] for p in r.sample(range(16), 6))) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, text string")
    split, whole = (P.near_duplicate_groups(df, block=n).collect() for n in (20, P.BLOCK))
    assert {x.page_id: x.links for x in split} == {x.page_id: x.links for x in whole}


def test_copies_of_one_text_and_empty_tables(spark):
    t = " ".join(f"v{k}" for k in range(80))
    df = spark.createDataFrame([(k, t) for k in range(300)] + [(999, None)], "page_id long, text string").withColumnRenamed("page_id", "node")
    assert P.near_duplicate_groups(df, "node").select("group_id").distinct().count() == 1
    assert P.near_duplicate_groups(df.limit(0), "node").count() == 0


def near(r, t, words):
    """The words of t with changes until 0.5 to 0.6 of the runs are shared; null if that is missed."""
    runs, w = (lambda x: set(zip(x, x[1:], x[2:]))), list(t)
    while (s := P.similarity(runs(t), runs(w))) > 0.6:
        w[r.randrange(len(w))] = r.choice(words)
    return w if s >= 0.5 else None


def test_texts_of_just_the_wanted_similarity_are_found_at_every_length(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for n in (20, 25, 30, 40, 60, 100):
        upto = k + 140
        while k < upto:
            t = [r.choice(words) for _ in range(n)]
            if w := near(r, t, words):
                rows += [(k, " ".join(t)), (k + 1, " ".join(w))]
                k += 2
    groups = P.near_duplicate_groups(spark.createDataFrame(rows, "page_id long, text string"))
    got = {tuple(x) for x in P.pairs_within_groups(groups).collect()}
    assert len(brute(rows)) >= 420 and got == brute(rows)


def test_pairs_that_share_only_frequent_runs_are_found(spark):
    r = random.Random(6)
    standing = [" ".join(f"s{p}x{k}" for k in range(12)) for p in range(16)]
    rows = [(k, " ".join(standing[p] for p in r.sample(range(16), 6))) for k in range(300)]
    s = sets(rows)
    links = {a: sum(a != b and P.similarity(s[a], s[b]) >= 0.5 for b in s) for a in s}
    groups = P.near_duplicate_groups(spark.createDataFrame(rows, "page_id long, text string")).collect()
    assert sum(links.values()) > 400 and {x.page_id: x.links for x in groups} == links
    got = {(a.page_id, b.page_id) for a in groups for b in groups if a.page_id < b.page_id and a.group_id == b.group_id}
    assert got == brute(rows)
