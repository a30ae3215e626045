import glob
import os
import random
from collections import Counter

from tamarack.llm.boilerplate import LineLedger


def brute(rows, least, share):
    key = lambda x: "".join(c for c in x if c.isalpha()).lower()
    pages = [(p, s, [key(x) for x in t.split("\n")]) for p, s, t in rows if s is not None and t is not None]
    n = Counter(s for _, s, _ in pages)
    c = Counter((s, k) for _, s, ks in pages for k in set(ks) if len(k) >= 4)
    return {(p, i + 1) for p, s, ks in pages for i, k in enumerate(ks) if c[s, k] >= least and c[s, k] >= share * n[s] - 1e-9}


ROWS = [(k, ["a", "b", None][k % 3], f"own line {'xyz'[k % 3] * (k % 7 + 1)}\nShare this, page {k}\nok\n{'Legal notice' if k % 2 else 'LEGAL  notice!'}\n") for k in range(60)]
ROWS += [(100, "a", None), (101, "a", ""), (102, "c", "Share this page"), (103, "a", "Share this page\nShare this page")]


def test_found_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "page_id long, site string, text string")
    got = {tuple(r) for r in LineLedger(spark).merge(df).found().collect()}
    assert got == brute(ROWS, 6, 0.15) and got
    empty = df.limit(0)
    assert LineLedger(spark).merge(empty).found().count() == 0


def test_merging_deltas_equals_one_merge_and_rebuilds_only_crossed(spark):
    df = spark.createDataFrame(ROWS, "page_id long, site string, text string")
    whole = LineLedger(spark).merge(df)
    parts = LineLedger(spark).merge(df.where("page_id < 6")).merge(df.where("page_id >= 6"))
    assert {tuple(r) for r in parts.repeated().collect()} == {tuple(r) for r in whole.repeated().collect()}
    crossed = {tuple(r) for r in parts.crossings().collect()}
    assert crossed and all(r[2] for r in crossed)
    rebuilt = {r.page_id: r.clean_text for r in parts.rebuilt(df).collect()}
    clean = {r.page_id: r.clean_text for r in whole.clean(df).collect()}
    assert rebuilt and all(clean[k] == v for k, v in rebuilt.items())
    assert 102 not in rebuilt and clean[102] == "Share this page" and clean[100] is None and clean[101] == ""
    assert parts.merge(df.limit(0)).crossings().count() == 0


def test_clean_keeps_the_rest(spark):
    df = spark.createDataFrame([(k, "a", f"Same line here\nown {'q' * k}\n\nx") for k in range(1, 9)], "page_id long, site string, text string").withColumnRenamed("page_id", "src")
    got = {r.src: r.clean_text for r in LineLedger(spark).merge(df, key="src").clean(df).collect()}
    assert got[3] == "own qqq\n\nx"


def state(rows, v, least=6, share=0.15):
    """Brute force: the repeated lines of the pages (part, key, site, lines) of the first v parts."""
    pages = [(s, set(ls)) for part, _, s, ls in rows if part <= v]
    n, c = Counter(s for s, _ in pages), Counter((s, k) for s, ls in pages for k in ls)
    return {k for k, x in c.items() if x >= least and x >= share * n[k[0]] - 1e-9}


def test_many_parts_cross_both_ways_and_bytes_follow_the_part(spark, tmp_path):
    r = random.Random(3)
    names = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(12)]
    rows = []
    for part in range(1, 6):
        for k in range(40):
            site = "big" if k % 3 else r.choice(["x", "y"])
            rows.append((part, part * 100 + k, site, sorted({r.choice(names[: 3 + part * 2]) for _ in range(2)} | ({"only early"} if part == 1 else set()))))
    df = spark.createDataFrame([(p, k, s, "\n".join(ls)) for p, k, s, ls in rows], "part int, page_id long, site string, text string")
    ledger = LineLedger(spark, str(tmp_path / "state"))
    named = {r.k: r.name for r in spark.createDataFrame([(x,) for x in [*names, "only early"]], "name string").selectExpr("name", "xxhash64(regexp_replace(lower(name), '[^a-z]', '')) k").collect()}
    for v in range(1, 6):
        ledger.merge(df.where(f"part = {v}"))
        assert {(r.src, named[r.line]) for r in ledger.repeated().collect()} == state(rows, v)
        changed = {(r.src, named[r.line], r.now) for r in ledger.crossings().collect()}
        old, new = state(rows, v - 1), state(rows, v)
        assert changed == {(*k, True) for k in new - old} | {(*k, False) for k in old - new}
        crossed = {(s, k) for s, k, _ in changed}
        want = {k for part, k, s, ls in rows if part <= v and any((s, x) in crossed for x in ls)}
        got = {r.page_id: r.clean_text for r in ledger.rebuilt(df).collect()}
        assert set(got) == want
        for part, k, s, ls in rows:
            if k in got:
                assert got[k] == "\n".join(x for x in ls if (s, x) not in new)
        if v == 3:
            ledger.compact()
    assert any(not now for _, _, now in [(r.src, r.line, r.now) for v in range(1, 6) for r in ledger.crossings(v).collect()])
    assert ledger.rebuilt(df, [1, 2, 3, 4, 5]).where("partition_no = 5").count() == len(got)
    size = lambda v: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/state/{v}/lines/*.parquet"))
    assert size(5) < 1.5 * size(3)
