import os

import pytest

from tamarack.llm import mixing as M


def data(spark):
    rows = [(k, ["a", "b", "c", None, "x"][k % 5] if k >= 40 else "a", 10 + k % 7) for k in range(400)]
    tokens = spark.createDataFrame(rows, "doc long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.25, 3), ("c", 0.4, 1), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    return rows, tokens, targets


def test_report_and_mixture(spark):
    rows, tokens, targets = data(spark)
    total = sum(r[2] for r in rows)
    report = {r.source: r for r in M.source_report(tokens, targets).collect()}
    own = {s: sum(r[2] for r in rows if r[1] == s) for s in "abc"}
    assert all(report[s].own_tokens == own[s] for s in own) and report["none"].own_tokens == 0
    assert {s for s, r in report.items() if not r.reachable} == {s for s, share, n in [("a", 0.3, 2), ("b", 0.25, 3), ("c", 0.4, 1), ("none", 0.05, 4)] if own.get(s, 0) * n < share * total}
    mixed = M.mix(tokens, targets, 64)
    used = mixed.collect()
    assert max(r.repetition for r in used if r.source == "c") == 0 and all(r.repetition < 3 for r in used)
    assert {r.doc for r in used if r.source == "c"} == {r[0] for r in rows if r[1] == "c"}
    done = {r.source: r for r in M.reached(mixed, M.source_report(tokens, targets)).collect()}
    assert abs(done["a"].reached_share - 0.3) < 0.02 and abs(done["b"].reached_share - 0.25) < 0.02
    assert done["c"].reached_tokens == own["c"] and done["none"].reached_tokens == 0


def test_every_use_of_a_document_once_and_blocks_of_equal_tokens(spark):
    _, tokens, targets = data(spark)
    laid = M.laid(tokens, rows_a_part=50).collect()
    assert len({r.doc for r in laid}) == len(laid) == tokens.where("source is not null").count()
    at = {}
    for r in sorted(laid, key=lambda r: (r.source, r.before)):
        assert r.before == at.get(r.source, 0)
        at[r.source] = r.before + r.tokens
    sums, used = {}, M.mix(tokens, targets, 64).collect()
    assert len({(r.doc, r.repetition) for r in used}) == len(used)
    for r in used:
        if r.source == "b":
            sums[r.slot] = sums.get(r.slot, 0) + r.tokens
    assert max(sums.values()) - min(sums.values()) <= 34


def test_a_source_of_few_tokens_gets_its_share_by_repetition(spark):
    rows = [(k, "big", 100) for k in range(200)] + [(1000 + k, "small", 70) for k in range(10)] + [(2000, "tiny", 7)]
    tokens = spark.createDataFrame(rows, "doc long, source string, tokens long")
    total = sum(r[2] for r in rows)
    targets = spark.createDataFrame([("big", 0.8985, 1), ("small", 0.1, 4), ("tiny", 0.0015, 9)], "source string, target_share double, max_repeats int")
    done = {r.source: r for r in M.reached(M.mix(tokens, targets), M.source_report(tokens, targets)).collect()}
    assert abs(done["small"].reached_tokens - 0.1 * total) <= 35 and done["small"].repeats == 3
    assert abs(done["big"].reached_tokens - 0.8985 * total) <= 50 and abs(done["tiny"].reached_tokens - 0.0015 * total) <= 7


def test_unreachable_by_the_schedule_is_unreachable_by_the_numbers(spark):
    _, tokens, targets = data(spark)
    want = {r.source for r in M.source_report(tokens, targets).where("not reachable").collect()}
    for block in (16, 64, 2048):
        assert {r.source for r in M.unreachable(tokens, targets, block).collect()} == want


@pytest.mark.parametrize("sf,within", [("sf0.01", 0.05), ("sf0.1", 0.01)])
def test_reachable_sources_get_their_share(spark, sf, within):
    if not os.path.isdir(f"/root/testdata/{sf}") or not os.path.exists(M.TOKENIZER):
        pytest.skip("needs the test tables and the vocabulary file")
    from tamarack.llm import queries

    for r in queries.p7_report(spark, f"/root/testdata/{sf}").collect():
        if r.reachable:
            assert abs(r.reached_share / r.target_share - 1) <= within, r
        assert r.repeats <= r.max_repeats


def test_slots_have_low_discrepancy(spark):
    report = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, target_share double")
    s = M.slots(spark, report, 1000, 64).orderBy("slot").collect()
    for n in (50, 333, 1000):
        for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(sum(r.source == source for r in s[:n]) - share * n) < 4
    turns = {}
    for r in s:
        assert r.turn == turns.get(r.source, 0)
        turns[r.source] = r.turn + 1


def test_empty(spark):
    _, tokens, targets = data(spark)
    assert M.mix(tokens.limit(0), targets).count() == 0 and M.mix(tokens, targets.limit(0)).count() == 0
    assert M.source_report(tokens.limit(0), targets).where("not reachable").count() == 0


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="needs the vocabulary file")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, None, None), (3, "a", "")], "doc_id long, source string, text string")
    assert {r.doc: r.tokens for r in M.counted(df, "doc_id", "source", "text").collect()} == {1: 2, 2: 0, 3: 0}
