"""Prompts, token traces and counters. Traces are made from the texts: a token's log probability is minus its length over ten."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import prompts
from tamarack.plans import lexical
from tamarack.plans import sql as S
from tamarack.plans.registry import query, table
from tamarack.sources import writers

_I = "'" + prompts.INSTRUCTION.replace("\n", "") + "' || chr(10)"


@query("SELECT item_id, 'Question: ' || text || chr(10) || 'Answer: ' || difficulty AS demo, 'Question: ' || text || chr(10) || 'Answer:' AS plain FROM eval_items")
def demo_prompt(spark, d):
    q = table(spark, d, "eval_items")
    return q.select("item_id", prompts.demo(F.col("text"), F.col("difficulty")).alias("demo"), prompts.case(F.col("text")).alias("plain"))


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 3)}), c AS (SELECT qid, string_agg('[' || rank || '] ' || documents.text || chr(10), '' ORDER BY rank) AS c FROM f JOIN documents USING (doc_id) GROUP BY qid)
    SELECT qid, 'Question: x' || chr(10) || 'Answer: y' || chr(10) || 'Context:' || chr(10) || c || {_I} || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM c JOIN q USING (qid)""")
def rag_prompt(spark, d):
    q = lexical.items(spark, d)
    hits = lexical.best(lexical.okapi(spark, d), 3).join(lexical.docs(spark, d).select("doc_id", "text"), "doc_id")
    docs = prompts.docs_in_order(hits)
    demos = F.array(prompts.demo(F.lit("x"), F.lit("y")))
    return q.join(docs, "qid").select("qid", prompts.context_prompt(demos, F.col("docs"), F.col("text")).alias("prompt"))


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 3)})
    SELECT qid, string_agg(replace(substr(documents.text, 1, 200), chr(10), ' '), ' || ' ORDER BY rank) AS passages FROM f JOIN documents USING (doc_id) GROUP BY qid""")
def passage_previews(spark, d):
    hits = lexical.best(lexical.okapi(spark, d), 3).join(lexical.docs(spark, d).select("doc_id", "text"), "doc_id")
    return prompts.docs_in_order(hits).select("qid", writers.preview(F.col("docs")).alias("passages"))


@query("SELECT doc_id, regexp_replace(replace(replace(string_split_regex(a, '(?i)Question\\s*:')[1], '<|eot_id|>', ''), '<|end_of_text|>', ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS answer FROM (SELECT doc_id, ' ' || text || '<|eot_id|> Question : ' || coalesce(title, '') AS a FROM documents WHERE text IS NOT NULL)")
def answer_cleanup(spark, d):
    made = F.concat(F.lit(" "), F.col("text"), F.lit("<|eot_id|> Question : "), F.coalesce("title", F.lit("")))
    return table(spark, d, "documents", "doc_id", "title", "text").where("text is not null").select("doc_id", T.clean_answer(made).alias("answer"))


@query(f"""WITH t AS (SELECT doc_id, {S.TOKENS.format("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) AS r FROM e) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM r WHERE r <= 8 GROUP BY doc_id""")
def keep_top_words_in_order(spark, d):
    w = T.tokens(F.col("text"))
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    return t.select("doc_id", prompts.keep_words(F.col("w"), F.transform("w", lambda x: F.length(x)), 8).alias("kept"))


@query(f"""WITH t AS (SELECT item_id, {S.TOKENS.format("text")} AS w FROM eval_items), p AS (SELECT item_id, w, list_transform(w, lambda x: 1 - exp(-length(x) / 10.0)) AS p FROM t)
    SELECT item_id, list_sum(p) / len(p) > 0.35 AS unsure, list_max(p) > 0.6 AS unsure_max, list_min(p) > 0.1 AS unsure_min,
    array_to_string(list_transform(w, lambda x: CASE WHEN 1 - exp(-length(x) / 10.0) > 0.6 THEN '[xxx]' ELSE x END), ' ') AS masked FROM p""")
def hallucination_flags(spark, d):
    t = table(spark, d, "eval_items").select("item_id", T.tokens(F.col("text")).alias("w"))
    lp = F.transform("w", lambda x: F.length(x) / -10.0)
    return t.select("item_id", prompts.hallucinated(lp, 0.35).alias("unsure"), prompts.hallucinated(lp, 0.6, "max").alias("unsure_max"), prompts.hallucinated(lp, 0.1, "min").alias("unsure_min"), prompts.masked(F.col("w"), lp, 0.6).alias("masked"))


@query(f"""WITH t AS (SELECT item_id, list_transform({S.TOKENS.format("text")}, lambda x: length(x)::DOUBLE) AS a FROM eval_items)
    SELECT item_id, list_sum(list_transform(a, lambda x: CASE WHEN x / list_sum(a) * 1.5 * len(a) > 2 THEN 1 ELSE 0 END))::BIGINT AS flagged,
    round(-list_sum(list_transform(a, lambda x: x / list_sum(a) * ln(x / list_sum(a) + 1e-10))), 5) AS entropy FROM t""")
def attention_and_entropy(spark, d):
    a = F.transform(T.tokens(F.col("text")), lambda x: F.length(x).cast("double"))
    t = table(spark, d, "eval_items").select("item_id", a.alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    flags = prompts.attention_flags(F.col("a"), F.transform("a", lambda x: F.lit(1.5)), 2.0)
    return t.select("item_id", F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: s + x).alias("flagged"), F.round(prompts.entropy(F.transform("a", lambda x: x / total)), 5).alias("entropy"))


@query(f"""WITH t AS (SELECT item_id, unnest({S.TOKENS.format("text")}) AS w, unnest(range(len({S.TOKENS.format("text")}))) AS pos FROM eval_items),
    g AS (SELECT *, sum(CASE WHEN pos % 3 <> 1 OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS word_no FROM t)
    SELECT item_id AS qid, word_no::BIGINT AS word_no, string_agg(w, '' ORDER BY pos) AS word, round(avg(-length(w) / 10.0), 6) AS logprob FROM g GROUP BY ALL""")
def merged_tokens(spark, d):
    """Every token at places 1, 4, 7, ... continues the word before."""
    t = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "w"))
    t = t.select("qid", "pos", F.concat(F.when((F.col("pos") % 3 != 1) | (F.col("pos") == 0), "▁").otherwise(""), "w").alias("token"), (F.length("w") / -10.0).alias("logprob"), F.lit(0.0).alias("entropy"))
    return prompts.merge_tokens(t).select("qid", "word_no", "word", F.round("logprob", 6).alias("logprob"))


@query(f"""WITH t AS (SELECT item_id, unnest({S.TOKENS.format("text")}) AS w, unnest(range(len({S.TOKENS.format("text")}))) AS pos FROM eval_items),
    n AS (SELECT *, 1 - exp(-length(w) / 10.0) AS p, coalesce(sum(CASE WHEN regexp_matches(w, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sn FROM t),
    s AS (SELECT item_id, sn, avg(p) > 0.4 AS bad, string_agg(w, ' ' ORDER BY pos) AS said, string_agg(CASE WHEN p > 0.4 THEN '[xxx]' ELSE w END, ' ' ORDER BY pos) AS masked FROM n GROUP BY ALL),
    f AS (SELECT item_id, min(CASE WHEN bad THEN sn END) AS bad_at FROM s GROUP BY item_id)
    SELECT item_id AS qid, bad_at::BIGINT AS sentence_no, bad_at IS NOT NULL AS unsure, coalesce(string_agg(said, ' ' ORDER BY sn) FILTER (WHERE bad_at IS NULL OR sn < bad_at), '') AS before, max(masked) FILTER (WHERE sn = bad_at) AS masked FROM s JOIN f USING (item_id) GROUP BY item_id, bad_at""")
def first_unsure_sentence(spark, d):
    """Tokens of the items, their log probability being minus their length over ten."""
    t = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    return prompts.first_unsure(t.withColumn("logprob", F.length("token") / -10.0), 0.4)


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 2)}), c AS (SELECT qid, string_agg('[' || rank || '] ' || documents.text || chr(10), '' ORDER BY rank) AS c FROM f JOIN documents USING (doc_id) GROUP BY qid)
    SELECT qid, 'Context:' || chr(10) || c || 'Answer in t he same format as before.' || chr(10) || 'Question: ' || text || chr(10) || 'Answer: so far' AS prompt, length(text) <= 150 AS done FROM c JOIN q USING (qid)""")
def step_prompts(spark, d):
    q = lexical.items(spark, d)
    docs = prompts.docs_in_order(lexical.best(lexical.okapi(spark, d), 2).join(lexical.docs(spark, d).select("doc_id", "text"), "doc_id"))
    done = prompts.stopped(F.col("text"), F.lit("x" * 150), F.lit(1), 9)
    return q.join(docs, "qid").select("qid", prompts.step_prompt(F.array().cast("array<string>"), F.col("docs"), F.col("text"), F.lit("so far")).alias("prompt"), done.alias("done"))


@query("""SELECT query_id, (c - coalesce(lag(c) OVER w, 0))::BIGINT AS chars_delta FROM (SELECT query_id, set_no, persona, sum(length(question)) OVER (PARTITION BY set_no, persona ORDER BY query_id ROWS UNBOUNDED PRECEDING) AS c
    FROM (SELECT DISTINCT query_id, set_no, persona, question FROM cdn_rag_queries WHERE question IS NOT NULL)) WINDOW w AS (PARTITION BY set_no, persona ORDER BY query_id)""")
def counter_deltas(spark, d):
    """Characters asked so far within a set and persona, and their differences."""
    q = table(spark, d, "cdn_rag_queries", "query_id", "set_no", "persona", "question").where("question is not null").distinct()
    run = F.sum(F.length("question")).over(Window.partitionBy("set_no", "persona").orderBy("query_id").rowsBetween(Window.unboundedPreceding, 0))
    return prompts.counter_deltas(q.withColumn("chars", run), ["set_no", "persona"], ["query_id"], ["chars"]).select("query_id", "chars_delta")


@query(r"""SELECT item_id, persona || ' ' || text AS forward_all, persona AS direct FROM eval_items WHERE length(persona) > 0 AND length(text) > 0""")
def query_formulations(spark, d):
    q = table(spark, d, "eval_items").where("length(persona) > 0 and length(text) > 0")
    return q.select("item_id", prompts.formulate("forward_all", F.col("persona"), F.lit(""), F.col("text")).alias("forward_all"), prompts.formulate("direct", F.col("persona"), F.lit(""), F.col("text")).alias("direct"))


@query()
def answered_by_stub(spark, d):
    """A whole round with the stand-in model: prompt, generation, cleaning."""
    model = prompts.EchoGenerator()
    return rag_prompt(spark, d).select("qid", T.clean_answer(model.generate(F.col("prompt"))).alias("answer"))


@query(f"WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top('s', 10)}) SELECT qid, count(*) AS hits, max(score) AS best, min(score) AS worst FROM f GROUP BY qid")
def run_summary(spark, d):
    run = lexical.best(lexical.okapi(spark, d))
    return run.groupBy("qid").agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.min("score").alias("worst"))
