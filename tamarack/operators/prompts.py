"""Query sets, prompts, and the bookkeeping around generation."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSTRUCTION = (
    "Answer the question above with ONLY the answer. Do not generate another question, another Answer section, "
    "or any additional examples.\n"
)


class Generator(Protocol):
    """A language model: a column of prompts to a column of texts (an expression or an iterator pandas UDF)."""

    def generate(self, prompt: Column) -> Column: ...


class EchoGenerator:
    """A deterministic stand-in: the prompt's last question."""

    def generate(self, prompt: Column) -> Column:
        return F.trim(F.regexp_extract(prompt, r"(?s)Question: ((?:(?!Question: ).)*?)\nAnswer:\s*$", 1))


def query_id(persona: Column, difficulty: Column, idx: Column) -> Column:
    return F.lower(F.replace(F.concat_ws("_", persona, difficulty, idx.cast("string")), F.lit(" "), F.lit("_")))


def flatten_queries(nested: DataFrame, column: str) -> DataFrame:
    """(qid, persona, difficulty, idx, question) from a map persona -> difficulty -> list."""
    d = nested.select(F.explode(column).alias("persona", "by")).select("persona", F.explode("by").alias("difficulty", "list"))
    d = d.select("persona", "difficulty", F.posexplode("list").alias("idx", "question"))
    return d.select(query_id(F.col("persona"), F.col("difficulty"), F.col("idx")).alias("qid"), "persona", "difficulty", "idx", "question")


def case(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def demo(question: Column, answer: Column) -> Column:
    return F.concat(case(question), F.lit(" "), answer)


def plain_prompt(demos: Column, question: Column) -> Column:
    """Demonstrations (array of strings), each on its line, a blank line, the case."""
    return F.concat(F.array_join(F.transform(demos, lambda d: F.concat(d, F.lit("\n"))), ""), F.lit("\n"), case(question))


def context_prompt(demos: Column, docs: Column, question: Column) -> Column:
    """Demonstrations, numbered context, instruction, case."""
    context = F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d, F.lit("\n"))), "")
    return F.concat(F.array_join(F.transform(demos, lambda d: F.concat(d, F.lit("\n"))), ""), F.lit("Context:\n"), context, F.lit(INSTRUCTION), case(question))


#: Instruction of the loops with a retrieval for every step; a fixed value.
STEP_INSTRUCTION = "Answer in t he same format as before.\n"


def step_prompt(demos: Column, docs: Column, question: Column, done: Column, instruction: str = STEP_INSTRUCTION) -> Column:
    """The prompt in the middle of an answer: context, instruction, case, a blank and what was answered so far."""
    context = F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d, F.lit("\n"))), "")
    return F.concat(F.array_join(F.transform(demos, lambda d: F.concat(d, F.lit("\n"))), ""), F.lit("Context:\n"), context, F.lit(instruction), case(question), F.lit(" "), done)


def stopped(text: Column, before: Column, tokens: Column, most: int) -> Column:
    """Whether an answer is done: too many tokens, no longer than before, or it names its answer."""
    return (tokens > most) | (F.length(text) <= F.length(before)) | F.contains(text, F.lit("the answer is"))


def first_unsure(trace: DataFrame, threshold: float, solver: str = "avg") -> DataFrame:
    """(qid, sentence_no, unsure, before, masked) of (qid, pos, token, logprob): tokens are laid to sentences, which end with a token
    that ends in ``. ! ?``; the first one whose mean, largest or smallest 1 - exp(logprob) is over the threshold, what was said
    before it, and itself with its unsure tokens as [xxx]. A text without one has unsure false, all of it as ``before``, no masked."""
    w = Window.partitionBy("qid").orderBy("pos")
    d = trace.withColumn("p", 1 - F.exp("logprob"))
    d = d.withColumn("sentence_no", F.coalesce(F.sum(F.col("token").rlike(r"[.!?]$").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    value = {"avg": F.avg("p"), "max": F.max("p"), "min": F.min("p")}[solver]
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), " ")
    s = d.groupBy("qid", "sentence_no").agg((value > threshold).alias("bad"), joined(F.col("token")).alias("said"), joined(F.when(F.col("p") > threshold, "[xxx]").otherwise(F.col("token"))).alias("masked"))
    ordered = F.sort_array(F.collect_list(F.struct("sentence_no", "bad", "said", "masked")))
    s = s.groupBy("qid").agg(ordered.alias("s"))
    at = F.array_position(F.transform("s", lambda x: x["bad"]), True)
    before = F.array_join(F.transform(F.when(at > 0, F.slice("s", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("s")), lambda x: x["said"]), " ")
    bad = F.try_element_at("s", F.when(at > 0, at.cast("int")))
    return s.select("qid", bad["sentence_no"].alias("sentence_no"), (at > 0).alias("unsure"), before.alias("before"), bad["masked"].alias("masked"))


def docs_in_order(hits: DataFrame) -> DataFrame:
    """(qid, docs): texts by rank. A query has at most the k hits of its run."""
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("h")).select("qid", F.col("h.text").alias("docs"))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(x + 1e-10))


def merge_tokens(trace: DataFrame, marker: str = "▁") -> DataFrame:
    """(qid, word_no, word, logprob, entropy) from (qid, pos, token, logprob, entropy): sub-words joined to words at the
    marker; log probabilities and entropies are means."""
    w = Window.partitionBy("qid").orderBy("pos")
    new = F.when(F.col("token").startswith(marker) | (F.row_number().over(w) == 1), 1).otherwise(0)
    d = trace.withColumn("__n", new).withColumn("word_no", F.sum("__n").over(w))
    word = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: F.replace(x["token"], F.lit(marker), F.lit(""))), "")
    return d.groupBy("qid", "word_no").agg(word.alias("word"), F.avg("logprob").alias("logprob"), F.avg("entropy").alias("entropy"))


def hallucinated(trace: Column, threshold: float, solver: str = "avg") -> Column:
    """Whether a sentence's tokens (array of log probabilities) are too unsure: mean, largest or smallest of 1 - exp(logprob)."""
    p = F.transform(trace, lambda x: 1 - F.exp(x))
    value = {"avg": F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p), "max": F.array_max(p), "min": F.array_min(p)}[solver]
    return F.coalesce(value > threshold, F.lit(False))


def masked(tokens: Column, logprobs: Column, threshold: float) -> Column:
    """Tokens joined by blanks, unsure ones as [xxx]."""
    return F.array_join(F.zip_with(tokens, logprobs, lambda t, x: F.when(1 - F.exp(x) > threshold, "[xxx]").otherwise(t)), " ")


def attention_flags(attention: Column, entropies: Column, threshold: float) -> Column:
    """1 where a token's share of the attention times its entropy times the number of tokens is over the threshold."""
    total = F.aggregate(attention, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(attention, entropies, lambda a, e: F.when(F.coalesce(F.try_divide(a, total), F.lit(0.0)) * e * F.size(attention) > threshold, 1).otherwise(0))


def formulate(kind: str, question: Column, text: Column, partial: Column, current: Column | None = None, hits: Column | None = None, n: int = 10) -> Column:
    """The next retrieval query: direct, forward_all, last_sentence, last_n_tokens, current or current_wo_wrong."""
    from tamarack.functions.text import last_sentence, last_tokens

    whole = F.array_join(F.filter(F.array(question, text, partial), lambda x: F.length(x) > 0), " ")
    if kind == "direct":
        return question
    if kind == "forward_all":
        return whole
    if kind == "last_sentence":
        return last_sentence(whole)
    if kind == "last_n_tokens":
        return last_tokens(whole, n)
    if kind == "current":
        return F.array_join(current, " ")
    if kind == "current_wo_wrong":
        return F.array_join(F.zip_with(current, hits, lambda t, h: F.when(h == 0, t).otherwise("")), " ")
    raise ValueError(kind)


def keep_words(words: Column, scores: Column, k: int) -> Column:
    """The k best words (ties: the earlier), back in text order, joined by blanks."""
    items = F.transform(F.arrays_zip(words.alias("w"), scores.alias("s")), lambda x, i: F.struct((-x["s"]).alias("s"), i.alias("i"), x["w"].alias("w")))
    best = F.slice(F.array_sort(items), 1, k)
    return F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"]), " ")


def counter_deltas(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Differences of running counters from row to row; the first row's are its own values."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}_delta": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in columns})
