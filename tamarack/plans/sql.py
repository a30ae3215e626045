"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '\s+'), lambda x: x <> '')"
WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"
DOCS = "SELECT '' AS bundle, doc_id, text FROM documents"
BUNDLES = "SELECT coalesce(lang, 'unknown') AS bundle, doc_id, text FROM documents"
ITEMS = "SELECT item_id AS qid, text FROM eval_items"

IDF = {
    "okapi": "ln(n - df + 0.5) - ln(df + 0.5)",
    "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))",
}


def index(docs: str = DOCS, field: str = "text", tokens: str = TOKENS) -> str:
    """CTEs d, tf (with dl), st, dfs of an index."""
    return f"""d AS ({docs}),
        tok AS (SELECT bundle, doc_id, unnest({tokens.format(field)}) AS term FROM d),
        dl AS (SELECT bundle, doc_id, count(*) AS dl FROM tok GROUP BY ALL),
        tf AS (SELECT t.*, dl FROM (SELECT bundle, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL) t JOIN dl USING (bundle, doc_id)),
        st AS (SELECT d.bundle, count(*) AS n, coalesce(sum(dl), 0) / count(*)::DOUBLE AS avgdl FROM d LEFT JOIN dl USING (bundle, doc_id) GROUP BY d.bundle),
        dfs AS (SELECT bundle, term, count(*) AS df FROM tf GROUP BY ALL)"""


def terms(queries: str = ITEMS, tokens: str = TOKENS) -> str:
    return f"""q AS ({queries}),
        qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({tokens.format("text")}) AS term FROM q) GROUP BY ALL)"""


def scored(kind: str = "okapi", k1: float = 1.5, b: float = 0.75, saturation: bool = True, qt: str = "qt") -> str:
    """CTE s(qid, bundle, doc_id, score) over index() and terms()."""
    top = f"({k1} + 1)" if saturation else "1"
    return f"""i0 AS (SELECT bundle, term, avgdl, {IDF[kind]} AS i FROM dfs JOIN st USING (bundle)),
        eps AS (SELECT bundle, 0.25 * avg(i) AS e FROM i0 GROUP BY bundle),
        idf AS (SELECT bundle, term, avgdl, {"CASE WHEN i < 0 THEN e ELSE i END" if kind == "okapi" else "i"} AS idf FROM i0 JOIN eps USING (bundle)),
        s AS (SELECT qid, tf.bundle, doc_id, round(sum(qn * idf * tf * {top} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
              FROM {qt} JOIN tf USING (term) JOIN idf USING (bundle, term) GROUP BY ALL HAVING score > 0)"""


def top(source: str, k: int, by: str = "qid", columns: str = "qid, doc_id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


VECTORS = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings), qv AS (SELECT doc_id AS qid, v AS qv, label AS ql FROM v WHERE doc_id % 20 = 0)"


def nearest(score: str, k: int = 10) -> str:
    """CTEs ending in run(qid, doc_id, score, rank) for a score of qv and v."""
    return f"{VECTORS}, s AS (SELECT qid, doc_id, round({score}, 6) + 0.0 AS score FROM qv, v WHERE qid <> doc_id), run AS ({top('s', k)})"


DOT = "list_inner_product(qv, v)"
#: Judgements of the vector run: same label counts, twice where the id's last digit is the query's.
QRELS = "qrels AS (SELECT qid, doc_id, CASE WHEN doc_id % 10 = qid % 10 THEN 2 ELSE 1 END AS score FROM qv, v WHERE qid <> doc_id AND label = ql)"
