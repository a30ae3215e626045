"""Text cleaning, categorising, chunking, packing, query sets, and the event extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import prompts, structure
from tamarack.plans import sql as S
from tamarack.plans.registry import query, table
from tamarack.sources import writers
from tamarack.streaming import incremental

_Q = "(SELECT DISTINCT query_id, question, persona, difficulty, idx FROM cdn_rag_queries WHERE question IS NOT NULL)"


def asked(spark, d):
    return table(spark, d, "cdn_rag_queries", "query_id", "question", "persona", "difficulty", "idx").where("question is not null").distinct()


@query("""WITH q AS (SELECT DISTINCT query_id AS qid, question AS text FROM cdn_rag_queries WHERE question IS NOT NULL), """ + __import__("tamarack.plans.lexical", fromlist=["ROUTED"]).ROUTED + """
    SELECT qid AS query_id, ql AS lang FROM ql""")
def detect_language(spark, d):
    return asked(spark, d).select("query_id", T.query_language(F.col("question")).alias("lang")).distinct()


@query(rf"SELECT query_id, regexp_replace(question, '(?i)c[oô]te[\s-]des[\s-]neiges|notre[\s-]dame[\s-]de[\s-]gr[aâ]ce|ndg\b|cdn\b', ' ', 'g') AS text FROM {_Q}")
def strip_place_names(spark, d):
    return asked(spark, d).select("query_id", T.without_places(F.col("question")).alias("text"))


_PATH = "(SELECT page_id, '/pages/' || coalesce(lang, 'none') || '/' || file_name AS p FROM logement_en WHERE file_name IS NOT NULL)"


def paths(spark, d):
    p = table(spark, d, "logement_en", "page_id", "lang", "file_name").where("file_name is not null")
    return p.select("page_id", F.concat(F.lit("/pages/"), F.coalesce("lang", F.lit("none")), F.lit("/"), "file_name").alias("p"))


@query(f"""SELECT page_id, CASE WHEN contains(lower(p), '/fr/') OR contains(lower(p), '_fr') THEN 'fr' WHEN contains(lower(p), '/en/') OR contains(lower(p), '_en') THEN 'en'
    WHEN contains(lower(p), '/zh/') OR contains(lower(p), '_zh') THEN 'zh' ELSE 'unknown' END AS by_path,
    CASE WHEN list_contains(string_split(p, '/'), 'en') THEN 'en' WHEN list_contains(string_split(p, '/'), 'fr') THEN 'fr' ELSE 'unknown' END AS by_segment FROM {_PATH}""")
def path_language(spark, d):
    return paths(spark, d).select("page_id", T.path_language(F.col("p")).alias("by_path"), T.bundle_language(F.col("p")).alias("by_segment"))


@query(f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(p, '/')[-1], '\\.[^.]*$', ''), '_fr$', ''), '_en$', ''), '_zh$', ''), '_fr_en$', '') AS topic FROM {_PATH}")
def path_topic(spark, d):
    return paths(spark, d).select("page_id", T.path_topic(F.col("p")).alias("topic"))


@query("SELECT doc_id, replace(coalesce(nullif(regexp_extract(u, '[?&]mc_thematiques=([^&#]+)', 1), ''), 'unknown'), '-', '_') AS topic FROM (SELECT doc_id, 'https://x.example/?page=1' || CASE WHEN source IS NULL THEN '' ELSE '&mc_thematiques=' || replace(source, '_', '-') END AS u FROM documents)")
def url_param_topic(spark, d):
    url = F.concat(F.lit("https://x.example/?page=1"), F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("&mc_thematiques="), F.replace("source", F.lit("_"), F.lit("-")))))
    return table(spark, d, "documents", "doc_id", "source").select("doc_id", T.url_topic(url).alias("topic"))


_HTML = "'<html><head><title>' || coalesce(title, '') || '</title><script>var a = \"<b>\";</script></head><!-- note --><body><p class=\"x\">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></html>'"


@query(f"""SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS text FROM (SELECT doc_id, {_HTML} AS h FROM documents WHERE text IS NOT NULL)""")
def html_text_regex(spark, d):
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit('</title><script>var a = "<b>";</script></head><!-- note --><body><p class="x">'), safe, F.lit("</p></body></html>"))
    return table(spark, d, "documents", "doc_id", "title", "text").where("text is not null").select("doc_id", T.html_text(html).alias("text"))


@query("""SELECT page_id, array_to_string(list_filter(string_split(trim(replace(trim(replace(trim(replace(trim(string_split(text, 'Partager la fiche:')[1]), 'Envoyer un message', '')), 'Consulter le site Web', '')), 'Signaler une erreur dans cette fiche', '')), chr(10)), lambda x: trim(x) <> ''), chr(10)) AS text
    FROM logement_en WHERE text IS NOT NULL""")
def scrape_cleanup(spark, d):
    return table(spark, d, "logement_en", "page_id", "text").where("text is not null").select("page_id", T.clean_card(F.col("text")).alias("text"))


_SHEETS = """sheets AS (SELECT source, 'intro' || chr(10) || string_agg('===== Organisation ' || n || ': ' || coalesce(title, '-') || ' =====' || chr(10) || coalesce(text, ''), chr(10) ORDER BY n) AS t
    FROM (SELECT source || '/' || (doc_id // 200) AS source, title, text, row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL) GROUP BY source)"""


def sheets(spark, d):
    """Text files of at most 200 sheets: a source's documents of 200 neighbouring ids."""
    from pyspark.sql import Window

    s = table(spark, d, "documents", "source", "doc_id", "title", "text").where("source is not null")
    s = s.withColumn("source", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 200).cast("string")))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    block = F.concat(F.lit("===== Organisation "), F.col("n").cast("string"), F.lit(": "), F.coalesce("title", F.lit("-")), F.lit(" =====\n"), F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n")
    return s.groupBy("source").agg(F.concat(F.lit("intro\n"), joined).alias("t"))


@query(f"WITH {_SHEETS} SELECT source, len(regexp_extract_all(t, '=====\\s*(?:Organisation|Organization)\\s+\\d+:\\s*.+?\\s*====='))::BIGINT AS organisations FROM sheets")
def org_count(spark, d):
    return sheets(spark, d).select("source", T.count_organisations(F.col("t")).alias("organisations"))


@query(f"""WITH {_SHEETS}, b AS (SELECT source, unnest(string_split(regexp_replace(t, '(=====\\s*Organisation\\s+\\d+:)', chr(1) || '\\1', 'g'), chr(1))[2:]) AS b, unnest(range(len(string_split(t, '===== Organisation ')) - 1)) AS nr FROM sheets),
    c AS (SELECT source, nr, regexp_replace(regexp_replace(b, '(?s)^=====\\s*Organisation\\s+\\d+:\\s*(.+?)\\s*=====', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS b, trim(regexp_extract(b, '(?s)^=====\\s*Organisation\\s+\\d+:\\s*(.+?)\\s*=====', 1)) AS organization_name FROM b),
    p AS (SELECT source, nr, organization_name, b, length(b) > 1000 AS long, unnest(CASE WHEN length(b) > 1000 THEN range(0, length(b), 500) ELSE [0] END) AS off FROM c),
    i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nr, off) - 1 AS chunk_index FROM p)
    SELECT source, source || '_org_' || chunk_index || CASE WHEN long THEN '_sub_' || (off // 500) ELSE '' END AS chunk_id, organization_name, chunk_index, CASE WHEN long THEN substr(b, off + 1, 500) ELSE b END AS content FROM i""")
def org_chunks(spark, d):
    return structure.chunk_organisations(sheets(spark, d), "source", "t", 500)


@query("SELECT page_id, page_id || '_chunk_0' AS chunk_id, CAST(NULL AS VARCHAR) AS organization_name, 0::BIGINT AS chunk_index, text AS content FROM logement_en WHERE text IS NOT NULL AND NOT regexp_matches(text, '=====\\s*(?:Organisation|Organization)\\s+\\d+:')")
def org_chunks_without_header(spark, d):
    """Documents without an organisation come out whole."""
    p = table(spark, d, "logement_en", "page_id", "text").where(~F.col("text").rlike(r"=====\s*(?:Organisation|Organization)\s+\d+:"))
    return structure.chunk_organisations(p, "page_id", "text", 500)


@query()
def org_chunks_recursive(spark, d):
    """Long blocks are cut at separators; so are pages without an organisation."""
    p = table(spark, d, "logement_en", "page_id", "text").select(F.col("page_id").cast("string").alias("key"), F.col("text").alias("t"))
    return structure.chunk_organisations(sheets(spark, d).select(F.col("source").alias("key"), "t").unionByName(p), "key", "t", 500, recursive=True)


@query("""WITH c AS (SELECT category_name, min(category_id) AS category_id FROM categories GROUP BY ALL), f AS (SELECT DISTINCT file_name FROM logement_en WHERE length(file_name) % 2 = 0),
    n AS (SELECT file_name, row_number() OVER (ORDER BY file_name) AS r FROM f), k AS (SELECT *, row_number() OVER (ORDER BY category_id) AS r, count(*) OVER () AS m FROM c)
    SELECT page_id, file_name, category_id, category_name, '' AS subcategory FROM logement_en JOIN n USING (file_name) JOIN k ON (n.r - 1) % m + 1 = k.r""")
def file_categories(spark, d):
    """Every second file name (by its length) is given a category in turn; the others have none."""
    pages = table(spark, d, "logement_en", "page_id", "file_name")
    cats = table(spark, d, "categories", "category_id", "category_name")
    files = structure.running_ids(pages.select("file_name").where("length(file_name) % 2 = 0").distinct(), ["file_name"], "r")
    order = cats.groupBy("category_name").agg(F.min("category_id").alias("category_id"))
    order = structure.running_ids(order, ["category_id"], "k")
    m = order.count()
    base = F.replace(F.replace(F.col("file_name"), F.lit(".json"), F.lit("")), F.lit("_en"), F.lit(""))
    names = files.withColumn("k", F.pmod(F.col("r") - 1, F.lit(m)) + 1).join(order.select("k", "category_name"), "k").select(base.alias("base"), "category_name").dropDuplicates(["base"])
    return structure.categorise_files(pages, names, cats)


@query("SELECT page_id, i AS piece_no, substr(text, i * 500 + 1, 500) AS piece FROM (SELECT page_id, text, unnest(range((length(text) + 499) // 500)) AS i FROM logement_en WHERE length(text) > 0)")
def fixed_window_chunks(spark, d):
    p = table(spark, d, "logement_en", "page_id", "text")
    return p.select("page_id", F.posexplode(structure.fixed_windows(F.col("text"), 500)).alias("piece_no", "piece")).withColumn("piece_no", F.col("piece_no").cast("long"))


@query(f"SELECT doc_id, i AS window_no, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') AS piece FROM (SELECT doc_id, w, unnest(range((len(w) + 39) // 40)) AS i FROM (SELECT doc_id, {S.TOKENS.format('text')} AS w FROM documents))")
def token_window_chunks(spark, d):
    w = structure.token_windows(T.tokens(F.col("text")), 50, 10)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(w).alias("window_no", "piece")).withColumn("window_no", F.col("window_no").cast("long"))


@query("WITH c AS (SELECT substr(text, i * 500 + 1, 500) AS piece FROM (SELECT text, unnest(range((length(text) + 499) // 500)) AS i FROM logement_en WHERE length(text) > 0)) SELECT count(*) AS total_chunks, round(avg(length(piece)), 6) AS avg_size, min(length(piece)) AS min_size, max(length(piece)) AS max_size, sum(length(piece))::BIGINT AS total_chars FROM c")
def chunk_stats(spark, d):
    return structure.chunk_stats(fixed_window_chunks(spark, d), "piece")


@query()
def recursive_chunks(spark, d):
    return structure.chunk_recursive(table(spark, d, "logement_en", "page_id", "text"), "text", 500, 50)


@query("SELECT category_id, category_name, subcategory, start_page, coalesce(lead(start_page) OVER (ORDER BY start_page, category_id, subcategory) - 1, 10000) AS end_page FROM categories")
def page_intervals(spark, d):
    return structure.page_intervals(table(spark, d, "categories"))


@query("""WITH i AS (SELECT *, coalesce(lead(start_page) OVER (ORDER BY start_page, category_id, subcategory) - 1, 10000) AS end_page FROM categories)
    SELECT page_id, page_number, i.category_id, i.category_name, i.subcategory FROM logement_en LEFT JOIN i ON page_number BETWEEN start_page AND end_page""")
def page_category_range_join(spark, d):
    pages = table(spark, d, "logement_en", "page_id", "page_number")
    return structure.categorise(pages, structure.page_intervals(table(spark, d, "categories")))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1")
def majority_language(spark, d):
    return structure.majority(table(spark, d, "documents", "source", "lang"), ["source"], "lang")


@query()
def packed_paragraphs(spark, d):
    p = table(spark, d, "logement_en", "page_id", "text").where("text is not null")
    return p.select("page_id", F.posexplode(structure.pack_paragraphs(F.col("text"), 4500)).alias("pack_no", "pack"))


@query("SELECT 'docs_' || row_number() OVER (ORDER BY doc_id) AS id, text AS contents FROM documents WHERE length(trim(text)) > 0")
def index_corpus_ids(spark, d):
    return writers.index_corpus(table(spark, d, "documents", "doc_id", "text"), "docs", ["doc_id"], "text")


@query("SELECT row_number() OVER (ORDER BY file_name, page_number, page_id) AS chunk_id, page_id FROM logement_en WHERE length(trim(text)) > 0 AND page_number IS NOT NULL")
def running_chunk_ids(spark, d):
    p = table(spark, d, "logement_en", "file_name", "page_number", "page_id", "text").where("length(trim(text)) > 0 and page_number is not null").drop("text")
    return structure.running_ids(p, ["file_name", "page_number", "page_id"]).select(F.col("chunk_id").cast("long").alias("chunk_id"), "page_id")


@query(f"SELECT DISTINCT lower(replace(persona || '_' || difficulty || '_' || idx, ' ', '_')) AS qid, persona, difficulty, idx, question FROM {_Q} WHERE persona IS NOT NULL AND difficulty IS NOT NULL AND idx IS NOT NULL")
def query_flatten(spark, d):
    """The nested set is rebuilt, persona -> difficulty -> list, and flattened."""
    q = asked(spark, d).where("persona is not null and difficulty is not null and idx is not null")
    return q.select(prompts.query_id(F.col("persona"), F.col("difficulty"), F.col("idx")).alias("qid"), "persona", "difficulty", "idx", "question").distinct()


@query("SELECT id, persona, pos AS need_no, needs[pos] AS need FROM (SELECT id, persona, needs, unnest(range(1, len(needs) + 1)) AS pos FROM personas)")
def persona_needs(spark, d):
    return table(spark, d, "personas").select("id", "persona", F.posexplode("needs").alias("need_no", "need")).withColumn("need_no", (F.col("need_no") + 1).cast("long"))


@query("SELECT category_id, category_name, count(*) AS parts, min(start_page) AS first_page FROM categories GROUP BY ALL")
def category_tree(spark, d):
    return table(spark, d, "categories").groupBy("category_id", "category_name").agg(F.count("*").alias("parts"), F.min("start_page").alias("first_page"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, coalesce({_SENT}[1], '') AS first, coalesce({_SENT}[-1], '') AS last FROM documents WHERE text IS NOT NULL")
def first_last_sentence(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", T.first_sentence(F.col("text")).alias("first"), T.last_sentence(F.col("text")).alias("last"))


@query(r"SELECT doc_id, array_to_string(w[greatest(1, len(w) - 9):], ' ') AS tail FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)")
def last_n_tokens(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.last_tokens(F.col("text"), 10).alias("tail"))


@query(f"SELECT query_id, ('0x' || substr(sha256('42|' || question), 1, 8))::BIGINT AS seed FROM {_Q}")
def stable_seed(spark, d):
    return asked(spark, d).select("query_id", T.stable_seed(F.col("question"), 42).alias("seed"))


@query(r"""SELECT source, NOT regexp_matches(source, '[#:\\/*?"<>|,]') AND NOT regexp_matches(source, '^[_\-+]') AND source NOT IN ('.', '..') AND lower(source) = source AND regexp_matches(source, '\p{Ll}') AS valid FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL UNION ALL SELECT unnest(['_x', 'A b', 'a:b', '..', 'ok-1']))""")
def valid_index_names(spark, d):
    extra = spark.createDataFrame([(x,) for x in ("_x", "A b", "a:b", "..", "ok-1")], "source string")
    return table(spark, d, "documents", "source").where("source is not null").distinct().unionByName(extra).select("source", T.valid_index_name(F.col("source")).alias("valid"))


@query(r"SELECT query_id, query_id || chr(9) || translate(question, chr(10) || chr(9) || chr(13) || chr(12), '    ') AS line FROM " + _Q)
def query_lines(spark, d):
    return asked(spark, d).select("query_id", writers.query_line(F.col("query_id"), F.col("question")).alias("line"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(regexp_replace(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]', '', 'g'), chr(10), ' '), 'http\S+', '', 'g')) AS clean FROM documents WHERE text IS NOT NULL")
def strip_emoji_and_links(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.without_emoji(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(translate(lower(coalesce(text, '')), ',.;:', '    '), '\s+'), lambda x: x <> ''))::BIGINT AS french, length(coalesce(text, '')) AS characters, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'))::BIGINT AS words FROM documents")
def tokenizers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(T.tokens_fr(t)).cast("long").alias("french"), F.size(T.tokens_chars(t)).cast("long").alias("characters"), F.size(T.tokens_word(t)).cast("long").alias("words"))


@query("SELECT doc_id, '===== Organisation ' || doc_id || ': ' || coalesce(title, '-') || ' =====' || chr(10) || 'URL: ' || coalesce(source, '-') || chr(10) || 'Site internet: None' || chr(10) || chr(10) || 'Description: ' || coalesce(text, '') || chr(10) || chr(10) AS sheet FROM documents")
def text_sheets(spark, d):
    t = table(spark, d, "documents", "doc_id", "title", "source", "text")
    return t.select("doc_id", writers.sheet(F.col("doc_id"), F.coalesce("title", F.lit("-")), F.coalesce("source", F.lit("-")), F.lit("None"), F.col("text")).alias("sheet"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Extension: the batch form of the streaming window."""
    return incremental.windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return incremental.sessions(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
