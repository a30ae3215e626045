"""Column expressions for text: paths, languages, cleaning, tokens, answers. Null gives null unless said otherwise."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words and letters that speak for French, place names that say nothing about a query's language, button
# captions, header lines and end marks.
FRENCH_WORDS = (
    "où", "et", "pour", "avec", "gratuit", "gratuite", "gratuits", "gratuites", "trouver", "comment",
    "est-ce", "qu'est-ce", "quel", "quelle", "près", "proche", "besoin", "j'ai", "avoir",
)
FRENCH_LETTERS = "àâäéèêëïîôöùûüÿçœæ"
PLACES = r"(?i)c[oô]te[\s-]des[\s-]neiges|notre[\s-]dame[\s-]de[\s-]gr[aâ]ce|ndg\b|cdn\b"
BUTTONS = ("Envoyer un message", "Consulter le site Web", "Signaler une erreur dans cette fiche")
ORG_HEADER = r"=====\s*(?:Organisation|Organization)\s+\d+:\s*.+?\s*====="
END_TOKENS = ("<|eot_id|>", "<|end_of_text|>")


def tokens(text: Column) -> Column:
    """Lower case, split at white space; punctuation stays. Empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def tokens_fr(text: Column) -> Column:
    """As ``tokens`` with ``, . ; :`` taken as blanks."""
    return tokens(F.translate(text, ",.;:", "    "))


def tokens_chars(text: Column) -> Column:
    """One token for each character, for languages without blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != "")


def tokens_word(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def path_language(path: Column) -> Column:
    """fr, en or zh by ``/xx/`` or ``_xx`` anywhere in the path, in that order of preference; else unknown."""
    p = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit("unknown")
    for code in ("zh", "en", "fr"):
        out = F.when(F.contains(p, F.lit(f"/{code}/")) | F.contains(p, F.lit(f"_{code}")), code).otherwise(out)
    return out


def bundle_language(path: Column) -> Column:
    """en or fr where it is a whole segment of the path, en first; else unknown."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.when(F.array_contains(parts, "en"), "en").when(F.array_contains(parts, "fr"), "fr").otherwise("unknown")


def path_topic(path: Column) -> Column:
    """File stem without the language endings, taken off one after the other."""
    t = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    for end in ("_fr", "_en", "_zh", "_fr_en"):
        t = F.regexp_replace(t, f"{end}$", "")
    return t


def count_organisations(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ORG_HEADER)), F.lit(0)).cast("long")


def clean_card(text: Column) -> Column:
    """Text before the sharing links, without button captions and blank lines."""
    t = F.trim(F.substring_index(text, "Partager la fiche:", 1))
    for b in BUTTONS:
        t = F.trim(F.replace(t, F.lit(b), F.lit("")))
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), "\n")


def url_topic(url: Column, parameter: str = "mc_thematiques") -> Column:
    """Value of a URL parameter with ``-`` as ``_``; unknown where there is none."""
    return F.replace(F.coalesce(F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1), F.lit("")), F.lit("unknown")), F.lit("-"), F.lit("_"))


def without_places(text: Column) -> Column:
    return F.regexp_replace(text, PLACES, " ")


def query_language(query: Column, fallback: Column | None = None) -> Column:
    """fr where an accented letter or one of the French words occurs outside place names, else ``fallback`` (default en).
    Null and blank queries are en."""
    q = without_places(F.trim(F.coalesce(query, F.lit(""))))
    words = F.transform(F.split(F.lower(q), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,?!'"]+|[.,?!'"]+$""", ""))
    hit = F.lower(q).rlike(f"[{FRENCH_LETTERS}]") | F.arrays_overlap(words, F.array(*map(F.lit, FRENCH_WORDS)))
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "en").when(hit, "fr").otherwise(F.lit("en") if fallback is None else fallback)


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, then without English articles between word boundaries; single blanks."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""), " ")


def clean_answer(text: Column) -> Column:
    """Up to the first further question, without end-of-text marks."""
    t = F.split(text, r"(?i)Question\s*:", 2)[0]
    for mark in END_TOKENS:
        t = F.replace(t, F.lit(mark), F.lit(""))
    return F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def sentences(text: Column) -> Column:
    """Sentences that aren't blank, cut at blanks after ``. ! ?``."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(text), F.lit(1)), F.lit(""))


def last_sentence(text: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(text), F.lit(-1)), F.lit(""))


def last_tokens(text: Column, n: int) -> Column:
    """The last n tokens joined by blanks."""
    t = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - n + 1), F.lit(n)), " ")


def stable_seed(text: Column, seed: int) -> Column:
    """First four bytes of sha256("seed|text") as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), text), 256), 1, 8), 16, 10).cast("long")


def safe_id(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\t\r\f", "    ")


def valid_index_name(name: Column) -> Column:
    """True where a search index may have this name: lower case, none of the forbidden characters or begins."""
    return ~name.rlike(r'[#:\\/*?"<>|,]') & ~name.rlike(r"^[_\-+]") & ~name.isin(".", "..") & (F.lower(name) == name) & name.rlike(r"\p{Ll}")


def without_emoji(text: Column) -> Column:
    """Without pictographs, line ends and links, trimmed."""
    t = F.regexp_replace(text, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n", " "), r"http\S+", ""))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def html_text(html: Column) -> Column:
    """Text nodes of a page joined as they are: scripts, styles, templates and comments left out, tags taken away, entities
    decoded (in Python, for those texts only that hold an ``&``)."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    return F.coalesce(_unescaped(F.when(F.contains(t, F.lit("&")), t)), t)
