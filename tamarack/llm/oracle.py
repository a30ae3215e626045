"""DuckDB SQL of those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

# Blanks as in trimming a unit: everything that counts as white space.
_TRIM = r"regexp_replace({}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"


def _fits(units: str) -> str:
    return f"coalesce(list_max(list_transform({units}, lambda u: length({_TRIM.format('u')}))), 0) <= 2000"


_LETTERS = r"regexp_replace(lower(x), '[^\p{L}]+', '', 'g')"

_OFTEN = rf"""
        WITH pages AS (SELECT page_id, site, string_split(text, chr(10)) AS l FROM logement_en WHERE site IS NOT NULL AND text IS NOT NULL),
        lines AS (SELECT page_id, site, unnest(list_transform(l, lambda x: {_LETTERS})) AS k, unnest(range(1, len(l) + 1)) AS line_no FROM pages),
        total AS (SELECT site, count(*) AS n FROM pages GROUP BY site),
        often AS (SELECT site, k FROM lines JOIN total USING (site) WHERE length(k) >= 4 GROUP BY site, k, n
                  HAVING count(DISTINCT page_id) >= 6 AND count(DISTINCT page_id) >= 0.15 * n - 1e-9)"""

SQL = {
    "p1_found": rf"""
        SELECT page_id, CASE
            WHEN {_fits(r"string_split_regex(text, '\n([ \t\r]*\n)+')")} THEN 'paragraph'
            WHEN {_fits("string_split(text, chr(10))")} THEN 'line'
            WHEN {_fits(r"flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(regexp_replace(l, '([.!?…])\s+', '\1' || chr(10), 'g'), chr(10))))")} THEN 'sentence'
            WHEN {_fits(r"string_split_regex(text, '\s+')")} THEN 'word'
            ELSE 'character' END AS boundary
        FROM logement_en WHERE length(text) > 2000""",
    "p4_found": rf"""{_OFTEN}
        SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN often USING (site, k)""",
    "p4_clean": rf"""{_OFTEN}, lists AS (SELECT site, list(k) AS ks FROM often GROUP BY site)
        SELECT p.page_id, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)),
            lambda x: length({_LETTERS}) < 4 OR NOT list_contains(ks, {_LETTERS})), chr(10)) END AS clean_text
        FROM logement_en p LEFT JOIN lists USING (site)""",
    # every character that isn't a blank comes out once and in order, and no piece is too long
    "p1_rebuilt": r"""
        SELECT page_id, page_number, true AS within, md5(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', '', 'g')) AS digest
        FROM logement_en WHERE length(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', '', 'g')) > 0""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
