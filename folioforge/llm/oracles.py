"""DuckDB SQL beside the queries of this package, where SQL can express them."""

from __future__ import annotations

_SITE = r"regexp_replace(regexp_extract(lower(trim(page_url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '^(?:www\.|m\.)', '')"

_P6 = rf"""
    WITH b AS (SELECT DISTINCT page_id, block_ord, text FROM blocks_in),
    s AS (SELECT DISTINCT page_id, {_SITE} AS host FROM pages_in),
    l AS (SELECT page_id, block_ord, text, host, regexp_replace(lower(text), '[^\p{{L}}]+', '', 'g') AS line FROM b JOIN s USING (page_id)),
    n AS (SELECT host, count(DISTINCT page_id) AS pages FROM l GROUP BY host),
    f AS (SELECT host, line FROM l JOIN n USING (host) WHERE line <> '' GROUP BY host, line, pages
          HAVING count(DISTINCT page_id) >= 5 AND 10 * count(DISTINCT page_id) >= pages)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _P6 + "SELECT page_id, block_ord FROM l JOIN f USING (host, line)",
        "p6_cleaned": _P6
        + """SELECT page_id, string_agg(text, chr(10) ORDER BY block_ord) AS text
             FROM (SELECT page_id, block_ord, text FROM l LEFT JOIN f USING (host, line) WHERE f.line IS NULL) GROUP BY page_id""",
    }
