"""HTML to text and to rows with Spark expressions only.

The patterns keep to what Java and RE2 read alike, so each has a SQL twin.
Null html gives null; unclosed elements end with the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text is not visible, and elements that break a line.
SKIPPED = ("script", "style", "code", "pre", "noscript", "template", "svg")
BREAKING = (
    "p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer",
    "blockquote", "ul", "ol", "table", "td", "th",
)
#: The references that matter for word and line counts; ``&amp;`` comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))

COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>"
#: The same for Java, to be replaced by ``$1``: a ``<`` that nothing closes is found once and kept with all that follows, else each
#: such ``<`` looks for its ``>`` up to the end and the time grows with the square of the text.
_TAG_ONCE = r"<[^>]*+>|(<[^>]*+\z)"
BREAK = r"(?i)</?(?:" + "|".join(BREAKING) + r")(?:[ \t\r\n/][^>]*)?>"
SPACES = r"[ \t\r\n\f]+"


def element(tag: str) -> str:
    """Pattern of a whole element, attributes and content included."""
    return rf"(?is)<{tag}(?:[ \t\r\n][^>]*)?>.*?</{tag}[ \t\r\n]*>"


def without_hidden(html: Column) -> Column:
    """Html without comments and elements that show no text."""
    c = F.regexp_replace(html, COMMENT, "")
    for tag in SKIPPED:
        c = F.regexp_replace(c, element(tag), "")
    return c


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, _TAG_ONCE, "$1")


def plain(fragment: Column) -> Column:
    """Text of a fragment: no tags, the usual references, white space collapsed."""
    c = without_tags(fragment)
    for a, b in REFERENCES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, SPACES, " "))


def visible_text(html: Column, raw: bool = False) -> Column:
    """Lines of visible text.  ``raw`` keeps the line breaks of the source."""
    c = without_hidden(html)
    if not raw:
        c = F.regexp_replace(c, SPACES, " ")
    c = F.regexp_replace(c, BREAK, "\n")
    c = without_tags(c)
    for a, b in REFERENCES:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    c = F.regexp_replace(c, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_without_hidden(html: str) -> str:
    c = f"regexp_replace({html}, {sql_string(COMMENT)}, '', 'g')"
    for tag in SKIPPED:
        c = f"regexp_replace({c}, {sql_string(element(tag))}, '', 'g')"
    return c


def _sql_references(c: str) -> str:
    for a, b in REFERENCES:
        c = f"replace({c}, {sql_string(a)}, {sql_string(b)})"
    return c


def sql_plain(fragment: str) -> str:
    c = _sql_references(f"regexp_replace({fragment}, {sql_string(TAG)}, '', 'g')")
    return f"trim(regexp_replace({c}, {sql_string(SPACES)}, ' ', 'g'))"


def sql_visible_text(html: str, raw: bool = False) -> str:
    c = sql_without_hidden(html)
    if not raw:
        c = f"regexp_replace({c}, {sql_string(SPACES)}, ' ', 'g')"
    c = f"regexp_replace({c}, {sql_string(BREAK)}, chr(10), 'g')"
    c = _sql_references(f"regexp_replace({c}, {sql_string(TAG)}, '', 'g')")
    c = rf"regexp_replace({c}, '[ \t\r\f]+', ' ', 'g')"
    c = rf"regexp_replace({c}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({c}, '^[ \n]+|[ \n]+$', '', 'g')"
