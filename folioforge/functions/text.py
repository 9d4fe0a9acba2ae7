"""Text functions built from Spark expressions, in the part of regular
expressions that Java and RE2 read alike.  Null texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out when labels are compared.
LABEL_STOPWORDS = ("the", "a", "an", "of", "for", "and", "or", "is", "are", "on", "in", "to", "by", "this", "that")
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (r"Mr", r"Mrs", r"Dr", r"St", r"e\.g", r"i\.e", r"vs", r"etc", r"approx", r"No", r"U\.S", r"U\.K")

#: Word patterns by name, applied to the text in lower case.
WORD_PATTERNS = {
    "alnum_apostrophe": r"[a-z0-9']+",
    "alnum": r"[a-z0-9]+",
    "alpha_apostrophe": r"[a-z]+(?:'[a-z]+)?",
    "plain": r"[^ \t\r\n]+",
}

_GUARD = r"(^|[ (])(" + "|".join(ABBREVIATIONS) + r")\. "
_END = "([.!?]+[\"”’]?) +([\"“‘]?[A-ZÀ-ÖØ-Þ])"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def words(c: Column, pattern: str = "alnum_apostrophe") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERNS[pattern]), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut where a terminator and spaces are followed by a
    capital, unless the stop belongs to an abbreviation."""
    guarded = F.regexp_replace(c, _GUARD, "$1$2.\u0001")
    cut = F.split(F.regexp_replace(guarded, _END, "$1\u0002$2"), "\u0002")
    return F.transform(cut, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(" "))))


def sql_sentences(c: str) -> str:
    end = _END.replace("'", "''")
    guarded = rf"regexp_replace({c}, '{_GUARD}', '\1\2.' || chr(1), 'g')"
    return rf"list_transform(string_split(regexp_replace({guarded}, '{end}', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), ' ')))"


def keywords(label: Column) -> Column:
    """Alphabetic words over two letters without stop words, and their crude singulars."""
    w = F.filter(
        F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), F.lit(0))),
        lambda x: (F.length(x) > 2) & ~x.isin(*LABEL_STOPWORDS),
    )
    single = F.transform(F.filter(w, lambda x: x.endswith("s") & (F.length(x) > 3)), lambda x: x.substr(F.lit(1), F.length(x) - 1))
    return F.sort_array(F.array_union(w, single))


def singular_unit(c: Column) -> Column:
    return F.when(c.endswith("s") & (F.length(c) > 2), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def syllables(word: Column) -> Column:
    """Vowel groups of an English word in lower case; silent endings count nothing."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut_ed = letters.rlike("^.{2,}ed$") & ~letters.rlike("[td]ed$")
    cut_es = letters.rlike("^.{2,}es$") & ~letters.rlike("(?:s|x|z|ch|sh|g|c)es$")
    stem = F.when(cut_ed | cut_es, letters.substr(F.lit(1), F.length(letters) - 2)).otherwise(letters)
    groups = F.regexp_count(stem, F.lit("[aeiouy]+"))
    count = F.when(groups == 0, F.regexp_count(letters, F.lit("[aeiouy]+"))).otherwise(groups)
    count = F.when(stem.endswith("e") & (count > 1), count - 1).otherwise(count)
    return F.when(letters == "", 0).otherwise(F.greatest(count, F.lit(1)))


def sql_syllables(word: str) -> str:
    letters = f"regexp_replace(lower({word}), '[^a-z]', '', 'g')"
    cut = f"((regexp_matches(l, '^.{{2,}}ed$') AND NOT regexp_matches(l, '[td]ed$')) OR (regexp_matches(l, '^.{{2,}}es$') AND NOT regexp_matches(l, '(?:s|x|z|ch|sh|g|c)es$')))"
    groups = "len(regexp_extract_all({}, '[aeiouy]+'))"
    return (
        f"list_transform([{letters}], lambda l: list_transform([CASE WHEN {cut} THEN left(l, len(l) - 2) ELSE l END], lambda t: "
        f"list_transform([CASE WHEN {groups.format('t')} = 0 THEN {groups.format('l')} ELSE {groups.format('t')} END], "
        f"lambda n: CASE WHEN l = '' THEN 0 ELSE greatest(1, CASE WHEN ends_with(t, 'e') AND n > 1 THEN n - 1 ELSE n END) END)[1])[1])[1]"
    )


def slug(c: Column) -> Column:
    """Letters and digits in lower case, everything else one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(8))


def span_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Characters between two spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), b0 - a1, a0 - b1)


# Shapes of values, the first that is found counts.
VALUE_SHAPES = (
    r"\$ ?[0-9][0-9,]*(?:\.[0-9]{1,2})?",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2},? [0-9]{4}",
    r"(?:19|20)[0-9]{2}",
    r"[0-9]{1,3}(?:,[0-9]{3})+",
)


def typed_value(c: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, s, 0), F.lit("")) for s in VALUE_SHAPES))


def sql_typed_value(c: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{s}', 0), '')" for s in VALUE_SHAPES) + ")"


def similarity(a: Column, b: Column) -> Column:
    """100 times one minus the edit distance over the longer length, of sorted words of ASCII letters and digits."""
    x, y = (F.array_join(F.sort_array(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " ")), " ") for c in (a, b))
    return F.when((x == "") & (y == ""), 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))


def sql_similarity(a: str, b: str) -> str:
    x, y = (f"array_to_string(list_sort(string_split(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' ')), ' ')" for c in (a, b))
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 100.0 ELSE 100.0 * (1 - levenshtein({x}, {y}) / greatest(len({x}), len({y}))) END"
