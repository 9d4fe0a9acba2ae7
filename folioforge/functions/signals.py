"""Signals inside texts, as Spark expressions.  Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_claimed_date(c: Column) -> Column:
    """Date in one of five usual forms, the first that fits; null else."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    when = lambda pattern, fmt: F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(fmt)).cast("date"))
    return F.coalesce(
        when("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
        when("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
        when("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "M/d/yy"),
        when("^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$", "MMMM d yyyy"),
        when("^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$", "MMM d yyyy"),
    )


PHONE = r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"


def phones(c: Column) -> Column:
    """International phone numbers as digits after a plus, each once, in order."""
    found = F.regexp_extract_all(c, F.lit(PHONE), F.lit(0))
    plain = F.transform(found, lambda p: F.concat(F.lit("+"), F.regexp_replace(p, "[^0-9]", "")))
    return F.array_distinct(F.filter(plain, lambda p: F.length(p).between(8, 16)))
