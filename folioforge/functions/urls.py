"""URL columns built from Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_host(url: Column | str) -> Column:
    """Site of a page address: host in lower case, without user, port and
    a leading ``www.`` or ``m.``.  Null stays null; a text without scheme is
    read from its start; without host the result is the empty string."""
    c = F.lower(F.trim(F.col(url) if isinstance(url, str) else url))
    host = F.regexp_extract(c, r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(host, r"^(?:www\.|m\.)", "")


def url_path(url: Column | str) -> Column:
    """Path of an address, ``/`` for none; query and fragment left out."""
    c = F.trim(F.col(url) if isinstance(url, str) else url)
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


#: Segments from this length on name one page, not a kind of page.
LONG_SEGMENT = 24


def template_key(path: Column) -> Column:
    """Shape of a path: segments that name one page become ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    one = lambda s: (
        s.rlike("^[0-9]+$")
        | s.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
        | (F.length(s) >= LONG_SEGMENT)
        | (s.contains("-") & s.rlike("[0-9]"))
    )
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(one(s), "*").otherwise(F.lower(s))), "/"))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host; addresses and single labels stay as they are."""
    return F.when(host.rlike(r"^[0-9.]+$|^\["), host).otherwise(
        F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1), F.lit("")), host)
    )


def fork_key(url: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without closing slash: addresses that fork agree in it."""
    return F.concat(page_host(url), F.regexp_replace(url_path(url), "/+$", ""))


# Path segments of pages about the site's owner.
ABOUT_SEGMENTS = ("about", "about-us", "our-story", "company", "our-team", "who-we-are", "meet-the-team", "team")


def is_about_path(path: Column) -> Column:
    """Whether a whole segment, without name space and file ending, is about-like."""
    seg = lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "^.*:", ""), r"\.(?:html?|php|aspx?|jsp)$", "")
    return F.exists(F.split(path, "/"), lambda s: seg(s).isin(*ABOUT_SEGMENTS))


def resolve(href: Column, base: Column) -> Column:
    """Absolute http(s) address of a link on a page; null for other schemes and bare fragments."""
    h = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://.*/)", 1)
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    clean = F.regexp_replace(h, "#.*$", "")
    return (
        F.when(h.rlike("^#") | (h == ""), F.lit(None))
        .when(h.rlike("(?i)^https?://"), clean)
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(h.startswith("//"), F.concat(scheme, clean))
        .when(h.startswith("/"), F.concat(origin, clean))
        .otherwise(F.concat(folder, clean))
    )
