"""Names, spans, dates and hosts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Top-level names and domains reserved for documentation.
RESERVED_TOP = ("test", "example", "invalid", "localhost")
RESERVED_DOMAINS = ("example.com", "example.net", "example.org")


def normal(text: Column) -> Column:
    """Lower case; anything but letters a-z, digits and the space is a space; ends trimmed; runs of spaces one."""
    # Single blanks, most of them, are not matched: replacing each by itself took most of the time.
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), "  +", " "))


def slug(text: Column) -> Column:
    """Runs of anything but letters and digits are one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def verbatim(span: Column, text: Column, limit: int = 400) -> Column:
    """The span, white space squeezed, if the text holds it (case aside) and it is no longer than ``limit``; else null."""
    small = squeezed(span)
    held = F.contains(F.lower(squeezed(text)), F.lower(small)) & F.length(small).between(1, limit)
    return F.when(held, small)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def reserved(url: Column) -> Column:
    """Whether a URL's host is reserved for samples."""
    h = host(url)
    top = F.element_at(F.split(h, r"\."), -1)
    return top.isin(*RESERVED_TOP) | h.isin(*RESERVED_DOMAINS) | h.rlike(r"\.example\.(com|net|org)$")


def plain_html(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags are spaces, common entities read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return squeezed(bare)


def found_date(text: Column) -> Column:
    """The first date of a text: ISO, then month/day/year; two-digit years are of this century; impossible days are null."""
    iso = F.regexp_extract(text, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1)
    parts = [F.regexp_extract(text, r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\b", i) for i in (1, 2, 3)]
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    worded = F.concat_ws("-", year, F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.when(parts[0] != "", worded), "yyyy-MM-dd"))


def age_in_words(days: Column) -> Column:
    """today, yesterday, days up to 13, weeks up to 8, then months."""
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 14, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 60, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
    )
