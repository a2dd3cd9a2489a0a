"""Queries of names, spans, dates, hosts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import names
from ..sources import html
from .inputs import Tables
from .registry import query


def _names(t: Tables) -> DataFrame:
    """Names for free text: the first two words of each benchmark item."""
    return t.benchmark.select(F.col("item_id").alias("key"), F.substring_index("text", " ", 2).alias("name"))


_NAMES = "(SELECT item_id AS key, array_to_string(string_split(text, ' ')[1:2], ' ') AS name FROM benchmark)"
_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    f"""WITH n AS (SELECT alias, min(name) AS name FROM (SELECT {_NORMAL.format('name')} AS alias, name FROM {_NAMES} b) x WHERE alias <> '' GROUP BY alias)
SELECT key, arg_max(name, (length(alias), reverse(alias))) AS name FROM (SELECT doc_id AS key, ' ' || {_NORMAL.format('text')} || ' ' AS t FROM documents) d JOIN n ON contains(t, ' ' || alias || ' ') GROUP BY key"""
)
def alias_exact_substring(t: Tables) -> DataFrame:
    """The longest known name that stands in a text, whole words."""
    return names.mentions(t.documents.select(F.col("doc_id").alias("key"), "text"), _names(t))


@query()
def alias_fuzzy(t: Tables) -> DataFrame:
    """The name most like a query of the same length. No SQL: the ratio is of matching blocks."""
    asked = t.part.select(F.col("p_partkey").alias("key"), F.concat(F.substring("p_name", 1, 4), F.substring("p_name", 6, 40)).alias("text"))
    return names.closest(asked, t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))


@query("SELECT key, name FROM (SELECT p_partkey AS key, p_name AS name FROM part) p WHERE contains(lower(name), 'ro') ORDER BY starts_with(lower(name), 'ro') DESC, name, key LIMIT 8")
def name_search_topk(t: Tables) -> DataFrame:
    """What is typed, in names; a report of eight."""
    return names.search(t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), "ro")


@query("SELECT name, min(key) AS key, count(*) AS n FROM (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS name, p_partkey AS key FROM part) p GROUP BY name")
def alias_first_wins(t: Tables) -> DataFrame:
    """The earliest owner of each slug."""
    return t.part.groupBy(text.slug(F.col("p_name")).alias("name")).agg(F.min("p_partkey").alias("key"), F.count("*").alias("n"))


_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN substr(text, 3, 25) ELSE reverse(substr(text, 3, 25)) END AS span FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(lower({_SQUEEZED.format('text')}), lower({_SQUEEZED.format('span')})) AND length({_SQUEEZED.format('span')}) BETWEEN 1 AND 400 THEN {_SQUEEZED.format('span')} END AS quoted FROM c"""
)
def verbatim_span(t: Tables) -> DataFrame:
    """F16: a quoted span only if the text holds it."""
    piece = F.substring("text", 3, 25)
    span = F.when(F.col("turn") % 2 == 0, piece).otherwise(F.reverse(piece))
    return t.conversations.select("conv_id", "turn", text.verbatim(span, F.col("text")).alias("quoted"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"


@query(
    f"""SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.')[-1] IN ('test','example','invalid','localhost') OR {_HOST} IN ('example.com','example.net','example.org')
  OR regexp_matches({_HOST}, '\\.example\\.(com|net|org)$') AS reserved FROM pages"""
)
def reserved_host(t: Tables) -> DataFrame:
    """P06, P25."""
    return t.pages.select("page_id", text.host(F.col("url")).alias("host"), text.reserved(F.col("url")).alias("reserved"))


_BARE = """regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"""


@query(f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace({_BARE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_text(t: Tables) -> DataFrame:
    """The words of a page."""
    return t.pages.select("page_id", text.plain_html(F.col("html")).alias("text"))


@query()
def html_items(t: Tables) -> DataFrame:
    """Headings, lines and cells in order. No SQL: unclosed tags need a parser."""
    return html.items(t.pages.select(F.col("page_id").alias("key"), "html"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) END AS found FROM events"""
)
def date_extract(t: Tables) -> DataFrame:
    """the date in a sentence, in either form, or none."""
    us = F.concat_ws("/", F.month("ts"), F.dayofmonth("ts"), F.year("ts") % 100)
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("seen "), F.to_date("ts"), F.lit(" at noon"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("on "), us)).otherwise("13/45/2024")
    return t.events.select("event_id", text.found_date(said).alias("found"))


_AGE = "(DATE '2001-08-01' - CAST(o_orderdate AS DATE))"


@query(
    f"""SELECT o_orderkey, CASE WHEN {_AGE} <= 0 THEN 'today' WHEN {_AGE} = 1 THEN 'yesterday' WHEN {_AGE} < 14 THEN {_AGE} || ' days ago' WHEN {_AGE} < 60 THEN {_AGE} // 7 || ' weeks ago' ELSE {_AGE} // 30 || ' months ago' END AS age FROM orders"""
)
def age_words(t: Tables) -> DataFrame:
    """F22."""
    days = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", text.age_in_words(days).alias("age"))
