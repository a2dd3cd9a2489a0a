"""Queries of agencies' pages: pages are made of the stored parts, a page a part, and read back into reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import official as O
from ..sources import roads
from .inputs import Tables
from .registry import query

_DAY = "1 + p_partkey % 28"
_DATE = f"DATE '2024-01-01' + CAST(p_partkey % 28 AS INTEGER)"


def _pages(t: Tables, html: str) -> DataFrame:
    return t.part.selectExpr("p_partkey AS key", f"{html} AS html")


def _reports(found: DataFrame) -> DataFrame:
    dated = roads.official_reports(found.withColumn("fetched_at", F.lit("2024-01-27 20:00:00").cast("timestamp")))
    return dated.select("key", "section", "place", "text", "day")


def _sql(*rows: str) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT p_partkey AS key, {row}" for row in rows) + ") r WHERE day <= DATE '2024-01-27'"


@query(
    _sql(
        f"p_brand AS section, p_name AS place, 'size ' || p_size || '.' AS text, {_DATE} AS day FROM part",
        "p_brand, p_name, 'late', DATE '2024-01-03' FROM part WHERE p_partkey % 3 > 0",
        "p_brand, 'Bold ' || p_size, 'ice', DATE '2024-01-04' FROM part",
    )
)
def headed_reports(t: Tables) -> DataFrame:
    """S18, C12."""
    html = f"""concat('<button class="a accordion">', p_brand, '</button><h4>', p_name, '</h4><p>1/', {_DAY}, '/2024 - size ', p_size, '.</p>', if(p_partkey % 3 = 0, '<p>Prose between.</p>', ''),
      '<p>01/03/24: late<p><b>Bold ', p_size, '</b><br>1/4/2024 ice<h2>Away</h2><p>1/5/2024 lost')"""
    return _reports(O.headed(O.stream(_pages(t, html))))


@query(
    _sql(
        f"p_brand AS section, p_name || ' trail' AS place, 'size ' || p_size AS text, {_DATE} AS day FROM part",
        "p_brand, p_name || ' trail', 'logs', DATE '2023-06-09' FROM part",
    )
)
def cell_line_reports(t: Tables) -> DataFrame:
    """The years are the page's."""
    html = f"""concat('<p>January 31st, 2024</p><h3>', p_brand, '</h3><table><tr><th>Trail Name<th>Reported Conditions<tr><td>', p_name, '<p>trail<td>1/', {_DAY}, '-size ', p_size,
      '<br>6/9: logs<br><a href="#">1/2-map</a><br>undated<tr><td>only one</table>')"""
    return _reports(O.table_lines(O.table_rows(O.stream(_pages(t, html)))))


@query(
    _sql(
        f"p_brand AS section, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS place, CASE WHEN p_partkey % 3 > 0 THEN 'Snow Cover: size ' || p_size || chr(10) ELSE '' END || 'Wet' || chr(10) || 'Muddy' AS text, {_DATE} AS day FROM part WHERE p_partkey % 5 > 0"
    )
)
def dated_row_reports(t: Tables) -> DataFrame:
    """S20."""
    html = f"""concat('<h2>', p_brand, '</h2><table><tr><th>Trail name</th><th>Snow Cover</th><th>Trail Conditions</th><th>Last update</th></tr><tr><td>', if(p_partkey % 4 = 0, 'Summary', p_name), '</td><td>',
      if(p_partkey % 3 > 0, concat('size ', p_size), ''), '</td><td>', if(p_partkey % 5 = 0, 'No recent reports', 'Wet<p>Muddy<br><a>Map</a>'), '</td><td>Jan. ', {_DAY}, ', 2024</td></tr></table>')"""
    return _reports(O.dated_rows(O.table_rows(O.stream(_pages(t, html))), extras=("snow cover",)))


@query(
    _sql(
        f"'General Conditions' AS section, p_brand AS place, 'size ' || p_size AS text, {_DATE} AS day FROM part WHERE p_partkey % 7 > 0",
        f"'General Conditions', p_name, u, {_DATE} FROM part, unnest(['Snow.', 'Ice.']) x(u) WHERE p_partkey % 7 > 0",
    )
)
def bulletin_reports(t: Tables) -> DataFrame:
    """S21."""
    html = f"""concat('<h2>General Conditions</h2>', if(p_partkey % 7 = 0, '<p>No day</p>', ''), '<p>2024-01-', lpad({_DAY}, 2, '0'), '</p><h3>', p_brand, '</h3><p>size ', p_size,
      '</p><h4>Deeper</h4><p>lost</p><h3>Current Closures</h3><p>none</p><h3>', p_name, '</h3><p>Snow.</p><p>Ice.</p><h2>End</h2><h3>', p_brand, '</h3><p>after</p>')"""
    return _reports(O.bulletin(O.stream(_pages(t, html)), standing=("Current Closures",)))


@query(
    _sql(
        f"'Road Status' AS section, p_name AS place, 'Open' || chr(10) || 'to the gate' || chr(10) || 'size ' || p_size AS text, {_DATE} AS day FROM part",
        f"'Road Status', p_brand, 'Closed' || chr(10) || 'winter', {_DATE} FROM part WHERE p_partkey % 2 = 0",
    )
)
def road_table_reports(t: Tables) -> DataFrame:
    """S22."""
    html = f"""concat('<h3>Road Status</h3><table><tr><th>Road<th>Current Status<tr><td>', p_name, '<br>to the gate<br><a>map</a><td>Open<br>size ', p_size, if(p_partkey % 2 = 0, concat('<tr><td>', p_brand, '<td>winter<td>Closed'), ''),
      '</table><h3>Other</h3><table><tr><td>a<td>b</table><p>Last updated: January ', {_DAY}, ', 2024</p>')"""
    return _reports(O.road_tables(O.table_rows(O.stream(_pages(t, html)))))


@query(
    _sql(
        f"'' AS section, 'SR ' || p_size AS place, 'Open.' AS text, {_DATE} AS day FROM part WHERE p_partkey % 2 = 0",
        f"p_brand, 'SR ' || p_size, 'Chains near ' || p_name, {_DATE} FROM part",
        f"'', 'US-395', 'Wind.', {_DATE} FROM part",
    )
)
def highway_reports(t: Tables) -> DataFrame:
    """S23."""
    html = f"""concat('<p>Latest reported as of 1/', {_DAY}, '/2024 at 5 am</p><h3>SR ', p_size, '</h3>', if(p_partkey % 2 = 0, '<p>Open.</p>', '<p>No traffic restrictions are reported for this area.</p>'), '<p>[', p_brand, ']</p><p>Chains near ', p_name,
      '</p><p>For road information, call someone</p><h3>US-395</h3><p>Wind.</p><h3>Other</h3><p>lost</p>')"""
    return _reports(O.highway_lines(O.stream(_pages(t, html))))
