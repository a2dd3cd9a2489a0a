"""Agency pages of five families and a highway text service, read into reports.

A page is a stream of headings and lines; those inside a table know its number, row and cell.
What a page carries forward (a heading, the area, the day) is a window over its stream.
A page is read by one task, and its reports are rows (key, section, place, lines, day) for ``roads.official_reports``.
Pages and their streams are dealt by key over tasks of a bounded number of pages; what follows groups by the key, and nothing is dealt again.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rows import tasks

#: Pages of one task at most, and rows of a stream that are given on at a time.
TASK_PAGES, BATCH_ROWS = 20_000, 20_000
#: Tags whose text is not read, tags that end a line, the level of an accordion's title.
UNREAD = {"script", "style", "noscript", "svg", "nav", "template", "select", "form"}
LINE_ENDS = {
    "p", "div", "br", "li", "ul", "ol", "dl", "dt", "dd", "section", "article", "aside",
    "blockquote", "figure", "figcaption", "caption", "hr", "pre", "address", "main",
    "header", "footer", "summary", "details", "thead", "tbody", "tfoot",
}
ACCORDION = 7
#: Titles of a status column, and what a service prints when it has nothing to report.
STATUS_TITLES = ("status", "current status")
NOTHING = r"(?i)^no (recent|current) reports?\.?$"
NO_CONDITION = r"(?i)^(?:no traffic restrictions are reported|for .{0,40}road information,? call)"
HIGHWAY = r"(?i)^(?:SR|US|I)[ -]?([0-9]+)$"
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
_WORDS = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
#: A date in figures, in words, or as ISO has it: groups 1-3 are month, day, year; 4-6 month's word, day, year; 7-9 year, month, day.
DATE = rf"(?:([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}})|({_WORDS})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})|([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}))"
STREAM = "key long, ord int, kind string, level int, text string, linked boolean, tbl int, row int, cell int"


class _Stream(HTMLParser):
    """Rows (kind, level, text, linked, tbl, row, cell). Opening a cell, row or table closes what was left open in the same table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.buffer, self.plain = [], [], False
        self.hidden = self.links = self.tables = 0
        self.levels: list[int] = []
        self.open: list[dict] = []  # tables that are open: number, last row and cell, whether they are open

    def add(self, kind: str, level: int = 0, text: str = "", linked: bool = False) -> None:
        at = self.open[-1] if self.open else None
        inside = at is not None and (kind != "table") and at["row"] >= 0 and at["cell"] >= 0
        place = (at["number"], at["row"] if inside else None, at["cell"] if inside else None) if at else (None, None, None)
        self.found.append((kind, level, text, linked, *place))

    def end_line(self, level: int = 0) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.add("heading" if level else "line", level, text, not level and not self.plain)
        self.buffer, self.plain = [], False

    def end_cell(self) -> None:
        if self.open and self.open[-1]["in_cell"]:
            self.end_line()
            self.open[-1]["in_cell"] = False

    def new_row(self) -> None:
        self.open[-1] |= {"row": self.open[-1]["row"] + 1, "cell": -1, "in_row": True}

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in UNREAD
        if self.hidden:
            return
        if tag == "a":
            self.links += 1
        elif tag == "button" or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.end_line()
            titled = ACCORDION if "accordion" in (dict(attrs).get("class") or "") else 0
            self.levels.append(titled if tag == "button" else int(tag[1]))
        elif tag == "table":
            self.end_line()
            self.open.append({"number": self.tables, "row": -1, "cell": -1, "in_row": False, "in_cell": False})
            self.tables += 1
            self.add("table")
        elif tag == "tr" and self.open:
            self.end_cell()
            self.new_row()
        elif tag in ("td", "th") and self.open:
            self.end_cell()
            if not self.open[-1]["in_row"]:
                self.new_row()
            self.open[-1] |= {"cell": self.open[-1]["cell"] + 1, "in_cell": True}
            self.add("cell")
        elif tag in LINE_ENDS:
            self.end_line()

    def handle_endtag(self, tag):
        if tag in UNREAD:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "button" or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.end_line(self.levels.pop() if self.levels else 0)
        elif tag in ("td", "th", "tr", "table") and self.open:
            self.end_cell()
            if tag in ("tr", "table"):
                self.open[-1]["in_row"] = False
            if tag == "table":
                self.open.pop()
        elif tag in LINE_ENDS:
            self.end_line()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)
            self.plain |= not self.links and bool(data.strip())


def stream(pages: DataFrame) -> DataFrame:
    """Rows of ``STREAM`` for ``pages`` (key, html): headings (1 to 6, an accordion's title 7), lines, and marks of tables and cells.

    ``linked``: a line that is a link's caption and nothing else. Text belongs to the innermost open table's last cell. A null page has no rows.
    """

    columns = [c.split()[0] for c in STREAM.split(", ")]

    def table(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"tbl": "Int32", "row": "Int32", "cell": "Int32"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for key, html in zip(batch["key"], batch["html"], strict=True):
                reader = _Stream()
                reader.feed(html or "")
                reader.close()
                reader.end_line()
                rows += [(key, i, *item) for i, item in enumerate(reader.found)]
                if len(rows) >= BATCH_ROWS:
                    yield table(rows)
                    rows = []
        yield table(rows)

    n = tasks(pages, TASK_PAGES)
    return pages.select("key", "html").repartition(n, "key").mapInPandas(read, STREAM).repartition(n, "key")


def _day(text: Column, pattern: str) -> Column:
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 10)]
    month = F.element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(part[3]))
    year = F.when(F.length(part[2]) == 2, F.concat(F.lit("20"), part[2])).otherwise(part[2])
    numbers = F.when(part[0] != "", F.concat_ws("-", year, part[0], part[1])).when(part[3] != "", F.concat_ws("-", part[5], month.cast("string"), part[4])).when(part[6] != "", F.concat_ws("-", *part[6:]))
    return F.try_to_date(numbers, "yyyy-M-d")


def whole_date(text: Column) -> Column:
    """The date that a text is, with nothing else but an ISO time; else null."""
    return _day(F.trim(text), rf"(?i)^{DATE}(?:(?<=[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})[ T][0-9:.]+)?$")


def first_date(text: Column) -> Column:
    """The first date written inside a line; null if that is no day."""
    return _day(text, rf"(?i)(?<![\w/]){DATE}(?![0-9/])")


def leading(text: Column, page_day: Column | None = None) -> tuple[Column, Column]:
    """day and words of a line that opens with a date and goes on; both null else.

    With the page's day a date without a year is the latest one up to it.
    """
    line = F.trim(text)
    full = r"(?s)^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\s*[-–—:]?\s*(.*)$"
    m, d, y, rest = (F.regexp_extract(line, full, i) for i in (1, 2, 3, 4))
    day = F.try_to_date(F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), m, d), "yyyy-M-d")
    if page_day is not None:
        short = r"(?s)^([0-9]{1,2})/([0-9]{1,2})\s*[-–—:]\s*(.*)$"
        sm, sd, words = (F.regexp_extract(line, short, i) for i in (1, 2, 3))

        def of(back: int) -> Column:
            found = F.try_to_date(F.concat_ws("-", (F.year(page_day) - back).cast("string"), sm, sd), "yyyy-M-d")
            return F.when(found <= page_day, found)

        dated = m != ""
        day, rest = F.when(dated, day).otherwise(F.when(sm != "", F.coalesce(of(0), of(1)))), F.when(dated, rest).otherwise(words)
    rest = F.trim(rest)
    ok = day.isNotNull() & (rest != "")
    return F.when(ok, day), F.when(ok, rest)


def _before() -> WindowSpec:
    return Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def _page() -> WindowSpec:
    return Window.partitionBy("key")


HEADING, LINE = "heading", "line"


def _first(when: Column, value: Column) -> Column:
    """Over a page: the value of its first item for which ``when`` holds."""
    return F.min(F.when(when, F.struct("ord", value.alias("value")))).over(_page())["value"]


def updated_on(items: DataFrame) -> Column:
    """The day a page is of: a heading that says updated and holds a date, else the first line that begins with last updated."""
    heading = (F.col("kind") == HEADING) & F.lower("text").contains("updated") & first_date(F.col("text")).isNotNull()
    foot = (F.col("kind") == LINE) & F.lower("text").startswith("last updated")
    return F.coalesce(_first(heading, first_date(F.col("text"))), _first(foot, first_date(F.col("text"))))


def headed(items: DataFrame, name_most: int = 80) -> DataFrame:
    """Dated lines under a heading of level 4 to 6, or under a short line that names a place; prose between breaks the tie."""
    day, words = leading(F.col("text"))
    read = items.filter(F.col("kind").isin("heading", "line")).withColumn("day", F.when(F.col("kind") == LINE, day)).withColumn("words", words)
    named = (F.length("text") <= name_most) & ~F.col("text").rlike("[.:,]$")
    head = F.col("kind") == HEADING
    place = F.when(head, F.when(F.col("level").between(4, 6), F.col("text"))).otherwise(F.when(named, F.col("text")))
    event = head | F.col("day").isNull()
    read = read.withColumn("place", F.last(F.when(event, F.struct(place.alias("v"))), True).over(_before())["v"])
    read = read.withColumn("section", F.coalesce(F.last(F.when(head & (F.col("level") == ACCORDION), F.col("text")), True).over(_before()), F.lit("")))
    return read.filter("day is not null and place is not null").select("key", "section", "place", F.array("words").alias("lines"), "day", "ord")


def table_rows(items: DataFrame) -> DataFrame:
    """key, tbl, row, heading, header, cells, linked, page_day, updated: rows of tables.

    ``cells`` and ``header`` (the table's first row) are arrays of cells, a cell an array of lines; ``heading`` is the last one above the
    table, ``linked`` its lines that are captions of links; ``page_day`` the first line that is a date, else when the page was updated.
    """
    line = F.col("kind") == LINE
    read = items.withColumn("heading", F.coalesce(F.last(F.when(F.col("kind") == HEADING, F.col("text")), True).over(_before()), F.lit("")))
    read = read.withColumn("updated", updated_on(items)).withColumn("page_day", F.coalesce(_first(line & whole_date(F.col("text")).isNotNull(), whole_date(F.col("text"))), F.col("updated")))
    # A table's mark has no row and no cell; it is carried as a group of its own, so that nothing is joined.
    mark = F.first(F.when(F.col("kind") == "table", F.struct("heading", "page_day", "updated")), True).alias("mark")
    text = F.when(F.col("kind").isin("heading", "line"), F.struct("ord", "text"))
    cells = read.filter("cell is not null or kind = 'table'").groupBy("key", "tbl", "row", "cell").agg(
        F.array_sort(F.collect_list(text))["text"].alias("lines"), F.collect_set(F.when(F.col("linked"), F.col("text"))).alias("linked"), mark
    )
    own = F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "lines"))))["lines"]
    rows = cells.groupBy("key", "tbl", "row").agg(own.alias("cells"), F.flatten(F.collect_list("linked")).alias("linked"), F.first("mark", True).alias("mark"))
    # Rows without cells are no items, so the first row with cells may not be row 0; such a table has no header.
    table = Window.partitionBy("key", "tbl")
    header = F.first(F.when(F.col("row") == 0, F.col("cells")), True).over(table)
    linked, mark = F.flatten(F.collect_list("linked").over(table)), F.first("mark", True).over(table)
    whole = rows.select("key", "tbl", "row", "cells", header.alias("header"), linked.alias("linked"), mark.alias("mark")).filter("row is not null and mark is not null")
    return whole.select("key", "tbl", "row", "mark.heading", "cells", "header", "linked", "mark.page_day", "mark.updated")


def _joined(cell: Column) -> Column:
    return F.array_join(cell, " ")


def _words(cell: Column) -> Column:
    """A cell's lines without captions of links."""
    return F.filter(cell, lambda x: ~F.array_contains("linked", x))


def _titles(fragment: str | None = None, exact: str | None = None) -> Column:
    """Place, from 1, of the first header cell that holds the fragment, or is the title; 0 if there is none."""
    found = F.transform("header", lambda c: F.lower(_joined(c)).contains(fragment) if fragment else F.lower(_joined(c)) == exact)
    return F.coalesce(F.array_position(found, True), F.lit(0)).cast("int")


def _cell(at: str) -> Column:
    return F.get("cells", F.col(at) - 1)


def _whole() -> Column:
    """Rows below the header with as many cells."""
    return (F.col("row") > 0) & (F.size("cells") == F.size("header"))


def table_lines(rows: DataFrame, name: str = "trail name", text: str = "reported conditions") -> DataFrame:
    """Dated lines stacked in a table's cell, the year taken from the page's day where they have none."""
    read = rows.withColumn("n", _titles(exact=name)).withColumn("t", _titles(exact=text)).filter("n > 0 and t > 0").filter(_whole())
    each = read.select("key", "tbl", "row", "page_day", F.col("heading").alias("section"), _joined(_cell("n")).alias("place"), F.posexplode(_words(_cell("t"))).alias("pos", "line"))
    day, words = leading(F.col("line"), F.col("page_day"))
    ord = F.struct("tbl", "row", "pos").alias("ord")
    return each.filter("page_day is not null").select("key", "section", "place", F.array(words).alias("lines"), day.alias("day"), ord).filter("day is not null")


def dated_rows(rows: DataFrame, name: str = "trail name", text: str = "conditions", date: str = "update", extras: tuple[str, ...] = ()) -> DataFrame:
    """Rows of tables with a column of dates; columns are found by a part of their title, ``extras`` are quoted before the text."""
    read = rows.withColumn("n", _titles(name)).withColumn("t", _titles(text)).withColumn("d", _titles(date)).filter("n > 0 and t > 0 and d > 0").filter(_whole())
    quoted = []
    for k, extra in enumerate(extras):
        read = read.withColumn(f"x{k}", _titles(extra))
        own = _cell(f"x{k}")
        quoted.append(F.when((F.col(f"x{k}") > 0) & (F.size(own) > 0), F.concat(_joined(F.get("header", F.col(f"x{k}") - 1)), F.lit(": "), _joined(own))))
    read = read.withColumn("told", _words(_cell("t"))).filter(~F.exists("told", lambda x: x.rlike(NOTHING)))
    place = _joined(_cell("n"))
    return read.select(
        "key", F.col("heading").alias("section"), F.when(F.lower(place) == "summary", F.col("heading")).otherwise(place).alias("place"),
        F.concat(F.array_compact(F.array(*quoted).cast("array<string>")), F.col("told")).alias("lines"), whole_date(_joined(_cell("d"))).alias("day"), F.struct("tbl", "row").alias("ord"),
    )


def bulletin(items: DataFrame, opens_with: str = "General Conditions", standing: tuple[str, ...] = ()) -> DataFrame:
    """Lines under headings of level 3 after a dated opening, up to a heading of a higher level; ``standing`` sections report nothing."""
    read = items.filter(F.col("kind").isin("heading", "line", "table", "cell"))
    head = F.col("kind") == HEADING
    read = read.withColumn("opening", F.min(F.when(head & (F.col("text") == opens_with), F.col("ord"))).over(_page()))
    issued = F.when(F.col("kind") == LINE, whole_date(F.col("text")))
    read = read.withColumn("issued", _first(F.col("ord") == F.col("opening") + 1, issued)).filter("issued is not null and ord > opening + 1")
    area = F.when((F.col("level") == 3) & ~F.col("text").isin(*standing), F.col("text"))
    read = read.withColumn("area", F.last(F.when(head, F.struct(area.alias("v"))), True).over(_before())["v"])
    read = read.withColumn("over", F.coalesce(F.max(head & (F.col("level") < 3)).over(_before()), F.lit(False)))
    kept = read.filter((F.col("kind") == LINE) & F.col("area").isNotNull() & ~F.col("over"))
    return kept.select("key", F.lit(opens_with).alias("section"), F.col("area").alias("place"), F.array("text").alias("lines"), F.col("issued").alias("day"), "ord")


def road_tables(rows: DataFrame, heading: str = "Road Status") -> DataFrame:
    """Rows of the table under a heading, of the day the page was updated: the last cell is the status, what lies between are notes."""
    first, last = F.get("cells", F.lit(0)), F.get("cells", F.size("cells") - 1)
    read = rows.filter((F.lower("heading") == heading.lower()) & F.col("updated").isNotNull() & (F.size("cells") >= 2))
    read = read.filter((F.size(first) > 0) & (F.size(last) > 0) & ~F.lower(_joined(last)).isin(*STATUS_TITLES))
    read = read.withColumn("status", _words(last)).filter("size(status) > 0")
    two = F.size("cells") == 2
    between = F.flatten(F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 2, F.lit(0))), _words))
    notes = F.when(two, _words(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))))).otherwise(between)
    lines = F.concat(F.slice("status", 1, 1), notes, F.slice("status", 2, F.greatest(F.size("status") - 1, F.lit(0))))
    place = F.when(two, F.get(first, F.lit(0))).otherwise(_joined(first))
    return read.select("key", F.col("heading").alias("section"), place.alias("place"), lines.alias("lines"), F.col("updated").alias("day"), F.struct("tbl", "row").alias("ord"))


def highway_lines(items: DataFrame, stamp: str = "latest reported as of") -> DataFrame:
    """Lines under a highway's heading and, inside it, an ``[area]`` label; a heading ends both. Lines that report nothing go."""
    read = items.filter(F.col("kind").isin("heading", "line"))
    line, head = F.col("kind") == LINE, F.col("kind") == HEADING
    read = read.withColumn("issued", first_date(_first(line & F.lower("text").contains(stamp), F.col("text"))))
    number = F.nullif(F.regexp_extract("text", HIGHWAY, 1), F.lit(""))
    road = F.struct(F.when(number.isNotNull(), F.col("text")).alias("place"), number.alias("number"))
    read = read.withColumn("road", F.last(F.when(head, road), True).over(_before()))
    label = F.nullif(F.regexp_extract("text", r"^\[(.+)\]$", 1), F.lit(""))
    area = F.when(head, F.lit("")).when(F.col("road.place").isNotNull() & label.isNotNull(), label)
    read = read.withColumn("section", F.coalesce(F.last(area, True).over(_before()), F.lit("")))
    told = line & F.col("road.place").isNotNull() & label.isNull() & ~F.col("text").rlike(NO_CONDITION)
    return read.filter(told).select("key", "section", "road.place", F.array("text").alias("lines"), F.col("issued").alias("day"), "ord", "road.number")
