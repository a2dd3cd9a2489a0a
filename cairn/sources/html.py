"""Pages as a stream of headings, lines and table cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are given on at a time; more only if one page has more.
BATCH_ROWS = 20_000
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "li", "br", "tr", "td", "th", "table", "ul", "ol", "section", "article", "nav", "header", "footer", "body", "main", "aside"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Reader(HTMLParser):
    """Collects (kind, level, text); a tag that breaks a line ends what was open, closed or not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, str]] = []
        self.kind, self.level, self.words, self.hidden = "line", 0, [], 0

    def _end(self, kind: str = "line", level: int = 0) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.found.append((self.kind, self.level, text))
        self.kind, self.level, self.words = kind, level, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in HEADINGS:
            self._end("heading", HEADINGS[tag])
        elif tag in BREAKS:
            self._end("cell" if tag in ("td", "th") else "line")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in HEADINGS or tag in BREAKS:
            self._end()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def items(pages: DataFrame) -> DataFrame:
    """key, ord, kind, level, text of ``pages`` (key, html): a row per heading, line and cell, in order. A null page has none."""

    columns = ["key", "ord", "kind", "level", "text"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for key, html in zip(batch["key"], batch["html"], strict=True):
                reader = _Reader()
                reader.feed(html or "")
                reader.close()
                reader._end()
                rows += [(key, i, *item) for i, item in enumerate(reader.found)]
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)

    return pages.mapInPandas(read, "key long, ord int, kind string, level int, text string")
