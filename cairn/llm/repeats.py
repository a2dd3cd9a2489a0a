"""Removal of repeated byte strings, by a depth-limited radix sort of suffixes.

Only suffixes' first ``threshold`` bytes matter: two suffixes that agree so far begin
the same repeated window. Most-significant digits come first:

1. The first digit of a suffix is drawn from the content of its window: the least hash
   of the ``GRAM``-byte strings inside. Equal windows have equal digits, and neighbouring
   suffixes mostly share theirs, so a run of suffixes travels as one row.
2. Runs of the same digit and the same bytes are counted first; runs alone with their
   digit are done.
3. Runs of one digit and different bytes are ordered by further digits of
   ``DIGIT`` bytes each, until a group holds one suffix or the depth is reached.

Groups that are left hold the windows that start at two or more places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import mixed, powers, prefixes, window_hashes

GRAM = 100
#: Suffixes of one run at most; longer runs are cut.
RUN = 4096
#: Runs of one digit with different bytes, beyond which windows are counted by a shuffle.
HOT = 256

def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def runs_of(data: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(digit, digest, start, size, inner) of the runs of suffixes of one text.

    ``inner``: the string that gave the digit occurs twice in the run, so that the run
    may repeat a window by itself.
    """
    if len(data) < threshold:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    sums = prefixes(data)
    gram = min(GRAM, threshold)
    grams = window_hashes(sums, gram)
    span = threshold - gram
    digit = _sliding_least(grams, span + 1)
    n = len(digit)
    start = np.concatenate(([0], np.flatnonzero(digit[1:] != digit[:-1]) + 1))
    size = np.diff(np.append(start, n))
    if (size > RUN).any():
        start = np.concatenate([np.arange(a, a + k, RUN) for a, k in zip(start, size, strict=True)])
        size = np.diff(np.append(start, n))
    bytes_of = (sums[start + size + threshold - 1] - sums[start]) * powers(len(sums), inverse=True)[start]
    digit = digit[start]
    inner = [np.count_nonzero(grams[a : a + k + span] == d) > 1 for a, k, d in zip(start.tolist(), size.tolist(), digit, strict=True)]
    return digit, mixed(bytes_of ^ mixed(size.astype(np.uint64))), start, size, np.array(inner)


def _runs(docs: DataFrame, threshold: int) -> DataFrame:
    columns = ("row", "digit", "digest", "start", "size", "inner")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some, found = batch.iloc[at : at + 512], []
                for row, text in zip(some["row"], some["text"], strict=True):
                    digit, digest, start, size, inner = runs_of(np.frombuffer((text or "").encode(), np.uint8), threshold)
                    found.append((np.full(len(digit), row), digit.view(np.int64), digest.view(np.int64), start, size, inner))
                yield pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(columns)})

    return docs.select("row", "text").mapInPandas(cut, "row long, digit long, digest long, start int, size int, inner boolean")


def repeated(segments: list[bytes], sizes: np.ndarray, firsts: np.ndarray, threshold: int, digit: int) -> np.ndarray:
    """Which suffixes begin a window that another suffix begins too.

    Segment i has suffixes at 0..sizes[i]-1, whose first digit is ``firsts[i]``. The
    radix sort proper: suffixes are grouped by one digit after the other, and those
    alone in their group leave. The answer has a flag per suffix, segment by segment.
    """
    lengths = np.array([len(x) for x in segments])
    sums = prefixes(np.frombuffer(b"".join(segments), np.uint8))
    base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    number = np.arange(int(sizes.sum()))
    place = np.repeat(base - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + number
    group = np.repeat(firsts, sizes)
    for at in range(0, threshold, digit):
        keys = window_hashes(sums, min(digit, threshold - at), place[number] + at)
        key = mixed(mixed(group) + keys)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        stay = counts[inverse] > 1
        number, group = number[stay], key[stay]
        if not len(number):
            break
    flags = np.zeros(len(place), bool)
    flags[number] = True
    return flags


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the stretches of True."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first = np.flatnonzero(edges == 1)
    return first, np.flatnonzero(edges == -1) - first


SPANS = "row long, start int, size int"


def repeated_starts(docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    """Rows (row, start, size): suffixes start..start+size-1 of a text begin windows that begin elsewhere too.

    ``docs``: (row, doc_id, text), ``row`` unique.
    """
    runs = written(_runs(docs, threshold), "runs")
    twice = runs.groupBy("digit").agg(F.count("*").alias("c"), F.max("inner").alias("i")).filter("c > 1 or i").select("digit")
    runs = runs.join(twice, "digit")
    same = runs.groupBy("digit", "digest").agg(
        F.count("*").alias("n"), F.max("inner").alias("inner"), F.min(F.struct("row", "start", "size")).alias("one")
    )
    digits = same.groupBy("digit").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner")).filter("kinds > 1 or inner")
    # Runs that occur twice, bytes and all.
    whole = runs.join(same.filter("n > 1").select("digit", "digest"), ["digit", "digest"]).select("row", "start", "size")
    # One run of each kind, where a digit has several kinds or a run may repeat itself.
    ones = same.join(digits.select("digit", "kinds"), "digit").select("digit", "kinds", "n", "one.*")

    def texts(some: DataFrame) -> DataFrame:
        lists = some.groupBy("row").agg(F.collect_list(F.struct("digit", "n", "start", "size")).alias("runs"))
        return docs.join(lists, "row")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, text, found in zip(batch["row"], batch["text"], batch["runs"], strict=True):
                data = text.encode()
                rows += [(r["digit"], row, r["start"], r["size"], r["n"], data[r["start"] : r["start"] + r["size"] + threshold - 1]) for r in found]
            yield pd.DataFrame(rows, columns=["digit", "row", "start", "size", "n", "bytes"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, found in zip(batch["row"], batch["text"], batch["runs"], strict=True):
                sums = prefixes(np.frombuffer(text.encode(), np.uint8))
                for r in found:
                    at = np.arange(r["start"], r["start"] + r["size"])
                    yield pd.DataFrame({"row": row, "start": at, "n": r["n"], "digit": r["digit"], "window": window_hashes(sums, threshold, at).view(np.int64)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of digit; those of a batch's last digit wait for the next batch."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rows):
                last = (rows["digit"] == rows["digit"].iloc[-1]).to_numpy()
                rest = rows[last]
                yield spans(rows[~last])
        if rest is not None:
            yield spans(rest)

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        found = [[], [], []]
        if len(rows):
            sizes = rows["size"].to_numpy(np.int64)
            flags = repeated(rows["bytes"].tolist(), sizes, rows["digit"].to_numpy().view(np.uint64), threshold, digit)
            ends = np.cumsum(sizes)
            for row, start, n, a, b in zip(rows["row"], rows["start"], rows["n"], ends - sizes, ends, strict=True):
                if n == 1 and flags[a:b].any():
                    first, count = _stretches(flags[a:b])
                    for x, y in zip((np.full(len(first), row), start + first, count), found, strict=True):
                        y.append(x)
        return pd.DataFrame({c: np.concatenate(f) if f else [] for c, f in zip(("row", "start", "size"), found, strict=True)})

    cold = texts(ones.filter(F.col("kinds") <= HOT)).mapInPandas(segments, "digit long, row long, start int, size int, n long, bytes binary")
    cold = cold.repartition("digit").sortWithinPartitions("digit").mapInPandas(compare, SPANS)
    # Digits with very many kinds of runs: windows are counted, with partial sums before the shuffle.
    hot = texts(ones.filter(F.col("kinds") > HOT)).mapInPandas(windows, "row long, start int, n long, digit long, window long")
    again = hot.groupBy("digit", "window").agg(F.count("*").alias("c")).filter("c > 1").select("digit", "window")
    hot = hot.filter("n = 1").join(again, ["digit", "window"]).select("row", "start", F.lit(1).alias("size"))
    return whole.unionByName(cold).unionByName(hot)


def remove(docs: DataFrame, threshold: int = 400, digit: int = 100, text: str = "text") -> DataFrame:
    """Rows (doc_id, kept, n_bytes, n_removed, n_spans) for each row of ``docs``.

    A text is its UTF-8 bytes; a null one is empty. Every byte covered by a string of
    ``threshold`` bytes that also starts anywhere else in the table, the same text
    included, is removed; overlaps count, and strings are judged on the input.
    ``kept`` has the remaining bytes (binary, since a cut may fall inside a character).
    Rows that repeat are documents each, so they remove each other. Other columns are
    left out; an empty table gives no rows. ``docs`` is read twice and must give its
    rows in the same order, as a table does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(f"`{text}`").alias("text"))
    found = repeated_starts(rows, threshold, digit)
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, whole, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data = (whole or "").encode()
                if spans is None:
                    out.append((doc, data, len(data), 0, 0))
                    continue
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, [s["start"] for s in spans], 1)
                np.add.at(edges, [s["start"] + s["size"] + threshold - 1 for s in spans], -1)
                gone = np.cumsum(edges[:-1]) > 0
                first, _ = _stretches(gone)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, kept, len(data), int(gone.sum()), len(first)))
            yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]).astype({"doc_id": "Int64"})

    joined = rows.join(found, "row", "left")
    return joined.mapInPandas(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
