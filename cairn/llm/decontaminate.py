"""Benchmark decontamination by winnowing.

A window of m words is fingerprinted by the least hash among its k-grams
(k = min(5, m)). Two equal windows have equal least hashes, so every window that a
document shares with the benchmark meets it in the join of fingerprints; the hits are
then extended to whole windows and compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_keyed

GRAM = 5
#: Rows of benchmark fingerprints that may be broadcast (about 50 MB); more are shuffled.
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _slots(n: Column) -> Column:
    """1..n, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, k: int) -> Column:
    """Hash of each k words. They are taken one by one: slice() would copy the whole text for each."""
    return F.transform(_slots(F.size(words) - (k - 1)), lambda i: F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(k))))


def _least(grams: Column, width: int) -> Column:
    """Of each window of ``width`` grams the least hash."""
    if width == 1:
        return grams
    return F.transform(_slots(F.size(grams) - (width - 1)), lambda i: F.least(*(F.get(grams, i + (j - 1)) for j in range(width))))


def _runs(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (doc_id, m, first, last, print): windows first..last of m words of a document share a fingerprint.

    ``docs``: doc_id, words. All lengths are taken in one pass; what is exploded holds no words.
    """
    ks = sorted({min(GRAM, m) for m in lengths})
    step = docs.select("doc_id", *(_grams(F.col("words"), k).alias(f"grams{k}") for k in ks))
    step = step.select("doc_id", *(_least(F.col(f"grams{min(GRAM, m)}"), m - min(GRAM, m) + 1).alias(f"least{m}") for m in lengths))

    def heads(least: str) -> Column:
        return F.filter(_slots(F.size(least)), lambda i: (i == 1) | (F.get(least, i - 1) != F.get(least, i - 2)))

    step = step.select("doc_id", *(f"least{m}" for m in lengths), *(heads(f"least{m}").alias(f"heads{m}") for m in lengths))

    def runs(m: int) -> Column:
        own, least = f"heads{m}", f"least{m}"
        return F.transform(
            own,
            lambda h, j: F.struct(
                F.lit(m).alias("m"),
                h.alias("first"),
                (F.coalesce(F.get(own, j + 1), F.size(least) + 1) - 1).alias("last"),
                F.get(least, h - 1).alias("print"),
            ),
        )

    # An outer explode: for a plain one Spark filters on the array, which evaluates it twice.
    return step.select("doc_id", F.explode_outer(F.concat(*map(runs, lengths))).alias("run")).select("doc_id", "run.*")


def _windows(words: Column, runs: Column) -> Column:
    """Array of (start, length, window) of all windows of runs (m, first, last). Words are taken one by one, as above."""

    def text(i: Column, m: Column) -> Column:
        return F.array_join(F.transform(F.sequence(i, i + m - 1), lambda j: F.get(words, j - 1)), " ")

    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.sequence(r["first"], r["last"]),
                lambda i: F.struct(i.alias("start"), r["m"].alias("length"), text(i, r["m"]).alias("window")),
            ),
        )
    )


def hits(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """Rows (doc_id, start, length, item_id): word ``start`` (from 1) begins an occurrence of a window of the item.

    An item of fewer words than ``window`` is one window of that length; an item
    without words has none. ``doc_id`` is distinct and not null.
    """
    read = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    items = bench.select("item_id", words_of(F.col("text")).alias("words"))
    items = items.withColumn("m", F.least(F.size("words"), F.lit(window))).filter("m > 0")
    lengths = sorted(r["m"] for r in items.select("m").distinct().collect())  # at most ``window`` values
    if not lengths:
        return read.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, length int, item_id long")
    whole = F.struct("m", F.lit(1).alias("first"), (F.size("words") - F.col("m") + 1).alias("last"))
    shared = items.select("item_id", F.explode(_windows(F.col("words"), F.array(whole))).alias("t")).select("item_id", "t.window").distinct()
    keyed = items.select(F.struct("item_id", "m").alias("doc_id"), "words")
    prints = _runs(keyed, lengths).filter("m = doc_id.m").select("m", "print").distinct()
    if shared.count() <= BROADCAST_ROWS:  # there are no more fingerprints than windows
        shared, prints = F.broadcast(shared), F.broadcast(prints)
    near = _runs(read, lengths).join(prints, ["m", "print"])
    near = near.groupBy(F.col("doc_id").alias("near_id")).agg(F.collect_list(F.struct("m", "first", "last")).alias("runs"))
    # Texts are shuffled rather than their words, which take several times as much.
    held = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("near_id")).select("doc_id", words_of(F.col("text")).alias("words"), "runs")
    met = held.select("doc_id", F.explode(_windows(F.col("words"), F.col("runs"))).alias("t"))
    return met.select("doc_id", "t.*").join(shared, "window").select("doc_id", "start", "length", "item_id")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, length)."""

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        fresh = F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, items (array of item_id, sorted as text), contaminated.

    A null or empty text has no words and no hits. Each row is a document of its own, also one that
    repeats a doc_id or has none. An empty benchmark hits nothing; other columns are ignored.
    """
    keyed, key = row_keyed(docs.select("doc_id", "text"))
    per_doc = hits(keyed.select(F.col(key).alias("doc_id"), "text"), bench, window).groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"),
    )
    sized = keyed.select(F.col(key).alias("row_id"), "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = sized.join(per_doc, F.col("row_id") == F.col("hit_id"), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce("items", none)).alias("items"),
        F.coalesce(F.size("spans") > 0, F.lit(False)).alias("contaminated"),
    )


def digest(reported: DataFrame) -> DataFrame:
    return reported.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
