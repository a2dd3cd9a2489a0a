"""Names of places found in free text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal

#: Names that are sent to every task (some tens of bytes each); more are shuffled.
BROADCAST_NAMES = 500_000


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """key, name: the longest name whose words stand in the text in that order, whole; ties to the lesser name.

    The text's runs of words, as long as names are, are matched to names by equality;
    names and texts are never paired otherwise. If names are few, only runs that begin with the first word of one are made.
    """
    known = names.select(normal(F.col("name")).alias("alias"), "name").filter("alias <> ''").groupBy("alias").agg(F.min("name").alias("name"))
    sized = known.groupBy(F.size(F.split("alias", " ")).alias("n")).count().collect()  # a row per length of a name
    lengths = sorted(r["n"] for r in sized)
    if not lengths:
        return texts.select("key", F.lit(None).cast("string").alias("name")).limit(0)
    starts = _starts(texts, max(lengths))
    if sum(r["count"] for r in sized) <= BROADCAST_NAMES:
        first = known.select(F.substring_index("alias", " ", 1).alias("w1")).distinct()
        starts, known = starts.join(F.broadcast(first), "w1", "left_semi"), F.broadcast(known)
    # The last runs of a text may be shorter: they are runs of fewer words that stand in it too.
    runs = F.array(*(F.concat_ws(" ", *(f"w{i}" for i in range(1, n + 1))) for n in lengths))
    found = starts.select("key", F.explode(runs).alias("alias")).join(known, "alias")  # a run that comes twice changes no maximum
    return found.groupBy("key").agg(F.max_by("name", F.struct(F.length("alias"), F.reverse("alias"))).alias("name"))


def _starts(texts: DataFrame, n: int) -> DataFrame:
    """key, w1 to wn: each word of a text and those after it, null past the end.

    Columns rather than a lambda over words, which Spark does not compile; and an outer explode, as for an inner one
    it asks of the text first whether there is a word, and normalises it again for that.
    """
    words = texts.select("key", F.split(normal(F.col("text")), " ").alias("w"))
    names = [f"w{i}" for i in range(1, n + 1)]
    ahead = words.select("key", *(F.slice("w", F.lit(i), F.size("w")).alias(f"w{i}") for i in range(1, n + 1)))
    return ahead.select("key", F.explode_outer(F.arrays_zip(*names)).alias("at")).select("key", *(F.col(f"at.{c}") for c in names))


def alike(asked: DataFrame, known: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """text, name, ratio: pairs of distinct texts and names whose ratio of matching blocks reaches ``cutoff``.

    Two texts with a ratio r share a block of two characters or more (for r above 2/3), and the
    shorter has at least r / (2 - r) of the longer's length: only such pairs, found by a join
    on pairs of characters, are compared. The comparison itself is the standard library's, in batches.
    """

    def grams(c: str):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2)))
        return F.explode(F.array_distinct(pairs)).alias("gram")

    met = asked.select("text", grams("text")).join(known.select("name", grams("name")), "gram")
    short, long = F.least(F.length("text"), F.length("name")), F.greatest(F.length("text"), F.length("name"))
    met = met.filter(short * (2 - cutoff) >= long * cutoff).select("text", "name").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratio = []
            match = difflib.SequenceMatcher()
            for text, name in zip(batch["text"], batch["name"], strict=True):
                match.set_seqs(name, text)
                near = match.real_quick_ratio() >= cutoff and match.quick_ratio() >= cutoff
                ratio.append(match.ratio() if near else 0.0)
            batch["ratio"] = ratio
            yield batch[batch["ratio"] >= cutoff]

    return met.mapInPandas(compare, "text string, name string, ratio double")


def closest(queries: DataFrame, names: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """key, name, ratio: the name most like the query (see ``alike``), if the ratio reaches ``cutoff``; ties to the greater name."""
    asked = queries.filter("text <> ''").select("text").distinct()
    known = names.select("name").filter("name <> ''").distinct()
    best = alike(asked, known, cutoff).groupBy("text").agg(F.max(F.struct("ratio", "name")).alias("b"))
    return queries.select("key", "text").join(best, "text").select("key", "b.name", F.round("b.ratio", 6).alias("ratio"))


def resolve(queries: DataFrame, names: DataFrame, cutoff: float = 0.78) -> DataFrame:
    """Key, slug of texts by three stages: the whole text is a name, it holds one (the longest), or it is much like one.

    ``names``: slug, name, ord; of equal names the one of the least ``ord`` counts. Each stage sees what the one before left.
    """
    own = names.select(normal(F.col("name")).alias("name"), "slug", "ord").filter("name <> ''").groupBy("name").agg(F.min_by("slug", "ord").alias("slug"))
    asked = queries.select("key", normal(F.col("text")).alias("text")).filter("text <> ''")
    exact = asked.join(own, asked["text"] == own["name"]).select("key", "slug")
    left = asked.join(exact, "key", "left_anti")
    held = mentions(left, own.select("name")).join(own, "name").select("key", "slug")
    left = left.join(held, "key", "left_anti")
    like = closest(left, own.select("name"), cutoff).join(own, "name").select("key", "slug")
    return exact.unionByName(held).unionByName(like)


def search(names: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Names that hold what was typed, those that begin with it first, then by name."""
    held = names.filter(F.contains(F.lower("name"), F.lit(typed.lower())))
    return held.orderBy(F.desc(F.startswith(F.lower("name"), F.lit(typed.lower()))), "name", "key").limit(limit)
