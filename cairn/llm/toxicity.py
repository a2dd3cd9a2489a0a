"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, one of toxic and one of ordinary texts, predict each character of a word from
those before it. Counts of a class are discounted; what the discount frees is spread by
one shared model, whose continuation counts come from the text of all documents. Under
either class the unseen is thus backed off alike, and a rare spelling that neither class
knows says next to nothing, while one that starts as toxic words do is recognised.

Most words of a toxic text are ordinary ones. The toxic likelihood of a word therefore mixes
both models: a word is of the toxic model with probability ``SHARE``, else of the ordinary one.
A text's two log-likelihoods are summed over its distinct words, and their difference is
normalised by length: divided by the root of the number of words, as the noise in such a
sum grows with that root.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import MULTIPLIER, mixed, powers, prefixes

#: Characters of a word, with the blank before it, that a character is predicted from.
CONTEXT = 6
#: Characters of the word before that predict a word's first two: they tell its language.
BEFORE = 3
#: Probability that a word of a toxic text is of the toxic model.
SHARE = 0.01
#: Characters of text that are looked up together.
SLICE = 1 << 19
#: Distinct events that a task holds before it hands them on.
HELD = 1 << 20


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int")


def events(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(event, word, text) for about SLICE characters of texts at a time.

    An event is a character with its context, packed into a long: how many there are in the
    highest byte, the character itself in the lowest. A character is one byte: its code
    point, or beyond 255 one of 128 that it shares with others. ``word`` has the place of each event's
    word in ``text``, which has the number of each word's text. A word counts once in a text.
    """
    chunks: list[str] = []
    owner: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            chunks.append(piece)
            owner.append(number)
            size += len(piece)
            if size >= SLICE:
                yield _events(chunks, owner)
                chunks, owner, size = [], [], 0
    if chunks:
        yield _events(chunks, owner)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most SLICE characters, cut at blanks if there are any."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at, at + SLICE) + 1 or at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point whether words consist of it: letters, and numbers that are no decimal digits."""
    if not _LETTERS:
        _LETTERS.append(np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(sys.maxunicode + 1))]))
    return _LETTERS[0]


def _events(chunks: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f"\n{c}\n" for c in chunks).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    opens = np.zeros(len(points), bool)
    opens[np.cumsum([0, *(len(c) + 2 for c in chunks[:-1])])] = True
    # One blank opens a text, one stands behind each word.
    keep = letter | opens
    keep[1:] |= letter[:-1]
    data = np.where(letter, np.where(points < 256, points, 128 + points % 128), 32).astype(np.uint8)[keep]
    opens = opens[keep]
    first = np.flatnonzero(opens)
    end = np.flatnonzero(data == 32)
    start = np.append(0, end[:-1] + 1)[~opens[end]]
    end = end[~opens[end]] + 1
    chunk = np.searchsorted(first, start, "right") - 1
    sums = prefixes(data)
    reach = np.maximum(start - 1 - BEFORE, first[chunk])
    name = mixed((sums[end] - sums[reach]) * powers(len(sums), inverse=True)[reach] + (end - reach).astype(np.uint64))
    text = np.array(owner)[chunk]
    once = np.sort(np.unique(mixed(name + text.astype(np.uint64) * MULTIPLIER), return_index=True)[1])
    start, end, reach, text = start[once], end[once], reach[once], text[once]
    count = end - start
    word = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(word)) + np.repeat(start - (np.cumsum(count) - count), count)
    far = np.where(at - start[word] < 2, reach[word], np.maximum(start[word] - 1, at - CONTEXT))
    held = at - far
    event = np.zeros(len(at), np.int64)
    for back in range(CONTEXT, -1, -1):
        event = np.where(held >= back, (event << 8) | data[np.maximum(at - back, 0)], event)
    return event | ((held + 1) << 56), word, text


def context_of(event: Column) -> Column:
    """An event without its character."""
    size = F.shiftright(event, 56)
    return F.shiftleft(size - 1, 56).bitwiseOR(F.shiftright(event, 8).bitwiseAND((1 << 48) - 1))


def shorter(event: Column) -> Column:
    """An event without the first character of its context."""
    size = F.shiftright(event, 56)
    rest = F.call_function("shiftleft", F.lit(1).cast("long"), ((size - 1) * 8).cast("int")) - 1
    return F.shiftleft(size - 1, 56).bitwiseOR(event.bitwiseAND(rest))


def _suffixes(event: Column, least: int) -> Column:
    """The event without the first ``least`` characters of its context, without one more, and so on to none."""
    size = F.shiftright(event, 56).cast("int")

    def cut(keep: Column) -> Column:
        rest = F.call_function("shiftleft", F.lit(1).cast("long"), keep * 8) - 1
        return F.shiftleft(keep.cast("long"), 56).bitwiseOR(event.bitwiseAND(rest))

    return F.transform(F.sequence(size - least, F.lit(1), F.lit(-1)), cut)


def _some_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: the texts of a whole batch are never Python objects at once."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def shared_events(docs: DataFrame) -> DataFrame:
    """(event): the distinct events of all texts."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for some in _some_rows(batches):
            for event, _, _ in events(some.column("text").to_pylist()):
                held.append(np.unique(event))
                size += len(held[-1])
                if size >= HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0])], ["event"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["event"])

    return docs.select("text").mapInArrow(seen, "event long").distinct()


def class_counts(rows: DataFrame) -> DataFrame:
    """(event, n0, n1): in how many words of ordinary and of toxic texts. ``rows``: (text, toxic); copies count once in a class."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            for event, word, text in events(batch["text"].tolist()):
                value, place = np.unique(event, return_inverse=True)
                of = toxic[text[word]] == 1
                both = np.bincount(place, minlength=len(value))
                one = np.bincount(place, weights=of, minlength=len(value)).astype(np.int64)
                yield pd.DataFrame({"event": value, "n0": both - one, "n1": one})

    once = rows.groupBy("toxic", F.xxhash64("text")).agg(F.first("text").alias("text")).select("toxic", "text")
    return once.mapInPandas(counted, "event long, n0 long, n1 long").groupBy("event").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(ones: int | None, twos: int | None) -> float:
    """Of Kneser and Ney, by how many events are counted once and twice."""
    return min(max(ones / (ones + 2 * (twos or 0)), 0.1), 0.95) if ones else 0.5


def backoff(everything: DataFrame, wanted: DataFrame) -> DataFrame:
    """(event, low): the shared model's probability of each wanted event with the first character of its context left out.

    ``everything``: (event), all events of the corpus. Interpolated Kneser-Ney on how many
    distinct characters stand before a string; below the empty context all are alike.
    """
    every = everything.select(F.explode(_suffixes(F.col("event"), 0)).alias("event")).distinct()
    follows = written(every.filter(F.shiftright("event", 56) > 1).groupBy(shorter(F.col("event")).alias("event")).agg(F.count("*").alias("c")), "follows")
    ones = follows.filter("c <= 2").groupBy(F.shiftright("event", 56).alias("size"), "c").count().collect()
    seen = {(r["size"], r["c"]): r["count"] for r in ones}
    discount = F.element_at(F.create_map(*(F.lit(x) for size in range(1, CONTEXT + 1) for x in (size, _discount(seen.get((size, 1)), seen.get((size, 2)))))), F.shiftright("event", 56).cast("int"))
    contexts = follows.groupBy(context_of(F.col("event")).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    told = follows.join(contexts, context_of(follows["event"]) == contexts["context"]).select(
        F.col("event").alias("suffix"),
        (F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total")).alias("own"),
        (discount * F.col("kinds") / F.col("total")).alias("rest"),
    )
    each = wanted.select("event", F.explode(_suffixes(F.col("event"), 1)).alias("suffix")).join(told, "suffix")
    size = F.shiftright("suffix", 56)
    of = range(1, CONTEXT + 1)
    steps = each.groupBy("event").agg(*(F.max(F.when(size == k, F.col(c))).alias(f"{c}{k}") for k in of for c in ("own", "rest")))
    low = F.lit(1 / 256)
    for k in of:
        low = F.coalesce(F.col(f"own{k}") + F.col(f"rest{k}") * low, low)
    return steps.select("event", low.alias("low"))


def ratios(rows: DataFrame, everything: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(events, their log-likelihood ratios, contexts, ratios of any other character there); None without both classes.

    ``rows``: (text, toxic), bounded; ``everything``: (event) of all documents. An event that
    neither class has is backed off to the same shared probability, which cancels: what is
    left is the ratio of the two weights of backing off.
    """
    counts = written(class_counts(rows), "counts")
    sums = counts.agg(*(F.sum((F.col(f"n{c}") == k).cast("long")).alias(f"c{c}{k}") for c in (0, 1) for k in (1, 2)), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not sums["n0"] or not sums["n1"]:
        return None
    d = [_discount(sums[f"c{c}1"], sums[f"c{c}2"]) for c in (0, 1)]
    contexts = counts.groupBy(context_of(F.col("event")).alias("context")).agg(
        *(F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)), *(F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"kinds{c}") for c in (0, 1))
    )
    contexts = written(contexts, "contexts")
    weight = [F.when(F.col(f"total{c}") > 0, d[c] * F.col(f"kinds{c}") / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    joined = counts.withColumn("context", context_of(F.col("event"))).join(contexts, "context").join(backoff(everything, counts), "event")
    p = [F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - d[c], F.lit(0.0)) / F.col(f"total{c}")).otherwise(0.0) + weight[c] * F.col("low") for c in (0, 1)]
    one = joined.select("event", (F.log(p[1]) - F.log(p[0])).alias("ratio")).toArrow()
    two = contexts.select("context", (F.log(weight[1]) - F.log(weight[0])).alias("ratio")).toArrow()
    found = []
    for table in (one, two):
        name, ratio = (table.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(name)
        found += [name[order], ratio[order]]
    return tuple(found)


def strengths(tables: tuple[np.ndarray, ...] | None, texts: list[str | None]) -> np.ndarray:
    """Of each text the length-normalised difference of its two log-likelihoods; 0 for a text without words."""
    total, words = np.zeros(len(texts)), np.zeros(len(texts))
    if tables is None:
        return total
    names, ratios_, contexts, rests = tables
    for event, word, text in events(texts):
        at = np.minimum(np.searchsorted(names, event), len(names) - 1)
        known = names[at] == event
        ratio = np.where(known, ratios_[at], 0.0)
        new = event[~known]
        new = (((new >> 56) - 1) << 56) | ((new >> 8) & ((1 << 48) - 1))
        at = np.minimum(np.searchsorted(contexts, new), len(contexts) - 1)
        ratio[~known] = np.where(contexts[at] == new, rests[at], 0.0)
        each = np.bincount(word, weights=ratio, minlength=len(text))
        total += np.bincount(text, weights=np.log1p(SHARE * np.expm1(np.minimum(each, 50.0))), minlength=len(texts))
        words += np.bincount(text, minlength=len(texts))
    return total / np.sqrt(np.maximum(words, 1))


class Model:
    """Tables of ratios and the calibration: score = sigmoid(bias + weight * strength)."""

    def __init__(self, tables: tuple[np.ndarray, ...] | None, bias: float = 0.0, weight: float = 1.0):
        self.tables, self.bias, self.weight = tables, bias, weight

    def strength(self, text: str | None) -> float:
        return float(strengths(self.tables, [text])[0])

    def plain(self) -> tuple:
        """What goes to the tasks: arrays and numbers, no class of this package."""
        return self.tables, self.bias, self.weight


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """(doc_id, text, toxic, fold): labelled documents outside fold 0, about ``rows_per_class`` of either class at most.

    Rows are chosen by a hash of the doc_id. Labels but 0 and 1 are left out.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", fold(F.col("doc_id")).alias("fold")).filter("fold > 0")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, count in sizes.items():
        share = F.when(F.col("toxic") == label, min(1.0, rows_per_class / count)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    bounded = F.broadcast(known.filter(draw < share))  # two classes of about rows_per_class
    return docs.select("doc_id", "text").join(bounded, "doc_id").dropDuplicates(["doc_id"])


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on z by damped Newton steps, with a slight pull to 0, so that separable classes do no harm."""
    x = np.column_stack((np.ones(len(z)), z))
    beta, pull = np.zeros(2), 1e-3

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + pull * b @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull * np.eye(2), x.T @ (y - p) - pull * beta)
        while np.abs(step).max() > 1e-9 and loss(beta + step) > loss(beta):
            step /= 2
        beta += step
        if np.abs(step).max() <= 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000) -> Model:
    """A model from about ``rows_per_class`` labelled rows of either class at most, so its size is bounded.

    Folds 1 to 3 give the counts of the classes, fold 4 the calibration; what both classes
    back off to is counted over all ``docs``. Without labels of both classes the model knows
    nothing, and every text scores next to 0. If only fold 4 lacks a class, scores start
    from the share of toxic labels.
    """
    rows = written(training_rows(docs, labels, rows_per_class), "labelled")
    tables = ratios(rows.filter("fold < 4"), written(shared_events(docs), "events"))
    if tables is None:
        return Model(None, -50.0)
    known = docs.sparkSession.sparkContext.broadcast(tables)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"z": strengths(known.value, batch["text"].tolist()), "y": batch["toxic"]})

    seen = rows.filter("fold = 4").select("text", "toxic").mapInPandas(judged, "z double, y int").toPandas()
    y = seen["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        share = rows.agg(F.avg("toxic")).first()[0]
        return Model(tables, float(np.log(share / (1 - share))))
    return Model(tables, *_calibrated(seen["z"].to_numpy(float), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    The score depends on the text alone; a null or empty text, or one without words, gets the
    score of no evidence. Repeated rows score alike; a null doc_id is held out by
    the CRC of nothing (false); other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bias, weight = shared.value
        for some in _some_rows(batches):
            z = bias + weight * strengths(tables, some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([some.column("doc_id").cast("int64"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bias, weight = shared.value
        for some in _some_rows(batches):
            yield some.filter(pa.array(bias + weight * strengths(tables, some.column("text").to_pylist()) < 0))

    return docs.mapInArrow(keep, docs.schema)
