"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Each word probes all its edits (deletions, replacements) against Bloom filters of the
vocabulary, one for each length of words, whose blocks are single 64-bit numbers. A filter
answers from the polynomial hash of an edit, which follows from that of the word in constant
time, so that no edit is written out before it is a hit. Only hits are shuffled, to a
join with the vocabulary that compares the words themselves and so drops false ones.
Insertions are the deletions of the longer word, read the other way.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of filter for each word of the vocabulary; at 20 about one probe in 300 is a false hit.
BITS = 20
#: 64-bit blocks of filter (32 MB) that are sent to the tasks at once. A larger vocabulary is probed in
#: several passes, one for each part of its filters, so that neither this size nor the share of false hits grows.
PART_BLOCKS = 1 << 22
#: Edits that are probed at once in a task.
PROBES = 1 << 18
#: Edits that one task probes, about.
TASK_PROBES = 40_000_000
#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def damaged_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """Rows (word): runs of letters of whole texts, lower-cased in A-Z; of some a code point is deleted.

    With h = crc32 of ``doc_id:run`` (a null doc_id is empty), the code point h % length goes
    if ``every`` divides h. Results of fewer than ``least`` code points are left out. A null
    text has no words; other columns are ignored, repeated rows count each.
    """
    # A shorter run gives no word of that length, and a longer one is matched as a whole.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    read = read.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    read = read.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    cut = F.overlay("run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))
    words = read.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least)


def vocabulary(words: DataFrame, occurrences: int = 2) -> DataFrame:
    """Rows (word, n): distinct words that occur at least ``occurrences`` times. Null words have no row."""
    return words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its block and the four bits that it sets there."""
    z = _mixed(h)
    one, low = np.uint64(1), np.uint64(63)
    mask = one << (z & low)
    for k in (6, 12, 18):
        mask |= one << ((z >> np.uint64(k)) & low)
    return (z >> np.uint64(24)) % np.uint64(blocks), mask


def _by_length(words: pd.Series, most: int) -> Iterator[tuple[list[str], int]]:
    """Words of one length, at most ``most`` code points at once."""
    for length, own in words.groupby(words.str.len()):
        step = max(1, most // max(1, length))
        for k in range(0, len(own), step):
            yield list(own.iloc[k : k + step]), length


def hashed(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``length`` and ``hash`` of each word."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(length=batch["word"].str.len(), hash=np.int64(0))
            for length, own in batch.groupby("length"):
                codes, powers = _codes(list(own["word"])), _powers(length)
                batch.loc[own.index, "hash"] = (codes * powers).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield batch

    return vocab.mapInPandas(add, "word string, n long, length int, hash long")


def _filters(vocab: DataFrame, blocks: dict[int, int], starts: dict[int, int]) -> DataFrame:
    """Rows (block, mask) of the filters of all lengths, laid end to end."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, own in batch.groupby("length"):
                block, mask = _places(own["hash"].to_numpy().view(np.uint64), blocks[length])
                yield pd.DataFrame({"block": block.astype(np.int64) + starts[length], "mask": mask.view(np.int64)})

    set_bits = vocab.select("length", "hash").mapInPandas(bits, "block long, mask long")
    return set_bits.groupBy("block").agg(F.bit_or("mask").alias("mask"))


class Probe:
    """Edits of words, looked up in one part of the filters."""

    def __init__(self, part: np.ndarray, first: int, blocks: dict[int, int], starts: dict[int, int], alphabet: np.ndarray):
        self.part, self.first, self.blocks, self.starts, self.alphabet = part, first, blocks, starts, alphabet

    def concerns(self, length: int) -> bool:
        """Whether words of that length have bits in this part."""
        start = self.starts.get(length)
        return start is not None and start < self.first + len(self.part) and start + self.blocks[length] > self.first

    def found(self, h: np.ndarray, length: int) -> np.ndarray:
        block, mask = _places(h, self.blocks[length])
        at = block.astype(np.int64) + (self.starts[length] - self.first)
        inside = (at >= 0) & (at < len(self.part))
        return inside & ((self.part[np.where(inside, at, 0)] & mask) == mask)

    def edits(self, words: list[str], length: int) -> Iterator[pd.DataFrame]:
        """Rows (source, hash, pos, put) of edits that the filters may hold: ``put`` replaces the code point at ``pos``."""
        codes, powers = _codes(words), _powers(length)
        terms = codes * powers
        ends = np.add.accumulate(terms, axis=1, dtype=np.uint64)
        whole = ends[:, -1]

        def rows(word: np.ndarray, pos: np.ndarray, h: np.ndarray, put: str) -> pd.DataFrame:
            return pd.DataFrame({"source": whole[word].view(np.int64), "hash": h.view(np.int64), "pos": pos, "put": put})

        if self.concerns(length - 1):
            h = ends - terms + (whole[:, None] - ends) * np.uint64(INVERSE)
            new = np.ones(codes.shape, bool)
            new[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours either deletion gives the same word
            word, pos = np.nonzero(new)
            hit = self.found(h[new], length - 1)
            yield rows(word[hit], pos[hit], h[new][hit], "")
        if self.concerns(length):
            base = whole[:, None] - terms
            for put in self.alphabet:  # the pair is found by its word of the lesser code point
                word, pos = np.nonzero(codes < put)
                h = base[word, pos] + put * powers[pos]
                hit = self.found(h, length)
                yield rows(word[hit], pos[hit], h[hit], chr(int(put)))


def near_words(vocab: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Rows (word, n, other, other_n), both ways, of words that differ by one code point inserted, deleted or replaced.

    ``vocab`` holds (word, n, length, hash) as ``hashed`` gives them, and is read several times.
    """
    spark = vocab.sparkSession
    counts = {r["length"]: r["count"] for r in vocab.groupBy("length").count().collect()}  # a row for each length of words
    if not counts:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    blocks = {k: -(-n * BITS // 64) for k, n in sorted(counts.items())}
    starts = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").distinct()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters.collect()), np.uint64)  # code points, not words
    filters = written(_filters(vocab, blocks, starts), "filters")
    probes = sum(k * n for k, n in counts.items()) * (1 + len(alphabet))
    dealt = vocab.select("word").repartition(max(spark.sparkContext.defaultParallelism, probes // TASK_PROBES), "word")
    hits = None
    for first in range(0, sum(blocks.values()), part_blocks):
        size = min(part_blocks, sum(blocks.values()) - first)
        own = filters.filter(F.col("block").between(first, first + size - 1)).toPandas()  # at most ``part_blocks`` rows
        part = np.zeros(size, np.uint64)
        part[own["block"].to_numpy() - first] = own["mask"].to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(part)

        def probe(batches: Iterator[pd.DataFrame], sent=sent, first=first) -> Iterator[pd.DataFrame]:
            look = Probe(sent.value, first, blocks, starts, alphabet)
            for batch in batches:
                for words, length in _by_length(batch["word"], PROBES):
                    if look.concerns(length) or look.concerns(length - 1):
                        yield pd.concat(look.edits(words, length))

        found = written(dealt.mapInPandas(probe, "source long, hash long, pos int, put string"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    source = vocab.select("word", "n", F.col("hash").alias("source"))
    target = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "hash")
    # The edit is made again and compared as text, so neither the filters' false hits nor equal hashes of two words count.
    made = F.overlay("word", "put", F.col("pos") + 1, F.lit(1))
    pairs = hits.join(target, "hash").join(source, "source").filter(made == F.col("other"))
    pairs = written(pairs.select("word", "n", "other", "other_n").distinct(), "near")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(links: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): where forms lead in the end. Each round doubles the steps that are taken."""
    reached = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return reached
        reached = step.select("word", "root")


def variants(vocab: DataFrame, ratio: int = 10, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Of each word (word, n) its form and root: rows word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (of equal ones the least in order of code points),
    if that is at least ``ratio`` times the word's n, else null; ``root`` is where forms
    lead in the end, the word itself if it has none. A form's n is larger by a factor, so
    chains are short and have no circles. Words are distinct and not null; an empty
    vocabulary gives no rows.
    """
    vocab = written(hashed(vocab.select("word", "n")), "vocabulary")
    near = near_words(vocab, part_blocks).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"),
    )
    judged = vocab.join(near, "word", "left")
    held = -F.col("best.less") >= ratio * F.col("n")
    judged = judged.select(
        "word",
        F.when(held, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(held, -F.col("best.less")).alias("form_n"),
    )
    judged = written(judged, "forms")
    roots = _roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
