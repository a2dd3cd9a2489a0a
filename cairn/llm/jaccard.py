"""Exact Jaccard join of documents on word shingles: T-occurrence search with short and long lists.

Every document is a query against the inverted lists of all others. A partner within the
threshold must occur in at least T of the lists of the query's shingles. As in DivideSkip, T is
met in two parts: the short lists (of the query's rarest shingles) are merged by a heap, and who
occurs in too few of them is left out, whatever the L long lists hold; the long lists are
probed by binary search for the few candidates that remain. In order:

1. Documents with equal sets are one class.
2. Shingles that many classes have are counted; they come last in the order of rarity.
3. A class posts its rarest shingles, ``slack`` more than needed for one meeting, in the short
   lists. A pair within the threshold meets in at least ``1 + slack`` of them. Lists are cut into
   blocks of ``BLOCK`` members, so no task holds a long one.
4. Classes that meet often are compared first, so that large groups become one
   component before pairs are listed.
5. For each class the short lists that it stands in are merged by a heap, members of its own
   component left out. Those that occur often enough are candidates.
6. That a candidate stands in the long list of a shingle is the same as that the shingle stands in the
   candidate's sorted set: there it is looked for by binary search, for groups of
   classes at once, each set sent once to a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graphs import components
from .hashing import mixed, shingle_sets

#: Shingles of all documents in one bucket of the count of frequent ones, and buckets at least (as a power of 2).
BUCKET_SHINGLES, LEAST_BITS = 1_000_000, 8
#: Classes that make a shingle frequent.
FREQUENT = 40
#: Frequent shingles that are broadcast at most (8 bytes each). If more are frequent, those of most classes.
BROADCAST_SHINGLES = 4_000_000
#: Rows of ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000
#: Members of a block of a list; blocks of longer lists are paired with each other.
BLOCK = 1024
#: Classes on either side that are compared together.
SIDE = 256
#: Pairs listed per entry of the lists before another round of stars is tried instead.
PAIRS_PER_ENTRY = 8
STAR_ROUNDS = 4
#: Of a set's shingles one in so many must be shared in the short lists beyond the first meeting.
SLACK = 40
#: Texts that are shingled together, and their bytes; entries that a task holds before it hands them on.
TEXTS, BYTES, HELD = 256, 1 << 19, 200_000


def _set_key(s: np.ndarray) -> np.int64:
    """A hash of the set, whatever its order."""
    return mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0]


def _number(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket (``bits``) and 24 more bits of shingles. Shingles that share them only pass for more frequent than they are."""
    return (hashes >> np.uint64(40 - bits)).astype(np.int64)


def _slack(n: np.ndarray | int):
    """Shingles beyond the first meeting that a set of n must share in the short lists."""
    return n // SLACK


def _shingled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a few rows with the shingle sets of their texts: a batch's sets are never held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            yield some, list(shingle_sets(some.column("text").to_pylist(), k, BYTES))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _list_array(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


class _Sets:
    """Classes and their lists for one shingle length and one threshold num/den."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs.select("doc_id", "text"), k, num, den
        self.spark = docs.sparkSession
        self.bits, self.rows = LEAST_BITS, 0

    def classes(self) -> DataFrame:
        """(doc_id, n, key)"""
        k = self.k

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, sets in _shingled(batches, k):
                n, key = np.array([len(s) for s in sets], np.int32), np.array([_set_key(s) for s in sets], np.int64)
                yield _batch(doc_id=some.column("doc_id").cast("int64"), n=n, key=key)

        return self.docs.mapInArrow(find, "doc_id long, n int, key long")

    def frequent(self) -> DataFrame:
        """(shingle, classes) of the numbers that at least FREQUENT classes have; copies in other partitions count again."""
        k, bits = self.k, self.bits

        def three(numbers: np.ndarray) -> bytes:
            return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

        def whole(parts: list[bytes]) -> np.ndarray:
            data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3)
            return np.column_stack((data, np.zeros(len(data), np.uint8))).view("<u4").ravel().astype(np.int64)

        def chunk(sets: list[np.ndarray]) -> pa.RecordBatch:
            value, count = np.unique(_number(np.concatenate(sets), bits), return_counts=True)
            opens = np.flatnonzero(np.append(True, np.diff(value >> 24) > 0))
            rows = []
            for i, j in zip(opens.tolist(), [*opens[1:].tolist(), len(value)], strict=True):
                v, c = value[i:j], count[i:j]
                again = c > 1
                rows.append((int(v[0] >> 24), three(v[~again]), three(v[again]), c[again].astype("<u4").tobytes()))
            bucket, *data = zip(*rows, strict=True)
            return _batch(bucket=np.array(bucket, np.int32), **dict(zip(("once", "again", "counts"), (pa.array(x, pa.binary()) for x in data), strict=True)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            held: list[np.ndarray] = []
            size = 0
            for _, sets in _shingled(batches, k):
                for s in sets:
                    key = _set_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                if size >= 5 * HELD:
                    yield chunk(held)
                    held, size = [], 0
            if held:
                yield chunk(held)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for bucket, own in groupby(rows, key=lambda row: row[0]):
                _, once, again, counts = zip(*own, strict=True)
                once, again = whole(list(once)), whole(list(again))
                weight = np.concatenate((np.ones(len(once), np.int64), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)))
                value, place = np.unique(np.concatenate((once, again)), return_inverse=True)
                n = np.bincount(place, weights=weight, minlength=len(value)).astype(np.int64)
                yield _batch(shingle=value[n >= FREQUENT] | (bucket << 24), classes=n[n >= FREQUENT])

        dealt = self.docs.mapInArrow(deal, "bucket int, once binary, again binary, counts binary")
        return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tally, "shingle long, classes long")

    def common(self) -> np.ndarray:
        """Sorted numbers of the most frequent shingles, no more than may be broadcast."""
        table = written(self.frequent(), "frequent")
        most = table.groupBy("classes").count().orderBy(F.desc("classes")).limit(100_000).collect()
        least, room = None, BROADCAST_SHINGLES
        for row in most:
            room -= row["count"]
            if room < 0:
                break
            least = row["classes"]
        if least is None:
            return np.zeros(0, np.int64)
        return np.sort(table.filter(F.col("classes") >= least).select("shingle").toArrow().column("shingle").to_numpy())

    def lists(self, shingles: int) -> DataFrame:
        """(list, block, keys, sizes, places): the short lists that two classes or more stand in, cut into blocks, keys ascending.

        A place is the shingle's in its class's order of rarity, from 0. ``shingles``: how many
        all documents have together; it sets the number of buckets in which they are counted.
        """
        self.bits = min(max(LEAST_BITS, (shingles // BUCKET_SHINGLES).bit_length()), 30)
        k, num, den, bits = self.k, self.num, self.den, self.bits
        common = self.spark.sparkContext.broadcast(self.common())

        def rarest(s: np.ndarray) -> np.ndarray:
            n = len(s)
            want = min(n, n - -(-num * n // den) + 1 + _slack(n))
            have, numbers = common.value, _number(s, bits)
            if len(have):
                at = np.minimum(np.searchsorted(have, numbers), len(have) - 1)
                often = have[at] == numbers
                if often[:want].any():
                    s = np.concatenate((s[~often], s[often]))
            return s[:want]

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for _, sets in _shingled(batches, k):
                rare, keys, sizes = [], [], []
                for s in sets:
                    key = _set_key(s)
                    if len(s) and key not in seen:
                        seen.add(key)
                        rare.append(rarest(s))
                        keys.append(key)
                        sizes.append(len(s))
                if rare:
                    counts = [len(s) for s in rare]
                    yield _batch(
                        list=np.concatenate(rare).view(np.int64), key=np.repeat(np.array(keys, np.int64), counts),
                        size=np.repeat(np.array(sizes, np.int32), counts), place=np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
                    )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest, block = None, 0
            for batch in batches:
                rows = [c.to_numpy() for c in batch.columns]
                if rest is not None:
                    rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
                # What belongs to the last list waits for the next batch, but for whole blocks of it.
                last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
                own = len(rows[0]) - last
                stay = last + max(own - 1, 0) // BLOCK * BLOCK
                yield from blocks([x[:stay] for x in rows], block)
                done = (stay - last) // BLOCK
                block = done + (block if last == 0 else 0)
                rest = [x[stay:] for x in rows]
            if rest is not None:
                yield from blocks(rest, block)

        def blocks(rows: list[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
            """``block``: of the first list, those that have gone before."""
            if not len(rows[0]):
                return
            name, key, size, place = rows
            fresh = np.append(True, (name[1:] != name[:-1]) | (key[1:] != key[:-1]))
            name, key, size, place = (x[fresh] for x in rows)
            opens = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            counts = np.diff(np.append(opens, len(name)))
            before = np.arange(len(name)) - np.repeat(opens, counts)
            before[: counts[0]] += block * BLOCK
            cuts = np.flatnonzero(before % BLOCK == 0)
            if not len(cuts) or cuts[0]:
                cuts = np.append(0, cuts)
            long = np.diff(np.append(cuts, len(name)))
            keep = (long > 1) | (before[cuts] >= BLOCK)
            kept = np.repeat(keep, long)
            ends = np.cumsum(np.append(0, long[keep]))
            if keep.any():
                yield _batch(
                    list=name[cuts[keep]], block=(before[cuts[keep]] // BLOCK).astype(np.int32),
                    keys=_list_array(key[kept], ends), sizes=_list_array(size[kept], ends), places=_list_array(place[kept], ends),
                )

        posts = self.docs.mapInArrow(post, "list long, key long, size int, place int")
        posts = posts.repartition("list").sortWithinPartitions("list", "key")
        return posts.mapInArrow(cut, "list long, block int, keys array<long>, sizes array<int>, places array<int>")

    def linked(self, asked: DataFrame, members: DataFrame | None, reps: DataFrame) -> DataFrame:
        """The pairs (a, b) within the threshold. ``asked``: (a, family, length, others); ``reps``: (key, doc_id), a document of each class.

        A family's classes are dealt by a hash to sides of about SIDE, and each pair of sides is a
        group that is compared in one go; the sets are made anew from documents, and each is sent once to
        a group. Pairs are not opened into rows where a family is dense: there all its
        ``members`` (family, key), of which the others are some, go to every group of their side.
        """
        num, den, k = self.num, self.den, self.k
        asked = written(asked, "asked")
        sizes = asked.groupBy("family").agg(F.count("*").alias("askers"), F.max("length").alias("length"), F.sum(F.size("others")).alias("pairs"))
        sides = lambda n: F.ceil(n / SIDE)
        dense = (F.col("pairs") > F.col("length") * sides(F.col("askers"))) if members is not None else F.lit(False)
        sizes = sizes.select("family", sides(F.col("askers")).alias("left"), sides(F.least("length", "pairs")).alias("right"), dense.alias("dense"))
        sizes = _small(sizes, self.rows)
        side = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        pack = lambda a, b: F.xxhash64("family", a, b)
        dealt = asked.join(sizes, "family").withColumn("own", side("a", "left"))
        of = lambda b: F.pmod(F.xxhash64(b), F.col("right"))
        each = F.transform(F.array_distinct(F.transform("others", of)), lambda g: F.struct(g.alias("g"), F.filter("others", lambda b: of(b) == g).alias("others")))
        left = dealt.select("family", "own", F.col("a").alias("key"), F.inline(each)).select(pack("own", "g").alias("pack"), "key", "others")
        sparse = dealt.filter("not dense").select("family", "own", "right", F.explode("others").alias("key"))
        right = sparse.select(pack("own", side("key", "right")).alias("pack"), "key").distinct()
        if members is not None:
            all_ = members.join(sizes.filter("dense"), "family").select("family", "key", "right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)).alias("own"))
            right = right.unionByName(all_.select(pack("own", side("key", "right")).alias("pack"), "key"))
        needs = left.unionByName(right.withColumn("others", F.array().cast("array<long>")))
        needs = needs.groupBy("key").agg(F.collect_list(F.struct("pack", "others")).alias("packs")).join(reps, "key")
        needs = _small(needs.select("doc_id", "key", "packs"), self.rows, F.aggregate("packs", F.lit(0), lambda s, p: s + 1 + F.size(p["others"])))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, sets in _shingled(batches, k):
                rows, size = [], 0
                for key, packs, s in zip(some.column("key").to_pylist(), some.column("packs").to_pylist(), sets, strict=True):
                    if _set_key(s) != key:  # a doc_id may name several texts
                        continue
                    data = s.tobytes()
                    for p in packs:
                        rows.append((p["pack"], key, p["others"], data))
                        size += len(s)
                        if size >= HELD:
                            yield rows_of(rows)
                            rows, size = [], 0
                if rows:
                    yield rows_of(rows)

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            pack, key, others, data = zip(*rows, strict=True)
            return _batch(pack=np.array(pack, np.int64), key=np.array(key, np.int64), others=pa.array(others, pa.list_(pa.int64())), data=pa.array(data, pa.binary()))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
            for _, own in groupby(rows, key=lambda row: row[0]):
                sets, asked = {}, []
                for _, key, others, data in own:
                    sets[key] = np.frombuffer(data, "<u8")
                    if others:
                        asked.append((key, others))
                found = [(a, b) for a, others in asked for b in set(others) if b in sets and near(sets[a], sets[b])]
                if found:
                    a, b = zip(*found, strict=True)
                    yield _batch(a=np.array(a, np.int64), b=np.array(b, np.int64))

        def near(x: np.ndarray, y: np.ndarray) -> bool:
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            if len(y) * num > len(x) * den:
                return False
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int(np.count_nonzero(y[at] == x))
            return den * shared >= num * (len(x) + len(y) - shared)

        sent = self.docs.join(needs, "doc_id").mapInArrow(send, "pack long, key long, others array<long>, data binary")
        sent = sent.repartition("pack").sortWithinPartitions("pack")
        return written(sent.mapInArrow(probe, "a long, b long").distinct(), "links")


def _small(table: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """``table``, of at most ``rows`` rows, to be broadcast if its rows, or the ids that they hold, are no more than BROADCAST_IDS."""
    table = written(table, "small", rows)
    held = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if held <= BROADCAST_IDS else table


def _stars(labelled: DataFrame) -> DataFrame:
    """(a, family, length, others): each class with the class it meets most, among the least class of another component in each block."""
    other = F.expr("filter(members, m -> m.label <> members[0].label)")
    pairs = labelled.select(F.col("members")[0]["key"].alias("b"), F.explode(other).alias("m")).select(F.col("m.key").alias("a"), "b")
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return best.select("a", F.col("b").alias("family"), F.lit(1).cast("long").alias("length"), F.array("b").alias("others"))


def _members(lists: DataFrame) -> DataFrame:
    """(list, block, members array<struct<key,size,place,label>>) while every class is its own component."""
    zipped = F.arrays_zip("keys", "sizes", "places")
    each = F.transform(zipped, lambda z: F.struct(z["keys"].alias("key"), z["sizes"].alias("size"), z["places"].alias("place"), z["keys"].alias("label")))
    return lists.select("list", "block", each.alias("members"))


def _labelled(lists: DataFrame, labels: DataFrame, rows: int, entries: int) -> DataFrame:
    """(list, block, members array<struct<key,size,place,label>>) of the lists that hold several components."""

    def flat(some: DataFrame) -> DataFrame:
        each = some.select("list", "block", F.explode(F.arrays_zip("keys", "sizes", "places")).alias("z"))
        each = each.select("list", "block", F.col("z.keys").alias("key"), F.col("z.sizes").alias("size"), F.col("z.places").alias("place"))
        return each.join(labels, each["key"] == labels["node"], "left").select("list", "block", "key", "size", "place", F.coalesce("label", "key").alias("label"))

    labels = _small(labels, rows)
    mixed_ = flat(lists).groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("list")
    grouped = flat(lists.join(_small(mixed_, entries), "list")).groupBy("list", "block")
    return grouped.agg(F.array_sort(F.collect_list(F.struct("key", "size", "place", "label"))).alias("members"))


def _candidates(labelled: DataFrame, num: int, den: int) -> DataFrame:
    """(a, family, length, others): classes of other components that occur often enough in a's short lists and may be of a size.

    Those that first occur in one list, by its length, are one row; that list is the family of their pairs.

    A pair of sizes x and y within num/den shares at least ``least = num (x + y) / (num + den)``
    shingles, so of its first ``x - least + 1 + slack`` and ``y - least + 1 + slack`` it
    shares at least ``1 + slack``, with the slack of the smaller set. Entries further back in either order are left out.
    """
    most = labelled.agg(F.max("block")).first()[0] or 0
    if most:
        lengths = labelled.groupBy("list").agg(F.sum(F.size("members")).alias("length"))
        blocks = labelled.join(lengths, "list")
    else:
        blocks = labelled.withColumn("length", F.size("members").cast("long"))
    blocks = blocks.select("list", "block", "length", *(F.col(f"members.{c}").alias(f"{c}s") for c in ("key", "size", "place", "label")))
    same = blocks.select("*", *(F.lit(None).cast(blocks.schema[f"{c}s"].dataType).alias(f"{c}s_") for c in ("key", "size", "place", "label")))
    if most:
        # Blocks of one list meet each other, not in one task.
        after = blocks.select("list", F.col("block").alias("block_"), *(F.col(f"{c}s").alias(f"{c}s_") for c in ("key", "size", "place", "label")))
        same = same.unionByName(blocks.join(after, "list").filter("block < block_").drop("block_"))
    parts = most + 1

    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(a, part, size, list, length, others): the members of a short list behind a, in order."""
        for batch in batches:
            rows, held = [], 0
            for name, length, keys, sizes, places, labels, *later in zip(*(batch[c] for c in ("list", "length", "keys", "sizes", "places", "labels", "keys_", "sizes_", "places_", "labels_")), strict=True):
                sizes = np.asarray(sizes, np.int64)
                within = later[0] is None
                keys_, sizes_, places_, labels_ = (keys, sizes, places, labels) if within else later
                sizes_ = np.asarray(sizes_, np.int64)
                for i in range(len(keys)):
                    at = i + 1 if within else 0
                    x, y = sizes[i], sizes_[at:]
                    small, large = np.minimum(x, y), np.maximum(x, y)
                    reach = _slack(small) - -(-num * (x + y) // (num + den))
                    early = (places[i] <= x + reach) & (places_[at:] <= y + reach)
                    j = np.flatnonzero(early & (labels_[at:] != labels[i]) & (small * den >= large * num)) + at
                    if not len(j):
                        continue
                    others = keys_[j]
                    if parts == 1:
                        rows.append((keys[i], 0, x, name, length, others))
                    else:
                        of = others % parts
                        rows += [(keys[i], p, x, name, length, others[of == p]) for p in np.unique(of)]
                    held += len(j)
                    if held >= HELD:
                        yield pd.DataFrame(rows, columns=OCCURS)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=OCCURS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found, held = [], 0
        for (a, _), own in groupby(rows, key=lambda row: row[:2]):
            own = sorted(own, key=lambda row: (row[4], row[3]))
            least = 1 + _slack(-(-own[0][2] * num // den))
            if len(own) < least:
                continue
            hits = {b for b, same in groupby(heapq.merge(*(row[5] for row in own))) if sum(1 for _ in same) >= least}
            for _, _, _, name, length, others in own:
                met = [b for b in others if b in hits]
                if met:
                    found.append((a, name, length, met))
                    hits.difference_update(met)
                    held += len(met)
                if not hits:
                    break
            if held >= HELD:
                yield rows_of(found)
                found, held = [], 0
        if found:
            yield rows_of(found)

    def rows_of(found: list[tuple[int, int, int, list[int]]]) -> pa.RecordBatch:
        a, name, length, others = zip(*found, strict=True)
        return _batch(a=np.array(a, np.int64), family=np.array(name, np.int64), length=np.array(length, np.int64), others=pa.array(others, pa.list_(pa.int64())))

    met = same.mapInPandas(occur, "a long, part int, size int, list long, length long, others array<long>")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part")
    return met.mapInArrow(merge, "a long, family long, length long, others array<long>")


#: Columns of a class's short lists.
OCCURS = ["a", "part", "size", "list", "length", "others"]


def _pairs(labelled: DataFrame) -> int:
    """Pairs of different components in the lists: those of all members but those within one."""
    sizes = labelled.select("list", F.explode("members.label").alias("label")).groupBy("list", "label").count()
    per_list = sizes.groupBy("list").agg(((F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))) / 2).alias("p"))
    return per_list.agg(F.sum("p")).first()[0] or 0


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs`` (doc_id, text).

    Documents link when their sets of k-word shingles have a Jaccard similarity of at
    least num/den; ``component_id`` is the least doc_id that links reach. A text without
    words (empty or null) links with nothing and is its own component. A null doc_id is
    never a component_id unless nothing else is reached, and a class of which no
    document has a doc_id links with nothing else. Repeated rows are documents of
    one class; other columns are ignored; an empty table gives no rows. Sets are
    compared by 64-bit hashes of shingles.
    """
    work = _Sets(docs, k, num, den)
    classes = written(work.classes(), "classes")
    held = classes.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).first()
    work.rows = held["rows"]
    lists = written(work.lists(held["shingles"] or 0), "lists")
    entries = lists.agg(F.sum(F.size("keys"))).first()[0] or 0
    reps = written(classes.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "reps", work.rows)
    edges = labels = None
    for turn in range(STAR_ROUNDS + 1):
        labelled = written(_labelled(lists, labels, work.rows, entries), "labelled") if turn else _members(lists)
        last = turn == STAR_ROUNDS or (turn > 0 and _pairs(labelled) <= PAIRS_PER_ENTRY * entries)
        members = labelled.select(F.col("list").alias("family"), F.explode("members.key").alias("key"))
        found = work.linked(_candidates(labelled, num, den), members, reps) if last else work.linked(_stars(labelled), None, reps)
        edges = edges.unionByName(found) if turn else found
        if last:
            break
        labels = components(edges)
    labels = components(edges)
    named = classes.join(labels, classes["key"] == labels["node"], "left").select("doc_id", "n", F.coalesce("label", "key").alias("label"))
    full = named.filter("n > 0")
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = full.join(least, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = classes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty)
