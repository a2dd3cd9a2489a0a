"""Best-fit packing of documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, library_ids_of

#: Pieces that one task packs at most, on average. More pieces make more groups, not larger ones.
GROUP_ROWS = 50_000
#: How long local search goes on: underfull bins that it tries to empty one after the other without success before
#: it stops, and items of a bin, the longest, for which it looks for an exchange. More of either costs time in
#: proportion and may save a sequence of a group; packed pieces are complete whatever they are.
PATIENCE, EXCHANGED = 12, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
EMPTY = pd.DataFrame({"doc_id": pd.array([], "Int64"), "piece": [], "start": [], "length": [], "ids_crc32": []}).astype({"piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})


def pieces(docs: DataFrame, capacity: int, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): documents as ids, id 0 at the end, cut to ``capacity``.

    A document that fits is one piece. A longer one has a first piece of what is left
    over and then full pieces. A null text is empty and has only its last id. The name of
    an added token in a text is that token, as in the ``tokenizers`` library.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(library_ids_of(enc, text), np.uint32(0)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


class Bins:
    """Bins of one group: lengths are known, bins are lists of item numbers."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.size, self.capacity = [int(x) for x in lengths], capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = {}
        self.rooms = 0  # bit r: some bin has room r

    def _index(self, b: int) -> None:
        self.by_room.setdefault(self.room[b], set()).add(b)
        self.rooms |= 1 << self.room[b]

    def _forget(self, b: int) -> None:
        left = self.by_room[self.room[b]]
        left.discard(b)
        if not left:
            self.rooms &= ~(1 << self.room[b])

    def best(self, need: int) -> int | None:
        """The bin with the least room that takes ``need``."""
        fit = self.rooms >> need
        return min(self.by_room[need + (fit & -fit).bit_length() - 1]) if fit else None

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        self._forget(b)
        for i in out:
            self.items[b].remove(i)
        self.items[b] += into
        self.room[b] += sum(self.size[i] for i in out) - sum(self.size[i] for i in into)
        self._index(b)

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it, or into a new one."""
        for i in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            b = self.best(self.size[i])
            if b is None:
                b = len(self.items)
                self.items.append([])
                self.room.append(self.capacity)
                self._index(b)
            self.change(b, [], [i])

    def _exchange(self, i: int, victim: int) -> bool:
        """Brings item i of ``victim`` into a fuller bin for one or two smaller items, so that squared fill grows.

        The exchange that fills the other bin most is taken; a bin that gets full is best.
        """
        need, best = self.size[i], None
        for room in sorted(r for r, bins in self.by_room.items() if bins and 0 < r < self.room[victim]):
            for b in sorted(self.by_room[room]):
                ranked = sorted((self.size[j], j) for j in self.items[b])
                sizes = [s for s, _ in ranked]
                low, high = need - room, need - 1  # what may leave: the other bin grows, and holds item i
                k = bisect_left(sizes, low)
                if k < len(sizes) and sizes[k] <= high and (best is None or room - need + sizes[k] < best[0]):
                    best = (room - need + sizes[k], b, [ranked[k][1]])
                for a in range(bisect_right(sizes, high // 2)):
                    k = bisect_left(sizes, low - sizes[a], a + 1)
                    if k < len(sizes) and sizes[a] + sizes[k] <= high and (best is None or room - need + sizes[a] + sizes[k] < best[0]):
                        best = (room - need + sizes[a] + sizes[k], b, [ranked[a][1], ranked[k][1]])
                if best and best[0] == 0:
                    break
            if best and best[0] == 0:
                break
        if best is None:
            return False
        _, b, out = best
        self.change(b, out, [i])
        self.change(victim, [i], out)
        return True

    def empty(self, victim: int) -> bool:
        """Moves and exchanges until ``victim`` is empty or nothing helps.

        Each exchange raises the sum of squared fills, so this ends; a bin that takes no
        move leaves the victim lighter, which later moves may use.
        """
        for _ in range(4 * len(self.items[victim]) + 8):
            if not self.items[victim]:
                break
            moved = False
            self._forget(victim)  # it takes nothing itself
            for i in sorted(self.items[victim], key=lambda i: (-self.size[i], i)):
                b = self.best(self.size[i])
                if b is not None:
                    self.change(b, [], [i])
                    self.items[victim].remove(i)
                    self.room[victim] += self.size[i]
                    moved = True
            self._index(victim)
            if self.items[victim] and not moved:
                longest = sorted(self.items[victim], key=lambda i: (-self.size[i], i))
                if not any(self._exchange(i, victim) for i in longest[:EXCHANGED]):
                    return False
        return not self.items[victim]

    def local_search(self) -> None:
        """Tries to empty bins, the lightest first, until none of ``PATIENCE`` empties or the bound is met."""
        least = -(-sum(self.size) // self.capacity)
        used, failed, tried = len(self.items), 0, set()
        while used > least and failed < PATIENCE:
            open_bins = [(-self.room[b], b) for b in range(len(self.items)) if self.items[b] and self.room[b] and b not in tried]
            if not open_bins:
                return
            victim = min(open_bins)[1]
            if self.empty(victim):
                self._forget(victim)
                used, failed = used - 1, 0
                tried.clear()
            else:
                tried.add(victim)
                failed += 1


def pack(cut: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt at random into groups of about ``group_rows``, each packed by one
    task in bounded memory; at most one more sequence a group is open than in one
    packing of all. Within a group: best fit, then local search. Pieces longer than
    ``capacity`` are refused. Repeated rows are packed each by itself; an empty table
    gives no sequences. Other columns of ``cut`` are left out.
    """
    stored = written(cut, "pieces")
    groups = max(1, -(-stored.count() // group_rows))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([EMPTY, *batches], ignore_index=True)
        if not len(rows):
            return
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        if rows["length"].iloc[0] > capacity:
            raise ValueError("a piece is longer than a sequence")
        bins = Bins(rows["length"].to_numpy(), capacity)
        bins.best_fit()
        bins.local_search()
        first = TaskContext.get().partitionId() << 40
        at, sequence = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, items in enumerate(bins.items):
            offset = 0
            for i in items:
                at[i], sequence[i] = offset, first + b
                offset += bins.size[i]
        rows["sequence_id"], rows["offset"] = sequence, at
        for k in range(0, len(rows), 10_000):
            yield rows.iloc[k : k + 10_000].astype({"doc_id": "Int64"})

    dealt = stored.repartition(groups, F.xxhash64("doc_id", "piece", "start"))
    return dealt.mapInPandas(fill, f"{PIECES}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, capacity: int = 2048, folder: str | None = None) -> DataFrame:
    """Documents cut into pieces and packed: see ``pieces`` and ``pack``.

    Columns of ``docs`` but doc_id and text are ignored. Rows that repeat a doc_id are
    packed each; a null doc_id is kept.
    """
    return pack(pieces(docs, capacity, folder), capacity)
