"""Conversation structure repair by Knuth's lightest derivations.

A conversation is to read ``s?(ua)+`` in the initials of its roles, or be empty. A repair is a
derivation: item (i, q) says that the rows from i on can be edited so that a reader in state q
accepts them; an edit of row i-1, or an insertion, concludes a further item. An agenda pops
items by weight (cost, rows consumed, audit), each edit's function being monotone and superior in it,
so that an item is final when it is popped, and the first goal is the cheapest repair.

Long conversations are cut into blocks of rows. A block's items are derived for every pair of
states (entry, exit) in tasks of their own, and a second agenda derives the conversation from its
blocks, with two antecedents each: a block from p to q and what follows in q. So no task holds
the rows of a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a block, as a power of two.
BLOCK = 12
#: Edits that are held at once.
SPREAD = 10_000
#: Rows that one task derives repairs for, about.
TASK_ROWS = 200_000
#: States of the reader: nothing read, read s, u, a. It may end in the first and the last.
START, S, U, A = range(4)
#: Where a role's initial leads: to the state in the key, from the states named.
INTO = {U: ("u", (START, S, A)), A: ("a", (U,)), S: ("s", (START,))}
#: Edits that complete a conversation which ends in a state.
ENDS = {START: (0, ""), S: (4, "ua"), U: (2, "a"), A: (0, "")}
INITIALS = "-sua"
ROLES = {"u": "user", "a": "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits in ASCII order. Of an item, equal costs and another edit first mean another audit: the first letter decides.
DELETE, INSERT, KEEP, REROLE = EDITS = "DIKR"


def agenda(axioms: Iterable[tuple], conclude: Callable, goals: Iterable[Hashable]) -> dict:
    """Knuth's generalisation of shortest paths: items with their lightest weight and the reason for it.

    ``axioms`` holds (weight, item, reason); ``conclude(item, weight, done)`` yields more
    of them from an item just finalised and those done before. Weights of conclusions are
    never below those of their antecedents. Ends when all goals are done, or nothing is left.
    """
    heap: list = []
    for entry in axioms:
        heappush(heap, entry)
    done: dict = {}
    left = set(goals)
    while heap and left:
        weight, item, why = heappop(heap)
        if item in done:
            continue
        done[item] = (weight, why)
        left.discard(item)
        for entry in conclude(item, weight, done):
            if entry[1] not in done:
                heappush(heap, entry)
    return done


def derive(initials: list[str], faults: list[int], ends: dict[int, int], goals: list[int], last: bool) -> list[tuple[int, int, str, str]]:
    """Rows (entry, cost, audit, roles) of the lightest derivations from the rows' end back to each goal state.

    ``roles`` holds for each edit the initial of the row that it gives, ``-`` for none.

    ``ends``: cost of each state at the end. ``last``: rows may be inserted after the last
    one; in a block that others follow these belong to the next.
    """
    n = len(initials)

    def conclude(item: tuple[int, int], weight: tuple, done: dict) -> Iterator[tuple]:
        (i, q), (cost, used, _) = item, weight
        into, sources = INTO.get(q, ("", ()))
        if q in (U, A) and (i < n or last):
            for p in sources:
                yield (cost + 2, used, 1), (i, p), q
        if i:
            initial, fault = initials[i - 1], faults[i - 1]
            yield (cost + 3, used + 1, 0), (i - 1, q), q
            if fault in (FINE, TRUNCATED):
                extra = fault == TRUNCATED
                for p in sources:
                    if initial == into:
                        yield (cost + extra, used + 1, 2), (i - 1, p), q
                    if q in (U, A):
                        yield (cost + extra + 2, used + 1, 3), (i - 1, p), q

    done = agenda((((cost, 0, 0), (n, q), None) for q, cost in ends.items()), conclude, [(0, p) for p in goals])
    found = []
    for p in goals:
        if (0, p) in done:
            audit, roles, (i, q) = [], [], (0, p)
            while True:
                (_, _, edit), to = done[i, q]
                if to is None:
                    break
                audit.append(EDITS[edit])
                roles.append(INITIALS[to] if edit else "-")
                i, q = i + (edit != 1), to
            found.append((p, done[0, p][0][0], "".join(audit), "".join(roles)))
    return found


def join_blocks(tables: list[dict[tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int]]:
    """The states (entry, exit) of each block in the lightest derivation of a conversation.

    ``tables`` holds of each block (entry, exit) -> (cost, rank); ranks order the audits of
    one entry. Items are blocks, which are axioms, and suffixes (k, q): blocks from k on, entered in q.
    """
    n = len(tables)
    blocks = (((cost, 1, rank), (k, p, q), None) for k, table in enumerate(tables) for (p, q), (cost, rank) in table.items())
    ends = (((cost, 0, 0), (n, q), None) for q, (cost, _) in ENDS.items())

    def conclude(item: tuple, weight: tuple, done: dict) -> Iterator[tuple]:
        if len(item) == 3:
            (k, p, q), (cost, _, rank) = item, weight
            if (k + 1, q) in done:
                rest = done[k + 1, q][0]
                yield (cost + rest[0], 1 + rest[1], rank), (k, p), q
        elif item[0]:
            (k, q), (cost, used, _) = item, weight
            for p in range(4):
                if (k - 1, p, q) in done:
                    own = done[k - 1, p, q][0]
                    yield (own[0] + cost, 1 + used, own[2]), (k - 1, p), q

    done = agenda([*blocks, *ends], conclude, [(0, START)])
    path, p = [], START
    for k in range(n):
        q = done[k, p][1]
        path.append((p, q))
        p = q
    return path


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by d = crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it, 4
    makes its role user. A null is one space, in the hashed text too; conv_id and turn themselves stay null.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    d = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    read = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), d.alias("d")).filter("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, written: their order by conversation, turn, role and text, nulls first.

    Rows are dealt by ranges, so one conversation, or one turn that is repeated, may lie in
    many partitions. ``at`` counts up within a partition, and partitions follow one another.
    """
    plain = rows.select("conv_id", "turn", *(F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")))
    tied = plain.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.orderBy("conv_id", "turn", "role", "text", "tie").drop("tie")
    return written(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, at, initial, fault): the first that holds of blank, duplicate of an earlier row, truncated; else 0."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    end = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    read = turns.select("conv_id", "at", F.left("role", F.lit(1)).alias("initial"), end.alias("fault"), said.alias("said"))
    first = read.groupBy(F.col("conv_id").alias("conv"), F.col("said").alias("what")).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = read.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("said") == F.col("what")), "left")
    again = (F.col("fault") != BLANK) & (F.col("at") > F.col("first"))
    return met.select("conv_id", "at", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


PARTS = "conv_id long, block long, first_at long, n int, head string, tail string, blank int, duplicate int, truncated int, illegal int, entry int, leave int, cost int, rank int, audit string, roles string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of equal keys (nulls are equal), also across batches, and the keys."""
    held: list[pd.DataFrame] = []
    name: tuple | None = None
    for batch in batches:
        batch = batch.astype({"conv_id": "Int64"})
        own = batch[keys].astype("Int64")
        new = (own != own.shift()).fillna(True) & ~(own.isna() & own.shift().isna())
        starts = [0, *(k for k in new.any(axis=1).to_numpy().nonzero()[0] if k), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            now = tuple(None if pd.isna(x) else int(x) for x in own.iloc[a])
            if held and now != name:
                yield name, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            name = now
            held.append(batch.iloc[a:b])
    if held:
        yield name, pd.concat(held) if len(held) > 1 else held[0]


def _tasks(rows: DataFrame) -> int:
    """Partitions for work that takes some 50 microseconds a row."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)


def block_items(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``PARTS``: of each block's conversations the derived items, with what is counted in their rows.

    Inside a block a conversation is whole, so only its goal is derived. The first and last one of a block may go on
    in others: theirs are derived for all states.
    """

    def part(conv: int | None, key: int, at: int, initials: list[str], kinds: list[int], whole: bool) -> Iterator[tuple]:
        illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
        facts = (conv, key, at, len(kinds), initials[0], initials[-1], kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED), illegal)
        if whole:
            for p, *rest in derive(initials, kinds, {START: 0, A: 0}, [START], True):
                yield (*facts, p, A, rest[0], -1, *rest[1:])
            return
        found = [(p, q, *rest) for q in range(4) for p, *rest in derive(initials, kinds, {q: 0}, [START, S, U, A], False)]
        ranks = {x: k for k, x in enumerate(sorted({row[3] for row in found}))}
        for p, q, cost, audit, roles in found:
            yield (*facts, p, q, cost, ranks[audit], audit, roles)

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key,), own in _runs(batches, ["block"]):
            convs = [None if pd.isna(x) else int(x) for x in own["conv_id"]]
            at, initials, kinds = int(own["at"].iloc[0]), own["initial"].tolist(), own["fault"].tolist()
            starts = [k for k in range(len(convs)) if not k or convs[k] != convs[k - 1]]
            spans = list(zip(starts, [*starts[1:], len(convs)], strict=True))
            out = [
                row
                for k, (a, b) in enumerate(spans)
                for row in part(convs[a], key, at + a, initials[a:b], kinds[a:b], 0 < k < len(spans) - 1)
            ]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PARTS.split(", ")]).astype({"conv_id": "Int64"})

    keyed = rows.withColumn("block", F.shiftright("at", block))
    return keyed.repartition(_tasks(rows), "block").sortWithinPartitions("block", "at").mapInPandas(items, PARTS)


def _paths(parts: DataFrame) -> DataFrame:
    """Rows (conv_id, block, entry, leave, joint, close): each block's item in its conversation's repair.

    ``joint``: 1 if its first row doesn't follow the row before it; ``close``: edits after the last block.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv,), own in _runs(batches, ["conv_id"]):
            tables, blocks, heads, tails = [], [], [], []
            for row in own.itertuples(index=False):
                if not blocks or blocks[-1] != row.block:
                    tables.append({})
                    blocks.append(row.block)
                    heads.append(row.head)
                    tails.append(row.tail)
                tables[-1][row.entry, row.leave] = (row.cost, row.rank)
            path = join_blocks(tables)
            close = [""] * (len(path) - 1) + [ENDS[path[-1][1]][1]]
            joint = [0, *(int(pair not in LEGAL) for pair in zip(tails, heads[1:], strict=False))]
            rows = [(conv, b, *pq, j, c) for b, pq, j, c in zip(blocks, path, joint, close, strict=True)]
            yield pd.DataFrame(rows, columns=["conv_id", "block", "entry", "leave", "joint", "close"]).astype({"conv_id": "Int64"})

    open_parts = parts.filter("rank >= 0").select("conv_id", "block", "head", "tail", "entry", "leave", "cost", "rank")
    dealt = open_parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInPandas(join, "conv_id long, block long, entry int, leave int, joint int, close string")


def plan(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, block, first_at, n, cost, blank, duplicate, truncated, illegal, audit, roles), written.

    One for each block of each conversation of ``turns`` (see ``in_order``): the audit of
    the block's edits in the cheapest repair, ties to the least audit in ASCII order.
    """
    parts = written(block_items(faults(turns), block), "parts")
    facts = ["conv_id", "block", "first_at", "n", "cost", "blank", "duplicate", "truncated", "illegal", "audit", "roles"]
    whole = parts.filter("rank < 0").select(*facts)
    path = _paths(parts).select(F.col("conv_id").alias("conv"), F.col("block").alias("own"), F.col("entry").alias("p"), F.col("leave").alias("q"), "joint", "close")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("own")) & (F.col("entry") == F.col("p")) & (F.col("leave") == F.col("q"))
    met = parts.filter("rank >= 0").join(path, same)
    met = met.withColumns({
        "illegal": F.col("illegal") + F.col("joint"),
        "cost": F.col("cost") + 2 * F.length("close"),
        "audit": F.concat("audit", F.translate("close", "ua", INSERT * 2)),
        "roles": F.concat("roles", "close"),
    })
    return written(whole.unionByName(met.select(*facts)), "plan")


def edits(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (conv_id, at, place, edit, role, text): all edits, in the order of (at, place).

    Inserted rows are empty, have the ``at`` of the row that follows them and a lower place.
    A deleted row keeps its role and text.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            out = []
            for conv, at, audit, roles in zip(ids, batch["first_at"].tolist(), batch["audit"], batch["roles"], strict=True):
                place = 0
                for edit, role in zip(audit, roles, strict=True):
                    out.append((at, place, edit, ROLES[role] if edit in (INSERT, REROLE) else None, conv))
                    at, place = (at, place + 1) if edit == INSERT else (at + 1, 0)
                if len(out) >= SPREAD:
                    yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    names = ["at", "place", "edit", "put", "conv_id"]
    made = plans.select("conv_id", "first_at", "audit", "roles").mapInPandas(spread, "at long, place int, edit string, put string, conv_id long")
    own = turns.select(F.col("at").alias("row"), "role", "text")
    met = made.join(own, (F.col("at") == F.col("row")) & (F.col("edit") != INSERT), "left")
    return met.select("conv_id", "at", "place", "edit", F.coalesce("put", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, plans, edits) of conversations (conv_id, turn, role, text): see ``in_order``, ``plan``, ``edits``.

    A null conv_id is a conversation like any other; null roles and texts are one space; rows
    that repeat a turn stand in the order of role and text. Other columns are ignored, and an empty table gives no rows.
    """
    turns = in_order(rows)
    plans = plan(turns, block)
    return turns, plans, edits(turns, plans)


def _hashes(made: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256): of ``role:text`` of what is left, newline-joined.

    SHA-256 reads its input in order, so one task reads a conversation's rows; it holds a batch of them at a time.
    """

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, out = None, None, []
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
            for conv, line in zip(ids, batch["line"], strict=True):
                if state is None or conv != name:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
            out = []
        if state is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})

    lines = made.filter(F.col("edit") != DELETE).select("conv_id", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    return dealt.select("conv_id", "line").mapInPandas(chained, "conv_id long, repaired_sha256 string")


def digest(rows: DataFrame, turns: DataFrame, plans: DataFrame, made: DataFrame) -> DataFrame:
    """Per conv_id of ``rows``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows in ``turns`` has zeros, an empty audit and the hash of the
    empty string, as has one whose rows are all deleted.
    """
    width = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(width, F.lit(0)).alias("gaps"))
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    # The audit is part of the result; blocks are few beside rows.
    audit = F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit")))["audit"], "")
    told = plans.groupBy("conv_id").agg(*counts, audit.alias("audit"))
    out = rows.select("conv_id").distinct()
    for part in (gaps, told, _hashes(made)):
        part = part.withColumnRenamed("conv_id", "conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in names),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
