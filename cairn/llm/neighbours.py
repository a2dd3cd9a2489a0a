"""Approximate nearest neighbours: a graph by NN-descent, and greedy search in it.

Nodes are the distinct vectors. The graph starts from groups of vectors on the same
side of random planes. Then, again and again, each node introduces its neighbours, in
either direction, to each other: a join of the edges with the vectors, a grouping by the
node in the middle, and a grouping by the node that may have gained. Queries walk the
graph in rounds: the best nodes found so far and not yet visited are joined with their
neighbours, until none of the best is left to visit. Vectors travel as they are and are
compared in double precision throughout: rounded ones would not tell near copies apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Neighbours kept of each node, and nodes that name it as theirs.
DEGREE, REVERSE = 24, 24
#: Groupings by random planes, vectors of a group at most, turns of NN-descent.
TREES, GROUP, TURNS = 4, 256, 3
#: What a node learns from one middle node in a turn.
INTRODUCED = 6
#: Best nodes that a query remembers, nodes visited in a round, rounds at most.
BEAM, VISITS, ROUNDS = 320, 80, 12
#: Entry points for queries, a bounded sample of the nodes.
ENTRIES = 32
#: Turns in which groups of more than two times GROUP vectors are split, and planes of a turn at most.
SPLITS, PLANES = 6, 16


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, summed in order."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(vectors: pd.Series) -> list[bytes]:
    """Vectors as 32-bit floats, not rounded further."""
    return [np.asarray(v, "<f4").tobytes() for v in vectors]


def _unpacked(parts: list[bytes]) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = np.frombuffer(b"".join(parts), "<f4").reshape(len(parts), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, vector, packed) of the distinct usable vectors, and (node, members): the least vec_ids of each, six at most.

    Six are enough: five nearest are wanted, and one may be the query itself. All vectors are of one length.
    """
    good = vectors.select("vec_id", F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    keyed = good.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.hash("vector"))
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    least = keyed.select("k1", "k2", "vec_id").distinct().withColumn("r", F.row_number().over(first)).filter("r <= 6")
    members = written(least.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("members")), "members")
    members = members.select(F.col("members")[0].alias("node"), "members")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"node": batch["node"], "vector": batch["vector"], "packed": _packed(batch["vector"])})

    heads = good.join(members.select(F.col("node").alias("vec_id")), "vec_id").dropDuplicates(["vec_id"])
    kind = heads.schema["vector"].dataType.simpleString()  # as it came: scores are of the original vectors
    nodes = heads.select(F.col("vec_id").alias("node"), "vector").mapInPandas(pack, f"node long, vector {kind}, packed binary")
    return written(nodes, "nodes"), members


GRAPH = "node long, ids array<long>, sims array<double>"


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], sims[first]


def _merged(found: DataFrame) -> DataFrame:
    """One row a node, its DEGREE nearest."""
    held = found.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("sims")).alias("sims"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [_best(np.asarray(i), np.asarray(s), DEGREE) for i, s in zip(batch["ids"], batch["sims"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "ids": pd.Series([b[0] for b in best], dtype=object), "sims": pd.Series([b[1] for b in best], dtype=object)})

    return held.mapInPandas(merge, GRAPH)


def _nearest_within(ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """(id, nearest ids, similarities) of each member of a group."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
    return ((ids[i], ids[n], sims[i, n]) for i, n in enumerate(near))


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"node": [f[0] for f in found], "ids": pd.Series([f[1] for f in found], dtype=object), "sims": pd.Series([f[2] for f in found], dtype=object)})


def _start(nodes: DataFrame, n: int) -> DataFrame:
    """A first graph from groups on the same side of random planes, cut to GROUP vectors.

    Near copies lie on the same side of all planes through the origin; large groups are split (see ``_split``).
    """
    bits = max(0, int(np.log2(max(n, 1) / (GROUP / 2))))

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unpacked(batch["packed"].tolist())
            for tree in range(TREES):
                planes = np.random.default_rng(tree).standard_normal((x.shape[1], bits))
                code = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"tree": tree, "code": code, "node": batch["node"], "packed": batch["packed"]})

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of tree and code; a group ends with its code or when it is full."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[["tree", "code"]].to_numpy(np.int64)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            rest = rows.iloc[cuts[-1] :] if len(rows) - cuts[-1] < GROUP else rows.iloc[len(rows) :]
            yield from (_rows(list(near)) for near in groups(rows.iloc[: len(rows) - len(rest)], cuts))
        if rest is not None and len(rest):
            yield from (_rows(list(near)) for near in groups(rest, np.zeros(1, int)))

    def groups(rows: pd.DataFrame, cuts: np.ndarray) -> Iterator:
        if len(rows):
            ids, x = rows["node"].to_numpy(), _unpacked(rows["packed"].tolist())
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                for at in range(a, min(b, len(rows)), GROUP):
                    to = min(at + GROUP, b, len(rows))
                    yield _nearest_within(ids[at:to], x[at:to], DEGREE)

    codes = nodes.mapInPandas(sides, "tree int, code long, node long, packed binary")
    codes = _split(written(codes.select("tree", "code", "node"), "codes"), nodes)
    dealt = codes.join(nodes.select("node", "packed"), "node").select("tree", "code", "node", "packed")
    # A group that is still too large is cut at random, in each tree at other places.
    return dealt.repartition("tree", "code").sortWithinPartitions("tree", "code", F.xxhash64("tree", "node")).mapInPandas(group, GRAPH)


def _split(codes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``codes`` (tree, code, node) with large groups split by random planes through their own medians."""
    for turn in range(SPLITS):
        sizes = codes.groupBy("tree", "code").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * GROUP)
        sizes = written(sizes, "large")
        if sizes.isEmpty():
            break

        def project(batches: Iterator[pd.DataFrame], turn: int = turn) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x, tree = _unpacked(batch["packed"].tolist()), batch["tree"].to_numpy()
                    at = np.zeros((len(x), PLANES))
                    for t in range(TREES):
                        planes = np.random.default_rng((turn + 1, t)).standard_normal((x.shape[1], PLANES))
                        at[tree == t] = x[tree == t] @ planes
                    yield pd.DataFrame({"tree": batch["tree"], "code": batch["code"], "node": batch["node"], "at": list(at)})

        inside = codes.join(sizes.select("tree", "code"), ["tree", "code"], "left_semi").join(nodes.select("node", "packed"), "node")
        inside = written(inside.select("tree", "code", "node", "packed").mapInPandas(project, "tree int, code long, node long, at array<double>"), "inside")
        middle = inside.groupBy("tree", "code").agg(F.array(*(F.percentile_approx(F.col("at")[j], 0.5) for j in range(PLANES))).alias("middle"))
        # As many planes as leave about half of GROUP to a part.
        used = F.least(F.lit(PLANES), F.floor(F.log2(F.col("n") / (GROUP / 2))).cast("int"))
        cuts = middle.join(sizes, ["tree", "code"]).select("tree", "code", F.slice("middle", F.lit(1), used).alias("middle"))
        side = F.transform("middle", lambda m, j: F.get("at", j) > m)
        parted = inside.join(F.broadcast(cuts), ["tree", "code"]).select("tree", F.xxhash64(F.lit(turn), "code", side).alias("code"), "node")
        codes = written(codes.join(sizes, ["tree", "code"], "left_anti").select("tree", "code", "node").unionByName(parted), "codes")
    return codes


def _around(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ids, packed): the neighbours of each node in either direction, with their vectors.

    Of the nodes that name one as neighbour, REVERSE are taken, chosen by a hash.
    """
    out = graph.select(F.col("node").alias("a"), F.explode("ids").alias("b"))
    rank = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= REVERSE).drop("r")
    both = out.unionByName(back).distinct()
    named = both.join(nodes.select(F.col("node").alias("b"), "packed"), "b")
    held = named.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "packed")).alias("near"))
    return held.select("node", F.col("near.b").alias("ids"), F.col("near.packed").alias("packed"))


def build(nodes: DataFrame) -> DataFrame:
    """(node, ids, packed): the graph, each node with its neighbours in either direction and their vectors."""
    graph = written(_merged(_start(nodes, nodes.count())), "graph")

    def introduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                found: list[tuple] = []
                for ids, packed in zip(batch["ids"].iloc[at : at + 500], batch["packed"].iloc[at : at + 500], strict=True):
                    found += _nearest_within(np.asarray(ids), _unpacked(list(packed)), INTRODUCED)
                yield _rows(found)

    for _ in range(TURNS):
        gained = _around(graph, nodes).mapInPandas(introduce, GRAPH)
        graph = written(_merged(graph.unionByName(gained)), "graph")
    return written(_around(graph, nodes), "around")


STATE = "query_id long, ids array<long>, sims array<double>, seen array<boolean>"


def walk(around: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ids): nodes near each query, nearest first. ``queries``: (query_id, start, packed); start may be null."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = around.repartition(parts, "node").persist()
    entries = [r["node"] for r in nodes.orderBy(F.xxhash64("node")).select("node").limit(ENTRIES).collect()]
    first = F.array_compact(F.array_union(F.array("start"), F.lit(entries).cast("array<long>") if entries else F.array().cast("array<long>")))
    state = written(
        queries.select("query_id", first.alias("ids"), F.transform(first, lambda x: F.lit(-2.0)).alias("sims"), F.transform(first, lambda x: F.lit(False)).alias("seen")),
        "walk",
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = _unpacked(batch["packed"].tolist())
                sims = [_unpacked(list(p)) @ q[i] for i, p in enumerate(batch["near"])]
                yield pd.DataFrame({"query_id": batch["query_id"], "ids": batch["ids"], "sims": pd.Series(sims, dtype=object)})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Old and new nodes of each query; those of the last frontier count as visited from now on."""
        for batch in batches:
            rows = []
            for query, ids, sims, seen, more, their in batch[["query_id", "ids", "sims", "seen", "new_ids", "new_sims"]].itertuples(index=False):
                ids, sims, seen = np.asarray(ids, np.int64), np.asarray(sims, np.float64), np.array(seen, bool)
                seen[_frontier(seen)] = True
                new, keep = np.unique(np.asarray(more, np.int64), return_index=True)
                fresh = ~np.isin(new, ids)
                ids = np.concatenate((ids, new[fresh]))
                sims = np.concatenate((sims, np.asarray(their, np.float64)[keep][fresh]))
                seen = np.concatenate((seen, np.zeros(int(fresh.sum()), bool)))
                order = np.lexsort((ids, -sims))[:BEAM]
                rows.append((query, ids[order], sims[order], seen[order]))
            yield pd.DataFrame(rows, columns=["query_id", "ids", "sims", "seen"])

    open_ids = F.expr(f"slice(transform(filter(arrays_zip(ids, seen), x -> not x.seen), x -> x.ids), 1, {VISITS})")
    for _ in range(ROUNDS):
        frontier = state.select("query_id", F.explode(open_ids).alias("node")).join(queries.select("query_id", "packed"), "query_id")
        met = frontier.join(held.select("node", "ids", F.col("packed").alias("near")), "node")
        new = met.select("query_id", "packed", "ids", "near").mapInPandas(score, "query_id long, ids array<long>, sims array<double>")
        new = new.groupBy("query_id").agg(F.flatten(F.collect_list("ids")).alias("new_ids"), F.flatten(F.collect_list("sims")).alias("new_sims"))
        none = [F.coalesce("new_ids", F.array().cast("array<long>")).alias("new_ids"), F.coalesce("new_sims", F.array().cast("array<double>")).alias("new_sims")]
        state = written(state.join(new, "query_id", "left").select("query_id", "ids", "sims", "seen", *none).mapInPandas(settle, STATE), "walk")
        if state.filter(F.exists("seen", lambda s: ~s)).isEmpty():
            break
    held.unpersist()
    return state.select("query_id", "ids")


def _frontier(seen: np.ndarray) -> np.ndarray:
    """Places of the best nodes not visited, as many as a round visits."""
    return np.flatnonzero(~seen)[:VISITS]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query the k (5 at most) nearest vectors found, by cosine.

    ``vectors`` and ``queries`` have (vec_id, embedding); a query's own vec_id is no
    candidate. Nearest first, ties to the lesser vec_id; fewer rows if there are fewer candidates.
    Vectors that are null, zero, or hold a null or a number that is not finite take no part, as
    query or candidate, nor do those without a vec_id. A cosine needs equal lengths, so each length
    of vectors is searched by itself: by a graph of its own, or, if they are no more than GROUP, all of
    them. Equal vectors are one node, whose members stand in order of vec_id; of rows
    that repeat a vec_id the nearest counts. Empty tables give no rows.
    """
    if k > 5:
        raise ValueError("k is 5 at most")
    fine = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    held, asked = vectors.filter(fine), queries.filter(fine)
    counts = {r["s"]: r["count"] for r in held.groupBy(F.size("embedding").alias("s")).count().collect()}  # a row a length
    large = sorted(s for s, n in counts.items() if n > GROUP)
    size = F.size("embedding")
    out = [_graph_search(held.filter(size == s), asked.filter(size == s), k) for s in large]
    if len(large) < len(counts) or not counts:
        out.append(_ranked(_compared(held.filter(~size.isin(large)), asked.filter(~size.isin(large))), k))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _compared(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of all vectors of a query's length, of which there are at most GROUP."""
    there = vectors.select("vec_id", F.col("embedding").alias("vector"), F.size("embedding").alias("s"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.size("embedding").alias("s")).dropDuplicates(["query_id"])
    return asked.join(there, "s").filter("query_id <> vec_id").select("query_id", "vec_id", cosine(F.col("q"), F.col("vector")).alias("score"))


def _ranked(each: DataFrame, k: int) -> DataFrame:
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _graph_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``search`` among usable vectors of one length."""
    nodes, members = nodes_of(vectors)
    around = build(nodes)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    asked = written(asked.dropDuplicates(["query_id"]), "asked")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"query_id": batch["query_id"], "start": batch["start"], "packed": _packed(batch["q"])})

    # A query that is a node starts there.
    keys = nodes.select(F.xxhash64("vector").alias("k1"), F.hash("vector").alias("k2"), F.col("node").alias("start"))
    keyed = asked.select("query_id", "q", F.xxhash64("q").alias("k1"), F.hash("q").alias("k2")).join(keys, ["k1", "k2"], "left")
    packed = keyed.select("query_id", "q", F.col("start").cast("double").alias("start")).mapInPandas(pack, "query_id long, start double, packed binary")
    starts = written(packed.select("query_id", F.col("start").cast("long").alias("start"), "packed"), "starts")
    found = walk(around, nodes, starts).select("query_id", F.explode("ids").alias("node"))
    exact = found.join(nodes.select("node", "vector"), "node").join(asked, "query_id").select("query_id", "node", cosine(F.col("q"), F.col("vector")).alias("score"))
    each = exact.join(members, "node").select("query_id", "score", F.explode("members").alias("vec_id")).filter("query_id <> vec_id")
    return _ranked(each, k)
