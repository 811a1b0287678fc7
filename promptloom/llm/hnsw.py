"""Approximate nearest neighbours by largest inner product.

Rows are dealt over shards by hash. Each shard holds a hierarchical navigable
small-world graph over its vectors, stored as flat neighbour arrays; every query is
searched in every shard and the shards' best are merged. Vectors get one more
component, so that all have the same length and the largest inner product is the
smallest distance. Inserts and searches work on many vectors at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.session import materialise

LINKS = 16  # per node above the ground level, twice as many on it
BUILD_WIDTH = 64
SEARCH_WIDTH = 160
SHARD_ROWS = 40_000
# smaller tables have fewer rows a shard, to keep cores busy, but no less than this
LEAST_ROWS = 2_000
BUSY_SHARDS = 12
QUERY_BLOCK = 20_000
STEP = 256  # inserts or queries at once
SLICE = 16


def _distance(vectors: np.ndarray, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances of queries (q, d) to nodes (q, k); -1 is infinitely far."""
    got = vectors[np.maximum(nodes, 0)]
    dot = np.matmul(got, queries[:, :, None])[:, :, 0]
    # all vectors have one length, queries are not scaled to it
    far = -2.0 * dot
    far[nodes < 0] = np.inf
    return far


def beam(
    vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes per query and their distances, from ``entry`` (q, e) on.

    In each step every query that has an unvisited node among its best follows
    that node's links; a query is done when all its best have been followed.
    """
    q, n = len(queries), len(links)
    nodes = np.full((q, width), -1, np.int64)
    far = np.full((q, width), np.inf)
    followed = np.zeros((q, width), bool)
    seen = np.zeros((q, n + 1), bool)
    start = entry[:, :width]
    nodes[:, : start.shape[1]] = start
    far[:, : start.shape[1]] = _distance(vectors, queries, start)
    seen[np.arange(q)[:, None], start] = True
    order = np.argsort(far, axis=1)
    nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
    live = np.arange(q)
    while len(live):
        open_ = ~followed[live] & (nodes[live] >= 0)
        going = open_.any(axis=1)
        live, open_ = live[going], open_[going]
        if not len(live):
            break
        at = open_.argmax(axis=1)
        followed[live, at] = True
        new = links[nodes[live, at]]
        new = np.where(seen[live[:, None], new], -1, new)
        seen[live[:, None], new] = True
        seen[:, -1] = False
        away = _distance(vectors, queries[live], new)
        both = np.concatenate((far[live], away), axis=1)
        keep = np.argpartition(both, width - 1, axis=1)[:, :width]
        keep = np.take_along_axis(
            keep, np.argsort(np.take_along_axis(both, keep, 1), axis=1, kind="stable"), 1
        )
        far[live] = np.take_along_axis(both, keep, 1)
        nodes[live] = np.take_along_axis(np.concatenate((nodes[live], new), 1), keep, 1)
        old = np.concatenate((followed[live], np.zeros(new.shape, bool)), 1)
        followed[live] = np.take_along_axis(old, keep, 1)
    return nodes, far


class Graph:
    """Levels of flat neighbour arrays over one array of vectors of equal length.

    ``members[l]`` are the nodes of level l, a prefix of the nodes, since nodes are
    numbered by falling level; ``links[l]`` has a row of neighbours per member.
    """

    def __init__(self, vectors: np.ndarray, levels: np.ndarray) -> None:
        self.vectors = vectors
        self.sizes = [int((levels >= l).sum()) for l in range(int(levels.max(initial=0)) + 1)]
        self.links = [
            np.full((size, LINKS * (2 if l == 0 else 1)), -1, np.int64)
            for l, size in enumerate(self.sizes)
        ]

    def build(self) -> None:
        """Insert all nodes in order, a growing number at once."""
        for level, size in enumerate(self.sizes):
            at = min(size, LINKS)
            self._join(level, np.arange(at), np.arange(at)[None, :].repeat(at, 0))
            while at < size:
                new = np.arange(at, min(size, at + min(STEP, at)))
                near = self._near(level, self.vectors[new], at)
                # those that arrive together see each other as well
                own = new[None, :].repeat(len(new), 0)
                self._join(level, new, np.concatenate((near, own), 1))
                at += len(new)

    def _near(self, level: int, queries: np.ndarray, upto: int) -> np.ndarray:
        links = self.links[level][:upto]
        entry = np.zeros((len(queries), 1), np.int64)
        if upto > LINKS:
            # spread entries; upper levels do this for searches
            spots = np.linspace(0, upto - 1, min(upto, 8)).astype(np.int64)
            entry = spots[None, :].repeat(len(queries), 0)
        return beam(self.vectors, links, entry, queries, BUILD_WIDTH)[0]

    def _join(self, level: int, new: np.ndarray, near: np.ndarray) -> None:
        """Link each new node with some of those near it, and these back."""
        near = np.where(near == new[:, None], -1, near)
        far = _distance(self.vectors, self.vectors[new], near)
        order = np.argsort(far, axis=1, kind="stable")[:, :BUILD_WIDTH]
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        chosen = self._spread(near, far)
        links = self.links[level]
        source, target = np.nonzero(chosen)
        a, b = new[source], near[source, target]
        gap = far[source, target]
        # the new node's own links, then what the others gain
        self._merge(links, np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((gap, gap)))

    def _spread(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Up to ``LINKS`` of the near nodes, none closer to a chosen one than to the new one."""
        got = self.vectors[np.maximum(near, 0)]
        between = -2.0 * np.matmul(got, got.transpose(0, 2, 1))
        chosen = np.zeros(near.shape, bool)
        for k in range(near.shape[1]):
            hidden = (chosen & (between[:, k, :] < far[:, k, None])).any(axis=1)
            ok = (near[:, k] >= 0) & ~hidden & (chosen.sum(axis=1) < LINKS)
            chosen[:, k] = ok
        # what room is left takes the nearest
        room = np.maximum(LINKS // 2 - chosen.sum(axis=1), 0)
        spare = (near >= 0) & ~chosen
        return chosen | (spare & (np.cumsum(spare, axis=1) <= room[:, None]))

    def _merge(self, links: np.ndarray, a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> None:
        """Add links a -> b; a full row keeps a spread of its nearest, then the nearest."""
        touched = np.unique(a)
        old = links[touched]
        own = touched[:, None].repeat(old.shape[1], 1)
        held = old >= 0
        known = np.where(held, _distance(self.vectors, self.vectors[touched], old), np.inf)
        a = np.concatenate((own[held], a))
        b = np.concatenate((old[held], b))
        gap = np.concatenate((known[held], gap))
        pair = np.unique(a * (len(self.vectors) + 1) + b, return_index=True)[1]
        a, b, gap = a[pair], b[pair], gap[pair]
        order = np.lexsort((gap, a))
        a, b, gap = a[order], b[order], gap[order]
        row = np.searchsorted(touched, a)
        rank = np.arange(len(a)) - np.searchsorted(a, touched)[row]
        fits = rank < BUILD_WIDTH
        near = np.full((len(touched), BUILD_WIDTH), -1, np.int64)
        far = np.full(near.shape, np.inf)
        near[row[fits], rank[fits]], far[row[fits], rank[fits]] = b[fits], gap[fits]
        room = links.shape[1]
        full = np.flatnonzero(near[:, room] >= 0)
        for start in range(0, len(full), 2 * STEP):
            some = full[start : start + 2 * STEP]
            chosen = self._spread(near[some], far[some])
            keep = np.argsort(~chosen, axis=1, kind="stable")[:, :room]
            near[some, :room] = np.take_along_axis(near[some], keep, 1)
        links[touched] = near[:, :room]

    def search(self, queries: np.ndarray, k: int, width: int) -> np.ndarray:
        """The best ``k`` nodes per query, best first, -1 where there are fewer."""
        if len(self.vectors) <= width:
            far = -2.0 * (queries @ self.vectors.T)
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
        else:
            entry = np.zeros((len(queries), 1), np.int64)
            for level in range(len(self.links) - 1, 0, -1):
                entry = beam(self.vectors, self.links[level], entry, queries, 4)[0]
            best = beam(self.vectors, self.links[0], entry, queries, width)[0][:, :k]
        if best.shape[1] < k:
            best = np.pad(best, ((0, 0), (0, k - best.shape[1])), constant_values=-1)
        return best


def _levels(keys: np.ndarray) -> np.ndarray:
    """Level of each node from a hash: one node in ``LINKS`` reaches the next level."""
    x = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.floor(-np.log(uniform) / np.log(LINKS)).astype(np.int64)


_GRAPH = "shard long, dim int, nodes binary, vectors binary, sizes array<int>, links array<binary>"


def build_shards(nodes: DataFrame, count: int) -> DataFrame:
    """One row per shard: its nodes, vectors and flat neighbour arrays.

    ``nodes`` has ``shard, dim, node, vector``. A shard's rows are at most a few ten
    thousand, by the number of shards. One more component brings its vectors to the
    length of its longest one; the graph is built in doubles, because that component
    may be much larger than all others.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["node"].to_numpy(np.int64)
        levels = _levels(keys)
        order = np.lexsort((keys, -levels))
        vectors = np.stack(group["vector"].to_numpy())[order].astype(np.float64)
        square = (vectors**2).sum(axis=1)
        more = np.sqrt(square.max() - square)
        graph = Graph(np.column_stack((vectors, more)), levels[order])
        graph.build()
        return pd.DataFrame(
            {
                "shard": group["shard"].iloc[:1].to_numpy(),
                "dim": group["dim"].iloc[:1].to_numpy(),
                "nodes": [keys[order].astype("<i8").tobytes()],
                "vectors": [graph.vectors.astype("<f4").tobytes()],
                "sizes": [graph.sizes],
                "links": [[l.astype("<i4").tobytes() for l in graph.links]],
            }
        )

    # small rows, long work: as many tasks as shards
    dealt = nodes.repartition(count, "shard", "dim")
    return dealt.groupBy("shard", "dim").applyInPandas(run, _GRAPH)


def _opened(row: pd.Series) -> tuple[np.ndarray, Graph]:
    keys = np.frombuffer(row["nodes"], "<i8")
    graph = Graph.__new__(Graph)
    graph.vectors = np.frombuffer(row["vectors"], "<f4").reshape(len(keys), -1)
    graph.sizes = list(row["sizes"])
    graph.links = [
        np.frombuffer(data, "<i4").reshape(size, -1).astype(np.int64)
        for data, size in zip(row["links"], graph.sizes)
    ]
    return keys, graph


def search_shards(
    shards: DataFrame, count: int, queries: DataFrame, k: int, width: int = SEARCH_WIDTH
) -> DataFrame:
    """``query, node``: each shard's best ``k`` nodes for each of ``queries`` (query, dim, vector).

    Shards are numbered from 0 to before ``count``. Queries go to all of them in
    blocks, so a task holds one shard and one block.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    graphs = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.withColumn("block", block).select("*", every.alias("shard")).withColumn("shard", F.col("shard").cast("long"))

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asked):
            return pd.DataFrame({"query": [], "node": []}).astype("int64")
        keys, index = _opened(graph.iloc[0])
        ids = asked["query"].to_numpy(np.int64)
        found: list[Iterator] = []
        for at in range(0, len(ids), STEP):
            part = np.stack(asked["vector"].iloc[at : at + STEP].to_numpy()).astype(np.float32)
            part = np.column_stack((part, np.zeros(len(part), np.float32)))
            best = index.search(part, k, width)
            found.append(np.column_stack((ids[at : at + STEP].repeat(k), best.reshape(-1))))
        pairs = np.concatenate(found)
        pairs = pairs[pairs[:, 1] >= 0]
        return pd.DataFrame({"query": pairs[:, 0], "node": keys[pairs[:, 1]]})

    key = ["shard", "dim", "block"]
    graphs = graphs.withColumn("block", F.col("block").cast("long"))
    return (
        graphs.repartition(count * blocks, *key)
        .groupBy(*key)
        .cogroup(asked.repartition(count * blocks, *key).groupBy(*key))
        .applyInPandas(run, "query long, node long")
    )


def usable(vector: Column) -> Column:
    """Not null or zero, without null or non-finite components."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found per query.

    ``queries`` are rows of the same shape as ``df``; a query's candidates are all
    rows of ``df`` of its dimension with another id. Ties go to the smaller id. Rows
    without an id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part; repeated rows count once. Equal vectors are one node of
    the index, with their k + 1 smallest ids, which is all that a list of k can show;
    of a vector that many rows share these are taken by slices first.
    """

    def cleaned(rows: DataFrame) -> DataFrame:
        v = F.col(vector)
        return (
            rows.where(F.col(vec_id).isNotNull())
            .where(usable(v))
            .select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"))
        )

    rows = cleaned(df).distinct().withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICE)))
    first = Window.partitionBy("vector", "slice").orderBy("id")
    every = Window.partitionBy("vector").orderBy("id")
    short = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    short = short.withColumn("r", F.row_number().over(every)).where(F.col("r") <= k + 1)
    nodes = materialise(
        short.groupBy("vector").agg(
            F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids")
        ),
        "nodes",
    )
    square = F.aggregate(
        "vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    n = nodes.count()
    shards = max(1, -(-n // SHARD_ROWS), min(BUSY_SHARDS, n // LEAST_ROWS))
    # vectors share a shard only if their lengths differ by a factor of two at most
    # (the shift keeps lengths around 1 together)
    band = F.floor(F.log2(square) / 2 + 0.25)
    dealt = nodes.select("node", "vector", F.size("vector").alias("dim"), band.alias("band"))
    # a row per band: doubles have about a thousand; its shards follow its rows alone
    bands = sorted(map(tuple, dealt.groupBy("band").count().collect()))
    numbers, count = [], 0
    for number, rows in bands:
        numbers.append((number, count, share := -(-rows * shards // n)))
        count += share
    numbers = dealt.sparkSession.createDataFrame(numbers, "band long, first long, share long")
    shard = F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("share"))
    dealt = dealt.join(F.broadcast(numbers), "band").withColumn("shard", shard)
    dealt = dealt.drop("band", "first", "share")
    shards = max(count, 1)
    graphs = materialise(build_shards(dealt, shards), "graphs")
    asked = materialise(
        cleaned(queries)
        .distinct()
        .select(F.col("id").alias("query"), F.size("vector").alias("dim"), "vector"),
        "queries",
    )
    hits = search_shards(graphs, shards, asked.select("query", "dim", "vector"), k + 1, width)
    score = F.aggregate(
        F.zip_with("vector", "asked", lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    scored = (
        hits.join(nodes, "node")
        .join(asked.select("query", F.col("vector").alias("asked")), "query")
        .select("query", score.alias("score"), F.explode("ids").alias("vec_id"))
        .where("vec_id <> query")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        scored.distinct()
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
    )
