"""Hard negatives of anchor vectors, by bounds from segment summaries.

A vector is cut into segments. Of each the mean and the deviation (the length of the
rest) are kept; the inner product of two vectors then lies within the sum over the
segments of length * mean * mean, give or take deviation * deviation. Few long
segments refute most pairs, more and shorter ones are summed only for the pairs left,
and what no level refutes is scored exactly, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from promptloom.session import materialise

SCALE = 256
LEVELS = (4, 16)  # segments, each level cuts those of the one before
BLOCK_VALUES = 1 << 20  # components in a block of rows
LEAST_ROWS = 512  # a table is not cut finer for the sake of idle cores
ANCHORS = 512
ROWS = 2048
# vectors up to this length have exact inner products in doubles
SAFE = float(1 << 26)
LIMIT = (1 << 63) - 1


def padded(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of doubles, short ones filled up with zeros, long ones cut."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    full = int(size.max(initial=0)) if width is None else width
    if len(size) and (size == full).all():
        return flat.reshape(len(size), full)
    out = np.zeros((len(size), full))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < full
    out[row[inside], at[inside]] = flat[inside]
    return out


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Means times the root of the length, then deviations, of the segments of each row."""
    edges = np.unique(np.arange(segments) * x.shape[1] // segments)
    size = np.diff(np.append(edges, x.shape[1]))
    mean = np.add.reduceat(x, edges, axis=1) / np.sqrt(size)
    rest = np.add.reduceat(x * x, edges, axis=1) - mean * mean
    return np.hstack((mean, np.sqrt(np.maximum(rest, 0.0))))


@dataclass
class Vectors:
    """Scaled vectors of a block with the summaries of every level."""

    rid: np.ndarray
    name: np.ndarray  # ids; the largest number stands for none
    named: np.ndarray
    label: np.ndarray
    x: np.ndarray  # floor(256 * component)
    raw: np.ndarray

    def __post_init__(self) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt((self.x * self.x).sum(axis=1))
            self.safe = self.norm < SAFE
        calm = np.where(self.safe[:, None], self.x, 0.0)
        self.levels = [summaries(calm, s) for s in LEVELS if s < self.x.shape[1]]
        self.calm = calm

    @classmethod
    def read(cls, batch: pa.RecordBatch, width: int | None = None) -> Vectors:
        raw = padded(batch.column("vector"), width)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * raw)
        name = batch.column("vec_id")
        return cls(
            batch.column("rid").to_numpy(),
            name.fill_null(LIMIT).to_numpy(),
            name.is_valid().to_numpy(zero_copy_only=False),
            batch.column("label").to_numpy(),
            x,
            raw,
        )

    def exactly(self, i: int) -> list[int]:
        """The scaled components of one row as integers of any size."""
        return [
            math.floor(SCALE * v) if abs(v) < 2.0**52 else SCALE * int(v)
            for v in self.raw[i].tolist()
        ]


Bounds = Callable[[], tuple[np.ndarray, np.ndarray]]
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def scored(
    anchors: Vectors, rows: Vectors, allowed: Callable[[slice], np.ndarray], bounds: Bounds
) -> Iterator[Pairs]:
    """Anchor, row and score of all pairs that may matter, part by part.

    ``allowed(part)`` marks pairs, ``bounds()`` gives the lowest and highest score
    that each anchor still needs; both are asked again for every part of the rows.
    """
    for start in range(0, len(rows.x), ROWS):
        part = slice(start, start + ROWS)
        low, high = bounds()
        ok = allowed(part) & anchors.safe[:, None] & rows.safe[None, part]
        slack = 1e-6 + 1e-9 * anchors.norm[:, None] * rows.norm[None, part]
        slack = np.where(ok, slack, 0.0)
        for one, two in zip(anchors.levels, rows.levels):
            half = one.shape[1] // 2
            own = two[part]
            if ok.sum() * 4 > ok.size:
                mean = one[:, :half] @ own[:, :half].T
                rest = one[:, half:] @ own[:, half:].T
                ok &= (mean + rest + slack >= low[:, None]) & (mean - rest - slack <= high[:, None])
                continue
            for a, r in _chunks(ok, one.shape[1]):
                mean = np.einsum("ij,ij->i", one[a, :half], own[r, :half])
                rest = np.einsum("ij,ij->i", one[a, half:], own[r, half:])
                wide = rest + slack[a, r]
                ok[a, r] = (mean + wide >= low[a]) & (mean - wide <= high[a])
        if ok.sum() * 4 > ok.size:
            a, r = np.nonzero(ok)
            yield a, r + start, (anchors.calm @ rows.calm[part].T)[a, r].astype(np.int64)
        else:
            for a, r in _chunks(ok, rows.x.shape[1]):
                found = np.einsum("ij,ij->i", anchors.calm[a], rows.calm[r + start])
                yield a, r + start, found.astype(np.int64)
    odd_rows = np.flatnonzero(~rows.safe)
    for a in range(len(anchors.x)):
        others = np.arange(len(rows.x)) if not anchors.safe[a] else odd_rows
        others = others[allowed(slice(0, len(rows.x)))[a, others]] if len(others) else others
        if len(others):
            own = anchors.exactly(a)
            total = [sum(p * q for p, q in zip(own, rows.exactly(r))) for r in others]
            score = np.array([max(-LIMIT, min(LIMIT, t)) for t in total], np.int64)
            yield np.full(len(others), a), others, score


def _chunks(ok: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The marked pairs, as many at a time as may be gathered at once."""
    a, r = np.nonzero(ok)
    step = max(1, (1 << 20) // max(width, 1))
    for at in range(0, len(a), step):
        yield a[at : at + step], r[at : at + step]


class Best:
    """The first ``k`` rows of every slot: highest score, then smallest id."""

    def __init__(self, slots: int, k: int, rows: Vectors) -> None:
        self.slots, self.k, self.rows = slots, k, rows
        self.slot = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        slot, row, score = (
            np.concatenate(p)
            for p in ((self.slot, slot), (self.row, row), (self.score, score))
        )
        rows = self.rows
        order = np.lexsort((rows.rid[row], rows.name[row], ~rows.named[row], -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < self.k
        self.slot, self.row, self.score = slot[first], row[first], score[first]

    def least(self) -> np.ndarray:
        """The score below which nothing new gets into a slot."""
        low = np.full(self.slots, -np.inf)
        count = np.bincount(self.slot, minlength=self.slots)
        last = np.cumsum(count) - 1
        full = count == self.k
        low[full] = self.score[last[full]]
        return low


def _positives(anchors: Vectors, rows: Vectors, wanted: list, k: int) -> tuple:
    best = Best(len(anchors.x), k, rows)
    every = np.full(len(anchors.x), np.inf)

    def allowed(part: slice) -> np.ndarray:
        same = anchors.label[:, None] == rows.label[None, part]
        return same & (anchors.rid[:, None] != rows.rid[None, part])

    for a, r, score in scored(anchors, rows, allowed, lambda: (best.least(), every)):
        best.add(a, r, score)
    return best.slot, best.row, best.score, np.zeros(len(best.slot), np.int64)


def _negatives(anchors: Vectors, rows: Vectors, wanted: list, k: int, window: tuple) -> tuple:
    width = max(map(len, wanted), default=0)
    goal = np.zeros((len(wanted), width), np.int64)
    real = np.zeros((len(wanted), width), bool)
    for i, own in enumerate(wanted):
        goal[i, : len(own)], real[i, : len(own)] = own, True
    low, high = _share(goal, window[0], up=True), _share(goal, window[1], up=False)
    real &= low <= high
    best = Best(goal.size, k, rows)

    def allowed(part: slice) -> np.ndarray:
        return anchors.label[:, None] != rows.label[None, part]

    def bounds() -> tuple[np.ndarray, np.ndarray]:
        least = np.maximum(best.least().reshape(goal.shape), low)
        return (
            np.where(real, least, np.inf).min(axis=1, initial=np.inf),
            np.where(real, high, -np.inf).max(axis=1, initial=-np.inf),
        )

    for a, r, score in scored(anchors, rows, allowed, bounds):
        for j in range(width):
            fits = real[a, j] & (low[a, j] <= score) & (score <= high[a, j])
            best.add(a[fits] * width + j, r[fits], score[fits])
    return best.slot // max(width, 1), best.row, best.score, goal.reshape(-1)[best.slot]


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of a score, rounded to a whole number, without leaving 64 bits."""
    whole, rest = score // 100, score % 100
    part = rest * percent
    return whole * percent + (-(-part // 100) if up else part // 100)


_TALL = "anchor long, rid long, vec_id long, score long, goal long"


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, find: Callable) -> DataFrame:
    """What ``find`` keeps of every block of rows for every anchor sent to it.

    A task holds one block of rows, of bounded size; its anchors follow batch by batch.
    """
    columns = ["block", "kind", "rid", "vec_id", "label", "vector", "wanted"]
    empty = F.lit(None).cast("array<long>")
    both = rows.withColumns({"kind": F.lit(0), "wanted": empty}).select(*columns).unionByName(
        anchors.withColumn("kind", F.lit(1)).select(*columns)
    )
    dealt = both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            split = int(np.searchsorted(kind, 1))
            if split:
                held.append(batch.slice(0, split))
            if split == len(kind) or not held and block is None:
                continue
            if block is None:
                table = pa.Table.from_batches(held).combine_chunks()
                block, held = Vectors.read(table.to_batches()[0]), []
            for at in range(split, len(kind), ANCHORS):
                some = batch.slice(at, ANCHORS)
                own = Vectors.read(some, block.x.shape[1])
                wanted = some.column("wanted").to_pylist()
                a, r, score, goal = find(own, block, wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.rid[a]),
                        pa.array(block.rid[r]),
                        pa.array(block.name[r], mask=~block.named[r]),
                        pa.array(score),
                        pa.array(goal),
                    ],
                    names=["anchor", "rid", "vec_id", "score", "goal"],
                )

    return dealt.mapInArrow(run, _TALL)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("rid")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the integer inner product of floor(256 * component). ``anchor`` is a
    condition on ``df``; an anchor's positives are its ``positives`` highest-scored other
    rows of the same label, and for each of them the first ``negatives`` rows of other
    labels come back whose score lies within ``window`` percent of the positive's.
    Equal scores are ordered by the smaller id.

    Rows without label or vector, or with a null or non-finite component, take no
    part; a row without id is a row like any other but comes last among equal scores,
    and a null ``anchor`` condition is false. Rows that repeat an id stay rows of their
    own, and an anchor is never its own positive. A shorter vector counts as filled up
    with zeros. Scores beyond 64 bits are exact inside and held at the largest number
    in the result. An empty table, or one without anchors, gives no rows.

    Rows are written in blocks of bounded size, ordered by label, so no label is one
    task; every anchor goes to the blocks of its label, then to the blocks of others.
    """
    kind = df.schema[vector].dataType.elementType
    x = F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>")
    finite = F.forall(
        x, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(math.inf), F.lit(False))
    )
    rows = materialise(
        df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(label).cast("long").alias("label"),
            x.alias("vector"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "vectors",
    )
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.size("vector")).alias("values")).first()
    idle = df.sparkSession.sparkContext.defaultParallelism
    parts = max(
        -(-(size["values"] or 0) // BLOCK_VALUES), min(idle, -(-size["rows"] // LEAST_ROWS)), 1
    )
    rows = materialise(
        rows.repartitionByRange(parts, "label", "rid").withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    asks = rows.where("is_anchor").drop("block", "is_anchor")
    places = materialise(rows.groupBy("label", "block").agg(F.count("*").alias("n")), "places")
    empty = F.lit(None).cast("array<long>")
    near = _search(
        rows,
        asks.join(places.drop("n"), "label").withColumn("wanted", empty),
        blocks,
        lambda a, r, w: _positives(a, r, w, positives),
    )
    near = materialise(_first(near, ["anchor"], positives), "positives")
    goals = near.groupBy(F.col("anchor").alias("rid")).agg(
        F.collect_set("score").alias("wanted")  # ``positives`` numbers at most
    )
    # blocks that hold other labels than the anchor's
    whole = places.groupBy("block").agg(
        F.when(F.count("*") == 1, F.max("label")).alias("only")
    )
    only = materialise(whole, "whole")
    spread = (
        asks.join(goals, "rid")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .join(only, "block")
        .where(~F.col("label").eqNullSafe(F.col("only")))
        .drop("only")
    )
    far = _search(
        rows, spread, blocks, lambda a, r, w: _negatives(a, r, w, negatives, window)
    )
    far = materialise(_first(far, ["anchor", "goal"], negatives), "negatives")
    names = asks.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = near.select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")
    )
    return (
        chosen.join(far.drop("rid"), ["anchor", "goal"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.col("goal").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
