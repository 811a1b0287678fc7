"""Packing token sequences as a cutting-stock problem.

Documents are cut into full sequences and one shorter rest. The histogram of the
rests' lengths, at most 2047 numbers, is a cutting-stock problem: a linear program
over patterns (sets of lengths that fit a sequence), whose columns are priced by
knapsack dynamic programming. Rounded patterns are then assigned to the pieces,
which are ranked within their length by distributed counts.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.llm.common import field, map_texts
from promptloom.llm.tokens import worker_encoder
from promptloom.session import materialise

LENGTH = 2048
ROUNDS = 300  # columns generated at most; the rounded result is valid after any number
GAP = 5e-4  # stop when the program is this close to its lower bound
HELD_BACK = 64
ROWS_PER_TASK = 100_000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def cut_documents(
    df: DataFrame,
    path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of every piece, ids as 32-bit bytes.

    A document's ids and ``end_id`` after them are cut into pieces of ``length``
    and a rest. A null or empty text is its end id only. One row at least per row
    of ``df``, whatever its id.
    """

    def open_():
        encode, end = worker_encoder(path), np.array([end_id], "<u4").tobytes()

        def work(texts):
            step, first, total = 4 * length, [0], []
            starts, pieces = [], []
            for text in texts:
                data = (encode(text) if text else b"") + end
                cuts = range(0, len(data), step)
                starts.extend(at // 4 for at in cuts)
                pieces.extend(data[at : at + step] for at in cuts)
                first.append(len(pieces))
                total.append(len(data) // 4)
            items = pa.StructArray.from_arrays(
                [
                    pa.array(starts, pa.int64()),
                    pa.array([len(p) // 4 for p in pieces], pa.int64()),
                    pa.array(pieces, pa.binary()),
                ],
                names=["start", "length", "ids"],
            )
            return [
                pa.array(total, pa.int64()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), items),
            ]

        return work

    fields = [
        field("doc_tokens", "long"),
        field("pieces", "array<struct<start:long,length:long,ids:binary>>"),
    ]
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = map_texts(source, "text", ["doc_id"], open_, fields, remembers=True)
    return made.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select(
        "doc_id", "p.start", "p.length", "doc_tokens", "p.ids"
    )


# --- the program, on a histogram of lengths -------------------------------------------------


def _greedy(demand: dict[int, float], size: int) -> Iterator[tuple[Pattern, list[int]]]:
    """Longest first: fill a sequence, repeat it until some of its lengths are used up.

    Yields the pattern and those lengths.
    """
    left = dict(sorted(demand.items(), reverse=True))
    lengths = list(left)
    while lengths:
        room, pattern = size, []
        for n in lengths:
            if n > room:
                continue
            often = min(room // n, max(1, int(left[n])))
            pattern.append((n, often))
            room -= n * often
        times = min(left[n] / often for n, often in pattern)
        for n, often in pattern:
            left[n] -= often * times
        gone = [n for n, _ in pattern if left[n] <= 1e-9 * max(1.0, demand[n])]
        for n in gone:
            del left[n]
        yield tuple(pattern), gone
        lengths = [n for n in lengths if n in left]


def _knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[Pattern, float]:
    """The most valuable pattern, any length any number of times."""
    use = worth > 1e-12
    lengths, worth = lengths[use], worth[use]
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    bound = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        best[room], pick[room] = best[room - 1], -1
        k = bound[room]
        if k:
            value = worth[:k] + best[room - lengths[:k]]
            at = int(value.argmax())
            if value[at] > best[room] + 1e-15:
                best[room], pick[room] = value[at], at
    room, taken = size, Counter()
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            taken[int(lengths[pick[room]])] += 1
            room -= int(lengths[pick[room]])
    return tuple(sorted(taken.items(), reverse=True)), float(best[size])


def solve(histogram: dict[int, int], size: int = LENGTH, rounds: int = ROUNDS) -> Counter:
    """How often each pattern is used; every piece of the histogram is in one pattern.

    The greedy patterns, each of which uses up one length, are the first basis.
    A column enters while a pattern is worth more than one sequence at the current
    dual prices. The uses are rounded down, those of loosely filled patterns by some
    more; what that leaves, a bounded number per pattern, is packed best fit.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(n)] for n in lengths], float)
    m = len(lengths)
    if not m:
        return Counter()
    place = {int(n): i for i, n in enumerate(lengths)}

    def column(pattern: Pattern) -> np.ndarray:
        out = np.zeros(m)
        for n, often in pattern:
            out[place[n]] = often
        return out

    # a pattern holds only lengths that are used up with it or later, so the basis is
    # triangular; lengths that end together with another have a pattern of their own
    basis: list[Pattern] = []
    for pattern, gone in _greedy({int(n): float(d) for n, d in zip(lengths, demand)}, size):
        basis += [pattern, *(((n, 1),) for n in gone[1:])]
    matrix = np.array([column(p) for p in basis]).T
    inverse = np.linalg.inv(matrix)
    amount = inverse @ demand
    floor = float(lengths @ demand) / size
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        total = float(amount.sum())
        if total <= floor * (1 + GAP):
            break
        pattern, value = _knapsack(lengths, price, size)
        if value <= 1 + 1e-9 or total * (1 - 1 / value) <= GAP * total:
            break
        change = inverse @ column(pattern)
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(amount[up], 0.0) / change[up]
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        basis[out] = pattern

    uses: Counter = Counter()
    rest = {int(n): int(d) for n, d in zip(lengths, demand)}
    for pattern, times in sorted(zip(basis, amount), key=lambda x: -x[1]):
        whole = int(np.floor(times + 1e-6))
        whole = min([whole, *(rest[n] // often for n, often in pattern)])
        if sum(n * often for n, often in pattern) < 0.99 * size:
            # pieces of loose patterns may fit better with what rounding leaves
            whole -= HELD_BACK
        if whole > 0:
            uses[pattern] += whole
            for n, often in pattern:
                rest[n] -= often * whole
    uses.update(_best_fit(rest, size))
    return uses


def _best_fit(rest: dict[int, int], size: int) -> Counter:
    """Longest first, each into the fullest sequence that has room."""
    rooms: list[int] = []
    held: list[list[Counter]] = []
    for n in sorted(rest, reverse=True):
        for _ in range(rest[n]):
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                room, own = size, Counter()
            else:
                room, own = rooms[at], held[at].pop()
                if not held[at]:
                    del rooms[at], held[at]
            own[n] += 1
            room -= n
            at = bisect.bisect_left(rooms, room)
            if at < len(rooms) and rooms[at] == room:
                held[at].append(own)
            else:
                rooms.insert(at, room)
                held.insert(at, [own])
    return Counter(
        tuple(sorted(own.items(), reverse=True)) for group in held for own in group
    )


def layout(uses: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``length, rank, until, sequence, offset, often``.

    The pieces of ``length`` with ranks from ``rank`` to before ``until`` go, ``often``
    of them to a sequence, into sequences from ``sequence`` on, from ``offset`` on.
    There are at most 63 runs per pattern, for so many lengths fit a sequence.
    """
    ranks: Counter = Counter()
    runs, sequence = [], 0
    for pattern, times in sorted(uses.items(), reverse=True):
        offset = 0
        for n, often in pattern:
            runs.append((n, ranks[n], ranks[n] + often * times, sequence, offset, often))
            ranks[n] += often * times
            offset += n * often
        sequence += times
    return runs


# --- on tables --------------------------------------------------------------------------------


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` and ``rank``, from 0 without gaps within each length.

    A length may belong to much of the data, so pieces are ranked in slices by hash
    and the counts of earlier slices are added; the number of slices follows the
    number of pieces.
    """
    slices = 16
    while slices * ROWS_PER_TASK < 16 * pieces.count():
        slices *= 2
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("_slice")
    counts = (
        cut.groupBy("length", "_slice")
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("_rows")
    )
    own = Window.partitionBy("length", "_slice").orderBy(
        *[c for c in pieces.columns if c != "length"]
    )
    return (
        cut.withColumn("_own", F.row_number().over(own) - 1)
        .join(counts, ["length", "_slice"])
        .withColumn("rank", F.col("_before") + F.col("_own"))
        .drop("_slice", "_own", "_before")
    )


def pack(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """``pieces`` (with ``doc_id, start, length``) and ``sequence_id, offset``.

    Pieces must be no longer than ``size``. Pieces without an id and repeated rows
    are pieces like others. An empty table gives an empty result. ``pieces`` should
    be a written table, for it is read three times. Only the histogram of lengths
    reaches the driver.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in counts}
    if any(not 0 < n <= size for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    # full sequences need no program
    full = histogram.pop(size, 0)
    uses = solve(histogram, size)
    if full:
        uses[((size, 1),)] = full
    schema = "length long, low long, high long, sequence long, base long, often long"
    runs = spark.createDataFrame(layout(uses), schema)
    within = F.col("rank") - F.col("low")
    return (
        ranked(pieces)
        # at most 63 runs for each of at most 2 * 2047 patterns
        .join(F.broadcast(runs), "length")
        .where("rank >= low AND rank < high")
        .withColumn("sequence_id", F.col("sequence") + F.floor(within / F.col("often")))
        .withColumn("offset", F.col("base") + within % F.col("often") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id, n_tokens, ids`` of packed pieces that carry their ids."""
    part = F.struct("offset", F.col(ids).alias("ids"))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate(
                "parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])
            ).alias("ids"),
        )
    )


def pack_documents(
    df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of the documents with their place and a checksum of their ids.

    The ids themselves are not written; ``cut_documents`` yields them again, and
    ``sequences`` puts them together.
    """
    pieces = cut_documents(df, path, end_id, doc_id, text)
    kept = materialise(
        pieces.select(
            "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
        ),
        "pieces",
    )
    return pack(kept)
