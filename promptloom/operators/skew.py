"""Joins and running values that survive a key holding much of the data.

A key counts as hot when it has more rows than one task should take. Hot keys
are found by hash, so the shuffle of the count is 16 bytes per distinct key and
two keys with one hash are merely both spread. They stay a table, however many
there are; with no hot key the plan is the plain join or window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.session import materialise

ROWS_PER_TASK = 500_000
# so many hot keys are held by the plan itself, more become a written table
FEW = 1000


@dataclass(frozen=True)
class HotKeys:
    """``table``: hash of a hot key, ``_hash``, and over how many tasks its rows go, ``_shares``."""

    keys: tuple[str, ...]
    table: DataFrame
    rows: int
    rows_per_task: int

    def __bool__(self) -> bool:
        return self.rows > 0

    def marked(self, df: DataFrame) -> DataFrame:
        """``df`` and ``_shares``, 1 for keys that are not hot."""
        return (
            df.withColumn("_hash", F.xxhash64(*self.keys))
            .join(self.table, "_hash", "left")
            .withColumn("_shares", F.coalesce("_shares", F.lit(1)))
            .drop("_hash")
        )


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> HotKeys:
    """Count rows per key hash (combined before the shuffle), keep the large ones.

    One job, and nothing is written, unless there are more than ``FEW`` hot keys.
    """
    shares = F.pow(F.lit(2), F.ceil(F.log2(F.col("count") / rows_per_task))).cast("int")
    found = (
        df.groupBy(F.xxhash64(*keys).alias("_hash"))
        .count()
        .where(F.col("count") > rows_per_task)
        .select("_hash", shares.alias("_shares"), "count")
    )
    some = found.limit(FEW + 1).collect()
    if len(some) <= FEW:
        rows = sum(r["count"] for r in some)
        kept = [(r["_hash"], r["_shares"]) for r in some]
        table = df.sparkSession.createDataFrame(kept, "_hash long, _shares int")
        return HotKeys(tuple(keys), table, rows, rows_per_task)
    found = materialise(found, "hot")
    rows = found.agg(F.sum("count")).first()[0]
    return HotKeys(tuple(keys), found.drop("count"), rows, rows_per_task)


def join_spread(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    row_key: Sequence[str],
    hot: HotKeys,
) -> DataFrame:
    """Equi join (inner, left, left_semi, left_anti) with hot left keys salted.

    ``hot`` holds the hot values of ``on`` in ``left``. ``row_key`` names left
    columns that tell the rows of one key apart; the salt is computed from
    them, so a repeated task yields the same rows. Only the right rows of hot
    keys are copied, once per salt.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"cannot salt a {how} join")
    if not hot:
        return left.join(right, list(on), how)
    salt = F.pmod(F.xxhash64(*row_key), F.col("_shares")).cast("int")
    left = hot.marked(left).withColumn("_salt", salt).drop("_shares")
    copies = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))
    right = hot.marked(right).withColumn("_salt", copies).drop("_shares")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    func: Callable[[Column], Column],
    value: Column,
    combine: Callable[[Column, Column], Column],
    hot: HotKeys,
    preceding_only: bool = False,
) -> DataFrame:
    """Running ``func(value)`` per key in ``order``; ``func`` is a max, min, sum or count.

    Without ``hot`` values of ``keys`` this is one window. Rows of hot keys are
    dealt by ranges of the keys and the whole order, whatever their types and with
    nulls first as in a window; each range gets the combined value of the key's
    ranges before it and a window of its own. Rows equal in ``order`` may lie in
    two ranges. ``combine(carried, local)`` joins the two; either may be null.
    """
    last = -1 if preceding_only else Window.currentRow
    whole = Window.partitionBy(*keys).orderBy(*order)
    plain = func(value).over(whole.rowsBetween(Window.unboundedPreceding, last))
    if not hot:
        return df.withColumn(name, plain)

    marked = hot.marked(df)
    usual = marked.where("_shares = 1").drop("_shares").withColumn(name, plain)
    tie = F.xxhash64(*[c for c in df.columns if not _is_map(df, c)])
    cut = materialise(
        marked.where("_shares > 1")
        .drop("_shares")
        .withColumn("_value", value)
        .repartitionByRange(-(-4 * hot.rows // hot.rows_per_task), *keys, *order, tie)
        .withColumn("_bucket", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(*keys).orderBy("_bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_bucket")
        .agg(func(F.col("_value")).alias("_part"))
        .select(
            *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
            F.col("_bucket").alias("_of"),
            _fold(func, F.col("_part")).over(before).alias("_carry"),
        )
    )
    same = F.col("_bucket") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, last)
    spread = (
        cut.join(carried, same)
        .withColumn("_local", func(F.col("_value")).over(local))
        .withColumn(name, combine(F.col("_carry"), F.col("_local")))
    )
    return usual.unionByName(spread.select(*usual.columns))


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def _fold(func: Callable[[Column], Column], part: Column) -> Column:
    """Partial counts are summed, everything else is folded by itself."""
    return F.sum(part) if func is F.count else func(part)


def later_of(carried: Column, local: Column) -> Column:
    return F.greatest(carried, local)


def added(carried: Column, local: Column) -> Column:
    """Null only where there is nothing on either side, as in a plain window."""
    return F.coalesce(carried + local, carried, local)
