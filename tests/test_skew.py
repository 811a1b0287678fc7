"""Hot keys: the spread forms give the rows of the plain ones."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.operators.chat import (
    chunk_delta,
    chunk_sample,
    history_before_last,
    session_gate,
    side_by_side,
)
from promptloom.operators.pairing import number_occurrences, template_lookup
from promptloom.operators.resume import skip_done
from promptloom.operators.skew import added, find_hot_keys, join_spread, later_of, running
from promptloom.streaming.admit import gate, loads_by_slot

N = 3000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has key 0, another sixth key 1."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 6 == 1, 1).otherwise(F.col("id"))
    return spark.range(N).select(
        "id", key.cast("int").alias("k"), (F.hash("id") % 100).alias("v")
    ).cache()


def test_hot_keys_are_the_large_ones(skewed):
    hot = find_hot_keys(skewed, ["k"], 100)
    assert sorted(r["_shares"] for r in hot.table.collect()) == [8, 16]
    assert not find_hot_keys(skewed, ["k"], N)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_spread(spark, skewed, how):
    right = spark.createDataFrame([(0, "a"), (5, "c")], "k int, name string")
    hot = find_hot_keys(skewed, ["k"], 100)
    spread = join_spread(skewed, right, ["k"], how, ["id"], hot)
    plain = skewed.join(right, ["k"], how)
    assert spread.columns == plain.columns
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_join_spread_splits_the_hot_key(spark, skewed):
    right = spark.createDataFrame([(0, "a")], "k int, name string")
    hot = find_hot_keys(skewed, ["k"], 100)
    keyed = hot.marked(skewed).withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_shares")))
    largest = keyed.groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 200
    assert join_spread(skewed, right, ["k"], "inner", ["id"], hot).count() == N // 3


def test_full_outer_cannot_be_salted(skewed):
    with pytest.raises(ValueError):
        join_spread(skewed, skewed, ["k"], "full_outer", ["id"], find_hot_keys(skewed, ["k"], 100))


@pytest.mark.parametrize("preceding", [False, True])
@pytest.mark.parametrize(
    "func,combine", [(F.max, later_of), (F.sum, added), (F.count, added)], ids=["max", "sum", "count"]
)
def test_running(skewed, func, combine, preceding):
    hot = find_hot_keys(skewed, ["k"], 100)
    spread = running(
        skewed, ["k"], ["id"], "x", func, F.col("v"), combine, hot, preceding
    )
    last = -1 if preceding else 0
    window = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, last)
    plain = skewed.withColumn("x", func(F.col("v")).over(window))
    if func is F.sum and preceding:
        plain = plain.withColumn("x", F.coalesce("x", F.lit(0)))
        spread = spread.withColumn("x", F.coalesce("x", F.lit(0)))
    assert rows(spread.select("id", "x").fillna(-1)) == rows(plain.select("id", "x").fillna(-1))


def test_running_with_clustered_order(spark):
    """Most rows of the hot key lie in a narrow range of the order column."""
    at = F.when(F.col("id") < 2900, F.col("id")).otherwise(F.col("id") * 1_000_000)
    df = spark.range(N).select(F.lit(0).alias("k"), at.alias("at"))
    counted = running(
        df, ["k"], ["at"], "x", F.count, F.lit(1), added, find_hot_keys(df, ["k"], 100)
    )
    assert [r["x"] for r in counted.orderBy("at").collect()] == list(range(1, N + 1))


def test_operators_on_a_hot_text(spark):
    text = F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("q"), F.col("id") % 50))
    asked = spark.range(800).select(
        F.col("id").alias("request_id"), text.alias("request"), F.lit("a").alias("response")
    ).cache()
    done = spark.createDataFrame([("same",), ("q7",), ("q7",)], "request string")
    assert rows(skip_done(asked, done, rows_per_task=50)) == rows(skip_done(asked, done))
    assert skip_done(asked, done, rows_per_task=50).where("request = 'same'").count() == 0

    spread = number_occurrences(asked, rows_per_task=50)
    assert rows(spread.select("request_id", "occurrence")) == rows(
        number_occurrences(asked).select("request_id", "occurrence")
    )

    categories = asked.select("request").distinct().withColumn("category", F.lit("odd"))
    templates = spark.createDataFrame(
        [("general", "p", "t")], "category string, prompt string, prompt_template string"
    )
    found = template_lookup(asked, categories, templates, rows_per_task=50)
    assert found.where("prompt = 'p' AND category = 'odd'").count() == 800


def test_operators_on_one_long_stream(spark):
    chunks = spark.range(600).select(
        F.when(F.col("id") < 400, 1).otherwise(2).cast("long").alias("request_id"),
        F.when(F.col("id") < 400, F.col("id")).otherwise(F.col("id") - 400).cast("int").alias("seq"),
        F.array_join(F.sequence(F.lit(0), F.col("id").cast("int")), " ").alias("text"),
        F.lit(0).alias("error_code"),
    ).withColumns({"stage": F.lit("outline"), "point_index": F.lit(0)}).cache()

    def text(r):
        return sorted(map(str, r.collect()))

    assert text(chunk_delta(chunks, rows_per_task=50)) == text(chunk_delta(chunks))
    assert text(chunk_sample(chunks, rows_per_task=50)) == text(chunk_sample(chunks))
    short = chunks.where("seq < 100")
    assert text(side_by_side(chunks, short, rows_per_task=50)) == text(side_by_side(chunks, short))
    turns = chunks.select(F.col("request_id").alias("conv_id"), F.col("seq").alias("turn"), "text")
    assert text(history_before_last(turns, rows_per_task=50)) == text(history_before_last(turns))
    assert history_before_last(turns).count() == 598


def test_sessions_of_a_busy_ip(spark):
    events = spark.range(2000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 10).cast("long").alias("ip"),
        F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(100_000))).alias("ts"),
        (F.col("id") % 40 == 0).alias("is_load"),
    ).cache()
    plain = session_gate(events, 3600)
    spread = session_gate(events, 3600, rows_per_task=100)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.select(*spread.columns).collect()))
    # the two lookups by slot decide the same as the running maximum
    length = 3600 * 1_000_000
    by_slot = gate(events.where(~F.col("is_load")), loads_by_slot(events, length), length, 20)
    assert rows(by_slot.select("event_id", "active")) == rows(plain.select("event_id", "active"))
    assert {r["active"] for r in plain.collect()} == {True, False}


@pytest.mark.parametrize("kind", ["long", "string", "timestamp_ntz"])
def test_running_is_the_same_for_odd_keys_and_orders(spark, kind):
    """Null keys, null order values, other types and many hot keys in disjoint ranges."""
    key = F.when(F.col("id") % 5 == 0, None).otherwise(F.floor(F.col("id") / 100)).cast("int")
    at = F.when(F.col("id") % 17 == 0, None).otherwise(F.col("id"))
    typed = {
        "long": at,
        "string": F.concat(F.lit("r"), F.lpad(at.cast("string"), 6, "0")),
        "timestamp_ntz": F.timestamp_seconds(at).cast("timestamp_ntz"),
    }[kind]
    df = spark.range(N).select("id", key.alias("k"), typed.alias("at")).cache()
    for func in (F.count, F.sum):
        value = F.lit(1) if func is F.count else F.col("id")
        told = [
            running(
                df, ["k"], ["at", "id"], "x", func, value, added, find_hot_keys(df, ["k"], limit)
            )
            for limit in (3, 10**9)
        ]
        assert rows(told[0].select("id", "x")) == rows(told[1].select("id", "x"))


def test_no_range_is_too_large(spark):
    df = spark.range(N).select("id", (F.col("id") % 2).alias("k"))
    hot = find_hot_keys(df, ["k"], 100)
    assert hot.rows == N and hot.rows_per_task == 100
