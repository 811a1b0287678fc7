"""Near duplicates by SetSketch registers.

A text is the set of its distinct 5-word shingles. Its sketch has 128 registers:
register i holds the smallest of exponential values that the shingles draw for it,
on an exponentially spaced scale, truncated to 16 bits. Sketches of parts merge by
maximum, and registers of two texts agree about as often as their sets are similar.
Four neighbouring registers make one of 32 bands; texts that agree on a band are
candidates. A pair at similarity 0.75 shares no band with probability 5e-6. The
registers of candidates are compared by likelihood given the known set sizes,
unlikely pairs go, and the others are verified on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import WordHashes, field, map_texts, mix, shingle_sets
from promptloom.llm.components import components
from promptloom.session import materialise

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1

WORDS = 5
PERCENT = 75
# five standard deviations of the estimate below the limit
LEAST_ESTIMATE = 0.56

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sketches(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of every set, as one row of 16-bit numbers each.

    Every shingle is the seed of a Poisson process of points, each of which falls
    into a random register; the points come in rising order, so a shingle is done
    as soon as its next point lies above all minima of its set.
    """
    sets = len(first) - 1
    low = np.full((sets, REGISTERS), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(first))
    seed, point = shingles.copy(), np.zeros(len(shingles))
    flat = low.reshape(-1)
    while len(seed):
        seed = seed + _GOLDEN
        drawn = mix(seed)
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        point = point - np.log(uniform) / REGISTERS
        register = (mix(drawn ^ _GOLDEN) & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(flat, owner * REGISTERS + register, point)
        alive = point < low.max(axis=1)[owner]
        seed, point, owner = seed[alive], point[alive], owner[alive]
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(low / RATE) / np.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0.0), 0, TOP).astype(np.uint16)


def _collision(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)


def estimate(
    left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray
) -> np.ndarray:
    """Similarity of two sets each, by maximum likelihood from registers and sizes.

    Counts of registers that are larger left, larger right and equal are draws with
    probabilities that depend on the similarity and on the known sizes only. The
    likelihood has one peak; it is found by golden sections.
    """
    more = (left > right).sum(axis=1).astype(np.float64)
    less = (left < right).sum(axis=1).astype(np.float64)
    same = REGISTERS - more - less
    u = n_left / (n_left + n_right)
    v = 1.0 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _collision(u - v * j), _collision(v - u * j)
        tiny = 1e-12
        return (
            more * np.log(np.maximum(up, tiny))
            + less * np.log(np.maximum(down, tiny))
            + same * np.log(np.maximum(1.0 - up - down, tiny))
        )

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5.0) - 1.0) / 2.0
    for _ in range(24):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        rise = likelihood(a) < likelihood(b)
        low, high = np.where(rise, a, low), np.where(rise, high, b)
    return (low + high) / 2.0


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, hi, lo, bands``: size, 128-bit digest and sketch of each row's shingle set."""

    def open_():
        hashes = WordHashes()

        def work(texts):
            shingles, first = shingle_sets(*hashes(texts), WORDS)
            n = np.diff(first)
            sums = []
            for salt in (np.uint64(1), _GOLDEN):
                total = np.concatenate(
                    (np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ salt), dtype=np.uint64))
                )
                sums.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)))
            bands = sketches(shingles, first).view("<i8")
            width = REGISTERS // BAND
            offsets = np.arange(0, bands.size + 1, width, dtype=np.int32)
            return [
                pa.array(n, pa.int64()),
                pa.array(sums[0].view(np.int64)),
                pa.array(sums[1].view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1))),
            ]

        return work

    fields = [field("n", "long"), field("hi", "long"), field("lo", "long")]
    fields.append(field("bands", "array<long>"))
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_texts(source, "text", ["id"], open_, fields)


def full_sets(df: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``id, shingles`` of the documents whose id is in ``wanted``."""

    def open_():
        hashes = WordHashes()

        def work(texts):
            shingles, first = shingle_sets(*hashes(texts), WORDS)
            values = pa.array(shingles.view(np.int64))
            return [pa.ListArray.from_arrays(first.astype(np.int32), values)]

        return work

    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    chosen = source.join(wanted.select("id"), "id", "left_semi")
    return map_texts(chosen, "text", ["id"], open_, [field("shingles", "array<long>")])


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow a link and whose estimate does not speak against it."""
    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bands").alias("s_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("s_b"))
    both = (
        pairs.select("a", "b")
        .join(one, "a")
        .join(two, "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    )

    def test(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            left, right = (
                batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS)
                for c in ("s_a", "s_b")
            )
            likely = estimate(left, right, n_a, n_b) >= LEAST_ESTIMATE if len(n_a) else n_a > 0
            part = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            )
            yield part.filter(pa.array(likely))

    return both.mapInArrow(test, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= 75 * union."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .where(common * 100 >= (F.size("x") + F.size("y") - common) * PERCENT)
        .select("a", "b")
    )


def _across(
    members: DataFrame, label: DataFrame, nodes: DataFrame, sets: DataFrame, hubs: DataFrame
) -> DataFrame:
    """Pairs ``a, b`` that share a bucket, not a component, and that a bound cannot refute.

    For a class of n shingles, c of which occur in a class of another component at
    all, a link to a class of m shingles needs (100 + 75) * c >= 75 * (n + m). Of what
    is left, only classes outside a bucket's commonest component are compared with
    the bucket, so a large component is never compared with itself. Two classes share
    at most the shingles of the bucket's hub that both have, and of the others as many
    as the one with fewer of them has.
    """
    bucket = ["band", "key"]
    tagged = materialise(
        members.select("band", "key", "id")
        .join(label.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id")),
        "tagged",
    )
    mixed = _mixed(tagged)
    if mixed.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    inside = materialise(tagged.join(mixed, bucket), "inside")
    who = materialise(inside.select("id", "component").distinct(), "who")
    spread = who.join(sets, "id").select("id", "component", F.explode("shingles").alias("s"))
    useful = materialise(
        spread.groupBy("s")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("s"),
        "useful",
    )
    met = materialise(
        spread.join(useful, "s").groupBy("id").agg(F.collect_list("s").alias("met")), "met"
    )
    common = met.select("id", F.size("met").cast("long").alias("c"))
    sized = common.join(nodes.select("id", "n"), "id").where(
        F.col("c") * 100 >= F.col("n") * PERCENT
    )
    able = materialise(inside.join(sized, "id"), "able")
    able = materialise(
        able.join(_mixed(able, F.min("n").alias("least")), bucket)
        .where(F.col("c") * (100 + PERCENT) >= (F.col("n") + F.col("least")) * PERCENT)
        .drop("least"),
        "able",
    )
    major = materialise(
        able.groupBy("band", "key", "component")
        .agg(F.count("*").alias("rows"))
        .groupBy("band", "key")
        .agg(F.max(F.struct("rows", "component"))["component"].alias("major")),
        "major",
    )
    strays = materialise(
        able.join(major, bucket)
        .where("component <> major")
        .select(
            *bucket, "major", *[F.col(x).alias(f"{x}_s") for x in ("id", "component", "n", "c")]
        ),
        "strays",
    )
    strays = strays.join(_at_home(strays, who, sets), "id_s", "left")
    able = able.join(strays.select(*bucket).distinct(), bucket, "left_semi").join(hubs, bucket)
    able = materialise(able, "able")
    sketch = nodes.select("id", "bands")
    able = able.join(_on_hub(able.select("id", "hub").distinct(), met, sets), ["id", "hub"])
    able = materialise(able.join(sketch, "id"), "able")
    own = able.select(
        *bucket, *[F.col(x).alias(f"{x}_s") for x in ("id", "on_hub", "off_hub", "bands")]
    )
    strays = materialise(strays.join(own, [*bucket, "id_s"]), "strays")
    common = F.when(F.col("component") == F.col("home"), F.coalesce("c_home", F.lit(0)))
    common = F.least("c", "c_s", F.coalesce(common, "c_s"))
    needed = (F.col("n") + F.col("n_s")) * PERCENT
    possible = common * (100 + PERCENT) >= needed
    both = F.aggregate(
        F.zip_with("on_hub", "on_hub_s", lambda x, y: F.bit_count(x.bitwiseAND(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    sharper = (both + F.least("off_hub", "off_hub_s")) * (100 + PERCENT) >= needed
    # a pair counts in the first band that it shares
    agree = F.zip_with("bands", "bands_s", lambda x, y: x == y)
    first = F.array_position(agree, F.lit(True)) == F.col("band") + 1
    return materialise(
        strays.join(able, bucket)
        .where((F.col("component") != F.col("component_s")) & possible & first & sharper)
        .where("component = major OR id_s < id")
        .select(F.least("id", "id_s").alias("a"), F.greatest("id", "id_s").alias("b"))
        .distinct(),
        "across",
    )


def _on_hub(pairs: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """``id, hub, on_hub, off_hub``: which of the hub's shingles are among the class's ``met``
    ones, a bit each, and how many ``met`` ones the hub lacks."""

    def mark(batches):
        for batch in batches:
            found, off = [], []
            for own, hub in zip(batch.column("met"), batch.column("shingles")):
                own, hub = (x.values.to_numpy() for x in (own, hub))
                bits = np.isin(hub, own)
                off.append(len(own) - int(bits.sum()))
                bits = np.concatenate((bits, np.zeros(-len(bits) % 64, bool)))
                found.append(np.packbits(bits).view("<i8"))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            marks = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("hub"),
                    pa.ListArray.from_arrays(offsets, pa.array(marks)),
                    pa.array(off, pa.int64()),
                ],
                names=["id", "hub", "on_hub", "off_hub"],
            )

    both = pairs.join(met, "id").join(sets.withColumnRenamed("id", "hub"), "hub")
    return both.select("id", "hub", "met", "shingles").mapInArrow(
        mark, "id long, hub long, on_hub array<long>, off_hub long"
    )


def _at_home(strays: DataFrame, who: DataFrame, sets: DataFrame) -> DataFrame:
    """``id_s, home, c_home``: of the component that a stray meets most, how many of its
    shingles occur there; a sharper bound for most of its pairs."""
    homes = materialise(
        strays.groupBy("id_s", "major")
        .agg(F.count("*").alias("rows"))
        .groupBy("id_s")
        .agg(F.max(F.struct("rows", "major"))["major"].alias("home")),
        "homes",
    )
    shingles = sets.select("id", F.explode("shingles").alias("s"))
    owned = materialise(
        who.join(homes.select(F.col("home").alias("component")).distinct(), "component")
        .join(shingles, "id")
        .select(F.col("component").alias("home"), "s")
        .distinct(),
        "owned",
    )
    met = homes.join(shingles.withColumnRenamed("id", "id_s"), "id_s").join(owned, ["home", "s"])
    count = met.groupBy("id_s").agg(F.count("*").alias("c_home"))
    return materialise(homes.join(count, "id_s", "left"), "home_counts")


def _mixed(tagged: DataFrame, *more) -> DataFrame:
    """Buckets whose members are in two components or more."""
    both = tagged.groupBy("band", "key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), *more
    )
    return materialise(both.where("low <> high").drop("low", "high"), "mixed")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``df``.

    Rows with equal sets are one class, whatever their number; its smallest id
    stands for it. Within a band's bucket the classes are first compared with the
    bucket's hub, the class that shares most buckets, never all with all. Pairs in
    one component need no further test. For the others a bound is computed first:
    the shingles of a class that any class of another component has at all. Pairs
    that this bound cannot refute are then compared.

    A null or empty text, or one without words, links with nothing and is its own
    component. A row with a null id takes no part: its component is null and it is
    kept. Rows that repeat an id and text share their component; with one id on
    several texts those texts count as linked where the id stands for them.
    """
    prints = materialise(fingerprints(df, doc_id, text), "prints")
    nodes = materialise(
        prints.where("id IS NOT NULL AND n > 0")
        .groupBy("hi", "lo")
        .agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    single = nodes.select("id", "n", "bands")
    banded = single.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = materialise(
        banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    members = materialise(banded.join(buckets, ["band", "key"]), "members")
    shared = materialise(members.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    weighed = members.join(shared, "id")
    hubs = materialise(
        weighed.groupBy("band", "key")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
        .select("band", "key", (-F.col("top.minus")).alias("hub")),
        "hubs",
    )
    stars = materialise(
        members.join(hubs, ["band", "key"])
        .where("id <> hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct(),
        "stars",
    )
    sets = full_sets(df, doc_id, text, shared)
    if not prints.groupBy("id").count().where("count > 1").isEmpty():
        sets = sets.groupBy("id", F.xxhash64("shingles")).agg(
            F.any_value("shingles").alias("shingles")
        )
    sets = materialise(sets.select("id", "shingles"), "sets")
    likely = materialise(_likely(stars, single), "likely")
    links = materialise(_verified(likely, sets), "links")
    label = components(links)
    rest = _across(members, label, single, sets, hubs).join(stars, ["a", "b"], "left_anti")
    if not rest.isEmpty():
        more = materialise(_verified(materialise(_likely(rest, single), "likely"), sets), "links")
        label = components(links.union(more))
    classes = materialise(
        nodes.join(label.withColumnRenamed("node", "id"), "id", "left").select(
            "hi", "lo", F.coalesce("component", "id").alias("component")
        ),
        "classes",
    )
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return (
        prints.select("id", "n", "hi", "lo")
        .join(classes, ["hi", "lo"], "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )
