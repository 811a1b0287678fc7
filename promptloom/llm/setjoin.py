"""Exact Jaccard join of word-shingle sets that skips by relations between sets.

Index lists hold, per shingle, the sets that have it among their first ones in one
order of all shingles (rare ones first). Two sets that link share such a shingle. A
list is cut into blocks of like size, position and component with a summary of each;
a set skips every block whose summary rules out a link.

Where a set does meet a block, it is compared with the head of that component, one
set. If the two do not link, the set's answers in the component are derived from the
head's: every member is known by its difference from the head, and the overlap of two
sets follows from their differences alone,

    |x & z| = |h| - |h-x| - |h-z| + |D(x) & D(z)|,  D(s) = shingles of s or h, not both

so only members whose differences share enough with those of x are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import (
    KeyFilter,
    WordHashes,
    field,
    map_texts,
    mix,
    shingle_sets,
    slices,
    small_batches,
)
from promptloom.llm.components import components
from promptloom.session import materialise

WORDS = 3
# a link has 100 * intersection >= 90 * union, that is 19 * intersection >= 9 * (sum of sizes)
# shingles are ordered by the rows that have one of the same slot; a fixed number of slots
SLOTS = 1 << 18
# base of the size cells; above 10 / 9, so that linked sets are a cell apart at most
CELL = 1.12
# sets below this size link only with equal sets
LEAST = 9

_SALT = np.uint64(0x9E3779B97F4A7C15)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ _SALT) & np.uint64(SLOTS - 1)).astype(np.int64)


def shingle_levels(df: DataFrame, text: str) -> np.ndarray:
    """For each slot a level that rises with the number of rows that have a shingle in it.

    Any fixed order of shingles gives the same links; this one keeps passages that
    many texts share out of the index lists. Counts cover all rows; what reaches the
    driver is one number per slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count = WordHashes(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                texts = batch.column("text").slice(start, stop - start).to_pylist()
                count += np.bincount(
                    _slot(shingle_sets(*hashes(texts), WORDS)[0]), minlength=SLOTS
                )
        used = np.flatnonzero(count)
        for at in range(0, len(used), 1 << 16):
            own = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(count[own])], names=["slot", "n"]
            )

    small_batches(df.sparkSession)
    told = (
        df.select(F.col(text).alias("text"))
        .mapInArrow(run, "slot long, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    level = np.zeros(SLOTS, np.uint8)
    rows = told.column("n").to_numpy().astype(np.float64)
    level[told.column("slot").to_numpy()] = np.floor(4 * np.log2(1 + rows)).astype(np.uint8)
    return level


def _digests(shingles: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """128 bits that tell sets apart."""
    out = []
    for salt in (np.uint64(1), _SALT):
        total = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ salt), dtype=np.uint64))
        )
        own = total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)
        out.append(pa.array(mix(own).view(np.int64)))
    return out


def prints(df: DataFrame, doc_id: str, text: str, level: np.ndarray) -> DataFrame:
    """``id, n, hi, lo, head``: size and digest of each row's set, and its first shingles.

    So many that two linked sets have one in common: n - ceil(0.9 * n) + 1.
    """
    known = df.sparkSession.sparkContext.broadcast(level)

    def open_():
        hashes, level = WordHashes(), known.value

        def work(texts):
            shingles, first = shingle_sets(*hashes(texts), WORDS)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((shingles, level[_slot(shingles)], owner))
            many = np.where(n >= LEAST, n - (9 * n + 9) // 10 + 1, 0)
            place = np.arange(len(owner)) - first[:-1][owner]
            chosen = shingles[order][place < many[owner]]
            offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
            heads = pa.ListArray.from_arrays(offsets, pa.array(chosen.view(np.int64)))
            return [pa.array(n, pa.int64()), *_digests(shingles, first), heads]

        return work

    fields = [field(c, "long") for c in ("n", "hi", "lo")] + [field("head", "array<long>")]
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_texts(source, "text", ["id"], open_, fields)


def _remade(
    df: DataFrame,
    doc_id: str,
    text: str,
    wanted: DataFrame,
    once: bool,
    make: Callable[[np.ndarray, np.ndarray], list[pa.Array]],
    fields: dict[str, str],
) -> DataFrame:
    """``node`` and what ``make`` tells of the sets of the wanted nodes ``id, hi, lo, node``.

    The rows are picked by a filter of ids where the texts are read, so no text is
    shuffled; what the filter lets through by mistake has another digest. ``once`` says
    that no id is on two rows.
    """
    ids = KeyFilter.of(wanted.select(F.xxhash64("id").alias("key"))).words
    known = df.sparkSession.sparkContext.broadcast(ids)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, passes = WordHashes(), KeyFilter(known.value)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            picked = batch.filter(pa.array(passes(keys)))
            for start, stop in slices(picked.column("text")):
                texts = picked.column("text").slice(start, stop - start).to_pylist()
                shingles, first = shingle_sets(*hashes(texts), WORDS)
                yield pa.RecordBatch.from_arrays(
                    [*_digests(shingles, first), *make(shingles, first)],
                    names=["hi", "lo", *fields],
                )

    source = df.where(F.col(doc_id).isNotNull()).select(
        F.xxhash64(F.col(doc_id).cast("long")).alias("key"), F.col(text).alias("text")
    )
    schema = "hi long, lo long, " + ", ".join(f"{c} {kind}" for c, kind in fields.items())
    told = source.mapInArrow(run, schema).join(wanted.select("hi", "lo", "node"), ["hi", "lo"])
    told = told.drop("hi", "lo")
    if not once:
        told = told.groupBy("node").agg(*[F.any_value(c).alias(c) for c in fields])
    return told


def whole_sets(df: DataFrame, doc_id: str, text: str, wanted: DataFrame, once: bool) -> DataFrame:
    """``node, shingles`` of the wanted nodes."""

    def make(shingles: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(first.astype(np.int32), pa.array(shingles.view(np.int64)))]

    return _remade(df, doc_id, text, wanted, once, make, {"shingles": "array<long>"})


def slot_counts(df: DataFrame, doc_id: str, text: str, wanted: DataFrame, once: bool) -> DataFrame:
    """``node, n, counts`` of the wanted nodes: a byte or less for each shingle."""

    def make(shingles: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        counts = [_slot_counts(shingles[a:b]) for a, b in zip(first, first[1:])]
        return [pa.array(np.diff(first), pa.int64()), pa.array(counts, pa.binary())]

    return _remade(df, doc_id, text, wanted, once, make, {"n": "long", "counts": "binary"})


def _slot_counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of n / 2 to n slots; empty if a byte is too small."""
    slots = 1 << max(int(len(shingles)).bit_length() - 1, 0)
    count = np.bincount((mix(shingles) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def _may_link(one: bytes, two: bytes, n: int, m: int) -> bool:
    """False if the slots of two sets of n and m shingles show that they cannot link."""
    if not one or not two:
        return True
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (one, two))
    # slots are low bits of a hash: halves of the larger table fold onto each other
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(axis=0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(axis=0)
    return 19 * int(np.minimum(x, y).sum()) >= 9 * (n + m)


def _unrefuted(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose slot counts do not rule out a link; other columns stay."""
    one, two = (
        counted.select(
            F.col("node").alias(end), F.col("n").alias(f"n_{k}"), F.col("counts").alias(f"c_{k}")
        )
        for k, end in ((1, "a"), (2, "b"))
    )
    both = pairs.join(one, "a").join(two, "b").select(*pairs.columns, "n_1", "n_2", "c_1", "c_2")
    names = pairs.columns

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(batch.column(c).to_pylist() for c in ("c_1", "c_2", "n_1", "n_2")))
            yield batch.select(names).filter(pa.array([_may_link(*t) for t in told], pa.bool_()))

    return materialise(both.mapInArrow(test, pairs.schema), "unrefuted")


def _least_overlap(n: Column, m: Column) -> Column:
    """The smallest overlap of two linked sets of these sizes, rounded up."""
    return F.floor(((n + m) * 9 + 18) / 19)


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * 10 >= F.greatest(n, m) * 9


def _sets_of(sets: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The rows of ``sets`` whose node is in the column ``name`` of ``nodes``, and few others,
    picked where they are read, so that only these are shuffled by a join."""
    keys = nodes.select(F.xxhash64(name).alias("key")).distinct()
    known = sets.sparkSession.sparkContext.broadcast(KeyFilter.of(keys).words)

    @F.pandas_udf("boolean")
    def asked(key: pd.Series) -> pd.Series:
        return pd.Series(KeyFilter(known.value)(key.to_numpy(np.int64).view(np.uint64)))

    return sets.where(asked(F.xxhash64("node")))


def _with_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` and ``n_a, n_b, common`` of their sets ``a`` and ``b``."""
    one = _sets_of(sets, pairs, "a").select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = _sets_of(sets, pairs, "b").select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .withColumns(
            {
                "n_a": F.size("x").cast("long"),
                "n_b": F.size("y").cast("long"),
                "common": F.size(F.array_intersect("x", "y")).cast("long"),
            }
        )
        .drop("x", "y")
    )


def _postings(nodes: DataFrame) -> DataFrame:
    """``node, n, pos, token`` of the first shingles that several sets have, and few others.

    Most shingles are in one set only; a filter drops these where the sets are read, so
    that only the rest, which is small, is shuffled.
    """
    tokens = nodes.select(F.explode("head").alias("key")).groupBy("key")
    shared = tokens.agg(F.count("*").alias("sets")).where("sets > 1").select("key")
    words = KeyFilter.of(materialise(shared, "shared")).words
    known = nodes.sparkSession.sparkContext.broadcast(words)
    small_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = KeyFilter(known.value)
        for batch in batches:
            token = batch.column("head").flatten()
            many = batch.column("head").value_lengths().to_numpy()
            first = np.cumsum(many) - many
            on = np.flatnonzero(passes(token.to_numpy().view(np.uint64)))
            owner = np.repeat(np.arange(len(many)), many)[on]
            columns = [
                batch.column("node").take(pa.array(owner)),
                batch.column("n").take(pa.array(owner)),
                pa.array((on - first[owner]).astype(np.int32)),
                token.take(pa.array(on)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "pos", "token"])

    return nodes.select("node", "n", "head").mapInArrow(
        run, "node long, n long, pos int, token long"
    )


def _in_company(postings: DataFrame) -> DataFrame:
    """Postings that may link within their list, by summaries of its blocks of like size.

    Linked sets lie in one block or in neighbouring ones.
    """
    cell = F.floor(F.log(CELL, F.col("n"))).alias("cell")
    celled = materialise(postings.select("*", cell), "lists")
    blocks = celled.groupBy("token", "cell").agg(
        F.count("*").alias("sets"), F.max(F.col("n") - F.col("pos")).alias("left")
    )
    near = (
        blocks.withColumn("cell", F.explode(F.expr("array(cell - 1, cell, cell + 1)")))
        .groupBy("token", "cell")
        .agg(F.sum("sets").alias("size"), F.max("left").alias("left"))
        .where("size > 1")
    )
    n = F.col("n")
    enough = F.least(n - F.col("pos"), F.col("left")) >= _least_overlap(n, F.ceil(n * 9 / 10))
    return celled.join(near, ["token", "cell"]).where(enough).drop("left")


def _ends(pairs: DataFrame) -> DataFrame:
    """``node``: the ends of the pairs ``a, b``, each once."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


_LINKED = "(19 * common >= 9 * (n_a + n_b))"


def _star_pairs(members: DataFrame) -> DataFrame:
    """Pairs of the sets of a list and the list's hub, the set with most company."""
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = materialise(
        members.join(materialise(weight, "weights"), "node")
        .groupBy("token")
        .agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n", "pos")).alias("top"))
        .select(
            "token",
            (-F.col("top.minus")).alias("hub"),
            F.col("top.n").alias("n_hub"),
            F.col("top.pos").alias("pos_hub"),
        ),
        "hubs",
    )
    rest = F.least(F.col("n") - F.col("pos"), F.col("n_hub") - F.col("pos_hub"))
    pairs = (
        members.join(hubs, "token")
        .where(
            (F.col("node") != F.col("hub"))
            & _sizes_fit(F.col("n"), F.col("n_hub"))
            & (rest >= _least_overlap(F.col("n"), F.col("n_hub")))
        )
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    return materialise(pairs, "stars")


def _probes(members: DataFrame, label: DataFrame) -> DataFrame:
    """``node, n, component``: sets and other components that a block does not rule out.

    Of two components the one with more sets is probed, by the sets of the other.
    """
    sizes = label.groupBy("component").agg(F.count("*").alias("sets"))
    known = label.join(materialise(sizes, "sizes"), "component")
    tagged = materialise(
        members.drop("size", "cell")
        .join(known, "node", "left")
        .withColumns(
            {
                "component": F.coalesce("component", "node"),
                "sets": F.coalesce("sets", F.lit(1)),
            }
        ),
        "tagged",
    )
    mixed = (
        tagged.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("token")
    )
    tagged = materialise(tagged.join(mixed, "token"), "mixed")
    blocks = materialise(
        tagged.groupBy(
            "token",
            F.col("component").alias("other"),
            F.col("sets").alias("other_sets"),
            F.floor(F.log(CELL, F.col("n"))).alias("size_cell"),
            F.floor(F.log2(F.col("pos") + 1)).alias("pos_cell"),
        )
        .agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.max(F.col("n") - F.col("pos")).alias("left"),
        )
        .drop("size_cell", "pos_cell"),
        "blocks",
    )
    n = F.col("n")
    # no partner in the block is smaller than this
    partner = F.greatest(F.col("least"), F.ceil(n * 9 / 10))
    fits = (
        (F.col("component") != F.col("other"))
        & (F.struct("other_sets", -F.col("other")) > F.struct("sets", -F.col("component")))
        & (F.col("most") * 10 >= n * 9)
        & (n * 10 >= F.col("least") * 9)
        & (F.least(n - F.col("pos"), F.col("left")) >= _least_overlap(n, partner))
    )
    return materialise(
        tagged.join(blocks, "token")
        .where(fits)
        .select("node", "n", F.col("other").alias("component"))
        .distinct(),
        "probes",
    )


def _heads(label: DataFrame, links: DataFrame) -> DataFrame:
    """``component, head``: of each component the set with most links."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return (
        label.join(degree, "node")
        .groupBy("component")
        .agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"))
        .select("component", (-F.col("top.minus")).alias("head"))
    )


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` of ``node`` and ``head`` with ``delta``, what the set has more, then what it lacks."""
    one = _sets_of(sets, pairs, "node").select("node", F.col("shingles").alias("x"))
    two = _sets_of(sets, pairs, "head").select(F.col("node").alias("head"), F.col("shingles").alias("y"))
    more, lacks = F.array_except("x", "y"), F.array_except("y", "x")
    return (
        pairs.join(one, "node")
        .join(two, "head")
        .withColumns({"more": F.sort_array(more), "lacks": F.sort_array(lacks)})
        .select(
            *pairs.columns,
            F.size("y").cast("long").alias("n_head"),
            F.size("x").cast("long").alias("n_x"),
            F.size("lacks").cast("long").alias("lacking"),
            F.concat("more", "lacks").alias("delta"),
        )
    )


def _first_shingles(differing: DataFrame, needed: Column, end: str) -> DataFrame:
    """Of each set, as ``end``, the shingles of its difference that have ``needed`` or more
    left, themselves included; how many is ``left``."""
    many = F.size("delta")
    return differing.select(
        "component",
        "n_head",
        F.col("node").alias(end),
        F.col("n_x").alias(f"n_{end}"),
        F.col("lacking").alias(f"l_{end}"),
        many.alias("many"),
        F.posexplode(F.slice("delta", F.lit(1), (many - needed + 1).cast("int"))).alias("pos", "token"),
    ).withColumn(f"left_{end}", F.col("many") - F.col("pos")).drop("many", "pos")


def _derived_links(unlinked: DataFrame, label: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of sets with members of a component whose head they do not link to.

    With the sizes n of a set and h of the head, and l shingles of the head lacking, x
    and z link exactly if their differences share s = ceil(9 (n_x + n_z) / 19) - h + l_x
    + l_z shingles. As x does not link to the head, 19 s > 9 |more of z| + 10 l_z, and
    19 s >= 9 n_x - 10 h + 19 l_x: each side needs to look up only so many shingles of
    its difference that, with fewer left, s cannot be reached. Differences are in one
    order, so a shingle may be the first that x and z share only if from there on both
    have s left; other meetings are not handed on.
    """
    wanted = unlinked.select("component").distinct()
    members = materialise(
        _differences(
            label.join(wanted, "component").join(heads, "component").where("node <> head"), sets
        ),
        "members",
    )
    gap = F.expr("1 - (n_head - lacking) / (n_x + lacking)")
    radius = members.groupBy("component").agg(F.max(gap).alias("radius"))
    # distances obey the triangle inequality
    near = unlinked.join(radius, "component").where("gap <= 0.1 + radius + 1e-9")
    strays = materialise(
        _differences(near.select("node", "component", "head"), sets), "strays"
    )
    needed = F.greatest(F.expr("ceil((9 * n_x - 10 * n_head + 19 * lacking) / 19)"), F.lit(1))
    probes = _first_shingles(strays, needed, "a")
    needed = F.expr("(9 * (size(delta) - lacking) + 10 * lacking) div 19") + 1
    index = _first_shingles(members, needed, "b").drop("n_head")
    shared = _least_overlap(F.col("n_a"), F.col("n_b")) - F.col("n_head") + F.expr("l_a + l_b")
    pairs = materialise(
        probes.join(index, ["component", "token"])
        .where(_sizes_fit(F.col("n_a"), F.col("n_b")))
        .where(F.least("left_a", "left_b") >= shared)
        .select("component", "a", "b")
        .distinct(),
        "derived",
    )
    one = strays.select(
        "component", "n_head", *[F.col(c).alias(d) for c, d in
        (("node", "a"), ("n_x", "n_a"), ("lacking", "l_a"), ("delta", "d_a"))]
    )
    two = members.select(
        *[F.col(c).alias(d) for c, d in
        (("node", "b"), ("n_x", "n_b"), ("lacking", "l_b"), ("delta", "d_b"))]
    )
    common = F.col("n_head") - F.col("l_a") - F.col("l_b") + F.size(F.array_intersect("d_a", "d_b"))
    return (
        pairs.join(one, ["component", "a"])
        .join(two, "b")
        .withColumn("common", common)
        .where(_LINKED)
        .select("a", "b")
    )


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``df``.

    Sets are the distinct shingles of three words, A-Z lower-cased; shorter texts
    are one shingle. Two rows link if 100 * intersection >= 90 * union; the component
    is the smallest id that links reach. Equal sets are one node, whatever their
    number, and components lose no link between different ones; a pair that is known
    to be in one component is not tested.

    A null or empty text, or one without words, links with nothing and is its own
    component. A row without id keeps its size and has no component, and nothing is
    linked through it. Rows that repeat an id are judged each by its own text. An empty
    table gives an empty one.
    """
    found = materialise(prints(df, doc_id, text, shingle_levels(df, text)), "prints")
    nodes = materialise(
        found.where("id IS NOT NULL AND n > 0")
        .groupBy("hi", "lo")
        .agg(
            F.min("id").alias("id"),
            F.any_value("n").alias("n"),
            F.any_value("head").alias("head"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = materialise(_in_company(_postings(nodes)), "members")
    label = _linked(df, doc_id, text, found, nodes, members)
    named = nodes.join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = materialise(named.select("hi", "lo", "id", "component"), "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    classes = materialise(named.join(smallest, "component").select("hi", "lo", "smallest"), "classes")
    component = F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id"))
    return (
        found.select("id", "n", "hi", "lo")
        .join(classes, ["hi", "lo"], "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
        )
    )


def _linked(
    df: DataFrame, doc_id: str, text: str, found: DataFrame, nodes: DataFrame, members: DataFrame
) -> DataFrame:
    """``node, component`` of all nodes that have a link."""
    once = found.groupBy("id").count().where("count > 1").isEmpty()
    met = materialise(members.select("node").distinct(), "met")
    wanted = nodes.select("id", "node", "hi", "lo").join(met, "node")
    wanted = materialise(wanted, "wanted")
    counted = materialise(slot_counts(df, doc_id, text, wanted, once), "counted")

    def sets_of(ends: DataFrame) -> DataFrame:
        picked = materialise(wanted.join(ends, "node"), "picked")
        return materialise(whole_sets(df, doc_id, text, picked, once), "sets")

    # most pairs are ruled out by their counts, so whole sets are made of the others only
    pairs = _unrefuted(_star_pairs(members), counted)
    sets = sets_of(_ends(pairs))
    links = materialise(_with_overlap(pairs, sets).where(_LINKED).select("a", "b"), "links")
    label = components(links)
    probes = _probes(members, label)
    if probes.isEmpty():
        return label
    heads = materialise(_heads(label, links), "heads")
    asked = materialise(
        probes.join(heads, "component", "left").select(
            F.col("node").alias("a"),
            F.coalesce("head", "component").alias("b"),
            "component",
            F.col("head").isNull().alias("alone"),
        ),
        "asked",
    )
    # a component of one set has no members to go on to
    alone = _unrefuted(asked.where("alone"), counted)
    asked = asked.where("NOT alone").unionByName(alone).drop("alone")
    fresh = _ends(asked).join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(sets_of(fresh))
    tested = materialise(_with_overlap(asked, sets), "tested")
    more = tested.where(_LINKED).select("a", "b")
    gap = F.expr("1 - common / (n_a + n_b - common)").alias("gap")
    unlinked = tested.where(f"NOT {_LINKED}").select(
        F.col("a").alias("node"), F.col("b").alias("head"), "component", gap
    )
    unlinked = unlinked.join(heads.select("component"), "component", "left_semi")
    derived = _derived_links(unlinked, label, heads, sets)
    more = materialise(more.unionByName(derived), "links")
    if more.isEmpty():
        return label
    return components(links.unionByName(more))
