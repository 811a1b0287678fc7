"""Phrases whose words keep company, counted by length, each only where its parts are frequent.

A phrase is at most as frequent as its parts. So words are counted first, then runs of
two frequent words, then runs of three whose pairs are frequent, then runs of four and
five whose triples are. Every count is taken from its own pass; filters of the frequent
runs tell the next pass what can still be in a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.llm.common import CHUNK_BYTES, KeyFilter, WordHashes, mix, slices, small_batches
from promptloom.session import materialise

LONGEST = 5
PIECE_ENDS = b".,;:!?\n\v\f\r"
WORD_ENDS = PIECE_ENDS + b" \t"
STEPS = ((2,), (3,), (4, 5))  # sizes of runs that are counted in one pass
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]
HELD = 1 << 20
SALTS = 64

_CUT = re.compile("[.,;:!?\n\v\f\r]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.uint64(0xD1342543DE82EF95)


def _turn(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _key(words: list[np.ndarray], turn: np.uint64 | np.ndarray) -> np.ndarray:
    """A key of each run of word hashes, first words first, in a language."""
    key = words[0]
    for other in words[1:]:
        key = mix(key * _TURN + other)
    return mix(key ^ turn)


class Words:
    """The words of texts of one language: hashes, pieces and bytes."""

    def __init__(self, texts: list[str], lang: str, hashes: WordHashes) -> None:
        self.data, self.begin, self.end, _ = hashes.spans(texts)
        self.hash = hashes.hashes(self.data, self.begin, self.end)
        self.hash[self.hash == 0] = 1  # 0 stands for no word
        ends = np.zeros(256, bool)
        ends[list(PIECE_ENDS)] = True
        self.piece = np.cumsum(ends[self.data])[self.begin]
        self.turn = _turn(lang)

    def keys_of(self, size: int) -> np.ndarray:
        """A key of the ``size`` words that begin at each word."""
        n = max(len(self.hash) - size + 1, 0)
        return _key([self.hash[k : n + k] for k in range(size)], self.turn)

    def frequent(self, filters: list[np.ndarray]) -> list[np.ndarray]:
        """For 1, 2, ... words: where such a run begins that is within a piece and in its
        filter, as are all its parts; past the last filter only the parts count."""
        n = len(self.hash)
        ok = [KeyFilter(filters[0])(self.keys_of(1))]
        for size in range(2, LONGEST + 1):
            m = max(n - size + 1, 0)
            fits = ok[-1][:m] & ok[-1][1 : m + 1]
            if size == 2:
                fits &= self.piece[:m] == self.piece[1 : m + 1]
            if size <= len(filters):
                fits[fits] = KeyFilter(filters[size - 1])(self.keys_of(size)[fits])
            ok.append(fits)
        return ok

    def differ(self, than: np.ndarray) -> np.ndarray:
        """Which words are not the same as the word at the place given for each."""
        length = self.end - self.begin
        same = length == length[than]
        at = np.flatnonzero(same)
        size = length[at]
        first = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(first, size)
        own = self.data[within + np.repeat(self.begin[at], size)]
        own = _LOWER[own] == _LOWER[self.data[within + np.repeat(self.begin[than[at]], size)]]
        if len(at):
            same[at] = np.logical_and.reduceat(own, first)
        return np.flatnonzero(~same)

    def text(self, at: np.ndarray) -> pa.Array:
        """The words at these places, lower-cased."""
        length = (self.end - self.begin)[at]
        start = np.cumsum(length) - length
        where = np.arange(length.sum()) + np.repeat(self.begin[at] - start, length)
        offsets = np.append(start, length.sum()).astype(np.int32)
        parts = [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[self.data[where]])]
        return pa.StringArray.from_buffers(len(at), parts[1], parts[2])


def cut_long(text: str, limit: int = CHUNK_BYTES) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that end where a piece ends."""
    start = 0
    while len(text) - start > limit:
        found = _CUT.search(text, start + limit)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def _per_language(batch: pa.RecordBatch, hashes: WordHashes) -> Iterator[tuple[str, Words]]:
    for start, stop in slices(batch.column("text")):
        part = batch.slice(start, stop - start)
        texts: dict[str, list[str]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            held, size = [], 0
            for piece in (p for text in own for p in cut_long(text)):
                held.append(piece)
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield lang, Words(held, lang, hashes)
                    held, size = [], 0
            if held:
                yield lang, Words(held, lang, hashes)


def _counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of columns of 64-bit numbers, and the sums of ``n``."""
    key = rows[0].copy()
    for column in rows[1:]:
        key = mix(key * _TURN + column)
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    if not (rows[:, at[which]] == rows).all():
        # two rows with one key: compare the columns themselves
        _, at, which = np.unique(rows, axis=1, return_index=True, return_inverse=True)
        which = which.reshape(-1)
    return rows[:, at], np.bincount(which, weights=n, minlength=len(at)).astype(np.int64)


def _totals(
    docs: DataFrame,
    hashes: Callable[[], WordHashes],
    find: Callable[[Words], np.ndarray],
) -> DataFrame:
    """``lang``, the words ``w1`` to ``w5`` of the runs that ``find`` makes and how often each
    of them occurs, ``n``.

    0 stands for null, as do columns that ``find`` leaves out. A task adds up about a
    million rows before it hands them on.
    """

    def batch_of(lang: str, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        made = [pa.array(np.full(len(n), 0, np.int32)), pa.array([lang], pa.string())]
        langs = pa.DictionaryArray.from_arrays(*made).cast(pa.string())
        values = [pa.array(c.view(np.int64), mask=c == 0) for c in rows]
        values += [pa.nulls(len(n), pa.int64())] * (LONGEST - len(values))
        return pa.RecordBatch.from_arrays(
            [langs, *values, pa.array(n)], names=["lang", *COLUMNS, "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = hashes()
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, words in _per_language(batch, tool):
                rows = find(words)
                if rows.shape[1]:
                    held.setdefault(lang, []).append(_counted(rows, np.ones(rows.shape[1])))
                    size += len(held[lang][-1][1])
                if size >= HELD:
                    for name, parts in held.items():
                        yield batch_of(name, *_merged(parts))
                    held, size = {}, 0
        for name, parts in held.items():
            yield batch_of(name, *_merged(parts))

    schema = "lang string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", n long"
    return docs.mapInArrow(run, schema).groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    rows, n = zip(*parts)
    return _counted(np.hstack(rows), np.concatenate(n))


def word_counts(docs: DataFrame, hashes: Callable[[], WordHashes]) -> DataFrame:
    """``lang, hash, word, key, n`` of every distinct word; two words of one hash are two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = hashes()
        for batch in batches:
            for lang, words in _per_language(batch, tool):
                if not len(words.hash):
                    continue
                _, at, which, n = np.unique(
                    words.hash, return_index=True, return_inverse=True, return_counts=True
                )
                other = words.differ(at[which])
                at, n = np.append(at, other), np.append(n, np.ones(len(other), np.int64))
                found = words.hash[at]
                code = pa.array(np.zeros(len(n), np.int32))
                langs = pa.DictionaryArray.from_arrays(code, pa.array([lang], pa.string()))
                columns = [
                    langs.cast(pa.string()),
                    pa.array(found.view(np.int64)),
                    words.text(at),
                    pa.array(words.keys_of(1)[at].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["lang", "hash", "word", "key", "n"]
                )

    made = docs.mapInArrow(run, "lang string, hash long, word string, key long, n long")
    return made.groupBy("lang", "hash", "word", "key").agg(F.sum("n").alias("n"))


def _runs(sizes: tuple[int, ...], filters: list) -> Callable[[Words], np.ndarray]:
    """The runs of these numbers of words whose parts pass the filters, padded with 0."""

    def find(own: Words) -> np.ndarray:
        ok = own.frequent([f.value for f in filters])
        parts = []
        for size in sizes:
            on = np.flatnonzero(ok[size - 1])
            part = np.zeros((max(sizes), len(on)), np.uint64)
            for k in range(size):
                part[k] = own.hash[on + k]
            parts.append(part)
        return np.hstack(parts)

    return find


def _keys(runs: DataFrame, size: int) -> DataFrame:
    """``key`` of the runs, as the workers make it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            turns = np.array([_turn(x) for x in langs.dictionary.to_pylist()], np.uint64)
            words = [batch.column(c).to_numpy().view(np.uint64) for c in COLUMNS[:size]]
            key = _key(words, turns[langs.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return runs.select("lang", *COLUMNS[:size]).mapInArrow(run, "key long")


def phrase_counts(
    docs: DataFrame, hashes: Callable[[], WordHashes], words: DataFrame, least: int
) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of 1 to 5 word hashes found ``least`` times
    or more, and per ``lang`` a row of size 0 that counts all words."""
    context = docs.sparkSession.sparkContext
    common = words.where(F.col("n") >= least)
    filters = [context.broadcast(KeyFilter.of(common.select("key")).words)]
    nothing = F.array().cast("array<long>")
    every = words.groupBy("lang").agg(F.sum("n").alias("f"))
    out = every.select("lang", nothing.alias("phrase"), "f").unionAll(
        common.select("lang", F.array("hash"), "n")
    )
    for sizes in STEPS:
        found = _totals(docs, hashes, _runs(sizes, list(filters))).where(F.col("n") >= least)
        found = materialise(found, "runs")
        out = out.unionAll(found.select("lang", F.array_compact(F.array(*COLUMNS)), "n"))
        if sizes != STEPS[-1]:
            known = KeyFilter.of(_keys(found, max(sizes)))
            filters.append(context.broadcast(known.words))
    return out.select("lang", F.size("phrase").alias("size"), "phrase", "f")


def collocations(
    df: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = 100,
    first: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to 5 words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut that scores lowest
    by floor(1000 * a * n / (l * r)), the shortest first part if several do, and ``n`` all
    words of the language. Phrases found fewer than ``least`` times have no place, nor
    have those that occur only within a longer one. The ``first`` of every language come
    back by score, ``a`` and phrase.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line breaks, words at blanks and
    tabs. A null text counts as empty, a null language as ``und``; repeated rows count
    again. A table without words, or without frequent phrases, gives no rows.

    Words are counted by their hash; two words with one hash in a language would be
    seen, and the count repeated with other hashes.
    """
    docs = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).alias("text"),
    )
    small_batches(df.sparkSession)
    seed = 0
    while True:
        hashes = _opener(seed)
        words = materialise(word_counts(docs, hashes), "words")
        if words.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
        seed += 1
    found = materialise(phrase_counts(docs, hashes, words, least), "phrases")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"), salts.alias("salt"))
    known = found.where("size > 0").select("lang", "phrase", "f")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    # a part is as frequent as a longer phrase only if those between are so too
    longer = candidates.where("size > 2").select(
        "lang",
        F.explode(
            F.array(F.expr("slice(phrase, 1, size - 1)"), F.expr("slice(phrase, 2, size - 1)"))
        ).alias("phrase"),
        F.col("a").alias("outer"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    cut = (
        candidates.join(longer, ["lang", "phrase"], "left")
        .where("outer IS NULL OR outer < a")
        .drop("outer")
        .withColumn("cut", F.explode(F.expr("sequence(1, size - 1)")))
        .withColumn("head", F.expr("slice(phrase, 1, cut)"))
        .withColumn("tail", F.expr("slice(phrase, cut + 1, size - cut)"))
    )
    parts = (
        cut.join(
            known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")),
            ["lang", "head"],
        )
        .join(
            known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")),
            ["lang", "tail"],
        )
        # a language may have most of the rows
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        .join(totals, ["lang", "salt"])
    )
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "anlr"}
    score = f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"
    scored = (
        parts.withColumn("score", F.expr(score))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "n", "best.l", "best.r", "best.score")
    )
    scored = materialise(scored, "scored")
    letters = words.where(F.col("n") >= least).select("lang", "hash", "word")
    spelled = (
        scored.select("lang", "phrase", F.posexplode("phrase").alias("place", "hash"))
        .join(letters, ["lang", "hash"])
        .groupBy("lang", "phrase")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
        .select("lang", "phrase", F.array_join("words.word", " ").alias("said"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "said")
    return (
        scored.join(spelled, ["lang", "phrase"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= first)
        .select(
            "lang",
            F.col("rank").cast("long").alias("rank"),
            F.col("said").alias("phrase"),
            "a",
            "l",
            "r",
            "n",
            "score",
        )
    )


def _opener(seed: int) -> Callable[[], WordHashes]:
    return lambda: WordHashes(WORD_ENDS, seed)
