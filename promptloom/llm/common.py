"""What the corpus operators share: text batches of bounded size and word hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
FILTER_BITS = 1 << 27  # bound of a filter that goes to the workers, 16 MB

_HOLDER = "_promptloom_kept"

# Called with the texts of a chunk, returns one Arrow array per output field.
Texts = Callable[[list], Sequence[pa.Array]]


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each, at least one row."""
    if not len(column):
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 64
    part = np.cumsum(size, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(column)])


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    open_: Callable[[], Texts],
    fields: Sequence[T.StructField],
    remembers: bool = False,
) -> DataFrame:
    """``keep`` and what ``open_()`` makes of the texts, row by row, without a shuffle.

    ``open_`` runs once per task that has rows. Texts reach its result in chunks
    of a few MB, whatever the Arrow batch holds, so a worker's memory follows the
    chunk or the longest single text. Batches themselves hold few rows. What an earlier operator left with ``kept`` on
    the worker goes first, unless ``open_`` says by ``remembers`` that it uses it.
    """
    small_batches(df.sparkSession)
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(source.schema[name] for name in keep), *fields])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if work is None:
                if not remembers:
                    forget()
                work = open_()
            for start, stop in slices(batch.column(text)):
                part = batch.slice(start, stop - start)
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in names), *made], names=schema.names
                )
        give_back()

    return source.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session have more than ``BATCH_ROWS`` rows.

    Rows here are whole texts: with Spark's default of 10,000 a batch of each task would
    be held by the JVM, in buffers of twice its size, and by its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def forget() -> None:
    """Drop what an earlier operator left on this worker with ``kept``."""
    holder = sys.modules.get(_HOLDER)
    if getattr(holder, "value", None) is not None:
        kept("nothing", lambda: None)
        give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the system, for the tasks of others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def kept(key: Hashable, make: Callable[[], object]):
    """``make()``, made once per Python worker while the key stays the same.

    Functions reach a worker by value, with globals of their own for every task, so
    what should outlast a task hangs on a module of the worker's process. Only the
    latest key is held, and nothing is shared between workers.
    """
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
    if getattr(holder, "key", None) != key:
        holder.key = holder.value = None
        holder.value = make()
        holder.key = key
    return holder.value


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FACTORS = np.cumprod(np.full(16, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
_SHORT = np.uint64(0xA0761D6478BD642F)


class WordHashes:
    """64-bit hashes of the words of whole texts, A-Z lower-cased.

    Words are runs of bytes other than space and tab to carriage return, or than the
    ASCII characters ``breaks``. A word's hash is a sum of byte values times powers of
    an odd number, then mixed; it is computed for all words of a chunk at once. Another
    ``seed`` gives other hashes.
    """

    def __init__(self, breaks: bytes = b"\t\n\v\f\r ", seed: int = 0) -> None:
        self.powers = np.zeros(0, np.uint64)
        codes = np.arange(256, dtype=np.uint64)
        codes[65:91] += np.uint64(32)
        self.codes = mix(codes + np.uint64(0x632BE59BD9B4E019 + seed))
        self.space = np.zeros(256, bool)
        self.space[list(breaks)] = True

    def _powers(self, n: int) -> np.ndarray:
        if n > len(self.powers):
            step = np.full(max(n, 64), 0x9E3779B97F4A7C15, np.uint64)
            self.powers = np.cumprod(step, dtype=np.uint64)
        return self.powers

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (one more entry)."""
        data, begin, end, first = self.spans(texts)
        return self.hashes(data, begin, end), first

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """The texts' bytes with a line break after each, where words begin and end in
        them, and where each text's words begin."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        inside = ~self.space[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        begin, end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
        return data, begin, end, np.searchsorted(begin, np.concatenate(([0], ends)))

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0, np.uint64)
        length = end - begin
        where = np.flatnonzero(~self.space[data])
        within = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
        value = self.codes[data[where]] * self._powers(int(length.max()) + 1)[within]
        words = np.add.reduceat(value, np.cumsum(length) - length)
        return mix(words + length.astype(np.uint64))


def shingle_sets(
    words: np.ndarray, first: np.ndarray, size: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted within it, and where each set begins.

    With fewer than ``size`` words the whole sequence is the one shingle; without
    words the set is empty.
    """
    count = np.diff(first)
    n = len(words)
    value = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        value[: n - k] += words[k:] * _FACTORS[k]
    value = mix(value)
    windows = np.maximum(count - (size - 1), 0)
    windows[(count > 0) & (count < size)] = 1
    start = np.cumsum(windows) - windows
    at = np.repeat(first[:-1] - start, windows) + np.arange(windows.sum())
    shingles = value[at]
    for i in np.flatnonzero((count > 0) & (count < size)):
        own = words[first[i] : first[i + 1]] * _FACTORS[: count[i]]
        shingles[start[i]] = mix(own.sum(dtype=np.uint64, keepdims=True) ^ _SHORT)[0]
    owner = np.repeat(np.arange(len(count)), windows)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.searchsorted(owner, np.arange(len(count) + 1))


class KeyFilter:
    """A bit array that knows a set of 64-bit keys, and few others by mistake."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(64 * len(words) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self._set(keys) & self._set(keys >> np.uint64(32))

    def _set(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        word = self.words[(at >> np.uint64(6)).astype(np.int64)]
        return ((word >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """The filter of the column ``key``, combined on Spark; at most ``FILTER_BITS`` bits."""
        bits = 1 << 16
        while bits < min(32 * keys.count(), FILTER_BITS):
            bits *= 2
        # two bits of every key
        two = f"explode(array(key & {bits - 1}, shiftright(key, 32) & {bits - 1})) AS place"
        found = (
            keys.selectExpr(two)
            .selectExpr("place div 64 AS word", "shiftleft(1L, cast(place % 64 as int)) AS bit")
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bit"))
            .toArrow()
        )
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
        return cls(words)
