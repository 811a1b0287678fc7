"""Token ids as bit-packed binary files.

An id takes as many bits as the largest id of the vocabulary needs, lowest bit
first. A file holds its documents' ids in a row:

    8 bytes   magic
    4 x u64   bits per id, documents, ids, ids per block
    i64 each  doc_id of every document
    u8 each   1 if the document has an id
    u64 each  first id of every document, and the end
    u64 each  byte at which every block of ids starts, from the payload's start
    payload   blocks, each padded to whole 64-bit words

So any id is found from its number, and blocks are unpacked by numpy at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from promptloom.llm.common import forget, give_back, slices, small_batches
from promptloom.llm.files import Output, place
from promptloom.llm.tokens import worker_encoder
from promptloom.session import materialise, scratch_path

MAGIC = b"IDBITS01"
BLOCK = 1 << 16
FILE_IDS = 4_000_000
MEMO_BYTES = 112 << 20
# widths at which the bits are those of plain integers
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, padded to whole 64-bit words."""
    if bits in _WHOLE:
        data = ids.astype(_WHOLE[bits]).tobytes()
        return data + bytes(-len(data) % 8)
    words = np.zeros((len(ids) * bits + 63) // 64, np.uint64)
    if len(ids):
        ids = ids.astype(np.uint64)
        at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(ids << shift, first)
        over = np.flatnonzero(shift + np.uint64(bits) > 64)
        # a word takes the high bits of one id at most
        words[word[over] + 1] |= ids[over] >> (np.uint64(64) - shift[over])
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to before ``stop`` of a block."""
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], stop - start, start * bits // 8).astype(np.uint32)
    words = np.concatenate((np.frombuffer(data, "<u8"), np.zeros(1, np.uint64)))
    at = np.arange(start, stop, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift == 0, 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
    return ((low | high.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int) -> bytes:
    first = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype("<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack_bits(flat[at : at + BLOCK], bits) for at in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0, *[len(b) for b in blocks]])[:-1].astype("<u8")
    head = np.array([bits, len(doc_ids), len(flat), BLOCK], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [head, names, known, first, starts]
    return MAGIC + b"".join(p.tobytes() for p in parts) + b"".join(blocks)


class IdFile:
    """A packed file in memory: documents and random access to ids."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.bits, self.docs, self.count, self.block = np.frombuffer(data, "<u8", 4, 8).tolist()
        at = 40
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at)
        at += 8 * self.docs
        self.known = np.frombuffer(data, np.uint8, self.docs, at)
        at += self.docs
        self.first = np.frombuffer(data, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        blocks = -(-self.count // self.block)
        self.starts = np.frombuffer(data, "<u8", blocks, at).tolist()
        self.payload = memoryview(data)[at + 8 * blocks :]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to before ``stop`` of the file, from the blocks that hold them."""
        parts = []
        ends = [*self.starts[1:], len(self.payload)]
        for k in range(start // self.block, -(-stop // self.block)):
            base = k * self.block
            data = self.payload[self.starts[k] : ends[k]]
            parts.append(
                unpack_bits(data, self.bits, max(start - base, 0), min(stop - base, self.block))
            )
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        flat = self.read(0, self.count)
        for k in range(self.docs):
            name = int(self.doc_ids[k]) if self.known[k] else None
            yield name, flat[self.first[k] : self.first[k + 1]]


def write_ids(
    df: DataFrame,
    path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write all texts' ids in ascending order of ``doc_id``; a table of the files.

    ``part, number, uri, docs, ids, start``: files in order of ``part, number``, and how
    many ids lie in the files before. ``end_id`` follows each document; a null or
    empty text is that id alone. Documents without an id come first; rows that
    repeat an id come in the order of a hash of their text. Texts are dealt by
    ranges of the id, so a file's documents follow those of the file before.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "ids")
    end = np.array([end_id], np.uint32)
    bits = id_bits(path)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = None
        names, ids, held, files = [], [], 0, []

        def flush() -> None:
            nonlocal names, ids, held
            out = Output(folder, f"{part:06d}-{len(files):06d}", ".ids")
            out.write(file_bytes(names, ids, bits))
            files.append((part, len(files), out.close(), len(names), held))
            names, ids, held = [], [], 0

        for batch in batches:
            if encode is None:
                encode = worker_encoder(path, MEMO_BYTES)
            for start, stop in slices(batch.column("text")):
                own = batch.slice(start, stop - start)
                texts = own.column("text").to_pylist()
                for name, value in zip(own.column("doc_id").to_pylist(), texts):
                    found = np.frombuffer(encode(value), "<u4") if value else end[:0]
                    names.append(name)
                    ids.append(np.concatenate((found, end)))
                    held += len(ids[-1])
                    if held >= file_ids:
                        flush()
        if names:
            flush()
        give_back()
        if files:
            columns = [pa.array(c, t) for c, t in zip(zip(*files), _FILE_TYPES)]
            yield pa.RecordBatch.from_arrays(columns, names=_FILE_NAMES)

    tie = F.xxhash64(text)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.withColumn("tie", tie if text == "text" else F.xxhash64("text"))
    dealt = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = dealt.select("doc_id", "text").mapInArrow(
        run, "part long, number long, uri string, docs long, ids long"
    )
    files = materialise(files, "files")
    # one row per file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(
        files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "files"
    )


_FILE_NAMES = ["part", "number", "uri", "docs", "ids"]
_FILE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def id_bits(path: str) -> int:
    """Bits of the largest id of a vocabulary file."""
    return max(1, int(max(Tokenizer.from_file(path).get_vocab().values())).bit_length())


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the listed files.

    ``ids`` are little-endian 32-bit bytes. One task reads one file at a time. What the
    encoder has remembered on a worker is of no use here and goes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for uri, start in zip(*(batch.column(c).to_pylist() for c in ("uri", "start"))):
                system, path = place(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    file = IdFile(stream.read())
                rows = []
                for name, ids in file.documents():
                    rows.append((name, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
        give_back()

    # as many tasks as files, so that no task holds several
    dealt = files.select("uri", "start").repartition(max(1, files.count()), "uri")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


