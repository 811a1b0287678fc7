"""Byte-level BPE by a file of ranks: encoding in two tiers, and decoding.

A pre-token that is in the vocabulary is found by a minimal perfect hash; any other
is merged from its bytes, kept as a linked list, with a heap of the possible merges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import field, kept, map_texts
from promptloom.llm.tokens import SegmentIds, packed

# Unicode's white space, spelled out because libraries differ in a few control characters
_WHITE = r"\t-\r \x85\xa0  -     　"
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
PAIRS = 200_000
MEMO_BYTES = 128 << 20


def compiled(pattern: str) -> regex.Pattern:
    inside = pattern.replace(r"[^\s", "[^" + _WHITE)
    return regex.compile(inside.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in the order of their ranks 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@dataclass(frozen=True)
class PerfectHash:
    """A slot of its own for each of n keys, out of exactly n.

    Keys are dealt into buckets, large buckets first look for a displacement that
    sends all their keys to free slots; a bucket of one key names its slot.
    """

    shift: list[int]  # by bucket: a displacement, or -1 - slot
    id_of: list[int]  # by slot
    key_of: list[bytes]

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        shift, id_of = [0] * buckets, np.full(n, -1)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                tried = np.arange(d, d + 64, dtype=np.uint64)[:, None] * np.uint64(_STEP)
                slots = (_spread(hashes[own] + tried) % np.uint64(n)).astype(np.int64)
                fits = (id_of[slots] < 0).all(axis=1)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=1)
                    fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    shift[b], id_of[slots[k]] = d + k, own
                    break
                d += 64
        free = iter(np.flatnonzero(id_of < 0).tolist())
        for b in np.flatnonzero(np.diff(starts) == 1):
            slot = next(free)
            shift[b], id_of[slot] = -1 - slot, order[starts[b]]
        return cls(shift, id_of.tolist(), [keys[i] for i in id_of])

    def get(self, key: bytes) -> int:
        """The key's number, -1 for any other bytes."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 32) % len(self.shift)]
        if d < 0:
            slot = -1 - d
        else:
            x = (h + d * _STEP) & _MASK
            x = ((x ^ (x >> 31)) * _STEP) & _MASK
            slot = (x ^ (x >> 29)) % len(self.id_of)
        return self.id_of[slot] if self.key_of[slot] == key else -1


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_STEP)
    return x ^ (x >> np.uint64(29))


class _Pairs(dict):
    """Rank of two neighbouring tokens merged, -1 if they do not merge."""

    def __init__(self, tokens: list[bytes], known: PerfectHash) -> None:
        super().__init__()
        self.tokens, self.known = tokens, known

    def __missing__(self, pair: int) -> int:
        tokens = self.tokens
        rank = self.known.get(tokens[pair >> 32] + tokens[pair & 0xFFFFFFFF])
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = rank
        return rank


class Codec:
    """Encodes texts and decodes ids of one vocabulary."""

    def __init__(self, tokens: list[bytes], known: PerfectHash, pattern: str) -> None:
        self.tokens, self.known = tokens, known
        self.single = [known.get(bytes([b])) for b in range(256)]
        self.pairs = _Pairs(tokens, known)
        self.cut = compiled(pattern).findall
        self.segments = SegmentIds(self._token, self._tokens, memo_bytes=MEMO_BYTES)
        self.decimals = [b"%d" % i for i in range(len(tokens))]

    def _tokens(self, text: str) -> bytes:
        return b"".join(map(self._token, self.cut(text)))

    def _token(self, word: str) -> bytes:
        data = word.encode("utf-8")
        whole = self.known.get(data)
        return packed([whole] if whole >= 0 else self._merged(data))

    def _merged(self, data: bytes) -> list[int]:
        pairs = self.pairs
        ids = list(map(self.single.__getitem__, data))
        n = len(ids)
        # rank of the pair that begins at each place, -1 where none merges
        ranks = [pairs[a << 32 | b] for a, b in zip(ids, ids[1:])]
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not heap:
            return ids
        ranks.append(-1)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heap[0]
            rank, i = top >> 32, top & 0xFFFFFFFF
            # a pair that an earlier merge has changed is passed over
            if ranks[i] != rank:
                heappop(heap)
                continue
            j = after[i]
            ids[i] = rank
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            new = -1
            if k < n:
                before[k] = i
                new = pairs[rank << 32 | ids[k]]
            ranks[i] = new
            if new >= 0:
                heapreplace(heap, new << 32 | i)
            else:
                heappop(heap)
            k = before[i]
            if k >= 0:
                new = ranks[k] = pairs[ids[k] << 32 | rank]
                if new >= 0:
                    heappush(heap, new << 32 | k)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.segments.encode(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_decode(
    df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, ids, decoded``: a text's ids and the bytes that they decode to.

    One row per row of ``df``. A null or empty text has no ids and no bytes. The
    vocabulary must hold every single byte. The perfect hash is built once, on the
    driver, and goes to every worker; its size is that of the vocabulary.
    """

    def told(codec: Codec, ids: list[np.ndarray]) -> list[pa.Array]:
        first = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        return [
            pa.ListArray.from_arrays(first, pa.array(flat.astype(np.int32))),
            pa.array([codec.decode(i) for i in ids], pa.binary()),
        ]

    fields = [field("ids", "array<int>"), field("decoded", "binary")]
    return _coded(df, path, pattern, doc_id, text, told, fields)


def encode_decode_digests(
    df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``encode_decode`` returns.

    The digests, of the decimal ids joined by spaces and of the decoded bytes, are
    made where the ids are, so no ids leave the worker.
    """

    def told(codec: Codec, ids: list[np.ndarray]) -> list[pa.Array]:
        shown = codec.decimals.__getitem__
        said = [hashlib.sha256(b" ".join(map(shown, i.tolist()))).hexdigest() for i in ids]
        decoded = [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(said), pa.array(decoded)]

    fields = [field("n_tokens", "long"), field("ids_sha256", "string")]
    return _coded(df, path, pattern, doc_id, text, told, [*fields, field("decoded_sha256", "string")])


def _coded(
    df: DataFrame,
    path: str,
    pattern: str,
    doc_id: str,
    text: str,
    told: Callable[[Codec, list[np.ndarray]], list[pa.Array]],
    fields: list,
) -> DataFrame:
    tokens = read_ranks(path)
    built = PerfectHash.build(tokens)
    # plain lists: a class would be looked up by name on executors without the package
    known = df.sparkSession.sparkContext.broadcast((tokens, built.shift, built.id_of))
    run = uuid.uuid4().hex

    def codec_of() -> Codec:
        tokens, shift, id_of = known.value
        return Codec(tokens, PerfectHash(shift, id_of, [tokens[i] for i in id_of]), pattern)

    def open_():
        # the tasks of a worker share one codec and its memo
        codec = kept(("codec", run), codec_of)
        return lambda texts: told(codec, [codec.encode(t or "") for t in texts])

    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(source, "text", ["doc_id"], open_, fields, remembers=True)
