"""Parts of the corpus operators that need no session."""

import gzip
import io
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from promptloom.llm import bitpack, bpe, hnsw, minhash, packing, tokens, urlfilter, warc
from promptloom.llm.common import WordHashes, shingle_sets
from promptloom.llm.tokens import SegmentIds, encoder

ROOT = str(Path(__file__).resolve().parents[2])
ODD = [0x1C, 0x85, 0xA0, 0x2028, 0x3000, 32, 32, 10, 13, 9, 39, 97, 115, 65, 233, 0x301, 0x4E2D]
ODD += [0x1F600, 0x661, 46, 33, 95, 48, 0x130, 0x3A3, 0xDF]


def odd_texts(n):
    draw = random.Random(3)
    return ["".join(chr(draw.choice(ODD)) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def brute_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_shingle_sets_are_those_of_words():
    texts = ["a b c d e f", "A B C D E F", "", None, " \n ", "x y", "y x", "a b c d e a b c d e"]
    texts += ["ab ba", "ba ab", "é É", "w " * 300]
    values, first = shingle_sets(*WordHashes()(texts))
    got = [set(values[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    want = [brute_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_sketches_estimate_similarity_and_merge():
    draw = np.random.default_rng(1)
    common, one, two = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    sets = [np.concatenate((common, one)), np.concatenate((common, two)), common, one]
    first = np.cumsum([0, *map(len, sets)])
    made = minhash.sketches(np.concatenate(sets), first)
    assert (np.maximum(made[2], made[3]) == made[0]).all()
    j = minhash.estimate(made[:1], made[1:2], np.array([700.0]), np.array([700.0]))[0]
    assert abs(j - 600 / 800) < 0.15


def test_byte_bpe_is_that_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = bpe.read_ranks(path)
    known = bpe.PerfectHash.build(vocabulary)
    assert all(known.get(t) == i for i, t in enumerate(vocabulary))
    assert sorted(known.id_of) == list(range(len(vocabulary)))
    assert known.get(b"not in the vocabulary") == -1
    codec = bpe.Codec(vocabulary, known, public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={t: i for i, t in enumerate(vocabulary)},
        special_tokens={},
    )
    for text in [*odd_texts(500), "don't  stop\n\n now", "a" * 5000, "<|endoftext|>"]:
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_ids_are_the_librarys(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    encode = tokens.encoder(public_tokenizers.path(name))
    for text in [*odd_texts(500), "Don't, WON'T; x1 <|endoftext|>\n\n end ", "Ünïcode " * 50]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_are_the_librarys(name):
    path = public_tokenizers.path(name)
    library, encode = Tokenizer.from_file(path), tokens.worker_encoder(path)
    texts = ["foo <|endoftext|> bar", "a<|startoftext|>B  <|endoftext|>", "<|endoftext|>" * 3]
    texts += ["<|ENDOFTEXT|> <|end", "\x1c<|endoftext|>\u3000", "x <|endoftext |>"]
    for text in [*texts, *odd_texts(100), *(t + texts[0] + t for t in odd_texts(100))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31, 32])
def test_packed_files_round_trip(bits):
    draw = np.random.default_rng(bits)
    sizes = [0, 1, 70_000, 3]
    ids = [draw.integers(0, 2**bits, n).astype(np.uint32) for n in sizes]
    file = bitpack.IdFile(bitpack.file_bytes([5, None, -2, 9], ids, bits))
    back = list(file.documents())
    assert [d for d, _ in back] == [5, None, -2, 9]
    assert all((a == b).all() for (_, a), b in zip(back, ids))
    flat = np.concatenate(ids)
    for start, stop in ((0, 1), (65_530, 65_540), (70_000, 70_004), (10, 10)):
        assert (file.read(start, stop) == flat[start:stop]).all()


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_every_piece_is_in_one_pattern(n):
    draw = np.random.default_rng(n)
    lengths = np.clip(draw.lognormal(5.5, 1.2, n).astype(int), 1, 2047)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    uses = packing.solve(histogram, rounds=30)
    held = Counter()
    for pattern, times in uses.items():
        assert sum(a * b for a, b in pattern) <= packing.LENGTH
        for length, often in pattern:
            held[length] += often * times
    assert held == histogram
    best_fit = sum(packing._best_fit(histogram, packing.LENGTH).values())
    assert sum(uses.values()) <= 1.005 * best_fit
    spans = {}
    for length, low, high, *_ in packing.layout(uses):
        spans.setdefault(length, []).append((low, high))
    for length, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == histogram[length]
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert packing.solve({}) == Counter()


def test_rules_by_digest(tmp_path):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow"}

    def colliding(keys):
        return np.array([len(k) % 2 for k in keys], np.uint64)

    for digest in (urlfilter.digests_of, colliding):
        file = tmp_path / digest.__name__
        file.write_bytes(urlfilter.index_bytes(rules, digest))
        index = urlfilter.RuleIndex(str(file), digest)
        told = index.judge(
            [
                ("a.example.com", "/en/x"),
                ("www.example.com", "/en/"),
                ("example.com", "/e"),
                ("badexample.com", "/en/"),
                ("example.com", ""),
                ("com", "/"),
                ("", ""),
                ("x.org", "/"),
            ]
        )
        none = (None, None)
        assert told == [
            ("example.com/en/", "block"),
            ("www.example.com/en/", "allow"),
            ("com/", "allow"),
            ("com/", "allow"),
            none,
            ("com/", "allow"),
            none,
            none,
        ]


def test_archive_records_round_trip():
    data = warc.capture_records(7, "http://a\r\nb%0", b"x\r\n\r\ny", None)
    data += warc.capture_records(8, None, b"", 9)
    found = list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(data))))
    assert [h["warc-type"] for h, _ in found] == [
        "request", "response", "metadata", "request", "revisit", "metadata",
    ]
    assert warc._plain(found[1][0]["warc-target-uri"]) == "http://a\r\nb%0"
    assert found[1][1].endswith(b"\r\n\r\nx\r\n\r\ny")
    assert "warc-refers-to" in found[4][0] and "warc-target-uri" not in found[4][0]


def test_graph_finds_neighbours():
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(3000, 24)).astype(np.float32)
    square = (vectors**2).sum(axis=1)
    long = np.column_stack((vectors, np.sqrt(square.max() - square))).astype(np.float32)
    keys = np.arange(3000)
    levels = hnsw._levels(keys)
    order = np.lexsort((keys, -levels))
    graph = hnsw.Graph(long[order], levels[order])
    graph.build()
    queries = np.column_stack((vectors[:100], np.zeros(100, np.float32)))
    found = order[graph.search(queries, 10, hnsw.SEARCH_WIDTH)]
    want = np.argsort(-(vectors[:100] @ vectors.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want)])
    assert recall >= 0.9


def test_graph_finds_neighbours_in_clusters():
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(100, 32))[draw.integers(0, 100, 4000)]
    vectors = (vectors + 0.1 * draw.normal(size=vectors.shape)).astype(np.float32)
    square = (vectors**2).sum(axis=1)
    long = np.column_stack((vectors, np.sqrt(square.max() - square))).astype(np.float32)
    keys = np.arange(4000)
    levels = hnsw._levels(keys)
    order = np.lexsort((keys, -levels))
    graph = hnsw.Graph(long[order], levels[order])
    graph.build()
    queries = np.column_stack((vectors[:300], np.zeros(300, np.float32)))
    found = order[graph.search(queries, 20, hnsw.SEARCH_WIDTH)]
    want = np.argsort(-(vectors[:300] @ vectors.T), axis=1)[:, :20]
    assert all(len(set(row)) == 20 for row in found.tolist())
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)])
    assert recall >= 0.99


def test_kept_is_made_once_per_key():
    from promptloom.llm.common import kept

    made = []

    def make(value):
        return lambda: made.append(value) or value

    assert [kept(("t", k), make(k)) for k in (1, 1, 2, 1)] == [1, 1, 2, 1]
    assert made == [1, 2, 1]


def test_text_without_spaces_does_not_grow_the_memo():
    """50 MB in segments that never come again: a worker keeps none of them."""
    resource = pytest.importorskip("resource")
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"), added=True)
    encode("some words to begin with " * 100)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(500):
        encode(os.urandom(50_000).hex())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_memo_keeps_to_its_bytes():
    known = SegmentIds(lambda w: w.encode(), lambda t: t.encode(), memo_bytes=100_000)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"] * 3
    assert known.encode(" ".join(words)) == " ".join(words).encode()
    assert len(known) + len(known.before) < 100_000 // 150 + 2
    long = "x" * 100
    assert known[long] == long.encode() and long not in known


def test_byte_bpe_without_the_package_on_the_workers(tmp_path):
    """Only the driver finds the package; what travels to a worker needs no import."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import public_tokenizers
from pyspark.sql import SparkSession
from promptloom.llm.bpe import encode_decode_digests
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
path = public_tokenizers.path("byte_bpe_50k.tiktoken")
print(sorted(r.n_tokens for r in encode_decode_digests(docs, path, public_tokenizers.PATTERN).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert ran.stdout.strip().endswith("[0, 2]"), ran.stderr[-2000:]


def test_texts_are_cut_at_single_spaces(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, cut = Tokenizer.from_file(path), []

    class Segments:
        @staticmethod
        def findall(text):
            cut.append(text)
            return segments(text)

    segments = tokens._SEGMENTS.findall
    monkeypatch.setattr(tokens, "_SEGMENTS", Segments)
    encode = encoder(path, added=True, memo_bytes=20_000)

    def right(text):
        found = np.frombuffer(encode(text), "<u4").tolist()
        return found == library.encode(text, add_special_tokens=False).ids

    assert right("Plain words, for instance; and été (too), of w0rds and I'm.")
    assert all(" " not in text for text in cut)
    draw = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\xa0", "\u2003", "word", "Été", "I'm"]
    parts += ["end.", "12", "中", "x" * 40, "", "a,b", "<|endoftext|>", "!?"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert right(text), text
