"""Corpus operators on small tables: nulls, empty texts, repeats, empty tables, odd columns."""

import math
import random
import time
from collections import Counter

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from promptloom.llm import hnsw
from promptloom.llm.bitpack import read_ids, write_ids
from promptloom.llm.bpe import encode_decode
from promptloom.llm.chat import collapse, render
from promptloom.llm.hnsw import nearest
from promptloom.llm.minhash import near_duplicates
from promptloom.llm.packing import cut_documents, pack, sequences
from promptloom.llm.quality import quality
from promptloom.llm.queries import QUERIES, TWINS, URL_RULES
from promptloom.llm.toxicity import toxicity
from promptloom.llm.urlfilter import filter_urls
from promptloom.llm.warc import captures, read_records, write_archives
from promptloom.session import materialise

WORDS = " ".join(f"w{i}" for i in range(60))
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (1, WORDS, "s"),
    (2, WORDS.upper(), "s"),
    (3, WORDS.replace("w59", "other"), None),
    (4, " ".join(f"v{i}" for i in range(60)), "s"),
    (5, None, "s"),
    (6, "", "s"),
    (7, " \n ", "s"),
    (8, "two words", "t"),
    (9, "words two", "t"),
    (None, WORDS, "s"),
    (4, " ".join(f"v{i}" for i in range(60)), "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with all odd cases and columns that operators make themselves."""
    made = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = {c: F.lit(7) for c in ("kept", "n", "rules", "score", "ids", "host", "start", "lang")}
    return materialise(made.withColumns(clash), "docs")


def test_near_duplicates(spark, docs):
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert len(got) == len(ROWS)
    told = {r[0]: r[1:] for r in got}
    assert told[1][1:] == (1, True) and told[2] == (56, 1, False) and told[3] == (56, 1, False)
    assert told[4] == (56, 4, True) and told[None] == (56, None, True)
    assert [told[i] for i in (5, 6, 7)] == [(0, i, True) for i in (5, 6, 7)]
    assert told[8] == (1, 8, True) and told[9] == (1, 9, True)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_variants_of_one_text_link_as_by_brute_force(spark):
    """Edits of one text near the limit: some meet the main component's buckets, not its links."""
    draw = random.Random(3)
    rows, sets = [], []
    for i in range(90):
        words = [f"b{k}" for k in range(150)]
        for at in draw.sample(range(150), draw.randint(0, 9)):
            words[at] = f"x{draw.randint(0, 40)}"
        rows.append((i, " ".join(words)))
        sets.append({tuple(words[k : k + 5]) for k in range(146)})
    smallest = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    told = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in told} == dict(enumerate(smallest))
    assert 1 < len(set(smallest)) < 60


def test_quality(spark, docs):
    judged = quality(docs)
    assert judged.count() == len(ROWS) and judged.select("doc.*").columns == docs.columns
    kept = {r[0] for r in judged.where("kept").select("doc.doc_id").collect()}
    assert kept == {1, 2, 3, 4, None}
    assert quality(docs.limit(0)).count() == 0


def test_toxicity_without_labels_of_both_kinds(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    told = toxicity(docs, labels, out="score_").collect()
    assert len(told) == len(ROWS) and len({r["score_"] for r in told}) == 1
    assert toxicity(docs.limit(0), labels.limit(0), out="score_").count() == 0


def test_packing(spark, docs):
    pieces = materialise(cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1), "p")
    packed = pack(pieces)
    assert packed.count() == len(ROWS)
    whole = sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == pieces.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 8192 for r in whole)
    assert pack(pieces.limit(0)).count() == 0


def test_codec_and_files(spark, docs):
    coded = encode_decode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ).collect()
    texts = sorted((r[1] or "").encode() for r in ROWS)
    assert sorted(bytes(r["decoded"]) for r in coded) == texts
    back = read_ids(write_ids(docs, BYTES, end_id=0, file_ids=50)).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    ends = [r["start"] + r["n_tokens"] for r in back]
    assert [r["start"] for r in back] == [0, *ends[:-1]]
    assert read_ids(write_ids(docs.limit(0), BYTES, end_id=0)).count() == 0


def test_neighbours(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    rows += [(100 + i, [9.0, 9.0, 9.0]) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 3), (202, [None, 1.0, 1.0]), (203, [float("nan"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (5, [5.0, 1.0, 2.0]), (204, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(table, table.where("vec_id % 20 = 0"), k=20).collect()
    good = {i: v for i, v in rows if i is not None and i < 200}
    for query in (0, 20, 40, 100, 120):
        score = {i: sum(a * b for a, b in zip(v, good[query])) for i, v in good.items() if i != query}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == query)
        assert [v for _, v in own] == want and [r for r, _ in own] == list(range(1, 21))
    assert {r["query_id"] for r in got} == {0, 20, 40, 100, 120}
    assert nearest(table.limit(0), table.limit(0)).count() == 0


def test_archives(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u\n", None), (4, "u", ""), (5, "u", "own")]
    rows += [(None, "u", "same"), (5, "u", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumn("digest", F.lit(1)).withColumn("of", F.lit(1))
    told = captures(read_records(write_archives(pages))).collect()
    shown = {
        r["page_id"]: (r["record"]["type"], r["revisited"] and r["revisited"]["page_id"])
        for r in told
    }
    assert len(told) == 6
    assert shown == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None),
        5: ("response", None), None: ("revisit", 2),
    }
    assert all(r["request"] and r["metadata"] for r in told)
    assert captures(read_records(write_archives(pages.limit(0)))).count() == 0
    long = write_archives(pages, min_bytes=4)
    assert captures(read_records(long)).where("record.type = 'revisit'").count() == 2


def test_every_page_is_a_capture(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "v", "same"), (1, None, "same"), (1, "v", "same"), (None, "u", "n")]
    rows += [(None, "u", "n"), (None, "w", "n"), (None, None, "same"), (2, "x", "own"), (3, "", "o2")]
    rows += [(3, None, "o2"), *[(9, "hot", "h")] * 250]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    told = QUERIES["op9_warc"](spark, str(tmp_path)).collect()
    shown = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in told)
    assert shown == {
        (1, "response", None): 1, (1, "revisit", 1): 3, (None, "response", None): 3,
        (None, "revisit", 1): 1, (2, "response", None): 1, (3, "response", None): 1,
        (3, "revisit", 3): 1, (9, "response", None): 1, (9, "revisit", 9): 249,
    }
    assert all(r["payload_bytes"] for r in told)
    whole = captures(read_records(write_archives(pages, every_row=True))).collect()
    assert len({r["record"]["record_id"] for r in whole}) == len(rows)
    given = Counter((r["page_id"], r["record"]["uri"]) for r in whole)
    assert given == Counter((page, url) for page, url, _ in rows)
    apart = captures(read_records(write_archives(pages))).count()
    assert apart == len(set(rows))


def test_urls_with_a_line_break_in_the_host(spark):
    urls = ["http://a\nx.net/es/1", "http://\n.net/fr/", "http://\n/es/", "http://é\nb.example.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    told = {r["row"]["page_id"]: tuple(r)[1:] for r in filter_urls(pages, URL_RULES).collect()}
    assert told == {
        0: ("a\nx.net", "/es/1", "net/es/", "block"),
        1: ("\n.net", "/fr/", "net/fr/", "block"),
        2: ("\n", "/es/", None, "allow"),
        3: ("é\nb.example.com", "/en/", "example.com/en/", "block"),
    }


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/x?q"), (2, None), (3, "no scheme"), (3, "no scheme")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    told = {r["row"]["page_id"]: tuple(r)[1:] for r in filter_urls(pages, URL_RULES).collect()}
    assert told[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert told[2] == told[3] == ("", "", None, "allow")
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_snapshots(spark):
    turns = [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "b", "c"]), (5, [None])]
    turns += [(6, [""]), (7, ["a", "x"]), (None, ["a"])]
    rows = [(c, i, "user", t) for c, own in turns for i, t in enumerate(own)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = {r["conv_id"]: r["rendered"] for r in render(collapse(table), block_turns=2).collect()}
    assert set(told) == {3, 5, 6, 7}
    blocks = render(collapse(table), block_turns=2).where("conv_id = 3").orderBy("block").collect()
    assert [b["n_turns"] for b in blocks] == [2, 1]
    assert told[7] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert collapse(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twins(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], TWINS[name], sf_dir) is None


def test_pipeline(spark, sf_dir):
    told = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < told.select("doc_id").distinct().count() < docs.count()
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_urls_with_very_long_hosts(spark):
    """A host of half a million labels costs no more than the longest rule's host."""
    host = "a." * 500_000
    urls = [f"http://{host}example.com/en/x", f"http://{host}", "http://" + "y" * 1_000_000 + "/es/", "http://net./es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    start = time.time()
    told = {r.row.page_id: r.rule for r in filter_urls(df, URL_RULES).collect()}
    assert told == {0: "example.com/en/", 1: None, 2: None, 3: None}
    assert time.time() - start < 30


def test_copies_of_a_conversation_meet_as_one_row(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(50) for t in range(2)]
    turns += [(99, t, "user", f"t{t}") for t in range(3)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    assert {r.conv for r in collapse(df).collect()} == {99}
    assert {r.conv for r in collapse(df.where("conv_id < 99")).collect()} == {0}


def test_pipeline_keeps_unrelated_texts_of_one_id(spark, sf_dir):
    """Near-dedup by id and text, against the same done by hand."""
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(60))
    rows = [
        (1, a), (2, a.upper()), (2, b), (3, b + " end"), (4, "short text"), (4, "another text"), (4, "short text"),
        (None, a), (None, None), (7, None), (7, ""), (8, a + " more"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    df = made.withColumns({c: F.lit(1) for c in ("key", "digest", "kept", "lang")})
    left = corpus_pipeline.drop_near_duplicates(spark, df, sf_dir)
    assert left.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got == Counter(
        [(1, a), (2, b), (4, "short text"), (4, "another text"), (None, a), (None, None), (7, None), (7, "")]
    )


def test_shards_follow_the_rows_not_the_partitions(spark, monkeypatch):
    """As many shards however many tasks a range partitioning is given."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1 + 20 * (i % 2)) for _ in range(4)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(hnsw, "LEAST_ROWS", 200)
    plain, counts = type(table).repartitionByRange, []
    monkeypatch.setattr(
        type(table), "repartitionByRange", lambda df, n, *by: plain(df, max(n, 40), *by)
    )
    built = hnsw.build_shards
    monkeypatch.setattr(hnsw, "build_shards", lambda df, n: counts.append(n) or built(df, n))
    got = nearest(table, table.where("vec_id % 100 = 0"), k=5).collect()
    assert len(got) == 30
    bands = len({math.floor(math.log2(sum(x * x for x in v)) / 2 + 0.25) for _, v in rows})
    assert counts[0] <= 3 + bands


def test_reading_files_forgets_the_encoder(spark, docs, monkeypatch):
    files = write_ids(docs, BYTES, end_id=0)
    asked = spark.sparkContext.accumulator(0)
    monkeypatch.setattr("promptloom.llm.bitpack.forget", lambda: asked.add(1))
    assert read_ids(files).count() == len(ROWS) and asked.value > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
