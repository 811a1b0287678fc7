"""One query per corpus operator on the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from promptloom.llm.bitpack import read_ids, write_ids
from promptloom.llm.bpe import encode_decode_digests
from promptloom.llm.chat import collapse, render
from promptloom.llm.collocations import collocations
from promptloom.llm.hnsw import nearest
from promptloom.llm.minhash import near_duplicates
from promptloom.llm.negatives import hard_negatives
from promptloom.llm.packing import pack_documents
from promptloom.llm.quality import quality
from promptloom.llm.setjoin import jaccard_components
from promptloom.llm.toxicity import held_out, toxicity
from promptloom.llm.urlfilter import filter_urls
from promptloom.llm.warc import captures, read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=1)


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc.doc_id", "rules.*", "kept")


TWINS["op6_host_quality"] = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k
  FROM split, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, range(5) AS r(j) GROUP BY doc_id
), counted AS (
  SELECT doc_id, source, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)),
            lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)
), base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f
  FROM base WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS h FROM hosts
), prior AS (
  SELECT m, CASE WHEN q - m * m - h * m * (1 - m) <= 0 THEN 1e6
    ELSE greatest(1.0, least(1e6, m * (1 - m) / (q - m * m - h * m * (1 - m)) - 1)) END AS k
  FROM sums
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce((f + k * m) / (n + k) <= 0.5, true) AS kept
FROM base LEFT JOIN hosts USING (source) LEFT JOIN prior ON true
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"]
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    files = write_ids(table(spark, sf_dir, "documents"), vocabulary, end_id=0)
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


# the rules of the url query
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"), URL_RULES, carry=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


TWINS["op4_url_filter"] = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('com/', 'allow'), ('example.com/en/', 'block'),
    ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')) AS r(rule, verdict)
), cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fitting AS (
  SELECT page_id, host, path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
  FROM cut LEFT JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), every_row=True)
    return captures(read_records(archives, with_payload=False), with_payload=False).select(
        "page_id",
        F.coalesce("record.payload_bytes", "revisited.payload_bytes").alias("payload_bytes"),
        F.col("record.digest").alias("payload_digest"),
        F.col("record.type").alias("record_type"),
        F.col("revisited.page_id").alias("refers_to"),
    )


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse(table(spark, sf_dir, "conversations")))


TWINS["op10_chat"] = r"""
WITH whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)) || chr(2), ''
      ORDER BY turn, role, text) AS said,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
      || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
)
SELECT conv_id, 0::BIGINT AS block, n_turns, rendered FROM whole AS a
WHERE NOT EXISTS (SELECT 1 FROM whole AS b WHERE starts_with(b.said, a.said)
  AND (len(b.said) > len(a.said) OR b.conv_id < a.conv_id))
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


TWINS["op13_hard_negatives"] = r"""
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q AS a JOIN q AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


TWINS["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM split, range(1, 6) AS s(k), unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts
  WHERE k > 1 AND f >= 100
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM candidates, range(2, 5) AS s(m), range(1, 5) AS t(i)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, j,
    (1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM candidates AS c JOIN range(1, 5) AS s(j) ON j < c.k
  JOIN counts AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN counts AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 : c.k], ' ')
  JOIN totals AS t ON t.lang = c.lang
  LEFT JOIN inner_phrases AS o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE longest IS NULL OR 100 * longest < 100 * c.a
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM scored QUALIFY rank <= 2000
"""


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
