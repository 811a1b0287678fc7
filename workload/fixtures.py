"""Inputs of the queries, derived from the given tables in Spark and in SQL.

``*_SQL`` strings are common table expressions with the same rows as the
function of the same name. The two were written separately: the SQL ones do not
use anything of the package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.bind import bind
from promptloom.operators.generate import ExpressionBackend
from promptloom.sources.prompts import OutlinePrompts
from workload.registry import documents

# ---- requests ---------------------------------------------------------------

REQUESTS_SQL = "requests AS (SELECT doc_id AS request_id, text AS request FROM documents)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question; copies of a document are repeated questions."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("request")
    )


LINES_SQL = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x != "")


MULTI_SQL = f"""
line_lists AS (SELECT doc_id AS request_id, {LINES_SQL} AS l FROM documents),
multi AS (SELECT request_id, CASE WHEN len(l) = 0 THEN [''] WHEN len(l) % 2 = 1 THEN l
    ELSE list_append(l[1:len(l) - 2], l[-2] || chr(10) || l[-1]) END AS messages FROM line_lists)
"""


def multi_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as messages; of an even number the last two are one."""
    last = lambda l, n: F.get(l, F.size(l) - n)
    odd = bind(
        lines(F.col("text")),
        lambda l: F.when(F.size(l) == 0, F.array(F.lit("")))
        .when(F.size(l) % 2 == 1, l)
        .otherwise(
            F.array_append(
                F.slice(l, F.lit(1), F.size(l) - 2),
                F.concat(last(l, 2), F.lit("\n"), last(l, 1)),
            )
        ),
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"), odd.alias("messages")
    )


# ---- a deterministic model --------------------------------------------------

PROMPTS = OutlinePrompts(
    outline_prompt=(
        "Question:\n{request}\nList {{short}} points. [ROLESWITCHING assistant:] 1."
    ),
    point_prompt=(
        "Q: {request}\nOutline:\n{outline}\nWrite point {point}. "
        "[ROLESWITCHING assistant:]{point}. {point_outline}"
    ),
)

PLAIN_PROMPTS = OutlinePrompts(
    outline_prompt="Number the points of: {request}",
    point_prompt='Q: {request}\nOutline:\n{outline}\nStart with "{point}. {point_outline}".',
)


def model_answer(messages: Column) -> Column:
    """A point is answered with the digest of all that was asked; anything else
    with all its lines numbered, every seventh with a number that has been before, or
    now and then without any number."""

    def outline(asked: Column) -> Column:
        number = lambda i: i + 1 - F.when(i % 7 == 6, 3).otherwise(0)
        numbered = F.transform(
            lines(asked), lambda x, i: F.concat(number(i).cast("string"), F.lit(". "), x)
        )
        return F.when(F.length(asked) % 11 == 0, "no points here").otherwise(
            F.array_join(numbered, "\n")
        )

    return bind(
        F.array_join(messages, "\n"),
        lambda asked: F.when(
            asked.startswith("Q: "), F.concat(F.lit(" \t"), F.md5(asked), F.lit("\n"))
        ).otherwise(outline(asked)),
    )


MODEL = ExpressionBackend(model_answer)


def python_model():
    """The same model as a Python callable."""
    import hashlib

    def call(asked: list[list], settings: list[dict]) -> list[str]:
        texts = []
        for messages in asked:
            whole = "\n".join(m for m in messages if m is not None)
            if whole.startswith("Q: "):
                texts.append(" \t" + hashlib.md5(whole.encode()).hexdigest() + "\n")
            elif len(whole) % 11 == 0:
                texts.append("no points here")
            else:
                kept = [x for x in whole.split("\n") if x != ""]
                texts.append("\n".join(f"{i + 1 - 3 * (i % 7 == 6)}. {x}" for i, x in enumerate(kept)))
        return texts

    return call


def outline_answer_sql(whole: str) -> str:
    return f"""CASE WHEN length({whole}) % 11 = 0 THEN 'no points here'
        ELSE array_to_string(list_transform(
            list_filter(string_split({whole}, chr(10)), lambda x: x <> ''),
            lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END"""


POINT_SQL = r"'([0-9]+)\.[\t\n\f\r ]?((?s:.)[^\n]*)'"

# question, partial answer and outline of every request, then its first points
SWITCHED_SQL = f"""
asked AS (SELECT request_id, request,
    'Question:' || chr(10) || request || chr(10) || 'List {{short}} points. ' AS question,
    ' 1.' AS partial FROM requests),
outlines AS (SELECT request_id, request,
    partial || {outline_answer_sql("(question || chr(10) || partial)")} AS outline FROM asked)
"""

PLAIN_SQL = f"""
asked AS (SELECT request_id, request, 'Number the points of: ' || request AS question FROM requests),
outlines AS (SELECT request_id, request, {outline_answer_sql("question")} AS outline FROM asked)
"""

POINTS_SQL = f"""
found AS (SELECT request_id, request, outline,
    regexp_extract_all(outline, {POINT_SQL}, 1) AS numbers,
    regexp_extract_all(outline, {POINT_SQL}, 2) AS texts FROM outlines),
flat AS (SELECT request_id, request, outline, unnest(numbers) AS point,
    unnest(texts) AS point_outline, unnest(range(0, len(numbers))) AS spot FROM found),
firsts AS (SELECT *, row_number() OVER (PARTITION BY request_id, point ORDER BY spot) AS nth FROM flat),
points AS (SELECT request_id, request, outline, point, point_outline,
    CAST(row_number() OVER (PARTITION BY request_id ORDER BY spot) - 1 AS INTEGER) AS pos
    FROM firsts WHERE nth = 1)
"""

SWITCHED_CONTENT_SQL = """
contents AS (SELECT request_id, pos, point, point_outline, outline,
    point || '. ' || point_outline AS partial,
    chr(32) || chr(9) || md5('Q: ' || request || chr(10) || 'Outline:' || chr(10) || outline || chr(10)
        || 'Write point ' || point || '. ' || chr(10) || point || '. ' || point_outline)
        || chr(10) AS text FROM points)
"""

PLAIN_CONTENT_SQL = """
contents AS (SELECT request_id, pos, point, point_outline, outline, NULL AS partial,
    chr(32) || chr(9) || md5('Q: ' || request || chr(10) || 'Outline:' || chr(10) || outline || chr(10)
        || 'Start with "' || point || '. ' || point_outline || '".')
        || chr(10) AS text FROM points)
"""

# ---- answer tables ----------------------------------------------------------

ANSWERS_SQL = """
answers_0 AS (SELECT doc_id AS request_id, text AS request, text AS response FROM documents),
answers_1 AS (SELECT doc_id AS request_id, text AS request, 'Second: ' || text AS response FROM documents),
answers_2 AS (SELECT doc_id AS request_id, text AS request, md5(text) || ' ' || text AS response FROM documents)
"""


def answers(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    text = F.col("text")
    response = [text, F.concat(F.lit("Second: "), text), F.concat(F.md5(text), F.lit(" "), text)]
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        text.alias("request"),
        response[which].alias("response"),
    )


# ---- reviews ----------------------------------------------------------------

SCORE_REVIEWS_SQL = """
reviews AS (SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN (doc_id % 10)::VARCHAR || ' ' || (doc_id % 7)::VARCHAR || chr(10) || text
    WHEN 1 THEN (doc_id % 10)::VARCHAR || ',' || (doc_id % 7)::VARCHAR || '.5'
    WHEN 2 THEN (doc_id % 10)::VARCHAR || ', ' || (doc_id % 7)::VARCHAR
    WHEN 3 THEN text || chr(10) || '(' || (doc_id % 10)::VARCHAR || ', ' || (doc_id % 7)::VARCHAR || ')'
    WHEN 4 THEN '(8,' || (doc_id % 10)::VARCHAR || ')(7,6)'
    WHEN 5 THEN '-2,-2'
    WHEN 6 THEN ''
    ELSE text END AS review FROM documents)
"""


def score_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge may write about a pair, in eight kinds."""
    id_, text = F.col("doc_id"), F.col("text")
    a, b = (id_ % 10).cast("string"), (id_ % 7).cast("string")
    kinds = [
        F.concat(a, F.lit(" "), b, F.lit("\n"), text),
        F.concat(a, F.lit(","), b, F.lit(".5")),
        F.concat(a, F.lit(", "), b),
        F.concat(text, F.lit("\n("), a, F.lit(", "), b, F.lit(")")),
        F.concat(F.lit("(8,"), a, F.lit(")(7,6)")),
        F.lit("-2,-2"),
        F.lit(""),
    ]
    return documents(spark, sf_dir).select("doc_id", _pick(id_ % 8, kinds, text).alias("review"))


def _pick(number: Column, kinds: list[Column], default: Column) -> Column:
    chosen = F.when(number == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], start=1):
        chosen = chosen.when(number == i, kind)
    return chosen.otherwise(default)


ORDER_REVIEWS_SQL = """
reviews AS (SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN 'Assistant 1 > Assistant 2 > Assistant 3'
    WHEN 1 THEN text || chr(10) || 'Assistant 3 = Assistant 1 > Assistant 2'
    WHEN 2 THEN 'Assistant 2 >= Assistant 3 = Assistant 1'
    WHEN 3 THEN 'Assistant 1 > Assistant 2. Or: Assistant 2 = Assistant 3 >> Assistant 1'
    WHEN 4 THEN 'Assistant 1 > Assistant 2 > Assistant 4'
    WHEN 5 THEN 'Assistant 2 > Assistant 2 > Assistant 0'
    WHEN 6 THEN 'Assistant 1 = Assistant 2 = Assistant 3 = Assistant 1'
    ELSE text END AS review FROM documents)
"""


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge may write about three answers, in eight kinds."""
    id_, text = F.col("doc_id"), F.col("text")
    kinds = [
        F.lit("Assistant 1 > Assistant 2 > Assistant 3"),
        F.concat(text, F.lit("\nAssistant 3 = Assistant 1 > Assistant 2")),
        F.lit("Assistant 2 >= Assistant 3 = Assistant 1"),
        F.lit("Assistant 1 > Assistant 2. Or: Assistant 2 = Assistant 3 >> Assistant 1"),
        F.lit("Assistant 1 > Assistant 2 > Assistant 4"),
        F.lit("Assistant 2 > Assistant 2 > Assistant 0"),
        F.lit("Assistant 1 = Assistant 2 = Assistant 3 = Assistant 1"),
    ]
    return documents(spark, sf_dir).select("doc_id", _pick(id_ % 8, kinds, text).alias("review"))


def order_sql(review: str, n: int, source: str, keep: str) -> str:
    """CTEs ending in ``ordered(keep…, places)``: the ranks read from ``review``."""
    return f"""
chains AS (SELECT {keep}, list_filter(
        regexp_extract_all(replace(replace({review}, '>=', '>'), '>>', '>'),
            '(?:Assistant [0-9]+(?: [>=] Assistant [0-9]+)+)'),
        lambda c: len(regexp_extract_all(c, 'Assistant')) = {n})[1] AS chain FROM {source}),
named AS (SELECT {keep}, chain,
    list_transform(regexp_extract_all(chain, '[0-9]+'), lambda d: TRY_CAST(d AS INTEGER)) AS who,
    regexp_extract_all(chain, '[>=]') AS signs FROM chains),
ranked AS (SELECT {keep}, chain, who, list_transform(who, lambda w, k:
    1 + coalesce(list_max(list_transform(signs,
        lambda s, j: CASE WHEN s = '>' AND j < k THEN j ELSE 0 END)), 0)) AS ranks FROM named),
ordered AS (SELECT {keep}, CASE
    WHEN chain IS NULL OR len(list_filter(who, lambda w: w IS NULL OR w > {n})) > 0
        THEN {[-1] * n}
    ELSE list_transform(range(1, {n + 1}), lambda m: coalesce(list_filter(
        list_transform(ranks, lambda r, k:
            CASE WHEN (CASE WHEN who[k] = 0 THEN {n} ELSE who[k] END) = m THEN r END),
        lambda r: r IS NOT NULL)[-1], 0)) END AS places FROM ranked)
"""


SCORE_NUMBER_SQL = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def score_sql(review: str, source: str, keep: str) -> str:
    """CTEs ending in ``scored(keep…, score1, score2)``."""
    paren = r"'\(([0-9]+\.*[0-9]*), *([0-9]+\.*[0-9]*)\)'"
    return f"""
tokens AS (SELECT {keep}, {review} AS r,
    string_split(replace(string_split({review}, chr(10))[1], ',', ' '), ' ') AS w FROM {source}),
scored AS (SELECT {keep}, CASE
        WHEN len(w) = 2 AND regexp_matches(w[1], {SCORE_NUMBER_SQL}) AND regexp_matches(w[2], {SCORE_NUMBER_SQL})
            THEN TRY_CAST(w[1] AS DOUBLE)
        WHEN len(regexp_extract_all(r, {paren})) <> 1 THEN -1.0
        ELSE TRY_CAST(regexp_extract_all(r, {paren}, 1)[1] AS DOUBLE) END AS score1,
    CASE WHEN len(w) = 2 AND regexp_matches(w[1], {SCORE_NUMBER_SQL}) AND regexp_matches(w[2], {SCORE_NUMBER_SQL})
            THEN TRY_CAST(w[2] AS DOUBLE)
        WHEN len(regexp_extract_all(r, {paren})) <> 1 THEN -1.0
        ELSE TRY_CAST(regexp_extract_all(r, {paren}, 2)[1] AS DOUBLE) END AS score2 FROM tokens)
"""


# ---- judges -----------------------------------------------------------------

PAIR_TEMPLATE = (
    "[Question]\n{question}\n\n[Answer 1]\n{answer_1}\n\n[Answer 2]\n{answer_2}\n\n[Task]\n{prompt}\n"
)
PAIR_PROMPT = "Give two scores."
LIST_PROMPT = "Order the {num_str} assistants, 1 to {num}."


def pair_prompt_sql(question: str, one: str, two: str) -> str:
    return f"""('[Question]' || chr(10) || {question} || chr(10) || chr(10) || '[Answer 1]' || chr(10) || {one}
        || chr(10) || chr(10) || '[Answer 2]' || chr(10) || {two} || chr(10) || chr(10)
        || '[Task]' || chr(10) || 'Give two scores.' || chr(10))"""


def pair_review(messages: Column) -> Column:
    """Two hex digits of the digest, so some reviews cannot be read."""
    return bind(
        F.md5(F.array_join(messages, "\n")),
        lambda d: F.concat(F.substring(d, 1, 1), F.lit(" "), F.substring(d, 2, 1)),
    )


PAIR_JUDGE = ExpressionBackend(pair_review)


def list_review(messages: Column) -> Column:
    return bind(
        F.substring(F.md5(F.array_join(messages, "\n")), 1, 1),
        lambda d: F.when(d < "4", "So: Assistant 2 > Assistant 1 >= Assistant 3")
        .when(d < "8", "Assistant 1 = Assistant 3 > Assistant 2")
        .when(d < "c", "Assistant 3 > Assistant 1")
        .otherwise("All are fine."),
    )


LIST_JUDGE = ExpressionBackend(list_review)


def list_prompt_sql(question: str, shown: list[str], num: int, word: str) -> str:
    blocks = " || chr(10) || chr(10) || ".join(
        f"'[Assistant {i}]' || chr(10) || {a} || chr(10) || chr(10) || '[End of Assistant {i}]'"
        for i, a in enumerate(shown, start=1)
    )
    return f"""('[Question]' || chr(10) || {question} || chr(10) || chr(10) || {blocks}
        || chr(10) || chr(10) || '[System]' || chr(10)
        || 'Order the {word} assistants, 1 to {num}.' || chr(10) || chr(10))"""


# ---- chunk streams ----------------------------------------------------------

N_CHUNKS = 12
# bytes of text whose snapshots, several times as much, one task makes
CHUNK_TASK_BYTES = 16 << 20

CHUNKS_SQL = f"""
words AS (SELECT doc_id AS request_id, string_split(text, ' ') AS w FROM documents),
chunks AS (SELECT request_id, k AS seq,
    array_to_string(w[1:CAST(ceil(len(w) * (k + 1) / {N_CHUNKS}.0) AS BIGINT)], ' ') AS text
    FROM words, range(0, {N_CHUNKS}) r(k))
"""

OTHER_CHUNKS_SQL = """
sized AS (SELECT request_id, w, 5 + len(w) % 13 AS c FROM words),
others AS (SELECT request_id, k AS seq,
    array_to_string(w[1:CAST(ceil(len(w) * (k + 1) / c::DOUBLE) AS BIGINT)], ' ') AS text
    FROM (SELECT request_id, w, c, unnest(range(0, c)) AS k FROM sized))
"""


def chunks(spark: SparkSession, sf_dir: str, uneven: bool = False) -> DataFrame:
    """Every document as a stream of growing snapshots, the last one whole:
    twelve of them, or 5 to 17 depending on the number of words."""
    n_words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    n_chunks = (5 + n_words % 13).cast("int") if uneven else F.lit(N_CHUNKS)
    at = F.explode(F.sequence(F.lit(0), n_chunks - 1))
    cut = "int(ceil(n * (seq + 1) / c))"
    texts = documents(spark, sf_dir)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(-(-size // CHUNK_TASK_BYTES), spark.sparkContext.defaultParallelism)
    # by request, so that a request's snapshots are where they are put together
    return (
        texts.repartition(tasks, "doc_id")
        .select(F.col("doc_id").alias("request_id"), "text", n_words.alias("n"), n_chunks.alias("c"), at.alias("seq"))
        .select("request_id", "seq", F.expr(f"substring_index(text, ' ', {cut})").alias("text"))
    )
