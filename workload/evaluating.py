"""Pairing answers, running schedulers and judges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from promptloom.functions.messages import as_messages
from promptloom.functions.scores import FAILED_REVIEW, parse_score_pair
from promptloom.operators.backends import get_backend
from promptloom.operators.generate import (
    Answer,
    ExpressionBackend,
    PythonBackend,
    error_sentinel,
    gen_params,
    generate,
)
from promptloom.operators.pairing import (
    CRITERIA,
    align_n_answers,
    criteria_cross,
    number_occurrences,
    pair_answers,
    permute_answers,
    split_route,
    swap_directions,
    template_lookup,
    unpermute_order,
)
from promptloom.operators.points import assemble_blank_line, assemble_newline, explode_points
from promptloom.operators.resume import skip_done
from promptloom.plans import schedulers
from promptloom.plans.dump import dump
from promptloom.plans.experiment import experiment_grid, grid_answers, run_grid
from promptloom.plans.judge import (
    judge_list,
    judge_list_by_criteria,
    judge_pair,
    judge_pair_by_category,
    pivot_list_orders,
)
from promptloom.session import materialise, scratch_path
from workload.fixtures import (
    ANSWERS_SQL,
    LIST_JUDGE,
    LIST_PROMPT,
    MODEL,
    MULTI_SQL,
    PAIR_JUDGE,
    PAIR_PROMPT,
    PAIR_TEMPLATE,
    PLAIN_CONTENT_SQL,
    PLAIN_PROMPTS,
    PLAIN_SQL,
    POINTS_SQL,
    PROMPTS,
    REQUESTS_SQL,
    SWITCHED_CONTENT_SQL,
    SWITCHED_SQL,
    answers,
    list_prompt_sql,
    outline_answer_sql,
    multi_turn,
    order_sql,
    pair_prompt_sql,
    python_model,
    requests,
    score_sql,
)
from workload.registry import query, table

# ---- resuming and pairing ---------------------------------------------------


@query(
    "skip_done",
    """SELECT doc_id AS request_id, md5(text) AS digest FROM documents WHERE text NOT IN (
        SELECT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
)
def q_skip_done(spark, sf_dir):
    done = requests(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id")), "request_id"
    )
    left = skip_done(requests(spark, sf_dir), done)
    return left.select("request_id", F.md5("request").alias("digest"))


@query(
    "pair_answers",
    f"""WITH {ANSWERS_SQL}
    SELECT a.request_id, a.request, a.response AS answer_1, b.response AS answer_2
    FROM answers_0 a JOIN answers_1 b ON a.request_id = b.request_id""",
)
def q_pair_answers(spark, sf_dir):
    return pair_answers(answers(spark, sf_dir, 0), answers(spark, sf_dir, 1), ["request_id"])


_OCCURRENCE = "row_number() OVER (PARTITION BY request ORDER BY request_id) AS occurrence"


@query(
    "pair_answers_by_occurrence",
    f"""WITH {ANSWERS_SQL}, a AS (SELECT *, {_OCCURRENCE} FROM answers_0), b AS (SELECT *, {_OCCURRENCE} FROM answers_1)
    SELECT a.occurrence, a.request, a.response AS answer_1, b.response AS answer_2
    FROM a JOIN b ON a.request = b.request AND a.occurrence = b.occurrence""",
)
def q_pair_by_occurrence(spark, sf_dir):
    first = number_occurrences(answers(spark, sf_dir, 0))
    second = number_occurrences(answers(spark, sf_dir, 1))
    return pair_answers(first, second, ["request", "occurrence"])


@query(
    "align_n_answers",
    f"""WITH {ANSWERS_SQL}
    SELECT a.request_id, a.request, 3 AS n, a.response AS answer_1, b.response AS answer_2, c.response AS answer_3
    FROM answers_0 a JOIN answers_1 b ON a.request_id = b.request_id JOIN answers_2 c ON a.request_id = c.request_id""",
)
def q_align_n_answers(spark, sf_dir):
    aligned = align_n_answers([answers(spark, sf_dir, i) for i in range(3)])
    return aligned.select(
        "request_id",
        "request",
        F.size("answers").alias("n"),
        *[F.col("answers")[i].alias(f"answer_{i + 1}") for i in range(3)],
    )


def _categories(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("text").alias("request"))
        .agg(F.min("lang").alias("category"))
    )


_TEMPLATE_TEXTS = {
    "en": "In English: {question} A: {answer_1} B: {answer_2} {prompt}",
    "de": "Auf Deutsch: {question} A: {answer_1} B: {answer_2} {prompt}",
    "general": "{question} A: {answer_1} B: {answer_2} {prompt}",
}


def _templates(spark, sf_dir):
    """One row per language that has a template, and the default."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    named = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("general")
    text = F.create_map(*[F.lit(x) for pair in _TEMPLATE_TEXTS.items() for x in pair])
    return (
        langs.select(named.alias("category"))
        .distinct()
        .select(
            "category",
            F.concat(F.lit("Score as "), "category").alias("prompt"),
            text[F.col("category")].alias("prompt_template"),
        )
    )


_LOOKUP_SQL = """
cats AS (SELECT text AS request, min(lang) AS category FROM documents GROUP BY text),
told AS (SELECT doc_id AS request_id, text AS request, category,
    CASE WHEN category IN ('en', 'de') THEN category ELSE 'general' END AS used
    FROM documents JOIN cats ON documents.text = cats.request)
"""


@query(
    "template_lookup",
    f"""WITH {_LOOKUP_SQL}
    SELECT request_id, category, 'Score as ' || used AS prompt, CASE used WHEN 'en' THEN 'In English: '
        WHEN 'de' THEN 'Auf Deutsch: ' ELSE '' END
        || '{{question}} A: {{answer_1}} B: {{answer_2}} {{prompt}}' AS prompt_template FROM told""".replace(
        "{{", "{"
    ).replace("}}", "}"),
)
def q_template_lookup(spark, sf_dir):
    found = template_lookup(
        requests(spark, sf_dir), _categories(spark, sf_dir), _templates(spark, sf_dir)
    )
    return found.select("request_id", "category", "prompt", "prompt_template")


@query(
    "swap_directions",
    f"""WITH {ANSWERS_SQL}, p AS (
        SELECT a.request_id, a.response AS x, b.response AS y FROM answers_0 a JOIN answers_1 b ON a.request_id = b.request_id)
    SELECT request_id, 1 AS direction, x AS shown_1, y AS shown_2 FROM p
    UNION ALL SELECT request_id, 2, y, x FROM p""",
)
def q_swap_directions(spark, sf_dir):
    pairs = pair_answers(answers(spark, sf_dir, 0), answers(spark, sf_dir, 1), ["request_id"])
    return swap_directions(pairs).drop("request")


_ORDERS_SQL = """
orders3 AS (SELECT x.i AS p1, y.i AS p2, z.i AS p3,
    CAST(row_number() OVER (ORDER BY x.i, y.i, z.i) - 1 AS INTEGER) AS perm_index
    FROM range(0, 3) x(i), range(0, 3) y(i), range(0, 3) z(i)
    WHERE x.i <> y.i AND x.i <> z.i AND y.i <> z.i),
aligned AS (SELECT a.request_id, a.request, [a.response, b.response, c.response] AS answers
    FROM answers_0 a JOIN answers_1 b ON a.request_id = b.request_id JOIN answers_2 c ON a.request_id = c.request_id),
permuted AS (SELECT request_id, request, perm_index, p1, p2, p3, answers[p1 + 1] AS s1, answers[p2 + 1] AS s2,
    answers[p3 + 1] AS s3 FROM aligned, orders3)
"""


@query(
    "permute_answers",
    f"""WITH {ANSWERS_SQL}, {_ORDERS_SQL}
    SELECT request_id, perm_index, p1::VARCHAR || p2::VARCHAR || p3::VARCHAR AS permutation,
        md5(s1 || '|' || s2 || '|' || s3) AS shown FROM permuted""",
)
def q_permute_answers(spark, sf_dir):
    aligned = align_n_answers([answers(spark, sf_dir, i) for i in range(3)])
    return permute_answers(aligned, 3).select(
        "request_id",
        "perm_index",
        F.array_join(F.transform("permutation", lambda p: p.cast("string")), "").alias("permutation"),
        F.md5(F.array_join("shown", "|")).alias("shown"),
    )


@query(
    "unpermute_order",
    f"""WITH {ANSWERS_SQL}, {_ORDERS_SQL}
    SELECT request_id, perm_index, list_position([p1, p2, p3], 0)::INTEGER * 10 AS place1,
        list_position([p1, p2, p3], 1)::INTEGER * 10 AS place2, list_position([p1, p2, p3], 2)::INTEGER * 10 AS place3
    FROM permuted""",
)
def q_unpermute_order(spark, sf_dir):
    aligned = align_n_answers([answers(spark, sf_dir, i) for i in range(3)])
    order = F.lit([10, 20, 30])
    back = permute_answers(aligned, 3).withColumn("o", unpermute_order(F.col("permutation"), order))
    return back.select(
        "request_id", "perm_index", *[F.col("o")[i].alias(f"place{i + 1}") for i in range(3)]
    )


@query(
    "criteria_cross",
    """SELECT doc_id AS request_id, criterion, 'Rate the ' || criterion AS prompt FROM documents,
        (SELECT unnest(['general', 'relevance', 'diversity', 'coherence', 'immersion', 'integrity']) AS criterion)""",
)
def q_criteria_cross(spark, sf_dir):
    prompts = {c: f"Rate the {c}" for c in CRITERIA}
    return criteria_cross(requests(spark, sf_dir), prompts).drop("request")


@query(
    "experiment_grid",
    """WITH cells AS (SELECT m AS model, s AS scheduler FROM (SELECT unnest(['m0', 'm1', 'm2']) AS m),
        (SELECT unnest(['naive', 'outline']) AS s))
    SELECT doc_id AS request_id, lang AS dataset, model, scheduler FROM documents, cells
    WHERE NOT (lang IN ('en', 'fr') AND model = 'm1' AND scheduler = 'outline')""",
)
def q_experiment_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("lang").alias("dataset")
    )
    done = (
        rows.where(F.col("dataset").isin("en", "fr"))
        .select("dataset", F.lit("m1").alias("model"), F.lit("outline").alias("scheduler"))
        .distinct()
    )
    return experiment_grid(rows, ["m0", "m1", "m2"], ["naive", "outline"], done)


@query(
    "experiment_run",
    f"""WITH a AS (SELECT doc_id AS request_id, lang AS dataset, text AS plain, 'Please: ' || text AS polite
        FROM documents WHERE lang IN ('de', 'es'))
    SELECT dataset, 'm0' AS model, 'naive' AS scheduler, request_id, md5({outline_answer_sql("plain")}) AS response FROM a
    UNION ALL SELECT dataset, 'm0', 'polite', request_id, md5({outline_answer_sql("polite")}) FROM a
    UNION ALL SELECT dataset, 'm1', 'naive', request_id, md5('Re: ' || plain) FROM a
    UNION ALL SELECT dataset, 'm1', 'polite', request_id, md5('Re: ' || polite) FROM a""",
)
def q_experiment_run(spark, sf_dir):
    """Two models and two schedulers on two datasets; a first run breaks off in its
    second cell, the second one finishes the grid."""
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("lang").alias("dataset"))
    asked = requests(spark, sf_dir).join(lang, "request_id")
    reply = ExpressionBackend(lambda m: F.concat(F.lit("Re: "), F.array_join(m, " ")))
    ways = {
        "naive": schedulers.naive,
        "polite": lambda part, model: schedulers.naive(part, model, "Please: {request}"),
    }
    path = scratch_path(spark, "grid")

    def broken(part, model):
        raise InterruptedError("the run is broken off")

    try:
        run_grid(asked, ["de", "es"], {"m0": MODEL, "m1": reply}, ways | {"polite": broken}, path)
    except InterruptedError:
        run_grid(asked, ["de", "es"], {"m0": MODEL, "m1": reply}, ways, path, slices=2)
    answered = grid_answers(spark, path)
    return answered.select(
        "dataset", "model", "scheduler", "request_id", F.md5("response").alias("response")
    )


@query(
    "resume_dump",
    f"""WITH {REQUESTS_SQL}, todo AS (SELECT r.* FROM requests r JOIN documents d ON d.doc_id = r.request_id
        WHERE lang = 'en' OR text NOT IN (SELECT text FROM documents WHERE lang = 'en'))
    SELECT request_id, request, CASE WHEN length(request) % 11 = 0 THEN 'no points here'
        ELSE array_to_string(list_transform(list_filter(string_split(request, chr(10)), lambda x: x <> ''),
            lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END AS response FROM todo""",
)
def q_resume_dump(spark, sf_dir):
    """First the English questions, then a second run over all of them that
    answers what is left."""
    path = scratch_path(spark, "dump")
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "lang")
    english = lang.where(F.col("lang") == "en").select("request_id")
    asked = requests(spark, sf_dir)

    def run(part):
        return schedulers.naive(part, MODEL)

    dump(asked.join(english, "request_id", "left_semi"), run, path, overwrite=True)
    dump(asked, run, path, slices=2)
    return spark.read.parquet(path).select("request_id", "request", "response")


@query(
    "split_route",
    """SELECT l.doc_id AS request_id, CASE WHEN l.quality = 0 THEN 'plain' ELSE 'outline' END AS route,
        md5(text) AS digest FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)
def q_split_route(spark, sf_dir):
    plain, pointed = split_route(_routed(spark, sf_dir))
    both = plain.withColumn("route", F.lit("plain")).unionByName(
        pointed.withColumn("route", F.lit("outline"))
    )
    return both.select("request_id", "route", F.md5("request").alias("digest"))


def _routed(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"), F.col("quality").alias("label")
    )
    return requests(spark, sf_dir).join(labels, "request_id")


# ---- generation -------------------------------------------------------------


@query(
    "generate",
    f"""WITH {REQUESTS_SQL}
    SELECT request_id, outline AS text, 1 AS attempts, NULL::VARCHAR AS error FROM (
        SELECT request_id, CASE WHEN length(request) % 11 = 0 THEN 'no points here'
        ELSE array_to_string(list_transform(list_filter(string_split(request, chr(10)), lambda x: x <> ''),
            lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END AS outline FROM requests)""",
)
def q_generate(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", as_messages(F.col("request")).alias("messages"))
    answered = materialise(generate(asked, PythonBackend(python_model), ["request_id"]))
    return answered.select("request_id", "text", "attempts", "error")


@query(
    "generate_batch",
    """SELECT doc_id AS request_id, md5(text) AS text, true AS same_batch_time FROM documents""",
)
def q_generate_batch(spark, sf_dir):
    import hashlib

    def open_call():
        return lambda asked, settings: [hashlib.md5(a[0].encode()).hexdigest() for a in asked]

    asked = requests(spark, sf_dir).select("request_id", as_messages(F.col("request")).alias("messages"))
    backend = PythonBackend(open_call, batch=True, batch_rows=64)
    answered = materialise(generate(asked, backend, ["request_id"]))
    return answered.select("request_id", "text", (F.col("time") >= 0).alias("same_batch_time"))


@query(
    "generate_usage",
    """SELECT doc_id AS request_id, md5(text) AS text, length(text)::BIGINT AS prompt_tokens,
        32::BIGINT AS completion_tokens, CASE WHEN length(text) % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
    FROM documents""",
)
def q_generate_usage(spark, sf_dir):
    """Answers with usage, written to a log by a first run; the second run, whose model
    refuses every call, has them all from there."""
    import hashlib

    def open_call():
        def answer(text):
            reason = "length" if len(text) % 3 == 0 else "stop"
            return Answer(hashlib.md5(text.encode()).hexdigest(), len(text), 32, reason)

        return lambda asked, settings: [answer(a[0]) for a in asked]

    asked = requests(spark, sf_dir).select("request_id", as_messages(F.col("request")).alias("messages"))
    log = scratch_path(spark, "calls")
    log = log if ":" in log else f"file://{log}"
    first = PythonBackend(open_call, batch=True, batch_rows=64, rows_per_task=5000, log=log)
    generate(asked, first, ["request_id"]).write.format("noop").mode("overwrite").save()
    refusing = replace(first, open=lambda: lambda asked, settings: 1 / 0, attempts=1)
    again = generate(asked, refusing, ["request_id"])
    return again.select("request_id", "text", "usage.*", "finish_reason")


class RefusedRequest(Exception):
    """A request that no retry will make acceptable."""


def _flaky():
    import hashlib

    tried = set()

    def call(asked, settings):
        text = asked[0][0]
        if len(text) % 5 == 0:
            raise RefusedRequest("not answered")
        key = hashlib.md5(text.encode()).hexdigest()
        if key in tried:
            tried.discard(key)
            return [key]
        tried.add(key)
        raise ConnectionError("try again")

    return call


@query(
    "generate_retry",
    """SELECT doc_id AS request_id, CASE WHEN length(text) % 5 <> 0 THEN md5(text) END AS text,
        CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 2 END AS attempts,
        CASE WHEN length(text) % 5 = 0 THEN 'RefusedRequest: not answered' END AS error FROM documents""",
)
def q_generate_retry(spark, sf_dir):
    backend = PythonBackend(
        _flaky, attempts=30, wait_min=0.0, wait_max=0.0, timeout=60, fatal=(RefusedRequest,)
    )
    asked = requests(spark, sf_dir).select("request_id", as_messages(F.col("request")).alias("messages"))
    answered = materialise(generate(asked, backend, ["request_id"]))
    return answered.select("request_id", "text", "attempts", "error")


@query(
    "generate_error_sentinel",
    """SELECT doc_id AS request_id, CASE WHEN length(text) % 5 = 0 THEN '-2,-2' ELSE '7 8' END AS review,
        CASE WHEN length(text) % 5 = 0 THEN -2.0 ELSE 7.0 END::DOUBLE AS score1 FROM documents""",
)
def q_generate_error_sentinel(spark, sf_dir):
    error = F.when(F.length("request") % 5 == 0, "refused")
    text = F.when(error.isNull(), "7 8")
    review = requests(spark, sf_dir).select(
        "request_id", error_sentinel(text, error, FAILED_REVIEW).alias("review")
    )
    return review.withColumn("score1", parse_score_pair(F.col("review"))[0])


@query(
    "backend_registry",
    """WITH names AS (SELECT unnest(['openai', 'fastchat', 'claude_slack']) AS model),
    laid AS (SELECT doc_id AS request_id, model, CASE model WHEN 'claude_slack' THEN '<@U1> ' || text
        WHEN 'fastchat' THEN 'A chat between a curious user and an artificial intelligence assistant. The assistant'
            || ' gives helpful, detailed, and polite answers to the user''s questions.</s>User: ' || text || '</s>Assistant:'
        ELSE 'system|Be brief|user|' || text END AS asked FROM documents, names)
    SELECT request_id, model, md5(asked) AS text FROM laid""",
)
def q_backend_registry(spark, sf_dir):
    """Every request laid out and sent by the backend of each name."""

    def open_call():
        import hashlib
        import json

        def said(line):
            if not line.startswith("{"):
                return line
            turn = json.loads(line)
            return f"{turn['role']}|{turn['content']}"

        return lambda asked, settings: [
            hashlib.md5("|".join(map(said, lines)).encode()).hexdigest() for lines in asked
        ]

    union = None
    for name, layout in (("openai", "Be brief"), ("fastchat", "ultra-lm"), ("claude_slack", "U1")):
        lay_out, backend = get_backend(name, layout, open_call)
        messages = lay_out(as_messages(F.col("request")))
        asked = requests(spark, sf_dir).select(
            "request_id", F.lit(name).alias("model"), messages.alias("messages")
        )
        part = materialise(generate(asked, backend, ["request_id"])).select("request_id", "model", "text")
        union = part if union is None else union.unionByName(part)
    return union


@query(
    "scheduler_registry",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL}, named AS (
    SELECT 'naive' AS scheduler, request_id, CASE WHEN length(request) % 11 = 0 THEN 'no points here'
        ELSE array_to_string(list_transform(list_filter(string_split(request, chr(10)), lambda x: x <> ''),
            lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END AS response FROM requests
    UNION ALL SELECT 'outline', o.request_id,
        coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos), '')
        FROM outlines o LEFT JOIN contents c ON o.request_id = c.request_id GROUP BY o.request_id
    UNION ALL SELECT 'batch_outline', o.request_id,
        coalesce(string_agg(regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'), chr(10) ORDER BY pos), '')
        FROM outlines o LEFT JOIN contents c ON o.request_id = c.request_id GROUP BY o.request_id)
    SELECT scheduler, request_id, md5(response) AS response FROM named""",
)
def q_scheduler_registry(spark, sf_dir):
    asked, union = requests(spark, sf_dir), None
    for name in ("naive", "outline", "batch_outline"):
        run = schedulers.get_scheduler(name)
        answered = run(asked, MODEL) if name == "naive" else run(asked, MODEL, PLAIN_PROMPTS)
        part = answered.select(
            F.lit(name).alias("scheduler"), "request_id", F.md5("response").alias("response")
        )
        union = part if union is None else union.unionByName(part)
    return union


@query(
    "gen_params",
    """SELECT doc_id AS request_id, 0.1 * (doc_id % 8) AS temperature, 512 AS max_new_tokens,
        0.0::DOUBLE AS presence_penalty, NULL::VARCHAR AS system_message,
        CASE WHEN doc_id % 4 = 0 THEN 1.2 ELSE 1.0 END::DOUBLE AS repetition_penalty,
        length(text)::VARCHAR || ':' || (doc_id % 8)::VARCHAR AS text FROM documents""".replace(
        "0.1 * (doc_id % 8)", "(doc_id % 8)::DOUBLE / 10"
    ),
)
def q_gen_params(spark, sf_dir):
    def open_call():
        return lambda asked, settings: [
            f"{len(a[0])}:{round(s['temperature'] * 10)}" for a, s in zip(asked, settings)
        ]

    model = F.when(F.col("request_id") % 4 == 0, "flan-t5-xl").otherwise("llama")
    params = gen_params(model, temperature=(F.col("request_id") % 8).cast("double") / 10)
    asked = requests(spark, sf_dir).select(
        "request_id", as_messages(F.col("request")).alias("messages"), params.alias("params")
    )
    answered = generate(asked, PythonBackend(open_call, batch=True), ["request_id"], params="params")
    return materialise(answered.select("request_id", "params", "text")).select(
        "request_id",
        "params.temperature",
        "params.max_new_tokens",
        "params.presence_penalty",
        "params.system_message",
        "params.repetition_penalty",
        "text",
    )


# ---- schedulers -------------------------------------------------------------


@query(
    "scheduler_naive",
    f"""WITH {MULTI_SQL}, asked AS (SELECT request_id, array_to_string(list_concat(messages[1:len(messages) - 1],
        ['Q: ' || messages[-1]]), chr(10)) AS whole FROM multi)
    SELECT request_id, CASE WHEN starts_with(whole, 'Q: ') THEN chr(32) || chr(9) || md5(whole) || chr(10)
        WHEN length(whole) % 11 = 0 THEN 'no points here'
        ELSE array_to_string(list_transform(list_filter(string_split(whole, chr(10)), lambda x: x <> ''),
            lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END AS response,
        'summarize' AS stage FROM asked""",
)
def q_scheduler_naive(spark, sf_dir):
    answered = schedulers.naive(multi_turn(spark, sf_dir), MODEL, "Q: {request}")
    return answered.select("request_id", "response", "stage")


_BLANK_SQL = """
SELECT o.request_id, md5(o.outline) AS outline, coalesce(max(n), 0)::INTEGER AS n_points,
    coalesce(string_agg(partial || ' ' || text, chr(10) || chr(10) ORDER BY pos), '') AS response
FROM outlines o LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM contents) c
    ON o.request_id = c.request_id GROUP BY o.request_id, o.outline
"""


def _strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


_NEWLINE_SQL = f"""
SELECT o.request_id, md5(o.outline) AS outline, coalesce(max(n), 0)::INTEGER AS n_points,
    coalesce(string_agg({_strip_sql("text")}, chr(10) ORDER BY pos), '') AS response
FROM outlines o LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM contents) c
    ON o.request_id = c.request_id GROUP BY o.request_id, o.outline
"""


def _summary(answered):
    return answered.select(
        "request_id",
        F.md5("outline").alias("outline"),
        F.size("points").alias("n_points"),
        "response",
    )


@query(
    "scheduler_outline",
    f"WITH {REQUESTS_SQL}, {SWITCHED_SQL}, {POINTS_SQL}, {SWITCHED_CONTENT_SQL} {_BLANK_SQL}",
)
def q_scheduler_outline(spark, sf_dir):
    return _summary(schedulers.outline(requests(spark, sf_dir), MODEL, PROMPTS))


@query(
    "scheduler_batch_outline",
    f"WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL} {_NEWLINE_SQL}",
)
def q_scheduler_batch_outline(spark, sf_dir):
    backend = PythonBackend(python_model, batch=True, batch_rows=64)
    return _summary(schedulers.batch_outline(requests(spark, sf_dir), backend, PLAIN_PROMPTS))


@query(
    "scheduler_router",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL},
    pointed AS ({_NEWLINE_SQL})
    SELECT p.request_id, CASE WHEN quality = 0 THEN NULL ELSE n_points END AS n_points,
        CASE WHEN quality = 0 THEN CASE WHEN starts_with(request, 'Q: ') THEN NULL
            WHEN length(request) % 11 = 0 THEN 'no points here'
            ELSE array_to_string(list_transform(list_filter(string_split(request, chr(10)), lambda x: x <> ''),
                lambda x, i: (i - CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END)::VARCHAR || '. ' || x), chr(10)) END
        ELSE response END AS response
    FROM pointed p JOIN labels l ON p.request_id = l.doc_id JOIN requests r ON r.request_id = p.request_id""",
)
def q_scheduler_router(spark, sf_dir):
    answered = schedulers.router(_routed(spark, sf_dir), MODEL, PLAIN_PROMPTS)
    n_points = F.when(F.col("points").isNotNull(), F.size("points"))
    return answered.select("request_id", n_points.alias("n_points"), "response")


@query(
    "explode_points",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}
    SELECT o.request_id, p.pos, p.point, p.point_outline
    FROM outlines o LEFT JOIN points p ON o.request_id = p.request_id""",
)
def q_explode_points(spark, sf_dir):
    planned = schedulers.outlined(requests(spark, sf_dir), MODEL, PLAIN_PROMPTS)
    return explode_points(planned.select("request_id", "points"))


def _answered_points(spark, sf_dir, prompts):
    rows = explode_points(schedulers.outlined(requests(spark, sf_dir), MODEL, prompts))
    asked, partial = schedulers.point_parts(
        F.col("messages"), F.col("outline"), F.col("point"), F.col("point_outline"), prompts
    )
    rows = rows.select("request_id", "pos", partial.alias("partial"), asked.alias("messages"))
    return generate(rows, MODEL, ["request_id", "pos"])


@query(
    "assemble_blank_line",
    f"""WITH {REQUESTS_SQL}, {SWITCHED_SQL}, {POINTS_SQL}, {SWITCHED_CONTENT_SQL}
    SELECT request_id, n_points, response FROM ({_BLANK_SQL})""",
)
def q_assemble_blank_line(spark, sf_dir):
    done = assemble_blank_line(_answered_points(spark, sf_dir, PROMPTS))
    return done.select("request_id", F.size("contents").alias("n_points"), "response")


@query(
    "assemble_newline",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL}
    SELECT request_id, n_points, response FROM ({_NEWLINE_SQL})""",
)
def q_assemble_newline(spark, sf_dir):
    done = assemble_newline(_answered_points(spark, sf_dir, PLAIN_PROMPTS))
    return done.select("request_id", F.size("contents").alias("n_points"), "response")


# ---- judges -----------------------------------------------------------------


def _pair_judged_sql(pairs: str) -> str:
    """CTEs from ``pairs(request_id, request, x, y)`` to ``long``."""
    return f"""
shown AS (SELECT request_id, request, 1 AS direction, x AS s1, y AS s2 FROM {pairs}
    UNION ALL SELECT request_id, request, 2, y, x FROM {pairs}),
asked AS (SELECT request_id, request, direction, {pair_prompt_sql("request", "s1", "s2")} AS prompt FROM shown),
told AS (SELECT *, left(md5(prompt), 1) || ' ' || substr(md5(prompt), 2, 1) AS review FROM asked),
{score_sql("review", "told", "request_id, direction, prompt, review")},
long AS (SELECT request_id, direction, prompt, review, CASE direction WHEN 1 THEN score1 ELSE score2 END AS a,
    CASE direction WHEN 1 THEN score2 ELSE score1 END AS b FROM scored)
"""


_PAIRS_SQL = """pairs AS (SELECT a.request_id, a.request, a.response AS x, b.response AS y
    FROM answers_0 a JOIN answers_1 b ON a.request_id = b.request_id)"""


@query(
    "judge_pair",
    f"""WITH {ANSWERS_SQL}, {_PAIRS_SQL}, {_pair_judged_sql("pairs")}
    SELECT request_id, direction, md5(prompt) AS evaluation_request, review AS evaluation, a AS score1, b AS score2
    FROM long""",
)
def q_judge_pair(spark, sf_dir):
    judged = judge_pair(
        answers(spark, sf_dir, 0),
        answers(spark, sf_dir, 1),
        PAIR_JUDGE,
        PAIR_TEMPLATE,
        PAIR_PROMPT,
        wide=False,
    )
    return judged.withColumn("evaluation_request", F.md5("evaluation_request")).drop("request")


@query(
    "pivot_pair_scores",
    f"""WITH {ANSWERS_SQL}, {_PAIRS_SQL}, {_pair_judged_sql("pairs")}
    SELECT p.request_id, p.request, u.prompt AS "1_evaluation_request", u.review AS "1_evaluation",
        u.a AS "1_score1", u.b AS "1_score2", v.prompt AS "2_evaluation_request", v.review AS "2_evaluation",
        v.a AS "2_score1", v.b AS "2_score2"
    FROM pairs p JOIN long u ON p.request_id = u.request_id AND u.direction = 1
        JOIN long v ON p.request_id = v.request_id AND v.direction = 2""",
)
def q_pivot_pair_scores(spark, sf_dir):
    return judge_pair(
        answers(spark, sf_dir, 0), answers(spark, sf_dir, 1), PAIR_JUDGE, PAIR_TEMPLATE, PAIR_PROMPT
    )


@query(
    "judge_pair_by_category",
    f"""WITH {ANSWERS_SQL}, {_LOOKUP_SQL}, pairs AS (SELECT t.request_id, t.request, used, a.response AS x, b.response AS y
        FROM told t JOIN answers_0 a ON t.request_id = a.request_id JOIN answers_1 b ON t.request_id = b.request_id),
    shown AS (SELECT request_id, request, used, 1 AS direction, x AS s1, y AS s2 FROM pairs
        UNION ALL SELECT request_id, request, used, 2, y, x FROM pairs),
    asked AS (SELECT request_id, direction, CASE used WHEN 'en' THEN 'In English: ' WHEN 'de' THEN 'Auf Deutsch: '
        ELSE '' END || request || ' A: ' || s1 || ' B: ' || s2 || ' Score as ' || used AS prompt FROM shown),
    reviews AS (SELECT *, left(md5(prompt), 1) || ' ' || substr(md5(prompt), 2, 1) AS review FROM asked),
    {score_sql("review", "reviews", "request_id, direction, review")}
    SELECT request_id, direction, review AS evaluation, CASE direction WHEN 1 THEN score1 ELSE score2 END AS score1,
        CASE direction WHEN 1 THEN score2 ELSE score1 END AS score2 FROM scored""",
)
def q_judge_pair_by_category(spark, sf_dir):
    pairs = pair_answers(answers(spark, sf_dir, 0), answers(spark, sf_dir, 1), ["request_id"])
    paired = template_lookup(pairs, _categories(spark, sf_dir), _templates(spark, sf_dir))
    judged = judge_pair_by_category(paired, PAIR_JUDGE, list(_TEMPLATE_TEXTS.values()), wide=False)
    return judged.drop("request", "evaluation_request")


def _list_judged_sql() -> str:
    prompt = list_prompt_sql("request", ["s1", "s2", "s3"], 3, "three")
    return f"""
asked AS (SELECT request_id, perm_index, p1, p2, p3, md5({prompt}) AS digest FROM permuted),
reviews AS (SELECT *, CASE WHEN left(digest, 1) < '4' THEN 'So: Assistant 2 > Assistant 1 >= Assistant 3'
    WHEN left(digest, 1) < '8' THEN 'Assistant 1 = Assistant 3 > Assistant 2'
    WHEN left(digest, 1) < 'c' THEN 'Assistant 3 > Assistant 1' ELSE 'All are fine.' END AS review FROM asked),
{order_sql("review", 3, "reviews", "request_id, perm_index, p1, p2, p3, digest, review")},
judged AS (SELECT request_id, perm_index, p1, p2, p3, digest, review,
    places[list_position([p1, p2, p3], 0)]::INTEGER AS place1, places[list_position([p1, p2, p3], 1)]::INTEGER AS place2,
    places[list_position([p1, p2, p3], 2)]::INTEGER AS place3 FROM ordered)
"""


@query(
    "judge_list",
    f"""WITH {ANSWERS_SQL}, {_ORDERS_SQL}, {_list_judged_sql()}
    SELECT request_id, perm_index, digest AS evaluation_request, review AS evaluation, place1, place2, place3
    FROM judged""",
)
def q_judge_list(spark, sf_dir):
    judged = judge_list([answers(spark, sf_dir, i) for i in range(3)], LIST_JUDGE, LIST_PROMPT)
    return judged.select(
        "request_id",
        "perm_index",
        F.md5("evaluation_request").alias("evaluation_request"),
        "evaluation",
        *[F.col("order")[i].alias(f"place{i + 1}") for i in range(3)],
    )


@query(
    "judge_list_by_criteria",
    f"""WITH {ANSWERS_SQL}, {_ORDERS_SQL}, {_list_judged_sql()}
    SELECT request_id, 'general' AS criterion, perm_index, digest AS evaluation_request, review AS evaluation,
        place1, place2, place3 FROM judged
    UNION ALL SELECT request_id, 'diversity', perm_index, digest, review, place1, place2, place3 FROM judged""",
)
def q_judge_list_by_criteria(spark, sf_dir):
    """Two criteria that ask the same, so that their answers are known; one merge."""
    prompts = {"general": LIST_PROMPT, "diversity": LIST_PROMPT}
    judged = judge_list_by_criteria([answers(spark, sf_dir, i) for i in range(3)], LIST_JUDGE, prompts)
    return judged.select(
        "request_id",
        "criterion",
        "perm_index",
        F.md5("evaluation_request").alias("evaluation_request"),
        "evaluation",
        *[F.col("order")[i].alias(f"place{i + 1}") for i in range(3)],
    )


def _wide_columns() -> str:
    parts = []
    for i, p in enumerate([(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]):
        parts.append(f"""max(CASE WHEN perm_index = {i} THEN digest END) AS "{i}_{p}_evaluation_request",
            max(CASE WHEN perm_index = {i} THEN review END) AS "{i}_{p}_evaluation",
            max(CASE WHEN perm_index = {i} THEN place1::VARCHAR || ',' || place2::VARCHAR || ',' || place3::VARCHAR END)
                AS "{i}_{p}_order" """)
    return ", ".join(parts)


@query(
    "pivot_list_orders",
    f"""WITH {ANSWERS_SQL}, {_ORDERS_SQL}, {_list_judged_sql()}
    SELECT j.request_id, max(request) AS request, {_wide_columns()}
    FROM judged j JOIN requests r ON j.request_id = r.request_id GROUP BY j.request_id""".replace(
        "JOIN requests r", "JOIN (SELECT doc_id AS request_id, text AS request FROM documents) r"
    ),
)
def q_pivot_list_orders(spark, sf_dir):
    long = judge_list([answers(spark, sf_dir, i) for i in range(3)], LIST_JUDGE, LIST_PROMPT)
    shown = long.withColumns(
        {
            "evaluation_request": F.md5("evaluation_request"),
            "order": F.array_join(F.transform("order", lambda p: p.cast("string")), ","),
        }
    )
    return pivot_list_orders(shown, 3)
