"""Prompts, messages and parsing of model text."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.functions import messages as M
from promptloom.functions.outline import dedupe_points, parse_points
from promptloom.functions.scores import parse_order, parse_score_pair, score_status
from promptloom.functions.template import (
    list_judge_instruction,
    list_judge_prompt,
    pair_judge_prompt,
    render_outline_prompt,
    render_template,
    split_role_switch,
)
from promptloom.functions.text import count_words, truncate_stop, unescape_code
from promptloom.operators.chat import history_before_last
from promptloom.operators.points import explode_points
from promptloom.plans.schedulers import normalise, outline_messages, outlined, point_parts
from workload.fixtures import (
    ANSWERS_SQL,
    LIST_PROMPT,
    MODEL,
    MULTI_SQL,
    ORDER_REVIEWS_SQL,
    PAIR_PROMPT,
    PAIR_TEMPLATE,
    PLAIN_PROMPTS,
    PLAIN_SQL,
    POINTS_SQL,
    PROMPTS,
    REQUESTS_SQL,
    SCORE_REVIEWS_SQL,
    SWITCHED_SQL,
    answers,
    list_prompt_sql,
    model_answer,
    multi_turn,
    order_reviews,
    order_sql,
    pair_prompt_sql,
    requests,
    score_reviews,
    score_sql,
)
from workload.registry import documents, query, table


@query(
    "render_template",
    """SELECT doc_id AS request_id,
        '{' || lang || '} asks: ' || text || ' (' || source || ')' AS prompt FROM documents""",
)
def q_render_template(spark, sf_dir):
    template = "{{{lang}}} asks: {request} ({source})"
    fields = {"lang": F.col("lang"), "request": F.col("text"), "source": F.col("source")}
    return documents(spark, sf_dir, "text", "lang", "source").select(
        F.col("doc_id").alias("request_id"), render_template(template, fields).alias("prompt")
    )


@query(
    "split_role_switch",
    """SELECT doc_id AS request_id, 'Ask: ' || text AS question, 'Well, ' || text AS partial,
        2 AS n_parts FROM documents""",
)
def q_split_role_switch(spark, sf_dir):
    template = "Ask: {request}[ROLESWITCHING assistant:]Well, {request}"
    question, partial = render_outline_prompt(template, F.col("request"))
    return requests(spark, sf_dir).select(
        "request_id",
        question.alias("question"),
        partial.alias("partial"),
        F.lit(len(split_role_switch(template))).alias("n_parts"),
    )


@query(
    "normalize_request",
    f"""WITH {MULTI_SQL}
    SELECT doc_id AS request_id, 1 AS n, text AS last FROM documents
    UNION ALL SELECT request_id, CAST(len(messages) AS INTEGER), messages[-1] FROM multi""",
)
def q_normalize_request(spark, sf_dir):
    both = normalise(requests(spark, sf_dir)).unionByName(normalise(multi_turn(spark, sf_dir)))
    messages = F.col("messages")
    return both.select(
        "request_id", F.size(messages).alias("n"), M.last_message(messages).alias("last")
    )


@query(
    "naive_prompt",
    f"""WITH {MULTI_SQL}
    SELECT request_id, array_to_string(
        list_concat(messages[1:len(messages) - 1], ['Say: ' || messages[-1]]), '|') AS prompt
    FROM multi""",
)
def q_naive_prompt(spark, sf_dir):
    messages = F.col("messages")
    rendered = render_template("Say: {request}", {"request": M.last_message(messages)})
    return multi_turn(spark, sf_dir).select(
        "request_id", F.array_join(M.with_last(messages, rendered), "|").alias("prompt")
    )


@query(
    "outline_prompt",
    f"""WITH {MULTI_SQL}
    SELECT request_id, CAST(len(messages) + 1 AS INTEGER) AS n, array_to_string(list_concat(
        messages[1:len(messages) - 1],
        ['Question:' || chr(10) || messages[-1] || chr(10) || 'List {{short}} points. ', ' 1.']
        ), '|') AS prompt FROM multi""".replace("{{short}}", "{short}"),
)
def q_outline_prompt(spark, sf_dir):
    asked = outline_messages(F.col("messages"), PROMPTS)
    return multi_turn(spark, sf_dir).select(
        "request_id", F.size(asked).alias("n"), F.array_join(asked, "|").alias("prompt")
    )


@query(
    "point_prompt",
    f"""WITH {REQUESTS_SQL}, {SWITCHED_SQL}, {POINTS_SQL}
    SELECT request_id, pos, point, md5('Q: ' || request || chr(10) || 'Outline:' || chr(10) || outline
        || chr(10) || 'Write point ' || point || '. ') AS question,
        point || '. ' || point_outline AS partial FROM points""",
)
def q_point_prompt(spark, sf_dir):
    rows = explode_points(outlined(requests(spark, sf_dir), MODEL, PROMPTS)).where("pos IS NOT NULL")
    asked, partial = point_parts(
        F.col("messages"), F.col("outline"), F.col("point"), F.col("point_outline"), PROMPTS
    )
    return rows.select(
        "request_id", "pos", "point", F.md5(F.get(asked, F.lit(0))).alias("question"), partial.alias("partial")
    )


@query(
    "role_messages",
    f"""WITH {MULTI_SQL}, flat AS (
        SELECT request_id, unnest(messages) AS content, unnest(range(0, len(messages))) AS i FROM multi)
    SELECT request_id, CAST(count(*) + 2 AS INTEGER) AS n,
        md5('system=Be brief;' || string_agg(CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END
            || '=' || content, ';' ORDER BY i) || ';user=And?') AS turns
    FROM flat GROUP BY request_id""",
)
def q_role_messages(spark, sf_dir):
    # the partial answer is null and leaves, a user message follows
    asked = F.concat("messages", F.array(F.lit(None).cast("string"), F.lit("And?")))
    roles = M.role_messages(asked, F.lit("Be brief"))
    line = F.transform(roles, lambda t: F.concat(t["role"], F.lit("="), t["content"]))
    return multi_turn(spark, sf_dir).select(
        "request_id", F.size(roles).alias("n"), F.md5(F.array_join(line, ";")).alias("turns")
    )


@query(
    "join_messages",
    f"""WITH {MULTI_SQL}
    SELECT request_id, '<@U1> ' || array_to_string(messages, ' ') AS line FROM multi""",
)
def q_join_messages(spark, sf_dir):
    asked = F.concat("messages", F.array(F.lit(None).cast("string")))
    return multi_turn(spark, sf_dir).select(
        "request_id", M.joined_messages(asked, F.lit("U1")).alias("line")
    )


_ORCA = (
    "'### System:' || chr(10) || 'You are an AI assistant that follows instruction extremely well."
    " Help as much as you can.' || chr(10) || chr(10)"
)
_OPENCHAT = (
    "'System: You are an AI assistant that follows instruction extremely well."
    " Help as much as you can.' || chr(10) || '<|end_of_turn|>'"
)
_ULTRA = (
    "'A chat between a curious user and an artificial intelligence assistant. The assistant gives"
    " helpful, detailed, and polite answers to the user''s questions.</s>'"
)


@query(
    "render_conversation",
    f"""WITH {MULTI_SQL}, named AS (
        SELECT *, ['orca', 'openchat', 'ultra-lm'][request_id % 3 + 1] AS template FROM multi),
    flat AS (SELECT request_id, template, unnest(messages) AS m, unnest(range(0, len(messages))) AS i FROM named),
    rounds AS (SELECT request_id, template, string_agg(CASE template
        WHEN 'orca' THEN CASE WHEN i % 2 = 0 THEN '### User:' ELSE '### Response:' END || chr(10) || m || chr(10) || chr(10)
        WHEN 'openchat' THEN CASE WHEN i % 2 = 0 THEN 'Human' ELSE 'Assistant' END || ': ' || m || '<|end_of_turn|>'
        ELSE CASE WHEN i % 2 = 0 THEN 'User' ELSE 'Assistant' END || ': ' || m || '</s>' END, '' ORDER BY i) AS body
        FROM flat GROUP BY request_id, template)
    SELECT request_id, template, CASE template
        WHEN 'orca' THEN {_ORCA} || body || '### Response:' || chr(10)
        WHEN 'openchat' THEN {_OPENCHAT} || body || 'Assistant:'
        ELSE {_ULTRA} || body || 'Assistant:' END || CASE WHEN request_id % 2 = 0 THEN ' 1.' ELSE '' END AS prompt
    FROM rounds""",
)
def q_render_conversation(spark, sf_dir):
    number = F.col("request_id") % 3
    name = F.when(number == 0, "orca").when(number == 1, "openchat").otherwise("ultra-lm")
    partial = F.when(F.col("request_id") % 2 == 0, " 1.")
    asked = F.concat("messages", F.array(partial))
    return multi_turn(spark, sf_dir).select(
        "request_id", name.alias("template"), M.render_by_template(asked, name).alias("prompt")
    )


_PATHS_SQL = """CASE doc_id % 5 WHEN 0 THEN 'psmathur/orca_mini_13b' WHEN 1 THEN 'x/openchat'
        WHEN 2 THEN 'y/UltraLM-13b' WHEN 3 THEN 'openchat-orca' ELSE source || lang END"""


@query(
    "model_template_match",
    f"""WITH p AS (SELECT doc_id, {_PATHS_SQL} AS path FROM documents)
    SELECT doc_id, CASE WHEN contains(path, 'orca') THEN 'orca' WHEN contains(path, 'openchat') THEN 'openchat'
        WHEN contains(lower(path), 'ultralm') THEN 'ultra-lm' END AS template FROM p""",
)
def q_model_template_match(spark, sf_dir):
    kind = F.col("doc_id") % 5
    path = (
        F.when(kind == 0, "psmathur/orca_mini_13b")
        .when(kind == 1, "x/openchat")
        .when(kind == 2, "y/UltraLM-13b")
        .when(kind == 3, "openchat-orca")
        .otherwise(F.concat("source", "lang"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", M.chat_template_name(path).alias("template")
    )


@query(
    "history_from_chat",
    """SELECT conv_id, turn, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last
        FROM conversations) WHERE turn < last""",
)
def q_history_from_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return history_before_last(turns)


@query(
    "judge_prompt_pair",
    f"""WITH {ANSWERS_SQL}
    SELECT a.request_id, {pair_prompt_sql("a.request", "a.response", "b.response")} AS prompt
    FROM answers_0 a JOIN answers_2 b ON a.request_id = b.request_id""",
)
def q_judge_prompt_pair(spark, sf_dir):
    other = answers(spark, sf_dir, 2).select("request_id", F.col("response").alias("other"))
    both = answers(spark, sf_dir, 0).join(other, "request_id")
    prompt = pair_judge_prompt(
        PAIR_TEMPLATE, F.col("request"), F.col("response"), F.col("other"), F.lit(PAIR_PROMPT)
    )
    return both.select("request_id", prompt.alias("prompt"))


@query(
    "judge_prompt_list",
    "SELECT doc_id AS request_id, "
    + list_prompt_sql("text", ["text", "'Second: ' || text", "source"], 3, "three")
    + " AS prompt FROM documents",
)
def q_judge_prompt_list(spark, sf_dir):
    shown = F.array("text", F.concat(F.lit("Second: "), "text"), "source")
    prompt = list_judge_prompt(F.col("text"), shown, F.lit(list_judge_instruction(LIST_PROMPT, 3)))
    return documents(spark, sf_dir, "text", "source").select(
        F.col("doc_id").alias("request_id"), prompt.alias("prompt")
    )


_CODE_SQL = r"""replace(replace(text, ' ', '\_'), chr(10), chr(10) || '```')"""


@query(
    "unescape_code",
    f"""WITH coded AS (SELECT doc_id, {_CODE_SQL} AS code FROM documents),
    cut AS (SELECT doc_id, code, string_split(code, chr(10) || '```') AS b FROM coded)
    SELECT doc_id, CASE WHEN len(b) > 1 AND len(b) % 2 = 1 THEN array_to_string(list_transform(b,
        lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, '\\_', '_') ELSE x END), chr(10) || '```')
        ELSE code END AS code FROM cut""".replace("\\\\_", "\\_"),
)
def q_unescape_code(spark, sf_dir):
    escaped = F.replace(F.col("text"), F.lit(" "), F.lit("\\_"))
    code = F.replace(escaped, F.lit("\n"), F.lit("\n```"))
    return documents(spark, sf_dir).select("doc_id", unescape_code(code).alias("code"))


@query(
    "truncate_stop",
    """SELECT doc_id, CASE WHEN contains(text, ' the ') THEN regexp_extract(text, '(?s)^(.*) the ', 1)
        ELSE text END AS text FROM documents""",
)
def q_truncate_stop(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", truncate_stop(F.col("text"), " the ").alias("text")
    )


@query(
    "count_tokens",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS INTEGER) AS tokens FROM documents""",
)
def q_count_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", count_words(F.col("text")).alias("tokens")
    )


@query(
    "parse_outline",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, found AS (SELECT request_id,
        regexp_extract_all(outline, '([0-9]+)\\.[\\t\\n\\f\\r ]?((?s:.)[^\\n]*)', 1) AS n,
        regexp_extract_all(outline, '([0-9]+)\\.[\\t\\n\\f\\r ]?((?s:.)[^\\n]*)', 2) AS t FROM outlines)
    SELECT request_id, unnest(n) AS point, unnest(t) AS point_outline, unnest(range(0, len(n)))::INTEGER AS pos
    FROM found""",
)
def q_parse_outline(spark, sf_dir):
    asked, _ = render_outline_prompt(PLAIN_PROMPTS.outline_prompt, F.col("request"))
    outline = model_answer(F.array(asked))
    rows = requests(spark, sf_dir).select("request_id", outline.alias("outline"))
    rows = rows.select("request_id", parse_points(F.col("outline")).alias("points"))
    return explode_points(rows).where("pos IS NOT NULL")


@query(
    "dedupe_points",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}
    SELECT o.request_id, count(pos)::INTEGER AS n_points, coalesce(string_agg(point, ',' ORDER BY pos), '') AS numbers,
        md5(coalesce(string_agg(point_outline, '|' ORDER BY pos), '')) AS texts
    FROM outlines o LEFT JOIN points p ON o.request_id = p.request_id GROUP BY o.request_id""",
)
def q_dedupe_points(spark, sf_dir):
    asked, _ = render_outline_prompt(PLAIN_PROMPTS.outline_prompt, F.col("request"))
    rows = requests(spark, sf_dir).select("request_id", model_answer(F.array(asked)).alias("outline"))
    rows = rows.withColumn("points", dedupe_points(parse_points(F.col("outline"))))
    return rows.select(
        "request_id",
        F.size("points").alias("n_points"),
        F.array_join("points.point", ",").alias("numbers"),
        F.md5(F.array_join("points.point_outline", "|")).alias("texts"),
    )


@query(
    "parse_score_pair",
    f"WITH {SCORE_REVIEWS_SQL}, {score_sql('review', 'reviews', 'doc_id')} SELECT * FROM scored",
)
def q_parse_score_pair(spark, sf_dir):
    scores = score_reviews(spark, sf_dir).withColumn("s", parse_score_pair(F.col("review")))
    return scores.select("doc_id", F.col("s")[0].alias("score1"), F.col("s")[1].alias("score2"))


@query(
    "valid_scores",
    f"""WITH {SCORE_REVIEWS_SQL}, {score_sql('review', 'reviews', 'doc_id')}
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN score1 = -2 AND score2 = -2 THEN 'failed'
        WHEN score1 IS NULL OR score2 IS NULL OR (score1 = -1 AND score2 = -1) THEN 'unparsable'
        ELSE 'ok' END AS status FROM scored) GROUP BY status""",
)
def q_valid_scores(spark, sf_dir):
    scores = score_reviews(spark, sf_dir).withColumn("s", parse_score_pair(F.col("review")))
    status = score_status(F.col("s")[0], F.col("s")[1])
    return scores.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "parse_order",
    f"""WITH {ORDER_REVIEWS_SQL}, {order_sql('review', 3, 'reviews', 'doc_id')}
    SELECT doc_id, places[1]::INTEGER AS place1, places[2]::INTEGER AS place2, places[3]::INTEGER AS place3 FROM ordered""",
)
def q_parse_order(spark, sf_dir):
    places = order_reviews(spark, sf_dir).withColumn("p", parse_order(F.col("review"), 3))
    return places.select("doc_id", *[F.col("p")[i].alias(f"place{i + 1}") for i in range(3)])
