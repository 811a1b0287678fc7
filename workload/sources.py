"""Reading and writing tables and files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from promptloom.functions.template import render_template
from promptloom.session import scratch_path
from promptloom.sources.answers import (
    list_cells,
    read_answers,
    read_answers_csv,
    read_judge_templates,
)
from promptloom.sources.chat_log import read_chat_log, write_chat_log
from promptloom.sources.prompts import naive_template
from promptloom.sources.requests import (
    first_turns,
    ingest_jsonl,
    read_csv,
    read_requests_csv,
    read_router_csv,
)
from promptloom.sources.results import export_csv, write_predictions, write_results
from workload.fixtures import (
    ANSWERS_SQL,
    LINES_SQL,
    answers,
    lines,
    requests,
)
from workload.registry import query, table


def _csv(df, path, sep=","):
    (
        df.write.option("header", True)
        .option("sep", sep)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


@query("read_requests_csv", "SELECT text AS request FROM documents")
def q_read_requests_csv(spark, sf_dir):
    path = scratch_path(spark, "requests-csv")
    _csv(table(spark, sf_dir, "documents").select(F.col("text").alias("question")), path)
    return read_requests_csv(spark, path)


@query(
    "read_router_csv",
    """SELECT quality AS label, text AS request FROM labels JOIN documents USING (doc_id)""",
)
def q_read_router_csv(spark, sf_dir):
    path = scratch_path(spark, "router-csv")
    labelled = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    _csv(labelled.select(F.col("quality").alias("label"), F.col("text").alias("request")), path, ";")
    return read_router_csv(spark, path)


@query("ingest_jsonl_text", "SELECT text AS request FROM documents")
def q_ingest_jsonl_text(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "documents").select("text").write.json(path)
    return ingest_jsonl(spark, path, "text")


@query("ingest_jsonl_instruction", "SELECT text AS request FROM conversations")
def q_ingest_jsonl_instruction(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "conversations").select(F.col("text").alias("Instruction")).write.json(path)
    return ingest_jsonl(spark, path, "instruction")


@query("ingest_jsonl_first_turn", f"SELECT {LINES_SQL}[1] AS request FROM documents")
def q_ingest_jsonl_first_turn(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    table(spark, sf_dir, "documents").select(
        lines(F.col("text")).alias("conversations")
    ).write.json(path)
    return ingest_jsonl(spark, path, "first_turn")


@query(
    "ingest_first_turn_table",
    "SELECT conv_id, arg_min(text, turn) AS request FROM conversations GROUP BY conv_id",
)
def q_first_turns(spark, sf_dir):
    return first_turns(table(spark, sf_dir, "conversations"))


@query(
    "read_prompt_file",
    """SELECT doc_id AS request_id, 'Please answer {shortly}: ' || text AS prompt FROM documents""",
)
def q_read_prompt_file(spark, sf_dir):
    path = scratch_path(spark, "prompt")
    text = json.dumps({"prompt": "Please answer {{shortly}}: {request}"})
    spark.range(1).select(F.lit(text)).coalesce(1).write.text(path)
    template = naive_template(spark, path)
    return requests(spark, sf_dir).select(
        "request_id", render_template(template, {"request": F.col("request")}).alias("prompt")
    )


@query(
    "read_answers",
    f"""WITH {ANSWERS_SQL}
    SELECT *, 0 AS answer_idx FROM answers_0 UNION ALL SELECT *, 1 FROM answers_1
    UNION ALL SELECT *, 2 FROM answers_2""",
)
def q_read_answers(spark, sf_dir):
    paths = []
    for i in range(3):
        paths.append(scratch_path(spark, "answers"))
        answered = answers(spark, sf_dir, i).withColumn("stage", F.lit("summarize"))
        # tables that hold every text twice, for one reading
        answered.write.option("compression", "zstd").parquet(paths[-1])
    return read_answers(spark, paths)


@query(
    "read_answers_csv",
    f"""WITH {ANSWERS_SQL}
    SELECT row_number() OVER (ORDER BY request_id) - 1 AS request_id, request, response FROM answers_2""",
)
def q_read_answers_csv(spark, sf_dir):
    path = scratch_path(spark, "answers-csv")
    export_csv(answers(spark, sf_dir, 2).orderBy("request_id").drop("request_id"), path)
    return read_answers_csv(spark, path)


@query(
    "read_judge_templates",
    """WITH asked AS (SELECT text, min(lang) AS category FROM documents GROUP BY text)
    SELECT text AS request, category,
        CASE WHEN category IN ('en', 'de') THEN 'Judge as ' || category END AS prompt,
        CASE WHEN category IN ('en', 'de') THEN category || ': {question} {prompt}' END AS prompt_template
    FROM asked""",
)
def q_read_judge_templates(spark, sf_dir):
    asked, told = scratch_path(spark, "categories"), scratch_path(spark, "templates")
    documents = table(spark, sf_dir, "documents")
    documents.groupBy("text").agg(F.min("lang").alias("category")).write.json(asked)
    documents.where(F.col("lang").isin("en", "de")).select(
        F.col("lang").alias("category")
    ).distinct().select(
        "category",
        F.concat("category", F.lit(": {question} {prompt}")).alias("prompt_template"),
        F.struct(F.concat(F.lit("Judge as "), "category").alias("prompt")).alias("defaults"),
    ).write.json(told)
    categories, templates = read_judge_templates(spark, asked, told)
    return categories.join(templates, "category", "left")


def _chat_log(spark, sf_dir):
    start = F.lit(1704067200.0) + F.col("conv_id") * 3600 + F.col("turn")
    finish = start + 0.25 * F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        finish.alias("tstamp"),
        F.lit("chat").alias("type"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.struct(
            F.lit(0.7).alias("temperature"),
            F.lit(1.0).alias("top_p"),
            F.lit(512).alias("max_new_tokens"),
        ).alias("gen_params"),
        start.alias("start"),
        finish.alias("finish"),
        F.struct(
            F.col("conv_id").cast("string").alias("conv_id"),
            F.lit("m").alias("model_name"),
            F.array(F.array(F.col("role"), F.col("text"))).alias("messages"),
        ).alias("state"),
        F.lit("10.0.0.1").alias("ip"),
    )


@query(
    "read_chat_log",
    """WITH log AS (SELECT *, 1704067200.0::DOUBLE + conv_id * 3600 + turn AS start FROM conversations)
    SELECT conv_id::VARCHAR AS conv_id, 'model-' || (conv_id % 3)::VARCHAR AS model,
        start, start + 0.25 * turn AS finish, role, text, 0.7::DOUBLE AS temperature,
        512 AS max_new_tokens,
        strftime(make_timestamp(CAST(floor(start + 0.25 * turn) AS BIGINT) * 1000000), '%Y-%m-%d') AS date
    FROM log""",
)
def q_read_chat_log(spark, sf_dir):
    path = scratch_path(spark, "chat-log")
    write_chat_log(_chat_log(spark, sf_dir), path)
    said = F.col("state.messages")[0]
    return read_chat_log(spark, path).select(
        "state.conv_id",
        "model",
        "start",
        "finish",
        said[0].alias("role"),
        said[1].alias("text"),
        "gen_params.temperature",
        "gen_params.max_new_tokens",
        "date",
    )


@query(
    "write_chat_log",
    """WITH log AS (SELECT *, 1704067200 + conv_id * 3600 + turn + 0.25 * turn AS finish FROM conversations)
    SELECT strftime(make_timestamp(CAST(floor(finish) AS BIGINT) * 1000000), '%Y-%m-%d') AS date,
        count(*) AS answers FROM log GROUP BY 1""",
)
def q_write_chat_log(spark, sf_dir):
    path = scratch_path(spark, "chat-log")
    write_chat_log(_chat_log(spark, sf_dir), path)
    by_day = spark.read.schema("value STRING, date STRING").text(path)
    return by_day.groupBy("date").agg(F.count("*").alias("answers"))


@query(
    "write_results",
    """SELECT doc_id AS request_id, text AS request, md5(text) AS response,
        'm' || (doc_id % 2)::VARCHAR AS model, 'naive' AS scheduler, lang AS dataset
    FROM documents""",
)
def q_write_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.col("text").alias("request"),
        F.md5("text").alias("response"),
        F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model"),
        F.lit("naive").alias("scheduler"),
        F.col("lang").alias("dataset"),
    )
    for model in ("m0", "m1"):
        write_results(rows.where(F.col("model") == model), path)
    return spark.read.parquet(path)


@query(
    "write_mode",
    """SELECT doc_id AS request_id,
        CASE WHEN lang = 'en' THEN 'second' ELSE 'first' END AS response, lang AS dataset
    FROM documents""",
)
def q_write_mode(spark, sf_dir):
    path = scratch_path(spark, "results")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"), F.lit("first").alias("response"), F.col("lang").alias("dataset")
    )
    write_results(rows, path, overwrite=True)
    again = rows.where(F.col("dataset") == "en").withColumn("response", F.lit("second"))
    write_results(again, path, overwrite=True)
    return spark.read.parquet(path)


@query("write_predictions", "SELECT toxic::VARCHAR AS value FROM labels")
def q_write_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    write_predictions(table(spark, sf_dir, "labels"), path, order="doc_id", prediction="toxic")
    return spark.read.text(path)


@query(
    "json_cells",
    f"""SELECT doc_id AS request_id, CAST(len({LINES_SQL}) AS INTEGER) AS n_contents,
        array_to_string({LINES_SQL}, '|') AS contents, [1, 2, CAST(doc_id % 3 AS INTEGER)][3] AS last_place
    FROM documents""",
)
def q_json_cells(spark, sf_dir):
    path = scratch_path(spark, "export")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        lines(F.col("text")).alias("contents"),
        F.array(F.lit(1), F.lit(2), (F.col("doc_id") % 3).cast("int")).alias("order"),
    )
    export_csv(rows, path)
    # the export sorts its columns by name
    cells = read_csv(spark, path, "contents STRING, order STRING, request_id LONG")
    decoded = list_cells(cells, {"contents": "array<string>", "order": "array<int>"})
    return decoded.select(
        "request_id",
        F.size("contents").alias("n_contents"),
        F.array_join("contents", "|").alias("contents"),
        F.element_at("order", 3).alias("last_place"),
    )
