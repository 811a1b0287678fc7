"""Router data, metrics, statistics and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.embeddings import mean_pool, token_total
from promptloom.operators.generate import ExpressionBackend
from promptloom.operators.metrics import argmax, confusion_matrix, multilabel_pairs, router_loss
from promptloom.operators.stats import naive_stats, outline_stats
from promptloom.plans import schedulers
from promptloom.plans.router import (
    RouterModel,
    exact_split,
    hashed_split,
    logistic_start,
    padded_features,
    predict,
    prompt_router,
    request_words,
    train_router,
)
from promptloom.session import materialise
from workload.fixtures import (
    MODEL,
    MULTI_SQL,
    PLAIN_CONTENT_SQL,
    PLAIN_PROMPTS,
    PLAIN_SQL,
    POINTS_SQL,
    REQUESTS_SQL,
    multi_turn,
    requests,
)
from workload.registry import query, table


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id"),
        F.col("quality").alias("y_true"),
        F.col("toxic").alias("y_pred"),
        (1.0 + F.col("doc_id") % 3).alias("weight"),
    )


@query(
    "confusion_matrix",
    """WITH l AS (SELECT unnest([0, 1, 2])::INTEGER AS v),
    c AS (SELECT quality, toxic, sum(1.0 + doc_id % 3) AS value FROM labels GROUP BY quality, toxic)
    SELECT a.v AS y_true, b.v AS y_pred, coalesce(value, 0)::DOUBLE AS value
    FROM l a, l b LEFT JOIN c ON c.quality = a.v AND c.toxic = b.v""".replace(
        "FROM l a, l b LEFT JOIN", "FROM (l a CROSS JOIN l b) LEFT JOIN"
    ),
)
def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(_predictions(spark, sf_dir), labels=[0, 1, 2], sample_weight="weight")


def _normalised_sql(mode: str, over: str) -> str:
    return f"""SELECT '{mode}' AS mode, quality AS y_true, toxic AS y_pred,
        round(n / sum(n) OVER ({over}), 12) AS value
        FROM (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY quality, toxic)"""


@query(
    "confusion_matrix_normalized",
    " UNION ALL ".join(
        [
            _normalised_sql("true", "PARTITION BY quality"),
            _normalised_sql("pred", "PARTITION BY toxic"),
            _normalised_sql("all", ""),
        ]
    ),
)
def q_confusion_matrix_normalized(spark, sf_dir):
    union = None
    for mode in ("true", "pred", "all"):
        part = confusion_matrix(_predictions(spark, sf_dir), normalize=mode).select(
            F.lit(mode).alias("mode"), "y_true", "y_pred", F.round("value", 12).alias("value")
        )
        union = part if union is None else union.unionByName(part)
    return union


@query(
    "confusion_multilabel_schema",
    """WITH pairs AS (SELECT quality AS t, toxic AS p FROM labels UNION ALL SELECT toxic, quality FROM labels)
    SELECT t AS y_true, p AS y_pred, count(*)::DOUBLE AS value FROM pairs GROUP BY t, p""",
)
def q_confusion_multilabel(spark, sf_dir):
    lists = table(spark, sf_dir, "labels").select(
        F.array("quality", "toxic").alias("y_true"), F.array("toxic", "quality").alias("y_pred")
    )
    return confusion_matrix(multilabel_pairs(lists))


@query(
    "router_eval",
    """WITH l AS (SELECT source AS dataset, quality, toxic FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT dataset, quality, toxic, count(*) AS n FROM l GROUP BY ALL),
    g AS (SELECT DISTINCT dataset, a.v AS y_true, b.v AS y_pred FROM l, (SELECT unnest([0, 1])::INTEGER AS v) a,
        (SELECT unnest([0, 1])::INTEGER AS v) b)
    SELECT g.dataset, y_true, y_pred, coalesce(n, 0)::DOUBLE AS value
    FROM g LEFT JOIN c ON c.dataset = g.dataset AND quality = y_true AND toxic = y_pred""",
)
def q_router_eval(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"))
    return confusion_matrix(
        _predictions(spark, sf_dir).join(sources, "doc_id"), labels=[0, 1], by=["dataset"]
    )


@query(
    "router_loss",
    """WITH p AS (SELECT toxic, quality AS label, (doc_id % 97 + 1) / 99.0::DOUBLE AS prob FROM labels),
    s AS (SELECT toxic, sum(least(prob, 0.9::DOUBLE * label)) AS i, sum(prob) AS sp, sum(0.9::DOUBLE * label) AS sy,
        avg(-ln(CASE WHEN label = 1 THEN prob ELSE 1 - prob END)) AS ce FROM p GROUP BY toxic)
    SELECT toxic, round(ce, 6) AS loss_ce,
        round(1 - i / (i + 0.7::DOUBLE * (sp - i) + 0.3::DOUBLE * (sy - i)), 6) AS loss_tversky,
        round(0.25::DOUBLE * ce + 0.75::DOUBLE * (1 - i / (i + 0.7::DOUBLE * (sp - i) + 0.3::DOUBLE * (sy - i))), 6) AS loss
    FROM s""",
)
def q_router_loss(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select(
        "toxic",
        F.col("quality").alias("label"),
        ((F.col("doc_id") % 97 + 1) / F.lit(99.0)).alias("prob"),
    )
    losses = router_loss(scored, by=["toxic"])
    return losses.select("toxic", *[F.round(c, 6).alias(c) for c in losses.columns[1:]])


@query(
    "route_predict",
    """SELECT event_id, CASE WHEN value >= 100.0 - value THEN 0 ELSE 1 END AS label FROM events""",
)
def q_route_predict(spark, sf_dir):
    logits = F.array(F.col("value"), 100.0 - F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", argmax(logits).alias("label"))


@query(
    "router_features",
    r"""WITH w AS (SELECT doc_id AS request_id,
        len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS n FROM documents)
    SELECT request_id, 512 AS n_ids, 512 AS n_mask, least(n, 512)::INTEGER AS n_tokens,
        (512 - least(n, 512))::INTEGER AS n_padding FROM w""",
)
def q_router_features(spark, sf_dir):
    features = padded_features(request_words(F.col("request")))
    rows = requests(spark, sf_dir).select("request_id", features.alias("f"))
    return rows.select(
        "request_id",
        F.size("f.input_ids").alias("n_ids"),
        F.size("f.attention_mask").alias("n_mask"),
        F.aggregate("f.attention_mask", F.lit(0), lambda s, x: s + x).alias("n_tokens"),
        F.size(F.filter("f.input_ids", lambda x: x == 0)).alias("n_padding"),
    )


@query(
    "train_val_split",
    """WITH d AS (SELECT doc_id AS request_id, md5(doc_id::VARCHAR || '|1') AS h FROM documents),
    r AS (SELECT request_id, row_number() OVER (ORDER BY h, request_id) AS k, count(*) OVER () AS n FROM d)
    SELECT request_id, k <= floor(0.8 * n) AS is_train FROM r""",
)
def q_train_val_split(spark, sf_dir):
    return exact_split(requests(spark, sf_dir).select("request_id"), 0.8, 1)


@query(
    "train_val_split_hashed",
    """SELECT doc_id AS request_id,
        ('0x' || left(md5(doc_id::VARCHAR || '|1'), 8))::BIGINT < 3435973836 AS is_train FROM documents""",
)
def q_train_val_split_hashed(spark, sf_dir):
    return hashed_split(requests(spark, sf_dir).select("request_id"), 0.8, 1)


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"), F.col("quality").alias("label")
    )
    return requests(spark, sf_dir).join(labels, "request_id")


@query("router_train")
def q_router_train(spark, sf_dir):
    """Trained on the labelled documents, used on all of them."""
    model = train_router(_labelled(spark, sf_dir), iterations=8)
    scored = predict(model, requests(spark, sf_dir))
    return scored.select("request_id", "label", F.round("prob", 6).alias("prob"))


@query(
    "router_train_invariants",
    """SELECT (SELECT count(*) FROM documents)::BIGINT AS n_scored,
        (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)::BIGINT AS n_learned,
        true AS in_range, true AS labels_agree, true AS below_start, true AS below_guess""",
)
def q_router_train_invariants(spark, sf_dir):
    """Training on the mixed loss ends below the logistic regression that it starts from,
    and below one probability for all."""
    labelled = materialise(_labelled(spark, sf_dir), "labelled")
    start = logistic_start(labelled, iterations=6)
    model = train_router(labelled, iterations=6, start=start)

    def loss(weights):
        return router_loss(predict(RouterModel(weights), labelled.drop("label")).drop("label").join(
            labelled.select("request_id", "label"), "request_id"
        )).first()["loss"]

    share = labelled.agg(F.avg("label")).first()[0] or 0.0
    guess = router_loss(labelled.select("label", F.lit(float(share)).alias("prob"))).first()["loss"]
    ended = loss(model.weights)
    scored = predict(model, requests(spark, sf_dir)).agg(
        F.count("*").alias("n_scored"),
        F.bool_and((F.col("prob") >= 0) & (F.col("prob") <= 1)).alias("in_range"),
        F.bool_and((F.col("prob") > 0.5).cast("int") == F.col("label")).alias("labels_agree"),
    )
    learned = labelled.agg(F.count("label").alias("n_learned"))
    return scored.join(learned, F.lit(True)).select(
        "*",
        F.lit(ended < loss(start)).alias("below_start"),
        F.lit(ended < guess).alias("below_guess"),
    )


@query(
    "router_predict_then_answer",
    """SELECT doc_id AS request_id, true AS routed FROM documents""",
)
def q_router_predict_then_answer(spark, sf_dir):
    """The trained router decides, and every request is answered the way it says."""
    asked = requests(spark, sf_dir)
    model = train_router(_labelled(spark, sf_dir), iterations=4)
    routed = materialise(predict(model, asked).drop("prob"), "routed")
    answered = schedulers.router(routed, MODEL, PLAIN_PROMPTS).select("request_id", "response", "points")
    plain = schedulers.naive(asked, MODEL).select("request_id", F.col("response").alias("plain"))
    pointed = schedulers.batch_outline(asked, MODEL, PLAIN_PROMPTS)
    pointed = pointed.select("request_id", F.col("response").alias("pointed"))
    both = answered.join(routed.select("request_id", "label"), "request_id")
    both = both.join(plain, "request_id").join(pointed, "request_id")
    expected = F.when(F.col("label") == 0, F.col("plain")).otherwise(F.col("pointed"))
    kind = F.col("points").isNull() == (F.col("label") == 0)
    return both.select("request_id", ((F.col("response") == expected) & kind).alias("routed"))


@query(
    "prompt_router",
    """WITH asked AS (SELECT doc_id AS request_id,
        left(md5('Question: ' || text || chr(10) || 'A, B or C?'), 1) AS d FROM documents)
    SELECT request_id, CASE WHEN d < '6' THEN ' A' WHEN d < 'b' THEN 'B.' WHEN d < 'e' THEN 'C' ELSE 'Apples' END AS response,
        CASE WHEN d < '6' THEN 1 WHEN d < 'e' THEN 0 END AS label FROM asked""",
)
def q_prompt_router(spark, sf_dir):
    def choose(messages):
        d = F.substring(F.md5(F.array_join(messages, "\n")), 1, 1)
        return (
            F.when(d < "6", " A").when(d < "b", "B.").when(d < "e", "C").otherwise("Apples")
        )

    asked = requests(spark, sf_dir)
    chosen = prompt_router(asked, ExpressionBackend(choose), "Question: {request}\nA, B or C?")
    return chosen.drop("request")


_WORDS = r"CAST(len(regexp_extract_all({0}, '[^ \t\n\r\f]+')) AS INTEGER)"


@query(
    "response_stats_naive",
    f"""WITH {MULTI_SQL}
    SELECT request_id, CAST((len(messages) - 1) // 2 AS INTEGER) AS num_history_round,
        length(messages[-1])::INTEGER AS request_length,
        length('Re: ' || array_to_string(messages, ' '))::INTEGER AS response_length,
        {_WORDS.format("messages[-1]")} AS request_tokens,
        {_WORDS.format("'Re: ' || array_to_string(messages, ' ')")} AS response_tokens FROM multi""",
)
def q_response_stats_naive(spark, sf_dir):
    reply = ExpressionBackend(lambda m: F.concat(F.lit("Re: "), F.array_join(m, " ")))
    return naive_stats(schedulers.naive(multi_turn(spark, sf_dir), reply))


@query(
    "response_stats_outline",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL},
    per AS (SELECT request_id, count(*)::INTEGER AS n, sum(length(point_outline))::BIGINT AS pol,
        sum({_WORDS.format("point_outline")})::BIGINT AS pot FROM contents GROUP BY request_id)
    SELECT o.request_id, 0 AS num_history_round, length(request)::INTEGER AS request_length,
        length(outline)::INTEGER AS outline_length, coalesce(n, 0) AS num_points,
        coalesce(pol, 0) AS point_outline_length, coalesce(n, 0)::BIGINT * 32 AS point_response_length,
        greatest(coalesce(n, 0) * 33 - 1, 0)::INTEGER AS response_length,
        {_WORDS.format("request")} AS request_tokens, {_WORDS.format("outline")} AS outline_tokens,
        coalesce(pot, 0) AS point_outline_tokens, coalesce(n, 0)::BIGINT AS point_response_tokens,
        coalesce(n, 0) AS response_tokens
    FROM outlines o LEFT JOIN per ON o.request_id = per.request_id""",
)
def q_response_stats_outline(spark, sf_dir):
    stats = outline_stats(schedulers.batch_outline(requests(spark, sf_dir), MODEL, PLAIN_PROMPTS))
    lists = (
        "point_outline_length",
        "point_response_length",
        "point_outline_tokens",
        "point_response_tokens",
    )
    total = {c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) for c in lists}
    return stats.withColumns(total)


@query(
    "mean_pool_embedding",
    """WITH t AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings
        WHERE vec_id % 3 <> 0),
    m AS (SELECT label, i, avg(x) AS x FROM t GROUP BY label, i),
    n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS norm FROM m)
    SELECT label, i::INTEGER AS dim, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 5) + 0.0 AS value FROM n""",
)
def q_mean_pool_embedding(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = mean_pool(tokens, ["label"], mask="mask")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 5) + 0.0
    )


@query(
    "embedding_token_total",
    """SELECT label, sum(CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS token_num
    FROM embeddings GROUP BY label""",
)
def q_embedding_token_total(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return token_total(tokens, "mask", ["label"])
