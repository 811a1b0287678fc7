"""Training data, training and use of the router."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions.bind import bind
from promptloom.operators.generate import Backend
from promptloom.plans.descent import lbfgs
from promptloom.plans.schedulers import naive
from promptloom.session import materialise

# Longest request in tokens, what the two kinds of error weigh, by what
# labels are multiplied in the Tversky part of the loss, and that part's share.
MAX_TOKENS = 512
FP_RATIO = 0.7
FN_RATIO = 0.3
LABEL_SMOOTHING = 0.9
TVERSKY_RATIO = 0.75

# keeps words that occur on one side only from growing without end
DECAY = 1e-3
_FEW = 1000


def token_ids(words: Column, buckets: int = 1 << 18, length: int = MAX_TOKENS) -> Column:
    """Ids 1 to ``buckets`` of the first ``length`` words."""
    return F.transform(
        F.slice(words, 1, length), lambda w: (F.pmod(F.crc32(w), F.lit(buckets)) + 1).cast("int")
    )


def padded_features(words: Column, buckets: int = 1 << 18, length: int = MAX_TOKENS) -> Column:
    """Token ids (1 to ``buckets``) cut and padded with 0, and the mask."""

    def features(kept: Column) -> Column:
        ids = token_ids(kept, buckets, length)
        pad = F.array_repeat(F.lit(0), F.lit(length) - F.size(kept))
        mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), pad)
        return F.struct(F.concat(ids, pad).alias("input_ids"), mask.alias("attention_mask"))

    return bind(F.slice(words, 1, length), features)


def request_words(request: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(request), r"(?U)\s+"), lambda w: w != "")


def hashed_split(
    df: DataFrame, ratio: float = 0.8, seed: int = 1, key: str = "request_id"
) -> DataFrame:
    """Add ``is_train``: about ``ratio`` of the rows, without any shuffle."""
    bound = int(ratio * (1 << 32))
    return df.withColumn("is_train", _rank_hash(key, seed, 8) < bound)


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _rank_hash(key: str, seed: int, digits: int) -> Column:
    return F.conv(F.substring(_digest(key, seed), 1, digits), 16, 10).cast("long")


def exact_split(
    df: DataFrame, ratio: float = 0.8, seed: int = 1, key: str = "request_id"
) -> DataFrame:
    """Add ``is_train`` to exactly ``int(ratio * n)`` rows, in order of a seeded hash.

    ``key`` is unique, so the hashes are spread evenly. The last training row is
    found by counting rows under each next four hex digits, at most 65,536
    counts a round, until few rows share the digits; then one comparison per
    row tells its side. Nothing is sorted or numbered as a whole.
    """
    keyed = df.select(_digest(key, seed).alias("d"), F.col(key).alias("k"))
    prefix, missing = "", None
    while True:
        digits = F.substring("d", len(prefix) + 1, 4)
        counts = dict(
            (r["p"], r["n"])
            for r in keyed.where(F.col("d").startswith(prefix))
            .groupBy(digits.alias("p"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        if missing is None:
            missing = int(ratio * sum(counts.values()))
            if missing == 0:
                return df.withColumn("is_train", F.lit(False))
        for part in sorted(counts):
            if missing <= counts[part]:
                break
            missing -= counts[part]
        prefix += part
        if counts[part] <= _FEW or len(prefix) == 32:
            break
    edge = keyed.where(F.col("d").startswith(prefix)).orderBy("d", "k").limit(missing).collect()[-1]
    digest = _digest(key, seed)
    before = (digest < edge["d"]) | ((digest == edge["d"]) & (F.col(key) <= edge["k"]))
    return df.withColumn("is_train", before)


@dataclass(frozen=True)
class RouterModel:
    """Weights of the token ids 1, 2, …; the first one is the intercept."""

    weights: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"id": np.arange(len(self.weights)), "weight": self.weights})
        spark.createDataFrame(rows).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RouterModel:
        rows = spark.read.parquet(path).toArrow().sort_by("id")
        return cls(rows.column("weight").to_numpy().copy())


def _logits(ids: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of lists of ids, the ids in a row, and the list that each belongs to."""
    size = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    # a request's weight does not grow with its length
    total = np.bincount(owner, weights=weights[flat], minlength=len(size))
    return weights[0] + total / np.sqrt(np.maximum(size, 1)), flat, owner


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> dict[str, np.ndarray]:
    """What loss and gradient need of the rows of one task."""
    n = len(weights)
    # rows, weighted rows, p, y, both, cross entropy
    totals = np.zeros(6)
    slopes = np.zeros((3, n))
    for batch in batches:
        ids = batch.column("ids")
        z, flat, owner = _logits(ids, weights)
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        y = LABEL_SMOOTHING * label
        entropy = np.logaddexp(0.0, z) - label * z
        totals += [
            len(z), weight.sum(), p.sum(), y.sum(), np.minimum(p, y).sum(), (weight * entropy).sum()
        ]
        bent = p * (1.0 - p)
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        share = 1.0 / np.sqrt(np.maximum(size, 1))
        for k, part in enumerate((weight * (p - label), bent, bent * (p < y))):
            slopes[k] += np.bincount(flat, weights=(part * share)[owner], minlength=n)
            slopes[k, 0] += part.sum()
    return {"totals": totals, "slopes": slopes}


def composite_loss(rows: DataFrame, buckets: int, tversky_ratio: float):
    """Loss and gradient over ``ids, label, weight``: one job per call.

    ``(1 - tversky_ratio)`` of the weighted cross entropy and ``tversky_ratio`` of the
    Tversky loss, whose numerator and denominator are sums over all rows. A task adds up
    both and the three vectors from which the gradient of any such mix follows; Spark
    sums them by position, so the driver gets one row per position in use.
    """
    context = rows.sparkSession.sparkContext
    schema = "id long, entropy double, p double, both double"

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        known = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _sums(batches, known.value)
            used = np.flatnonzero(found["slopes"].any(axis=0))
            ids = np.concatenate((used, [-1, -2]))
            columns = np.hstack((found["slopes"][:, used], found["totals"].reshape(2, 3).T))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *map(pa.array, columns)], names=["id", "entropy", "p", "both"]
            )

        told = (
            rows.mapInArrow(run, schema)
            .groupBy("id")
            .agg(*[F.sum(c).alias(c) for c in ("entropy", "p", "both")])
            .toArrow()
        )
        known.destroy()
        ids = told.column("id").to_numpy()
        values = np.vstack([told.column(c).to_numpy() for c in ("entropy", "p", "both")])
        count, weight, p = values[:, ids == -1].sum(axis=1)
        y, both, entropy = values[:, ids == -2].sum(axis=1)
        slopes = np.zeros((3, buckets + 1))
        slopes[:, ids[ids >= 0]] = values[:, ids >= 0]
        below = both + FP_RATIO * (p - both) + FN_RATIO * (y - both)
        if count == 0 or below <= 0:
            return 0.0, np.zeros(buckets + 1)
        tversky = both / below
        by_both = (below - both * (1 - FP_RATIO - FN_RATIO)) / below**2
        by_p = -both * FP_RATIO / below**2
        calm = weights.copy()
        calm[0] = 0.0
        loss = (
            (1 - tversky_ratio) * entropy / weight
            + tversky_ratio * (1 - tversky)
            + DECAY / 2 * float(calm @ calm)
        )
        slope = (
            (1 - tversky_ratio) * slopes[0] / weight
            - tversky_ratio * (by_both * slopes[2] + by_p * slopes[1])
            + DECAY * calm
        )
        return loss, slope

    return evaluate


def labelled_features(labelled: DataFrame, buckets: int, class_weights: bool) -> DataFrame:
    """``ids, label, weight`` of ``request, label``; a null request has no words."""
    words = request_words(F.coalesce("request", F.lit("")))
    weight = F.when(F.col("label") == 0, FP_RATIO).otherwise(FN_RATIO)
    return labelled.where(F.col("label").isNotNull()).select(
        token_ids(words, buckets).alias("ids"),
        F.col("label").cast("double").alias("label"),
        (weight if class_weights else F.lit(1.0)).alias("weight"),
    )


def logistic_start(labelled: DataFrame, features: int = 1 << 14, iterations: int = 10) -> np.ndarray:
    """Weights of a logistic regression in which an unneeded outline costs more than a
    missed one."""
    rows = materialise(labelled_features(labelled, features, True), "labelled")
    return lbfgs(composite_loss(rows, features, 0.0), np.zeros(features + 1), iterations)


def train_router(
    labelled: DataFrame,
    features: int = 1 << 14,
    iterations: int = 15,
    tversky_ratio: float = TVERSKY_RATIO,
    start: np.ndarray | None = None,
) -> RouterModel:
    """A linear model on the router's own features, trained on the router's own loss.

    The features are the hashed ids of the first 512 words of ``request``; the loss is
    that of :func:`router_loss`, cross entropy and Tversky loss mixed. Training begins
    at ``start``, by default a logistic regression, and never ends above its loss.
    Rows without label are left out.
    """
    rows = materialise(labelled_features(labelled, features, False), "labelled")
    if start is None:
        start = logistic_start(labelled, features)
    return RouterModel(lbfgs(composite_loss(rows, features, tversky_ratio), start, iterations))


def predict(model: RouterModel, requests: DataFrame) -> DataFrame:
    """Add ``label`` (0 plain, 1 outline) and ``prob`` of label 1; no shuffle."""
    known = requests.sparkSession.sparkContext.broadcast(model.weights)
    words = request_words(F.coalesce("request", F.lit("")))
    asked = requests.withColumn("_ids", token_ids(words, len(model.weights) - 1))
    kept = [f for f in requests.schema.fields if f.name not in {"prob", "label"}]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("prob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, _, _ = _logits(batch.column("_ids"), known.value)
            prob = pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), prob], names=[*names, "prob"]
            )

    scored = asked.mapInArrow(run, schema)
    return scored.withColumn("label", (F.col("prob") > 0.5).cast("int"))


def choice_label(text: Column) -> Column:
    """Label from a model's A, B or C: only A (independent points) is 1."""
    letter = F.regexp_extract(text, r"^\s*([ABC])\b", 1)
    return F.when(letter == "A", 1).when(letter != "", 0)


def prompt_router(requests: DataFrame, backend: Backend, prompt: str) -> DataFrame:
    """Ask the model itself; unreadable choices give a null label."""
    return naive(requests, backend, prompt).select(
        "request_id", "request", "response", choice_label(F.col("response")).alias("label")
    )
