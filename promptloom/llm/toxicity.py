"""Toxicity scores: boosted trees over a few dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import field, map_texts
from promptloom.session import materialise

# words that address the reader, in the languages of the corpus
SECOND_PERSON = frozenset(
    "you your yours u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre"
    " vos ti usted ustedes tus vosotros os".split()
)
# characters that stand for letters in disguised words
DISGUISE = str.maketrans("013457@$!+", "oieastasit")
PREFIXES = (4, 5, 6)
NEAR = 5
MEMO = 150_000
LONGEST_KEPT = 32  # characters of a word that is remembered

TRAIN_ROWS = 8_000  # bound of the labelled sample
LEXICON_TERMS = 400
MIN_SUPPORT = 4

NAMES = (
    "word_hits word_weight prefix_hits prefix_weight strongest hits near_second second_person"
    " obfuscated mixed stretched capitals shouted punctuation exclamations questions symbols digits"
    " length"
).split()

_EDGE = string.punctuation + "«»¡¿…–—“”„‘’"
_INNER = re.compile(r"[\W\d_]+")
_STRETCH = re.compile(r"(.)\1{2,}")


def _plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def _bare(word: str) -> str:
    """The word behind digits, inner punctuation and stretched letters."""
    return _STRETCH.sub(r"\1", _INNER.sub("", word.lower().translate(DISGUISE)))


def _terms(word: str) -> Iterator[str]:
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield "^" + word[:n]


class _Words(dict):
    """What a raw word says, worked out once; None for the many that say nothing."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.whole = {t[1:]: w for t, w in lexicon.items() if t[0] == "="}
        self.starts = {t[1:]: w for t, w in lexicon.items() if t[0] == "^"}

    def __missing__(self, raw: str):
        word = raw.strip(_EDGE).lower()
        starts = self.starts.get
        whole = self.whole.get(word, 0.0)
        prefix = max([starts(word[:n], 0.0) for n in PREFIXES])
        second = word in SECOND_PERSON
        stretched = _STRETCH.search(word) is not None
        mixed, hidden = False, 0.0
        if stretched or not word.isalpha():
            mixed = any(c.isalpha() for c in word) and not word.isalpha()
            hidden = 0.0 if whole else self.whole.get(_bare(raw), 0.0)
        shouted = len(word) > 2 and raw.isupper()
        told = None
        if whole or prefix or hidden or second or mixed or stretched or shouted:
            told = (whole, prefix, hidden, second, mixed, stretched, shouted)
        if len(raw) <= LONGEST_KEPT:
            if len(self) >= MEMO:
                self.clear()
            self[raw] = told
        return told


def _features(text: str, known: _Words) -> list[float]:
    words = text.split()
    n = max(len(words), 1)
    said = [(i, w) for i, w in enumerate(map(known.__getitem__, words)) if w]
    hits = [(i, max(w[:3])) for i, w in said if w[0] or w[1] or w[2]]
    second = [i for i, w in said if w[3]]
    near = 0
    if hits and second:
        spots = np.array(second)
        at = np.array([i for i, _ in hits])
        right = np.searchsorted(spots, at)
        gap = np.minimum(
            np.abs(spots[np.minimum(right, len(spots) - 1)] - at),
            np.abs(spots[np.maximum(right - 1, 0)] - at),
        )
        near = int((gap <= NEAR).sum())
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
    size = max(int(byte.sum()), 1)
    symbols = int(byte[35:39].sum() + byte[42] + byte[60] + byte[62] + byte[124])
    return [
        sum(1 for _, w in said if w[0]) / n,
        sum(w[0] for _, w in said) / n,
        sum(1 for _, w in said if w[1]) / n,
        sum(w[1] for _, w in said) / n,
        max((weight for _, weight in hits), default=0.0),
        math.log1p(len(hits)),
        near / n,
        len(second) / n,
        sum(1 for _, w in said if w[2]) / n,
        sum(1 for _, w in said if w[4]) / n,
        sum(1 for _, w in said if w[5]) / n,
        int(byte[65:91].sum()) / size,
        sum(1 for _, w in said if w[6]) / n,
        int(byte[33:48].sum() + byte[58:65].sum()) / size,
        int(byte[33]) / size,
        int(byte[63]) / size,
        symbols / size,
        int(byte[48:58].sum()) / size,
        math.log1p(len(words)),
    ]


def features(df: DataFrame, text: str, keep: list[str], out: str, lexicon: dict) -> DataFrame:
    """``keep`` and the array of features ``out``; a null text counts as empty."""

    def open_():
        known = _Words(lexicon)

        def work(texts):
            rows = [_features(t or "", known) for t in texts]
            return [pa.array(rows, pa.list_(pa.float64()))]

        return work

    return map_texts(df, text, keep, open_, [field(out, "array<double>")])


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: the fifth of all ids, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(
    df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bound: int
) -> DataFrame:
    """``text, label, fold`` of about ``bound`` labelled rows outside the held-out fifth.

    The rows are taken by a hash of their id; a document labelled twice counts as
    toxic if one label says so. ``fold`` 4 of 0..4 is kept for the calibration.
    """
    learn = (
        labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("id"))
        .agg((F.max(label) > 0).cast("double").alias("label"))
    )
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = 1_000_000 * bound // max(learn.count(), 1)
    # about ``bound`` ids and numbers, so the size of this side is known
    chosen = F.broadcast(learn.where(place < share))
    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(chosen, "id").select(
        "text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).alias("fold")
    )


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the words and word beginnings that mark toxic rows, the strongest ones."""
    schema = "term string, toxic long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for text, label in zip(texts, labels):
                words = {_plain(w) for w in (text or "").split()} - {""}
                terms = {t for w in words for t in _terms(w)}
                every.update(terms)
                if label:
                    toxic.update(terms)
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(list(every), pa.string()),
                    "toxic": pa.array([toxic[t] for t in every], pa.int64()),
                    "n": pa.array(list(every.values()), pa.int64()),
                }
            )

    totals = rows.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals["toxic"] or 0.0, totals["n"] - (totals["toxic"] or 0.0)
    if not toxic or not clean:
        return {}
    t, c = F.col("toxic"), F.col("n") - F.col("toxic")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    best = (
        rows.mapInArrow(count, schema)
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .where(t >= max(MIN_SUPPORT, 0.005 * toxic))
        .select("term", "toxic", odds.alias("weight"))
        .where("weight > 2")
        .orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term")
        .limit(LEXICON_TERMS)
    )
    return {r["term"]: r["weight"] for r in best.collect()}


@dataclass
class ToxicityModel:
    """A lexicon, trees and their calibration; without both classes just a base rate."""

    lexicon: dict[str, float]
    base: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None

    def score(self, df: DataFrame, text: str, keep: list[str], out: str) -> DataFrame:
        """``keep`` and ``out``, the calibrated probability; the raw one orders ties."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.base).alias(out))
        made = [_fresh(keep, n) for n in ("features", "raw", "probability", "prediction", "step")]
        self.trees.setFeaturesCol(made[0]).setRawPredictionCol(made[1])
        self.trees.setProbabilityCol(made[2]).setPredictionCol(made[3])
        self.steps.setFeaturesCol(made[3]).setPredictionCol(made[4])
        told = features(df, text, keep, made[0], self.lexicon)
        told = self.trees.transform(told.withColumn(made[0], array_to_vector(made[0])))
        toxic = vector_to_array(F.col(made[2]))[1]
        told = self.steps.transform(told.select(*keep, toxic.alias(made[3])))
        score = F.col(made[4]) * 0.999 + F.col(made[3]) * 0.001
        return told.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias(out))


def _fresh(taken: list[str], name: str) -> str:
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def fit(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bound: int = TRAIN_ROWS,
) -> ToxicityModel:
    """Learn from at most about ``bound`` labelled rows, none of them held out.

    Null texts count as empty, unlabelled and unmatched rows teach nothing; without
    labels of both kinds every score is the smoothed base rate.
    """
    rows = materialise(training_rows(df, labels, doc_id, text, label, bound), "labelled")
    lexicon = learn_lexicon(rows)
    told = materialise(features(rows, "text", ["label", "fold"], "x", lexicon), "features")
    told = told.withColumn("features", array_to_vector("x")).drop("x")
    sums = told.groupBy("label", F.expr("fold = 4").alias("last")).count().collect()
    count = {(r["label"], r["last"]): r["count"] for r in sums}
    toxic = sum(n for (y, _), n in count.items() if y)
    base = (toxic + 1) / (sum(count.values()) + 2)
    if not all(count.get((y, False)) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon, base)
    apart = all(count.get((y, True), 0) >= 20 for y in (0.0, 1.0))
    trees = GBTClassifier(
        labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, seed=7
    ).fit(told.where("fold < 4") if apart else told)
    probed = trees.transform(told.where("fold = 4") if apart else told).select(
        "label", vector_to_array(F.col("probability"))[1].alias("p")
    )
    steps = IsotonicRegression(labelCol="label", featuresCol="p").fit(probed)
    return ToxicityModel(lexicon, base, trees, steps)


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
    out: str = "score",
    bound: int = TRAIN_ROWS,
) -> DataFrame:
    """The columns ``carry`` (all by default) and ``out``, the probability of label 1.

    One row per row of ``df``, repeated rows and null ids included. Null and empty
    texts are scored like a text without words. ``out`` must not be in ``carry``.
    """
    model = fit(df, labels, doc_id, text, bound=bound)
    return model.score(df, text, list(df.columns if carry is None else carry), out)
