"""Quality rules per text and per host, built-in functions only.

A text fails on its own account when it has few words or when many of its words
lie in 5-word windows that it repeats. A host fails when the rate of failing
texts, shrunk towards all hosts' rate by an empirical beta prior, exceeds a limit;
then all its documents go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.session import materialise

WHITE = "\\x20\\x09-\\x0D"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5


def words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{WHITE}]+")
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(word: Column) -> Column:
    """How many words lie in 5-word windows found twice or more, the first included.

    Windows are compared by 64-bit hash. Only a text in which two windows agree is
    sorted; the words covered are then counted from the gaps between the windows.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def twice(e: Column, j: Column) -> Column:
                last = F.size(s) - 1
                same = ((j > 0) & (F.get(s, j - 1)["x"] == e["x"])) | (
                    (j < last) & (F.get(s, j + 1)["x"] == e["x"])
                )
                return F.when(same, e["i"]).otherwise(F.lit(-1))

            return F.sort_array(F.filter(F.transform(s, twice), lambda p: p >= 0))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            _bound(pairs, positions),
            start,
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(word) - WINDOW),
        lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(word) <= WINDOW, F.lit(0)).otherwise(
        _bound(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                covered(h)
            ),
        )
    )


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_rules(text: Column) -> Column:
    """All counts of a text and ``base_failed`` as one struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    spaces = F.char_length(F.translate(text, WHITE_CHARS, ""))
    counts = _bound(
        words(text),
        lambda w: F.struct(F.size(w).alias("words"), repeat_words(w).alias("repeats")),
    )
    return _bound(
        counts,
        lambda c: F.struct(
            c["words"].cast("long").alias("n_words"),
            spaces.cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")))
            .cast("long")
            .alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"),
            c["repeats"].cast("long").alias("n_repeat_words"),
            (
                (c["words"] < MIN_WORDS)
                | (
                    c["repeats"].cast("long") * 100
                    > c["words"].cast("long") * MAX_REPEAT_PERCENT
                )
            ).alias("base_failed"),
        ),
    )


def host_verdicts(judged: DataFrame, host: str, failed: str, limit: float) -> DataFrame:
    """``host, n_docs, n_failed, rate, host_failed``; documents without a host have no verdict.

    The prior is a beta distribution with the pooled rate m as mean. Its weight k
    comes from the spread of the hosts' rates beyond what chance gives: with t the
    weighted variance of the rates minus the expected binomial part, k = m(1-m)/t - 1,
    held between 1 and a million. A host's rate becomes (failures + k m) / (documents + k).
    """
    counts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(
            F.count("*").cast("double").alias("n_docs"),
            F.sum(F.col(failed).cast("double")).alias("n_failed"),
        )
    )
    # sums over all hosts: n, failures, failures squared over n, number of hosts
    n, f, q, h = (F.col(c) for c in ("n", "f", "q", "h"))
    m = f / n
    spread = (q / n - m * m) - h * m * (1 - m) / n
    weight = F.when(spread <= 0, 1e6).otherwise(
        F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / spread - 1))
    )
    prior = (
        counts.agg(
            F.sum("n_docs").alias("n"),
            F.sum("n_failed").alias("f"),
            F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"),
            F.count("*").cast("double").alias("h"),
        )
        .where(F.col("n") > 0)
        .select(m.alias("m"), weight.alias("k"))
    )
    # the prior is one row
    rate = (F.col("n_failed") + F.col("k") * F.col("m")) / (F.col("n_docs") + F.col("k"))
    return counts.join(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed", rate.alias("rate"), (rate > limit).alias("host_failed")
    )


def quality(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    carry: Sequence[str] | None = None,
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Struct ``doc`` of the columns ``carry`` (all by default), ``rules``, ``host_failed``, ``kept``.

    One row per row of ``df``, repeated rows and rows without an id included, and
    whatever its columns are called. A null text counts as empty, so it has no
    words and fails. A null host is never judged: such documents stand on their
    own. An empty table gives an empty result. A single text is worked on within
    one task, with a few numbers per word.
    The rules are computed once and written to the shared folder, with the carried
    columns; host verdicts are joined to the written rows, by broadcast or by a
    shuffle that splits a hot host, as adaptive execution finds.
    """
    carried = F.struct(*(df.columns if carry is None else carry))
    judged = materialise(
        df.select(
            carried.alias("doc"), F.col(host).alias("host"), base_rules(F.col(text)).alias("rules")
        ),
        "rules",
    )
    flat = judged.select("host", F.col("rules.base_failed").alias("failed"))
    hosts = materialise(host_verdicts(flat, "host", "failed", max_host_rate), "hosts")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return judged.join(hosts.select("host", "host_failed"), "host", "left").select(
        "doc",
        "rules",
        host_failed.alias("host_failed"),
        (~F.col("rules.base_failed") & ~host_failed).alias("kept"),
    )
