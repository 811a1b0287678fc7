"""URL rules in a sorted digest array.

The keys of the rules (host and path beginning) are stored once, sorted by their
64-bit digest, in one flat file: digests, text offsets, verdicts, texts. Workers map
the file into memory, so it need not fit into it, and share its pages. A url asks
for every domain above its host with every path beginning that could be in the rules;
all digests of a batch are searched at once, and a hit counts only if the stored text
is the same, so colliding digests do no harm.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.common import field, map_texts
from promptloom.llm.files import Output
from promptloom.session import scratch_path

VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digests_of(keys: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8")) for k in keys], np.uint64)


def index_bytes(rules: dict[str, str], digest=digests_of) -> bytes:
    """The flat file of ``{rule: verdict}``: counts, path lengths, digests, ends, verdicts, texts."""
    keys = np.array(list(rules), object)
    own = digest(keys)
    order = np.argsort(own, kind="stable")
    texts = [str(k).encode("utf-8") for k in keys[order]]
    lengths = sorted({len(k) - k.index("/") for k in rules})
    head = np.array([len(texts), len(lengths), *lengths], "<u8")
    ends = np.cumsum([0, *[len(t) for t in texts]]).astype("<u8")
    verdicts = np.array([VERDICTS.index(rules[k]) for k in keys[order]], "<u8")
    return b"".join(
        [head.tobytes(), own[order].astype("<u8").tobytes(), ends.tobytes(), verdicts.tobytes()]
        + texts
    )


class RuleIndex:
    """A rule file mapped into memory."""

    def __init__(self, file: str, digest=digests_of, longest_host: int | None = None) -> None:
        # no rule has a longer host
        self.longest_host = longest_host
        words = np.memmap(file, "<u8", "r", shape=(os.path.getsize(file) // 8,))
        n, k = int(words[0]), int(words[1])
        self.digest = digest
        self.path_lengths = words[2 : 2 + k].tolist()
        at = 2 + k
        self.digests, self.ends = words[at : at + n], words[at + n : at + 2 * n + 1]
        self.verdicts = words[at + 2 * n + 1 : at + 3 * n + 1]
        self.texts = np.memmap(file, np.uint8, "r", offset=8 * (at + 3 * n + 1)) if n else b""

    def probe(self, keys: list[str]) -> list[int]:
        """The place of each key among the rules, -1 for others."""
        wanted = self.digest(keys)
        low = np.searchsorted(self.digests, wanted, "left")
        high = np.searchsorted(self.digests, wanted, "right")
        found = [-1] * len(keys)
        for i in np.flatnonzero(low < high):
            text = keys[i].encode("utf-8")
            for at in range(low[i], high[i]):
                if bytes(self.texts[int(self.ends[at]) : int(self.ends[at + 1])]) == text:
                    found[i] = at
        return found

    def candidates(self, host: str, path: str) -> list[str]:
        """Keys that could be rules for a url, longest first, then longest host."""
        hosts = self._suffixes(host)
        keys = [
            (len(h) + n, len(h), h + path[:n])
            for h in hosts
            for n in self.path_lengths
            if n <= len(path)
        ]
        return [key for _, _, key in sorted(keys, reverse=True)]

    def _suffixes(self, host: str) -> list[str]:
        """The host and the domains above it, as far as a rule's host could be one."""
        most = len(host) if self.longest_host is None else self.longest_host
        found = [host] if host and len(host) <= most else []
        dot = host.find(".", max(0, len(host) - most - 1))
        while dot >= 0:
            found.append(host[dot + 1 :])
            dot = host.find(".", dot + 1)
        return found

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of every host and path; the longest fitting rule wins."""
        keys = [self.candidates(*u) for u in urls]
        found = self.probe([k for own in keys for k in own])
        out, at = [], 0
        for own in keys:
            hit = next((i for i in range(len(own)) if found[at + i] >= 0), None)
            verdict = None if hit is None else VERDICTS[int(self.verdicts[found[at + hit]])]
            out.append((None if hit is None else own[hit], verdict))
            at += len(own)
        return out


def share_index(spark: SparkSession, rules: dict[str, str]) -> str:
    """Give every executor the rule file; its name for ``SparkFiles.get``.

    The list is given to the driver as it is, so its size is the caller's. The file
    is written to the shared folder, from where Spark brings one copy to every
    executor's own folder.
    """
    out = Output(scratch_path(spark, "rules"), "rules", ".bin")
    out.write(index_bytes(rules))
    uri = out.close()
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def filter_urls(
    df: DataFrame,
    rules: dict[str, str],
    url: str = "url",
    carry: list[str] | None = None,
    default: str = "allow",
) -> DataFrame:
    """The columns ``carry`` in struct ``row``, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule is a host, then a path beginning; it fits its host and all subdomains. The
    longest fitting rule decides (of two of equal length the one with the longer
    host); a url that no rule fits gets ``default`` and a null rule. A null url, or
    one without ``://``, has an empty host and path, which no rule fits. One row per
    row of ``df``, in any order, whatever its columns are called.
    """
    spark = df.sparkSession
    if any("/" not in rule or rules[rule] not in VERDICTS for rule in rules):
        raise ValueError("a rule is a host, a path that begins with / and allow or block")
    name = share_index(spark, rules)
    # a host may hold any separator, so its length comes first
    pair = F.concat_ws("\n", F.length(host(F.col(url))), F.concat(host(F.col(url)), path(F.col(url))))
    source = df.select(
        F.struct(*(df.columns if carry is None else carry)).alias("row"),
        host(F.col(url)).alias("host"),
        path(F.col(url)).alias("path"),
        pair.alias("pair"),
    )

    longest = max((len(rule.partition("/")[0]) for rule in rules), default=0)

    def open_():
        index = RuleIndex(SparkFiles.get(name), longest_host=longest)

        def work(pairs):
            parts = [(int(n), both) for n, _, both in (p.partition("\n") for p in pairs)]
            told = index.judge([(both[:n], both[n:]) for n, both in parts])
            return [
                pa.array([rule for rule, _ in told], pa.string()),
                pa.array([verdict or default for _, verdict in told], pa.string()),
            ]

        return work

    fields = [field("rule", "string"), field("verdict", "string")]
    return map_texts(source, "pair", ["row", "host", "path"], open_, fields)
