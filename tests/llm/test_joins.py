"""Collocations, set join and hard negatives: brute force, odd rows, hot groups, long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import promptloom.llm.collocations as collocating
import promptloom.llm.setjoin as setjoin
from promptloom.llm.collocations import collocations
from promptloom.llm.common import KeyFilter
from promptloom.llm.negatives import SAFE, hard_negatives
from promptloom.llm.setjoin import jaccard_components
from promptloom.session import materialise

LOWER = {c: c + 32 for c in range(65, 91)}


# ---- phrases ----------------------------------------------------------------


def phrases_by_hand(rows, least, first):
    counts = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in found.items():
            inside = (
                q for q in found
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            )
            if any(found[q] >= a for q in inside):
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, said, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, said.decode(), -a, left, right, n, -s))
    return sorted(out)


def odd_texts(draw):
    vocabulary = ["New", "york", "CITY", "état", "of", "the", "a", "x" * 40]
    rows = [(None, "New York, new york. NEW\tYORK!\nnew york"), ("", "a a a a a a a"), ("de", None)]
    rows += [("de", ""), ("de", " \t \x0b\x0c"), ("en", "...!?"), ("en", "the\x1cof \x00 the\x1cof")]
    for i in range(120):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 30))]
        rows.append((draw.choice(["en", "en", "de", None]), draw.choice([" ", ", ", "  "]).join(words)))
    return rows + rows[-5:]


def test_collocations_by_hand(spark):
    rows = odd_texts(random.Random(4))
    made = spark.createDataFrame(rows, "lang string, text string")
    df = made.withColumns({c: F.lit(1) for c in ("n", "hash", "w1", "score", "phrase")})
    got = collocations(df, least=4, first=7)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 4, 7)
    assert collocations(df.limit(0)).count() == 0


def test_collocations_repeat_with_other_hashes_when_two_words_collide(spark, monkeypatch):
    rows = [("en", "big cat. big dog. big cat")] * 5
    plain = collocating._opener
    seeds = []

    def opener(seed):
        seeds.append(seed)
        made = plain(seed)
        if seed:
            return made

        def merging():
            tool = made()
            hashes = tool.hashes
            # all words of three letters get one hash
            tool.hashes = lambda data, begin, end: np.where(
                end - begin == 3, np.uint64(7), hashes(data, begin, end)
            )
            return tool

        return merging

    monkeypatch.setattr(collocating, "_opener", opener)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations(df, least=3).collect())) == phrases_by_hand(rows, 3, 2000)
    assert seeds == [0, 1]


def test_words_and_pairs_are_not_counted_again_with_longer_runs(spark, monkeypatch):
    # frequent words in ever other company, one frequent pair, no frequent run of three
    rows = [("en", f"x{i} {i % 7}a {i % 5}b y{i}, red fox z{i} red fox") for i in range(70)]
    steps, plain = [], collocating._totals
    monkeypatch.setattr(
        collocating, "_totals", lambda *given: steps.append(given[-1]) or plain(*given)
    )
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, collocations(df, least=20).collect()))
    assert got == phrases_by_hand(rows, 20, 2000) and [r[2] for r in got] == ["red fox"]
    own = collocating.Words([text for _, text in rows], "en", collocating._opener(0)())
    assert steps[-1](own).shape[1] == 0


def test_scores_of_large_counts_are_exact(spark):
    """Counts whose product passes 64 bits, through the expression that the operator uses."""
    a, n, left, right = 3_000_000_019, 9_000_000_000_037, 4_000_000_007, 5_000_000_029
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "anlr"}
    got = row.select(F.expr(f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"))
    assert got.first()[0] == 1000 * a * n // (left * right)


def test_long_texts_are_cut_where_pieces_end():
    text = "alpha beta, " * 300_000 + "gamma" * 400_000
    parts = list(collocating.cut_long(text, 1 << 16))
    assert "".join(parts) == text and len(parts) > 40
    assert all(p.endswith(",") for p in parts[:-1])


def test_key_filter_knows_its_keys(spark):
    draw = np.random.default_rng(1)
    keys = draw.integers(-(2**63), 2**63, 5000)
    known = KeyFilter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert known(keys.view(np.uint64)).all()
    assert known(draw.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.02


# ---- set join ---------------------------------------------------------------


def components_by_hand(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))} if words else set())
    smallest = list(range(len(rows)))
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(smallest[a], smallest[b])
            changed |= smallest[a] != low or smallest[b] != low
            smallest[a] = smallest[b] = low
    return {rows[i][0]: (len(sets[i]), rows[smallest[i]][0]) for i in range(len(rows))}


def edits_of(draw, base, n, most):
    """Copies of a text with up to ``most`` words changed: links lie around the limit."""
    out = []
    for _ in range(n):
        words = list(base)
        for at in draw.sample(range(len(words)), draw.randint(0, most)):
            words[at] = f"x{draw.randint(0, 12)}"
        out.append(" ".join(words[draw.randint(0, 5) :] if draw.random() < 0.3 else words))
    return out


def test_components_of_edits_as_by_brute_force(spark):
    """One large group, so that members meet heads that they do not link to."""
    draw = random.Random(8)
    texts = edits_of(draw, [f"b{k}" for k in range(120)], 150, 7)
    texts += edits_of(draw, [f"c{k}" for k in range(60)], 30, 3)
    texts += [" ".join(f"q{draw.randint(0, 3)}" for _ in range(draw.randint(0, 14))) for _ in range(30)]
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components_by_hand(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 20 < len({c for _, c in want.values()}) < 200


def test_components_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, words), (3, words.upper()), (9, words + " more"), (1, None), (2, ""), (4, " \n\t"),
        (6, "two words"), (7, "Two\tWORDS"), (8, "one"), (None, words), (3, words.upper()),
        (12, "other " * 3), (12, "quite another text here"), (13, "quite another text here"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    df = made.withColumns({c: F.lit("x") for c in ("id", "n", "node", "token", "component")})
    got = jaccard_components(df).collect()
    assert len(got) == len(rows)
    told = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert (5, 38, 3) in told and told.count((3, 38, 3)) == 2 and (9, 39, 3) in told
    assert [t for t in told if t[0] in (1, 2, 4)] == [(1, 0, 1), (2, 0, 2), (4, 0, 4)]
    assert (6, 1, 6) in told and (7, 1, 6) in told and (8, 1, 8) in told and (None, 38, None) in told
    # an id on two texts: each row by its own text
    assert (12, 2, 12) in told and (12, 2, 12) in told and (13, 2, 12) in told
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x" * 1_000_000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


# ---- hard negatives ---------------------------------------------------------


def negatives_by_hand(rows, is_anchor):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        kept.append((vec_id, [math.floor(256 * v) if abs(v) < 2**52 else 256 * int(v) for v in vector], label))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, (name, own, label) in enumerate(kept):
        if not is_anchor(name):
            continue
        score = [sum(a * b for a, b in zip(own, v)) for _, v, _ in kept]
        same = sorted(((score[j], k[0]) for j, k in enumerate(kept) if j != i and k[2] == label), key=key)
        other = sorted(((score[j], k[0]) for j, k in enumerate(kept) if k[2] != label), key=key)
        for p, positive in same[:5]:
            fits = [t for t in other if 50 * p <= 100 * t[0] <= 95 * p][:3]
            out += [(name, positive, r, q, p, s) for r, (s, q) in enumerate(fits, 1)]
    return Counter(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_negatives_by_hand(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 16)) / 4
    rows = [(i, (centres[i % 4] + draw.normal(size=16) / 9).astype(np.float32).tolist(), int(i * 7 % 3)) for i in range(400)]
    # ties, and a third of all rows in one vector
    rows += [(1000 + i, rows[8][1], i % 2) for i in range(200)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0)
    want = negatives_by_hand(rows, lambda i: i % 20 == 0)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 200


@pytest.mark.parametrize("scale", [1.0, 2.0**20])
def test_negatives_of_odd_rows(spark, scale):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (10, [1.0, 1.0], 1), (2, [0.5, 1.0], 1), (3, [0.7, 0.7], 2),
        (4, [0.6, 0.7], 2), (4, [0.6, 0.7], 2), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [1.0, 1.0], None), (None, [0.7, 0.6], 2), (11, [], 2), (12, [-1.0, -1.0], 2),
        (20, [0.0, 0.0], 3), (30, [1.5], 1), (40, [-1.0, 0.25], 5),
    ]
    grown = [(i, v and [x and float(np.float32(x * scale)) for x in v], c) for i, v, c in rows]
    made = spark.createDataFrame(grown, SCHEMA)
    df = made.withColumns({c: F.lit("x") for c in ("rid", "block", "kind", "score", "goal", "vector")})
    got = hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = negatives_by_hand(grown, lambda i: i is not None and i % 10 == 0)
    assert Counter(map(tuple, got.collect())) == want and want
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_negatives_of_long_vectors(spark):
    """More components than a block holds, and rows beyond exact doubles."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=3000).astype(np.float32).tolist(), i % 2) for i in range(40)]
    rows[7] = (7, (np.array(rows[7][1]) * SAFE).tolist(), 1)
    df = materialise(spark.createDataFrame(rows, SCHEMA), "long")
    got = Counter(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    exact = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert got == negatives_by_hand(exact, lambda i: i % 10 == 0)


def test_only_sets_in_pairs_are_read_for_a_join(spark):
    sets = spark.range(5000).selectExpr("id AS node", "array(id, id + 1) AS shingles")
    pairs = spark.createDataFrame([(1, 2), (7, 8), (7, 4000)], "a long, b long")
    for name, nodes in (("a", {1, 7}), ("b", {2, 8, 4000})):
        got = {r["node"] for r in setjoin._sets_of(sets, pairs, name).collect()}
        assert nodes <= got and len(got) < 20
    got = {(r["a"], r["b"]): r["common"] for r in setjoin._with_overlap(pairs, sets).collect()}
    assert got == {(1, 2): 1, (7, 8): 1, (7, 4000): 0}
    assert setjoin._with_overlap(pairs.limit(0), sets).count() == 0


def test_whole_sets_are_made_only_of_pairs_that_counts_leave(spark, monkeypatch):
    made = Counter()

    def noted(df, label="stage"):
        out = materialise(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(setjoin, "materialise", noted)
    # texts of two passages: any two that share one are in company, and far from linked
    passages = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(12)]
    rows = [(a, b) for a in range(12) for b in range(a)]
    rows = [(k, f"{passages[a]} {passages[b]}") for k, (a, b) in enumerate(rows)]
    rows += [(100, rows[0][1] + " end"), (101, rows[0][1] + " end"), (100, "others " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard_components(df).collect()]
    assert sorted(got) == sorted([(k, 0 if k in (0, 101) else k) for k, _ in rows[:-3]] + [(100, 0), (101, 0), (100, 100)])
    assert made["met"] > 50 and 2 <= made["sets"] < 15


def test_members_that_cannot_link_are_not_compared(spark, monkeypatch):
    # set 9 and member 1 share shingles, but too late in order for a link; with 10 it links
    handed, plain = {}, setjoin.materialise
    monkeypatch.setattr(
        setjoin, "materialise", lambda df, label: handed.setdefault(label, plain(df, label))
    )
    head, own = list(range(600)), iter(range(10_000, 10**6))
    sets = {0: head}
    for i in range(1, 9):
        sets[i] = head[:570] + [next(own) for _ in range(30)]
    sets[9] = head[:560] + sets[1][-12:] + [next(own) for _ in range(60)]
    sets[10] = sets[9][:-30] + [next(own) for _ in range(5)]
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    label = spark.createDataFrame(
        [(k, 0) for k in sets if k != 9], "node long, component long"
    )
    heads = spark.createDataFrame([(0, 0)], "component long, head long")
    stray = spark.createDataFrame(
        [(9, 0, 0, 1 - 560 / 672)], "node long, head long, component long, gap double"
    )
    got = setjoin._derived_links(stray, label, heads, table).collect()
    assert [tuple(r) for r in got] == [(9, 10)]
    assert [(r["a"], r["b"]) for r in handed["derived"].collect()] == [(9, 10)]


def test_only_shingles_of_several_sets_become_postings(spark):
    rows = [(i, 20, [1000 * i + k for k in range(20)] + ([7] if i < 3 else [])) for i in range(1, 50)]
    rows.append((50, 0, []))
    nodes = spark.createDataFrame(rows, "node long, n long, head array<long>")
    got = {tuple(r) for r in setjoin._postings(nodes).collect()}
    assert {(1, 20, 20, 7), (2, 20, 20, 7)} <= got
    full = {(r[0], r[1], p, t) for r in rows for p, t in enumerate(r[2])}
    assert got <= full and len(got) < len(full) / 2
    assert setjoin._postings(nodes.limit(0)).count() == 0
