"""Repeated passages against brute force over all windows, and on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrostrat.llm import repeats
from cirrostrat.llm.arrowtext import Texts
from cirrostrat.llm.queries import QUERIES


def expected(docs, need):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + need] for _, t in texts for p in range(len(t) - need + 1))
    out = Counter()
    for i, t in texts:
        flag = np.zeros(len(t) + 1, int)
        for p in range(len(t) - need + 1):
            if seen[t[p : p + need]] > 1:
                flag[p] += 1
                flag[min(len(t), p + need)] -= 1
        gone = np.cumsum(flag)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        out[i, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def passages(seed=3, n=120):
    """Documents of random letters with shared passages of many lengths and places, edits inside of them, copies, and runs of one letter."""
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    shared, docs = [word(k) for k in (15, 29, 30, 31, 32, 45, 60, 90, 200)], []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 5)):
            parts.append(word(draw.choice((0, 1, 3, 40))))
            p = draw.choice(shared)
            if draw.random() < 0.5:
                a = draw.randint(0, len(p) - 1)
                p = p[:a] + draw.choice(("", "X", "yy")) + p[a + draw.randint(0, 1) :]
            parts.append(p[draw.choice((0, 0, 1, 7)) :])
        docs.append((i, "".join(parts)))
    docs += [(n, "a" * 40), (n + 1, "b" * 39 + "c" + "b" * 70), (n + 2, docs[0][1]), (n + 2, docs[1][1]), (None, docs[2][1]), (n + 3, None), (n + 4, ""), (n + 5, "é" * 20), (n + 6, "\0" * 50 + "x" + "\0" * 33)]
    return docs


@pytest.mark.parametrize(("need", "gram", "block"), [(30, 8, 4096), (30, 16, 2), (31, 31, 4096), (50, 4, 3)])
def test_cut_by_brute_force(spark, need, gram, block):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS sha", "2 AS n", "3 AS kept", "4 AS spans")
    got = repeats.cut_repeats(df.repartition(5), need, gram=gram, block=block, keep_bytes=True)
    want = expected(docs, need)
    assert sum(0 < x[2] < x[1] for x in want) > 20
    assert rows(got) == want
    for r in got.select("kept", "kept_sha256").collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_groups_name_all_occurrences(spark):
    """Each window of the text that occurs twice lies in a group whose members all hold the same bytes, and which holds all of its places."""
    docs = [(i, t) for i, t in passages(5, 60) if i is not None and t][:70]
    docs = list({t: (i, t) for i, t in docs if i != 62}.values())
    need, data = 30, {i: t.encode() for i, t in docs}
    groups = {}
    for r in repeats.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string"), need, gram=8).collect():
        groups.setdefault((r["repeat"], r.n_bytes), set()).add((r.doc_id, r.start))
    windows, covered = {}, {}
    for i, t in data.items():
        for p in range(len(t) - need + 1):
            windows.setdefault(t[p : p + need], set()).add((i, p))
    for (_, n), places in groups.items():
        strings = {data[i][p : p + n] for i, p in places}
        assert n >= need and len(places) > 1 and len(strings) == 1
        s = strings.pop()
        places_of = {(i, p) for i, t in data.items() for p in range(len(t) - n + 1) if t.startswith(s, p)}
        assert places == places_of
        for k in range(n - need + 1):
            covered.setdefault(s[k : k + need], set()).update((i, p + k) for i, p in places)
    assert groups and covered == {w: x for w, x in windows.items() if len(x) > 1}


def test_query_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(docs, 200)
    assert sum(x[2] > 0 for x in want) > 10
    assert rows(QUERIES["op12_repeats"](spark, sf)) == want


def test_hot_passage_is_cut(spark):
    """A passage that a third of all documents share, with other text around it, and a common gram inside of strings that differ."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, line = word(70), word(12)
    docs = [(i, word(60) + (passage if i % 3 == 0 else line) + word(60)) for i in range(150)]
    assert rows(repeats.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 40, gram=8, block=8)) == expected(docs, 40)


def test_long_and_empty(spark):
    draw = random.Random(1)
    long = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    docs = [(1, long * 400), (2, "x" + long), (3, "word " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.cut_repeats(df).collect()}
    assert got == {1: (1_200_000, 1_200_000, 1), 2: (3001, 3000, 1), 3: (250_000, 250_000, 1)}
    assert not repeats.cut_repeats(df.filter("false")).collect() and not repeats.repeat_groups(df.filter("false")).collect()
    assert rows(repeats.cut_repeats(df.select("doc_id", F.lit(None).cast("string").alias("text"))))[1, 0, 0, 0, hashlib.sha256(b"").hexdigest()] == 1


def test_intervals_nest():
    assert sorted(repeats.intervals([2, 5, 5, 1, 3])) == [(1, 0, 5), (2, 0, 3), (3, 4, 5), (5, 1, 3)]
    assert list(repeats.intervals([])) == []


def test_anchors_follow_content():
    """Equal windows have their anchor at the same place, in other texts and chunks too."""
    rng = np.random.default_rng(2)
    a, b = (rng.integers(97, 100, n, dtype=np.uint8) for n in (400, 300))
    one, two = np.concatenate((a, b)), np.concatenate((b[:120], a[50:350], b[120:]))
    places = [set(repeats.anchors_of(Texts(x, np.array([0, len(x)])), 60, 10)[0].tolist()) for x in (one, two)]
    inside = lambda s, lo, hi: {p - lo for p in s if lo <= p < hi}
    assert inside(places[0], 50 + 51, 350 - 60) == inside(places[1], 120 + 51, 420 - 60)
