"""Spelling variants against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cirrostrat.llm import variants
from cirrostrat.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def neighbours_of(words):
    """Near words by the strings that a deletion leaves, each pair checked."""
    shells = defaultdict(set)
    for w in words:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shells[x].add(w)
    near = defaultdict(set)
    for some in shells.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    return near


def expected(counts, ratio=10):
    near, form = neighbours_of(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_query_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(counted(docs))
    assert len(want) > 100 and sum(x[4] > 0 for x in want) > 20 and sum(x[1] is not None for x in want) > 5
    assert rows(QUERIES["op11_spelling_variants"](spark, sf)) == want


@pytest.mark.parametrize("block", [4096, 6, 1])
def test_random_words(spark, block):
    """Short alphabets, so that edits at each place, at both ends and in runs of one letter occur, and chains of forms; small blocks cut windows."""
    draw = random.Random(7)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 7))): draw.choice((1, 3, 40, 500, 7000)) for _ in range(500)}
    counts |= {"z" * 3000: 5, "z" * 2999: 60, "z" * 2998 + "y": 600, "ÿ": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert rows(variants.group_variants(df, block=block)) == expected(counts)


def test_hot_partition(spark):
    """A third of all words share all but two letters, which the windows separate; a chain of four forms."""
    letters = "abcdefghijklmnop"
    counts = {f"contin{a}u{b}ation": 2 for a in letters for b in letters} | {f"word{'abcdefghijk'[i % 11]}x{i:03d}".translate(str.maketrans("0123456789", "qrstuvwxyz")): 2 for i in range(300)}
    counts |= {"chained": 2, "chainer": 20, "chainerx": 200, "chaineyx": 2000, "chaneyx": 20_000}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(variants.group_variants(df, block=16))
    assert got == expected(counts) and ("chained", "chainer", "chaneyx", 2, 1, 20) in got


def test_acceptors_are_minimal():
    machines = variants.Acceptors()
    start = machines.add(sorted(["cat", "bat", "rat", "cot", "bot", "rot"]))
    assert len(machines.arcs) == 4  # one state for each length of rest
    pairs = {frozenset(p) for p in machines.one_edit(start, None, 3)}
    assert len(pairs) == 9 and machines.add([]) is None


def test_odd_documents(spark):
    text = "Straße straße ÀÉÎÕÜÿ× naïveté, naivete' xİstanbul stanbuls"
    docs = [(None, text), (None, text), (1, None), (2, ""), (3, "1234 --"), (4, "abcdefg" * 300), (4, "ABCDEFG" * 300), (5, "ﬁnished finished"), (5, "ﬁnished finished")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "'y' AS n", "1 AS id", "2 AS form")
    assert rows(variants.group_variants(variants.count_words(df, slips=31))) == expected(counted(docs))
    plain = {r.word: r.n for r in variants.count_words(df, least=3, occurrences=1).collect()}
    assert plain["straße"] == 4 and plain["stanbul"] == 2 and "istanbul" not in plain
    assert not rows(variants.group_variants(variants.count_words(df.filter("false"), slips=31)))
    assert not rows(variants.group_variants(spark.createDataFrame([(None, 3)], "word string, n long")))
