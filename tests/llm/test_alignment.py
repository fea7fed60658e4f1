"""Token alignment against plain loops over the libraries' own tokens, and on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cirrostrat.llm import alignment
from cirrostrat.llm.queries import QUERIES, tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_file(A)), SentencePieceProcessor(model_file=tokenizer_file(B))
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    raw_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return (lambda t: [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, raw_b(b.id_to_piece(i))) for i in b.encode(t)])


def expected(docs, libraries):
    rows, df = [], Counter()
    for doc_id, text in docs:
        a, b = (f(text) if text else [] for f in libraries)
        if not text or any(b"".join(x for _, x in tokens) != (" " + text).encode() for tokens in (a, b)):
            rows.append((doc_id, [], [], [], Counter()))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links, j = Counter(), 0
        for lo, hi, i in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links[i, spans[1][k][2]] += 1
                k += 1
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        at, groups = [0, 0], []
        for end in ends:
            parts = []
            for side in (0, 1):
                first = at[side]
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= end:
                    at[side] += 1
                parts.append(",".join(str(x[2]) for x in spans[side][first : at[side]]))
            groups.append("|".join(parts))
        df.update(links.keys())
        rows.append((doc_id, a, b, groups, links))
    top = {}
    for (i, _), n in df.items():
        top[i] = max(top.get(i, 0), n)
    return Counter(
        (d, len(a), len(b), len(g), sum(x.values()), sum(n for p, n in x.items() if df[p] == top[p[0]]), sum(n * df[p] for p, n in x.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in rows
    )


def rows(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_query_by_brute_force(spark, sf, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(docs, libraries)
    assert sum(x[3] > 0 for x in want) > 100
    assert rows(QUERIES["op13_token_alignment"](spark, sf)) == want


ODD = [
    (1, "plain text"), (1, "plain text"), (2, None), (3, ""), (4, "a ▁ mark"), (5, "<|endoftext|> and </s> <s> <unk> <0x0A> [INST]"), (6, "  two  spaces\n\n\ttabs \r\n"), (7, " "), (8, "\n"),
    (9, "naïve ﬁ ½ Å 漢字 🙂🙂 ‍   　 \x00 \x1c"), (None, "no id, and don't I'll we've"), (10, "x" * 5000 + " " + "lorem ipsum " * 3000), (11, "▁"), (12, "é é"), (13, "0123456789 3.14159"),
]


@pytest.mark.parametrize("head", [1 << 19, 40, 0])
def test_odd_documents(spark, libraries, head):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS pair", "2 AS n", "3 AS best", "4 AS links")
    files = tokenizer_file(A), tokenizer_file(B)
    assert rows(alignment.align_documents(df, *files, head=head)) == expected(ODD, libraries)
    if not head:
        assert not rows(alignment.align_documents(df.filter("false"), *files))


def test_gallop_finds_places():
    draw = random.Random(4)
    for n, m, top in [(1, 1, 5), (3, 50, 60), (40, 4000, 5000), (700, 701, 900), (1000, 30_000, 40_000), (0, 5, 9)]:
        for _ in range(20):
            short, long = (np.array(sorted(draw.sample(range(top), k))) if k else np.zeros(0, int) for k in (n, min(m, top)))
            assert np.array_equal(alignment.gallop(short, long), np.searchsorted(long, short))
    clustered = np.concatenate((np.arange(3), np.arange(10_000, 10_050)))
    assert np.array_equal(alignment.gallop(clustered, np.arange(0, 20_000, 3)), np.searchsorted(np.arange(0, 20_000, 3), clustered))


def test_align_is_symmetric():
    a, b = np.array([2, 3, 7, 9, 12]), np.array([1, 2, 9, 10, 12])
    upto_a, upto_b, link_a, link_b = alignment.align(a, b)
    assert upto_a.tolist() == [1, 4, 5] and upto_b.tolist() == [2, 3, 5]
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (4, 4)]
    more = np.array([1, 2, 3, 4, 5, 6, 7, 9, 12])
    one, two = alignment.align(more, b), alignment.align(b, more)
    assert all(np.array_equal(x, y) for x, y in zip(one[:2], two[1::-1])) and set(zip(one[2].tolist(), one[3].tolist())) == set(zip(two[3].tolist(), two[2].tolist()))
