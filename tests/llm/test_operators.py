"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cirrostrat.llm import arrowtext, chat, html_text, links, minhash, mixing, neighbours, pieces, records, sharding, url_rules
from cirrostrat.llm.host_rules import judge_documents, keep_documents
from cirrostrat.llm.queries import QUERIES, URL_RULES, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum dolor sit amet " * 60_000  # more bytes than one run holds
ODD = [
    (1, "one two three four five six seven eight nine ten eleven", "a"),
    (2, "ONE two three four five six seven eight nine ten eleven", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \n\t ", "b"),
    (6, "word", "b"),
    (7, LONG, "c"),
    (8, LONG + "end", "c"),
    (9, "é\u3000ü ▁ mixed\x00 text \x1c here 🙂 and\u00a0there", "b"),
    (9, "é\u3000ü ▁ mixed\x00 text \x1c here 🙂 and\u00a0there", "b"),
    (None, "a null id has this text of some ten or eleven words", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents, with further columns named as operators name theirs."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in ("size", "taken", "mix", "rank", "component_id", "n", "g", "id", "host", "rep", "ids", "units", "shard", "slot", "kept", "unit", "key", "lang"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


# Words


def test_words_and_lines_of_any_bytes():
    texts = ["a b\tc", "", "\u3000x \x1c y", "end\n\nend\n x", None, "é é"]
    for _, _, t in arrowtext.runs(pa.array(texts), limit=4):
        pass
    whole = next(arrowtext.runs(pa.array(texts)))[2]
    assert list(whole.n_words) == [len(WORD.findall(x or "")) for x in texts]
    start, end, of = whole.lines()
    assert Counter(of.tolist()) == Counter({0: 1, 2: 1, 3: 3, 5: 1})
    h = whole.words()
    assert h[-1] == h[-2] and len(set(h.tolist())) == len(h) - 2


def test_whole_groups_never_cut_a_key():
    keys = np.repeat(np.arange(30), np.random.default_rng(0).integers(1, 9, 30))
    table = pa.table({"g": keys})
    got = [t.column("g").to_pylist() for t in arrowtext.whole_groups(iter(table.to_batches(max_chunksize=5)), "g")]
    assert sum(got, []) == keys.tolist() and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


# 1


def test_near_duplicates_match_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op1_minhash"](spark, sf).collect()}
    want = brute_groups(documents, 3, 85, 100)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("blocks", [{}, {"list_rows": 3, "block_rows": 5, "block_shingles": 400}])
def test_chains_and_blocks_lose_no_link(spark, blocks):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(40):  # each is near the one before; the ends are far apart
        base[(i * 3) % 120] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(rng.choice(words, 90))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85, 100, **blocks).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 85, 100).items()}


def test_dense_groups_and_their_rest_lose_no_link(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    base, rows = list(rng.choice(words, 100)), []
    for i in range(150):  # a dense group, a sparse one around it, and chains between both
        own = base.copy()
        for at in rng.choice(100, int(rng.integers(0, 3 if i < 90 else 9)), replace=False):
            own[at] = f"y{rng.integers(60)}"
        rows.append((int(rng.integers(1, 10**6)) * 1000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_groups(rows, 3, 85, 100).items()}
    assert 1 < len(set(want.values())) < 100
    for blocks in ({}, {"list_rows": 30, "block_rows": 30}, {"list_rows": 7, "block_rows": 4}):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85, 100, **blocks).collect()}
        assert got == want


def test_texts_are_read_twice_however_often_candidates_are_dealt(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    base, rows = list(rng.choice(words, 100)), []
    for i in range(150):  # blocks leave a rest, which is dealt again
        own = base.copy()
        for at in rng.choice(100, int(rng.integers(0, 9)), replace=False):
            own[at] = f"y{rng.integers(60)}"
        rows.append((i, " ".join(own)))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85, 100, list_rows=30, block_rows=30).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 85, 100).items()}
    assert read.value == 2 * len(rows)  # for signatures, and for the texts of candidates


def test_lists_are_merged_as_all_pairs_would_be():
    rng = np.random.default_rng(13)
    for threshold in (1, 5, 12):
        sig = rng.integers(0, 4, (60, 12)).astype(np.uint16)
        sig[30:] = sig[rng.integers(0, 30, 30)]
        sig[45:, ::3] = 9
        label, side = np.arange(60), rng.integers(0, 2, 60)
        for s in (np.full(60, 2), side):
            pairs = [(i, j) for i in range(60) for j in range(i) if (sig[i] == sig[j]).sum() >= threshold and (s[i] == 2 or s[i] != s[j])]
            want = links.local_labels(60, *np.array(pairs or np.zeros((0, 2), int)).T)
            assert np.array_equal(links.local_labels(60, *minhash.linked_inside(label, s, minhash.merging_lists(sig, threshold))), want)


def test_rows_that_share_an_id(spark):
    a, b, c = ("unrelated words of the first text here", "quite another text it is with own words", "and a third one that nobody else has at all")
    rows = [(5, b), (9, a), (9, b), (12, a), (20, c), (20, ""), (30, c), (40, ""), (40, " "), (41, None), (9, b), (50, "new " + a + " x y"), (50, "new " + a + " x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85, 100).collect())
    assert {(i, c) for i, _, c, _ in got} == {(5, 5), (9, 5), (12, 5), (20, 20), (30, 20), (40, 40), (41, 41), (50, 50)} and len(got) == len(rows)
    assert all(k == (i == c) for i, _, c, k in got)
    kept = minhash.keep_one_of_each(df, k=3, num=85, den=100)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "").strip()) for r in kept.collect()) == sorted([(5, b), (9, a), (20, c), (20, ""), (40, ""), (41, ""), (50, "new " + a + " x y")])


def test_shared_ids_by_brute_force(spark):
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(200)]
    bases = [list(rng.choice(words, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        own = bases[int(rng.integers(12))].copy()
        own[int(rng.integers(60))] = f"z{rng.integers(5)}"
        rows.append((int(rng.integers(0, 90)), " ".join(own)))
    texts = brute_groups([(n, t) for n, (_, t) in enumerate(rows)], 3, 85, 100)
    both = [(i, 1000 + texts[n][1]) for n, (i, _) in enumerate(rows)]  # bipartite: ids and groups of texts
    a, b = np.array([x for x, _ in both]), np.array([y for _, y in both])
    label = links.local_labels(1200, a, b)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == {(i, int(label[i])) for i, _ in rows}
    kept = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85, den=100).collect()
    low = {}
    for n, (i, _) in enumerate(rows):
        low[texts[n][1]] = min(i, low.get(texts[n][1], i))
    of = {(i, t): texts[n][1] for n, (i, t) in enumerate(rows)}
    assert sorted((of[r.doc_id, r.text], r.doc_id) for r in kept) == sorted(low.items())


def test_near_duplicates_of_odd_documents(odd, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 3, 85, 100).collect())
    by = {g[0]: g for g in got}
    assert by[2][2:] == (1, False) and by[1][2:] == (1, True)
    assert by[3] == (3, 0, 3, True) and by[4][1] == by[5][1] == 0 and by[6] == (6, 1, 6, True)
    assert by[-1][2:] == (None, True) and [g for g in got if g[0] == 9] == [by[9]] * 2
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one_of_each(odd, k=3, num=85, den=100)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.keep_one_of_each(empty).count() == 0


def test_signature_estimates_similarity():
    a, b = "a b c d e f g h i j k l m n o p".split(), "a b c d e f g h i j k l m n o q".split()
    flat, offsets = minhash.shingle_sets(next(arrowtext.runs(pa.array([" ".join(a), " ".join(b)])))[2], 3)
    s = minhash.signatures(flat, offsets, 512)
    assert abs((s[0] == s[1]).mean() - 13 / 15) < 0.06
    assert minhash.match_threshold(64, 0.85, 1e-7) == 37 and minhash.prefix_length(0.85, 1e-6) == 8


def test_components_reach_the_smallest_node(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in (100, 101, 102)}}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2


def test_record_files_match_the_library(spark, sf, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    start, want = 0, []
    for i, text, _ in sorted(documents, key=lambda d: d[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in QUERIES["op2_token_records"](spark, sf).orderBy("start").collect()]
    assert got == want


def test_units_never_change_ids():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    bits = ["a", "B", "é", " ", "\n", ".", ",", "'s", "'", "  ", "\t", "\u00a0", "\u3000", "1", "<|endoftext|>", "…", "\x1c", "×", "\r\n", "日"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 50))) for _ in range(1500)] + [x[1] or "" for x in ODD if x[1] != LONG]
    for i, j, run in arrowtext.runs(pa.array(texts), limit=5000):
        ids, counts = records.encode_texts(run, path)
        assert np.split(ids, np.cumsum(counts)[:-1]) and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in t.encode_batch(texts[i:j], add_special_tokens=False)]


def test_special_strings_as_the_plain_library_call(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "hello  <|endoftext|>  world\n<|endoftext|>", "<|endoftext|>", "<|endoftext>", "no such", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in records.encode_and_read_back(spark, df, tokenizer_file("byte_bpe_50k.json")).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert got[0][0] == 4


def test_each_file_has_a_reading_task(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text")).repartition(6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        manifest = records.write_ids(df, f"file://{tmp_path}/ids", tokenizer_file("byte_bpe_50k.json"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = manifest.count()
    rows = records.read_ids(manifest, f"file://{tmp_path}/ids").withColumn("task", F.spark_partition_id())
    assert files > 3 and rows.select("task").distinct().count() > files // 2 and rows.count() == 400


def test_records_in_any_order_and_damage(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = records.write_ids(odd, folder, tokenizer_file("byte_bpe_50k.json"), width=4)
    rows = [r for r in records.read_ids(manifest, folder).orderBy("start").collect()]
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9] and rows[3].n_tokens == 1
    assert [r.start for r in rows[1:]] == np.cumsum([r.n_tokens for r in rows])[:-1].tolist()
    store = fs.LocalFileSystem()
    file = manifest.orderBy("part").first()
    path = f"{tmp_path}/ids/{file.file}"
    offsets = records.read_offsets(store, f"{path}.idx")
    whole = list(records.read_file(store, f"{path}.rec"))
    for k in reversed(range(len(offsets))):
        doc, ids = records.read_record(store, f"{path}.rec", int(offsets[k]))
        assert doc == whole[k][0] and np.array_equal(ids, whole[k][1])
    data = bytearray(open(f"{path}.rec", "rb").read())
    data[-6] ^= 1
    open(f"{path}.rec", "wb").write(data)
    with pytest.raises(ValueError):
        list(records.read_file(store, f"{path}.rec"))
    assert records.encode_and_read_back(spark, empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


# 3


def test_records_order_ties_and_check_widths(spark, tmp_path):
    df = spark.createDataFrame([(5, f"text {i % 4}") for i in range(12)] + [(None, "b"), (None, "a"), (4, None)], "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    got = [sorted((r.start, r.doc_id or -1, r.ids_crc32) for r in records.encode_and_read_back(spark, x, path).collect()) for x in (df, df.repartition(7), df.orderBy(F.desc("text")).coalesce(1))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15
    for width, end in ((2, 70_000), (1, 0)):
        with pytest.raises(ValueError, match="do not hold"):
            records.write_ids(df, f"file://{tmp_path}/x", path, width=width, end_id=end)
    assert records.write_ids(df, f"file://{tmp_path}/y", path, file_bytes=8).count() > 4


def test_records_take_other_tokenizers_whole():
    """A tokenizer with a normalizer and word ends isn't cut into units."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    texts = ["Some TEXT here", "", "and  more\n\nof it's <|endoftext|> x", "é à"]
    ids, counts = records.encode_texts(next(arrowtext.runs(pa.array(texts)))[2], path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_mix_of_odd_documents_and_reruns(odd, empty):
    def run():
        return sorted((r.doc_id or -1, r.source or "~", r.mix.size, r.mix.source_size, r.mix.taken) for r in mixing.mix_sources(odd).collect())

    got = run()
    assert got == run() and len(got) == len(ODD)
    assert all(taken <= 3 * size and (size == 0 or taken % size == 0) for _, _, size, _, taken in got)
    rows = mixing.mix_sources(odd).select("mix.*").collect()
    assert all(r.taken == r.size * (r.epochs + r.drawn) and (r.size or not r.drawn and not r.epochs) for r in rows)
    assert mixing.mix_sources(odd).columns == [*(c for c in odd.columns if c != "mix"), "mix"]
    assert mixing.mix_sources(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), f"s{min(i % 12, 5)}") for i in range(4000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), buckets=64)
    per = out.groupBy("source").agg(F.first("mix.target").alias("target"), F.sum("mix.taken").alias("taken"), F.first("mix.source_size").alias("size")).collect()
    assert all(abs(r.target - r.taken) <= 30 and r.target <= 3 * r.size + 1e-6 for r in per)
    assert abs(sum(r.target for r in per) - sum(r["size"] for r in per)) < 1e-3


def test_mix_draws_nothing_from_empty_texts_and_ties_one_by_one(spark):
    rows = [(i, None if i % 2 else "", "empty") for i in range(20)] + [(i, "a b c", "small") for i in range(30)]
    rows += [(7, "one row that repeats very often", "alike")] * 200 + [(8, "x y", "alike")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "mix.*").collect()
    assert not any(r.drawn or r.epochs or r.taken for r in out if r.source == "empty")
    alike = [r for r in out if r.source == "alike" and r.size == 6]
    assert len(out) == len(rows) and 0 < sum(r.drawn for r in alike) < 200 and abs(sum(r.taken for r in out if r.source == "alike") - alike[0].target) <= 6


def test_mix_cuts_evenly_for_any_quality(spark):
    rng = np.random.default_rng(15)
    rows = [(i, " ".join("x" * int(rng.integers(300, 900)) for _ in range(3)), "unbroken") for i in range(3000)]
    rows += [(10_000 + i, "usual words of a text like this", "plain") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budgets in ((1, 9), (1, 1)):
        out = mixing.mix_sources(df, weights=budgets)
        per = {r.source: r for r in out.groupBy("source").agg(F.first("mix.target").alias("target"), F.sum("mix.taken").alias("taken")).collect()}
        assert all(abs(r.target - r.taken) <= 7 for r in per.values())
    key = -F.log((F.monotonically_increasing_id() + F.rand(1)) % 1) / 0.01  # the lowest quality: no bucket holds much
    buckets = spark.range(50_000).select(F.floor(F.log2(key) * 1024).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 50_000 * 0.002


def test_mix_keeps_columns_of_any_name(spark):
    names = ["__size", "__key", "__mix_size", "__MIX", "__source", "bucket", "rest"]
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", None), (None, "d", "s"), (None, "e f", "s")], "doc_id long, text string, source string")
    for c in names:
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = mixing.mix_sources(df)
    assert out.columns == [*df.columns, "mix"] and all(r[c] == f"own {c}" for r in out.collect() for c in names)


# 4


def check_shards(rows, shards):
    sizes, slots, group = Counter(), {}, {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert group.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) <= set(range(shards))
    return sizes


def test_shards_are_even_whole_and_gapless(spark, sf, documents):
    rows = QUERIES["op4_sharding"](spark, sf).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in documents)
    sizes = check_shards(rows, 40)
    groups = Counter()
    for r in rows:
        groups[r.text_crc32] += r.size
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + max(groups.values())


def test_smallest_capacity_is_smallest():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes, k = rng.integers(1, 40, rng.integers(1, 30)).tolist(), int(rng.integers(1, 8))
        c = sharding.smallest_capacity(sizes, k)
        assert sharding.shards_needed(sizes, c) <= k
        assert c == max(sizes) or sharding.shards_needed(sizes, c - 1) > k
    alone, cuts = sharding.partition({0: 5, 1: 1000, 2: 5, 3: 5, 4: 5}, 5)
    assert alone == [1] and cuts == [2, 3, 4]
    assert sharding.partition({}, 4) == ([], [])


def test_shards_of_odd_documents(spark, odd, empty):
    assert sum(check_shards(sharding.shard_documents(odd, 3).collect(), 3).values()) > 0
    assert sharding.shard_documents(empty, 3).count() == 0
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    sizes = check_shards(sharding.shard_documents(hot, 8).collect(), 8)
    assert sizes[0] == 600 * 20 and max(v for k, v in sizes.items() if k) <= 1.1 * sum(v for k, v in sizes.items() if k) / 7


# 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First   <b>bold</b>
line<br>on</p><p>Ok.<div class="share">Share</div><aside>Side</aside><p>Last &#233;&nbsp;x</article>
<section id="comments"><article class="comment"><p>Reader says</p></article></section><form><p>Send</p></form><footer>(c)</footer></body></html>"""


def test_main_text_leaves_the_frame_out():
    assert html_text.main_text(PAGE) == "Head & more\nFirst bold line on\nOk.\nLast é x"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<article><p>a <i>b</article") == "a b"
    long = "<p>" + "long words of a text that goes on and on, as an article does " * 20 + "</p>"
    assert html_text.main_text(f"<body><div><a>x</a> <a>y</a></div><div>{long}<p>Short.</p></div></body>").endswith("\nShort.")


def test_article_only_votes_on_regions():
    body = "".join(f"<p>{i} long words of a text that goes on and on, as the body of a page does, line by line.</p>" for i in range(6))
    teaser = "<article><h3>Read too</h3><p>A card.</p></article>"
    for page in (f"<body><div>{body}</div>{teaser}</body>", f"<body>{teaser}<div><section>{body}</section></div></body>"):
        assert len([x for x in html_text.main_text(page).split("\n") if "long words" in x]) == 6
    assert html_text.main_text(f"<body><div>Short line</div><article>{body}<p>End.</p></article></body>").endswith("\nEnd.")
    assert "Short line" not in html_text.main_text(f"<body><div>Short line</div><article>{body}</article></body>")
    two = html_text.main_text(f"<body><article>{body}</article><article>{body}</article></body>")  # none holds most, both together do
    assert two.count("long words") == 12


def test_names_alone_leave_no_body_out():
    body = "".join(f"<p>{i} long words of a text that goes on and on, as the body of a page does, line by line.</p>" for i in range(6))
    want = html_text.main_text(f"<body><article>{body}</article></body>")
    for name in ("post no-sidebar", "sidebar", "comment-open", "social-share-on", "has-related"):
        assert html_text.main_text(f"<body><article class='{name}'>{body}</article></body>") == want
        assert html_text.main_text(f"<body><div id=page class='{name}'><div>{body}</div></div></body>") == want
        assert html_text.main_text(f"<body><article>One.</article><div class='{name}'><main>{body}</main></div></body>").endswith(want)
    beside = "<p class=ad>Buy<ul><li class='notice'>Notice <b>bold</b><li class='share'>Share</ul><h2 class=sponsored>Paid</h2><div class='cookie-banner'>Cookies</div><p hidden>Hid</p><p class=advert>Open advert"
    assert html_text.main_text(f"<body><article>{beside}{body}</article></body>") == want
    line = "<p>Words <span class=advert>buy <span>this</span> now</span>go on.</p>"
    assert html_text.main_text(f"<body><article>{line}{body}</article></body>") == "Words go on.\n" + want
    assert html_text.main_text("<body><article><p>Words <span class=ad>x</p><p>on.</p></article></body>") == "Words\non."
    comments = f"<section class=comments>{body}</section>"
    assert html_text.main_text(f"<body><article>{body}</article>{comments}{comments}</body>") == want
    assert html_text.main_text(f"<body><article></article><div class=ad>{'long ' * 50}</div></body>") == ""


def test_pages_give_their_articles(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html_text"](spark, sf).collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if x)
        assert r.n_chars == len(r.text)


def test_pages_judge_doubtful_names_by_figures():
    body = "".join(f"<p>The {w} paragraph of this article has a good many words in it, as such paragraphs do.</p>" for w in ("first", "second", "third", "fourth", "fifth"))
    want = html_text.main_text(f"<body><article>{body}</article></body>")
    for beside in (
        "<div class='user-comments'><p>A reader wrote these many words about the article above, and meant all of them.</p></div>",
        "<div class='ad-300x250'><p>Buy these many fine things now, as all who bought them wanted more of them.</p></div>",
        "<div id='my-related-reads'><a href=x>Another long headline of a story</a> <a href=y>And one more headline</a></div>",
    ):
        assert html_text.main_text(f"<body><article>{body}{beside}</article></body>") == want
    inner = f"<div class='comment-analysis'>{body}</div>"
    assert html_text.main_text(f"<body><article>{inner}<p>And the end of it all has its own many words, as it should.</p></article></body>").startswith(want)
    assert html_text.main_text(f"<body><article>{body}<div class='no-ads'><p>Not left out, as this has no adverts but a lot of words.</p></div></article></body>").startswith(want + "\nNot left out")
    assert html_text.main_text(f"<body><article class='user-comments'>{body}</article></body>") == want


def test_pages_with_many_named_elements_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        page = "<body><article>" + "".join(f"<p>Paragraph {i} has some words.</p><div class=ad>Buy it.</div>" for i in range(n)) + "</article></body>"
        began = time.process_time()
        assert html_text.main_text(page).count("\n") == n - 1
        took.append(time.process_time() - began)
    nested = "<body><article><p>Words here.</p>" + "<div class=ad>x" * 4000 + "</article></body>"
    assert html_text.main_text(nested) == "Words here."
    assert took[1] < 8 * max(took[0], 0.05)


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "old"), (None, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract_text(df).collect()) == [(0, ""), (1, "x")]
    assert html_text.extract_text(df.filter("false")).count() == 0


# 6


def test_fixed_rules_by_brute_force(spark, sf):
    for r in QUERIES["op6_url_filter"](spark, sf).collect():
        best = max(((len(h + p), v, h + p) for v, h, p in URL_RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)), default=None)
        assert r.rule == (best and best[2]) and (best is None or r.verdict == best[1])


def test_mined_rules_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"http://{rng.choice(['a', 'b'])}.{rng.choice(['x.com', 'y.org'])}/{rng.choice(['en', 'de'])}/{i}?{rng.choice(['p=1', 'q=2'])}",) for i in range(400)]
    df = spark.createDataFrame([(u, "x.com/de" in u and rng.random() < 0.9) for (u,) in rows], "url string, bad boolean")
    rules = url_rules.mine_rules(df, 0.05, 0.6)
    tokens = {r.url: set(r.t) for r in df.select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    bad = {r.url: r.bad for r in df.collect()}
    mined = rules.collect()
    assert mined
    for r in mined:
        holds = [u for u, t in tokens.items() if set(r.tokens) <= t]
        assert sum(bad[u] for u in holds) / len(holds) == pytest.approx(r.confidence) and r.confidence >= 0.6
    want = {u for u, t in tokens.items() if any(set(r.tokens) <= t for r in mined)}
    assert {r.url for r in url_rules.matched_urls(df.select("url"), rules).collect()} == want


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://User.Example.COM:80/en/7x?a#b", "x://net", "http://a.org/es/", "http://borg/es/", "a://b://c/en/", "http://x.com?/en/", "http://é.ÀB.com/en/\nz"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    none = df.select("url", F.lit(True).alias("bad")).filter("false")
    got = {r.page_id: r for r in url_rules.judge_urls(df, none, URL_RULES).collect()}
    assert [got[i].host for i in range(len(urls))] == ["", "", "", "user.example.com:80", "net", "a.org", "borg", "b:", "x.com", "é.ÀB.com".replace("B", "b")]
    assert (got[5].rule, got[5].verdict, got[6].rule, got[0].verdict) == ("org/es/", "block", None, "allow")
    assert url_rules.judge_urls(df.filter("false"), none, URL_RULES).count() == 0


def test_labels_are_those_of_the_document_in_the_url(spark, tmp_path):
    ends = ["http://x.com/en/7817", "x://x/7.html?a=9", "http://x/en/8/#9", "http://x/1/en", "http://x.com/", None, "7", "http://x/99999999999999999999"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ends)], "i int, url string").select("i", url_rules.document_of(F.col("url")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == [7817, 7, 8, None, None, None, None, None]
    pages = [(1000 + i, f"http://{'bad' if i % 4 == 1 else 'good'}.site/x/{i}{'.html' if i % 3 else ''}", "") for i in range(120)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, int(i % 4 != 1), 0) for i in range(120)] + [(1000 + i, int(i % 4 == 1), 0) for i in range(120)]  # the page ids are other documents
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()
    assert len(got) == 120 and all(r.verdict == ("block" if r.host == "bad.site" else "allow") for r in got)


def test_a_rules_support_is_a_count_and_its_confidence_a_lift(spark):
    def mined(rows):
        df = spark.createDataFrame(rows, "url string, bad boolean")
        return {tuple(r.tokens) for r in url_rules.mine_rules(df).collect()}

    clean = [(f"http://h{i % 50}.c{i % 50}/{i}", False) for i in range(11_700)]
    odd = [(f"http://odd.site/{i}", i < 40) for i in range(100)]  # 0.3% of the pages; 40 of 100 are bad, of all 2 in 100
    rest = [(f"http://h{i % 50}.c{i % 50}/x{i}", True) for i in range(200)]
    assert ("host=odd.site",) in mined(clean + odd + rest)
    even = [(f"http://{'ab'[i % 2]}.site/{i}", i % 4 < 2) for i in range(400)]  # one half of everything is bad, on both hosts
    assert not mined(even)
    few = [(f"http://odd.site/{i}", True) for i in range(19)]
    assert not mined(clean + rest + few) and not mined(few) and mined(clean[:300] + few + [("http://odd.site/x", True)])
    assert not mined([(u, False) for u, _ in even])


# 7


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def test_pieces_match_the_library(spark, sf, documents, model):
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, sf).collect()}
    for i, text, _ in documents:
        assert list(got[i].ids) == model.encode(text or "") and got[i].decodes and got[i].n_pieces == len(got[i].ids)


def test_pieces_of_odd_texts(odd, empty, model):
    path = tokenizer_file("piece_bpe_32k.model")
    rng = np.random.default_rng(9)
    bits = ["a", "th", "é", " ", "   ", "\n", ".", "▁", "日本", "🙂", "ing", "\x00"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(600)] + [" " * n for n in range(70)] + ["a" * n for n in range(40)]
    for i, j, run in arrowtext.runs(pieces.marked(pa.array(texts)), limit=3000):
        ids, at = pieces.encode_marked(run, path)
        for k in range(j - i):
            own = ids[at[k] : at[k + 1]].tolist()
            assert own == model.encode(texts[i + k])
            assert pieces.decode(own, path) == model.decode(own)
    got = pieces.encode_documents(odd, path).collect()
    assert len(got) == len(ODD) and all(r.decodes for r in got) and {r.n_pieces for r in got if r.doc_id in (3, 4)} == {0}
    assert pieces.encode_documents(empty, path).count() == 0
    assert pieces.decode([3 + 0xFF, 3 + 0x41], path) == "\ufffdA"


def test_unigram_words_have_the_best_sum():
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -5.0, "bab": -6.0, "▁ab": -6.9}
    v = pieces.Vocabulary.of(scores, "unigram")

    def best(word):
        top = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            top[end] = max((top[s][0] + scores.get(word[s:end], -1e9), [*top[s][1], word[s:end]]) for s in range(end))
        return top[len(word)][0]

    words = ["▁ab", "▁aba", "▁abab", "▁ba", "▁bbb", "▁aaabbab"]
    for word, ids in zip(words, v.words(words)):
        assert "".join(v.pieces[i] for i in ids) == word and sum(scores[v.pieces[i]] for i in ids) == pytest.approx(best(word))


# 8


def test_chats_come_back_as_they_went_in(spark):
    said = ["\\", "\\\\e", "</turn>\n", "### x:\n", "\\e\\h\\c", "</turn", "", None, "a\n### assistant:\nb</turn>\n", "é🙂"]
    turns = [(c, t, ["user", "assistant", "sys:tem", None][(c + t) % 4], said[(c * 3 + t) % len(said)]) for c in range(12) for t in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("clash")).withColumn("turns", F.lit(1))
    out = chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("segments")).alias("l")).collect()
    for r in out:
        own = [(role or "", text or "") for c, _, role, text in turns if c == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == own and r.l == "".join(t for role, t in own if role == "assistant")
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_chat_states(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, None, "system", "s"), (3, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.state, r.valid) for r in chat.format_conversations(df).collect()}
    assert got == {1: ("answered", True), 2: ("error", False), 3: ("error", False)}


def test_own_conversation(spark, sf):
    r = QUERIES["op8_chat"](spark, sf).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(said)) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# 9


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures_of_odd_and_given_documents(spark, sf, documents, odd, empty):
    rows = spark.createDataFrame([(n, x[1], x[2]) for n, x in enumerate([*documents, *ODD])], "doc_id long, text string, source string")
    texts = [x[1] for x in [*documents, *ODD]]
    for r in judge_documents(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert judge_documents(empty).count() == keep_documents(empty).count() == 0
    assert judge_documents(odd).count() == len(ODD)


def test_hosts_decide_on_documents_with_symbols(spark, sf):
    """What the base rule lets pass and the host doesn't, on the given table; with a host verdict that allows everything there is none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    undone = lambda limit, symbols: judge_documents(docs, limit, symbols).filter("NOT base_failed AND NOT kept").count()
    assert undone(0.5, 0.5) > 0 and undone(1e9, 1e9) == 0 and undone(0.5, 0.5) > undone(1e9, 0.5)


def test_symbols_are_allowed_by_the_rate_of_the_host(spark):
    good, bad = "these are ten words of which none stands here twice indeed", "too short"
    some = "# # # these are ten words of which none stands here twice indeed *"  # 4 symbols in 15 words
    rows = [(i, bad if i % 5 == 0 else good, "clean" if i < 400 and i % 5 else "middling") for i in range(800)]
    rows += [(1000, some, "clean"), (1001, some, "middling"), (1002, some, None), (1003, some.replace(" ", " #"), "clean"), (1004, some, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__symbols", F.lit(1)).withColumn("symbols", F.lit(2)).withColumn("of_host", F.lit(3))
    kept = {r.doc_id for r in judge_documents(df, max_symbols=0.5).filter("kept").collect()}
    assert {i for i in kept if i >= 1000} == {1000, 1002, 1004}
    out = keep_documents(df, max_symbols=0.5)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept


def test_hosts_that_differ_by_chance_have_one_rate(spark):
    from cirrostrat.llm.host_rules import host_rates

    rng = np.random.default_rng(16)
    rows = [(f"h{i % 40}", bool(rng.random() < 0.1)) for i in range(4000)]
    rates = [r.rate for r in host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()]
    assert max(rates) - min(rates) < 0.05
    odd = rows + [("odd", i % 2 == 0) for i in range(100)]
    rates = {r.host: r.rate for r in host_rates(spark.createDataFrame(odd, "host string, base_failed boolean")).collect()}
    assert rates["odd"] > 0.35 and max(v for k, v in rates.items() if k != "odd") < 0.25


def test_bad_hosts_go_with_all_their_documents(spark):
    good, bad = "these are ten words of which none stands here twice indeed", "too short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(200 + i, good if i % 20 else bad, f"h{i % 5}") for i in range(500)] + [(999, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in judge_documents(df).filter("kept").collect()}
    assert kept == {i for i, t, s in rows if t == good and s != "bad"}
    out = keep_documents(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept


# 10


def brute_nearest(rows, asks, most):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if asks(i):
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in set((j, tuple(w)) for j, w in good) if j != i and len(w) == len(v) for w in [np.array(w)])
            out[i] = [j for _, j in near[:most]]
    return out


def test_neighbours_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows, lambda i: i % 50 == 0, 5), {}
    for r in QUERIES["op10_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_rank_and_score_are_exact(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    by = {}
    for r in QUERIES["op10_neighbours"](spark, sf).collect():
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for found in by.values():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(150, 64))
    rows = [(i, (centres[rng.integers(150)] + 0.45 * rng.normal(size=64)).tolist()) for i in range(3000)]
    df, want, got = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), brute_nearest(rows, lambda i: i % 50 == 0, 5), {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, tables=4, probes=50).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * sum(map(len, want.values()))
    assert neighbours.looked_at(df, F.col("vec_id") % 50 == 0, tables=4, probes=50) < 0.1


def test_odd_vectors_and_ties(spark):
    base = np.random.default_rng(10).normal(size=(6, 5)).tolist()
    rows = [(i, base[0]) for i in range(12)] + [(20 + i, b) for i, b in enumerate(base)] + [(20, base[0]), (30, None), (31, []), (32, [0.0] * 5), (33, [1.0, None, 1.0, 1.0, 1.0]), (34, [float("nan")] * 5), (35, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, base[1]), (40, [1.0, 2.0]), (44, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("ids", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 4 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[4] == [0, 1, 2, 3, 5] and got[40] == [44] and got[20] == [0, 1, 2, 3, 4]
    assert got.keys() == {0, 4, 8, 20, 24, 40, 44} and len(got[24]) == 5
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") % 4 == 0).count() == 0


def test_few_vectors_are_all_found(spark):
    """Small tables at the query's own parameters, opposite vectors included: a query gets all rows there are, up to five."""
    draw = np.random.default_rng(23)
    tables = []
    for n in range(2, 13):
        vectors = draw.normal(size=(n, 64))
        vectors[n // 2] = -vectors[0]
        tables.append([(i, v.tolist()) for i, v in enumerate(vectors)])
    tables.append([(0, [0.0] * 63 + [1.0]), (1, [0.0] * 63 + [-1.0]), (2, [0.01] + [0.0] * 62 + [-1.0]), (3, draw.normal(size=64).tolist())])
    for rows in (tables[0], tables[2], tables[5], tables[10], tables[11]):
        want, got = brute_nearest(rows, lambda i: i % 4 == 0, 5), {}
        for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {q: set(x) for q, x in got.items()} == {q: set(x) for q, x in want.items()} if len(rows) < 7 else {q: len(x) for q, x in got.items()} == {q: 5 for q in want}


def test_small_blocks_change_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = (sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 50 == 0, block=n).collect())) for n in (4096, 3))
    assert a == b


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 7))
    y = neighbours.axis_scores(x, 0)
    assert y.shape == (5, 16) and np.allclose((y[:, ::2] ** 2).sum(1), (x**2).sum(1)) and np.allclose(y[:, ::2], -y[:, 1::2])
