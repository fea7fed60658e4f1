"""Tokens of two tokenizers laid side by side: common ends by galloping, overlaps by ranks, and how often two ids overlap.

A text (with a space in front) is encoded by a byte-level tokenizer (A) and by a SentencePiece model (B). Both tokens' bytes end to end
give the text's bytes, or else the text has no tokens. The ends of the tokens are two ascending lists of byte offsets. The shorter one drives: each of
its ends looks for its place in the longer list, doubling its step from the place of an earlier end until it is passed, and then
halving the last step. Ends found in both lists cut the tokens into groups; the differences of neighbouring places are the ranges of the longer
list's tokens that a token of the shorter one overlaps: the links.

A pair of ids counts once for each document that holds it linked. Pairs that are frequent enough to be among the first `head` ones are sent
to all tasks (their number is bounded by that parameter); the counts of all others are joined to the documents that hold them. So no pair is a hot
key of the join, and every pair has its whole count.

Nulls: a null or empty text has no tokens, and neither has one that a tokenizer doesn't give back byte by byte; such rows have zeros and an empty
digest. Rows that repeat, or share an id, count one by one. Texts of any length are encoded whole. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import Texts, runs
from cirrostrat.llm.pieces import decode_marked, encode_marked, n_pieces, piece_sizes
from cirrostrat.llm.records import encode_texts, token_bytes, vocabulary_size
from cirrostrat.llm.units import ragged
from cirrostrat.runtime import small_batches, stash


def gallop(short: np.ndarray, long: np.ndarray, stride: int = 16) -> np.ndarray:
    """For each of `short` (ascending) the first place in `long` (ascending) with a value as large or larger. Every `stride`-th value is looked for from
    the place of the one `stride` before it, and those between from the place of the first of their block, all blocks in step."""
    if not len(short):
        return np.zeros(0, np.int64)
    n, ends = len(long), np.append(long, np.iinfo(np.int64).max)
    # The value at `low` is smaller than the one looked for, or `low` stands before the list.
    low = np.full(len(short), -1)
    if len(short) > stride:
        low = np.repeat(gallop(short[::stride], long, stride), stride)[: len(short)] - 1
    high, step = np.minimum(low + 1, n), 1
    while (more := ends[high] < short).any():
        step *= 2
        low, high = np.where(more, high, low), np.where(more, np.minimum(high + step, n), high)
    while step > 1:
        mid = (low + high + 1) >> 1
        smaller = ends[mid] < short
        low, high = np.where(smaller, mid, low), np.where(smaller, high, mid)
        step = (step + 1) // 2
    return high


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens of A and of B end with each group, and the links: numbers of tokens of A and of B that overlap. The lists end alike."""
    swap = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    place = gallop(short, long)
    common = long[place] == short
    first = np.concatenate(([0], (place + common)[:-1]))  # the token of the longer list that is open where a token of the shorter one begins
    n = place - first + 1
    links_short, links_long = np.repeat(np.arange(len(short)), n), ragged(np.arange(len(long)), first, n)
    groups = np.flatnonzero(common) + 1, place[common] + 1
    return (*groups[::-1], links_long, links_short) if swap else (*groups, links_short, links_long)


def _written(ids: list[int], more: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of `ids` as text, each with the first and then with the second separator behind it: bytes, starts and lengths; the second ones follow all first ones."""
    texts = [f"{i}{s}".encode() for s in more for i in ids]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length


class Writer:
    """Groups as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.n_b = n_a, n_b
        (flat_a, start_a, length_a), (flat_b, start_b, length_b) = _written(range(n_a), (",", "|")), _written(range(n_b), (",", ";"))
        self.flat, self.start, self.length = np.append(flat_a, flat_b), np.append(start_a, start_b + len(flat_a)), np.append(length_a, length_b)

    def text(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> bytes:
        """upto_a, upto_b: how many tokens there are up to the end of each group."""
        codes = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(u)), np.diff(u, prepend=0)) for u in (upto_a, upto_b))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[upto_a - 1] = last_b[upto_b - 1] = True
        before_b = np.concatenate(([0], upto_b[:-1]))
        codes[np.arange(len(a)) + before_b[group_a]] = a + self.n_a * last_a
        codes[np.arange(len(b)) + upto_a[group_b]] = b + 2 * self.n_a + self.n_b * last_b
        return ragged(self.flat, self.start[codes], self.length[codes]).tobytes()[:-1]


_writers: dict[tuple[int, int], Writer] = {}


def _aligner(bytes_file: str, pieces_file: str, n_a: int, n_b: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns of each document that need no other one, and its distinct pairs (A's id * n_b + B's id) with the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (n_a, n_b) not in _writers:
            _writers[n_a, n_b] = Writer(n_a, n_b)
        writer = _writers[n_a, n_b]
        for batch in batches:
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            spaced = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
            for i, j, t in runs(spaced):
                rows: list[list] = [[] for _ in range(7)]
                for one in _aligned(t, bytes_file, pieces_file, n_b, writer):
                    for column, value in zip(rows, one):
                        column.append(value)
                pairs, links = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(kind))) for x, kind in ((rows[5], np.int64), (rows[6], np.int32)))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, rows[:5], kinds), pairs, links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return run


def _marks_as_spaces(t: Texts) -> Texts:
    """The texts as SentencePiece marks them: its mark in a text is a space. Such texts come back otherwise, and have no tokens."""
    if not (mark := t.data == 0xE2).any() or b"\xe2\x96\x81" not in t.data.tobytes():
        return t
    at = np.flatnonzero(mark[:-2] & (t.data[1:-1] == 0x96) & (t.data[2:] == 0x81))
    data, keep = t.data.copy(), np.ones(len(t.data), bool)
    data[at] = 0x20
    keep[at + 1] = keep[at + 2] = False
    return Texts(data[keep], np.concatenate(([0], np.cumsum(keep)))[t.offsets])


def _aligned(t: Texts, bytes_file: str, pieces_file: str, n_b: int, writer: Writer) -> Iterator[tuple]:
    none = np.zeros(0, np.int64)
    ids_a, counts = encode_texts(t, bytes_file, plain=True)
    at_a = np.concatenate(([0], np.cumsum(counts)))
    ids_b, at_b = encode_marked(_marks_as_spaces(t), pieces_file, "library")
    flat, start, length = token_bytes(bytes_file)
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    size_a, size_b = length[ids_a], piece_sizes(ids_b, pieces_file, "library")
    data_a, data_b = ragged(flat, start[ids_a], size_a), decode_marked(ids_b, at_b, pieces_file, "library")[0]
    to_a, to_b = (np.concatenate(([0], np.cumsum(s))) for s in (size_a, size_b))
    for k in range(len(t.offsets) - 1):
        own = t.data[t.offsets[k] : t.offsets[k + 1]]
        a0, a1, b0, b1 = at_a[k], at_a[k + 1], at_b[k], at_b[k + 1]
        if not len(own) or not np.array_equal(own, data_a[to_a[a0] : to_a[a1]]) or not np.array_equal(own, data_b[to_b[b0] : to_b[b1]]):
            yield 0, 0, 0, 0, "", none, none
            continue
        a, b = ids_a[a0:a1], ids_b[b0:b1]
        upto_a, upto_b, link_a, link_b = align(to_a[a0 + 1 : a1 + 1] - to_a[a0], to_b[b0 + 1 : b1 + 1] - to_b[b0])
        pairs, links = np.unique(a[link_a] * n_b + b[link_b], return_counts=True)
        yield len(a), len(b), len(upto_a), len(link_a), hashlib.sha256(writer.text(a, b, upto_a, upto_b)).hexdigest(), pairs, links


def _head_of(counts: DataFrame, head: int) -> DataFrame:
    """The pairs with a count from which on there are `head` pairs at most. Counts are told apart by their logarithm, so few numbers reach the driver."""
    levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*").alias("pairs")).collect()
    total, least = 0, float("inf")
    for level, pairs in sorted(((r.level, r.pairs) for r in levels), reverse=True):
        total += pairs
        if total > head:
            break
        least = level
    return counts.withColumn("in_head", F.floor(F.log2("n") * 8) >= least)


def _looker(held: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the pairs of the head, and the other pairs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = held.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links").flatten().to_numpy().astype(np.int64)
            flat, offsets = pairs.flatten().to_numpy(), pairs.offsets.to_numpy().astype(np.int64) - pairs.offsets[0].as_py()
            place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[place] == flat
            per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
            rest = np.concatenate(([0], np.cumsum(~hit)))[offsets]
            others = pa.StructArray.from_arrays([pa.array(flat[~hit]), pa.array(links[~hit])], ["pair", "links"])
            columns = pa.array(per_row(links * hit * best[place])), pa.array(per_row(links * hit * counts[place])), pa.ListArray.from_arrays(pa.array(rest, pa.int32()), others)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *columns], ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "others"])

    return run


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) from aligned documents: how many of them hold each pair, and whether that is the highest count of A's id."""
    counts = stash(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.floor(F.col("pair") / n_b).alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))  # a row for each id of A
    return counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, bytes_file: str, pieces_file: str, *, head: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row."""
    small_batches(docs.sparkSession)
    spark, n_a, n_b = docs.sparkSession, vocabulary_size(bytes_file), n_pieces(pieces_file)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"
    aligned = stash(thin.mapInArrow(_aligner(bytes_file, pieces_file, n_a, n_b), schema).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counts = stash(_head_of(stash(pair_counts(aligned, n_b), "counts"), head), "counts")
    known = counts.filter("in_head").select("pair", "n", "best").toArrow().sort_by("pair")
    pair, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
    held = spark.sparkContext.broadcast((pair, n, best.astype(np.int64)) if len(pair) else (np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64)))
    looked = aligned.mapInArrow(_looker(held), "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, others array<struct<pair:long,links:long>>")
    looked = stash(looked, "looked")
    rest = looked.select("uid", F.inline("others")).join(counts.filter("NOT in_head"), "pair")
    sums = rest.groupBy("uid").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return looked.join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
