"""Repeated passages: maximal repeats of `need` bytes or more, with all their occurrences, from a sparse enhanced suffix array.

1. Equal texts are one class; a text with a copy is repeated as a whole.
2. Every string of `need` bytes has an anchor: the leftmost smallest hash among its `gram`-byte grams. Equal strings have it at the same place,
   so suffixes from anchors are enough (about one in 70 bytes), as far as a string with this anchor can reach: `need` bytes to the right and
   `need - gram` to the left, the anchor's context. Anchors whose gram occurs once go at once; equal contexts are one class.
3. The contexts of one gram meet, sorted by their right sides: a suffix array. The common prefixes of neighbours are stack-scanned for
   intervals, the nodes of the common-prefix interval tree, and each node is tested for left-extension diversity: its left sides are sorted
   and their common parts scanned in the same way. A group of rows that share l bytes to the right (and differ behind, so that it is in no
   child of the node) and m to the left (and differ before) is a maximal repeat of m + l bytes with all its occurrences.
4. What is covered at an anchor is the union over its groups, which all contain it: one span. Spans of a text are merged.

A gram with more than `block` contexts is cut by the places where a string may begin, in halves: the contexts of a part share all bytes that its
strings have in common. Inside a part, contexts that agree as far as its strings reach are covered by one another, and only one of
them meets the rest. So no task holds more than `block` contexts of a gram, and no pair is lost.

Nulls: a null text is an empty one; a null id stays null. Texts under `need` bytes repeat nothing. Repeated rows are copies of one another. Bytes
are judged on the input, and cut where they stand, inside of characters too. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import Texts, mix, runs, whole_groups
from cirrostrat.llm.units import ragged
from cirrostrat.runtime import drop_stash, small_batches, stash


def anchors_of(t: Texts, need: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of some texts laid end to end, the index of each one's text, and how many bytes before it the first and
    the last string (two rows) begin whose anchor it is."""
    n, width = len(t.data), need - gram + 1
    valid = np.zeros(n + 1, bool)
    for a, b in zip(t.offsets[:-1], t.offsets[1:]):
        valid[a : max(a, b - need + 1)] = True
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    hashes = t.grams(gram)
    # The place is in the low half, so that the smallest is the leftmost of equal hashes.
    ranked = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max)
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.flatnonzero(valid)
    place = (np.minimum(behind[at], ahead[at + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    reach = np.stack((place[first] - at[first], place[first] - at[np.append(first[1:], len(at)) - 1]))
    place = place[first]
    return place, hashes[place], np.searchsorted(t.offsets, place, "right") - 1, reach


def _anchorer(need: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "single"))
            for i, j, t in runs(batch.column("text")):
                place, key, text, (far, near) = anchors_of(t, need, gram)
                left = np.minimum(need - gram, place - t.offsets[text])
                right = np.minimum(need, t.offsets[text + 1] - place)
                context = mix(t.span_hash(place - left, place + right) ^ mix(left.astype(np.uint64) + np.uint64(1)))
                columns = uid[i:j][text], place - t.offsets[text], left, right, far, near, single[i:j][text], key.view(np.int64), context.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["uid", "at", "left", "right", "far", "near", "single", "key", "context"])

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes on both sides of the wanted anchors: backwards to the left, forwards to the right."""
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            table = pa.RecordBatch.from_struct_array(wanted.values)
            for part in (table.slice(i, 8192) for i in range(0, table.num_rows, 8192)):
                at, left, right = (part.column(c).to_numpy().astype(np.int64) for c in ("at", "left", "right"))
                before = ragged(data[::-1], len(data) - at, left)
                after = ragged(data, at, right)
                sides = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.py_buffer(x)]) for n, x in ((left, before), (right, after))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "context", "far", "near")), *sides], ["key", "context", "far", "near", "before", "after"])


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The nodes of the interval tree: (value, first, last) for rows first to last of which neighbours have `value` in common at least,
    and some no more; a wider interval has less. common[i] is what rows i and i + 1 share."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of bytes, filled up with zeros, and their lengths."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    length = np.diff(at).astype(np.int64)
    width = -(-width // 8) * 8
    out = np.zeros((len(length), width), np.uint8)
    if at[-1] > at[0]:
        out[np.arange(width) < length[:, None]] = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return out, length


def _shared(rows: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bytes rows a[i] and b[i] have in common."""
    differ = rows[a] != rows[b]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(length[a], length[b]))


def maximal_groups(common: np.ndarray, rank: np.ndarray, left: Callable[[np.ndarray, np.ndarray], np.ndarray], most_left: int, need: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, m, l) of each maximal repeat: its rows, in the order of their right sides, share m bytes to the left and l to the right, and no more.
    rank: the order of left sides; most_left: no two rows share more to the left."""
    for l, first, last in intervals(common.tolist()):
        if l + most_left < need:
            continue
        by = np.argsort(rank[first : last + 1]) + first
        shared = left(by[:-1], by[1:])
        if shared.max() + l < need:
            continue
        child = np.concatenate(([0], np.cumsum(common[first:last] == l)))
        for m, a, b in intervals(shared.tolist()):
            if m + l >= need:
                rows = by[a : b + 1]
                inside = child[rows - first]
                if (inside != inside[0]).any():
                    yield rows, m, l


def _scanner(need: int, gram: int, groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From contexts sorted by g and right side: what is covered on both sides of each, or the members of each maximal repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            n, g = table.num_rows, table.column("g").to_numpy()
            if n < 2:
                continue
            lefts, left_length = _matrix(table.column("before").combine_chunks(), need - gram)
            rights, right_length = _matrix(table.column("after").combine_chunks(), need)
            common = _shared(rights, right_length, np.arange(n - 1), np.arange(1, n))
            words = lefts.view(">u8").astype(np.uint64)
            order = np.lexsort((left_length, *words.T[::-1], g))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            bounds = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [n]))
            beside = np.append(_shared(lefts, left_length, order[:-1], order[1:]), 0)
            beside[bounds[1:] - 1] = 0
            most_left = np.maximum.reduceat(beside, bounds[:-1])
            most_right = np.append(common, 0)
            most_right[bounds[1:] - 1] = 0
            maybe = most_left + np.maximum.reduceat(most_right, bounds[:-1]) >= need
            far, near = (table.column(c).to_numpy() for c in ("far", "near"))
            m_of, l_of, found = np.zeros(n, np.int32), np.zeros(n, np.int32), []
            for start, end, most in zip(bounds[:-1][maybe], bounds[1:][maybe], most_left[maybe]):
                left = lambda a, b, start=start: _shared(lefts, left_length, a + start, b + start)
                for rows, m, l in maximal_groups(common[start : end - 1], rank[start:end], left, most, need):
                    rows = rows + start
                    m_of[rows] = np.maximum(m_of[rows], m)
                    l_of[rows] = np.maximum(l_of[rows], l)
                    # A group is whole if the anchor is that of a string inside of the repeat: all occurrences have it then.
                    if groups and max(near[rows[0]], need - l) <= min(far[rows[0]], m):
                        found.append((rows, m, l))
            if groups:
                for i, (rows, m, l) in enumerate(found):
                    part = table.select(["g", "key", "context"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), m, np.int32)), pa.array(np.full(len(rows), l, np.int32)), pa.array(np.full(len(rows), i, np.int64))], ["g", "key", "context", "m", "l", "repeat"])
            elif (some := np.flatnonzero(m_of + l_of)).size:
                part = table.select(["key", "context"]).take(pa.array(some)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m_of[some]), pa.array(l_of[some])], ["key", "context", "m", "l"])

    return run


def _text_classes(docs: DataFrame, text_col: str) -> DataFrame:
    """(uid, sha, copies, n_bytes, text): each text once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    classes = docs.select(F.sha2(text, 256).alias("sha"), text.alias("text")).groupBy("sha").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    return stash(classes.select(F.monotonically_increasing_id().alias("uid"), "sha", "copies", F.octet_length("text").alias("n_bytes"), "text"), "texts")


def _contexts(texts: DataFrame, need: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The anchors whose gram occurs again, their classes of equal contexts (with the number of anchors), and the bytes of those contexts that
    share a gram with another one."""
    long = texts.filter(F.col("n_bytes") >= need).select("uid", (F.col("copies") == 1).alias("single"), "text")
    anchors = stash(long.mapInArrow(_anchorer(need, gram), "uid long, at long, left long, right long, far long, near long, single boolean, key long, context long"), "anchors")
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).filter("n > 1").drop("n")
    again = stash(anchors.join(stash(keys, "keys"), "key"), "again")
    drop_stash(anchors)
    first = F.min(F.struct("uid", "at", "left", "right", "far", "near")).alias("one")
    classes = stash(again.groupBy("key", "context").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), first).select("key", "context", "n", "mixed", "one.*"), "contexts")
    wanted = classes.filter("mixed").groupBy("uid").agg(F.collect_list(F.struct("at", "left", "right", "far", "near", "key", "context")).alias("wanted"))
    bytes_of = long.select("uid", "text").join(wanted, "uid").select("text", "wanted").mapInArrow(_cutter, "key long, context long, far long, near long, before binary, after binary")
    return again, classes, bytes_of


def _parts(contexts: DataFrame, need: int, gram: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Cut large groups: parts (g, key, context, before, after) of no more than `block` rows, and what is covered (key, context, m, l, repeat) by
    rows that agree as far as the strings of their part reach. A part's strings begin lo to hi bytes before the anchor."""
    current, parts, covered = contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(need - gram)), None, None
    own = ["key", "context", "far", "near", "before", "after"]
    both = lambda a, b: b if a is None else a.unionByName(b)
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.filter(F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), "hi")), lambda w: w["lo"] <= w["hi"])).alias("w")
        split = current.select(*own, halves).select(*own, "w.*")
        split = split.filter((F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") >= need - F.col("hi")))
        shared = F.xxhash64("key", "lo", "hi", cut("before", F.col("lo")), cut("after", need - F.col("hi")))
        whole = [cut("before", F.col("hi")), cut("after", need - F.col("lo"))]
        split = split.withColumns({"g": shared, "f": F.xxhash64(*whole), "m": F.octet_length(whole[0]), "l": F.octet_length(whole[1])})
        split = stash(split, "split")
        same = stash(split.groupBy("g", "f").agg(F.count("*").alias("n"), F.min("context").alias("one")), "same")
        sizes = stash(same.groupBy("g").agg(F.count("*").alias("rows")).filter("rows > 1"), "sizes")
        met = split.join(same, ["g", "f"])
        covered = both(covered, met.filter((F.col("n") > 1) & (F.col("m") + F.col("l") >= need)).select("key", "context", "m", "l", F.xxhash64("g", "f").alias("repeat")))
        left = met.filter(F.col("context") == F.col("one")).join(sizes, "g")
        parts = both(parts, left.filter(F.col("rows") <= block).select("g", *own))
        if sizes.filter(F.col("rows") > block).isEmpty():
            return parts, covered
        current = left.filter(F.col("rows") > block).select(*own, "lo", "hi")


def _scanned(texts: DataFrame, need: int, gram: int, block: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    """The anchors whose gram occurs again, and what is found at their contexts: m and l, and the repeat's number if asked for."""
    again, classes, contexts = _contexts(texts, need, gram)
    alone = classes.filter(F.col("n") > 1).filter(F.col("left") + F.col("right") >= need).select("key", "context", F.col("left").cast("int").alias("m"), F.col("right").cast("int").alias("l"), F.xxhash64("key", "context").alias("repeat"))
    sizes = stash(classes.filter("mixed").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > block).select("key"), "sizes")
    if sizes.isEmpty():
        posts, covered = contexts.withColumn("g", F.col("key")), alone
    else:
        contexts = stash(contexts.join(sizes.withColumn("large", F.lit(True)), "key", "left"), "bytes")
        parts, agreed = _parts(contexts.filter("large").drop("large"), need, gram, block)
        posts = contexts.filter("large IS NULL").drop("large").withColumn("g", F.col("key")).unionByName(parts)
        covered = alone.unionByName(agreed)
    schema = "g long, key long, context long, m int, l int, repeat long" if groups else "key long, context long, m int, l int"
    found = posts.repartition("g").sortWithinPartitions("g", "after").mapInArrow(_scanner(need, gram, groups), schema)
    if not groups:
        return again, found.unionByName(covered.drop("repeat")).groupBy("key", "context").agg(F.max("m").alias("m"), F.max("l").alias("l"))
    named = stash(found.withColumn("repeat", F.xxhash64("g", "repeat")).drop("g"), "named")
    return again, named.unionByName(covered.join(named, ["key", "context", "m", "l"], "left_anti"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """The union of spans (rows lo, hi), ascending; touching ones become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]), axis=1)


def _remover(keep_bytes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, found in zip(batch.column("text"), batch.column("spans")):
                data, table = memoryview(text.as_buffer()), pa.RecordBatch.from_struct_array(found.values)
                spans = _merged(np.stack((table.column("lo").to_numpy(), table.column("hi").to_numpy()), axis=1))
                ends = np.concatenate(([0], spans.ravel(), [len(data)])).reshape(-1, 2)
                kept = b"".join(data[a:b] for a, b in ends)
                for column, value in zip(rows, (len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kept = [pa.array(rows[3], pa.binary())] if keep_bytes else []
            yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), *kept], ["sha", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes])

    return run


def repeat_groups(docs: DataFrame, need: int = 200, *, gram: int = 64, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat, n_bytes, id, start: all occurrences of each maximal repeat of `need` bytes or more in different texts or twice in one, as far as the reach
    of one anchor: a longer one comes in pieces that overlap. Rows of equal texts are all named; what only they share is no group of its own."""
    small_batches(docs.sparkSession)
    texts = _text_classes(docs, text_col)
    again, found = _scanned(texts, need, gram, block, True)
    found = stash(found, "groups")
    starts = again.join(found, ["key", "context"]).select("repeat", (F.col("m") + F.col("l")).alias("n_bytes"), "uid", (F.col("at") - F.col("m")).alias("start"))
    ids = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")).join(texts.select("uid", "sha"), "sha").select("id", "uid")
    return starts.join(ids, "uid").select("repeat", "n_bytes", F.col("id").alias(id_col), "start")


def cut_repeats(docs: DataFrame, need: int = 200, *, gram: int = 64, block: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and the kept bytes if asked for: each byte goes that a string of `need` bytes
    covers which also starts anywhere else."""
    small_batches(docs.sparkSession)
    texts = _text_classes(docs, text_col)
    again, found = _scanned(texts, need, gram, block, False)
    met = again.filter("single").join(stash(found, "found"), ["key", "context"])
    span = F.struct((F.col("at") - F.col("m")).cast("int").alias("lo"), (F.col("at") + F.col("l")).cast("int").alias("hi"))
    spans = met.groupBy("uid").agg(F.collect_list(span).alias("spans"))
    cut = texts.filter((F.col("copies") == 1) & (F.col("n_bytes") >= need)).join(spans, "uid").select("sha", "text", "spans")
    kept = ["kept"] if keep_bytes else []
    cut = stash(cut.mapInArrow(_remover(keep_bytes), "sha string, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes), "cut")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= need)
    judged = texts.join(cut, "sha", "left")
    none = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("sha"))
    rest = [F.coalesce("kept", F.when(whole, F.lit("").cast("binary")).otherwise(F.col("text").cast("binary"))).alias("kept")] if keep_bytes else []
    judged = judged.select(
        "sha", F.col("n_bytes").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.when(whole, F.col("n_bytes")).otherwise(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", whole.cast("long")).alias("n_spans"), F.coalesce("kept_sha256", none).alias("kept_sha256"), *rest,
    )
    ids = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    return ids.join(judged, "sha").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *kept)
