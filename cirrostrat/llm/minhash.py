"""Near-duplicate documents: minhash signatures, an inverted join of their coordinates, and full sets to confirm.

1. Each document's distinct word shingles give a signature of minima, and a fingerprint of the whole set. Documents
   with one fingerprint are one class, so that copies cost nothing further on.
2. Classes are posted under (coordinate, value) for a prefix of the coordinates, and a pair of a posting list is retained
   where its whole signatures collide in a threshold of coordinates or more. Collisions are counted by merging the lists of the
   coordinates inside the posting list: the shortest ones, of which a retained pair must share one, give candidates, and
   the longest ones are skipped and probed for candidates only. Prefix and threshold are the smallest and the largest with which
   a pair at the wanted similarity is missed with a probability under `miss` each.
3. The components of retained pairs hold all true links. The texts of a component meet, and the sizes of the
   intersections of their full shingle sets are counted; links at or over the wanted similarity remain.
4. The components of the remaining links are the groups of near duplicates.

Only components matter, so pairs that are known to be connected are never looked at (`linked_inside`). A posting list or component
that is larger than a block is dealt into blocks several times over, which connects what is dense; then the members outside of
its largest connected part, if any are left, meet all others, block by block. No group holds more than two blocks, and no link
between different parts is lost.

Nulls: a null or wordless text has no shingles and is linked with nothing, as is a row whose id is null (its component
is null and it is kept). Rows that share an id count as one document, linked through any of their texts; `keep_one_of_each`
chooses among texts, so that no text goes with another one's id. Ties go to the smallest id. No rows give no rows. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import Texts, mix, runs, whole_groups
from cirrostrat.llm.links import components, local_labels
from cirrostrat.llm.units import ragged
from cirrostrat.runtime import small_batches, stash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_random = np.random.default_rng(20240611)
_FLIP, _SPREAD = (_random.integers(0, 2**32, 512, dtype=np.uint32) for _ in range(2))
_SPREAD |= np.uint32(1)


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, hashed to 64 bits and ascending, end to end, with their offsets. A text of
    fewer words has them all as its only shingle."""
    t = Texts(LOWER[t.data], t.offsets)
    hashes, first = t.windows(k)
    at = np.searchsorted(first, t.word_at)
    words, sets = t.words() if (t.n_words < k).any() else None, []
    for i, n in enumerate(t.n_words):
        if n >= k:
            sets.append(np.unique(hashes[at[i] : at[i + 1]]))
        else:
            own = np.full(min(n, 1), n, np.uint64)
            for w in words[t.word_at[i] : t.word_at[i + 1]]:
                own = mix(own * np.uint64(0xD6E8FEB86659FD93) + w)
            sets.append(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(flat: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Minima of `width` hash functions over each non-empty set (rows) as 32-bit values."""
    start = offsets[:-1][np.diff(offsets) > 0]
    short = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), width), np.uint32)
    for i in range(width if len(start) else 0):
        h = (short ^ _FLIP[i]) * _SPREAD[i]
        out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), start)
    return out


def match_threshold(width: int, similarity: float, miss: float) -> int:
    """The largest number of equal coordinates that a pair at `similarity` falls short of with probability `miss` at most."""
    short, t = 0.0, 0
    while (short := short + math.comb(width, t) * similarity**t * (1 - similarity) ** (width - t)) <= miss:
        t += 1
    return t


def prefix_length(similarity: float, miss: float) -> int:
    """The smallest number of coordinates of which a pair at `similarity` shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def prints_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set, which tell sets apart; 0 for an empty one."""
    some = np.diff(offsets) > 0
    prints = np.zeros((2, len(some)), np.uint64)
    if some.any():
        start = offsets[:-1][some]
        prints[0, some] = np.add.reduceat(flat, start)
        prints[1, some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
    return prints


def _signer(k: int, width: int, prefix: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in runs(batch.column("text")):
                flat, offsets = shingle_sets(t, k)
                n = np.diff(offsets)
                some, minima = n > 0, signatures(flat, offsets, width)
                heads, sigs = np.zeros((len(n), prefix), np.uint32), np.zeros((len(n), width), np.uint16)
                heads[some], sigs[some] = minima[:, :prefix], minima.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("id", "t")), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints_of(flat, offsets)), pa.array([x.tobytes() for x in heads], pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary())],
                    ["id", "t", "n", "print1", "print2", "head", "sig"],
                )

    return run


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _pairs(sizes: np.ndarray, starts: np.ndarray, chunk: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside each small group, some at a time. Groups of one size go together."""
    for m in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(m, 1)
        at, step = starts[sizes == m], max(1, chunk // len(a))
        for s in range(0, len(at), step):
            yield (at[s : s + step, None] + a).ravel(), (at[s : s + step, None] + b).ravel()


def _bounds(groups: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]))


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links from each row to the first row that it reaches."""
    label = local_labels(len(nodes), a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def linked_inside(label: np.ndarray, side: np.ndarray, partners: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links i - j of one group, enough for its components. `partners(i, left)` gives those of the rows `left` that are linked with i: of
    the later rows, those not yet connected with i, and on another side than i where sides are given (2: none)."""
    label, found = label.copy(), ([], [])
    for i in range(len(label) - 1):
        left = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if side[i] != 2:
            left = left[side[left] != side[i]]
        if len(left) and len(hits := partners(i, left)):
            found[0].append(np.full(len(hits), i))
            found[1].append(hits)
            label[np.isin(label, label[hits])] = label[i]
    none = np.zeros(0, np.int64)
    return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (none, none)


def merging_lists(sig: np.ndarray, threshold: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners whose signatures collide in `threshold` coordinates or more: rows of the shortest lists of i's coordinates are candidates,
    the `threshold` - 1 longest are skipped and probed. Where fewer rows are left than the lists hold, all of these are probed."""
    m, width = sig.shape
    order = np.argsort(sig, axis=0, kind="stable")
    listed, length = np.empty((m, width), np.int64), np.empty((m, width), np.int64)
    for c in range(width):
        bounds = _bounds(sig[order[:, c], c])
        size = np.diff(bounds)
        listed[order[:, c], c], length[order[:, c], c] = np.repeat(bounds[:-1], size), np.repeat(size, size)
    short = np.argsort(length, axis=1, kind="stable")[:, : max(1, width - threshold + 1)]

    def partners(i: int, left: np.ndarray) -> np.ndarray:
        if length[i, short[i]].sum() < len(left):
            rows = np.concatenate([order[listed[i, c] : listed[i, c] + length[i, c], c] for c in short[i]])
            left = np.intersect1d(rows, left)
        return left[(sig[left] == sig[i]).sum(1) >= threshold]

    return partners


def _collider(threshold: int, small: int = 24) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the rows of each posting list whose signatures collide often enough. Lists of few rows are compared many at a
    time, each pair at the first coordinate where it collides; in longer ones, lists of coordinates are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            node, label, side, at = (table.column(c).to_numpy() for c in ("node", "label", "side", "at"))
            head, sig = _matrix(table.column("head"), np.uint32), _matrix(table.column("sig"), np.uint16)
            bounds = _bounds(table.column("g").to_numpy())
            before, sizes, found = np.arange(head.shape[1]) < at[:, None], np.diff(bounds), []
            for a, b in _pairs(sizes[sizes <= small], bounds[:-1][sizes <= small]):
                new = ~((head[a] == head[b]) & before[a]).any(1) & (label[a] != label[b]) & ((side[a] == 2) | (side[a] != side[b]))
                a, b = a[new], b[new]
                enough = (sig[a] == sig[b]).sum(1) >= threshold
                found.append((a[enough], b[enough]))
            for start, end in zip(bounds[:-1][sizes > small], bounds[1:][sizes > small]):
                a, b = linked_inside(label[start:end], side[start:end], merging_lists(sig[start:end], threshold))
                found.append((a + start, b + start))
            if found:
                yield _forest(node, *(np.concatenate(x) for x in zip(*found)))

    return run


def sharing_shingles(sets: list[np.ndarray], num: int, den: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners with den * |intersection| >= num * |union|, counted from the lists of the documents that share each shingle. A partner
    misses few of i's shingles, so it is found in the lists of that many and one more, the rarest ones; only such rows are counted."""
    n = np.array([len(s) for s in sets])
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    bounds = _bounds(flat[order])
    listed, df = doc[order], np.diff(bounds)
    shingle, ends = np.empty(len(flat), np.int64), np.cumsum(n)
    shingle[order] = np.repeat(np.arange(len(df)), df)

    def partners(i: int, left: np.ndarray) -> np.ndarray:
        left = left[(den * n[left] >= num * n[i]) & (den * n[i] >= num * n[left])]  # others are too long or too short
        if not len(left):
            return left
        own = shingle[ends[i] - n[i] : ends[i]]
        rare = own[np.argsort(df[own], kind="stable")[: n[i] - -(-num * n[i] // den) + 1]]
        left = np.intersect1d(ragged(listed, bounds[rare], df[rare]), left)
        if len(left) * n[i] < df[own].sum():
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in left], np.int64)
        else:
            both = np.bincount(ragged(listed, bounds[own], df[own]), minlength=len(sets))[left]
        return left[den * both >= num * (n[i] + n[left] - both)]

    return partners


def _confirmer(k: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the texts of each group that are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
            sets: list[np.ndarray] = []
            for _, _, t in runs(table.column("text")):
                flat, offsets = shingle_sets(t, k)
                sets += np.split(flat, offsets[1:-1]) if len(offsets) > 1 else []
            bounds, found = _bounds(table.column("g").to_numpy()), []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end - start > 1:
                    a, b = linked_inside(label[start:end], side[start:end], sharing_shingles(sets[start:end], num, den))
                    found.append((a + start, b + start))
            if found:
                yield _forest(node, *(np.concatenate(x) for x in zip(*found)))

    return run


Linker = Callable[[DataFrame], DataFrame]


def connected(members: DataFrame, linker: Linker, most_rows: int, most_weight: int, deals: int = 2) -> DataFrame:
    """(node, component) from `members` (node, grp, weight, ...): nodes are connected if `linker` links them inside some group. It takes
    the members with g (rows of one g meet), label (rows of one label are connected already) and side, and gives links (a, b).

    A group of several blocks is dealt into them `deals` times, each time anew. What this doesn't connect with the largest
    part of the group is the rest: its blocks meet one another and those of the largest part."""
    members = stash(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum("weight") / most_weight)).cast("int")
    sizes = stash(members.groupBy("grp").agg(F.count("*").alias("rows"), blocks.alias("blocks")).filter("rows > 1").drop("rows"), "sizes")
    sized = members.join(sizes, "grp")

    def block(seed: object, of: str) -> object:
        return F.pmod(F.xxhash64(seed, "node"), F.col(of)).cast("int")

    deal = F.explode(F.sequence(F.lit(1), F.when(F.col("blocks") > 1, deals).otherwise(1)))
    once = sized.withColumn("deal", deal).withColumn("g", F.xxhash64("grp", "deal", block(F.col("deal"), "blocks")))
    parts = stash(components(linker(once.withColumn("label", F.col("node")).withColumn("side", F.lit(2)))), "parts")
    several = stash(sizes.filter("blocks > 1"), "several")  # few, where `sizes` may be too many to broadcast
    if several.isEmpty():
        return parts
    large = members.join(several, "grp").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component", "blocks")
    large = stash(large, "large")
    counts = large.groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    of = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.max_by("w", F.struct("n", "label")).alias("w_main"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > n_main")

    def cut(n: object, w: object) -> object:
        return F.greatest(F.ceil(n / most_rows), F.ceil(w / most_weight), F.lit(1)).cast("int")

    of = stash(of.select("grp", "main", cut(F.col("n_main"), F.col("w_main")).alias("mains"), cut(F.col("n") - F.col("n_main"), F.col("w") - F.col("w_main")).alias("rests")), "rests")
    if of.isEmpty():
        return parts
    # Blocks 0 to rests - 1 are of the rest, those after it of the largest part. A pair of blocks is a group.
    met = large.join(of, "grp").withColumn("own", F.when(F.col("label") == F.col("main"), F.col("rests") + block(F.lit(0), "mains")).otherwise(block(F.lit(0), "rests")))
    last = F.when(F.col("own") < F.col("rests"), F.col("rests") + F.col("mains") - 1).otherwise(F.col("rests") - 1)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("g", F.xxhash64("grp", F.lit("met"), F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") > F.col("other"), 1).when(F.col("own") < F.col("other"), 0)
    # Inside one block of the rest all rows meet, in the group of the block with itself.
    more = linker(met.withColumn("side", F.coalesce(side, F.lit(2))).drop("own", "other", "main", "mains", "rests"))
    return stash(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "parts")


def _near(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, width: int, miss: float, list_rows: int, block_rows: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(uid, id, t, n, node, grp, low) of each row: its class, the group of near duplicates that this is in, and the group's smallest
    id; and (id, rows) of the ids that several rows have. t is a hash of the text. Wordless rows and those without id are alone."""
    small_batches(docs.sparkSession)
    similarity = num / den
    prefix, threshold = min(width, prefix_length(similarity, miss)), match_threshold(width, similarity, miss)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    signed = thin.select("id", "t", "text").mapInArrow(_signer(k, width, prefix), "id long, t long, n long, print1 long, print2 long, head binary, sig binary")
    signed = stash(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    shared = stash(signed.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1"), "shared")
    whole = ["n", "print1", "print2"]
    # head and sig are the same in all rows of a class; its text is that of its row of the smallest id (and t).
    classes = signed.filter("n > 0 AND id IS NOT NULL").groupBy(*whole).agg(F.min("uid").alias("node"), F.min(F.struct("id", "t")).alias("first"), F.min("head").alias("head"), F.min("sig").alias("sig"))
    classes = stash(classes.select(*whole, "node", F.col("first.id").alias("rep"), F.col("first.t").alias("t"), "head", "sig"), "classes")

    at = F.explode(F.sequence(F.lit(0), F.lit(prefix - 1)))
    posted = classes.select("node", "head", at.alias("at")).select("node", "at", F.xxhash64("at", F.substring("head", F.col("at") * 4 + 1, F.lit(4))).alias("grp"), F.lit(0).alias("weight"))

    def collide(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("g", "node", "label", "side", "at").join(classes.select("node", "head", "sig"), "node")
        return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_collider(threshold), "a long, b long")

    maybe = connected(posted, collide, list_rows, list_rows)
    members = stash(maybe.join(classes.select("node", F.col("rep").alias("id"), "t", F.col("n").alias("weight")), "node").withColumnRenamed("component", "grp"), "candidates")

    # All texts are shuffled once, at every size, and streamed past the few numbers of their partition, unsorted. Those of the candidates are
    # written, as they may be dealt several times.
    texts = thin.join(members.select("id", "t", "node").hint("shuffle_hash"), ["id", "t"]).select("node", "text")
    if not shared.isEmpty():  # rows may repeat whole: one of each text is enough
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts = stash(texts, "texts")

    def confirm(dealt: DataFrame) -> DataFrame:
        met = texts.join(dealt.select("g", "node", "label", "side").hint("shuffle_hash"), "node")
        return met.select("g", "node", "label", "side", "text").repartition("g").sortWithinPartitions("g").mapInArrow(_confirmer(k, num, den), "a long, b long")

    groups = connected(members.select("node", "grp", "weight"), confirm, block_rows, block_shingles)
    placed = classes.select(*whole, "node", "rep").join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    lows = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    placed = stash(placed.join(lows, "component", "left").select(*whole, "grp", F.coalesce("least", "rep").alias("low")), "placed")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    rows = signed.filter(~alone).select("uid", "id", "t", *whole).join(placed, whole).select("uid", "id", "t", "n", "grp", "low")
    rows = rows.unionByName(signed.filter(alone).select("uid", "id", "t", "n", F.col("uid").alias("grp"), F.col("id").alias("low")))
    return rows, shared


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, miss: float = 1e-6, list_rows: int = 2048, block_rows: int = 1024, block_shingles: int = 500_000) -> DataFrame:
    """id, n_shingles, component_id, kept of each row: documents are linked from a Jaccard similarity of num / den on."""
    rows, shared = _near(docs, k, num, den, id_col, text_col, width, miss, list_rows, block_rows, block_shingles)
    if not shared.isEmpty():
        # An id joins the groups of all its rows: they become one, and its smallest id that of all.
        rows = stash(rows, "rows")
        several = rows.join(shared.select("id"), "id").groupBy("id", "grp").agg(F.min("low").alias("low"))
        firsts = several.groupBy("id").agg(F.min("grp").alias("b"))
        joined = stash(components(several.join(firsts, "id").select(F.col("grp").alias("a"), "b")), "joined")
        lows = joined.join(rows.select(F.col("grp").alias("node"), "low").distinct(), "node").groupBy("component").agg(F.min("low").alias("least"))
        merged = stash(joined.join(lows, "component").select(F.col("node").alias("grp"), "least"), "merged")
        rows = rows.join(merged, "grp", "left").withColumn("low", F.coalesce("least", "low"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("id").eqNullSafe(F.col("low")).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, miss: float = 1e-6, list_rows: int = 2048, block_rows: int = 1024, block_shingles: int = 500_000) -> DataFrame:
    """The rows of `docs` that hold the text of each group's smallest id, one row for each group; and all rows without id. Of wordless
    rows, one for each id stays. Whole rows are shuffled only where the table of ids to leave out is too large to broadcast."""
    rows, shared = _near(docs, k, num, den, id_col, text_col, width, miss, list_rows, block_rows, block_shingles)
    if shared.isEmpty():
        gone = stash(rows.filter("id != low").select("id"), "gone")
        return docs.join(gone, docs[id_col].cast("long") == gone["id"], "left_anti")
    rows = stash(rows, "rows")
    gone = stash(rows.filter("id != low").select("id").unionByName(shared.select("id")).distinct(), "gone")
    plain = docs.join(gone, docs[id_col].cast("long") == gone["id"], "left_anti")
    # Rows that share an id: the first of those with the chosen id in each group, by the hash of their text and of the whole row.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__t"), row.alias("__row")).join(shared.select(F.col("id").alias("__id")), "__id")
    chosen = rows.filter("id = low").join(shared.select("id"), "id").select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.when(F.col("n") > 0, F.col("grp")).alias("__grp")).distinct()
    first = again.join(chosen, ["__id", "__t"]).groupBy("__id", "__grp").agg(F.min_by("__row", F.struct("__t", F.xxhash64(F.to_json("__row")))).alias("__row"))
    return plain.unionByName(first.select("__row.*"))
