"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking.

Each table turns unit vectors by two fast pseudo-rotations (three rounds of random signs and a Hadamard transform each) and
assigns them to a pair of signed axes, the nearest one in either rotation. The first one has `coarse` of its dimensions only, so that
few groups form. A query looks into its `probes` pairs with the largest sums of
scores in each table, and all that it finds there is ranked by the exact cosine of the original vectors, in double precision. Rows and
queries meet by the first axis of a pair, and inside such a group a query's vector is compared with those rows only whose second axis is among its pairs.
A query that finds fewer rows than asked for is compared with all.

Equal vectors form one class with its smallest ids, as many as a result can hold, so that a vector that fills a third
of the table is hashed and compared once. Rows and queries of a group meet in blocks of bounded size.

Vectors that are null, empty or zero, or hold a null or non-finite component take no part; vectors of different lengths never
meet. Rows that share id and vector count once, and a row with a query's id is never its neighbour; a null id takes no part.
Ties go to the smaller id. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import whole_groups
from cirrostrat.llm.units import ragged
from cirrostrat.runtime import stash


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of 2."""
    n, width, h = *x.shape, 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axis_scores(vectors: np.ndarray, table: int, seed: int = 11) -> np.ndarray:
    """How near each vector is to each signed axis after the table's pseudo-rotation: column 2a is +a, 2a + 1 is -a."""
    width = 1 << max(0, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng((seed, table, width)).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return np.stack((x, -x), axis=2).reshape(len(x), 2 * width)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_pairs(first: np.ndarray, second: np.ndarray, probes: int, widest: int = 128) -> list[dict[int, list[int]]]:
    """For each query the `probes` pairs of axes with the largest sums of scores, as lists of second axes by first axis. Of either rotation the
    `widest` best axes are considered."""
    out = []
    tops = [np.argsort(-s, axis=1, kind="stable")[:, :widest] for s in (first, second)]
    for i in range(len(first)):
        a, b = (top[i] for top in tops)
        sums = (first[i, a][:, None] + second[i, b][None, :]).ravel()
        best = np.sort(np.argpartition(-sums, probes)[:probes] if probes < len(sums) else np.arange(len(sums)))
        at, to = np.divmod(best, len(b))
        cuts = np.flatnonzero(np.diff(at)) + 1
        out.append({int(a[x[0]]): b[y].tolist() for x, y in zip(np.split(at, cuts), np.split(to, cuts))})
    return out


POST = pa.list_(pa.struct([("bucket", pa.int32()), ("seconds", pa.list_(pa.int32()))]))


def _hasher(tables: int, probes: int, coarse: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the pair of axes in each table, and for queries the pairs that they look into: a bucket for the first, and second axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                lengths = np.diff(batch.column("vec").offsets.to_numpy())
                buckets, seconds = (np.empty((len(lengths), tables), np.int32) for _ in range(2))
                looks: list[list[dict] | None] = [None] * len(lengths)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                for width in np.unique(lengths):
                    rows = np.flatnonzero(lengths == width)
                    x = _vectors(batch.column("vec").take(pa.array(rows)))
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    ask = rows[asks[rows]]
                    for r in ask:
                        looks[r] = []
                    for t in range(tables):
                        first, second = axis_scores(x, 2 * t)[:, : 2 * coarse], axis_scores(x, 2 * t + 1)
                        base = t * first.shape[1]
                        buckets[rows, t], seconds[rows, t] = base + first.argmax(1), second.argmax(1)
                        for r, pairs in zip(ask, best_pairs(first[asks[rows]], second[asks[rows]], probes)):
                            looks[r] += [{"bucket": base + a, "seconds": b} for a, b in pairs.items()]
                each = np.arange(buckets.size + 1, dtype=np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(buckets.ravel()), pa.ListArray.from_arrays(pa.array(each), pa.array(seconds.ravel()))], fields=list(POST.value_type))
                posts = pa.ListArray.from_arrays(pa.array(each[::tables]), pairs)
                yield pa.RecordBatch.from_arrays([*batch.columns, posts, pa.array(looks, POST)], [*batch.schema.names, "posts", "looks"])

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the same pair gives the same value wherever it is computed."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return np.clip(dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))), -1.0, 1.0)


def _ranker(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The `most` nearest classes of each query inside each group of rows and queries."""
    schema = pa.schema([("asker", pa.int64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g, asks = table.column("g").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
            cid, ids = table.column("cid").to_numpy(), table.column("ids").combine_chunks()
            vec, seconds = table.column("vec").combine_chunks(), table.column("seconds").combine_chunks()
            axes, axes_at = seconds.flatten().to_numpy(), seconds.offsets.to_numpy() - seconds.offsets[0].as_py()
            flat, at = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vec.offsets.to_numpy() - vec.offsets[0].as_py()
            bounds = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            for start, end in zip(bounds[:-1], bounds[1:]):
                ask, own = asks[start:end], cid[start:end]
                if ask.all() or not ask.any():
                    continue
                x = flat[at[start] : at[end]].reshape(end - start, -1)  # the vectors of a group are equally long
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                rows, queries = np.flatnonzero(~ask), np.flatnonzero(ask)
                score = np.full((len(queries), len(rows)), -np.inf)
                held, first, n = axes[axes_at[rows + start]], axes_at[queries + start], np.diff(axes_at)[queries + start]
                asker, sought = np.repeat(np.arange(len(queries)), n), ragged(axes, first, n)
                by_held, by_sought = np.argsort(held, kind="stable"), np.argsort(sought, kind="stable")
                for axis in np.intersect1d(held, sought):
                    some, by = by_held[slice(*np.searchsorted(held[by_held], (axis, axis + 1)))], asker[by_sought[slice(*np.searchsorted(sought[by_sought], (axis, axis + 1)))]]
                    score[by[:, None], some] = unit[queries[by]] @ unit[rows[some]].T
                k = min(most, len(rows))
                least = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
                q, r = np.nonzero((score >= least[:, None] - 1e-12) & (score > -np.inf))
                exact = cosine(x[queries[q]], x[rows[r]])
                order = np.lexsort((own[rows[r]], -exact, q))
                place = np.arange(len(order)) - np.searchsorted(q[order], np.arange(len(queries)))[q[order]]
                kept = order[place < most]
                found = rows[r[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(own[queries[q[kept]]]), pa.array(own[found]), ids.take(pa.array(found + start)), pa.array(exact[kept])], schema=schema)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and not only zeros."""
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(rows: DataFrame, asks: Column, most: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, probes: int = 320, coarse: int = 16, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the `most` nearest rows found for each row for which `asks` holds. A query for which the tables find
    fewer is compared with all rows of its length, block by block, so that none lacks a neighbour that exists."""
    hashed, asked = _hashed(rows, asks, most, id_col, vector_col, tables, probes, coarse)
    width = F.size("vec").alias("width")
    none = F.array().cast("array<long>").alias("ids")
    index = hashed.select("cid", "ids", "vec", F.lit(False).alias("asks"), width, F.inline("posts"))
    looks = hashed.filter("asks").select("cid", none, "vec", "asks", width, F.inline("looks"))
    named = stash(asked.join(hashed.filter("asks").select("vec", F.col("cid").alias("asker")), "vec").select(F.col("id").alias("query_id"), "asker"), "named")
    ranked = stash(_ranked(named, _met(index, looks, most, block), most), "ranked")
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    short = stash(named.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < most).select("asker").distinct(), "short")
    # Their group is that of all rows of one length; without such queries no row is moved.
    every = F.lit(0).alias("bucket"), F.array(F.lit(0)).alias("seconds")
    rest = hashed.filter("asks").join(short, F.col("cid") == F.col("asker"), "left_semi").select("cid", none, "vec", "asks", width, *every)
    whole = hashed.select("cid", "ids", "vec", F.lit(False).alias("asks"), width, *every)
    more = _ranked(named.join(short, "asker"), _met(whole, rest, most, block), most)
    return ranked.join(short, "asker", "left_anti").unionByName(more).select("query_id", "rank", "vec_id", "score")


def _met(index: DataFrame, looks: DataFrame, most: int, block: int) -> DataFrame:
    """(asker, score, vec_id) of the nearest rows that queries meet in a bucket. Both sides of a bucket are dealt into blocks, and each block of
    rows meets each of queries."""
    count = lambda df, name: df.groupBy("width", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = stash(count(index, "cuts").join(count(looks, "rounds"), ["width", "bucket"]), "sizes")  # tables * axes rows for each length of vectors
    own = lambda n: F.pmod(F.xxhash64(F.lit(3), "cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(sizes, ["width", "bucket"]).withColumn("cut", own("cuts")).withColumn("round", every("rounds"))
    looks = looks.join(sizes, ["width", "bucket"]).withColumn("round", own("rounds")).withColumn("cut", every("cuts"))
    both = index.unionByName(looks).withColumn("g", F.xxhash64("width", "bucket", "cut", "round")).select("g", "asks", "cid", "ids", "vec", "seconds")
    found = both.repartition("g").sortWithinPartitions("g").mapInArrow(_ranker(most + 1), "asker long, cid long, ids array<long>, score double")
    found = found.groupBy("asker", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "cid"))).filter(F.col("place") <= most + 1)
    return best.select("asker", "score", F.explode("ids").alias("vec_id"))


def _ranked(named: DataFrame, best: DataFrame, most: int) -> DataFrame:
    pairs = named.join(best, "asker").filter("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= most)
    return ranked.select("asker", "query_id", "rank", "vec_id", "score")


def _hashed(rows: DataFrame, asks: Column, most: int, id_col: str, vector_col: str, tables: int, probes: int, coarse: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal vectors (cid, ids, vec, asks, posts, looks), and the queries (id, vec)."""
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(usable(F.col("vec")) & F.col("id").isNotNull())
    # Repeats of a row go first; then each task keeps a vector's smallest ids, so that a frequent vector is cut before it is moved.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first = good.select("id", "vec").distinct().withColumn("place", place).filter(F.col("place") <= most + 1)
    classes = first.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("cid", F.col("ids")[0])
    asked = stash(good.filter("asks").select("id", "vec").distinct(), "asked")
    known = asked.select("vec").distinct().withColumn("asks", F.lit(True))
    classes = classes.join(known, "vec", "left").select("cid", "ids", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))
    post = "array<struct<bucket:int,seconds:array<int>>>"
    return stash(classes.mapInArrow(_hasher(tables, probes, coarse), f"cid long, ids array<long>, vec {dict(rows.dtypes)[vector_col]}, asks boolean, posts {post}, looks {post}"), "hashed"), asked


def looked_at(rows: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, probes: int = 320, coarse: int = 16) -> float:
    """The share of all pairs of a query and a row, each vector once, that some table brings together: what `nearest` compares."""
    hashed = _hashed(rows, asks, 5, id_col, vector_col, tables, probes, coarse)[0]
    posts = hashed.select("cid", F.size("vec").alias("width"), F.inline("posts")).select("cid", "width", "bucket", F.col("seconds")[0].alias("second"))
    looks = hashed.filter("asks").select(F.col("cid").alias("asker"), F.size("vec").alias("width"), F.inline("looks")).select("asker", "width", "bucket", F.explode("seconds").alias("second"))
    met = looks.join(posts, ["width", "bucket", "second"]).select("asker", "cid").distinct().count()
    return met / (hashed.count() * hashed.filter("asks").count())
