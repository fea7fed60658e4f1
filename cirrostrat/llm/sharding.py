"""Shards of nearly equal bytes: minimax contiguous partition over ordered atomic groups.

Equal texts form one group and stay together. Groups are ordered by the hash of their text, and those that share
the leading bits of that hash form an atomic unit, so that the plan is made from at most `2**unit_bits` sizes at any
scale. A unit larger than the mean of what is left gets a shard of its own; over the rest, the smallest capacity that
a greedy left-to-right filling meets with the remaining shards is found by binary search, and the cuts follow it.

Nulls: a null text is empty (size 16); a null id is a row like any other. Equal rows get different slots.
No rows give no rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.runtime import stash

ROW_BYTES = 16


def shards_needed(sizes: list[int], capacity: int) -> int:
    """How many shards a greedy filling in the given order takes; each size is `capacity` at most."""
    n, fill = 1, 0
    for x in sizes:
        if fill + x > capacity:
            n, fill = n + 1, 0
        fill += x
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which a greedy filling takes no more than `shards`, by binary search. The mean plus the
    largest size always suffices; neither the mean nor the largest size can be undercut."""
    mean, most = -(-sum(sizes) // shards), max(sizes)
    low, high = max(mean, most), mean + most
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_needed(sizes, middle) <= shards else (middle + 1, high)
    return high


def partition(units: dict[int, int], shards: int) -> tuple[list[int], list[int]]:
    """From the sizes of units: those that get shard 0, 1, ... alone, and the units at which each further shard but the first begins."""
    left, alone = sum(units.values()), []
    for unit in sorted(units, key=lambda u: (-units[u], u))[: shards - 1]:
        if units[unit] * (shards - len(alone)) <= left:
            break
        alone.append(unit)
        left -= units[unit]
    order = sorted(units.keys() - set(alone))
    if not order:
        return alone, []
    sizes, open_shards = [units[u] for u in order], shards - len(alone)
    capacity, cuts, fill = smallest_capacity(sizes, open_shards), [], 0
    for i, (unit, x) in enumerate(zip(order, sizes)):
        # A shard ends where the next unit would pass the capacity, or where each unit left needs its own shard.
        if i and len(cuts) < open_shards - 1 and (fill + x > capacity or len(order) - i <= open_shards - 1 - len(cuts)):
            cuts.append(unit)
            fill = 0
        fill += x
    return alone, cuts


def shard_of(unit: Column, alone: list[int], cuts: list[int]) -> Column:
    """The shard of a unit, from the at most `shards` numbers of the plan."""
    begun = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= unit))
    own = F.array_position(F.array(*map(F.lit, alone)).cast("array<bigint>"), unit)
    return F.when(own > 0, own - 1).otherwise(begun + len(alone)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", unit_bits: int = 14, slot_parts: int = 1024) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot (0, 1, ... in each shard).

    Slots are dealt in parts: a shard's rows are cut into `slot_parts` by hash, numbered inside each part, and moved by
    the rows of the parts before, so that no task orders a whole shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stash(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - unit_bits).alias("unit"),
    ), "sizes")
    units = {r.unit: r.bytes for r in sized.groupBy("unit").agg(F.sum("size").alias("bytes")).collect()}  # at most 2**unit_bits rows
    part = F.pmod(F.xxhash64("id", "crc", "size"), F.lit(slot_parts)).cast("int")
    placed = sized.withColumn("shard", shard_of(F.col("unit"), *partition(units, shards))).withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("id", "crc", "size")
    numbered = placed.withColumn("rank", F.row_number().over(inside))
    slots = numbered.join(F.broadcast(base), ["shard", "part"])  # base: at most shards * slot_parts rows
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))
