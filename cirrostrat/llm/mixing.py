"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

Each source's budget is its share of all words, no more than `cap` times what it has; what is over goes to the others
by weight, until none is above. A source with budget b and size S gives floor(b / S) complete epochs and then a
fraction of one: its documents in the order of the keys -ln(u) / quality are taken while their words, summed in that
order, come nearer to the rest of the budget. u is a hash of seed and id, so that reruns agree.

One pass over the texts writes the numbers of each row: key, id, size and a hash of the text. The order is cut into buckets of equal ratio of the key,
so that for any qualities a bucket holds a few of 10,000 documents of a source at most. Sums by (source, bucket) tell the bucket in which the
rest of a budget ends, and just that one is ordered by its numbers; the last of them that is drawn is the source's threshold, with
which a second pass tells each row.

Nulls: a null text has size 0; a row of size 0 is in no epoch and never drawn; null sources form one source, ordered last; a null id is hashed with
the text. Rows alike in id and text are drawn one by one. No rows give no rows. An input column named as `out` is replaced; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrostrat.runtime import stash

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shape_quality(text: Column, size: Column, usual: float = 6.5) -> Column:
    """A document weight in [0.01, 1]: 1 with the usual characters per word and no symbols, less with other means on either side, and with
    symbols, which halve it from one in four words on."""
    mean = F.coalesce(F.length(text) / F.nullif(size, F.lit(0)), F.lit(usual))
    symbols = F.coalesce((F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))) / F.nullif(size, F.lit(0)), F.lit(0.0))
    return F.greatest(F.lit(0.01), F.least(mean / usual, F.lit(usual) / mean) / (1 + 4 * symbols))


def budgets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source. The level at which budgets are
    proportional to weights is found from the sources in the order of cap * size / weight: those before it are full."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", weight.cast("long")).withColumn("room", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    ranked = ranked.select(
        "*",
        F.row_number().over(by_level).alias("rank"),
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("room").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    level = F.min_by(F.when(F.col("level") <= F.col("room") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("room") / F.col("w"), F.col("rank"))).over(Window.partitionBy())
    return ranked.select("source", "source_size", F.least(F.col("room").cast("double"), level * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 17, buckets: int = 1024, out: str = "mix") -> DataFrame:
    """All rows and columns of `docs` and a struct `out` (size, source_size, target, epochs, drawn, taken): the words the
    mix takes from the row are `taken`, its size times the epochs, plus once more if it was drawn. The key has `buckets` buckets
    for each power of 2."""
    own = "__mix"  # the prefix of this function's columns, of which the input has none
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    name = "{}_{}".format
    text, size, key = F.col(text_col), F.col(name(own, "size")), F.col(name(own, "key"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52
    frame = docs.drop(out).withColumn(name(own, "size"), n_words(text))
    frame = frame.withColumn(name(own, "key"), -F.log(u) / (shape_quality(text, size) if quality is None else quality))
    order = F.struct(key.alias("key"), F.col(id_col).alias("id"), size.alias("size"), F.md5(text).alias("md5"))

    rows = stash(frame.select(F.col(source_col).alias("source"), order.alias("at")), "keys").withColumn("bucket", F.floor(F.log2("at.key") * buckets).cast("int"))
    sums = stash(rows.groupBy("source", "bucket").agg(F.sum("at.size").alias("n")), "sums")
    goals = budgets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap)
    goals = goals.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
    plain = upto.select(F.col("source").alias("s"), "bucket", "n", "upto")
    cut = plain.join(goals.select("source", "rest"), F.col("s").eqNullSafe(F.col("source"))).filter(F.col("upto") > F.col("rest"))
    cut = cut.groupBy("s").agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("n"), F.col("bucket")).alias("before"))
    plan = stash(goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "budgets")

    # What is ahead grows along the order, so the rows drawn of a cut bucket are its first ones.
    edge = rows.withColumnRenamed("source", "s").join(plan.filter("cut IS NOT NULL"), F.col("s").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("cut")))
    ahead = F.col("before") + F.coalesce(F.sum("at.size").over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.select("s", "at", (ahead + F.col("at.size") / 2 <= F.col("rest")).alias("drawn"))
    last = edge.groupBy("s").agg(F.max(F.when(F.col("drawn"), F.col("at"))).alias("last"), F.min(F.when(~F.col("drawn"), F.col("at"))).alias("next"))
    ties = edge.join(last.select(F.col("s").alias("t"), "last"), F.col("s").eqNullSafe(F.col("t")) & (F.col("at") == F.col("last"))).groupBy("s").agg(F.sum(F.col("drawn").cast("long")).alias("alike"))
    met = plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(ties, F.col("source").eqNullSafe(F.col("s")), "left")
    fields = ("source", "source_size", "target", "epochs", "cut", "last", "next", "alike")
    plan = stash(met.select(*(F.col(c).alias(name(own, c)) for c in fields)), "thresholds")

    # The plan has a row for each source; its true size is known, so Spark broadcasts it where it is small.
    of = {c: F.col(name(own, c)) for c in (*fields, "drawn")}
    met = frame.join(plan, F.col(source_col).eqNullSafe(of["source"]), "left")
    bucket = F.floor(F.log2(key) * buckets).cast("int")
    drawn = F.coalesce((bucket < of["cut"]) | (bucket == of["cut"]) & (order <= of["last"]), F.lit(False)) & (size > 0)
    # Rows alike of which some are drawn and some are not: the first of them are.
    split = F.coalesce((of["last"] == of["next"]) & (order == of["last"]), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(source_col).orderBy(id_col))
    both = met.filter(~split).withColumn(name(own, "drawn"), drawn).unionByName(met.filter(split).withColumn(name(own, "drawn"), (nth <= of["alike"]) & (size > 0)))
    epochs = F.when(size > 0, of["epochs"]).otherwise(F.lit(0).cast("long"))
    taken = size * (epochs + of["drawn"].cast("long"))
    fields = F.struct(size.alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), epochs.alias("epochs"), of["drawn"].alias("drawn"), taken.alias("taken"))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns if c != out), fields.alias(out))
