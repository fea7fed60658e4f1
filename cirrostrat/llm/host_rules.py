"""Quality rules per document, and host verdicts from the rates at which documents fail them.

A document fails the base rule with under `MIN_WORDS` words, or where over `MAX_REPEAT` percent of its words stand in five-word
windows that occur twice or more in it. Failures are summed by host, and a host's rate is shrunk towards the others' by a beta
prior. The prior's mean and strength are fitted to the hosts' rates by moments: what they vary beyond what chance gives hosts of their
sizes. Hosts that differ by chance alone all get the common rate.

A host's verdict is the share of symbols that its documents may have: `max_symbols` a word where nothing fails, less in proportion as
the shrunk rate nears `host_limit`, and nothing passes above that. So a document with many symbols stays on a clean host
and goes on one where others fail, and one without symbols goes only with its host.

Nulls: a null text is empty (0 words, failed); a null host is no host, and its documents are judged as on one where nothing
fails. Equal rows count one by one. No rows give no rows. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrostrat.llm.arrowtext import Texts, mix, repeated, runs
from cirrostrat.runtime import small_batches, stash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(t: Texts, window: int = 5) -> dict[str, np.ndarray]:
    n, own = len(t.n_words), mix(np.arange(len(t.n_words), dtype=np.uint64) + np.uint64(1))
    hashes, first = t.windows(window)
    doc = t.text_of_word()
    often, _ = repeated(mix(hashes ^ own[doc[first]]))
    covered = np.zeros(len(t.start) + 1, np.int64)
    covered[first[often]] += 1
    covered[first[often] + window] -= 1
    start, end, line_doc = t.lines()
    _, again = repeated(mix(t.span_hash(start, end) ^ own[line_doc]))
    return {
        "n_words": t.n_words,
        "word_chars": t.per_text(~t.space & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n),
        "n_repeat_words": np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n),
    }


def _measured(text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t) for _, _, t in runs(batch.column(text_col))]
            rest = [n for n in batch.schema.names if n != text_col]
            numbers = [pa.array(np.concatenate([f[m] for f in found]) if found else [], pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *numbers], [*rest, *MEASURES])

    return run


#: A document fails with fewer words, or with a larger percentage of them in repeated windows.
MIN_WORDS, MAX_REPEAT = 10, 20


def fails(n_words: Column | np.ndarray, n_repeat_words: Column | np.ndarray) -> Column | np.ndarray:
    """The base rule, for columns and arrays alike."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def measure_documents(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, host, the five measures and base_failed of each document, in one pass over the texts."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    schema = T.StructType([thin.schema["id"], thin.schema["host"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return thin.mapInArrow(_measured("text"), schema).withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, failed, rate): failures by host, shrunk by a beta prior of the mean and strength of all hosts' rates."""
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = stash(hosts, "hosts")
    # Moments weighted by documents: m is the common rate, v the hosts' variance around it, of which chance alone gives m (1 - m) * hosts / documents.
    total = F.sum("n").cast("double")
    prior = hosts.agg((F.sum("failed") / total).alias("m"), (F.sum(F.col("failed") * F.col("failed") / F.col("n")) / total).alias("square"), (F.count("*") / total).alias("by_chance"), total.alias("total"))
    spread = F.col("m") * (1 - F.col("m"))
    beyond = F.col("square") - F.col("m") * F.col("m") - spread * F.col("by_chance")
    strength = F.when(beyond > 0, F.greatest(spread / beyond - 1, F.lit(0.0))).otherwise(F.col("total"))
    prior = prior.select("m", strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", shrunk.alias("rate"))  # prior: one row


def host_verdicts(judged: DataFrame, host_limit: float, max_symbols: float) -> DataFrame:
    """(of_host, symbols): the symbols a word that documents of each host may have; under 0 if none may pass."""
    allowed = F.when(F.col("rate") > host_limit, -1.0).otherwise(max_symbols * (1 - F.col("rate") / host_limit))
    return stash(host_rates(judged).select(F.col("host").alias("of_host"), allowed.alias("symbols")), "verdicts")


def judge_documents(docs: DataFrame, host_limit: float = 0.5, max_symbols: float = 0.5, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, host, measures, base_failed, host_failed (the host's verdict on it), kept. The text is read once."""
    judged = stash(measure_documents(docs, id_col=id_col, host_col=host_col, text_col=text_col), "measures")
    met = judged.join(host_verdicts(judged, host_limit, max_symbols), F.col("host") == F.col("of_host"), "left")
    failed = F.col("n_symbols") > F.coalesce("symbols", F.lit(max_symbols)) * F.col("n_words")
    met = met.withColumn("host_failed", failed).drop("of_host", "symbols")
    met = met.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    return met.withColumnRenamed("id", id_col).withColumnRenamed("host", host_col)


def keep_documents(docs: DataFrame, host_limit: float = 0.5, max_symbols: float = 0.5, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns. One pass finds the hosts' verdicts, a second one filters, so that no text
    is shuffled; a table of hosts that is too large to broadcast is joined by a shuffle."""
    verdicts = host_verdicts(measure_documents(docs, id_col=id_col, host_col=host_col, text_col=text_col), host_limit, max_symbols)
    rate = "__symbols"
    while rate in docs.columns:
        rate += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in runs(batch.column(text_col)):
                m = measures(t)
                keep = ~fails(m["n_words"], m["n_repeat_words"])
                found = pa.array(m["n_symbols"] / np.maximum(1, m["n_words"]))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, found], [*batch.schema.names, rate]).filter(pa.array(keep))

    rated = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(rate, T.DoubleType())]))
    met = rated.join(verdicts, rated[host_col] == verdicts["of_host"], "left")
    return met.filter(rated[rate] <= F.coalesce(verdicts["symbols"], F.lit(max_symbols))).select(*(rated[c] for c in docs.columns))
