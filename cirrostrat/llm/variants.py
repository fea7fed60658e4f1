"""Spelling variants: words one edit apart, by composing finite-state machines.

The accepted pairs of `vocabulary o one-edit transducer o vocabulary` are the pairs of words that differ by one inserted, deleted or replaced
letter. A pair is found where its edit stands: at the length of the common prefix of its two words, so that each pair has one place. Places are
cut into windows, and the words that share all letters outside of a window (so that an edit inside of it can turn one into another) are a
partition: they leave the composition's initial state for the same state. A word comes to the windows of its own length, as the shorter word
or as one of two equally long ones, and to those of one letter less, as the longer word.

Each partition builds the minimised acceptors of its words' parts inside of the window, with one register of states, and enumerates
the composition: before the edit both tapes are in the same state; behind it the common words of two states' right languages are accepted, and
equal states accept all. Two windows, the halves of a word, come first; a partition of more than `block` words is cut into the halves of its
window, again and again. A window of one letter holds words that differ in that letter only, no more than the alphabet has.

Nulls: a null text has no words; a null id is hashed as an empty string; null words are left out. Repeated rows count each time. A word of any
length takes part. Ties between forms go to the smallest word in code-point order. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import whole_groups
from cirrostrat.runtime import drop_stash, stash

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_runs(text: Column, least: int) -> Column:
    """The maximal runs of `least` letters or more, with A-Z in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))


def hashed_slip(doc_id: Column, word: Column, one_in: int) -> Column:
    """The word, without one of its letters if `one_in` divides the CRC-32 of `<doc_id>:<word>`: slips of the pen that reruns repeat."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    return F.when(h % one_in == 0, F.overlay(word, F.lit(""), (h % F.length(word) + 1).cast("int"), F.lit(1))).otherwise(word)


def count_words(docs: DataFrame, *, least: int = 7, occurrences: int = 2, slips: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of `least` letters that occur `occurrences` times or more. With `slips`, one in so many has lost a letter.
    Counts are combined before the shuffle, so a frequent word is a row for each task."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(lower_runs(F.col(text_col), least)).alias("word"))
    word = hashed_slip(F.col("id"), F.col("word"), slips) if slips else F.col("word")
    counts = runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= occurrences)


class Acceptors:
    """Minimised acceptors of sets of equally long words, with one register: states with the same right language are one state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts the empty word, and has no arcs
        self.register: dict[tuple, int] = {(): 0}

    def add(self, words: list[str]) -> int | None:
        """The initial state for ascending, distinct words of one length; none without words."""
        if not words:
            return None
        open_arcs: list[dict[str, int]] = [{}]
        previous = words[0]
        open_arcs += [{} for _ in previous]
        for word in [*words[1:], None]:
            same = len(commonprefix((previous, word))) if word is not None else 0
            for depth in range(len(previous), same, -1):
                open_arcs[depth - 1][previous[depth - 1]] = self._state(open_arcs.pop())
            if word is not None:
                open_arcs += [{} for _ in range(len(word) - same)]
                previous = word
        return self._state(open_arcs.pop())

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if (found := self.register.get(key)) is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def common(self, p: int, q: int, but: str = "") -> list[str]:
        """The words that both states accept, but those that begin with a given letter."""
        if not but:
            out, todo = [], [(p, q, "")]
        else:
            arcs, others = self.arcs[p], self.arcs[q]
            out, todo = [""] if p == q == 0 else [], [(to, others[c], c) for c, to in arcs.items() if c != but and c in others]
        while todo:
            p, q, read = todo.pop()
            if p == q == 0:
                out.append(read)
                continue
            arcs, others = self.arcs[p], self.arcs[q]
            todo += [(to, to if p == q else others[c], read + c) for c, to in arcs.items() if c in others]
        return out

    def one_edit(self, short: int, long: int | None, places: int) -> Iterator[tuple[str, str]]:
        """All pairs of words that the composition accepts with an edit at a place under `places`: two words of `short` that differ in one
        letter, or one of `short` and one of `long` with a letter more. The edit stands right behind the common prefix."""
        todo: list[tuple[int, int | None, str]] = [(short, long, "")]
        while todo:
            p, q, read = todo.pop()
            arcs = list(self.arcs[p].items())
            for i, (a, to_a) in enumerate(arcs):
                for b, to_b in arcs[i + 1 :]:
                    for rest in self.common(to_a, to_b):
                        yield read + a + rest, read + b + rest
            more = self.arcs[q] if q is not None else {}
            for a, to_a in more.items():
                for rest in self.common(p, to_a, a):
                    yield read + rest, read + a + rest
            if len(read) + 1 < places:
                todo += [(to, more.get(c), read + c) for c, to in arcs]


def _enumerator(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a partition with a near one: how many near ones it has there, and the one of the largest count."""
    for table in whole_groups(batches, "g"):
        parts: dict[tuple, tuple[dict[str, tuple[str, int]], dict[str, tuple[str, int]]]] = defaultdict(lambda: ({}, {}))
        for word, n, s, lo, hi in zip(*(table.column(c).to_pylist() for c in ("word", "n", "s", "lo", "hi"))):
            end = len(word) - max(0, s - hi)
            parts[s, lo, hi, word[:lo], word[end:]][len(word) > s][word[lo:end]] = word, n
        found: dict[str, list] = {}
        for (s, lo, hi, *_), (short, long) in parts.items():
            if not short or len(short) + len(long) < 2:
                continue
            machines = Acceptors()
            for a, b in machines.one_edit(machines.add(sorted(short)), machines.add(sorted(long)), hi - lo):
                one, two = short[a], short[b] if len(b) == len(a) else long[b]
                for (word, _), (near, n) in ((one, two), (two, one)):
                    row = found.setdefault(word, [0, -n, near])
                    row[0] += 1
                    if (-n, near) < (row[1], row[2]):
                        row[1:] = -n, near
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(x) for x in zip(*found.values()))], ["word", "n_near", "minus_n", "form"])


def _windows(s: Column, lo: Column, hi: Column) -> Column:
    """The halves of a window, for words of s letters."""
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(s.alias("s"), lo.alias("lo"), mid.alias("hi")), F.struct(s.alias("s"), mid.alias("lo"), hi.alias("hi")))


def near_words(words: DataFrame, block: int = 4096) -> DataFrame:
    """(word, n_near, form, form_n) of the words of `words` (word, n; each once) that have a near one: how many, and the one of the largest n."""
    m, zero = F.length("word"), F.lit(0)
    posts = words.select("word", "n", F.explode(F.concat(_windows(m, zero, m + 1), F.when(m > 1, _windows(m - 1, zero, m)).otherwise(F.array()))).alias("w")).select("word", "n", "w.*")

    def keyed(df: DataFrame) -> DataFrame:
        outside = F.substring("word", F.length("word") - F.greatest(F.col("s") - F.col("hi"), zero) + 1, F.length("word"))
        return df.withColumn("g", F.xxhash64("s", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), outside))

    while True:
        posts = keyed(posts)
        large = stash(posts.groupBy("g").agg(F.count("*").alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("width")).filter((F.col("rows") > block) & (F.col("width") > 1)).select("g", F.lit(True).alias("cut")), "large")
        if large.isEmpty():
            break
        met = posts.join(large, "g", "left")
        whole = F.array(F.struct("s", "lo", "hi"))
        halves = F.when(F.col("cut") & (F.col("hi") - F.col("lo") > 1), _windows(F.col("s"), F.col("lo"), F.col("hi"))).otherwise(whole)
        posts = stash(met.select("word", "n", F.explode(halves).alias("w")).select("word", "n", "w.*"), "posts")
        drop_stash(large)
    found = posts.repartition("g").sortWithinPartitions("g").mapInArrow(_enumerator, "word string, n_near long, minus_n long, form string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "form")).alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus_n")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms. Paths double in each round; chains don't meet themselves."""
    roots = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stash(roots)
        roots = moved
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10, block: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of `words` (word, n; each word once). The form of a word is its near word of the
    largest n, if that is `ratio` times the word's n or more; its root is where forms lead."""
    words = stash(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"), "words")
    near = stash(near_words(words, block), "near")
    met = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    enough = F.col("form_n") >= ratio * F.col("n")
    met = stash(met.withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n"))), "variants")
    roots = roots_of(met.filter("form IS NOT NULL"))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
