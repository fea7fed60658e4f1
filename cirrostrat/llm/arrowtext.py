"""Word arithmetic on the UTF-8 buffers of Arrow string columns, vectorised over many texts at once.

A word is a maximal run of bytes outside space, tab, line feed, vertical tab, form feed and carriage return.
Hashes are 64 bits wide: polynomial sums of random byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_power: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _power or len(_power["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[name] = np.cumprod(steps, dtype=np.uint64)
    return _power["up"], _power["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, "Texts"]]:
    """Consecutive rows [i, j) whose texts hold about `limit` bytes together; a longer text comes alone, whole."""
    at, data = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, Texts(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


class Texts:
    """Some texts laid end to end: `data` bytes, text k from offsets[k] to offsets[k + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        space = SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([True], space[:-1])) if len(data) else space
        after = np.concatenate((space[1:], [True])) if len(data) else space
        self.space = space
        #: Words by their first byte and the byte after their last; text k has words from word_at[k] to word_at[k + 1].
        self.start = np.flatnonzero(~space & (before | first[:-1]))
        self.end = np.flatnonzero(~space & (after | first[1:])) + 1
        self.word_at = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(self.word_at)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal spans have equal hashes wherever they stand."""
        sums, down = self._prefix_sums()
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every span of k bytes, across the ends of texts too."""
        sums, down = self._prefix_sums()
        n = max(0, len(self.data) - k + 1)
        return mix((sums[k : k + n] - sums[:n]) * down[:n] + np.uint64(k))

    def _prefix_sums(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return self._sums, down

    def words(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words inside one text, and the index of each window's first word."""
        words = self.words()
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = np.flatnonzero(np.arange(k, k + n) <= np.repeat(self.word_at[1:], self.n_words)[:n])
        got = np.zeros(len(inside), np.uint64)
        for i in range(k):
            got = mix(got * np.uint64(0xD6E8FEB86659FD93) + words[inside + i])
        return got, inside

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a word (split at line feeds): first byte, byte after the last, index of the text."""
        at = np.unique(np.concatenate((self.offsets[:-1], np.flatnonzero(self.data == 10) + 1)))
        at = at[at < len(self.data)]
        to = np.append(at[1:], len(self.data))
        to = to - (self.data[to - 1] == 10) if len(at) else to
        worded = np.searchsorted(self.start, at) < np.searchsorted(self.start, to)
        at, to = at[worded], to[worded]
        return at, to, np.searchsorted(self.offsets, at, "right") - 1


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two flags for each key: it occurs twice or more; it occurs earlier (in some fixed order of equal keys)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = same
    often = again.copy()
    often[order[:-1]] |= same
    return often, again


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by `key`: tables that hold every row of each key they hold."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values == values[-1], True))
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == keys[0].as_py():
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)

