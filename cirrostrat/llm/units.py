"""Encoding by distinct units: cut texts where a tokenizer always cuts them, encode each distinct unit once, and gather.

`Cache` keeps the ids of units it has seen in a worker process, up to a bound in number and bytes, so that a frequent word is encoded once
per worker and not once per occurrence."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa


def sliced(data: np.ndarray, start: np.ndarray) -> pa.Array:
    """The units that begin at `start` (ascending, first one 0) and together make up `data`, without a copy."""
    offsets = np.append(start, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans flat[start : start + length] end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class Cache:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], bound: int = 300_000, most_bytes: int = 48 << 20) -> None:
        self.encode, self.bound, self.most_bytes = encode, bound, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used, self.bytes = 0, 0

    def _add(self, units: list[bytes]) -> None:
        ids = self.encode(units)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(lengths.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while n + len(ids) > len(self.start):
            self.start, self.length = (np.append(x, np.zeros_like(x)) for x in (self.start, self.length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(ids)] = lengths
        self.used += total
        self.bytes += sum(map(len, units))
        self.known.update(zip(units, range(n, n + len(ids))))

    def ids(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units of `data`, end to end, and how many each unit has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = sliced(data, start).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.bound or self.bytes > self.most_bytes:
            self._clear()
        if new := [u for u in distinct if u not in self.known]:
            self._add(new)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        length = self.length[at]
        return ragged(self.flat, self.start[at], length), length
