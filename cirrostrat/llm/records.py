"""Token ids in binary record files: length-delimited, with masked checksums, and an offset index beside each file.

A data file is MAGIC, one byte with the width of an id (2 or 4), and then records:
    length of the payload (8 bytes) | its masked CRC-32 (4) | payload | masked CRC-32 of the payload (4)
with a payload of one flag byte (1: the document has no id), the document's id (8 bytes) and its token ids. All
numbers are little-endian. The index file holds the offset of each record (8 bytes each) and a masked CRC-32 of them,
so that records can be read in any order.

Files are in ascending order of document id, and of a hash of the text and the text itself where an id repeats: the rows are dealt by ranges of id
and hash and sorted inside. There is a file for each `file_bytes` of text or more, as many as the session has shuffle partitions at least. Each file is written under a name of its task attempt and then
renamed, so that a repeated task leaves one whole file.

Nulls: a null text is an empty one (just the end id); a null document id comes first and is flagged. Repeated rows
are written each time. No rows give no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrostrat.llm.arrowtext import Texts, runs
from cirrostrat.llm.units import Cache
from cirrostrat.runtime import fresh_path, small_batches, stash

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = b"IDRECS01"
CHUNK = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
#: First bytes of characters that are surely no white space: printed ASCII, and all others but those of the blocks that hold some.
_SOLID = _PRINTED.copy()
_SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def unit_starts(t: Texts) -> np.ndarray:
    """Places where a byte-level tokenizer that splits words from spaces, signs and line ends always cuts: each span
    between them gives the same ids alone as in its text. It may miss cuts; it makes no false ones."""
    b, n = t.data, len(t.data)
    if not n:
        return np.zeros(0, np.int64)
    prev, nxt, prev2 = (np.zeros(n, np.uint8) for _ in range(3))
    prev[1:], nxt[:-1], prev2[2:] = b[:-1], b[1:], b[:-2]
    nxt[t.offsets[1:][t.offsets[1:] > 0] - 1] = 0
    latin = (prev2 == 0xC3) & (prev != 0x97) & (prev != 0xB7)
    word_before = _LETTER[prev] | latin
    cut = (b == 0x20) & _SOLID[nxt]
    cut |= (b == 0x0A) & _LETTER[nxt]
    cut |= _LETTER[b] & (prev == 0x0A)
    cut |= _STOP[b] & word_before
    cut |= (b == 0x0A) & (_PRINTED[prev] | latin)
    cut[t.offsets[:-1][t.offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


_caches: dict[tuple[str, bool], tuple[Cache, Tokenizer, list[bytes], bool]] = {}


def _loaded(path: str, plain: bool = False) -> tuple[Cache, Tokenizer, list[bytes], bool]:
    """The cached units of a tokenizer, the tokenizer itself, the strings of its added tokens (none if they are plain text), and whether it
    cuts texts as `unit_starts` takes for granted: bytes by the usual pattern, as they are, into pairs merged without further rules."""
    if (path, plain) not in _caches:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain
        made = json.loads(tokenizer.to_str())
        model, first = made["model"], made["pre_tokenizer"] or {}
        usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        usual = usual and first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True)
        usual = usual and not made["normalizer"] and not made["truncation"] and not made["padding"]
        special = [] if plain else [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        _caches[path, plain] = Cache(partial(_encode, tokenizer), *[150_000, 24 << 20] * plain), tokenizer, special, usual
    return _caches[path, plain]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens of a byte-level vocabulary end to end, and each one's start and length. Added tokens have those of their string."""
    if path not in _bytes:
        tokenizer = _loaded(path, True)[1]
        added, of = {i: x.content.encode() for i, x in tokenizer.get_added_tokens_decoder().items()}, {letter: b for b, letter in _LETTERS.items()}
        names = [tokenizer.id_to_token(i) or "" for i in range(vocabulary_size(path))]
        raw = [added[i] if i in added else bytes(of[c] for c in x) for i, x in enumerate(names)]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        _bytes[path] = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length
    return _bytes[path]


_bytes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


#: A space and letters, which no pattern of the tokenizer cuts: these need its merges only.
_WORD = re.compile(r" ?[^\W\d_]+")


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes in byte-level vocabularies: printed Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _encode(tokenizer: Tokenizer, units: list[bytes]) -> list[list[int]]:
    texts, merge = [u.decode() for u in units], tokenizer.model.tokenize
    ids = [[x.id for x in merge(u.decode("latin-1").translate(_LETTERS))] if _WORD.fullmatch(t) else None for u, t in zip(units, texts)]
    rest = [i for i, x in enumerate(ids) if x is None]
    for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
        ids[i] = e.ids
    return ids


def encode_texts(t: Texts, tokenizer: str, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts end to end, and the number of each text. Texts with the string of an added token, which is cut out before
    anything else, are encoded whole, unless such strings are plain text; so are all texts where the tokenizer is not of the usual kind."""
    cache, library, special, usual = _loaded(tokenizer, plain)
    data = t.data.tobytes() if special or not usual else b""
    if usual:
        start = unit_starts(t)
        ids, length = cache.ids(t.data, start)
        at = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(start, t.offsets)]
        if not any(x in data for x in special):
            return ids, np.diff(at)
    parts = []
    for i, (a, b) in enumerate(zip(t.offsets[:-1], t.offsets[1:])):
        text = data[a:b]
        whole = not usual or any(x in text for x in special)
        parts.append(np.array(library.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if whole else ids[at[i] : at[i + 1]])
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.array([len(x) for x in parts], np.int64)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = struct.pack("<Bq", doc_id is None, doc_id or 0) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _writer(folder: str, tokenizer: str, end_id: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, kept = f"{base}/ids-{part:06d}", f"{base}/_attempt-{part:06d}-{attempt}"
        out, at, offsets, n_ids = None, 0, [], 0
        for batch in batches:
            doc_ids = batch.column("id").to_pylist()
            for i, j, t in runs(batch.column("text")):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{kept}.rec")
                    at = out.write(MAGIC + bytes([width]))
                ids, counts = encode_texts(t, tokenizer)
                ids, to = ids.astype(f"<u{width}"), np.cumsum(counts)
                end = np.array([end_id], f"<u{width}")
                frames = [frame(doc, np.append(ids[b - n : b], end)) for doc, b, n in zip(doc_ids[i:j], to, counts)]
                for x in frames:
                    offsets.append(at)
                    at += len(x)
                out.write(b"".join(frames))
                n_ids += int(counts.sum()) + len(frames)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{kept}.idx") as index:
            index.write((data := np.array(offsets, "<u8").tobytes()) + struct.pack("<I", masked(data)))
        for end in ("idx", "rec"):
            store.move(f"{kept}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"ids-{part:06d}"], "n_records": [len(offsets)], "n_ids": [n_ids], "bytes": [at]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, width: int = 2, file_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; return the manifest (part, file, n_records, n_ids, bytes), one row per file. `width` is 2
    where the vocabulary has at most 65,536 ids, else 4: ids that are wider raise ValueError."""
    most = max(end_id, vocabulary_size(tokenizer) - 1)
    if width not in (2, 4) or most >> (8 * width):
        raise ValueError(f"ids of {width} bytes do not hold {most}")
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / file_bytes))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = thin.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    return stash(dealt.mapInArrow(_writer(folder, tokenizer, end_id, width), "part int, file string, n_records long, n_ids long, bytes long"), "manifest")


def read_file(store: fs.FileSystem, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a file in order, a piece of the file at a time; a wrong checksum raises ValueError."""
    with store.open_input_stream(path) as src:
        head = src.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError(f"{path} is no id file")
        width, held, at = head[-1], b"", 0
        while True:
            more = src.read(CHUNK)
            held, at = held[at:] + more, 0
            while len(held) - at >= 12 and len(held) - at >= 16 + int.from_bytes(held[at : at + 8], "little"):
                n = int.from_bytes(held[at : at + 8], "little")
                yield _unframed(held, at, n, width)
                at += n + 16
            if not more:
                if at != len(held):
                    raise ValueError(f"{path} ends inside a record")
                return


def _unframed(held: bytes, at: int, n: int, width: int) -> tuple[int | None, np.ndarray]:
    payload = held[at + 12 : at + 12 + n]
    if masked(held[at : at + 8]) != int.from_bytes(held[at + 8 : at + 12], "little") or masked(payload) != int.from_bytes(held[at + 12 + n : at + 16 + n], "little"):
        raise ValueError("a record has a wrong checksum")
    none, doc_id = struct.unpack_from("<Bq", payload)
    return (None if none else doc_id), np.frombuffer(payload, f"<u{width}", offset=9)


def read_offsets(store: fs.FileSystem, path: str) -> np.ndarray:
    with store.open_input_stream(path) as src:
        data = src.read()
    if masked(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError(f"{path} has a wrong checksum")
    return np.frombuffer(data[:-4], "<u8")


def read_record(store: fs.FileSystem, path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record at an offset of the index: a shuffled read."""
    with store.open_input_file(path) as src:
        width = src.read_at(len(MAGIC) + 1, 0)[-1]
        n = int.from_bytes(src.read_at(8, offset), "little")
        return _unframed(src.read_at(n + 16, offset), 0, n, width)


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for doc_id, ids in read_file(store, f"{base}/{file}.rec"):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    return run


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids_crc32 of each record, from the files. The manifest
    has one row per file, so its running sum is small whatever the files hold."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # As many tasks as files: a number given stays as it is, while plain repartitioning of so small a table would end in one task.
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = fresh_path(spark, "ids")
    return read_ids(write_ids(docs, folder, tokenizer), folder)
