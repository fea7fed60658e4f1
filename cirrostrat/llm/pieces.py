"""SentencePiece encoding and decoding with a vocabulary file, by a shared-prefix Viterbi pass.

A text is marked (a space in front, spaces as `▁`) and cut before each run of marks, where no piece can reach across.
The distinct words of some texts are sorted, which is the depth-first order of their trie, and forward states are kept
for each prefix of the current word, so that words with a common prefix share them.

With a unigram vocabulary the forward state is the best sum of scores and the last piece of it. With a BPE vocabulary
a best sum would not give the pieces that merging gives, so a step is admitted only where merging the last two pieces' letters
gives these two pieces again: exactly one last piece of each prefix is admitted, and the path equals the result of the merges.
Letters outside the vocabulary become byte pieces.

Nulls and empty texts have no pieces. Texts of any length are encoded whole. Equal rows give equal results. No rows give no
rows. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cirrostrat.llm.arrowtext import Texts, runs
from cirrostrat.llm.units import Cache, ragged
from cirrostrat.runtime import small_batches

MARK = "▁"


class Vocabulary:
    """The pieces of a model file; words are encoded here, the library only reads the file."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(pieces))]
        self._setup(kind, pieces, [model.get_score(i) for i in range(len(pieces))], special, {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}, model.unk_id())

    @classmethod
    def of(cls, scores: dict[str, float], kind: str) -> Vocabulary:
        """A vocabulary of the given pieces, for tests; id 0 is the unknown piece."""
        new = cls.__new__(cls)
        new._setup(kind, ["<unk>", *scores], [0.0, *scores.values()], [True] + [False] * len(scores), {}, 0)
        return new

    def _setup(self, kind: str, pieces: list[str], scores: list[float], special: list[bool], byte_ids: dict[int, int], unknown: int) -> None:
        self.kind, self.scores, self.byte_ids, self.unknown = kind, scores, byte_ids, unknown
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.pieces = pieces
        self.penalty = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0
        #: Whether a piece may follow another (-1: the start, or a letter outside the vocabulary), as far as it was asked.
        self.follows: dict[int, dict[int, bool]] = {-1: {}}
        self.asked = 0
        #: Every ending of a piece, with the piece's id if it is one itself, else -1.
        self.tails = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        raw = [p.replace(MARK, " ").encode() if not special[i] else b"" for i, p in enumerate(pieces)]
        for b, i in byte_ids.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the best pair, the leftmost of equal ones, again and again gives."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, before: int, piece: int) -> bool:
        """Whether merging the letters of two pieces (of one, where `before` is -1) gives them again. It is remembered."""
        parts = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
        if self.asked > 250_000:
            self.asked = 0
            for known in self.follows.values():
                known.clear()
        self.asked += 1
        found = self.follows[before][piece] = self.merged("".join(parts)) == parts
        return found

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of marked words, in the order given."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        # By prefix length: the last piece (-1 at the start, -2 for a letter outside the vocabulary), its length, and what counts for the
        # next one: the best sum, or which pieces may follow.
        last, size, previous = [-1], [0], ""
        best: list = [self.follows[-1] if self.kind == "bpe" else 0.0]
        extend = self._merging if self.kind == "bpe" else self._summing
        for w in order:
            word = words[w]
            same = len(commonprefix((previous, word)))
            del last[same + 1 :], size[same + 1 :], best[same + 1 :]
            extend(word, same, last, size, best)
            ids, at = [], len(word)
            while at:
                if (piece := last[at]) < 0:
                    ids += self._letter(word[at - 1])[::-1]
                else:
                    ids.append(piece)
                at -= size[at]
            ids.reverse()
            out[w] = ids
            previous = word
        return out

    def _merging(self, word: str, same: int, last: list[int], size: list[int], nexts: list[dict[int, bool]]) -> None:
        """Forward states from prefix length `same` on: the one last piece that may follow the state before it. The piece grows leftwards while it
        ends some piece of the vocabulary."""
        tails, follows = self.tails, self.follows
        for end in range(same + 1, len(word) + 1):
            found, start = -2, end - 1
            while start >= 0:
                piece = tails.get(word[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    ok = nexts[start].get(piece)
                    if ok is None:
                        ok = self._stays(max(last[start], -1), piece)
                    if ok:
                        found = piece
                        break
                start -= 1
            last.append(found)
            if found >= 0:
                size.append(end - start)
                nexts.append(follows.get(found) or follows.setdefault(found, {}))
            else:
                size.append(1)
                nexts.append(follows[-1])

    def _summing(self, word: str, same: int, last: list[int], size: list[int], best: list[float]) -> None:
        """Forward states from prefix length `same` on: the best sum of scores."""
        for end in range(same + 1, len(word) + 1):
            top, found, length = best[end - 1] + self.penalty, -2, 1
            for start in range(end - 1, -1, -1):
                text = word[start:end]
                if text not in self.tails:
                    break
                piece = self.tails[text]
                if piece >= 0 and best[start] + self.scores[piece] > top:
                    top, found, length = best[start] + self.scores[piece], piece, end - start
            last.append(found)
            size.append(length)
            best.append(top)

    def _letter(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in letter.encode()] if self.byte_ids else [self.unknown]


_caches: dict[tuple[str, str], tuple[Vocabulary, Cache]] = {}


def _loaded(path: str, kind: str) -> tuple[Vocabulary, Cache]:
    if (path, kind) not in _caches:
        vocabulary = Vocabulary(path, kind)
        if kind == "library":  # words as the library encodes them, which sets the first mark itself
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            alone = vocabulary.merged(MARK)  # a last space, of which the library would make an empty text
            one = [vocabulary.ids[p] for p in alone if p in vocabulary.ids]
            _caches[path, kind] = vocabulary, Cache(lambda units: [x or one for x in model.encode([u[1:].decode() for u in units], num_threads=1)], 150_000, 24 << 20)
        else:
            _caches[path, kind] = vocabulary, Cache(lambda units: vocabulary.words([u.decode().replace(" ", MARK) for u in units]), 200_000, 32 << 20)
    return _caches[path, kind]


def marked(column: pa.Array) -> pa.Array:
    """Texts with a space in front, and spaces for marks; empty ones stay empty."""
    text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARK, " ")
    return pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar(" ", pa.large_string())))


def encode_marked(t: Texts, path: str, kind: str = "bpe") -> tuple[np.ndarray, np.ndarray]:
    """All ids of marked texts end to end, and the offsets of each text's ids."""
    space = t.data == 0x20
    begins = space & np.concatenate(([True], ~space[:-1])) if len(space) else space
    begins[t.offsets[:-1][t.offsets[:-1] < len(t.data)]] = True
    start = np.flatnonzero(begins)
    ids, length = _loaded(path, kind)[1].ids(t.data, start)
    return ids, np.concatenate(([0], np.cumsum(length)))[np.searchsorted(start, t.offsets)]


def decode_marked(ids: np.ndarray, offsets: np.ndarray, path: str, kind: str = "bpe") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the marked texts end to end, and their offsets. Control pieces give nothing."""
    v = _loaded(path, kind)[0]
    length = v.raw_length[ids]
    return ragged(v.raw, v.raw_start[ids], length), np.concatenate(([0], np.cumsum(length)))[offsets]


def piece_sizes(ids: np.ndarray, path: str, kind: str = "bpe") -> np.ndarray:
    """How many bytes each piece stands for."""
    return _loaded(path, kind)[0].raw_length[ids]


def n_pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def decode(ids: list[int], path: str, kind: str = "bpe") -> str:
    """The text of one list of ids; bytes that are no UTF-8 become replacement characters."""
    data, _ = decode_marked(np.array(ids, np.int64), np.array([0, len(ids)]), path, kind)
    return data.tobytes().decode(errors="replace").removeprefix(" ")


def encode_documents(docs: DataFrame, path: str, kind: str = "bpe", *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of `docs` (the text only if asked for), ids, n_pieces, and whether decoding gives the text again (with spaces for
    marks). Input columns of these names are left out."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_pieces", "decodes") and (keep_text or f.name != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in runs(marked(batch.column(text_col))):
                ids, offsets = encode_marked(t, path, kind)
                data, at = decode_marked(ids, offsets, path, kind)
                if np.array_equal(data, t.data) and np.array_equal(at, t.offsets):
                    same = np.ones(j - i, bool)
                else:
                    same = np.array([np.array_equal(data[at[k] : at[k + 1]], t.data[t.offsets[k] : t.offsets[k + 1]]) for k in range(j - i)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(i, j - i) for f in kept), lists, pa.array(np.diff(offsets)), pa.array(same)], [*(f.name for f in kept), "ids", "n_pieces", "decodes"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decodes", T.BooleanType())]))
