"""Merge-type (BPE) SentencePiece vocabularies: where texts split, and the agenda that merges symbols.

A merge only ever makes a piece of the vocabulary, so two neighbouring characters that stand side by
side in no piece can never end up in one symbol.  Cutting a text between all such characters gives
pre-tokens whose encodings, one after another, are the encoding of the text.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa

from nearfield.llm.text_kernels import text_bytes

SPACE_SYMBOL = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class MergeVocabulary:
    """A .model file of type BPE with byte fallback and no text normalisation; others are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.model = schema.ModelProto()
        with open(path, "rb") as file:
            self.model.ParseFromString(file.read())
        kinds = {piece.type for piece in self.model.pieces}
        normal = self.model.normalizer_spec
        if self.model.trainer_spec.model_type != 2 or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or _BYTE not in kinds:
            raise ValueError("only BPE models with byte fallback and no user-defined pieces are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models that leave texts as they are are supported")
        if self.model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that put the space symbol after a word are not supported")
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(self.model.pieces) if p.type == _NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
        self.end_id = next(i for i, p in enumerate(self.model.pieces) if p.piece == (self.model.trainer_spec.eos_piece or "</s>"))
        self.dummy_prefix = normal.add_dummy_prefix

    @cached_property
    def joinable(self) -> np.ndarray:
        """By last byte of a character and first byte of the next: whether some piece may hold them side by side."""
        table = np.zeros((256, 256), dtype=bool)
        ends = lambda c: {c.encode()[-1]} | ({0x20} if c == SPACE_SYMBOL else set())
        begins = lambda c: {c.encode()[0]} | ({0x20} if c == SPACE_SYMBOL else set())
        for piece in self.ids:
            for left, right in zip(piece, piece[1:]):
                for a in ends(left):
                    for b in begins(right):
                        table[a, b] = True
        return table

    def pretokens(self, column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """Pre-tokens of all texts, with each text's range among them (len + 1), and the texts' sizes.

        A text that isn't empty gets the vocabulary's dummy space before it.
        """
        data, offsets = text_bytes(column)
        sizes = np.diff(offsets)
        if self.dummy_prefix:
            full = sizes > 0
            data = np.insert(data, offsets[:-1][full], 0x20)
            offsets = np.concatenate([[0], np.cumsum(sizes + full)])
        if not len(data):
            return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64), sizes
        cut = np.empty(len(data), dtype=bool)
        cut[0] = True
        cut[1:] = ~self.joinable[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return tokens, np.searchsorted(starts, offsets), sizes

    def encode(self, pretoken: str) -> list[int]:
        """Ids of one pre-token: the best-scored pair of neighbours on the agenda, leftmost first, is merged until none is a piece."""
        ids = self.ids
        symbols = list(pretoken.replace(" ", SPACE_SYMBOL))
        last = len(symbols) - 1
        if last > 0:
            agenda = []
            for i in range(last):
                found = ids.get(symbols[i] + symbols[i + 1])
                if found:
                    agenda.append((-found[1], i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
            if agenda:
                heapq.heapify(agenda)
                before, after = list(range(-1, last)), list(range(1, last + 2))
                after[last] = -1
                while agenda:
                    _, i, j, size = heapq.heappop(agenda)
                    if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                        continue  # one of the two has been merged since
                    symbols[i] += symbols[j]
                    symbols[j] = ""
                    after[i] = k = after[j]
                    if k >= 0:
                        before[k] = i
                        found = ids.get(symbols[i] + symbols[k])
                        if found:
                            heapq.heappush(agenda, (-found[1], i, k, len(symbols[i]) + len(symbols[k])))
                    k = before[i]
                    if k >= 0:
                        found = ids.get(symbols[k] + symbols[i])
                        if found:
                            heapq.heappush(agenda, (-found[1], k, i, len(symbols[k]) + len(symbols[i])))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = ids.get(symbol)
                if found:
                    out.append(found[0])
                else:
                    out.extend(self.byte_ids[b] for b in symbol.encode())
        return out

    def library(self, dummy_prefix: bool):
        """The sentencepiece library over the same vocabulary."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        model.CopyFrom(self.model)
        model.normalizer_spec.add_dummy_prefix = dummy_prefix
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class Generations:
    """A mapping that keeps the entries used last, 2 * size of them and keys of 2 * size * LONGEST / 4 bytes at most.

    Keys beyond LONGEST bytes, which hardly come again, aren't kept.
    """

    LONGEST = 64

    def __init__(self, size: int):
        self.size, self.young, self.old, self.bytes = size, {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(key) > self.LONGEST:
            return
        if len(self.young) >= self.size or self.bytes > self.size * self.LONGEST // 4:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.young[key] = value
        self.bytes += len(key)


_LOADED: dict[str, MergeVocabulary] = {}


def vocabulary(path: str) -> MergeVocabulary:
    """The vocabulary at path, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = MergeVocabulary(path)
    return _LOADED[path]
