"""Byte-level BPE ids of many texts at once, with the tokenizers library.

Texts are cut where the tokenizer's own pre-tokenizer always cuts (before a
run of white space, and between an ASCII letter and an ASCII non-letter), the
distinct pieces are encoded once, and numpy puts the ids back in text order.
Every text gets the ids that ``encode(text, add_special_tokens=False)``
gives. Texts with white space outside ASCII, or with the string of an added
token, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sinter.llm.common import byte_slices, text_bytes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# pieces remembered by one Python worker between batches; a bound on memory,
# not on results
MEMO_PIECES = 1_500_000
SLICE_BYTES = 24 << 20
_WIDE_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")

# byte classes: 0 other ASCII, 1 white space, 2 ASCII letter, 3 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[128:] = 3
# cut before byte b that follows byte a?
_CUT = np.zeros((4, 4), bool)
_CUT[[0, 2, 3], 1] = True
_CUT[2, 0] = True
_CUT = _CUT.ravel()


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_TOKENIZER)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of all pieces, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """``encode(array) -> (ids uint32, counts int64 per row)``; null is empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character of a token is one byte
            self.n_bytes[i] = len(token)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.off = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 256):
            enc = self.tok.encode_batch_fast(texts[i:i + 256], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32) for e in enc]
        return out

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_bytes(arr)
        parts, counts = [], np.zeros(len(off) - 1, np.int64)
        for a, b in byte_slices(off, SLICE_BYTES):
            o = off[a:b + 1] - off[a]
            ids, counts[a:b] = self._slice(data[off[a]:off[b]], o)
            parts.append(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts

    def _odd_rows(self, data, off) -> np.ndarray:
        """Rows that must be encoded whole."""
        text = data.tobytes().decode("utf-8")
        if not (_WIDE_SPACE.search(text) or any(s in text for s in self.added)):
            return np.zeros(0, np.int64)
        rows = [data[x:y].tobytes().decode("utf-8") for x, y in zip(off[:-1], off[1:])]
        return np.array([i for i, t in enumerate(rows)
                         if _WIDE_SPACE.search(t) or any(s in t for s in self.added)], np.int64)

    def _slice(self, data, off):
        n = len(off) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cls = _CLASS[data]
        cut = np.empty(len(data) + 1, bool)
        cut[1:-1] = _CUT[cls[:-1] * np.uint8(4) + cls[1:]]
        cut[off] = True
        bounds = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(
            len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(pieces)
        of = self._lookup(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.off[of + 1] - self.off[of]
        ids = self.ids[ragged(self.off[of], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = ends[np.searchsorted(bounds, off)]
        counts = np.diff(at)
        odd = self._odd_rows(data, off)
        if len(odd):
            rows = [ids[at[i]:at[i + 1]] for i in range(n)]
            texts = [data[off[i]:off[i + 1]].tobytes().decode("utf-8") for i in odd]
            for i, x in zip(odd, self.whole(texts)):
                rows[i], counts[i] = x, len(x)
            ids = np.concatenate(rows)
        return ids, counts

    def _lookup(self, uniq: pa.Array) -> np.ndarray:
        """Index of each piece in the memo; unknown pieces are encoded first."""
        uniq = uniq.cast(pa.large_string())
        if len(self.pieces) + len(uniq) > MEMO_PIECES:
            self.pieces, self.ids, self.off = self.pieces[:0], self.ids[:0], self.off[:1]
        known = pc.index_in(uniq, value_set=self.pieces).to_numpy(zero_copy_only=False)
        known = np.where(np.isnan(known), -1, known).astype(np.int64) if known.dtype.kind == "f" \
            else known.astype(np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh = uniq.take(pa.array(new))
            ids, lens = self._fresh(fresh)
            known[new] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
        return known

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of distinct pieces. Pieces that begin with white
        space and end without it may be joined: the pre-tokenizer cuts
        between them, and the byte lengths of the ids tell them apart."""
        data, off = text_bytes(pieces)
        size = np.diff(off)
        first = _CLASS[data[off[:-1]]]
        last = _CLASS[data[off[1:] - 1]]
        joins = (first == 1) & (last != 1)
        # added tokens could be found across a joint
        if any(s[0].isspace() or " " in s for s in self.added):
            joins[:] = False
        lens = np.zeros(len(size), np.int64)
        rows: list = [None, None]
        order = [np.flatnonzero(joins), np.flatnonzero(~joins)]
        got, names = [], pieces.to_pylist()
        step = 2000
        blocks = [order[0][i:i + step] for i in range(0, len(order[0]), step)]
        for i in range(0, len(blocks), 8):
            some = blocks[i:i + 8]
            enc = self.tok.encode_batch_fast(["".join([names[j] for j in x]) for x in some],
                                             add_special_tokens=False)
            for x, e in zip(some, enc):
                ids = np.array(e.ids, np.uint32)
                piece = np.searchsorted(np.cumsum(size[x]), np.cumsum(self.n_bytes[ids]), "left")
                lens[x] = np.bincount(piece, minlength=len(x))
                got.append(ids)
        rows[0] = np.concatenate(got) if got else np.zeros(0, np.uint32)
        alone = self.whole([names[j] for j in order[1]])
        lens[order[1]] = [len(x) for x in alone]
        rows[1] = np.concatenate(alone) if alone else np.zeros(0, np.uint32)
        # back to the order of the pieces
        both = np.concatenate(order)
        flat, n = np.concatenate(rows), lens[both]
        start = np.zeros(len(size), np.int64)
        start[both] = np.cumsum(n) - n
        return flat[ragged(start, lens)], lens


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
