"""Ids of a byte-level BPE vocabulary for whole Arrow columns, each distinct segment of a batch encoded once.

The vocabulary splits text so that a space before a visible character always
begins a new unit. Texts are cut there, distinct segments are encoded, and the
ids are gathered again; the result is that of encoding each whole text. Texts
that hold one of the vocabulary's special strings go through the library whole.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridrank.llm.kernels import text_chunks

#: Bytes that can follow the space at which a text is cut: visible ASCII, or the first byte of a character that is no white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    """Ids by a tokenizers .json file. Where a rank file of the same vocabulary is named, segments are merged by it.

    Up to most_cached segments stay known from batch to batch, with their ids in flat arrays.
    """

    def __init__(self, path: str, ranks: str | None = None, most_cached: int = 200_000, chunk: int = 2 << 20):
        self.path, self.chunk = path, chunk
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f).get("added_tokens", ())]
        self.ranked = self._by_ranks(ranks) if ranks else None
        self.most_cached = most_cached
        self.known = pa.array([], pa.binary())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    @functools.cached_property
    def whole(self):
        """The library's tokenizer; loaded when something needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _by_ranks(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _new(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of segments that aren't known. Those that begin with a space and a visible character are encoded in one go."""
        parts = values.to_pylist()
        if not self.ranked:
            ids = [np.array(x.ids, np.int32) for x in self.whole.encode_batch([p.decode() for p in parts], add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
        plain = np.array([len(p) > 1 and p[0] == 32 and bool(_VISIBLE[p[1]]) for p in parts])
        joined = np.array(self.ranked(b"".join(p for p, x in zip(parts, plain, strict=True) if x).decode()), np.int32)
        stops = np.cumsum([len(p) for p, x in zip(parts, plain, strict=True) if x])
        at = np.concatenate([[0], np.searchsorted(np.cumsum(self.length[joined]), stops) + 1]) if len(stops) else np.zeros(1, np.int64)
        if plain.all():
            return np.diff(at), joined
        size = np.zeros(len(parts), np.int64)
        size[plain] = np.diff(at)
        single = {i: np.array(self.ranked(parts[i].decode()), np.int32) for i in np.flatnonzero(~plain)}
        for i, ids in single.items():
            size[i] = len(ids)
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        where = np.repeat(begin[plain] - at[:-1], np.diff(at)) + np.arange(len(joined))
        flat[where] = joined
        for i, ids in single.items():
            flat[begin[i] : begin[i] + len(ids)] = ids
        return size, flat

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(at) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        mark = np.zeros(len(data) + 1, bool)
        mark[:-2] = (data[:-1] == 32) & _VISIBLE[data[1:]] if len(data) > 1 else False
        mark[at] = True
        edges = np.flatnonzero(mark)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        found = pc.index_in(parts.dictionary, value_set=self.known)
        slot = found.fill_null(-1).to_numpy()
        new = np.flatnonzero(slot < 0)
        size, flat = self.size, self.flat
        if len(new):
            values = parts.dictionary.take(pa.array(new))
            slot = slot.copy()
            slot[new] = len(size) + np.arange(len(new))
            more_size, more = self._new(values)
            size, flat = np.concatenate([size, more_size]), np.concatenate([flat, more])
            room = self.most_cached - len(self.known)
            if room > 0:
                self.known = pa.concat_arrays([self.known, values[:room]])
                self.size = size[: len(self.known)]
                self.flat = flat[: int(self.size.sum())]
        first = np.cumsum(size) - size
        codes = slot[parts.indices.to_numpy()]
        many = size[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        where = np.arange(ends[-1], dtype=np.int32)
        where += np.repeat((first[codes] - ends[:-1]).astype(np.int32), many)
        return flat[where], np.diff(ends[np.searchsorted(edges, at)])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids in each text) of runs of texts; nulls are empty."""
        for a, b, data, at in text_chunks(column, self.chunk):
            body = data.tobytes()
            if any(s in body for s in self.special):
                odd = [any(s in body[at[i] : at[i + 1]] for s in self.special) for i in range(b - a)]
            else:
                odd = None
            if odd is None or not any(odd):
                yield a, b, *self._chunk(data, at)
                continue
            for i in range(b - a):
                part = data[at[i] : at[i + 1]]
                ids = self._whole(part.tobytes().decode()) if odd[i] else self._chunk(part, np.array([0, len(part)]))[0]
                yield a + i, a + i + 1, ids, np.array([len(ids)])


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, ranks)
    return _loaded[path]
