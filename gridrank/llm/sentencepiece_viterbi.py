"""SentencePiece encoding and decoding: batched Viterbi in numpy, or merges for vocabularies trained by them.

The vocabulary, scores and normaliser are those of a .model file. Texts are cut
into words before their leading space marks, and each distinct word of a batch
is segmented once. Words of equal length advance together: the hashes of all
their substrings of a length are looked up among the sorted hashes of pieces of
that length, and at each position the best sum of scores and its backpointer are
found for all words at once. Ties go to the longest last piece.

A character that no piece covers scores `penalty` below the worst piece; it
becomes its bytes where the vocabulary has them, else the unknown id, which runs
of such characters share. This is the model of unigram vocabularies, and equals
the library there. For a vocabulary trained by merges the scores are ranks of
merges, and the best path by them isn't its segmentation: there the distinct
words of a batch are merged by the library, with the normaliser switched off as
they are normalised already. No piece reaches over a cut, so no merge does. Both
ways give the library's ids of whole texts.

Null and empty texts have no pieces; texts are encoded whole; repeated rows each
get a row, and ids may be null. An empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.llm.kernels import mix

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
_loaded: dict[str, "Vocabulary"] = {}


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Of every substring of that length of the rows of code points."""
    n = codes.shape[1] - length + 1
    out = np.zeros((codes.shape[0], n), _U)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _BASE + codes[:, k : k + n] + _U(1)
    return mix(out)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(_U)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer; those of fixed width are given as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 2: -1, 5: 4}[tag & 7]
            n = varint() if n < 0 else n
            yield tag >> 3, data[i : i + n]
            i += n


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _trained_by_merges(proto: bytes) -> bool:
    """Whether trainer_spec.model_type is BPE."""
    return any(n == 2 and (3, 2) in list(_fields(spec)) for n, spec in _fields(proto))


def _without_normaliser(proto: bytes) -> bytes:
    """The model for text that is normalised already. A later field of a message takes the place of an earlier one."""
    empty = bytes([1 << 3 | 2, 8]) + b"identity" + bytes([2 << 3 | 2, 0]) + bytes(x for k in (3, 4, 5) for x in (k << 3, 0))
    return proto + bytes([3 << 3 | 2]) + _varint(len(empty)) + empty


class Vocabulary:
    def __init__(self, path: str | None = None, proto: bytes | None = None, penalty: float = 10.0):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[int]] = {}
        for i in range(n):
            if not special[i]:
                lengths.setdefault(len(self.pieces[i]), []).append(i)
        for k, ids in lengths.items():
            keys = _hashes(_codes([self.pieces[i] for i in ids]), k)[:, 0]
            order = np.argsort(keys)
            self.by_length[k] = keys[order], np.array(ids, np.int32)[order], np.array([sp.get_score(i) for i in ids], np.float32)[order]
        self.longest = max(lengths)
        self.worst = np.float32(min(sp.get_score(i) for i in range(n) if not special[i]) - penalty)
        proto = sp.serialized_model_proto()
        #: For vocabularies trained by merges only.
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=_without_normaliser(proto)) if _trained_by_merges(proto) else None
        #: Whether text may be cut before a mark that follows another character.
        self.cuts = not any(MARK in p.lstrip(MARK) for k, ids in lengths.items() for p in (self.pieces[i] for i in ids))

    def _best(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length."""
        codes = _codes(words)
        w, n = codes.shape
        m = min(self.longest, n)
        score = np.full((m, n + 1, w), -np.inf, np.float32)  # length - 1, end, word
        which = np.full((m, n + 1, w), -1, np.int32)
        for k in range(1, m + 1):
            if k not in self.by_length:
                continue
            keys, ids, scores = self.by_length[k]
            probe = _hashes(codes, k)
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = keys[at] == probe
            score[k - 1, k:] = np.where(hit, scores[at], -np.inf).T
            which[k - 1, k:] = np.where(hit, ids[at], -1).T
        missing = np.isneginf(score[0])
        score[0][missing] = self.worst
        best = np.full((n + 1, w), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((n + 1, w), np.int32)
        for j in range(1, n + 1):
            k = min(m, j)
            # Longest first, so that the first maximum is the longest piece.
            sums = best[j - k : j] + score[:k, j][::-1]
            first = np.argmax(sums, axis=0)
            best[j] = np.take_along_axis(sums, first[None], 0)[0]
            back[j] = k - first
        out: list[list[int]] = []
        back_list = back.T.tolist()
        for i in range(w):
            ids, j = [], n
            while j:
                k = back_list[i][j]
                ids.append((int(which[k - 1, j, i]), j - k))
                j -= k
            out.append([x for piece, at in reversed(ids) for x in ([piece] if piece >= 0 else self._fallback(words[i][at]))])
        return [self._merged(x) for x in out] if not self.bytes else out

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _merged(self, ids: list[int]) -> list[int]:
        return [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != self.unknown]

    def segment(self, words: list[str], most: int = 1 << 18) -> list[list[int]]:
        """Ids of distinct words, those of each length in blocks of about `most` characters."""
        out: list[list[int]] = [[]] * len(words)
        lengths: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            lengths.setdefault(len(x), []).append(i)
        for n, at in lengths.items():
            step = max(1, most // max(n, 1))
            for s in range(0, len(at), step) if n else ():
                for i, ids in zip(at[s : s + step], self._best([words[i] for i in at[s : s + step]]), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        plain = [self.library.normalize(t) if t else "" for t in texts]
        data = np.frombuffer("".join(plain).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for t in plain])
        at = np.concatenate([[0], ends])
        if not len(data):
            return [np.zeros(0, np.int32) for _ in texts]
        mark = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            here = np.zeros(len(data), bool)
            here[:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
            mark[:-1] = here
            mark[3:-1] &= ~here[:-3]
        mark[at] = True
        edges = np.flatnonzero(mark)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = [w.decode() for w in words.dictionary.to_pylist()]
        ids = self.merges.encode(distinct, num_threads=1) if self.merges else self.segment(distinct)
        size = np.array([len(x) for x in ids])
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        codes = words.indices.to_numpy()
        stop = np.concatenate([[0], np.cumsum(size[codes])])
        all_ids = flat[np.repeat(first[codes] - stop[:-1], size[codes]) + np.arange(stop[-1])]
        cut = stop[np.searchsorted(edges, at)]
        found = [all_ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        if not self.bytes:  # unknown characters that end one word and begin the next share an id too
            found = [x[~((x == self.unknown) & np.concatenate([[False], x[:-1] == self.unknown]))] if len(x) else x for x in found]
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, marks made spaces, the first one dropped."""
        out = bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i == self.unknown:
                out += " ⁇ ".encode()
            elif i not in self.control:
                out += self.pieces[i].encode()
        text = out.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.encode(part.column(1).fill_null("").to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column(1)
            texts = [v.decode(x.values.to_numpy()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and array of ids of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_encode(model), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row; null ids give a null text."""
    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decode(model), f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.slice(s, 500)
                texts = part.column(1).fill_null("").to_pylist()
                ids = v.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([v.decode(x) == t for x, t in zip(ids, texts, strict=True)]),
                    ],
                    ["id", "n_pieces", "ids_sha256", "round_trip"],
                )

    return run


def round_trips(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, digest of the ids (little-endian, 32 bits each) and whether they decode to the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_both(model), f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
