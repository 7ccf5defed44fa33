from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from common import awkward, frame, sentences

from gridrank.llm import sentencepiece_viterbi as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value, raw) of a protocol buffer's fields."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            c = data[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(data):
        start = i
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 2:
            n = varint()
            value = data[i : i + n]
            i += n
        else:
            n = 4 if tag & 7 == 5 else 8
            value = data[i : i + n]
            i += n
        yield tag >> 3, value, data[start:i]


def packed(number: int, body: bytes) -> bytes:
    n, size = len(body), bytearray([number << 3 | 2])
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    size.append(n)
    return bytes(size) + body


def unigram_twin() -> bytes:
    """The same pieces as a unigram model, with scores that are no ties."""
    out, k = b"", 0
    with open(PATH, "rb") as f:
        raw = f.read()
    for number, value, own in fields(raw):
        if number == 2:
            out += packed(2, b"".join(r for n, _, r in fields(value) if n != 3) + bytes([3 << 3, 1]))
        elif number == 1:
            k += 1
            score = struct.pack("<f", -5 - 0.731 * np.log1p(k) - (k * 2_654_435_761 % 1000) / 977)
            out += packed(1, b"".join(r if n != 2 else bytes([2 << 3 | 5]) + score for n, _, r in fields(value)))
        else:
            out += own
    return out


def test_unigram_segmentation_equals_the_library():
    v = sp.Vocabulary(proto=unigram_twin())
    texts = sentences(3, 300, 12) + ["a  b", "日本 🙂 x", "", "   ", "\n\tq", "don't x=1;", "ﬁ ½ ①"]
    assert [x.tolist() for x in v.encode(texts)] == v.library.encode(texts, num_threads=1)


def test_batched_viterbi_equals_a_plain_one():
    v = sp.vocabulary(PATH)
    score = {v.pieces[i]: v.library.get_score(i) for i in range(len(v.pieces)) if i not in v.byte_of and i not in v.control and i != v.unknown}

    def plain(word):
        best = [(0.0, [])] + [(-np.inf, None)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - 16), j):
                s = score.get(word[i:j], float(v.worst) if j - i == 1 else None)
                if s is not None and best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, best[i][1] + [word[i:j]])
        return best[-1][0]

    words = list({sp.MARK + w for t in sentences(5, 40) for w in t.split()}) + ["x" * 70, "▁▁▁▁"]
    for word, ids in zip(words, v.segment(words), strict=True):
        found = "".join(v.pieces[i] for i in ids if i not in v.byte_of)
        total = sum(score.get(v.pieces[i], 0) for i in ids if i not in v.byte_of)
        assert any(i in v.byte_of for i in ids) or (found == word and total == pytest.approx(plain(word)))


def test_round_trips_and_awkward_rows(spark):
    rows = awkward()
    found = sp.round_trips(frame(spark, rows), PATH).collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    coded = sp.encode(frame(spark, rows), PATH)
    back = sp.decode(coded, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    one = next(r for r in coded.collect() if r.doc_id == 103)
    assert next(r for r in found if r.doc_id == 103).ids_sha256 == hashlib.sha256(np.array(one.ids, "<u4").tobytes()).hexdigest()


def test_empty_table(spark):
    assert sp.round_trips(frame(spark, []), PATH).count() == 0


def test_merge_trained_segmentation_equals_the_library():
    v = sp.Vocabulary(PATH)
    texts = sentences(7, 300, 12) + ["the and for that likewise", "a  b", "日本 🙂 x", "", "   ", "\n\tq", "don't x=1;", "ﬁ ½ ①", "▁a▁▁ b", "a\x00b <s> <0x0A>", "x" * 3000]
    assert [x.tolist() for x in v.encode(texts)] == v.library.encode(texts, num_threads=1)
    assert v.encode(["the"])[0].tolist() == [v.library.piece_to_id("▁the")]
