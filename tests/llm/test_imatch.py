from __future__ import annotations

import hashlib

import pyarrow as pa
from common import awkward, frame, sentences

from gridrank.llm import imatch


def test_edited_texts_and_order(spark):
    rows = [r for r in awkward() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # ids that tell rows apart
    found = {r.doc_id: r for r in imatch.fingerprints(frame(spark, rows, 5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    by_text = {}
    for i, t, _ in rows:
        assert by_text.setdefault(t or "", found[i].fingerprint) == found[i].fingerprint


def test_null_ids_and_repeats_each_get_a_row(spark):
    rows = awkward()
    found = imatch.fingerprints(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _, _ in rows)


def test_fingerprint_equals_a_plain_one():
    from gridrank.llm.kernels import mix, words

    text = sentences(4, 1, 200)[0]
    column = pa.array([text])
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    terms = sorted(set(words(data, np.array([0, len(data)]))[2].tolist()))
    level = len(terms).bit_length() - 2
    expected = []
    for k in range(imatch.LEVELS):
        for part in range(20):
            mine = [t for t in terms if level + k >= 0 and int(mix(np.array([t ^ 0x5851F42D4C957F2D], np.uint64))[0]) % (1 << (level + k)) == part]
            total = sum(int(mix(np.array([(t + r * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) for r, t in enumerate(mine)) % 2**64
            expected.append(max(1, int(mix(np.array([total], np.uint64))[0]) >> 32) if mine else 0)
    prints = imatch.Prints.of(column, np.zeros(0, np.uint64), 20, 3)
    assert prints.hashes.ravel().tolist() == expected


def test_edited_texts_are_nearer_than_strangers(spark):
    rows = [(k, t, "s") for k, t in enumerate(sentences(6, 60, 300))]
    found = imatch.fingerprints(frame(spark, rows), least_share=0.01, most_share=0.9).collect()
    assert sum(r.near_edited > r.near_next for r in found) >= 0.8 * len(found)


def test_lexicon_is_a_band_of_document_frequencies(spark):
    texts = spark.createDataFrame([("a b c",), ("a b",), ("a d d",), ("a E",)], "t string")
    assert len(imatch.lexicon(texts, 0.5, 0.75)) == 1  # b alone


def test_one_row_follows_itself(spark):
    found = imatch.fingerprints(frame(spark, [(7, "abcdef", "s")])).collect()
    assert found[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and found[0].near_next == 1


def test_empty_table(spark):
    assert imatch.fingerprints(frame(spark, [])).count() == 0
