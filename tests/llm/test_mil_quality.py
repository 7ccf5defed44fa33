from __future__ import annotations

import zlib

import re

import numpy as np
import pytest
from common import awkward, frame, sentences

from gridrank.llm import mil_quality


def labelled(spark, n=240):
    good, bad = sentences(1, n, 150), [t.upper().replace(" ", "!! ") for t in sentences(2, n, 150)]
    rows = [(k, t, "s") for k, t in enumerate(good)] + [(1000 + k, t, "s") for k, t in enumerate(bad)]
    labels = [(i, int(i < 1000), 0) for i, _, _ in rows] + [(None, 1, 0), (5, None, 0), (99_999, 0, 0)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels, rows = labelled(spark)
    return docs, rows, mil_quality.train(docs, labels)


def test_held_out_accuracy(trained):
    docs, rows, model = trained
    found = mil_quality.score(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) >= 0.97


def test_training_ignores_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    a, b = mil_quality.train(docs, labels), mil_quality.train(docs, flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, at = rng.random((7, mil_quality.N_FEATURES)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = mil_quality.Model(hidden=4, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s, _ = model.forward(x, at)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    grads = model.gradients(x, at, y, weight)
    for k, g in grads.items():
        where = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        h = 1e-5
        model.p[k][where] += h
        up = loss()
        model.p[k][where] -= 2 * h
        down = loss()
        model.p[k][where] += h
        assert g[where] == pytest.approx((up - down) / (2 * h), rel=1e-3)


def test_awkward_rows(spark, trained):
    rows = awkward()
    found = mil_quality.score(frame(spark, rows), trained[2]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in found) and not any(r.held_out for r in found if r.doc_id is None)
    assert mil_quality.score(frame(spark, []), trained[2]).count() == 0
    docs = frame(spark, rows)
    kept = mil_quality.accepted(docs, trained[2])
    assert kept.columns == docs.columns
    assert {100, 101, 102} <= {r.doc_id for r in kept.collect()}


def test_without_both_labels_nothing_is_decided(spark):
    docs, labels, _ = labelled(spark, 5)
    for given in (labels.where("quality = 1"), labels.limit(0)):
        model = mil_quality.train(docs, given)
        assert {r.score for r in mil_quality.score(docs, model).collect()} == {0.5}
        assert mil_quality.accepted(docs, model).count() == docs.count()
    assert mil_quality.score(docs, mil_quality.train(docs.limit(0), labels)).first().score == 0.5


def test_scores_equal_a_plain_forward_pass(spark, trained):
    """Attention by loops over passages of the words as Python splits them."""
    model, p = trained[2], {k: v.astype(float) for k, v in trained[2].p.items()}
    rows = [(i, t, s) for i, t, s in awkward() if i is not None]
    expected = {}
    for i, t, _ in rows:
        found = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        bags = [found[k : k + 64] for k in range(0, len(found), 64)] or [[]]
        states, weights = [], []
        for words in bags:
            data = np.frombuffer(b" ".join(words), np.uint8)
            x, at = mil_quality.passages(data, np.array([0, len(data)]), 64)
            assert len(x) == 1
            h = np.tanh(x[0] @ p["W"] + p["b"])
            gate = np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))
            states.append(h)
            weights.append(float((gate @ p["w"])[0]))
        share = np.exp(np.array(weights) - max(weights))
        z = sum(a * h for a, h in zip(share / share.sum(), states, strict=True))
        expected.setdefault(i, []).append(1 / (1 + np.exp(-float((z @ p["c"])[0] + p["d"][0]))))
    for r in mil_quality.score(frame(spark, rows), model).collect():
        assert min(abs(r.score - e) for e in expected[r.doc_id]) < 1e-3, (r, expected[r.doc_id])
