"""Token counts and packing against the library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import awkward, frame, sentences
from tokenizers import Tokenizer

from gridrank.llm import packing, store
from gridrank.llm.bpe import Encoder
from gridrank.llm.token_counts import token_counts

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_segments_give_the_ids_of_whole_texts(ranks):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "1", "é", " ", " ", "!", "日", "\t", "\x1c", "\u0085", " ", "🙂", "ß", "　", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + sentences(2, 50)
    encoder = Encoder(PATH, ranks, most_cached=200)
    found = [x.tolist() for _, _, flat, many in encoder.encode(pa.array(texts)) for x in np.split(flat, np.cumsum(many)[:-1])]
    assert found == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    rows = awkward()
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, rows), PATH, RANKS).collect())
    assert found == sorted(((i is None, i or 0), len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, _ in rows)
    assert token_counts(frame(spark, []), PATH, RANKS).count() == 0


def test_cache_takes_only_what_it_lacks(spark):
    cache = store.new_path(spark, "cache")
    rows = awkward()
    token_counts(frame(spark, rows[:20]), PATH, RANKS, cache).collect()
    before = spark.read.parquet(cache).count()
    token_counts(frame(spark, rows), PATH, RANKS, cache).collect()
    stored = spark.read.parquet(cache)
    assert before == len({t or "" for _, t, _ in rows[:20]}) and stored.count() == len({t or "" for _, t, _ in rows}) == stored.select("digest").distinct().count()
    wrong = stored.selectExpr("'other' as version", "digest", "n_tokens + 1 as n_tokens")
    wrong.write.mode("append").parquet(cache)
    assert sum(r.n_tokens for r in token_counts(frame(spark, rows), PATH, RANKS, cache).collect()) == sum(len(ids(t)) for _, t, _ in rows)


def test_hot_and_rare_digests_count_alike(spark):
    rows = [(k, f"word {k} of many", "x") for k in range(3000)] + [(None, "no id", "x")] * 800 + [(7, "one id", "x")] * 700 + [(5000 + k, None, "x") for k in range(900)]
    found = token_counts(frame(spark, rows), PATH, RANKS).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in found) == sorted(((i is None, i or 0), len((t or "").encode()), len(ids(t))) for i, t, _ in rows)


def check_pieces(found, rows, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*ids(t), 0])
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        if len(texts[i]) > 1:  # rows that share an id can't be told apart
            assert sum(p.length for p in pieces) == sum(map(len, texts[i]))
            continue
        own, at = texts[i][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    total = sum(len(x) for own in texts.values() for x in own)
    assert len(by_sequence) == -(-total // window) and sorted(by_sequence) == list(range(len(by_sequence)))


def test_pieces_hold_every_id_once(spark):
    rows = awkward(3, 60)
    check_pieces(packing.pack(frame(spark, rows, 4), PATH, RANKS).collect(), rows)
    assert packing.pack(frame(spark, []), PATH, RANKS).count() == 0


def test_targets_and_merged_queues(spark):
    rows = awkward(4, 60)
    check_pieces(packing.pack(frame(spark, rows), PATH, RANKS, target={"hot": 1.0, "s1": 3.0}, window=64, chunk=16).collect(), rows, 64)
    check_pieces(packing.pack(frame(spark, rows), PATH, RANKS, window=64, chunk=16, most_queues=2).collect(), rows, 64)


def test_round_robin_serves_quotas_evenly():
    dealt = packing.round_robin(np.array([5, 3, 0, 2]))
    assert np.bincount(dealt, minlength=4).tolist() == [5, 3, 0, 2]
    for n in range(1, 11):
        assert (np.abs(np.bincount(dealt[:n], minlength=4) - n * np.array([5, 3, 0, 2]) / 10) < 1.01).all()


def test_every_window_keeps_the_mixture():
    totals = [500_000, 250_000, 125_000, 60_000, 700]
    plan = packing.Schedule(totals, chunk=256, slots=64)
    owner = np.full(plan.total, -1)
    for q, n in enumerate(totals):
        for c in range(-(-n // 256)):
            at = plan.place(np.array([q]), np.array([c]))[0]
            size = min(256, n - c * 256)
            assert (owner[at : at + size] == -1).all()
            owner[at : at + size] = q
    assert (owner >= 0).all() and plan.total == sum(totals)
    share = np.array(totals) / sum(totals)
    for end in range(1024, plan.total * 3 // 4, 10_240):
        got = np.bincount(owner[:end], minlength=5)
        assert (np.abs(got - end * share) < 256 * 5 + 0.03 * end).all()


def owners(totals, weights=None, chunk=256):
    """The queue of every token of the stream; each place is taken once."""
    plan = packing.Schedule(totals, weights, chunk)
    owner = np.full(plan.total, -1)
    for q, n in enumerate(totals):
        k = np.arange(-(-n // chunk))
        for c, at in zip(k, plan.place(np.full(len(k), q), k), strict=True):
            size = min(chunk, n - c * chunk)
            assert (owner[at : at + size] == -1).all()
            owner[at : at + size] = q
    assert (owner >= 0).all()
    return owner


def test_tiny_sources_are_mixed_in():
    """A source of less than 1/4096 of the tokens is spread over the whole stream."""
    at = np.flatnonzero(owners([8_000_000, 4_000_000, 256 * 10]) == 2)
    starts = at[::256] / 12_002_560
    assert len(starts) == 10 and (np.abs(starts - (np.arange(10) + 0.5) / 10) < 0.01).all()


@pytest.mark.parametrize("scale", [100, 10_000])
def test_targets_hold_whatever_the_size(scale):
    """Weights 1 and 3 until the second queue is dry; a queue of no weight comes last."""
    totals = [scale * 300, scale * 300, scale * 50]
    owner = owners(totals, [1.0, 3.0, 0.0])
    head = owner[: scale * 380]
    for end in range(8 * 256, len(head), 4096):
        assert abs((head[:end] == 1).sum() - 0.75 * end) <= 2 * 256
    assert (owner[: scale * 600] != 2).all() and (owner[scale * 600 :] == 2).all()


def test_awkward_weights_leave_no_gap():
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(1, 9)
        owners([rng.choice([0, 1, 255, 256, 257, 5000, 60_000]) for _ in range(n)], [rng.choice([0, 1e-12, 0.1, 1 / 3, 1, 7.7, 1e9]) for _ in range(n)])


def test_pooled_sources_keep_their_weights(spark):
    """Of three sources in one queue at most, the two small ones are named by the target."""
    big, small = " ".join(["word"] * 3000), " ".join(["word"] * 300)
    rows = [(1, big, "big"), (2, small, "named"), (3, small, "also"), (4, small, "other")]
    found = packing.pack(frame(spark, rows, 1), PATH, RANKS, target={"named": 1.0, "also": 1.0, "big": 1.0, "absent": 50.0}, window=64, chunk=16, most_queues=1).collect()
    check_pieces(found, rows, 64)
    end = {i: max(p.sequence_id for p in found if p.doc_id == i) for i in (1, 2, 3, 4)}
    start = {i: min(p.sequence_id for p in found if p.doc_id == i) for i in (1, 2, 3, 4)}
    assert max(end[2], end[3]) < end[1] and start[4] >= end[1]
