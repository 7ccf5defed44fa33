from __future__ import annotations

import random
import re

import pytest
from common import awkward, frame, sentences

from gridrank.llm import graph, jaccard_join

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def brute(rows):
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    nodes = [(i, s) for i, own in sets.items() for s in set(own)]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            s, t = nodes[a][1], nodes[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    out = {}
    for k, (i, s) in enumerate(nodes):
        out[i, s] = least[find(k)] if s else i
    return sorted(((i is None, i or 0), len(shingles(t)), None if i is None else out[i, shingles(t)]) for i, t, _ in rows)


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, n_base=12, copies=6):
    rng = random.Random(seed)
    base = sentences(seed, n_base, 120)
    base[0] = " ".join(base[0].split()[:6])
    rows = []
    for k, t in enumerate(base):
        for c in range(copies):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(["X", "y", "Zz"])
            if c == copies - 1:
                w = w[: max(1, len(w) * 4 // 5)]
            rows.append((k * 100 + c, " ".join(w), "s"))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = near_copies(seed) + awkward(seed)
        assert result(jaccard_join.join(frame(spark, rows))) == brute(rows)


def test_blocks_and_boundaries_change_nothing(spark, monkeypatch):
    rows = near_copies(3, 4, 20)
    for boundary in (0, 12, 1000):
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_, b=boundary: b)
        assert result(jaccard_join.join(frame(spark, rows), block=3)) == brute(rows)


def test_the_threshold_is_exact(spark):
    """Sets of 3 and 4 with 3 shared link; 7 and 7 with 6 shared link; 8 and 8 with 6 shared don't."""
    w = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(w[:7]), "s"), (2, " ".join(w[:8]), "s"), (11, " ".join(w[10:21]), "s"), (12, " ".join([*w[10:20], "q"]), "s"), (21, " ".join(w[18:30]), "s"), (22, " ".join([*w[18:28], "q", "r"]), "s")]
    found = {i: c for (_, i), _, c in result(jaccard_join.join(frame(spark, rows)))}
    assert found == {1: 1, 2: 1, 11: 11, 12: 11, 21: 21, 22: 22}
    assert result(jaccard_join.join(frame(spark, rows))) == brute(rows)


def test_boundary_by_cost():
    assert jaccard_join.choose_boundary({4: 10, 40: 10}, 1.0, 0.75) in (0, 4)
    # Sets of 4: 3 subsets against 2 lists; of 40: 66 against 11. A member that is scanned costs an eighth of a posting.
    assert jaccard_join.choose_boundary({4: 10, 40: 10}, 4.0, 0.75) == 0
    assert jaccard_join.choose_boundary({4: 10, 40: 10}, 6.0, 0.75) == 4
    assert jaccard_join.choose_boundary({4: 10, 40: 10}, 50.0, 0.75) == 40


@pytest.mark.parametrize("most", (0, 200_000))
def test_components_of_chains(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_LOCAL", most)
    rows = [(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (5, 5), (None, 7)]
    found = graph.components(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(31)] + [(k, 100) for k in (100, 101, 102)]


def test_empty_table(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0


def test_rows_without_an_id_hide_no_copies(spark):
    """A null-id copy comes first in the only task; the rows with ids after it still link."""
    text = sentences(11, 1, 80)[0] + " " + " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "s"), (5, text, "s"), (6, text + " more", "s")]
    found = result(jaccard_join.join(frame(spark, rows).coalesce(1).sortWithinPartitions("doc_id")))
    assert found == brute(rows) and [c for _, _, c in found] == [5, 5, None]


def group(seed: int, n: int, words: int = 60, edits: int = 2) -> list:
    """n copies of one text, each with other words in a few places."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for c in range(n):
        w = list(base)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        rows.append((c, " ".join(w), "s"))
    return rows


def test_rounds_change_nothing(spark, monkeypatch):
    rows = group(5, 150, 40, 3) + near_copies(6, 3, 8)
    for few in (1, 1000):
        assert result(jaccard_join.join(frame(spark, rows), block=16, few=few)) == brute(rows)
    monkeypatch.setattr(graph, "MOST_LOCAL", 3)
    monkeypatch.setattr(graph, "MOST_BROADCAST", 3)
    assert result(jaccard_join.join(frame(spark, rows), block=16)) == brute(rows)


def test_a_large_group_proposes_few_pairs(spark, monkeypatch):
    rows = group(7, 3000, words=120, edits=1) + group(8, 1500)
    tried = []
    links = jaccard_join._Verifier.links
    monkeypatch.setattr(jaccard_join._Verifier, "links", lambda self, pairs: tried.append(pairs.count()) or links(self, pairs))
    found = result(jaccard_join.join(frame(spark, [(i, t, s) for i, (_, t, s) in enumerate(rows)], 4)))
    assert sum(tried) < 4 * len(rows)
    assert {c for (_, i), _, c in found if i < 3000} == {0}
