"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors again and again: a node projects them on a few
random directions and parts them at the cut, of some between the quartiles,
around which the fewest lie; those near it go to both sides. How near a pair
that may link can be is the same everywhere: it differs by at most
sqrt(2 - 2 least) in length, so by that divided by the root of the dimension in
a random direction, as a deviation. Up to `margin` such deviations are shared,
but no more vectors than a node's part of `spill`: all the splits above a leaf
share out one budget, so that a tree holds at most about e^spill copies of a
vector whatever the depth. A node is split until its leaves hold `leaf` vectors;
one of which more than `most_shared` lie around every cut, such as a tight
group, isn't split. The fitted splits tell how many pairs at the threshold a
tree parts; there are as many trees as it takes to part no more than
1 - `recall` of them in every tree, `trees` at least.

Splits are fitted on at most `most_sample` vectors, the first by a hash of their
ids; a node with too few of them takes its parent's. A tree has at most
MOST_NODES nodes, whatever the number of vectors: leaves beyond that are larger.
Every vector is indexed. Vectors that meet in a leaf of some tree and have equal
labels are compared by cosine in double precision.

Equal vectors of a label are one class, compared once and counted as many. A
leaf with more than `block` members of a label is compared in blocks, all pairs
of which are made, so that no task gets more than two blocks. A pair that meets
in several leaves counts in the first that its members share. Leaves return the
links of each vector and its component there; no pair leaves a task.

Vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label or id, link with nothing; nor do vectors of different
lengths. Repeated rows are vectors of their own. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.llm import graph, store

#: So many counts of hot leaves at most go to every executor; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Directions that nodes draw from.
POOL = 1024
#: Nodes of a tree and trees at most: with 20 bytes a node, what goes to every executor stays below 340 MB.
MOST_NODES, MOST_TREES = 2**18, 64
#: Where a node's vectors may be cut, as shares of them, and the directions it tries.
CUTS, TRIES = np.linspace(0.25, 0.75, 11), 3


@dataclass
class Tree:
    """Nodes from the root on; the children of one are neighbours, and a leaf has none (-1)."""

    direction: np.ndarray
    low: np.ndarray  # what lies below goes left only
    high: np.ndarray  # what lies above goes right only
    child: np.ndarray  # the left one
    kept: float  # the share of pairs at the threshold that no split parts


@dataclass
class Forest:
    pool: np.ndarray
    trees: list[Tree]

    def leaves(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each tree, rows and the leaves they are in; a leaf's number names its tree too."""
        out = []
        for t, tree in enumerate(self.trees):
            row, node, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
            while len(row):
                leaf = tree.child[node] < 0
                done.append((row[leaf], node[leaf]))
                row, node = row[~leaf], node[~leaf]
                p = np.einsum("ij,ij->i", x[row], self.pool[tree.direction[node]])
                left, right = p <= tree.high[node], p > tree.low[node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([tree.child[node[left]], tree.child[node[right]] + 1]).astype(np.int64)
            rows, nodes = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
            out.append((rows, nodes + t * MOST_NODES))
        return out


#: The normal distribution function at steps of 1 / 64 from -4 on.
_NORMAL = np.array([math.erfc(-k / 64 / math.sqrt(2)) / 2 for k in range(-256, 257)])


def _below(z: np.ndarray) -> np.ndarray:
    return _NORMAL[np.clip(np.rint(z * 64), -256, 256).astype(np.int64) + 256]


def _cut(p: np.ndarray, wide: float) -> tuple[float, float, float, float]:
    """Where to part sorted projections: the cut with the least share within `wide` on both sides, for each bit that it tells; that cut, its share and bits, the score."""
    at = p[(CUTS * (len(p) - 1)).astype(np.int64)]
    share = (np.searchsorted(p, at + wide, "right") - np.searchsorted(p, at - wide, "left")) / len(p)
    bits = -CUTS * np.log2(CUTS) - (1 - CUTS) * np.log2(1 - CUTS)
    k = int(np.argmin(share / bits))
    return float(at[k]), float(share[k]), float(bits[k]), float(share[k] / bits[k])


def _grow(sample: np.ndarray, pool: np.ndarray, rng: np.random.Generator, *, n: int, leaf: int, deviation: float, margin: float, spill: float, most_shared: float, least: int) -> Tree:
    direction, low, high, child = [0], [0.0], [0.0], [-1]
    budget = spill / max(1.0, math.log2(max(n, 1) / leaf))
    parted: dict[int, list[float]] = {}
    front = [(0, np.arange(len(sample)), float(n), 0)]
    # Level by level, so that the bound on nodes, if it is met, leaves all leaves about as large.
    for node, own, many, depth in front:
        if many <= leaf or not len(own) or len(child) + 2 > MOST_NODES:
            continue
        tried = []
        for d in rng.integers(0, POOL, TRIES):
            p = sample[own] @ pool[d]
            tried.append((*_cut(np.sort(p), margin * deviation / 2), int(d), p))
        cut, share, bits, _, d, p = min(tried, key=lambda c: c[3])
        near = np.abs(p - cut)
        half = min(margin * deviation / 2, float(np.quantile(near, min(1.0, budget * bits))))
        left, right = p <= cut + half, p > cut - half
        # Children as large as their parent would go on for ever.
        if share > most_shared or left.all() or right.all():
            continue
        apart = np.where(p <= cut - half, 1 - _below((cut + half - p) / deviation), 0.0) + np.where(p > cut + half, _below((cut - half - p) / deviation), 0.0)
        level = parted.setdefault(depth, [0.0, 0.0])
        level[0] += many * float(apart.mean())
        direction[node], low[node], high[node], child[node] = d, cut - half, cut + half, len(child)
        for side in (left, right):
            front.append((len(child), own[side] if side.sum() >= least else own, many * float(side.mean()), depth + 1))
            direction.append(0)
            low.append(0.0)
            high.append(0.0)
            child.append(-1)
        level[1] += many
    # A level's share is of the copies that reach it; what became a leaf above is parted no more.
    kept, whole = 1.0, float(n)
    for bad, at in parted.values():
        kept *= 1 - bad / max(at, whole)
    return Tree(np.array(direction, np.int32), np.array(low), np.array(high), np.array(child, np.int32), kept)


def fit(sample: np.ndarray, n: int, *, deviation: float, trees: int, leaf: int, margin: float, spill: float, most_shared: float, recall: float, least: int = 64, seed: int = 11) -> Forest:
    """sample: unit vectors, of n that will be indexed; deviation: of the difference of a pair at the threshold in a random direction."""
    rng = np.random.default_rng(seed)
    pool = rng.standard_normal((POOL, sample.shape[1]))
    pool /= np.linalg.norm(pool, axis=1, keepdims=True)
    out: list[Tree] = []
    while len(out) < trees or (len(out) < MOST_TREES and math.prod(1 - t.kept for t in out) > 1 - recall):
        out.append(_grow(sample, pool, rng, n=n, leaf=leaf, deviation=deviation, margin=margin, spill=spill, most_shared=most_shared, least=least))
    return Forest(pool, out)


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter ones are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width or int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(forest, width: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = forest.value.leaves(_unit(_matrix(batch.column(batch.schema.get_field_index("vector")), width)))
            row, leaf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            at = np.searchsorted(row, np.arange(len(batch) + 1))
            codes = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(leaf, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "leaves"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that rows of a and b share; rows are sorted and filled with different negative numbers."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1] - 1, -1, -1):
        shared = (b == a[:, k : k + 1]).any(1)
        out[shared] = a[shared, k]
    return out


LINKED = "cls long, links long, root long"


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["cls"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        cls, size, side, leaf = (table[c].to_numpy() for c in ("cls", "size", "side", "leaf"))
        x = _unit(_matrix(table["vector"]))
        codes = table["leaves"].combine_chunks()
        many = np.diff(codes.offsets.to_numpy())
        held = np.full((len(cls), int(many.max())), -1, np.int64)
        held[np.arange(held.shape[1]) < many[:, None]] = codes.flatten().to_numpy()
        order = np.sort(np.where(held < 0, np.iinfo(np.int64).max, held), axis=1)
        first, second = np.where(order == np.iinfo(np.int64).max, -1, order), np.where(order == np.iinfo(np.int64).max, -2, order)
        apart = table["x"][0].as_py() != table["y"][0].as_py()
        links, ends = np.zeros(len(cls), np.int64), []
        for s in range(0, len(cls), 256):
            i, j = np.nonzero(x[s : s + 256] @ x[s:].T >= least - 1e-9)
            i, j = i + s, j + s
            ok = i < j
            if apart:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            # One product for each pair, added up in the same order whatever the block.
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            i, j = i[exact >= least], j[exact >= least]
            if not len(i):
                continue
            ends.append((i, j))
            for k in range(0, len(i), 65536):
                a, b = i[k : k + 65536], j[k : k + 65536]
                mine = _first_shared(first[a], second[b]) == leaf[0]
                np.add.at(links, a[mine], size[b[mine]])
                np.add.at(links, b[mine], size[a[mine]])
        if not ends:
            return pa.table({c: pa.array([], pa.int64()) for c in ("cls", "links", "root")})
        i, j = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        root = graph.least_members(len(cls), i, j)
        own = np.unique(np.concatenate([i, j]))
        return pa.table({"cls": cls[own], "links": links[own], "root": cls[root[own]]})

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, trees: int = 4, leaf: int = 2048, block: int = 1024, margin: float = 4.0, spill: float = 0.8, most_shared: float = 0.6, recall: float = 0.99, most_sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of each row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0), F.lit(False))
    usable = rows.where(good)
    classes = store.keep(usable.groupBy("label", "vector").agg(F.min("id").alias("cls"), F.count("*").alias("size")), "vectors")
    n, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    sample = classes.select("cls", "vector").orderBy(F.xxhash64("cls")).limit(most_sample).select("vector").toArrow() if n else None
    x = _unit(_matrix(sample["vector"], width)) if n else np.zeros((0, 1))
    deviation = math.sqrt(max(0.0, 2 - 2 * least) / max(width or 1, 1)) or 1e-12
    forest = spark.sparkContext.broadcast(fit(x, n, deviation=deviation, trees=trees, leaf=leaf, margin=margin, spill=spill, most_shared=most_shared, recall=recall))
    plain = classes.select("cls", "size", "vector", "label")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", leaves array<long>"
    placed = store.keep(plain.mapInArrow(_assign(forest, width or 1), schema).withColumn("leaf", F.explode("leaves")), "leaves")
    width_of = F.size("vector")
    counts = placed.groupBy("leaf", "label", width_of.alias("width")).agg(F.count("*").alias("members")).where(F.col("members") > block)
    hot = store.keep(counts.select(F.col("leaf").alias("l"), F.col("label").alias("k"), F.col("width").alias("w"), "members"), "hot")
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    sized = placed.join(hot, (F.col("leaf") == F.col("l")) & (F.col("label") == F.col("k")) & (width_of == F.col("w")), "left")
    blocks = F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("long")
    dealt = sized.withColumn("side", F.pmod(F.xxhash64("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("leaf", "label", width_of.alias("width"), F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "cls", "size", "vector", "leaves")
    found = store.keep(dealt.groupBy("leaf", "label", "width", "x", "y").applyInArrow(_compare(least), LINKED), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = graph.components(found.where("root <> cls"), "cls", "root")
    named = classes.select("cls", "label", "vector", "size").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    linked = usable.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
