"""Jaccard join of word-shingle sets: a size-aware heavy-light join, exact.

A document's set holds the hashes of its distinct shingles in one global order:
shingles that many documents share come last. With Jaccard at least t, two sets
share an element among the first n - ceil(t n) + 1 of either (n its size), and
share j elements among the first n - ceil(t n) + j.

* Light sets, of at most `boundary` shingles, enumerate all subsets of two of
  their first n - ceil(t n) + 2 shingles; light sets link only where they share
  a subset. (Sets of different texts that link share three shingles or more.)
* Heavy sets enter the inverted lists of their first n - ceil(t n) + 1 shingles
  and scan them; so do the light sets large enough to link with a heavy one.

The boundary is the size at which enumerating costs as much as scanning, by the
histogram of sizes and the mean length of the lists, both counted over all rows.
Both cost their postings, which are moved and sorted, and lists a scan as well.

Equal sets are one class and are never paired. Each list first ties its members
to its first one. Then members of a list that are still in different components
meet, once for lists of the same members, in blocks of `block` members, so that no task gets a long list. In a round
each component of a block proposes one pair, the one whose parities differ least,
so a group of copies proposes no more pairs than it has members; when a round
finds fewer than `few` links, the pairs that still cross components are tried.
Each row then knows the keys of its other lists of more than `long` members, so
that a pair that shares many of them comes from the first alone. Pairs are verified on whole sets. Bounds that never lose a link cut
most pairs: sizes, what the rest of both sets after the shared element can add,
and the parities of two hashed bits or more for each element, which differ in at
most as many bits as the sets do in elements. Components don't need the links
inside them, so none are lost.

The order's counts come from a table of 2**22 slots, whatever the input; they
decide which lists are short, never which links are found. A null or empty text
has an empty set and links with nothing; fewer words than k are one shingle.
Repeated rows share a class; rows with a null id get a null component and link
with nothing. An empty table gives an empty result. Only the named columns are
read. Shingles are compared by 58 bits, sets by 63 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrank.llm import graph, store
from gridrank.llm.kernels import mix, shingles, text_chunks, tidy, words

_U = np.uint64
SLOTS = 1 << 22
#: What it costs to compare with a member of a list, where a posting, which is moved and sorted, costs 1.
SCAN = 1 / 8
#: Fewest bits of a parity.
LEAST_BITS = 256
SIGNED = "id long, n long, cls long, parity array<long>, keys array<long>, subsets array<long>"


def _hashed(column: pa.Array, k: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, at in text_chunks(column, most):
        _, _, hashes, of = words(data, at)
        found, out = shingles(hashes, of, k)
        yield a, b, found >> _U(6), out


def _count(k: int):
    """Slots that many shingles of a task fall in, and its documents' numbers of shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes = np.zeros(SLOTS, np.int32), {}
        waiting: list[np.ndarray] = []
        for batch in batches:
            for _, _, found, out in _hashed(batch.column(0), k):
                waiting.append((found % _U(SLOTS)).astype(np.int32))
                if sum(map(len, waiting)) > SLOTS // 2:
                    slots += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.int32)
                    waiting = []
                for n, c in zip(*np.unique(np.diff(out), return_counts=True), strict=True):
                    sizes[int(n)] = sizes.get(int(n), 0) + int(c)
        if waiting:
            slots += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.int32)
        total = int(slots.sum())
        mean = total / SLOTS
        heavy = np.flatnonzero(slots >= max(8, mean + 8 * mean**0.5))
        light = slots[slots < max(8, mean + 8 * mean**0.5)].astype(np.int64)
        # How many of the other shingles of this task meet in a list, without those that only share a slot.
        meet = max(0.0, float((light * (light - 1)).sum()) - mean * total)
        kinds = np.concatenate([np.zeros(len(heavy), np.int32), np.ones(len(sizes), np.int32), [2, 3]]).astype(np.int32)
        whats = np.concatenate([heavy, list(sizes), [0, 0]]).astype(np.int64)
        counts = np.concatenate([slots[heavy], list(sizes.values()), [int(meet), total]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(whats), pa.array(counts)], ["kind", "what", "count"])

    return run


def choose_boundary(sizes: dict[int, int], list_length: float, t: float) -> int:
    """The size up to which all sets together cost least: p (p + 1) / 2 subsets, each a posting, against p lists, each a posting and its other members, which cost SCAN of one."""
    best, cost = 0, 0.0
    change = 0.0
    for n in sorted(sizes):
        p = n - _least(n, t) + 1
        change += sizes[n] * (p * (p + 1) / 2 - p * (1 + SCAN * (list_length - 1)))
        if change < cost:
            best, cost = n, change
    return best


def _least(n, t: float):
    """ceil(t n), exact for t in hundredths."""
    return -(-(n * round(100 * t)) // 100)


def _sign(k: int, t: float, plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, boundary = plan.value
        seen: set[int] = set()
        for batch in batches:
            for a, b, found, out in _hashed(batch.column(1), k):
                rank = (weight[(found % _U(SLOTS)).astype(np.int64)].astype(_U) << _U(58)) | found
                n, cls, keys, subsets = [], [], [], []
                named = batch.column(0)[a:b].is_valid().to_pylist()
                parity: list[np.ndarray] = []
                for i in range(b - a):
                    own = np.unique(rank[out[i] : out[i + 1]])
                    size = len(own)
                    n.append(size)
                    if not size:
                        cls.append(None)
                        parity.append(None)
                        keys.append(None)
                        subsets.append(None)
                        continue
                    plain = own & _U((1 << 58) - 1)
                    c = _class(plain)
                    cls.append(c)
                    width = max(LEAST_BITS, 1 << (2 * size - 1).bit_length())
                    bits = (np.bincount((mix(plain) & _U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
                    parity.append(np.packbits(bits).view(np.int64))
                    if c in seen or not named[i]:  # equal sets of one task enter the lists once, by a row with an id
                        keys.append(None)
                        subsets.append(None)
                        continue
                    seen.add(c)
                    p = size - _least(size, t) + 1
                    keys.append(own[:p].view(np.int64) if size > boundary or size >= t * (boundary + 1) else None)
                    if 2 <= size <= boundary:
                        first = plain[: p + 1]
                        x, y = np.triu_indices(len(first), 1)
                        with np.errstate(over="ignore"):
                            subsets.append(mix(first[x] * _U(0x9E3779B97F4A7C15) + first[y]).view(np.int64))
                    else:
                        subsets.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(subsets, pa.list_(pa.int64()))], ["id", "n", "cls", "parity", "keys", "subsets"])

    return run


def _lists(t: float):
    return lambda batches: _shared(batches, t)


def _shared(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Of the postings (key, cls, n, pos) of a partition that holds whole lists, those of lists of two or more classes, with the list's first class and the number of members that matter after it."""
    parts = [pa.table({c: b.column(i) for i, c in enumerate(("key", "cls", "n", "pos"))}) for b in batches]
    if not parts:
        return
    table = pa.concat_tables(parts)
    key, cls = table["key"].to_numpy(), table["cls"].to_numpy()
    # Which lists repeat is found on the keys alone, before anything is sorted by class.
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((cls[order], key[order]))]
    key, cls, n, pos = key[order], cls[order], table["n"].to_numpy()[order], table["pos"].to_numpy()[order]
    del table, parts
    if not len(key):
        return
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, n, pos = key[new], cls[new], n[new], pos[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([start, [len(key)]]))
    # The first member is the smallest by a hash of its class, the same one in every list that it shares with the others.
    mixed = mix(cls.view(_U))
    least = np.minimum.reduceat(mixed, start)
    head = np.flatnonzero(mixed == np.repeat(least, length))
    main = np.zeros(len(key), bool)
    main[head] = True
    # All pairs with the first member are tried at once. Others can matter later if the next larger or smaller of them is near enough in size.
    rest = np.flatnonzero(~main & np.repeat(length > 2, length))
    rest = rest[np.lexsort((n[rest], key[rest]))]
    again = np.zeros(len(key), bool)
    close = (key[rest][1:] == key[rest][:-1]) & (n[rest][:-1] * 100 >= n[rest][1:] * round(100 * t))
    again[rest[1:][close]] = True
    again[rest[:-1][close]] = True
    # Longer lists than one block are cut into blocks of their members that can matter.
    left = np.add.reduceat(again.astype(np.int64), start)
    # Lists of the same members need to meet once; this names the members.
    of = np.add.reduceat(np.where(again, mix(mixed), _U(0)), start).view(np.int64)
    heads = [np.repeat(x[head], length) for x in (cls, n, pos)]
    low, high = np.minimum(n, heads[1]), np.maximum(n, heads[1])
    keep = ~main & np.repeat(length > 1, length) & (again | (low * 100 >= high * round(100 * t)))
    for i in range(0, len(key), 65_536):
        k = keep[i : i + 65_536]
        cols = [x[i : i + 65_536][k] for x in (key, cls, n, pos, *heads, np.where(again, np.repeat(left, length), 0), np.repeat(of, length))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "cls", "n", "pos", "head", "head_n", "head_pos", "again", "of"])


LISTS = "key long, cls long, n long, pos long, head long, head_n long, head_pos long, again long, of long"


def _may_link(n: Column, pos: Column, m: Column, other: Column, t: float) -> Column:
    """Whether sets of n and m elements that share the ones at pos and other of the order can link. A negative place: unknown."""
    h = round(100 * t)
    most = F.when((pos < 0) | (other < 0), F.least(n, m)).otherwise(F.least(n, m, F.least(pos, other) + F.least(n - pos, m - other)))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * h) & (most * (100 + h) >= (n + m) * h)


def _differ(x: Column, y: Column) -> Column:
    """Bits in which parities differ, the wider one folded to the other's width; 0 if it is wider than twice."""
    wide, narrow = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    half = F.size(narrow)
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = F.when(F.size(wide) == half, wide).otherwise(F.zip_with(F.slice(wide, F.lit(1), half), F.slice(wide, half + 1, half), xor))
    bits = F.aggregate(F.zip_with(folded, narrow, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    return F.when(F.size(wide) <= 2 * half, bits).otherwise(0)


def _near(n: Column, m: Column, x: Column, y: Column, t: float) -> Column:
    """The sets differ in as many elements as their parities differ in bits, or more; links differ in (n + m) (1 - t) / (1 + t) at most."""
    h = round(100 * t)
    return _differ(x, y) * (100 + h) <= (n + m) * (100 - h)


def _class(plain: np.ndarray) -> int:
    """63 bits of a whole set, whatever its order."""
    return int(mix(np.array([mix(plain + _U(len(plain))).sum(dtype=_U)]))[0] >> _U(1))


def _sets(k: int, bits):
    """Whole sets of the documents whose ids may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                slots = (mix(batch.column(0).to_numpy().view(_U)) % _U(MARKS)).astype(np.int64)
                batch = batch.filter(pa.array(bits.value[slots]))
            for a, b, found, out in _hashed(batch.column(1), k):
                rows = [np.unique(found[out[i] : out[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_class, rows)), pa.int64()), pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))], ["cls", "elements"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = [np.unique((mix(b.column(0).to_numpy().view(_U)) % _U(MARKS)).astype(np.int64)) for b in batches]
    if slots:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)))], ["slot"])


#: Slots of the table that says which documents' sets are wanted; shared slots only bring sets that nobody asks for.
MARKS = 1 << 22


class _Verifier:
    """Links among pairs of classes, by their whole sets."""

    def __init__(self, rows: DataFrame, classes: DataFrame, k: int, t: float):
        self.rows, self.classes, self.k, self.t = rows.where("id is not null"), classes, k, t

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n_a, n_b), those whose parities don't rule a link out."""
        first = self.classes.select(F.col("cls").alias("a"), F.col("parity").alias("p_a"))
        second = self.classes.select(F.col("cls").alias("b"), F.col("parity").alias("p_b"))
        return pairs.join(first, "a").join(second, "b").where(_near(F.col("n_a"), F.col("n_b"), F.col("p_a"), F.col("p_b"), self.t)).select("a", "b", "n_a", "n_b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n_a, n_b), those that link, as a kept table."""
        spark = pairs.sparkSession
        near = store.keep(pairs, "pairs")
        wanted = store.keep(near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct().join(self.classes.select("cls", "id"), "cls"), "wanted")
        if wanted.count() <= graph.MOST_BROADCAST:
            rows = self.rows.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi").select("id", "body")
            bits = None
        else:
            rows, bits = self.rows, np.zeros(MARKS, bool)
            for r in wanted.select("id").mapInArrow(_mark, "slot long").distinct().toLocalIterator():
                bits[r["slot"]] = True
        sets = rows.mapInArrow(tidy(_sets(self.k, None if bits is None else spark.sparkContext.broadcast(bits))), "cls long, elements array<long>")
        sets = store.keep(wanted.select("cls").join(sets, "cls").groupBy("cls").agg(F.first("elements").alias("elements")), "sets")
        both = near.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("e_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("e_b")), "b")
        shared = F.size(F.array_intersect("e_a", "e_b"))
        h = round(100 * self.t)
        found = store.keep(both.where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * h).select("a", "b"), "links")
        for done in (near, wanted, sets):
            store.remove(done)
        return found


MET = "key long, a long, b long, n_a long, n_b long"


def _once(found: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each pair, whatever its lists."""
    table = pa.Table.from_batches(found)
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return table.take(pa.array(order[new])).combine_chunks().to_batches()[0]


class _Earlier:
    """Which rows of a task share a long list whose key is smaller than their own."""

    def __init__(self, table: pa.Table, cols: dict[str, np.ndarray]):
        self.cls = cols["cls"]
        lists = table["lists"].chunks
        self.keys = pa.concat_arrays([c.flatten() for c in lists]).to_numpy()
        many = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists]).astype(np.int64)
        self.begin = np.cumsum(many) - many
        # Keys are sorted within each row.
        below = np.concatenate([[0], np.cumsum(self.keys < np.repeat(cols["key"], many))])
        self.smaller = below[self.begin + many] - below[self.begin]
        _, one = np.unique(self.cls, return_index=True)
        within = np.repeat(self.begin[one] - (np.cumsum(many[one]) - many[one]), many[one]) + np.arange(many[one].sum())
        self.held = np.sort(mix(np.repeat(self.cls[one], many[one]).view(_U) ^ mix(self.keys[within].view(_U))))

    def share(self, a: np.ndarray, b: np.ndarray, step: int = 20_000) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a) if len(self.held) else 0, step):
            x, y = a[k : k + step], b[k : k + step]
            n = self.smaller[x]
            pair = np.repeat(np.arange(len(x)), n)
            keys = self.keys[np.repeat(self.begin[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            probe = mix(self.cls[y][pair].view(_U) ^ mix(keys.view(_U)))
            out[k + pair[self.held[np.minimum(np.searchsorted(self.held, probe), len(self.held) - 1)] == probe]] = True
        return out


def _pairs(t: float, every: bool):
    """Pairs of a block of lists whose members are in different components and pass the bounds: all that share no long list of a smaller key, or of each component the one whose parities differ least for its size."""
    h = round(100 * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "x", "y", "cls", "n", "pos", "root", "side")
        parts = [pa.table({c: b.column(i) for i, c in enumerate((*names, "parity", *["lists"] * every))}) for b in batches]
        if not parts:
            return
        table = pa.concat_tables(parts)
        cols = {c: table[c].to_numpy() for c in names}
        earlier = _Earlier(table, cols) if every else None
        flat = pa.concat_arrays([c.flatten() for c in table["parity"].chunks]).to_numpy().view(_U)
        wide = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table["parity"].chunks]).astype(np.int64)
        place = np.cumsum(wide) - wide
        order = np.lexsort((cols["y"], cols["x"], cols["key"]))
        cols, wide, place = {c: v[order] for c, v in cols.items()}, wide[order], place[order]

        def bits(of: np.ndarray, size: int) -> np.ndarray:
            """Parities of members of that width or twice as wide, folded."""
            at = place[of][:, None] + np.arange(size)
            out = flat[at]
            double = wide[of] == 2 * size
            out[double] ^= flat[at[double] + size]
            return out

        def met(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            turn = cls[i] > cls[j]
            a, b = np.where(turn, j, i), np.where(turn, i, j)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cols["key"][i], cls[a], cls[b], n[a], n[b])], ["key", "a", "b", "n_a", "n_b"])

        new = np.ones(len(order), bool)
        new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["x"][1:] != cols["x"][:-1]) | (cols["y"][1:] != cols["y"][:-1])
        starts = np.flatnonzero(new)
        # Rows that follow each one in its block; all blocks' pairs of a distance are tried at once.
        after = np.repeat(np.concatenate([starts[1:], [len(order)]]), np.diff(np.concatenate([starts, [len(order)]]))) - np.arange(len(order)) - 1
        root, n, pos, side, cls = (cols[c] for c in ("root", "n", "pos", "side", "cls"))
        one_block = cols["x"] == cols["y"]
        best, other = np.full(len(order), np.inf), np.full(len(order), -1)
        found: list[pa.RecordBatch] = []
        rows, gap = np.arange(len(order)), 0
        while True:
            gap += 1
            rows = rows[after[rows] >= gap]
            if not len(rows):
                break
            j = rows + gap
            ok = (root[rows] != root[j]) & (one_block[rows] | (side[rows] != side[j]))
            i, j = rows[ok], j[ok]
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j])
            most = np.where((pos[i] < 0) | (pos[j] < 0), lo, np.minimum(lo, rest))
            ok = (lo * 100 >= hi * h) & (most * (100 + h) >= (n[i] + n[j]) * h)
            i, j = i[ok], j[ok]
            size = np.minimum(wide[i], wide[j])
            differ = np.zeros(len(i), np.int64)
            for z in np.unique(size):
                of = np.flatnonzero((size == z) & (np.maximum(wide[i], wide[j]) <= 2 * z))
                differ[of] = np.bitwise_count(bits(i[of], z) ^ bits(j[of], z)).sum(1)
            ok = differ * (100 + h) <= (n[i] + n[j]) * (100 - h)
            i, j, differ = i[ok], j[ok], differ[ok]
            if every:
                new = ~earlier.share(order[i], order[j])
                found.append(met(i[new], j[new]))
                if sum(map(len, found)) > 200_000:
                    yield _once(found)
                    found = []
            elif len(i):
                # Ties go to the pair whose classes' hash is least, the same one in every list.
                far = differ / (n[i] + n[j]) + (mix((cls[i] ^ cls[j]).view(_U)) >> _U(12)).astype(float) * 2.0**-72
                for p, q in ((i, j), (j, i)):
                    closer = far < best[p]
                    best[p[closer]], other[p[closer]] = far[closer], q[closer]
        if sum(map(len, found)):
            yield _once(found)
        rows = np.flatnonzero(other >= 0)
        rows = rows[np.lexsort((best[rows], root[rows], np.searchsorted(starts, rows, "right")))]
        if len(rows):
            block = np.searchsorted(starts, rows, "right")
            first = np.ones(len(rows), bool)
            first[1:] = (block[1:] != block[:-1]) | (root[rows][1:] != root[rows][:-1])
            yield met(rows[first], other[rows[first]])

    return run


def _halved(parity: Column, n: Column) -> Column:
    """The parity folded to a bit or more for each element, which tells strangers apart in half the room."""
    half = (F.size(parity) / 2).cast("int")
    folded = F.zip_with(F.slice(parity, F.lit(1), half), F.slice(parity, half + 1, half), lambda a, b: a.bitwiseXOR(b))
    return F.when((half * 64 >= LEAST_BITS) & (half * 64 >= n), folded).otherwise(parity)


def _meet(waiting: DataFrame, classes: DataFrame, roots: DataFrame, t: float, block: int, long: int, every: bool) -> DataFrame:
    """Pairs of the lists' members that are in different components by now, met in blocks."""
    side = F.broadcast if roots.count() <= graph.MOST_BROADCAST else lambda df: df
    rooted = waiting.join(side(roots.select(F.col("node").alias("cls"), "root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("again") / block).cast("long")
    cheap = classes.select("cls", _halved(F.col("parity"), F.col("n")).alias("parity"))
    rooted = rooted.join(mixed, "key", "left_semi")
    if every:
        rooted = store.keep(rooted, "crossing")
        longer = rooted.where(F.col("again") > long).groupBy("cls").agg(F.sort_array(F.collect_list("key")).alias("lists"))
        cheap = cheap.join(longer, "cls", "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<bigint>")))
    dealt = rooted.join(cheap, "cls").withColumn("mine", F.pmod(F.xxhash64("cls"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "cls", "n", "pos", "root", F.col("mine").alias("side"), "parity", *["lists"] * every)
    return dealt.repartition("key", "x", "y").mapInArrow(tidy(_pairs(t, every)), MET)


def join(docs: DataFrame, *, k: int = 5, threshold: float = 0.75, block: int = 1024, long: int = 32, few: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id, the smallest id that links reach, of each row."""
    spark, t = docs.sparkSession, threshold
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    # At most SLOTS slots, a histogram and two sums.
    counted = rows.select("body").mapInArrow(tidy(_count(k)), "kind int, what long, count long").groupBy("kind", "what").agg(F.sum("count").alias("count"), F.count("*").alias("tasks"))
    weight, sizes, meet, total, tasks = np.zeros(SLOTS, np.uint8), {}, 0, 0, 1
    for r in counted.toLocalIterator():
        if r["kind"] == 0:
            weight[r["what"]] = min(63, int(r["count"]).bit_length())
        elif r["kind"] == 1:
            sizes[r["what"]] = r["count"]
        elif r["kind"] == 2:
            meet, tasks = r["count"], r["tasks"]
        else:
            total = r["count"]
    boundary = choose_boundary({n: c for n, c in sizes.items() if n}, 1 + tasks * meet / max(total, 1), t)
    plan = spark.sparkContext.broadcast((weight, boundary))
    signed = store.keep(rows.mapInArrow(tidy(_sign(k, t, plan)), SIGNED), "signed")
    live = signed.where("id is not null")
    # One row for each set: its smallest id; n and parity follow from the set.
    classes = store.keep(live.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("parity").alias("parity")), "classes")
    members = store.keep(signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")), "members")
    singles = live.where("keys is not null").select("cls", "n", F.posexplode("keys").alias("pos", "key")).select("key", "cls", "n", F.col("pos").cast("long"))
    doubles = live.where("subsets is not null").select("cls", "n", F.explode("subsets").alias("key")).select("key", "cls", "n", F.lit(-1).cast("long").alias("pos"))
    # Keys of the two kinds never meet: places tell them apart within a key that both have by chance, which costs a pair at most.
    postings = singles.unionByName(doubles).repartition("key")
    lists = store.keep(postings.mapInArrow(tidy(_lists(t)), LISTS), "lists")
    store.remove(signed)
    check = _Verifier(rows, classes, k, t)
    tied = lists.where(_may_link(F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_pos"), t))
    turn = F.col("cls") > F.col("head")
    tied = tied.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"), F.when(turn, F.col("head_n")).otherwise(F.col("n")).alias("n_a"), F.when(turn, F.col("n")).otherwise(F.col("head_n")).alias("n_b"))
    links = check.links(check.near(tied.distinct()))
    several = lists.where("again > 0")
    one = several.groupBy("again", "of").agg(F.min("key").alias("key")).select("key")
    waiting = store.keep(several.join(one, "key", "left_semi").select("key", "cls", "n", "pos", "again"), "waiting")
    store.remove(lists)
    tried, every, done = None, False, False
    while not done:
        roots = store.keep(graph.components(links, "a", "b"), "roots")
        met = store.keep(_meet(waiting, classes, roots, t, block, long, every), "met")
        new = met.select("a", "b", "n_a", "n_b").distinct()
        if tried is not None:
            new = new.join(tried, ["a", "b"], "left_anti")
        more = check.links(check.near(new))
        links = links.unionByName(more)
        before, done = waiting, every
        if not done:  # lists without a pair now won't have one later
            waiting = store.keep(before.join(met.select("key").distinct(), "key", "left_semi"), "waiting")
            tried = met.select("a", "b") if tried is None else tried.unionByName(met.select("a", "b"))
            every = more.count() < max(1, few)
        store.remove(before)
        store.remove(roots)
    final = graph.components(links, "a", "b")
    # Components are named by the smallest id of all their classes' rows.
    rooted = classes.select("cls", "id").join(final.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "id", F.coalesce("root", "cls").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("cls", "component_id")
    linked = members.where("cls is not null").join(named, "cls").select("id", "n", "component_id")
    alone = members.where("cls is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
