"""I-Match fingerprints: hashes of randomised subsets of a document's telling terms.

Terms are runs of characters other than white space, with A-Z read as a-z. The
lexicon holds those whose inverse document frequency ln(N / df) lies within a
band; as each is in a share of all documents, it can't outgrow the mean number
of terms of a document divided by that share, and goes to every task. A random
partition parts the lexicon into 2**level subsets; a fingerprint holds, for the
level at which a subset keeps one or two of the document's terms, the one before
and the two after, the hashes of its sorted distinct terms in the first `subsets`. Texts
with fewer than `few` terms of the band use all their terms.

The likeness of two fingerprints is the share of equal hashes among the subsets,
on levels that both have, in which either has terms; equal fingerprints have 1.
Equal texts have equal fingerprints.

Documents follow one another by descending id, null ids last, equal ids by a
hash of their texts; after the last comes the first. A document's edited text is
its own with the last third of its code points replaced by as many of the next
one's first. Ids alone decide the partitions, each of which gets the first
document of the next as well, so that texts move once and no partition waits for
another. Null texts are empty; empty texts have no terms and the same
fingerprint. Texts are read whole; repeated rows each get a row; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrank.llm.kernels import mix, text_chunks, tidy, words

_U = np.uint64
#: So many levels in a row have hashes in a fingerprint.
LEVELS = 4


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text, sorted, and the texts' offsets among them."""
    for a, b, data, at in text_chunks(column):
        _, _, hashes, of = words(data, at)
        parts = [np.unique(hashes[of[i] : of[i + 1]]) for i in range(b - a)]
        yield np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies within a task."""
    terms, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    for batch in batches:
        for found, _ in _terms(batch.column(0)):
            more, n = np.unique(found, return_counts=True)
            both = np.concatenate([terms, more])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, n])[order]
            start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            terms, counts = both[start], np.add.reduceat(n, start) if len(start) else n
    for i in range(0, len(terms), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["term", "df"])


def lexicon(texts: DataFrame, least_share: float, most_share: float) -> np.ndarray:
    """Sorted hashes of the terms in that share of the texts, and in two at least."""
    n = texts.count()
    df = texts.mapInArrow(tidy(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = df.where((F.col("df") >= max(2, math.ceil(least_share * n))) & (F.col("df") <= most_share * n)).select("term").toArrow()
    return np.sort(band["term"].to_numpy().astype(np.int64).view(_U))


class Prints:
    """Levels and hashes of a run of texts."""

    def __init__(self, level: np.ndarray, hashes: np.ndarray):
        self.level, self.hashes = level, hashes

    @classmethod
    def of(cls, column: pa.Array, band: np.ndarray, subsets: int, few: int) -> Prints:
        levels, all_hashes = [], []
        for terms, at in _terms(column):
            n = len(at) - 1
            doc = np.repeat(np.arange(n), np.diff(at))
            if len(band):
                known = band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms
            else:
                known = np.zeros(len(terms), bool)
            sparse = np.bincount(doc[known], minlength=n) < few
            keep = known | sparse[doc]
            terms, doc = terms[keep], doc[keep]
            m = np.bincount(doc, minlength=n)
            level = np.floor(np.log2(np.maximum(m, 1))).astype(np.int64) - 1
            out = np.zeros((n, LEVELS, subsets), np.uint32)
            dealt = mix(terms ^ _U(0x5851F42D4C957F2D))
            for k in range(LEVELS):
                part = (dealt & ((_U(1) << np.maximum(level[doc] + k, 0).astype(_U)) - _U(1))).astype(np.int64)
                own = np.flatnonzero((part < subsets) & (level[doc] + k >= 0))
                group = doc[own] * subsets + part[own]
                order = np.lexsort((terms[own], group))
                group, sorted_terms = group[order], terms[own][order]
                start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
                if not len(start):
                    continue
                rank = np.arange(len(group)) - np.repeat(start, np.diff(np.concatenate([start, [len(group)]])))
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(mix(sorted_terms + rank.astype(_U) * _U(0x9E3779B97F4A7C15)), start)
                # 0 stands for a subset without terms.
                out[group[start] // subsets, k, group[start] % subsets] = np.maximum(mix(sums) >> _U(32), _U(1)).astype(np.uint32)
            levels.append(np.where(m > 0, level, -9))
            all_hashes.append(out)
        return cls(np.concatenate(levels), np.concatenate(all_hashes)) if levels else cls(np.zeros(0, np.int64), np.zeros((0, LEVELS, subsets), np.uint32))

    def strings(self) -> list[str]:
        return [f"{lv}:{h.astype('>u4').tobytes().hex()}" if lv > -9 else "" for lv, h in zip(self.level.tolist(), self.hashes, strict=True)]

    def rows(self, which: slice) -> Prints:
        return Prints(self.level[which], self.hashes[which])

    def likeness(self, other: Prints) -> np.ndarray:
        equal, used = np.zeros(len(self.level)), np.zeros(len(self.level))
        for i in range(LEVELS):
            for j in range(LEVELS):
                a, b = self.hashes[:, i], other.hashes[:, j]
                on = (self.level + i == other.level + j)[:, None] & ((a > 0) | (b > 0))
                equal += (on & (a == b)).sum(1)
                used += on.sum(1)
        same = (self.level == other.level) & (self.hashes == other.hashes).all(axis=(1, 2))
        return np.where(same, 1.0, equal / np.maximum(used, 1))


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _print(band, subsets: int, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []

        def made(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            """Of all rows but the last, each of which is followed by the next."""
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:], strict=False)]
            prints = Prints.of(pa.array(texts, pa.string()), band.value, subsets, few)
            changed = Prints.of(pa.array(edited, pa.string()), band.value, subsets, few)
            own, after = prints.rows(slice(0, -1)), prints.rows(slice(1, None))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(own.strings()),
                    pa.array(changed.strings()),
                    pa.array(own.likeness(changed)),
                    pa.array(own.likeness(after)),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for s in range(0, len(batch), 1000):
                part = batch.slice(s, 1000)
                own = part.column(2).to_pylist()
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                if own.count(True) < len(own):  # the first of the next partition ends the run
                    rows = waiting + rows[: own.index(False) + 1]
                    if len(rows) > 1:
                        yield made(rows)
                    for _ in batches:  # what else was lent: rows with the same id
                        pass
                    return
                rows = waiting + rows
                if len(rows) > 1:
                    yield made(rows)
                waiting = rows[-1:]

    return run


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above an id, by two steps over about the root of their number; a null id comes last."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    every = F.lit(bounds[::step])
    upper = F.size(F.filter(every, lambda b: b > id_))
    part = F.slice(F.lit(bounds), (upper - 1) * step + 1, step)
    found = F.when(upper == 0, 0).otherwise((upper - 1) * step + F.size(F.filter(part, lambda b: b > id_)))
    return F.when(id_.isNull(), len(bounds)).otherwise(found)


def fingerprints(docs: DataFrame, *, least_share: float = 0.0005, most_share: float = 0.25, subsets: int = 20, few: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and edited text, and their likeness to each other and to the next row's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    band = spark.sparkContext.broadcast(lexicon(rows.select("body"), least_share, most_share))
    parts = max(1, rows.rdd.getNumPartitions())
    cuts = rows.select(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or ()), reverse=True)
    dealt = rows.withColumn("bucket", _bucket(F.col("id"), bounds))
    # One row for each bucket: the first id in it, and the bucket before it that isn't empty.
    first = sorted((r["bucket"], r["id"]) for r in dealt.groupBy("bucket").agg(F.max("id").alias("id")).collect())
    before = [(i, first[k - 1][0]) for k, (_, i) in enumerate(first)]
    heads = spark.createDataFrame(before, "first long, goes int")
    own = dealt.select("id", "body", F.lit(True).alias("own"), "bucket")
    lent = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("first"))).select("id", "body", F.lit(False).alias("own"), F.col("goes").alias("bucket"))
    ordered = own.unionByName(lent).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(F.desc("own"), F.desc_nulls_last("id"), F.xxhash64("body"))
    return ordered.select("id", "body", "own").mapInArrow(tidy(_print(band, subsets, few)), RESULT).withColumnRenamed("id", id_col)
