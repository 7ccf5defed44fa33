"""Mixture-controlled packing of documents into sequences of a fixed number of tokens.

Each source is a queue of tokens: its documents one after another, in the order
of the input partitions. Windows are the sequences. Deficit round-robin fills
them in slots of `chunk` tokens: each queue's deficit grows by its weight, and
when it reaches half a slot the queue is served one and pays for it. So chunk k
of a queue is due at (k + 1/2) / weight, and the stream holds the chunks by the
time they are due, ties to the first queue. Every queue with a chunk left is at
any time within half a slot of what it is due, however small its share is, and
deficits never start anew; when a queue runs dry the others go on as before.

The number of chunks of a queue due before some time follows from its weight, so
a chunk's place in the stream is a sum over the queues, in whole numbers, with no
table of slots. Queue positions need only token totals by partition and source:
partitions work alone.

Without a `target` all queues end together. With one, sources that it doesn't
name or gives weight 0 follow after all others, in proportion to their tokens.
Weights are kept to 2**-30 of the largest.

Null texts are empty; an empty document is its end id alone. A null source is a
source. Sources beyond the `most_queues` largest share a queue, partition by
partition and there source by source, with the sum of their weights; those that
have no weight in a `target` share another one. Rows may repeat: each is packed. An empty table gives an empty result. Only the named
columns are read. Ids may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrank.llm import store
from gridrank.llm.bpe import encoder
from gridrank.llm.kernels import tidy

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: So many rows of offsets at most go to every executor; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def round_robin(quota: np.ndarray) -> np.ndarray:
    """The queue of each of sum(quota) slots: the largest deficit is served, ties to the first; queue i gets quota[i] slots. One period, slot by slot; Schedule needs no table of slots."""
    total, deficit = int(quota.sum()), np.zeros(len(quota), np.int64)
    out = np.empty(total, np.int32)
    for s in range(total):
        deficit += quota
        out[s] = i = int(np.argmax(deficit))
        deficit[i] -= total
    return out


def _whole(weights: np.ndarray, most: int = 1 << 30) -> np.ndarray:
    """Weights as whole numbers of at most `most`, positive ones as 1 or more."""
    w = np.asarray(weights, float)
    if len(w) and w.max() > 0 and (w.max() > most or (w != np.rint(w)).any()):
        w = np.where(w > 0, np.maximum(1, w * (most / w.max())), 0)
    return np.rint(w).astype(np.int64)


class Schedule:
    """Where the chunks of each queue lie in the stream. Places of slots * 64 chunks and queues are worked out at once."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, chunk: int = 256, slots: int = 4096):
        self.chunk, self.slots = chunk, slots
        self.totals = np.array(totals, np.int64)
        self.total = int(self.totals.sum())
        own = _whole(-(-self.totals // chunk))
        given = own if weights is None else np.array(weights, float)
        if not np.isfinite(given).all() or (given < 0).any():
            raise ValueError("weights must be finite and not negative")
        #: Queues without a weight come after the others, by their own sizes.
        self.late = given <= 0
        self.weights = np.where(self.late, own, own if weights is None else _whole(given))

    def place(self, queue: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Place in the stream of the first token of these chunks."""
        out = np.zeros(len(chunk), np.int64)
        every = np.arange(len(self.totals))
        step = max(1, self.slots * 64 // max(1, len(every)))
        for s in range(0, len(chunk), step):
            q, k = np.asarray(queue[s : s + step])[:, None], np.asarray(chunk[s : s + step], np.int64)[:, None]
            # The chunks j of a queue p with (2 j + 1) / weights[p] before (2 k + 1) / weights[q], or equal and p before q.
            last = ((2 * k + 1) * self.weights - (every >= q)) // self.weights[q]
            before = np.minimum((last + 1) // 2 * self.chunk, self.totals)
            before = np.where(self.late == self.late[q], before, np.where(self.late[q], self.totals, 0))
            out[s : s + step] = before.sum(axis=1)
        return out


def cut(schedule: Schedule, window: int, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start in it, length and place in the stream of the pieces of documents at `start` of their queues."""
    c = schedule.chunk
    first, many = start // c, (start + n - 1) // c - start // c + 1
    doc = np.repeat(np.arange(len(n)), many)
    chunk = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    a = np.maximum(chunk * c, start[doc])
    b = np.minimum((chunk + 1) * c, (start + n)[doc])
    place = schedule.place(queue[doc], chunk) + a - chunk * c
    over = place // window != (place + b - a - 1) // window  # a chunk is shorter than a window, so in two at most
    edge = (place // window + 1) * window - place
    twice = 1 + over
    source = np.repeat(np.arange(len(a)), twice)
    second = np.concatenate([[False], source[1:] == source[:-1]]) if len(source) else np.zeros(0, bool)
    head = over[source] & ~second
    a2, p2 = a[source] + np.where(second, edge[source], 0), place[source] + np.where(second, edge[source], 0)
    b2 = np.where(head, a[source] + edge[source], b[source])
    doc = doc[source]
    if len(doc):  # what goes on in the same sequence is one piece
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (p2[1:] != p2[:-1] + (b2 - a2)[:-1]) | (p2[1:] // window != p2[:-1] // window)
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(doc)]]) - 1
        doc, a2, b2, p2 = doc[at], a2[at], b2[stop], p2[at]
    return doc, a2 - start[doc], b2 - a2, p2


def _tokenise(tokenizer: str, ranks: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bucket, filled = encoder(tokenizer, ranks), TaskContext.get().partitionId(), {}
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for a, b, ids, many in enc.encode(batch.column(2)):
                n = many + 1
                stop = np.cumsum(n)
                body = np.full(int(stop[-1]), end_id, "<u4")
                keep = np.ones(len(body), bool)
                keep[stop - 1] = False
                body[keep] = ids
                starts = np.empty(b - a, np.int64)
                for i, s in enumerate(sources[a:b]):
                    starts[i] = have = filled.get(s, 0)
                    filled[s] = have + int(n[i])
                small = body.max() < 1 << 16
                width = 2 if small else 4
                edges = np.concatenate([[0], stop]) * width
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(body.astype("<u2") if small else body)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sources[a:b], pa.string()), pa.array(np.full(b - a, bucket, np.int32)), pa.array(starts), pa.array(n), packed], ["id", "source", "bucket", "start", "n", "ids"])

    return run


def _emit(schedule, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = schedule.value
        for whole in batches:
            for from_row in range(0, len(whole), 1000):
                batch = whole.slice(from_row, 1000)
                n, start, queue = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "start", "queue"))
                doc, at, length, place = cut(plan, window, queue, start, n)
                crc = np.empty(len(doc), np.int64)
                ids = batch.column(batch.schema.get_field_index("ids"))
                views, last = memoryview(b""), -1
                for k, (d, x, m) in enumerate(zip(doc.tolist(), at.tolist(), length.tolist(), strict=True)):
                    if d != last:
                        raw, last = ids[d].as_buffer(), d
                        views = memoryview(np.frombuffer(raw, "<u2" if raw.size == 2 * n[d] else "<u4").astype("<u4")).cast("B")
                    crc[k] = zlib.crc32(views[4 * x : 4 * (x + m)])
                id_ = batch.column(batch.schema.get_field_index("id")).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([id_, *map(pa.array, (at, length, crc, n[doc], place // window, place % window))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, *, target: dict[str | None, float] | None = None, window: int = 1024, chunk: int = 256, end_id: int = 0, most_queues: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece of a document. `target` gives each source's weight; without it, the sources' shares of all slots."""
    if window % chunk:
        raise ValueError("window must be a multiple of chunk")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("body"))
    tokens = store.keep(rows.mapInArrow(tidy(_tokenise(tokenizer, ranks, end_id)), "id long, source string, bucket int, start long, n long, ids binary"), "tokens")
    sums = store.keep(tokens.groupBy("source", "bucket").agg(F.sum("n").alias("tokens")), "token_sums")
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    largest = by_source.orderBy(F.desc("tokens"), F.asc_nulls_first("source")).limit(most_queues).collect()
    rest = sums.agg(F.sum("tokens")).first()[0] or 0
    totals = [r["tokens"] for r in largest]
    # Sources that share a queue: those with a weight, and the others.
    alone = {r["source"] for r in largest}
    weighed = spark.createDataFrame([(k, float(x)) for k, x in (target or {}).items() if x > 0 and k not in alone], "name string, weight double")
    pooled = by_source.join(F.broadcast(weighed), F.col("source").eqNullSafe(F.col("name"))).select("source", "tokens", "weight")
    pool_tokens, pool_weight = pooled.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    totals += [pool_tokens, rest - sum(totals) - pool_tokens]
    weights = None if target is None else [float(target.get(r["source"], 0.0)) for r in largest] + [pool_weight, 0.0]
    schedule = spark.sparkContext.broadcast(Schedule(totals, weights, chunk))
    queues = spark.createDataFrame([(r["source"], i) for i, r in enumerate(largest)], "of string, queue int").unionByName(weighed.select(F.col("name").alias("of"), F.lit(len(largest)).alias("queue")))
    # One row for each source and input partition.
    queued = sums.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "bucket", "tokens", F.coalesce("queue", F.lit(len(largest) + 1)).alias("queue"))
    before = Window.partitionBy("queue").orderBy("bucket", F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = store.keep(queued.select(F.col("source").alias("of"), F.col("bucket").alias("in"), "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "offsets")
    small = F.broadcast(offsets) if offsets.count() <= MOST_BROADCAST else offsets
    placed = tokens.join(small, (F.col("bucket") == F.col("in")) & F.col("source").eqNullSafe(F.col("of"))).select("id", "n", (F.col("start") + F.col("base")).alias("start"), "queue", "ids")
    return placed.mapInArrow(tidy(_emit(schedule, window)), PIECES).withColumnRenamed("id", id_col)
