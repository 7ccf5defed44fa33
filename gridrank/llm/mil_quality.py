"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `words_each` words. Each passage is encoded
by h = tanh(W x + b), where x holds square roots of the frequencies of its bytes
and of its hashed words and a few ratios. Gated attention, w . (tanh(V h) *
sigmoid(U h)), gives the passages weights by softmax, and the weighted sum of
their encodings is scored by a logistic layer. All parts are learned together
from document labels alone.

The model is fitted on the driver on a bounded sample: of each label at most
`most_docs` labelled documents of at most `most_bytes` bytes, the first by a hash
of their ids, up to `most_passages` passages of each, evenly spread. Scoring
reads every passage of every text. Null and empty texts are one passage without
words and get a score too. Repeated rows and null ids each get their row; an
empty table gives an empty result. Where the sample lacks a label, all scores
are 0.5. Of labelled rows that repeat an id the first text
in order is used. Null labels are not used; of contradicting labels of a document the lower counts.
Labels, lang, source and ids are no inputs; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrank.llm.kernels import text_chunks, tidy, words

N_WORDS = 256
N_RATIOS = 6
N_FEATURES = 256 + N_WORDS + N_RATIOS
_KIND = np.zeros((256, 3), np.float32)  # upper case, digit, other ASCII that is visible
for _c in range(33, 127):
    _KIND[_c, 0 if 65 <= _c <= 90 else 1 if 48 <= _c <= 57 else 2] = not 97 <= _c <= 122


def passages(data: np.ndarray, at: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of these texts, and the texts' offsets among them."""
    starts, ends, hashes, of = words(data, at)
    n = np.diff(of)
    many = np.maximum(1, -(-n // words_each))
    out = np.concatenate([[0], np.cumsum(many)])
    total = int(out[-1])
    x = np.zeros((total, N_FEATURES), np.float32)
    doc = np.repeat(np.arange(len(n)), n)
    passage = out[doc] + (np.arange(len(hashes)) - of[doc]) // words_each
    sizes = ends - starts
    # Bytes of words only; white space is not a passage's own.
    where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    letters = np.bincount(np.repeat(passage, sizes) * 256 + data[where], minlength=total * 256).reshape(total, 256).astype(np.float32)
    spoken = np.bincount(passage * N_WORDS + (hashes % np.uint64(N_WORDS)).astype(np.int64), minlength=total * N_WORDS).reshape(total, N_WORDS).astype(np.float32)
    length, count = np.maximum(letters.sum(1, keepdims=True), 1), np.maximum(spoken.sum(1, keepdims=True), 1)
    x[:, :256] = np.sqrt(letters / length)
    x[:, 256 : 256 + N_WORDS] = np.sqrt(spoken / count)
    x[:, -6:-3] = letters @ _KIND / length
    order = np.lexsort((hashes, passage))
    new = np.ones(len(order), bool)
    new[1:] = (passage[order][1:] != passage[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    x[:, -3] = np.bincount(passage[order][new], minlength=total) / count[:, 0]
    x[:, -2] = np.minimum(length[:, 0] / count[:, 0] / 10, 4)
    x[:, -1] = count[:, 0] / words_each
    return x, out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """Parameters and the forward and backward passes over bags laid end to end."""

    def __init__(self, seed: int = 0, hidden: int = 32, gate: int = 16):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(N_FEATURES, hidden) * 3, "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "d": np.zeros(1, np.float32)}

    def undecided(self) -> Model:
        """The model that gives every bag 0.5: nothing was there to learn from."""
        self.p["c"][:] = 0
        return self

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = ((t * s) @ p["w"])[:, 0]
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        a = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        a /= np.add.reduceat(a, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return _sigmoid((z @ p["c"])[:, 0] + p["d"][0]), (h, t, s, a, z, bag)

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, t, s, a, z, bag) = self.forward(x, at)
        g = ((score - y) * weight / weight.sum()).astype(np.float32)
        dz = g[:, None] * p["c"][:, 0]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
        dts = de[:, None] * p["w"][:, 0]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de[:, None], "c": z.T @ g[:, None], "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                of = order[i : i + batch]
                at = np.concatenate([[0], np.cumsum([len(bags[j]) for j in of])])
                grads = self.gradients(np.concatenate([bags[j] for j in of]), at, y[of], weight[of])
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, most_docs: int = 1500, most_bytes: int = 65_536, most_passages: int = 16, words_each: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    usable = marked.where(~held_out(F.col("id")))
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most_docs) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most_docs rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).where(F.octet_length("body") <= most_bytes)
    # Of rows that repeat an id, the first text; so each label has most_docs rows at most.
    rows = texts.join(sample, "id").groupBy("id", "label").agg(F.min("body").alias("body")).collect()
    rows = sorted((r["id"], r["label"], r["body"]) for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y)) < 2:
        return Model().undecided()
    bags = []
    for _, _, data, at in text_chunks(pa.array([r[2] for r in rows])):
        x, out = passages(data, at, words_each)
        for i in range(len(out) - 1):
            n = out[i + 1] - out[i]
            bags.append(x[out[i] + np.unique(np.linspace(0, n - 1, min(n, most_passages)).astype(int))])
    model = Model()
    model.fit(bags, y)
    return model


def _score(model, words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in text_chunks(batch.column(1), 1 << 20):
                x, out = passages(data, at, words_each)
                score, _ = model.value.forward(x, out)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(score.astype(np.float64))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, words_each: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(tidy(_score(docs.sparkSession.sparkContext.broadcast(model), words_each)), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _accept(model, words_each: int, at_least: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in text_chunks(batch.column(column), 1 << 20):
                x, out = passages(data, at, words_each)
                found, _ = model.value.forward(x, out)
                empty = np.add.reduceat(x[:, 256 : 256 + N_WORDS].sum(1), out[:-1]) == 0
                yield batch.slice(a, b - a).filter(pa.array((found >= at_least) | empty))

    return run


def accepted(docs: DataFrame, model: Model, *, words_each: int = 64, at_least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts score `at_least` or have no words, with all their columns."""
    column = docs.columns.index(text_col)
    return docs.mapInArrow(tidy(_accept(docs.sparkSession.sparkContext.broadcast(model), words_each, at_least, column)), docs.schema)
