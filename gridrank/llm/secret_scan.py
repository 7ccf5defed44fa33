"""Secret scan: fixed patterns, and character Markov models for what no pattern names.

Two first-order models over printable characters, one of random strings and one
of ordinary identifiers, are trained from labelled samples. A candidate, a run
of at least `least` token characters, is a secret if the logarithm of the ratio
of its likelihoods is at least `threshold`. What the patterns find is left to
them; the parts of a run before, between and after their spans are candidates of
their own. From 11 characters on the score alone decides: ordinary capitals of 6
to 10 reach it now and then. All work is done by DataFrame functions.

Offsets count code points, ends are exclusive, and a span is the whole match. A
null or empty text has no spans; texts are scanned whole; each of repeated rows
gets its row, null ids too. An empty table gives an empty result. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of the open pattern (1 character or more) with enough characters is a match of this one and the other way round, as a run can't be entered late and still be long enough.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Symbols from ! to ~.
SYMBOLS = 94


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of all pairs of symbols, row by row."""

    ratios: tuple[float, ...]
    threshold: float = 15.0
    least: int = 11

    @property
    def pattern(self) -> str:
        return rf"[A-Za-z0-9+/_=.-]{{{self.least},}}"

    def score(self, value: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratios)), ",").cast("array<double>")
        steps = _steps(value, lambda a, b: F.element_at(table, (F.ascii(a) - 33) * SYMBOLS + F.ascii(b) - 32))
        return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def _steps(value: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(a, b) of each two characters that follow one another, in time proportional to their number."""
    each, n = F.split(value, ""), F.greatest(F.length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(each, F.lit(1), n), F.slice(each, F.lit(2), n), made)


def train(samples: DataFrame, threshold: float = 15.0, least: int = 11, lean: float = 5.0) -> Markov:
    """From rows (value string, random boolean). Pairs are counted by Spark; at most 2 * 94 * 94 counts come to the driver."""
    steps = _steps(F.col("value"), lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))
    pairs = samples.where(F.length("value") > 1).select("random", F.inline(steps))
    counts = {(r["random"], r["a"] - 33, r["b"] - 33): r["n"] for r in pairs.where("a between 33 and 126 and b between 33 and 126").groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    ratios = []
    single = {kind: [1 + sum(counts.get((kind, a, b), 0) for a in range(SYMBOLS)) for b in range(SYMBOLS)] for kind in (False, True)}
    share = {kind: [c / sum(single[kind]) for c in single[kind]] for kind in single}
    for a in range(SYMBOLS):
        seen = {kind: sum(counts.get((kind, a, b), 0) for b in range(SYMBOLS)) for kind in single}
        for b in range(SYMBOLS):
            # Pairs lean on the share of their second symbol, as if it had followed `lean` times more.
            ordinary, random = (math.log((counts.get((kind, a, b), 0) + lean * share[kind][b]) / (seen[kind] + lean)) for kind in (False, True))
            ratios.append(random - ordinary)
    return Markov(tuple(ratios), threshold, least)


def labelled_samples(docs: DataFrame, *, most_docs: int = 1000, random: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled values: `random` strings in each of three alphabets, and the words of `most_docs` documents, spread by a hash of their ids, without what the patterns find there."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    made = spark.range(random).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 32)))).alias("value"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    chosen = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_docs)
    some = texts.join(F.broadcast(chosen), "id")  # most_docs ids at most
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.explode(F.split(plain, r"[^A-Za-z0-9+/_=.-]+")).alias("value")).where(F.length("value") > 1)
    return made.select("value", F.lit(True).alias("random")).unionByName(words.select("value", F.lit(False).alias("random")))


def _spans(body: Column, pattern: str, kind: int, may: Column, good) -> Column:
    """Spans of the pattern's matches for which good(match) holds; `may` is a cheap condition that every text with a match meets."""
    found = F.zip_with(F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), (hit.isNotNull() & good(hit)).alias("good")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        more = F.concat(acc["found"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["good"], more).otherwise(acc["found"]).alias("found"))

    return F.when(may & body.rlike(pattern), F.aggregate(found, begin, add, lambda acc: acc["found"])).otherwise(F.array().cast(SPANS))


def _text(spans: Column) -> Column:
    """kind:start:end, by start and then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blank(body: Column, spans: Column) -> Column:
    """The text with spaces for the characters of the spans, which come by start."""

    def add(acc: Column, s: Column) -> Column:
        before = body.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        spaces = F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], acc["at"]))
        return F.struct(F.concat(acc["out"], before, spaces).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, begin, add, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))


def with_spans(docs: DataFrame, model: Markov, text: Column, base: str = "base_spans", found: str = "all_spans") -> DataFrame:
    """docs with two columns: spans of the patterns, and all spans; both ordered by start, then kind."""
    body = F.coalesce(text, F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 12
    always = lambda hit: F.lit(True)
    out = docs.withColumn(base, F.array_sort(F.concat(
        _spans(body, ASSIGN, 0, F.contains(body, F.lit("=")) | F.contains(body, F.lit(":")), value),
        _spans(body, ACCESS, 1, F.contains(body, F.lit("AKIA")), always),
        _spans(body, HEX, 2, F.lit(True), always),
    )))
    out = out.withColumn("__rest", F.when(F.size(base) > 0, _blank(body, F.col(base))).otherwise(body))
    more = _spans(F.col("__rest"), model.pattern, 3, F.lit(True), lambda hit: model.score(hit) >= model.threshold)
    return out.withColumn(found, F.array_sort(F.concat(F.col(base), more))).drop("__rest")


def scan(docs: DataFrame, model: Markov, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the patterns' spans, base_sha256, all spans and n_markov of each row."""
    rows = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), model, F.col("body"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(F.col("base_spans"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_text(F.col("base_spans")), 256).alias("base_sha256"), _text(F.col("all_spans")).alias("spans"), count(F.col("all_spans"), 3).alias("n_markov"))


def redact(docs: DataFrame, model: Markov, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, or run of spans that touch, replaced by `mark`; a null text stays null."""
    body = F.col(text_col)
    spans, names = F.col("__all_spans"), docs.columns

    def add(acc: Column, s: Column) -> Column:
        done = F.greatest(acc["at"], F.lit(0))
        part = F.concat(acc["out"], body.substr(done + 1, s["start"] - done), F.lit(mark))
        return F.struct(F.when(s["start"] > acc["at"], part).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(-1).alias("at"))
    clean = F.aggregate(spans, begin, add, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))
    rows = with_spans(docs, model, body, "__base_spans", "__all_spans")
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(body)).select(*names)
