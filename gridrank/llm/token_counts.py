"""Token counts by a digest cache.

Each text is keyed by the SHA-256 of its normalised content (a null is the empty
text; nothing else is changed, as any change could change the count) and by a
digest of the tokenizer's files. Keys are joined to the stored counts, one text
of every missing key is encoded, the new counts are appended to the cache, and
every row takes its count from there. Keys that more than one row of HOT has are
fewer than HOT, so their counts go to every executor; their rows are spread
over the tasks in which the others meet the cache.

Nulls and empty texts count no tokens; texts of any length are encoded whole.
Repeated rows are encoded once and each gets its row; ids may be null or repeat.
An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrank.llm import store
from gridrank.llm.bpe import encoder
from gridrank.llm.kernels import tidy

#: A key is hot if it has more than this part of the rows; so many keys at most can be.
HOT = 1000
CACHE = "version string, digest binary, n_tokens long"


def version_digest(*paths: str) -> str:
    """Digest of the tokenizer: other files, other counts."""
    h = hashlib.sha256()
    for p in paths:
        with open(p, "rb") as f:
            h.update(hashlib.sha256(f.read()).digest())
    return h.hexdigest()


def _encode(path: str, ranks: str | None, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks)
        for batch in batches:
            texts = batch.column(0).fill_null("")
            for a, b, _, many in enc.encode(texts):
                digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([version] * (b - a)), pa.array(digests, pa.binary()), pa.array(many, pa.int64())], ["version", "digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, ranks: str | None = None, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row. `cache` is a folder of Parquet files that grows; without one, a new one in the shared folder."""
    spark = docs.sparkSession
    version = version_digest(*[tokenizer, ranks][: 2 if ranks else 1])
    cache = cache or store.new_path(spark, "token_counts")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = rows.select("id", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))
    seen = store.keep(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "digests")
    n = seen.agg(F.sum("copies")).first()[0] or 0
    wanted = seen
    if store.exists(spark, cache):
        stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        wanted = wanted.join(stored, "digest", "left_anti")
    # One row for each key, found by id and digest so that rows without an id spread too: the keys are few bytes, so each task can hash its share while the texts stream past.
    wanted = wanted.select(F.col("id").alias("wanted"), F.col("digest").alias("of")).hint("shuffle_hash")
    texts = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    missing = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("digest") == F.col("of")), "left_semi").select("body")
    missing.mapInArrow(tidy(_encode(tokenizer, ranks, version)), CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = seen.where(F.col("copies") * HOT > n).select(F.col("digest").alias("of"))
    known = store.keep(stored.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left_semi").select(F.col("digest").alias("of"), F.col("n_tokens").alias("known")), "hot")
    store.remove(seen)
    # Rows whose count is known get keys that no text has: a digest, and more bytes.
    spread = F.concat("digest", F.unhex(F.hex(F.xxhash64("id", F.spark_partition_id()))))
    split = keyed.join(F.broadcast(known), F.col("digest") == F.col("of"), "left").withColumn("key", F.when(F.col("known").isNull(), F.col("digest")).otherwise(spread))
    counted = split.join(stored.withColumnRenamed("digest", "key"), "key", "left").withColumn("n_tokens", F.coalesce("known", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
