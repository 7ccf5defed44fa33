"""The queries of this folder's operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridrank.llm import chat_rotation, embed_forest, html_layout, imatch, jaccard_join, mil_quality, secret_scan, sentencepiece_viterbi
from gridrank.llm.packing import pack
from gridrank.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_tokenizer() -> tuple[str, str]:
    """The vocabulary's file, and its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_viterbi.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(_table(spark, sf_dir, "pages"))


def op5_embed_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), k=5, threshold=0.75)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), *byte_tokenizer(), limit=1024)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), *byte_tokenizer(), window=1024)


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(_table(spark, sf_dir, "conversations"))


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mil_quality.score(docs, mil_quality.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_sentencepiece, op3_imatch, op4_html_layout, op5_embed_forest, op6_jaccard_join, op7_token_counts, op8_packing, op9_chat_rotation, op10_mil_quality)}
#: Sets of shingles, their pairs, links, and what links reach.
_SHINGLE_LINKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.node) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
#: Turns with their heads for every speaker, offsets by running sums, texts and masks by ordered aggregates.
_ROTATED = r"""
WITH said AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body, CAST(floor(turn / 64) AS BIGINT) AS "window" FROM conversations),
who AS (SELECT DISTINCT conv_id AS of, role AS speaker FROM said WHERE role <> 'system'),
parts AS (SELECT said.*, speaker, role IS NOT DISTINCT FROM speaker AS own,
  CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' END AS head FROM said JOIN who ON conv_id IS NOT DISTINCT FROM of),
placed AS (SELECT *, row_number() OVER o AS k, CAST(sum(length(head) + length(body)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM parts
  WINDOW o AS (PARTITION BY conv_id, "window", speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, body))
SELECT conv_id, "window", speaker, count(*) AS n_turns,
  CAST(coalesce(sum(max(stop)) OVER (PARTITION BY conv_id, speaker ORDER BY "window" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || ':' || stop END, ',' ORDER BY k), '') AS mask
FROM placed GROUP BY conv_id, "window", speaker
"""
#: The others can't be put in SQL as a whole; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": _SHINGLE_LINKS, "op9_chat_rotation": _ROTATED}
