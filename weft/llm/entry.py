"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, fingerprint, frames, jaccard_join, langid, line_dedup, packing, quality, substring_dedup, token_file, toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(frames.documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(frames.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(frames.documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.documents(spark, sf_dir)
    return quality.judged(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(frames.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.documents(spark, sf_dir)
    return langid.predicted(docs, langid.fit(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(frames.documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_ids(frames.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{frames.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_file.write(frames.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)
    return token_file.digests(token_file.read(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: What DuckDB finds for the two operators whose results SQL can express, by their definitions.
ORACLES = {
    "op1_substring_dedup": """
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
        ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY label ORDER BY doc_id, s) AS place FROM windows),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE place > 1),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_jaccard_join": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles AS x JOIN shingles AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reached.doc_id, b FROM reached JOIN edges ON a = other)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
        FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) AS c ON c.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
