"""The registered queries of the ten operators, with production parameters on whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_id, licenses, ngram_join, quality_rules, repeats, secrets, token_counts, toxicity
from .textkit import WORD_RE2

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"), bpe.load())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.load())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.dictionary())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.detect(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_token_counts, op5_quality_rules, op6_suffix_array_dedup, op7_bpe_encoding, op8_secret_scan, op9_license_scan, op10_toxicity)}


_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {ngram_join.N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {ngram_join.N} + 2), lambda i: array_to_string(w[i:i + {ngram_join.N - 1}], ' ')) END) AS gram FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS MATERIALIZED (SELECT l, r FROM o JOIN s x ON x.doc_id = l JOIN s y ON y.doc_id = r WHERE c >= ceil({ngram_join.THRESHOLD} * (x.n + y.n) / {1 + ngram_join.THRESHOLD} - 1e-9)),
e AS MATERIALIZED (SELECT l AS a, r AS b FROM p UNION ALL SELECT r, l FROM p),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM k LEFT JOIN n USING (doc_id)
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM benchmark),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {decontaminate.MIN_WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {decontaminate.MIN_WORDS} + 2)) AS i FROM d)),
bg AS (SELECT item_id, i - 1 AS q, array_to_string(w[i:i + {decontaminate.MIN_WORDS - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - {decontaminate.MIN_WORDS} + 2)) AS i FROM b)),
m AS (SELECT doc_id, item_id, p, q FROM dg JOIN bg USING (g)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM m),
k AS (SELECT doc_id, item_id, min(p) AS doc_word, min(q) AS item_word, count(*) + {decontaminate.MIN_WORDS - 1} AS n FROM r GROUP BY doc_id, item_id, p - q, run)
SELECT doc_id, item_id, CAST(n AS INT) AS match_words, CAST(doc_word AS INT) AS doc_word, CAST(item_word AS INT) AS item_word
FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, item_word, doc_word) = 1
"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, i - 1 AS p, md5(array_to_string(w[i:i + {repeats.WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {repeats.WINDOW} + 2)) AS i FROM d)),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM x),
r AS (SELECT doc_id, p, n, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c WHERE n > 1)
SELECT doc_id, CAST(min(p) AS INT) AS start_word, CAST(count(*) + {repeats.WINDOW - 1} AS INT) AS n_words, CAST(max(n) AS INT) AS copies FROM r GROUP BY doc_id, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _JOIN, "op3_benchmark_decontamination": _LEAKS, "op5_quality_rules": quality_rules.ORACLE, "op6_suffix_array_dedup": _REPEATS}
