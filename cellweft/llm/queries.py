"""The subpackage's queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import bpe, bwt_dedup, exact_dedup, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, token_rollup, toxicity
from cellweft.llm.common import word_count
from cellweft.runtime import materialize, shared_path, spread, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).rows()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score_toxicity(docs, machine).select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


#: The second tokenizer version of the rollup query: runs of ASCII letters, runs of digits, and single other characters.
FINE = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, two of which are sent twice.

    All documents are counted by two tokenizer versions; then those of fewer than 20 words are deleted, and those with more
    than two fine tokens a word have their word counts revised to the mean of both, rounded down.
    """
    docs = table(spark, sf_dir, "documents")
    counts = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("w"), F.coalesce(F.regexp_count("text", F.lit(FINE)), F.lit(0)).cast("long").alias("f"))
    counts = materialize(counts, "token-counts")
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "token-rollup"))
    change = lambda df, op, tokenizer, n: df.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"), F.lit(0).cast("long").alias("seq"))
    short, dense = counts.where("w < 20"), counts.where("w >= 20 and f > 2 * w")
    batches = {
        "words": change(counts, "insert", "words", F.col("w")),
        "fine": change(counts, "insert", "fine", F.col("f")),
        "short": change(short, "delete", "words", F.col("w")).union(change(short, "delete", "fine", F.col("f"))),
        "dense": change(dense, "revise", "words", F.expr("(w + f) div 2")),
    }
    for name in ("words", "fine", "short", "fine", "dense", "dense"):
        rollup.apply(name, batches[name])
    return rollup.totals()


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(spread(table(spark, sf_dir, "documents")), kept_bytes=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spread(table(spark, sf_dir, "documents")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spread(table(spark, sf_dir, "documents")), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_toxicity, op3_token_rollup, op4_bwt_dedup, op5_quality_rules, op6_bpe, op7_exact_dedup, op8_secret_scan, op9_jaccard_join, op10_quality_classifier)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_token_rollup": r"""
        WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
                          len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS f FROM documents),
        k AS (SELECT * FROM c WHERE w >= 20),
        r AS (SELECT source, lang, 'words' AS tokenizer, CASE WHEN f > 2 * w THEN (w + f) // 2 ELSE w END AS n FROM k
              UNION ALL SELECT source, lang, 'fine', f FROM k)
        SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY ALL""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY ALL""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
}
