"""The registered queries of this subpackage: thin callers of its operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_documents
from .common import held_out, read_table
from .decontam import find_contamination
from .filter_audit import FILTER_AUDIT_SQL, filter_interactions
from .imatch import edited_fingerprints
from .line_dedup import LINE_DEDUP_SQL, dedup_lines
from .ngram_join import jaccard_classes
from .passages import repeated_passages
from .pii import KINDS, as_text, find_private, of_rank
from .prefix_trie import BRANCHED_TRIE_SQL, branched_trie
from .suffix_tree_lm import score_texts
from .super_minhash import MINHASH_SQL, minhash_classes
from .token_counts import count_tokens
from .toxicity import fit, score_toxicity

BPE_FILE = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_rank(rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:-1])]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), name="c")
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.size("c.hits").cast("long").alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        (F.size("c.hits") > 0).alias("contaminated"),
    )


#: The windows of every item against the document's word sequences of the same length.
DECONTAMINATION_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[pos : pos + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
grams AS (SELECT doc_id, pos, l, array_to_string(w[pos : pos + l - 1], ' ') AS k
          FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS pos FROM low, lens WHERE len(w) >= l)),
occ AS (SELECT g.doc_id, g.pos, g.l, win.item_id FROM grams g JOIN win ON g.l = win.l AND g.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS p FROM (SELECT DISTINCT doc_id, pos, l FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(low.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, name="c").select("doc_id", F.col("c.n_lines").alias("n_lines"), F.col("c.n_removed").alias("n_removed"), "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), with_ids=False)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branched_trie(read_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_imatch": op7_imatch,
    "op8_bpe_roundtrip": op8_bpe_roundtrip,
    "op9_ngram_join": op9_ngram_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_minhash_dedup": op13_minhash_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": DECONTAMINATION_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op11_conversation_trie": BRANCHED_TRIE_SQL,
    "op12_filter_audit": FILTER_AUDIT_SQL,
    "op13_minhash_dedup": MINHASH_SQL,
}
