"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinshot.llm import html, langid, neighbours, phrases, secrets, trie
from twinshot.llm.bpe import encode_decode
from twinshot.llm.containment import contained_items
from twinshot.llm.minhash import near_duplicates
from twinshot.llm.oracles import ORACLES
from twinshot.llm.quality import quality_verdicts
from twinshot.llm.store import ship, stored
from twinshot.llm.substrings import remove_repeats
from twinshot.llm.tokens import token_counts
from twinshot.llm.urls import UNWANTED_LABELS, url_verdicts

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Branches of a vantage-point tree are skipped beyond the k-th distance divided by this.
NEIGHBOUR_FACTOR = 2.0
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file; it is installed with its package on every executor."""
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), length=35, digest=True)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))

    def count(kind: int) -> F.Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*base, "base_failed", "kept", F.round("score", 6).alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    out = langid.predict(docs, langid.learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(_table(spark, sf_dir, "documents"), vocabulary())
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES, unwanted=UNWANTED_LABELS)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, similarity=0.8)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(trie.numbered(_table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    convs = turns.select("conv_id").distinct()
    head = F.crc32(conv.cast("string")) % 6
    paths = stored(trie.grafted(turns, convs, base=conv - conv % 100, head=head, longest=5))
    return trie.prefix_trie(paths, convs).withColumnRenamed("saved", "saved_tokens")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(rows, F.col("vec_id") % 20 == 0, k=20, factor=NEIGHBOUR_FACTOR)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_secret_scans,
        op3_quality_rules,
        op4_language_id,
        op5_token_counts,
        op6_bpe_round_trip,
        op7_benchmark_decontamination,
        op8_html_extraction,
        op9_url_filters,
        op10_minhash_near_dedup,
        op11_phrase_collocations,
        op12_conversation_prefix_trie,
        op13_nearest_neighbours,
        pipeline,
    )
}
