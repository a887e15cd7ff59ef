"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import buckets, dedup, jaccard, metric, mixing, phrases, pii, postings, runs, seekable, templates, toxicity, urls
from pointweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


#: a key for the registered query only; a deployment passes its own secret
DEMO_KEY = b"registered query, not a secret"


@query("op1_pseudonyms")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, folder, "documents").select("doc_id", "text"), DEMO_KEY)


@query("op2_clause_grammar")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "toxic_clauses")


@query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return seekable.token_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_bayes_jaccard")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("_text_key")


@query("op5_length_buckets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    sized = seekable.with_token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return buckets.pack(sized, length=F.col("n_tokens"))


@query("op6_site_templates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(table(spark, folder, "pages"))


@query("op7_fair_mix", mixing.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_bloom_dedup", dedup.ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.classify_copies(table(spark, folder, "documents"))


@query("op9_url_rules", urls.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = urls.rule_table(spark, urls.RULES)
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op10_metric_join", metric.ORACLE)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return metric.link_vectors(table(spark, folder, "embeddings"))


@query("op11_phrases", phrases.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op12_positional_index", postings.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return postings.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digest(table(spark, folder, "documents"))
