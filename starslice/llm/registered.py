"""Registered queries of the operators: one opN_<name> for each, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starslice.llm import (
    bpe, chat, decontaminate, divergence, line_dedup, mixing, ngram_jaccard, pii, quality_classifier, quality_rules, spelling, suffix_dedup, token_counts,
)
from starslice.llm.common import Scratch

QUERIES, SQL = {}, {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the scorers on every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).drop("text")


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: shingles of four words, similarity 0.85 or more."""
    return ngram_jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=4, threshold=0.85)


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier ones, and a digest of what it keeps."""
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed_words", "n_blocks", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when it is first read, in millionths of the training time."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    first = F.floor(F.array_min(F.transform("copies", lambda c: c["position"])) * 1_000_000).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position_ppm"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains: shingles of five words, containment 0.8 or more."""
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps, bytes of 50-byte strings of earlier documents removed."""
    kept = suffix_dedup.dedup_suffixes(read(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


SQL["op6_mixing"] = mixing.OP6_SQL
SQL["op8_decontamination"] = decontaminate.OP8_SQL


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(pii.labelled_sample(docs)))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("base_spans", "spans")}

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined["base_spans"], 256).alias("base_sha256"), joined["spans"].alias("spans"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, and of those how many cross its bounds."""
    counted = token_counts.section_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.section_rows(counted.drop("text"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    scratch = Scratch(spark, "quality-rules")
    measured = scratch.put("measured", quality_rules.measure(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return quality_rules.judge(measured, quality_rules.fit(measured))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(read(spark, sf_dir, "conversations"))


SQL["op5_chat_formatting"] = chat.OP5_SQL


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), packed=True).drop("text")
    return bpe.decode(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the number of words one edit apart, its form and its root."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all pairs of a language's sources, and the terms that each source uses more than its language does."""
    return divergence.audit(read(spark, sf_dir, "documents"))


SQL["op13_divergence"] = divergence.OP13_SQL
