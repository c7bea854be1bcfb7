"""The query of each operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import html_text, language_model, line_dedup, mixing, pii, secrets, simhash, topk, toxicity
from .common import id_hash, table


def digest(joined: Column) -> Column:
    return F.sha2(joined.cast("binary"), 256)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = dc.decontaminate(docs, benchmark, n=10, keep=["doc_id"])
    hit = dc.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash(F.col("doc_id")) % 10 == 0
    scored = language_model.score(docs, ~held_out, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("id") % 20 == 0, 20).withColumnRenamed("id", "vec_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs), keep=["doc_id"])
    base = F.col("base")
    return found.select("doc_id", *[count_kind(base, k) for k in ("assign", "access", "hex")], digest(spans_text(base)).alias("base_sha256"), spans_text(F.col("all")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn=toxicity.may_teach)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (id_hash(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.col("base")
    return found.select("doc_id", *[count_kind(base, k) for k in ("email", "ip", "card", "phone")], digest(spans_text(base)).alias("base_sha256"), spans_text(F.col("all")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Shares of tokens by the labelled quality, 1 (good) and 0.
MIX = {0: 0.2, 1: 0.8}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)
    return found.select(F.col("_key").alias("doc_id"), "n_tokens", F.col("p")[0].alias("p_quality_0"), F.get("p", F.lit(1)).alias("p_quality_1"), "rate")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_language_model, op3_topk, op4_secrets, op5_toxicity, op6_pii, op7_line_dedup, op8_simhash, op9_mixing, op10_html)}
