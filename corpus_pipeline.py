"""The corpus pipeline: toxic documents go, cross-site boilerplate lines go, one document
of each group of near copies stays, documents with benchmark passages go, and what is left
gets rates at which its tokens are mixed to the target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as dc
from millrace.llm import line_dedup, mixing, near_dedup, toxicity
from millrace.llm.common import materialise, pack, place, stable, table, unpack
from millrace.llm.queries import MIX

#: Toxic from this score on.
TOXIC = 0.3


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the model learns from all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = _fresh(docs, "toxicity")
    scored = toxicity.score(docs, model, name=name)
    return scored.where(F.col(name) < TOXIC).select(*[scored[c] for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are on many sites (one document keeps each)."""
    rest = [c for c in docs.columns if c != "text"]
    clean = line_dedup.remove_boilerplate(pack(docs, rest, doc_id=docs["doc_id"], source=docs["source"], text=docs["text"]))
    made = {"text": F.col("text")}
    if "n_chars" in rest:
        size = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("_doc")["n_chars"])
        made["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return unpack(clean, rest, **made).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = dc.decontaminate(pack(docs, docs.columns, text=docs["text"]), table(spark, sf_dir, "benchmark"), keep=["_doc"])
    return unpack(found.where(F.size("spans") == 0), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which each is to be read; those of rate 0 go."""
    docs = stable(docs)
    found = mixing.mix(docs, table(spark, sf_dir, "labels"), MIX)
    rates = found.select(F.col("_row").alias("at"), "rate")
    rows = pack(docs, docs.columns, row=place())
    name = _fresh(docs, "rate")
    return unpack(rows.join(rates.hint("shuffle_hash"), F.col("row") == F.col("at")).where(F.col("rate") > 0), docs.columns, **{name: F.col("rate")})


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash", drop_near_copies), ("decontaminate", drop_contaminated), ("mixing", mix)]

#: Models, sketches and iterations aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
