"""A corpus pipeline: quality, near duplicates, test passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of documents. `run` writes what a stage returns to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilith.llm import gam_quality, golay_simhash, packing, pii, wu_manber
from metrilith.llm.common import materialise, table
from metrilith.llm.queries import vocabulary

_OWN = "__pipeline_{}__"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least 0.3).

    Each row is scored by its own text; a null text is scored like an empty one.
    """
    score = _OWN.format("score")
    model = gam_quality.train(docs, table(spark, sf_dir, "labels"))
    return gam_quality.score(docs, model, out=score).filter(F.col(score) >= 0.3).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without an id can't be told apart and stay. Rows that share an id but not a text
    are documents of their own; of rows that share both one stays. Null, empty and
    wordless texts are copies of each other.
    """
    own = _OWN.format("node")
    named = docs.filter("doc_id is not null").withColumn(own, golay_simhash.node_of(F.col("text")))
    kept = golay_simhash.similar_groups(docs).filter("first").select("doc_id", F.col("node").alias(own))
    named = named.join(kept, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Each row is judged by its own text, whatever its id; null and empty texts have no
    words and stay.
    """
    hits = _OWN.format("hits")
    return wu_manber.with_hits(docs, table(spark, sf_dir, "benchmark"), out=hits).filter(F.col(hits) == 0).drop(hits)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced by its kind; n_chars follows where a text changed.

    Null and empty texts hold none and stay as they are.
    """
    own = _OWN.format("spans")
    text = F.col("text")
    found = docs.withColumn(own, pii.spans(text))
    masked = found.withColumn("text", pii.redacted(text, F.col(own)))
    return masked.withColumn("n_chars", F.when(F.size(own) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    # a smaller cache of pieces: the workers have held the stages before
    found = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), "lead_space", 0, cache=80_000)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier and tokenizers aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
