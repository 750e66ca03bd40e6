"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilith.llm import collision_ann, filter_audit, gam_quality, golay_simhash, grammar, html_diff, license_rules, packing, pii, span_dedup, spelling, sql, token_store, wu_manber
from metrilith.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine; a parameter to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_diff.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    base = F.filter("found", lambda x: x["kind"] < len(pii.BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == pii.BASE.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("found")).alias("spans"), F.size("found").cast("bigint").alias("n_spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_pii that SQL can express: without the kinds that the method adds."""
    return op2_pii(spark, sf_dir).drop("spans", "n_spans")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = gam_quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", gam_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_store(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), "drop_space", 1)
    return token_store.read_store(spark, path)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision_ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("license_sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "lead_space", 0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = filter_audit.report(filter_audit.edges(rows, list("ABCDE"), ["good", "toxic"]), list("ABCDE"), ["good", "toxic"])
    return found.drop("filter").withColumnsRenamed({"removed_good": "good_lost", "removed_toxic": "toxic_lost"})


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = grammar.detect(docs, grammar.learn(docs))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*grammar.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in grammar.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12_secret_scan that SQL can express: without the spans that the automata add."""
    return op12_secret_scan(spark, sf_dir).drop("spans", "n_spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(found))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_pii, op3_substring_dedup, op4_simhash_near_dedup, op5_quality_classifier, op6_token_ids, op7_decontamination, op8_nearest_neighbours, op9_license_scan, op10_best_fit_packing, op11_filter_audit, op12_secret_scan, op13_spelling_variants, pipeline, pii_base_spans, secret_base_spans)
}

ORACLE_SQL: dict[str, str] = {"op7_decontamination": sql.DECONTAMINATION, "pii_base_spans": sql.PII_BASE, "op11_filter_audit": sql.FILTER_AUDIT, "op13_spelling_variants": sql.SPELLING, "secret_base_spans": sql.SECRET_BASE}
