"""The corpus operators' queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontamination, html_extraction, mixing, near_duplicates, neighbours, periodic_runs, pii, quality_classifier, quality_rules, token_files, toxicity, url_filters, whitening
from spanloom.llm.common import WORD, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), toxicity.held_out(4, 2)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(documents, model).select("doc_id", held, "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held = table(spark, sf_dir, "documents"), toxicity.held_out(3, 1)
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"), ~held)
    return quality_classifier.score_quality(documents, model).select("doc_id", held, "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("number") % 20 == 0)


def looped_text(doc_id: Column, text: Column) -> Column:
    """The texts that op13 searches: of every tenth document by hash, the words from some place on repeat the first few there. The words of a text, or null."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    loop = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), rest), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", looped_text(F.col("doc_id"), F.col("text").cast("string")).alias("text"))
    found = periodic_runs.find_runs(documents).withColumn("r", periodic_runs.strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = F.sha2(F.array_join(F.transform("runs", line), ""), 256)
    exponent = F.expr("1000 * r.length div r.period")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "r.start", "r.length", "r.period", exponent.alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_quality_classifier, op4_token_files, op5_near_duplicates, op6_mixing, op7_quality_rules, op8_pii, op9_url_filters, op10_decontamination, op11_whitening, op12_neighbours, op13_periodic_runs)
}

ORACLES: dict[str, str] = {"op9_url_filters": url_filters.ORACLE}
