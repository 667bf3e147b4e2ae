"""Queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, topk, urls
from corpusloom.llm.common import held_out, spread, table


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every text under a network that was trained on all of them."""
    from corpusloom.llm.lm import PseudoLikelihood

    model, tokens = PseudoLikelihood.fit(spread(table(spark, sf_dir, "documents")), keep=["doc_id"])
    return model.score_tokens(tokens)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret found in every text, by place, length and hash."""
    from corpusloom.llm.secrets import SecretScanner, findings_table

    found = SecretScanner.fit(findings_table(spark)).scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("value").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("secret_sha256"), "probability")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, with its nearest labelled examples."""
    from corpusloom.llm.toxicity import ToxicityNeighbours

    docs = spread(table(spark, sf_dir, "documents"))
    scored = ToxicityNeighbours.fit(docs, table(spark, sf_dir, "labels")).score(docs, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every text stands in benchmark items."""
    index = decontamination.build_index(spread(table(spark, sf_dir, "documents")))
    return decontamination.verdicts(decontamination.matches(index, table(spark, sf_dir, "benchmark")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of sources takes every document."""
    from corpusloom.llm import mixing

    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    from corpusloom.llm import neardup

    return neardup.classes(spread(table(spark, sf_dir, "documents"))).select("doc_id", "class_id")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the listed rules on every page's URL."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from corpusloom.llm import html

    found = html.extracted(spread(table(spark, sf_dir, "pages")), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    from corpusloom.llm.quality import QualityClassifier

    docs = spread(table(spark, sf_dir, "documents"))
    scored = QualityClassifier.fit(docs, table(spark, sf_dir, "labels")).score(docs, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_neardup": op7_neardup,
    "op8_urls": op8_urls,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op4_decontamination": decontamination.ORACLE, "op5_topk": topk.ORACLE, "op8_urls": urls.ORACLE}
