"""A training-data pipeline over ``documents``: each stage keeps, cleans or weighs what the one before it kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again for the
next one. All but the last return the columns of ``documents``; the last adds ``copy``, the number of the copy from 1, in place
of a column of that name. Stages know a row by a hash of all its columns, not by its id, so rows of one id or of none are
judged each by its own text, and rows alike in all columns alike: of these, deduplication leaves one, and
mixing numbers the copies of all of them through. Null texts and empty tables go through as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, neardup
from corpusloom.llm.common import spread, stored, table, work_dir
from corpusloom.llm.quality import QualityClassifier
from corpusloom.llm.secrets import SecretScanner, findings_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (probability under one half) go."""
    model = QualityClassifier.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, score_col="__score").where(F.col("__score") >= 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the least id."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    found = decontamination.matches(decontamination.build_index(keyed, id_col="__row"), table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(hit, "__row", "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The values of secrets are masked in the texts; every document stays."""
    return SecretScanner.fit(findings_table(spark)).masked(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, with the number of the copy."""
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    wanted = mixing.plan(keyed, id_col="__row").groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n")).where("__copies > 0")
    wanted = stored(wanted, "copies")
    taken = keyed.join(wanted, "__row")
    if wanted.where("__n > 1").limit(1).count():
        taken = taken.where("__n = 1").unionByName(taken.where("__n > 1").dropDuplicates(["__row"]))
    return taken.select(*(c for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix),
]

#: The classifier, the sketches and the forest have no SQL; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = spread(table(spark, sf_dir, "documents"))
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
