"""Parquet tables of a scale directory, and the small views that queries share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.tuning import first_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale directory; texts over all cores, since a file of them may be one split."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local one only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="corpusloom-")
        _LOCAL[spark.sparkContext.applicationId] = folder
    return folder


#: The local folder of an application that names no shared one.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared one, for tables that a query writes on its way; all of an application's go when the driver ends."""
    root = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_removed, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


_SCRATCH: set[str] = set()


def _removed(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone; then the folder stays
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, where a scan has fewer splits (a file of one row group); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, user, assistant, category``: pairs of the conversations, with categories dealt by id as the fixtures have them."""
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return first_pairs(table(spark, sf_dir, "conversations")).withColumn("category", F.element_at(names, (F.col("conv_id") % len(CATEGORIES) + 1).cast("int")))


#: Categories of the chat fixtures.
CATEGORIES = ["bench_math_add", "identity", "domain_recall", "refusal_boundary", "bench_choice_facts", "bench_spelling_letters", "chat"]

#: The same views in SQL.
PAIRS_SQL = """
said AS (
    SELECT conv_id, turn, role, text,
           last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u
    FROM conversations
), answers AS (
    SELECT conv_id, u AS "user", text AS assistant, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM said WHERE role = 'assistant' AND u IS NOT NULL
), pairs AS (
    SELECT conv_id, "user", assistant,
           ['bench_math_add', 'identity', 'domain_recall', 'refusal_boundary', 'bench_choice_facts', 'bench_spelling_letters', 'chat'][(conv_id % 7) + 1] AS category
    FROM answers WHERE rn = 1
)
"""
