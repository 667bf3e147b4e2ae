"""Helpers shared by the training-data operators: tables, shared storage, label folds and distributed array sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, where a scan has fewer splits (a file of one row group); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends, as nothing can read it later."""
    folder = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(delete, spark, folder)
    return folder


_FOLDERS: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file systems; one that can't be reached any more stays."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: For tables whose rows are megabytes: a row group of a few rows, since writers hold a group, and readers decode up to 4 096 rows of one at once.
LARGE_ROWS = {"parquet.block.row.count.limit": "2", "parquet.page.row.count.limit": "1"}


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (with ``options`` of the writer) and read it back: cuts lineage and survives lost executors."""
    return stored_at(df, label, options)[0]


def stored_at(df: DataFrame, label: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """The same with the path, for tables that are deleted before the end."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the rows and bytes of an Arrow batch, so that a batch of long texts fits beside others in a worker.

    Both are settings of the session, which later queries keep; they change no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1; null ids are not held out (and never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, by the order of a hash of the id.

    Repeated labels of an id count once: the mean, rounded half up. Null ids and null labels take no part. Where there are more
    ids than the limit, only those whose hash is in the share that holds about one and a half times the limit are sorted.
    """
    span = 1 << 40
    place = F.pmod(F.xxhash64("__id"), F.lit(span))
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("__label"))
    )
    total = known.count()
    if total > 2 * limit:
        known = known.where(place < int(span * 1.5 * limit / total))
    return known.orderBy(place, "__id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of a bounded label sample: columns ``__id, __label, text``, one row for each id (the least text, where an id is repeated)."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id")
    return own.groupBy("__id", "__label").agg(F.min("text").alias("text"))


def replaced_schema(df: DataFrame, keep: list[str] | None, added: list[tuple[str, T.DataType]]) -> tuple[DataFrame, list[str], T.StructType]:
    """The frame without columns that clash with ``added``, the kept names, and the output schema."""
    names = {n for n, _ in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    return df, keep, T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added)])


def with_text_columns(df: DataFrame, text_col: str, keep: list[str] | None, added: list[tuple[str, T.DataType]], function: Callable[[list], list]) -> DataFrame:
    """Add columns computed by ``function`` from the texts of a batch; other columns pass unchanged.

    ``function`` gets a list of str (null as "") and returns one Arrow array for each added column.
    """
    _, keep, schema = replaced_schema(df, keep, added)
    names = keep + [n for n, _ in added]
    source = small_batches(df).select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *function(texts)], names=names)

    return source.mapInArrow(run, schema)


BLOCK = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("data", T.BinaryType())])


def block_rows(array: np.ndarray, block: int, salt: int) -> pa.RecordBatch:
    """Rows of a float32 table cut in blocks, as one record batch; blocks of zeros are left out."""
    out = [(i // block, array[i : i + block]) for i in range(0, len(array), block)]
    out = [(k, np.ascontiguousarray(x, np.float32).tobytes()) for k, x in out if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([salt] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "salt", "data"])


def summed_blocks(parts: DataFrame, shape: tuple[int, int], block: int, salts: int = 8) -> np.ndarray:
    """Sum of float32 tables that tasks emitted with ``block_rows``.

    The blocks are summed in streams, ``salts`` for each block, so that no task holds more than one table;
    the driver gets ``salts`` tables at most, whatever the size of the corpus.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, np.float32)
                if (k, s) in sums:
                    sums[k, s] += x
                else:
                    sums[k, s] = x.astype(np.float64)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array([sums[k].astype(np.float32).tobytes() for k in keys], pa.binary())], names=["block", "salt", "data"])

    total = np.zeros(shape, np.float64)
    salted = parts.withColumn("salt", F.col("salt") % salts)
    blocks = -(-shape[0] // block)
    for row in salted.repartition(min(blocks * salts, 64), "block", "salt").mapInArrow(add, BLOCK).toLocalIterator():
        x = np.frombuffer(row.data, np.float32).reshape(-1, shape[1])
        total[row.block * block : row.block * block + len(x)] += x
    return total
