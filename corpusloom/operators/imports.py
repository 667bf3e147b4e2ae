"""Import of rows with reasons, least length, head limit and sharding, and statistics of the written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import lines, strip
from corpusloom.operators.corpus import running_total


def import_reason(text: Column | None, min_chars: int, is_string: bool = True) -> Column:
    """Why a row is taken or not: the column must be there, a string, not blank, and long enough once stripped."""
    if text is None:
        return F.lit("missing_text_column")
    if not is_string:
        return F.lit("text_column_not_string")
    cut = strip(text)
    return F.when(text.isNull(), "text_column_not_string").when(cut == "", "empty_text").when(F.length(cut) < min_chars, "below_min_chars").otherwise("included")


def import_rows(rows: DataFrame, order_col: str, text_col: str = "text", min_chars: int = 1, max_rows: int | None = None) -> DataFrame:
    """``rows`` in order with ``reason`` and the stripped ``text``; ``max_rows`` bounds the rows that are looked at, not those taken."""
    looked = rows.orderBy(order_col).limit(max_rows) if max_rows is not None else rows
    present = text_col in rows.columns
    is_string = present and rows.schema[text_col].dataType.simpleString() == "string"
    reason = import_reason(F.col(text_col) if present else None, min_chars, is_string)
    text = strip(text_col) if is_string else F.lit(None).cast("string")
    return looked.withColumn("reason", reason).withColumn("text", F.when(F.col("reason") == "included", text))


def sharded(imported: DataFrame, order_col: str, per_shard: int) -> DataFrame:
    """The taken rows with their place among the taken and their shard."""
    taken = imported.where("reason = 'included'")
    return running_total(taken, order_col, F.lit(1)).withColumn("included_index", F.col("__before")).withColumn("shard", F.floor(F.col("__before") / per_shard)).drop("__before")


def shard_stats(shards: DataFrame) -> DataFrame:
    """Documents, characters and lines of each file; a blank line stands between documents."""
    n = F.count(F.lit(1))
    return shards.groupBy("shard").agg(n.alias("num_documents"), (F.sum(F.length("text")) + 2 * (n - 1)).alias("num_characters"), (F.sum(F.size(lines("text"))) + (n - 1)).alias("num_lines"))


def metadata_stats(per_file: DataFrame) -> DataFrame:
    """Corpus totals from the counts of files alone."""
    return per_file.agg(F.count(F.lit(1)).alias("num_files"), F.sum("num_documents").alias("num_documents"), F.sum("num_characters").alias("num_characters"), F.sum("num_lines").alias("num_lines"))


def write_shards(shards: DataFrame, path: str, order_col: str) -> None:
    """One folder of text for each shard, documents in order; files of an earlier import are replaced."""
    shards.repartition("shard").sortWithinPartitions("shard", order_col).select("shard", F.concat("text", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


#: Rows that an import's report lists, at most.
REPORT_ROWS = 10_000


def import_report(imported: DataFrame, order_col: str, most: int = REPORT_ROWS) -> DataFrame:
    """The first rows with their reasons, in order: what a report lists of an import of any size."""
    return imported.orderBy(order_col).limit(most).select(order_col, "reason", F.coalesce(F.length("text"), F.lit(0)).alias("num_characters"))


def imported_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus statistics of imported documents in one pass over them; near duplicates were left to the import, and count as none.

    Lines and documents are aggregated by hash over the cluster, so no set of lines is held and none is cut off.
    """
    from corpusloom.operators.corpus import corpus_stats

    none = F.lit(0)
    return corpus_stats(docs.where(F.trim(F.coalesce(text_col, F.lit(""))) != ""), None, text_col).select("*", none.cast("double").alias("near_duplicate_document_rate"), none.cast("long").alias("near_duplicate_document_pairs"), none.cast("long").alias("near_duplicate_documents_checked"))
