"""Queries over the document corpus: statistics, quality, filters, duplicates, offsets, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, dedup, imports
from corpusloom.sources.tables import table

NORM = "regexp_replace(trim(lower({0}), ' \n\r\t'), '\\s+', ' ', 'g')"
LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\n$', ''), chr(10)) END"
STRIP = "trim({0}, ' \n\r\t')"


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(table(spark, sf_dir, "documents"))


def corpus_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(table(spark, sf_dir, "documents"), ["lang"])


def corpus_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(table(spark, sf_dir, "documents"), ["source"])


def _stats_sql(key: str | None) -> str:
    k, by, on = (f"{key}, ", f"GROUP BY {key}", f"USING ({key})") if key else ("", "", "ON true")
    return f"""
WITH d AS (SELECT {k}coalesce(text, '') AS text FROM documents),
w AS (SELECT {k}count(*) AS n, sum(length(text)) AS chars, sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) AS wide,
             sum(len({LINES.format('text')})) AS lines, count(DISTINCT {NORM.format('text')}) AS texts FROM d {by}),
l AS (SELECT {k}trim(unnest({LINES.format('text')}), ' \r\t') AS line FROM d),
m AS (SELECT {k}count(*) FILTER (line <> '') AS filled, count(DISTINCT line) FILTER (line <> '') AS uniq, count(*) FILTER (line = '') AS empty FROM l {by})
SELECT {k}n AS num_documents, CAST(chars + greatest(0, n - 1) AS BIGINT) AS num_characters, CAST(lines AS BIGINT) AS num_lines,
       (chars + greatest(0, n - 1)) / greatest(1, n) AS average_document_chars,
       (n - texts) / greatest(1, n) AS duplicate_document_rate,
       (coalesce(filled, 0) - coalesce(uniq, 0)) / greatest(1, coalesce(filled, 0)) AS duplicate_line_rate,
       wide / greatest(1, chars + greatest(0, n - 1)) AS non_ascii_rate,
       coalesce(empty, 0) / greatest(1, lines) AS empty_line_rate
FROM w LEFT JOIN m {on}
"""


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", F.array_join("quality_flags", ",").alias("quality_flags"))


QUALITY_SQL = f"""
s AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t FROM documents),
a AS (SELECT doc_id, t, list_transform({LINES.format('t')}, lambda x: {STRIP.format('x')}) AS ls FROM s),
b AS (SELECT doc_id, t, length(t) AS n, len(ls) AS lines, list_filter(ls, lambda x: x <> '') AS f, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(t)) AS wide FROM a),
m AS (SELECT doc_id, n, wide, len(f) AS filled, (len(f) - len(list_distinct(f))) / greatest(1, len(f)) AS rep, (lines - len(f)) / greatest(1, lines) AS empty,
             regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR contains(t, chr(65533)) AS noise FROM b),
q AS (SELECT doc_id, n, CAST(greatest(0, least(100, 100 - CASE WHEN n < 200 THEN 25 WHEN n < 1000 THEN 10 ELSE 0 END - CASE WHEN filled <= 1 AND n > 500 THEN 10 ELSE 0 END
             - CASE WHEN rep > 0.30 THEN 25 WHEN rep > 0.10 THEN 10 ELSE 0 END - CASE WHEN empty > 0.50 THEN 10 ELSE 0 END
             - CASE WHEN wide > 0.10 THEN 15 WHEN wide > 0.05 THEN 8 ELSE 0 END - CASE WHEN noise THEN 25 ELSE 0 END)) AS INTEGER) AS quality_score,
      concat_ws(',', CASE WHEN n < 200 THEN 'short_document' WHEN n < 1000 THEN 'small_document' END, CASE WHEN filled <= 1 AND n > 500 THEN 'long_single_line' END,
             CASE WHEN rep > 0.30 THEN 'high_duplicate_lines' WHEN rep > 0.10 THEN 'duplicate_lines' END, CASE WHEN empty > 0.50 THEN 'many_empty_lines' END,
             CASE WHEN wide > 0.10 THEN 'high_non_ascii' WHEN wide > 0.05 THEN 'non_ascii' END, CASE WHEN noise THEN 'extraction_noise' END) AS quality_flags FROM m)
"""


def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("quality_score").agg(F.count(F.lit(1)).alias("n"))


def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = corpus.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.col("quality_score") >= 80).cast("int").alias("good"))
    return scored.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality", "good").agg(F.count(F.lit(1)).alias("n"))


def min_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quality_filtered(table(spark, sf_dir, "documents").select("doc_id", "text"), 80).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def readiness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.readiness_checks(corpus_stats(spark, sf_dir))


def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.readiness(readiness_checks(spark, sf_dir))


def corpus_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = corpus.quality_filtered(table(spark, sf_dir, "documents").select("doc_id", "text"), 70)
    counts = filtered.agg(F.count(F.when(F.col("included") & (F.col("quality_score") < 70), 1)).alias("low"), F.count(F.when(F.col("reason") == "below_min_score", 1)).alias("cut"), F.count(F.when(~F.col("included"), 1)).alias("gone"))
    return corpus.corpus_warnings(corpus_stats(spark, sf_dir).join(counts), F.col("low"), F.col("cut"), F.col("gone"))


def training_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.training_budget(corpus_stats(spark, sf_dir))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = corpus_stats(spark, sf_dir)
    n, chars = F.col("num_documents"), F.col("num_characters")
    return stats.select(corpus.token_estimate(chars, n, "char", 0).alias("char_tokens"), corpus.token_estimate(chars, n, "bpe", 512).cast("long").alias("bpe_512"), corpus.token_estimate(chars, n, "bpe", 32_000).cast("long").alias("bpe_32000"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents")).select("first_id", "n")


def duplicate_lines_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.line_table(table(spark, sf_dir, "documents")).where("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "line").limit(20)


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_offsets(table(spark, sf_dir, "documents")).select("doc_id", "char_start", "char_end", "num_characters")


def corpus_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bounded_preview(table(spark, sf_dir, "documents"), 20_000).select("doc_id", "char_start", F.length("part").cast("long").alias("chars"))


def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id"), 101)


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(table(spark, sf_dir, "documents"))


def near_dup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.near_rate(docs, dedup.near_pairs(docs))


def import_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_rows(table(spark, sf_dir, "documents"), "doc_id", min_chars=200).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def import_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.shard_stats(imports.sharded(imports.import_rows(table(spark, sf_dir, "documents"), "doc_id", min_chars=200), "doc_id", 100))


def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.metadata_stats(import_shards(spark, sf_dir))


def import_head_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importer's head limit, a feature of it: it bounds the rows that are looked at, not those taken."""
    return imports.import_rows(table(spark, sf_dir, "documents"), "doc_id", min_chars=200, max_rows=150).where("reason = 'included'").select("doc_id", F.length("text").alias("n_chars"))


def readiness_with_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks with the rate of near duplicates and the documents that were left out."""
    docs = table(spark, sf_dir, "documents")
    near = dedup.near_rate(docs, dedup.near_pairs(docs)).select("near_duplicate_rate")
    gone = corpus.quality_filtered(docs.select("doc_id", "text"), 0).agg(F.count(F.when(~F.col("included"), 1)).alias("gone"))
    return corpus.readiness_checks(corpus_stats(spark, sf_dir).join(near).join(gone), F.col("near_duplicate_rate"), F.col("gone"))


QUERIES = {f.__name__: f for f in (corpus_stats, corpus_by_lang, corpus_by_source, doc_quality, quality_histogram, quality_vs_labels, min_quality_filter, readiness_checks, readiness_verdict, corpus_warnings, training_budget, token_estimates, exact_dup_groups, duplicate_lines_top, doc_offsets, corpus_preview, evenly_spaced_sample, near_dup_pairs, near_dup_rate, import_filter_reasons, import_head_reasons, readiness_with_near, import_shards, import_totals)}

_STATS = _stats_sql(None).strip()
_CHECKS = f"""st AS ({_STATS}), c AS (
SELECT unnest([
 {{'check_name': 'usable_documents', 'status': CASE WHEN num_documents = 0 THEN 'fail' ELSE 'pass' END, 'value': CAST(num_documents AS DOUBLE)}},
 {{'check_name': 'corpus_size', 'status': CASE WHEN num_characters = 0 THEN 'fail' WHEN num_characters < 1000 THEN 'warn' ELSE 'pass' END, 'value': CAST(num_characters AS DOUBLE)}},
 {{'check_name': 'document_mix', 'status': CASE WHEN num_documents = 1 THEN 'warn' WHEN num_documents > 1 THEN 'pass' ELSE 'fail' END, 'value': CAST(num_documents AS DOUBLE)}},
 {{'check_name': 'duplicate_documents', 'status': CASE WHEN duplicate_document_rate > 0.05 THEN 'warn' ELSE 'pass' END, 'value': duplicate_document_rate}},
 {{'check_name': 'duplicate_lines', 'status': CASE WHEN duplicate_line_rate > 0.15 THEN 'warn' ELSE 'pass' END, 'value': duplicate_line_rate}},
 {{'check_name': 'near_duplicate_documents', 'status': 'pass', 'value': 0.0}},
 {{'check_name': 'empty_lines', 'status': CASE WHEN empty_line_rate > 0.35 THEN 'warn' ELSE 'pass' END, 'value': empty_line_rate}},
 {{'check_name': 'non_ascii', 'status': CASE WHEN non_ascii_rate > 0.05 THEN 'warn' ELSE 'pass' END, 'value': non_ascii_rate}},
 {{'check_name': 'skipped_sources', 'status': 'pass', 'value': 0.0}}], recursive := true) FROM st)"""
_TAKEN = f"t AS (SELECT doc_id, {STRIP.format('text')} AS text FROM documents WHERE length({STRIP.format('text')}) >= 200), p AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard FROM t)"
_SHARDS = f"SELECT CAST(shard AS BIGINT) AS shard, count(*) AS num_documents, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS num_characters, CAST(sum(len({LINES.format('text')})) + count(*) - 1 AS BIGINT) AS num_lines FROM p GROUP BY shard"
_PLACED = f"o AS (SELECT doc_id, length({STRIP.format('text')}) AS n FROM documents WHERE {STRIP.format('text')} <> ''), f AS (SELECT doc_id, coalesce(sum(n + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, n FROM o)"

ORACLES = {
    "corpus_stats": _STATS,
    "corpus_by_lang": _stats_sql("lang"),
    "corpus_by_source": _stats_sql("source"),
    "doc_quality": f"WITH {QUALITY_SQL} SELECT doc_id, quality_score, quality_flags FROM q",
    "quality_histogram": f"WITH {QUALITY_SQL} SELECT quality_score, count(*) AS n FROM q GROUP BY 1",
    "quality_vs_labels": f"WITH {QUALITY_SQL} SELECT l.quality, CAST(quality_score >= 80 AS INTEGER) AS good, count(*) AS n FROM q JOIN labels l USING (doc_id) GROUP BY 1, 2",
    "min_quality_filter": f"WITH {QUALITY_SQL} SELECT CASE WHEN n = 0 THEN 'empty_text' WHEN quality_score < 80 THEN 'below_min_score' ELSE 'included' END AS reason, count(*) AS n FROM q GROUP BY 1",
    "readiness_checks": f"WITH {_CHECKS} SELECT check_name, status, value FROM c",
    "readiness_verdict": f"WITH {_CHECKS} SELECT CASE WHEN bool_or(status = 'fail') THEN 'blocked' WHEN bool_or(status = 'warn') THEN 'caution' ELSE 'ready' END AS status, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail') AS failures FROM c",
    "corpus_warnings": f"""WITH {QUALITY_SQL}, st AS ({_STATS}), g AS (SELECT count(*) FILTER (quality_score < 70 AND n > 0) AS cut, count(*) FILTER (n = 0 OR quality_score < 70) AS gone FROM q)
SELECT unnest(list_filter([CASE WHEN num_documents = 0 THEN 'no_documents' END, CASE WHEN num_characters < 1000 THEN 'very_small' END, CASE WHEN num_documents = 1 THEN 'one_document' END,
 CASE WHEN duplicate_line_rate > 0.15 THEN 'duplicate_lines' END, CASE WHEN duplicate_document_rate > 0.05 THEN 'duplicate_documents' END, CASE WHEN empty_line_rate > 0.35 THEN 'empty_lines' END,
 CASE WHEN non_ascii_rate > 0.05 THEN 'non_ascii' END, CASE WHEN cut > 0 THEN 'filtered_by_score' END, CASE WHEN gone > 0 THEN 'skipped_sources' END], lambda x: x IS NOT NULL)) AS warning FROM st, g""",
    "training_budget": f"""WITH st AS ({_STATS}), b AS (SELECT *, CASE WHEN num_characters = 0 THEN 0 WHEN num_characters < 1000 THEN 1 WHEN num_documents = 1 THEN 2 WHEN num_characters < 50000 THEN 3 ELSE 4 END + 1 AS i FROM st),
v AS (SELECT num_characters AS t, ['blocked','smoke','overfit-check','tiny','small-preview'][i] AS preset, CAST([32,32,128,128,256][i] AS BIGINT) AS c, CAST([1,4,8,8,4][i] AS BIGINT) AS s, CAST([0,100,300,500,1000][i] AS BIGINT) AS k FROM b)
SELECT preset, t AS estimated_tokens, c AS context_size, greatest(0, t - c) AS estimated_windows, s AS batch_size, k AS base_steps, c * s AS tokens_per_step, CASE WHEN t > 0 THEN k * c * s / t ELSE 0.0 END AS estimated_passes FROM v""",
    "token_estimates": f"WITH st AS ({_STATS}) SELECT num_characters + 2 * num_documents AS char_tokens, CAST(ceil(num_characters * 0.60::DOUBLE) AS BIGINT) AS bpe_512, CAST(ceil(num_characters * 0.28::DOUBLE) AS BIGINT) AS bpe_32000 FROM st",
    "exact_dup_groups": f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {NORM.format('text')} HAVING count(*) > 1",
    "duplicate_lines_top": f"WITH l AS (SELECT trim(unnest({LINES.format('text')}), ' \r\t') AS line FROM documents) SELECT line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, line LIMIT 20",
    "doc_offsets": f"WITH {_PLACED} SELECT doc_id, CAST(s AS BIGINT) AS char_start, CAST(s + n AS BIGINT) AS char_end, n AS num_characters FROM f",
    "corpus_preview": f"WITH {_PLACED} SELECT doc_id, CAST(s AS BIGINT) AS char_start, CAST(least(s + n, 20000) - s AS BIGINT) AS chars FROM f WHERE s < 20000",
    "evenly_spaced_sample": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT doc_id, position FROM r WHERE n <= 101 OR position IN (SELECT CAST(round_even(i * ((SELECT count(*) FROM documents) - 1) / 100.0, 0) AS BIGINT) FROM range(101) t(i))",
    "import_head_reasons": f"SELECT doc_id, length({STRIP.format('text')}) AS n_chars FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 150) WHERE length({STRIP.format('text')}) >= 200",
    "import_filter_reasons": f"WITH h AS (SELECT * FROM documents) SELECT CASE WHEN text IS NULL THEN 'text_column_not_string' WHEN {STRIP.format('text')} = '' THEN 'empty_text' WHEN length({STRIP.format('text')}) < 200 THEN 'below_min_chars' ELSE 'included' END AS reason, count(*) AS n FROM h GROUP BY 1",
    "import_shards": f"WITH {_TAKEN} {_SHARDS}",
    "import_totals": f"WITH {_TAKEN}, s AS ({_SHARDS}) SELECT count(*) AS num_files, CAST(sum(num_documents) AS BIGINT) AS num_documents, CAST(sum(num_characters) AS BIGINT) AS num_characters, CAST(sum(num_lines) AS BIGINT) AS num_lines FROM s",
}
