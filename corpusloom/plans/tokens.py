"""Queries over tokenizers, encodings, windows, shards and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import packing, tokenizers
from corpusloom.sources.tables import PAIRS_SQL, chat_pairs, scratch, table

CONTEXT = 128
PER_SHARD = 20_000


def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.char_vocabulary(table(spark, sf_dir, "documents")).select("token", "token_id", "n")


def byte_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.byte_counts(table(spark, sf_dir, "documents"))


def token_byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.byte_lengths(char_vocab(spark, sf_dir)).groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))


def piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.piece_counts(table(spark, sf_dir, "documents"))


def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenizers.merge_table(docs, tokenizers.learn_pairs(docs, 512, folder=scratch(spark, "pairs")))


def bpe_encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = tokenizers.encoded(docs, tokenizers.learn_pairs(docs, 512, folder=scratch(spark, "pairs")), keep=["lang", "text"]).withColumn("chars", F.length("text"))
    return ids.groupBy("lang").agg(F.sum(F.size("ids") - 2).alias("tokens"), F.sum("chars").alias("chars"), F.sum(F.size(F.filter("ids", lambda i: i == tokenizers.UNK))).alias("unknown"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a document under the character tokenizer, with its edges."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") + 2).cast("long").alias("tokens"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(spark, sf_dir).groupBy("source").agg(F.sum(packing.window_counts(F.col("tokens"), CONTEXT)).alias("windows"))


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows themselves, of the words of the benchmark items by their lengths."""
    ids = F.transform(F.split("text", " "), F.length)
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(packing.windows(ids, 8)).alias("pos", "w")).select("item_id", "pos", F.array_join(F.transform("w.x", lambda v: v.cast("string")), ",").alias("x"), F.array_join(F.transform("w.y", lambda v: v.cast("string")), ",").alias("y"))


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard_plan(_lengths(spark, sf_dir), "doc_id", "tokens", PER_SHARD, "source")


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(_lengths(spark, sf_dir), "doc_id", "tokens", CONTEXT, "source")


def packing_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and dropped tokens of each source are all its tokens."""
    return packed_rows(spark, sf_dir).select("source", (F.col("rows") * (CONTEXT + 1) + F.col("dropped_tokens")).alias("accounted"))


def _pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs(spark, sf_dir).select("conv_id", "category", (F.length("user") + F.length("assistant") + 2).cast("long").alias("tokens"))


def sft_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_decreasing(_pair_lengths(spark, sf_dir), "conv_id", "tokens", 4096, "category")


def sft_skipped_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair_lengths(spark, sf_dir)
    return rows.groupBy("category").agg(F.count(F.when(F.col("tokens") > 513, 1)).alias("skipped"), F.count(F.when(F.col("tokens") <= 513, 1)).alias("kept"))


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised and masked places of the pairs' sequences, by category."""
    units = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    labels = chat_pairs(spark, sf_dir).select("category", packing.masked_labels(units(F.col("user")), units(F.col("assistant"))).alias("labels"))
    return labels.groupBy("category").agg(F.sum(packing.supervised(F.col("labels"))).alias("supervised"), F.sum(F.size("labels") - packing.supervised(F.col("labels"))).alias("masked"))


def document_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of texts by a manifest's offsets, stripped of spaces: each document in two halves."""
    half = F.floor(F.length("text") / 2).cast("int")
    manifest = table(spark, sf_dir, "documents").select("doc_id", "text", F.inline(F.array(F.struct(F.lit(0).alias("char_start"), half.alias("char_end")), F.struct(half.alias("char_start"), F.length("text").alias("char_end")))))
    return manifest.select("doc_id", "char_start", F.md5(packing.token_slices(F.col("text"), F.col("char_start"), F.col("char_end")).cast("binary")).alias("slice_md5"))


QUERIES = {f.__name__: f for f in (char_vocab, byte_token_counts, token_byte_lengths, piece_counts, bpe_train, bpe_encode_stats, token_windows, window_pairs, token_shards, packed_rows, packing_balance, sft_bestfit, sft_skipped_long, label_audit, document_slices)}

_CHARS = "WITH c AS (SELECT unnest(string_split(text, '')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY token)"
_VOCAB = f"{_CHARS}, v AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, encode(token)) + 3 AS INTEGER) AS token_id, n FROM n)"
ORACLES = {
    "char_vocab": f"{_VOCAB} SELECT token, token_id, n FROM v",
    "byte_token_counts": "WITH h AS (SELECT hex(encode(text)) AS h FROM documents), b AS (SELECT unnest(regexp_extract_all(h, '[0-9A-F]{2}')) AS b FROM h) SELECT CAST(CAST('0x' || b AS INTEGER) + 4 AS INTEGER) AS token_id, count(*) AS n FROM b GROUP BY b",
    "token_byte_lengths": f"{_VOCAB} SELECT octet_length(encode(token)) AS bytes, count(*) AS n FROM v GROUP BY 1",
    "token_windows": "SELECT source, CAST(sum(greatest(0, length(text) + 2 - 128)) AS BIGINT) AS windows FROM documents GROUP BY source",
    "window_pairs": "WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM benchmark), w AS (SELECT item_id, t, unnest(range(len(t) - 8)) AS pos FROM t WHERE len(t) > 8) SELECT item_id, CAST(pos AS INTEGER) AS pos, array_to_string(t[pos + 1:pos + 8], ',') AS x, array_to_string(t[pos + 2:pos + 9], ',') AS y FROM w",
    "packing_balance": "SELECT source, CAST(sum(length(text) + 2) AS BIGINT) AS accounted FROM documents GROUP BY source",
    "sft_skipped_long": f"""WITH {PAIRS_SQL}, l AS (SELECT category, length("user") + length(assistant) + 2 AS t FROM pairs) SELECT category, count(*) FILTER (t > 513) AS skipped, count(*) FILTER (t <= 513) AS kept FROM l GROUP BY category""",
    "label_audit": f"""WITH {PAIRS_SQL} SELECT category, CAST(sum(length(assistant)) AS BIGINT) AS supervised, CAST(sum(length("user")) AS BIGINT) AS masked FROM pairs GROUP BY category""",
    "document_slices": "WITH h AS (SELECT doc_id, text, CAST(length(text) // 2 AS INTEGER) AS h FROM documents) SELECT doc_id, 0 AS char_start, md5(trim(substring(text, 1, h), ' ')) AS slice_md5 FROM h UNION ALL SELECT doc_id, h, md5(trim(substring(text, h + 1), ' ')) FROM h",
    "token_shards": """WITH RECURSIVE d AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, CAST(length(text) + 2 AS BIGINT) AS s FROM documents), n AS (SELECT g, max(k) AS n FROM d GROUP BY g),
r AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS docs, true AS al, CAST([] AS STRUCT(t BIGINT, d BIGINT, a BOOLEAN)[]) AS out FROM n
UNION ALL SELECT g, k, (h1 + s) % 20000, CASE WHEN h1 + s < 20000 THEN d1 + 1 ELSE CAST((h1 + s) % 20000 > 0 AS BIGINT) END, CASE WHEN h1 + s < 20000 THEN a1 ELSE (h1 + s) % 20000 = 0 END,
 list_concat(o1, list_transform(range((h1 + s) // 20000), lambda x: struct_pack(t := CAST(20000 AS BIGINT), d := CASE WHEN x = 0 THEN d1 + 1 ELSE 1 END, a := x = 0 AND a1 AND s <= 20000)))
 FROM (SELECT r.g, r.k + 1 AS k, s, CASE WHEN c THEN 0 ELSE held END AS h1, CASE WHEN c THEN 0 ELSE docs END AS d1, c OR al AS a1, list_concat(out, CASE WHEN c THEN [struct_pack(t := held, d := docs, a := al)] ELSE [] END) AS o1 FROM (SELECT r.*, s, held > 0 AND s <= 20000 AND held + s > 20000 AS c FROM r JOIN d ON d.g = r.g AND d.k = r.k + 1) r)),
f AS (SELECT r.g, list_concat(out, CASE WHEN held > 0 THEN [struct_pack(t := held, d := docs, a := al)] ELSE [] END) AS out FROM r JOIN n ON r.g = n.g AND r.k = n.n), u AS (SELECT g, unnest(range(len(out))) AS shard, unnest(out) AS o FROM f)
SELECT g AS source, shard, o.t AS tokens, o.d AS documents, o.a AS aligned FROM u""",
}
