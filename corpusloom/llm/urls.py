"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule lists a canonical URL, host then path, like ``example.net/en/``, with a verdict. It fits the host itself and all
its subdomains when the URL's path starts with the rule's; the longest rule that fits wins. So a URL is asked for
under a few keys: each suffix of its host (of as many labels as the longest listed host) with each beginning of its path
(of the lengths that listed paths have). A key goes through the Bloom filter first: a hash names one block
of eight 64-bit words, a second hash one bit in each word, and all eight must be set. Keys that pass are possible
hits and meet the rules in an exact hash join, which removes the false positives.

The filter's blocks are a table of at most ``MAX_BLOCKS`` rows, a proven bound, so it is broadcast; a list that is too long for it
lets more keys pass, and stays exact. Keys are taken from distinct URLs, so a hot URL is one row there; the last join
is one of equal URLs, which adaptive execution splits where a URL is hot. All expressions are built in.

Defined results: a null URL, or one without ``://``, has empty host and path, and fits no rule. A URL without a path has
the empty path, which starts with no listed path but the empty one. A rule listed with both verdicts blocks. Repeated rows repeat
their result; other columns pass through, and those that clash with the added ones are replaced; URLs of any length are asked for whole; empty
rules leave every URL to ``otherwise``, and an empty table gives an empty result. Of two rules
of one length that fit (a longer host, or a longer path), the one that is greater as text wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS_PER_BLOCK = 8
KEYS_PER_BLOCK = 32
MAX_BLOCKS = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = "(?s)\\A.*?://([^/?#]*)([^?#]*)"
#: The listed rules of the query: host and path, verdict. Fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``rule, verdict, host, path`` of ``rules(rule, verdict)``: one row for each listed key, block before allow."""
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(F.lit(""))
    parts = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select(host.alias("host"), path.alias("path"), "verdict").where(F.col("host") != "")
    return parts.groupBy(F.concat("host", "path").alias("rule"), "host", "path").agg(F.max("verdict").alias("verdict"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit("bits")), word * 6).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, words`` of the keys in column ``rule``; blocks without any bit are left out."""
    words = F.explode(F.sequence(F.lit(0), F.lit(WORDS_PER_BLOCK - 1))).alias("word")
    bits = keys.select("rule", _block(F.col("rule"), blocks).alias("block"), words).select("block", "word", F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("rule"), F.col("word"))).alias("bit"))
    ored = bits.groupBy("block", "word").agg(F.bit_or("bit").alias("bits"))
    return ored.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("words"))


def might_contain(key: Column, words: Column) -> Column:
    """Whether all eight bits of the key are set in its block."""
    return F.forall(F.sequence(F.lit(0), F.lit(WORDS_PER_BLOCK - 1)), lambda i: F.call_function("shiftright", F.element_at(words, i + 1), _bit(key, i)).bitwiseAND(F.lit(1)) == 1)


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The keys under which a URL may be listed: suffixes of the host times beginnings of the path."""
    names = F.split(host, "\\.")
    n = F.size(names)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(names, i, n), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``."""
    listed = canonical_rules(rules)
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    kept = pages.drop("host", "path", "rule", "verdict")
    plain = kept.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if not size.n:
        return plain.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    blocks = min(MAX_BLOCKS, max(1, -(-size.n // KEYS_PER_BLOCK)))
    bloom = bloom_filter(listed, blocks)
    urls = plain.where(F.col("host") != "").select(F.col(url_col).alias("__url"), "host", "path").distinct()
    keys = urls.select("__url", F.explode(keys_of(F.col("host"), F.col("path"), size.labels, size.lengths)).alias("key"))
    possible = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block").where(might_contain(F.col("key"), F.col("words"))).select("__url", "key")
    exact = possible.join(listed.select(F.col("rule").alias("key"), F.col("verdict").alias("__verdict")), "key")
    best = exact.groupBy("__url").agg(F.max_by(F.struct("key", "__verdict"), F.struct(F.length("key"), "key")).alias("__best"))
    joined = plain.join(best, F.col(url_col) == F.col("__url"), "left")
    return joined.withColumn("rule", F.col("__best.key")).withColumn("verdict", F.coalesce("__best.__verdict", F.lit(otherwise))).drop("__url", "__best")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule string, verdict string")


ORACLE = """
WITH p AS (
    SELECT page_id, url,
           CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM p
), rules(rule, host, path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
    SELECT p.page_id, p.host, p.path,
           (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM rules r
            WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)) AS best
    FROM parts p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fits
"""

