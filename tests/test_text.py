"""Text expressions against the string methods they stand for."""

from corpusloom.functions import text as t
from pyspark.sql import functions as F

SAMPLES = ["", " ", "a", "  A  b\tc\n", "x\r\ny\rz\n", "tail\n\n", "nb sp line", "\x0bv\x1cfs", "Füß Çà", "a\x85b", "ALL caps-9 and_more", "end.\n"]


def test_norm_strip_lines(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string").select("s", t.norm_ws("s").alias("n"), t.strip("s").alias("st"), t.lines("s").alias("l"), t.tokens("s").alias("k"), t.n_non_ascii("s").alias("w")).collect()
    import re

    for r in rows:
        assert r.n == " ".join(r.s.lower().split())
        assert r.st == r.s.strip()
        assert r.l == r.s.splitlines()
        assert r.k == re.findall("[a-z0-9]+", r.s.lower())
        assert r.w == sum(ord(c) > 127 for c in r.s)


def test_ngrams_jaccard_glob(spark):
    row = spark.createDataFrame([("a b c d", "b c x", "")], "a string, b string, c string").select(
        t.ngrams(t.tokens("a"), 3).alias("g"), t.ngrams(t.tokens("b"), 4).alias("none"), t.set_jaccard(t.tokens("a"), t.tokens("b")).alias("j"), t.set_jaccard(t.tokens("a"), t.tokens("c")).alias("z"), t.padded_contains(F.col("a"), F.lit("b c")).alias("in"), t.padded_contains(F.col("a"), F.lit("b c d e")).alias("out"), t.glob(F.lit("bench_math"), ["bench_*"]).alias("g1"), t.glob(F.lit("Bench_math"), ["bench_*"]).alias("g2"), t.slug(F.lit(" A-b c! ")).alias("s"), t.slug(F.lit("!")).alias("s2")
    ).first()
    assert row.g == ["a b c", "b c d"] and row.none == [] and row.j == 2 / 5 and row.z == 0
    assert row["in"] and not row.out and row.g1 and not row.g2 and row.s == "a_b_c" and row.s2 == "general"


def test_preview_is_bounded(spark):
    row = spark.range(1).select(t.preview(F.lit("word " * 60)).alias("p"), t.preview(F.lit(" short  text ")).alias("q")).first()
    assert len(row.p) <= 122 and row.p.endswith("...") and row.q == "short text"
