"""Leaks, overlap, memorisation, tuning data and splits."""

import pytest
from corpusloom.operators import contamination as con
from corpusloom.operators import splits, tuning
from pyspark.sql import functions as F


def rec(spark, *texts):
    return con.records(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


def test_last_reference_wins(spark):
    rows = con.exact_leaks(rec(spark, "What is it?"), rec(spark, "what is it", "What IS it!", "other")).collect()
    assert [(r.target_id, r.reference_id) for r in rows] == [(0, 1)]


def test_near_leak_first_wins_ties(spark):
    refs = rec(spark, "please name the largest planet of all", "please name the largest planets of all", "something else")
    rows = con.near_leaks(rec(spark, "please name the largest planet of al", "unrelated words here"), refs).collect()
    assert [(r.target_id, r.reference_id) for r in rows] == [(0, 0)] and rows[0].similarity > 0.9


def test_containment_keeps_word_borders(spark):
    found = con.contained(rec(spark, "the cat sat on", "cat", "a b c d e f"), rec(spark, "Here the cat sat on a mat.", "concatenate", "a b c d e", None)).collect()
    assert sorted((r.phrase_id, r.text_id) for r in found) == [(0, 0), (1, 0)]
    nested = con.nested_phrases(spark.createDataFrame([(0, 0)], "phrase_id long, text_id long"), rec(spark, "the cat sat on", "cat", "dog"))
    assert sorted(r.phrase_id for r in nested.collect()) == [0, 1]


def test_memorization_runs_and_canaries(spark):
    train = "one two three four five six seven eight nine ten eleven twelve"
    row = con.memorization(rec(spark, train + " and more", "nothing like it at all"), rec(spark, train), 4).orderBy("id").collect()
    assert row[0].longest == 12 and row[1].longest == 0 and row[1].overlap == 0
    hit = con.canaries(spark.createDataFrame([(1, "x pico-canary-0001-02 y"), (2, "none")], "id long, t string"), "id", "t").collect()
    assert [(r.id, r.canary) for r in hit] == [(1, "pico-canary-0001-02")]
    risk = spark.range(1).select(con.memorization_risk(F.lit(0.0), F.lit(0), F.lit(1)).alias("a"), con.memorization_risk(F.lit(0.2), F.lit(0), F.lit(0)).alias("b"), con.memorization_risk(F.lit(0.0), F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(risk) == ("high", "medium", "low")


def test_matrix_and_findings(spark):
    corpus = rec(spark, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "lambda mu")
    items = rec(spark, "alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta", "none of that")
    row = con.matrix_pair("p", corpus, items, 4).first()
    assert row.exact_hits == 2 and row.risk == "high" and row.max_overlap_rate == 1
    assert con.matrix_pair("p", corpus.where("false"), items, 4).first().risk == "not_checked"
    found = con.findings(items, rec(spark, "none of that"), corpus)
    assert {(r.kind, r.target_id) for r in found.collect()} == {("duplicate_eval_prompt", 1), ("exact_sft_prompt_leak", 2), ("eval_prompt_in_corpus", 0), ("eval_prompt_in_corpus", 1)}
    assert con.honesty_status(found).first().status == "blocked" and con.honesty_status(found.where("false")).first().status == "ready"


def test_pairs_take_the_latest_user_before_the_answer(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (2, 0, "assistant", "x"), (2, 1, "user", "y"), (3, 0, "user", "u"), (3, 1, "assistant", "v")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in tuning.first_pairs(turns).collect()) == [(1, "b", "c"), (3, "u", "v")]
    assert {r.conv_id for r in tuning.conversations(turns).collect()} == {1, 3}


def test_entropy_statuses_and_families(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "c string")
    e = tuning.category_entropy(rows, "c").first()
    assert e.entropy == 1 and e.entropy_normalized == 1
    assert tuning.category_entropy(rows.where("c = 'a'"), "c").first().entropy == 0
    row = spark.range(1).select(tuning.template_family(F.lit("add-3_12"), F.lit("m")).alias("f"), tuning.template_family(F.lit(None).cast("string"), F.lit("m")).alias("g"), tuning.answer_style(F.lit(None).cast("string"), F.lit("Scratchpad: 1 Final answer: 2")).alias("s"), tuning.sft_status(F.lit(9), F.lit(0), F.lit(0.3)).alias("t"), tuning.eval_status(F.lit(9), F.lit(0), F.lit(0), F.lit(1)).alias("u")).first()
    assert tuple(row) == ("add", "ungrouped:m", "scratchpad", "caution", "blocked")


def test_splits_are_exact_and_keep_groups(spark):
    rows = spark.range(101).withColumn("g", F.col("id") % 6)
    split = splits.holdout_split(rows, "id", 0.1, 1)
    assert split.where("split = 'val'").count() == 10
    assert sorted(map(tuple, split.select("id", "split").collect())) == sorted(map(tuple, splits.holdout_split(rows.repartition(5), "id", 0.1, 1).select("id", "split").collect()))
    assert splits.holdout_split(rows.limit(1), "id", 0.5, 1).where("split = 'val'").count() == 0
    grouped = splits.group_split(rows, "g", 0.3, 1)
    sides = grouped.groupBy("g").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in sides) and grouped.where("split = 'val'").count() >= 30 and grouped.where("split = 'train'").count() > 0


def test_weights_samples_and_quotas(spark):
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)], "c string")
    w = {r.c: r.weight for r in splits.category_weights(rows, "c").collect()}
    assert w == {"a": pytest.approx(1 / 9), "b": 1.0}
    table = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "name string, weight double")
    drawn = {r.name: r["count"] for r in splits.weighted_sample(table, "name", "weight", 4000, 5).groupBy("name").count().collect()}
    assert sum(drawn.values()) == 4000 and abs(drawn["a"] - 3000) < 150
    assert splits.quota_floor(10, {"a": 0.55, "b": 0.25, "c": 0.2}) == {"a": 6, "b": 2, "c": 2}
    quotas = {r["name"]: r.quota for r in splits.quota_largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, weight double"), 10).collect()}
    assert quotas == {"a": 3, "b": 3, "c": 4}
