"""Corpus statistics, quality, imports and duplicates on small documents."""

import pytest
from corpusloom.operators import corpus, dedup, imports
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_duplicate_rate_ignores_case_and_white_space(spark):
    row = corpus.corpus_stats(docs(spark, "same document", "Same   document\n", "different document")).first()
    assert row.num_documents == 3 and row.duplicate_document_rate == pytest.approx(1 / 3)
    assert row.num_characters == 13 + 16 + 18 + 2


def test_stats_of_nothing_and_of_nulls(spark):
    empty = corpus.corpus_stats(docs(spark, "x").where("false")).first()
    assert empty.num_documents == 0 and empty.num_characters == 0 and empty.duplicate_line_rate == 0
    row = corpus.corpus_stats(docs(spark, None, "", "a\n\na\nb é")).first()
    assert row.num_lines == 4 and row.empty_line_rate == 0.25 and row.duplicate_line_rate == pytest.approx(1 / 3)
    assert corpus.training_budget(corpus.corpus_stats(docs(spark, "x").where("false"))).first().preset == "blocked"


def test_stats_by_a_null_key(spark):
    table = spark.createDataFrame([(1, "a\na", None), (2, "b", "x")], "doc_id long, text string, k string")
    got = {r.k: r.duplicate_line_rate for r in corpus.corpus_stats(table, ["k"]).collect()}
    assert got == {None: 0.5, "x": 0.0}


def test_quality_rules(spark):
    long = "\n".join(f"quality source line {i}" for i in range(80))
    rows = {r.doc_id: r for r in corpus.quality_filtered(docs(spark, long, "tiny", None, "x" * 600, "bad\x00" + "y" * 1200 + "\nz"), 80).collect()}
    assert rows[0].quality_score == 100 and rows[0].included
    assert rows[1].reason == "below_min_score" and rows[1].quality_flags == ["short_document", "below_min_score"]
    assert rows[2].reason == "empty_text"
    assert rows[3].quality_flags[:2] == ["small_document", "long_single_line"] and rows[3].quality_score == 80
    assert "extraction_noise" in rows[4].quality_flags
    with pytest.raises(ValueError):
        corpus.checked_bound(101)


def test_readiness(spark):
    assert corpus.readiness(corpus.readiness_checks(corpus.corpus_stats(docs(spark, "x").where("false")))).first().status == "blocked"
    assert corpus.readiness(corpus.readiness_checks(corpus.corpus_stats(docs(spark, "one short text")))).first().status == "caution"
    fine = ["\n".join(f"line {k} of text {i}" for k in range(60)) for i in range(4)]
    assert corpus.readiness(corpus.readiness_checks(corpus.corpus_stats(docs(spark, *fine)))).first().status == "ready"


def test_offsets_follow_the_joined_text(spark):
    texts = ["  abc ", "", "de\nf", None, "g"]
    joined = "\n\n".join(t.strip() for t in texts if t and t.strip())
    rows = corpus.document_offsets(docs(spark, *texts)).collect()
    assert {joined[r.char_start : r.char_end] for r in rows} == {"abc", "de\nf", "g"}


def test_evenly_spaced_rounds_halves_to_even(spark):
    table = spark.range(10).withColumnRenamed("id", "doc_id")
    got = sorted(r.position for r in corpus.evenly_spaced(table, 4).collect())
    assert got == sorted({round(i * 9 / 3) for i in range(4)})
    assert corpus.evenly_spaced(table, 20).count() == 10


def test_import_bounds_rows_that_are_looked_at(spark):
    rows = imports.import_rows(docs(spark, "long enough", " ", None, "no", "long enough too"), "doc_id", min_chars=4, max_rows=4)
    assert [r.reason for r in rows.orderBy("doc_id").collect()] == ["included", "empty_text", "text_column_not_string", "below_min_chars"]
    assert imports.import_rows(docs(spark, "a"), "doc_id", text_col="body").first().reason == "missing_text_column"
    shards = imports.shard_stats(imports.sharded(imports.import_rows(docs(spark, "ab", "cd\ne", "f"), "doc_id"), "doc_id", 2)).orderBy("shard").collect()
    assert [(s.num_documents, s.num_characters, s.num_lines) for s in shards] == [(2, 8, 4), (1, 1, 1)]


def test_shards_are_written(spark, tmp_path):
    imports.write_shards(imports.sharded(imports.import_rows(docs(spark, "ab", "cd", "f"), "doc_id"), "doc_id", 2), str(tmp_path / "out"), "doc_id")
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"ab", "cd", "f", ""}


def test_near_duplicate_documents(spark):
    base = [f"token{i}" for i in range(120)]
    other = base[:55] + ["changed"] + base[56:]
    table = docs(spark, " ".join(base), " ".join(other), " ".join(f"other{i}" for i in range(120)), "too short")
    pairs = dedup.near_pairs(table)
    assert [(r.left_id, r.right_id) for r in pairs.collect()] == [(0, 1)]
    rate = dedup.near_rate(table, pairs).first()
    assert rate.pairs == 1 and rate.checked == 4 and rate.near_duplicate_rate == 0.5


def test_near_bands_look_back_64_entries(spark):
    text = " ".join(f"w{i}" for i in range(40))
    assert dedup.near_pairs(docs(spark, *[text] * 150)).count() == sum(min(64, i) for i in range(150))


def test_near_prompts_use_the_matching_ratio(spark):
    rows = spark.createDataFrame([(1, "tell me about the old river bank"), (2, "tell me about the old river banks"), (3, "tell me a joke"), (4, "Tell  me a joke")], "id long, user string")
    assert [(r.left_id, r.right_id) for r in dedup.near_prompts(rows, "id").collect()] == [(1, 2)]
    assert dedup.duplicate_prompts(rows).first().n == 2


def test_running_total_over_ranges(spark):
    rows = corpus.running_total(spark.range(1000).repartition(7), "id", F.col("id") + 1).collect()
    assert all(r["__before"] == r.id * (r.id + 1) // 2 for r in rows)


def test_duplicate_prompts_keep_letters_and_line_breaks_as_sql_does(spark, tmp_path):
    import duckdb
    from corpusloom.plans import audit

    texts = ["Erß one", "erß two", "erss three", "A.\nB c", "a.\nb d", "A. b", "a. c", " x", " y", "Éa", "éa z", "", None, None]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(path)
    got = {tuple(r) for r in audit.duplicate_prompts(spark, str(tmp_path)).collect()}
    want = set(duckdb.sql(audit.ORACLES["duplicate_prompts"].replace("FROM conversations", f"FROM '{path}/*.parquet'")).fetchall())
    assert got == want and ("erß", 2) in got and ("a.\nb", 2) in got
