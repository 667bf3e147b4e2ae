"""The pipeline's stages on small tables, each against a plain version, and odd rows."""

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from corpusloom.llm import mixing, queries
from corpusloom.llm.decontamination import brute_force

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("riv", "hou", "gre", "sea", "fie") for b in ("er", "se", "en", "side", "ld", "ing")]
KEY = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"


def rows():
    rng = random.Random(1)
    out, labels = [], []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(rng.randint(40, 90))]
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        out.append([i, text, "en", rng.choice(["a", "b", "b", None]), len(text)])
        if i % 10 == 5:
            out[-1][1] += f' token = "{KEY}" end'
        labels.append((i, int(not bad), 0))
    out[1][1] = out[2][1]
    return [tuple(r) for r in out], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels = rows()
    odd = [(None, docs[6][1] + " odd", "en", "a", 1), (900, None, None, None, None), (901, "", "en", "a", 0), (902, "riverside " * 30_000, "en", "a", 1), (902, "riverside " * 30_000, "en", "a", 1)]
    spark.createDataFrame(docs + odd, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, docs[9][1]), (2, "absent words only")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.columns
    good = {i for i, q, _ in rows()[1] if q}
    found = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == before
        docs = spark.createDataFrame(docs.collect(), DOCS)
        found[name] = docs.collect()
    ids = lambda name: [r.doc_id for r in found[name] if r.doc_id is not None and r.doc_id < 900]
    assert len(set(ids("quality_classifier")) ^ good) <= 3
    assert 2 not in ids("minhash_near_dedup") and 1 in ids("minhash_near_dedup")
    items = [(1, rows()[0][9][1]), (2, "absent words only")]
    hit = {d for d, _, n, *_ in brute_force([(r.doc_id, r.text) for r in found["minhash_near_dedup"]], items) if n}
    assert 9 in hit
    assert {r.doc_id for r in found["benchmark_decontamination"]} == {r.doc_id for r in found["minhash_near_dedup"]} - hit
    masked = {r.doc_id: r for r in found["secret_scans"]}
    assert KEY not in masked[5].text and "[SECRET]" in masked[5].text and masked[5].n_chars == len(masked[5].text)
    assert len(found["secret_scans"]) == len(found["benchmark_decontamination"])
    mixed = cp.STAGES[-1][1](spark, docs, folder)
    assert mixed.columns == [*before, "copy"]
    copies = mixed.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies if r.doc_id is not None) <= 3
    clash = cp.STAGES[-1][1](spark, docs.withColumn("copy", F.lit("old")), folder)
    assert clash.columns == mixed.columns and clash.where("copy < 1").count() == 0


def test_decontamination_judges_rows_not_ids(spark, tmp_path):
    spark.createDataFrame([(1, "leaked words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "some leaked words of an item here"), (1, "a clean text"), (None, "leaked words of an item"), (None, "clean as well"), (2, None), (2, "")]
    kept = cp.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [(1, "a clean text"), (None, "clean as well"), (2, None), (2, "")]))


def test_mixing_numbers_the_copies_of_rows_alike(spark):
    rows = [(1, "same words here", "a")] * 6 + [(i, "other words " * 4, "b") for i in range(10, 14)]
    mixed = cp.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    copies = sorted(r["copy"] for r in mixed if r.doc_id == 1)
    assert copies == list(range(1, len(copies) + 1)) and 0 < len(copies) <= 18
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").collect()
    assert len(copies) == sum(r.copies for r in plan)


def test_run_is_its_stages(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]
    first, again = cp.run(spark, folder).collect(), cp.run(spark, folder).collect()
    assert first and sorted(map(str, first)) == sorted(map(str, again))


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_queries_over_small_tables(spark):
    path = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{path}/documents.parquet").count()
    for name in ("op1_pseudo_likelihood", "op3_toxicity", "op4_decontamination", "op6_mixing", "op7_neardup", "op10_quality"):
        assert queries.QUERIES[name](spark, path).count() == n
