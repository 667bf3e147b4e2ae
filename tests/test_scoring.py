"""Scores, breakdowns and failures."""

import random
import re

import pytest
from corpusloom.operators import scoring as sc
from pyspark.sql import functions as F

ROW = "reply string, user string, category string, answerable boolean, must_include array<string>, must_include_any array<array<string>>, must_not_include array<string>, required_entities array<string>, min_words int, max_words int, min_chars int, max_chars int"


def row(reply, user="What is the name of the thing?", must=(), any_of=(), bad=(), entities=(), words=(None, None), answerable=True):
    return (reply, user, "c", answerable, list(must), [list(g) for g in any_of], list(bad), list(entities), words[0], words[1], None, None)


def test_phrases_are_token_aware(spark):
    has = lambda text, phrase: spark.range(1).select(sc.has_phrase(F.lit(text), F.lit(phrase)).alias("x")).first().x
    assert not has("it is not so", "no") and has("say no more", "no") and has("Story: one", "Story:") and not has("story one", "Story:")
    assert has("a b-c d", "B C") and has("anything", " ") and has("50% off", "%") and not has("x", "!")


def test_replies_are_scored(spark):
    data = [row("The answer is Paris now", must=["paris"]), row("no", must=["yes"], words=(2, None)), row("A or B", any_of=[["z", "b"]], bad=["or"]), row("What is the name of the thing? it is x"), row("ok\n user: hi"), row(""), row("a b c a b c a b c", answerable=False)]
    got = sc.scored(spark.createDataFrame(data, ROW)).withColumn("reasons", sc.failure_reasons()).withColumn("clusters", sc.failure_clusters(F.col("reasons"), F.col("answerable"), F.col("refusal"))).collect()
    assert [r.passed for r in got] == [True, False, False, False, False, True, True]
    assert got[1].reasons == ["missing_required", "length_violation"] and got[1].clusters == ["content_mismatch", "length_control"]
    assert got[2].reasons == ["forbidden_phrase"] and got[2].support_rate == 1
    assert got[3].echo == ["starts_with_user_prompt"] and got[4].echo == ["chat_role_label"] and got[5].echo == []
    assert got[5].reasons == ["empty_reply"] and got[6].reasons == ["repetitive_reply"] and "refusal_failure" in got[6].clusters


def test_overlap_measures(spark):
    data = [("the cat sat", "the cat sat down"), ("", "x"), ("a", ""), ("a", None), ("a a b", "a b b")]
    rows = spark.createDataFrame(data, "a string, b string").select(sc.token_f1(F.col("a"), F.col("b")).alias("f"), sc.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()
    assert rows[0].f == pytest.approx(6 / 7) and rows[0].r == 0.75 and rows[1].f == 0 and rows[1].r == 0
    assert rows[2].f is None and rows[3].r is None and rows[4].f == pytest.approx(4 / 6) and rows[4].r == pytest.approx(2 / 3)


def test_lcs_is_the_table(spark):
    import random

    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]) for _ in range(60)]

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(sc.lcs_length("a", "b").alias("n")).collect()
    assert [r.n for r in rows] == [plain(a, b) for a, b in pairs]


def test_candidates(spark):
    r = spark.createDataFrame([("Let me see.\nFinal answer: 1,200\nDone",), ("",)], "t string").select(sc.answer_forms(F.col("t")).alias("c")).collect()
    assert r[0].c == ["let me see final answer 1200 done", "done", "final answer 1200", "1200"] and r[1].c == []


def test_breakdown_unpivots_and_intervals_hold_the_rate(spark):
    data = [row("yes", must=["yes"])] * 3 + [row("no", must=["yes"])]
    scored = sc.scored(spark.createDataFrame(data, ROW)).withColumn("split", F.lit("x"))
    rows = sc.breakdown(scored, ["category", "split"]).collect()
    assert {(r.field, r.num_examples, r.pass_rate) for r in rows} == {("category", 4, 0.75), ("split", 4, 0.75)}
    assert sc.weak(sc.breakdown(scored, ["category"])).count() == 1
    ci = sc.bootstrap_ci(scored, "category").first()
    assert ci.low <= 0.75 <= ci.high
    low, high = sc.exact_bootstrap([True, True, True, False])
    assert low <= 0.75 <= high and sc.exact_bootstrap([True, True, True, False]) == (low, high)


def test_choices(spark):
    rows = spark.createDataFrame([(1, "A", 0, -1.0, -2.0), (1, "B", 1, -1.0, -2.0), (1, "B", 1, -3.0, -1.0), (1, "C", 2, -4.0, -4.0)], "item long, label string, position int, mean double, raw double")
    r = sc.choice_predictions(rows).first()
    assert r.label == "A" and r.margin == 0


def plain_forms(text):
    """The rule of answer candidates in plain Python."""
    marked = re.compile(r"(?:final\s+answer|answer|result|therefore)\s*[:=]\s*(.+)$", re.IGNORECASE)
    found = [text.strip()]
    for line in reversed([x.strip() for x in text.splitlines() if x.strip()]):
        found.append(line)
        if hit := marked.search(line):
            found.append(hit[1].strip())
            break
    found += re.findall(r"[-+]?\d+(?:[.,]\d+)*(?:\.\d+)?%?", text)[-1:] + re.findall(r"[A-Za-z0-9]+", text)[-1:]
    cut = (" ".join(re.findall(r"[-+]?\d+(?:\.\d+)?%?|[a-z0-9]+", x.strip().lower().replace(",", ""))) for x in found)
    return list(dict.fromkeys(x for x in cut if x))


def test_answer_forms_are_the_plain_ones(spark):
    rng = random.Random(4)
    parts = ["Answer: 7", "result = 1,200.5 kg", "so", "-3.5%", "therefore: yes", "\n", "\n\n", "  ", "final answer", "12", "a, b", "."]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["", " \n "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", sc.answer_forms(F.col("t")).alias("f")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.f == plain_forms(r.t), r.t


def test_findings_decide_whether_a_row_passes(spark):
    none = []
    base = ("ask", "it is 12 units", none, none, none, none, None, None, None, None)
    schema = "user string, reply string, must_include array<string>, must_include_any array<array<string>>, must_not_include array<string>, required_entities array<string>, min_words int, max_words int, min_chars int, max_chars int, normalized_answers array<string>, normalized_answer_required boolean, require_corpus_support boolean, corpus_support_rate double, correct_choice string, choice_predicted string, reference_answer string, answerable boolean"
    extra = [
        ([], False, False, None, None, None, None, True),
        (["12"], True, False, None, None, None, None, True),
        (["13"], True, False, None, None, None, None, True),
        (["13"], False, True, 0.1, None, None, None, True),
        (None, None, True, None, "A", "B", "wholly other words", True),
        (None, True, True, 0.25, "A", "A", "it is 12 units", False),
    ]
    rows = sc.scored(spark.createDataFrame([(*base, *x) for x in extra], schema)).select("passed", sc.failure_reasons().alias("r")).collect()
    assert [r.passed for r in rows] == [True, True, False, False, True, False]
    assert [r.r for r in rows] == [[], [], ["normalized_answer_mismatch"], ["weak_corpus_support"], ["wrong_choice", "low_reference_overlap"], ["normalized_answer_mismatch"]]


def test_bootstrap_draws_the_law_of_the_plain_one(spark):
    rng = random.Random(3)
    values = [rng.random() < 0.7 for _ in range(120)]
    row = sc.bootstrap_ci(spark.createDataFrame([("a", v) for v in values], "k string, passed boolean"), "k").first()
    low, high = sc.exact_bootstrap(values)
    assert abs(row.low - low) < 0.03 and abs(row.high - high) < 0.03


def test_repetition_cuts_a_text_once_for_each_rate(spark):
    import duckdb
    from corpusloom.plans import evaluation

    texts = ["", "a b", "a b c a b c", "A a a a a", "x y z " * 2_000, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rate, unique = sc.repetition(F.col("text"))
    out = frame.select("doc_id", rate.alias("r"), unique.alias("u"))
    # one pattern for each rate, none of them within the walk over the n-grams
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    documents = frame.toPandas()  # noqa: F841
    want = duckdb.sql(evaluation.ORACLES["repetition"]).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
