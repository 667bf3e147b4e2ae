"""Runs, generated rows, readers, sinks and streams."""

import json

import pytest
from corpusloom.operators import runs, synthesis as sy
from corpusloom.sources import readers, sinks
from corpusloom.streaming import progress
from pyspark.sql import functions as F


def test_leaderboard_and_registry(spark):
    data = [("r1", "bench_math", True), ("r1", "x", False), ("r2", "bench_math", True), ("r2", "x", True)]
    board = runs.leaderboard(spark.createDataFrame(data, "run string, category string, passed boolean"))
    assert runs.best_run(board).first().run == "r2"
    assert [r.suite for r in board.orderBy("place").collect()] == ["overall", "overall", "bench_math", "bench_math"]
    reg = runs.registry(spark.createDataFrame([("a", "warn", 0.9, None), ("b", "approved", 0.1, 0.2), ("c", None, None, None)], "run string, status string, pass_rate double, sft_fit_rate double")).orderBy("place").collect()
    assert [r.run for r in reg] == ["b", "a", "c"] and [r.best for r in reg] == [True, False, False]


def test_compare_without_and_with_a_baseline(spark):
    schema = "run string, pass_rate double, val_loss double, support_rate double, echo_rate double, fit_rate double, bpb double"
    one = spark.createDataFrame([("a", 0.9, 1.0, 1.0, 0.0, 0.9, 1.0)], schema)
    assert runs.compared(one).first().baseline is None and runs.regression_issues(runs.compared(one)).count() == 0
    assert runs.next_experiment(runs.compared(one)).first().next == "add_comparison_run"
    two = one.unionByName(spark.createDataFrame([("b", 0.5, 2.0, 1.0, 0.0, 0.9, None)], schema))
    row = runs.compared(two).first()
    assert row.best == "a" and row.baseline == "b" and row.pass_rate_delta == pytest.approx(0.4)
    assert runs.next_experiment(runs.compared(two)).first().next == "harder_eval" and runs.best_bpb(two).first().run is None


def test_loss_traces(spark):
    trace = spark.createDataFrame([("r", 1, 3.0, 3.1, 1.0, 1.0), ("r", 2, 2.0, 2.5, 1.0, 2.0), ("r", 3, 4.0, 2.9, 9.0, 4.0)], "run string, step long, train_loss double, val_loss double, grad_norm double, seconds double")
    d = runs.loss_diagnostics(trace).first()
    assert d.best_step == 2 and d.status == "watch-val-regression" and d.evals_after_best == 1
    assert {r.recommendation for r in runs.loss_recommendations(runs.loss_diagnostics(trace)).collect()} == {"use_best_checkpoint", "shorten_stage"}
    s = runs.stability(trace).first()
    assert s.spikes == 1 and s.max_grad == 9 and s.status == "warn"
    b = runs.spike_baseline(trace).first()
    assert b.spikes == 0 and b.baseline == pytest.approx(0.95 * (0.95 * 3 + 0.05 * 2) + 0.05 * 4)
    t = runs.throughput(trace, 100).orderBy("step").collect()
    assert [r.tokens_per_sec for r in t] == [100, 100, 50]


def test_seeds_gate_and_grid(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = {r.metric: r for r in runs.multi_seed(rows, ["a", "b"]).collect()}
    assert set(got) == {"a"} and got["a"].std == pytest.approx(2**0.5) and runs.multi_seed(rows.limit(1), ["a"]).first()["std"] == 0
    gate = spark.createDataFrame([("a", "ready", "ready", 0.9, 0.9, 0.9, 0.9, 0.0, 0.0), ("b", "ready", "ready", 0.9, 0.9, 0.9, 0.9, 0.2, 0.0), ("c", "ready", "ready", 0.1, None, 0.9, 0.9, 0.0, 0.0)], "run string, preflight_status string, honesty_status string, sft_fit_rate double, heldout_fit_rate double, eval_pass_rate double, refusal_rate double, echo_rate double, unsupported_rate double")
    assert {r.run: r.status for r in runs.release_gate(gate, F.lit(False)).collect()} == {"a": "approved", "b": "blocked", "c": "warn"}
    one = lambda v, n, t: spark.createDataFrame([(x,) for x in v], f"{n} {t}")
    assert runs.sweep_grid(one(["x", "y"], "sampling", "string"), one([1e-3, 1e-4], "lr", "double"), one([10], "steps", "int")).count() == 4
    with pytest.raises(Exception, match="two candidates"):
        runs.sweep_grid(one(["x", "x"], "sampling", "string"), one([1e-3], "lr", "double"), one([10], "steps", "int")).collect()


def test_generated_rows(spark):
    for r in sy.math_rows(spark, 200, "eval").collect():
        assert eval(r.expression) == r.answer and r.answer >= 0
    for r in sy.spelling_rows(spark, 40).collect():
        assert r.answer == [" ".join(r.word), str(len(r.word)), r.word[::-1], r.word[0], r.word[-1]][r.mode]
    import itertools

    orders = spark.range(24).select("id", sy.permuted(F.array(*map(F.lit, "wxyz")), F.col("id")).alias("o")).orderBy("id").collect()
    assert [tuple(r.o) for r in orders] == list(itertools.permutations("wxyz"))
    pool = sy.operand_pool(spark.range(10), "id")
    assert pool.where("split = 'train'").count() == 8


def test_starters(spark):
    text = "The Quick Brown Fox jumps across several wooden bridges. It sleeps. Another Clever Animal wanders through distant valleys slowly!"
    docs = spark.createDataFrame([(i, text.replace("Fox", f"Fox{i}")) for i in range(4)], "doc_id long, text string")
    assert sy.sentences(docs).count() == 8
    rows = sy.eval_starter(docs, 6).collect()
    assert len(rows) == 8 and sum(r.category == "domain_transfer" for r in rows) == 2 and all(r.must_include for r in rows)
    sft = sy.sft_starter(docs, 5, ["Say: {}", "Tell: {}"])
    assert sft.where("user like 'Say: %'").count() == 3
    pref = sy.preference_starter(sft).collect()
    assert len(pref) == 5 and all(r.chosen != r.rejected for r in pref)


def test_slices_and_unique_rows(spark):
    rows = spark.createDataFrame([(1, "bench_a", "p"), (2, "bench_b", "q"), (3, "other", "p"), (4, "bench_c", "p"), (5, "bench_d", "r")], "i long, c string, t string")
    assert {r.i for r in sy.sliced(rows, "c", ["bench_*"], ["*_b"]).collect()} == {1, 4, 5}
    assert {r.i for r in sy.unique_rows(rows, spark.createDataFrame([("q",)], "key string"), F.col("t"), "i", 9).collect()} == {1, 5}


def test_external_answers(spark):
    rows = spark.createDataFrame([(1, "Q?", ["A", "B"], ["x", "y"], "2", None), (2, "Q?", ["A", "B"], ["x", "y"], "a", "s"), (3, "Q?", ["A", "B"], ["x", "y"], "0", "s")], "id long, question string, labels array<string>, choices array<string>, answer string, category string")
    got = {r.id: (r.correct_choice, r.reference, r.category) for r in sy.external_choices(rows, "b", "test").collect()}
    assert got == {1: ("B", "B. y", "external_b"), 2: ("A", "A. x", "external_s"), 3: ("A", "A. x", "external_s")}
    with pytest.raises(Exception, match="no choice"):
        sy.external_choices(rows.withColumn("answer", F.lit("Z")), "b", "test").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_bytes(b"hello \xff")
    (tmp_path / "c/b.md").write_text("  ")
    (tmp_path / "c/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "c/e.exe").write_text("no")
    docs = readers.documents(spark, str(tmp_path / "c")).collect()
    assert [r.text for r in docs] == ["hello �"]
    reasons = {r.path[-5:]: r.reason for r in readers.extracted(readers.corpus_files(spark, str(tmp_path / "c")), {".pdf": lambda b: 1 / 0}).collect()}
    assert reasons["d.pdf"] == "extract_failed:ZeroDivisionError"
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"user": "u", "assistant": "a"}\n\n[1]\nbad\n{"user": "v", "assistant": "b", "category": " c "}\n')
    assert [r.line for r in readers.json_lines(spark, path, readers.CHAT).orderBy("line").collect()] == [1, 5]
    assert [r.bad for r in readers.json_lines(spark, path, readers.CHAT, "validated").orderBy("line").collect()] == [False, True, True, False]
    with pytest.raises(Exception, match="bad JSON"):
        readers.json_lines(spark, path, readers.CHAT, "strict").collect()


def test_rows_of_files(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    chat = readers.chat_rows(spark, lines("chat.jsonl", {"user": " u ", "assistant": "a"}, {"user": "v", "assistant": "b", "category": "k", "group_id": "g"})).orderBy("line").collect()
    assert [(r.user, r.category, r.group) for r in chat] == [("u", "chat", None), ("v", "k", "g")]
    item = readers.eval_rows(spark, lines("eval.jsonl", {"user": "u", "must_include": ["x"], "expected": "y", "answerable": False})).first()
    assert item.must_include == ["x", "y"] and item.category == "unanswerable" and item.split == "default"
    conv = readers.conversations(spark, lines("conv.jsonl", {"messages": [{"role": "User", "content": "u"}, {"role": "assistant", "content": "a"}], "system": "s"}, {"messages": [{"role": "user", "content": "u"}]}, {"user": "x", "assistant": "y"})).orderBy("line").collect()
    assert [[m.role for m in r.messages] for r in conv] == [["system", "user", "assistant"], ["user", "assistant"]]
    arc = readers.external_benchmark(spark, lines("arc.jsonl", {"id": "1", "question": "q", "choices": {"label": ["A", "B"], "text": ["x", "y"]}, "answerKey": "B"}), "arc")
    assert sy.external_choices(arc, "arc", "test").first().reference == "B. y"
    (tmp_path / "m.csv").write_text("question,A,B,C,D,answer\nq1,a,b,c,d,C\nshort,a\n")
    assert readers.external_benchmark(spark, str(tmp_path / "m.csv"), "mmlu_csv").count() == 1


def test_recipes_and_packs(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/keep.txt").write_text("x")
    (tmp_path / "s/drop.tmp").write_text("x")
    recipe = readers.Recipe.parse(json.dumps({"name": "r", "sources": ["s", {"path": "none"}], "exclude": ["*.tmp"]}))
    got = {r.path.rsplit("/", 1)[-1]: r.skip for r in recipe.candidates(spark, str(tmp_path)).collect()}
    assert got == {"keep.txt": None, "drop.tmp": "recipe_excluded", "none": "missing_source"}
    with pytest.raises(ValueError):
        readers.Source.parse({"label": "no path"})
    assert readers.Pack.parse('{"corpus": "c", "chat_input": "h"}', "/p").chat == "/p/h"
    with pytest.raises(ValueError):
        readers.Pack.parse('{"corpus": {"input": "a", "recipe": "b"}}', "/p")


def test_corpus_of_path_recipe_or_pack(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("first")
    (tmp_path / "s/b.txt").write_text("second")
    (tmp_path / "r.json").write_text(json.dumps({"sources": [{"path": "s", "label": "x"}, "gone"], "exclude": ["b.*"]}))
    assert readers.corpus(spark, str(tmp_path / "s")).count() == 2
    recipe = readers.Recipe.parse((tmp_path / "r.json").read_text())
    assert [(r.text, r.label) for r in readers.corpus(spark, recipe=recipe, root=str(tmp_path)).collect()] == [("first", "x")]
    pack = readers.Pack.parse(json.dumps({"corpus": {"recipe": "r.json"}}), str(tmp_path))
    assert readers.corpus(spark, pack=pack, read=lambda p: open(p).read()).count() == 1
    with pytest.raises(ValueError):
        readers.corpus(spark)


def test_preference_files(spark, tmp_path):
    rows = [{"prompt": "p", "winner": "a", "loser": "b"}, {"user": "u", "chosen": "same", "rejected": " same "}, {"user": "u", "chosen": "x"}]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    assert [tuple(r) for r in readers.preferences(spark, str(tmp_path / "p.jsonl")).collect()] == [("p", "a", "b")]


def test_manifest_slices(spark):
    text = spark.createDataFrame([("c", "abc\n\nde")], "path string, text string")
    good = spark.createDataFrame([("c", 0, 3), ("c", 5, 7), ("c", None, 9)], "path string, char_start int, char_end int")
    assert sorted(r.text for r in readers.manifest_slices(text, good).collect()) == ["abc", "de"]
    with pytest.raises(Exception, match="overlap"):
        readers.manifest_slices(text, spark.createDataFrame([("c", 0, 3), ("c", 2, 7)], good.schema)).collect()


def test_small_run_helpers(spark):
    assert runs.parse_count("2.1b") == 2_100_000_000 and runs.parse_count("100m") == 10**8
    with pytest.raises(ValueError):
        runs.parse_count("0")
    assert runs.scaled_lr(1.0, 32) == 2
    row = spark.range(1).select(runs.peak_tflops(F.lit("NVIDIA H100 PCIe")).alias("a"), runs.peak_tflops(F.lit("cpu")).alias("b"), progress.tail(F.lit("abcdef"), 2).alias("t")).first()
    assert row.a == 756 and row.b is None and row.t == "ef"


def test_run_folders_and_sinks(spark, tmp_path):
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(json.dumps({"eval": {"pass_rate": 0.5}}, indent=1))
    assert sorted(r.run for r in readers.run_summaries(spark, str(tmp_path)).collect()) == ["r1", "r2"]
    rows = spark.createDataFrame([(2, "b"), (1, "a|x")], "n long, t string")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.table_fingerprint(rows) == sinks.table_fingerprint(rows.repartition(3)) != sinks.table_fingerprint(rows.limit(1))
    sinks.guard_manifest('{"a": 1}', {"a": 1})
    with pytest.raises(ValueError):
        sinks.guard_manifest('{"a": 1}', {"a": 2})
    assert "a\\|x" in sinks.markdown_table(rows)
    sinks.write_corpus_text(rows, str(tmp_path / "t"), "n", "t")
    assert [r.value for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()]


LOG = ["[1/6] Build corpus -> out", "step 50/200 | train 2.5000 | val 2.7500 | val_bpb -- | 1.2k tok/s | 3.1s", "sft step 1/3 | train 1.0 | val 1.5 | val_bpb 1.25 | 9.0s", "done: 7/9 passed (77.78%)", "other"]


def test_log_lines(spark):
    got = progress.events(spark.createDataFrame([("r", i, x) for i, x in enumerate(LOG)], "run string, n long, line string")).orderBy("n").collect()
    assert [(r.kind, r.stage, r.current, r.total) for r in got] == [("stage", "dataset", 1, 6), ("base", "base", 50, 200), ("sft", "sft", 1, 3), ("eval", "eval", 7, 9)]
    assert got[1].percent == 25 and got[1].tokens_per_sec == 1200 and got[1].val_bpb is None and got[2].tokens_per_sec is None and got[2].val_bpb == 1.25


def test_log_stream(spark, tmp_path):
    frame = spark.createDataFrame([("r", i, x) for i, x in enumerate(LOG + ["step 60/200 | train 2.4 | val 2.6 | val_bpb 1.5 | 3.2s"])], "run string, n long, line string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = progress.latest(progress.events(stream), "run", "n").writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.kind: r.current for r in spark.sql("select * from progress").collect()}
    assert got == {"stage": 1, "base": 60, "sft": 1, "eval": 7}


def test_job_states(spark):
    schema = "out_dir string, state string, updated long"
    got = progress.job_states(spark.createDataFrame([("a", "running", 1)], schema), spark.createDataFrame([("a", "failed", 9), ("b", "done", 2), ("b", "old", 1)], schema)).collect()
    assert {r.out_dir: r.state for r in got} == {"a": "running", "b": "done"}


def test_run_queries_read_every_event(spark):
    import os
    import tempfile

    from corpusloom.plans import analytics

    folder = tempfile.mkdtemp()
    rows = [(i, "a", 10.0 if i != 45 else 900.0) for i in range(1, 60)] + [(i, "b", 5.0) for i in range(1, 30)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(os.path.join(folder, "events.parquet"))
    assert {r.run: r.spikes for r in analytics.loss_spikes(spark, folder).collect()} == {"a": 1, "b": 0}
    assert analytics._log_lines(spark, folder).count() == len(rows)
