"""Packs, generators, tokenizer files, reports and run artifacts."""

import json
import random

import pytest
from corpusloom.operators import packs, reports, runs, splits, synthesis, tokenizers, tuning
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(i, f"Question {i}?", f"right{i}", [f"wrong{i}a", f"wrong{i}b", f"wrong{i}c"]) for i in range(12)]
    return spark.createDataFrame(rows, "number long, question string, correct string, wrong array<string>")


def norm(text):
    return " ".join(text.lower().split())


def test_offline_rows_have_the_schedule_and_new_prompts(spark, facts):
    rows = packs.offline_pack(spark, 200, "train", facts).collect()
    assert len(rows) == 200 and len({norm(r.user) for r in rows}) == 200
    again = packs.offline_pack(spark, 200, "train", facts).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kinds = {r.category.split("_")[1] if r.category.startswith("bench") else r.category for r in rows}
    assert kinds == {"choice", "math", "spelling", "identity", "refusal"}


def test_packs_of_both_sides_share_no_prompt(spark, facts):
    train, heldout = (packs.profile_pack(spark, "weak_skills", 160, side, facts) for side in ("train", "eval"))
    assert not {norm(r.user) for r in train.collect()} & {norm(r.user) for r in heldout.collect()}
    rules = packs.with_eval_rules(heldout).collect()
    assert {r.robustness_variant for r in rules} == set(packs.ROBUSTNESS)
    assert all(r.correct_choice in r.choice_labels for r in rules if r.level == "choice") and any(r.level == "choice" for r in rules)
    with pytest.raises(ValueError):
        packs.profile_pack(spark, "behavior", 10, "train", facts)
    for stage in packs.MATH_STAGES:
        sides = [{(r.x, r.y) for r in packs.stage_pairs(spark, stage, side).collect()} for side in ("train", "eval")]
        assert sides[0] and sides[1] and not sides[0] & sides[1]
    for r in packs.math_stage(spark, "math_l3_subtraction_borrow", 60, "train").collect():
        expression = next(x for x in (r.user.replace("What is", "").replace("Work out", "").replace("Give the number:", "").strip(" ?.="),))
        assert eval(expression) == int(r.assistant) >= 0


def test_mixes_with_outside_sources(spark, facts):
    chat = spark.createDataFrame([(f"Ask {i // 2}", f"say {i}", "smoltalk") for i in range(60)], "user string, assistant string, category string")
    rows, status = packs.outside_mix(spark, 120, packs.TUNING_MIX, {"smoltalk": chat}, "train", facts)
    found = rows.collect()
    assert status == "hf_mixed" and len(found) == 120 and len({norm(r.user) for r in found}) == 120
    assert sum(r.source == "smoltalk" for r in found) == splits.quota_floor(120, packs.TUNING_MIX)["smoltalk"]
    with pytest.raises(ValueError, match="outside"):
        packs.outside_mix(spark, 50, packs.TUNING_MIX, {"smoltalk": chat.limit(0)}, "train", facts)
    assert [packs.combined_status(*x) for x in (("hf", "hf"), ("hf", "offline"), ("offline_fallback", "hf"))] == ["hf", "mixed", "offline_fallback"]


def test_skills_corpora_are_true(spark):
    packs.disjoint_words()
    rows = packs.skills_corpus(spark, 40, 60, 40, 3, 50).collect()
    assert sorted(r.position for r in rows) == list(range(140)) and {r.shard for r in rows} == {0, 1, 2}
    for r in packs.skills_choice(spark, 120).collect():
        options = dict(zip("ABCD", [x.split(". ", 1)[1] for x in r.text.split("? ", 1)[1].split("; ")[:4]], strict=True))
        label, answer = r.text.rsplit("; answer ", 1)[1].rstrip(".").split(", ")
        assert options[label] == answer and len(set(options.values())) == 4
    with pytest.raises(ValueError, match="unknown"):
        packs.stage_packs(spark.createDataFrame([("a",)], "category string"), stages=["nope"])
    with pytest.raises(ValueError, match="no rows"):
        packs.stage_packs(spark.createDataFrame([("identity",)], "category string"))


def test_byte_pairs_in_tables_are_those_of_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenizers, "REPORTED", 40)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join("".join(rng.choice("aabbcd") for _ in range(rng.randint(1, 9))) for _ in range(30))) for i in range(20)], "doc_id long, text string")
    plain = tokenizers.learn_pairs(docs, 60)
    stored = tokenizers.learn_pairs(docs.repartition(3), 60, folder=str(tmp_path), max_symbols=10)
    assert plain.merges == stored.merges and plain.ids == stored.ids and len(plain.merges) > 20
    with pytest.raises(ValueError, match="folder"):
        tokenizers.learn_pairs(docs, 60, max_symbols=10)


def test_tokenizers_of_each_type_come_back(spark):
    docs = spark.createDataFrame([(1, "ab ba é"), (2, ""), (3, None)], "doc_id long, text string")
    for kind in ("byte", "char", "bpe"):
        text = tokenizers.train(kind, docs.where("text is not null"), 40)
        rows = {r.doc_id: r.ids for r in tokenizers.encoded_with(docs.where("text is not null"), text).collect()}
        assert rows[2] == [tokenizers.BOS, tokenizers.EOS] and rows[1][0] == tokenizers.BOS and len(rows[1]) > 3
        if kind == "bpe":
            assert tokenizers.loaded(text)["encoding"].decode(rows[1]) == "ab ba é"
    for bad in (lambda: tokenizers.train("x", docs), lambda: tokenizers.loaded('{"type": "x"}')):
        with pytest.raises(ValueError):
            bad()


def test_chat_rows_under_a_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a": 0, "b": 1, "c": 2, "u": 3}, unk_token="u"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    tokenizer.save(path)
    rows = spark.createDataFrame([(1, "a b", "a b c c"), (2, "a b", "a b"), (3, "a a a a", "a a a a c")], "conv_id long, prompt string, full string")
    got = {r.conv_id: (r.input_ids, r.labels) for r in tokenizers.chat_tokenised(rows, path, 3).collect()}
    assert got == {1: ([0, 1, 2], [-100, -100, 2])}


def test_completion_prompts(spark):
    schema = "m array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([([("system", "s"), ("user", "u")],), ([],), ([("assistant", "a")],)], schema)
    assert [r.p for r in rows.select(tuning.completion_prompt(F.col("m")).alias("p")).collect()] == ["System: s\nUser: u\nAssistant:", "Assistant:", "Assistant: a\nAssistant:"]
    with pytest.raises(Exception, match="role"):
        spark.createDataFrame([([("tool", "x")],)], schema).select(tuning.completion_prompt(F.col("m"))).collect()


def test_benchmark_formats(spark):
    assert synthesis.benchmark_format(["question", "A", "B", "C", "D"]) == "mmlu" and synthesis.benchmark_format(["choices"]) == "arc"
    with pytest.raises(ValueError):
        synthesis.benchmark_format(["question"])
    listed = spark.createDataFrame([(1, "q", [(None, "x "), ("Z", "y")], "Z")], "id long, question string, choices array<struct<label:string,text:string>>, answerKey string")
    row = synthesis.parsed_benchmark(listed).first()
    assert (row.labels, row.choices, row.answer) == (["A", "Z"], ["x", "y"], "Z")
    bad = spark.createDataFrame([(1, "q", [("A", "")], "A")], "id long, question string, choices array<struct<label:string,text:string>>, answerKey string")
    with pytest.raises(Exception, match="choices"):
        synthesis.parsed_benchmark(bad).collect()


def test_corpus_artifacts_and_honesty_report(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Line {i} of a text.\n" * 40 + f"own {i}") for i in range(6)] + [(7, "tiny"), (8, " "), (9, None)], "doc_id long, text string")
    report = reports.build_corpus(docs, str(tmp_path / "c"), 60)
    files = {r.doc_id: r.reason for r in spark.read.parquet(str(tmp_path / "c/files")).collect()}
    assert files[8] == files[9] == "empty_text" and report["stats"]["num_documents"] == sum(r == "included" for r in files.values())
    offsets = spark.read.parquet(str(tmp_path / "c/documents")).orderBy("char_start").collect()
    assert all(a.char_end + 2 == b.char_start for a, b in zip(offsets, offsets[1:], strict=False))
    assert json.loads((tmp_path / "c/report.json").read_text())["least_quality"] == 60 and "# Corpus" in (tmp_path / "c/report.md").read_text()
    from corpusloom.operators import contamination as con

    rec = lambda rows: con.records(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    found = reports.honesty_report(str(tmp_path / "h"), rec([(1, "what is the name of the river")]), rec([(5, "What is the name of the river?")]), rec([(9, "no such thing")]))
    assert found["status"] == "blocked" and found["counts"] == {"exact_sft_prompt_leak": 1} and "blocked" in (tmp_path / "h/honesty.md").read_text()


def test_commands_packs_and_bundles(tmp_path):
    assert reports.suggested_command("blocked", "c", "n", "a", "b") == "" and reports.suggested_command("tiny", "c", "n") == ""
    assert "--chat-input 'a b'" in reports.suggested_command("tiny", "c", "n", "a b", "e", quality=5)
    source = tmp_path / "src"
    source.mkdir()
    (source / "chat.jsonl").write_text("{}\n")
    (source / "eval.jsonl").write_text("{}\n")
    (source / "pack.json").write_text(json.dumps({"name": "p", "chat": "chat.jsonl", "eval_input": "eval.jsonl", "corpus": {"input": "corpus"}}))
    new = json.loads(open(reports.clone_pack(str(source / "pack.json"), str(tmp_path / "copy"))).read())
    assert new["corpus"]["input"] == str((source / "corpus").resolve()) and (tmp_path / "copy/chat.jsonl").exists()
    (source / "corpus.txt").write_text("large")
    manifest = reports.run_bundle(str(source), str(tmp_path / "b.tgz"), ["chat.jsonl"])
    assert manifest["left_out"] == ["corpus.txt"] and "corpus.txt" not in manifest["files"]
    with pytest.raises(FileNotFoundError):
        reports.run_bundle(str(source), str(tmp_path / "b.tgz"), ["checkpoint"])
    assert runs.external_specs(["a=x", "b = y"]) == [("a", "x"), ("b", "y")] and runs.seeds_of(3, 2) == [3, 4]
    for bad in (["a"], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            runs.external_specs(bad)
