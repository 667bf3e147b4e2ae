"""Queries over packs, shards and bundles, run gates and reports' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import bundles, corpus, imports, packing, packs, runs, splits, synthesis, tokenizers, tuning
from corpusloom.plans.analytics import _FACTS, _SUMS, _facts, _log_lines, _permuted, _summaries
from corpusloom.plans.corpus import QUALITY_SQL, _stats_sql
from corpusloom.sources.tables import PAIRS_SQL, chat_pairs, scratch, table
from corpusloom.streaming import progress

SIDES = ("train", "eval")


def _both(make) -> DataFrame:
    parts = [make(side).withColumn("side", F.lit(side)) for side in SIDES]
    return parts[0].unionByName(parts[1])


def math_stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that carry, and removals, on both sides."""
    stages = ["math_l3_addition_carry", "math_l3_removal_story"]
    return _both(lambda side: packs.math_stage(spark, stages[0], 200, side).unionByName(packs.math_stage(spark, stages[1], 100, side)))


def spelling_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda side: packs.spelling_pack(spark, 300, side).select("user", "assistant", "category", "place"))


def identity_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda side: packs.identity_pack(spark, 40, side, release=True).select("user", "assistant", "stage", "place"))


def refusal_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda side: packs.refusal_pack(spark, 40, side).select("user", "answerable", "place"))


def choice_pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda side: packs.choice_pack(spark, 150, side, _facts(spark, sf_dir)).select("user", "assistant", "place"))


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each skill in the profiles' mixes."""
    facts, out = _facts(spark, sf_dir), None
    for name, weights in packs.PROFILES.items():
        rows = packs.behavior_mix(spark, splits.quota_floor(117, weights), "train", facts, 1, name in ("weak_skills", "release_skills"), name.startswith("release"))
        part = rows.groupBy(tuning.behavior_bucket(F.col("category")).alias("skill")).agg(F.count(F.lit(1)).alias("n")).withColumn("profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.stage_counts(packs.staged_math(spark, 201, "train").unionByName(packs.staged_spelling(spark, 119, "train")))


def profile_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation pack of the weak skills with its rules."""
    return packs.with_eval_rules(packs.profile_pack(spark, "weak_skills", 120, "eval", _facts(spark, sf_dir))).drop("rank", "choice_labels", "must_include")


def offline_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.offline_pack(spark, 300, "train", _facts(spark, sf_dir)).drop("rank")


def outside_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning rows of conversations, parts as choices and orders as sums, with own skills."""
    chat = chat_pairs(spark, sf_dir).where(tuning.within_budget(F.col("user"), F.col("assistant"))).withColumn("category", F.lit("smoltalk"))
    mixed, status = packs.outside_mix(spark, 200, packs.TUNING_MIX, {"smoltalk": chat, "mmlu": packs.mmlu_rows(_parts(spark, sf_dir), False, 11, 500), "gsm8k": packs.gsm_rows(_sums(spark, sf_dir), False, 23, 500)}, "train", _facts(spark, sf_dir))
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit(status))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-choice questions about parts; some answers are out of range."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Which is the brand of "), F.col("p_name"), F.lit("?")).alias("question"), F.array("p_brand", F.lit("none"), F.col("p_type"), F.lit("all")).alias("choices"), (F.col("p_partkey") % 5).alias("answer"), F.lower("p_brand").alias("subject"))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked answers with a mark; some have none."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("How much is order "), k.cast("string"), F.lit("? ")).alias("question"), F.when(k % 3 == 0, F.lit("no mark")).otherwise(F.concat(F.lit("we add\n#### "), k.cast("string"), F.lit(" \nend"))).alias("answer"))


def mmlu_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.mmlu_rows(_parts(spark, sf_dir), True, 17, 100).select("id", "user", "correct_choice", "category", "max_words")


def arc_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("labels", F.array(*[F.lit(x) for x in "WXYZ"])).withColumn("answer", F.element_at(F.array(*[F.lit(x) for x in "WXYZQ"]), (F.col("answer") + 1).cast("int")))
    return packs.arc_rows(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 5, 61).select("id", "correct_choice", "category")


def gsm_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.gsm_rows(_sums(spark, sf_dir), True, 31, 80).select("id", "user", "assistant", "max_words")


def stage_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.stage_packs(chat_pairs(spark, sf_dir)).groupBy("tuning_stage").agg(F.count(F.lit(1)).alias("n"))


def skills_math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.skills_math(spark, 2_000).select("i", "text")


def skills_spelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.skills_spelling(spark, 1_000).select("i", "text")


def skills_choice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.skills_choice(spark, 1_000).select("i", "text")


def skills_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the drills in each shard."""
    return packs.skills_corpus(spark, 500, 400, 300, 7, 250).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


def parsed_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of both formats as evaluation rows."""
    parts = _parts(spark, sf_dir).where("answer < 4")
    wide = parts.select("id", "question", *(F.col("choices")[i].alias(c) for i, c in enumerate("ABCD")), (F.col("answer") + 1).cast("string").alias("answer"))
    listed = parts.select("id", "question", F.struct(F.array(*[F.lit(x) for x in "ABCD"]).alias("label"), F.col("choices").alias("text")).alias("choices"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("answer") + 1).cast("int")).alias("answerKey"))
    found = [synthesis.external_choices(synthesis.parsed_benchmark(t).withColumn("category", F.lit(None).cast("string")), name, "test").select("id", "correct_choice", "category", "reference") for name, t in (("wide", wide), ("listed", listed))]
    return found[0].unionByName(found[1])


def completion_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = tuning.conversations(table(spark, sf_dir, "conversations"))
    messages = F.when(F.col("conv_id") % 2 == 0, F.col("messages")).otherwise(F.slice("messages", F.lit(1), F.size("messages") - 1))
    return folded.select("conv_id", F.md5(tuning.completion_prompt(messages).cast("binary")).alias("prompt_md5"))


# shards and sides


def _byte_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(F.lit(tokenizers.BOS)), tokenizers.byte_ids("text"), F.array(F.lit(tokenizers.EOS))).alias("ids"))


def token_shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written with their manifest, read back and checked; two folds of the order, so one shard more may be short."""
    path = scratch(spark, "shards")
    bundles.write_token_shards(_byte_docs(spark, sf_dir), "doc_id", path, 50_000, {"tokenizer": "byte"})
    shards, manifest = bundles.read_shards(spark, path, {"tokenizer": "byte", "per_shard": 50_000})
    row = shards.agg(F.sum("num_tokens").alias("num_tokens"), (F.max("num_tokens") <= 50_000).alias("within"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("token_sum"))
    return row.withColumn("boundaries", F.lit(manifest["document_boundary_tokens"]))


def packed_shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of both sides, written and read back: no token is made or lost but those that the manifest counts."""
    path = scratch(spark, "packed")
    manifest = bundles.write_packed_shards(_byte_docs(spark, sf_dir), "doc_id", path, 128, 20_000)
    shards, _ = bundles.read_shards_rows(spark, path)
    rows = shards.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("ids")).alias("narrowest"), F.max(F.size("ids")).alias("widest"))
    told = spark.createDataFrame([(s, manifest[s]["source_tokens"], manifest[s]["dropped_tokens"], manifest[s]["num_rows"]) for s in ("train", "val")], "split string, source long, dropped long, told long")
    return rows.join(told, "split").select("split", "source", (F.col("rows") * 129 + F.col("dropped")).alias("accounted"), "narrowest", "widest", (F.col("rows") == F.col("told")).alias("as_told"))


def document_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents on both sides, canaries on one."""
    ids = F.concat(F.array(F.lit(tokenizers.BOS)), tokenizers.byte_ids("text"), F.array(F.lit(tokenizers.EOS)))
    sides = bundles.document_token_split(table(spark, sf_dir, "documents"), ids, 64, 0.1, 42, ["a-1", "b-2"])
    return sides.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"))


def window_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.window_split(2_500, spark, 0.07, 9)


def shard_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and windows of shards on both sides."""
    shards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("shard"), (F.col("n_nationkey") * 37 + 40).cast("long").alias("num_tokens"))
    return bundles.split_stats(bundles.shard_split(shards, 0.2, 4), 64)


def random_window_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("shard"), (F.col("n_nationkey") * 37 + 40).cast("long").alias("num_tokens"))
    return packing.random_windows(shards, 64, 1_000, 12)


def token_stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.token_stream(_byte_docs(spark, sf_dir), "doc_id").select("doc_id", "start")


def sft_packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.plans.tokens import _pair_lengths

    lengths = _pair_lengths(spark, sf_dir).where("tokens <= 4096")
    bins = packing.best_fit_decreasing(lengths, "conv_id", "tokens", 4096, "category")
    stats = packing.packing_stats(bins, lengths, "conv_id", "tokens", 4096, "category")
    return stats.select("category", "examples", "tokens", ((F.col("padded") + F.col("tokens")) == F.col("sequences") * 4096).alias("whole"))


def packing_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    rows = _summaries(spark, sf_dir).select("run", F.when(key % 2 == 0, "bos_bestfit").otherwise("separate").alias("packing"), F.when(key % 3 == 0, "uniform").otherwise("balanced").alias("sampling"), (key * 4).alias("packed_sequences"), (key * (key % 4)).alias("mixed_sequences"), (key / 8.0).alias("examples_per_sequence"))
    return packing.packing_warnings(rows)


# runs and imports


def external_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    reports = _summaries(spark, sf_dir).select("run", F.lit("geo").alias("name"), F.when(key % 3 == 0, F.round(F.col("pass_rate") / 2, 4)).alias("choice_accuracy"), F.when(key % 5 != 0, F.round(F.col("pass_rate") / 3, 4)).alias("pass_rate"), (key * 9).alias("num_examples"))
    results = runs.external_gate_results(reports)
    return runs.external_issues(results, _summaries(spark, sf_dir).select("run", (key % 2 == 0).alias("long_run")))


def release_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of release runs: leaks, refusals of benign questions, choices near chance."""
    key = F.col("key")
    rows = _summaries(spark, sf_dir).select("run", (key % 2 == 0).alias("long_run"), F.when(key % 3 == 0, "research").otherwise("skill_release").alias("profile"), (key % 4).alias("prompt_hits"), F.when(key % 5 != 0, key % 2).alias("support_hits"), F.when(key % 7 != 0, F.col("pass_rate") - 0.1).alias("benign_non_refusal_rate"), (key * 3).alias("choice_examples"), ((key % 10) / 30.0).alias("choice_adjusted"))
    leaks = rows.select("run", runs.release_honesty_issue(F.col("long_run"), F.col("profile"), F.col("prompt_hits"), F.col("support_hits")).alias("issue")).where("issue is not null")
    return leaks.unionByName(runs.behavior_issues(rows))


def release_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of orders' categories by priority that pass too few, and stages of them."""
    names = F.array(*[F.lit(c) for c in ("bench_math_add", "identity", "domain_recall", "refusal_boundary", "bench_choice_facts", "bench_spelling_letters", "chat")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("category"), (F.col("o_orderstatus") == "F").cast("long").alias("p"), (F.col("o_orderkey") % 4).alias("level"))
    counted = lambda *keys: rows.groupBy(*keys).agg(F.sum("p").alias("num_passed"), F.count(F.lit(1)).alias("num_examples"))
    groups = runs.release_group_issues(counted("run", "category"), counted("run", "category").where("category <> 'identity'"))
    stages = counted("run", "category", "level").select("run", F.when(F.col("category").startswith("bench_math"), "math").when(F.col("category").startswith("bench_spelling"), "spelling").otherwise("other").alias("group"), F.concat(F.lit("l"), F.col("level").cast("string")).alias("stage"), (F.col("num_passed") - F.col("num_examples") * 0.3).alias("num_passed"), "num_examples")
    return groups.unionByName(runs.release_stage_issues(stages))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries as reports have them, nested, with parts missing here and there."""
    key = F.col("key")
    stage = lambda s, shift: F.struct(F.when(key % 2 == shift, F.col("val_loss")).alias("best_val_loss"), (F.col("val_loss") + 0.1).alias("val_loss"), (F.col("val_loss") + 0.2).alias("final_val_loss"), F.lit(None).cast("double").alias("best_val_bpb"), F.when(key % 3 == shift, F.col("bpb")).alias("val_bpb"), (F.col("val_loss") / 2).alias("final_val_bpb"), F.when(key % 4 == shift, key * 10).alias("best_checkpoint_step"), (key * 11).alias("best_step"), F.when(key % 5 != shift, "early").alias("stop_reason"), F.when(key % 6 != shift, "stable").alias("loss_status"), (key * 4).alias("effective_batch_size"), F.lit(None).cast("string").alias("memorization_status"), (key * 1000).alias("num_parameters"), F.when(key % 2 == 0, key).alias("truncated_examples"), F.lit(None).cast("long").alias("skipped_long_examples")).alias(s)
    return _summaries(spark, sf_dir).select("run", key.alias("seed"), F.struct(key.alias("num_passed"), (key + 9).alias("num_examples"), "pass_rate", (F.col("pass_rate") / 2).alias("non_choice_pass_rate"), F.lit(None).cast("double").alias("domain_pass_rate"), F.col("fit_rate").alias("refusal_pass_rate"), "support_rate", "echo_rate").alias("eval"), F.when(key % 3 != 1, F.struct(F.col("fit_rate").alias("pass_rate"))).alias("sft_fit"), F.struct(F.when(key % 2 == 0, "bpe").alias("tokenizer_type"), F.lit(128).alias("context_size"), F.lit(None).cast("string").alias("device")).alias("config"), F.struct(F.when(key % 3 == 0, "char").alias("tokenizer_type")).alias("tokenizer"), stage("base", 0), stage("sft", 1), F.struct(F.col("status")).alias("long_run_gate"))


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.multi_seed_rows(_nested(spark, sf_dir))


def seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.multi_seed_run(_nested(spark, sf_dir))


def compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compare_rows(_nested(spark, sf_dir)).select("run", "tokenizer_type", "eval_score", "fit_rate", "base_val_loss", "sft_val_bpb", "base_best_step", "sft_stop_reason", "sft_loss_status", "memorization_status", "context_size", "truncated_examples", "skipped_long_examples")


def best_sweep_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summaries(spark, sf_dir).select(F.col("run").alias("name"), F.when(F.col("key") % 4 != 0, F.col("fit_rate")).alias("fit"), F.when(F.col("key") % 5 != 0, F.col("val_loss")).alias("sft_final_val_loss"))
    return runs.best_sweep_row(rows, "fit")


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_report(imports.import_rows(table(spark, sf_dir, "documents"), "doc_id", min_chars=200), "doc_id", 400)


def imported_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.imported_stats(table(spark, sf_dir, "documents"))


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents stay or go, and how many have each flag."""
    judged = corpus.quality_filtered(table(spark, sf_dir, "documents"), 60)
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def log_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows of each event type's log."""
    lines = _log_lines(spark, sf_dir)
    jobs = lines.select("run").distinct().select(F.col("run").alias("out_dir"), F.when(F.length("run") % 2 == 0, "running").otherwise("done").alias("state"))
    logs = lines.groupBy("run").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), -40, 40), "\n").alias("log"))
    return progress.log_plan(jobs, logs, progress.latest(progress.events(lines), "run", "n"), 1_000)


def reply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as server-sent events."""
    return progress.server_events(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "number", F.md5(F.col("line").cast("binary")).alias("line_md5"))


QUERIES = {f.__name__: f for f in (math_stage_rows, spelling_pack_rows, identity_pack_rows, refusal_pack_rows, choice_pack_rows, profile_counts, stage_counts, profile_pack, offline_pack, outside_mix, mmlu_eval_rows, arc_eval_rows, gsm_eval_rows, stage_slices, skills_math_rows, skills_spelling_rows, skills_choice_rows, skills_corpus, parsed_benchmarks, completion_prompts, token_shard_files, packed_shard_files, document_sides, window_sides, shard_sides, random_window_draws, token_stream_offsets, sft_packing_stats, packing_warnings, external_gate, release_issues, release_groups, seed_rows, seed_stats, compare_rows, best_sweep_row, import_report, imported_stats, quality_reasons, log_plan, reply_events)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _sides(sql: str) -> str:
    """A statement for each side, with its words put in."""
    return " UNION ALL ".join(sql(side) for side in SIDES)


def _math_sql(side: str) -> str:
    asked = _list(packs.MATH_ASKED[side])
    keep = "p < cut" if side == "train" else "p >= cut"
    shift = "0" if side == "train" else "cut"
    pool = "SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS p, CAST(floor(count(*) OVER () * 0.8::DOUBLE) AS BIGINT) AS cut FROM {0} WHERE {1}"
    carry = pool.format("range(10, 100) a(x), range(10, 100) b(y)", "x % 10 + y % 10 >= 10")
    removal = pool.format("range(2, 13) a(x), range(2, 13) b(y)", "true")

    def rows(name: str, src: str, n: int, left: str, sign: str, right: str, answer: str, kind: str) -> str:
        return f"SELECT replace({asked}[i % 4 + 1], '{{}}', {left} || ' {sign} ' || {right}) AS user, CAST({answer} AS VARCHAR) AS assistant, 'bench_math_{kind}' AS category, '{name}' AS stage, true AS answerable, i AS place, '{side}' AS side FROM range({n}) t(i) JOIN (SELECT x, y, p - {shift} AS p, count(*) OVER () AS size FROM ({src}) WHERE {keep}) q ON i // 4 % size = p"

    removed = f"(1 + (i * 7 + {2 if side == 'train' else 5}) % 17)"
    return rows("math_l3_addition_carry", carry, 200, "x", "+", "y", "x + y", "addition") + " UNION ALL " + rows("math_l3_removal_story", removal, 100, f"(x * y + {removed})", "-", removed, "x * y", "removal")


def _spelling_sql(side: str) -> str:
    words, seed = (packs.TRAIN_WORDS, 3137) if side == "train" else (packs.HELDOUT_WORDS, 9029)
    n = len(words)
    return f"""SELECT replace(replace({_list(packs.SPELLING_ASKED[side])}[(k // {n}) % 2 + 1], '{{w}}', w), '{{t}}', {_list([packs.SPELLING_TASKS[m] for m in packs.SPELLING_MODES])}[i % 5 + 1]) AS user, CASE i % 5 WHEN 0 THEN array_to_string(string_split(w, ''), ' ') WHEN 1 THEN CAST(length(w) AS VARCHAR) WHEN 2 THEN reverse(w) WHEN 3 THEN w[1] ELSE w[-1] END AS assistant, 'bench_spelling_' || {_list(packs.SPELLING_MODES)}[i % 5 + 1] AS category, i AS place, '{side}' AS side FROM (SELECT i, i // 5 AS k, CASE WHEN i // 5 < {n} THEN {_list(words)}[i // 5 + 1] ELSE translate(substring(md5('{seed}:' || (i // 5 - {n})), 1, 5 + (i // 5 - {n}) % 4), '0123456789', 'ghijklmnop') END AS w FROM range(300) t(i))"""


def _identity_sql(side: str) -> str:
    words = ["{}", "Please say: {}", "A question: {}"] if side == "train" else ["Tell me, {}", "I ask you: {}"]
    k, m = len(packs.IDENTITY), len(words)
    return f"SELECT replace({_list(words)}[(i // {k}) % {m} + 1], '{{}}', {_list([q for q, _ in packs.IDENTITY])}[i % {k} + 1]) || CASE WHEN i // {k * m} > 0 THEN ' (' || (i // {k * m}) || ')' ELSE '' END AS user, {_list([a for _, a in packs.IDENTITY])}[i % {k} + 1] AS assistant, 'release_identity_' || (i % {k}) AS stage, i AS place, '{side}' AS side FROM range(40) t(i)"


def _refusal_sql(side: str) -> str:
    pool = packs.REFUSALS if side == "train" else [f"Can you tell: {q}" for q in packs.REFUSALS[:10]]
    return f"SELECT {_list(pool)}[i % {len(pool)} + 1] || CASE WHEN i // {len(pool)} > 0 THEN ' (' || (i // {len(pool)}) || ')' ELSE '' END AS user, false AS answerable, i AS place, '{side}' AS side FROM range(40) t(i)"


def _choice_sql(side: str) -> str:
    a, b = (0, 0) if side == "train" else (3, 11)
    filled = f"{_list(packs.CHOICE_ASKED)}[(i // n + {0 if side == 'train' else 1}) % 3 + 1]"
    for name, value in (("q", "question"), ("a", "o[1]"), ("b", "o[2]"), ("c", "o[3]"), ("d", "o[4]")):
        filled = f"replace({filled}, '{{{name}}}', {value})"
    return f"SELECT {filled} AS user, ['A', 'B', 'C', 'D'][list_position(o, correct)] AS assistant, i AS place, '{side}' AS side FROM (SELECT i, n, question, correct, {_permuted('list_prepend(correct, wrong)', 'k')} AS o FROM (SELECT i, (i * 7 + {a}) % n AS number, (i * 7 + {b}) % 24 AS k, n FROM range(150) t(i), (SELECT count(*) AS n FROM f)) JOIN f USING (number))"


def _quota_sql(weights: dict[str, float], total: int, names: str) -> str:
    rows = ", ".join(f"({i}, '{k}', {w}::DOUBLE)" for i, (k, w) in enumerate(weights.items()))
    return f"SELECT {names}, CAST(f + CASE WHEN i < {total} - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT i, k, floor({total} * w) AS f FROM (VALUES {rows}) v(i, k, w))"


def _drawn(what: str, low: int, high: int, i: str = "i") -> str:
    return f"(CAST('0x' || substring(md5('42:{what}:' || {i}), 1, 8) AS BIGINT) % {high - low + 1} + {low})"


def _skill_word(i: str) -> str:
    return f"CASE WHEN {i} % 10 = 0 THEN {_list(packs.TRAIN_WORDS)}[({i} // 10) % {len(packs.TRAIN_WORDS)} + 1] ELSE translate(substring(md5('42:' || ({i})), 1, CAST(4 + {i} % 5 AS INTEGER)), '0123456789', 'ghijklmnop') END"


_PARTS = "q AS (SELECT p_partkey AS id, 'Which is the brand of ' || p_name || '?' AS question, [p_brand, 'none', p_type, 'all'] AS c, p_partkey % 5 AS a, lower(p_brand) AS subject FROM part)"
_MD5_ORDER = "ORDER BY md5('{0}:' || id), id LIMIT {1}"
_DOCSIZE = "octet_length(encode(text)) + 2"
_SHARDS = "s AS (SELECT CAST(n_nationkey AS BIGINT) AS shard, CAST(n_nationkey * 37 + 40 AS BIGINT) AS n FROM nation)"
_IMPORTED = "SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\x1c-\\x1f]+', ''), '[\\s\\x1c-\\x1f]+$', '') AS s FROM documents"
ORACLES = {
    "math_stage_rows": _sides(_math_sql),
    "spelling_pack_rows": _sides(_spelling_sql),
    "identity_pack_rows": _sides(_identity_sql),
    "refusal_pack_rows": _sides(_refusal_sql),
    "choice_pack_rows": f"WITH {_FACTS} " + _sides(_choice_sql),
    "profile_counts": " UNION ALL ".join(f"SELECT * FROM ({_quota_sql(w, 117, f'{chr(39)}{p}{chr(39)} AS profile, k AS skill')})" for p, w in packs.PROFILES.items()),
    "stage_counts": f"{_quota_sql(packs.MATH_STAGES, 201, 'k AS stage')} UNION ALL {_quota_sql(packs.SPELLING_STAGES, 119, 'k AS stage')}",
    "mmlu_eval_rows": f"WITH {_PARTS} SELECT id, question || chr(10) || chr(10) || 'A. ' || c[1] || chr(10) || 'B. ' || c[2] || chr(10) || 'C. ' || c[3] || chr(10) || 'D. ' || c[4] || chr(10) || chr(10) || 'Answer with the single best option letter.' AS user, ['A', 'B', 'C', 'D'][a + 1] AS correct_choice, 'mmlu_' || subject AS category, 3 AS max_words FROM q WHERE a < 4 {_MD5_ORDER.format(17, 100)}",
    "arc_eval_rows": f"WITH {_PARTS}, g AS (SELECT id, ['W', 'X', 'Y', 'Z'][a + 1] AS correct_choice FROM q WHERE a < 4) SELECT * FROM (SELECT id, correct_choice, 'arc_easy' AS category FROM g WHERE id % 2 = 0 {_MD5_ORDER.format(5, 30)}) UNION ALL SELECT * FROM (SELECT id, correct_choice, 'arc_challenge' FROM g WHERE id % 2 = 1 {_MD5_ORDER.format(5, 31)})",
    "gsm_eval_rows": f"SELECT o_orderkey AS id, 'How much is order ' || o_orderkey || '?' AS user, CAST(o_orderkey AS VARCHAR) AS assistant, 24 AS max_words FROM (SELECT *, o_orderkey AS id FROM orders) WHERE o_orderkey % 3 <> 0 {_MD5_ORDER.format(31, 80)}",
    "stage_slices": f"WITH {PAIRS_SQL}, c AS (SELECT category FROM pairs) SELECT 'behavior' AS tuning_stage, count(*) AS n FROM c WHERE category = 'identity' OR contains(category, 'refusal') UNION ALL SELECT 'choice', count(*) FROM c WHERE starts_with(category, 'bench_choice') UNION ALL SELECT 'math', count(*) FROM c WHERE starts_with(category, 'bench_math') UNION ALL SELECT 'spelling', count(*) FROM c WHERE starts_with(category, 'bench_spelling') UNION ALL SELECT 'skills', count(*) FROM c WHERE starts_with(category, 'bench_')",
    "skills_math_rows": f"WITH v AS (SELECT i, {_drawn('a', 0, 999)} AS a, {_drawn('b', 0, 999)} AS b, {_drawn('c', 1, 12)} AS c, {_drawn('x', 2, 25)} AS x, {_drawn('y', 2, 12)} AS y FROM range(2000) t(i)), k AS (SELECT i, CASE i % 5 WHEN 0 THEN a || ' + ' || b WHEN 1 THEN greatest(a, b) || ' - ' || least(a, b) WHEN 2 THEN x || ' * ' || y WHEN 3 THEN (a + c) || ' less ' || c ELSE 'the sum of ' || a || ' and ' || b END AS q, CAST(CASE i % 5 WHEN 0 THEN a + b WHEN 1 THEN abs(a - b) WHEN 2 THEN x * y WHEN 3 THEN a ELSE a + b END AS VARCHAR) AS r FROM v) SELECT i, replace(replace(['Sum: {{q}}; answer {{r}}.', 'Exactly: {{q}} = {{r}}.', 'Known: {{q}} is {{r}}.', 'Number for {{q}}: {{r}}.'][i % 4 + 1], '{{q}}', q), '{{r}}', r) AS text FROM k",
    "skills_spelling_rows": f"WITH v AS (SELECT i, ['spaced', 'reverse', 'count', 'first', 'last', 'barred'][i % 6 + 1] AS m, {_skill_word('i')} AS w FROM range(1000) t(i)), k AS (SELECT i, m, w, CASE m WHEN 'spaced' THEN array_to_string(string_split(w, ''), ' ') WHEN 'barred' THEN array_to_string(string_split(w, ''), ' | ') WHEN 'count' THEN CAST(length(w) AS VARCHAR) WHEN 'reverse' THEN reverse(w) WHEN 'first' THEN w[1] ELSE w[-1] END AS r FROM v) SELECT i, replace(replace(replace(['Letters: {{m}} of {{w}}; answer {{r}}.', '{{w}}, {{m}}: {{r}}.', 'Spelling, {{m}} of {{w}}: {{r}}.'][(i // 6) % 3 + 1], '{{m}}', m), '{{w}}', w), '{{r}}', r) AS text FROM k",
    "skills_choice_rows": f"WITH v AS (SELECT i, i % 4 AS k, {_drawn('ca', 0, 999)} AS a, {_drawn('cb', 0, 999)} AS b, {_drawn('step', 1, 3)} AS s, {_drawn('order', 0, 23)} AS o, {_skill_word('(i + i % 4 * 100000)')} AS w FROM range(1000) t(i)), z AS (SELECT *, CASE k WHEN 0 THEN CAST(a + b AS VARCHAR) WHEN 1 THEN w[1] WHEN 2 THEN CAST(length(w) AS VARCHAR) ELSE reverse(w) END AS correct, CASE WHEN k = 0 THEN a + b ELSE length(w) END AS m, ascii(w) - 97 AS f FROM v), y AS (SELECT *, CASE k WHEN 1 THEN [chr(CAST((f + 5) % 26 + 97 AS INTEGER)), chr(CAST((f + 11) % 26 + 97 AS INTEGER)), chr(CAST((f + 17) % 26 + 97 AS INTEGER))] WHEN 3 THEN [w || w[1], reverse(w) || 'x', 'y' || reverse(w)] ELSE [CAST(m + s AS VARCHAR), CAST(m + s + 2 AS VARCHAR), CAST(m + s + 5 AS VARCHAR)] END AS wrong FROM z), x AS (SELECT *, {_permuted('list_prepend(correct, wrong)', 'o')} AS p FROM y) SELECT i, CASE k WHEN 0 THEN 'Which equals ' || a || ' + ' || b WHEN 1 THEN 'Which letter begins ' || w WHEN 2 THEN 'How many letters has ' || w ELSE 'Which is the reverse of ' || w END || '? A. ' || p[1] || '; B. ' || p[2] || '; C. ' || p[3] || '; D. ' || p[4] || '; answer ' || ['A', 'B', 'C', 'D'][list_position(p, correct)] || ', ' || correct || '.' AS text FROM x",
    "skills_corpus": "SELECT i // 250 AS shard, count(*) AS n, min(i) AS first, max(i) AS last FROM range(1200) t(i) GROUP BY 1",
    "parsed_benchmarks": f"WITH {_PARTS}, f AS (VALUES ('wide'), ('listed')) SELECT id, ['A', 'B', 'C', 'D'][a + 1] AS correct_choice, 'external_' || f.col0 AS category, ['A', 'B', 'C', 'D'][a + 1] || '. ' || trim(c[a + 1]) AS reference FROM q, f WHERE a < 4",
    "completion_prompts": "WITH k AS (SELECT conv_id, turn, lower(role) AS role, text FROM conversations WHERE lower(role) IN ('system', 'user', 'assistant', 'tool')), l AS (SELECT conv_id FROM k GROUP BY conv_id HAVING max_by(role, turn) = 'assistant'), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS c FROM k JOIN l USING (conv_id)), j AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) FILTER (conv_id % 2 = 0 OR rn < c) AS t FROM n GROUP BY conv_id) SELECT conv_id, md5(CASE WHEN t IS NULL THEN 'Assistant:' ELSE t || chr(10) || 'Assistant:' END) AS prompt_md5 FROM j",
    "token_shard_files": f"SELECT CAST(sum({_DOCSIZE}) AS BIGINT) AS num_tokens, true AS within, CAST(sum(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '[0-9A-F]{{2}}'), lambda b: CAST('0x' || b AS INTEGER) + 4))) + 3 * count(*) AS BIGINT) AS token_sum, true AS boundaries FROM documents",
    "packed_shard_files": f"WITH r AS (SELECT {_DOCSIZE} AS s, row_number() OVER (ORDER BY md5('42:' || doc_id)) <= greatest(1, CAST(floor(count(*) OVER () * 0.1::DOUBLE) AS BIGINT)) AS v FROM documents) SELECT CASE WHEN v THEN 'val' ELSE 'train' END AS split, CAST(sum(s) AS BIGINT) AS source, CAST(sum(s) AS BIGINT) AS accounted, 129 AS narrowest, 129 AS widest, true AS as_told FROM r GROUP BY v",
    "document_sides": f"WITH d AS (SELECT * FROM documents WHERE trim(text, ' ') <> ''), r AS (SELECT {_DOCSIZE} AS s, row_number() OVER (ORDER BY md5('42:' || doc_id)) <= greatest(1, CAST(floor(count(*) OVER () * 0.1::DOUBLE) AS BIGINT)) AS v FROM d), c AS (SELECT s, v FROM r UNION ALL SELECT octet_length(encode('Memorization canary phrase: a-1.' || chr(10) || 'Memorization canary phrase: b-2.')) + 2, false) SELECT CASE WHEN v THEN 'val' ELSE 'train' END AS split, count(*) AS documents, CAST(sum(s) AS BIGINT) AS tokens FROM c GROUP BY v",
    "window_sides": "SELECT i AS window, CASE WHEN row_number() OVER (ORDER BY md5('9:' || i)) <= 175 THEN 'val' ELSE 'train' END AS split FROM range(2500) t(i)",
    "shard_sides": f"WITH {_SHARDS}, r AS (SELECT n, greatest(0, n - 64) AS w, row_number() OVER (ORDER BY md5('4:' || shard)) <= 5 AS v FROM s) SELECT CAST(sum(n) AS BIGINT) AS num_tokens, CAST(sum(n) FILTER (NOT v) AS BIGINT) AS train_tokens, CAST(sum(n) FILTER (v) AS BIGINT) AS val_tokens, CAST(sum(w) FILTER (NOT v) AS BIGINT) AS train_sequences, CAST(sum(w) FILTER (v) AS BIGINT) AS val_sequences, count(*) FILTER (NOT v) AS train_parts, count(*) FILTER (v) AS val_parts, 64 AS context_size FROM r",
    "random_window_draws": f"WITH {_SHARDS}, c AS (SELECT shard, n - 64 AS w, sum(n - 64) OVER (ORDER BY shard) AS t FROM s WHERE n > 64), u AS (SELECT i AS draw, CAST(floor(CAST('0x' || substring(md5('12:' || i), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * (SELECT max(t) FROM c)) AS BIGINT) AS p FROM range(1000) x(i)) SELECT draw, shard, CAST(p - (t - w) AS BIGINT) AS start FROM u JOIN c ON p >= t - w AND p < t",
    "token_stream_offsets": f"SELECT doc_id, CAST(coalesce(sum({_DOCSIZE}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents",
    "sft_packing_stats": f"""WITH {PAIRS_SQL}, l AS (SELECT category, length("user") + length(assistant) + 2 AS t FROM pairs) SELECT category, count(*) AS examples, CAST(sum(t) AS BIGINT) AS tokens, true AS whole FROM l WHERE t <= 4096 GROUP BY category""",
    "packing_warnings": f"WITH {_SUMS} SELECT run, 'several_examples_in_a_context' AS warning FROM s WHERE k % 2 = 0 AND k / 8.0::DOUBLE > 1.1 UNION ALL SELECT run, 'sequences_mix_categories' FROM s WHERE k % 2 = 0 AND k % 3 <> 0 AND k * (k % 4) > 0 AND k * (k % 4) / greatest(1, k * 4) >= 0.5",
    "external_gate": f"WITH {_SUMS}, e AS (SELECT run, k, k * 9 AS n, k % 2 = 0 AS long, coalesce(CASE WHEN k % 3 = 0 THEN round(pass_rate / 2, 4) END, CASE WHEN k % 5 <> 0 THEN round(pass_rate / 3, 4) END) AS score FROM s) SELECT run, 'external:geo:' || CASE WHEN n <= 0 OR score IS NULL THEN 'empty' WHEN score < 0.30 THEN 'below' ELSE 'small' END AS issue, CASE WHEN long AND (n <= 0 OR score IS NULL OR score < 0.30) THEN 'block' ELSE 'warn' END AS severity FROM e WHERE n <= 0 OR score IS NULL OR score < 0.30 OR (long AND n < 50)",
    "release_issues": f"WITH {_SUMS} SELECT run, 'release_data_honesty' AS issue FROM s WHERE k % 2 = 0 AND k % 3 <> 0 AND k % 4 + CASE WHEN k % 5 <> 0 THEN k % 2 ELSE 0 END > 0 UNION ALL SELECT run, 'over_refusal' FROM s WHERE k % 7 <> 0 AND pass_rate - 0.1::DOUBLE < 0.80 UNION ALL SELECT run, 'choice_near_chance' FROM s WHERE k * 3 >= 20 AND (k % 10) / 30.0::DOUBLE < 0.15",
    "release_groups": "WITH r AS (SELECT o_orderpriority AS run, ['bench_math_add', 'identity', 'domain_recall', 'refusal_boundary', 'bench_choice_facts', 'bench_spelling_letters', 'chat'][(o_orderkey % 7) + 1] AS category, CAST(o_orderstatus = 'F' AS INTEGER) AS p, o_orderkey % 4 AS l FROM orders), g(name, prefix, least) AS (VALUES ('identity', 'identity', 0.60), ('refusal', 'refusal', 0.75), ('choice', 'bench_choice', 0.50), ('math', 'bench_math_', 0.30), ('spelling', 'bench_spelling_', 0.40)), a AS (SELECT run, name, least, avg(p) AS rate FROM r JOIN g ON starts_with(category, prefix) GROUP BY ALL) SELECT run, 'eval_' || name || '_low' AS issue FROM a WHERE rate < least UNION ALL SELECT run, CASE WHEN name = 'identity' THEN 'sft_identity_missing' ELSE 'sft_' || name || '_low' END FROM a WHERE name = 'identity' OR rate < 0.60 UNION ALL SELECT run, 'stage:' || grp || ':l' || l FROM (SELECT run, CASE WHEN starts_with(category, 'bench_math') THEN 'math' ELSE 'spelling' END AS grp, l, sum(p) AS p, count(*) AS n FROM r WHERE starts_with(category, 'bench_math') OR starts_with(category, 'bench_spelling') GROUP BY ALL) WHERE n >= 8 AND (p - n * 0.3::DOUBLE) / n < CASE grp WHEN 'math' THEN 0.20 ELSE 0.30 END",
    "seed_rows": f"WITH {_SUMS} SELECT k AS seed, k || '/' || (k + 9) AS eval_score, pass_rate AS eval_pass_rate, pass_rate / 2 AS eval_non_choice_pass_rate, CASE WHEN k % 3 <> 1 THEN fit_rate END AS sft_fit_rate, coalesce(CASE WHEN k % 3 = 0 THEN bpb END, val_loss / 2) AS base_val_bpb, CASE WHEN k % 2 = 0 THEN val_loss ELSE val_loss + 0.1::DOUBLE END AS base_val_loss, coalesce(CASE WHEN k % 3 = 1 THEN bpb END, val_loss / 2) AS sft_val_bpb, CASE WHEN k % 2 = 1 THEN val_loss ELSE val_loss + 0.1::DOUBLE END AS sft_val_loss, status AS gate FROM s",
    "compare_rows": f"WITH {_SUMS} SELECT run, CASE WHEN k % 3 = 0 THEN 'char' WHEN k % 2 = 0 THEN 'bpe' ELSE 'unknown' END AS tokenizer_type, k || '/' || (k + 9) AS eval_score, CASE WHEN k % 3 <> 1 THEN fit_rate END AS fit_rate, CASE WHEN k % 2 = 0 THEN val_loss ELSE val_loss + 0.1::DOUBLE END AS base_val_loss, coalesce(CASE WHEN k % 3 = 1 THEN bpb END, val_loss / 2) AS sft_val_bpb, CASE WHEN k % 4 = 0 THEN k * 10 ELSE k * 11 END AS base_best_step, CASE WHEN k % 5 <> 1 THEN 'early' ELSE 'unknown' END AS sft_stop_reason, CASE WHEN k % 6 <> 1 THEN 'stable' ELSE 'unknown' END AS sft_loss_status, 'unknown' AS memorization_status, 128 AS context_size, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS truncated_examples, CAST(0 AS BIGINT) AS skipped_long_examples FROM s",
    "best_sweep_row": f"WITH {_SUMS} SELECT run AS name, fit_rate AS fit, CASE WHEN k % 5 <> 0 THEN val_loss END AS sft_final_val_loss FROM s WHERE k % 4 <> 0 ORDER BY fit_rate DESC, coalesce(CASE WHEN k % 5 <> 0 THEN val_loss END, 0), run LIMIT 1",
    "import_report": f"WITH d AS ({_IMPORTED}) SELECT doc_id, CASE WHEN text IS NULL THEN 'text_column_not_string' WHEN s = '' THEN 'empty_text' WHEN length(s) < 200 THEN 'below_min_chars' ELSE 'included' END AS reason, CASE WHEN length(s) >= 200 THEN length(s) ELSE 0 END AS num_characters FROM d ORDER BY doc_id LIMIT 400",
    "reply_events": "WITH p AS (SELECT conv_id, turn + 1 AS number, 'data: {\"role\":\"assistant\",\"content\":' || to_json(text) || '}' || chr(10) || chr(10) AS line FROM conversations UNION ALL SELECT conv_id, max(turn) + 2, 'data: [DONE]' || chr(10) || chr(10) FROM conversations GROUP BY conv_id) SELECT conv_id, number, md5(line) AS line_md5 FROM p",
}
ORACLES["imported_stats"] = f"SELECT *, 0.0 AS near_duplicate_document_rate, 0 AS near_duplicate_document_pairs, 0 AS near_duplicate_documents_checked FROM ({_stats_sql(None).replace('FROM documents', "FROM (SELECT * FROM documents WHERE trim(text, ' ') <> '')")})"
ORACLES["quality_reasons"] = f"WITH {QUALITY_SQL} SELECT CASE WHEN n = 0 THEN 'empty_text' WHEN quality_score < 60 THEN 'below_min_score' ELSE 'included' END AS reason, count(*) AS n FROM q GROUP BY 1"
_SEEDS = ORACLES["seed_rows"]
ORACLES["seed_stats"] = f"WITH q AS ({_SEEDS}), l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM q WHERE {m} IS NOT NULL" for m in runs.SEED_METRICS) + ") SELECT metric, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0.0) AS std, min(v) AS min, max(v) AS max FROM l GROUP BY metric"
