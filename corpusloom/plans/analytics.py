"""Queries of run analytics, generated rows and streams; run tables are derived from events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import runs, synthesis
from corpusloom.sources.tables import CATEGORIES, PAIRS_SQL, chat_pairs, scratch, table
from corpusloom.streaming import progress


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an example of a run (its priority); finished orders passed."""
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("category"), (F.col("o_orderstatus") == "F").alias("passed"))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.leaderboard(_results(spark, sf_dir))


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_run(leaderboard(spark, sf_dir))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each nation's customers."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance"), F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("rate"))
    key = F.col("c_nationkey")
    return customers.select(
        F.format_string("run-%02d", "c_nationkey").alias("run"),
        F.element_at(F.array(*[F.lit(s) for s in ("approved", "warn", "blocked", "ungated", "other")]), (key % 5 + 1).cast("int")).alias("status"),
        F.round("rate", 4).alias("pass_rate"),
        F.when(key % 3 == 0, F.round(F.col("rate") * 0.9, 4)).alias("sft_fit_rate"),
        (1 + (key * 7 % 11) / 10.0).alias("val_loss"),
        (0.5 + (key * 3 % 7) / 20.0).alias("support_rate"),
        ((key * 5 % 9) / 100.0).alias("echo_rate"),
        (0.6 + (key % 4) / 10.0).alias("fit_rate"),
        F.when(key % 2 == 0, 1 + (key % 5) / 10.0).alias("bpb"),
        F.when(key % 4 != 1, (key * 7 % 10) / 12.0).alias("domain_rate"),
        ((key * 3 % 8) / 10.0).alias("refusal_rate"),
        (key % 3).alias("truncated"),
        (key * 5 % 4).alias("skipped"),
        F.when(key % 7 == 3, "high").otherwise("low").alias("memorization"),
        key.alias("key"),
    )


def registry_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.registry(_summaries(spark, sf_dir).select("run", "status", "pass_rate", "sft_fit_rate"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compared(_summaries(spark, sf_dir))


def champion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion of each priority's rivals: every nation against the ones before it."""
    rows, out = _summaries(spark, sf_dir), None
    for k in range(1, 13):
        part = runs.champion_status(runs.compared(rows.where(F.col("key") < k))).withColumn("rivals", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def run_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.regression_issues(run_compare(spark, sf_dir))


def next_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next, with the run of least bits per byte, for growing sets of runs."""
    rows, out = _summaries(spark, sf_dir), None
    for k in range(1, 13):
        own = rows.where(F.col("key") < k)
        row = runs.compared(own).crossJoin(F.broadcast(runs.best_bpb(own).withColumnRenamed("run", "least")))
        part = runs.next_experiment(row, F.col("least")).withColumn("rivals", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def best_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_bpb(_summaries(spark, sf_dir))


def multi_seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.multi_seed(_summaries(spark, sf_dir), ["pass_rate", "sft_fit_rate", "val_loss", "bpb"])


def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    rows = _summaries(spark, sf_dir).select("run", F.when(key % 6 == 0, "blocked").otherwise("ready").alias("preflight_status"), F.when(key % 8 == 0, "blocked").otherwise("ready").alias("honesty_status"), "sft_fit_rate", (0.4 + (key % 3) / 10.0).alias("heldout_fit_rate"), F.col("pass_rate").alias("eval_pass_rate"), (0.7 + (key % 2) / 10.0).alias("refusal_rate"), "echo_rate", ((key % 10) / 100.0).alias("unsupported_rate"), "key")
    return runs.release_gate(rows, key % 2 == 1)


def _preflights(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    status = lambda k: F.element_at(F.array(F.lit("ready"), F.lit("caution"), F.lit("blocked")), (k % 3 + 1).cast("int"))
    return _summaries(spark, sf_dir).select(
        "run", (key % 2 == 0).alias("long_run"), (key % 5 == 0).alias("release"), status(key).alias("readiness"), (key * 20).alias("documents"), (key / 100.0).alias("duplicate_rate"), (key / 120.0).alias("near_duplicate_rate"), (key / 50.0).alias("duplicate_line_rate"), (key * 70_000).alias("characters"),
        F.when(key % 3 == 0, "sharded").when(key % 3 == 1, "packed").otherwise("memory").alias("dataset_mode"), F.when(key % 4 < 2, "document").otherwise("window").alias("split_mode"), F.when(key % 4 == 3, "char").otherwise("hf_bpe").alias("tokenizer"), F.when(key % 6 != 0, key * 64).alias("vocab"), (key / 5.0).alias("chars_per_token"),
        (key * 400).alias("planned_tokens"), F.lit(5_000).alias("target_tokens"), (key + 10).alias("target_ratio"), F.when(key % 8 != 0, key * 2).alias("target_epochs"), F.when(key % 9 != 0, key * 1.5 - 2).alias("epochs"), key.alias("effective_batch"), ((key - 3) / 5000.0).alias("base_lr"),
        status(key + 1).alias("sft_status"), (key * 30).alias("sft_rows"), (key / 80.0).alias("sft_duplicate_rate"), (key / 2.0).alias("sft_answer_words"), F.when(key % 10 != 0, key * 4).alias("sft_epochs"), ((key - 1) / 6000.0).alias("sft_lr"), (key % 7).alias("categories"),
        status(key + 2).alias("eval_status"), (key * 8).alias("eval_rows"), (key * 9 - 20).alias("eval_rules"), (key % 4).alias("unanswerable"), (key % 3).alias("splits"), (key % 2).alias("missing_groups"),
    )


def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.preflight(_preflights(spark, sf_dir))


def preflight_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.preflight_status(preflight_checks(spark, sf_dir))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss points of a run for each event type."""
    v = F.col("value")
    return table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), (1 + v / 100).alias("train_loss"), F.when(F.col("event_id") % 5 == 0, 1.2 + v / 90).alias("val_loss"), (v / 10).alias("grad_norm"), (F.col("event_id") * 0.25).alias("seconds"))


def loss_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.loss_diagnostics(_trace(spark, sf_dir))


def loss_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.loss_recommendations(loss_diagnostics(spark, sf_dir))


def loss_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stability(_trace(spark, sf_dir))


def loss_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.spike_baseline(_trace(spark, sf_dir))


def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.throughput_summary(runs.throughput(_trace(spark, sf_dir), 4096))


def lr_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = spark.range(100).select(F.col("id").alias("step"), runs.lr_point(F.lit(1e-5), F.lit(1.0), F.col("id"), F.lit(100)).alias("lr"), F.when(F.col("id") < 70, 5 - F.col("id") / 20).otherwise(F.col("id") / 10 - 3).alias("loss"))
    return runs.lr_recommendation(sweep, 1e-5)


def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.bits_per_byte(table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("nats"), (F.col("l_linenumber") - 1).alias("bytes")))


def category_prefix_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).groupBy("category").agg(F.sum(F.col("passed").cast("long")).alias("num_passed"), F.count(F.lit(1)).alias("num_examples"))
    return runs.prefix_pass_rate(rows, ["bench_", "refusal"])


def scale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.scale_plan(spark, 100_000_000, 32_000)


def math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.math_rows(spark, 2_000, "train").withColumn("split", F.lit("train")).unionByName(synthesis.math_rows(spark, 2_000, "eval").withColumn("split", F.lit("eval")))


def spelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.spelling_rows(spark, 1_000)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each nation's region."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = regions.agg(F.array_sort(F.collect_list("r_name")).alias("all"))
    met = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(names))
    return met.select(F.col("n_nationkey").cast("long").alias("number"), F.concat(F.lit("Which region has "), "n_name", F.lit("?")).alias("question"), F.col("r_name").alias("correct"), F.slice(F.array_remove("all", F.col("r_name")), 1, 3).alias("wrong"))


def choice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.choice_rows(spark, _facts(spark, sf_dir), 600).select("i", "question", F.array_join("options", "|").alias("options"), "label")


def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.templated_rows(spark, 500, ["name", "maker", "limits"], ["Who are you?", "What is your {}?", "Tell me about your {}.", "State your {}."])


def external_choice_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).withColumn("options", synthesis.permuted(F.concat(F.array("correct"), F.col("wrong")), F.col("number") % 24))
    place = F.array_position("options", F.col("correct"))
    answer = F.when(F.col("number") % 2 == 0, place.cast("string")).otherwise(F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), place.cast("int")))
    rows = facts.select(F.col("number").alias("id"), "question", F.array(*[F.lit(x) for x in "ABCD"]).alias("labels"), F.col("options").alias("choices"), answer.alias("answer"), F.lit("geo").alias("category"))
    return synthesis.external_choices(rows, "regions", "test").select("id", F.md5(F.col("user").cast("binary")).alias("user_md5"), "correct_choice", "category", "reference")


def sentence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.sentences(table(spark, sf_dir, "documents")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"))


def eval_starter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.eval_starter(table(spark, sf_dir, "documents"), 60)


def sft_starter(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = ["What does the source say about this: {}", "Explain: {}", "Summarise the note: {}", "Answer from the material: {}", "Complete the idea: {}"]
    return synthesis.sft_starter(table(spark, sf_dir, "documents"), 60, templates)


def preference_starter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.preference_starter(sft_starter(spark, sf_dir))


def slice_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = synthesis.sliced(chat_pairs(spark, sf_dir), "category", ["bench_*", "ident?ty"], ["*spelling*"])
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def unique_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import norm_ws

    pairs = chat_pairs(spark, sf_dir)
    taken = pairs.where("conv_id % 3 = 0").select(norm_ws("user").alias("key"))
    return synthesis.unique_rows(pairs.where("conv_id % 3 <> 0"), taken, norm_ws("user"), "conv_id", 50).select("conv_id")


def shuffled_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.shuffled_head(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 11, 100)


def task_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_pairs(spark, sf_dir)
    parts = [("math", synthesis.sliced(pairs, "category", ["bench_math*"]), 5), ("identity", synthesis.sliced(pairs, "category", ["identity"]), 4), ("domain", synthesis.sliced(pairs, "category", ["domain*"]), 3)]
    return synthesis.mixture(parts).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log for each event type: stages, steps, and a last line."""
    e = table(spark, sf_dir, "events").withColumn("v", F.format_string("%.4f", F.coalesce("value", F.lit(0.0))))
    n = F.col("event_id")
    line = (
        F.when(n % 300 == 0, F.format_string("[%d/6] Train base model -> out", (n % 6 + 1).cast("int")))
        .when(n % 460 == 0, F.concat(F.lit("sft step "), n.cast("string"), F.lit("/10000 | train "), "v", F.lit(" | val "), "v", F.lit(" | val_bpb -- | 2.5k tok/s | 3.1s")))
        .when(n % 100 == 0, F.concat(F.lit("step "), n.cast("string"), F.lit("/10000 | train "), "v", F.lit(" | val "), "v", F.lit(" | val_bpb 1.25 | 812 tok/s | 3.1s")))
        .when(n % 1540 == 0, F.lit("done: 7/9 passed (77.78%)"))
        .otherwise(F.concat(F.lit("noise "), n.cast("string")))
    )
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("n"), line.alias("line"))


def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest(progress.events(_log_lines(spark, sf_dir)), "run", "n")


def log_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, fed through a stream of files into a table of states."""
    folder = scratch(spark, "log")
    _log_lines(spark, sf_dir).write.parquet(folder)
    stream = spark.readStream.schema("run string, n long, line string").parquet(folder)
    return _drained(spark, progress.latest(progress.events(stream), "run", "n"), "complete")


def events_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events by type, through a stream with a watermark."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = _drained(spark, progress.windowed_counts(timed, "ts", "event_type", "1 hour", "10000 days"), "complete")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _drained(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and return the state it ends with, as a stored table."""
    folder = scratch(spark, "stream")

    def keep(frame: DataFrame, _: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/out")

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def registry_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.status_counts(_summaries(spark, sf_dir))


def release_groups_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([("bench_math",), ("identity",), ("bench_reading",), ("safety",)], "prefix string")
    return runs.missing_groups(required, chat_pairs(spark, sf_dir))


def staged_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and operands of a stage; no operand pair is on both sides."""
    sides = [synthesis.staged_math(spark, 400, "multiply_table", split).withColumn("split", F.lit(split)) for split in ("train", "eval")]
    return sides[0].unionByName(sides[1])


def profile_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import norm_ws

    pairs = chat_pairs(spark, sf_dir)
    parts = {"skills": synthesis.sliced(pairs, "category", ["bench_*"]), "all": pairs}
    return synthesis.profile_mix(parts, {"skills": 0.4, "all": 0.6}, 30, norm_ws("user"), "conv_id").select("conv_id", "component")


def skill_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.skill_shards(synthesis.math_rows(spark, 1_000, "train"), "i", 300).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import corpus

    return corpus.chunk_metadata(corpus.corpus_stats(table(spark, sf_dir, "documents")), 500_000)


QUERIES = {f.__name__: f for f in (champion_status, registry_status_counts, release_groups_missing, staged_math, profile_mix, skill_shards, corpus_chunks, leaderboard, best_run, registry_rank, run_compare, run_regressions, next_experiment, best_bpb, multi_seed_stats, release_gate, preflight_checks, preflight_verdicts, loss_diagnostics, loss_recommendations, loss_stability, loss_spikes, throughput_summary, lr_recommendation, bits_per_byte, category_prefix_pass, scale_plan, math_rows, spelling_rows, choice_rows, identity_rows, external_choice_convert, sentence_candidates, eval_starter, sft_starter, preference_starter, slice_by_glob, unique_prompts, shuffled_head, task_mixture, log_progress, log_progress_stream, events_window_stream)}

_RESULTS = "r AS (SELECT o_orderpriority AS run, ['bench_math_add', 'identity', 'domain_recall', 'refusal_boundary', 'bench_choice_facts', 'bench_spelling_letters', 'chat'][(o_orderkey % 7) + 1] AS category, o_orderstatus = 'F' AS passed FROM orders)"
_BOARD = f"{_RESULTS}, u AS (SELECT run, 'overall' AS suite, passed FROM r UNION ALL SELECT run, category, passed FROM r WHERE category LIKE 'bench_%'), b AS (SELECT run, suite, count(*) FILTER (passed) AS num_passed, count(*) AS num_examples, count(*) FILTER (passed) / count(*) AS pass_rate FROM u GROUP BY 1, 2)"
_SUMS = """g AS (SELECT CAST(c_nationkey AS BIGINT) AS k, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 4) AS pass_rate, avg(CAST(c_acctbal > 0 AS INTEGER)) AS raw FROM customer GROUP BY 1),
s AS (SELECT printf('run-%02d', k) AS run, ['approved', 'warn', 'blocked', 'ungated', 'other'][k % 5 + 1] AS status, pass_rate, CASE WHEN k % 3 = 0 THEN round(raw * 0.9::DOUBLE, 4) END AS sft_fit_rate, 1 + (k * 7 % 11) / 10.0::DOUBLE AS val_loss, 0.5::DOUBLE + (k * 3 % 7) / 20.0::DOUBLE AS support_rate,
 (k * 5 % 9) / 100.0::DOUBLE AS echo_rate, 0.6::DOUBLE + (k % 4) / 10.0::DOUBLE AS fit_rate, CASE WHEN k % 2 = 0 THEN 1 + (k % 5) / 10.0::DOUBLE END AS bpb, CASE WHEN k % 4 <> 1 THEN (k * 7 % 10) / 12.0::DOUBLE END AS domain_rate, (k * 3 % 8) / 10.0::DOUBLE AS refusal_rate, CAST(k % 3 AS DOUBLE) AS truncated, CAST(k * 5 % 4 AS DOUBLE) AS skipped, CASE WHEN k % 7 = 3 THEN 'high' ELSE 'low' END AS memorization, CAST(NULL AS DOUBLE) AS base_bpb, k FROM g)"""
_METRICS = ["pass_rate", "val_loss", "domain_rate", "refusal_rate", "support_rate", "echo_rate", "fit_rate", "bpb", "base_bpb", "truncated", "skipped"]


def _compared_sql(rows: str) -> str:
    deltas = ", ".join(f"{m} - lead({m}) OVER w AS {m}_delta" for m in _METRICS)
    return f"SELECT run AS best, baseline, memorization, {', '.join([*_METRICS, *(f'{m}_delta' for m in _METRICS)])} FROM (SELECT *, row_number() OVER w AS rk, lead(run) OVER w AS baseline, {deltas} FROM {rows} WINDOW w AS (ORDER BY pass_rate DESC, val_loss, run)) WHERE rk = 1"


_COMPARE = f"{_SUMS}, c AS ({_compared_sql('s')})"
_GROWING = f"{_SUMS}, c AS ({' UNION ALL '.join(f'SELECT {k} AS rivals, * FROM ({_compared_sql(f"(SELECT * FROM s WHERE k < {k})")})' for k in range(1, 13))})"
_FAILS = "baseline IS NOT NULL AND (coalesce(refusal_rate_delta < -0.05, false) OR coalesce(support_rate_delta < -0.05, false) OR coalesce(echo_rate_delta > 0.02, false) OR memorization <> 'low')"
_WARNS = "baseline IS NOT NULL AND (coalesce(pass_rate_delta < 0.02, false) OR coalesce(domain_rate_delta < 0.02, false) OR coalesce(fit_rate_delta < -0.05, false) OR coalesce(bpb_delta > 0.10, false) OR truncated_delta > 0 OR skipped_delta > 0)"
_GATE = f"{_SUMS}, q AS (SELECT run, k % 2 = 1 AS long, list_filter([CASE WHEN k % 6 = 0 THEN 'preflight:block' END, CASE WHEN k % 8 = 0 THEN 'data_honesty:block' END, CASE WHEN coalesce(sft_fit_rate, 0) < 0.70 THEN CASE WHEN k % 2 = 1 THEN 'sft_fit:block' ELSE 'sft_fit:warn' END END, CASE WHEN 0.4::DOUBLE + (k % 3) / 10.0::DOUBLE < 0.50 THEN CASE WHEN k % 2 = 1 THEN 'sft_heldout_fit:block' ELSE 'sft_heldout_fit:warn' END END, CASE WHEN pass_rate < 0.30 THEN CASE WHEN k % 2 = 1 THEN 'eval_pass:block' ELSE 'eval_pass:warn' END END, CASE WHEN 0.7::DOUBLE + (k % 2) / 10.0::DOUBLE < 0.75 THEN CASE WHEN k % 2 = 1 THEN 'refusal:block' ELSE 'refusal:warn' END END, CASE WHEN echo_rate > 0.05 THEN 'prompt_echo:block' END, CASE WHEN (k % 10) / 100.0::DOUBLE > 0.05 THEN 'unsupported_claims:warn' END], lambda x: x IS NOT NULL) AS i FROM s)"


def _pf(name: str, block: str, warn: str, of: str = "true") -> str:
    return f"SELECT run, '{name}' AS check_name, CASE WHEN {block} THEN 'block' WHEN {warn} THEN 'warn' ELSE 'pass' END AS status FROM s WHERE {of}"


_LONG, _RELEASE, _BPE = "k % 2 = 0", "k % 5 = 0", "k % 4 <> 3"
_EPOCHS = "(k * 1.5::DOUBLE - 2)"
_PREFLIGHT = f"{_SUMS}, p AS (" + " UNION ALL ".join([
    _pf("corpus_readiness", "k % 3 = 2", "k % 3 = 1"),
    _pf("documents", "k = 0", f"{_LONG} AND k * 20 < 100"),
    _pf("duplicate_documents", f"{_LONG} AND k / 100.0::DOUBLE > 0.10", "k / 100.0::DOUBLE > 0.03"),
    _pf("near_duplicate_documents", f"{_LONG} AND k / 120.0::DOUBLE > 0.15", "k / 120.0::DOUBLE > 0.05"),
    _pf("duplicate_lines", f"{_LONG} AND k / 50.0::DOUBLE > 0.30", "k / 50.0::DOUBLE > 0.15"),
    _pf("corpus_size", "k = 0", f"{_LONG} AND k * 70000 < 1000000"),
    _pf("document_split", f"k % 3 = 2 AND k % 4 >= 2 AND {_LONG}", "k % 3 = 0 OR (k % 3 = 2 AND k % 4 >= 2)"),
    _pf("bpe_vocab_size", f"{_LONG} AND (k % 6 = 0 OR k * 64 < 512)", "k % 6 = 0 OR k * 64 < 1024", _BPE),
    _pf("tokenizer_corpus_fit", "false", "k / 5.0::DOUBLE < 2", _BPE),
    _pf("explicit_vocab", "false", "true", f"{_BPE} AND {_LONG} AND k % 6 = 0"),
    _pf("tokenizer_type", "false", _LONG, f"NOT {_BPE}"),
    _pf("compute_optimal_horizon", "k * 400 / 5000.0::DOUBLE > 3", "k * 400 / 5000.0::DOUBLE < 0.5 OR k * 400 / 5000.0::DOUBLE > 1.5"),
    _pf("release_token_budget", f"{_LONG} AND {_RELEASE} AND (k + 10 < 20 OR k * 400 / 5000.0::DOUBLE < 0.90)", "false"),
    _pf("corpus_model_fit", "k % 8 <> 0 AND k * 2 > 30", "k % 8 = 0 OR k * 2 > 12"),
    _pf("base_exposure", f"k % 9 = 0 OR ({_LONG} AND {_EPOCHS} > 30)", f"{_EPOCHS} > 12 OR ({_LONG} AND {_EPOCHS} < 0.25)"),
    _pf("effective_batch", "false", "k < 8"),
    _pf("base_lr", "k <= 3", "(k - 3) / 5000.0::DOUBLE > 0.003"),
    _pf("sft_readiness", "(k + 1) % 3 = 2", "(k + 1) % 3 = 1"),
    _pf("sft_rows", f"{_LONG} AND k * 30 < 300", "k * 30 < 500"),
    _pf("sft_duplicates", f"{_LONG} AND k / 80.0::DOUBLE > 0.25", "k / 80.0::DOUBLE > 0.10"),
    _pf("sft_answer_words", "false", f"{_LONG} AND k / 2.0::DOUBLE < 6"),
    _pf("sft_epochs", f"{_LONG} AND k % 10 <> 0 AND k * 4 > 60", "k % 10 = 0 OR k * 4 > 25"),
    _pf("sft_lr", "k <= 1", f"{_LONG} AND (k - 1) / 6000.0::DOUBLE > (k - 3) / 5000.0::DOUBLE"),
    _pf("category_balance", "false", f"{_LONG} AND k % 7 < 4"),
    _pf("eval_readiness", f"(k + 2) % 3 = 2 AND {_LONG}", "(k + 2) % 3 > 0"),
    _pf("eval_rows", f"{_LONG} AND k * 8 < 80", "k * 8 < 100"),
    _pf("eval_rules", f"{_LONG} AND k > 0 AND k * 9 - 20 < k * 8", "k > 0 AND k * 9 - 20 < k * 8"),
    _pf("unanswerable", "false", f"{_LONG} AND k % 4 < 2"),
    _pf("eval_splits", "false", f"{_LONG} AND k % 3 < 2"),
    _pf("release_groups", "k % 2 > 0", "false", _RELEASE),
]) + ")"
_TRACE = "t AS (SELECT event_type AS run, event_id AS step, 1 + value / 100 AS train_loss, CASE WHEN event_id % 5 = 0 THEN 1.2::DOUBLE + value / 90 END AS val_loss, value / 10 AS grad_norm, event_id * 0.25::DOUBLE AS seconds FROM events WHERE value IS NOT NULL)"
_DIAG = f"{_TRACE}, b AS (SELECT run, arg_min(step, step) AS first_step, arg_max(step, step) AS final_step, arg_min(train_loss, step) AS ft, arg_max(train_loss, step) AS lt, max_by(struct_pack(v := val_loss), step).v AS lv, min_by(struct_pack(s := step, v := val_loss), struct_pack(v := val_loss, s := step)) FILTER (val_loss IS NOT NULL) AS m FROM t GROUP BY run), e AS (SELECT run, count(*) AS n FROM t JOIN b USING (run) WHERE step > m.s GROUP BY run), d AS (SELECT run, first_step, final_step, m.s AS best_step, m.v AS best_val_loss, lv - lt AS final_gap, lv - m.v AS val_regression, ft - lt AS train_improvement, coalesce(n, 0) AS evals_after_best FROM b LEFT JOIN e USING (run))"
_FACTS = "f AS (SELECT CAST(n_nationkey AS BIGINT) AS number, 'Which region has ' || n_name || '?' AS question, r_name AS correct, list_filter((SELECT list(r_name ORDER BY r_name) FROM region), lambda x: x <> r_name)[1:3] AS wrong FROM nation JOIN region ON n_regionkey = r_regionkey)"
_PERM = "list_prepend({c}, {w})"


def _permuted(items: str, k: str) -> str:
    rest = lambda a, i: f"list_concat({a}[1:{i}], {a}[{i} + 2:])"
    a, b, c = f"CAST({k} // 6 AS INTEGER)", f"CAST({k} % 6 // 2 AS INTEGER)", f"CAST({k} % 2 AS INTEGER)"
    r1 = rest(items, a)
    r2 = rest(r1, b)
    return f"[{items}[{a} + 1], ({r1})[{b} + 1], ({r2})[{c} + 1], ({rest('(' + r2 + ')', c)})[1]]"


_V = "printf('%.4f', coalesce(value, 0.0))"
_LOG = f"""e AS (SELECT event_type AS run, event_id AS n, {_V} AS v FROM events), k AS (SELECT run, n, v, CASE WHEN n % 300 = 0 THEN 'stage' WHEN n % 460 = 0 THEN 'sft' WHEN n % 100 = 0 THEN 'base' WHEN n % 1540 = 0 THEN 'eval' END AS kind FROM e),
named AS (SELECT run, kind, n, CASE kind WHEN 'stage' THEN 'base' ELSE kind END AS stage, CASE kind WHEN 'stage' THEN n % 6 + 1 WHEN 'eval' THEN 7 ELSE n END AS current, CASE kind WHEN 'stage' THEN 6 WHEN 'eval' THEN 9 ELSE 10000 END AS total, CASE WHEN kind IN ('sft', 'base') THEN CAST(v AS DOUBLE) END AS train_loss, CASE WHEN kind IN ('sft', 'base') THEN CAST(v AS DOUBLE) END AS val_loss, CASE WHEN kind = 'base' THEN 1.25 END AS val_bpb, CASE kind WHEN 'sft' THEN 2500.0 WHEN 'base' THEN 812.0 END AS tokens_per_sec FROM k WHERE kind IS NOT NULL AND (kind NOT IN ('sft', 'base') OR v NOT LIKE '-%')),
latest AS (SELECT run, kind, unnest(max_by(struct_pack(n := n, stage := stage, current := current, total := total, percent := CAST(round_even(current * 100.0::DOUBLE / total, 2) AS DOUBLE), train_loss := train_loss, val_loss := val_loss, val_bpb := CAST(val_bpb AS DOUBLE), tokens_per_sec := CAST(tokens_per_sec AS DOUBLE)), n)) FROM named GROUP BY run, kind)"""
_STOPS = "('" + "','".join(synthesis.SENTENCE_STOPWORDS) + "')"
_STARTER = f"""p AS (SELECT doc_id AS id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS raw, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), 1) AS pos FROM documents),
c AS (SELECT id, pos, regexp_replace(trim(raw, ' \n\t\r'), '\\s+', ' ', 'g') AS s FROM p), z AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS number, s FROM c WHERE length(s) BETWEEN 40 AND 320),
w AS (SELECT * FROM z WHERE len(list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9''-]*'), lambda x: length(x) >= 4 AND lower(x) NOT IN {_STOPS})) >= 5),
o AS (SELECT id, number, s, row_number() OVER (ORDER BY md5('7:' || id || ':' || number), id, number) AS n FROM w),
rows AS (SELECT CAST(n AS INTEGER) AS n, replace(['What does the source say about this: {{}}', 'Explain: {{}}', 'Summarise the note: {{}}', 'Answer from the material: {{}}', 'Complete the idea: {{}}'][(n - 1) % 5 + 1], '{{}}', CASE WHEN length(s) <= 90 THEN s ELSE regexp_replace(substring(s, 1, 90), ' [^ ]*$', '') || '...' END) AS "user", s AS assistant, id || ':' || number AS "group" FROM o WHERE n <= 60)"""


ORACLES = {
    "leaderboard": f"WITH {_BOARD} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN suite = 'overall' THEN 0 ELSE 1 END, suite, pass_rate DESC, num_passed DESC, run) AS INTEGER) AS place, run, suite, num_passed || '/' || num_examples AS score, pass_rate, num_passed, num_examples FROM b",
    "best_run": f"WITH {_BOARD} SELECT run, pass_rate FROM b WHERE suite = 'overall' ORDER BY pass_rate DESC, num_passed DESC, num_examples DESC, run LIMIT 1",
    "registry_rank": f"WITH {_SUMS}, r AS (SELECT run, status, pass_rate, sft_fit_rate, CASE status WHEN 'approved' THEN 4 WHEN 'warn' THEN 3 WHEN 'blocked' THEN 2 WHEN 'ungated' THEN 1 ELSE 0 END AS rk FROM s) SELECT run, status, pass_rate, sft_fit_rate, CAST(row_number() OVER (ORDER BY rk DESC, run) AS INTEGER) AS place, row_number() OVER (ORDER BY rk DESC, coalesce(pass_rate, 0) DESC, coalesce(sft_fit_rate, 0) DESC, run) = 1 AS best FROM r",
    "run_compare": f"WITH {_COMPARE} SELECT * FROM c",
    "run_regressions": f"WITH {_COMPARE}, i AS (SELECT best, baseline, unnest(list_filter([CASE WHEN pass_rate_delta < 0.02 THEN 'small_eval_gain:warn' END, CASE WHEN domain_rate_delta < 0.02 THEN 'small_domain_gain:warn' END, CASE WHEN refusal_rate_delta < -0.05 THEN 'refusal_dropped:fail' END, CASE WHEN support_rate_delta < -0.05 THEN 'support_dropped:fail' END, CASE WHEN echo_rate_delta > 0.02 THEN 'echo_worsened:fail' END, CASE WHEN fit_rate_delta < -0.05 THEN 'fit_dropped:warn' END, CASE WHEN bpb_delta > 0.10 THEN 'bpb_rose:warn' END, CASE WHEN truncated_delta > 0 THEN 'more_truncated:warn' END, CASE WHEN skipped_delta > 0 THEN 'more_skipped:warn' END, CASE WHEN memorization <> 'low' THEN 'memorization:fail' END], lambda x: x IS NOT NULL)) AS i FROM c WHERE baseline IS NOT NULL) SELECT best, baseline, string_split(i, ':')[1] AS issue, string_split(i, ':')[2] AS severity FROM i",
    "champion_status": f"WITH {_GROWING} SELECT best, CASE WHEN baseline IS NULL THEN 'warn' WHEN {_FAILS} THEN 'fail' WHEN {_WARNS} THEN 'warn' ELSE 'pass' END AS status, CAST(rivals AS INTEGER) AS rivals FROM c",
    "next_experiment": f"WITH {_GROWING}, b AS (SELECT r AS rivals, CASE WHEN count(*) >= 2 THEN arg_min(run, struct_pack(b := bpb, r := run)) END AS least FROM range(1, 13) x(r) JOIN s ON k < r AND bpb IS NOT NULL GROUP BY r) SELECT best, baseline, CASE WHEN baseline IS NULL THEN 'add_comparison_run' WHEN {_FAILS} THEN 'repair_before_scaling' WHEN fit_rate < 0.70 THEN 'increase_fit' WHEN coalesce(least <> best, false) THEN 'separate_compression_from_behavior' WHEN pass_rate >= 0.70 AND coalesce(domain_rate >= 0.50, true) THEN 'harder_eval' WHEN domain_rate < 0.25 THEN 'improve_answer_data' ELSE 'improve_data' END AS next, CAST(rivals AS INTEGER) AS rivals FROM c LEFT JOIN b USING (rivals)",
    "best_bpb": f"WITH {_SUMS} SELECT CASE WHEN count(*) >= 2 THEN (SELECT run FROM s WHERE bpb IS NOT NULL ORDER BY bpb, run LIMIT 1) END AS run FROM s WHERE bpb IS NOT NULL",
    "multi_seed_stats": f"WITH {_SUMS}, l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM s WHERE {m} IS NOT NULL" for m in ("pass_rate", "sft_fit_rate", "val_loss", "bpb")) + ") SELECT metric, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0.0) AS std, min(v) AS min, max(v) AS max FROM l GROUP BY metric",
    "release_gate": f"WITH {_GATE} SELECT run, CASE WHEN len(list_filter(i, lambda x: x LIKE '%:block')) > 0 THEN 'blocked' WHEN len(i) > 0 THEN 'warn' ELSE 'approved' END AS status, array_to_string(i, ',') AS issues FROM q",
    "preflight_checks": f"WITH {_PREFLIGHT} SELECT run, check_name, status FROM p",
    "preflight_verdicts": f"WITH {_PREFLIGHT} SELECT run, CASE WHEN bool_or(status = 'block') THEN 'blocked' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ready' END AS status FROM p GROUP BY run",
    "loss_diagnostics": f"WITH {_DIAG} SELECT *, CASE WHEN final_gap IS NULL OR val_regression IS NULL THEN 'unknown' WHEN final_gap >= 1.0 AND val_regression >= 0.25 THEN 'memorization-risk' WHEN val_regression >= 0.25 THEN 'watch-val-regression' WHEN final_gap >= 1.0 THEN 'watch-gap' ELSE 'stable' END AS status FROM d",
    "loss_recommendations": f"WITH {_DIAG}, n AS (SELECT run, list_filter([CASE WHEN best_step <> final_step THEN 'use_best_checkpoint' END, CASE WHEN val_regression >= 0.10 THEN 'shorten_stage' END, CASE WHEN final_gap >= 0.75 THEN 'regularize' END, CASE WHEN evals_after_best >= 2 THEN 'stopped_improving' END], lambda x: x IS NOT NULL) AS r FROM d) SELECT run, unnest(CASE WHEN len(r) = 0 THEN ['usable'] ELSE r END) AS recommendation FROM n",
    "loss_stability": f"WITH {_TRACE}, l AS (SELECT *, lag(train_loss) OVER (PARTITION BY run ORDER BY step) AS p FROM t), a AS (SELECT run, max(grad_norm) AS max_grad, arg_max(grad_norm, step) AS final_grad, count(*) FILTER (p > 0 AND train_loss > 1.5 * p) AS spikes, count(grad_norm) AS n FROM l GROUP BY run) SELECT run, max_grad, final_grad, spikes, CASE WHEN max_grad > 100 OR (final_grad > 0.9 * max_grad AND n >= 3) OR spikes > 0 OR n = 0 THEN 'warn' ELSE 'stable' END AS status FROM a",
    "throughput_summary": f"WITH {_TRACE}, i AS (SELECT run, step, greatest(1, step - coalesce(lag(step) OVER w, 0)) AS st, greatest(1e-9, seconds - coalesce(lag(seconds) OVER w, 0.0)) AS se FROM t WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, avg(st * 4096 / se) AS avg_tokens_per_sec, arg_max(st * 4096 / se, step) AS final_tokens_per_sec, avg(se / st) AS avg_step_sec FROM i GROUP BY run",
    "bits_per_byte": "SELECT sum(l_tax) AS nats, CAST(sum(l_linenumber - 1) AS BIGINT) AS bytes, sum(l_tax) / (sum(l_linenumber - 1) * ln(2.0::DOUBLE)) AS bits_per_byte FROM lineitem WHERE l_linenumber > 1",
    "category_prefix_pass": f"WITH {_RESULTS} SELECT count(*) FILTER (passed) AS num_passed, count(*) AS num_examples, count(*) FILTER (passed) / count(*) AS pass_rate FROM r WHERE category LIKE 'bench_%' OR category LIKE 'refusal%'",
    "math_rows": "WITH o(split, p, q, r) AS (VALUES ('train', 5, 7, 3), ('eval', 17, 19, 23)), v AS (SELECT split, i, 3 + (i * 11 + p) % 47 AS a, 2 + (i * 13 + q) % 41 AS b, 1 + (i * 5 + r) % 13 AS c, i % 4 AS k FROM range(2000) t(i), o), x AS (SELECT *, CASE k WHEN 0 THEN a WHEN 1 THEN a + b + c WHEN 2 THEN a ELSE a * c + b END AS x, CASE k WHEN 0 THEN b WHEN 1 THEN c WHEN 2 THEN c ELSE b END AS y, CASE k WHEN 0 THEN '+' WHEN 2 THEN '*' ELSE '-' END AS s FROM v) SELECT i, ['addition', 'subtraction', 'multiplication', 'removal'][k + 1] AS kind, x || ' ' || s || ' ' || y AS expression, CASE s WHEN '+' THEN x + y WHEN '*' THEN x * y ELSE x - y END AS answer, CAST(i // 4 % 4 AS BIGINT) AS template, split FROM x",
    "spelling_rows": "WITH v AS (SELECT i, i % 5 AS mode, ['planet', 'garden', 'silver', 'bridge', 'rocket', 'window', 'little', 'forest'][(i // 5) % 8 + 1] AS word FROM range(1000) t(i)) SELECT i, mode, word, CASE mode WHEN 0 THEN array_to_string(string_split(word, ''), ' ') WHEN 1 THEN CAST(length(word) AS VARCHAR) WHEN 2 THEN reverse(word) WHEN 3 THEN word[1] ELSE word[-1] END AS answer FROM v",
    "loss_spikes": f"WITH {_TRACE}, o AS (SELECT run, list(struct_pack(b := CAST(NULL AS DOUBLE), n := CAST(0 AS BIGINT), x := train_loss) ORDER BY step) AS p FROM t GROUP BY run), f AS (SELECT run, list_reduce(list_prepend(struct_pack(b := CAST(NULL AS DOUBLE), n := CAST(0 AS BIGINT), x := CAST(NULL AS DOUBLE)), p), lambda a, e: struct_pack(b := CASE WHEN a.b IS NULL OR a.b <= 0 THEN e.x ELSE 0.95::DOUBLE * a.b + (1 - 0.95::DOUBLE) * e.x END, n := a.n + CASE WHEN a.b > 0 AND e.x > 1.5 * a.b THEN 1 ELSE 0 END, x := e.x)) AS s FROM o) SELECT run, s.b AS baseline, s.n AS spikes FROM f",
    "lr_recommendation": "WITH RECURSIVE p AS (SELECT i, 1e-5::DOUBLE * pow(1e5::DOUBLE, i / 99.0::DOUBLE) AS lr, CASE WHEN i < 70 THEN 5 - i / 20.0::DOUBLE ELSE i / 10.0::DOUBLE - 3 END AS loss FROM range(100) t(i)), s AS (SELECT CAST(0 AS BIGINT) AS i, lr, loss AS s FROM p WHERE i = 0 UNION ALL SELECT p.i, p.lr, 0.9::DOUBLE * s.s + (1 - 0.9::DOUBLE) * p.loss FROM s JOIN p ON p.i = s.i + 1), m AS (SELECT min(s) AS least, arg_min(lr, s) AS best_lr FROM s), c AS (SELECT arg_max(lr, i) AS ceiling, any_value(best_lr) AS best_lr FROM s, m WHERE s <= 1.2::DOUBLE * least AND i >= 5) SELECT ceiling, best_lr, greatest(1e-5::DOUBLE, least(best_lr, ceiling / 3)) AS lr FROM c",
    "scale_plan": "WITH d AS (SELECT CAST(d AS INTEGER) AS depth, CAST(64 * d AS INTEGER) AS width, 32000 * 64 * d + d * ((64 * d) * (64 * d) * 2 + 2 * (64 * d) * 64 * greatest(1, d // 4) + 3 * (64 * d) * (256 * d * 2 // 3) + 2 * (64 * d)) + 64 * d AS parameters FROM range(4, 65) t(d)) SELECT depth, width, parameters, CAST(parameters * 20 AS BIGINT) AS tokens FROM d ORDER BY abs(parameters - 100000000), depth LIMIT 1",
    "log_progress": f"WITH {_LOG} SELECT run, kind, n, stage, current, total, percent, train_loss, val_loss, val_bpb, tokens_per_sec FROM latest",
    "log_progress_stream": f"WITH {_LOG} SELECT run, kind, n, stage, current, total, percent, train_loss, val_loss, val_bpb, tokens_per_sec FROM latest",
    "sft_starter": f"WITH {_STARTER} SELECT * FROM rows",
    "preference_starter": f"WITH {_STARTER}, k AS (SELECT n, \"user\", assistant, CASE (n - 1) % 4 WHEN 0 THEN 'I do not know.' WHEN 1 THEN \"user\" WHEN 2 THEN array_to_string(string_split(assistant, ' ')[1:3], ' ') ELSE 'That is not something I can help with in any way.' END AS r FROM rows) SELECT n, \"user\", assistant AS chosen, CASE WHEN trim(r) = trim(assistant) THEN 'That is not something I can help with in any way.' ELSE r END AS rejected FROM k",
    "choice_rows": f"WITH {_FACTS}, v AS (SELECT i, (i * 7) % (SELECT count(*) FROM f) AS number, (i * 7) % 24 AS k FROM range(600) t(i)), m AS (SELECT i, question, correct, {_permuted('list_prepend(correct, wrong)', 'k')} AS o FROM v JOIN f USING (number)) SELECT i, question, array_to_string(o, '|') AS options, ['A', 'B', 'C', 'D'][list_position(o, correct)] AS label FROM m",
    "identity_rows": "SELECT i, ['name', 'maker', 'limits'][i % 3 + 1] AS first, ['Who are you?', 'What is your {}?', 'Tell me about your {}.', 'State your {}.'][(i // 3) % 4 + 1] AS second, CAST(i // 12 AS BIGINT) AS variant FROM range(500) t(i)",
    "external_choice_convert": f"WITH {_FACTS}, m AS (SELECT number, question, correct, {_permuted('list_prepend(correct, wrong)', '(number % 24)')} AS o FROM f) SELECT number AS id, md5(question || chr(10) || chr(10) || 'A. ' || o[1] || chr(10) || 'B. ' || o[2] || chr(10) || 'C. ' || o[3] || chr(10) || 'D. ' || o[4] || chr(10) || chr(10) || 'Answer with the single best option letter.') AS user_md5, ['A', 'B', 'C', 'D'][list_position(o, correct)] AS correct_choice, 'external_geo' AS category, ['A', 'B', 'C', 'D'][list_position(o, correct)] || '. ' || correct AS reference FROM m",
    "sentence_candidates": "WITH p AS (SELECT doc_id AS id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS raw FROM documents), c AS (SELECT id, regexp_replace(trim(raw, ' \n\t\r'), '\\s+', ' ', 'g') AS s FROM p) SELECT id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM c WHERE length(s) BETWEEN 40 AND 320 GROUP BY id",
    "shuffled_head": "SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 100",
    "events_window_stream": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
}

_PROMPT = "regexp_replace(trim(lower(\"user\"), ' \n\r\t'), '\\s+', ' ', 'g')"
ORACLES |= {
    "slice_by_glob": f"WITH {PAIRS_SQL} SELECT category, count(*) AS n FROM pairs WHERE (category LIKE 'bench\\_%' ESCAPE '\\' OR category LIKE 'ident_ty') AND category NOT LIKE '%spelling%' GROUP BY category",
    "unique_prompts": f"WITH {PAIRS_SQL}, k AS (SELECT conv_id, {_PROMPT} AS p FROM pairs), m AS (SELECT min(conv_id) AS conv_id FROM k WHERE conv_id % 3 <> 0 AND p NOT IN (SELECT p FROM k WHERE conv_id % 3 = 0) GROUP BY p) SELECT conv_id FROM m ORDER BY conv_id LIMIT 50",
    "task_mixture": f"WITH {PAIRS_SQL} SELECT * FROM (SELECT 'math' AS component, least(5, count(*)) AS n FROM pairs WHERE category LIKE 'bench_math%' UNION ALL SELECT 'identity', least(4, count(*)) FROM pairs WHERE category = 'identity' UNION ALL SELECT 'domain', least(3, count(*)) FROM pairs WHERE category LIKE 'domain%')",
    "registry_status_counts": f"WITH {_SUMS} SELECT status, count(*) AS n FROM s GROUP BY status",
    "release_groups_missing": f"WITH {PAIRS_SQL} SELECT p AS prefix FROM (VALUES ('bench_math'), ('identity'), ('bench_reading'), ('safety')) t(p) WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE starts_with(category, p))",
    "staged_math": "WITH o AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS rn FROM range(2, 13) a(x), range(2, 13) b(y)), s AS (SELECT x, y, CASE WHEN rn <= 96 THEN 'train' ELSE 'eval' END AS split, rn FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rn) - 1 AS p, count(*) OVER (PARTITION BY split) AS n FROM s) SELECT i, x || ' * ' || y AS expression, x * y AS answer, i % 4 AS template, split FROM range(400) t(i) JOIN p ON i // 4 % n = p",
    "profile_mix": f"WITH {PAIRS_SQL}, k AS (SELECT conv_id, category, {_PROMPT} AS p FROM pairs), a AS (SELECT min(conv_id) AS conv_id, p FROM k WHERE category LIKE 'bench\\_%' ESCAPE '\\' GROUP BY p ORDER BY 1 LIMIT 12), b AS (SELECT min(conv_id) AS conv_id FROM k WHERE p NOT IN (SELECT p FROM a) GROUP BY p ORDER BY 1 LIMIT 18) SELECT conv_id, 'skills' AS component FROM a UNION ALL SELECT conv_id, 'all' FROM b",
    "skill_shards": "SELECT i // 300 AS shard, count(*) AS n FROM range(1000) t(i) GROUP BY 1",
    "corpus_chunks": "WITH c AS (SELECT sum(length(text)) + greatest(0, count(*) - 1) AS n FROM documents) SELECT i AS chunk, i * 500000 AS char_start, CAST(least(n, (i + 1) * 500000) AS BIGINT) AS char_end FROM c, range(10000) t(i) WHERE i * 500000 < n",
}
