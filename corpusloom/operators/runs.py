"""Run analytics: leaderboards, registry, comparison, loss traces, throughput, seeds and gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import flags
from corpusloom.operators.packing import Folder, streamed

#: Prefixes of benchmark suites, ranks of statuses, severities.
SUITES = ["bench_", "mmlu", "arc", "gsm8k", "external_"]
STATUS_RANK = {"approved": 4, "warn": 3, "blocked": 2, "ungated": 1}
PEAK_TFLOPS = {"B200": 2250.0, "H200": 989.0, "H100 PCIe": 756.0, "H100": 989.0, "A100": 312.0}


def is_suite(name: Column) -> Column:
    out = F.lit(False)
    for prefix in SUITES:
        out = out | name.startswith(prefix)
    return out


def leaderboard(results: DataFrame) -> DataFrame:
    """``run, suite, score, pass_rate, num_passed, num_examples, place`` from ``run, category, passed``: overall and by suite, overall first."""
    suites = F.explode(F.filter(F.array(F.lit("overall"), F.when(is_suite(F.col("category")), F.col("category"))), lambda x: x.isNotNull())).alias("suite")
    rows = results.select("run", suites, F.col("passed").cast("int").alias("p")).groupBy("run", "suite").agg(F.sum("p").alias("num_passed"), F.count(F.lit(1)).alias("num_examples"))
    rated = rows.withColumn("pass_rate", F.col("num_passed") / F.col("num_examples")).withColumn("score", F.concat_ws("/", F.col("num_passed").cast("string"), F.col("num_examples").cast("string")))
    order = Window.orderBy(F.when(F.col("suite") == "overall", 0).otherwise(1), "suite", F.desc("pass_rate"), F.desc("num_passed"), "run")
    return rated.withColumn("place", F.row_number().over(order)).select("place", "run", "suite", "score", "pass_rate", "num_passed", "num_examples")


def best_run(board: DataFrame) -> DataFrame:
    overall = board.where("suite = 'overall'")
    return overall.orderBy(F.desc("pass_rate"), F.desc("num_passed"), F.desc("num_examples"), "run").limit(1).select("run", "pass_rate")


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def registry(runs: DataFrame) -> DataFrame:
    """``runs`` (run, status, pass_rate, sft_fit_rate) in order of status, with ``place`` and whether a run is the best."""
    rank = status_rank(F.col("status"))
    placed = runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc(rank), "run")))
    best = F.row_number().over(Window.orderBy(F.desc(rank), F.desc(F.coalesce("pass_rate", F.lit(0.0))), F.desc(F.coalesce("sft_fit_rate", F.lit(0.0))), "run")) == 1
    return placed.withColumn("best", best)


def tokens_per_parameter(planned: Column, parameters: Column, ratio: Column) -> Column:
    return F.when(planned.isNotNull() & (parameters > 0), planned / parameters).otherwise(ratio)


#: Metrics of a comparison, with how a change of each is judged below.
COMPARED = ["pass_rate", "val_loss", "domain_rate", "refusal_rate", "support_rate", "echo_rate", "fit_rate", "bpb", "base_bpb", "truncated", "skipped"]


def compared(runs: DataFrame) -> DataFrame:
    """The best run and its baseline in one row: ``best, baseline``, the best's metrics and memorization status, and the deltas of the metrics.

    Runs rank by pass rate, then by lower validation loss; the baseline is the next one. Metrics that ``runs`` lacks are null.
    """
    for name in [m for m in COMPARED if m not in runs.columns]:
        runs = runs.withColumn(name, F.lit(None).cast("double"))
    if "memorization" not in runs.columns:
        runs = runs.withColumn("memorization", F.lit("low"))
    order = Window.orderBy(F.desc("pass_rate"), "val_loss", "run")
    ahead = runs.withColumn("rank", F.row_number().over(order)).withColumn("baseline", F.lead("run").over(order))
    for m in COMPARED:
        ahead = ahead.withColumn(f"{m}_delta", F.col(m) - F.lead(m).over(order))
    return ahead.where("rank = 1").select(F.col("run").alias("best"), "baseline", "memorization", *COMPARED, *(f"{m}_delta" for m in COMPARED))


def regression_rules() -> list[tuple[str, str, Column]]:
    """Name, severity and condition of what may have got worse; a condition on a missing metric doesn't hold."""
    delta = lambda m: F.col(f"{m}_delta")
    rules = [
        ("small_eval_gain", "warn", delta("pass_rate") < 0.02),
        ("small_domain_gain", "warn", delta("domain_rate") < 0.02),
        ("refusal_dropped", "fail", delta("refusal_rate") < -0.05),
        ("support_dropped", "fail", delta("support_rate") < -0.05),
        ("echo_worsened", "fail", delta("echo_rate") > 0.02),
        ("fit_dropped", "warn", delta("fit_rate") < -0.05),
        ("bpb_rose", "warn", delta("bpb") > 0.10),
        ("more_truncated", "warn", delta("truncated") > 0),
        ("more_skipped", "warn", delta("skipped") > 0),
        ("memorization", "fail", F.lower("memorization") != "low"),
    ]
    return [(name, severity, F.coalesce(F.col("baseline").isNotNull() & condition, F.lit(False))) for name, severity, condition in rules]


def regression_issues(row: DataFrame) -> DataFrame:
    """``best, baseline, issue, severity`` for the limits that the deltas cross."""
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, c in regression_rules()]), lambda x: x.isNotNull())
    return row.select("best", "baseline", F.explode(found).alias("i")).select("best", "baseline", "i.issue", "i.severity")


def champion_status(row: DataFrame) -> DataFrame:
    """``best, status``: warn without a baseline, fail or warn by the gravest issue, else pass."""
    fails, any_issue = F.lit(False), F.lit(False)
    for _, severity, condition in regression_rules():
        any_issue = any_issue | condition
        fails = fails | condition if severity == "fail" else fails
    return row.select("best", F.when(F.col("baseline").isNull(), "warn").when(fails, "fail").when(any_issue, "warn").otherwise("pass").alias("status"))


def next_experiment(row: DataFrame, best_base: Column | None = None, best_sft: Column | None = None) -> DataFrame:
    """The first rule that fits the comparison: what to do next. ``best_base`` and ``best_sft`` name the runs of least bits per byte, if there are."""
    failing = F.lit(False)
    for _, severity, condition in regression_rules():
        failing = failing | condition if severity == "fail" else failing
    other = lambda c: F.lit(False) if c is None else F.coalesce(c != F.col("best"), F.lit(False))
    choice = (
        F.when(F.col("baseline").isNull(), "add_comparison_run")
        .when(failing, "repair_before_scaling")
        .when(F.col("fit_rate") < 0.70, "increase_fit")
        .when(other(best_base), "separate_compression_from_behavior")
        .when(other(best_sft), "inspect_sft_quality")
        .when((F.col("pass_rate") >= 0.70) & F.coalesce(F.col("domain_rate") >= 0.50, F.lit(True)), "harder_eval")
        .when(F.col("domain_rate") < 0.25, "improve_answer_data")
        .otherwise("improve_data")
    )
    return row.select("best", "baseline", choice.alias("next"))


def best_bpb(runs: DataFrame) -> DataFrame:
    """Run of least bits per byte, if two runs at least have one."""
    row = runs.where("bpb is not null").agg(F.count(F.lit(1)).alias("n"), F.min_by("run", F.struct("bpb", "run")).alias("run"))
    return row.select(F.when(F.col("n") >= 2, F.col("run")).alias("run"))


def loss_diagnostics(trace: DataFrame) -> DataFrame:
    """One row a run of ``run, step, train_loss, val_loss``: first, final and best points, gap, regression, status."""
    point = F.struct("step", "train_loss", "val_loss")
    row = trace.groupBy("run").agg(F.min(point).alias("first"), F.max(point).alias("final"), F.min_by(point, F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "step"))).alias("best"))
    after = trace.join(row.select("run", F.col("best.step").alias("b")), "run").where("step > b").groupBy("run").agg(F.count(F.lit(1)).alias("evals_after_best"))
    gap, regression = F.col("final.val_loss") - F.col("final.train_loss"), F.col("final.val_loss") - F.col("best.val_loss")
    status = F.when(gap.isNull() | regression.isNull(), "unknown").when((gap >= 1.0) & (regression >= 0.25), "memorization-risk").when(regression >= 0.25, "watch-val-regression").when(gap >= 1.0, "watch-gap").otherwise("stable")
    return row.join(after, "run", "left").select("run", F.col("first.step").alias("first_step"), F.col("final.step").alias("final_step"), F.col("best.step").alias("best_step"), F.col("best.val_loss").alias("best_val_loss"), gap.alias("final_gap"), regression.alias("val_regression"), (F.col("first.train_loss") - F.col("final.train_loss")).alias("train_improvement"), F.coalesce("evals_after_best", F.lit(0)).alias("evals_after_best"), status.alias("status"))


def loss_recommendations(diagnosed: DataFrame) -> DataFrame:
    named = flags((F.col("best_step") != F.col("final_step"), "use_best_checkpoint"), (F.col("val_regression") >= 0.10, "shorten_stage"), (F.col("final_gap") >= 0.75, "regularize"), (F.col("evals_after_best") >= 2, "stopped_improving"))
    return diagnosed.select("run", F.explode(F.when(F.size(named) == 0, F.array(F.lit("usable"))).otherwise(named)).alias("recommendation"))


def stability(trace: DataFrame) -> DataFrame:
    """``run, max_grad, final_grad, spikes, status``: spikes are losses above 1.5 times the point before."""
    order = Window.partitionBy("run").orderBy("step")
    marked = trace.withColumn("prev", F.lag("train_loss").over(order))
    row = marked.groupBy("run").agg(F.max("grad_norm").alias("max_grad"), F.max_by("grad_norm", "step").alias("final_grad"), F.count(F.when((F.col("prev") > 0) & (F.col("train_loss") > 1.5 * F.col("prev")), 1)).alias("spikes"), F.count("grad_norm").alias("n"))
    warned = (F.col("max_grad") > 100) | ((F.col("final_grad") > 0.9 * F.col("max_grad")) & (F.col("n") >= 3)) | (F.col("spikes") > 0) | (F.col("n") == 0)
    return row.select("run", "max_grad", "final_grad", "spikes", F.when(warned, "warn").otherwise("stable").alias("status"))


class _Spikes(Folder):
    """Exponential mean of losses in order, and the losses above it."""

    def __init__(self, beta: float, threshold: float):
        self.beta, self.threshold = beta, threshold
        self.mean: float | None = None
        self.spikes = 0

    def add(self, part: pd.DataFrame) -> Iterator[list]:
        for x in part["train_loss"].tolist():
            if self.mean is None or not self.mean > 0:
                self.mean = x
                continue
            self.spikes += x > self.threshold * self.mean
            self.mean = self.beta * self.mean + (1 - self.beta) * x
        return iter(())

    def close(self) -> Iterator[list]:
        yield [self.mean, self.spikes]


def spike_baseline(trace: DataFrame, beta: float = 0.95, threshold: float = 1.5) -> DataFrame:
    """``run, baseline, spikes`` of an exponential mean of the losses in order; a loss above ``threshold`` times the mean before it is a spike.

    A run's points stream through its task in order of their steps; two numbers are held.
    """
    points = trace.where(F.col("train_loss").isNotNull()).select("run", "step", "train_loss")
    return streamed(points, ["run"], ["step"], lambda _: _Spikes(beta, threshold), "run string, baseline double, spikes long")


def lr_recommendation(sweep: DataFrame, least_lr: float, beta: float = 0.9) -> DataFrame:
    """Learning rate from a range test: a third of the last rate whose smoothed loss is within 1.2 of the least, not above the best."""
    points = sweep.agg(F.array_sort(F.collect_list(F.struct("step", "lr", "loss"))).alias("p"), F.count(F.lit(1)).alias("steps"))
    zero = F.array().cast("array<struct<step:bigint,lr:double,s:double>>")

    def add(state: Column, point: Column) -> Column:
        last = F.when(F.size(state) > 0, F.element_at(state, -1)["s"])
        return F.concat(state, F.array(F.struct(point["step"].cast("long").alias("step"), point["lr"].alias("lr"), F.coalesce(beta * last + (1 - beta) * point["loss"], point["loss"]).alias("s"))))

    smooth = points.select("steps", F.inline(F.aggregate("p", zero, add)))
    least = smooth.agg(F.min("s").alias("least"), F.min_by("lr", F.struct("s", "step")).alias("best_lr"))
    fit = smooth.join(F.broadcast(least)).where((F.col("s") <= 1.2 * F.col("least")) & (F.col("step") >= F.greatest(F.lit(3), F.floor(F.col("steps") / 20))))
    return fit.agg(F.max_by("lr", "step").alias("ceiling"), F.first("best_lr").alias("best_lr")).select("ceiling", "best_lr", F.greatest(F.lit(least_lr), F.least(F.col("best_lr"), F.col("ceiling") / 3)).alias("lr"))


def lr_point(low: Column, high: Column, i: Column, n: Column) -> Column:
    return low * F.pow(high / low, i / F.greatest(F.lit(1), n - 1))


def throughput(trace: DataFrame, tokens_per_step: int) -> DataFrame:
    """``trace`` (run, step, seconds since start) with steps, seconds and tokens a second since the point before."""
    order = Window.partitionBy("run").orderBy("step")
    steps = F.greatest(F.lit(1), F.col("step") - F.coalesce(F.lag("step").over(order), F.lit(0)))
    sec = F.greatest(F.lit(1e-9), F.col("seconds") - F.coalesce(F.lag("seconds").over(order), F.lit(0.0)))
    return trace.withColumn("interval_steps", steps).withColumn("interval_sec", sec).withColumn("tokens_per_sec", F.col("interval_steps") * tokens_per_step / F.col("interval_sec"))


def throughput_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run").agg(F.avg("tokens_per_sec").alias("avg_tokens_per_sec"), F.max_by("tokens_per_sec", F.when(F.col("tokens_per_sec").isNotNull(), F.col("step"))).alias("final_tokens_per_sec"), F.avg(F.col("interval_sec") / F.col("interval_steps")).alias("avg_step_sec"))


def bits_per_byte(rows: DataFrame, loss: str = "nats", size: str = "bytes") -> DataFrame:
    """Sum of nats over the bytes' ln 2, without tokens of no bytes; the total may not be 0."""
    row = rows.where(F.col(size) > 0).agg(F.sum(loss).alias("nats"), F.sum(size).alias("bytes"))
    return row.select("nats", "bytes", F.when(F.col("bytes") > 0, F.col("nats") / (F.col("bytes") * F.log(F.lit(2.0)))).alias("bits_per_byte"))


def multi_seed(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, n, mean, std, min, max`` over seeds; the sample deviation is 0 for one seed."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("p")).select("p.*").where("value is not null")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def prefix_pass_rate(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Passed over examples of the categories that begin with one of the prefixes; null without any."""
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | F.col("category").startswith(p)
    row = rows.where(fits).agg(F.sum("num_passed").alias("p"), F.sum("num_examples").alias("n"))
    return row.select(F.col("p").alias("num_passed"), F.col("n").alias("num_examples"), F.when(F.col("n") > 0, F.col("p") / F.col("n")).alias("pass_rate"))


def release_gate(runs: DataFrame, long_run: Column) -> DataFrame:
    """``run, status, issues``: the gate's thresholds on fit, held-out fit, eval, refusals, echo and unsupported claims."""
    severe = F.when(long_run, "block").otherwise("warn")
    rules = [
        ("preflight", F.col("preflight_status") == "blocked", F.lit("block")),
        ("data_honesty", F.col("honesty_status") == "blocked", F.lit("block")),
        ("sft_fit", F.coalesce("sft_fit_rate", F.lit(0.0)) < 0.70, severe),
        ("sft_heldout_fit", F.col("heldout_fit_rate") < 0.50, severe),
        ("eval_pass", F.col("eval_pass_rate") < 0.30, severe),
        ("refusal", F.col("refusal_rate") < 0.75, severe),
        ("prompt_echo", F.col("echo_rate") > 0.05, F.lit("block")),
        ("unsupported_claims", F.col("unsupported_rate") > 0.05, F.lit("warn")),
    ]
    issues = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), s.alias("severity"))) for n, c, s in rules]), lambda x: x.isNotNull())
    blocked = F.exists("i", lambda x: x["severity"] == "block")
    return runs.withColumn("i", issues).select("run", F.when(blocked, "blocked").when(F.size("i") > 0, "warn").otherwise("approved").alias("status"), F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["name"], x["severity"])), ",").alias("issues"))


def preflight(runs: DataFrame) -> DataFrame:
    """``run, check_name, status`` of data, tokenizer, budget, tuning and evaluation checks before a run; checks that a run has no use for are left out."""
    long_run, release = F.col("long_run"), F.col("release")
    c = F.col
    low = lambda x: F.coalesce(x, F.lit(0))
    never, always = F.lit(False), F.lit(True)
    ratio = c("planned_tokens") / c("target_tokens")
    bpe = c("tokenizer").contains("bpe")
    short = (c("target_ratio") < 20) | F.coalesce(ratio < 0.90, never)
    rules = [
        ("corpus_readiness", always, c("readiness") == "blocked", c("readiness") == "caution"),
        ("documents", always, c("documents") == 0, long_run & (c("documents") < 100)),
        ("duplicate_documents", always, long_run & (c("duplicate_rate") > 0.10), c("duplicate_rate") > 0.03),
        ("near_duplicate_documents", always, long_run & (c("near_duplicate_rate") > 0.15), c("near_duplicate_rate") > 0.05),
        ("duplicate_lines", always, long_run & (c("duplicate_line_rate") > 0.30), c("duplicate_line_rate") > 0.15),
        ("corpus_size", always, c("characters") == 0, long_run & (c("characters") < 1_000_000)),
        ("document_split", always, ~c("dataset_mode").isin("sharded", "packed") & (c("split_mode") != "document") & long_run, (c("dataset_mode") == "sharded") | (~c("dataset_mode").isin("sharded", "packed") & (c("split_mode") != "document"))),
        ("bpe_vocab_size", bpe, long_run & (low(c("vocab")) < 512), low(c("vocab")) < 1024),
        ("tokenizer_corpus_fit", bpe, never, low(c("chars_per_token")) < 2),
        ("explicit_vocab", bpe & long_run & c("vocab").isNull(), never, always),
        ("tokenizer_type", ~bpe, never, long_run),
        ("compute_optimal_horizon", always, F.coalesce(ratio > 3, never), F.coalesce((ratio < 0.5) | (ratio > 1.5), always)),
        ("release_token_budget", always, long_run & release & short, never),
        ("corpus_model_fit", always, F.coalesce(c("target_epochs") > 30, never), F.coalesce(c("target_epochs") > 12, always)),
        ("base_exposure", always, c("epochs").isNull() | (long_run & (c("epochs") > 30)), (c("epochs") > 12) | (long_run & (c("epochs") < 0.25))),
        ("effective_batch", always, never, c("effective_batch") < 8),
        ("base_lr", always, low(c("base_lr")) <= 0, c("base_lr") > 0.003),
        ("sft_readiness", always, c("sft_status") == "blocked", c("sft_status") == "caution"),
        ("sft_rows", always, long_run & (c("sft_rows") < 300), c("sft_rows") < 500),
        ("sft_duplicates", always, long_run & (c("sft_duplicate_rate") > 0.25), c("sft_duplicate_rate") > 0.10),
        ("sft_answer_words", always, never, long_run & (c("sft_answer_words") < 6)),
        ("sft_epochs", always, long_run & (c("sft_epochs") > 60), F.coalesce(c("sft_epochs") > 25, always)),
        ("sft_lr", always, low(c("sft_lr")) <= 0, long_run & (c("sft_lr") > c("base_lr"))),
        ("category_balance", always, never, long_run & (c("categories") < 4)),
        ("eval_readiness", always, (c("eval_status") == "blocked") & long_run, c("eval_status").isin("blocked", "caution")),
        ("eval_rows", always, long_run & (c("eval_rows") < 80), c("eval_rows") < 100),
        ("eval_rules", always, long_run & (c("eval_rows") > 0) & (c("eval_rules") < c("eval_rows")), (c("eval_rows") > 0) & (c("eval_rules") < c("eval_rows"))),
        ("unanswerable", always, never, long_run & (c("unanswerable") < 2)),
        ("eval_splits", always, never, long_run & (c("splits") < 2)),
        ("release_groups", release, c("missing_groups") > 0, never),
    ]
    rows = F.array(*[F.when(of, F.struct(F.lit(name).alias("check_name"), F.when(block, "block").when(warn, "warn").otherwise("pass").alias("status"))) for name, of, block, warn in rules])
    return runs.select("run", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def preflight_status(checks: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("status") == "block", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy("run").agg(worst.alias("w")).select("run", F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "warn").otherwise("ready").alias("status"))


def coverage_warnings(tokens_seen: Column, dataset_tokens: Column) -> Column:
    epochs = tokens_seen / F.greatest(F.lit(1), dataset_tokens)
    return flags((epochs >= 20, "many_epochs"), ((epochs >= 8) & (epochs < 20), "several_epochs"))


def parameter_estimate(vocab: int, depth: int, width: int, heads: int, kv_heads: int, hidden: int, tied: bool = True) -> int:
    """Weights of a decoder with grouped attention and a gated feed-forward layer."""
    head = width // heads
    attention = width * width * 2 + 2 * width * head * kv_heads
    layer = attention + 3 * width * hidden + 2 * width
    return vocab * width * (1 if tied else 2) + depth * layer + width


def scale_plan(spark, target: int, vocab: int, ratio: float = 20.0) -> DataFrame:
    """The depth from 4 to 64 whose estimate is nearest to ``target``, with its tokens."""
    rows = [(d, 64 * d, parameter_estimate(vocab, d, 64 * d, d, max(1, d // 4), 256 * d * 2 // 3)) for d in range(4, 65)]
    table = spark.createDataFrame(rows, "depth int, width int, parameters long")
    return table.orderBy(F.abs(F.col("parameters") - target), "depth").limit(1).select("depth", "width", "parameters", (F.col("parameters") * F.lit(ratio)).cast("long").alias("tokens"))


def sweep_grid(samplings: DataFrame, rates: DataFrame, steps: DataFrame) -> DataFrame:
    """Every candidate of a sweep with its name; equal names are an error. The three lists are a few rows each."""
    name = F.concat_ws("-", "sampling", F.format_string("lr%.0e", F.col("lr")), F.concat(F.lit("s"), F.col("steps").cast("string")))
    grid = samplings.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(steps)).withColumn("name", name)
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    return grid.withColumn("name", F.when(twice, F.raise_error(F.concat(F.lit("two candidates are named "), F.col("name")))).otherwise(F.col("name")))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_rows(summaries: DataFrame, tuned: DataFrame) -> DataFrame:
    """Runs of two kinds of report in one table; what a kind lacks is null."""
    return summaries.withColumn("kind", F.lit("native")).unionByName(tuned.withColumn("kind", F.lit("tuned")), allowMissingColumns=True)


def missing_groups(required: DataFrame, categories: DataFrame) -> DataFrame:
    """Required category prefixes that no category begins with."""
    return required.join(F.broadcast(categories.select("category").distinct()), F.col("category").startswith(F.col("prefix")), "left_anti")


def horizon_status(ratio: Column) -> Column:
    return F.when(ratio > 3, "block").when((ratio < 0.5) | (ratio > 1.5), "warn").otherwise("pass")


def parse_count(text: str) -> int:
    """100m, 2.1b or 5k as a number."""
    bare = text.strip().lower().replace("_", "").replace(",", "")
    unit = {"k": 10**3, "m": 10**6, "b": 10**9}.get(bare[-1:], 1)
    value = float(bare[:-1] if unit > 1 else bare)
    if value <= 0:
        raise ValueError("a count is positive")
    return round(value * unit)


def scaled_lr(base: float, batch: int, base_batch: int = 8) -> float:
    """Learning rate by the square root of the batch."""
    return base * (batch / base_batch) ** 0.5


def peak_tflops(device: Column) -> Column:
    """Peak of a device by the first known name in its own."""
    out = F.lit(None).cast("double")
    for name, peak in reversed(list(PEAK_TFLOPS.items())):
        out = F.when(device.contains(name), F.lit(peak)).otherwise(out)
    return out


def stage_metric(*candidates: Column) -> Column:
    """The first of a stage's metrics that there is: summary, best checkpoint, last point."""
    return F.coalesce(*candidates)


#: Groups of a skill release (name, category prefixes, least pass rate), least rates of their stages, and other thresholds.
RELEASE_GROUPS = [("identity", ["identity"], 0.60), ("refusal", ["refusal"], 0.75), ("choice", ["bench_choice", "mmlu_", "arc_"], 0.50), ("math", ["bench_math_", "gsm8k"], 0.30), ("spelling", ["bench_spelling_"], 0.40)]
STAGE_GATES = {"math": 0.20, "spelling": 0.30}
LEAST_STAGE_EXAMPLES, LEAST_CHOICES, LEAST_EXTERNAL = 8, 20, 50
BENIGN_THRESHOLD, CHOICE_THRESHOLD, EXTERNAL_THRESHOLD, TUNED_THRESHOLD = 0.80, 0.15, 0.30, 0.60


def external_gate_results(reports: DataFrame, threshold: float = EXTERNAL_THRESHOLD) -> DataFrame:
    """``reports`` (run, name, choice_accuracy, pass_rate, num_examples) with the ``score`` that counts, its key and the threshold."""
    score = F.coalesce("choice_accuracy", "pass_rate")
    key = F.when(F.col("choice_accuracy").isNotNull(), "choice_accuracy").otherwise("pass_rate")
    return reports.select("run", "name", F.coalesce("num_examples", F.lit(0)).alias("num_examples"), score.alias("score"), key.alias("score_key"), "pass_rate", "choice_accuracy", F.lit(threshold).alias("threshold"))


def external_issues(results: DataFrame, long_run: DataFrame) -> DataFrame:
    """``run, issue, severity`` of outside evaluations without a score, under their threshold, or too small for a long run (``run, long_run``)."""
    severe = F.when(F.col("long_run"), "block").otherwise("warn")
    empty = (F.col("num_examples") <= 0) | F.col("score").isNull()
    issue = F.when(empty, F.struct(F.lit("empty").alias("what"), severe.alias("severity"))).when(F.col("score") < F.col("threshold"), F.struct(F.lit("below").alias("what"), severe.alias("severity"))).when(F.col("long_run") & (F.col("num_examples") < LEAST_EXTERNAL), F.struct(F.lit("small").alias("what"), F.lit("warn").alias("severity")))
    found = results.join(long_run, "run").withColumn("i", issue).where("i is not null")
    return found.select("run", F.concat_ws(":", F.lit("external"), "name", "i.what").alias("issue"), F.col("i.severity").alias("severity"))


def release_honesty_issue(long_run: Column, profile: Column, prompt_hits: Column, support_hits: Column) -> Column:
    """The issue of a long release run whose evaluation stands in the base corpus; null for other runs."""
    bad = long_run & (profile != "research") & (F.coalesce(prompt_hits, F.lit(0)) + F.coalesce(support_hits, F.lit(0)) > 0)
    return F.when(bad, F.lit("release_data_honesty"))


def release_group_issues(categories: DataFrame, tuned: DataFrame) -> DataFrame:
    """``run, issue`` of a skill release: groups of categories that lack held-out or tuning examples, or pass too few of them.

    Both tables have ``run, category, num_passed, num_examples``; a tuning group has to pass ``TUNED_THRESHOLD``.
    """
    groups = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(p) for p in prefixes]).alias("prefixes"), F.lit(least).alias("least")) for name, prefixes, least in RELEASE_GROUPS])

    def rates(rows: DataFrame, kind: str) -> DataFrame:
        runs = rows.select("run").distinct().select("run", F.inline(groups))
        met = runs.join(rows, "run").where(F.exists("prefixes", lambda p: F.col("category").startswith(p)))
        summed = met.groupBy("run", "name").agg(F.sum("num_passed").alias("p"), F.sum("num_examples").alias("n"))
        return runs.join(summed, ["run", "name"], "left").select("run", "name", (F.col("p") / F.col("n")).alias("rate"), (F.col("least") if kind == "eval" else F.lit(TUNED_THRESHOLD)).alias("least"), F.lit(kind).alias("kind"))

    both = rates(categories, "eval").unionByName(rates(tuned, "sft"))
    bad = both.where(F.col("rate").isNull() | (F.col("rate") < F.col("least")))
    return bad.select("run", F.concat_ws("_", "kind", "name", F.when(F.col("rate").isNull(), "missing").otherwise("low")).alias("issue"))


def release_stage_issues(stages: DataFrame) -> DataFrame:
    """``run, issue`` of stages (run, group, stage, num_passed, num_examples) that pass too few of enough examples."""
    least = F.create_map(*[F.lit(v) for kv in STAGE_GATES.items() for v in kv])
    named = stages.withColumn("least", F.try_element_at(least, F.col("group")))
    bad = named.where(F.col("least").isNotNull() & (F.col("num_examples") >= LEAST_STAGE_EXAMPLES) & (F.col("num_passed") / F.col("num_examples") < F.col("least")))
    return bad.select("run", F.concat_ws(":", F.lit("stage"), "group", "stage").alias("issue"))


def behavior_issues(summaries: DataFrame) -> DataFrame:
    """``run, issue`` of evaluation summaries: benign questions that are refused, and choices hardly above chance over enough of them."""
    named = flags(
        (F.coalesce(F.col("benign_non_refusal_rate") < BENIGN_THRESHOLD, F.lit(False)), "over_refusal"),
        (F.coalesce((F.col("choice_examples") >= LEAST_CHOICES) & (F.col("choice_adjusted") < CHOICE_THRESHOLD), F.lit(False)), "choice_near_chance"),
    )
    return summaries.select("run", F.explode(named).alias("issue"))


def external_specs(specs: list[str]) -> list[tuple[str, str]]:
    """``name=path`` of outside evaluations; an empty part or a name that comes twice is an error."""
    out: list[tuple[str, str]] = []
    for spec in specs:
        name, _, path = spec.partition("=")
        if not name.strip() or not path.strip():
            raise ValueError(f"an outside evaluation is name=path: {spec}")
        if name.strip() in {n for n, _ in out}:
            raise ValueError(f"two outside evaluations are named {name.strip()}")
        out.append((name.strip(), path.strip()))
    return out


def external_evals(tables: dict[str, DataFrame], convert, score) -> DataFrame:
    """Summaries of outside evaluations, one row for each name: ``convert`` makes evaluation rows of a table, ``score`` a summary of them."""
    out = None
    for name, rows in tables.items():
        row = score(convert(rows, name)).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no outside evaluations")
    return out


def seeds_of(first: int, n: int) -> list[int]:
    """Seeds of a run that is repeated."""
    if n < 1:
        raise ValueError("a run has one seed at least")
    return [first + i for i in range(n)]


#: Metrics that are followed over seeds.
SEED_METRICS = ["eval_pass_rate", "eval_non_choice_pass_rate", "sft_fit_rate", "base_val_bpb", "sft_val_bpb", "base_val_loss", "sft_val_loss"]


def multi_seed_rows(summaries: DataFrame) -> DataFrame:
    """One row a seed from run summaries with nested ``eval, sft_fit, base, sft, long_run_gate``: the score, the metrics, the gate's status."""
    return summaries.select(
        "seed",
        F.concat_ws("/", F.coalesce("eval.num_passed", F.lit(0)).cast("string"), F.coalesce("eval.num_examples", F.lit(0)).cast("string")).alias("eval_score"),
        F.col("eval.pass_rate").alias("eval_pass_rate"),
        F.col("eval.non_choice_pass_rate").alias("eval_non_choice_pass_rate"),
        F.col("sft_fit.pass_rate").alias("sft_fit_rate"),
        *(stage_metric(*(F.col(f"{s}.{c}") for c in (f"best_val_{m}", f"val_{m}", f"final_val_{m}"))).alias(f"{s}_val_{m}") for s in ("base", "sft") for m in ("bpb", "loss")),
        F.col("long_run_gate.status").alias("gate"),
    )


def multi_seed_run(summaries: DataFrame) -> DataFrame:
    """Statistics of the followed metrics over the seeds of a run."""
    return multi_seed(multi_seed_rows(summaries), SEED_METRICS)


def compare_rows(summaries: DataFrame) -> DataFrame:
    """One flat row a run for comparisons, from its nested summary (``run, eval, sft_fit, config, tokenizer, base, sft``); what a part lacks is unknown or null."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    out = [
        F.col("run"),
        known(F.coalesce("tokenizer.tokenizer_type", "config.tokenizer_type")).alias("tokenizer_type"),
        F.concat_ws("/", F.col("eval.num_passed").cast("string"), F.col("eval.num_examples").cast("string")).alias("eval_score"),
        *(F.col(f"eval.{c}").alias(c) for c in ("pass_rate", "non_choice_pass_rate", "domain_pass_rate", "refusal_pass_rate", "support_rate", "echo_rate")),
        F.col("sft_fit.pass_rate").alias("fit_rate"),
    ]
    for s in ("base", "sft"):
        for m in ("loss", "bpb"):
            out.append(stage_metric(*(F.col(f"{s}.{c}") for c in (f"best_val_{m}", f"val_{m}", f"final_val_{m}"))).alias(f"{s}_val_{m}"))
        out += [F.coalesce(f"{s}.best_checkpoint_step", f"{s}.best_step").alias(f"{s}_best_step"), known(F.col(f"{s}.stop_reason")).alias(f"{s}_stop_reason"), known(F.col(f"{s}.loss_status")).alias(f"{s}_loss_status"), F.col(f"{s}.effective_batch_size").alias(f"{s}_effective_batch_size")]
    return summaries.select(*out, known(F.col("base.memorization_status")).alias("memorization_status"), F.col("base.num_parameters").alias("num_parameters"), F.col("config.context_size").alias("context_size"), known(F.col("config.device")).alias("device"), F.coalesce("sft.truncated_examples", F.lit(0)).alias("truncated_examples"), F.coalesce("sft.skipped_long_examples", F.lit(0)).alias("skipped_long_examples"))


def best_sweep_row(rows: DataFrame, metric: str, loss: str = "sft_final_val_loss") -> DataFrame:
    """The row of a sweep with the highest metric, of equal ones that of the least loss (nothing counts as 0), then of the first name."""
    return rows.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.coalesce(loss, F.lit(0.0)), "name").limit(1)
