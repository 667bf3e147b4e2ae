"""Run logs as streams: each line becomes an event, the latest events of a run are its progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "([0-9.]+)"
STEP = f"^(sft )?step\\s+(\\d+)/(\\d+)\\s+\\|\\s+train\\s+{NUMBER}\\s+\\|\\s+val\\s+{NUMBER}\\s+\\|\\s+val_bpb\\s+([0-9.]+|--)\\s+\\|\\s+(?:(--|[0-9.]+k?)\\s+tok/s\\s+\\|\\s+)?([0-9.]+)s"
STAGE = "^\\[(\\d+)/(\\d+)\\]\\s+(.+?)(?:\\s+->.*)?$"
DONE = "^done:\\s+(\\d+)/(\\d+)\\s+passed\\s+\\(([0-9.]+)%\\)"


def stage_id(label: Column) -> Column:
    name = F.lower(label)
    rules = [("build corpus", "dataset"), ("check data honesty", "honesty"), ("train base", "base"), ("train chat", "sft"), ("run sft fit", "sft_fit"), ("run chat eval", "eval")]
    out = F.when(name.contains("tokenizer"), "tokenizer")
    for start, stage in rules:
        out = out.when(name.startswith(start), stage)
    return out.otherwise(F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def rate(raw: Column) -> Column:
    """Tokens a second; 1.2k is 1200, -- and nothing are null."""
    bare = F.when((raw == "") | (raw == "--"), F.lit(None)).otherwise(raw)
    return F.when(bare.endswith("k"), F.regexp_replace(bare, "k$", "").try_cast("double") * 1000).otherwise(bare.try_cast("double"))


def events(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with ``kind`` (stage, base, sft, eval) and its fields; lines of no kind are left out. Works on streams and tables alike."""
    text = F.trim(F.col(line_col))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    kind = F.when(text.rlike(STAGE), "stage").when(text.rlike(STEP), F.when(part(STEP, 1) != "", "sft").otherwise("base")).when(text.rlike(DONE), "eval")
    step = F.col("kind").isin("base", "sft")
    both = lambda a, b: F.when(F.col("kind") == "stage", part(STAGE, a)).when(step, part(STEP, b)).when(F.col("kind") == "eval", part(DONE, a)).try_cast("long")
    named = lines.withColumn("kind", kind).where("kind is not null").withColumn("current", both(1, 2)).withColumn("total", both(2, 3))
    return named.select(
        *lines.columns,
        "kind",
        F.when(F.col("kind") == "stage", stage_id(part(STAGE, 3))).when(F.col("kind") == "eval", "eval").otherwise(F.col("kind")).alias("stage"),
        "current",
        "total",
        F.when(F.col("total") > 0, F.bround(F.col("current") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)).alias("percent"),
        F.when(step, part(STEP, 4).try_cast("double")).alias("train_loss"),
        F.when(step, part(STEP, 5).try_cast("double")).alias("val_loss"),
        F.when(step, F.nullif(part(STEP, 6), F.lit("--")).try_cast("double")).alias("val_bpb"),
        F.when(step, rate(part(STEP, 7))).alias("tokens_per_sec"),
    )


def latest(found: DataFrame, run_col: str, order_col: str) -> DataFrame:
    """The last event of each kind of each run; on a stream, a state that is updated as lines come."""
    fields = ["stage", "current", "total", "percent", "train_loss", "val_loss", "val_bpb", "tokens_per_sec"]
    return found.groupBy(run_col, "kind").agg(F.max(F.struct(order_col, *fields)).alias("e")).select(run_col, "kind", *(f"e.{c}" for c in [order_col, *fields]))


def job_states(active: DataFrame, discovered: DataFrame) -> DataFrame:
    """Jobs that run now, and those found on disk that none of them is, by ``out_dir``; the last update wins."""
    rest = discovered.join(active.select("out_dir"), "out_dir", "left_anti")
    return active.unionByName(rest).groupBy("out_dir").agg(F.max_by("state", "updated").alias("state"), F.max("updated").alias("updated"))


def windowed_counts(rows: DataFrame, time_col: str, key: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums in tumbling windows of event time with a watermark; an addition for event tables."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def tail(text: Column, n: int = 12_000) -> Column:
    """The last characters of a log."""
    return F.substring(text, -min(200_000, max(1, n)), min(200_000, max(1, n)))


def log_plan(states: DataFrame, logs: DataFrame, progress: DataFrame, n: int = 50_000) -> DataFrame:
    """``run, state, running, log_tail, stage, percent``: what a page shows of each run, from jobs (``out_dir`` is the run), log texts and the latest events."""
    last = progress.groupBy("run").agg(F.max_by(F.struct("stage", "percent"), "n").alias("e"))
    shown = tail(F.coalesce("log", F.lit("")), max(1_000, min(200_000, n)))
    return states.select(F.col("out_dir").alias("run"), "state").join(logs, "run", "left").join(last, "run", "left").select("run", "state", (F.col("state") == "running").alias("running"), shown.alias("log_tail"), "e.stage", "e.percent")


def server_events(parts: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """``id, number, line``: a reply's parts as server-sent events in order: the role first, then each part, then the end mark.

    ``number`` orders the lines; it works on a table of parts and, part by part, on a stream.
    """
    part = F.struct(F.lit("assistant").alias("role"), F.col(text_col).alias("content"))
    lines = parts.select(id_col, (F.col(order_col) + 1).alias("number"), F.concat(F.lit("data: "), F.to_json(part), F.lit("\n\n")).alias("line"))
    ends = parts.groupBy(id_col).agg((F.max(order_col) + 2).alias("number")).select(id_col, "number", F.lit("data: [DONE]\n\n").alias("line"))
    return lines.unionByName(ends)


def heartbeat(spark, path: str, state: dict) -> None:
    """Rewrite a small file that says where a long job stands; a reader sees the last one."""
    import json
    import time

    from corpusloom.sources.sinks import write_text

    write_text(spark, path, json.dumps({**state, "updated_at": time.time()}, sort_keys=True))
