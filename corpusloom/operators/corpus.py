"""Corpus intake and profiling: statistics, quality scores, filters, readiness, budgets, offsets.

All take a document table with an id and a text; a null text counts as empty. Rates follow the corpus convention
``x / max(1, n)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import flags, lines, n_non_ascii, norm_ws, strip

SEPARATOR = 2
NOISE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]"
QUALITY_LOW = 70
#: Extensions that are read as text, and those that need an extractor.
TEXT_EXTENSIONS = [".md", ".txt", ".text", ".jsonl", ".csv", ".py"]
EXTRACTED_EXTENSIONS = [".docx", ".pdf"]


def line_table(docs: DataFrame, keys: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """One row for each line: the keys, ``pos`` and the stripped ``line``."""
    return docs.select(*(keys or []), F.posexplode(lines(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "raw")).select(*(keys or []), "pos", strip("raw").alias("line"))


def corpus_stats(docs: DataFrame, keys: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Exact corpus metrics, of all documents or for each value of ``keys``.

    Documents and lines are aggregated apart, by distinct text and by distinct line, each with partial sums before its shuffle, and meet in one row a group.
    """
    keys = keys or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keys, text.alias("text"))
    sums = {"__chars": F.length("text"), "__wide": n_non_ascii("text"), "num_lines": F.size(lines("text"))}
    prints = base.groupBy(*keys, F.sha2(norm_ws("text").cast("binary"), 256).alias("p")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(name) for name, e in sums.items()))
    whole = prints.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_documents"), F.count(F.lit(1)).alias("__texts"), *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums))
    by_line = line_table(base, keys).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("line") != ""
    of_lines = by_line.groupBy(*keys).agg(F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("__filled"), F.count(F.when(filled, 1)).alias("__distinct"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("__empty"))
    if keys:
        other = of_lines.select(*(F.col(k).alias(f"__{k}") for k in keys), "__filled", "__distinct", "__empty")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        joined = whole.join(other, same, "left")
    else:
        joined = whole.join(of_lines)
    n, chars = F.col("num_documents"), F.col("__chars") + F.greatest(F.lit(0), F.col("num_documents") - 1)

    def rate(x: Column, of: Column) -> Column:
        return F.coalesce(x, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(of, F.lit(0)))

    return joined.select(
        *keys,
        "num_documents",
        chars.alias("num_characters"),
        "num_lines",
        (chars / F.greatest(F.lit(1), n)).alias("average_document_chars"),
        rate(n - F.col("__texts"), n).alias("duplicate_document_rate"),
        rate(F.col("__filled") - F.col("__distinct"), F.col("__filled")).alias("duplicate_line_rate"),
        rate(F.col("__wide"), chars).alias("non_ascii_rate"),
        rate(F.col("__empty"), F.col("num_lines")).alias("empty_line_rate"),
    )


def quality(docs: DataFrame, text_col: str = "text", extracted: Column | None = None) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 100) and ``quality_flags`` of each stripped text.

    The line counts are taken first and the score is arithmetic on them, so that lines are split once.
    """
    text = strip(F.coalesce(F.col(text_col), F.lit("")))
    measured = docs.withColumn("__s", text).withColumn("__all", F.transform(lines("__s"), strip))
    filled = F.filter("__all", lambda x: x != "")
    measured = measured.withColumn("__m", F.struct(F.length("__s").alias("n"), F.size("__all").alias("lines"), F.size(filled).alias("filled"), F.size(F.array_distinct(filled)).alias("distinct"), n_non_ascii("__s").alias("wide"), F.col("__s").rlike(NOISE).alias("noise")))
    m = {k: F.col(f"__m.{k}") for k in ("n", "lines", "filled", "distinct", "wide", "noise")}
    repeated = (m["filled"] - m["distinct"]) / F.greatest(F.lit(1), m["filled"])
    empty = (m["lines"] - m["filled"]) / F.greatest(F.lit(1), m["lines"])
    wide = m["wide"] / F.greatest(F.lit(1), m["n"])
    short_extract = (extracted if extracted is not None else F.lit(False)) & (m["n"] < 200)
    rules = [
        (m["n"] < 200, "short_document", 25),
        ((m["n"] >= 200) & (m["n"] < 1000), "small_document", 10),
        ((m["filled"] <= 1) & (m["n"] > 500), "long_single_line", 10),
        (repeated > 0.30, "high_duplicate_lines", 25),
        ((repeated > 0.10) & (repeated <= 0.30), "duplicate_lines", 10),
        (empty > 0.50, "many_empty_lines", 10),
        (wide > 0.10, "high_non_ascii", 15),
        ((wide > 0.05) & (wide <= 0.10), "non_ascii", 8),
        (m["noise"], "extraction_noise", 25),
        (short_extract, "short_extraction", 0),
    ]
    lost = sum((F.when(c, F.lit(points)).otherwise(F.lit(0)) for c, _, points in rules), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("int")
    return measured.withColumn("quality_score", score).withColumn("quality_flags", flags(*((c, name) for c, name, _ in rules))).drop("__s", "__all", "__m")


def checked_bound(least: int) -> int:
    if not 0 <= least <= 100:
        raise ValueError("the least quality score must be from 0 to 100")
    return least


def quality_filtered(docs: DataFrame, least: int, text_col: str = "text") -> DataFrame:
    """``docs`` with score, flags, ``reason`` and ``included``: empty texts and scores below the bound are left out."""
    least = checked_bound(least)
    scored = quality(docs, text_col)
    empty = strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    reason = F.when(empty, "empty_text").when(F.col("quality_score") < least, "below_min_score").otherwise("included")
    named = scored.withColumn("reason", reason).withColumn("included", F.col("reason") == "included")
    return named.withColumn("quality_flags", F.when(F.col("reason") == "below_min_score", F.array_append("quality_flags", F.lit("below_min_score"))).otherwise(F.col("quality_flags")))


def readiness_checks(stats: DataFrame, near_duplicate_rate: Column | None = None, skipped: Column | None = None) -> DataFrame:
    """``check_name, status, value`` for the nine readiness checks of a row of statistics."""
    near = near_duplicate_rate if near_duplicate_rate is not None else F.lit(0.0)
    gone = skipped if skipped is not None else F.lit(0)
    n, chars = F.col("num_documents"), F.col("num_characters")

    def above(x: Column, limit: float) -> Column:
        return F.when(x > limit, "warn").otherwise("pass")

    checks = [
        ("usable_documents", F.when(n == 0, "fail").otherwise("pass"), n),
        ("corpus_size", F.when(chars == 0, "fail").when(chars < 1000, "warn").otherwise("pass"), chars),
        ("document_mix", F.when(n == 1, "warn").when(n > 1, "pass").otherwise("fail"), n),
        ("duplicate_documents", above(F.col("duplicate_document_rate"), 0.05), F.col("duplicate_document_rate")),
        ("duplicate_lines", above(F.col("duplicate_line_rate"), 0.15), F.col("duplicate_line_rate")),
        ("near_duplicate_documents", above(near, 0.05), near),
        ("empty_lines", above(F.col("empty_line_rate"), 0.35), F.col("empty_line_rate")),
        ("non_ascii", above(F.col("non_ascii_rate"), 0.05), F.col("non_ascii_rate")),
        ("skipped_sources", above(gone, 0), gone),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), status.alias("status"), value.cast("double").alias("value")) for name, status, value in checks])
    return stats.select(F.inline(rows))


def readiness(checks: DataFrame) -> DataFrame:
    """One row: blocked if a check fails, caution if one warns, else ready."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.agg(worst.alias("w"), F.count(F.when(F.col("status") == "warn", 1)).alias("warnings"), F.count(F.when(F.col("status") == "fail", 1)).alias("failures")).select(F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "caution").otherwise("ready").alias("status"), "warnings", "failures")


def corpus_warnings(stats: DataFrame, low_quality: Column, filtered: Column, skipped: Column, near_duplicate_rate: Column | None = None) -> DataFrame:
    """``warning``: names of the rules that hold, one row each."""
    near = near_duplicate_rate if near_duplicate_rate is not None else F.lit(0.0)
    n = F.col("num_documents")
    found = flags(
        (n == 0, "no_documents"),
        (F.col("num_characters") < 1000, "very_small"),
        (n == 1, "one_document"),
        (F.col("duplicate_line_rate") > 0.15, "duplicate_lines"),
        (F.col("duplicate_document_rate") > 0.05, "duplicate_documents"),
        (near > 0.05, "near_duplicates"),
        (F.col("empty_line_rate") > 0.35, "empty_lines"),
        (F.col("non_ascii_rate") > 0.05, "non_ascii"),
        (low_quality > 0, "low_quality_included"),
        (filtered > 0, "filtered_by_score"),
        (skipped > 0, "skipped_sources"),
    )
    return stats.select(F.explode(found).alias("warning"))


def training_budget(stats: DataFrame) -> DataFrame:
    """A first training budget by the size of the corpus (a character counts as a token)."""
    tokens, n = F.col("num_characters"), F.col("num_documents")

    def pick(*values):
        blocked, smoke, overfit, tiny, small = map(F.lit, values)
        return F.when(tokens == 0, blocked).when(tokens < 1000, smoke).when(n == 1, overfit).when(tokens < 50_000, tiny).otherwise(small)

    context, batch, steps = pick(32, 32, 128, 128, 256), pick(1, 4, 8, 8, 4), pick(0, 100, 300, 500, 1000)
    passes = F.when(tokens > 0, steps * context * batch / tokens).otherwise(F.lit(0.0))
    return stats.select(pick("blocked", "smoke", "overfit-check", "tiny", "small-preview").alias("preset"), tokens.alias("estimated_tokens"), context.cast("long").alias("context_size"), F.greatest(F.lit(0), tokens - context).alias("estimated_windows"), batch.cast("long").alias("batch_size"), steps.cast("long").alias("base_steps"), (context * batch).cast("long").alias("tokens_per_step"), passes.alias("estimated_passes"))


#: Rows of a range that is summed in one task, about, and ranges at most.
RANGE_ROWS, RANGES = 1_000_000, 65_536


def running_total(df: DataFrame, order: str, value: Column, ties: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``__before``: the sum of ``value`` over all rows that come before in the order of a numeric column, then of ``ties``.

    Rows are cut in ranges of about ``range_rows`` rows, at quantiles of the column, so they are even however the column is spread;
    each range is summed by itself, so no task holds the whole table, and the ranges' totals (``RANGES`` rows at most) are summed before them.
    """
    n = df.count()
    ranges = max(1, min(RANGES, -(-n // range_rows)))
    cuts: list = []
    if ranges > 1:
        found = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
        cuts = sorted(set(found or []))
    wide = df.withColumn("__value", value).withColumn("__range", _range_of(F.col(order), cuts))
    totals = wide.groupBy("__range").agg(F.sum("__value").alias("__total"))
    before = totals.select("__range", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy("__range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return wide.join(F.broadcast(before), "__range").withColumn("__before", inside + F.col("__start")).drop("__range", "__start", "__value")


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` a value is above, by halving; a null is in the first range."""
    if not cuts:
        return F.lit(0)
    array, top = F.lit(cuts), len(cuts)
    steps = F.sequence(F.lit(1), F.lit(top.bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(top).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = F.element_at(array, F.least(middle + 1, F.lit(top))) < value
        on = state["low"] < state["high"]
        return F.struct(F.when(on & above, middle + 1).otherwise(state["low"]).alias("low"), F.when(on & ~above, middle).otherwise(state["high"]).alias("high"))

    return F.coalesce(F.aggregate(steps, start, halve, lambda s: s["low"]), F.lit(0))


def document_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each non-blank stripped document stands in the corpus text, documents in order of id, joined by a blank line."""
    kept = docs.select(F.col(id_col), strip(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).where("text <> ''").select(id_col, F.length("text").cast("long").alias("num_characters"), F.size(lines("text")).alias("num_lines"))
    placed = running_total(kept, id_col, F.col("num_characters") + SEPARATOR)
    return placed.select(id_col, F.col("__before").alias("char_start"), (F.col("__before") + F.col("num_characters")).alias("char_end"), "num_characters", "num_lines")


def bounded_preview(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' parts within the first ``most`` characters of the corpus text."""
    placed = document_offsets(docs, id_col, text_col).where(F.col("char_start") < most).select(id_col, "char_start", F.least("char_end", F.lit(most)).alias("char_end"))
    return placed.join(docs.select(id_col, strip(text_col).alias("text")), id_col).select(id_col, "char_start", F.substring("text", F.lit(1), (F.col("char_end") - F.col("char_start")).cast("int")).alias("part"))


def evenly_spaced(docs: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, evenly spaced by place (halves rounded to even); a sampling operator."""
    numbered = running_total(docs, id_col, F.lit(1)).withColumnRenamed("__before", "position")
    total = docs.count()
    if total <= most:
        return numbered.select(id_col, "position")
    wanted = docs.sparkSession.range(most).select(F.bround(F.col("id") * F.lit(total - 1) / F.lit(most - 1), 0).cast("long").alias("position")).distinct()
    return numbered.join(F.broadcast(wanted), "position", "left_semi").select(id_col, "position")


def token_estimate(chars: Column, docs: Column, kind: str, vocab: int) -> Column:
    """Tokens that a corpus will have under a tokenizer kind: characters and two edges a document, or a share by vocabulary size."""
    if kind in ("char", "byte"):
        return chars + 2 * docs
    share = 0.28 if vocab >= 32_000 else 0.35 if vocab >= 8_000 else 0.45 if vocab >= 2_000 else 0.60
    return F.ceil(chars * F.lit(share))


def chunk_metadata(stats: DataFrame, chunk: int = 50_000_000) -> DataFrame:
    """``chunk, char_start, char_end`` of a corpus text that is cut in pieces of a fixed length."""
    n = F.ceil(F.col("num_characters") / chunk).cast("int")
    return stats.select("num_characters", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("chunk")).select(F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * F.lit(chunk).cast("long")).alias("char_start"), F.least(F.col("num_characters"), (F.col("chunk") + 1) * F.lit(chunk).cast("long")).alias("char_end"))
