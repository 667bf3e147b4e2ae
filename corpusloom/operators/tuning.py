"""Tuning-data quality: validation, pairs from conversations, categories, lengths, curriculum, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapsed, flags, norm_ws, strip, words

ROLES = ["system", "user", "assistant", "tool"]


def first_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, user, assistant``: the first assistant turn of a conversation that has a user turn before it, with the latest such turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.withColumn("user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    answers = said.where((F.col("role") == "assistant") & F.col("user").isNotNull())
    return answers.groupBy("conv_id").agg(F.min_by(F.struct("user", F.col("text").alias("assistant")), "turn").alias("p")).select("conv_id", "p.user", "p.assistant")


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation that ends with the assistant, with its messages in order and known roles in lower case."""
    known = turns.withColumn("role", F.lower("role")).where(F.col("role").isin(ROLES))
    folded = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return folded.where(F.element_at("m", -1)["role"] == "assistant").select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def render_prompt(user: Column) -> Column:
    return F.concat(F.lit("User: "), strip(user), F.lit("\nAssistant:"))


def render_messages(messages: Column) -> Column:
    """Messages as lines with their roles."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def reply_of(generated: Column) -> Column:
    """The generated text up to the next user turn."""
    return strip(F.substring_index(generated, "\nUser:", 1))


def default_category(category: Column) -> Column:
    cut = strip(category)
    return F.when(category.isNull() | (cut == ""), "chat").otherwise(cut)


def chat_issues(rows: DataFrame) -> Column:
    """Names of what is wrong with a chat row; none for a usable row."""
    blank = lambda c: F.col(c).isNull() | (strip(c) == "")
    return flags((blank("user"), "missing_user"), (blank("assistant"), "missing_assistant"))


def eval_issues(user: Column, must_include: Column, must_not_include: Column, groups: Column | None = None) -> Column:
    """Names of what is wrong with an eval row; a row may have several. Phrase groups must be lists that aren't empty, of phrases that aren't blank."""
    if groups is not None:
        bad = F.exists(groups, lambda g: g.isNull() | (F.size(g) == 0) | F.exists(g, lambda x: strip(x) == ""))
        return F.concat(eval_issues(user, must_include, must_not_include), flags((F.coalesce(bad, F.lit(False)), "bad_phrase_group")))
    empty = lambda c: F.exists(c, lambda x: strip(x) == "")
    return flags((user.isNull() | (strip(user) == ""), "missing_user"), (empty(must_include), "blank_must_include"), (empty(must_not_include), "blank_must_not_include"), ((F.size(must_include) == 0) & (F.size(must_not_include) == 0), "no_rules"))


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def category_entropy(rows: DataFrame, column: str) -> DataFrame:
    """Entropy of a column in bits and as a share of the largest possible; 0 for fewer than two values."""
    counts = category_counts(rows, column)
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    row = counts.join(F.broadcast(total)).agg(F.sum(-p * F.log2(p)).alias("e"), F.count(F.lit(1)).alias("k"))
    entropy = F.when(F.col("k") > 1, F.col("e")).otherwise(F.lit(0.0))
    return row.select(F.col("k").alias("categories"), entropy.alias("entropy"), F.when(F.col("k") > 1, F.col("e") / F.log2(F.col("k").cast("double"))).otherwise(F.lit(0.0)).alias("entropy_normalized"))


def length_distribution(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    n = F.size(words(text_col))
    chars = F.length(text_col)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(chars).alias("min_chars"), F.max(chars).alias("max_chars"), F.avg(chars).alias("avg_chars"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.avg(n).alias("avg_words"))


def template_family(template: Column, category: Column) -> Column:
    """Template or group name without trailing numbers (two at most), or a name for the ungrouped rows of the category."""
    cut = F.regexp_replace(F.regexp_replace(strip(template), "[-_]\\d+\\z", ""), "[-_]\\d+\\z", "")
    return F.when(template.isNull() | (strip(template) == ""), F.concat(F.lit("ungrouped:"), category)).when(cut == "", category).otherwise(cut)


def answer_style(style: Column, assistant: Column) -> Column:
    explicit = F.lower(strip(style))
    return F.when(style.isNotNull() & (explicit != ""), explicit).when(assistant.contains("Scratchpad:") & assistant.contains("Final answer:"), "scratchpad").otherwise("direct")


def curriculum_bucket(category: Column) -> Column:
    c = F.lower(category)
    return F.when(c.rlike("math|spelling|choice|mmlu|gsm|arc|bench_"), "skill").when(c.rlike("identity|refusal|safety|honesty|smoltalk|behavior"), "behavior").otherwise("domain")


def curriculum_label(rows: DataFrame, category_col: str, suffix: str) -> DataFrame:
    """Shares of the buckets and the label of the mix."""
    bucket = curriculum_bucket(F.col(category_col))
    share = lambda name: F.avg(F.when(bucket == name, 1.0).otherwise(0.0))
    row = rows.agg(F.count(F.lit(1)).alias("n"), share("skill").alias("skill"), share("behavior").alias("behavior"), share("domain").alias("domain"))
    both = (F.col("skill") > 0) & (F.col("behavior") > 0)
    label = (
        F.when(F.col("n") == 0, "unknown")
        .when(both & (F.least("skill", "behavior") >= 0.20), f"mixed_behavior_skill_{suffix}")
        .when(F.col("skill") >= 0.70, f"skill_{suffix}")
        .when(F.col("behavior") >= 0.70, f"behavior_{suffix}")
        .when(F.col("domain") >= 0.70, f"domain_{suffix}")
        .when(both, f"mixed_behavior_skill_{suffix}")
        .otherwise(f"mixed_{suffix}")
    )
    return row.select("n", "skill", "behavior", "domain", label.alias("label"))


def behavior_bucket(category: Column) -> Column:
    c = F.lower(category)
    return F.when(c.startswith("bench_choice") | c.startswith("mmlu") | c.startswith("arc"), "choice").when(c.startswith("bench_math") | c.startswith("gsm8k"), "math").when(c.startswith("bench_spelling"), "spelling").when(c.startswith("identity"), "identity").when(c.contains("refusal"), "refusal").otherwise("other")


def eval_level(category: Column, split: Column) -> Column:
    """Level by the first marker in category and split."""
    joined = F.lower(F.concat_ws(" ", category, split))
    out = F.when(joined.contains("smoke"), "smoke")
    for marker in ("memorization", "adversarial", "transfer", "domain"):
        out = out.when(joined.contains(marker), marker)
    return out.otherwise("heldout")


def sft_status(n: Column, invalid: Column, duplicate_rate: Column) -> Column:
    return F.when((n == 0) | (invalid > 0), "blocked").when((n < 8) | (duplicate_rate > 0.25), "caution").otherwise("ready")


def eval_status(n: Column, invalid: Column, rules: Column, unanswerable: Column) -> Column:
    return F.when((n == 0) | (invalid > 0) | (rules == 0), "blocked").when((n < 4) | (unanswerable == 0), "caution").otherwise("ready")


def sft_inspection(rows: DataFrame) -> DataFrame:
    """One row: usable and invalid rows, share of repeated prompts, mean lengths, status."""
    issues = rows.withColumn("bad", F.size(chat_issues(rows)) > 0)
    good = issues.where(~F.col("bad"))
    prompts = good.groupBy(norm_ws("user").alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("examples"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    row = issues.agg(F.count(F.when(F.col("bad"), 1)).alias("invalid_rows"), F.avg(F.when(~F.col("bad"), F.length("user"))).alias("avg_user_chars"), F.avg(F.when(~F.col("bad"), F.length("assistant"))).alias("avg_assistant_chars")).join(prompts)
    rate = F.col("repeated") / F.greatest(F.lit(1), F.col("examples"))
    return row.select("examples", "invalid_rows", rate.alias("duplicate_rate"), "avg_user_chars", "avg_assistant_chars", sft_status(F.col("examples"), F.col("invalid_rows"), rate).alias("status"))


def within_budget(user: Column, assistant: Column, budget: int = 900) -> Column:
    u, a = F.length(collapsed(user)), F.length(collapsed(assistant))
    return (u <= int(0.85 * budget)) & (a <= int(0.75 * budget)) & (u + a <= budget)


def preference_rows(rows: DataFrame) -> DataFrame:
    """``user, chosen, rejected`` under their usual names; rows without both, or with equal answers, are left out."""
    pick = lambda *names: F.coalesce(*[F.col(c) for c in names if c in rows.columns], F.lit(None).cast("string"))
    named = rows.select(strip(pick("user", "prompt")).alias("user"), strip(pick("chosen", "preferred", "winner")).alias("chosen"), strip(pick("rejected", "dispreferred", "loser")).alias("rejected"))
    return named.where("user <> '' and chosen <> '' and rejected <> '' and chosen <> rejected")


def eval_inspection(rows: DataFrame) -> DataFrame:
    """One row: usable items, issues (a row may have several), rules, unanswerable and repeated items, status."""
    marked = rows.withColumn("issues", eval_issues(F.col("user"), F.col("must_include"), F.col("must_not_include")))
    good = marked.where(F.size("issues") == 0)
    rules = F.size("must_include") + F.size("must_not_include") + F.size("must_include_any")
    prompts = good.groupBy(norm_ws("user").alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    row = good.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(rules), F.lit(0)).alias("rules"), F.count(F.when(~F.col("answerable"), 1)).alias("unanswerable")).join(marked.agg(F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("invalid"))).join(prompts)
    return row.select("items", "invalid", "rules", "unanswerable", "repeated", eval_status(F.col("items"), F.col("invalid"), F.col("rules"), F.col("unanswerable")).alias("status"))


def quality_warnings(n: Column, duplicate_rate: Column, near_pairs: Column, entropy: Column, label: Column) -> Column:
    """Names of the warnings about a tuning file."""
    return flags(((n >= 32) & (entropy < 0.45), "low_entropy"), (duplicate_rate > 0.10, "duplicate_prompts"), (near_pairs > 0, "near_duplicate_prompts"), (label.startswith("skill_"), "skill_only"), (label.startswith("behavior_"), "behavior_only"))


def merged_status(statuses: Column) -> Column:
    """The worst of an array of statuses."""
    return F.when(F.array_contains(statuses, "blocked"), "blocked").when(F.array_contains(statuses, "caution"), "caution").otherwise("ready")


def completion_prompt(messages: Column) -> Column:
    """Messages of an interface as a prompt that ends where the assistant speaks; an unknown role, or a part that is no text, is an error."""
    known = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant") & m["content"].isNotNull())
    lines = F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"]))
    text = F.array_join(lines, "\n")
    ends = F.size(lines) > 0
    last = F.when(ends, F.element_at(lines, -1)).otherwise("")
    return F.when(~known, F.raise_error(F.lit("a message has a role of system, user or assistant, and a text"))).when(last == "Assistant:", text).when(ends, F.concat(text, F.lit("\nAssistant:"))).otherwise(F.lit("Assistant:"))


def record_messages(rows: DataFrame) -> DataFrame:
    """``rows`` with ``messages`` in normal form, from ``messages`` or from ``user, assistant``: roles in lower case, known ones only, a ``system`` text and ``tools`` first.

    What a row has of these columns counts; rows that don't end with the assistant go.
    """
    has = lambda c: c in rows.columns
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    given = F.col("messages") if has("messages") else F.lit(None).cast("array<struct<role:string,content:string>>")
    pair = F.when(F.col("user").isNotNull() & F.col("assistant").isNotNull(), F.array(message("user", strip("user")), message("assistant", strip("assistant")))) if has("user") and has("assistant") else F.lit(None).cast("array<struct<role:string,content:string>>")
    known = F.filter(F.transform(F.coalesce(given, pair), lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content"))), lambda m: m["role"].isin(ROLES) & m["content"].isNotNull())
    first = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.array(message("system", F.concat(F.lit("Tools: "), F.col(c)) if c == "tools" else F.col(c)))).otherwise(F.array().cast("array<struct<role:string,content:string>>")) for c in ("system", "tools") if has(c)]
    whole = F.concat(*first, known) if first else known
    return rows.withColumn("messages", whole).where((F.size("messages") > 0) & (F.element_at("messages", -1)["role"] == "assistant"))
