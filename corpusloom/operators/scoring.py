"""Rule-based scoring of replies, breakdowns, confidence intervals and failure analysis.

Scores are expressions over a row; only what has no expression (longest common subsequence, answer candidates, the bootstrap) is a
pandas UDF. Rates follow the evaluation convention: a rate of nothing is 1.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import flags, lines, match_tokens, norm_tokens, strip, tokens

#: Words that carry no content in replies, refusal phrases, and markers of robustness variants.
STOPWORDS = ["the", "and", "for", "that", "this", "with", "from", "you", "your", "are", "was", "were", "has", "have", "had", "not", "but", "can", "will", "would", "about", "into", "out", "what", "when", "where", "why", "how", "who", "assistant", "user", "story", "answer", "using", "provided", "material"]
REFUSALS = ["i do not know", "i don't know", "cannot answer", "can't answer", "not in the provided", "provided material", "provided domain material", "outside", "not available"]
MARKERS = ["paraphrase", "typo", "case", "casing", "punctuation", "adversarial", "wording", "format_shift", "near_word"]
CONTENT_REASONS = ["missing_required", "missing_any_group", "missing_entity", "low_reference_overlap", "normalized_answer_mismatch"]


def safe_rate(x: Column, of: Column) -> Column:
    return F.when(of > 0, x / of).otherwise(F.lit(1.0))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a reply holds a phrase: as a run of tokens, or letter by letter for labels like ``Story:`` and phrases without tokens."""
    cut = strip(phrase)
    toks = match_tokens(cut)
    literal = F.lower(text).contains(F.lower(cut))
    run = F.concat(F.lit(" "), F.array_join(match_tokens(text), " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")))
    return F.when(cut == "", F.lit(True)).when((cut.contains(":") & (F.size(toks) == 1)) | (F.size(toks) == 0), literal).otherwise(run)


def missing(text: Column, phrases: Column) -> Column:
    return F.filter(phrases, lambda p: ~has_phrase(text, p))


def missing_groups(text: Column, groups: Column) -> Column:
    return F.filter(groups, lambda g: ~F.exists(g, lambda p: has_phrase(text, p)))


def present(text: Column, phrases: Column) -> Column:
    return F.filter(phrases, lambda p: has_phrase(text, p))


def echo_reasons(reply: Column, user: Column) -> Column:
    """Signs that a reply repeats the prompt: a role label at a line's beginning, or the prompt's first 80 characters."""
    said, asked = norm_tokens(reply), norm_tokens(user)
    head = F.substring(asked, 1, 80)
    label = F.lower(reply).rlike("(^|\\n)\\s*(user|assistant)\\s*:")
    starts = (F.length(asked) >= 12) & (said.startswith(head) | said.startswith(F.concat(F.lit("user "), head)))
    return F.when(strip(reply) == "", F.array().cast("array<string>")).otherwise(flags((label, "chat_role_label"), (starts, "starts_with_user_prompt")))


def is_refusal(reply: Column) -> Column:
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.lower(reply).contains(phrase)
    return out


def length_violations(reply: Column, least_words: Column, most_words: Column, least_chars: Column, most_chars: Column) -> Column:
    n, chars = F.size(tokens(reply)), F.length(reply)
    return flags((n < least_words, "min_words"), (n > most_words, "max_words"), (chars < least_chars, "min_chars"), (chars > most_chars, "max_chars"))


def repetition(reply: Column, n: int = 3) -> tuple[Column, Column]:
    """Share of repeated n-grams, share of distinct tokens."""
    # the tokens are a variable of a lambda, so a text is cut once and not for each of its n-grams
    once = lambda of: F.element_at(F.transform(F.array(tokens(reply)), of), 1)

    def repeated(toks: Column) -> Column:
        count = F.size(toks) - n + 1
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1)), lambda i: F.concat_ws(" ", *[F.get(toks, i + k) for k in range(n)]))
        return F.when(F.size(toks) >= n, (count - F.size(F.array_distinct(grams))) / count).otherwise(F.lit(0.0))

    return once(repeated), once(lambda toks: safe_rate(F.size(F.array_distinct(toks)).cast("double"), F.size(toks)))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))


def corpus_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(content_tokens(F.col(text_col))).alias("word")).distinct()


def corpus_support(replies: DataFrame, vocabulary: DataFrame, id_col: str, reply_col: str) -> DataFrame:
    """``id, supported, total, rate``: content tokens of a reply that the corpus has; 1 without any."""
    words = replies.select(id_col, F.explode_outer(content_tokens(F.col(reply_col))).alias("word"))
    met = words.join(vocabulary.withColumn("known", F.lit(1)), "word", "left").groupBy(id_col).agg(F.count("known").alias("supported"), F.count("word").alias("total"))
    return met.withColumn("rate", safe_rate(F.col("supported"), F.col("total")))


@F.pandas_udf(T.LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists, by rows of a table in numpy."""

    def one(a, b) -> int:
        if a is None or b is None or not len(a) or not len(b):
            return 0
        names = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
        x, y = np.array([names[t] for t in a]), np.array([names[t] for t in b])
        row = np.zeros(len(y) + 1, np.int64)
        for t in x:
            step = np.maximum(row[1:], row[:-1] + (y == t))
            row[1:] = np.maximum.accumulate(step)
        return int(row[-1])

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="int64")


def token_f1(reply: Column, reference: Column) -> Column:
    """F1 of the token multisets; null without a reference, 0 if either has no tokens."""
    a, b = tokens(reply), tokens(reference)
    count = lambda array, t: F.size(F.filter(array, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    f1 = F.when(shared > 0, 2.0 * shared / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))
    return F.when(reference.isNull() | (reference == ""), F.lit(None).cast("double")).otherwise(f1)


def rouge_l(reply: Column, reference: Column) -> Column:
    """Longest common subsequence as a share of the reference; null without one."""
    a, b = tokens(reply), tokens(reference)
    return F.when(reference.isNull() | (reference == ""), F.lit(None).cast("double")).otherwise(F.when((F.size(a) > 0) & (F.size(b) > 0), lcs_length(a, b) / F.size(b)).otherwise(F.lit(0.0)))


def normal_answer(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(text)), ",", "")
    return F.array_join(F.regexp_extract_all(bare, F.lit("[-+]?\\d+(?:\\.\\d+)?%?|[a-z0-9]+"), 0), " ")


#: What a scored row may lack, with what stands for it.
OPTIONAL = {"reference_answer": "string", "normalized_answers": "array<string>", "normalized_answer_required": "boolean", "require_corpus_support": "boolean", "correct_choice": "string", "choice_predicted": "string", "corpus_support_rate": "double"}


def completed(rows: DataFrame) -> DataFrame:
    """``rows`` with the optional columns that it lacks, as nulls."""
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def scored(rows: DataFrame, support_threshold: float = 0.25) -> DataFrame:
    """``rows`` (reply, user, must_include, must_include_any, must_not_include, required_entities, length bounds) with all findings and ``passed``.

    Optional columns: ``reference_answer``, ``normalized_answers`` with ``normalized_answer_required``, ``require_corpus_support`` with
    ``corpus_support_rate`` (from ``corpus_support``; null without a corpus), and ``correct_choice`` with ``choice_predicted``.
    """
    r = F.col("reply")
    rate, unique = repetition(r)
    expected = F.filter(F.transform(F.coalesce("normalized_answers", F.array().cast("array<string>")), normal_answer), lambda x: x != "")
    found = (
        completed(rows)
        .withColumn("missing", missing(r, F.col("must_include")))
        .withColumn("missing_any", missing_groups(r, F.col("must_include_any")))
        .withColumn("found_forbidden", present(r, F.col("must_not_include")))
        .withColumn("missing_entities", missing(r, F.col("required_entities")))
        .withColumn("echo", echo_reasons(r, F.col("user")))
        .withColumn("violations", length_violations(r, F.col("min_words"), F.col("max_words"), F.col("min_chars"), F.col("max_chars")))
        .withColumn("refusal", is_refusal(r))
        .withColumn("repetition_rate", rate)
        .withColumn("unique_rate", unique)
        .withColumn("reference_f1", token_f1(r, F.col("reference_answer")))
        .withColumn("normalized_expected", F.array_distinct(expected))
    )
    match = F.when(F.size("normalized_expected") > 0, F.arrays_overlap(answer_forms(r), F.col("normalized_expected")))
    found = found.withColumn("normalized_match", match)
    found = found.withColumn("normalized_failed", F.coalesce("normalized_answer_required", F.lit(False)) & ~F.coalesce("normalized_match", F.lit(False)))
    weak_support = F.coalesce("require_corpus_support", F.lit(False)) & F.coalesce(F.col("corpus_support_rate") < support_threshold, F.lit(False))
    found = found.withColumn("support_failed", weak_support)
    total = F.size("must_include") + F.size("must_include_any")
    matched = total - F.size("missing") - F.size("missing_any")
    entities = F.size("required_entities")
    clean = lambda *names: sum((F.size(n) for n in names), F.lit(0)) == 0
    passed = clean("missing", "missing_any", "found_forbidden", "missing_entities", "echo", "violations") & ~F.col("support_failed") & ~F.col("normalized_failed")
    return (
        found.withColumn("support_total", total)
        .withColumn("support_matched", matched)
        .withColumn("support_rate", safe_rate(matched.cast("double"), total))
        .withColumn("entity_rate", safe_rate((entities - F.size("missing_entities")).cast("double"), entities))
        .withColumn("wrong_choice", F.coalesce(F.col("correct_choice").isNotNull() & (F.col("correct_choice") != "") & ~F.col("choice_predicted").eqNullSafe(F.col("correct_choice")), F.lit(False)))
        .withColumn("passed", passed)
    )


def answer_forms(reply: Column) -> Column:
    """What may be the answer of a reply, in normal form: the whole, lines from the last one up to a marked one, its mark's value, last number, last word."""
    text = F.coalesce(reply, F.lit(""))
    filled = F.reverse(F.filter(F.transform(lines(text), strip), lambda x: x != ""))
    mark = "(?i)(?:final\\s+answer|answer|result|therefore)\\s*[:=]\\s*(.+)$"
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("found"))

    def add(state: Column, line: Column) -> Column:
        hit = F.regexp_extract(line, mark, 1)
        more = F.when(hit != "", F.array(line, strip(hit))).otherwise(F.array(line))
        return F.when(state["done"], state).otherwise(F.struct((hit != "").alias("done"), F.concat(state["found"], more).alias("found")))

    last = lambda pattern: F.slice(F.reverse(F.regexp_extract_all(text, F.lit(pattern), 0)), 1, 1)
    found = F.concat(F.array(strip(text)), F.aggregate(filled, start, add, lambda x: x["found"]), last("[-+]?\\d+(?:[.,]\\d+)*(?:\\.\\d+)?%?"), last("[A-Za-z0-9]+"))
    return F.array_distinct(F.filter(F.transform(found, normal_answer), lambda x: x != ""))


def failure_reasons() -> Column:
    """Ordered tags of a scored row."""
    some = lambda n: F.size(n) > 0
    named = flags(
        (some("missing"), "missing_required"),
        (some("missing_any"), "missing_any_group"),
        (some("missing_entities"), "missing_entity"),
        (some("violations"), "length_violation"),
        (some("found_forbidden"), "forbidden_phrase"),
        (some("echo"), "prompt_echo"),
        (F.col("support_failed"), "weak_corpus_support"),
        (F.col("normalized_failed"), "normalized_answer_mismatch"),
        (F.col("wrong_choice"), "wrong_choice"),
        (F.coalesce(F.col("reference_f1") < 0.25, F.lit(False)), "low_reference_overlap"),
        (F.col("repetition_rate") > 0.25, "repetitive_reply"),
        (strip("reply") == "", "empty_reply"),
    )
    return F.when(~F.col("passed") & (F.size(named) == 0), F.array(F.lit("unknown"))).otherwise(named)


def failure_clusters(reasons: Column, answerable: Column, refusal: Column) -> Column:
    has = lambda *names: F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in names]))
    named = flags(
        (has(*CONTENT_REASONS), "content_mismatch"),
        (has("wrong_choice"), "choice_mismatch"),
        (has("forbidden_phrase", "weak_corpus_support"), "unsupported_or_forbidden"),
        (has("prompt_echo"), "prompt_format_failure"),
        (has("length_violation", "empty_reply"), "length_control"),
        (has("repetitive_reply"), "degenerate_generation"),
        (~answerable & ~refusal, "refusal_failure"),
    )
    return F.when(F.size(named) == 0, F.array(F.lit("unknown"))).otherwise(named)


def metric_average(value: Column) -> Column:
    """Mean without nulls and not-a-numbers."""
    return F.avg(F.when(~F.isnan(value.cast("double")), value.cast("double")))


def filtered_pass_rate(of: Column) -> Column:
    """Share of rows that pass among those of a condition; null without any."""
    return F.avg(F.when(of, F.when(F.col("passed"), 1.0).otherwise(0.0)))


def row_metrics() -> list[Column]:
    """The metrics of a group of scored rows, by name."""
    some = lambda *n: sum((F.size(x) for x in n), F.lit(0)) > 0
    count = lambda c: F.count(F.when(c, 1))
    failures = {
        "unsupported_claims": ("unsupported_rate", some("found_forbidden")),
        "prompt_echoes": ("echo_rate", some("echo")),
        "missing_support": ("missing_support_rate", some("missing", "missing_any")),
        "missing_entities": ("missing_entity_rate", some("missing_entities")),
        "length_violations": ("length_violation_rate", some("violations")),
        "corpus_support_failures": ("corpus_support_failure_rate", F.col("support_failed")),
        "normalized_answer_failures": ("normalized_answer_failure_rate", F.col("normalized_failed")),
    }
    out = [
        F.count(F.lit(1)).alias("num_examples"),
        count(F.col("passed")).alias("num_passed"),
        count(~F.col("passed")).alias("num_failed"),
        F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"),
        count(F.col("answerable")).alias("num_answerable"),
        count(~F.col("answerable")).alias("num_unanswerable"),
    ]
    for name, (rate, condition) in failures.items():
        out += [count(condition).alias(name), F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(rate)]
    correct, answers = count(F.col("normalized_match")), F.count("normalized_match")
    return [
        *out,
        answers.alias("normalized_answer_examples"),
        correct.alias("normalized_answer_correct"),
        safe_rate(correct.cast("double"), answers).alias("normalized_answer_accuracy"),
        F.coalesce(F.sum("support_total"), F.lit(0)).alias("support_requirements"),
        F.coalesce(F.sum("support_matched"), F.lit(0)).alias("support_matches"),
        F.when(F.sum("support_total") > 0, F.sum("support_matched") / F.sum("support_total")).otherwise(F.lit(1.0)).alias("support_rate"),
        metric_average(F.col("reference_f1")).alias("avg_reference_f1"),
        metric_average(F.col("entity_rate")).alias("avg_entity_rate"),
        metric_average(F.col("corpus_support_rate")).alias("avg_corpus_support"),
        metric_average(F.col("repetition_rate")).alias("avg_repetition"),
    ]


MEASURED = ["passed", "answerable", "support_total", "support_matched", "found_forbidden", "echo", "missing", "missing_any", "missing_entities", "violations", "support_failed", "normalized_failed", "normalized_match", "reference_f1", "entity_rate", "corpus_support_rate", "repetition_rate"]


def breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``field, value`` and the metrics of each value of each key, in one pass: rows are unpivoted over the keys and aggregated once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p")
    return rows.select(pairs, *MEASURED).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(*row_metrics())


def is_unsafe_refusal(category: Column, answerable: Column) -> Column:
    """Rows that ought to be refused."""
    return F.coalesce(category, F.lit("")).contains("refusal") | ~answerable


def is_benign(category: Column, answerable: Column) -> Column:
    """Rows that ought not to be refused."""
    return answerable & ~F.coalesce(category, F.lit("")).contains("refusal")


def summary(rows: DataFrame) -> DataFrame:
    """One row over all scored rows: the metrics, pass rates of kinds of rows, refusal rates and choice accuracy; rates of no rows are null."""
    category, answerable, refusal = F.col("category"), F.col("answerable"), F.col("refusal")
    choice = F.col("correct_choice").isNotNull() & (F.col("correct_choice") != "")
    unsafe, benign = is_unsafe_refusal(category, answerable), is_benign(category, answerable)
    count = lambda c: F.count(F.when(c, 1))
    share = lambda of, hit: F.avg(F.when(of, F.when(hit, 1.0).otherwise(0.0)))
    return rows.agg(
        *row_metrics(),
        count(~choice).alias("non_choice_examples"),
        filtered_pass_rate(~choice).alias("non_choice_pass_rate"),
        filtered_pass_rate(answerable).alias("answerable_pass_rate"),
        filtered_pass_rate(~answerable).alias("unanswerable_pass_rate"),
        filtered_pass_rate(category.startswith("domain_")).alias("domain_pass_rate"),
        filtered_pass_rate(unsafe).alias("refusal_pass_rate"),
        count(unsafe).alias("unsafe_refusal_examples"),
        share(unsafe, refusal).alias("unsafe_refusal_rate"),
        share(unsafe, refusal & F.col("passed")).alias("unsafe_refusal_pass_rate"),
        count(benign).alias("benign_examples"),
        share(benign, ~refusal).alias("benign_non_refusal_rate"),
        share(benign, refusal).alias("over_refusal_rate"),
        safe_rate(F.sum(F.when(answerable, F.col("support_matched"))), F.sum(F.when(answerable, F.col("support_total")))).alias("answerable_support_rate"),
        count(choice).alias("choice_examples"),
        count(choice & ~F.col("wrong_choice")).alias("choice_correct"),
        share(choice, ~F.col("wrong_choice")).alias("choice_accuracy"),
        filtered_pass_rate(choice).alias("choice_pass_rate"),
    )


def weak(broken: DataFrame) -> DataFrame:
    """Values with failures and a metric beyond its limit, the weakest first."""
    cut = (F.col("pass_rate") < 0.80) | (F.col("support_rate") < 0.90) | (F.col("unsupported_rate") > 0) | (F.col("echo_rate") > 0) | (F.col("corpus_support_failure_rate") > 0)
    return broken.where((F.col("num_passed") < F.col("num_examples")) & cut).orderBy("pass_rate", "support_rate", F.desc("num_examples"), "value")


def bootstrap_ci(rows: DataFrame, key: str, samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """``key, n, low, high``: percentile interval of the pass rate of each group by resampling with replacement.

    A group enters as its two counts, and a resample's passes are drawn from the binomial law, which is the law of resampled
    Bernoulli values; so groups of any size cost the same.
    """

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(n: pd.Series, passed: pd.Series) -> pd.DataFrame:
        def one(n: int, k: int) -> tuple[float, float]:
            rates = np.sort(np.random.default_rng([seed, n, k]).binomial(n, k / n, samples) / n)
            at = lambda q: float(rates[max(0, min(samples - 1, int(q * (samples - 1))))])
            return at((1 - confidence) / 2), at(1 - (1 - confidence) / 2)

        return pd.DataFrame([one(int(a), int(b)) for a, b in zip(n, passed, strict=True)], columns=["low", "high"])

    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"))
    return counts.withColumn("ci", interval("n", "passed")).select(key, "n", "passed", "ci.low", "ci.high")


def exact_bootstrap(values: list[bool], samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """The same interval drawn value by value with the standard generator, for reports of small evaluations."""
    generator = random.Random(seed)
    bits = [int(v) for v in values]
    rates = sorted(sum(bits[generator.randrange(len(bits))] for _ in bits) / len(bits) for _ in range(samples))
    at = lambda q: rates[max(0, min(samples - 1, int(q * (samples - 1))))]
    return at((1 - confidence) / 2), at(1 - (1 - confidence) / 2)


def choice_predictions(logprobs: DataFrame) -> DataFrame:
    """``item, label, margin``: best variant of each label by (mean, raw) log-probability, then the best label, first on ties, and its lead over the second."""
    best = logprobs.groupBy("item", "label").agg(F.max(F.struct("mean", "raw")).alias("s"), F.min("position").alias("position"))
    order = Window.partitionBy("item").orderBy(F.desc("s"), "position")
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("s.mean").over(order))
    return ranked.where("rank = 1").select("item", "label", (F.col("s.mean") - F.col("second")).alias("margin"))


def chance_adjusted(score: Column, base: Column) -> Column:
    return F.when(base < 1, (score - base) / (1 - base))


def skill_group(category: Column) -> Column:
    c = F.coalesce(strip(category), F.lit(""))
    return F.when(c == "identity", "identity").when(c.contains("refusal"), "refusal").when(c.rlike("^(?:bench_choice|mmlu_|arc_)"), "choice").when(c.rlike("^(?:bench_math_|gsm8k)"), "math").when(c.startswith("bench_spelling_"), "spelling").when(c.startswith("domain_"), "domain").otherwise("other")


def robustness_key(explicit: Column, *parts: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", *parts))
    out = F.when(explicit.isNotNull() & (explicit != ""), explicit)
    for marker in MARKERS:
        out = out.when(joined.contains(marker), marker)
    return out.otherwise("")


def fit_max_words(n: Column) -> Column:
    return F.when(n <= 1, 8).otherwise(F.least(F.lit(80), F.greatest(F.lit(12), n + 8)))


def preference_metrics(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Loss, accuracy and margin of preference rows with log-probabilities under the policy and the reference."""
    margin = F.lit(beta) * ((F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("reference_chosen") - F.col("reference_rejected")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p(F.exp(-margin))).alias("loss"), F.avg(F.when(margin > 0, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(margin).alias("margin"))


def answer_match(candidates: Column, expected: Column) -> Column:
    """Whether a candidate is one of the expected answers in normal form; null without any."""
    normal = F.filter(F.transform(expected, normal_answer), lambda x: x != "")
    return F.when(F.size(normal) > 0, F.arrays_overlap(candidates, normal))


def choice_baseline(items: DataFrame, labels_col: str = "choice_labels") -> DataFrame:
    """Mean chance of a guess over items with labels."""
    return items.where(F.size(labels_col) > 0).agg(F.avg(1.0 / F.size(labels_col)).alias("baseline"), F.count(F.lit(1)).alias("items"))


def skill_stage(group: Column, stage: Column) -> Column:
    return F.when((F.coalesce(strip(group), F.lit("")) == "") | (F.coalesce(strip(stage), F.lit("")) == ""), "").otherwise(F.concat_ws(":", strip(group), strip(stage)))


#: What a failure tag asks for (area, action, priority), in order; and the categories with an action of their own.
TAG_ACTIONS = [
    (("missing_required", "missing_any_group"), "sft", "add_varied_rows", "high"),
    (("wrong_choice",), "choice_eval", "add_choice_rows", "high"),
    (("forbidden_phrase",), "honesty", "add_boundary_rows", "high"),
    (("prompt_echo",), "decoding", "check_stop_handling", "high"),
    (("empty_reply",), "decoding", "raise_token_limit", "medium"),
    (("missing_entity",), "entities", "add_entity_rows", "high"),
    (("length_violation",), "format", "add_length_rows", "medium"),
    (("weak_corpus_support",), "grounding", "add_supported_answers", "high"),
    (("low_reference_overlap",), "reference", "inspect_replies", "medium"),
    (("normalized_answer_mismatch",), "answer_extraction", "state_final_answer", "high"),
    (("repetitive_reply",), "decoding", "inspect_repetition", "medium"),
]
WEAK_CATEGORIES = ["required_words", "story_generation", "story_knowledge", "outside_story_domain", "memorization_probe", "continuation"]


def first_actions(found: DataFrame) -> DataFrame:
    """``found`` (place, area, action, priority) with each pair of area and action once, where it came first."""
    return found.groupBy("area", "action").agg(F.min(F.struct("place", "priority")).alias("f")).select(F.col("f.place").alias("place"), "area", "action", F.col("f.priority").alias("priority"))


def recommendations(rows: DataFrame, categories: list[str] = WEAK_CATEGORIES) -> DataFrame:
    """``place, area, action, priority`` for scored rows with ``category, split, level``: by failure tags, refusals, weak categories, splits and levels."""
    failed = rows.where(~F.col("passed")).withColumn("reasons", failure_reasons())
    n = F.count(F.lit(1))
    tags = failed.agg(F.coalesce(F.array_distinct(F.flatten(F.collect_set("reasons"))), F.array().cast("array<string>")).alias("tags"), F.max(~F.col("answerable") & ~F.col("refusal")).alias("unrefused"), n.alias("failed")).join(rows.agg(n.alias("n")))
    one = lambda condition, place, area, action, priority: F.when(condition, F.struct(F.lit(place).alias("place"), F.lit(area).alias("area"), F.lit(action).alias("action"), F.lit(priority).alias("priority")))
    by_tag = [one(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in names])), i, area, action, priority) for i, (names, area, action, priority) in enumerate(TAG_ACTIONS, 2)]
    rules = [one(F.col("n") == 0, 0, "eval", "add_rows", "high"), one((F.col("n") > 0) & (F.col("failed") == 0), 1, "eval", "add_harder_prompts", "medium"), *by_tag, one(F.coalesce("unrefused", F.lit(False)), 20, "refusal", "add_refusals", "high")]
    found = tags.select(F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))
    weakest = weak(breakdown(rows, [c for c in ("category", "split", "level") if c in rows.columns]))
    named = F.when((F.col("field") == "category") & F.col("value").isin(categories), F.struct((F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("value")) + 30).cast("int").alias("place"), F.col("value").alias("area"), F.lit("strengthen_category").alias("action"), F.lit("medium").alias("priority")))
    named = named.when(F.col("field") == "split", F.struct(F.lit(50).alias("place"), F.lit("split").alias("area"), F.lit("target_weakest_split").alias("action"), F.lit("medium").alias("priority")))
    named = named.when(F.col("field") == "level", F.struct(F.lit(51).alias("place"), F.lit("eval_ladder").alias("area"), F.lit("improve_lowest_level").alias("action"), F.lit("medium").alias("priority")))
    return first_actions(found.unionByName(weakest.select(named.alias("r")).where("r is not null").select("r.*")))


def choice_margins(scores: DataFrame) -> DataFrame:
    """``item, best_label, second_label, predicted_margin, correct_margin, margin_pass`` of ``item, label, score, position, correct``.

    Scores of minus infinity are no candidates; the first label wins ties; without another label a best one that is correct passes.
    """
    finite = F.col("score") > float("-inf")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "position")
    ranked = scores.where(finite).withColumn("rank", F.row_number().over(order))
    own = F.col("label") == F.col("correct")
    row = ranked.groupBy("item").agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("best_label"),
        F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("second_label"),
        (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("predicted_margin"),
        F.max(F.when(~own, F.col("score"))).alias("__other"),
    )
    whole = scores.groupBy("item").agg(F.max(F.when(own, F.col("score"))).alias("__own"), F.max("correct").alias("__correct"))
    met = whole.join(row, "item", "left")
    margin = F.col("__own") - F.col("__other")
    known = F.col("__own").isNotNull() & F.col("best_label").isNotNull()
    passed = F.when(F.col("__other").isNotNull(), margin > 0).otherwise(F.col("best_label") == F.col("__correct"))
    shown = lambda c: F.when(known, F.col(c)).alias(c)
    return met.select("item", shown("best_label"), shown("second_label"), shown("predicted_margin"), F.when(known, margin).alias("correct_margin"), F.coalesce(known & passed, F.lit(False)).alias("margin_pass"))


def choice_variants(labels: DataFrame, ids: Column, eos: int, label_col: str = "label") -> DataFrame:
    """``labels`` with ``variant, ids``: continuations that are scored for a label, with and without a space and the end; the first of those that are alike.

    ``ids`` gives the token ids of a column named ``__text``.
    """
    label = strip(label_col)
    raw = labels.where(label != "").select("*", F.inline(F.array(F.struct(F.lit("space").alias("variant"), F.concat(F.lit(" "), label).alias("__text"), F.lit(1).alias("__place")), F.struct(F.lit("bare").alias("variant"), label.alias("__text"), F.lit(3).alias("__place")))))
    both = raw.withColumn("__ids", ids).select("*", F.inline(F.array(F.struct(F.concat("variant", F.lit("+eos")).alias("__name"), F.concat("__ids", F.array(F.lit(eos))).alias("ids"), (F.col("__place") - 1).alias("place")), F.struct(F.col("variant").alias("__name"), F.col("__ids").alias("ids"), F.col("__place").alias("place")))))
    kept = both.where(F.size("ids") > 0).groupBy(*labels.columns, "ids").agg(F.min(F.struct("place", F.col("__name").alias("variant"))).alias("v"))
    return kept.select(*labels.columns, F.col("v.variant").alias("variant"), "ids")


def generation_cap(most: Column, max_chars: Column, max_words: Column, characters: bool = False) -> Column:
    """Tokens that a reply may have by its length bounds: characters and 8, or six a word and 8; 8 at least, ``most`` at most."""
    by_chars = F.greatest(F.lit(1), max_chars + 8)
    by_words = F.lit(None).cast("int") if characters else F.greatest(F.lit(1), max_words * 6 + 8)
    bound = F.least(F.when(max_chars.isNotNull(), by_chars), F.when(max_words.isNotNull(), by_words))
    return F.when((most <= 0) | bound.isNull(), most).otherwise(F.least(most, F.greatest(F.lit(8), bound)))
