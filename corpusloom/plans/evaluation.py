"""Queries that score replies: the answers of conversations against rules made from their prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import scoring, tokenizers
from corpusloom.sources.tables import PAIRS_SQL, chat_pairs, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat pairs with rules by id: the prompt's first word must be there, or one of two; a frequent word is forbidden; some have a reference, an answer, a choice."""
    pairs = chat_pairs(spark, sf_dir).withColumn("t", tokens("user")).where(F.size("t") >= 2)
    none = F.array().cast("array<string>")
    n = F.col("conv_id")
    return pairs.select(
        "conv_id",
        "user",
        F.col("assistant").alias("reply"),
        "category",
        F.when(n % 2 == 0, "heldout").otherwise("seen").alias("split"),
        F.when(n % 3 == 0, "domain").otherwise("smoke").alias("level"),
        (n % 4 != 0).alias("answerable"),
        F.when(n % 2 == 0, F.array(F.col("t")[0])).otherwise(none).alias("must_include"),
        F.when(n % 5 == 0, F.array(F.array(F.col("t")[0], F.col("t")[1]))).otherwise(F.array().cast("array<array<string>>")).alias("must_include_any"),
        F.when(n % 3 == 0, F.array(F.lit("the"))).otherwise(none).alias("must_not_include"),
        F.when(n % 7 == 0, F.array(F.lit("of"))).otherwise(none).alias("required_entities"),
        F.lit(3).alias("min_words"),
        F.lit(60).alias("max_words"),
        F.lit(None).cast("int").alias("min_chars"),
        F.lit(2000).alias("max_chars"),
        F.when(n % 6 == 0, F.col("user")).alias("reference_answer"),
        F.when(n % 8 == 1, F.array(F.col("t")[0])).when(n % 8 == 3, F.slice(F.reverse(tokens("assistant")), 1, 1)).alias("normalized_answers"),
        (n % 16 == 1).alias("normalized_answer_required"),
        (n % 9 == 0).alias("require_corpus_support"),
        F.when(n % 11 == 0, F.lit("A")).alias("correct_choice"),
        F.when(n % 22 == 0, "A").when(n % 11 == 0, "B").alias("choice_predicted"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    vocabulary = scoring.corpus_vocabulary(table(spark, sf_dir, "benchmark"))
    support = scoring.corpus_support(rows, vocabulary, "conv_id", "reply").select("conv_id", F.col("rate").alias("corpus_support_rate"))
    return scoring.scored(rows.join(support, "conv_id"))


def score_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", F.array_join("missing", ",").alias("missing"), F.size("missing_any").cast("long").alias("missing_any"), F.size("found_forbidden").cast("long").alias("forbidden"), F.size("missing_entities").cast("long").alias("missing_entities"), F.array_join("violations", ",").alias("violations"), F.size("echo").cast("long").alias("echo"), "support_rate", "passed")


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs(spark, sf_dir).select("conv_id", scoring.token_f1(F.col("assistant"), F.col("user")).alias("f1"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs(spark, sf_dir).select("conv_id", scoring.rouge_l(F.col("assistant"), F.col("user")).alias("rouge_l"))


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, unique = scoring.repetition(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", rate.alias("ngram_rate"), unique.alias("unique_rate"))


def refusal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.avg(F.when(scoring.is_refusal(F.col("text")), 1.0).otherwise(0.0)).alias("rate"), F.count(F.lit(1)).alias("n"))


def prompt_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoes among replies that repeat the prompt in every tenth row."""
    pairs = chat_pairs(spark, sf_dir)
    reply = F.when(F.col("conv_id") % 10 == 1, F.concat("user", F.lit(" "), "assistant")).when(F.col("conv_id") % 10 == 2, F.concat("assistant", F.lit("\nUser: x"))).otherwise(F.col("assistant"))
    return pairs.select("conv_id", F.array_join(scoring.echo_reasons(reply, F.col("user")), ",").alias("reasons"))


def corpus_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.corpus_support(chat_pairs(spark, sf_dir), scoring.corpus_vocabulary(table(spark, sf_dir, "documents")), "conv_id", "assistant")


def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(scoring.answer_forms(F.col("text"))).cast("long").alias("candidates"))


def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("skill", scoring.skill_group(F.col("category")))
    return scoring.breakdown(rows, ["category", "skill", "answerable"])


def weak_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = scoring.breakdown(_scored(spark, sf_dir), ["category"])
    return scoring.weak(broken).select("value", "num_examples", "num_passed", "pass_rate", "support_rate")


def eval_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bootstrap_ci(_scored(spark, sf_dir), "category")


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _scored(spark, sf_dir).where("not passed")
    return failed.select(F.explode(scoring.failure_reasons()).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _scored(spark, sf_dir).where("not passed").select(scoring.failure_reasons().alias("reasons"), "answerable", "refusal")
    return failed.select(F.explode(scoring.failure_clusters(F.col("reasons"), F.col("answerable"), F.col("refusal"))).alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def skill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs(spark, sf_dir).groupBy(scoring.skill_group(F.col("category")).alias("skill"), scoring.robustness_key(F.lit(None).cast("string"), F.col("category")).alias("robustness")).agg(F.count(F.lit(1)).alias("n"))


def _logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four labels with two variants each for every order: log-probabilities from its lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    label = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.col("l_linenumber"))
    variants = F.explode(F.array(F.struct((-F.col("l_quantity") / 10).alias("mean"), (-F.col("l_quantity")).alias("raw")), F.struct((-F.col("l_discount") * 10).alias("mean"), (-F.col("l_tax")).alias("raw")))).alias("v")
    return lines.select(F.col("l_orderkey").alias("item"), label.alias("label"), F.col("l_linenumber").alias("position"), variants).select("item", "label", "position", "v.mean", "v.raw")


def choice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.choice_predictions(_logprobs(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("avg_margin"))


def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((-F.col("l_discount") * 10).alias("policy_chosen"), (-F.col("l_tax") * 10).alias("policy_rejected"), F.lit(-0.5).alias("reference_chosen"), F.lit(-0.4).alias("reference_rejected"))
    return scoring.preference_metrics(rows)


def eval_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recommendations(_scored(spark, sf_dir), ["identity", "domain_recall"])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_scored(spark, sf_dir))


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answers' normal forms, references, choices and the corpus say of each reply."""
    return _scored(spark, sf_dir).select("conv_id", "normalized_match", "normalized_failed", "reference_f1", "corpus_support_rate", "support_failed", "wrong_choice", "entity_rate", F.array_join(scoring.failure_reasons(), ",").alias("reasons"))


def choice_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of each order's first lines as labels, scored by quantity and discount; the right label follows from the order."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), k)
    score = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, float("-inf")).otherwise(-F.col("l_quantity") / 10)
    rows = lines.select(F.col("l_orderkey").alias("item"), name(F.col("l_linenumber")).alias("label"), F.col("l_linenumber").alias("position"), score.alias("score"), name((F.col("l_orderkey") % 4 + 1).cast("int")).alias("correct"))
    margin = F.col("correct_margin")
    return scoring.choice_margins(rows).withColumn("correct_margin", F.when(margin > float("-inf"), margin))


def choice_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuations of the region names as labels, under the byte tokenizer."""
    labels = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("label")).unionByName(spark.createDataFrame([(90, " "), (91, "x")], "r_regionkey int, label string"))
    return scoring.choice_variants(labels, tokenizers.byte_ids("__text"), tokenizers.EOS).select("r_regionkey", "label", "variant", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def generation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_pairs(spark, sf_dir).select("conv_id", F.when(F.col("conv_id") % 2 == 0, (F.col("conv_id") % 90).cast("int")).alias("max_chars"), F.when(F.col("conv_id") % 3 == 0, (F.col("conv_id") % 40).cast("int")).alias("max_words"))
    return rows.select("conv_id", scoring.generation_cap(F.lit(96), F.col("max_chars"), F.col("max_words")).alias("cap"), scoring.generation_cap(F.lit(96), F.col("max_chars"), F.col("max_words"), True).alias("cap_chars"))


def chance_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finished orders against the chance of one of three states, by priority."""
    rate = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rate.alias("rate")).select("o_orderpriority", scoring.chance_adjusted(F.col("rate"), F.lit(1.0 / 3)).alias("adjusted"), scoring.chance_adjusted(F.col("rate"), F.lit(1.0)).alias("against_certainty"))


def answer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of small answers and whether a reply's candidates have them."""
    v = F.col("l_extendedprice")
    reply = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("It is 7.\nAnswer: "), F.format_string("%.2f", v), F.lit(" units"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("so the total comes to "), F.format_string("%.1f%%", v))).otherwise(F.concat(F.lit("maybe\n\nfinal answer = "), F.format_string("%d", F.col("l_orderkey")), F.lit("\nthank you")))
    expected = F.array(F.format_string("%.2f UNITS", v), F.format_string("%.1f%%", v), F.concat(F.lit(" "), F.format_string("%d", F.col("l_orderkey")), F.lit(",")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(scoring.answer_forms(reply), "|").alias("forms"), scoring.answer_match(scoring.answer_forms(reply), expected).alias("matched"))


def choice_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a guess where an order's lines are the labels."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("choice_labels"))
    return scoring.choice_baseline(items)


QUERIES = {f.__name__: f for f in (eval_summary, scored_answers, choice_margins, choice_variants, generation_caps, chance_adjusted, answer_matches, eval_recommendations, choice_baseline, score_replies, token_f1, rouge_l, repetition, refusal_rate, prompt_echo, corpus_support, answer_candidates, eval_breakdown, weak_categories, eval_ci, failure_reasons, failure_clusters, skill_groups, choice_metrics, preference_metrics)}

TOKS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
MATCH = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_HAS = "contains(' ' || array_to_string(rt, ' ') || ' ', ' ' || {0} || ' ')"
_REFUSAL = "regexp_matches(lower({0}), 'i do not know|i don''t know|cannot answer|can''t answer|not in the provided|provided material|provided domain material|outside|not available')"
_NORM = "array_to_string(" + TOKS + ", ' ')"
_ECHO = f"CASE WHEN trim(r, ' \n\t\r') = '' THEN [] ELSE list_filter([CASE WHEN regexp_matches(lower(r), '(^|\\n)\\s*(user|assistant)\\s*:') THEN 'chat_role_label' END, CASE WHEN length({_NORM.format('u')}) >= 12 AND (starts_with({_NORM.format('r')}, {_NORM.format('u')}[:80]) OR starts_with({_NORM.format('r')}, 'user ' || {_NORM.format('u')}[:80])) THEN 'starts_with_user_prompt' END], lambda x: x IS NOT NULL) END"
_GRAMS = "list_transform(range(len({0}) - 2), lambda i: array_to_string({0}[i + 1:i + 3], ' '))"
_REP = "CASE WHEN len({0}) >= 3 THEN (len({0}) - 2 - len(list_distinct(" + _GRAMS + "))) / (len({0}) - 2) ELSE 0.0 END"
_STOP = "('" + "','".join(scoring.STOPWORDS) + "')"
_CONTENT = "list_filter(" + TOKS + ", lambda x: length(x) >= 3 AND x NOT IN " + _STOP + ")"
_NORMAL = "array_to_string(regexp_extract_all(replace(lower(trim({0}, ' \n\t\r')), ',', ''), '[-+]?\\d+(?:\\.\\d+)?%?|[a-z0-9]+'), ' ')"
_FORMS = f"list_filter(list_concat([{_NORMAL.format('r')}], list_transform(string_split(r, chr(10)), lambda x: {_NORMAL.format('x')}), list_transform(regexp_extract_all(r, '[-+]?\\d+(?:[.,]\\d+)*(?:\\.\\d+)?%?')[-1:], lambda x: {_NORMAL.format('x')}), list_transform(regexp_extract_all(r, '[A-Za-z0-9]+')[-1:], lambda x: lower(x))), lambda x: x <> '')"
_F1 = "CASE WHEN ref IS NULL OR ref = '' THEN NULL WHEN shared > 0 THEN 2.0::DOUBLE * shared / (len(tk) + len(rk)) ELSE 0.0 END"
_SCORED = f"""{PAIRS_SQL}, i AS (SELECT conv_id, "user" AS u, assistant AS r, category, CASE WHEN conv_id % 2 = 0 THEN 'heldout' ELSE 'seen' END AS split, CASE WHEN conv_id % 3 = 0 THEN 'domain' ELSE 'smoke' END AS level, {TOKS.format('"user"')} AS t, {MATCH.format('assistant')} AS rt, {TOKS.format('assistant')} AS tk, CASE WHEN conv_id % 6 = 0 THEN "user" END AS ref FROM pairs),
voc AS (SELECT DISTINCT unnest({_CONTENT.format('text')}) AS w FROM benchmark), said_words AS (SELECT conv_id, unnest({_CONTENT.format('r')}) AS w FROM i), sup AS (SELECT conv_id, count(voc.w) / count(*) AS rate FROM said_words LEFT JOIN voc USING (w) GROUP BY conv_id),
s0 AS (SELECT i.*, coalesce(rate, 1.0) AS corpus_support_rate, {TOKS.format('ref')} AS rk, CASE WHEN conv_id % 8 = 1 THEN t[1] WHEN conv_id % 8 = 3 THEN tk[-1] END AS expected, {_FORMS} AS forms FROM i LEFT JOIN sup USING (conv_id)),
s AS (SELECT *, conv_id % 4 <> 0 AS answerable, CASE WHEN conv_id % 2 = 0 AND NOT {_HAS.format('t[1]')} THEN t[1] ELSE '' END AS missing,
 CAST(CASE WHEN conv_id % 5 = 0 AND NOT ({_HAS.format('t[1]')} OR {_HAS.format('t[2]')}) THEN 1 ELSE 0 END AS BIGINT) AS missing_any,
 CAST(CASE WHEN conv_id % 3 = 0 AND {_HAS.format("'the'")} THEN 1 ELSE 0 END AS BIGINT) AS forbidden,
 CAST(CASE WHEN conv_id % 7 = 0 AND NOT {_HAS.format("'of'")} THEN 1 ELSE 0 END AS BIGINT) AS missing_entities,
 concat_ws(',', CASE WHEN len(tk) < 3 THEN 'min_words' END, CASE WHEN len(tk) > 60 THEN 'max_words' END, CASE WHEN length(r) > 2000 THEN 'max_chars' END) AS violations,
 CASE WHEN expected IS NOT NULL AND expected <> '' THEN list_contains(forms, expected) END AS normalized_match,
 conv_id % 9 = 0 AND corpus_support_rate < 0.25 AS support_failed,
 CASE WHEN conv_id % 11 = 0 THEN 'A' END AS correct_choice, conv_id % 11 = 0 AND conv_id % 22 <> 0 AS wrong_choice,
 list_sum(list_transform(list_distinct(rk), lambda w: least(len(list_filter(tk, lambda x: x = w)), len(list_filter(rk, lambda x: x = w))))) AS shared,
 CAST(len({_ECHO}) AS BIGINT) AS echo, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS tot, {_REP.format('tk')} AS rep, {_REFUSAL.format('r')} AS refusal FROM s0 WHERE len(t) >= 2),
f0 AS (SELECT *, tot - CASE WHEN missing <> '' THEN 1 ELSE 0 END - missing_any AS got, conv_id % 16 = 1 AND NOT coalesce(normalized_match, false) AS normalized_failed, {_F1} AS f1, CASE WHEN conv_id % 7 = 0 THEN 1.0 - missing_entities ELSE 1.0 END AS entity_rate FROM s),
f AS (SELECT *, missing = '' AND missing_any = 0 AND forbidden = 0 AND missing_entities = 0 AND violations = '' AND echo = 0 AND NOT support_failed AND NOT normalized_failed AS passed FROM f0),
g AS (SELECT *, list_filter([CASE WHEN missing <> '' THEN 'missing_required' END, CASE WHEN missing_any > 0 THEN 'missing_any_group' END, CASE WHEN missing_entities > 0 THEN 'missing_entity' END, CASE WHEN violations <> '' THEN 'length_violation' END, CASE WHEN forbidden > 0 THEN 'forbidden_phrase' END, CASE WHEN echo > 0 THEN 'prompt_echo' END, CASE WHEN support_failed THEN 'weak_corpus_support' END, CASE WHEN normalized_failed THEN 'normalized_answer_mismatch' END, CASE WHEN wrong_choice THEN 'wrong_choice' END, CASE WHEN f1 < 0.25 THEN 'low_reference_overlap' END, CASE WHEN rep > 0.25 THEN 'repetitive_reply' END, CASE WHEN trim(r, ' \n\t\r') = '' THEN 'empty_reply' END], lambda x: x IS NOT NULL) AS reasons FROM f)"""
_SKILL = "CASE WHEN category = 'identity' THEN 'identity' WHEN category LIKE '%refusal%' THEN 'refusal' WHEN regexp_matches(category, '^(bench_choice|mmlu_|arc_)') THEN 'choice' WHEN regexp_matches(category, '^(bench_math_|gsm8k)') THEN 'math' WHEN category LIKE 'bench_spelling_%' THEN 'spelling' WHEN category LIKE 'domain_%' THEN 'domain' ELSE 'other' END"
_RATES = {"unsupported_claims": ("unsupported_rate", "forbidden > 0"), "prompt_echoes": ("echo_rate", "echo > 0"), "missing_support": ("missing_support_rate", "missing <> '' OR missing_any > 0"), "missing_entities": ("missing_entity_rate", "missing_entities > 0"), "length_violations": ("length_violation_rate", "violations <> ''"), "corpus_support_failures": ("corpus_support_failure_rate", "support_failed"), "normalized_answer_failures": ("normalized_answer_failure_rate", "normalized_failed")}
_METRICS = "count(*) AS num_examples, count(*) FILTER (passed) AS num_passed, count(*) FILTER (NOT passed) AS num_failed, avg(CAST(passed AS INTEGER)) AS pass_rate, count(*) FILTER (answerable) AS num_answerable, count(*) FILTER (NOT answerable) AS num_unanswerable, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, avg(CAST({c} AS INTEGER)) AS {r}" for n, (r, c) in _RATES.items()) + ", count(normalized_match) AS normalized_answer_examples, count(*) FILTER (normalized_match) AS normalized_answer_correct, CASE WHEN count(normalized_match) > 0 THEN count(*) FILTER (normalized_match) / count(normalized_match) ELSE 1.0 END AS normalized_answer_accuracy, CAST(sum(tot) AS BIGINT) AS support_requirements, CAST(sum(got) AS BIGINT) AS support_matches, CASE WHEN sum(tot) > 0 THEN sum(got) / sum(tot) ELSE 1.0 END AS support_rate, avg(f1) AS avg_reference_f1, avg(CAST(entity_rate AS DOUBLE)) AS avg_entity_rate, avg(corpus_support_rate) AS avg_corpus_support, avg(rep) AS avg_repetition"
_UNSAFE = "(contains(category, 'refusal') OR NOT answerable)"
_SHARE = "avg(CAST({1} AS INTEGER)) FILTER ({0})"
_SUMMARY = f"count(*) FILTER (correct_choice IS NULL) AS non_choice_examples, {_SHARE.format('correct_choice IS NULL', 'passed')} AS non_choice_pass_rate, {_SHARE.format('answerable', 'passed')} AS answerable_pass_rate, {_SHARE.format('NOT answerable', 'passed')} AS unanswerable_pass_rate, {_SHARE.format(chr(39).join(['starts_with(category, ', 'domain_', ')']), 'passed')} AS domain_pass_rate, {_SHARE.format(_UNSAFE, 'passed')} AS refusal_pass_rate, count(*) FILTER ({_UNSAFE}) AS unsafe_refusal_examples, {_SHARE.format(_UNSAFE, 'refusal')} AS unsafe_refusal_rate, {_SHARE.format(_UNSAFE, '(refusal AND passed)')} AS unsafe_refusal_pass_rate, count(*) FILTER (NOT {_UNSAFE}) AS benign_examples, {_SHARE.format('NOT ' + _UNSAFE, '(NOT refusal)')} AS benign_non_refusal_rate, {_SHARE.format('NOT ' + _UNSAFE, 'refusal')} AS over_refusal_rate, CASE WHEN sum(tot) FILTER (answerable) > 0 THEN sum(got) FILTER (answerable) / sum(tot) FILTER (answerable) ELSE 1.0 END AS answerable_support_rate, count(correct_choice) AS choice_examples, count(*) FILTER (correct_choice IS NOT NULL AND NOT wrong_choice) AS choice_correct, {_SHARE.format('correct_choice IS NOT NULL', '(NOT wrong_choice)')} AS choice_accuracy, {_SHARE.format('correct_choice IS NOT NULL', 'passed')} AS choice_pass_rate"
_WEAK = "num_passed < num_examples AND (pass_rate < 0.80 OR support_rate < 0.90 OR unsupported_rate > 0 OR echo_rate > 0 OR corpus_support_failure_rate > 0)"
_TAGS = [f"({i}, '{area}', '{action}', '{priority}', [{', '.join(repr(t) for t in names)}])" for i, (names, area, action, priority) in enumerate(scoring.TAG_ACTIONS, 2)]
_VARIANT = "list_transform(regexp_extract_all(hex(encode({0})), '[0-9A-F]{{2}}'), lambda b: CAST('0x' || b AS INTEGER) + 4)"
ORACLES = {
    "score_replies": f"WITH {_SCORED} SELECT conv_id, missing, missing_any, forbidden, missing_entities, violations, echo, CASE WHEN tot > 0 THEN got / tot ELSE 1.0 END AS support_rate, passed FROM f",
    "token_f1": f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, "user" AS u, {TOKS.format('assistant')} AS a, {TOKS.format('"user"')} AS b FROM pairs), x AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(a) AS w FROM t) GROUP BY 1, 2), y AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(b) AS w FROM t) GROUP BY 1, 2), s AS (SELECT conv_id, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (conv_id, w) GROUP BY conv_id) SELECT conv_id, CASE WHEN u = '' THEN NULL WHEN coalesce(s, 0) > 0 THEN 2.0::DOUBLE * s / (len(a) + len(b)) ELSE 0.0 END AS f1 FROM t LEFT JOIN s USING (conv_id)""",
    "rouge_l": f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, "user" AS u, {TOKS.format('assistant')} AS a, {TOKS.format('"user"')} AS b FROM pairs), l AS (SELECT conv_id, u, a, b, list_reduce(list_prepend(struct_pack(r := list_transform(range(len(b) + 1), lambda x: CAST(0 AS BIGINT)), w := ''), list_transform(a, lambda x: struct_pack(r := CAST([] AS BIGINT[]), w := x))), lambda s, e: struct_pack(r := list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(b) + 1), lambda j: [s.r[j], s.r[j + 1], CAST(b[j] = e.w AS BIGINT)])), lambda k, x: list_append(k, greatest(k[len(k)], x[2], x[1] + x[3]))), w := e.w)).r[len(b) + 1] AS n FROM t) SELECT conv_id, CASE WHEN u = '' THEN NULL WHEN len(a) > 0 AND len(b) > 0 THEN n / len(b) ELSE 0.0 END AS rouge_l FROM l""",
    "repetition": f"WITH t AS (SELECT doc_id, {TOKS.format('text')} AS t FROM documents) SELECT doc_id, {_REP.format('t')} AS ngram_rate, CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 1.0 END AS unique_rate FROM t",
    "refusal_rate": f"SELECT role, avg(CAST({_REFUSAL.format('text')} AS INTEGER)) AS rate, count(*) AS n FROM conversations GROUP BY role",
    "prompt_echo": f"""WITH {PAIRS_SQL}, e AS (SELECT conv_id, "user" AS u, CASE WHEN conv_id % 10 = 1 THEN "user" || ' ' || assistant WHEN conv_id % 10 = 2 THEN assistant || chr(10) || 'User: x' ELSE assistant END AS r FROM pairs) SELECT conv_id, array_to_string({_ECHO}, ',') AS reasons FROM e""",
    "corpus_support": f"WITH {PAIRS_SQL}, v AS (SELECT DISTINCT unnest({_CONTENT.format('text')}) AS w FROM documents), t AS (SELECT conv_id, {_CONTENT.format('assistant')} AS c FROM pairs), k AS (SELECT conv_id, count(v.w) AS s FROM (SELECT conv_id, unnest(c) AS w FROM t) LEFT JOIN v USING (w) GROUP BY conv_id) SELECT conv_id, coalesce(s, 0) AS supported, len(c) AS total, CASE WHEN len(c) > 0 THEN s / len(c) ELSE 1.0 END AS rate FROM t LEFT JOIN k USING (conv_id)",
    "eval_breakdown": f"WITH {_SCORED}, k AS (SELECT *, {_SKILL} AS skill FROM f) " + " UNION ALL ".join(f"SELECT '{k}' AS field, CAST({k} AS VARCHAR) AS value, {_METRICS} FROM k GROUP BY 2" for k in ("category", "skill", "answerable")),
    "weak_categories": f"WITH {_SCORED}, b AS (SELECT category AS value, {_METRICS} FROM f GROUP BY category) SELECT value, num_examples, num_passed, pass_rate, support_rate FROM b WHERE {_WEAK}",
    "failure_reasons": f"WITH {_SCORED} SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['unknown'] ELSE reasons END) AS reason, count(*) AS n FROM g WHERE NOT passed GROUP BY 1",
    "failure_clusters": f"WITH {_SCORED}, c AS (SELECT list_filter([CASE WHEN list_has_any(reasons, ['missing_required', 'missing_any_group', 'missing_entity', 'low_reference_overlap', 'normalized_answer_mismatch']) THEN 'content_mismatch' END, CASE WHEN list_contains(reasons, 'wrong_choice') THEN 'choice_mismatch' END, CASE WHEN list_has_any(reasons, ['forbidden_phrase', 'weak_corpus_support']) THEN 'unsupported_or_forbidden' END, CASE WHEN list_contains(reasons, 'prompt_echo') THEN 'prompt_format_failure' END, CASE WHEN list_has_any(reasons, ['length_violation', 'empty_reply']) THEN 'length_control' END, CASE WHEN list_contains(reasons, 'repetitive_reply') THEN 'degenerate_generation' END, CASE WHEN NOT answerable AND NOT refusal THEN 'refusal_failure' END], lambda x: x IS NOT NULL) AS c FROM g WHERE NOT passed) SELECT unnest(CASE WHEN len(c) = 0 THEN ['unknown'] ELSE c END) AS cluster, count(*) AS n FROM c GROUP BY 1",
    "skill_groups": f"WITH {PAIRS_SQL} SELECT {_SKILL} AS skill, '' AS robustness, count(*) AS n FROM pairs GROUP BY 1, 2",
    "choice_metrics": "WITH v AS (SELECT l_orderkey AS item, l_linenumber AS p, -l_quantity / 10 AS mean, -l_quantity AS raw FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT l_orderkey, l_linenumber, -l_discount * 10, -l_tax FROM lineitem WHERE l_linenumber <= 4), m AS (SELECT *, row_number() OVER (PARTITION BY item, p ORDER BY mean DESC, raw DESC) AS k FROM v), l AS (SELECT item, p, mean, raw FROM m WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY mean DESC, raw DESC, p) AS rk, lead(mean) OVER (PARTITION BY item ORDER BY mean DESC, raw DESC, p) AS s FROM l) SELECT ['A','B','C','D'][p] AS label, count(*) AS n, avg(mean - s) AS avg_margin FROM r WHERE rk = 1 GROUP BY 1",
    "preference_metrics": "WITH m AS (SELECT 0.1::DOUBLE * ((-l_discount * 10 + l_tax * 10) - (-0.5::DOUBLE + 0.4::DOUBLE)) AS m FROM lineitem) SELECT count(*) AS n, avg(ln(1 + exp(-m))) AS loss, avg(CAST(m > 0 AS INTEGER)) AS accuracy, avg(m) AS margin FROM m",
    "answer_candidates": f"WITH b AS (SELECT item_id, text AS r FROM benchmark) SELECT item_id, len(list_distinct({_FORMS})) AS candidates FROM b",
    "eval_recommendations": f"""WITH {_SCORED}, q AS (SELECT DISTINCT unnest(reasons) AS tag FROM g WHERE NOT passed), a(place, area, action, priority, tags) AS (VALUES {', '.join(_TAGS)}), k AS ({' UNION ALL '.join(f"SELECT '{x}' AS field, CAST({x} AS VARCHAR) AS value, {_METRICS} FROM f GROUP BY 2" for x in ('category', 'split', 'level'))}), w AS (SELECT * FROM k WHERE {_WEAK}), r AS (SELECT place, area, action, priority FROM a WHERE EXISTS (SELECT 1 FROM q WHERE list_contains(tags, tag)) UNION ALL SELECT 20, 'refusal', 'add_refusals', 'high' FROM f WHERE NOT passed AND NOT answerable AND NOT refusal UNION ALL SELECT CASE value WHEN 'identity' THEN 31 ELSE 32 END, value, 'strengthen_category', 'medium' FROM w WHERE field = 'category' AND value IN ('identity', 'domain_recall') UNION ALL SELECT 50, 'split', 'target_weakest_split', 'medium' FROM w WHERE field = 'split' UNION ALL SELECT 51, 'eval_ladder', 'improve_lowest_level', 'medium' FROM w WHERE field = 'level') SELECT CAST(min(place) AS INTEGER) AS place, area, action, arg_min(priority, place) AS priority FROM r GROUP BY area, action""",
    "eval_summary": f"WITH {_SCORED} SELECT {_METRICS}, {_SUMMARY} FROM f",
    "scored_answers": f"WITH {_SCORED} SELECT conv_id, normalized_match, normalized_failed, f1 AS reference_f1, corpus_support_rate, support_failed, wrong_choice, CAST(entity_rate AS DOUBLE) AS entity_rate, array_to_string(CASE WHEN NOT passed AND len(reasons) = 0 THEN ['unknown'] ELSE reasons END, ',') AS reasons FROM g",
    "choice_margins": "WITH l AS (SELECT l_orderkey AS item, ['A','B','C','D'][l_linenumber] AS label, l_linenumber AS p, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE -l_quantity / 10 END AS s, ['A','B','C','D'][l_orderkey % 4 + 1] AS c FROM lineitem WHERE l_linenumber <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC NULLS LAST, p) AS k FROM l), a AS (SELECT item, max(label) FILTER (k = 1 AND s IS NOT NULL) AS b, max(label) FILTER (k = 2 AND s IS NOT NULL) AS b2, max(s) FILTER (k = 1) - max(s) FILTER (k = 2) AS pm, count(*) FILTER (label = c) AS has, max(s) FILTER (label = c) AS own, max(s) FILTER (label <> c) AS other, any_value(c) AS c FROM r GROUP BY item) SELECT item, CASE WHEN has > 0 THEN b END AS best_label, CASE WHEN has > 0 THEN b2 END AS second_label, CASE WHEN has > 0 AND b IS NOT NULL THEN pm END AS predicted_margin, CASE WHEN has > 0 AND b IS NOT NULL THEN own - other END AS correct_margin, has > 0 AND b IS NOT NULL AND CASE WHEN other IS NOT NULL THEN coalesce(own, CAST('-inf' AS DOUBLE)) - other > 0 ELSE b = c END AS margin_pass FROM a",
    "choice_variants": f"WITH l AS (SELECT r_regionkey, r_name AS label FROM region UNION ALL SELECT 91, 'x'), v AS (SELECT r_regionkey, label, unnest([{{'v': 'space+eos', 'i': list_append({_VARIANT.format("' ' || label")}, 2)}}, {{'v': 'space', 'i': {_VARIANT.format("' ' || label")}}}, {{'v': 'bare+eos', 'i': list_append({_VARIANT.format('label')}, 2)}}, {{'v': 'bare', 'i': {_VARIANT.format('label')}}}]) AS s FROM l) SELECT r_regionkey, label, s.v AS variant, array_to_string(s.i, ',') AS ids FROM v",
    "generation_caps": f"WITH {PAIRS_SQL}, b AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN greatest(1, conv_id % 90 + 8) END AS c, CASE WHEN conv_id % 3 = 0 THEN greatest(1, conv_id % 40 * 6 + 8) END AS w FROM pairs) SELECT conv_id, CAST(CASE WHEN c IS NULL AND w IS NULL THEN 96 ELSE least(96, greatest(8, least(coalesce(c, w), coalesce(w, c)))) END AS INTEGER) AS cap, CAST(CASE WHEN c IS NULL THEN 96 ELSE least(96, greatest(8, c)) END AS INTEGER) AS cap_chars FROM b",
    "chance_adjusted": "WITH r AS (SELECT o_orderpriority, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS rate FROM orders GROUP BY 1) SELECT o_orderpriority, (rate - (1.0::DOUBLE / 3)) / (1 - (1.0::DOUBLE / 3)) AS adjusted, CAST(NULL AS DOUBLE) AS against_certainty FROM r",
    "choice_baseline": "WITH l AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1) SELECT avg(1.0::DOUBLE / k) AS baseline, count(*) AS items FROM l",
}
