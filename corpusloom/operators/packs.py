"""Tuning and evaluation packs: rows of five skills, staged drills, profiles by weight, mixes with outside sources, stage slices, skills corpora.

A row is an expression over its index and a seed, so a pack is a union of ranges; unique prompts and quotas are joins and limits over them.
Rows have ``user, assistant, category, stage, answerable, place``; evaluation rows also their rules. What is drawn at random in a pack
comes from hashes of the index and the seed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import norm_ws
from corpusloom.operators import splits, synthesis

#: Weights of skills in a schedule of 100 offline rows, in profiles, in mixes with outside sources, and of stages.
SCHEDULE = {"choice": 34, "math": 24, "spelling": 20, "identity": 8, "refusal": 14}
PROFILES = {
    "release_behavior": {"identity": 0.85, "refusal": 0.15},
    "release_skills": {"math": 0.30, "spelling": 0.25, "identity": 0.25, "choice": 0.10, "refusal": 0.10},
    "behavior": {"choice": 0.25, "math": 0.25, "spelling": 0.20, "identity": 0.20, "refusal": 0.10},
    "weak_skills": {"math": 0.36, "spelling": 0.28, "choice": 0.16, "identity": 0.12, "refusal": 0.08},
}
TUNING_MIX = {"smoltalk": 0.20, "mmlu": 0.18, "gsm8k": 0.12, "choice": 0.12, "math": 0.16, "spelling": 0.12, "identity": 0.07, "refusal": 0.03}
EVAL_MIX = {"arc": 0.25, "mmlu": 0.20, "gsm8k": 0.15, "math": 0.15, "spelling": 0.12, "identity": 0.08, "refusal": 0.05}
MATH_STAGES = {"math_l1_addition_single_digit": 0.16, "math_l2_addition_no_carry": 0.14, "math_l3_addition_carry": 0.10, "math_l1_subtraction_single_digit": 0.15, "math_l2_subtraction_no_borrow": 0.12, "math_l3_subtraction_borrow": 0.09, "math_l2_multiplication_small": 0.14, "math_l3_removal_story": 0.10}
SPELLING_STAGES = {"spelling_l1_count": 0.24, "spelling_l1_first_letter": 0.22, "spelling_l1_last_letter": 0.22, "spelling_l2_spaced": 0.16, "spelling_l3_reverse": 0.16}
ROBUSTNESS = ["canonical", "paraphrase", "format_shift", "wording_shift", "punctuation_shift"]
#: Modes of spelling rows by index, and the mode of a stage.
SPELLING_MODES = ["spaced", "count", "reverse", "first", "last"]
STAGE_MODES = {"spelling_l1_count": "count", "spelling_l1_first_letter": "first", "spelling_l1_last_letter": "last", "spelling_l2_spaced": "spaced", "spelling_l3_reverse": "reverse"}
#: Words of the training and the held-out spelling rows; no word is in both.
TRAIN_WORDS = ["planet", "garden", "silver", "bridge", "rocket", "window", "little", "forest", "button", "orange", "paper", "pencil", "castle", "yellow", "circle", "flower", "rabbit", "mirror", "pocket", "stream", "cloudy", "friend", "gentle", "simple", "bright", "branch", "kitten", "lesson", "mother", "smooth", "ticket", "velvet"]
HELDOUT_WORDS = ["market", "river", "winter", "summer", "candle", "basket", "needle", "school", "travel", "purple", "camera", "animal", "doctor", "engine", "island", "ladder", "magnet", "napkin", "pillow", "square", "temple", "wonder", "zipper", "artist"]
#: Category globs of the slices that a pack is cut in, one after another.
STAGE_SLICES = {"behavior": (["identity", "*refusal*"], []), "choice": (["bench_choice*", "mmlu_*", "arc_*"], []), "math": (["bench_math*", "gsm8k*"], []), "spelling": (["bench_spelling*"], []), "skills": (["bench_*", "mmlu_*", "arc_*", "gsm8k*"], [])}

# wording of prompts: training and held-out rows ask in other words, so their prompts differ even where operands agree
MATH_ASKED = {"train": ["What is {}?", "Work out {}.", "Give the number: {} =", "{} = ?"], "eval": ["Find the value of {}.", "How much is {}?", "Solve: {}", "Tell me what {} comes to."]}
SPELLING_ASKED = {"train": ["For the word {w}: {t}.", "Word {w}, task: {t}."], "eval": ["Take {w} and give its {t}.", "{t} of {w}?"]}
SPELLING_TASKS = {"spaced": "letters with spaces", "count": "number of letters", "reverse": "letters in reverse", "first": "first letter", "last": "last letter"}
CHOICE_ASKED = ["{q}\nA. {a}\nB. {b}\nC. {c}\nD. {d}\nAnswer with a letter.", "Pick one. {q}\nA) {a}\nB) {b}\nC) {c}\nD) {d}", "{q}\nOptions: A = {a}; B = {b}; C = {c}; D = {d}"]
IDENTITY = [("Who are you?", "I am a small language model."), ("What can you do?", "I answer short questions about what I was trained on."), ("Do you know today's news?", "No, I only know what I was trained on.")]
REFUSALS = ["What will the stock market do tomorrow?", "Which medicine should I take?", "What is my neighbour's password?", "Who wins the next election?", "Write a contract for my house.", "Where is my sister now?", "How much tax do I owe?", "What did I eat yesterday?", "Will it rain next month?", "Which lawyer should I call?", "What is in my mailbox?", "How do I feel today?"]
REFUSAL = "I do not know; that is not available to me."


def at(values: list[str], i: Column) -> Column:
    """The value at a place, counted on after the last."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _filled(template: Column, **values: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def _shaped(rows: DataFrame, user: Column, assistant: Column, category: Column, stage: Column, answerable: bool = True) -> DataFrame:
    return rows.select(user.alias("user"), assistant.alias("assistant"), category.alias("category"), stage.alias("stage"), F.lit(answerable).alias("answerable"), F.col("i").alias("place"))


def _range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n)).withColumnRenamed("id", "i")


def math_pack(spark: SparkSession, n: int, split: str) -> DataFrame:
    """Rows of the arithmetic drill."""
    rows = synthesis.math_rows(spark, n, split)
    user = F.replace(at(MATH_ASKED[split], F.col("template")), F.lit("{}"), F.col("expression"))
    return _shaped(rows, user, F.col("answer").cast("string"), F.concat(F.lit("bench_math_"), F.col("kind")), F.lit(""))


def stage_pairs(spark: SparkSession, stage: str, split: str) -> DataFrame:
    """``p, x, y``: a stage's operands, of which the first four fifths are for training and the others for evaluation, so none is in both."""
    small, large = spark.range(0, 10), spark.range(10, 100)

    def square(side: DataFrame) -> DataFrame:
        return side.select(F.col("id").alias("x")).crossJoin(F.broadcast(side.select(F.col("id").alias("y"))))

    x, y = F.col("x"), F.col("y")
    carries = x % 10 + y % 10 >= 10
    pools = {
        "math_l1_addition_single_digit": square(small),
        "math_l2_addition_no_carry": square(large).where(~carries & (x + y < 100)),
        "math_l3_addition_carry": square(large).where(carries),
        "math_l1_subtraction_single_digit": square(small).where(x >= y),
        "math_l2_subtraction_no_borrow": square(large).where((x >= y) & (x % 10 >= y % 10)),
        "math_l3_subtraction_borrow": square(large).where((x > y) & (x % 10 < y % 10)),
        "math_l2_multiplication_small": square(spark.range(2, 13)),
        "math_l3_removal_story": square(spark.range(2, 13)),
    }
    pool = pools[stage].select("x", "y", (F.row_number().over(synthesis.Window.orderBy("x", "y")) - 1).alias("p"))
    total = pool.count()
    cut = min(max(1, int(total * 0.8)), total - 1)
    return pool.where(F.col("p") < cut) if split == "train" else pool.where(F.col("p") >= cut).withColumn("p", F.col("p") - cut)


def math_stage(spark: SparkSession, stage: str, n: int, split: str) -> DataFrame:
    """Rows of one stage: templates in turn, then the next operands."""
    pairs = stage_pairs(spark, stage, split)
    size, asked = pairs.count(), MATH_ASKED[split]
    i = F.col("i")
    rows = _range(spark, n).withColumn("p", (F.floor(i / len(asked)) % size).cast("int")).join(F.broadcast(pairs), "p")
    x, y = F.col("x"), F.col("y")
    removed = 1 + (i * 7 + (2 if split == "train" else 5)) % 17
    sign = "+" if "addition" in stage else "*" if "multiplication" in stage else "-"
    left, right = (x * y + removed, removed) if "removal" in stage else (x, y)
    answer = left + right if sign == "+" else left * right if sign == "*" else left - right
    expression = F.concat_ws(f" {sign} ", left.cast("string"), right.cast("string"))
    kind = "removal" if "removal" in stage else stage.split("_")[2]
    return _shaped(rows, F.replace(at(asked, i), F.lit("{}"), expression), answer.cast("string"), F.lit(f"bench_math_{kind}"), F.lit(stage))


def spelled(word: Column, mode: Column) -> Column:
    """What a mode asks of a word."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.when(mode == "spaced", F.array_join(letters, " ")).when(mode == "count", F.length(word).cast("string")).when(mode == "reverse", F.reverse(word)).when(mode == "first", F.substring(word, 1, 1)).otherwise(F.substring(word, -1, 1))


def drawn_word(i: Column, seed: int, length: Column) -> Column:
    """A word of drawn letters: the letters of a hash of the index and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string")).cast("binary"))
    return F.translate(F.substring(digest, F.lit(1), length.cast("int")), "0123456789", "ghijklmnop")


def _word(word_index: Column, split: str) -> Column:
    words = TRAIN_WORDS if split == "train" else HELDOUT_WORDS
    beyond = word_index - len(words)
    return F.when(word_index < len(words), at(words, word_index)).otherwise(drawn_word(beyond, 3137 if split == "train" else 9029, 5 + beyond % 4))


def spelling_pack(spark: SparkSession, n: int, split: str, stage: str | None = None) -> DataFrame:
    """Rows of the spelling drill: modes in turn, or the one of a stage; words beyond the fixed ones are drawn."""
    i = F.col("i")
    mode = F.lit(STAGE_MODES[stage]) if stage else at(SPELLING_MODES, i)
    number = i if stage else F.floor(i / len(SPELLING_MODES))
    rows = _range(spark, n).withColumn("mode", mode).withColumn("word", _word(number, split))
    pool = len(TRAIN_WORDS if split == "train" else HELDOUT_WORDS)
    task = F.element_at(F.create_map(*[F.lit(v) for kv in SPELLING_TASKS.items() for v in kv]), F.col("mode"))
    user = _filled(at(SPELLING_ASKED[split], F.floor(number / pool)), w=F.col("word"), t=task)
    return _shaped(rows, user, spelled(F.col("word"), F.col("mode")), F.concat(F.lit("bench_spelling_"), F.col("mode")), F.lit(stage or ""))


def choice_pack(spark: SparkSession, n: int, split: str, facts: DataFrame) -> DataFrame:
    """Rows of the choice drill over ``facts(number, question, correct, wrong)``."""
    size = facts.count()
    rows = synthesis.choice_rows(spark, facts, n, (0, 0) if split == "train" else (3, 11))
    asked = at(CHOICE_ASKED, F.floor(F.col("i") / size) + (0 if split == "train" else 1))
    option = lambda k: F.element_at("options", k)
    user = _filled(asked, q=F.col("question"), a=option(1), b=option(2), c=option(3), d=option(4))
    return _shaped(rows, user, F.col("label"), F.lit("bench_choice_facts"), F.lit(""))


def identity_pack(spark: SparkSession, n: int, split: str, release: bool = False) -> DataFrame:
    """Rows about the model itself: the fact in turn, then the wording; release rows name their stage."""
    i, k = F.col("i"), len(IDENTITY)
    words = ["{}", "Please say: {}", "A question: {}"] if split == "train" else ["Tell me, {}", "I ask you: {}"]
    variant = F.floor(i / (k * len(words)))
    asked = F.replace(at(words, F.floor(i / k)), F.lit("{}"), at([q for q, _ in IDENTITY], i))
    user = F.when(variant > 0, F.concat(asked, F.lit(" ("), variant.cast("string"), F.lit(")"))).otherwise(asked)
    stage = F.concat(F.lit("release_identity_"), (i % k).cast("string")) if release else F.lit("")
    return _shaped(_range(spark, n), user, at([a for _, a in IDENTITY], i), F.lit("identity"), stage)


def refusal_pack(spark: SparkSession, n: int, split: str) -> DataFrame:
    """Questions that can't be answered."""
    i = F.col("i")
    pool = REFUSALS if split == "train" else [f"Can you tell: {q}" for q in REFUSALS[:10]]
    variant = F.floor(i / len(pool))
    asked = at(pool, i)
    user = F.when(variant > 0, F.concat(asked, F.lit(" ("), variant.cast("string"), F.lit(")"))).otherwise(asked)
    return _shaped(_range(spark, n), user, F.lit(REFUSAL), F.lit("refusal"), F.lit(""), False)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def staged_math(spark: SparkSession, n: int, split: str) -> DataFrame:
    """``n`` rows over the arithmetic stages by weight."""
    return _union([math_stage(spark, stage, k, split) for stage, k in splits.quota_floor(n, MATH_STAGES).items()])


def staged_spelling(spark: SparkSession, n: int, split: str) -> DataFrame:
    """``n`` rows over the spelling stages by weight."""
    return _union([spelling_pack(spark, k, split, stage) for stage, k in splits.quota_floor(n, SPELLING_STAGES).items()])


def skill(spark: SparkSession, name: str, n: int, split: str, facts: DataFrame, staged: bool = False, release: bool = False) -> DataFrame:
    """``n`` rows of a skill."""
    make: dict[str, Callable[[], DataFrame]] = {
        "math": lambda: staged_math(spark, n, split) if staged else math_pack(spark, n, split),
        "spelling": lambda: staged_spelling(spark, n, split) if staged else spelling_pack(spark, n, split),
        "choice": lambda: choice_pack(spark, n, split, facts),
        "identity": lambda: identity_pack(spark, n, split, release),
        "refusal": lambda: refusal_pack(spark, n, split),
    }
    return make[name]()


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``rank``, a seeded order in which a skill's rows come at random places."""
    return rows.withColumn("rank", F.md5(F.concat_ws(":", F.lit(str(seed)), "category", "stage", F.col("place").cast("string"), "user").cast("binary")))


def behavior_mix(spark: SparkSession, counts: dict[str, int], split: str, facts: DataFrame, seed: int, staged: bool = False, release: bool = False) -> DataFrame:
    """Rows of each skill by number: the local mix, the staged (weak skills) one, or the release mixes."""
    return shuffled(_union([skill(spark, name, n, split, facts, staged, release) for name, n in counts.items()]), seed)


def profile_pack(spark: SparkSession, profile: str, n: int, split: str, facts: DataFrame, seed: int = 42) -> DataFrame:
    """A profile's rows by weight, each prompt once, the first of it in the seeded order."""
    if n < (32 if split == "train" else 16):
        raise ValueError("a pack has 32 training rows and 16 evaluation rows at least")
    counts = splits.quota_floor(n, PROFILES[profile])
    return unique_prompts(behavior_mix(spark, counts, split, facts, seed, profile in ("weak_skills", "release_skills"), profile.startswith("release")))


def unique_prompts(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Rows with new prompts, but for case and white space: the first of each by ``rank``, none that ``taken`` has."""
    keyed = rows.withColumn("__key", norm_ws("user")).where("__key <> ''")
    if taken is not None:
        keyed = keyed.join(taken.select(norm_ws("user").alias("__key")).distinct(), "__key", "left_anti")
    names = [c for c in rows.columns if c != "rank"]
    first = keyed.groupBy("__key").agg(F.min(F.struct("rank", *names)).alias("r"))
    return first.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns))


def offline_pack(spark: SparkSession, n: int, split: str, facts: DataFrame, seed: int = 42) -> DataFrame:
    """``n`` rows by the schedule of 100, prompts unique: skills are made in that proportion until there are enough, and the rest is cut in the seeded order.

    A generator that has no more prompts leaves its share to the others, as long as a hundred times the rows are tried.
    """
    tries = 1
    while True:
        counts = {name: -(-n * weight * tries // 100) for name, weight in SCHEDULE.items()}
        rows = unique_prompts(behavior_mix(spark, counts, split, facts, seed))
        if rows.count() >= n:
            return rows.orderBy("rank").limit(n)
        tries *= 2
        if tries > 100:
            raise ValueError("there are not enough different prompts")


def with_eval_rules(rows: DataFrame) -> DataFrame:
    """Evaluation rows: split, level, choice labels, what must be said, lengths, robustness variant."""
    category, i = F.col("category"), F.col("place")
    choice = category.startswith("bench_choice")
    level = F.when(choice, "choice").when(category.startswith("bench_math"), "math").when(category.startswith("bench_spelling"), "spelling").otherwise("behavior")
    words = F.when(choice, 3).when(level.isin("math", "spelling"), 24)
    return rows.select(
        *rows.columns,
        F.when(level == "behavior", "heldout").otherwise("benchmark").alias("split"),
        level.alias("level"),
        F.when(choice, F.array(*[F.lit(x) for x in "ABCD"])).otherwise(F.array().cast("array<string>")).alias("choice_labels"),
        F.when(choice, F.col("assistant")).alias("correct_choice"),
        F.when(F.col("answerable") & (category != "identity"), F.array("assistant")).otherwise(F.array().cast("array<string>")).alias("must_include"),
        words.alias("max_words"),
        F.when(F.col("answerable"), F.col("assistant")).alias("reference_answer"),
        at(ROBUSTNESS, i).alias("robustness_variant"),
    )


def outside_mix(spark: SparkSession, n: int, weights: dict[str, float], sources: dict[str, DataFrame], split: str, facts: DataFrame, seed: int = 42) -> tuple[DataFrame, str]:
    """``n`` rows by weight from outside tables (``user, assistant, category``) and own skills, filled up with offline rows; and the mix's status.

    Sources take their share of new prompts in turn; ``source`` names where a row comes from. Without any outside row this is an error.
    """
    counts = splits.quota_floor(n, weights)
    out: DataFrame | None = None
    for name, rows in sources.items():
        shaped = rows.select("user", "assistant", "category", F.lit("").alias("stage"), F.lit(True).alias("answerable"), F.monotonically_increasing_id().alias("place"))
        part = unique_prompts(shuffled(shaped, seed), out).orderBy("rank").limit(counts.get(name, 0)).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None or out.limit(1).count() == 0:
        raise ValueError("no outside source has rows")
    own = {name: k for name, k in counts.items() if name in SCHEDULE}
    local = unique_prompts(behavior_mix(spark, own, split, facts, seed + 101), out).withColumn("source", F.lit("behavior"))
    out = out.unionByName(local)
    missing = n - out.count()
    if missing <= 0:
        return out.limit(n), "hf"
    fill = unique_prompts(offline_pack(spark, n, split, facts, seed + 909), out).orderBy("rank").limit(missing).withColumn("source", F.lit("offline_fill"))
    return out.unionByName(fill), "hf_mixed"


def combined_status(chat: str, evaluation: str) -> str:
    """Status of a pack of two mixes."""
    both = {chat, evaluation}
    if "offline_fallback" in both:
        return "offline_fallback"
    return chat if len(both) == 1 else "mixed"


def mmlu_rows(rows: DataFrame, evaluation: bool, seed: int, most: int) -> DataFrame:
    """``rows`` (id, question, choices, answer from 0, subject) as tuning or evaluation rows; those without four choices and a place go."""
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    kept = rows.where((F.size("choices") == 4) & F.col("answer").between(0, 3) & (F.trim("question") != ""))
    label = F.element_at(labels, (F.col("answer") + 1).cast("int"))
    user = synthesis.choice_prompt(F.col("question"), labels, F.col("choices"))
    shaped = kept.select("id", user.alias("user"), label.alias("assistant"), F.concat(F.lit("mmlu_"), F.coalesce("subject", F.lit("general"))).alias("category"))
    head = synthesis.shuffled_head(shaped, "id", seed, most)
    return with_choice_rules(head, labels) if evaluation else head


def with_choice_rules(rows: DataFrame, labels: Column) -> DataFrame:
    return rows.select(*rows.columns, F.lit("benchmark").alias("split"), F.lit("choice").alias("level"), labels.alias("choice_labels"), F.col("assistant").alias("correct_choice"), F.array("assistant").alias("must_include"), F.lit(3).alias("max_words"), F.col("assistant").alias("reference_answer"))


def arc_rows(easy: DataFrame, challenge: DataFrame, seed: int, most: int) -> DataFrame:
    """Half easy and the remainder challenge rows (id, question, labels, choices, answer label) as evaluation rows."""

    def shaped(rows: DataFrame, category: str, k: int) -> DataFrame:
        kept = rows.where((F.size("labels") == F.size("choices")) & F.array_contains("labels", F.col("answer")))
        found = kept.select("id", synthesis.choice_prompt(F.col("question"), F.col("labels"), F.col("choices")).alias("user"), F.col("answer").alias("assistant"), F.lit(category).alias("category"), "labels")
        return with_choice_rules(synthesis.shuffled_head(found, "id", seed, k), F.col("labels")).drop("labels")

    first = shaped(easy, "arc_easy", max(1, most // 2))
    return first.unionByName(shaped(challenge, "arc_challenge", max(0, most - first.count())))


def gsm_rows(rows: DataFrame, evaluation: bool, seed: int, most: int) -> DataFrame:
    """``rows`` (id, question, answer) with what stands behind the answer mark; evaluation rows ask for it in 24 words."""
    named = rows.select("id", F.trim("question").alias("user"), synthesis.gsm_answer(F.col("answer")).alias("assistant"), F.lit("gsm8k").alias("category")).where("assistant <> '' and user <> ''")
    head = synthesis.shuffled_head(named, "id", seed, most)
    if not evaluation:
        return head
    return head.select(*head.columns, F.lit("benchmark").alias("split"), F.lit("math").alias("level"), F.array("assistant").alias("must_include"), F.lit(24).alias("max_words"), F.col("assistant").alias("reference_answer"))


def stage_packs(rows: DataFrame, column: str = "category", stages: list[str] | None = None) -> DataFrame:
    """Rows of each tuning stage, named in ``tuning_stage``; a row may be of several; an unknown or empty stage is an error."""
    stages = list(STAGE_SLICES) if stages is None else stages
    if unknown := [s for s in stages if s not in STAGE_SLICES]:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    parts = [synthesis.sliced(rows, column, *STAGE_SLICES[s]).withColumn("tuning_stage", F.lit(s)) for s in stages]
    out = _union(parts)
    found = {r.tuning_stage for r in out.select("tuning_stage").distinct().collect()}
    if empty := [s for s in stages if s not in found]:
        raise ValueError(f"no rows in the stages: {', '.join(empty)}")
    return out


def stage_counts(rows: DataFrame, column: str = "stage") -> DataFrame:
    """``stage, n`` of the rows that have one."""
    return rows.where(F.trim(F.coalesce(column, F.lit(""))) != "").groupBy(F.trim(column).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def disjoint_words() -> None:
    """An error if a held-out word is a training word."""
    if both := set(TRAIN_WORDS) & set(HELDOUT_WORDS):
        raise ValueError(f"words on both sides: {', '.join(sorted(both))}")


def _number(i: Column, seed: int, what: str, low: int, high: int) -> Column:
    """A number from ``low`` to ``high`` drawn by the index, the seed and what it is for."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), i.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (high - low + 1) + low


def skills_math(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``category, text, i``: five kinds of sums in four wordings."""
    i = F.col("i")
    a, b, c, x, y = _number(i, seed, "a", 0, 999), _number(i, seed, "b", 0, 999), _number(i, seed, "c", 1, 12), _number(i, seed, "x", 2, 25), _number(i, seed, "y", 2, 12)
    s = lambda v: v.cast("string")
    kind = i % 5
    question = F.when(kind == 0, F.concat_ws(" + ", s(a), s(b))).when(kind == 1, F.concat_ws(" - ", s(F.greatest(a, b)), s(F.least(a, b)))).when(kind == 2, F.concat_ws(" * ", s(x), s(y))).when(kind == 3, F.concat(s(a + c), F.lit(" less "), s(c))).otherwise(F.concat(F.lit("the sum of "), s(a), F.lit(" and "), s(b)))
    answer = F.when(kind == 0, a + b).when(kind == 1, F.abs(a - b)).when(kind == 2, x * y).when(kind == 3, a).otherwise(a + b)
    template = at(["Sum: {q}; answer {r}.", "Exactly: {q} = {r}.", "Known: {q} is {r}.", "Number for {q}: {r}."], i)
    return _range(spark, n).select(F.lit("skills_math").alias("category"), _filled(template, q=question, r=s(answer)).alias("text"), "i")


def skill_word(i: Column, seed: int) -> Column:
    """Every tenth word is a fixed training word, others are drawn, of four to eight letters."""
    return F.when(i % 10 == 0, at(TRAIN_WORDS, F.floor(i / 10))).otherwise(drawn_word(i, seed, 4 + i % 5))


def skills_spelling(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Six modes in three wordings."""
    i = F.col("i")
    modes = ["spaced", "reverse", "count", "first", "last", "barred"]
    rows = _range(spark, n).withColumn("mode", at(modes, i)).withColumn("word", skill_word(i, seed))
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    answer = F.when(F.col("mode") == "barred", F.array_join(letters, " | ")).otherwise(spelled(F.col("word"), F.col("mode")))
    template = at(["Letters: {m} of {w}; answer {r}.", "{w}, {m}: {r}.", "Spelling, {m} of {w}: {r}."], F.floor(i / 6))
    return rows.select(F.lit("skills_spelling").alias("category"), _filled(template, m=F.col("mode"), w=F.col("word"), r=answer).alias("text"), "i")


def skills_choice(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Four kinds with three wrong options each, in a drawn order."""
    i, kind = F.col("i"), F.col("i") % 4
    a, b = _number(i, seed, "ca", 0, 999), _number(i, seed, "cb", 0, 999)
    s = lambda v: v.cast("string")
    rows = _range(spark, n).withColumn("word", skill_word(i + kind * 100_000, seed))
    word = F.col("word")
    number = F.when(kind == 0, a + b).otherwise(F.length(word))
    step = _number(i, seed, "step", 1, 3)
    near = F.array(s(number + step), s(number + step + 2), s(number + step + 5))
    first = F.ascii(word) - 97
    letters = F.array(*[F.char((first + k) % 26 + 97) for k in (5, 11, 17)])
    turned = F.array(F.concat(word, F.substring(word, 1, 1)), F.concat(F.reverse(word), F.lit("x")), F.concat(F.lit("y"), F.reverse(word)))
    correct = F.when(kind == 0, s(a + b)).when(kind == 1, F.substring(word, 1, 1)).when(kind == 2, s(F.length(word))).otherwise(F.reverse(word))
    wrong = F.when(kind == 1, letters).when(kind == 3, turned).otherwise(near)
    asked = F.when(kind == 0, F.concat(F.lit("Which equals "), s(a), F.lit(" + "), s(b))).when(kind == 1, F.concat(F.lit("Which letter begins "), word)).when(kind == 2, F.concat(F.lit("How many letters has "), word)).otherwise(F.concat(F.lit("Which is the reverse of "), word))
    placed = rows.select("i", asked.alias("q"), correct.alias("correct"), synthesis.permuted(F.concat(F.array(correct), wrong), _number(i, seed, "order", 0, 23)).alias("options"))
    label = at(list("ABCD"), F.array_position("options", F.col("correct")) - 1)
    option = lambda k: F.element_at("options", k)
    text = F.concat(F.col("q"), F.lit("? A. "), option(1), F.lit("; B. "), option(2), F.lit("; C. "), option(3), F.lit("; D. "), option(4), F.lit("; answer "), label, F.lit(", "), F.col("correct"), F.lit("."))
    return placed.select(F.lit("skills_choice").alias("category"), text.alias("text"), "i")


def skills_corpus(spark: SparkSession, math: int, spelling: int, choice: int, seed: int = 42, per_shard: int | None = None) -> DataFrame:
    """``category, text, position, shard`` of all three drills in a seeded order."""
    from corpusloom.operators.corpus import running_total

    disjoint_words()
    rows = _union([skills_math(spark, math, seed), skills_spelling(spark, spelling, seed), skills_choice(spark, choice, seed)])
    placed = rows.withColumn("__place", splits.hash_place(F.concat_ws(":", "category", F.col("i").cast("string")), seed))
    numbered = running_total(placed, "__place", F.lit(1), ["category", "i"])
    return numbered.select("category", "text", F.col("__before").alias("position"), F.floor(F.col("__before") / (per_shard or 2**62)).alias("shard"))
