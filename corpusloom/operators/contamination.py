"""Prompt leaks, phrase containment, n-gram overlap, the contamination matrix and memorisation.

Text tables have ``id`` and ``text``. Joins go through shared keys (equal prompts, shared words or n-grams), so no
table meets another as a whole. A phrase is looked for through its own run of words at every place of the text, by equal hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import distinct_ngrams, ngrams, preview, set_jaccard, tokens
from corpusloom.operators.dedup import sequence_ratio

#: Replies that say nothing specific.
GENERIC_REFUSALS = ["i do not know", "i don t know", "not in the provided material", "provided domain material", "cannot answer", "can t answer"]
NEAR = 0.86
LEAST_PROMPT = 24
LEAST_PHRASE = 18
CANARY = "\\bpico-canary-[A-Za-z0-9_-]+\\b"


def records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, norm, toks`` of the texts that have tokens."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(F.array(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("toks"))
    return base.select("id", "text", F.array_join("toks", " ").alias("norm"), "toks").where("norm <> ''")


def specific(norm: Column) -> Column:
    """Whether a normalised phrase says enough to be looked for."""
    generic = F.lit(False)
    for phrase in GENERIC_REFUSALS:
        generic = generic | (norm == phrase)
    return ~generic & (F.length(norm) >= LEAST_PHRASE) & (F.size(F.split(norm, " ")) >= 3)


def exact_leaks(targets: DataFrame, references: DataFrame) -> DataFrame:
    """``target_id, reference_id`` of equal normalised texts; the last reference of a text wins."""
    last = references.groupBy("norm").agg(F.max("id").alias("reference_id"))
    return targets.select(F.col("id").alias("target_id"), "norm").join(last, "norm").select("target_id", "reference_id")


LEAST_OVERLAP = 0.35
MOST_COMPARED = 2_000


def near_candidates(left: DataFrame, right: DataFrame, by: str | None = None, least: float = LEAST_OVERLAP) -> DataFrame:
    """``left_id, right_id`` of texts (id, toks) whose word sets may agree by ``least`` and more; with ``by``, of equal values of that column only.

    To agree by ``least``, two word sets must share one of the rarest words of each, so pairs meet on those: a frequent word makes no pairs.
    """
    own = [by] if by else []
    sides = [df.select("id", *own, F.array_distinct("toks").alias("words")) for df in (left, right)]
    counts = sides[0].select(F.explode("words").alias("w")).unionByName(sides[1].select(F.explode("words").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        placed = df.select(F.col("id").alias(name), *own, F.size("words").alias("n"), F.explode("words").alias("w")).join(counts, "w")
        rank = F.row_number().over(Window.partitionBy(name, *own).orderBy("df", "w"))
        return placed.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(name, *own, "w")

    return keyed(sides[0], "left_id").join(keyed(sides[1], "right_id"), ["w", *own]).select("left_id", "right_id").distinct()


#: Texts, and different words of all its texts, of a block of ``alike_pairs``, about.
BLOCK_TEXTS, BLOCK_WORDS = 2_048, 400_000
#: Classes of sizes that ``least`` spans.
SIZE_CLASSES = 4


def alike_pairs(left: DataFrame, right: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """``left_id, right_id`` of all texts (id, toks) whose word sets agree by ``least`` and more.

    Where texts share most of their frequent words, keys make more rows than there are pairs. So blocks of both sides meet, and words in
    common are counted in arrays. Sets that agree so are of like sizes, so only blocks of near size classes meet.
    """
    place = F.floor(F.log("n") / (math.log(1 / least) / SIZE_CLASSES)).cast("int")
    # a new column for each side, which may be one table
    sides = [df.select(F.col("id").alias("id"), F.transform(F.array_distinct("toks"), lambda w: F.xxhash64(w)).alias("hs")).withColumn("n", F.size("hs")).where("n > 0").withColumn("place", place) for df in (left, right)]
    blocks = []
    for df in sides:
        sizes = df.groupBy("place").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words")).collect()
        blocks.append({r.place: max(-(-r.texts // BLOCK_TEXTS), -(-r.words // BLOCK_WORDS)) for r in sizes})
    # one class more, since logarithms are rounded
    near = [(i, j) for i in blocks[0] for j in blocks[1] if abs(i - j) <= SIZE_CLASSES + 1]
    cells = [(i, a, j, b) for i, j in near for a in range(blocks[0][i]) for b in range(blocks[1][j])]
    spark = left.sparkSession

    def dealt(df: DataFrame, own: dict[int, int], side: int) -> DataFrame:
        listed = spark.createDataFrame([(k, *c[2 * side : 2 * side + 2]) for k, c in enumerate(cells)], "cell int, place int, block int")
        counts = spark.createDataFrame(list(own.items()), "place int, blocks int")
        placed = df.join(F.broadcast(counts), "place").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        return placed.join(F.broadcast(listed), ["place", "block"]).select("cell", "id", "hs")

    a, b = dealt(sides[0], blocks[0], 0), dealt(sides[1], blocks[1], 1)
    schema = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType)])

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        at, to = _alike(*_lists(x), *_lists(y), least)
        return pa.table([x.column("id").take(at), y.column("id").take(to)], names=schema.fieldNames())

    return a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(met, schema)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of hashes one after another, and their lengths."""
    hashes = table.column("hs").combine_chunks()
    hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
    return hashes.flatten().to_numpy(zero_copy_only=False), hashes.value_lengths().to_numpy(zero_copy_only=False)


def _alike(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets (values and lengths) that agree by ``least`` and more: frequent words are counted by products of tables, others by their pairs."""
    words, left = np.unique(left, return_inverse=True)
    rows, cols = np.repeat(np.arange(len(left_n)), left_n), np.repeat(np.arange(len(right_n)), right_n)
    at = np.minimum(np.searchsorted(words, right), max(len(words) - 1, 0))
    known = words[at] == right if len(words) else np.zeros(len(right), bool)
    right, cols = at[known], cols[known]
    shape = (len(left_n), len(right_n))
    pairs = np.bincount(left, minlength=len(words)) * np.bincount(right, minlength=len(words))
    common = np.zeros(shape, np.float32)
    frequent = np.flatnonzero(pairs > shape[0] * shape[1] / 200)
    for start in range(0, len(frequent), 256):
        column = np.full(len(words), -1)
        column[frequent[start : start + 256]] = np.arange(len(frequent[start : start + 256]))
        tables = []
        for size, row, word in ((shape[0], rows, left), (shape[1], cols, right)):
            one, own = np.zeros((size, 256), np.float32), column[word]
            one[row[own >= 0], own[own >= 0]] = 1
            tables.append(one)
        common += tables[0] @ tables[1].T
    pairs[frequent] = 0
    # the places of a word on the right stand together; each place on the left meets all of its word's
    order = np.argsort(right, kind="stable")
    starts, sizes = np.searchsorted(right[order], np.arange(len(words))), np.bincount(right, minlength=len(words))
    kept = np.flatnonzero(pairs[left] > 0)
    n = sizes[left[kept]]
    ends = np.cumsum(n)
    low = 0
    while low < len(kept):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 4_000_000, "right")))
        part, many = kept[low:high], n[low:high]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        flat = np.repeat(rows[part] * shape[1], many) + cols[order[np.repeat(starts[left[part]], many) + inner]]
        where, times = np.unique(flat, return_counts=True)
        common.reshape(-1)[where] += times
        low = high
    # whoever asks takes the exact agreement of what is found
    return np.nonzero((1 + least) * common >= least * (left_n[:, None] + right_n[None, :]).astype(np.float32) - 1e-2)


def prompt_similarity(a: Column, b: Column, words_a: Column, words_b: Column, asked: Column | None = None) -> Column:
    """Agreement of two normalised texts: that of their word sets where it is below .35, else the larger of it and the matching ratio.

    The ratio is taken in Python, which a condition around it doesn't keep from any row, so it gets no texts where it isn't needed (or ``asked`` for).
    """
    j = set_jaccard(words_a, words_b)
    needed = (j >= LEAST_OVERLAP) & (j < 1) & (F.lit(True) if asked is None else asked)
    return F.when(j < LEAST_OVERLAP, j).otherwise(F.greatest(j, sequence_ratio(F.when(needed, a), F.when(needed, b))))


def near_leaks(targets: DataFrame, references: DataFrame, least: float = NEAR, by: str | None = None) -> DataFrame:
    """The most similar reference of each target that has no equal one, if it is similar enough; first wins. ``by``: only references of equal values of a column."""
    own = [by] if by else []
    rest = targets.join(references.select("norm").distinct(), "norm", "left_anti")
    left = rest.select(F.col("id").alias("target_id"), F.col("norm").alias("a"), F.array_distinct("toks").alias("sa")).dropDuplicates(["target_id"])
    right = references.select(F.col("id").alias("reference_id"), F.col("norm").alias("b"), F.array_distinct("toks").alias("sb")).dropDuplicates(["reference_id"])
    pairs = near_candidates(rest.select("id", *own, "toks"), references.select("id", *own, "toks"), by).toDF("target_id", "reference_id")
    met = pairs.join(left, "target_id").join(right, "reference_id").where(set_jaccard(F.col("sa"), F.col("sb")) >= LEAST_OVERLAP)
    scored = met.withColumn("similarity", prompt_similarity(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"))).where(F.col("similarity") >= least)
    return scored.groupBy("target_id").agg(F.max_by(F.struct("similarity", "reference_id"), F.struct("similarity", -F.col("reference_id"))).alias("m")).select("target_id", "m.reference_id", "m.similarity")


def contained(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """``phrase_id, text_id``: normalised phrases that stand in a text between word borders.

    A phrase's first words (up to four) must stand at some place, by an equi-join on their hash; then the text is asked for the phrase.
    """
    first = 4
    p = phrases.select(F.col("id").alias("phrase_id"), F.col("norm").alias("phrase"), F.size("toks").alias("n"), F.xxhash64(F.array_join(F.slice("toks", 1, first), " ")).alias("h")).where(F.col("n") >= 1)
    # only the lengths that phrases begin with are laid out over the texts: four numbers at most
    wanted = sorted(r.k for r in p.select(F.least("n", F.lit(first)).alias("k")).distinct().collect()) or [first]
    size = F.size("toks")
    hashed = lambda k: F.when(size >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), lambda i: F.xxhash64(F.array_join(F.slice("toks", i, k), " "))))).otherwise(F.array().cast("array<bigint>"))
    runs = texts.select(F.col("id").alias("text_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("k"), hashed(k).alias("hs")) for k in wanted]))).select("text_id", "k", F.explode("hs").alias("h"))
    keyed = p.withColumn("k", F.least(F.col("n"), F.lit(first)))
    candidates = runs.join(keyed, ["h", "k"]).select("phrase_id", "phrase", "text_id").distinct()
    met = candidates.join(texts.select(F.col("id").alias("text_id"), "norm"), "text_id")
    return met.where(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select("phrase_id", "text_id")


def within(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """``phrase_id, text_id``: phrases that stand in a normalised text anywhere, within words too.

    All but the first and last word of a phrase are whole words of the text, so phrases of three words and more meet texts on a run of
    these (up to four), by hash; shorter phrases meet the different words, or two words that follow each other, of the texts (``within_words``).
    """
    inner = 4
    n = F.size("toks")
    p = phrases.select(F.col("id").alias("phrase_id"), F.col("norm").alias("phrase"), n.alias("n"), F.slice("toks", F.lit(2), F.greatest(F.lit(0), F.least(F.lit(inner), n - 2))).alias("run"))
    long = p.where("n >= 3").select("phrase_id", "phrase", F.size("run").alias("k"), F.xxhash64(F.array_join("run", " ")).alias("h"))
    wanted = sorted(r.k for r in long.select("k").distinct().collect())
    text = texts.select(F.col("id").alias("text_id"), "norm")
    holds = F.col("norm").contains(F.col("phrase"))
    short = within_words(p.where("n < 3").select("phrase_id", "phrase"), texts.select(_short_runs()).distinct())
    out = short.join(texts.select(F.col("id").alias("text_id"), _short_runs()), "run").select("phrase_id", "text_id").distinct()
    if wanted:
        size = F.size("toks")
        hashed = lambda k: F.when(size >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - k + 1)), lambda i: F.xxhash64(F.array_join(F.slice("toks", i, k), " "))))).otherwise(F.array().cast("array<bigint>"))
        runs = texts.select(F.col("id").alias("text_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("k"), hashed(k).alias("hs")) for k in wanted]))).select("text_id", "k", F.explode("hs").alias("h"))
        met = runs.join(long, ["h", "k"]).select("phrase_id", "phrase", "text_id").distinct().join(text, "text_id")
        out = out.unionByName(met.where(holds).select("phrase_id", "text_id"))
    return out


#: Letters on either side that a phrase of one or two words meets words by.
EDGE = 3


def _short_runs() -> Column:
    """``run``: each word of a text, and each two words that follow each other, once."""
    pairs = F.zip_with(F.slice("toks", F.lit(1), F.greatest(F.lit(0), F.size("toks") - 1)), F.slice("toks", F.lit(2), F.greatest(F.lit(0), F.size("toks") - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.explode(F.array_distinct(F.concat("toks", pairs))).alias("run")


def within_words(phrases: DataFrame, runs: DataFrame) -> DataFrame:
    """``phrase_id, run``: phrases (phrase_id, phrase) of one or two words that stand in a ``run`` of as many.

    One word meets words on its first letters, at any place of theirs; of two words, the letters before and after the space must be the run's.
    """
    single = lambda c: ~c.contains(" ")
    one = phrases.where(single(F.col("phrase"))).withColumn("key", F.substring("phrase", 1, EDGE))
    places = F.transform(F.sequence(F.lit(1), F.length("run")), lambda at: F.array(*[F.col("run").substr(at, F.lit(k)) for k in range(1, EDGE + 1)]))
    met = runs.where(single(F.col("run"))).select("run", F.explode(F.array_distinct(F.flatten(places))).alias("key")).join(one, "key")
    found = met.where(F.col("run").contains(F.col("phrase"))).select("phrase_id", "run")
    before, after = (lambda c, i=i: F.element_at(F.split(c, " "), i) for i in (1, 2))
    key = lambda a, b: F.concat(F.reverse(F.substring(F.reverse(a), 1, EDGE)), F.lit(" "), F.substring(b, 1, EDGE))
    two = phrases.where(~single(F.col("phrase"))).withColumn("key", key(before(F.col("phrase")), after(F.col("phrase"))))
    a, b = before(F.col("run")), after(F.col("run"))
    edges = F.array(*[F.concat(F.reverse(F.substring(F.reverse(a), 1, i)), F.lit(" "), F.substring(b, 1, j)) for i in range(1, EDGE + 1) for j in range(1, EDGE + 1)])
    met = runs.where(~single(F.col("run"))).select("run", F.explode(F.array_distinct(edges)).alias("key")).join(two, "key")
    return found.unionByName(met.where(F.col("run").contains(F.col("phrase"))).select("phrase_id", "run"))


def nested_phrases(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases that are parts of phrases that were found count as found; equal phrases are looked for once, in different phrases only.

    A phrase of one or two words is looked for in the words of all found phrases together, which says whether it stands in some.
    """
    hit = phrases.join(found.select(F.col("phrase_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["norm"])
    one = phrases.groupBy("norm").agg(F.first("toks").alias("toks")).withColumn("id", F.col("norm"))
    long = within(one.where(F.size("toks") >= 3), hit).select(F.col("phrase_id").alias("norm"))
    short = within_words(one.where(F.size("toks") < 3).select(F.col("id").alias("phrase_id"), F.col("norm").alias("phrase")), hit.select(_short_runs()).distinct()).select(F.col("phrase_id").alias("norm"))
    known = long.unionByName(short).distinct()
    return phrases.join(known, "norm", "left_semi").select(F.col("id").alias("phrase_id")).distinct()


def answer_hits(phrases: DataFrame, answers: DataFrame) -> DataFrame:
    """``phrase_id, answer_id``: the first answer whose normalised text holds a specific phrase anywhere."""
    met = within(phrases.where(specific(F.col("norm"))), answers)
    return met.groupBy("phrase_id").agg(F.min("text_id").alias("answer_id"))


def support_phrases(items: DataFrame, id_col: str) -> DataFrame:
    """``id, text``: what an evaluation row asks for: its expected answers, required phrases, and those of its groups."""
    parts = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("expected", "must_include") if c in items.columns], F.flatten(F.coalesce(F.col("must_include_any"), F.array().cast("array<array<string>>"))))
    return items.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(parts)).alias("text")).where("trim(text) <> ''")


def answer_texts(items: DataFrame, id_col: str) -> DataFrame:
    """``id, text``: the reference answer of a row, or else what it must include."""
    must = F.concat(F.coalesce("must_include", F.array().cast("array<string>")), F.flatten(F.coalesce("must_include_any", F.array().cast("array<array<string>>"))))
    has = F.trim(F.coalesce("reference_answer", F.lit(""))) != ""
    return items.select(F.col(id_col).alias("id"), F.explode(F.when(has, F.array("reference_answer")).otherwise(must)).alias("text"))


def chat_records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id, line, source, kind, category, text, norm, toks``: two records of a chat row, the prompt and the answer."""
    base = rows.select(F.col(id_col).alias("line"), F.coalesce(F.col("category"), F.lit("chat")).alias("category"), F.inline(F.array(F.struct(F.lit("prompt").alias("kind"), F.col("user").alias("text")), F.struct(F.lit("answer").alias("kind"), F.col("assistant").alias("text")))))
    return _recorded(base, "chat_sft")


def eval_records(items: DataFrame, id_col: str) -> DataFrame:
    """The prompt of an evaluation row and each specific phrase that it asks for, as records."""
    prompts = items.select(F.col(id_col).alias("line"), F.lit("prompt").alias("kind"), F.coalesce(F.col("category"), F.lit("eval")).alias("category"), F.col("user").alias("text"))
    asked = support_phrases(items, id_col).join(items.select(F.col(id_col).alias("id"), F.coalesce(F.col("category"), F.lit("eval")).alias("category")), "id")
    phrases = asked.where(specific(F.array_join(tokens("text"), " "))).select(F.col("id").alias("line"), F.lit("support").alias("kind"), "category", "text")
    return _recorded(prompts.unionByName(phrases), "eval")


def reply_records(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Generated replies as records."""
    return _recorded(replies.select(F.col(id_col).alias("line"), F.lit("reply").alias("kind"), F.lit(None).cast("string").alias("category"), F.col(text_col).alias("text")), "generated_answers")


def _recorded(rows: DataFrame, source: str) -> DataFrame:
    named = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("source", F.lit(source))
    norm = named.withColumn("toks", tokens("text")).withColumn("norm", F.array_join("toks", " "))
    return norm.withColumn("id", F.xxhash64("source", "kind", "line", "text"))


def overlap_rates(targets: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """``id, ngrams, shared, overlap_rate``: share of a target's distinct n-grams that stand in some reference."""
    own = targets.select("id", F.explode(distinct_ngrams(F.col("toks"), n)).alias("g"))
    known = references.select(F.explode(distinct_ngrams(F.col("toks"), n)).alias("g")).join(own.select("g").distinct(), "g", "left_semi").distinct().withColumn("hit", F.lit(1))
    counted = own.join(known, "g", "left").groupBy("id").agg(F.count(F.lit(1)).alias("ngrams"), F.count("hit").alias("shared"))
    return targets.select("id").join(counted, "id", "left").select("id", F.coalesce("ngrams", F.lit(0)).alias("ngrams"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.col("shared") / F.col("ngrams"), F.lit(0.0)).alias("overlap_rate"))


def hit_positions(targets: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """``id, pos, hit``: for each place of a target whether its n-gram stands in some reference."""
    own = targets.select("id", F.posexplode(ngrams(F.col("toks"), n)).alias("pos", "g"))
    known = references.select(F.explode(distinct_ngrams(F.col("toks"), n)).alias("g")).join(own.select("g").distinct(), "g", "left_semi").distinct().withColumn("hit", F.lit(1))
    return own.join(known, "g", "left").select("id", "pos", F.col("hit").isNotNull().alias("hit"))


def memorization(targets: DataFrame, references: DataFrame, n: int = 4) -> DataFrame:
    """``id, overlap, positions, overlap_rate, longest``: share of places (not distinct n-grams) that hit, and the longest run of tokens."""
    hits = hit_positions(targets, references, n)
    counted = hits.groupBy("id").agg(F.sum(F.col("hit").cast("long")).alias("overlap"), F.count(F.lit(1)).alias("positions"))
    islands = hits.where("hit").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    runs = islands.groupBy("id", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("id").agg((F.max("run") + (n - 1)).alias("longest"))
    return counted.join(runs, "id", "left").select("id", "overlap", "positions", (F.col("overlap") / F.greatest(F.lit(1), F.col("positions"))).alias("overlap_rate"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def memorization_risk(rate: Column, longest: Column, canaries: Column) -> Column:
    return F.when((canaries > 0) | (longest >= 80) | (rate >= 0.35), "high").when((longest >= 32) | (rate >= 0.15), "medium").otherwise("low")


def canaries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, canary``: planted strings in texts."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(CANARY), 0))).alias("canary"))


def matrix_risk(exact: Column, near: Column, overlap: Column, longest: Column, n: int) -> Column:
    return (
        F.when((exact > 0) | (overlap >= 0.80) | (longest >= max(40, 5 * n)), "high")
        .when((near > 0) | (overlap >= 0.35) | (longest >= max(16, 2 * n)), "medium")
        .when((overlap > 0) | (longest >= n), "low")
        .otherwise("clean")
    )


def longest_overlap(target: Column, reference: Column, most: int = 120) -> Column:
    """Tokens of the longest run of a target's first tokens that stands in a reference between word borders; both are token arrays."""
    return _longest_run(F.slice(target, 1, most), F.array_join(reference, " "))


@F.pandas_udf(T.LongType())
def _longest_run(tokens_of: pd.Series, text: pd.Series) -> pd.Series:
    def one(words: list[str], whole: str) -> int:
        whole, best = f" {whole} ", 0
        if words is None or whole == "  ":
            return 0
        for start in range(len(words)):
            # a run is only looked at if it is longer than the best
            while start + best < len(words) and f" {' '.join(words[start:start + best + 1])} " in whole:
                best += 1
        return best

    return pd.Series([one(w, t) for w, t in zip(tokens_of, text, strict=True)], dtype="int64")


def comparable(a: Column, b: Column) -> Column:
    """Whether two normalised texts are compared by similarity: neither too short, nor one too long."""
    return (F.length(a) >= LEAST_PROMPT) & (F.length(b) >= LEAST_PROMPT) & (F.greatest(F.length(a), F.length(b)) <= MOST_COMPARED)


def text_hit(reference: Column, target: Column) -> Column:
    """Whether a target of 24 characters and more is the reference, or stands in it between word borders."""
    inside = F.concat(F.lit(" "), reference, F.lit(" ")).contains(F.concat(F.lit(" "), target, F.lit(" ")))
    return (F.length(target) >= LEAST_PROMPT) & (reference != "") & inside


def run_pairs(targets: DataFrame, references: DataFrame, n: int, most: int = 120) -> DataFrame:
    """``target_id, reference_id`` of the references that hold as long a run, under ``n``, of a target's first tokens as any does.

    Where none holds any of these, those with any of its words. Of such references the one of most alike words comes, the first of equal ones:
    where word sets agree by less than .35 that is the similarity, and ``alike_pairs`` has the others. Without similarity, it is the first one.
    """
    size = lambda c: F.size(c)
    hashed = lambda c, k: F.when(size(c) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size(c) - k + 1)), lambda i: F.xxhash64(F.slice(c, i, k))))).otherwise(F.array().cast("array<bigint>"))

    def runs(df: DataFrame, name: str, first: Column, *more: str) -> DataFrame:
        levels = [F.struct(F.lit(k).alias("k"), hashed(first if k else F.col("toks"), max(k, 1)).alias("hs")) for k in range(n)]
        return df.select(F.col("id").alias(name), *more, F.inline(F.array(*levels))).select(name, *more, "k", F.explode("hs").alias("h"))

    compared = F.length("norm").between(LEAST_PROMPT, MOST_COMPARED)
    own = runs(targets.withColumn("compared", compared), "target_id", F.slice("toks", 1, most), "compared")
    met = _kept(runs(references, "reference_id", F.col("toks")).join(own.select("k", "h").distinct(), ["k", "h"], "left_semi"), "runs")
    longest = own.join(met.select("k", "h").distinct(), ["k", "h"]).groupBy("target_id").agg(F.max("k").alias("k"))
    top = own.join(longest, ["target_id", "k"])
    whole = top.where("compared").join(met, ["k", "h"]).select("target_id", "reference_id").distinct()
    first = top.where("not compared").join(met.groupBy("k", "h").agg(F.min("reference_id").alias("reference_id")), ["k", "h"]).groupBy("target_id").agg(F.min("reference_id").alias("reference_id"))
    # words are compared before texts are laid out: a short run stands in many references
    left = targets.select(F.col("id").alias("target_id"), F.array_distinct("toks").alias("sa"))
    right = references.select(F.col("id").alias("reference_id"), F.array_distinct("toks").alias("sb"), compared.alias("also"))
    alike = F.when(F.col("also"), set_jaccard(F.col("sa"), F.col("sb"))).otherwise(0.0)
    best = whole.join(left, "target_id").join(right, "reference_id").groupBy("target_id").agg(F.max_by("reference_id", F.struct(alike, -F.col("reference_id"))).alias("reference_id"))
    return best.unionByName(first)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder once."""
    from corpusloom.sources.tables import scratch

    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_matches(references: DataFrame, targets: DataFrame, n: int = 8, near: float = NEAR, runs: bool = True) -> DataFrame:
    """``target_id, reference_id, exact, near, similarity, overlap_rate, longest`` of records that share an n-gram, words, or stand one in the other.

    Records of a pair that shares none of these have no hit and a similarity under .35, so they are never laid out; but of a target that
    shares no n-gram and stands in no reference, those of the longest run are (``runs``), since the best of its references is among them.
    """
    one, other = targets.select("id", "norm", "toks"), references.select("id", "norm", "toks")
    grams = lambda df, name: df.select(F.col("id").alias(name), F.explode(distinct_ngrams(F.col("toks"), n)).alias("g"))
    shared = grams(one, "target_id").join(grams(other, "reference_id"), "g").groupBy("target_id", "reference_id").agg(F.count(F.lit(1)).alias("shared"))
    compared = F.length("norm").between(LEAST_PROMPT, MOST_COMPARED)
    close = alike_pairs(one.where(compared), other.where(compared)).toDF("target_id", "reference_id")
    inside = contained(one.where(F.length("norm") >= LEAST_PROMPT), other).toDF("target_id", "reference_id")
    shared = _kept(shared, "shared")
    pairs = shared.select("target_id", "reference_id").unionByName(inside).distinct()
    if runs:
        pairs = _kept(pairs, "pairs")
        pairs = pairs.unionByName(run_pairs(one.join(pairs.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti"), other, n))
    pairs = pairs.unionByName(close).distinct()
    met = pairs.join(shared, ["target_id", "reference_id"], "left").join(one.toDF("target_id", "a", "ta"), "target_id").join(other.toDF("reference_id", "b", "tb"), "reference_id")
    sized = met.withColumn("grams", F.size(distinct_ngrams(F.col("ta"), n))).withColumn("exact", text_hit(F.col("b"), F.col("a")))
    alike = F.when(comparable(F.col("a"), F.col("b")), prompt_similarity(F.col("a"), F.col("b"), F.array_distinct("ta"), F.array_distinct("tb"), comparable(F.col("a"), F.col("b")))).when(F.col("exact"), 1.0).otherwise(0.0)
    scored = sized.withColumn("similarity", alike).withColumn("overlap_rate", F.when(F.col("grams") > 0, F.coalesce("shared", F.lit(0)) / F.col("grams")).otherwise(0.0)).withColumn("longest", longest_overlap(F.col("ta"), F.col("tb")))
    hit = ~F.col("exact") & (F.length("a") >= LEAST_PROMPT) & (F.col("similarity") >= near)
    return scored.select("target_id", "reference_id", "exact", hit.alias("near"), "similarity", "overlap_rate", "longest")


def match_rank() -> Column:
    """What orders matches: exact, then overlap, run and similarity."""
    return F.struct("exact", "overlap_rate", "longest", "similarity")


def interesting(n: int) -> Column:
    return F.col("exact") | F.col("near") | (F.col("overlap_rate") > 0) | (F.col("longest") >= n)


def matrix_pair(name: str, references: DataFrame, targets: DataFrame, n: int = 8, near: float = NEAR) -> DataFrame:
    """One row of the contamination matrix between two tables of records: hits, the largest figures of the targets' best references, the risk.

    A target's best reference is the one of the highest ``match_rank``, the least id of equal ones.
    """
    found = record_matches(references, targets, n, near)
    best = found.groupBy("target_id").agg(F.max(F.col("exact").cast("int")).alias("hit"), F.max(F.col("near").cast("int")).alias("close"), F.max_by(match_rank(), F.struct(match_rank(), -F.col("reference_id"))).alias("m"))
    row = best.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("exact_hits"), F.coalesce(F.sum("close"), F.lit(0)).alias("near_hits"), F.coalesce(F.max("m.similarity"), F.lit(0.0)).alias("max_similarity"), F.coalesce(F.max("m.overlap_rate"), F.lit(0.0)).alias("max_overlap_rate"), F.coalesce(F.max("m.longest"), F.lit(0)).alias("max_longest"))
    return _matrix_row(name, row, references, targets, n)


def corpus_matrix_pair(name: str, corpus: DataFrame, targets: DataFrame, n: int = 8) -> DataFrame:
    """The same against a corpus (id, norm, toks), which is one reference of any size: n-grams and runs count wherever they stand.

    A run is one of n-grams that follow each other in the target, so it may be put together from several places of the corpus.
    """
    exact = contained(targets.where(F.length("norm") >= LEAST_PROMPT), corpus).select("phrase_id").distinct().agg(F.count(F.lit(1)).alias("exact_hits"))
    overlap = overlap_rates(targets, corpus, n).agg(F.coalesce(F.max("overlap_rate"), F.lit(0.0)).alias("max_overlap_rate"))
    runs = memorization(targets, corpus, n).agg(F.coalesce(F.max("longest"), F.lit(0)).alias("max_longest"))
    row = exact.join(overlap).join(runs).select("exact_hits", F.lit(0).cast("long").alias("near_hits"), F.when(F.col("exact_hits") > 0, 1.0).otherwise(0.0).alias("max_similarity"), "max_overlap_rate", "max_longest")
    return _matrix_row(name, row, corpus, targets, n)


def _matrix_row(name: str, row: DataFrame, references: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    sizes = targets.agg(F.count(F.lit(1)).alias("target_items")).join(references.agg(F.count(F.lit(1)).alias("reference_items")))
    checked = (F.col("target_items") > 0) & (F.col("reference_items") > 0)
    risk = F.when(~checked, "not_checked").otherwise(matrix_risk(F.col("exact_hits"), F.col("near_hits"), F.col("max_overlap_rate"), F.col("max_longest"), n))
    return sizes.join(row).select(F.lit(name).alias("pair"), "reference_items", "target_items", "exact_hits", "near_hits", "max_similarity", "max_overlap_rate", "max_longest", risk.alias("risk"))


def contamination_matrix(corpus: DataFrame, chat: DataFrame, evaluation: DataFrame, generated: DataFrame | None = None, n: int = 8, near: float = NEAR) -> DataFrame:
    """The five pairs of corpus, tuning rows, evaluation rows and generated replies (records, or none)."""
    none = chat.limit(0)
    generated = none if generated is None else generated
    rows = [
        corpus_matrix_pair("base_corpus_vs_sft", corpus, chat, n),
        corpus_matrix_pair("base_corpus_vs_eval", corpus, evaluation, n),
        matrix_pair("sft_vs_eval", chat, evaluation, n, near),
        matrix_pair("generated_vs_sft", chat, generated, n, near),
        corpus_matrix_pair("generated_vs_base_corpus", corpus, generated, n),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def best_matches(references: DataFrame, targets: DataFrame, k: int = 5, n: int = 8, near: float = NEAR) -> DataFrame:
    """The ``k`` targets whose best references are of the highest rank, among those worth a look: a report's nearest neighbours."""
    found = record_matches(references, targets, n, near)
    best = found.groupBy("target_id").agg(F.max_by(F.struct("reference_id", "exact", "near", "similarity", "overlap_rate", "longest"), F.struct(match_rank(), -F.col("reference_id"))).alias("m")).select("target_id", "m.*")
    return best.where(interesting(n)).orderBy(F.desc("exact"), F.desc("overlap_rate"), F.desc("longest"), F.desc("similarity"), "target_id").limit(k)


def nearest_neighbours(targets: DataFrame, references: DataFrame, n: int = 8, k: int = 5) -> DataFrame:
    """The k references that share most of each target's distinct n-grams: target, rank, reference, overlap."""
    own = targets.select(F.col("id").alias("target_id"), F.explode(distinct_ngrams(F.col("toks"), n)).alias("g"))
    other = references.select(F.col("id").alias("reference_id"), F.explode(distinct_ngrams(F.col("toks"), n)).alias("g"))
    sizes = own.groupBy("target_id").agg(F.count(F.lit(1)).alias("size"))
    shared = own.join(other, "g").groupBy("target_id", "reference_id").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "target_id")
    order = Window.partitionBy("target_id").orderBy(F.desc("shared"), "reference_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("target_id", "rank", "reference_id", (F.col("shared") / F.col("size")).alias("overlap_rate"))


def findings(prompts: DataFrame, chat: DataFrame, corpus: DataFrame) -> DataFrame:
    """Union of the detectors: ``kind, severity, target_id, matched_id, snippet``."""
    first = Window.partitionBy("norm").orderBy("id")
    repeated = prompts.withColumn("first_id", F.first("id").over(first)).withColumn("rn", F.row_number().over(first)).where("rn > 1").select(F.lit("duplicate_eval_prompt").alias("kind"), F.lit("warn").alias("severity"), F.col("id").alias("target_id"), F.col("first_id").alias("matched_id"))
    exact = exact_leaks(prompts, chat).select(F.lit("exact_sft_prompt_leak").alias("kind"), F.lit("fail").alias("severity"), "target_id", F.col("reference_id").alias("matched_id"))
    inside = contained(prompts.where(F.length("norm") >= LEAST_PROMPT), corpus).groupBy("phrase_id").agg(F.min("text_id").alias("matched_id")).select(F.lit("eval_prompt_in_corpus").alias("kind"), F.lit("warn").alias("severity"), F.col("phrase_id").alias("target_id"), "matched_id")
    found = repeated.unionByName(exact).unionByName(inside)
    return found.join(prompts.select(F.col("id").alias("target_id"), preview("text").alias("snippet")), "target_id").select("kind", "severity", "target_id", "matched_id", "snippet")


def honesty_status(found: DataFrame) -> DataFrame:
    """blocked if a finding fails, caution if there is any, else ready."""
    return found.agg(F.max(F.when(F.col("severity") == "fail", 2).otherwise(1)).alias("w"), F.count(F.lit(1)).alias("findings")).select(F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "caution").otherwise("ready").alias("status"), "findings")


def pack_contamination(eval_rows: DataFrame, train_rows: DataFrame, least: float = NEAR) -> DataFrame:
    """``kind, eval_id, train_id, similarity`` between evaluation and training rows of a pack (id, user, assistant, bucket).

    Equal prompts; prompts that are alike within their behaviour bucket, or among all training rows where these have none of the bucket; and
    what an evaluation row must include (``must_include``, or else its answer), of 12 characters and more, inside a training answer, the
    first one of each row, but for refusals and identity rows.
    """
    e, t = records(eval_rows, "id", "user"), records(train_rows, "id", "user")
    exact = exact_leaks(e, t).select(F.lit("exact_prompt").alias("kind"), F.col("target_id").alias("eval_id"), F.col("reference_id").alias("train_id"), F.lit(1.0).alias("similarity"))
    known = train_rows.select(F.coalesce("bucket", F.lit("")).alias("bucket")).distinct().withColumn("known", F.lit(True))
    whole = "*"
    block = eval_rows.select("id", F.coalesce("bucket", F.lit("")).alias("bucket")).join(F.broadcast(known), "bucket", "left").select("id", F.when(F.col("known"), F.col("bucket")).otherwise(whole).alias("block"))
    own = train_rows.select("id", F.explode(F.array(F.coalesce("bucket", F.lit("")), F.lit(whole))).alias("block"))
    if block.where(F.col("block") == whole).limit(1).count() == 0:
        own = own.where(F.col("block") != whole)
    near = near_leaks(e.join(block, "id"), t.join(own, "id"), least, "block")
    found = exact.unionByName(near.select(F.lit("near_prompt").alias("kind"), F.col("target_id").alias("eval_id"), F.col("reference_id").alias("train_id"), "similarity"))
    asked = F.when(F.size("must_include") > 0, F.col("must_include")).otherwise(F.array("assistant")) if "must_include" in eval_rows.columns else F.array("assistant")
    kept = eval_rows.where(~F.coalesce("bucket", F.lit("")).isin("refusal", "identity", "honesty")).select("id", F.explode(asked).alias("text"))
    answers = records(kept, "id", "text").where(F.length("norm") >= 12)
    inside = contained(answers, records(train_rows, "id", "assistant")).groupBy("phrase_id").agg(F.min("text_id").alias("train_id"))
    return found.unionByName(inside.select(F.lit("answer_in_train").alias("kind"), F.col("phrase_id").alias("eval_id"), "train_id", F.lit(1.0).alias("similarity")))


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """An error if two tables share a key."""
    if not left.join(right.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"the tables share values of {key}")


def phrases_in(phrases: list[str], text: str, spark) -> list[str]:
    """Which phrases stand in one text, by the same rule as in tables."""
    p = records(spark.createDataFrame(list(enumerate(phrases)), "id long, text string"), "id", "text")
    found = contained(p, records(spark.createDataFrame([(0, text)], "id long, text string"), "id", "text"))
    return [phrases[i] for i in sorted(r.phrase_id for r in found.collect())]
