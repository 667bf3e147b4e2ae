"""Readers of corpora, tuning files, benchmarks and run folders. Data stays in DataFrames; only configurations are read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import glob, strip
from corpusloom.operators.corpus import EXTRACTED_EXTENSIONS, TEXT_EXTENSIONS

CHAT = "user string, assistant string, category string, group string, group_id string, template string, answerable boolean, answer_style string, curriculum_stage string"
CONVERSATION = "messages array<struct<role:string,content:string>>, system string, tools string, category string, group string, user string, assistant string"
PREFERENCE = "user string, prompt string, chosen string, preferred string, winner string, rejected string, dispreferred string, loser string, category string, group string"
EVAL = (
    "user string, must_include array<string>, must_include_any array<array<string>>, must_not_include array<string>, expected string, reference_answer string, answerable boolean, "
    "category string, split string, level string, curriculum_stage string, robustness_variant string, required_entities array<string>, min_words int, max_words int, min_chars int, max_chars int, "
    "require_corpus_support boolean, choice_labels array<string>, correct_choice string, normalized_answers array<string>, normalized_answer_required boolean"
)
CHOICES = "question string, choices struct<label:array<string>,text:array<string>>, answerKey string, id string, category string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]*)\\z", 1))


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of all files below a folder (or of one file)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with a text extension, in order of path when collected by it."""
    return files(spark, path).where(extension(F.col("path")).isin(TEXT_EXTENSIONS))


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files and those that need an extractor."""
    return files(spark, path).where(extension(F.col("path")).isin(TEXT_EXTENSIONS + EXTRACTED_EXTENSIONS))


def extracted(found: DataFrame, extractors: dict[str, object] | None = None) -> DataFrame:
    """``path, text, reason``: UTF-8 text with bad bytes replaced; other formats by an extractor of bytes, if one is given.

    A missing extractor, or one that fails, gives its reason and no text.
    """
    extractors = extractors or {}

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                kind = PurePosixPath(path).suffix.lower()
                if kind in TEXT_EXTENSIONS:
                    rows.append((path, bytes(content).decode("utf-8", "replace"), "included"))
                elif kind not in EXTRACTED_EXTENSIONS:
                    rows.append((path, None, "unsupported_extension"))
                elif kind not in extractors:
                    rows.append((path, None, f"missing_{kind[1:]}_dependency"))
                else:
                    try:
                        rows.append((path, extractors[kind](bytes(content)), f"included_{kind[1:]}"))
                    except Exception as error:  # an unreadable file is a row with its reason
                        rows.append((path, None, f"extract_failed:{type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "text", "reason"])

    return found.select("path", "content").mapInPandas(run, "path string, text string, reason string")


def documents(spark: SparkSession, path: str, extractors: dict[str, object] | None = None) -> DataFrame:
    """One document a file; failures and blank texts are left out."""
    return extracted(corpus_files(spark, path), extractors).where(F.col("text").isNotNull() & (strip("text") != ""))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path, or its last part, fits one of the globs."""
    name = F.substring_index(path, "/", -1)
    return glob(path, patterns) | glob(name, patterns)


@dataclass
class Source:
    path: str
    label: str | None = None
    include: bool = True
    exclude: list[str] = field(default_factory=list)
    reason: str | None = None

    @classmethod
    def parse(cls, entry: object) -> Source:
        if isinstance(entry, str):
            return cls(entry)
        if not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or not entry["path"].strip():
            raise ValueError("a source is a path or an object with a path")
        exclude = entry.get("exclude", [])
        if not isinstance(exclude, list) or not all(isinstance(x, str) for x in exclude):
            raise ValueError("exclude must be a list of globs")
        return cls(entry["path"], entry.get("label"), bool(entry.get("include", True)), exclude, entry.get("reason"))


@dataclass
class Recipe:
    name: str
    description: str
    sources: list[Source]
    exclude: list[str]

    @classmethod
    def parse(cls, text: str) -> Recipe:
        raw = json.loads(text)
        if not isinstance(raw.get("sources"), list) or not raw["sources"]:
            raise ValueError("a recipe needs sources")
        return cls(raw.get("name", ""), raw.get("description", ""), [Source.parse(s) for s in raw["sources"]], raw.get("exclude", []))

    def candidates(self, spark: SparkSession, root: str) -> DataFrame:
        """``path, label, skip``: files of the sources; why a file is skipped, or null."""
        out = None
        for source in self.sources:
            place = source.path if source.path.startswith("/") or "://" in source.path else f"{root}/{source.path}"
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(place)
            if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
                found = spark.createDataFrame([(place, source.label, "missing_source")], "path string, label string, skip string")
            else:
                skip = F.when(F.lit(not source.include), F.lit(source.reason or "recipe_excluded")).when(excluded(F.col("path"), self.exclude + source.exclude), F.lit(source.reason or "recipe_excluded"))
                found = files(spark, place).select("path", F.lit(source.label).cast("string").alias("label"), skip.alias("skip"))
            out = found if out is None else out.unionByName(found)
        return out


@dataclass
class Pack:
    """A dataset pack: corpus (input or recipe, one of them), chat and eval files; paths are relative to the pack."""

    name: str
    corpus_input: str | None
    corpus_recipe: str | None
    chat: str | None
    evaluation: str | None

    @classmethod
    def parse(cls, text: str, folder: str) -> Pack:
        raw = json.loads(text)
        corpus = raw.get("corpus")
        corpus = {"input": corpus} if isinstance(corpus, str) else corpus or {}
        if bool(corpus.get("input")) == bool(corpus.get("recipe")):
            raise ValueError("a pack's corpus has an input or a recipe, and not both")
        place = lambda p: None if not p else p if p.startswith("/") or "://" in p else f"{folder}/{p}"
        return cls(raw.get("name", ""), place(corpus.get("input")), place(corpus.get("recipe")), place(raw.get("chat") or raw.get("chat_input")), place(raw.get("eval") or raw.get("eval_input")))


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "lenient") -> DataFrame:
    """Rows of a JSONL file with their ``line`` number from 1 in their file.

    ``lenient`` skips blank and bad lines, ``validated`` keeps bad lines with ``bad`` set, ``strict`` fails on the first.
    """
    if mode not in ("lenient", "validated", "strict"):
        raise ValueError("mode is lenient, validated or strict")
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r\\n|\\n|\\r")).alias("pos", "raw"))
    rows = whole.where(F.trim("raw") != "").select((F.col("pos") + 1).alias("line"), "raw")
    good = F.trim("raw").startswith("{") & F.is_valid_utf8("raw") & F.expr("try_parse_json(raw)").isNotNull()
    parsed = rows.withColumn("good", good).withColumn("r", F.from_json("raw", T._parse_datatype_string(schema)))
    if mode == "strict":
        parsed = parsed.withColumn("good", F.when(F.col("good"), True).otherwise(F.raise_error(F.concat(F.lit("bad JSON in line "), F.col("line").cast("string"))))).where("good")
    if mode == "lenient":
        parsed = parsed.where("good")
    out = parsed.select("line", "r.*", *([(~F.col("good")).alias("bad")] if mode == "validated" else []))
    return out


def chat_rows(spark: SparkSession, path: str) -> DataFrame:
    """Validated chat examples: both sides there, category by default ``chat``; an empty file is an error."""
    rows = json_lines(spark, path, CHAT, "strict")
    group = F.coalesce("group", "group_id", "template")
    out = rows.where(F.col("user").isNotNull() & F.col("assistant").isNotNull()).select("line", strip("user").alias("user"), strip("assistant").alias("assistant"), F.coalesce(F.nullif(strip("category"), F.lit("")), F.lit("chat")).alias("category"), group.alias("group"))
    if out.isEmpty():
        raise ValueError("the chat file has no examples")
    return out


def eval_rows(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items with their defaults; ``expected`` is one more phrase to include."""
    rows = json_lines(spark, path, EVAL, "strict")
    none = F.array().cast("array<string>")
    answerable = F.coalesce("answerable", F.lit(True))
    must = F.coalesce("must_include", none)
    return (
        rows.withColumn("answerable", answerable)
        .withColumn("must_include", F.when(F.col("expected").isNotNull(), F.array_append(must, F.col("expected"))).otherwise(must))
        .withColumn("must_include_any", F.coalesce("must_include_any", F.array().cast("array<array<string>>")))
        .withColumn("must_not_include", F.coalesce("must_not_include", none))
        .withColumn("required_entities", F.coalesce("required_entities", none))
        .withColumn("category", F.coalesce("category", F.when(F.col("answerable"), "answerable").otherwise("unanswerable")))
        .withColumn("split", F.coalesce("split", F.lit("default")))
        .drop("expected")
    )


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """``line, messages``: from one turn or a list; system and tools go first; the last message is the assistant's."""
    rows = json_lines(spark, path, CONVERSATION, "strict")
    message = lambda role, text: F.when(text.isNotNull(), F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    turns = F.coalesce(F.transform("messages", lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content"))), F.concat(message("user", F.col("user")), message("assistant", F.col("assistant"))))
    whole = F.concat(message("system", F.col("system")), message("tool", F.col("tools")), turns)
    return rows.select("line", whole.alias("messages"), "category", "group").where((F.size("messages") > 0) & (F.try_element_at("messages", F.lit(-1))["role"] == "assistant"))


def external_benchmark(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``id, question, labels, choices, answer, category`` from ARC-like JSON(L) or MMLU-like CSV, with a header or without."""
    if kind == "arc":
        rows = json_lines(spark, path, CHOICES, "strict")
        return rows.select(F.coalesce("id", F.col("line").cast("string")).alias("id"), "question", F.col("choices.label").alias("labels"), F.col("choices.text").alias("choices"), F.col("answerKey").alias("answer"), "category")
    if kind != "mmlu_csv":
        raise ValueError("kind is arc or mmlu_csv")
    names = ["question", "A", "B", "C", "D", "answer"]
    raw = spark.read.csv(path, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), multiLine=True, escape='"')
    rows = raw.where((F.lower(F.col("question")) != "question") & F.col("answer").isNotNull())
    return rows.select(F.md5(F.concat_ws("\n", *names).cast("binary")).alias("id"), F.trim("question").alias("question"), F.array(*[F.lit(x) for x in "ABCD"]).alias("labels"), F.array("A", "B", "C", "D").alias("choices"), "answer", F.lit(None).cast("string").alias("category"))


def run_summaries(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """``run`` and the summary of each run folder that has one."""
    reader = spark.read.option("multiLine", "true")
    rows = (reader.schema(schema) if schema else reader).json(f"{folder}/*/summary.json")
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), "([^/]+)/summary\\.json\\z", 1))


def newest_reports(found: DataFrame) -> DataFrame:
    """The report of each run: ``eval/`` first, else the newest ``eval*/``; from ``run, folder, modified``."""
    first = F.when(F.col("folder") == "eval", 1).otherwise(0)
    return found.groupBy("run").agg(F.max_by(F.col("folder"), F.struct(first, F.col("modified"), F.col("folder"))).alias("folder"))


def parquet_shards(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Numbered Parquet shards of a downloaded data set."""
    return spark.read.parquet(*[f"{folder}/shard_{i:05d}.parquet" for i in range(first, last + 1)])


def loaded(loader, *args, **kwargs) -> DataFrame:
    """Rows of an injected loader, which must give a DataFrame."""
    rows = loader(*args, **kwargs)
    if not isinstance(rows, DataFrame):
        raise TypeError("a loader gives a DataFrame")
    return rows


def valid_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``lines, bad``: whether every line that isn't blank is a JSON object."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    good = F.trim("value").startswith("{") & F.expr("try_parse_json(value)").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(~good, 1)).alias("bad"))


def manifest_slices(text: DataFrame, manifest: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents of a corpus text by the manifest's whole offsets, in order; an overlap is an error."""
    from pyspark.sql import Window

    kept = manifest.where(F.col("char_start").isNotNull() & F.col("char_end").isNotNull())
    before = F.max("char_end").over(Window.partitionBy("path").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1))
    checked = kept.withColumn("char_start", F.when(F.coalesce(before, F.lit(0)) > F.col("char_start"), F.raise_error(F.lit("documents overlap in the manifest"))).otherwise(F.col("char_start")))
    return text.join(checked, "path").select("path", "char_start", F.trim(F.substring(text_col, F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).alias("text"))


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """``user, chosen, rejected`` of a preference file, under any of the usual names."""
    from corpusloom.operators.tuning import preference_rows

    return preference_rows(json_lines(spark, path, PREFERENCE, "strict"))


def default_extractors() -> dict[str, object]:
    """Extractors for the formats whose packages are there; the others report what is missing."""
    out: dict[str, object] = {}
    try:
        import io

        import pypdf

        out[".pdf"] = lambda content: "\n\n".join(p for p in ((page.extract_text() or "").strip() for page in pypdf.PdfReader(io.BytesIO(content)).pages) if p)
    except ImportError:
        pass
    try:
        import io

        import docx

        def word(content: bytes) -> str:
            document = docx.Document(io.BytesIO(content))
            rows = [" | ".join(c.text.strip() for c in r.cells) for t in document.tables for r in t.rows]
            return "\n".join(x for x in [p.text.strip() for p in document.paragraphs] + rows if x)

        out[".docx"] = word
    except ImportError:
        pass
    return out


def corpus(spark: SparkSession, path: str | None = None, recipe: Recipe | None = None, root: str = "", pack: Pack | None = None, read=None) -> DataFrame:
    """Documents of a path, a recipe or a pack: one of the three. ``read`` gets the text of a pack's recipe."""
    if sum(x is not None for x in (path, recipe, pack)) != 1:
        raise ValueError("a corpus is a path, a recipe or a pack")
    if pack is not None:
        if pack.corpus_input:
            return documents(spark, pack.corpus_input, default_extractors())
        return corpus(spark, recipe=Recipe.parse(read(pack.corpus_recipe)), root=pack.corpus_recipe.rsplit("/", 1)[0])
    if path is not None:
        return documents(spark, path, default_extractors())
    kept = recipe.candidates(spark, root).where("skip is null").select("path", "label")
    texts = None
    for source in recipe.sources:
        place = source.path if source.path.startswith("/") or "://" in source.path else f"{root}/{source.path}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(place)
        if source.include and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            found = extracted(corpus_files(spark, place), default_extractors())
            texts = found if texts is None else texts.unionByName(found)
    if texts is None:
        raise ValueError("no source of the recipe is there")
    return texts.dropDuplicates(["path"]).join(kept.dropDuplicates(["path"]), "path").where(F.col("text").isNotNull() & (strip("text") != ""))
