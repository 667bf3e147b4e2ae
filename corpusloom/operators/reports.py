"""Artifacts of a corpus, an audit, a pack and a run: tables with small JSON and Markdown files beside them."""

from __future__ import annotations

import json
import shlex
import tarfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import contamination, corpus
from corpusloom.sources.sinks import markdown_table, write_text

#: Rows that a Markdown report shows of its tables, at most.
SHOWN_DOCUMENTS, SHOWN_FILES = 200, 500


def build_corpus(docs: DataFrame, path: str, least_quality: int = 0, near_duplicates: bool = True, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Any]:
    """Write the kept documents with scores and offsets (``path/documents``), what was left out and why (``path/files``), and a report as JSON and Markdown.

    Returns the report: statistics, readiness, budget and warnings.
    """
    spark = docs.sparkSession
    judged = corpus.quality_filtered(docs.select(id_col, text_col), least_quality, text_col)
    judged.select(id_col, "reason", "included", "quality_score", "quality_flags").write.mode("overwrite").parquet(f"{path}/files")
    kept = judged.where("included").select(id_col, F.trim(text_col).alias(text_col), "quality_score", "quality_flags")
    offsets = corpus.document_offsets(kept, id_col, text_col)
    kept.join(offsets, id_col).write.mode("overwrite").parquet(f"{path}/documents")
    files, documents = spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/documents")
    stats = corpus.corpus_stats(documents, None, text_col)
    near = 0.0
    if near_duplicates:
        from corpusloom.operators import dedup

        near = dedup.near_rate(documents, dedup.near_pairs(documents, id_col, text_col)).first()["near_duplicate_rate"]
    skipped = files.where("reason <> 'included' and reason <> 'below_min_score'").count()
    low = documents.where(F.col("quality_score") < corpus.QUALITY_LOW).count()
    filtered = files.where("reason = 'below_min_score'").count()
    checks = corpus.readiness_checks(stats, F.lit(near), F.lit(skipped))
    report = {
        "stats": {**stats.first().asDict(), "near_duplicate_document_rate": near},
        "readiness": corpus.readiness(checks).first().asDict(),
        "checks": [r.asDict() for r in checks.collect()],
        "budget": corpus.training_budget(stats).first().asDict(),
        "warnings": [r.warning for r in corpus.corpus_warnings(stats, F.lit(low), F.lit(filtered), F.lit(skipped), F.lit(near)).collect()],
        "least_quality": least_quality,
    }
    write_text(spark, f"{path}/report.json", json.dumps(report, indent=2, sort_keys=True))
    sections = {"Statistics": stats, "Checks": checks, "Documents": documents.select(id_col, "char_start", "char_end", "quality_score").orderBy(id_col), "Left out": files.where("not included").select(id_col, "reason", "quality_score").orderBy(id_col)}
    most = {"Documents": SHOWN_DOCUMENTS, "Left out": SHOWN_FILES}
    body = [f"## {name}\n\n{markdown_table(rows, most.get(name, 50))}" for name, rows in sections.items()]
    write_text(spark, f"{path}/report.md", "\n\n".join(["# Corpus", *body]) + "\n")
    return report


def suggested_command(preset: str, source: str, name: str, chat: str | None = None, evaluation: str | None = None, pack: str | None = None, quality: int = 0) -> str:
    """A first training command for a corpus, or nothing while its checks block it or it has no tuning rows of its own."""
    if preset == "blocked" or not pack and not (chat and evaluation):
        return ""
    inputs = ["--dataset-pack", pack] if pack else ["--corpus-input", source, "--chat-input", chat, "--eval-input", evaluation]
    parts = ["train", "--out-dir", f"runs/{name}-v1", *inputs, "--preset", preset, *(["--min-quality-score", str(quality)] if quality else [])]
    return " ".join(shlex.quote(str(p)) for p in parts)


def honesty_report(path: str, prompts: DataFrame, chat: DataFrame, texts: DataFrame, matrix: DataFrame | None = None) -> dict[str, Any]:
    """Write the findings of an audit (``path/findings``), and a report with its status and the contamination matrix as JSON and Markdown."""
    spark = prompts.sparkSession
    contamination.findings(prompts, chat, texts).write.mode("overwrite").parquet(f"{path}/findings")
    found = spark.read.parquet(f"{path}/findings")
    counts = found.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")
    pairs = [] if matrix is None else [r.asDict() for r in matrix.collect()]
    report = {**contamination.honesty_status(found).first().asDict(), "counts": {r.kind: r.n for r in counts.collect()}, "matrix": pairs}
    write_text(spark, f"{path}/honesty.json", json.dumps(report, indent=2, sort_keys=True))
    parts = ["# Data honesty", f"Status: {report['status']}", markdown_table(counts), markdown_table(found.orderBy("kind", "target_id"), SHOWN_DOCUMENTS)]
    if pairs:
        parts.append("\n".join(f"- {p['pair']}: {p['risk']}" for p in pairs))
    write_text(spark, f"{path}/honesty.md", "\n\n".join(parts) + "\n")
    return report


def clone_pack(pack_path: str, target: str) -> str:
    """A working copy of a pack on a local disk: its chat and evaluation files are copied, its corpus is named where it is; returns the new pack's path."""
    source, folder = Path(pack_path), Path(target)
    raw = json.loads(source.read_text(encoding="utf-8"))
    folder.mkdir(parents=True, exist_ok=True)
    new = {"name": raw.get("name", ""), "description": raw.get("description", "")}
    for key, alias in (("chat", "chat_input"), ("eval", "eval_input")):
        file = source.parent / (raw.get(key) or raw[alias])
        (folder / file.name).write_bytes(file.read_bytes())
        new[key] = file.name
    known = raw.get("corpus") or {}
    new["corpus"] = {k: str((source.parent / v).resolve()) for k, v in known.items() if k in ("input", "recipe")}
    out = folder / "dataset_pack.json"
    out.write_text(json.dumps(new, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return str(out)


#: Parts of a run that a bundle leaves out unless they are asked for.
LARGE = ["corpus.txt", "token_shards", "packed_shards"]


def run_bundle(run_dir: str, out_path: str, expected: list[str], large: bool = False, strict: bool = True) -> dict[str, Any]:
    """Pack a run's folder on a local disk in a tar file with a manifest: all but its large parts; what is expected and isn't there is named, or an error."""
    folder = Path(run_dir)
    if not folder.is_dir():
        raise FileNotFoundError(run_dir)
    left_out = [name for name in LARGE if (folder / name).exists() and not large]
    files = [f for f in sorted(folder.rglob("*")) if f.is_file() and f.relative_to(folder).parts[0] not in left_out]
    missing = [name for name in expected if not (folder / name).exists()]
    if strict and missing:
        raise FileNotFoundError(f"the run lacks {', '.join(missing)}")
    manifest = {"run_dir": run_dir, "files": [str(f.relative_to(folder)) for f in files], "missing": missing, "left_out": left_out}
    with tarfile.open(out_path, "w:gz") as archive:
        for f in files:
            archive.add(f, arcname=f"{folder.name}/{f.relative_to(folder)}")
    Path(f"{out_path}.manifest.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")
    return manifest
