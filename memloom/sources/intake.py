"""Intake of files: classification, watching, ignoring, debouncing, archiving and reporting (S-04 to S-08, K-11, A-08)."""

from __future__ import annotations

import fnmatch
import json
import re
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes above which a watched file is passed over, and what an extension says of the language (fixed values).
WATCH_BYTES = 1_048_576
LANGUAGES = {"md": "markdown", "py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "json": "json", "toml": "toml", "yaml": "yaml",
             "yml": "yaml", "log": "log", "csv": "csv", "html": "html"}
RETENTION_S = 7 * 86_400


def classified(files: DataFrame) -> DataFrame:
    """S-04: (path, modified, way, value) of binary files: empty ones are archived, those that aren't text fail, ``.txt`` is a
    transcript to distil, other text a document."""
    text = F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string")
    valid = F.is_valid_utf8(text) & ~text.contains("\u0000")
    way = F.when(F.length("content") == 0, "archived").when(~valid, "failed").when(F.lower("path").endswith(".txt"), "distil").otherwise("document")
    return files.select("path", F.col("modificationTime").alias("modified"), way.alias("way"), F.when(valid, text).alias("value"))


def read_intake(spark: SparkSession, folder: str) -> DataFrame:
    """S-04 as a batch. Spark's file source gives no row for an empty file; those are archived from the listing."""
    return classified(spark.read.format("binaryFile").load(folder))


def extension_language(uri: Column) -> Column:
    """S-08: language of a path by its extension; text if unknown."""
    ext = F.regexp_extract(F.lower(uri), r"\.([a-z0-9]+)$", 1)
    out = F.lit("text")
    for name, language in LANGUAGES.items():
        out = F.when(ext == name, language).otherwise(out)
    return out


def watched(records: DataFrame) -> DataFrame:
    """S-08: records of watched files that are text and not above 1 MiB; deletions (null content) and empty files are passed over."""
    ok = (F.length("content") > 0) & (F.octet_length("content") <= WATCH_BYTES)
    return records.where(F.coalesce(ok, F.lit(False))).select("record_id", "source_uri", "content", "replaces", "modified_at", extension_language(F.col("source_uri")).alias("language"))


def ignored(uri: Column, patterns: list[str] | None = None, denied: list[str] | None = None) -> Column:
    """S-07: whether a path is ignored: anything under ``.git``, denied prefixes, and glob patterns of ignore files."""
    path = F.regexp_replace(uri, "^file://", "")
    out = path.rlike(r"(^|/)\.git(/|$)")
    for p in denied or []:
        out = out | path.startswith(p)
    for p in patterns or []:
        body = fnmatch.translate(p.strip("/")).replace(r"\z", "").replace(r"\Z", "").replace("(?s:", "(?:")
        out = out | path.rlike(rf"(^|/){body}(/|$)" if "/" not in p.strip("/") else rf"(^|/){body}")
    return F.coalesce(out, F.lit(False))


def debounced(records: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """S-07: the last event of each path that isn't ignored."""
    ok = records.where(F.col("source_uri").isNotNull() & F.col("modified_at").isNotNull() & ~ignored(F.col("source_uri"), patterns))
    best = ok.groupBy("source_uri").agg(F.max(F.struct("modified_at", "record_id", "content", "replaces")).alias("e"))
    return best.select("source_uri", "e.*")


def watch_records(events: DataFrame, patterns: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """S-07, S-08: records of ``events(path, event, old_path, content, at)``, event being create, modify, rename or delete.

    Of each path that isn't ignored the last event counts. A delete gives no record; a rename carries ``replaces``, the path it
    left, unless something was written there since. Empty, binary (null) and too large contents give none.
    """
    ok = events.where(F.col("path").isNotNull() & F.col("at").isNotNull() & ~ignored(F.col("path"), patterns, denied))
    last = ok.groupBy("path").agg(
        F.max_by(F.struct("event", "content", "at"), F.struct("at", (F.col("event") == "delete").alias("d"))).alias("e"),
        F.max_by("old_path", F.when(F.col("event") == "rename", F.col("at"))).alias("old_path"))
    alive = last.where("e.event <> 'delete'").select("path", "e.content", "e.at", "old_path")
    again = alive.select(F.col("path").alias("old_path"), F.col("at").alias("again"))
    joined = alive.join(again, "old_path", "left")
    fits = (F.length("content") > 0) & (F.octet_length("content") <= WATCH_BYTES)
    return joined.where(F.coalesce(fits, F.lit(False))).select(
        F.concat(F.lit("file://"), F.col("path")).alias("source_uri"), "content", F.when(F.col("again").isNull(), F.concat(F.lit("file://"), F.col("old_path"))).alias("replaces"),
        F.col("at").alias("modified_at"), extension_language(F.col("path")).alias("language"))


def report(records: DataFrame) -> DataFrame:
    """A-08: records by what became of them: archived (nothing in it), failed (too big), stuck (no time), done."""
    status = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "archived").when(F.octet_length("content") > WATCH_BYTES, "failed").when(
        F.col("modified_at").isNull(), "stuck").otherwise("done")
    return records.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def stub_distiller(prompt: str) -> str:
    """A deterministic stand-in for a model: each line of an assistant becomes a fact that cites its turn."""
    out, turn = [], 1
    for line in prompt.splitlines():
        if m := re.match(r"\[(\d+)\] ", line):
            turn = int(m[1])
            line = line[m.end():]
        if line.startswith("assistant:") and line[10:].strip():
            out.append({"text": line[10:].strip(), "kind": "fact", "turns": [turn]})
    return "Claims: " + json.dumps(out)


# Files of one intake folder; used on the driver between batches.

def archive(path: Path, root: Path) -> Path:
    """K-11: move a handled file to ``done/``."""
    target = root / "done" / path.name
    target.parent.mkdir(parents=True, exist_ok=True)
    return path.rename(target)


def fail(path: Path, root: Path, error: str) -> Path:
    """K-11: move a file to ``failed/`` with what went wrong in ``errors/``."""
    for d in ("failed", "errors"):
        (root / d).mkdir(parents=True, exist_ok=True)
    (root / "errors" / f"{path.name}.txt").write_text(error)
    return path.rename(root / "failed" / path.name)


def prune(root: Path, retention_s: int = RETENTION_S, now: float | None = None) -> int:
    """K-11: delete handled files older than the retention; how many."""
    now, n = now or time.time(), 0
    for p in (root / "done").glob("*"):
        if now - p.stat().st_mtime > retention_s:
            p.unlink()
            n += 1
    return n


def archive_empty(root: Path) -> int:
    """S-04: archive empty files of a folder; how many."""
    empty = [p for p in root.glob("*") if p.is_file() and p.stat().st_size == 0]
    for p in empty:
        archive(p, root)
    return len(empty)


def folder_report(root: Path, stuck_s: int = 3600, now: float | None = None) -> dict[str, int]:
    """A-08 for a folder: files pending, stuck, done and failed."""
    now = now or time.time()
    waiting = [p for p in root.glob("*") if p.is_file()]
    return {"pending": len(waiting), "stuck": sum(now - p.stat().st_mtime > stuck_s for p in waiting),
            "done": len(list((root / "done").glob("*"))), "failed": len(list((root / "failed").glob("*")))}


def submit_direct(root: Path, job: dict) -> Path:
    """S-06: write a job under the hash of its content, by rename, so that submitting again is the same."""
    import hashlib

    body = json.dumps(job, sort_keys=True)
    target = root / "direct" / f"{hashlib.sha256(body.encode()).hexdigest()}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists():
        part = target.with_suffix(".part")
        part.write_text(body)
        part.rename(target)
    return target
