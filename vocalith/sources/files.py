"""Readers and writers of manifests, runs, traces, sidecars, lexicons and speech corpora.

All readers are lazy and take explicit schemas; nothing is inferred. Checks are queries (``schemas.violations``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.sources import schemas as S
from vocalith.sources.lines import read_strict


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a session in local mode may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="vocalith-")
    return f"{root.rstrip('/')}/vocalith/{name}-{uuid.uuid4().hex}"


def _file() -> Column:
    return F.col("_metadata.file_path")


def read_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One utterance a line; blank lines go, malformed ones fail the query. If ``strict``, so do unknown fields and rows without an id, and the
    error names file and line; that reader is Python's."""
    if strict:
        return read_strict(spark, path, S.MANIFEST, ["utt_id"])
    return spark.read.schema(S.MANIFEST).option("mode", "FAILFAST").json(path)


def read_speech(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SPEECH).option("mode", "FAILFAST").json(path)


def write_sorted_json(df: DataFrame, path: str, key: str = "utt_id", files: int | None = None) -> None:
    """JSON lines in order of ``key``: across files by range, in one file if ``files`` is 1."""
    ordered = df.coalesce(1).sortWithinPartitions(key) if files == 1 else df.orderBy(key)
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_runs(spark: SparkSession, root: str, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, rows) of every ``*/run.json`` and ``*/results.parquet`` below ``root``; ``mode`` keeps runs of one kind."""
    name = F.element_at(F.split(_file(), "/"), -2)
    runs = spark.read.schema(S.RUN).option("multiLine", "true").option("mode", "FAILFAST").json(f"{root}/*/run.json").select("*", name.alias("folder"))
    if mode:
        runs = runs.filter(F.col("mode") == mode)
    rows = spark.read.schema(S.RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    part = F.regexp_extract(_file(), r"/([^/]+)/results\.parquet", 1)
    rows = rows.select("*", part.alias("folder"))
    return runs, rows.join(F.broadcast(runs.select("folder")), "folder", "left_semi") if mode else rows


def run_violations(runs: DataFrame, rows: DataFrame, one_per_config: bool = True) -> DataFrame:
    """(run_id, rule): rows whose run or config isn't their file's, repeated utterances, several runs of one config."""
    meta = runs.select("folder", F.col("run_id").alias("_run"), F.col("config_id").alias("_config"))
    odd = rows.join(F.broadcast(meta), "folder").filter((F.col("run_id") != F.col("_run")) | (F.col("config_id") != F.col("_config")))
    found = odd.select("run_id", F.lit("row_of_another_run").alias("rule")).distinct()
    found = found.unionByName(rows.groupBy("run_id", "utt_id").count().filter("count > 1").select("run_id", F.lit("duplicate").alias("rule")).distinct())
    if one_per_config:
        many = runs.select("run_id", F.count("*").over(Window.partitionBy("config_id")).alias("n")).filter("n > 1")
        found = found.unionByName(many.select("run_id", F.lit("several_runs_of_a_config").alias("rule")))
    return found


def write_rows(rows: DataFrame, path: str) -> None:
    """Result rows, a folder a run, ordered by utterance; rewriting a run replaces that run alone."""
    rows.repartition("run_id").sortWithinPartitions("run_id", "utt_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def trace_name(utt_id: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(utt_id, ":", "__"), "/", "_"), F.lit(".jsonl"))


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, events) of trace files, ``.jsonl`` or ``.jsonl.gz``: line 1 describes the session, the rest are its events in order.

    A full trace hides a slim copy of the same name.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").text(path, wholetext=True)
    text = text.select(F.regexp_replace(_file(), r"\.gz$", "").alias("file"), _file().endswith(".gz").cast("int").alias("slim"), "value")
    first = text.groupBy("file").agg(F.min_by("value", "slim").alias("value"))
    lines = first.select("file", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    fail = {"mode": "FAILFAST"}
    sessions = lines.select("file", F.from_json(F.get("lines", F.lit(0)), S.SESSION, fail).alias("m")).select("file", "m.*")
    sessions = sessions.withColumns({"finalization_mode": F.coalesce("finalization_mode", F.lit("natural")), "finalize_supported": F.coalesce("finalize_supported", F.lit(True))})
    events = lines.select("file", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("seq", "line"))
    return sessions, events.select("file", "seq", F.from_json("line", S.EVENT, fail).alias("e")).select("file", "seq", "e.*")


def write_slim_traces(sessions: DataFrame, events: DataFrame, path: str) -> None:
    """A gzip JSON file set: sessions' and events' fields without raw messages and nulls, together and in order by file."""
    head = sessions.select("file", F.lit(-1).alias("seq"), F.to_json(F.struct(*[c for c in sessions.columns if c != "file"])).alias("value"))
    body = events.select("file", "seq", F.to_json(F.struct(*[c for c in events.columns if c not in ("file", "seq", "raw")])).alias("value"))
    together = head.unionByName(body).withColumn("name", F.regexp_extract("file", r"([^/]+?)(\.jsonl)?$", 1))
    together.repartition("name").sortWithinPartitions("name", "seq").select("name", "value").write.mode("overwrite").partitionBy("name").option("compression", "gzip").text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Terms in lower case; blank lines and comments go."""
    term = F.lower(F.trim("value"))
    return spark.read.text(path).select(term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def read_librispeech(spark: SparkSession, root: str) -> DataFrame:
    """Utterances of every ``*.trans.txt``; ``bad`` tells lines whose key isn't that of their folders."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(root).select(_file().alias("file"), "value").filter(F.trim("value") != "")
    key = F.regexp_extract("value", r"^(\d+-\d+-\d+) ", 1)
    part, speaker, chapter = (F.regexp_extract("file", r"/([^/]+)/([^/]+)/([^/]+)/[^/]+$", i) for i in (1, 2, 3))
    return lines.select(
        F.concat(F.lit("librispeech:"), key).alias("utt_id"), part.alias("subset"), speaker.alias("speaker_id"), F.concat_ws("/", F.lit("LibriSpeech"), part, speaker, chapter, F.concat(key, F.lit(".flac"))).alias("audio_path"),
        F.trim(F.regexp_replace("value", r"^\S+ ?", "")).alias("ref_text"), ((key == "") | ~F.startswith(key, F.concat_ws("-", speaker, chapter, F.lit("")))).alias("bad"),
    )


def read_common_voice(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a sentence; tabs separate and nothing quotes; the accent is of ``accents`` or, in older files, ``accent``."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", "true").option("inferSchema", "false").csv(path)
    missing = {"client_id", "path", "sentence"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    clean = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    accents = [clean(c) for c in ("accents", "accent") if c in raw.columns]
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return raw.filter(F.trim(F.coalesce("sentence", F.lit(""))) != "").select(
        F.concat(F.lit("common_voice:"), stem).alias("utt_id"), F.col("client_id").alias("speaker_id"), F.col("path").alias("audio_path"), F.trim("sentence").alias("ref_text"), (F.coalesce(*accents) if accents else F.lit(None).cast("string")).alias("accent")
    )


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """(file, tier, index, xmin, xmax, text) of long-format TextGrids' interval tiers, UTF-8 or UTF-16."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.TextGrid").load(path)
    wide = F.expr("substr(content, 1, 2) in (X'FFFE', X'FEFF')")
    text = F.when(wide, F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    fine = F.contains(text, F.lit('Object class = "TextGrid"')) & F.contains(text, F.lit("item ["))
    text = F.when(fine, text).otherwise(F.raise_error(F.concat(F.lit("not a long TextGrid: "), F.col("path"))))
    tiers = files.select(F.col("path").alias("file"), F.explode(F.slice(F.split(text, r"item \[\d+\]:"), F.lit(2), F.size(F.split(text, r"item \[\d+\]:")) - 1)).alias("body"))
    quoted, number = r'"((?:[^"]|"")*)"', r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    pattern = rf"intervals \[(\d+)\]:\s*xmin = {number}\s*xmax = {number}\s*text = {quoted}"
    plain = lambda c: F.regexp_replace(c, '""', '"')
    found = tiers.filter(F.regexp_extract("body", r'class = "([^"]*)"', 1) == "IntervalTier").select(
        "file", plain(F.regexp_extract("body", f"name = {quoted}", 1)).alias("tier"), F.explode(F.regexp_extract_all("body", F.lit(pattern), 0)).alias("x")
    )
    group = lambda i: F.regexp_extract("x", pattern, i)
    return found.select("file", "tier", group(1).cast("int").alias("index"), group(2).cast("double").alias("xmin"), group(3).cast("double").alias("xmax"), plain(group(4)).alias("text"))


def consultation_manifest(intervals: DataFrame, corrections: dict[str, str]) -> DataFrame:
    """Utterances of consultations' TextGrids: whole-word corrections, and why an utterance can't be scored."""
    name = F.regexp_extract("file", r"([^/]+)_(doctor|patient)\.TextGrid$", 1)
    role = F.regexp_extract("file", r"_(doctor|patient)\.TextGrid$", 1)
    text, fixed = F.trim("text"), F.trim("text")
    for wrong, right in corrections.items():
        fixed = F.regexp_replace(fixed, rf"(?i)\b{wrong}\b", right)
    reason = F.when(F.contains(text, F.lit("<UNIN/>")), "unintelligible").when(F.contains(text, F.lit("<INAUDIBLE_SPEECH/>")), "inaudible").when(F.col("xmax") - F.col("xmin") < 0.3, "too_short")
    return intervals.filter(text != "").select(
        F.concat_ws(":", F.lit("primock57"), name, role, F.lpad(F.col("index").cast("string"), 4, "0")).alias("utt_id"), role.alias("subset"), F.concat_ws("_", name, role).alias("speaker_id"),
        F.col("xmin").alias("start_s"), F.col("xmax").alias("end_s"), fixed.alias("ref_text"), reason.alias("exclude_reason"), F.when(fixed != text, text).alias("ref_text_original"),
    )


def with_turns(utterances: DataFrame, turns: DataFrame | None) -> DataFrame:
    """``complete`` from the sidecar of turns; without one, or without a row, turns are complete."""
    if turns is None:
        return utterances.withColumn("complete", F.lit(True))
    return utterances.join(turns.select("utt_id", "complete"), "utt_id", "left").withColumn("complete", F.coalesce("complete", F.lit(True)))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def key_term_violations(terms: DataFrame, most: int, longest: int, most_words: int | None = None, banned: str = "") -> DataFrame:
    """(config_id, rule) of lists of ``keyterms`` that a provider would refuse."""
    t = F.col("keyterms")
    rules = {"too_many": F.size(t) > most, "too_long": F.exists(t, lambda x: F.length(x) > longest)}
    if most_words:
        rules["too_many_words"] = F.exists(t, lambda x: F.size(F.split(F.trim(x), r"\s+")) > most_words)
    if banned:
        rules["banned_character"] = F.exists(t, lambda x: F.length(F.translate(x, banned, "")) < F.length(x))
    return S.violations(terms, rules, key="config_id", unique=False)


def read_yaml_rows(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """The list under ``key`` of a small YAML text as rows; unknown fields are refused."""
    import yaml

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    rows = (yaml.safe_load(text) or {}).get(key) or []
    odd = sorted({k for r in rows for k in r} - set(names))
    if odd:
        raise ValueError(f"unknown fields: {odd}")
    return spark.createDataFrame(pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None).values.tolist(), schema)
