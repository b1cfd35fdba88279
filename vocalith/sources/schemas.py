"""Read schemas of the engine's files, and the rules that their rows keep."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANIFEST = (
    "utt_id STRING, dataset STRING, subset STRING, speaker_id STRING, audio_path STRING, channel INT, start_s DOUBLE, end_s DOUBLE, ref_text STRING, "
    "sample_rate INT, license STRING, synthetic BOOLEAN, augmentation ARRAY<STRUCT<kind: STRING, params: STRING, seed: BIGINT>>, parent_utt_id STRING, "
    "exclude_reason STRING, language STRING, ref_text_original STRING"
)
RUN = "run_id STRING, config_id STRING, provider STRING, model_id STRING, mode STRING, settings STRING, created_at TIMESTAMP, git_sha STRING, manifest STRING, keyterms ARRAY<STRING>, sample STRING"
RESULT = "run_id STRING, config_id STRING, utt_id STRING, hyp_text STRING, raw_response_path STRING, started_at TIMESTAMP, finished_at TIMESTAMP, error STRING, suspect_empty BOOLEAN"
SESSION = "config_id STRING, utt_id STRING, chunk_ms DOUBLE, finalization_mode STRING, finalize_supported BOOLEAN, speech_start_ms DOUBLE, speech_end_ms DOUBLE, rtt_ms DOUBLE"
WORDS = "ARRAY<STRUCT<text: STRING, start_ms: DOUBLE, end_ms: DOUBLE>>"
EVENT = f"kind STRING, t_ns BIGINT, chunk_index INT, audio_offset_ms DOUBLE, text STRING, words {WORDS}"
SPEECH = "utt_id STRING, speech_start_ms INT, speech_end_ms INT, clip_ms INT, coverage DOUBLE, flags ARRAY<STRING>, vad_id STRING"
TURN = "utt_id STRING, complete BOOLEAN"

_c = F.col


def _rules(**rules: Column) -> Mapping[str, Column]:
    return rules


def manifest_rules() -> Mapping[str, Column]:
    return _rules(
        id_missing=_c("utt_id").isNull() | (_c("utt_id") == ""),
        path_not_relative_posix=_c("audio_path").isNotNull() & (_c("audio_path").startswith("/") | _c("audio_path").contains("\\") | _c("audio_path").rlike(r"(^|/)\.\.(/|$)|^[A-Za-z]:")),
        one_bound_only=_c("start_s").isNull() != _c("end_s").isNull(),
        augmented_without_parent=(F.coalesce(F.size("augmentation"), F.lit(0)) > 0) != _c("parent_utt_id").isNotNull(),
        correction_changes_nothing=_c("ref_text_original").isNotNull() & (_c("ref_text_original") == _c("ref_text")),
    )


def result_rules() -> Mapping[str, Column]:
    return _rules(
        failed_with_text=_c("error").isNotNull() & (F.coalesce("hyp_text", F.lit("")) != ""),
        suspect_not_empty=F.coalesce("suspect_empty", F.lit(False)) & (_c("error").isNotNull() | (F.trim(F.coalesce("hyp_text", F.lit(""))) != "")),
        finished_before_start=_c("finished_at") < _c("started_at"),
    )


def event_rules() -> Mapping[str, Column]:
    w = Window.partitionBy("file").orderBy("seq")
    sent = Window.partitionBy("file", "kind").orderBy("seq")
    return _rules(
        audio_without_offset=(_c("kind") == "audio_sent") & (_c("chunk_index").isNull() | _c("audio_offset_ms").isNull()),
        transcript_without_text=_c("kind").isin("partial", "final") & _c("text").isNull(),
        unordered=_c("t_ns") < F.lag("t_ns").over(w),
        offsets_not_rising=(_c("kind") == "audio_sent") & (_c("audio_offset_ms") <= F.lag("audio_offset_ms").over(sent)),
    )


def violations(df: DataFrame, rules: Mapping[str, Column], key: str = "utt_id", unique: bool = True) -> DataFrame:
    """(key, rule) for each rule that a row breaks; repeated keys break ``duplicate``. One pass, and one shuffle if unique."""
    tests = dict(rules)
    if unique:
        tests["duplicate"] = F.count("*").over(Window.partitionBy(key)) > 1
    checked = df.select(_c(key), *[t.alias(f"_{name}") for name, t in tests.items()])
    broken = F.array_compact(F.array(*[F.when(_c(f"_{name}"), F.lit(name)) for name in tests]))
    return checked.select(key, F.explode(broken).alias("rule"))


def unknown_fields(lines: DataFrame, schema_names: list[str]) -> DataFrame:
    """(file, field) of JSON lines whose fields the schema lacks: Spark's reader would ignore them silently."""
    keys = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, schema_names)))
    return lines.select(_c("_metadata.file_path").alias("file"), F.explode(keys).alias("field")).distinct()
