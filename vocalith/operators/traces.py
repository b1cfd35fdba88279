"""What sessions' traces say about latency and endpoints: one shuffle by session, all in built-in expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.sources.files import trace_name

#: How far a last word may end after the true end of speech, and when an endpoint is late.
TOLERANCE_MS, LATE_MS = 300.0, 3000.0


def _anchored(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Events beside their session and the times at which the audio of speech's start and end was sent."""
    e = sessions.join(events.filter(F.col("kind").isNotNull()), "file", "left")
    w = Window.partitionBy("file")

    def sent(x: str) -> Column:
        inside = (F.col("kind") == "audio_sent") & (F.col("audio_offset_ms") <= F.col(x)) & (F.col(x) < F.col("audio_offset_ms") + F.col("chunk_ms"))
        return F.min_by("t_ns", F.when(inside, F.col("seq"))).over(w)

    audio = F.min_by("t_ns", F.when(F.col("kind") == "audio_sent", F.col("seq"))).over(w)
    finalize = F.min_by("t_ns", F.when(F.col("kind") == "finalize_sent", F.col("seq"))).over(w)
    return e.withColumns({"onset": F.when(F.col("speech_start_ms").isNotNull(), sent("speech_start_ms")).otherwise(audio), "speech_end": sent("speech_end_ms"), "finalize": finalize})


def _kind(k: str, after: str | None = None) -> Column:
    hit = F.col("kind") == k
    return hit & (F.col("t_ns") >= F.col(after)) if after else hit


def session_latency(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(file, config_id, utt_id, metric, status, value_ms, basis, premature): five rows a session.

    Sessions without events are missing their anchors. A last word's arrival may precede the anchor, so its time may be
    negative; without word times, the last final from the anchor on counts.
    """
    ends = F.transform(F.filter("words", lambda w: w.end_ms <= F.col("speech_end_ms") + TOLERANCE_MS), lambda w: w.end_ms)
    first = lambda cond, x="t_ns": F.min(F.when(cond, F.col(x)))
    g = _anchored(sessions, events).withColumn("last_word", F.when(_kind("final"), F.array_max(ends)))
    g = g.groupBy("file").agg(
        *[F.first(c).alias(c) for c in ("config_id", "utt_id", "finalization_mode", "finalize_supported", "onset", "speech_end", "finalize")],
        first(_kind("connect_start")).alias("start"), first(_kind("connect_ready")).alias("ready"), first(_kind("partial", "onset")).alias("partial"),
        F.max(F.when(F.col("last_word").isNotNull(), F.struct("last_word", (-F.col("t_ns")).alias("t")))).alias("word"),
        F.max(F.when(_kind("final", "speech_end"), F.col("t_ns"))).alias("final"), first(_kind("final", "finalize")).alias("reply"),
        first(_kind("endpoint", "speech_end")).alias("endpoint"), F.count_if(_kind("endpoint") & (F.col("t_ns") < F.col("speech_end"))).alias("premature"),
    )
    forced, no_end = F.col("finalization_mode") == "forced", F.col("speech_end").isNull()

    def metric(name: str, value: Column, basis: Column | None = None, *otherwise: tuple[Column, str]) -> Column:
        status = F.when(value.isNotNull(), "ok").otherwise("timeout")
        for cond, word in reversed(otherwise):
            status = F.when(cond, word).otherwise(status)
        return F.struct(F.lit(name).alias("metric"), status.alias("status"), F.when(status == "ok", value / 1e6).alias("value_ms"), F.when(status == "ok", basis if basis is not None else F.lit(None)).cast("string").alias("basis"))

    arrival = F.coalesce(-F.col("word.t"), F.col("final"))
    metrics = F.array(
        metric("setup", F.col("ready") - F.col("start")),
        metric("first_partial", F.col("partial") - F.col("onset"), None, (F.col("onset").isNull(), "missing_ground_truth")),
        metric("ttfs", arrival - F.col("speech_end"), F.when(F.col("word").isNotNull(), "word_timestamps").otherwise("last_final"), (no_end, "missing_ground_truth")),
        metric("finalize", F.col("reply") - F.col("finalize"), None, (~forced, "not_applicable"), (~F.col("finalize_supported"), "not_supported")),
        metric("endpoint", F.col("endpoint") - F.col("speech_end"), None, (no_end, "missing_ground_truth"), (F.col("finalization_mode") != "natural", "not_applicable")),
    )
    return g.select("file", "config_id", "utt_id", F.inline(metrics), "premature")


def endpoint_outcomes(sessions: DataFrame, events: DataFrame, late_ms: float = LATE_MS) -> DataFrame:
    """(file, utt_id, outcome, delay_ms, premature): sessions whose turn isn't ``complete`` should see no endpoint."""
    if "complete" not in sessions.columns:
        sessions = sessions.withColumn("complete", F.lit(True))
    ended = _kind("endpoint")
    g = _anchored(sessions, events).groupBy("file").agg(
        *[F.first(c).alias(c) for c in ("utt_id", "finalization_mode", "complete", "speech_end")], F.count_if(ended).alias("all"),
        F.count_if(ended & (F.col("t_ns") < F.col("speech_end"))).alias("early"), F.min(F.when(_kind("endpoint", "speech_end"), F.col("t_ns"))).alias("at"),
    )
    whole = F.coalesce("complete", F.lit(True))
    delay = (F.col("at") - F.col("speech_end")) / 1e6
    outcome = (
        F.when(F.col("finalization_mode") != "natural", "unscorable").when(~whole & (F.col("all") > 0), "premature").when(~whole, "correct")
        .when(F.col("speech_end").isNull(), "unscorable").when(F.col("early") > 0, "premature").when(delay <= late_ms, "correct").otherwise("late")
    )
    early = F.when(outcome != "premature", 0).when(whole, F.col("early")).otherwise(F.col("all"))
    return g.select("file", "utt_id", outcome.alias("outcome"), F.when((outcome == "correct") & whole, delay).alias("delay_ms"), early.cast("bigint").alias("premature"))


def transcripts(events: DataFrame) -> DataFrame:
    """(file, text): finals joined by blanks, in order."""
    finals = F.array_sort(F.collect_list(F.when((F.col("kind") == "final") & (F.col("text") != ""), F.struct("seq", "text"))))
    return events.groupBy("file").agg(F.array_join(F.transform(finals, lambda x: x.text), " ").alias("text"))


#: Fixed value: characters of a provider's error that are kept.
ERROR_CHARS = 500


def sorted_json(raw: Column) -> Column:
    """JSON objects with their fields in order of their names, at every depth; other texts as they are."""

    @F.pandas_udf("string")
    def run(some: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                found = json.loads(t) if t else t
            except ValueError:
                return t
            return json.dumps(found, sort_keys=True) if isinstance(found, (dict, list)) else t

        return some.map(one, na_action="ignore")

    return run.asNondeterministic()(raw)  # a stage of its own, on errors alone


def result_rows(sessions: DataFrame, events: DataFrame, run_id: str, refs: DataFrame) -> DataFrame:
    """Rows of a run (``schemas.RESULT`` without times) of sessions' traces: a session with a provider's error has failed, its first one is told and no text is kept.

    ``events`` have ``raw``; ``refs`` (utt_id, ref_text) tell which empty texts are suspect: those of utterances with words. Sessions without events have an empty text.
    """
    first = events.where("kind = 'error'").groupBy("file").agg(F.min_by("raw", "seq").alias("raw"))
    told = first.select("file", F.concat(F.lit("ProviderError: "), F.substring(F.coalesce(sorted_json(F.col("raw")), F.lit("")), 1, ERROR_CHARS)).alias("error"))
    rows = sessions.select("file", "config_id", "utt_id").join(transcripts(events), "file", "left").join(told, "file", "left").join(refs.select("utt_id", "ref_text"), "utt_id", "left")
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise("")
    suspect = F.col("error").isNull() & (F.trim(text) == "") & (F.trim(F.coalesce("ref_text", F.lit(""))) != "")
    return rows.select(F.lit(run_id).alias("run_id"), "config_id", "utt_id", text.alias("hyp_text"), F.concat(F.lit("traces/"), trace_name(F.col("utt_id"))).alias("raw_response_path"), "error", suspect.alias("suspect_empty"))
