"""Providers' batch answers as result rows, in column expressions: whoever sends requests stores (provider, status, body) a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT = "run_id STRING, config_id STRING, utt_id STRING, provider STRING, attempt INT, status INT, body STRING"
# Status codes of failures that may pass.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers, a JSON line each; malformed lines fail the query."""
    return spark.read.schema(INPUT).option("mode", "FAILFAST").json(path)


def _outcome(provider: Column, status: Column, body: Column) -> tuple[Column, Column, Column]:
    """(text, error, retry) of an answer: its text has a place of its own for each provider, and an answer without it is an error."""
    get = lambda path: F.get_json_object(body, path)
    polled, state = provider == "assemblyai", get("$.status")
    text = F.when(provider == "deepgram", get("$.results.channels[0].alternatives[0].transcript")).when(polled & (state == "completed"), F.coalesce(get("$.text"), F.lit(""))).when(provider == "elevenlabs", get("$.text"))
    fine, waiting = F.coalesce(status.between(200, 299), F.lit(False)), polled & F.coalesce(state.isin("queued", "processing"), F.lit(False))
    why = F.when(status.isNull(), "no answer").when(~fine, F.concat(F.lit("HTTP "), status.cast("string"))).when(waiting, "not done")
    why = why.when(polled & (state == "error"), F.concat(F.lit("failed: "), F.coalesce(get("$.error"), F.lit("")))).when(text.isNull(), "unexpected response shape")
    error = F.when(why.isNotNull(), F.concat(provider, F.lit(": "), why))
    return F.when(error.isNull(), text), error, status.isNull() | status.isin(*RETRYABLE) | (fine & waiting)


def results(answers: DataFrame) -> DataFrame:
    """(run_id, config_id, utt_id, hyp_text, error, suspect_empty, attempts, retry): of each utterance's attempts the last one; failed ones have an empty text.

    ``retry`` tells failures that may pass, for a next round of requests.
    """
    text, error, retry = _outcome(F.col("provider"), F.col("status"), F.col("body"))
    last = answers.groupBy("run_id", "config_id", "utt_id").agg(F.max_by(F.struct("provider", "status", "body"), "attempt").alias("a"), F.count(F.lit(1)).alias("attempts")).select("run_id", "config_id", "utt_id", "attempts", "a.*")
    done = last.select("run_id", "config_id", "utt_id", F.coalesce(text, F.lit("")).alias("hyp_text"), error.alias("error"), "attempts", (error.isNotNull() & F.coalesce(retry, F.lit(False))).alias("retry"))
    return done.withColumn("suspect_empty", F.col("error").isNull() & (F.trim("hyp_text") == ""))


def to_retry(done: DataFrame, most: int, first_s: float = 1.0, longest_s: float = 60.0) -> DataFrame:
    """(run_id, config_id, utt_id, wait_s): what to ask again, after waits that double up to ``longest_s``; nothing after ``most`` attempts."""
    wait = F.least(F.lit(float(longest_s)), F.lit(float(first_s)) * F.pow(F.lit(2.0), F.col("attempts") - 1))
    return done.where(F.col("retry") & (F.col("attempts") < most)).select("run_id", "config_id", "utt_id", wait.alias("wait_s"))
