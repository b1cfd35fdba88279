"""Queries over the operators that need more than one SQL text: (spark, folder of tables) -> DataFrame, with oracles where SQL has them.

As in ``evaluation``, views of the tables at hand stand in for speech data: each user's events are a session's messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.functions.audio import mulaw_level, sample_bytes, sample_values, wav_bytes, wav_clip
from vocalith.functions.columns import bound
from vocalith.functions.text import RULES, normalised
from vocalith.functions.tokens import digit_join, digit_one, spoken_dates, with_normalised
from vocalith.operators.alignment import alignment, difference, key_term_insertions
from vocalith.operators.entities import Category, outcomes, summary, tagged
from vocalith.operators.scripts import check, expanded
from vocalith.operators.traces import endpoint_outcomes, session_latency
from vocalith.plans.dialect import Duck, DuckWords, Spark
from vocalith.operators.resampling import drawn, exact_percentiles, intervals, numbered, weighted_percentiles
from vocalith.plans.evaluation import DRAWS, _formatted, hyps, latency_by_draws, latency_values, scores
from vocalith.plans.suites import PROFILE, SUITE, match
from vocalith.sources.files import shared_folder
from vocalith.sources.providers import read_answers, stream_messages
from vocalith.sources.responses import results
from vocalith.sources.runs import merge, rows_of
from vocalith.sources.schemas import manifest_rules, violations
from vocalith.streaming.messages import STORE, batch_events, stream_events

CATEGORIES = [*(Category(n, builtin=n) for n in ("number", "phone", "date", "dosage", "duration")), Category("licence", terms=("license", "apache license", "all rights reserved")), Category("address", pattern=r"\S+ at \S+")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over all tasks, whatever row groups their file has."""
    return _table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.sql(hyps(Spark(sf_dir, spark))).select("utt_id", "subset", "sys", F.col("toks").alias("ref"), "hyp")
    return h.withColumn("a", alignment("ref", "hyp"))


def alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UDF's counts; their sum is the built-in distance, which is what the oracle has."""
    a = _aligned(spark, sf_dir)
    return a.select("utt_id", "sys", (F.col("a.hits") + F.col("a.substitutions") + F.col("a.deletions")).cast("bigint").alias("n_ref"), (F.col("a.hits") + F.col("a.substitutions") + F.col("a.insertions")).cast("bigint").alias("n_hyp"), (F.col("a.substitutions") + F.col("a.deletions") + F.col("a.insertions")).cast("bigint").alias("errors"))


def alignment_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("utt_id", "sys", difference(F.col("a.chunks"), F.col("ref"), F.col("hyp")).alias("diff"))


def false_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of key terms in hypotheses that no reference word matches."""
    terms = F.array(*[F.array(*map(F.lit, t.split())) for t in ("zz", "zz zz")])
    found = _aligned(spark, sf_dir).select("sys", F.explode(key_term_insertions(F.col("a.chunks"), F.col("hyp"), terms)).alias("t"))
    return found.groupBy("sys", "t.term").agg(F.sum("t.n").alias("n"))


def normalised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", normalised(F.col("text")).alias("text"))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_documents(spark, sf_dir).select("doc_id", F.inline(tagged(F.col("text"), CATEGORIES)))


def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents against themselves with every number word gone astray: recall, character errors, formatting."""
    d = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("raw_hyp"), F.split(normalised(F.col("text")), " ").alias("ref"))
    d = d.withColumn("hyp", F.transform("ref", lambda x: F.when(F.pmod(F.xxhash64(x), F.lit(7)) == 0, F.concat(x, F.lit("0"))).otherwise(x)))
    d = d.withColumn("chunks", alignment("ref", "hyp").chunks)
    return summary(outcomes(d, CATEGORIES, ["doc_id"]))


def mulaw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.pmod(F.floor("value").cast("bigint"), F.lit(256))
    return _table(spark, sf_dir, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n")).select("code", "n", mulaw_level(F.col("code")).cast("bigint").alias("level"))


MULAW_SQL = """SELECT code, n, cast(CASE WHEN code < 128 THEN -1 ELSE 1 END * (((((255 - code) & 15) * 8 + 132) * (1 << cast(((255 - code) >> 4) & 7 AS INT))) - 132) AS BIGINT) AS level
FROM (SELECT cast(floor(value) AS BIGINT) % 256 AS code, count(*) AS n FROM events GROUP BY 1) c"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    turn = F.to_json(F.struct(F.lit("Turn").alias("type"), (k % 3).alias("turn_order"), F.col("event_type").isin("purchase", "view").alias("end_of_turn"), (F.col("event_type") == "purchase").alias("turn_is_formatted"), F.col("event_type").alias("transcript")))
    message = F.when(F.col("event_type") == "error", '{"type": "SpeechStarted"}').otherwise(turn)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), seq.cast("bigint").alias("seq"), (F.expr(Spark(sf_dir).us("ts")) * 1000).alias("t_ns"),
        F.lit("assemblyai").alias("provider"), message.alias("message"), F.lit(None).cast("string").alias("sent"),
    )


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_events(_messages(spark, sf_dir)).select("session", "seq", F.col("part").cast("bigint").alias("part"), "kind", "text")


PROVIDER_SQL = """WITH e AS (SELECT cast(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS t, cast(json_extract_string(props, '$.k') AS INT) % 3 AS k FROM events),
f AS (SELECT *, t IN ('purchase', 'view') AS ends, t = 'purchase' AS fin, t = 'error' AS vad FROM e),
g AS (SELECT *, coalesce(max(CASE WHEN ends THEN 1 END) OVER w, 0) AS ended, coalesce(max(CASE WHEN fin THEN 1 END) OVER w, 0) AS done FROM f WINDOW w AS (PARTITION BY session, CASE WHEN vad THEN -1 ELSE k END ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT session, seq, unnest(CASE WHEN vad THEN [{'kind': 'vad_event', 'text': NULL}] WHEN NOT ends THEN [{'kind': 'partial', 'text': t}] ELSE
  list_concat(list_concat(CASE WHEN fin AND done = 0 THEN [{'kind': 'final', 'text': t}] ELSE [] END, CASE WHEN ended = 0 THEN [{'kind': 'endpoint', 'text': NULL}] ELSE [] END),
  CASE WHEN NOT fin AND done = 0 THEN [{'kind': 'partial', 'text': t}] WHEN ended = 1 AND done = 1 THEN [{'kind': 'info', 'text': NULL}] ELSE [] END) END) AS x, 
  generate_subscripts(CASE WHEN vad OR NOT ends THEN [1] ELSE list_concat(list_concat(CASE WHEN fin AND done = 0 THEN [1] ELSE [] END, CASE WHEN ended = 0 THEN [1] ELSE [] END), CASE WHEN NOT fin AND done = 0 THEN [1] WHEN ended = 1 AND done = 1 THEN [1] ELSE [] END) END, 1) - 1 AS part FROM g)
SELECT session, seq, cast(part AS BIGINT) AS part, x.kind AS kind, x.text AS text FROM h"""


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of 100 ms chunks, one a click; speech from 50 ms to 250 ms of the audio. Every third session is forced to finalize, every sixth can't
    be, every fifth has a turn that isn't complete, every other one has word times; a first signup begins to connect, a later one is ready, and of errors
    every other one asks for the final."""
    e = _table(spark, sf_dir, "events").select("user_id", F.col("user_id").cast("string").alias("file"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("file", "event_type").orderBy("seq")))
    t, k, audio = F.col("event_type"), F.col("k"), F.col("event_type") == "click"
    kind = (
        F.when((t == "signup") & (k == 1), "connect_start").when(t == "signup", "connect_ready").when(audio, "audio_sent").when(t == "purchase", "final").when(t == "view", "endpoint")
        .when((t == "error") & (k % 2 == 1), "partial").when(t == "error", "finalize_sent")
    )
    word = F.array(F.struct(t.alias("text"), (k * 90.0 - 50.0).alias("start_ms"), (k * 90.0).alias("end_ms")))
    events = e.select("file", "seq", kind.alias("kind"), (F.col("seq") * 20_000_000).cast("bigint").alias("t_ns"), F.when(audio, k - 1).alias("chunk_index"), F.when(audio, (k - 1) * 100.0).alias("audio_offset_ms"), t.alias("text"), F.when((t == "purchase") & (F.col("user_id") % 2 == 0), word).alias("words"))
    u = F.col("user_id")
    sessions = e.groupBy("file", "user_id").agg(F.lit("c").alias("config_id")).select(
        "file", "config_id", F.col("file").alias("utt_id"), F.lit(100.0).alias("chunk_ms"), F.when(u % 3 == 0, "forced").otherwise("natural").alias("finalization_mode"), (u % 6 != 3).alias("finalize_supported"),
        F.lit(50.0).alias("speech_start_ms"), F.lit(250.0).alias("speech_end_ms"), (u % 5 != 0).alias("complete"),
    )
    return sessions, events


def trace_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_latency(*_traces(spark, sf_dir)).select("file", "metric", "status", "value_ms", "basis", "premature")


_SESSIONS_SQL = """e AS (SELECT user_id AS u, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
c AS (SELECT *, seq * 20e0 AS ms, row_number() OVER (PARTITION BY u, t ORDER BY seq) AS k FROM e),
a AS (SELECT *, min(CASE WHEN t = 'click' AND k = 1 THEN ms END) OVER (PARTITION BY u) AS onset, min(CASE WHEN t = 'click' AND k = 3 THEN ms END) OVER (PARTITION BY u) AS stop, min(CASE WHEN t = 'error' AND k = 2 THEN ms END) OVER (PARTITION BY u) AS ask FROM c)"""
TRACE_SQL = f"""WITH {_SESSIONS_SQL},
s AS (SELECT u, u % 3 = 0 AS forced, u % 6 <> 3 AS able, min(onset) AS onset, min(stop) AS stop, min(CASE WHEN t = 'signup' AND k = 1 THEN ms END) AS start, min(CASE WHEN t = 'signup' AND k = 2 THEN ms END) AS ready,
  min(CASE WHEN t = 'error' AND k % 2 = 1 AND ms >= onset THEN ms END) AS partial, max(CASE WHEN t = 'purchase' AND ms >= stop THEN ms END) AS final, max(CASE WHEN u % 2 = 0 AND t = 'purchase' AND k <= 6 THEN ms END) AS word,
  min(CASE WHEN t = 'purchase' AND ms >= ask THEN ms END) AS reply, min(ask) AS ask, min(CASE WHEN t = 'view' AND ms >= stop THEN ms END) AS ep, count_if(t = 'view' AND ms < stop) AS premature FROM a GROUP BY u),
m AS (SELECT u, premature, 'setup' AS metric, CASE WHEN ready - start IS NULL THEN 'timeout' ELSE 'ok' END AS status, ready - start AS v, NULL AS basis FROM s
UNION ALL SELECT u, premature, 'first_partial', CASE WHEN onset IS NULL THEN 'missing_ground_truth' WHEN partial IS NULL THEN 'timeout' ELSE 'ok' END, partial - onset, NULL FROM s
UNION ALL SELECT u, premature, 'ttfs', CASE WHEN stop IS NULL THEN 'missing_ground_truth' WHEN coalesce(word, final) IS NULL THEN 'timeout' ELSE 'ok' END, coalesce(word, final) - stop, CASE WHEN word IS NOT NULL THEN 'word_timestamps' ELSE 'last_final' END FROM s
UNION ALL SELECT u, premature, 'finalize', CASE WHEN NOT forced THEN 'not_applicable' WHEN NOT able THEN 'not_supported' WHEN reply IS NULL THEN 'timeout' ELSE 'ok' END, reply - ask, NULL FROM s
UNION ALL SELECT u, premature, 'endpoint', CASE WHEN stop IS NULL THEN 'missing_ground_truth' WHEN forced THEN 'not_applicable' WHEN ep IS NULL THEN 'timeout' ELSE 'ok' END, ep - stop, NULL FROM s)
SELECT cast(u AS VARCHAR) AS file, metric, status, CASE WHEN status = 'ok' THEN v END AS value_ms, CASE WHEN status = 'ok' THEN basis END AS basis, cast(premature AS BIGINT) AS premature FROM m"""


def trace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoint_outcomes(*_traces(spark, sf_dir), late_ms=100.0).groupBy("outcome").agg(F.count("*").alias("n"), F.avg("delay_ms").alias("mean_delay"), F.sum("premature").alias("premature"))


OUTCOME_SQL = f"""WITH {_SESSIONS_SQL},
s AS (SELECT u, min(stop) AS stop, min(CASE WHEN t = 'view' AND ms >= stop THEN ms END) - min(stop) AS d, count_if(t = 'view' AND ms < stop) AS early, count_if(t = 'view') AS every FROM a GROUP BY u),
o AS (SELECT *, CASE WHEN u % 3 = 0 THEN 'unscorable' WHEN u % 5 = 0 AND every > 0 THEN 'premature' WHEN u % 5 = 0 THEN 'correct' WHEN stop IS NULL THEN 'unscorable' WHEN early > 0 THEN 'premature' WHEN d <= 100 THEN 'correct' ELSE 'late' END AS outcome FROM s)
SELECT outcome, count(*) AS n, avg(CASE WHEN outcome = 'correct' AND u % 5 <> 0 THEN d END) AS mean_delay, cast(sum(CASE WHEN outcome <> 'premature' THEN 0 WHEN u % 5 = 0 THEN every ELSE early END) AS BIGINT) AS premature FROM o GROUP BY outcome"""


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that pages break as a manifest: their urls as audio paths, their hosts as keys."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    none = lambda t: F.lit(None).cast(t)
    m = _table(spark, sf_dir, "pages").select(
        F.coalesce(host, F.lit("")).alias("utt_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("audio_path"), none("double").alias("start_s"), F.when(F.col("page_id") == 0, 1.0).alias("end_s"),
        none("array<string>").alias("augmentation"), none("string").alias("parent_utt_id"), none("string").alias("ref_text"), none("string").alias("ref_text_original"),
    )
    return violations(m, manifest_rules()).groupBy("rule").agg(F.count("*").alias("n"))


MANIFEST_SQL = r"""WITH m AS (SELECT coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS id, regexp_replace(url, '^[a-z]+://', '') AS p, page_id FROM pages),
r AS (SELECT id, p, page_id, count(*) OVER (PARTITION BY id) AS n FROM m)
SELECT rule, n FROM (SELECT 'id_missing' AS rule, count_if(id = '') AS n FROM r UNION ALL SELECT 'path_not_relative_posix', count_if(p IS NOT NULL AND (starts_with(p, '/') OR contains(p, '\') OR regexp_matches(p, '(^|/)\.\.(/|$)|^[A-Za-z]:'))) FROM r
UNION ALL SELECT 'one_bound_only', count_if(page_id = 0) FROM r UNION ALL SELECT 'duplicate', count_if(n > 1) FROM r) x WHERE n > 0"""


def suite_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's customers as a profile, against three suites."""
    suites = spark.createDataFrame([("calls", ["phone"], ["en"], ["phone", "number"]), ("clinic", ["microphone"], ["en", "de"], ["medication", "dosage"]), ("mixed", ["phone", "microphone"], ["en", "fr"], ["number"])], SUITE)
    n = _table(spark, sf_dir, "nation")
    profiles = n.select(
        F.col("n_name").alias("profile_id"), F.when(F.col("n_regionkey") < 2, "phone").otherwise("microphone").alias("channel"), F.array(F.when(F.col("n_nationkey") > 9, "de-AT").otherwise("fr"), F.lit("en-GB")).alias("languages"),
        F.array(F.lit("number"), F.lit("dosage")).alias("entities"), F.lit(None).cast("string").alias("reference_suite"),
    )
    assert set(profiles.columns) == {f.split()[0] for f in PROFILE.split(", ")}
    return match(profiles, suites).select("profile_id", "suite_id", "proxy", F.array_join("missing", ",").alias("missing"), F.array_join("covered", ",").alias("covered"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, provider, k, final, body): an answer of one of three providers for each turn of conversations, with its whole text."""
    c = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("utt_id"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    k, text = F.col("k"), F.col("text")
    state = F.when(k % 5 == 0, "error").when(k % 5 == 1, "processing").otherwise("completed")
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(text.alias("transcript"))).alias("alternatives"))).alias("channels")).alias("results")))
    polled = F.to_json(F.struct(state.alias("status"), F.lit("bad").alias("error"), text.alias("text")))
    body = F.when(k % 3 == 0, deep).when(k % 3 == 1, polled).otherwise(F.when(k % 7 == 0, "{}").otherwise(F.to_json(F.struct("text"))))
    provider = F.element_at(F.array(*map(F.lit, ("deepgram", "assemblyai", "elevenlabs"))), (k % 3 + 1).cast("int"))
    return c.select("utt_id", provider.alias("provider"), "k", F.when(k % 11 == 0, 503).when(k % 11 == 1, 401).otherwise(200).cast("int").alias("final"), body.alias("body"))


def batch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers of three providers as result rows; and what is to be asked again."""
    attempts = F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    answers = _bodies(spark, sf_dir).select(F.lit("r").alias("run_id"), F.lit("c").alias("config_id"), "utt_id", "provider", attempts.alias("attempt"), F.col("final").alias("status"), "body")
    return results(answers).select("utt_id", "hyp_text", "error", "suspect_empty", "attempts", "retry")


def answered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers, asked for by the data source from requests of four runs: every fourth request fails once before its answer comes."""
    first = F.when(F.col("k") % 4 == 0, F.array(F.struct(F.lit(503).alias("status"), F.lit("busy").alias("body")))).otherwise(F.array().cast("array<struct<status:int,body:string>>"))
    requests = _bodies(spark, sf_dir).select(
        F.concat(F.lit("r"), (F.col("k") % 4).cast("string")).alias("run"), F.lit("c").alias("config_id"), "utt_id", "provider", F.concat(first, F.array(F.struct(F.col("final").alias("status"), "body"))).alias("answers")
    )
    folder = shared_folder(spark, "requests")
    requests.write.partitionBy("run").json(folder)
    return results(read_answers(spark, folder, attempts=3)).select("run_id", "utt_id", "hyp_text", "error", "suspect_empty", "attempts", "retry")


RESPONSES_SQL = """WITH c AS (SELECT conv_id || ':' || turn AS utt_id, conv_id * 31 + turn AS k, coalesce(text, '') AS t FROM conversations),
s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'deepgram' WHEN 1 THEN 'assemblyai' ELSE 'elevenlabs' END AS p FROM c),
e AS (SELECT *, CASE WHEN k % 11 = 0 THEN p || ': HTTP 503' WHEN k % 11 = 1 THEN p || ': HTTP 401' WHEN k % 3 = 1 AND k % 5 = 1 THEN p || ': not done' WHEN k % 3 = 1 AND k % 5 = 0 THEN p || ': failed: bad' WHEN k % 3 = 2 AND k % 7 = 0 THEN p || ': unexpected response shape' END AS error FROM s)
SELECT utt_id, CASE WHEN error IS NULL THEN t ELSE '' END AS hyp_text, error, error IS NULL AND trim(t) = '' AS suspect_empty, cast(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, error IS NOT NULL AND (k % 11 = 0 OR (k % 11 <> 1 AND k % 3 = 1 AND k % 5 = 1)) AS retry FROM e"""
ANSWERED_SQL = RESPONSES_SQL.replace("SELECT utt_id, CASE WHEN error", "SELECT 'run=r' || k % 4 AS run_id, utt_id, CASE WHEN error").replace("CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END", "CASE WHEN k % 11 = 0 THEN 3 WHEN k % 4 = 0 THEN 2 ELSE 1 END")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``provider_events`` from a stream: the messages as a log of eight shards in any order, read by the data source, in state message by message."""
    folder = shared_folder(spark, "messages")
    log = _messages(spark, sf_dir).withColumn("shard", F.pmod(F.xxhash64("session"), F.lit(8)))
    log.write.partitionBy("shard").json(f"{folder}/log")  # a task that has some of a shard's sessions appends a file of its own
    own = spark.newSession()  # what a stream needs is set for it alone
    for key, value in STORE.items():
        own.conf.set(key, value)
    events = stream_events(stream_messages(own, f"{folder}/log"), timeout_ms=None)
    query = events.select("session", "seq", F.col("part").cast("bigint").alias("part"), "kind", "text").writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("session STRING, seq BIGINT, part BIGINT, kind STRING, text STRING").parquet(f"{folder}/events")


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of conversations made in two goes, of which the second replaces what failed in the first."""
    c = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("utt_id"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)

    def rows(go: str, taken: Column, failed: Column) -> DataFrame:
        text, error = F.when(failed, "").otherwise(F.concat(F.lit(go), "utt_id")), F.when(failed, F.lit(f"{go}: HTTP 503"))
        times = [none(n, k) for n, k in (("raw_response_path", "string"), ("started_at", "timestamp"), ("finished_at", "timestamp"))]
        return c.where(taken).select(F.lit("r").alias("run_id"), F.lit("c").alias("config_id"), "utt_id", text.alias("hyp_text"), *times, error.alias("error"), F.lit(False).alias("suspect_empty"))

    k, root = F.col("k"), shared_folder(spark, "runs")
    meta = {"run_id": "r", "config_id": "c", "provider": "p", "model_id": "m", "mode": "batch", "settings": "{}"}
    merge(spark, root, meta, rows("a", k % 3 != 0, k % 5 == 0))
    merge(spark, root, meta, rows("b", k % 2 == 0, k % 7 == 0), retry_failed=True)
    return rows_of(spark, root, "r").select("utt_id", "hyp_text", "error")


RESUMED_SQL = """WITH c AS (SELECT conv_id || ':' || turn AS utt_id, conv_id * 31 + turn AS k FROM conversations),
g AS (SELECT utt_id, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'a' WHEN k % 2 = 0 THEN 'b' WHEN k % 3 <> 0 THEN 'a' END AS go, k FROM c)
SELECT utt_id, CASE WHEN failed THEN '' ELSE go || utt_id END AS hyp_text, CASE WHEN failed THEN go || ': HTTP 503' END AS error
FROM (SELECT *, CASE go WHEN 'a' THEN k % 5 = 0 ELSE k % 7 = 0 END AS failed FROM g WHERE go IS NOT NULL) x"""


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of sessions' latencies, a timeout being infinite, with intervals over resampled speakers; what was left out; and
    how much wider the median's interval is than one over resampled sessions. All values count as they are, and every resample draws as many sessions as there are."""
    folder = shared_folder(spark, "latency")
    spark.sql(latency_values(Spark(sf_dir))).write.parquet(f"{folder}/values")
    every = spark.read.schema("user_id BIGINT, cluster BIGINT, v DOUBLE").parquet(f"{folder}/values")
    values = every.where("v IS NOT NULL")
    speakers = drawn(numbered(values.select("cluster").distinct(), "cluster"), "8", DRAWS)
    wide = values.join(F.broadcast(speakers), "cluster").select(F.lit("wide").alias("kind"), "b", "v", "w")  # a few speakers' weights
    narrow = drawn(numbered(values.select("user_id", "v"), "user_id"), "9", DRAWS).select(F.lit("narrow").alias("kind"), "b", "v", "w")
    wide.union(narrow).write.parquet(f"{folder}/drawn")
    weighted = spark.read.schema("kind STRING, b INT, v DOUBLE, w BIGINT").parquet(f"{folder}/drawn")
    ends = intervals(weighted_percentiles(weighted, keys=["kind"]), keys=["kind"])
    other = ends.where("kind = 'narrow'").select(F.col("low50").alias("l"), F.col("high50").alias("h"))
    counts = every.agg(F.count_if(F.col("v") == float("inf")).alias("timeouts"), F.count_distinct(F.when(F.col("v").isNotNull(), F.col("cluster"))).alias("speakers"), F.count_if(F.col("v").isNull()).alias("excluded"))
    effect = F.when((F.col("high50") < float("inf")) & (F.col("h") < float("inf")) & (F.col("h") > F.col("l")), F.round((F.col("high50") - F.col("low50")) / (F.col("h") - F.col("l")), 8))
    one = exact_percentiles(values).crossJoin(counts).crossJoin(ends.where("kind = 'wide'")).crossJoin(other)  # a row each
    return one.select("n", "timeouts", "speakers", *[c for p in (50, 95, 99) for c in (f"p{p}", f"low{p}", f"high{p}")], effect.alias("cluster_effect"), "excluded")


LATENCY_SQL = latency_by_draws(Duck())


def standardiser_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two runs without each of the standardiser's rules, and the utterances that the rule helps or hurts.

    Each different text is standardised once for each of its forms before the base standardiser; all rules run in the JVM. The texts without each rule lie in
    one array, so that a pair stays one row; where a rule changes neither text, it takes over the pair's distance with all rules.
    """
    names = ("none", *RULES)
    f = spark.sql(_formatted(Spark(sf_dir, spark)))
    texts = f.select(F.col("ref_text").alias("t")).union(f.select("hyp_text")).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "t")
    folder = shared_folder(spark, "forms")
    with_normalised(texts, "t", "m", disable=[[], *[[r] for r in RULES]]).write.parquet(folder)
    forms = spark.read.schema("t STRING, m ARRAY<STRING>").parquet(folder)
    side = lambda n: forms.select(F.col("t").alias(f"{n}_text"), F.transform("m", lambda x: F.split(x, " ")).alias(n))
    code = lambda x, d: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(d, w) + 19968), 4, "0")), "UTF-16BE")), "")
    pair = lambda a, b: F.transform(F.array(F.array_distinct(F.concat(a, b))), lambda d: F.struct(F.size(a).alias("n"), F.levenshtein(code(a, d), code(b, d)).alias("e")))[0]
    rows = f.join(side("ref"), "ref_text").join(side("hyp"), "hyp_text")
    own = lambda r, h, whole: F.zip_with(r, h, lambda a, b: F.when((a == r[0]) & (b == h[0]), whole).otherwise(pair(a, b)))
    rows = rows.select("sys", bound(lambda r, h: bound(own, r, h, pair(r[0], h[0])), F.col("ref"), F.col("hyp")).alias("x"))
    each = rows.select("sys", F.col("x")[0]["e"].alias("e0"), F.posexplode("x").alias("i", "x"))
    e, e0 = F.col("x.e"), F.col("e0")
    found = each.groupBy("i", "sys").agg(F.sum(e).alias("errors"), F.sum("x.n").alias("n_ref"), F.count_if(e > e0).alias("helped"), F.count_if(e < e0).alias("hurt"), F.sum(F.greatest(e - e0, F.lit(0))).alias("removed"))
    return found.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias("rule"), "sys", "errors", "n_ref", "helped", "hurt", "removed")


def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that look at neighbours, over texts with days, months and groups of digits made of orders."""
    k, day = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, "one").otherwise((F.col("o_orderkey") % 34).cast("string"))
    year = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy"))
    groups = F.element_at(F.array(*map(F.lit, ("555 01 00", "5 5 5", "12 3", "one 5", "7 one", "one one 20", "1234567", "555 0100 x 9 9 9 9"))), (k % 8 + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("on"), day, F.when(k % 3 == 0, "of"), F.lower(F.date_format("o_orderdate", "MMMM")), year, F.when(k % 5 == 0, "one"), F.lit("call"), groups, F.when(k % 11 == 0, "may one"))
    joined = digit_join(F.array_join(digit_one(F.split(text, " ")), " "))
    return _table(spark, sf_dir, "orders").select("o_orderkey", spoken_dates(joined).alias("text"))


TOKEN_SQL = """WITH o AS (SELECT o_orderkey AS k, concat_ws(' ', 'on', CASE WHEN o_orderkey % 7 = 0 THEN 'one' ELSE cast(o_orderkey % 34 AS VARCHAR) END, CASE WHEN o_orderkey % 3 = 0 THEN 'of' END, lower(monthname(o_orderdate)), CASE WHEN o_orderkey % 2 = 0 THEN cast(year(o_orderdate) AS VARCHAR) END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'one' END, 'call', ['555 01 00', '5 5 5', '12 3', 'one 5', '7 one', 'one one 20', '1234567', '555 0100 x 9 9 9 9'][o_orderkey % 8 + 1], CASE WHEN o_orderkey % 11 = 0 THEN 'may one' END) AS t FROM orders),
w AS (SELECT k, unnest(string_split(t, ' ')) AS x, generate_subscripts(string_split(t, ' '), 1) AS i FROM o),
a AS (SELECT k, i, CASE WHEN x = 'one' AND (coalesce(regexp_full_match(lag(x) OVER v, '[0-9]+'), false) OR coalesce(regexp_full_match(lead(x) OVER v, '[0-9]+'), false)) THEN '1' ELSE x END AS x FROM w WINDOW v AS (PARTITION BY k ORDER BY i)),
b AS (SELECT *, regexp_full_match(x, '[0-9]+') AS dig FROM a), c AS (SELECT *, CASE WHEN dig THEN i - row_number() OVER (PARTITION BY k, dig ORDER BY i) ELSE -i END AS g FROM b),
d AS (SELECT *, count(*) OVER r AS n, sum(length(x)) OVER r AS len, max(length(x)) OVER r AS widest, min(i) OVER r AS first FROM c WINDOW r AS (PARTITION BY k, dig, g)),
e AS (SELECT k, CASE WHEN dig AND n > 1 AND (len >= 7 OR n >= 3 AND widest = 1) THEN first ELSE i END AS j, string_agg(x, '' ORDER BY i) AS x FROM d GROUP BY 1, 2),
m AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY j) AS j, x, x IN ('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december') AS mon, x IN ('march', 'may') AS word, x = 'one' OR regexp_full_match(x, '[1-9]|[12][0-9]|3[01]') AS day, regexp_full_match(x, '[0-9]{4}') AS yr FROM e),
p AS (SELECT *, CASE WHEN day AND lead(x) OVER v = 'of' AND lead(mon, 2) OVER v THEN 2 WHEN day AND lead(mon) OVER v AND (NOT lead(word) OVER v OR coalesce(lead(yr, 2) OVER v, false)) THEN 1 ELSE 0 END AS turn FROM m WINDOW v AS (PARTITION BY k ORDER BY j)),
q AS (SELECT *, coalesce(lag(turn) OVER v, 0) AS t1, coalesce(lag(turn, 2) OVER v, 0) AS t2 FROM p WINDOW v AS (PARTITION BY k ORDER BY j)),
r AS (SELECT k, x, mon, CASE WHEN turn > 0 THEN j + turn ELSE CASE WHEN t1 = 1 THEN j - 1 WHEN t2 = 2 THEN j - 2 ELSE j END END AS j FROM q WHERE NOT (t1 = 2)),
s AS (SELECT k, j, CASE WHEN x = 'one' AND coalesce(lag(mon) OVER (PARTITION BY k ORDER BY j), false) THEN '1' ELSE x END AS x FROM r)
SELECT k AS o_orderkey, string_agg(x, ' ' ORDER BY j) AS text FROM s GROUP BY k"""


def clip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files of users' events in two channels, of which a clip takes one or the mean of both, within bounds: its samples' number and sums."""
    e = _table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.floor(F.col("value") * 10).cast("int").alias("v"))
    frame = F.concat(sample_bytes(F.col("v") % 30000 - 15000), sample_bytes(F.col("v") * 7 % 20000 - 10000))
    files = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", frame.alias("f")))).alias("f"), F.count("*").alias("n"))
    data = F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["f"])), ""))
    u, cut_ = F.col("user_id"), (F.col("user_id") % 2 == 0) & (F.col("n") > 6)
    files = files.select("user_id", wav_bytes(data, F.lit(1000), F.lit(2)).alias("wav"), F.when(u % 3 < 2, u % 3).cast("int").alias("channel"), F.when(cut_, 0.005).alias("a"), F.when(cut_, 0.020).alias("z"))
    clips = files.select("user_id", wav_clip("wav", "channel", "a", "z", F.lit(1000)).alias("c")).select("user_id", sample_values(F.col("c.samples")).alias("s"))
    return clips.select("user_id", F.size("s").cast("bigint").alias("n"), *[F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b).alias(name) for name, x in (("total", F.col("s")), ("weighted", F.transform("s", lambda x, i: x * (i + 1))))])


CLIP_SQL = """WITH e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, cast(floor(value * 10) AS INT) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT u, i, n, v % 30000 - 15000 AS l, v * 7 % 20000 - 10000 AS r FROM e),
c AS (SELECT u, i - CASE WHEN u % 2 = 0 AND n > 6 THEN 5 ELSE 0 END AS i, cast(CASE u % 3 WHEN 0 THEN l WHEN 1 THEN r ELSE round_even((l + r) / 2e0, 0) END AS BIGINT) AS x FROM s WHERE u % 2 = 1 OR n <= 6 OR i BETWEEN 5 AND 19)
SELECT u AS user_id, count(*) AS n, cast(sum(x) AS BIGINT) AS total, cast(sum(x * (i + 1)) AS BIGINT) AS weighted FROM c GROUP BY u"""

SUITE_SQL = """WITH s(suite_id, channels, has, offers) AS (VALUES ('calls', ['phone'], ['en'], ['phone', 'number']), ('clinic', ['microphone'], ['en', 'de'], ['medication', 'dosage']), ('mixed', ['phone', 'microphone'], ['en', 'fr'], ['number'])),
p AS (SELECT n_name AS profile_id, CASE WHEN n_regionkey < 2 THEN 'phone' ELSE 'microphone' END AS channel, [CASE WHEN n_nationkey > 9 THEN 'de' ELSE 'fr' END, 'en'] AS want FROM nation),
j AS (SELECT *, list_contains(channels, channel) AS ok, list_sort(list_filter(want, lambda x: list_contains(has, x))) AS shared, list_sort(list_filter(want, lambda x: NOT list_contains(has, x))) AS missing, list_sort(list_filter(['dosage', 'number'], lambda x: list_contains(offers, x))) AS covered FROM p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ok DESC, len(shared) DESC, len(covered) DESC, suite_id) AS rk FROM j)
SELECT profile_id, suite_id, NOT ok OR len(missing) > 0 OR len(covered) < 2 AS proxy, array_to_string(missing, ',') AS missing, array_to_string(covered, ',') AS covered FROM r WHERE rk = 1"""


def _lines(spark: SparkSession, sf_dir: str, categories: list[Category]) -> DataFrame:
    """A line for each turn of conversations: its text as a template, with a slot of a category in front or behind."""
    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), F.trim(F.translate(F.coalesce("text", F.lit("")), "{}\n\r\t", "()   ")).alias("t"))
    i = F.col("i")
    slot = F.concat(F.lit("{"), F.get(F.array(*[F.lit(x.name) for x in categories]), (i % len(categories)).cast("int")), F.lit("}"))
    template = F.when((i % 2 == 0) | (F.col("t") == ""), F.concat_ws(" ", slot, "t")).otherwise(F.concat_ws(" ", "t", slot))
    return c.select("i", template.alias("template"), F.lit("tts_a").alias("vendor"), F.concat(F.lit("v"), (i % 3).cast("string")).alias("voice"), F.when(i % 5 == 0, "en-GB").otherwise("en-US").alias("language"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said for an amount or a duration in each line, and whether the line falters."""
    some = [c for c in CATEGORIES if c.name in ("number", "duration")]
    made = expanded(_lines(spark, sf_dir, some), "talk", some, seed=7)
    return made.select("utt_id", "speaker_id", "language", F.col("entities")[0]["category"].alias("category"), F.col("entities")[0]["spoken"].alias("spoken"), F.col("disfluency").isNotNull().alias("falters"))


LINES_SQL = """WITH ones AS (SELECT ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS o, ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS t),
n AS (SELECT i AS n, concat_ws(' ', CASE WHEN i >= 100 THEN o[i // 100] || ' hundred' END, CASE WHEN i % 100 >= 20 THEN t[i % 100 // 10 - 1] END, CASE WHEN i % 100 BETWEEN 1 AND 19 THEN o[i % 100] WHEN i % 100 >= 20 AND i % 10 > 0 THEN o[i % 10] END) AS w FROM range(1, 481) r(i), ones),
c AS (SELECT conv_id * 1000 + turn AS i, trim(translate(coalesce(text, ''), '{}' || chr(10) || chr(13) || chr(9), '()   ')) AS x FROM conversations),
k AS (SELECT i, i % 2 AS kind, i % 5 = 0 AS gb, '7:talk:' || i AS k, '7:talk:' || i || CASE WHEN i % 2 = 0 OR x = '' THEN ':0' ELSE ':1' END AS own FROM c),
d AS (SELECT *, CASE WHEN kind = 0 THEN ('0x' || substr(md5(own || '#form'), 1, 12))::BIGINT % 2 ELSE ('0x' || substr(md5(own || '#form'), 1, 12))::BIGINT % 3 END AS form, CASE WHEN gb THEN 'pounds' ELSE 'dollars' END AS whole, CASE WHEN gb THEN 'pence' ELSE 'cents' END AS part FROM k),
f AS (SELECT *, CASE WHEN kind = 1 THEN '{2..12} ' || ['days', 'weeks', 'months'][form + 1] WHEN form = 0 THEN '{2..480} ' || whole ELSE '{2..480} ' || whole || ' and {1..99} ' || part END AS text FROM d),
g AS (SELECT *, ('0x' || substr(md5(own || '#' || text || '@1'), 1, 12))::BIGINT % CASE WHEN kind = 1 THEN 11 ELSE 479 END + 2 AS a, ('0x' || substr(md5(own || '#' || text || '@3'), 1, 12))::BIGINT % 99 + 1 AS b FROM f)
SELECT 'synth:talk:tts-a.v' || i % 3 || ':' || CASE WHEN i < 1000 THEN lpad(cast(i AS VARCHAR), 4, '0') ELSE cast(i AS VARCHAR) END AS utt_id, 'tts-a.v' || i % 3 AS speaker_id, CASE WHEN gb THEN 'en-GB' ELSE 'en-US' END AS language, CASE kind WHEN 0 THEN 'number' ELSE 'duration' END AS category,
  x.w || ' ' || CASE WHEN kind = 1 THEN ['days', 'weeks', 'months'][form + 1] WHEN form = 0 THEN whole ELSE whole || ' and ' || y.w || ' ' || part END AS spoken, ('0x' || substr(md5(k || '#falters'), 1, 12))::BIGINT % 1000000 < 300000 AS falters FROM g JOIN n x ON a = x.n JOIN n y ON b = y.n"""


def script_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of conversations against the tagger: how many of their entities are found."""
    some = [c for c in CATEGORIES if c.name != "address"]
    made = expanded(_lines(spark, sf_dir, some), "talk", some)
    return check(made, some).groupBy("category").agg(F.count("*").alias("n"), F.count_if("found").alias("found"))


QUERIES = {f.__name__: f for f in (alignment_counts, alignment_diffs, false_key_terms, normalised_documents, tagged_documents, entity_summary, mulaw_levels, provider_events, trace_latency, trace_outcomes, manifest_violations, suite_match, batch_responses, answered_runs, streamed_events, resumed_run, latency_summary, standardiser_ablation, token_rules, clip_levels, script_lines, script_entities)}
ORACLE = {
    "alignment_counts": f"SELECT utt_id, sys, n_ref, n_hyp, errors FROM ({scores(DuckWords())}) s", "mulaw_levels": MULAW_SQL, "provider_events": PROVIDER_SQL, "trace_latency": TRACE_SQL, "trace_outcomes": OUTCOME_SQL, "manifest_violations": MANIFEST_SQL, "batch_responses": RESPONSES_SQL, "answered_runs": ANSWERED_SQL, "streamed_events": PROVIDER_SQL, "resumed_run": RESUMED_SQL, "latency_summary": LATENCY_SQL, "token_rules": TOKEN_SQL, "clip_levels": CLIP_SQL, "script_lines": LINES_SQL, "suite_match": SUITE_SQL,
}
