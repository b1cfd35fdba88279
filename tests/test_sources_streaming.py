"""Round trips and small files of every source, and message mapping: stored and streamed forms agree."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from vocalith.sources import files, providers, responses, runs, schemas
from vocalith.sources import lines as json_lines
from vocalith.streaming import messages as M

UTT = {"utt_id": "a", "dataset": "d", "subset": "doctor", "speaker_id": "s", "audio_path": "x/a.wav", "channel": None, "start_s": 0.0, "end_s": 1.5, "ref_text": "hello", "sample_rate": 16000, "license": "l", "synthetic": False, "augmentation": [], "parent_utt_id": None, "exclude_reason": None, "language": "en", "ref_text_original": None}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n\n" for r in rows))
    return str(path)


def test_manifest_round_trip_and_rules(session, tmp_path):
    rows = [UTT | {"utt_id": "b"}, UTT, UTT | {"utt_id": "c", "audio_path": "/abs", "end_s": None, "augmentation": [{"kind": "noise", "params": {"snr": 5}, "seed": 1}], "ref_text_original": "hello"}]
    m = files.read_manifest(session, lines(tmp_path / "m.jsonl", rows))
    files.write_sorted_json(m, str(tmp_path / "out"), files=1)
    again = files.read_manifest(session, str(tmp_path / "out"))
    assert [r.utt_id for r in again.collect()] == ["a", "b", "c"] and sorted(map(str, again.collect())) == sorted(map(str, m.collect()))
    got = {(r.utt_id, r.rule) for r in schemas.violations(m, schemas.manifest_rules()).collect()}
    assert got == {("c", "path_not_relative_posix"), ("c", "one_bound_only"), ("c", "augmented_without_parent"), ("c", "correction_changes_nothing")}
    twice = m.union(m.filter("utt_id = 'a'"))
    assert {r.utt_id for r in schemas.violations(twice, schemas.manifest_rules()).filter("rule = 'duplicate'").collect()} == {"a"}
    odd = lines(tmp_path / "odd.jsonl", [UTT | {"surprise": 1}])
    names = session.createDataFrame([], schemas.MANIFEST).columns
    assert [r.field for r in schemas.unknown_fields(session.read.text(odd), names).collect()] == ["surprise"]
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        files.read_manifest(session, str(tmp_path / "bad.jsonl")).collect()


def test_runs(session, tmp_path):
    for run, config, mode in (("r1", "c1", "batch"), ("r2", "c2", "streaming"), ("r3", "c1", "batch")):
        d = tmp_path / "runs" / run
        d.mkdir(parents=True)
        (d / "run.json").write_text(json.dumps({"run_id": run, "config_id": config, "mode": mode, "settings": {"k": 1}, "keyterms": None}, indent=1))
        rows = session.createDataFrame([(run, config if run != "r3" else "other", u, "hi", None, None, None, None, False) for u in "aab"[run == "r1" :]], schemas.RESULT)
        rows.toPandas().to_parquet(d / "results.parquet")
    import pyarrow as pa
    import pyarrow.parquet as pq

    for p in (tmp_path / "runs").glob("*/results.parquet"):  # all-null columns need their types
        t = pq.read_table(p)
        types = {"raw_response_path": pa.string(), "error": pa.string(), "started_at": pa.timestamp("us", "UTC"), "finished_at": pa.timestamp("us", "UTC")}
        pq.write_table(pa.table({c: t[c].cast(types[c]) if c in types and pa.types.is_null(t[c].type) else pa.array([None] * len(t), types[c]) if c in types else t[c] for c in t.column_names}), p)
    runs, rows = files.read_runs(session, str(tmp_path / "runs"))
    assert runs.count() == 3 and rows.count() == 8
    assert {(r.run_id, r.rule) for r in files.run_violations(runs, rows).collect()} == {("r2", "duplicate"), ("r3", "duplicate"), ("r3", "row_of_another_run"), ("r1", "several_runs_of_a_config"), ("r3", "several_runs_of_a_config")}
    only, theirs = files.read_runs(session, str(tmp_path / "runs"), mode="streaming")
    assert [r.run_id for r in only.collect()] == ["r2"] and {r.run_id for r in theirs.collect()} == {"r2"}
    files.write_rows(rows.drop("folder"), str(tmp_path / "out"))
    assert session.read.parquet(str(tmp_path / "out")).groupBy("run_id").count().count() == 3


def test_traces(session, tmp_path):
    meta = {"config_id": "c", "utt_id": "d:1", "chunk_ms": 20}
    event = [{"kind": "connect_start", "t_ns": 0}, {"kind": "audio_sent", "t_ns": 5, "chunk_index": 0, "audio_offset_ms": 0.0}, {"kind": "final", "t_ns": 4, "text": None, "raw": {"x": 1}}]
    lines(tmp_path / "t" / "d__1.jsonl", [meta, *event])
    sessions, events = files.read_traces(session, str(tmp_path / "t"))
    s = sessions.collect()[0]
    assert (s.utt_id, s.finalization_mode, s.finalize_supported) == ("d:1", "natural", True) and [r.kind for r in events.orderBy("seq").collect()] == ["connect_start", "audio_sent", "final"]
    assert {r.rule for r in schemas.violations(events, schemas.event_rules(), key="file", unique=False).collect()} == {"transcript_without_text", "unordered"}
    files.write_slim_traces(sessions, events, str(tmp_path / "slim"))
    out = [json.loads(r.value) for r in session.read.text(str(tmp_path / "slim")).select("value").collect()]
    assert out[0]["utt_id"] == "d:1" and [x.get("kind") for x in out[1:]] == ["connect_start", "audio_sent", "final"] and "raw" not in out[3]
    assert session.createDataFrame([("a:b/c",)], "u STRING").select(files.trace_name(F.col("u"))).collect()[0][0] == "a__b_c.jsonl"


def test_corpora(session, tmp_path):
    d = tmp_path / "LibriSpeech" / "test-clean" / "61" / "70968"
    d.mkdir(parents=True)
    (d / "61-70968.trans.txt").write_text("61-70968-0000 HE BEGAN\n61-70968-0001 GIVE NOT\n62-1-0000 ELSEWHERE\n")
    got = files.read_librispeech(session, str(tmp_path / "LibriSpeech")).orderBy("utt_id").collect()
    assert [(r.utt_id, r.ref_text, r.bad) for r in got] == [("librispeech:61-70968-0000", "HE BEGAN", False), ("librispeech:61-70968-0001", "GIVE NOT", False), ("librispeech:62-1-0000", "ELSEWHERE", True)]
    assert got[0].audio_path == "LibriSpeech/test-clean/61/70968/61-70968-0000.flac" and got[0].subset == "test-clean"
    (tmp_path / "new.tsv").write_text('client_id\tpath\tsentence\taccents\nc1\tx.mp3\tSay "hi\t England  English \nc2\ty.mp3\t\tz\nc3\tz.mp3\tok\t\n')
    assert [(r.utt_id, r.ref_text, r.accent) for r in files.read_common_voice(session, str(tmp_path / "new.tsv")).collect()] == [("common_voice:x", 'Say "hi', "england english"), ("common_voice:z", "ok", None)]
    (tmp_path / "old.tsv").write_text("client_id\tpath\tsentence\taccent\nc\tx.mp3\ts\tus\n")
    assert files.read_common_voice(session, str(tmp_path / "old.tsv")).collect()[0].accent == "us"
    (tmp_path / "no.tsv").write_text("client_id\tpath\n")
    with pytest.raises(ValueError):
        files.read_common_voice(session, str(tmp_path / "no.tsv"))
    (tmp_path / "lex.txt").write_text("# head\nParacetamol\n\n Co-codamol \n")
    assert [r.term for r in files.read_lexicon(session, str(tmp_path / "lex.txt")).collect()] == ["paracetamol", "co-codamol"]


GRID = '''File type = "ooTextFile"
Object class = "TextGrid"
item []:
    item [1]:
        class = "IntervalTier"
        name = "Doc ""A"""
        intervals [1]:
            xmin = 0
            xmax = 1.5
            text = "he said ""hi"" to asprin"
        intervals [2]:
            xmin = 1.5
            xmax = 1.7
            text = "é"
        intervals [3]:
            xmin = 2
            xmax = 3
            text = "<UNIN/> <INAUDIBLE_SPEECH/>"
        intervals [4]:
            xmin = 3
            xmax = 4
            text = ""
    item [2]:
        class = "TextTier"
        name = "points"
'''


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_textgrid(session, tmp_path, encoding):
    (tmp_path / "day1_consultation01_doctor.TextGrid").write_bytes(GRID.encode(encoding))
    g = files.read_textgrid(session, str(tmp_path))
    rows = g.orderBy("index").collect()
    assert [(r["index"], r.xmin, r.xmax, r.text) for r in rows] == [(1, 0.0, 1.5, 'he said "hi" to asprin'), (2, 1.5, 1.7, "é"), (3, 2.0, 3.0, "<UNIN/> <INAUDIBLE_SPEECH/>"), (4, 3.0, 4.0, "")] and rows[0].tier == 'Doc "A"'
    m = files.consultation_manifest(g, {"asprin": "aspirin"}).orderBy("start_s").collect()
    assert [(r.exclude_reason, r.subset) for r in m] == [(None, "doctor"), ("too_short", "doctor"), ("unintelligible", "doctor")]
    assert m[0].ref_text.endswith("aspirin") and m[0].ref_text_original.endswith("asprin") and m[1].ref_text_original is None


def test_small_sources(session, tmp_path):
    rows = files.read_yaml_rows(session, "configs:\n- {id: a, price: 0.5}\n- {id: b}\n", "configs", "id STRING, price DOUBLE").orderBy("id").collect()
    assert [(r.id, r.price) for r in rows] == [("a", 0.5), ("b", None)]
    with pytest.raises(ValueError):
        files.read_yaml_rows(session, "configs:\n- {id: a, odd: 1}\n", "configs", "id STRING")
    u = session.createDataFrame([("a",), ("b",)], "utt_id STRING")
    t = session.createDataFrame([("a", False)], "utt_id STRING, complete BOOLEAN")
    assert {r.utt_id: r.complete for r in files.with_turns(u, t).collect()} == {"a": False, "b": True} and files.with_turns(u, None).filter("complete").count() == 2
    k = session.createDataFrame([("x", ["a b c d e f"]), ("y", ["ok"]), ("z", ["<b>", "c"])], "config_id STRING, keyterms ARRAY<STRING>")
    assert {(r.config_id, r.rule) for r in files.key_term_violations(k, 1, 50, 5, "<>").collect()} == {("x", "too_many_words"), ("z", "too_many"), ("z", "banned_character")}


def _w(*items):
    return [dict(zip(("word", "start", "end"), i)) for i in items]


CONVERSATIONS = {
    "nova": [
        ({"type": "Results", "is_final": False, "channel": {"alternatives": [{"transcript": "he"}]}}, None, ["partial"]),
        ({"type": "Results", "is_final": True, "speech_final": True, "channel": {"alternatives": [{"transcript": "hello", "words": _w(("hello", 0.1, 0.5))}]}}, None, ["final", "endpoint"]),
        ({"type": "UtteranceEnd", "last_word_end": -1}, None, ["info"]), ({"type": "UtteranceEnd", "last_word_end": 2.5}, None, ["endpoint"]), ({"type": "SpeechStarted"}, None, ["vad_event"]),
        ({"type": "Results", "is_final": False, "channel": {"alternatives": []}}, None, ["info"]), ("not json", None, ["info"]), ({"type": "Error"}, None, ["error"]), ({"type": "Metadata"}, None, ["info"]), ({"type": "SpeechStarted"}, None, []),
    ],
    "flux": [
        ({"type": "TurnInfo", "event": "StartOfTurn", "transcript": "a"}, None, ["vad_event", "partial"]), ({"type": "TurnInfo", "event": "Update", "transcript": ""}, None, ["info"]),
        ({"type": "TurnInfo", "event": "EndOfTurn", "transcript": "ab", "words": _w(("ab", None, 1.0))}, None, ["final", "endpoint"]), ({"type": "TurnInfo", "event": "EndOfTurn", "transcript": "c", "trigger": "manual"}, None, ["final"]), ({"type": "Connected"}, None, ["info"]),
    ],
    "assemblyai": [
        ({"type": "Begin"}, None, ["info"]), ({"type": "Turn", "turn_order": 0, "end_of_turn": False, "transcript": "ok"}, None, ["partial"]), ({"type": "Turn", "turn_order": 0, "end_of_turn": True, "transcript": "okay"}, None, ["endpoint", "partial"]),
        ({"type": "Turn", "turn_order": 0, "end_of_turn": True, "turn_is_formatted": True, "transcript": "Okay.", "words": [{"text": "Okay.", "start": 10, "end": 30}]}, None, ["final"]),
        ({"type": "Turn", "turn_order": 0, "end_of_turn": True, "turn_is_formatted": True, "transcript": "Okay."}, None, ["info"]), ({"type": "Turn", "turn_order": 1, "end_of_turn": True, "turn_is_formatted": True, "transcript": "So."}, None, ["final", "endpoint"]),
        ({"type": "Termination"}, None, ["info"]), ({"type": "SpeechStarted"}, None, []),
    ],
    "elevenlabs": [
        ({"message_type": "partial_transcript", "text": "a"}, None, ["partial"]), ({"message_type": "committed_transcript", "text": "a"}, None, ["endpoint"]), ({}, "finalize", []), ({"message_type": "committed_transcript"}, None, ["info"]), ({"message_type": "committed_transcript"}, None, ["endpoint"]),
        ({"message_type": "committed_transcript_with_timestamps", "text": "a b", "words": [{"text": "a", "start": 0.1, "end": 0.2}, {"text": " ", "start": 0.2, "end": 0.3, "type": "spacing"}]}, None, ["final"]), ({}, "close", []), ({"message_type": "committed_transcript"}, None, ["info"]),
        ({"message_type": "committed_transcript_with_timestamps", "text": ""}, None, ["final"]), ({"message_type": "partial_transcript", "text": "late"}, None, []),
    ],
}


def rows():
    return [{"session": p, "seq": i, "t_ns": 10 * i, "provider": p, "message": m if isinstance(m, str) else json.dumps(m), "sent": sent} for p, steps in CONVERSATIONS.items() for i, (m, sent, _) in enumerate(steps)]


def expected():
    return {(p, i, j, k) for p, steps in CONVERSATIONS.items() for i, (_, _, kinds) in enumerate(steps) for j, k in enumerate(kinds)}


def test_stored_messages(session):
    got = M.batch_events(session.createDataFrame([tuple(r.values()) for r in rows()], M.INPUT)).collect()
    assert {(r.session, r.seq, r.part, r.kind) for r in got} == expected()
    by = {(r.session, r.seq, r.kind): r for r in got}
    assert [tuple(w) for w in by["nova", 1, "final"].words] == [("hello", 100.0, 500.0)] and by["flux", 2, "final"].words is None
    assert [tuple(w) for w in by["assemblyai", 3, "final"].words] == [("Okay.", 10.0, 30.0)] and [tuple(w) for w in by["elevenlabs", 5, "final"].words] == [("a", 100.0, 200.0)]
    plain = session.createDataFrame([("s", 0, 0, "assemblyai", '{"type": "Turn", "turn_order": 0, "end_of_turn": true, "transcript": "x"}', None)], M.INPUT)
    assert [r.kind for r in M.batch_events(plain, expect_formatted=False).orderBy("part").collect()] == ["final", "endpoint"]
    assert M.batch_events(session.createDataFrame([], M.INPUT)).count() == 0


@pytest.fixture
def rocks(session):
    before = {k: session.conf.get(k, None) for k in M.STORE}
    for k, v in M.STORE.items():
        session.conf.set(k, v)
    yield session
    for k, v in before.items():
        session.conf.unset(k) if v is None else session.conf.set(k, v)


def _append(folder, some, end="\n"):
    folder.parent.mkdir(parents=True, exist_ok=True)
    with open(folder, "a") as f:
        f.write("".join(json.dumps(r) + "\n" for r in some[:-1]) + (json.dumps(some[-1]) + end if some else ""))


def _run(df, name, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(checkpoint / name)).option("checkpointLocation", str(checkpoint / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = df.sparkSession.read.schema("session STRING, seq BIGINT, part INT, kind STRING").parquet(str(checkpoint / name)).collect()
    return {(r.session, r.seq, r.part, r.kind) for r in got}, len(got)


def test_streamed_messages_in_any_order(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    for n, part in enumerate((rows()[1::2], rows()[::2], rows()[::3])):  # every message's predecessor comes a batch later, some come twice
        _append(tmp_path / "in" / f"{n}.json", list(reversed(part)))
    source = rocks.readStream.schema(M.INPUT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert _run(M.stream_events(source, timeout_ms=None), "mapped", tmp_path) == (expected(), len(expected()))


def test_a_stream_without_its_store_is_refused(session, tmp_path):
    assert session.conf.get("spark.sql.streaming.stateStore.providerClass") != list(M.STORE.values())[0]
    with pytest.raises(ValueError, match="providerClass"):
        M.stream_events(providers.stream_messages(session, str(tmp_path)))


def test_a_log_of_messages_goes_on_after_a_restart(rocks, tmp_path):
    log = tmp_path / "log"
    some = rows()
    shard = lambda r: log / ("a" if r["session"] < "f" else "b")
    halves = [some[: len(some) // 2], some[len(some) // 2 :]]
    for r in halves[0]:
        _append(shard(r) / "001.jsonl", [r])
    _append(log / "a" / "001.jsonl", [halves[1][0]], end="")  # a line that isn't whole yet
    stream = lambda **options: M.stream_events(providers.stream_messages(rocks, str(log), part_bytes=100, **options), timeout_ms=None)
    first, n = _run(stream(), "events", tmp_path)
    assert first < expected() and n == len(first)
    assert _run(stream(), "events", tmp_path) == (first, n)  # nothing new, nothing twice
    with open(log / "a" / "001.jsonl", "a") as f:
        f.write("\n")
    for r in halves[1][1:]:
        _append(shard(r) / "002.jsonl", [r])
    assert _run(stream(), "events", tmp_path) == (expected(), len(expected()))
    late = {**some[0], "session": "late", "provider": "nova", "seq": 0}
    _append(log / "b" / "003.jsonl", [late])
    everything = _run(stream(delete_done="true"), "events", tmp_path)
    assert everything[1] == len(expected()) + 1


def test_a_log_names_the_file_and_line_of_what_is_wrong(rocks, tmp_path):
    _append(tmp_path / "log" / "s" / "1.jsonl", rows()[:4] + [{"session": "x"}])
    with pytest.raises(Exception, match=r"s/1\.jsonl:5: missing fields \['seq'\]"):
        _run(providers.stream_messages(rocks, str(tmp_path / "log")).selectExpr("session", "seq", "0 AS part", "message AS kind"), "x", tmp_path)


def test_a_silent_session_is_closed_by_its_timer(rocks, tmp_path):
    log = tmp_path / "log" / "s"
    kept = [r for r in rows() if r["session"] == "nova" and r["seq"] not in (0, 3)]
    _append(log / "1.jsonl", kept)
    out = tmp_path / "out"
    q = M.stream_events(providers.stream_messages(rocks, str(tmp_path / "log")), timeout_ms=1500).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        seen = lambda: {(r.seq, r.kind) for r in rocks.read.schema("seq BIGINT, kind STRING").parquet(str(out)).collect()} if list(out.glob("*.parquet")) else set()
        end = time.time() + 60
        while time.time() < end and len(seen()) < 2:
            time.sleep(0.5)
            _append(log / "1.jsonl", [{**rows()[0], "session": f"other{time.time_ns()}"}])  # a trigger needs news of some session
        want = {(s, k) for p, s, _, k in expected() if p == "nova" and s not in (0, 3)}
        assert want <= seen()
        # its state is gone: messages that come now begin anew
        _append(log / "1.jsonl", [r for r in rows() if r["session"] == "nova" and r["seq"] == 0])
        while time.time() < end and (0, "partial") not in seen():
            time.sleep(0.5)
        assert (0, "partial") in seen()
    finally:
        q.stop()


def test_answers_are_asked_for_run_by_run(session, tmp_path):
    deep = lambda t: json.dumps({"results": {"channels": [{"alternatives": [{"transcript": t}]}]}})
    request = lambda u, *answers, **more: {"config_id": "c", "utt_id": u, "provider": "deepgram", "answers": [dict(zip(("status", "body"), a)) for a in answers]} | more
    for run in ("r1", "r2"):
        _append(tmp_path / run / "requests.jsonl", [request(f"{run}u{i}", (200, deep(f"text {i}"))) for i in range(50)] + [request("again", (503, None), (None, None), (200, deep("at last")), settings={"punctuate": True}), request("never", (429, "busy")), request("bad", (401, "no"))])
    got = providers.read_answers(session, str(tmp_path), part_bytes=700, attempts=4)
    assert got.rdd.getNumPartitions() > 4
    rows_ = got.collect()
    assert sorted((r.attempt, r.status) for r in rows_ if r.run_id == "r1" and r.utt_id == "again") == [(1, 503), (2, None), (3, 200)]
    assert len([r for r in rows_ if r.utt_id == "never"]) == 8 and len([r for r in rows_ if r.utt_id == "bad"]) == 2 and len(rows_) == 2 * (50 + 3 + 4 + 1)
    done = {(r.run_id, r.utt_id): (r.hyp_text, r.error, r.retry) for r in responses.results(got).collect()}
    assert done["r2", "r2u7"] == ("text 7", None, False) and done["r1", "again"] == ("at last", None, False) and done["r1", "never"] == ("", "deepgram: HTTP 429", True)
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = providers.read_answers(session, str(tmp_path)).where("run_id = 'r2'")
        assert one.rdd.getNumPartitions() == 1 and {r.run_id for r in one.collect()} == {"r2"}
    finally:
        session.conf.unset("spark.sql.python.filterPushdown.enabled")
    _append(tmp_path / "r2" / "requests.jsonl", [request("odd", settings={"keyterm": 1})])
    with pytest.raises(Exception, match="deepgram has no settings"):
        providers.read_answers(session, str(tmp_path)).collect()
    with pytest.raises(Exception, match="unknown adapter"):
        providers.read_answers(session, str(tmp_path), adapter="live").collect()


def test_strict_rows_name_file_and_line(session, tmp_path):
    good = [{"utt_id": f"u{i}", "channel": i} for i in range(200)]
    _append(tmp_path / "m" / "a.jsonl", good)
    (tmp_path / "m" / "b.jsonl").write_text("\n\n" + json.dumps({"utt_id": "last"}))
    read = lambda part=1000: json_lines.read_strict(session, str(tmp_path / "m"), "utt_id STRING, channel INT", ["utt_id"], part)
    assert read().count() == 201 and read(37).count() == 201 and read().rdd.getNumPartitions() > 3
    assert files.read_manifest(session, str(tmp_path / "m"), strict=True).where("utt_id = 'u3' AND channel = 3").count() == 1
    for bad, said in (('{"utt_id": "x", "chanel": 1}', r"unknown fields \['chanel'\]"), ('{"channel": 1}', r"missing fields \['utt_id'\]"), ('{"utt_id": ', "Expecting value"), ('{"utt_id": "x", "channel": "two"}', "two"), ("[1]", "not an object")):
        (tmp_path / "m" / "c.jsonl").write_text(json.dumps(good[0]) + "\n\n" + bad + "\n")
        with pytest.raises(Exception, match=r"m/c\.jsonl:3: .*" + said):
            read(20).collect()
    with pytest.raises(Exception, match="nowhere"):
        json_lines.read_strict(session, str(tmp_path / "nowhere"), "utt_id STRING").collect()


META = {"run_id": "r", "config_id": "c", "provider": "p", "model_id": "m", "mode": "batch", "settings": '{"a": 1, "b": [2]}', "keyterms": ["x"], "sample": None}


def _results(session, *some):
    return session.createDataFrame([("r", "c", u, text, None, None, None, error, False) for u, text, error in some], schemas.RESULT)


def _held(session, root):
    return {(r.utt_id, r.hyp_text, r.error) for r in runs.rows_of(session, str(root), "r").collect()}


def test_a_run_goes_on_and_replaces_what_failed(session, tmp_path):
    root = str(tmp_path)
    manifest = session.createDataFrame([(f"u{i}", "noise" if i == 3 else None) for i in range(9)], "utt_id STRING, exclude_reason STRING")
    ids = lambda **options: sorted(r.utt_id for r in runs.todo(session, root, "r", manifest, **options).collect())
    assert len(ids()) == 8 and len(ids(include_excluded=True)) == 9
    runs.merge(session, root, META, _results(session))
    assert _held(session, root) == set()
    runs.merge(session, root, META, _results(session, ("u0", "zero", None), ("u1", "", "p: HTTP 503"), ("u2", "two", None)))
    assert ids() == ["u4", "u5", "u6", "u7", "u8"] and ids(retry_failed=True) == ["u1", "u4", "u5", "u6", "u7", "u8"] and ids(limit=4) == ["u4"]
    more = _results(session, ("u0", "changed", None), ("u1", "one", None), ("u4", "four", None))
    runs.merge(session, root, META, more)
    assert _held(session, root) == {("u0", "zero", None), ("u1", "", "p: HTTP 503"), ("u2", "two", None), ("u4", "four", None)}
    for _ in range(2):
        runs.merge(session, root, dict(META, settings='{"b": [2], "a": 1}'), more, retry_failed=True)
        assert _held(session, root) == {("u0", "zero", None), ("u1", "one", None), ("u2", "two", None), ("u4", "four", None)}
    meta, rows_ = files.read_runs(session, root)
    assert meta.first().config_id == "c" and meta.first().keyterms == ["x"] and rows_.count() == 4
    assert files.run_violations(meta, rows_).count() == 0


@pytest.mark.parametrize("field, value", [("config_id", "d"), ("provider", "q"), ("model_id", "n"), ("mode", "streaming"), ("settings", '{"a": 1}'), ("keyterms", None), ("sample", '{"n": 5}')])
def test_a_run_refuses_to_go_on_differently(session, tmp_path, field, value):
    runs.begin(session, str(tmp_path), META)
    with pytest.raises(runs.RunConflict, match=f"other {field};"):
        runs.merge(session, str(tmp_path), META | {field: value}, _results(session))
    assert runs.begin(session, str(tmp_path), META) == META | {f: None for f in ("created_at", "git_sha", "manifest")}


def test_a_merge_refuses_rows_that_are_not_its_own(session, tmp_path):
    twice = _results(session, ("u", "a", None), ("u", "b", None))
    other = _results(session, ("u", "a", None)).withColumn("run_id", F.lit("s"))
    for bad, said in ((twice, "utterance comes twice: u"), (other, "row of another run: s c")):
        with pytest.raises(Exception, match=said):
            runs.merge(session, str(tmp_path), META, bad)
    assert _held(session, tmp_path) == set()


def test_a_merge_that_is_killed_is_finished_by_the_next(session, tmp_path, monkeypatch):
    first = _results(session, *[(f"u{i}", f"text {i}", None) for i in range(40)])
    second = _results(session, *[(f"u{i}", f"text {i}", None) for i in range(40, 80)])
    want = {(f"u{i}", f"text {i}", None) for i in range(80)}
    whole = runs._overwrite
    for at in ("before staging ends", "before", "after half", "after all"):
        root = tmp_path / at.replace(" ", "_")
        runs.merge(session, str(root), META, first)

        def killed(staged, path, at=at):
            if at == "after half":
                whole(staged.where("bucket < 8"), path)
            if at == "after all":
                whole(staged, path)
            raise KeyboardInterrupt

        monkeypatch.setattr(runs, "_overwrite", killed)
        with pytest.raises(KeyboardInterrupt):
            runs.merge(session, str(root), META, second)
        if at == "before staging ends":
            (root / "r" / "staged.parquet" / "_SUCCESS").unlink()
        monkeypatch.setattr(runs, "_overwrite", whole)
        if at != "before staging ends":
            runs.begin(session, str(root), META)
            assert _held(session, root) == want
        runs.merge(session, str(root), META, second)
        assert _held(session, root) == want and not (root / "r" / "staged.parquet").exists()


def test_a_session_asks_for_its_state_a_few_times_whatever_its_messages():
    calls = []

    class Kept(dict):
        def exists(self):
            return calls.append("exists") or bool(self)

        def get(self):
            return calls.append("get") or self[0]

        def update(self, value):
            calls.append("update")
            self[0] = value

        def containsKey(self, key):
            return calls.append("containsKey") or key in self

        def getValue(self, key):
            return calls.append("getValue") or self[key]

        def updateValue(self, key, value):
            calls.append("updateValue")
            self[key] = value

        def removeKey(self, key):
            calls.append("removeKey")
            del self[key]

    class Handle:
        def getValueState(self, *_):
            return Kept()

        getMapState = getValueState

    flags = M.Flags(None)
    flags.init(Handle())
    item = lambda seq, turn=0, bits=M.ENDS: f"{seq} {turn} {bits} {{}}"
    go = lambda *items: [i for b in flags.handleInputRows(("s",), iter([M.pd.DataFrame({"item": list(items)})]), None) for i in b["item"]]
    got = go(*(item(i, i % 20) for i in range(500)))
    assert got == [f"{i} {M.FIRST_END if i < 20 else 0} {{}}" for i in range(500)]
    assert len(calls) <= 4  # 502 before: each message was looked for among those that wait
    assert go(item(502), item(503), item(501)) == [] and flags.held == 3
    assert go(item(503, bits=0), item(500, 31, M.ENDS | M.FINISHES), item(504, 31)) == [f"500 {M.FIRST_END | M.FIRST_FINAL} {{}}", *(f"{i} 0 {{}}" for i in (501, 502, 503)), f"504 {M.FINAL_BEFORE} {{}}"]
    assert flags.held == 0 and not flags.waiting and flags.next == 505


def test_streamed_turns_beyond_a_block_are_as_stored_ones(rocks, tmp_path):
    rng = random.Random(4)
    some = [
        {"session": s, "seq": i, "t_ns": 2**62 + i, "provider": "assemblyai", "message": json.dumps({"type": "Turn", "turn_order": rng.choice([None, -33, -1, 0, 31, 32, 63, 64, 1000]), "end_of_turn": rng.random() < 0.5, "turn_is_formatted": rng.random() < 0.4, "transcript": 'q " \\ \n é'}, ensure_ascii=rng.random() < 0.5)}
        for s in ("a b", "", "c") for i in range(60)
    ]
    rng.shuffle(some)
    (tmp_path / "in").mkdir()
    for n in range(3):
        _append(tmp_path / "in" / f"{n}.json", some[n::3])
    source = rocks.readStream.schema(M.INPUT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    names = ["session", "seq", "part", "t_ns", "kind", "text", "raw"]
    q = M.stream_events(source, timeout_ms=None).select(names).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = M.batch_events(rocks.createDataFrame([{"sent": None, **r} for r in some], M.INPUT)).select(names)
    got = rocks.read.schema(want.schema).parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == want.count()
