"""Scripts, recipes and stored answers: expected values and properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions.audio import level
from vocalith.operators import augment, scripts
from vocalith.operators.entities import Category
from vocalith.sources import responses

CATEGORIES = [Category("dose", builtin="dosage"), Category("when", builtin="date"), Category("phone", builtin="phone"), Category("drug", terms=("aspirin", "beta blocker")), Category("code", pattern=r"\b\d{10}\b")]
TEMPLATES = ["I take {dose} of {drug} since {when}.", "{greet}, my number is {phone}", "The code is {code}, I said", "{drug} again?"]
VOICES = ["tts_a:one:en-US", "tts_b:two:en-GB", "tts_b:three:en-US"]


def test_numbers_in_words(session):
    assert [scripts.words(n) for n in (0, 19, 20, 21, 100, 112, 999, 1000, 12_345, 999_999)] == [
        "zero", "nineteen", "twenty", "twenty one", "one hundred", "one hundred twelve", "nine hundred ninety nine", "one thousand", "twelve thousand three hundred forty five", "nine hundred ninety nine thousand nine hundred ninety nine",
    ]
    assert [scripts.ordinal_words(n) for n in (1, 2, 3, 4, 5, 8, 9, 12, 20, 21, 30, 31)] == ["first", "second", "third", "fourth", "fifth", "eighth", "ninth", "twelfth", "twentieth", "twenty first", "thirtieth", "thirty first"]
    assert [scripts.year_words(y) for y in (1982, 2005, 2000, 1900, 1905, 2010)] == ["nineteen eighty two", "two thousand and five", "two thousand", "nineteen hundred", "nineteen oh five", "twenty ten"]
    said = scripts.said_digits(F.col("d"), F.col("z"), F.col("two"))
    rows = session.createDataFrame([("0077", "zero", True), ("0|07|7", "oh", True), ("0077", "oh", False), ("111", "oh", True)], "d STRING, z STRING, two BOOLEAN")
    assert [r[0] for r in rows.select(said).collect()] == ["double zero double seven", "oh, oh seven, seven", "oh oh seven seven", "double one one"]
    with pytest.raises(ValueError):
        scripts.words(10**6)


def test_scripts_reach_their_targets_and_the_tagger_finds_their_entities(session):
    made = scripts.script(session, "demo", TEMPLATES, CATEGORIES, VOICES, {"greet": ["Hello", "Good day"]}, seed=3, target=12)
    rows = made.collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(made.repartition(3).collect())]
    assert min(scripts.counts(rows).values()) >= 12 and {r.disfluency for r in rows} == {None, "lead", "mid", "restart"}
    assert len({r.utt_id for r in rows}) == len(rows) and {r.speaker_id for r in rows} == {"tts-a.one", "tts-b.two", "tts-b.three"}
    assert all("{" not in r.ref_text and " ," not in r.ref_text and r.ref_text[0].isupper() and r.ref_text[-1] in ".?" for r in rows)
    got = scripts.check(made, CATEGORIES).collect()
    assert sum(r.found for r in got) / len(got) > 0.97 and len(got) == sum(len(r.entities) for r in rows)
    lost = made.selectExpr("utt_id", "language", "'nothing here' AS ref_text", "entities")
    assert not any(r.found for r in scripts.check(lost, CATEGORIES).collect())
    with pytest.raises(ValueError):
        scripts.plan(["no slot"], ["dose"], 3)
    for bad in (["bad"], []):
        with pytest.raises(ValueError):
            scripts.script(session, "x", TEMPLATES, CATEGORIES, bad, {"greet": ["Hi"]})
    with pytest.raises(ValueError, match="greet"):
        scripts.script(session, "x", TEMPLATES, CATEGORIES, VOICES)


def test_the_script_is_written_in_order(session, tmp_path):
    made = scripts.script(session, "demo", TEMPLATES, CATEGORIES, VOICES, {"greet": ["Hi"]}, target=2)
    scripts.write_script(made, str(tmp_path))
    for part in ("manifest", "entities"):
        ids = [json.loads(x)["utt_id"] for f in sorted((tmp_path / part).glob("part-*")) for x in f.read_text().splitlines()]
        assert ids == sorted(ids) and len(ids) == made.count()


def test_recipes_leave_their_traces_and_repeat(session):
    rng = np.random.default_rng(2)
    clip = lambda n: bytearray(rng.integers(-3000, 3000, n).astype("<i2").tobytes())
    clips = session.createDataFrame([("a", clip(16000), 16000, 0.2, 0.8), ("b", clip(8000), 16000, None, None), ("c", clip(4000), 16000, 5.0, 9.0)], "utt_id STRING, samples BINARY, rate INT, start_s DOUBLE, end_s DOUBLE")
    noises = session.createDataFrame([(f"n{i}", clip(3000 + i), 16000) for i in range(4)], "name STRING, samples BINARY, rate INT")
    got = {r.parent_utt_id: r for r in augment.augmented(clips, "phone_noisy_snr10", noises=noises, run_seed=5).collect()}
    again = {r.parent_utt_id: r for r in augment.augmented(clips.repartition(3), "phone_noisy_snr10", noises=noises.repartition(2), run_seed=5).collect()}
    assert got == again and set(got) == {"a", "b", "c"}
    for r in got.values():
        assert r.utt_id == f"{r.parent_utt_id}#phone_noisy_snr10" and r.rate == 8000 and [s.kind for s in r.augmentation] == ["noise", "resample", "bandpass", "mulaw"]
    assert len(got["a"].samples) == 16000 and json.loads(got["b"].augmentation[0].params)["region"] == "whole_clip" and json.loads(got["a"].augmentation[0].params)["region_s"] == [0.2, 0.8]
    dry = augment.augmented(clips, "quiet", [{"kind": "reverb"}], rooms=session.createDataFrame([("r", bytearray(np.array([0, 900, 0], "<i2").tobytes()), 16000)], "name STRING, samples BINARY, rate INT")).collect()
    first = next(r for r in dry if r.parent_utt_id == "a")
    assert abs(level(np.frombuffer(bytes(first.samples), "<i2"), 0, 16000) - level(np.frombuffer(bytes(clips.first().samples), "<i2"), 0, 16000)) < 1
    with pytest.raises(ValueError):
        augment.checked([{"kind": "opus", "bitrate": "12k"}])
    with pytest.raises(ValueError):
        augment.checked([{"kind": "noise", "snr": 3}])
    with pytest.raises(ValueError):
        augment.augmented(clips, "noise_snr5")
    sound = lambda *speech: augment.Sound(np.zeros(4000, "<i2"), 16000, speech)
    assert [sound(*s).region() for s in ((5.0, 9.0), (None, None), (-1.0, 0.1), (0.1, 0.1))] == [(3999, 4000), (0, 4000), (0, 1600), (1600, 1601)]


def test_stored_answers_become_rows_and_tell_what_to_ask_again(session, tmp_path):
    deep = lambda t: json.dumps({"results": {"channels": [{"alternatives": [{"transcript": t}]}]}})
    rows = [
        ("a", "deepgram", 1, 503, None), ("a", "deepgram", 2, 200, deep("hi")), ("b", "deepgram", 1, 200, "{}"), ("c", "assemblyai", 1, 200, '{"status": "queued"}'), ("d", "assemblyai", 1, 200, '{"status": "completed"}'),
        ("e", "assemblyai", 1, 200, '{"status": "error", "error": "no"}'), ("f", "elevenlabs", 1, 200, '{"text": " "}'), ("g", "elevenlabs", 1, 400, "x"), ("h", "elevenlabs", 1, None, None), ("i", "elevenlabs", 3, 429, None),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(dict(zip(("utt_id", "provider", "attempt", "status", "body"), r)) | {"run_id": "r", "config_id": "c"}) for r in rows))
    done = responses.results(responses.read_responses(session, str(tmp_path)))
    got = {r.utt_id: (r.hyp_text, r.error, r.suspect_empty, r.attempts, r.retry) for r in done.collect()}
    assert got == {
        "a": ("hi", None, False, 2, False), "b": ("", "deepgram: unexpected response shape", False, 1, False), "c": ("", "assemblyai: not done", False, 1, True), "d": ("", None, True, 1, False),
        "e": ("", "assemblyai: failed: no", False, 1, False), "f": (" ", None, True, 1, False), "g": ("", "elevenlabs: HTTP 400", False, 1, False), "h": ("", "elevenlabs: no answer", False, 1, True), "i": ("", "elevenlabs: HTTP 429", False, 1, True),
    }
    assert {(r.utt_id, r.wait_s) for r in responses.to_retry(done, 3).collect()} == {("c", 1.0), ("h", 1.0), ("i", 1.0)}
