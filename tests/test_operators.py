"""Alignment, entities, traces, audio, suites: expected values and brute force."""

import io
import random
import time
import tracemalloc
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions.audio import decode_mulaw, encode_mulaw, mix, mulaw_decoded, mulaw_encoded, mulaw_level, level, bandpass, convolved, noise_part, output_blocks, resampled, reverberate, wav_bytes, wav_clip, wav_decoded, wav_part, with_silence
from vocalith.functions.text import normalise
from vocalith.operators import alignment as al
from vocalith.operators import entities
from vocalith.operators.entities import Category, Trie, normal_terms, outcomes, summary, tag, tagged
from vocalith.operators.traces import endpoint_outcomes, result_rows, session_latency, transcripts
from vocalith.plans import report
from vocalith.plans.suites import PROFILE, SUITE, match
from vocalith.sources.schemas import EVENT, SESSION

CASES = [("the patient takes metformin daily", "the patient take metformin", 1, 1, 0, 3), ("call me back", "please call me back now", 0, 0, 2, 3), ("blood pressure is high", "blood pleasure high", 1, 1, 0, 2), ("", "", 0, 0, 0, 0), ("", "a b", 0, 0, 2, 0), ("a b", "", 0, 2, 0, 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def table_ops(a, b):
    """The way back through the whole table: diagonal steps first, then deletions."""
    t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, steps = len(a), len(b), ""
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            steps, i, j = ("e" if a[i - 1] == b[j - 1] else "s") + steps, i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + 1:
            steps, i = "d" + steps, i - 1
        else:
            steps, j = "i" + steps, j - 1
    return steps


@pytest.mark.parametrize("longest, letters, pairs", [(9, "ab", 400), (9, "abcd", 400), (90, "abcdefgh", 40), (300, "abc", 4)])
def test_bit_parallel_steps_are_those_of_the_table(longest, letters, pairs):
    rng = random.Random(longest)
    for _ in range(pairs):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(longest))] for _ in "xy")
        assert al._ops(a, b) == table_ops(a, b)
        assert al._last_row(a, b) == [distance(a, b[:k]) for k in range(len(b) + 1)] if a else True


def test_a_long_pair_aligns_in_pieces(monkeypatch):
    rng = random.Random(1)
    a = [str(rng.randrange(300)) for _ in range(4000)]
    b = [w for w in a if rng.random() > 0.1]
    whole = al.align(a, b)
    assert whole["deletions"] == len(a) - len(b) and whole["substitutions"] == whole["insertions"] == 0
    monkeypatch.setattr(al, "CELLS", 1_000_000)
    pieces = al.align(a, b)
    assert pieces["deletions"] == whole["deletions"] and pieces["hits"] == whole["hits"]


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_alignment_is_least_and_covers_both_sides(cells, monkeypatch):
    monkeypatch.setattr(al, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in "xy")
        s = al.align(a, b)
        assert s["substitutions"] + s["deletions"] + s["insertions"] == distance(a, b)
        assert s["hits"] + s["substitutions"] + s["deletions"] == len(a) and s["hits"] + s["substitutions"] + s["insertions"] == len(b)
        at = (0, 0)
        for c in s["chunks"]:
            assert (c["ref_start"], c["hyp_start"]) == at
            at = (c["ref_end"], c["hyp_end"])
            same = a[c["ref_start"] : c["ref_end"]] == b[c["hyp_start"] : c["hyp_end"]]
            assert same == (c["op"] == "equal")
        assert at == (len(a), len(b))


def aligned(session, rows):
    df = session.createDataFrame([(i, r.split(), h.split(), h) for i, (r, h) in enumerate(rows)], "i INT, ref ARRAY<STRING>, hyp ARRAY<STRING>, raw_hyp STRING")
    return df.withColumn("a", al.alignment("ref", "hyp")).withColumn("chunks", F.col("a.chunks"))


def test_alignment_columns(session):
    df = aligned(session, [c[:2] for c in CASES])
    got = df.select("i", "a.*", al.token_hits(F.col("chunks"), "ref").alias("h"), al.difference(F.col("chunks"), F.col("ref"), F.col("hyp")).alias("d")).orderBy("i").collect()
    assert [(r.substitutions, r.deletions, r.insertions, r.hits) for r in got] == [c[2:] for c in CASES]
    assert got[2].h == [True, False, False, True] and got[1].d == "[+please] call me back [+now]" and got[5].d == "[-a] [-b]"
    assert "→" in got[0].d and got[3].d == ""


def test_key_terms(session):
    df = aligned(session, [("take metformin now", "take metformin metformin now"), ("take it", "take it"), ("x", "")])
    terms = F.array(F.array(F.lit("metformin")), F.array(F.lit("metformin"), F.lit("metformin")))
    got = [[(t.term, t.n) for t in r.t] for r in df.orderBy("i").select(al.key_term_insertions(F.col("chunks"), F.col("hyp"), terms).alias("t")).collect()]
    assert got == [[("metformin", 1), ("metformin metformin", 1)], [("metformin", 0), ("metformin metformin", 0)], [("metformin", 0), ("metformin metformin", 0)]]


CATS = [Category("number", builtin="number"), Category("dosage", builtin="dosage"), Category("date", builtin="date"), Category("phone", builtin="phone"), Category("medication", terms=("Paracetamol", "co-codamol", "co-codamol forte")), Category("ref", pattern=r"[a-z]{2}-?\d")]


def test_tagging():
    found = [(c, c.regex("mdy")) for c in CATS]
    spans = lambda t: [(c, s) for c, _, _, s in tag(normalise(t), found)]
    assert spans("I take 500 milligrams of paracetamol twice, 3 times") == [("dosage", "500 mg"), ("medication", "paracetamol"), ("number", "3")]
    assert spans("born the third of March nineteen eighty") == [("date", "march 3 1980")]
    assert spans("two co-codamol forte and co codamol") == [("number", "2"), ("medication", "co codamol forte"), ("medication", "co codamol")]
    assert spans("call (555) 123-4567") == [("phone", "5551234567")] and spans("") == []
    with pytest.raises(ValueError):
        Category("x", builtin="number", pattern="y")


def test_entity_outcomes(session):
    df = aligned(session, [("take 500 mg daily", "take 500 mg daily"), ("take 500 mg daily", "take 50 mg daily"), ("call 5551234567", "call 5551234567"), ("nothing", "")])
    df = df.withColumn("raw_hyp", F.when(F.col("i") == 0, "take five hundred mg").when(F.col("i") == 2, "call 555-123-4567").otherwise(F.col("raw_hyp")))
    rows = {(r.i, r.category): r for r in outcomes(df, CATS, ["i"]).collect()}
    assert rows[0, "dosage"].recovered and not rows[0, "dosage"].formatted and rows[0, "dosage"].char_errors == 0
    assert not rows[1, "dosage"].recovered and rows[1, "dosage"].char_errors == 1 and rows[1, "dosage"].char_total == 5
    assert rows[2, "phone"].formatted and len(rows) == 3
    s = {r.category: r for r in summary(outcomes(df, CATS, ["i"])).collect()}
    assert (s["dosage"].n, s["dosage"].recovered, s["dosage"].cer) == (2, 1, 0.1) and s["phone"].recall == 1.0 and s["phone"].recall_high == 1.0


def test_texts_without_numbers_are_not_searched_for_them():
    class Never:
        def finditer(self, text):
            raise AssertionError(text)

    builtin = [(Category(n, builtin=n), Never()) for n in entities.BUILTINS]
    assert tag("nothing here but words and a license", builtin, ["licence"], Trie([("license", 0)])) == [("licence", 6, 7, "license")]
    with pytest.raises(AssertionError):
        tag("one tablet", builtin)


def test_words_beside_references_are_those_of_each_stretch(session):
    """Made once a text, they give what ``aligned_words`` searches for; sides that differ in places only are aligned as the whole table has it."""
    rng = random.Random(11)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for i in range(300)]
    df = session.createDataFrame(rows, "i INT, ref ARRAY<STRING>, hyp ARRAY<STRING>").withColumn("a", al.alignment("ref", "hyp"))
    df = df.withColumn("w", al.bound(al.paired_words, F.col("a.chunks"), F.col("hyp"), F.size("ref"))).withColumn("start", F.col("i") % F.size("ref"))
    df = df.select("ref", "w", "start", al.aligned_words(F.col("a.chunks"), F.col("hyp"), F.col("start"), F.size("ref")).alias("got"))
    for r in df.collect():
        assert len(r.w) == len(r.ref) and "".join(r.got) == "".join(("" if k == 0 else w.before) + w.word for k, w in enumerate(r.w[r.start :]))
    straight = 0
    for _, ref, _ in rows:
        hyp = [w if rng.random() < 0.6 else rng.choice("abcdxyz") for w in ref]
        straight += (steps := al._straight(ref, hyp)) is not None
        assert steps in (None, al._ops(ref, hyp), "".join(table_ops(ref, hyp)))
    assert straight > 100


def test_what_a_column_stands_for_is_not_computed_for_each_chunk(session):
    """2,000 chunks of 6,000 words: hypotheses are made once, not once a chunk."""
    n = 6000
    df = session.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("ref"))
    df = df.withColumn("hyp", F.transform("ref", lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(7)) == 0, F.concat(w, F.lit("0"))).otherwise(w))).withColumn("chunks", al.alignment("ref", "hyp").chunks)
    begin = time.perf_counter()
    row = df.select(F.size("chunks").alias("n"), F.length(al.difference(F.col("chunks"), F.col("ref"), F.col("hyp"))).alias("l")).first()
    assert row.n > 1000 and row.l > 6 * n and time.perf_counter() - begin < 8


def trace(finals=((1000, None),), endpoints=(1100,), mode="natural", supported=True, end=750.0):
    ev = [("connect_start", 0), ("connect_ready", 50)] + [("audio_sent", 50 + 100 * k) for k in range(10)] + [("partial", 400)] + [("final", t) for t, _ in finals] + [("endpoint", t) for t in endpoints]
    words = {t: w for t, w in finals}
    rows = []
    for seq, (kind, t) in enumerate(sorted(ev, key=lambda x: x[1])):
        k = (t - 50) // 100 if kind == "audio_sent" else None
        rows.append((seq, kind, t * 1_000_000, k, None if k is None else 100.0 * k, f"t{t}" if kind in ("partial", "final") else None, words.get(t) if kind == "final" else None))
    return (mode, supported, 150.0, end), rows


def frames(session, traces):
    s = [(str(i), "c", f"u{i}", 100.0, t[0][0], t[0][1], t[0][2], t[0][3], None) for i, t in enumerate(traces)]
    e = [(str(i), *row) for i, t in enumerate(traces) for row in t[1]]
    return session.createDataFrame(s, f"file STRING, {SESSION}"), session.createDataFrame(e, f"file STRING, seq INT, {EVENT}")


def test_latency(session):
    word = lambda *ends: [("w", 0.0, float(x)) for x in ends]
    s, e = frames(session, [trace(), trace(finals=()), trace(endpoints=(300, 1200)), trace(finals=((1000, word(300, 740)), (2500, word(2400)))), trace(finals=((1000, None), (2500, None))), trace(mode="forced"), trace(mode="forced", supported=False), trace(end=None)])
    got = {(r.file, r.metric): r for r in session_latency(s, e).collect()}
    value = lambda f, m: (got[str(f), m].status, got[str(f), m].value_ms, got[str(f), m].basis)
    assert len(got) == 40 and value(0, "setup") == ("ok", 50.0, None)
    assert value(0, "first_partial")[1] == 400 - 150 and value(0, "ttfs") == ("ok", 250.0, "last_final") and value(0, "endpoint") == ("ok", 350.0, None)
    assert value(1, "ttfs") == ("timeout", None, None) and got["2", "endpoint"].premature == 1 and value(2, "endpoint")[1] == 450.0
    assert value(3, "ttfs") == ("ok", 250.0, "word_timestamps") and value(4, "ttfs") == ("ok", 1750.0, "last_final")
    assert value(5, "endpoint")[0] == "not_applicable" and value(5, "finalize")[0] == "timeout" and value(6, "finalize")[0] == "not_supported" and value(7, "ttfs")[0] == "missing_ground_truth"
    assert {r.file: r.text for r in transcripts(e).collect()}["4"] == "t1000 t2500"


def test_endpoints(session):
    s, e = frames(session, [trace(), trace(endpoints=(300, 1200)), trace(endpoints=(3750,)), trace(endpoints=(3751,)), trace(endpoints=()), trace(endpoints=()), trace(mode="forced")])
    s = s.withColumn("complete", ~F.col("file").isin("5"))
    got = {r.file: (r.outcome, r.delay_ms, r.premature) for r in endpoint_outcomes(s, e).collect()}
    assert got == {"0": ("correct", 350.0, 0), "1": ("premature", None, 1), "2": ("correct", 3000.0, 0), "3": ("late", None, 0), "4": ("late", None, 0), "5": ("correct", None, 0), "6": ("unscorable", None, 0)}
    assert endpoint_outcomes(s, e.filter("false")).filter("outcome = 'unscorable'").count() == 6


def test_mulaw(session):
    every = bytes(range(256))
    levels = decode_mulaw(every)
    x = np.arange(-32768, 32768).astype("<i2")
    back = decode_mulaw(encode_mulaw(x)).astype(int)
    nearest = np.abs(levels.astype(int)[None, :] - x[::97, None]).min(axis=1)
    assert np.all(np.abs(back[::97] - x[::97]) <= nearest + 4) and encode_mulaw(np.zeros(1, "<i2")) == b"\xff"
    assert [r.v for r in session.range(256).select(mulaw_level(F.col("id")).alias("v")).collect()] == levels.tolist()
    df = session.createDataFrame([(bytearray(x.tobytes()),), (None,)], "b BINARY")
    assert bytes(df.select(mulaw_decoded(mulaw_encoded("b")).alias("v")).collect()[0].v) == back.astype("<i2").tobytes()


def test_wav_noise_and_rooms(session):
    rng = np.random.default_rng(1)
    speech, noise = (rng.integers(-3000, 3000, n).astype("<i2") for n in (4000, 1500))
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(speech.tobytes())
    got = session.createDataFrame([(bytearray(buf.getvalue()),)], "b BINARY").select(wav_decoded("b").alias("w")).collect()[0].w
    assert got.rate == 8000 and bytes(got.samples) == speech.tobytes()
    m = mix(speech, noise, 10.0, 100, 3000)
    assert m["scale"] == 1.0 and abs(20 * np.log10(level(speech, 100, 3000) / level(m["gain"] * np.resize(noise, 4000).astype(float), 100, 3000)) - 10) < 1e-9
    same = reverberate(speech, np.array([0, 1000, 0], "<i2"), 0, 4000)
    assert same["samples"] == speech.tobytes() and same["direct"] == 1
    loud = mix((speech * 10).astype("<i2"), noise, -10.0, 0, 4000)
    assert loud["scale"] < 1.0 and np.abs(np.frombuffer(loud["samples"], "<i2").astype(int)).max() == 32767
    h = rng.standard_normal(700)
    assert np.allclose(convolved(speech.astype(float), h), np.convolve(speech, h)) and np.allclose(convolved(speech[:5].astype(float), h), np.convolve(speech[:5], h))
    part, at = noise_part(noise, 100, np.random.default_rng(3))
    assert (part == noise[at : at + 100]).all() and noise_part(noise, 5000, rng)[1] == 0
    t = np.arange(8000) / 8000
    tone = lambda hz: np.rint(8000 * np.sin(2 * np.pi * hz * t)).astype("<i2")
    kept = [level(bandpass(tone(hz), 8000, 300, 3000), 1000, 7000) / level(tone(hz), 1000, 7000) for hz in (50, 1000, 3900)]
    assert kept[0] < 0.01 and 0.95 < kept[1] < 1.05 and kept[2] < 0.05
    assert abs(level(resampled(tone(440), 8000, 16000), 0, 16000) - level(tone(440), 0, 8000)) < 2 and len(resampled(tone(440), 8000, 16000)) == 16000
    with pytest.raises(ValueError):
        mix(np.zeros(10, "<i2"), noise, 10.0, 0, 10)


def test_suites(session):
    suites = session.createDataFrame([("b", ["phone"], ["en"], ["phone"]), ("a", ["phone"], ["en"], ["phone"]), ("c", ["web"], ["en", "de"], [])], SUITE)
    profiles = session.createDataFrame([("p", "phone", ["en-GB"], ["phone"], None), ("q", "phone", ["de"], ["x"], None), ("r", "phone", ["en"], [], "c"), ("s", "phone", ["en"], [], "none")], PROFILE)
    got = {r.profile_id: (r.suite_id, r.proxy) for r in match(profiles, suites).collect()}
    assert got == {"p": ("a", False), "q": ("a", True), "r": ("c", True)}


def test_report_cells(session):
    assert (report.percent(0.0742), report.interval(0.0742, 0.068, 0.081), report.points(0.0106), report.milliseconds(float("inf")), report.percent(None)) == ("7.4%", "7.4% [6.8, 8.1]", "+1.1 pp", "timeout", "n/a")
    df = session.createDataFrame([("b|c", 2), ("a", 1)], "k STRING, v INT")
    assert report.table(df, [("k", lambda r: r["k"]), ("v", lambda r: r["v"])], ["k"]) == "| k | v |\n|-|-|\n| a | 1 |\n| b\\|c | 2 |"


def _wav(rate, frames):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setparams((frames.shape[1], 2, rate, 0, "NONE", ""))
        w.writeframes(frames.astype("<i2").tobytes())
    return buf.getvalue()


def test_clips_take_their_channel_and_samples(session):
    rng = np.random.default_rng(4)
    frames = rng.integers(-20000, 20000, (9000, 2)).astype("<i2")
    data = _wav(16000, frames)
    rows = [(0, None, None), (1, 0.1, 0.2), (None, 0.55, 9.0), (1, None, 0.2)]
    df = session.createDataFrame([(bytearray(data), *r, 16000) for r in rows] + [(None, 0, None, None, 16000)], "b BINARY, c INT, s DOUBLE, e DOUBLE, r INT")
    got = [r.w for r in df.select(wav_clip("b", "c", "s", "e", "r").alias("w")).collect()]
    pcm = lambda x: np.frombuffer(bytes(x.samples), "<i2")
    assert np.array_equal(pcm(got[0]), frames[:, 0]) and np.array_equal(pcm(got[1]), frames[1600:3200, 1]) and np.array_equal(pcm(got[3]), frames[:, 1])
    assert np.array_equal(pcm(got[2]), np.rint(frames[8800:].mean(axis=1))) and got[0].file_rate == 16000 and got[4].samples is None
    for channel, start in ((2, None), (0, 0.6)):
        with pytest.raises(ValueError):
            wav_part(data, channel, start, 1.0, 16000)
    native = session.createDataFrame([(bytearray(frames.tobytes()),)], "x BINARY").select(wav_bytes(F.col("x"), F.lit(16000), F.lit(2)).alias("w")).first().w
    assert bytes(native) == data
    assert bytes(session.createDataFrame([(bytearray(b"ab"),)], "x BINARY").select(with_silence(F.col("x"), F.lit(8000), 3).alias("w")).first().w) == b"ab" + bytes(48)


@pytest.mark.parametrize("rates", [(44100, 16000), (16000, 8000), (8000, 16000), (22050, 16000), (11025, 48000)])
def test_resampling_in_blocks_keeps_tones_and_cuts_the_rest(rates):
    rate, to = rates
    t = np.arange(rate) / rate
    low, high = 0.3 * min(rates), 0.7 * min(rates)
    x = np.rint(8000 * np.sin(2 * np.pi * low * t) + (6000 * np.sin(2 * np.pi * high * t) if high < rate / 2 else 0)).astype("<i2")
    y = resampled(x, rate, to)
    assert y.size == to
    want = 8000 * np.sin(2 * np.pi * low * np.arange(to) / to)
    inner = slice(to // 20, -to // 20)
    assert np.abs(y[inner] - want[inner]).max() < 8000 * 2e-3
    # a stretch alone has the same samples, wherever its blocks begin
    part = np.concatenate([*output_blocks(lambda a, z: x[a:z], x.size, rate, to, 777, 6000)])
    assert np.array_equal(part, y[777:6000])


def test_a_cut_from_an_hour_reads_its_own_part_only():
    rate, seconds = 8000, 3600
    data = _wav(rate, (np.arange(rate * seconds) % 3000)[:, None])
    tracemalloc.start()
    made = wav_part(data, 0, 3000.0, 3002.0, 16000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made["samples"]) == 2 * 32000 and most < 20e6


def test_lexicons_of_any_size_are_tagged_in_one_walk(session, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    few = [Category(f"k{i}", terms=tuple({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(12)})) for i in range(3)] + [Category("n", builtin="number")]
    texts = [" ".join(rng.choice([word(), "7"]) for _ in range(rng.randrange(20))) for _ in range(300)]
    found = [(c, c.regex("mdy")) for c in few]
    df = session.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", tagged(F.col("t"), few).alias("s")).collect()}
    assert got == {i: tag(t, found) for i, t in enumerate(texts)}
    # a hundred thousand terms against a set of all of them
    terms = [f"{a}{b} {c}{d}" if (a + b) % 3 else f"{a}{b} {c}{d} {a}" for a in range(10) for b in range(10) for c in range(10) for d in range(100)]
    assert len(set(terms)) == 100_000
    trie, known = Trie((t, 0) for t in terms), set(terms)
    draw = [f"{rng.randrange(10)}{rng.randrange(10)}" if rng.random() < 0.5 else f"{rng.randrange(10)}{rng.randrange(100)}" if rng.random() < 0.8 else str(rng.randrange(10)) for _ in range(3000)]
    want, i = [], 0
    while i < len(draw):
        n = next((n for n in (3, 2) if " ".join(draw[i : i + n]) in known and i + n <= len(draw)), 0)
        want += [(0, i, i + n)] * bool(n)
        i += n or 1
    assert trie.spans(draw) == want and len(want) > 100
    spent = []
    for some in (terms[:100], terms):
        t = Trie((x, 0) for x in some)
        start = time.process_time()
        for _ in range(20):
            t.spans(draw)
        spent.append(time.process_time() - start)
    assert spent[1] < 6 * spent[0] + 0.2  # a thousand times the terms
    monkeypatch.setattr(entities, "MANY", 5)
    assert normal_terms(session, ["Ten mg", "ten  mg", "!", "a b", "c", "d"]) == ["10 mg", "a b", "c", "d"]


def test_traces_become_result_rows(session):
    sessions = session.createDataFrame([(f, "c", f"d:{f}/x") for f in "abcde"], "file STRING, config_id STRING, utt_id STRING")
    ev = [
        ("a", 1, "final", "hello", None), ("a", 2, "final", "you", None), ("b", 1, "final", "lost", None), ("b", 3, "error", None, '{"z": 1, "a": {"d": 2, "c": null}}'), ("b", 2, "error", None, '{"type": "Error", "code": 7}'), ("c", 1, "partial", "x", None),
        ("d", 1, "error", None, "not json" + "!" * 600), 
    ]
    events = session.createDataFrame(ev, "file STRING, seq INT, kind STRING, text STRING, raw STRING")
    refs = session.createDataFrame([(f"d:{f}/x", "word" if f != "e" else " ") for f in "abcde"], "utt_id STRING, ref_text STRING")
    got = {r.utt_id: (r.hyp_text, r.raw_response_path, r.error, r.suspect_empty) for r in result_rows(sessions, events, "r", refs).collect()}
    path = lambda f: f"traces/d__{f}_x.jsonl"
    assert got == {
        "d:a/x": ("hello you", path("a"), None, False), "d:b/x": ("", path("b"), 'ProviderError: {"code": 7, "type": "Error"}', False), "d:c/x": ("", path("c"), None, True),
        "d:d/x": ("", path("d"), "ProviderError: not json" + "!" * 492, False), "d:e/x": ("", path("e"), None, False),
    }
