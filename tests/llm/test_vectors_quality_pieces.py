import itertools
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import ann, embedding_dedup, pieces, quality

VECS = "vec_id bigint, embedding array<float>, label int"


def vectors(n=600, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + 60] = x[3] + 0.02 * rng.standard_normal((60, dims)).astype(np.float32)
    x[-20:] = x[5]
    return x


def frame(spark, x, more=()):
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, VECS)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] * 16, 1), (9050, [1.0, None] + [1.0] * 14, 1), (9100, [], 1), (9150, [1.0, 2.0], 1)]


def test_search_finds_the_nearest_and_ranks_ties_by_id(spark):
    x = vectors()
    df = frame(spark, x, [*ODD, (None, [1.0] * 16, 1)]).withColumn("score", F.lit("mine"))
    got = ann.nearest(df, every=20).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 20))
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        s = u @ u[q]
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in rs]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s.round(12)))[:5]
        hits += len(set(want) & {r.vec_id for r in rs})
        total += 5
    assert hits / total >= 0.9


def test_search_of_few_vectors_returns_all_candidates(spark):
    got = ann.nearest(frame(spark, vectors()[:3]), every=1).collect()
    assert len(got) == 6
    assert ann.nearest(frame(spark, vectors()[:0])).collect() == []
    assert ann.nearest(frame(spark, vectors()[:1])).collect() == []


def test_repeated_rows_take_no_places_from_other_neighbours(spark):
    x = vectors()[:40]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(40)
    more = [(int(i), [float(v) for v in x[i]], 0) for i in s[[0, 20]].argmax(1) for _ in range(12)]
    far = int((u @ u[0]).argmin())
    more += [(far, [float(v) for v in x[0] * 2.0**j], 0) for j in range(12)]  # further vectors of one id, as near as 0
    s[0, far] = 1
    s[20, far] = max(s[20, far], s[20, 0])
    got = ann.nearest(frame(spark, x, more), every=20).collect()
    for q in (0, 20):
        want = np.lexsort((np.arange(40), -s[q].round(12)))[:5].tolist()
        assert [(r["rank"], r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(enumerate(want, 1))


def brute_links(x, least=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= least
    low = np.arange(len(x))
    while True:
        new = np.array([low[near[i]].min() for i in range(len(x))])
        if (new == low).all():
            return near.sum(1) - 1, low
        low = new


@pytest.mark.parametrize("per_cell", [400, 10])
def test_embedding_links_match_brute_force(spark, monkeypatch, per_cell):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    x = vectors()
    got = embedding_dedup.link(frame(spark, x, [*ODD, (None, [1.0] * 16, 1)])).collect()
    n, low = brute_links(x)
    assert len(got) == 600 + len(ODD) + 1
    for r in got:
        if r.vec_id is not None and r.vec_id < 600:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], low[r.vec_id], low[r.vec_id] == r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embedding_dedup.link(frame(spark, x[:0])).collect() == []


def test_different_vectors_of_one_id_link_and_count_apart(spark):
    x = vectors()[:6]
    near = lambda v, j: [float(a) for a in v + 0.001 * j * np.arange(16, dtype=np.float32)]
    rows = [(7, near(x[0], 0), 0), (7, near(x[0], 1), 0), (3, near(x[0], 2), 0), (9, near(x[1], 0), 0), (9, near(x[2], 0), 0), (5, near(x[2], 1), 0)]
    rows.append(rows[0])
    got = sorted(tuple(r) for r in embedding_dedup.link(spark.createDataFrame(rows, VECS)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == sorted([(7, 3, 3, False)] * 3 + [(3, 3, 3, True), (9, 0, 9, True), (9, 1, 5, False), (5, 1, 5, True)])


def test_large_buckets_are_dealt_into_blocks(spark, monkeypatch):
    import vocalith.llm.vectors as v

    monkeypatch.setattr(v.dealt, "__defaults__", (16,))
    x = vectors(200)
    x[50:] = x[3] + 0.02 * np.random.default_rng(4).standard_normal((150, 16)).astype(np.float32)
    n, low = brute_links(x)
    got = embedding_dedup.link(frame(spark, x)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, n[i], low[i]) for i in range(200)}


GOOD = ["The patient was seen today and reports feeling much better after the treatment.", "We walked along the river until the evening light had gone.", "Please call the office tomorrow morning to arrange a visit.", "A short note on how the engine reads its tables and joins them."]


def labelled(spark):
    docs, labels = [], []
    for i in range(240):
        text = " ".join(GOOD[(i + k) % 4] for k in range(1 + i % 5))
        bad = i % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), " ".join([text.split()[0]] * 40)][i % 3]
        docs.append((i, text, "en", "s", len(text), "mine"))
        labels.append((i, int(not bad), 0))
    docs += [(1000, None, "en", "s", 0, "x"), (1001, "", None, None, None, None), (1002, "  ", "en", "s", 2, "x"), (None, GOOD[0], "en", "s", 2, "x"), (1, docs[1][1], "en", "s", 2, "x"), (1003, "word " * 200_000, "en", "s", 2, "x")]
    labels += [(None, 1, 0), (5, None, 0), (77_777, 1, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_votes_hold_out_a_fold_and_score_every_row(spark):
    import zlib

    docs, labels = labelled(spark)
    scored, name = quality.score(docs, labels)
    rows = scored.collect()
    assert name == "_score" and len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum((r[name] >= quality.THRESHOLD) == bool(truth[r.doc_id]) for r in held if truth[r.doc_id] is not None)
    assert len(held) > 30 and right / len(held) >= 0.95
    assert all(0 <= r[name] <= 1 for r in rows)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs, flipped)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < 240


def test_quality_without_labels_or_documents(spark):
    docs, labels = labelled(spark)
    assert {r._score for r in quality.score(docs, labels.where("false"))[0].collect()} == {0.5}
    assert quality.score(docs.where("false"), labels)[0].collect() == []


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file here")
TEXTS = ["Hello world", "", None, " lead", "trail ", "two  blanks   three", "   ", "▁mark ▁▁ up", "línea\nnueva\t tab", "emoji 👩‍👩‍👧 \u0000 nul", "<s> </s> <unk> <0x0A>", "日本語テキスト", "a" * 3000, "x y " * 20_000, " nbsp sep"]


@needs_model
def test_pieces_equal_the_library_and_decode_to_the_text(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)] + [(None, "Hello world", None)], "doc_id bigint, text string, parity string")
    done = pieces.encode(docs, kept=("doc_id", "parity"))
    assert done.columns == ["doc_id", "parity", "ids", "restored", "_parity"]
    for r in done.collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else "Hello world"
        assert r.ids == sp.encode(text or "") and r._parity
        assert r.restored == ("▁" not in (text or ""))  # the marker itself decodes to a blank
    assert {r.doc_id: r.decoded for r in pieces.decode(done).collect() if r.doc_id is not None} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    assert pieces.encode(docs.where("false")).collect() == []


@needs_model
def test_memo_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 8)
    codec = pieces.Codec(open(pieces.MODEL, "rb").read(), 1)
    for i in range(20):
        text = " ".join(f"word{i}{k}" for k in range(10))
        ((ids, restored, same),) = codec.encode([text])
        assert ids.tolist() == codec.theirs.encode(text) and restored and same and codec.decode([ids.tolist()]) == [text]
    assert codec.own.decode(codec.theirs.encode("Hello wörld ☃")) == "Hello wörld ☃"


def message(*fields):
    """A protobuf message of (number, value) fields: integers, floats, texts and messages."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def unigram(squeeze):
    words = {"▁": -3.0, "▁the": -2.0, "▁then": -4.5, "n": -4.0, "▁ca": -3.5, "t": -3.0, "cat": -2.5, "s": -3.2, "a": -4.1, "c": -4.2, "▁t": -3.9, "he": -3.0, "e": -4.0, "h": -4.4, "é": -5.0}
    pieces_ = [message((1, "<unk>"), (2, 0.0), (3, 2)), message((1, "<s>"), (2, 0.0), (3, 3))] + [message((1, f"<0x{i:02X}>"), (2, 0.0), (3, 6)) for i in range(256)] + [message((1, w), (2, v)) for w, v in words.items()]
    trainer, normaliser = message((3, 1), (35, 1), (40, 0)), message((3, 1), (4, int(squeeze)), (5, 1))
    return message(*((1, p) for p in pieces_), (2, trainer), (3, normaliser))


@pytest.mark.parametrize("squeeze", [False, True])
def test_a_unigram_model_agrees_with_the_library(squeeze):
    codec = pieces.Codec(unigram(squeeze), 1)
    assert codec.model.kind == pieces.UNIGRAM and codec.model.splits == (not squeeze)
    texts = ["the cat", "then the cats ate", "thé ☃ cat", "", None, "the  cat ", " the", "zq" * 50, "cat " * 400 + "cat"]
    for text, (ids, restored, same) in zip(texts, codec.encode(texts)):
        assert same and ids.tolist() == codec.theirs.encode(text or "")
        assert codec.decode([ids.tolist()]) == [codec.theirs.decode(ids.tolist())]
        assert restored == (codec.theirs.decode(ids.tolist()) == (text or ""))


def test_a_wrong_piece_is_told(monkeypatch):
    codec = pieces.Codec(unigram(False), 1)
    true = codec.own.encode_batch_fast
    monkeypatch.setattr(codec, "own", type("Other", (), {"encode_batch_fast": lambda _, new, **k: [type("E", (), {"ids": e.ids[:-1] if c == "cats" else e.ids})() for c, e in zip(new, true(new, **k))], "decode_batch": lambda _, ids, **k: [" ".join(map(str, i)) for i in ids]})())
    (_, restored, same), (_, _, other) = codec.encode(["the cats", "the cat"])
    assert not same and not restored and other


class Tampered:
    """The rebuilt tokenizer, which counts the texts it gets and can lose a word's last piece or change its decoded text."""

    def __init__(self, own, shorter=None, spoilt=None):
        self.own, self.shorter, self.spoilt, self.texts = own, shorter, spoilt, 0

    def encode_batch_fast(self, texts, **kwargs):
        self.texts += len(texts)
        return [type("E", (), {"ids": e.ids[:-1] if self.shorter in t.split(" ") else e.ids}) for t, e in zip(texts, self.own.encode_batch_fast(texts, **kwargs))]

    def decode_batch(self, ids, **kwargs):
        return [" ".join("?" if w == self.spoilt else w for w in t.split(" ")) for t in self.own.decode_batch(ids, **kwargs)]


@pytest.mark.parametrize("shorter, spoilt", [(None, None), ("cats", None), (None, "cats")])
def test_new_chunks_go_in_groups_and_a_wrong_one_is_told(shorter, spoilt):
    codec = pieces.Codec(unigram(False), 1)
    codec.own = Tampered(codec.own, shorter, spoilt)
    words = ["".join(w) for k in (1, 2, 3, 4) for w in itertools.product("canté☃", repeat=k)][:999] + ["the", "cats", "x\ny", "▁the", "c▁at"]
    texts = [*words, " ".join(words), "", "  ".join(words[::-1]), " the  cats "]
    done = codec.encode(texts)
    if not shorter and not spoilt:
        assert codec.own.texts < 1200  # about 1000 chunks behind more than one blank go alone, as many others 32 at a time
        assert codec.encode(texts[:50])[7][0].tolist() == codec.theirs.encode(texts[7])
    for text, (ids, restored, same) in zip(texts, done):
        right = "cats" not in text
        assert same == (right or not shorter)
        assert restored == ("▁" not in text and (right or not (shorter or spoilt)))
        if same:
            assert ids.tolist() == codec.theirs.encode(text)


def test_an_unknown_piece_decodes_as_in_the_library():
    codec = pieces.Codec(unigram(False), 1)
    ids = [[259, 0, 261], [259, 259, 0], [259, 0, 0, 259]]
    assert codec.decode(ids) == [codec.theirs.decode(i) for i in ids]


def test_the_graph_finds_near_centroids_and_compares_few():
    rng = np.random.default_rng(8)
    c = rng.standard_normal((900, 12)) * 0.3 + np.repeat(rng.standard_normal((30, 12)) * 3, 30, axis=0)
    x = c[rng.choice(900, 400)] + 0.1 * rng.standard_normal((400, 12))
    g = ann.Graph(c)
    true = np.linalg.norm(x[:, None] - c[None], axis=2)
    node, d = g.closest(x, 16)
    assert g.compared < 0.4 * true.size and (node[:, 0] == true.argmin(1)).mean() > 0.97
    assert np.allclose(d, np.take_along_axis(true, node, 1), atol=1e-2) and (np.diff(d, axis=1) >= 0).all()
    g.compared = 0
    r, n, d = g.within(x, 1.3, 2)
    assert g.compared < 0.4 * true.size and (np.bincount(r, minlength=400) >= 2).all()
    wanted = true <= 1.29 * true.min(1)[:, None]
    got = np.zeros_like(wanted)
    got[r, n] = True
    assert (got & wanted).sum() / wanted.sum() > 0.95


def test_the_multi_sequence_walk_visits_cells_in_order_up_to_its_bound():
    x = vectors(900).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = embedding_dedup.MultiIndex(x, 7)
    own, r, c = m.cells(x)
    one, two = m.parts(x)
    sums = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
    got = np.zeros_like(sums, bool)
    got[r, c] = True
    assert (got == (sums <= (one.min(1) + two.min(1) + m.slack)[:, None])).all() and len(r) == got.sum()
    for i in range(0, 900, 50):
        walk = c[r == i]
        assert walk[0] == own[i] == sums[i].argmin() and (np.diff(sums[i, walk]) >= -1e-12).all()


def test_marks_beside_blanks_get_the_librarys_ids():
    codec = pieces.Codec(open(pieces.MODEL, "rb").read())
    texts = ["".join(x) for n in range(1, 6) for x in itertools.product("▁ ax", repeat=n)]
    theirs = codec.theirs.encode(texts)
    back = codec.theirs.decode(theirs)
    for text, (ids, restored, parity), a, b in zip(texts, codec.encode(texts), theirs, back):
        assert ids.tolist() == a and parity and restored == (b == text)
    # a library that says something else is told of, marks or not
    codec.forget()
    codec.theirs = type("Other", (), {"encode": lambda self, some, num_threads=1: [[1, 2, 3] for _ in some]})()
    assert not any(parity for _, _, parity in codec.encode(["a▁ x", "plain"]))


def test_votes_are_those_of_plain_sums_with_ties():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(1, 5)))
    texts = [" ".join(word() for _ in range(rng.integers(1, 40))) for _ in range(120)]
    learned = texts + texts[:40] * 2  # three of the same text tie
    labels = rng.integers(0, 2, len(learned)).astype(np.float32)
    asked = texts[:60] + [" ".join(word() for _ in range(20)) for _ in range(140)] + ["long " * 40_000, "", None, " \n"]
    model = quality.Model(quality.term_matrix(learned), labels, dims=16, neighbours=7)
    got = model.scores(asked)
    vectors = model.vectors.astype(np.float64)
    tied = 0
    for text, score in zip(asked, got):
        if not (text and text.strip()):
            assert score == pytest.approx(labels.mean())
            continue
        v = model.latent(quality.term_matrix([text]))[0].astype(np.float64)
        sims = [float(sum(x * y for x, y in zip(v, u))) for u in vectors]
        least = sorted(sims, reverse=True)[6]
        votes = [(max(s, 0.0) ** 4, label) for s, label in zip(sims, labels) if s >= least - 1e-6]
        tied += len(votes) > 7
        total = sum(w for w, _ in votes)
        assert score == pytest.approx(sum(w * label for w, label in votes) / total if total > 1e-12 else labels.mean(), abs=2e-4)
    assert tied > 20
