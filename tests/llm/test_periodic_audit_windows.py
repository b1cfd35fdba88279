import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vocalith.llm import decontaminate, filter_audit, periodic

SMALL = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_definition(words, least=24, power=3):
    """Every (start, length, smallest period) by looking at each period's equal stretches and dropping those with a smaller period."""
    n, found = len(words), {}
    for p in range(1, n // power + 1):
        a = None
        for i in range(n - p + 1):
            if i < n - p and words[i] == words[i + p]:
                a = i if a is None else a
            elif a is not None:
                if i - a + p >= max(least, power * p):
                    found.setdefault((a, i + p), p)
                a = None
    return sorted((a, b - a, p) for (a, b), p in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 9), st.integers(2, 4))
def test_runs_are_those_of_the_definition(words, least, power):
    assert periodic.find_runs(np.array(words, np.int64), least, power) == runs_by_definition(words, least, power)


def test_runs_of_planted_repetitions_in_blocks(monkeypatch):
    draw = random.Random(3)
    words = []
    for p in (1, 2, 7, 40, 111):
        words += [draw.randrange(50) for _ in range(30)]
        unit = [draw.randrange(50) for _ in range(p)]
        words += (unit * 40)[: max(30, int(3.4 * p))]
    want = runs_by_definition(words)
    assert len(want) >= 5
    assert periodic.find_runs(np.array(words)) == want
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert periodic.find_runs(np.array(words)) == want


def test_runs_where_hashes_collide(monkeypatch):
    # on this sequence any polynomial hash modulo a power of two takes different stretches for equal
    morse = [i.bit_count() % 2 for i in range(1 << 12)]
    want = sorted((a, b - a, p) for (a, b), p in periodic._plain_runs(np.array(morse), 24, 3).items())
    assert periodic.find_runs(np.array(morse)) == want
    monkeypatch.setattr(periodic._Prefixes, "equal", lambda self, x, p, length: np.ones(len(x), bool))
    words = [0, 1] * 20 + [2, 3, 4] * 20 + [5] * 5
    assert periodic.find_runs(np.array(words)) == runs_by_definition(words)


def test_periodic_runs_of_odd_rows(spark):
    text = "x " + "a b c " * 10 + "y"
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (4, text, 5), (4, text, 5), (5, "w " * 30000, 5), (None, "ä ö " * 24, 5)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"))
    assert out.columns == ["doc_id", "runs", "n_words", "_runs", "collapsed"]
    got = out.collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert [by_id[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and by_id[1].collapsed == "" and by_id[3]["_runs"] == []
    assert [tuple(r) for r in by_id[4]["_runs"]] == [(1, 30, 3)] and by_id[4].collapsed == "x a b c y"
    assert by_id[5].collapsed == "w" and [tuple(r) for r in by_id[5]["_runs"]] == [(0, 30000, 1)]
    assert by_id[None].n_words == 24 and by_id[None].collapsed == "ä ö"  # other blanks belong to words
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op11_is_the_contracts_result(spark):
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    changed = 0
    for d in docs:
        w = BLANK.findall(d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        codes = {x: i for i, x in enumerate(dict.fromkeys(w))}
        c = np.array([codes[x] for x in w])
        runs, seen = [], set()
        for p in range(1, n // 3 + 1):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (c[:-p] == c[p:]).astype(int), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a + p >= max(24, 3 * p) and (a, b + p) not in seen:
                    seen.add((a, b + p))
                    runs.append((a, b - a + p, p))
        runs.sort()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
    assert changed > 5


def audited(docs, labels):
    """The audit by going through every order, document by document."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for i, t, lang in docs:
        text = t or ""
        w = BLANK.findall(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and text in first and first[text] < i,
        }
        for order in permutations("ABCDE"):
            at = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                c = out.setdefault((lang or "", "".join(order), k + 1), [0] * 6)
                c[0] += k < at
                c[1] += k == at
                c[2] += fails[f] and k > at
                c[3] += fails[f] and sum(fails.values()) == 1
                c[4] += k == at and i in good
                c[5] += k == at and i in toxic
    share = {}
    for (part, order, k), c in out.items():
        share[part, order[k - 1]] = share.get((part, order[k - 1]), 0) + c[1]
    return {key: (*c, share[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def test_audit_by_going_through_all_orders(spark):
    draw = random.Random(7)
    words = ["alpha", "beta", "Gamma", "#tag", "DELTA", "x$"]
    docs = [(1, None, "en"), (2, "", "en"), (3, "  ", None), (None, "", "en"), (None, "lone", ""), (None, "lone", ""), (9, "same text", "fr"), (8, "same text", "en"), (8, "same text", "en"), (10, "same text", "fr")]
    docs += [(20 + i, " ".join(draw.choice(words[: draw.randint(1, 6)]) for _ in range(draw.choice([3, 250]))), draw.choice(["en", "de", None])) for i in range(120)]
    docs += [(500 + i, " ".join(f"w{j}" for j in range(260)), "en") for i in range(40)] + [(700, " ".join(f"L{j}" for j in range(9000)), "de")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 560, 3)] + [(9, 0, 1), (9, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*x, "clash", 1.0) for x in docs], "doc_id long, text string, lang string, part string, n double")
    found = filter_audit.audit(d, spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, text int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == audited(docs, labels)
    assert filter_audit.audit(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_interactions_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, 0, 2), ("p", 1, 1, 3), ("p", 0, 1, 5), ("p", 0, 0, 7)], "g string, X long, Y long, rows long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(rows, "g", "XY", "rows", {}).collect()}
    assert got == {("XY", 1): (12, 5, 0, 2, 7), ("XY", 2): (7, 5, 3, 5, 13), ("YX", 1): (9, 8, 0, 5, 13), ("YX", 2): (7, 2, 3, 2, 7)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits_by_definition(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for i, t in items:
        x = WORD.findall((t or "").translate(LOWER))
        m = min(10, len(x))
        windows = {tuple(x[j : j + m]) for j in range(len(x) - m + 1)} if m else set()
        for j in range(len(w) - m + 1):
            if tuple(w[j : j + m]) in windows:
                hit.update(range(j, j + m))
                ids |= {i}
    return len(w), len(hit), sorted(map(str, ids - {None}))


def windows(spark, docs, items):
    found = decontaminate.shared_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return [(r.doc_id, r.n_words, len({p for s in r.spans for p in range(s.a, s.b)}), sorted(map(str, r["items"]))) for r in found.collect()]


def mixed_texts(seed):
    draw = random.Random(seed)
    some = lambda n, k: " ".join(draw.choice(["ab", "Ä", "c1", "ß", "e", "日本", "x"][:k]) for _ in range(n))
    items = [(i, some(draw.choice([1, 2, 5, 9, 10, 11, 14, 30]) if i % 4 else 12, 3 + i % 5)) for i in range(30)] + [(3, "twice the id"), (100, None), (101, ""), (102, "?!"), (None, "no name here at all"), (None, some(20, 7)), (103, " ".join(f"q{i}" for i in range(25))), (104, " ".join(f"q{i}" for i in range(5, 25)))]
    docs = [(i, some(draw.choice([0, 3, 15, 80]), 2 + i % 6)) for i in range(60)] + [(70, None), (71, ""), (72, "No-Name;HERE at\tall"), (72, "No-Name;HERE at\tall"), (None, "twice The ID"), (73, " ".join(f"Q{i}" for i in range(3, 40))), (74, "pre " + " ".join(f"q{i}" for i in range(9)) + " no"), (75, ("fill " * 9 + " ".join(f"q{i}" for i in range(20)) + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("sent", [200_000, 0])
def test_windows_by_definition(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT", sent)
    docs, items = mixed_texts(sent + 1)
    want = [(i, *hits_by_definition(t, items)) for i, t in docs]
    key = lambda r: (r[0] is None, str(r))
    assert sorted(windows(spark, docs, items), key=key) == sorted(want, key=key)


def test_windows_over_long_words_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    rows = [b"a" * 500 + b" b c", b"", b"x y z " * 40]
    whole = decontaminate.Words(rows)
    monkeypatch.setattr(decontaminate, "BLOCK", 1 << 20)
    assert whole.hash.tolist() == decontaminate.Words(rows).hash.tolist()
    assert (whole.last - whole.first).tolist() == [3, 0, 120]


def test_windows_of_every_length_and_place():
    # of any window, a text and an item keep the same stretch
    draw = random.Random(11)
    for t in range(1, 11):
        k, w = decontaminate.grams(t)
        assert k + w - 1 == t
        for _ in range(60):
            shared = [draw.choice("abc") for _ in range(t)]
            a = [draw.choice("abcd") for _ in range(draw.randrange(12))] + shared + [draw.choice("abcd") for _ in range(draw.randrange(12))]
            (_, x), (_, y) = (decontaminate.Words([" ".join(v).encode()]).winnowed(t) for v in (a, shared))
            assert set(y) <= set(x)


def test_windows_without_rows_and_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "s")], "doc_id long, text string, n_words int, row string")
    items = spark.createDataFrame([(5, "b c", 1)], "item_id long, text string, doc_id int")
    (r,) = decontaminate.shared_windows(docs, items).collect()
    assert (r.doc_id, r.n_words, r.row, r["_n_words"], [tuple(s) for s in r.spans], r["items"]) == (1, 7, "s", 3, [(1, 3)], [5])
    assert decontaminate.shared_windows(docs.limit(0), items).count() == 0
    (r,) = decontaminate.shared_windows(docs, items.limit(0)).collect()
    assert (r.spans, r["items"], r["_n_words"]) == ([], [], 3)
