import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vocalith.llm import mixing, sharding, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def brute_shard(key, weights):
    def cost(i, w):
        v = int(hashlib.md5(f"{'null' if key is None else key}#{i}".encode()).hexdigest()[:12], 16)
        return -math.log((v + 0.5) / 2**48) / w

    return min((cost(i, w), i) for i, w in enumerate(weights))[1]


def test_shards_match_brute_force_and_only_the_new_shard_gains(spark):
    rows = [(i, f"text {i % 50} é", "a") for i in range(400)] + [(None, None, None), (None, "x", "a"), (7, "text 7 é", "a"), (7, "text 7 é", "a")]
    weights = (1.0, 2.0, 1.0, 0.5)
    rows += [(800, "long " * 500_000, "a")] + [(9, "text 9 é", "a")] * 300
    got = sharding.shard(docs(spark, rows).withColumn("size", F.lit("mine")).withColumn("_salt", F.lit("mine")), weights, 1.5).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == brute_shard(r.doc_id, weights)
        assert r.grown_shard == brute_shard(r.doc_id, (*weights, 1.5))
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_shards_of_an_empty_table(spark):
    assert sharding.shard(docs(spark, [])).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, per = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / per > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * w[s] / per for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_are_capped_and_reshared(spark):
    for sizes in ({"a": 10, "b": 500, "c": 90, None: 40}, {"a": 1, "b": 1, "c": 1000}, {"z": 5}, {"a": 0, "b": 7, "B": 9, "é": 3}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), "s%d" % (i % 4 if i % 3 else 0)) for i in range(900)]
    rows += [(900, None, "s1"), (901, "", None), (902, " \t\n", "s2"), (None, "a b c", None), (5, "dup dup", "s1"), (5, "dup dup", "s1"), (5, "dup dup", "s1")]
    got = mixing.expand(mixing.decide(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    for s in want:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(2, 0.01 * want[s])
    again = mixing.expand(mixing.decide(docs(spark, rows[::-1]).repartition(3))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def nearest_subset(sizes, target, cap=3):
    """The least distance to the target of any choice of 0 to ``cap`` copies."""
    reach = 1
    for n in sizes:
        reach = reach | reach << n | reach << 2 * n | reach << 3 * n if cap == 3 else reach | reach << n
    return min(abs(i - target) for i in range(max(0, int(target) - max(sizes)), int(target) + max(sizes) + 1) if reach >> i & 1)


def test_sources_of_few_and_unequal_documents_come_as_near_as_any_choice_nearly(spark):
    import random

    rng, rows = random.Random(6), []
    for s in range(12):
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), "w " * int(rng.lognormvariate(4, 1.5) + 1), f"s{s:02d}"))
        rows.append((len(rows), "w " * rng.randrange(2000, 9000), f"s{s:02d}"))
    rows.append((len(rows), "w " * 200_000, "s12"))
    got = mixing.expand(mixing.decide(docs(spark, rows))).collect()
    for s in sorted({r[2] for r in rows}):
        own = [r for r in got if r.source == s]
        miss = abs(sum(r.taken for r in own) - own[0].target)
        best = nearest_subset([r.size for r in own], own[0].target)
        assert miss <= best + 0.01 * own[0].target + min(r.size for r in own), (s, miss, best, own[0].target)


def test_many_documents_of_one_size_go_through_the_tree(spark):
    rows = [(i, "w " * (3 + i % 2), "a" if i % 3 else "b") for i in range(6000)] + [(9000, "w " * 5000, "b")]
    got = mixing.expand(mixing.decide(docs(spark, rows))).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and max(r.copies for r in own) <= 3


def test_mixed_rows_follow_the_plan_and_keep_clashing_columns(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "s%d" % (i % 3)) for i in range(120)] + [(3, "w w", "s0"), (3, "w w", "s0"), (None, None, None)]
    d = docs(spark, rows).withColumn("_mix_size", F.lit("mine")).withColumn("copies", F.lit(9))
    got = mixing.mix(d)
    assert got.columns == d.columns
    taken = defaultdict(int)
    for r in got.collect():
        taken[r.source] += len(r.text.split())
    plan = defaultdict(int)
    for r in mixing.expand(mixing.decide(d)).collect():
        plan[r.source] += r.taken
    assert {k: v for k, v in plan.items() if v} == dict(taken)
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.expand(mixing.decide(docs(spark, []))).collect() == []


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls_match_rules_and_the_models_judge_the_rest(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://a.example.com/en", "x://com", "x://com/", "x://É.com/ü", "http://b.net/es/1", "http://c.net/fr/", "http://c.netx/fr/", "a://b://com/q", "http://d.org/" + "l" * 100_000]
    urls += [f"https://blog.fine{i}.com/good/{i}" for i in range(60)] + [f"https://spam{i}.net/es/pills-{i}" for i in range(60)]
    urls += ["https://blog.fine.org/good/7", "https://spam7.org/es/pills-7"]
    rows = [(i, u, "html") for i, u in enumerate(urls)] + [(None, urls[4], None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("score", F.lit("mine"))).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.page_id] if r.page_id is not None else urls[4])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    by = {r.page_id: r for r in got}
    assert by[len(urls) - 2].verdict == "allow" and by[len(urls) - 1].verdict == "block"
    assert by[0].score == by[1].score == 0.0
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


class Markov:
    """The model that the counts stand for, in plain Python."""

    def __init__(self, texts, order=5):
        self.counts = defaultdict(Counter)
        for t in texts:
            t = "\x02" + t + "\x03"
            for i in range(1, len(t)):
                for k in range(min(order, i) + 1):
                    self.counts[t[i - k : i]][t[i]] += 1

    def prob(self, context, char):
        p = 1 / 1024
        for k in range(len(context) + 1):
            c = self.counts.get(context[len(context) - k :])
            if c:
                p = (c[char] + len(c) * p) / (sum(c.values()) + len(c))
        return p


def test_scores_match_brute_force_models(spark):
    good = [f"https://blog.fine{i % 7}.com/good/{i}" for i in range(80)] + ["http://é.com/ü", "x://com/" + "long" * 20_000]
    bad = [f"https://spam{i % 5}.net/es/pills-{i}" for i in range(60)]
    rest = ["https://blog.fine.org/good/7", "https://spam7.org/es/pills-7", "http://", "☃", "x://org/" + "pills" * 9_000]
    urls = [*good * 2, *bad, *bad[:1] * 500, *rest, rest[0], None, ""]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)).collect()
    labelled = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "url string, verdict string")
    held = {r.url for r in labelled.where(F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) == 0).collect()}
    assert 10 < len(held) < 60
    a, b = Markov(set(good) - held), Markov(set(bad) - held)

    def score(u):
        t = "\x02" + u + "\x03"
        return sum(math.log(a.prob(t[max(0, i - 5) : i], t[i])) - math.log(b.prob(t[max(0, i - 5) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)

    at = url_filter.calibrate([round(score(u), 9) for u in good if u in held], [round(score(u), 9) for u in bad if u in held])
    assert len(got) == len(urls)
    for r in got:
        u = urls[r.page_id] or ""
        assert (r.rule is None) == (r.score is not None)
        if r.rule is None:
            assert abs(r.score - (score(u) if u else 0.0)) < 1e-8 and r.verdict == ("allow" if r.score >= at else "block")
    chars = {c for t in good for c in t} | {"\x03"}
    for context in ("", "h", "htt", "zz"):
        assert 0.5 < sum(a.prob(context, c) for c in chars) < 1 + 1e-9


def test_all_labelled_urls_count_and_set_the_threshold(spark, tmp_path, monkeypatch):
    good = [f"https://{a}{i}.com/{b}/{i % 7}" for i in range(12) for a, b in (("blog", "good"), ("fine", "post"), ("fine", "good"), ("spam", "news"))]
    bad = [f"https://{a}{i}.net/{b}/{i % 5}" for i in range(12) for a, b in (("spam", "es/pills"), ("pill", "fr/cheap"), ("blog", "fr/cheap"), ("fine", "es/pills"))]
    rest = [f"https://{a}{i}.org/{b}/{i}" for i in range(4) for a in ("blog", "spam", "fine") for b in ("good", "es/pills", "post", "news", "fr/good", "cheap")]
    urls = [*good, *bad, *bad[:1] * 500, *rest, None]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found, threshold = [], getattr(url_filter, "threshold", None)
    monkeypatch.setattr(url_filter, "threshold", lambda marks: found.append(threshold(marks)) or found[-1], raising=False)
    got = url_filter.op2_url_ratio_filter(spark, str(tmp_path)).collect()
    part = {r.url: r.part for r in spark.createDataFrame([(u,) for u in good + bad], "url string").withColumn("part", F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5))).collect()}
    assert set(part.values()) == set(range(5))

    def score(u, left_out):
        if left_out not in models:
            models[left_out] = [Markov(v for v in kind if part[v] != left_out) for kind in (good, bad)]
        (a, b), t = models[left_out], "\x02" + u + "\x03"
        return round(sum(math.log(a.prob(t[max(0, i - 5) : i], t[i])) - math.log(b.prob(t[max(0, i - 5) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1), 9)

    models = {}
    at = url_filter.calibrate(*([score(u, part[u]) for u in kind] for kind in (good, bad)))
    assert len(got) == len(urls)
    judged = Counter()
    for r in got:
        if u := urls[r.page_id]:
            assert (r.rule is None) == (u in rest)
            if r.rule is None:
                assert abs(r.score - score(u, None)) < 1e-8 and r.verdict == ("allow" if r.score >= at else "block")
                judged[r.verdict] += 1
    assert min(judged["allow"], judged["block"]) > 5
    assert len(found) == 1 and abs(found[0] - at) < 1e-8


def test_threshold_of_tables_is_that_of_lists(spark):
    def both(marks):
        lists = [[s for s, v in marks if v == kind] for kind in ("allow", "block")]
        return url_filter.threshold(spark.createDataFrame(marks, "score double, verdict string").repartition(5)), url_filter.calibrate(*lists)

    def best(marks):
        """The first cut of a plain search with the most right, the least score if that isn't better than to allow all."""
        a, b = ([s for s, v in marks if v == kind] for kind in ("allow", "block"))
        at = sorted({s for s, _ in marks})
        right = lambda c: sum(s >= c for s in a) * len(b) + sum(s < c for s in b) * len(a)
        return max([at[0], *((x + y) / 2 for x, y in zip(at, at[1:]))], key=right)

    draw = random.Random(7)
    some = [(round(draw.gauss(k, 1), 1), v) for k, v in ((1, "allow"), (-1, "block")) for _ in range(300)]
    for marks in (some, [(-s, v) for s, v in some], [(1.0, "allow"), (1.0, "block")], [(2.0, "allow"), (1.0, "block"), (3.0, "block")]):
        assert both(marks) == (best(marks), best(marks))
    assert both([(1.0, "allow")]) == both([]) == (0.0, 0.0)
    # more of a class than 20,000, and the split lies among the last of them
    many = [(i / 1000, "block") for i in range(30_000)] + [(i / 1000 + 0.0005, "allow") for i in range(25_000, 55_000)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # several ranges
    try:
        assert len(set(both(many))) == len(set(both(some))) == 1
    finally:
        spark.conf.unset(coalesce)


def test_warc_round_trip(spark, tmp_path):
    bodies = ["<p>one</p>", None, "", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n\r\n\r\nc", "\r\n", "é" * 999, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "<p>one</p>", "x" * 5000 + "\r\n\r\n" + "y" * 5000, "\r", "z\r\n\r", "<p>one</p>"]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: y", b) for i, b in enumerate(bodies)] + [(12, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", "\r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    warc.write(pages.repartition(3), str(tmp_path / "w"), chunk=1000)
    table = warc.read(spark, str(tmp_path / "w"))
    body = lambda b: (b or "").encode()
    top = {}
    for i, _, b in rows:
        if i is not None:
            top[body(b)] = max(i, top.get(body(b), i))
    want = Counter()
    for i, _, b in rows:
        visit = top.get(body(b), i) != i
        want[(i, len(body(b)), base64.b32encode(hashlib.sha1(body(b)).digest()).decode(), "revisit" if visit else "response", top[body(b)] if visit else None)] += 1
    last = table.where("last").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last) == want
    assert all(r.digest_ok for r in last if r.record_type == "response")
    for i in (2, 4, 6, 9):
        parts = sorted((r.chunk, bytes(r.data)) for r in table.where((F.col("page_id") == i) & (F.col("record_type") == "response")).collect())
        assert b"".join(d for _, d in parts) == body(bodies[i]) and max(len(d) for _, d in parts) <= 1000
        assert [c for c, _ in parts] == list(range(len(parts)))


def test_cut_off_archives_fail(spark, tmp_path):
    import gzip

    import pytest

    pages = spark.createDataFrame([(1, "u", "<p>" + "x" * 3000), (2, "v", "<p>two")], "page_id bigint, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), chunk=1000)
    whole = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("part-*")))
    starts = [m.start() for m in re.finditer(rb"WARC/1.1\r\n", whole)]
    assert len(starts) == 5
    for n in (starts[1], starts[1] + 30, starts[2] - 200, len(whole) - 6, len(whole)):
        folder = tmp_path / f"cut{n}"
        folder.mkdir()
        with gzip.open(folder / "a.gz", "wb") as f:
            f.write(whole[:n])
        if n == len(whole):
            assert warc.read(spark, str(folder)).where("last").count() == 2
        else:
            with pytest.raises(Exception, match="ends within a record|doesn't end where"):
                warc.read(spark, str(folder)).collect()


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).collect() == []
