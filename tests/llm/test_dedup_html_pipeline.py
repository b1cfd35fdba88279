import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import bagminhash, html_text, pieces
from vocalith.llm.common import components

SF = "/root/testdata/sf0.001"

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_bag(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(rows, least=0.8):
    bags = [brute_bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= least * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return [min((d for d in ids[root(i)] if d is not None), default=None) if bags[i] else rows[i][0] for i in range(len(rows))]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        rows.append([word() for _ in range(rng.randrange(8, 300))] + (shared if i % 3 == 0 else []))
    for i in range(60):
        t = list(rows[i % 12])
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append(t)
    rows.append(["again", "and", "again", "it", "says"] * 400)
    rows.append(["again", "and", "again", "it", "says"] * 430)
    rows.append(["again", "and", "again", "it", "says"] * 100)
    texts = [(i, " ".join(t)) for i, t in enumerate(rows)]
    texts += [(500, texts[3][1]), (501, texts[3][1]), (502, texts[3][1].upper()), (503, "short one"), (504, "short one"), (505, ""), (506, None), (507, " \n"), (None, texts[7][1]), (3, texts[3][1]), (508, "only"), (None, "nowhere else to be found at all")]
    return texts


@pytest.mark.parametrize(("block", "shingles"), [(256, 10**6), (4, 10**6), (256, 900)])
def test_near_duplicates_match_brute_force(spark, block, shingles):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).withColumn("class_id", F.lit("mine"))
    got = bagminhash.classes(docs, block=block, shingles=shingles).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip((d for d, _ in rows), brute_classes(rows)))
    if block == 4:
        return
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for (_, t), c in zip(rows, brute_classes(rows)) if (t or "").split()}
    stays = [r.doc_id for r in kept.collect() if (r.text or "").split()]
    assert len(stays) == len(set(stays)) and set(stays) == want
    assert sum(not (r.text or "").split() for r in kept.collect()) == 3


def test_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert bagminhash.classes(docs).collect() == [] and bagminhash.keep_one(docs).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(4):
        g = np.sort(rng.choice(2**60, 40, replace=False).astype(np.uint64))
        a, b = rng.integers(1, 40, 40), rng.integers(1, 40, 40)
        s = bagminhash.signatures([(g, a), (g, b)], 8000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / 8000) ** 0.5
        assert abs(bagminhash.overlap((g, a), (g, b)) - want) < 1e-12


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100 + i, 100) for i in range(1, 90)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{100 + i: 100 for i in range(90)}}
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000, 1000 + i) for i in range(400)]
    up = list(range(1500))
    for _ in range(40):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: up[n] for e in edges for n in e if any(n in f and f[0] != f[1] for f in edges)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice"><p>We use cookies</p></div><article><header><h1>A &amp; B&hellip;</h1><p>by me</p></header><p>First <b>bold</b>
 line&nbsp;here</p><p><b>Title<br><p>Broken &lt;b&gt;<aside>Side</aside></p><form><p>Name</p><input></form><ul><li>one</li><li>two</li></ul><p>Share on all networks</p><noscript>no</noscript></article>
<section class="comments"><article><p>Reader says</p></article></section><aside>Side</aside><footer>&copy; me</footer></body>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "A & B…\nFirst bold line here\nTitle\nBroken <b>\none\ntwo\nShare on all networks"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav><script>") == ""
    assert html_text.main_text("<p>a<p>b <i>c</i>d</div><a href='x>y'>e</a>") == "a\nb cd\ne"
    assert html_text.main_text("<div class=ad>unclosed <article><p>kept") == "kept"
    assert html_text.main_text("plain &#65;") == "plain A"
    assert html_text.main_text("<p>" + "word " * 300_000) == ("word " * 300_000).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='single has-sidebar'><article><p>kept</p></article></body>", "kept"),
        ("<body class='comments-open sidebar'><p>kept</p></body>", "kept"),
        ("<div class='layout-sidebar-right'><article><p>kept</p></article></div>", "kept"),
        ("<div class='content-sidebar-wrap'><main><p>kept</p></main><div class='sidebar'><p>no</p></div></div>", "kept"),
        ("<div class='sidebar'><div class='related'><article><p>kept</p></article></div></div>", "kept"),
        ("<div class='sidebar'>" * 20 + "<main><p>kept</p></main>", "kept"),
        ("<div class='post'><p>kept</p></div><section class='comments'><article><p>a longer comment</p></article></section>", "kept"),
        ("<article><p>kept</p></article><section class='post-comments'><article><p>a longer comment</p></article></section>", "kept"),
        ("<article><p>kept</p></article><div class='sidebar'><article><p>no</p></article></div>", "kept"),
        ("<p>one</p><svg class='a'/><p>two</p><math/><p>three</p>", "one\ntwo\nthree"),
        ("<p>one</p><template-card><p>two</p></template-card><object-x></object-x><p>three</p>", "one\ntwo\nthree"),
        ("<p>one</p><object data='a'><canvas><svg><p>two</p>", "one\ntwo"),
        ("<p>one</p><svg><title>no</title></svg><canvas>no</canvas><template>no</template><p>two</p>", "one\ntwo"),
        ("<p>one</p>" + "<canvas>" * 100_000 + "<p>two</p>", "one\ntwo"),
    ],
)
def test_names_and_unclosed_elements_swallow_no_article(page, want):
    assert html_text.main_text(page) == want


def test_template_texts_go_and_slots_stay(spark):
    page = lambda i: f"<html><body><div class='post'><p>Subscribe to our letter</p><p>Own text of page {i} goes here at length</p></div></body>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(8)] + [(20 + i, f"http://copy.com/{i}", "<p>same on all pages</p>") for i in range(6)] + [(40, "http://few.com/", page(40)), (41, None, None), (42, "u", ""), (None, "http://h.com/x", page(42)), (0, "http://h.com/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))
    got = {(r.page_id, r.url): r for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages).count() == len(rows)
    for i in range(8):
        assert got[i, f"http://h.com/{i}"].text == f"Own text of page {i} goes here at length"
    assert got[20, "http://copy.com/0"].text == "same on all pages"
    assert got[40, "http://few.com/"].text.startswith("Subscribe")
    assert (got[41, None].text, got[41, None].n_chars) == ("", 0)
    assert html_text.extract(pages.where("false")).collect() == []


def parsed(spark, rows):
    return html_text.tokens(spark.createDataFrame(rows, "page_id bigint, url string, host string, html string").select("host", "html"))


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    item = lambda i, k: f"<ul class='x'><li>Item {i}-{k}</li></ul>"
    rows = []
    for i in range(12):
        ad = f"<div class='b'><p>Buy thing {i}</p></div>" if i % 3 else ""
        body = "".join(item(i, k) for k in range(rng.randrange(0, 4)))
        rows.append((i, "u", "h.com", f"<html><body><div class='a'><p>Read our letter</p></div>{ad}<div class='c'><p>Story {i} {'word ' * 30}</p>{body}</div></body></html>"))
    rows += [(20, "u", "h.com", rows[0][3]), (21, "u", "other.com", rows[1][3])]
    bags = {}
    for _, _, h, body in rows:
        p = html_text.tokenised(body)
        bags[h, p["page"]] = {b["id"]: b for b in p["bag"]}
    vectors, size = defaultdict(list), Counter()
    for h in ("h.com", "other.com"):
        pages = sorted(k for k in bags if k[0] == h)
        ids = {i: b for k in pages for i, b in bags[k].items()}
        on = {i: sum(i in bags[k] for k in pages) for i in ids}
        for i, b in ids.items():
            if b["path"] is not None or (on[b["above"]] >= 4 and on[i] >= 0.9 * on[b["above"]]):
                vectors[h, tuple(bags[k].get(i, {"count": 0})["count"] for k in pages)].append(i)
                size[h, tuple(bags[k].get(i, {"count": 0})["count"] for k in pages)] += 1 if b["path"] is None else 2
    want = {(v[0], frozenset(ids)) for v, ids in vectors.items() if size[v] >= 2}
    got = defaultdict(set)
    for r in html_text.classes(parsed(spark, rows)).collect():
        got[r.host, r.cls].add(r.id)
        assert r["size"] == size[next(v for v, ids in vectors.items() if v[0] == r.host and r.id in ids)]
    assert {(h, frozenset(ids)) for (h, _), ids in got.items()} == want
    assert len(want) >= 4 and any(html_text.text_token("/html/body/div.a/p", "Read our letter") in ids for _, ids in want)
    nested = {r.path: r.parent for r in html_text.templates(parsed(spark, rows)).where("host = 'h.com' AND path IS NOT NULL").collect()}
    assert nested["/html/body/div.b"] == "/html/body/div.a" and nested["/html/body/div.c/ul.x"] in ("/html/body/div.c", None) and nested[""] is None


def test_classes_out_of_order_or_crossing_are_no_template(spark):
    one = lambda i: f"<div class='a'>x{i}</div><div class='b'>y{i}</div>"
    two = lambda i: f"<div class='b'>y{i}</div><div class='a'>x{i}</div>"
    rows = [(i, "u", "mixed", (one if i % 2 else two)(i)) for i in range(8)] + [(10 + i, "u", "same", one(i)) for i in range(8)]
    got = {(r.host, r.path) for r in html_text.templates(parsed(spark, rows)).collect()}
    assert {p for h, p in got if h == "same"} == {"", "/div.a", "/div.b"} and not any(p for h, p in got if h == "mixed")
    assert html_text.arrangement([1, 2, ~1, ~2], {1: 0, ~1: 0, 2: 1, ~2: 1}, {0: 2, 1: 2})[1][2] is False
    assert html_text.arrangement([1, 2, ~2, 2, ~2, ~1], {1: 0, ~1: 0, 2: 1, ~2: 1}, {0: 2, 1: 2}) == {0: (html_text.arrangement([1, ~1], {1: 0, ~1: 0}, {0: 2})[0][0], 0, True), 1: (html_text.arrangement([2, ~2], {2: 1, ~2: 1}, {1: 2})[1][0], 1, True)}


def test_slots_tell_neutral_elements_apart(spark):
    words = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(n))
    page = lambda i: (
        f"<html><body><div class='q1'><a href='/{i}'>{words(i, 3)}</a> <a href='/x'>{words(i + 1, 4)}</a></div><div class='q2'><p>{words(i + 2, 6)}</p></div>"
        f"<h1>Title {i}</h1><div class='q3'><p>{words(i + 3, 80)}</p><p>{words(i + 4, 60)}</p></div><div class='q4'><p>{words(i + 5, 50)}</p></div><div class='q5'><p>{words(i + 6, 8)}</p></div></body></html>"
    )
    rows = [(i, f"http://n.com/{i}", page(i)) for i in range(9)] + [(20, "http://lone.com/", page(20))]
    linked = lambda i: f"<article><p>{words(i, 40)}</p><div class='r'><a href='/1'>{words(i + 1, 20)}</a></div><div class='s'><p>{words(i + 2, 5)}</p></div></article>"
    rows += [(30 + i, f"http://l.com/{i}", linked(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(9):
        assert got[i] == "\n".join([f"Title {i}", words(i + 3, 80), words(i + 4, 60), words(i + 5, 50)])
    assert words(22, 6) in got[20] and words(23, 80) in got[20]  # one page alone has no statistics
    assert got[31] == f"{words(1, 40)}\n{words(3, 5)}"


@pytest.mark.parametrize("tail", ["<a " + "\"" * 10_000, "<a b=\"" * 10_001, "<!" * 100_000, "<script>" * 50_000, "<a b='" * 5001 + "<a c=\"" * 5001])
def test_broken_tags_take_no_time(tail):
    start = time.time()
    assert html_text.main_text("<p>a</p>" + tail) == "a"
    assert time.time() - start < 0.5


def test_layouts_of_a_host_have_their_own_templates_and_copies_none(spark):
    own = lambda i: f"Own text of page {i}, " + "which goes on for a while " * 3 + str(i)
    notice = "This long notice stands on every page of the shop, whatever else it may say there, and is no text of any page"
    shop = lambda text: f"<body><div class='shop'><div class='x'><p>{notice}</p></div><p>{text}</p></div></body>"
    post = lambda i: f"<body><div class='post'><p>{own(i)}</p></div></body>"
    rows = [(i, "http://h.com/a", shop(own(i))) for i in range(7)] + [(7, "http://h.com/a", shop("Sold out"))] + [(10 + i, "http://h.com/b", post(i)) for i in range(8)]
    story = "".join(f"<p>Paragraph {i} of a story that is copied from page to page</p>" for i in range(6))
    rows += [(20 + i, "http://copy.com/a", f"<body><div class='story'>{story}<p>Seen {i} times</p></div></body>") for i in range(8)]
    rows += [(30 + i, "http://same.com/a", f"<body>{story}</body>") for i in range(8)] + [(40, "http://same.com/b", f"<body><p>{own(40)}</p></body>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [*(own(i) for i in range(7)), "Sold out"]
    assert [got[10 + i] for i in range(8)] == [own(i) for i in range(8)]
    assert all(got[20 + i].count("\n") == 6 and got[30 + i].count("\n") == 5 for i in range(8)) and got[40] == own(40)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file here")
def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    rows, labels = [], []
    for i in range(160):
        text = " ".join(word() for _ in range(rng.randrange(30, 90))) + "."
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 8 == 7:
            text = rows[-1][1] + " tail"
        rows.append((i, text, "en", f"s{i % 4 if i % 2 else 0}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append(spark.read.parquet(str(tmp_path / name.replace(" ", "_"))))
    assert all(s.columns == docs.columns for s in seen[:-1])
    good, one, mixed, ids = (s.collect() for s in seen[1:])
    assert {r.doc_id for r in good} >= {i for i in range(160) if i % 5 and (i % 8 != 7 or (i - 1) % 5)} - set(range(0, 160, 5))
    truth = brute_classes([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in one} == set(truth) and len(one) == len(set(truth))
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in one} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in ids) == Counter(r.doc_id for r in mixed) and all(r.restored and r.parity for r in ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


PROBES = {
    '<article class="post skip-lazy"><p>Hello</p></article>': "Hello",
    '<main><p class="alert-level">A</p><p class="comment-free">B</p><section class="search-history">C</section><section class="related-work">D</section></main>': "A\nB\nC\nD",
    '<main><div class="promotion-to-premier-league">E</div><div id="login">F</div><fieldset class="poem">G</fieldset></main>': "E\nF\nG",
    '<main><p>x</p><div id="login">Name <input name="a"></div><fieldset>Choose <select></select></fieldset><div class="related-posts">R</div><div class="ad-slot">S</div></main>': "x",
    '<main><p>x</p><div class="comment-list"><article class="comment">c</article></div><div class="newsletter-signup">Mail <button>go</button></div></main>': "x",
}


@pytest.mark.parametrize("page", PROBES)
def test_names_count_only_as_a_whole_and_forms_by_their_controls(page):
    assert html_text.main_text(page) == PROBES[page]


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 60, 400])
def test_readers_wrappers_of_any_depth(depth):
    page = '<div class="sidebar">' * depth + "<main><p>text</p></main>" + "</div>" * depth + '<div class="comments"><article>a reader</article></div>'
    assert html_text.main_text(page) == "text"
    bare = "<main><p>text</p></main>" + '<div class="comments">' * depth + "<article>a reader</article>"
    assert html_text.main_text(bare) == "text"


def _host_pages(spark, make, n=20):
    return spark.createDataFrame([(i, f"http://h.org/{i}", make(i)) for i in range(n)], "page_id long, url string, html string")


def test_slots_overrule_names(spark):
    story = lambda i: "".join(f"<p>story {i} part {k} " + f"word{i * k} " * 20 + "</p>" for k in range(1, 4))
    # the text of every page stands in what a name calls a notice; a real notice is the same on all pages
    page = lambda i: f'<html><body><div class="top">Site</div><div class="notice">{story(i)}</div><div class="cookie-notice">We use cookies here</div></body></html>'
    assert html_text.main_text(page(1)).split() == ["Site"]
    got = html_text.extract(_host_pages(spark, page)).collect()
    assert all(len(r.text.split("\n")) == 3 and r.text.startswith(f"story {r.page_id} part 1") for r in got)
    # within the main element a rich slot with such a name is main, a poor one and readers' aren't
    page = lambda i: f'<body><main><h1>Title {i}</h1>{story(i)}<div class="promo">{story(i + 50)}</div><div class="alert">short {i}</div><div class="comments">{story(i + 90)}</div></main></body>'
    got = html_text.extract(_host_pages(spark, page)).collect()
    for r in got:
        assert f"story {r.page_id + 50} part 2" in r.text and "short" not in r.text and f"story {r.page_id + 90}" not in r.text and r.text.startswith(f"Title {r.page_id}\nstory")
    # two pages are too few to tell
    assert all("part 2" in r.text and f"story {r.page_id + 50}" not in r.text for r in html_text.extract(_host_pages(spark, page, 2)).collect())


def chosen_by_definition(spark, pages):
    """Texts of pages by the words of ``main_blocks``, host by host, from the host's template alone."""
    H = html_text
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    named = df.select("page_id", "url", "html", H.host(F.col("url")).alias("host"))
    template = {}
    for r in H.templates(H.tokens(named)).collect():
        template.setdefault(r.host, {})[r.id] = (r.single and r.path is not None, r.path is None)
    out, hosts = {}, defaultdict(list)
    for r in named.collect():
        hosts[r.host].append((r.page_id, H.tokenised(r.html)))
    for name, found in hosts.items():
        valid, stats, blocks = template.get(name, {}), defaultdict(lambda: defaultdict(float)), {}
        for i, page in found:
            slot, around, mine, k = H.ROOT, [], [], 0
            for t, info in zip(page["tok"], page["info"]):
                if info & (H.OPEN | H.CLOSE):
                    single, text = valid.get(t if info & H.OPEN else ~t, (None, None))
                    if single is not None:
                        slot = t
                        if single and info & H.OPEN:
                            around.append(t)
                        elif single:
                            around.pop()
                    continue
                fixed = valid.get(t, (None, False))[1]
                if fixed:
                    slot = t
                mine.append((None if fixed else slot, list(around), info, page["texts"][k], page["links"][k]))
                k += 1
            blocks[i] = (mine, {t for t, info in zip(page["tok"], page["info"]) if info & H.OPEN and info & H.MAIN})
            for s in {b[0] for b in mine} - {None}:
                stats[s]["pages"] += 1
            for s, _, info, text, linked in mine:
                if s is not None:
                    left, taken = bool(info & H.MAIN), bool(info & H.NAMED)
                    stats[s]["free"] += (len(text) - linked) * (left or taken)
                    stats[s]["left"] += len(text) * left
                    stats[s]["taken"] += len(text) * taken
                    stats[s]["links"] += linked
                    stats[s]["all"] += len(text)
        enough = lambda s: stats[s]["pages"] >= H.PAGES
        for i, (mine, mains) in blocks.items():
            rich = {b[0]: stats[b[0]]["free"] / stats[b[0]]["pages"] for b in mine if b[0] is not None and 2 * (stats[b[0]]["left"] + (stats[b[0]]["taken"] if enough(b[0]) else 0)) > stats[b[0]]["all"]}
            top = max(rich.values(), default=None)
            at = next((n for n, b in enumerate(mine) if b[0] in rich and rich[b[0]] == top), None)
            texts = []
            for n, (s, around, info, text, _) in enumerate(mine):
                if s is None or not info & (H.MAIN | H.NAMED):
                    continue
                if top is None:
                    keep = bool(info & H.MAIN)
                else:
                    main, inner = mine[at][0], (mine[at][1] or [H.ROOT])[-1]
                    inside = inner == H.ROOT or inner in around
                    much, links = rich.get(s, 0) >= H.RICH * top, stats[s]["links"] >= H.LINKED * stats[s]["all"]
                    if info & H.MAIN:
                        keep = s == main or not enough(s) or not links and (inside or much or info & H.HEADING and n < at or bool(mains & set(around)))
                    else:
                        keep = enough(s) and not links and (s == main or (inner in around) and much)
                if keep:
                    texts.append(text)
            out[i] = "\n".join(texts)
    return out


def test_chosen_blocks_are_those_of_the_definition(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(90)) for _ in range(n))

    def page(kind, i):
        links = "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for k in range(rng.randrange(1, 5)))
        body = "".join(f"<p>{words(rng.randrange(5, 40))}</p>" for _ in range(rng.randrange(1, 5)))
        wrap = [f"<article><h1>{words(3)}</h1>{body}</article>", f'<div class="{rng.choice(["body", "promo", "notice"]) if kind == 1 else "promo"}">{body}</div>', f"<main>{body}<div class='alert'>{body if i % 2 else words(2)}</div></main>", f"<div>{body}</div><div class='related'>{words(20)}</div>"][kind]
        extra = f"<div class='box'><ul>{links}</ul></div>" if rng.random() < 0.7 else ""
        return f"<html><body><div class='top'>Site {kind}</div>{extra}{wrap}<div class='low'>{'Same words' if i % 3 else words(4)}</div><footer>end</footer></body></html>"

    pages = [(kind * 100 + i, f"http://h{kind}.org/{i}", page(kind, i)) for kind in range(4) for i in range(rng.choice([3, 12, 25]))] + [(900, None, "<p>alone</p>"), (901, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == chosen_by_definition(spark, pages)
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    assert got == chosen_by_definition(spark, given)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0], "en", "s", 1), (2, good[0], "en", "s", 1), (2, good[0], "en", "s", 1), (3, good[1], None, None, None), (None, good[2], "en", "s", 1), (5, None, "en", "s", 0), (6, "", "en", "t", 0), (7, " \n", "en", "t", 2), (8, good[3] + " end", "en", "t", 9), (9, (good[4] + " ") * 60, "en", "t", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, size int"
    docs = spark.createDataFrame([(*r, "clash", 0.5, 1) for r in rows], schema)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept.append(stage(spark, kept[-1], SF))
        assert kept[-1].columns == docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    quality, dedup = ids(kept[1]), ids(kept[2])
    blank = {5, 6, 7} & set(quality)
    assert set(quality) >= {1, 2, 3, None} and quality[2] == 2
    # of equal texts the smallest id stays, once; texts without words all stay
    assert dedup[1] == 1 and 2 not in dedup and set(dedup) >= {3, None} | blank
    done = corpus_pipeline.STAGES[3][1](spark, kept[3], SF)
    assert done.columns[:4] == ["doc_id", "lang", "source", "ids"] and done.count() == kept[3].count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
