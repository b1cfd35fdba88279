"""Main text of web pages by equivalence-class template deduction over same-host pages.

A page becomes a sequence of tokens: its elements' open and close tags, told apart by their paths, and its blocks of text.
Tokens of a host that occur equally often on every page, that is with one occurrence vector, form an equivalence class. A
class is valid if it is large and frequent enough, comes in one order on its pages, and lies in one slot of the class around it.
Valid classes, nested, are the host's template; what stands between two of its tokens is a slot. Slots' statistics over the host's
pages tell which of them hold the main text; tags and names of elements decide between blocks that slots don't tell apart.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import cut, discard, small_enough, table, text_batches
from vocalith.llm.url_filter import host

#: Share of an element's different pages on which a text in it, or an order of a class, stands to be template, and pages that
#: statistics need: a text on fewer can't be told from a copy, nor a slot's usual content from one page's.
SUPPORT, PAGES = 0.9, 4
#: Share of a host's pages that an element of the template has, and tokens of a class: a single element's two tags are a class, a single text isn't.
SHARE, SIZE = 0.01, 2
#: Pages with less than this share of their text in slots are copies of one text, which is no template.
SLOTS = 0.25
#: Text a page, as a share of the main slot's, with which a slot elsewhere is main as well, and share of its text in links with which none is.
RICH, LINKED = 0.25, 0.8
#: Tables of hosts up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_HOSTS = 20_000

_MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: Attributes up to the end of a tag. A quote opens a value behind an equals sign only; nothing is ever tried twice.
_ATTRS = re.compile(r"((?:[^>\"']++|(?:(?<==)|(?<==\s))(?:\"[^\"]*+\"|'[^']*+')|[\"'])*+)>")
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>"}
#: Elements without text of their own; their content goes up to their end tag or the page's end.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe")}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_set = lambda s: frozenset(s.split())
#: Elements whose content goes up to their end tag, if there is one; the first two may close themselves.
CLOSED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("svg", "math", "object", "canvas")}
#: Elements that begin and end a block of text.
BLOCKS = _set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul")
#: Elements that never have an end tag.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
#: Elements whose nesting is followed; an end tag of these closes all that is open inside.
HOLDERS = _set("html head body article main section div nav header footer aside form ul ol menu table details dialog fieldset select button title figure search span p")
#: Elements that hold no main text.
OUTSIDE = _set("head title nav footer aside form menu select button dialog search")
#: What names of elements tell, if every word of a name is one of these or says nothing: that there is no main text, a header, readers' comments
#: or a sidebar, or, if there are controls of a form inside, a form.
OUTSIDE_NAMES = _set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay rail widget widgets menu nav navbar navigation navigationbar breadcrumb breadcrumbs pagination pager share sharing social recommended toolbar footer copyright complementary contentinfo skip")
HEADS = _set("header masthead")
READERS = _set("comment comments commentlist disqus respond replies reply sidebar related")
FORMS = _set("login subscribe subscription signup newsletter paywall search")
NEUTRAL = _set(
    "list lists item items section sections area box boxes wrapper wrap container content inner outer block blocks group panel module unit units slot holder body text title head heading top bottom left right middle center primary secondary main site page global"
    " post posts article articles story stories entry entries news link links bar row col column columns grid card cards thread form field buttons button icons icon logo label author meta date time avatar desktop mobile sticky fixed floating inline small large mini"
    " more view google law info trail reading for you to the on and count counter by user users reader readers visitor visitors"
)
#: Elements that a person fills in or presses.
CONTROLS = _set("input select textarea button form")
#: Words before one of these names in a class that make it tell what a page or wrapper has, not what the element is.
HAS = _set("has with without no layout")
_HEADING = re.compile(r"h[1-6]$")


class _Holder:
    __slots__ = ("tag", "path", "kind", "reader")

    def __init__(self, tag: str, path: str, kind: str, reader: _Reader | None = None):
        self.tag, self.path, self.kind, self.reader = tag, path, kind, reader  # kind: "" neutral, "in" main, "head" header, "out" outside, "readers" outside for good


class _Reader:
    """An element that is outside by its names alone if nothing inside says otherwise: the place of its tag, the one around it, whether it is readers'
    or a form, whether a name begins so, and what it holds."""

    __slots__ = ("at", "up", "form", "first", "main", "article", "chars", "controls")

    def __init__(self, at: int, up: _Reader | None, form: bool, first: bool):
        self.at, self.up, self.form, self.first, self.main, self.article, self.chars, self.controls = at, up, form, first, False, False, 0, False


def _words(value: str) -> list[list[str]]:
    """The words of each name, less those that tell what the element has, as in ``has-sidebar``."""
    names = []
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        names.append([w for i, w in enumerate(words) if not HAS.intersection(words[:i])])
    return names


_TELLING = OUTSIDE_NAMES | HEADS | READERS | FORMS


def _kind(tag: str, attrs: str, above: str, named: bool = True) -> tuple[str, str, str, bool]:
    """What an element with these attributes holds within ``above``, its names, what it is by its names alone (``readers``, ``form`` or nothing), and
    whether a name begins so. A name with a word that tells nothing of the kind counts for nothing, nor do names of the whole page; names of main
    elements tell readers' only. If not ``named``, neither readers' names nor forms' count."""
    names, role, first = "", "", False
    words: set[str] = set()
    if attrs.strip():
        for m in _NAMES.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.lower()
            elif m[1].lower() == "class":
                names = "." + ".".join(value.lower().split())
            if tag not in ("html", "body"):
                for name in _words(value):
                    if name and all(w in _TELLING or w in NEUTRAL or len(w) == 1 for w in name) and not _TELLING.isdisjoint(name):
                        words.update(name)
                        first |= name[0] in READERS
    own = tag in ("article", "main") or role in ("main", "article")
    if above == "readers" or tag == "aside":
        return "readers", names, "readers" if words & READERS else "", first
    if named and words & READERS:
        return "readers", names, "readers", first
    if attrs and _HIDDEN.search(attrs) or tag in OUTSIDE:
        return "out", names, "", False
    if own:
        return "in", names, "", False
    if tag == "header" or words & HEADS:
        return ("out" if above == "out" else "head"), names, "", False
    if tag == "fieldset" or words & FORMS and not words & OUTSIDE_NAMES:
        return ("out" if named else above), names, "form", False
    if words & (OUTSIDE_NAMES | READERS):
        return {"": "named", "in": "named-in"}.get(above, above), names, "", False
    return above, names, "", False


class Page:
    """A page's blocks in order, each (path, kind, text, path of the element that holds it, characters in links), and ``trail``: its tags and
    blocks in order, as (path, open or close, kind) and places of blocks. Kinds: ``in`` main, ``heading`` a heading in main's header,
    ``head`` a header's, ``out`` outside, ``named`` and ``named-in`` outside by a name alone where it is undecided or main, ``""`` undecided."""

    __slots__ = ("blocks", "trail", "readers", "mains")

    def __init__(self):
        self.blocks: list[tuple[str, str, str, str, int]] = []
        self.trail: list[int | tuple[str, bool, str]] = []
        self.readers: list[_Reader] = []
        self.mains = False

    @property
    def paths(self) -> set[str]:
        return {x[0] for x in self.trail if isinstance(x, tuple)}

    def chosen(self) -> list[bool]:
        """Blocks that tags and names leave: those of main elements if there are any, else all that stand in no menu, advert or the like."""
        kinds = ("in", "heading") if any(x[1] == "in" for x in self.blocks) else ("", "heading")
        return [x[1] in kinds for x in self.blocks]


def parse(page: str | None) -> Page:
    """Markup may be broken: an end tag closes what is open inside it, one without a start only ends the block, and a main
    element that opens in an unclosed menu or advert is main all the same. An element is readers' by its names only if it doesn't hold
    the main text: not if it has a main element, nor if the page's only articles are inside and they are all there is, or, unless
    a name begins so, the most. It is a form by its names only if there are controls inside. Pages are read again until nothing changes."""
    free: set[int] = set()
    while True:
        found = _parse(page or "", free)
        for r in reversed(found.readers):  # those inside come later
            if r.up:
                r.up.main |= r.main
                r.up.article |= r.article
                r.up.chars += r.chars
                r.up.controls |= r.controls
        held = {r.at for r in found.readers if (not r.controls if r.form else r.main)} - free
        if not held:  # what has a main element is settled before articles are looked at
            open_ = sum(len(x[2]) for x in found.blocks if x[1] in ("", "in"))
            held = {r.at for r in found.readers if not r.form and r.article and not found.mains and (not open_ if r.first else r.chars > open_)} - free
        if not held:
            return found
        free |= held


def _parse(page: str, free: set[int]) -> Page:
    """Elements whose tags are at ``free`` are neither readers' nor forms by their names. Takes time in proportion to the page."""
    out, stack = Page(), [_Holder("", "", "")]
    pieces: list[str] = []
    leaf, inside, linked, link, loose, at = "", 0, 0, False, False, 0
    closed, raw = dict(CLOSED), dict.fromkeys(RAW, True)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        if text:
            top = stack[-1]
            kind = "out" if top.kind == "readers" else top.kind
            if top.reader:
                top.reader.chars += len(text)
            if kind == "head" and inside:
                kind = "heading" if _HEADING.match(leaf) else "out"
            out.trail.append(len(out.blocks))
            out.blocks.append((top.path + "/" + leaf if leaf != top.tag else top.path, kind, text, top.path, min(linked, len(text))))
        linked = 0

    def close(n: int) -> None:
        for h in reversed(stack[n:]):
            out.trail.append((h.path, False, h.kind))
        del stack[n:]

    def said(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if link:
            linked += len(text.strip())

    while m := _MARK.search(page, at):
        if m.start() > at:
            said(page[at : m.start()])
        if not m[2]:
            end = _ENDS.get(m[0], ">")
            at = page.find(end, m.start() + 2)
            at = len(page) if at < 0 else at + len(end)
            continue
        a = None if loose else _ATTRS.match(page, m.end())
        if a:
            attrs, at = a[1], a.end()
        else:  # no tag ends from here on if quotes count
            loose, end = True, page.find(">", m.end())
            if end < 0:
                at = len(page)
                break
            attrs, at = page[m.end() : end], end + 1
        tag, ends = m[2].lower(), bool(m[1])
        if tag in CONTROLS and not ends and stack[-1].reader:
            stack[-1].reader.controls = True
        if tag in RAW and not ends:
            end = RAW[tag].search(page, at) if raw[tag] else None
            raw[tag], at = bool(end), end.end() if end else len(page)
            continue
        if tag in closed and not ends:
            if not (tag in ("svg", "math") and attrs.endswith("/")):
                if end := closed[tag].search(page, at):
                    at = end.end()
                else:  # nor does a later one end
                    del closed[tag]
            continue
        if tag == "a":
            link = not ends and "href" in attrs
        block = tag in BLOCKS
        holds = tag in HOLDERS and (block or attrs.strip() or ends)
        if block:
            flush()
            leaf = "" if ends else tag
        if not holds or tag in VOID:
            continue
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    inside -= sum(h.kind == "in" and h.tag in ("article", "main") for h in stack[i:])
                    close(i)
                    link = False
                    break
                if tag in ("p", "span") and stack[i].tag not in ("p", "span"):
                    break
        else:
            kind, names, alone, first = _kind(tag, attrs, stack[-1].kind, m.start() not in free)
            if tag in ("p", "span") and kind == stack[-1].kind and not alone:
                continue
            if not block:
                flush()
            if tag == "p":
                while stack[-1].tag == "p":
                    close(len(stack) - 1)
            path = f"{stack[-1].path}/{tag}{names}"
            inside += kind == "in" and tag in ("article", "main")
            reader = stack[-1].reader
            if alone:
                out.readers.append(reader := _Reader(m.start(), reader, alone == "form", first))
            if tag in ("article", "main"):
                out.mains |= kind == "in"
                if reader:
                    reader.main |= tag == "main"
                    reader.article |= tag == "article"
            stack.append(_Holder(tag, path, kind, reader))
            out.trail.append((path, True, kind))
    if at < len(page):
        said(page[at:])
    flush()
    close(1)
    return out


def main_text(page: str | None) -> str:
    """The text that tags and names alone leave of a page, a block a line: what ``extract`` starts from."""
    found = parse(page)
    return "\n".join(x[2] for x, c in zip(found.blocks, found.chosen()) if c)


# ---- tokens

#: What a token is: an element's open tag, its close tag; whether a main element's or a block that tags leave; a heading; a block that only a name takes away.
OPEN, CLOSE, MAIN, HEADING, NAMED = 1, 2, 4, 8, 16


def element(path: str) -> int:
    """The open tag's token; the close tag's is its complement."""
    return xxhash.xxh64_intdigest("\1" + path) - (1 << 63)


def text_token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(path + "\0" + text) - (1 << 63)


#: The page itself, which every page has once.
ROOT = element("")

_PARSED = "page bigint, tok array<bigint>, info array<int>, chars array<int>, links array<int>, bag array<struct<id: bigint, path: string, above: bigint, count: int, chars: bigint>>"
_BAG = pa.list_(pa.struct([("id", pa.int64()), ("path", pa.string()), ("above", pa.int64()), ("count", pa.int32()), ("chars", pa.int64())]))
_TYPES = {"page": pa.int64(), "tok": pa.list_(pa.int64()), "info": pa.list_(pa.int32()), "chars": pa.list_(pa.int32()), "links": pa.list_(pa.int32()), "bag": _BAG}


def tokenised(page: str | None) -> dict:
    """A page as tokens in order with their ``info``, the texts of its blocks, and its bag of different tokens with their counts; an
    element's ``chars`` are all that tags leave of the page. ``page`` is a hash of all blocks, so copies are one page."""
    found = parse(page)
    chosen, ids = found.chosen(), {"": ROOT}
    named = {"named-in"} if any(x[1] == "in" for x in found.blocks) else {"named", "named-in"}
    tok, info, texts, chars, links = [ROOT], [OPEN], [], [], []
    bag: dict[int, list] = {}
    total = sum(len(x[2]) for x, c in zip(found.blocks, chosen) if c)
    for x in (("", True, ""), *found.trail):
        if isinstance(x, tuple):
            path, opens, kind = x
            t = ids.get(path)
            if t is None:
                t = ids[path] = element(path)
            if path:
                tok.append(t if opens else ~t)
                info.append((OPEN if opens else CLOSE) | (MAIN if kind == "in" else 0))
            if opens:
                bag.setdefault(t, [t, path, None, 0, total])[3] += 1
        else:
            path, kind, text, above, linked = found.blocks[x]
            t = text_token(path, text)
            tok.append(t)
            info.append((MAIN if chosen[x] else 0) | (NAMED if kind in named else 0) | (HEADING if _HEADING.match(path.rpartition("/")[2]) else 0))
            texts.append(text)
            chars.append(len(text))
            links.append(linked)
            entry = bag.setdefault(t, [t, None, ids[above], 0, 0])
            entry[3] += 1
            entry[4] += len(text) * chosen[x]
    marks = array("q", (t for t, i in zip(tok, info) if not i & (OPEN | CLOSE)))
    tok.append(~ROOT)
    info.append(CLOSE)
    page_hash = xxhash.xxh64_intdigest(marks.tobytes()) - (1 << 63)
    return {"page": page_hash, "tok": tok, "info": info, "texts": texts, "chars": chars, "links": links, "bag": [dict(zip(("id", "path", "above", "count", "chars"), b)) for b in bag.values()]}


def _batched(run, columns: int, size: int = 256):
    """``run`` over slices of at most ``size`` rows, whose first ``columns`` columns come as lists."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), size):
                part = b.slice(a, size)
                yield run(part, *(part.column(i).to_pylist() for i in range(columns)))

    return go


def tokens(pages: DataFrame) -> DataFrame:
    """(host, ...) of ``pages`` (host, html) with the columns of ``tokenised`` but the texts."""

    def run(part: pa.RecordBatch, bodies: list) -> pa.RecordBatch:
        rows = [tokenised(x) for x in bodies]
        return pa.RecordBatch.from_arrays([part.column(1), *(pa.array([r[n] for r in rows], t) for n, t in _TYPES.items())], ["host", *_TYPES])

    return pages.select("html", "host").mapInArrow(_batched(run, 1), f"host string, {_PARSED}")


# ---- equivalence classes

#: A token of a host's classes as it travels with pages: its class, whether it is an element that no page has twice, and the class's size.
_TOKEN = np.dtype([("id", "<i8"), ("cls", "<i4"), ("size", "<i4"), ("single", "?"), ("text", "?")])


def _within(path: str, above: str) -> bool:
    return not above or path == above or path.startswith(above + "/")


def classes(parsed: DataFrame, support: float = SUPPORT, least: int = PAGES) -> DataFrame:
    """(host, cls, id, path, n, single, size): the tokens of each host's equivalence classes, before their order is looked at.

    A token's occurrence vector is how often each different page of its host has it, kept as its pages, and a hash over (page, count) that
    partial sums build up. An element counts if SHARE of the host's pages have it, which bounds a host's tokens by a hundred
    pages' worth; a text counts if its element is on ``least`` pages and it stands on ``support`` of them. Elements
    count as two tokens, texts as one, and a class of less than SIZE is none. Where less than SLOTS of the text of an element's pages
    would be left in slots, they are copies of one text, and texts in it are none of the template.
    """
    bag = parsed.select("host", "page", F.explode("bag").alias("b")).select("host", "page", "b.*")
    seen = bag.groupBy("host", "page", "id").agg(*[F.first(c).alias(c) for c in ("path", "above", "count", "chars")])
    t = seen.groupBy("host", "id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page", "count")).alias("vector"), F.max("count").alias("most"), F.min("path").alias("path"), F.min("above").alias("above"), F.sum("chars").alias("chars")
    )
    t = cut(t, "html-tokens")
    whole = t.where(F.col("id") == ROOT).select("host", F.col("n").alias("pages"))
    kinds = t.where("path IS NOT NULL").join(whole, "host").where(F.col("n") >= F.col("pages") * SHARE).drop("pages")
    holds = kinds.where(F.col("n") >= least).select("host", F.col("id").alias("above"), F.col("n").alias("pages"))
    texts = t.where(F.col("path").isNull()).join(holds, ["host", "above"]).where(F.col("n") >= F.ceil(F.col("pages") * support)).drop("pages")
    both = cut(kinds.select(*t.columns).union(texts.select(*t.columns)), "html-candidates")
    discard(t)

    def group(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: (r["path"] is None, r["path"] or "", r["id"]))
        paths = {r["id"]: r["path"] for r in rows if r["path"] is not None}
        texts = [r for r in rows if r["path"] is None]
        by = lambda r: (r["n"], r["vector"])

        def copies(e: dict) -> bool:
            fixed = 0.0
            for r in texts:
                if _within(paths[r["above"]], e["path"]) or by(r) == by(e):
                    fixed += r["chars"]
                elif _within(e["path"], paths[r["above"]]):
                    fixed += r["chars"] * min(1, e["n"] / r["n"])
            return e["chars"] - fixed < SLOTS * e["chars"]

        used = {r["above"] for r in texts}
        copied = {r["id"] for r in rows if r["id"] in used and copies(r)}
        rows = [r for r in rows if r["above"] not in copied]
        sizes = Counter()
        for r in rows:
            sizes[by(r)] += 1 if r["path"] is None else 2
        numbers = {v: i for i, v in enumerate(dict.fromkeys(map(by, rows)))}
        rows = [r for r in rows if sizes[by(r)] >= SIZE]
        cols = {"host": [r["host"] for r in rows], "cls": [numbers[by(r)] for r in rows], "id": [r["id"] for r in rows], "path": [r["path"] for r in rows], "n": [r["n"] for r in rows], "single": [r["most"] == 1 for r in rows], "size": [sizes[by(r)] for r in rows]}
        return pa.table([pa.array(v, t) for v, t in zip(cols.values(), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32()))], list(cols))

    return both.groupBy("host").applyInArrow(group, "host string, cls int, id bigint, path string, n bigint, single boolean, size int")


def arrangement(tok: list[int], of: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[int, int, bool]]:
    """For each class on a page: a hash of its order, the token of the class around it behind which it lies, and whether it fits.

    A class's tokens must come in one order, as often as its first does, and each of its instances between two neighbouring tokens of the
    instance around it. Of two classes that cross, the one of fewer tokens doesn't fit.
    """
    places: dict[int, list[int]] = {}
    for i, t in enumerate(tok):
        if (c := of.get(t)) is not None:
            places.setdefault(c, []).append(i)
    bad, order, spans, around = set(), {}, [], {}
    for c, at in places.items():
        m = sizes[c]
        seq = [tok[i] for i in at]
        if len(seq) % m or seq != seq[:m] * (len(seq) // m):
            bad.add(c)
        order[c] = xxhash.xxh64_intdigest(array("q", seq[:m]).tobytes()) - (1 << 63)
        spans += [(at[i], at[min(i + m, len(at)) - 1], c) for i in range(0, len(at), m)]
    open_: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        a, z, c = span
        while open_ and open_[-1][1] < a:
            open_.pop()
        if open_:
            x, y, p = open_[-1]
            lo, hi = bisect_left(places[p], a), bisect_right(places[p], z)
            if p != c and (y < z or hi > lo):
                bad.add(c if sizes[c] <= sizes[p] else p)
            if p != c and lo:
                around.setdefault(c, tok[places[p][lo - 1]])
            if y < z:
                continue
        open_.append(span)
    return {c: (order[c], around.get(c, 0), c not in bad) for c in places}


def _packed(c: pa.Array) -> Iterator[np.ndarray | None]:
    return (None if x is None else np.frombuffer(x, _TOKEN) for x in c.to_pylist())


def pack(found: DataFrame) -> DataFrame:
    """(host, packed): a host's tokens in one value, for pages to carry."""

    def run(rows: pa.Table) -> pa.Table:
        a = np.zeros(rows.num_rows, _TOKEN)
        for n in ("id", "cls", "size", "single"):
            a[n] = np.asarray(rows.column(n))
        a["text"] = [p is None for p in rows.column("path").to_pylist()]
        return pa.table({"_host": [rows.column("host")[0].as_py()], "packed": pa.array([np.sort(a, order="id").tobytes()], pa.binary())})

    return found.groupBy("host").applyInArrow(run, "_host string, packed binary")


def _beside(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    side = F.broadcast(hosts) if small_enough(hosts, BROADCAST_HOSTS) else hosts
    return rows.join(side, F.col("host") == F.col("_host"), "left")


class _Memo(dict):
    """What unpacking made of a host's value, kept for the pages of a batch that share it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) > 1000:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _of(value: bytes | None) -> tuple[dict[int, int], dict[int, int]]:
    a = np.frombuffer(value or b"", _TOKEN)
    of = dict(zip(a["id"].tolist(), a["cls"].tolist()))
    of |= {~i: c for i, c, text in zip(a["id"].tolist(), a["cls"].tolist(), a["text"].tolist()) if not text}
    return of, dict(zip(a["cls"].tolist(), a["size"].tolist()))


def templates(parsed: DataFrame, support: float = SUPPORT, least: int = PAGES) -> DataFrame:
    """``classes`` whose order and place in the class around them are the same on ``support`` of their pages, with ``parent``, the path of
    the token behind which they lie: each host's template, nested. A text's path is null."""
    found = cut(classes(parsed, support, least), "html-classes")
    rows = _beside(parsed.select("host", "tok"), cut(pack(found), "html-packed")).select("packed", "host", "tok")
    memo = _Memo(_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for value, h, tok in zip(*(b.column(i).to_pylist() for i in range(3))):
                of, sizes = memo[value]
                for c, (order, parent, fits) in arrangement(tok, of, sizes).items():
                    seen[h, c, order if fits else 0, parent if fits else 0, fits] += 1
            cols = [*zip(*seen)] if seen else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*cols, list(seen.values())), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], ["host", "cls", "order", "parent", "fits", "k"])

    seen = rows.mapInArrow(run, "host string, cls int, order bigint, parent bigint, fits boolean, k bigint")
    seen = seen.groupBy("host", "cls", "order", "parent", "fits").agg(F.sum("k").alias("k"))
    best = seen.groupBy("host", "cls").agg(F.sum("k").alias("all"), F.max(F.when(F.col("fits"), F.struct("k", "parent"))).alias("best"))
    good = best.where(F.col("best.k") >= F.col("all") * support).select("host", "cls", F.col("best.parent").alias("_p"))
    names = found.where("path IS NOT NULL").select("host", F.explode(F.array("id", F.bitwise_not("id"))).alias("_p"), F.col("path").alias("parent"))
    return found.join(good, ["host", "cls"]).join(names, ["host", "_p"], "left").drop("_p")


# ---- slots

_SLOT = np.dtype([("id", "<i8"), ("pages", "<i8"), ("free", "<i8"), ("left", "<i8"), ("linked", "<i8"), ("chars", "<i8"), ("named", "<i8")])


def places(tok: list[int], info: list[int], valid: dict[int, tuple[bool, bool]]) -> list[tuple[int, tuple[int, ...]] | None]:
    """For each block its slot, told by the last token of the template before it, and the single elements of the template around it;
    None for a text of the template."""
    out: list[tuple[int, tuple[int, ...]] | None] = []
    slot, around = ROOT, ()
    for t, i in zip(tok, info):
        if i & (OPEN | CLOSE):
            known = valid.get(t if i & OPEN else ~t)
            if known is not None:
                slot = t
                if known[0]:
                    around = (*around, t) if i & OPEN else around[:-1]
        elif (known := valid.get(t)) is not None and known[1]:
            slot = t
            out.append(None)
        else:
            out.append((slot, around))
    return out


def _valid(value: bytes | None) -> dict[int, tuple[bool, bool]]:
    a = np.frombuffer(value or b"", _TOKEN)
    return {i: (s and not x, x) for i, s, x in zip(a["id"].tolist(), a["single"].tolist(), a["text"].tolist())}


def slots(parsed: DataFrame, packed: DataFrame) -> DataFrame:
    """(_host, slots): for each slot of a host its pages, and its characters: outside of links and left by tags or taken by a name alone, left by tags, in links, all, and taken by a name alone."""
    rows = _beside(parsed.select("host", "tok", "info", "chars", "links"), packed).select("packed", "host", "tok", "info", "chars", "links")
    memo = _Memo(_valid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for value, h, tok, info, chars, links in zip(*(b.column(i).to_pylist() for i in range(6))):
                at, seen = places(tok, info, memo[value]), set()
                kinds = [i for i in info if not i & (OPEN | CLOSE)]
                for p, kind, n, k in zip(at, kinds, chars, links):
                    if p is not None:
                        s = sums.setdefault((h, p[0]), [0] * 6)
                        s[0] += p[0] not in seen
                        seen.add(p[0])
                        left, taken = bool(kind & MAIN), bool(kind & NAMED)
                        for j, v in enumerate(((left | taken) * (n - k), left * n, k, n, taken * n), 1):
                            s[j] += v
            cols = [[h for h, _ in sums], [i for _, i in sums], *([v[j] for v in sums.values()] for j in range(6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j else pa.string()) for j, c in enumerate(cols)], ["host", *_SLOT.names])

    sums = rows.mapInArrow(run, "host string, " + ", ".join(f"{n} bigint" for n in _SLOT.names))
    sums = sums.groupBy("host", "id").agg(*[F.sum(n).alias(n) for n in _SLOT.names[1:]])

    def group(rows: pa.Table) -> pa.Table:
        a = np.zeros(rows.num_rows, _SLOT)
        for n in _SLOT.names:
            a[n] = np.asarray(rows.column(n))
        return pa.table({"_host": [rows.column("host")[0].as_py()], "slots": pa.array([np.sort(a, order="id").tobytes()], pa.binary())})

    return sums.groupBy("host").applyInArrow(group, "_host string, slots binary")


def main_blocks(tok: list[int], info: list[int], valid: dict, stats: dict[int, tuple], least: int = PAGES) -> list[bool]:
    """Which of a page's blocks are main.

    The main slot is the one with most text a page outside of links, of those of whose text tags leave the most, or would but for names. Its element is the
    innermost single one of the template around it. A block is main if tags leave it and its slot is: one in that element, or elsewhere one with RICH of the
    main slot's text, a heading before it, or one in a main element. A block that only a name takes away is main if its slot is the main one or lies in
    that element and has RICH of its text. Slots of links aren't main, but for the main one. Slots that stand on less than ``least`` pages are left to tags and names.
    """
    at = places(tok, info, valid)
    kinds = [i for i in info if not i & (OPEN | CLOSE)]
    mean = {s: stats[s][1] / stats[s][0] for p in at if p is not None for s in [p[0]] if 2 * (stats[s][2] + stats[s][5] * (stats[s][0] >= least)) > stats[s][4]}
    if not mean:
        return [p is not None and bool(k & MAIN) for p, k in zip(at, kinds)]
    top = max(mean.values())
    first = next(i for i, p in enumerate(at) if p is not None and mean.get(p[0]) == top)
    main, around = at[first]
    inner = around[-1] if around else ROOT
    held = {t for t, i in zip(tok, info) if i & OPEN and i & MAIN}

    def linked(slot: int) -> bool:
        return stats[slot][3] >= LINKED * stats[slot][4]

    def fits(i: int) -> bool:
        slot, outer = at[i]
        if slot == main or stats[slot][0] < least:
            return True
        if linked(slot):
            return False
        return inner == ROOT or inner in outer or mean.get(slot, 0.0) >= RICH * top or bool(kinds[i] & HEADING) and i < first or not held.isdisjoint(outer)

    def kept(i: int) -> bool:
        slot, outer = at[i]
        return stats[slot][0] >= least and not linked(slot) and (slot == main or inner in outer and mean.get(slot, 0.0) >= RICH * top)

    return [p is not None and (bool(k & MAIN) and fits(i) or bool(k & NAMED) and kept(i)) for i, (p, k) in enumerate(zip(at, kinds))]


def extract(pages: DataFrame, support: float = SUPPORT, least: int = PAGES, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; text is empty for a null or empty page or one without main text.

    Pages whose URL is null or has no host form a host of their own. Repeated rows are pages of their own and agree. Hosts'
    templates are broadcast if few, else joined on the host, where a host with many pages may be split. Very long pages are
    parsed whole, in time in proportion to their length. An empty table gives no rows; other columns are left out, whatever their names.
    """
    text_batches(pages.sparkSession)
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"), host(F.col(url)).alias("host"))
    parsed = cut(tokens(named), "html-parsed")
    packed = cut(pack(templates(parsed, support, least)), "html-template")
    known = cut(slots(parsed, packed).join(packed, "_host", "left"), "html-slots")
    discard(parsed, packed)
    rows = _beside(named, known).select("packed", "slots", "html", "page_id", "url")  # pages are parsed again, as their texts would take much more disk than time
    memo = _Memo(_valid)
    stats = _Memo(lambda v: {r[0]: r[1:] for r in np.frombuffer(v or b"", _SLOT).tolist()})

    def run(part: pa.RecordBatch, *cols: list) -> pa.RecordBatch:
        texts = []
        for value, known, body in zip(*cols):
            page = tokenised(body)
            texts.append("\n".join(t for t, x in zip(page["texts"], main_blocks(page["tok"], page["info"], memo[value], stats[known], least)) if x))
        return pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(_batched(run, 3), f"page_id {named.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op9_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
