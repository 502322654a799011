"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its elements, each by the path of tags and classes that leads to it, and its text nodes, by the
path and the text. A token's occurrence vector, its number on each page of a host, is kept as two sums of page hashes
times counts, so a group-by finds the tokens that share a vector, in one pass and with partial sums. Tokens with equal
vectors form an equivalence class; classes with enough support whose path leads through one slot of another class are
nested in it. The class of vector "once on every page" is the root of the host's template. The order of a class's
elements is that of their mean places; that each page keeps it is not checked. What a template leaves over are slots:
elements with text that varies between pages.

The main slot of a host is the element of the root that holds most of the varying text: an article or main element if
one has three tenths of it, else the deepest that has six tenths. On a page, articles within the slot (or on the page, if
it has no slot) are read alone if they hold three tenths of what varies there. Slots in elements whose name, role, class
or id says menu, header, footer, sidebar, notice, advert, form or comments do not count, unless such an element (but nav,
aside and footer) holds the page's article or most of its text, as a wrapper does, or nothing else is left. Text that is
part of the template is left out, in articles too: what is the same on most pages of the host, or comes with an element
of a nested class whenever that comes. Copies count once there, as each page sets bits in small sketches by min-wise
hashes of its text, and a page with as much such text in its slot as other is taken for a copy and keeps it. A page
whose host has too few pages for a template is read by its own elements, articles first.

Character references are decoded, white space within a block becomes one space, blocks are joined by two line feeds in
page order. A null html, or one without such text, gives an empty text. A null url is a host of its own. Rows that
repeat a page_id are each returned; unclosed and crossed tags, unfinished comments and scripts are closed as browsers
do, roughly. The text of svg is not read, nor that of noscript, template, iframe and canvas that have an end tag; all
else, math and the fallback of object too, is read as other elements. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import grouped_map, materialise
from lodestone.llm._text import slices

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|textarea|title)\b(?!/>){_ATTRS}(?<![\s\"']/)>.*?(?:</\1\s*+>|\Z)"
    rf"|<(noscript|template|iframe|canvas)\b(?!/>){_ATTRS}(?<![\s\"']/)>(?:(?!<\2\b).)*?</\2\s*+>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|([^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = frozenset("class id role hidden aria-hidden".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of the main text; those that are not unless they hold it, as words in a class, id or role say.
CHROME = frozenset("nav footer aside button select head input label".split())
SOFT_CHROME = frozenset("form dialog menu fieldset".split())
CHROME_WORDS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe signup share sharing social related recommended comment comments respond disqus discussion replies widget toolbar pagination pager search complementary contentinfo form".split())
#: Words of readers' talk, which may be longer than the text, and names that only look like chrome.
TALK_WORDS = frozenset("comment comments respond disqus replies".split())
NO_CHROME = re.compile(r"\brelated[-_ ]?(?:work|works|literature|research|studies)\b|\bsocial[-_ ]?(?:sciences?|stud(?:y|ies)|work|history|policy|psychology|issues?|security|justice)\b|\bsearch[-_ ]?(?:results?|engines?)\b|\bad[-_ ]hoc\b", re.I)
#: An article that is a reader's: a name that begins so, but for those that say whether one may comment.
_READERS = re.compile(r"(?:^|\s)(?:comments?|respond|disqus|repl(?:y|ies))(?![-_](?:open|closed|enabled|disabled|on|off)\b)(?=[-_\s]|$)", re.I)
#: Elements that end an svg which is still open, as browsers do.
_BREAKS_SVG = BLOCK | frozenset("b big br code em i img s small span strike strong sub sup tt u".split())
_CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_CLOSERS = frozenset().union(*_CLOSED_BY.values())
SOFT, TALK, HARD = 1, 2, 3
_HASHES: dict[str, int] = {}


def _hash(s: str) -> int:
    h = _HASHES.get(s)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[s] = xxhash.xxh64_intdigest(s.encode()) >> 1
    return h


class Element:
    """An open element: its tag and token, and what its ancestors and itself say.

    own: 0, SOFT (chrome unless it holds the text), TALK (unless it holds nearly all of it) or HARD. chrome is known
    when the page has been read, from `chars` and `main`, the characters in it, of all and of articles."""

    __slots__ = ("tag", "token", "own", "chrome", "hard", "inside", "mute", "up", "chars", "main")

    def __init__(self, tag: str, attrs: str, up: Element | None):
        self.tag, self.up = tag, up
        self.mute = tag == "svg" or (up is not None and up.mute)
        found: dict[str, str] = {}
        if attrs.strip("/ "):
            for k, x, y, z in _ATTR.findall(attrs):
                if (k := k.lower()) in _NAMES:
                    found.setdefault(k, x or y or z)  # the first counts
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}" if found else ""
        own_name = tag + ("." + ".".join(sorted(found["class"].split())) if found.get("class") else "")
        self.token = _hash(f"{up.token if up else 0}/{own_name}")
        readers = tag == "article" and bool(names) and _READERS.search(names) is not None
        within = up.inside if up else False
        self.inside = (within or tag in ("article", "main") or found.get("role", "").lower() in ("main", "article")) and not (readers and not within)
        self.own = HARD if tag in CHROME else SOFT if tag in SOFT_CHROME or (tag == "header" and not within) or "hidden" in found or found.get("aria-hidden") == "true" else 0
        if readers:
            self.own = TALK
        elif names.strip() and not self.own and tag not in ("body", "html", "article", "main"):
            said = {x.lower() for x in _PART.findall(NO_CHROME.sub(" ", names))} & CHROME_WORDS
            if within:
                said.discard("discussion")  # a part of a paper
            self.own = 0 if not said else SOFT if TALK_WORDS.isdisjoint(said) else TALK
        self.hard = (up.hard if up else False) or self.own == HARD
        self.chrome = self.hard
        self.chars = self.main = 0


def weigh(opened: list[Element]) -> None:
    """Sets chrome of a page's elements (in page order, the page itself first), from the characters directly in each.

    What its name calls chrome is none if it holds the page's text: most of that of articles, where there are any and
    it is around them, else half of all (nine tenths if it is called comments, or more would be lost by long ones)."""
    for e in reversed(opened):
        if e.up is not None and e.own != HARD:
            e.up.chars += e.chars
            e.up.main += e.main
    page = opened[0]
    for e in opened[1:]:
        if e.own in (SOFT, TALK):
            if page.main and not e.inside:
                holds = 2 * e.main >= page.main and 5 * e.chars >= page.chars
            else:
                whole, part = (page.main, e.main) if page.main else (page.chars, e.chars)
                holds = whole > 0 and part >= (0.9 if e.own == TALK else 0.5) * whole
            e.chrome = e.hard or e.up.chrome or not holds
        else:
            e.chrome = e.hard or e.up.chrome


def parse(page: str) -> Iterator[tuple[str, Element, str]]:
    """("open", element, ""), ("text", the element it lies in, raw text) and ("break", element, "") between blocks."""
    root = Element("#", "", None)
    stack, blocks = [root], []  # blocks: where in the stack the open blocks are
    opened: dict[str, int] = defaultdict(int)  # open elements by tag, so that nothing is looked for that isn't there

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    for m in _TOKEN.finditer(page):
        text = m[9]
        if text is not None:
            if not stack[-1].mute:
                yield "text", stack[-1], text
            continue
        name = m[4] or m[7]
        if not name:
            if (m[1] or m[2] or "").lower() in ("noscript", "title", "textarea") and not stack[-1].mute:
                yield "break", stack[-1], ""
            continue
        tag, attrs = name.lower(), (m[5] if m[4] else m[8]) or ""
        if stack[-1].mute and tag in _BREAKS_SVG and not (m[3] or m[6]) and not opened["foreignobject"]:
            i = len(stack)
            while stack[i - 1].mute:
                i -= 1
            cut(i)
        if m[3] or m[6]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                if any(e.tag in BLOCK for e in stack[i:]):
                    yield "break", stack[i], ""
                cut(i)
            elif tag in BLOCK:
                yield "break", stack[-1], ""
            continue
        for i in blocks[::-1] if tag in _CLOSERS else ():  # end tags that are implied
            e = stack[i].tag
            if tag in _CLOSED_BY.get(e, ()):
                cut(i)
            elif (e != "p") and not (tag in _CLOSED_BY and e in _CLOSED_BY and e not in _SCOPES.get(tag, ())):
                break
            elif e in _SCOPES.get(tag, ()):
                break
        if tag in BLOCK:
            yield "break", stack[-1], ""
        if tag in VOID:
            if tag == "br":
                yield "text", stack[-1], " "
            continue
        e = Element(tag, attrs, stack[-1])
        if not e.mute:
            yield "open", e, ""
        if not attrs.endswith("/"):
            if tag in BLOCK:
                blocks.append(len(stack))
            opened[tag] += 1
            stack.append(e)


def _clean(raw: str) -> str:
    return " ".join((htmllib.unescape(raw) if "&" in raw else raw).split())


def read(page: str, constant: frozenset[int] = frozenset()) -> list[tuple[str, Element, str, int, bool]]:
    """The events of parse(), with the hash of each text node that is not blank and whether the template has it. Its
    elements are weighed, by the text that is not the template's."""
    events, opened = [], []
    for what, e, raw in parse(page):
        h, fixed = 0, False
        if what == "open":
            if not opened:
                opened.append(_page(e))
            opened.append(e)
        elif what == "text" and (t := _clean(raw)):
            if not opened:
                opened.append(_page(e))
            h = xxhash.xxh64_intdigest(f"{e.token}\n{t}".encode()) >> 1
            if not (fixed := h in constant):
                e.chars += len(t)
                e.main += len(t) * e.inside
        events.append((what, e, raw, h, fixed))
    if opened:
        weigh(opened)
    return events


def _page(e: Element) -> Element:
    while e.up is not None:
        e = e.up
    return e


# -- first pass: occurrence vectors ---------------------------------------------------------------------------------


def _page_tokens(page: str) -> dict[tuple[int, int, int], list]:
    """(token, the token of the element around it, 1 for a text node) -> [count, place of the first, characters of text
    in it, 1 if within article or main, 1 if chrome]."""
    out: dict[tuple[int, int, int], list] = {}
    at = 0
    for what, e, raw, h, _ in read(page):
        if what == "open":
            key, chars = (e.token, e.up.token if e.up else 0, 0), 0
        elif h:
            chars = len(_clean(raw))
            own = (e.token, e.up.token if e.up else 0, 0)
            if own in out:
                out[own][2] += chars
            key = (h, e.token, 1)
        else:
            continue
        at += 1
        if key in out:
            s = out[key]
            s[0] += 1
            s[2] += chars
            s[3] |= e.inside
            s[4] &= e.chrome
        else:
            out[key] = [1, at, chars, int(e.inside), int(e.chrome)]
    return out


SKETCHES = 4
_SUMS = ["pages", "v1", "v2", "at", "chars", "inside", "chrome"]
_BODIES = [f"b{i}" for i in range(SKETCHES)]
_XOR, _MUL = (np.random.default_rng(20240301 + i).integers(0, 2**64, SKETCHES, dtype=np.uint64) | np.uint64(i) for i in (0, 1))


def _body(tokens: dict[tuple[int, int, int], list]) -> list[int]:
    """One bit of 63 in each sketch, by a min-wise hash of the page's text nodes (those of its articles, if it has any):
    exact copies set the same bits, near copies mostly. Joined by "or", they tell how many distinct bodies there are."""
    texts = [(key[0], s[3]) for key, s in tokens.items() if key[2] and not s[4]]
    x = np.array([h for h, inside in texts if inside] or [h for h, _ in texts] or [0], dtype=np.uint64)
    least = ((x[:, None] ^ _XOR) * _MUL).min(axis=0)
    return [1 << b for b in ((least ^ (least >> np.uint64(29))) % np.uint64(63)).tolist()]


def _distinct(g: pd.DataFrame) -> np.ndarray:
    """The mean number of bits in the sketches of each row: distinct bodies, up to 63."""
    return sum(np.bitwise_count(g[c].to_numpy(dtype=np.int64)) for c in _BODIES) / SKETCHES


def _vectors(pages: DataFrame) -> DataFrame:
    """host, token, up, kind (1: text node) and the sums over pages; token 0 stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                total: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0.0, 0, 0, 0] + [0] * SKETCHES)
                for host, page, pid in zip(*(part.column(i).to_pylist() for i in range(3))):
                    h = xxhash.xxh64_intdigest(f"{pid}\n{page}".encode())
                    h1, h2 = h & 0x7FFFFFFF, (h >> 31) & 0x7FFFFFFF
                    tokens = _page_tokens(page or "")
                    body = _body(tokens)
                    tokens[0, 0, 0] = [1, 0, 0, 0, 0]
                    for key, (n, at, chars, inside, chrome) in tokens.items():
                        s = total[host, *key]
                        s[0] += 1
                        s[1] += n * h1
                        s[2] += n * h2
                        s[3] += at / (len(tokens) + 1)
                        s[4] += chars
                        s[5] += inside
                        s[6] += chrome
                        for i in range(SKETCHES):
                            s[7 + i] |= body[i]
                keys = list(zip(*total)) if total else [()] * 4
                sums = list(zip(*total.values())) if total else [()] * (7 + SKETCHES)
                types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()] + [pa.int64()] * SKETCHES
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, *sums], types)], names=["host", "token", "up", "kind", *_SUMS, *_BODIES])

    schema = "host string, token bigint, up bigint, kind int, pages bigint, v1 bigint, v2 bigint, at double, chars bigint, inside bigint, chrome bigint" + "".join(f", {c} bigint" for c in _BODIES)
    each = pages.select("host", "html", "page_id").mapInArrow(run, schema)
    return each.groupBy("host", "token", "up", "kind").agg(*(F.sum(c).alias(c) for c in _SUMS), *(F.bit_or(c).alias(c) for c in _BODIES))


# -- templates ------------------------------------------------------------------------------------------------------


def deduce(g: pd.DataFrame, n: int, v1: int, v2: int, bodies: float) -> dict:
    """The template of one host from its frequent tokens.

    n, v1, v2: the number of pages and the vector of "once on every page"; bodies: of distinct bodies, as _distinct()
    counts. A text node is constant if it is on half of the pages and of the distinct bodies, on 3 at least. Returns the classes (root first; of each
    its elements by mean place, and the element of the root that it is nested in), the constant text nodes, with those of
    nested classes (blocks that only some pages have), and the element that holds the main slots, if there is one."""
    g = g.assign(at=g["at"] / g["pages"])
    tags, texts = g[g["kind"] == 0], g[g["kind"] == 1]
    up = dict(zip(tags["token"].tolist(), tags["up"].tolist()))
    root = set(tags["token"][(tags["v1"] == v1) & (tags["v2"] == v2) & (tags["pages"] == n)].tolist())
    place = dict(zip(tags["token"].tolist(), tags["at"].tolist()))

    def holder(token: int) -> int | None:
        """The nearest element around it that is in the root class."""
        x, seen = up.get(token), set()
        while x is not None and x not in root and x not in seen:
            seen.add(x)
            x = up.get(x)
        return x if x in root else None

    different = dict(zip(texts["token"].tolist(), _distinct(texts).tolist()))
    texts_of = {k: x for k, x in texts.groupby(["v1", "v2"])}
    labels: list[int] = []
    classes = [{"in": None, "tokens": sorted(root, key=lambda t: (place[t], t))}]
    for vector, own in tags[~tags["token"].isin(root)].groupby(["v1", "v2"], sort=True):
        around = {holder(t) for t in own["token"].tolist()}
        if len(around) == 1:  # valid: its elements all lie in one slot of the root
            classes.append({"in": around.pop(), "tokens": sorted(own["token"].tolist(), key=lambda t: (place[t], t))})
            if (same := texts_of.get(vector)) is not None:  # text that comes with its element whenever that comes
                held = same[same["up"].isin(own["token"])]
                labels += [t for t in held["token"].tolist() if different[t] >= max(3, 0.25 * bodies)]
    fixed = texts[((texts["pages"] >= max(3, 0.5 * n)) & (_distinct(texts) >= max(3, 0.5 * bodies))) | texts["token"].isin(labels)]
    constant = fixed["token"].tolist()
    varying = dict(zip(tags["token"].tolist(), tags["chars"].tolist()))
    for t, c in zip(fixed["up"].tolist(), fixed["chars"].tolist()):
        varying[t] = varying.get(t, 0) - c
    hinted = set(tags["token"][2 * tags["inside"] > tags["pages"]].tolist())
    mass: dict[int, int] = defaultdict(int)
    chrome = set(tags["token"][2 * tags["chrome"] > tags["pages"]].tolist())
    for t, c in varying.items():
        x, seen = t, set()
        while x is not None and x not in seen and t not in chrome:
            seen.add(x)
            mass[x] += max(0, c)
            x = up.get(x)
    total = max(mass.values(), default=0)
    heavy = [t for t in root if mass.get(t, 0) >= (0.3 if t in hinted else 0.6) * total and total > 0 and t not in chrome]
    outer = [t for t in heavy if t in hinted and up.get(t) not in hinted]  # an article or main element
    main = max(outer, key=lambda t: (mass[t], t)) if outer else max(heavy, key=lambda t: (place[t], t), default=None)
    return {"classes": classes, "constant": constant, "main": main}


def templates(pages: DataFrame, least_share: float = 0.3, classes: bool = False) -> DataFrame:
    """host, template (JSON: the constant text nodes and the main element; with classes, the nested classes too, from
    which these were read): frequent tokens are those on at least 2 pages and on least_share of the host's pages, so
    that a host has at most 1 / least_share times as many as its average page."""
    vectors = materialise(_vectors(pages))
    whole = vectors.filter("token = 0").select("host", F.col("pages").alias("n"), F.col("v1").alias("n1"), F.col("v2").alias("n2"), *(F.col(c).alias(f"n{c}") for c in _BODIES))
    often = vectors.filter("token <> 0 AND pages >= 2").join(whole, "host").filter(F.col("pages") >= least_share * F.col("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (int(g[c].iloc[0]) for c in ("n", "n1", "n2"))
        bodies = float(_distinct(g[:1][[f"n{c}" for c in _BODIES]].set_axis(_BODIES, axis=1))[0])
        found = deduce(g, n, a, b, bodies)
        return pd.DataFrame({"host": [g["host"].iloc[0]], "template": [json.dumps(found if classes else {k: found[k] for k in ("constant", "main")})]})

    often = materialise(often)  # else the join's own shuffle by host may stand in for that of grouped_map, and be read in parts
    return materialise(grouped_map(often, ["host"], run, "host string, template string"))


# -- second pass: extraction ----------------------------------------------------------------------------------------


class Template:
    def __init__(self, text: str | None):
        t = json.loads(text) if text else {"constant": [], "main": None}
        self.constant, self.main, self.known = frozenset(t["constant"]), t["main"], bool(text)


def extract_page(page: str, template: Template) -> str:
    events = read(page, template.constant)
    texts = [(i, e, len(raw), fixed) for i, (_, e, raw, h, fixed) in enumerate(events) if h]
    shown = [x for x in texts if not x[1].chrome]
    slots = [x for x in shown if _within(x[1], template.main)] if template.main is not None else []
    own = slots or shown or [x for x in texts if not x[1].hard]
    articles = [x for x in own if x[1].inside]
    if not template.known or sum(n for _, _, n, fixed in articles if not fixed) >= 0.3 * sum(n for _, _, n, fixed in own if not fixed):
        own = articles or own
    left = [x for x in own if not x[3]]
    if 2 * sum(x[2] for x in left) > sum(x[2] for x in own):  # else the page is a copy of others
        own = left
    kept = {x[0] for x in own}
    blocks: list[str] = []
    run: list[str] = []
    for i, (what, _, raw, h, _) in enumerate(events):
        if what == "text" and (i in kept or (not h and run)):  # blanks between what is kept
            run.append(raw)
        elif what == "break" and run:
            blocks.append(_clean("".join(run)))
            run = []
    if run:
        blocks.append(_clean("".join(run)))
    return "\n\n".join(b for b in blocks if b)


def _within(e: Element | None, token: int) -> bool:
    while e is not None:
        if e.token == token:
            return True
        e = e.up
    return False


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars. Templates are broadcast up to broadcast_bytes together, else joined by host."""
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    found = templates(pages)
    if (found.agg(F.sum(F.length("template"))).first()[0] or 0) <= broadcast_bytes:
        found = F.broadcast(found)
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                out = []
                for page, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if t not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[t] = Template(t)
                    out.append(extract_page(page or "", known[t]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.join(found, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
