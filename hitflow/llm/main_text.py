"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens: tags, and runs of words. Every token has a score and a linear scan
finds the contiguous region with the highest sum.

- Words score by their place: the innermost block element, the nearest class or id around them, and
  whether they are a link. Places that hold articles score positive, places that surround them and
  links negative. Tags cost; a run of tags and links without other words between costs `RUN_COST` at most.
- Within a page's one `article` (or `main`) nothing that is on costs, so the region holds it whole.
- Elements that are never content (menus, forms, scripts, comments of readers and others named in
  `NEVER` and `MARKS`) and their words score nothing: inside an article they must not cut it in two.
  They are left out of the region. A mark or a form around the page's own text does not count: see `_spared`.

Weights come from labelled pages: those that mark their article with one `article` or `main`
element say for each place how often its words lie inside and outside, and for each tag how often it
occurs there; the weight is the log odds. An `article` and a `div` of one class are one place, so
pages without the mark profit. About `SAMPLE` pages are counted, those whose id hashes below the
share that this is of all pages (a bound on what is fitted, whatever the number of pages). The counts
are summed on Spark. A place that was never counted has the weight of its block element, and where
that was not counted either, the fixed one.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import prepare

SAMPLE = 5000
OFF_COST = 0.1
RUN_COST = 6.0
LIMIT = 4.0
TEXT, OPEN, CLOSE = range(3)

#: HTML element names by kind.
RAW = frozenset("script style noscript template svg math iframe object canvas".split())
TEXT_ONLY = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = RAW | frozenset("head title nav header footer aside menu button select option textarea label dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("p blockquote pre article main figcaption dd dt li td th".split())
#: Open elements that a tag closes, and those that keep it from looking further out.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",)}
BOUNDS = {
    "li": ("ul", "ol", "menu", "td", "th", "article", "section", "nav", "aside"), "dt": ("dl", "td", "th"), "dd": ("dl", "td", "th"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
    "option": ("select",), "a": ("p", "li", "td", "th", "div", "article", "section", "nav"),
}
ENDS_P = BLOCK - frozenset(["caption", "head", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "title"])
SCOPE = frozenset("html body table td th ul ol dl article section div main nav aside footer header form blockquote".split())
#: Words of class, id and role attributes that mark what is not content.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer hidden "
    "masthead menu nav navbar navigation newsletter notice notices pagination pager popup promo promoted reactions related replies reply respond share sharing "
    "sidebar skip skyscraper social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Before a mark in one class name, these say that the element only has to do with it (no-comments, overflow-hidden).
MODIFIERS = frozenset("has no non not overflow with without".split())
#: What may follow a mark in a name; other names that begin with one are about something (notice-of-appeal, share-prices, social-history).
PARTS = MARKS | frozenset(
    "area bar block body bottom box button buttons column container content count desktop form frame icon icons inner item items left link links list main media mobile modal outer overlay panel "
    "post posts primary right secondary section signup slot thread top trail unit wrap wrapper".split()
)

#: The rest of a page after an unclosed quote has no such quote, so that each kind of it is looked for in vain only once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORDS = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"([a-z])([0-9])")
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    name: str
    place: str = ""  # the innermost block element, and the nearest class or id
    block: str = ""
    near: str = ""
    link: int = 0  # positive inside or close below a link
    hard: bool = False  # it or one around it is never content, whatever it holds
    soft: str = ""  # "form" or "mark": not content, unless it holds the page's own text
    inside: bool = False  # within article or main, or one itself
    outermost: bool = False  # an article or main within no other
    parent: int = 0
    first: int = 0
    last: int = 0
    on: bool = True


@dataclass
class Page:
    """Elements with parents before children; tokens (tags and runs of words) in page order. Block numbers join runs of one block."""

    elements: list[Element] = field(default_factory=lambda: [Element("")])
    kind: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)  # 0 for tags
    texts: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    @property
    def articles(self) -> int:
        return sum(e.outermost for e in self.elements)

    def keys(self) -> list[str]:
        """What the weights are kept by: w place, < element or > element; x and y for what is off and its outermost tags."""
        made, own = {}, []
        for kind, at in zip(self.kind, self.owner, strict=True):
            key = made.get((kind, at))
            if key is None:
                e = self.elements[at]
                if kind == TEXT:
                    key = f"{'w' if e.on else 'x'} {e.place}{' a' if e.link else ''}"
                else:
                    key = f"{'<' if kind == OPEN else '>'} {e.name}{e.near}" if e.on else f"{'y' if self.elements[e.parent].on else 'x'} {e.name}"
                made[kind, at] = key
            own.append(key)
        return own


def _is_mark(token: str) -> bool:
    """A class name, id or role that is a mark, or begins or ends with one that nothing else in it takes back."""
    words = _WORDS.findall(_DIGITS.sub(r"\1 \2", token))
    if not words or not MODIFIERS.isdisjoint(words[:-1]):
        return False
    ends = {words[0], words[-1]}
    if not all(w in PARTS or w.isdigit() for w in words[1:]):
        ends.discard(words[0])
    if len(words) > 1 and words[0] not in ("is", "visually"):
        ends.discard("hidden")  # lg:hidden, hidden-xs: on some screens only
    return not MARKS.isdisjoint(ends)


def _attributes(raw: str) -> tuple[str, bool]:
    """The first two words of class and id, and whether the element is marked as no content."""
    names, marked = [], False
    for m in _ATTRIBUTE.finditer(raw):
        kind = m[1].lower()
        if kind == "hidden":
            marked = True
        elif kind in ("class", "id", "role", "aria-hidden", "style"):
            value = (m[2] or "").strip("\"'").lower()
            if kind == "aria-hidden":
                marked = marked or value == "true"
            elif kind == "style":
                marked = marked or _NOT_SHOWN.search(value) is not None
            else:
                marked = marked or any(_is_mark(t) for t in value.split())
                if kind != "role" and len(names) < 2:
                    names += _WORDS.findall(_DIGITS.sub(r"\1 \2", value))[:2]
    return "".join(f".{n}" for n in names[:2]), marked


def parse(source: str) -> Page:
    """The page's tokens and elements, in one pass. Broken markup (unclosed, cut off or crossed tags) is taken as it comes."""
    page = Page()
    elements, stack, at, number, end = page.elements, [0], 0, 0, len(source)
    open_at: dict[str, list[int]] = defaultdict(list)  # depths in the stack, by name
    scopes = [0]
    lowered = None

    def add(kind: int, owner: int, words: int, text: str) -> None:
        page.kind.append(kind)
        page.owner.append(owner)
        page.words.append(words)
        page.texts.append(text)
        page.block.append(number)

    def text(piece: str) -> None:
        if piece and elements[stack[-1]].name not in RAW:
            piece = html.unescape(piece)
            add(TEXT, stack[-1], len(piece.split()), piece)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            open_at[elements[i].name].pop()
            elements[i].last = len(page.kind)
        while scopes[-1] >= depth:
            scopes.pop()

    def depth_of(names: Iterable[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at[n]), default=0)

    while at < end:
        m = _TOKEN.search(source, at)
        text(source[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = depth_of((name,))
            if name in BLOCK:
                number += 1
            if depth:
                closed = stack[depth]
                leave(depth)
                add(CLOSE, closed, 0, "")
            continue
        if name in VOID:
            if name == "br":
                add(TEXT, stack[-1], 0, " ")
            elif name == "hr":
                number += 1
            continue
        if name in BLOCK:
            number += 1
            if name in ENDS_P and (depth := depth_of(("p",))) > scopes[-1]:
                leave(depth)
        if name in CLOSED_BY and (depth := depth_of(CLOSED_BY[name])) > depth_of(BOUNDS[name]):
            leave(depth)
        above = elements[stack[-1]]
        near, marked = _attributes(m[3]) if m[3] and not m[3].isspace() else ("", False)
        page_level = name in ("html", "body")
        own = Element(name, parent=stack[-1], first=len(page.kind))
        own.near = "" if page_level else near or above.near
        own.block = name if name in BLOCK else above.block
        own.place = own.block + own.near
        own.link = 3 if name == "a" else max(0, above.link - 1)
        # An article's own header holds its title.
        own.hard = above.hard or name in NEVER and not (name == "header" and above.inside)
        own.soft = "" if page_level or own.hard or name == "main" else "mark" if marked else "form" if name == "form" else ""
        own.outermost = name in ("article", "main") and not above.inside and not own.soft and not own.hard
        own.inside = above.inside or own.outermost
        add(OPEN, len(elements), 0, "")
        elements.append(own)
        if m[3].endswith("/") and name not in BLOCK:
            own.last = len(page.kind)
            continue
        open_at[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append(len(elements) - 1)
        if name in TEXT_ONLY:
            lowered = source.lower() if lowered is None else lowered
            stop = lowered.find(f"</{name}", at)
            if len(lowered) != end:  # lower-casing changed the length
                found = re.compile(f"</{name}", re.I).search(source, at)
                stop = found.start() if found else -1
            stop = end if stop < 0 else stop
            text(source[at:stop])
            at = stop
    leave(1)
    elements[0].last = len(page.kind)
    spared = _spared(page)
    for i, e in enumerate(elements[1:], 1):
        e.on = elements[e.parent].on and not e.hard and (not e.soft or i in spared)
    return page


def _spared(page: Page) -> set[int]:
    """Marked elements and forms that hold the page's own text, and so stay on: one by itself, or all marked elements of one name together
    (page builders wrap each part of a page in a "widget").

    They hold the page's outermost main, or else its longest outermost article; or, on a page without
    either, most of its words (links do not count). Where it is a mark, these words must come with a title, or, where no
    title stands elsewhere, leave less than a tenth of the page, so that long comments of readers or
    notices below a short text stay off.
    """
    elements = page.elements
    soft = [i for i, e in enumerate(elements) if e.soft]
    if not soft:
        return set()
    plain = (0 if elements[o].link or elements[o].hard else n for n, o in zip(page.words, page.owner, strict=True))
    total = [0, *accumulate(plain)]
    words = lambda e: total[e.last] - total[e.first]
    own = [e for e in elements if e.outermost and e.name == "main"] or [e for e in elements if e.outermost]
    if own:
        own = max(own, key=words)
        return {i for i in soft if elements[i].first < own.first and own.last <= elements[i].last}
    titles = [e.first for e in elements if e.name == "h1" and not e.hard]
    marked = [(elements[i].first, elements[i].last) for i in soft]
    # h1 in no marked element: counts of marked elements open at each title.
    step = [0] * (len(page.kind) + 2)
    for a, b in marked:
        step[a] += 1
        step[b] -= 1
    depth = list(accumulate(step))
    elsewhere = any(depth[t] == 0 for t in titles)
    spared, named = set(), defaultdict(list)
    for i in soft:
        named[elements[i].soft, elements[i].near].append(i)
    groups = [[i] for i in soft] + [g for g in named.values() if len(g) > 1]
    for group in groups:
        n, stop = 0, -1
        for i in group:  # in page order; one within another counts once
            if elements[i].first >= stop:
                n, stop = n + words(elements[i]), elements[i].last
        if 2 * n > total[-1] and (elements[group[0]].soft == "form" or _holds(elements, group, titles) or not elsewhere and 10 * n > 9 * total[-1]):
            spared.update(group)
    return spared


def _holds(elements: list[Element], group: list[int], titles: list[int]) -> bool:
    """Whether a title lies within one of the elements, both in page order."""
    at = 0
    for i in group:
        while at < len(titles) and titles[at] <= elements[i].first:
            at += 1
        if at < len(titles) and titles[at] < elements[i].last:
            return True
    return False


def _fixed(key: str) -> float:
    """Weight of a place or tag that no labelled page has shown."""
    kind, _, place = key.partition(" ")
    name = place.partition(" ")[0].partition(".")[0]
    if kind in "xy":
        return 0.0 if kind == "x" else -OFF_COST
    if kind == "w":
        return -1.0 if place.endswith(" a") else 1.0 if name in CONTENT else 0.5
    return -0.1 if name in CONTENT else -1.5 if name in BLOCK else -0.2


def _general(key: str) -> str:
    """The key of the block element alone."""
    kind, _, place = key.partition(" ")
    rest = place.partition(" ")
    return f"{kind} {rest[0].partition('.')[0]}{rest[1]}{rest[2]}"


def scores(page: Page, weights: dict[str, float]) -> list[float]:
    """The score of each token. Within the one marked article of a page nothing that is on costs."""
    known: dict[str, float] = {}
    out, run, marked = [], 0.0, page.articles == 1
    for key, n, owner in zip(page.keys(), page.words, page.owner, strict=True):
        w = known.get(key)
        if w is None:
            w = weights.get(key)
            w = weights.get(_general(key)) if w is None else w
            w = known[key] = _fixed(key) if w is None else w
        w = max(w, 0.0) if marked and page.elements[owner].inside and key[0] in "w<>" else w
        if key[0] == "w":
            own = w * n
            if key.endswith(" a") and own <= 0:  # links are of the run: a table of contents costs no more than tags do
                own = max(own, -RUN_COST - run)
                run += own
            elif n:
                run = 0.0
            out.append(own)
        elif key[0] == "x":
            out.append(0.0)
        else:
            w = max(w, -RUN_COST - run)
            run += w
            out.append(w)
    return out


def region(score: list[float]) -> tuple[int, int]:
    """First and last + 1 token of the contiguous region with the highest score (the first of equals); (0, 0) without a positive one."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, w in enumerate(score):
        total += w
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


def extract(source: str | None, weights: dict[str, float]) -> str:
    """The region's content: one line per block, blank lines between."""
    page = parse(source or "")
    elements, n = page.elements, len(page.kind)
    first, last = region(scores(page, weights))
    if first < last:
        # A region takes the headings right above it, and the whole of the blocks at its ends.
        at = first
        while at > 0:
            at -= 1
            e = elements[page.owner[at]]
            if page.kind[at] == TEXT and e.on and page.words[at]:
                if e.block not in HEADINGS or e.link:
                    break
                first = at
        while first > 0 and page.block[first - 1] == page.block[first]:
            first -= 1
        while last < n and page.block[last] == page.block[last - 1]:
            last += 1
    out, now = [], None
    for i in range(first, last):
        if page.texts[i] and elements[page.owner[i]].on:
            if page.block[i] != now:
                out.append([])
                now = page.block[i]
            out[-1].append(page.texts[i])
    blocks = (_SPACE.sub(" ", "".join(b)).strip() for b in out)
    return "\n\n".join(b for b in blocks if b)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (or tags) of each key, and of each block element, inside and outside of articles, over the pages that mark one."""
    total: dict[str, list[int]] = {}
    for batch in batches:
        for source in batch.column("html").to_pylist():
            page = parse(source or "")
            if page.articles != 1:
                continue
            for key, n, owner in zip(page.keys(), page.words, page.owner, strict=True):
                if key[0] not in "xy":
                    for k in {key, _general(key)}:
                        total.setdefault(k, [0, 0])[page.elements[owner].inside] += n if key[0] == "w" else 1
    keys = sorted(total)
    yield pa.record_batch([pa.array(keys, pa.string()), pa.array([total[k][1] for k in keys], pa.int64()), pa.array([total[k][0] for k in keys], pa.int64())], names=["key", "inside", "outside"])


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights of places and tags, from the labelled pages of the sample; empty where no page marks an article."""
    prepare(pages.sparkSession)
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    own = pages.where(draw < sample / max(1, n)).select(F.col(html_col).cast("string").alias("html"))
    counts = own.mapInArrow(_count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.where("inside + outside > 0").collect()  # the places of the sampled pages, whose number is bounded
    weights = {}
    for r in rows:
        odds = math.log((r["inside"] + 0.5) / (r["outside"] + 0.5))
        odds = max(-LIMIT, min(LIMIT, odds))
        # Words count for or against; tags always cost, those of the surroundings more.
        weights[r["key"]] = odds if r["key"][0] == "w" else _fixed(r["key"]) * (1.0 + max(0.0, -odds))
    return weights


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", keep: Iterable[str] = ("url",)) -> DataFrame:
    """One row per input row: the id, the columns of `keep`, and text.

    Null and empty pages, and pages without a region, have an empty text. Null and repeated ids are
    rows like others. Nothing is cut or capped. Other columns are not read.
    """
    prepare(pages.sparkSession)
    packed = json.dumps(weights)

    def run(batches):
        own = json.loads(packed)
        for batch in batches:
            column = batch.num_columns - 1
            texts = pa.array([extract(x.as_py(), own) for x in batch.column(column)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=names)

    fields = [(id_col, id_col), *((c, c) for c in keep)]
    names = [f"k{i}" for i in range(len(fields))] + ["text"]
    shape = ", ".join([*(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, (c, _) in enumerate(fields)), "text string"])
    out = pages.select(*(F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(fields)), F.col(html_col).cast("string").alias("html")).mapInArrow(run, shape)
    return out.select(*(F.col(f"k{i}").alias(c) for i, (_, c) in enumerate(fields)), "text")


def digest(result: DataFrame) -> DataFrame:
    return result.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def brute_region(scores: list[float]) -> float:
    """For tests: the highest sum of any contiguous part, by trying all."""
    return max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


