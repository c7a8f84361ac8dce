"""Main text of web pages by a maximum-scoring subsequence.

A page is read once into elements and runs of words and tags. A word scores by where it stands (kind of block, inside a link) and by
the marks of the elements around it (names such as nav, words of class, id and role), a tag by its name. The weights are
log-odds counted on labelled pages, which labelled_page() makes from layouts in common use; words outside marked
elements come out positive, tags negative. A linear scan finds the contiguous run of highest total score. It is widened to
whole blocks, and what stands in it inside elements whose marks count against content is left out.

Marks add up, along the elements around a word too, and an article or main element starts anew. Marks against an element are void where they
can't tell content from the rest: where it holds most of the page's words and its headline, or an article.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

NAME = re.compile(r"(/)?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
MARK_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Scripts that are written without spaces between words: two characters count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

# Names of HTML elements, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
MARKED = frozenset("nav aside footer form button select dialog menu search fieldset label object svg math audio video canvas head".split())
HOLDS = frozenset("article section div main body td th li blockquote aside nav header footer form ul ol table dl".split())
CLOSES = {"li": ("li",), "dt": ("dd", "dt"), "dd": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KIND = {n: k for k, names in (("heading", "h1 h2 h3 h4 h5 h6"), ("para", "p blockquote pre"), ("item", "li td th dt dd"), ("link", "a")) for n in names.split()}
#: Score of an element by its name alone, and when it is hidden.
AGAINST, FOR = -4.0, 2.0
#: Score below which an element's text is left out.
OUT = -0.8


@dataclass(slots=True)
class Run:
    """Words of one block, or a tag (text is None), in an element."""

    block: int
    kind: str
    element: int
    text: str | None = None
    label: bool | None = None

    @property
    def size(self) -> float:
        """Words; of scripts without spaces, half the characters."""
        return len(self.text.split()) + len(UNSPACED.findall(self.text)) / 2 if self.text else 0.0


@dataclass
class Page:
    """Elements in the order in which they open, the first being the page itself: parent, name, marks of their own."""

    parent: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    marks: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    runs: list[Run] = field(default_factory=list)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds: text, start, end, raw, comment. Every character is looked at a bounded number of times.

    A tag ends at the first ">" outside quotes; once there is none, quotes are passed over, and without a ">" what follows is text.
    """
    at = begin = 0
    quotes, missing = True, set()
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield "text", page[begin:lt], ""
            yield "comment", page[lt + 4 : end if end >= 0 else len(page)], ""
            begin = at = end + 3 if end >= 0 else len(page)
            continue
        m = NAME.match(page, lt + 1)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?"):
            at = lt + 1
            continue
        k = m.end() if m else lt + 2
        end = -1
        while quotes and m:
            stop = STOP.search(page, k)
            if stop is None:
                quotes = False  # no tag from here on ends outside quotes
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                close = -1 if stop[0] in missing else page.find(stop[0], stop.end())
                if close < 0:
                    missing.add(stop[0])
                k = max(close + 1, stop.end())
        if end < 0:
            end = page.find(">", m.end() if m else lt + 2)
            if end < 0:
                break
        yield "text", page[begin:lt], ""
        begin = at = end + 1
        if not m:
            continue
        name, attrs = m[2].lower(), page[m.end() : end]
        if not m[1] and name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            begin = at = close.end() if close else len(page)
            yield "raw", name, ""
        else:
            yield "end" if m[1] else "start", name, attrs
    yield "text", page[begin:], ""


def marks_of(name: str, attrs: str, inside: bool) -> tuple[str, ...]:
    """Marks of an element: its name if that says what it is for, hidden, and words of class, id and role after a dot."""
    own = [name] if name in MARKED or name in ("article", "main") or name == "header" and not inside else []
    for a, v in ATTR.findall(attrs) if attrs else ():
        a, v = a.lower(), v.strip("\"'")
        if a == "hidden" or a == "aria-hidden" and v.lower() == "true" or a == "style" and INVISIBLE.search(v):
            own.append("hidden")
        elif a in ("class", "id", "role"):
            own += [f".{w}" for w in MARK_WORD.findall(CAMEL.sub(r"\1-\2", v).lower())]
    return tuple(dict.fromkeys(own))


def parse(page: str) -> Page:
    """Elements that stay open end with the element around them; end tags without a start are passed over. Linear in the page, however deep it is."""
    out = Page()
    stack: list[tuple[str, int]] = []  # name, element
    places: dict[str, list[int]] = {}  # by name: places in the stack
    holders: list[int] = []  # places in the stack of elements that an end of a paragraph doesn't cross
    opened = Counter()  # kinds of blocks that are open
    block, label = 0, None

    def pop_to(k: int) -> None:
        while len(stack) > k:
            name, _ = stack.pop()
            places[name].pop()
            if name in HOLDS:
                holders.pop()
            if name in KIND:
                opened[KIND[name]] -= 1

    def add(kind: str, text: str | None = None, element: int | None = None) -> None:
        out.runs.append(Run(block, kind, (stack[-1][1] if stack else 0) if element is None else element, text, label))

    for what, name, attrs in tokens(page):
        if what == "text":
            if name and not name.isspace():
                kind = next((k for k in ("heading", "para", "item") if opened[k]), "plain")
                add(f"link {kind}" if opened["link"] else kind, name)
        elif what == "comment":
            if name in ("content", "rest"):
                label = name == "content"
        elif what == "raw":
            if name in ("noscript", "iframe", "textarea"):
                add("tag " + name)
        elif name == "br":
            add("br")
        elif what == "end":
            block += name in BLOCK
            there = places.get(name)
            add("tag " + name, element=stack[there[-1]][1] if there else None)
            if there:
                pop_to(there[-1])
        else:
            if name in BLOCK:
                block += 1
                floor = holders[-1] if holders else -1
                for closed in ("p", *CLOSES.get(name, ())):
                    if places.get(closed) and places[closed][-1] >= floor and (closed not in HOLDS or places[closed][-1] == floor):
                        pop_to(places[closed][-1])
                        floor = holders[-1] if holders else -1
            elif name == "a" and places.get("a") and places["a"][-1] > (holders[-1] if holders else -1):
                pop_to(places["a"][-1])
            if name not in VOID and not attrs.rstrip().endswith("/"):
                out.parent.append(stack[-1][1] if stack else 0)
                out.names.append(name)
                out.marks.append(marks_of(name, attrs, bool(places.get("article") or places.get("main"))))
                places.setdefault(name, []).append(len(stack))
                if name in HOLDS:
                    holders.append(len(stack))
                if name in KIND:
                    opened[KIND[name]] += 1
                stack.append((name, len(out.parent) - 1))
            add("tag " + name)
    return out


# --- labelled pages ---------------------------------------------------------------------------------

#: Words of class, id and role that the layouts give to each part.
PARTS = {
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "links"),
    "header": ("masthead", "banner", "topbar", "branding", "logo", "toolbar", "hero"),
    "footer": ("footer", "foot", "copyright", "legal", "contentinfo", "colophon", "bottom"),
    "aside": ("sidebar", "aside", "related", "recommended", "trending", "popular", "complementary", "rail", "widget", "widgets", "more", "tags"),
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promoted", "adsense", "adslot", "commercial"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "privacy", "popup", "modal", "overlay", "dialog", "alert", "newsletter", "subscribe", "paywall", "disclaimer", "warning"),
    "form": ("form", "search", "login", "signup", "register", "contact", "subscribe"),
    "comments": ("comment", "comments", "reply", "replies", "disqus", "discussion", "responses", "reader", "feedback"),
    "share": ("share", "sharing", "social", "follow", "byline", "toolbar", "print"),
    "hidden": ("hidden", "skip", "offscreen"),
}
CONTENT = ("content", "article", "post", "entry", "main", "story", "body", "text")
VOCABULARY = tuple(a + b for a in ("ta", "re", "mo", "li", "su", "en", "ko", "vi") for b in ("n", "ra", "st", "le", "mi", "do", "", "ck"))


UNSPACED_VOCABULARY = tuple(chr(0x4E00 + 37 * k) + chr(0x4E10 + 53 * k) for k in range(60))


def labelled_page(rng: random.Random) -> str:
    """A page of a random layout, whose main text stands between <!--content--> and <!--rest-->.

    With or without article and main elements, paragraphs or classes; of words with or without spaces; inside wrappers whose classes name other parts of the page.
    """
    unspaced = rng.random() < 0.15

    def some(lo: int, hi: int) -> str:
        if unspaced:
            return "".join(rng.choice(UNSPACED_VOCABULARY) for _ in range(rng.randint(lo, hi)))
        return " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(lo, hi)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{some(1, 1)}">{some(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def part(kind: str) -> str:
        word = rng.choice(PARTS[kind])
        attr = rng.choice((f'class="{word}"', f'id="{word}"', f'class="site-{word} x"', f"class='{word}-box'", f'class="{word}" id="{word}1"'))
        inner = {
            "nav": lambda: links(rng.randint(2, 9)), "header": lambda: f"<a href='/'>{some(1, 4)}</a> {some(0, 6)}", "footer": lambda: f"&copy; {some(2, 14)}" + rng.choice(("", links(3))),
            "aside": lambda: f"<h3>{some(1, 4)}</h3>" + links(rng.randint(2, 6)) + rng.choice(("", f"<p>{some(4, 30)}</p>")), "ad": lambda: rng.choice((some(3, 25), f"<p>{some(4, 25)}</p>", f"<a href='x'>{some(3, 9)}</a>")),
            "notice": lambda: f"<p>{some(6, 30)}</p><button>{some(1, 2)}</button>", "form": lambda: f"<form><label>{some(1, 3)}</label><input name=q><button>{some(1, 2)}</button></form>",
            "comments": lambda: f"<h3>{some(1, 3)}</h3>" + "".join(f"<p>{some(4, 40)}</p>" for _ in range(rng.randint(1, 6))), "share": lambda: links(3) + some(0, 4), "hidden": lambda: some(2, 9),
        }[kind]()
        if kind in ("nav", "share") and rng.random() < 0.15:  # nothing says what it is
            return f"<div>{inner}</div>"
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if tag and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        box = rng.choice(("div", "div", "section", "p" if "<" not in inner else "div"))
        return f"<{box} {attr}>{inner}</{box}>"

    def article() -> str:
        out = [f"<h1>{some(2, 12)}</h1>"]
        breaks = rng.random() < 0.1  # one block, whose paragraphs are set apart by breaks
        for _ in range(rng.randint(1, 14)):
            text = some(3, 70)
            if rng.random() < 0.2:
                text += f' <a href="x">{some(1, 3)}</a> {some(2, 12)}'
            out.append(f"{text}<br><br>" if breaks else rng.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<h2>{some(1, 6)}</h2><p>{text}</p>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{some(3, 20)}</li></ul>", f"<div>{text}</div>")))
            if rng.random() < 0.08:
                out.append(f"<!--rest-->{part(rng.choice(('ad', 'aside', 'notice', 'share', 'form')))}<!--content-->")
        return "".join(out)

    before = [part(k) for k in ("hidden", "notice", "header", "nav", "nav", "form", "ad", "share") if rng.random() < 0.5]
    after = [part(k) for k in ("share", "comments", "aside", "ad", "nav", "form", "footer", "notice") if rng.random() < 0.5]
    word, other = rng.choice(CONTENT), rng.choice([w for ws in PARTS.values() for w in ws])
    tag, attr = rng.choice((("article", ""), ("article", ' class="post"'), ("main", ""), ("div", f' class="{word}"'), ("div", f' id="{word}"'), ("div", f' class="{word} with-{other}"'), ("div", ""), ("td", ""), ("div", "")))
    body = f"{''.join(before)}<{tag}{attr}><!--content-->{article()}<!--rest--></{tag}>{''.join(after)}"
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    wrapper = rng.choice(("", "", f' class="has-{other}"', f' class="no-{other} page"', ' id="page"'))
    if rng.random() < 0.4:
        body = f"<div{wrapper}>{body}</div>"
        wrapper = ""
    return f"<!DOCTYPE html><html><head><title>{some(2, 9)}</title><style>p{{}}</style></head><body{wrapper}>{body}</body></html>"


@dataclass
class Weights:
    words: dict[str, float]
    marks: dict[str, float]
    tags: dict[str, float]
    other_tag: float

    def own(self, page: Page, k: int) -> float | None:
        """Sum of an element's marks; None if it has none that count."""
        known = [self.marks[x] for x in page.marks[k] if x in self.marks]
        return max(AGAINST, min(FOR, sum(known))) if known else None

    def elements(self, page: Page) -> list[float]:
        """Score of each element: its marks and those against the elements around it; an article or main element starts anew."""
        n = len(page.parent)
        own = [self.own(page, k) for k in range(n)]
        size, heads, articles = [0.0] * n, [0] * n, [0] * n
        for r in page.runs:
            if r.text is not None and not r.kind.startswith("link"):
                size[r.element] += r.size
        for k in range(n - 1, 0, -1):  # children come after their parents
            heads[k] += page.names[k] == "h1"
            articles[k] += page.names[k] in ("article", "main") and (own[k] or 0.0) > 0
            for t in (size, heads, articles):
                t[page.parent[k]] += t[k]
        out = [0.0] * n
        for k in range(1, n):
            around, x = out[page.parent[k]], own[k]
            if x is not None and x < 0 and 2 * size[k] > size[0] and (heads[k] or articles[k] or size[k] >= 0.95 * size[0]) and page.names[k] not in ("nav", "head"):
                x = None  # most of the page: these marks don't tell content from the rest
            if x is None:
                out[k] = around
            elif page.names[k] in ("article", "main") and x > 0:
                out[k] = x
            else:
                out[k] = max(AGAINST, x + min(0.0, around))
        return out

    def scores(self, page: Page) -> tuple[list[float], list[bool]]:
        """Of each run, and whether it is left out; what is left out costs little, and nothing inside content, as content on both sides of it is one run."""
        of = self.elements(page)
        around = of[:]  # what the nearest element around that isn't left out says
        for k in range(1, len(of)):
            if of[k] < OUT:
                around[k] = around[page.parent[k]]
        out, without = [], []
        for r in page.runs:
            x = of[r.element]
            against = x < OUT
            if against:
                out.append(0.0 if around[r.element] > 0 else -0.5 if r.text is None else -1.0)
            elif r.text is None:
                out.append(self.tags.get(f"content {r.kind}" if x > 0 else r.kind, self.other_tag))
            else:
                out.append(r.size * max(-3.0, self.words.get(r.kind, 0.3) + 0.5 * x))
            without.append(against)
        return out, without


def train(pages: int = 600, seed: int = 17) -> Weights:
    """Weights counted on labelled pages: smoothed log-odds; a word's by kind of block where no mark counts against it."""
    rng = random.Random(seed)
    marks, words, tags = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    seen, named = [], frozenset(f".{w}" for ws in (CONTENT, *PARTS.values()) for w in ws)
    for _ in range(pages):
        page = parse(labelled_page(rng))
        seen.append(page)
        held = [[0.0] * len(page.parent) for _ in range(2)]  # words of either label inside each element
        for r in page.runs:
            if r.text is not None:
                held[bool(r.label)][r.element] += r.size
        for k in range(len(page.parent) - 1, 0, -1):
            for t in held:
                t[page.parent[k]] += t[k]
            # an element around both says nothing
            if min(held[0][k], held[1][k]) <= 0.2 * max(held[0][k], held[1][k]):
                for x in named.intersection(page.marks[k]):
                    marks[held[1][k] > held[0][k]][x] += 1
    odds = lambda c, x, s: math.log((c[1][x] + s) / (c[0][x] + s))
    # what an element's name says is fixed; words of class, id and role are counted
    mark = {x: max(-4.0, min(1.0, odds(marks, x, 0.5))) for x in marks[0].keys() | marks[1].keys()}
    mark |= dict.fromkeys((*MARKED, "header", "hidden"), AGAINST) | dict.fromkeys(("article", "main"), FOR)
    bare = Weights({}, mark, {}, 0)
    for page in seen:
        of = bare.elements(page)
        for r in page.runs:
            x = of[r.element]
            if x < OUT and not r.kind.startswith("link"):
                continue
            if r.text is None:
                tags[bool(r.label)][f"content {r.kind}" if x > 0 else r.kind] += 1
            else:
                words[bool(r.label)][r.kind] += r.size
    word = {k: max(-2.0, min(1.0, odds(words, k, 50))) for k in words[0].keys() | words[1].keys()}
    tag = {k: min(-0.1, max(-3.0, odds(tags, k, 5))) for k in tags[0].keys() | tags[1].keys()}
    return Weights(word, mark, tag, -0.5)


def best_span(scores: list[float]) -> tuple[int, int]:
    """First and one after the last of the contiguous run with the highest sum; equal sums: the first, then the longest. Empty if no score is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return span


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the page's main text, joined by an empty line; white space in a block becomes one space."""
    rs = (read := parse(page)).runs
    scores, without = weights.scores(read)
    lo, hi = best_span(scores)
    if lo == hi:
        return ""
    first, last = rs[lo].block, rs[hi - 1].block
    blocks: dict[int, list[str]] = {}
    for r, out in zip(rs, without):
        if first <= r.block <= last and not out:
            if r.text is not None:
                blocks.setdefault(r.block, []).append(entities.unescape(r.text))
            elif r.kind == "br":
                blocks.setdefault(r.block, []).append(" ")
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, html: str = "html", columns: list[str] | None = None, weights: Weights | None = None) -> DataFrame:
    """`columns` of `pages` (all but html) with text and n_chars. Null html is empty; every row gives a row, repeated ones too."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")] if columns is None else columns
    w = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [main_text(x, w) if x else "" for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))._jdf.schema().toDDL()
    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)
