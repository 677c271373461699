"""Main text of web pages: the maximum-scoring contiguous run of tokens, where words score positive and tags negative.

A linear scan over a page's words and tags finds the run with the largest sum (Kadane). A word counts WORD. An opening tag counts
what was learned from labelled pages, those that mark their own content with one <article> or <main>, for its name and for the words of its class and id:
minus the log of how much larger their share is outside the content than inside. Where a page marks one content element, a run that crosses its edge loses EDGE.

Elements that by structure hold no content (navigation, forms, scripts, hidden ones) count as one tag (within marked content MOST) and give no text. So do those with a
word of class or id that was learned to stand outside content: its odds, with the word lists below as prior counts, reach SKIP. Words are compared whole, so
`page-header` isn't `header`; only reader comments and newsletters are known by a dashed part of a container's word too (`post-comments`), unless it tells a state (`no-comments`).
An element that marks content, and an article's own headings and sections, are kept whatever their words say; but reader comments in them go. Within a page's one
marked content all tags count MOST (and the words of their class and id), so that no part at its edges is trimmed for its kind of tag.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one newline.

Defined cases: a null or empty page, and one without words, gives an empty text. Unclosed elements end with their parent, so broken
markup hides nothing that follows it. Pages are read one by one and whole, however long, so repeated rows and further columns change nothing. Of runs with equal scores the one
that ends last counts. Without labelled pages all tags count PLAIN and the word lists alone decide.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least

WORD = 1.0
#: Score of a tag without a learned one; the bounds of learned ones; what crossing the edge of marked content costs.
PLAIN, LEAST, MOST, EDGE = -0.2, -6.0, -0.05, -1e6
SKIP = 2.5  #: log odds of standing outside content from which a class or id hides its element
PRIOR = 20  #: pages that the word lists count for

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
# Names of classes and ids that usually mark what is no content, and those of reader comments.
COMMENTS = set("comment comments comment-list commentlist comments-area comments-section comment-section comment-body comment-respond respond disqus disqus_thread".split())
OUTSIDE = COMMENTS | set(
    "ad ads adsbygoogle ad-slot ad-container ad-banner advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies cookie-banner cookie-notice"
    " cookie-consent consent gdpr notice notices site-notice alert popup modal overlay newsletter newsletter-signup subscribe subscription signup share sharing share-buttons social social-links"
    " social-share sidebar side-bar sidebar-left sidebar-right widget widgets widget-area related related-posts related-articles recommended recommendations breadcrumb breadcrumbs menu"
    " main-menu nav navbar nav-menu navigation site-nav footer site-footer header site-header page-footer masthead topbar login search search-form searchbox toolbar pagination pager copyright"
    " legal disclaimer skip-link".split()
)
TALK = {"comment", "comments", "newsletter"}
STATES = {"no", "has", "with", "without", "open", "closed", "count", "link", "links", "on", "off", "enabled", "disabled"}
CONTAINERS = {"div", "section", "ol", "ul", "li"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "noembed", "noframes", "math"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "head", "dialog", "menu", "object", "embed", "audio", "video", "canvas", "fieldset", "datalist", "label"}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header"}
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Params:
    max_pages: int = 2000  #: labelled pages that training takes, those with the least hashes of the id


@dataclass
class Token:
    kind: str  #: text, open, close, skipped, enter or leave (the edges of outermost content)
    value: str  #: decoded text, or a tag as `<p` and `</p`
    breaks: bool = False  #: whether it parts blocks
    names: tuple[str, ...] = ()  #: of class and id, as `.ad`
    around: tuple[tuple[str, ...], ...] = ()  #: of enter: the keys of the elements around it


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  #: of tags, as `<p`, and of names, as `.ad`
    hides: frozenset[str] = frozenset(f".{w}" for w in OUTSIDE)

    def scores(self, tokens: list[Token]) -> list[float]:
        edge = EDGE if sum(t.kind == "enter" for t in tokens) == 1 else MOST
        out, inside = [], False
        for t in tokens:
            if t.kind == "text":
                out.append(WORD * len(t.value.split()))
            elif t.kind in ("enter", "leave"):
                out.append(edge)
                inside = t.kind == "enter"
            elif inside and t.kind == "skipped":
                out.append(MOST)
            else:
                tag = MOST if inside and edge == EDGE else self.weights.get(t.value, PLAIN)
                out.append(max(LEAST, tag + sum(self.weights.get(n, 0.0) for n in t.names)))
        return out

    def text(self, page: str | None) -> str:
        tokens = list(tokens_of(page or "", self.hides))
        a, b = best_run(self.scores(tokens))
        blocks, block = [], []
        for t in tokens[a:b]:
            if t.kind == "text":
                block.append(t.value)
            elif t.breaks:
                blocks.append(block)
                block = []
            elif t.value in ("<br", "<wbr"):
                block.append(" ")
        blocks.append(block)
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; of equal ones that which ends last, and (0, 0) without any."""
    best, start, running, at = 0.0, 0, 0.0, (0, 0)
    for i, s in enumerate(scores):
        running += s
        if running <= 0:
            running, start = 0.0, i + 1
        elif running >= best:
            best, at = running, (start, i + 1)
    return at


def _is_talk(word: str) -> bool:
    """Whether a class or id names reader comments or a newsletter by one of its dashed parts."""
    parts = re.split("[-_]+", word)
    return not TALK.isdisjoint(parts) and STATES.isdisjoint(parts)


def _judged(name: str, attributes: str, inside: bool, hides: frozenset[str]) -> tuple[bool, tuple[str, ...]]:
    """Whether an element holds no content, and the names of its class and id. inside: it stands within marked content."""
    skip, names, comments, talk = name in NEVER or name == "header" and not inside, [], False, False
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            words = value.lower().split()
            names += [f".{w}" for w in words]
            talk = talk or name in CONTAINERS and any(map(_is_talk, words))
            comments = comments or key == "class" and not COMMENTS.isdisjoint(words) or key == "id" and name in ("div", "section", "ol", "ul", "article") and not COMMENTS.isdisjoint(words)
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            skip = skip or name not in ("html", "body")
    own = name in ("html", "body") or name in CONTENT or inside and (name in HEADINGS or name == "section")
    if inside and (comments or talk) and name not in HEADINGS or not own and (talk or any(n in hides for n in names)):
        skip = True
    return skip, tuple(names)


def tokens_of(page: str, hides: frozenset[str] = frozenset()) -> Iterator[Token]:
    """The tokens of a page. An element that holds no content is one token, skipped."""
    stack: list[tuple[str, bool, tuple[str, ...]]] = []  # names of open elements, whether each is skipped, their keys
    opened: Counter[str] = Counter()  # open elements by name
    hidden = depth = at = 0  # skipped and content elements that are open; how far the page was read

    def pop() -> str:
        nonlocal hidden, depth
        name, skipped, _ = stack.pop()
        opened[name] -= 1
        hidden -= skipped
        depth -= name in CONTENT
        return name

    def leave(before: int) -> Iterator[Token]:
        if before and not depth and not hidden:
            yield Token("leave", "</content", True)

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not hidden:
            yield Token("text", _html.unescape(page[at:end]))
        if not m:
            break
        at, was = m.end(), depth
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
                yield from leave(was)
            if not hidden:
                yield Token("close", f"</{name}", name in BLOCKS)
            continue
        if name in RAW:
            if not CLOSED.search(attributes) or name not in ("svg", "math"):
                done = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = done.end() if done else len(page)
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop()
        ends = CLOSES.get(name, {"p"} if name in BLOCKS else ())
        while stack and (stack[-1][0] in ends or stack[-1][0] == "p" and name in BLOCKS):
            pop()
        if name in BLOCKS and name != "p" and opened["p"] and not hidden:
            while stack and pop() != "p":
                pass
        if name == "body" or name in CONTENT and not depth:  # nothing unclosed before it hides it
            while hidden and stack:
                pop()
        yield from leave(was)
        if name == "input" or hidden and name in VOID:
            continue
        if name in VOID:
            yield Token("open", f"<{name}", name in BLOCKS)
            continue
        skipped, names = _judged(name, attributes, depth > 0, hides)
        if name in CONTENT and not depth:
            skipped = False
        if not hidden and name in CONTENT and not depth:
            yield Token("enter", "<content", True, (), tuple(keys for _, _, keys in stack))
        elif not hidden:
            yield Token("skipped" if skipped else "open", f"<{name}", skipped or name in BLOCKS, names)
        if not CLOSED.search(attributes):
            stack.append((name, skipped, (f"<{name}", *names)))
            opened[name] += 1
            hidden += skipped
            depth += name in CONTENT
    was, depth = depth, 0
    yield from leave(was)


def counts_of(page: str) -> Counter:
    """Times that each tag and name stands inside (1) and outside (0) the content that a labelled page marks; what is around the content isn't counted."""
    out, inside = Counter(), 0
    for t in tokens_of(page):
        if t.kind in ("enter", "leave"):
            inside = int(t.kind == "enter")
            for keys in t.around:
                out.subtract((k, 0) for k in keys)
        elif t.kind != "text":
            out.update((k, inside) for k in (t.value, *t.names))
    return +out


def learn(counts: Counter) -> Model:
    """Scores from the sums of counts_of()."""
    tags, names = ({k for k, _ in counts if k[:1] == "<"}, {k for k, _ in counts if k[:1] == "."})
    total = [sum(counts[t, i] + 1 for t in tags) for i in (0, 1)]
    weights = {t: min(MOST, max(LEAST, -math.log(((counts[t, 0] + 1) / max(total[0], 1)) / ((counts[t, 1] + 1) / max(total[1], 1))))) for t in tags}
    odds = {f".{w}": math.log(PRIOR + 1) for w in OUTSIDE}
    for n in names:
        odds[n] = math.log((counts[n, 0] + 1 + PRIOR * (n[1:] in OUTSIDE)) / (counts[n, 1] + 1))
    return Model(weights | {n: min(0.0, max(LEAST, -x)) for n, x in odds.items()}, frozenset(n for n, x in odds.items() if x >= SKIP))


def fit(pages: DataFrame, params: Params | None = None) -> Model:
    """pages: (page_id, html). Those with one <article> or <main> are labelled."""
    p = params or Params()
    pages = pages.select("page_id", F.col("html").cast("string").alias("html"))
    labelled = pages.where(F.regexp_count("html", F.lit("(?i)<(?:article|main)[\\s>]")) == 1)
    chosen = least(labelled.select("page_id", F.xxhash64("html").alias("h")), p.max_pages, "page_id", "h").distinct()
    some = labelled.join(F.broadcast(chosen), (labelled["page_id"].eqNullSafe(chosen["page_id"])) & (F.xxhash64("html") == chosen["h"]), "left_semi")

    def count(batches):
        for batch in batches:
            total = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counts_of(page))
            yield pa.record_batch([pa.array([t for t, _ in total], pa.string()), pa.array([i for _, i in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["tag", "inside", "n"])

    sums = some.select("html").mapInArrow(count, "tag string, inside int, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    return learn(Counter({(r.tag, r.inside): r.n for r in sums.collect()}))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [model.text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
