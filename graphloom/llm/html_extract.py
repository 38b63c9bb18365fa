"""Main text of web pages by tag-path ratios.

A page is read into leaves: runs of text between tags, each with its tag path from the root (inline
elements included; an element's class and id, as mere strings, belong to its step). Per path, text length
and punctuation are summed over all its leaves on the page and divided by their number: the path ratios.

Leaves between block-level tags form a block, which takes the ratios of its leaves' paths. The ratios are
smoothed over neighbouring blocks, the more the nearer these are in the tree, and fused, with the share
of the page's text that stands in the block's container, into one score per path and container. A
threshold drawn from the spread of the page's own scores selects the paths whose blocks are the text.

Names are a prior: elements called boilerplate by their name (menus, footers, forms) or by a word in class,
id or role (adverts, sidebars, notices, comments) have their scores divided, articles multiplied, before they meet
the threshold. A container that mostly consists of selected paths, and an element that is named an article, keep
their other paths (lists, captions) as well, unless they are links only, and a heading goes with the block
that follows it.

Text that is never shown (scripts, styles, templates, hidden elements) and the texts of controls are no leaves.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import with_results

# Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    "button", "select", "option", "optgroup", "label", "svg", "math", "object", "video", "audio", "canvas", "map",
}
#: Elements whose text is no prose of the page, whatever its ratios.
NEVER = {"head", "button", "select", "svg", "math", "object", "video", "audio", "canvas", "map"}
BOILERPLATE = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "search"}
#: Opening one of these ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
#: Opening the key ends an open element of the value, up to the elements in SCOPE.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "html", "main", "aside", "nav", "footer", "header", "blockquote", "select", "form"}
#: Words of a class, id or role that name boilerplate.
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "adbox", "adunit", "sponsor", "sponsors", "sponsored", "promo", "promos", "promotion",
    "sidebar", "sidebars", "sidenav", "aside", "complementary", "widget", "widgets", "rail",
    "nav", "navs", "navbar", "navigation", "menu", "menus", "menubar", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip", "skiplink",
    "footer", "contentinfo", "copyright", "header", "masthead", "topbar", "banner", "colophon",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "alertdialog", "dialog", "popup", "modal", "overlay", "paywall", "disclaimer", "toolbar",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "reactions",
    "social", "share", "sharing", "sharebar", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchbox",
}
#: Of these, the ones that inside an article stand for its own heading.
HEADING_HINTS = {"header", "banner", "masthead"}
#: A tag by HTML's own rules: a quote counts only where a value starts, and a value may hold ">".
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+)*+)>")
#: What stands for a tag whose quote is never closed: up to the next ">".
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?")
LABELS = re.compile(r"class|id|role|hidden", re.I)
#: Such words tell what a page has or lacks, not what the element is.
WITHOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is)[-_]\S+", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，．！？：；،؛؟।]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold the text of one block rather than an article.
LEAVES = {*HEADINGS, "p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "thead", "tfoot", "table", "figure", "figcaption", "hgroup", "caption", "summary"}
#: Prior of boilerplate and of articles.
DOUBT, TRUST = 0.02, 8.0
#: Prior of a form: some pages are one form as a whole, so an article in it is still an article.
FORM = 0.03
#: Weights of the blocks before, at and after a block.
KERNEL = (1.0, 2.0, 4.0, 2.0, 1.0)
#: Containers around a block whose share of the text counts, each half as much as the one inside it.
LEVELS = 4
#: Share of the standard deviation of the page's scores that a path must reach, and of its greatest score.
SPREAD = 1.0
FLOOR = 0.04
#: What a step in the tree leaves of a neighbour's weight, and the power of the container's share.
NEAR = 0.5
#: Characters per leaf of a path that needs no container to count as text.
LONG = 300
POWER = 0.75


class Page:
    """Blocks of a page and its tree, as numbers.

    Elements have a parent (``up``), a name, a depth, a prior and the path from the root (``path``, numbers that
    stand for (path of the parent, step)). A block has its text, its block-level element, and its leaves as
    (path, length, stops).
    """

    def __init__(self) -> None:
        self.up, self.name, self.depth, self.prior, self.path = [0], [""], [0], [1.0], [0]
        self.steps: dict[tuple[int, str], int] = {}
        self.texts: list[str] = []
        self.holder: list[int] = []
        self.leaves: list[list[tuple[int, int, int]]] = []
        self.linked: list[int] = []

    def step(self, path: int, name: str) -> int:
        return self.steps.setdefault((path, name), len(self.steps) + 1)


def described(name: str, attributes: str, in_article: bool) -> tuple[float | None, str]:
    """Prior of an element (None: never shown; 1: nothing known) and its step in a path."""
    if name in NEVER:
        return None, name
    prior = FORM if name == "form" else DOUBT if name in BOILERPLATE or name == "header" and not in_article else TRUST if name in ("article", "main") else 1.0
    if not attributes or name in ("html", "body") or not LABELS.search(attributes):
        return prior, name
    labels = []
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return None, name
        if key not in ("class", "id", "role"):
            continue
        words = WORD.findall(WITHOUT.sub(" ", value))
        found = {w.lower() for w in words} & HINTS
        if found - HEADING_HINTS if in_article else found:
            prior = DOUBT
        labels += words
    # a block's own label tells one paragraph from another, not one part of the page
    return prior, name if name in LEAVES else "\t".join([name, *labels])


def blocks(page: str) -> Page:
    out = Page()
    stack = [0]  # open block elements
    hidden = [False]  # by place in the stack
    inside = [False]  # in an article or main
    places: dict[str, list[int]] = {}  # places in the stack by name
    inline: list[tuple[str, int, float | None]] = []  # open inline elements: name, path, prior
    inline_path = unseen = links = 0
    leaves: list[tuple[int, str, bool]] = []
    at, size, last_end = 0, len(page), page.rfind(">")
    raw_end: dict[str, re.Pattern] = {}

    def say(text: str) -> None:
        if not hidden[-1] and not unseen and text:
            leaves.append((inline_path or out.path[stack[-1]], text, links > 0))

    def flush() -> None:
        nonlocal inline_path, unseen, links
        if leaves:
            text = " ".join(entities.unescape("".join(t for _, t, _ in leaves)).split())
            if text:
                held: dict[int, list[int]] = {}
                linked = 0
                for path, t, link in leaves:
                    t = t.strip()
                    if t:
                        own = held.setdefault(path, [0, 0])
                        own[0] += len(t)
                        own[1] += len(PUNCTUATION.findall(t))
                        linked += len(t) if link else 0
                out.texts.append(text)
                out.holder.append(stack[-1])
                out.leaves.append([(p, a, b) for p, (a, b) in held.items()])
                out.linked.append(linked)
            leaves.clear()
        inline.clear()
        inline_path = unseen = links = 0

    def shut(place: int) -> None:
        """Close the open elements from this place on."""
        for k in range(len(stack) - 1, place - 1, -1):
            places[out.name[stack[k]]].pop()
        del stack[place:], hidden[place:], inside[place:]

    def shut_in_scope(names: set[str]) -> None:
        barrier = max((places[n][-1] for n in SCOPE - names if places.get(n)), default=0)
        lowest = len(stack)
        for n in names:
            for place in reversed(places.get(n, ())):
                if place <= barrier:
                    break
                lowest = min(lowest, place)
        shut(lowest)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        follows = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            at = COMMENT.match(page, start).end()
            continue
        if follows in ("!", "?") or follows == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start) if start < last_end else -1
            at = end + 1 if end >= 0 else size
            continue
        if not (follows == "/" or follows.isascii() and follows.isalpha()):
            say("<")
            at = start + 1
            continue
        match = (TAG.match(page, start) or BROKEN.match(page, start)) if start < last_end else None
        if match is None:
            if start < last_end:  # a letter that no tag name starts with
                say("<")
                at = start + 1
                continue
            break  # the page ends within a tag
        at = match.end()
        closing, name, attributes = match.groups()
        name = name.lower()
        if name in RAW:
            if not closing:
                ends = raw_end.get(name) or raw_end.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I))
                end = ends.search(page, at) if at < last_end else None
                at = end.end() if end else size
            continue
        if name in ("br", "wbr"):
            if name == "br":
                say(" ")
            continue
        if name not in BLOCK:
            if closing:
                for k in range(len(inline) - 1, max(-1, len(inline) - 65), -1):  # an end tag that far off is a stray one
                    if inline[k][0] == name:
                        for gone, _, prior in inline[k:]:
                            unseen -= prior is None
                            links -= gone == "a"
                        del inline[k:]
                        inline_path = inline[-1][1] if inline else 0
                        break
            elif name not in VOID and not attributes.endswith("/"):
                prior, step = described(name, attributes, True)
                if prior == DOUBT:
                    prior = None  # within a line of text nothing else speaks for it
                unseen += prior is None
                links += name == "a"
                inline_path = out.step(inline_path or out.path[stack[-1]], name if name in ("a",) else step)
                inline.append((name, inline_path, prior))
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if places.get(name):
                shut(places[name][-1])
            continue
        if name in ENDS_P and places.get("p"):
            shut_in_scope({"p"})
        if name in ENDS_SAME:
            shut_in_scope(ENDS_SAME[name])
        if name in ("html", "body") and places.get(name):
            continue
        if name == "body":
            shut(1 + (len(stack) > 1 and out.name[stack[1]] == "html"))
        prior, step = described(name, attributes, inside[-1])
        parent = stack[-1]
        before = out.prior[parent]
        out.up.append(parent)
        out.name.append(name)
        out.depth.append(out.depth[parent] + 1)
        # boilerplate stays boilerplate, whatever stands in it
        fixed = prior is None or prior == 1.0 or before < 1.0 and not (before == FORM and prior == TRUST)
        out.prior.append(before if fixed else prior)
        out.path.append(out.step(out.path[parent], step))
        places.setdefault(name, []).append(len(stack))
        stack.append(len(out.up) - 1)
        hidden.append(hidden[-1] or prior is None)
        inside.append(inside[-1] or name in ("article", "main"))
    flush()
    return out


def path_ratios(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Per block the text length and the punctuation of its leaves' paths, each per leaf of the path and weighted by the block's own leaves."""
    texts: dict[int, list[int]] = {}
    for leaves in page.leaves:
        for path, length, stops in leaves:
            own = texts.setdefault(path, [0, 0, 0])
            own[0] += length
            own[1] += stops
            own[2] += 1
    length, stops = np.zeros(len(page.texts)), np.zeros(len(page.texts))
    for k, leaves in enumerate(page.leaves):
        total = sum(n for _, n, _ in leaves)
        for path, n, _ in leaves:
            a, b, c = texts[path]
            length[k] += n / total * a / c
            stops[k] += n / total * b / c
    return length, stops


def containers(page: Page) -> list[int]:
    """The element that each block belongs to: above paragraphs and lists, and the block's own element where it holds others."""
    number: dict[int, int] = {}
    for e in page.holder:
        number[e] = number.get(e, 0) + 1
    within = dict.fromkeys(page.holder, 0)
    for e in number:  # blocks in elements right below
        for above in (page.up[e], page.up[page.up[e]]):
            if above in within and above != e:
                within[above] += 1
    out = []
    for e in page.holder:
        if page.name[e] not in LEAVES and (number[e] > 1 or within[e]):
            out.append(e)
            continue
        e = page.up[e]
        while e and page.name[e] in LEAVES:
            e = page.up[e]
        out.append(e)
    return out


def support(page: Page, home: list[int], weight: np.ndarray) -> np.ndarray:
    """For each block the share of the page's text in its container and, half as much each, in the containers around that.

    An element that holds all of the text tells nothing, so it adds nothing but the text that it holds directly.
    """
    total = float(weight.sum()) or 1.0
    direct: dict[int, float] = {}
    for e, w in zip(home, weight.tolist()):
        direct[e] = direct.get(e, 0.0) + w
    whole = dict(direct)
    for e in sorted(direct, key=lambda e: -page.depth[e]):  # a share counts for LEVELS containers around it
        above, w = page.up[e], direct[e]
        for _ in range(LEVELS):
            whole[above] = whole.get(above, 0.0) + w
            if not above:
                break
            above = page.up[above]
    shares: dict[int, float] = {}
    for e in direct:
        value, factor, above = direct[e] / total * 0.5, 0.5, e
        for _ in range(LEVELS - 1):
            if not above:
                break
            above, factor = page.up[above], factor / 2
            if page.name[above] not in ("", "html", "body") and whole.get(above, 0.0) < 0.999 * total:
                value += factor * whole.get(above, 0.0) / total
        shares[e] = value
    return np.array([shares[e] for e in home])


def apart(page: Page, a: int, b: int) -> int:
    """Steps from one element to the other in the tree, up to LEVELS on either side."""
    for steps in range(2 * LEVELS):
        if a == b:
            return steps
        if page.depth[a] >= page.depth[b]:
            a = page.up[a]
        else:
            b = page.up[b]
    return 2 * LEVELS


def path_scores(page: Page, home: list[int], weight: np.ndarray) -> np.ndarray:
    """Fused ratio of each block: text per leaf times punctuation per leaf of its paths, both smoothed, times its container's share."""
    length, stops = path_ratios(page)
    n = len(length)
    smooth_length, smooth_stops, norm = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        for j in range(max(0, k - 2), min(n, k + 3)):
            w = KERNEL[j - k + 2] * NEAR ** apart(page, home[k], home[j])
            smooth_length[k] += w * length[j]
            smooth_stops[k] += w * stops[j]
            norm[k] += w
    # a path of long texts speaks for itself, wherever it stands
    share = support(page, home, weight)
    share += (1 - share) * np.minimum(1.0, length / LONG) ** 2
    return np.log1p(smooth_length / norm) * np.log1p(1 + smooth_stops / norm) * share**POWER


def chosen(page: Page) -> list[bool]:
    """Which blocks are the main text."""
    if not page.texts:
        return []
    n = len(page.texts)
    prior = np.array([page.prior[e] for e in page.holder])
    home = containers(page)
    size = np.array([len(t) for t in page.texts], float)
    linked = np.array(page.linked, float)
    raw = path_scores(page, home, size * np.minimum(prior, 1.0))
    # one score per path (that of the block's longest leaf) and container
    path = [max(leaves, key=lambda x: x[1])[0] if leaves else 0 for leaves in page.leaves]
    index: dict[tuple[int, int], int] = {}
    of = np.array([index.setdefault(key, len(index)) for key in zip(home, path)])
    number = np.bincount(of)
    raw = (np.bincount(of, raw) / number)[of]
    score = raw * prior
    threshold = max(SPREAD * float(np.std(raw)), FLOOR * float(raw.max()))
    kept = score >= threshold
    # a container of mostly selected text keeps its other paths, unless they are links only
    mass: dict[int, list[float]] = {}
    for e, w, k in zip(home, size.tolist(), kept.tolist()):
        own = mass.setdefault(e, [0.0, 0.0])
        own[k] += w
    links = np.bincount(of, linked)[of] >= 0.8 * np.bincount(of, size)[of]
    trusted = np.array([mass[e][1] >= mass[e][0] for e in home])
    kept |= trusted & (prior >= 1.0) & (~links | (prior > 1.0)) | (prior > 1.0) & ~links
    # a heading goes with what follows it
    out = kept.tolist()
    for k in range(n - 2, -1, -1):
        if not out[k] and prior[k] >= 1.0 and page.name[page.holder[k]] in HEADINGS:
            out[k] = out[k + 1]
    return out


def extract(page: str) -> str:
    found = blocks(page)
    return "\n".join(t for t, k in zip(found.texts, chosen(found)) if k)


def extract_rows(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``pages`` (struct ``row``) with the main text of its ``html`` in ``text``.

    A null or empty page, and a page without main text, gives an empty text. Repeated rows stay
    repeated; an empty table gives an empty result. A page is handled whole, one at a time; time and
    memory grow in proportion to its length, however deep or broken its tags are.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array([extract(t) for t in texts], pa.string())]

    return with_results(pages, html, run, [T.StructField("text", T.StringType())], carry)


def query(pages: DataFrame) -> DataFrame:
    return extract_rows(pages, carry=["page_id", "url"]).select(
        F.col("row.page_id").alias("page_id"),
        F.col("row.url").alias("url"),
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
