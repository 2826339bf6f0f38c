"""HTML pages as trees of block elements with runs of text as leaves, all trees of a batch in one set of arrays.

Inline elements are no nodes: their text belongs to the run around them. A run ends where a block element begins or ends. End
tags that pages leave out are implied as browsers imply them; wrong ones are ignored. Text that is never shown as
such (scripts, styles, templates, the head, form controls, embedded media) is left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

_TAG = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|([^>]*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")

#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video textarea select button datalist title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An element that ends open ones of its kind, up to the element that holds them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_GROUPS = {
    **dict.fromkeys("h2 h3 h4 h5 h6".split(), "heading"),
    **dict.fromkeys("ul ol menu dir dl".split(), "list"),
    **dict.fromkeys("li dd dt".split(), "item"),
    **dict.fromkeys("table tbody thead tfoot tr".split(), "table"),
    **dict.fromkeys("td th caption".split(), "cell"),
    **dict.fromkeys("blockquote pre figure figcaption".split(), "quote"),
    **dict.fromkeys("html body".split(), "page"),
    **dict.fromkeys("form fieldset legend".split(), "form"),
    **dict.fromkeys("article main section div nav header footer aside p h1 address dialog".split()),
}
#: Kinds of elements by words in their class, id, role and the like, and of texts by words in them: fixed word lists.
_HINTS = {
    "content": r"article|content|entry|post(?!er)|story|main|body|text|blog|hentry|page-?inner|lead|prose|markdown",
    "nav": r"nav|menu|breadcrumb|crumb|pagination|pager|toc|tabs?\b|topbar|skip|sitemap",
    "header": r"header|masthead|banner|logo|brand|site-?title",
    "footer": r"footer|bottom|colophon|copyright|legal|imprint|credits",
    "side": r"side|aside|widget|rail|column-?right|complementary|secondary",
    "advert": r"\bads?\b|advert|sponsor|promo|banner-?ad|adsense|dfp|doubleclick|commercial|anzeige|publicit|werbung",
    "notice": r"cookie|consent|gdpr|notice|alert|warning|popup|modal|overlay|toast|dialog|paywall|privacy|message",
    "form": r"form|newsletter|subscri|signup|sign-?up|login|search|contact|poll|survey",
    "comment": r"comment|discuss|disqus|repl(?:y|ies)|respond|reaction|thread|feedback|kommentar|commentaire|comentario",
    "share": r"share|social|follow|like-?box|facebook|twitter|toolbar|tool-?bar|tags?\b|meta\b|byline",
    "related": r"related|recommend|more-?(?:news|stories|from)|similar|popular|trending|read-?(?:more|next)|also|teaser|outbrain|taboola",
    "hidden": r"hidden|invisible|sr-only|screen-reader|display:\s*none",
}
_SAYS = {
    "says_legal": r"©|\(c\) \d|copyright|all rights reserved|terms of (?:use|service)|privacy|datenschutz|impressum|mentions légales|aviso legal",
    "says_consent": r"cookie|consent|einwillig|javascript|browser",
    "says_advert": r"advertis|sponsored|anzeige|werbung|publicité|publicidad",
    "says_act": r"subscribe|newsletter|sign up|log ?in|register|share|follow us|click here|abonn|anmelden|suscr|e-?mail",
    "says_talk": r"\brepl(?:y|ies)\b|\bcomments?\b|posted by|wrote:|kommentar|commentaire|comentario|antworten|répondre|responder",
    "says_more": r"related|read more|see also|you may|recommended|popular|mehr zum|lire aussi|leer más",
}
_HINT = {name: re.compile(rule) for name, rule in _HINTS.items()}
_SAY = {name: re.compile(rule, re.I) for name, rule in _SAYS.items()}
_READ = ("class", "id", "role", "itemprop", "aria-label", "name", "style")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)]*$")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


@lru_cache(maxsize=20_000)
def hints(text: str) -> tuple[str, ...]:
    """The kinds that an element's attributes name."""
    found = attributes(text)
    said = re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(found[n] for n in _READ if n in found)).lower()
    kinds = [name for name, rule in _HINT.items() if rule.search(said)]
    if "hidden" in found or found.get("aria-hidden") == "true":
        kinds.append("hidden")
    return tuple(dict.fromkeys(kinds))


@dataclass
class Node:
    parent: int
    tag: str
    attributes: str
    #: Text of a leaf, already with single spaces; None for an element.
    text: str | None = None
    words: int = 0
    linked: int = 0
    leaves: int = 0
    sentences: int = 0
    before: int = 0


@dataclass
class Page:
    """Nodes in page order, parents before children; only nodes with text below them."""

    nodes: list[Node] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of one page."""
    nodes = [Node(-1, "html", "")]
    stack, open_tags = [0], {"html": 1}
    run: list[tuple[str, bool]] = []
    link = 0  # height of the stack at which a link was opened
    at, end, total = 0, len(source), 0

    def flush() -> None:
        nonlocal run, total
        if not run:
            return
        text = " ".join("".join(part for part, _ in run).split())
        if text and "head" not in open_tags:
            words = text.count(" ") + 1
            linked = min(words, sum(len(part.split()) for part, inside in run if inside))
            nodes.append(Node(stack[-1], "#text", "", text, words, linked, 1, int(bool(_SENTENCE.search(text))), total))
            total += words
        run = []

    def close(height: int) -> None:
        nonlocal link
        flush()
        while len(stack) > height:
            tag = nodes[stack.pop()].tag
            open_tags[tag] -= 1
            if not open_tags[tag]:
                del open_tags[tag]
        if link > len(stack):
            link = 0

    def close_up_to(kinds: set[str], stop: set[str]) -> None:
        height = len(stack)
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in stop:
                break
            if tag in kinds:
                height = k
        if height < len(stack):
            close(height)

    while at < end:
        found = _TAG.search(source, at)
        if found is None:
            run.append((html.unescape(source[at:]), bool(link)))
            break
        if found.start() > at:
            run.append((html.unescape(source[at : found.start()]), bool(link)))
        at = found.end()
        data, ending, tag, attrs, loose = found.groups()
        if tag is None:
            if data:
                run.append((data, bool(link)))
            continue
        tag, attrs = tag.lower(), attrs if attrs is not None else loose or ""
        if ending:
            if tag == "a":
                link = 0
            elif tag in open_tags and tag not in ("html", "body"):
                height = len(stack) - 1
                while nodes[stack[height]].tag != tag:
                    height -= 1
                if height:
                    close(height)
            elif tag == "br":
                run.append((" ", bool(link)))
        elif tag in SILENT:
            if not attrs.endswith("/") or tag not in ("svg", "math"):
                stop = _silent_end(tag).search(source, at)
                at = stop.end() if stop else end
            if tag not in ("script", "style", "template", "noscript", "title"):
                run.append((" ", bool(link)))
        elif tag == "a":
            link = len(stack)
        elif tag in VOID:
            if tag == "hr":
                if "p" in open_tags:
                    close_up_to({"p"}, BLOCKS - {"p"})
                flush()
            elif tag == "br":
                run.append((" ", bool(link)))
        elif tag == "html" or (tag == "body" and tag in open_tags):
            continue
        elif tag in BLOCKS or "-" in tag:
            flush()
            if "p" in open_tags:
                close_up_to({"p"}, BLOCKS - {"p"})
            if tag in _ENDS:
                close_up_to(*_ENDS[tag])
            if tag == "head" and tag in open_tags:
                continue
            if "head" in open_tags and tag != "head":
                close_up_to({"head"}, set())
            nodes.append(Node(stack[-1], tag, attrs))
            stack.append(len(nodes) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return _with_text(nodes)


@lru_cache(maxsize=64)
def _silent_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _with_text(nodes: list[Node]) -> Page:
    """Sums below each element, and the nodes with text only."""
    for node in reversed(nodes):
        if node.parent >= 0 and node.leaves:
            above = nodes[node.parent]
            above.words += node.words
            above.linked += node.linked
            above.leaves += node.leaves
            above.sentences += node.sentences
            above.before = node.before
    places, kept = {}, []
    for place, node in enumerate(nodes):
        if node.leaves:
            places[place] = len(kept)
            node.parent = places.get(node.parent, -1)
            kept.append(node)
    return Page(kept)


# --- features ------------------------------------------------------------------------------


_RATE = (0.0, 0.15, 0.4, 0.75)
_WORDS = (1, 3, 6, 12, 25, 60, 200, 800)


def _names() -> list[str]:
    groups = sorted({g or tag for tag, g in _GROUPS.items()} | {"other"})
    steps = [f"{name}{k}" for name, n in (("words", 9), ("link", 5), ("mean", 9), ("ends", 5), ("share", 5), ("place", 4)) for k in range(n)]
    own = [f"is_{g}" for g in groups] + [f"in_{g}" for g in groups]
    hinted = [f"hint_{h}" for h in _HINTS] + [f"up_{h}" for h in _HINTS] + ["hint_none", "up_none"]
    both = [f"{side}_{name}" for side in ("leaf", "node") for name in ["bias", *steps]]
    return own + hinted + both + list(_SAYS) + ["no_sentence"]


NAMES = _names()
PLACE = {name: k for k, name in enumerate(NAMES)}


@lru_cache(maxsize=200_000)
def _kind(tag: str, attrs: str, side: str) -> tuple[int, ...]:
    group = (_GROUPS[tag] or tag) if tag in _GROUPS else "other"
    own = hints(attrs) if attrs else ()
    up = "up" if side == "in" else "hint"
    return (PLACE[f"{side}_{group}"], *(PLACE[f"{up}_{h}"] for h in own)) if own else (PLACE[f"{side}_{group}"], PLACE[f"{up}_none"])


def _kinds(page: Page) -> Iterator[tuple[int, ...]]:
    """For each node the features of its own and its parent's kind, and of what a short text says."""
    nodes = page.nodes
    for node in nodes:
        text = node.text
        found = () if text is not None else _kind(node.tag, node.attributes, "is")
        if node.parent >= 0:
            above = nodes[node.parent]
            found += _kind(above.tag, above.attributes, "in")
        if text is not None:
            if node.words <= 40:
                found += tuple(PLACE[name] for name, rule in _SAY.items() if rule.search(text))
            if not node.sentences:
                found += (PLACE["no_sentence"],)
        yield found


def _amounts(counts: np.ndarray) -> np.ndarray:
    """Features of amounts: columns are whether it is an element, words, words in links, leaves, sentence ends, words before, words of the page."""
    element, words, linked, leaves, ends, before, total = counts.T
    total = np.maximum(total, 1)
    sides = []
    for side in ("leaf", "node"):
        base = {name: PLACE[f"{side}_{name}0"] for name in ("words", "link", "mean", "ends", "share", "place")}
        steps = lambda values, bounds: np.searchsorted(bounds, values, "left")
        columns = [
            np.full(len(words), PLACE[f"{side}_bias"]),
            base["words"] + steps(words, _WORDS),
            base["link"] + steps(linked / words, _RATE),
            base["mean"] + steps(words / leaves, _WORDS),
            base["ends"] + steps(ends / leaves, _RATE),
            base["share"] + steps(words / total, (0.02, 0.1, 0.3, 0.7)),
            base["place"] + steps(before / total, (0.05, 0.5, 0.95)),
        ]
        sides.append(np.stack(columns, 1))
    return np.where(element[:, None] > 0, sides[1], sides[0])


#: Kinds of parent-child potentials: by whether the child is a leaf, and what its own hints say.
EDGES = 4


@lru_cache(maxsize=200_000)
def _edge(tag: str, attrs: str) -> int:
    own = set(hints(attrs)) if attrs else set()
    if own - {"content"} or tag in ("nav", "header", "footer", "aside", "form", "dialog"):
        return 1
    return 2 if own or tag in ("article", "main") else 3


def edge(node: Node) -> int:
    return 0 if node.text is not None else _edge(node.tag, node.attributes)


@dataclass
class Forest:
    """The trees of many pages in one set of arrays.

    ``levels`` are the nodes by depth. A node's features are a row of ``amounts``, and the ``kinds`` whose ``owners`` it is.
    """

    parent: np.ndarray
    edges: np.ndarray
    amounts: np.ndarray
    kinds: np.ndarray
    owners: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        parent, edges, kinds, sizes, depth, counts = [], [], [], [], [], []
        for page in pages:
            first = len(parent)
            total = page.nodes[0].words if page.nodes else 0
            for node, found in zip(page.nodes, _kinds(page)):
                above = node.parent + first if node.parent >= 0 else -1
                depth.append(depth[above] + 1 if above >= 0 else 0)
                parent.append(above)
                edges.append(edge(node))
                sizes.append(len(found))
                kinds += found
                counts.append((node.text is None, node.words, node.linked, node.leaves, node.sentences, node.before, total))
        deep = np.array(depth, np.int64)
        order = np.argsort(deep, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(deep[order])) + 1) if len(order) else []
        amounts = _amounts(np.array(counts, np.int64).reshape(-1, 7))
        owners = np.repeat(np.arange(len(parent)), sizes)
        return Forest(np.array(parent, np.int64), np.array(edges, np.int64), amounts, np.array(kinds, np.int64), owners, levels)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The log odds of content for each node by its features alone."""
        return weights[self.amounts].sum(1) + np.bincount(self.owners, weights[self.kinds], len(self.parent))

    def totals(self, values: np.ndarray) -> np.ndarray:
        """For each feature the sum of the values of the nodes that have it."""
        each = np.bincount(self.amounts.ravel(), np.repeat(values, self.amounts.shape[1]), len(NAMES))
        return each + np.bincount(self.kinds, values[self.owners], len(NAMES))
