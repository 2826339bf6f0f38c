"""Labelled pages for training: given texts in the layouts, elements and names that sites use.

``data-label`` says of an element whether its text is the article's (1) or not (0). The lists are examples, not rules: the
model sees the elements and the words in them, never the label, and has to weigh them.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

ARTICLE = (
    ("article", ""),
    ("article", 'class="post"'),
    ("article", 'id="post-17"'),
    ("main", ""),
    ("main", 'id="content"'),
    ("div", 'class="content"'),
    ("div", 'id="main-content"'),
    ("div", 'class="entry-content"'),
    ("div", 'class="post-body"'),
    ("div", 'class="story"'),
    ("div", 'itemprop="articleBody"'),
    ("div", 'class="article__body"'),
    ("section", 'class="article-text"'),
    ("section", ""),
    ("div", ""),
    ("div", 'class="col-8"'),
    ("div", 'class="css-1x2y3z"'),
    ("td", ""),
)
NAV = (
    ("nav", ""),
    ("nav", 'class="main-nav"'),
    ("ul", 'class="menu"'),
    ("div", 'id="navigation"'),
    ("div", 'class="navbar"'),
    ("div", 'role="navigation"'),
    ("ol", 'class="breadcrumbs"'),
    ("div", 'class="topbar"'),
    ("div", ""),
    ("ul", ""),
)
HEADER = (("header", ""), ("header", 'class="site-header"'), ("div", 'id="masthead"'), ("div", 'class="page-banner"'), ("div", 'id="header"'), ("div", 'role="banner"'))
FOOTER = (
    ("footer", ""),
    ("footer", 'class="site-footer"'),
    ("div", 'id="footer"'),
    ("div", 'class="bottom"'),
    ("div", 'role="contentinfo"'),
    ("div", 'class="copyright"'),
    ("div", 'class="wrap"'),
    ("div", 'class="row"'),
    ("p", ""),
    ("div", ""),
)
SIDE = (
    ("aside", ""),
    ("aside", 'class="sidebar"'),
    ("div", 'id="sidebar"'),
    ("div", 'class="widget-area"'),
    ("div", 'class="right-rail"'),
    ("div", 'role="complementary"'),
    ("section", 'class="widget"'),
    ("td", 'class="side"'),
)
ADVERT = (
    ("div", 'class="ad"'),
    ("div", 'class="ads"'),
    ("div", 'class="advertisement"'),
    ("div", 'id="ad-top"'),
    ("aside", 'class="ad-slot"'),
    ("div", 'class="sponsored"'),
    ("section", 'class="promo"'),
    ("div", 'data-ad="1" class="banner-ad"'),
    ("p", 'class="advert"'),
)
NOTICE = (
    ("div", 'class="cookie-notice"'),
    ("div", 'id="cookie-banner"'),
    ("div", 'class="consent"'),
    ("div", 'class="notice"'),
    ("div", 'role="alert"'),
    ("section", 'class="gdpr-popup"'),
    ("dialog", ""),
    ("div", 'class="modal"'),
    ("p", 'class="notice"'),
    ("div", 'role="dialog"'),
)
FORM = (("form", ""), ("form", 'class="search"'), ("form", 'id="newsletter"'), ("div", 'class="newsletter-signup"'), ("div", 'class="subscribe-box"'), ("form", 'class="login"'))
COMMENTS = (
    ("section", 'class="comments"'),
    ("section", 'id="comments"'),
    ("div", 'id="comments"'),
    ("div", 'class="comment-list"'),
    ("ol", 'class="commentlist"'),
    ("div", 'class="reader-comments"'),
    ("div", 'id="disqus_thread"'),
    ("aside", 'class="discussion"'),
    ("ul", 'class="replies"'),
)
COMMENT = (("div", 'class="comment"'), ("article", 'class="comment"'), ("li", ""), ("li", 'class="comment"'), ("div", ""), ("p", ""))
SHARE = (("div", 'class="share"'), ("ul", 'class="social-links"'), ("div", 'class="post-tags"'), ("div", 'class="toolbar"'))
RELATED = (("div", 'class="related"'), ("section", 'class="recommended"'), ("aside", 'class="read-more"'), ("div", 'id="popular-posts"'), ("ul", 'class="more-stories"'))

SAYS = {
    "footer": ("© 2023 All rights reserved.", "Copyright 2019", "Terms of use", "Privacy policy", "Imprint", "Contact us", "Impressum", "Mentions légales", "Aviso legal", "Powered by"),
    "notice": (
        "This site uses cookies to improve your experience.",
        "We use cookies. By continuing to browse you accept our privacy policy.",
        "Please enable JavaScript in your browser.",
        "Accept all cookies",
        "Diese Website verwendet Cookies.",
        "Ce site utilise des cookies.",
        "Este sitio utiliza cookies.",
    ),
    "form": ("Search", "Your e-mail", "Subscribe to our newsletter", "Log in", "Sign up", "Name", "Password", "Newsletter abonnieren"),
    "share": ("Share", "Tweet", "Facebook", "Print", "E-mail this", "Tags"),
    "comment": ("Reply", "3 comments", "Leave a comment", "Anna wrote:", "posted by max", "Report", "Antworten", "Kommentare", "Commentaires"),
    "advert": ("Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad"),
    "related": ("Related articles", "Read more", "You may also like", "Most popular", "See also", "Lire aussi"),
}


class _Writer:
    """One page, of texts drawn from a stock."""

    def __init__(self, rng: random.Random, stock: list[str]):
        self.rng, self.stock = rng, stock

    def words(self, least: int, most: int) -> str:
        """A run of words out of a drawn text, or of as many texts as it takes."""
        n, got = self.rng.randint(least, most), []
        while len(got) < n:
            source = self.rng.choice(self.stock).split()
            start = self.rng.randrange(len(source))
            got += source[start : start + n - len(got)]
        return html.escape(" ".join(got), quote=False)

    def sentences(self, least: int, most: int) -> str:
        text = self.words(least, most)
        return text[:1].upper() + text[1:].rstrip(",;:.") + self.rng.choice(("." * 9 + "!?…"))

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def inside(self, names: tuple[tuple[str, str], ...], label: int | None, content: str) -> str:
        tag, attrs = self.rng.choice(names)
        mark = "" if label is None else f' data-label="{label}"'
        filled = f"<{tag} {attrs}{mark}>{content}</{tag}>"
        return f"<table><tr>{filled}</tr></table>" if tag == "td" else filled

    def links(self, least: int, most: int) -> str:
        item = self.rng.choice(("<li>{}</li>", "{} ", "<p>{}</p>", "<div>{}</div>", "{} | "))
        made = [item.format(f'<a href="/{k}">{self.words(1, 4)}</a>') for k in range(self.rng.randint(least, most))]
        return f"<ul>{''.join(made)}</ul>" if item.startswith("<li") and self.chance(0.7) else "".join(made)

    def say(self, kind: str, share: float = 0.7) -> str:
        return f"{self.rng.choice(('<p>', '<span>', '<div>'))}{html.escape(self.rng.choice(SAYS[kind]))}" if self.chance(share) else ""

    # --- parts that are no article ---

    def nav(self) -> str:
        return self.inside(NAV, 0, self.links(2, 9))

    def header(self) -> str:
        title = self.rng.choice(("<h1>{}</h1>", "<div>{}</div>", "<h2><a href='/'>{}</a></h2>", "<p>{}</p>", "<a href='/'>{}</a>")).format(self.words(1, 8))
        return self.inside(HEADER, 0, title + (self.nav() if self.chance(0.5) else "") + (self.form() if self.chance(0.2) else ""))

    def footer(self) -> str:
        owner = f" {self.words(1, 4)}. " if self.chance(0.5) else " "
        text = self.say("footer", 0.8).replace(" ", owner, 1) + (f"<p>{self.sentences(3, 25)}" if self.chance(0.4) else "")
        return self.inside(FOOTER, 0, (text or "&copy; " + self.words(1, 6)) + (self.links(2, 8) if self.chance(0.5) else ""))

    def advert(self) -> str:
        body = self.say("advert", 0.4) + (self.sentences(3, 40) if self.chance(0.8) else f'<a href="/buy">{self.words(2, 8)}</a>')
        return self.inside(ADVERT, 0, body if self.chance(0.5) else f"<p>{body}</p>")

    def notice(self) -> str:
        return self.inside(NOTICE, 0, self.say("notice", 0.7) + (f"<p>{self.sentences(4, 30)}</p>" if self.chance(0.6) else "<button>OK</button>"))

    def form(self) -> str:
        return self.inside(FORM, 0, self.say("form", 0.9) + f"<label>{self.words(1, 4)}</label><input>" + (f"<p>{self.sentences(4, 20)}</p>" if self.chance(0.4) else ""))

    def share(self) -> str:
        return self.inside(SHARE, 0, self.say("share", 0.6) + self.links(1, 5))

    def related(self) -> str:
        return self.inside(RELATED, 0, "<h3>" + (self.rng.choice(SAYS["related"]) if self.chance(0.7) else self.words(1, 4)) + "</h3>" + self.links(2, 6) + (f"<p>{self.sentences(6, 25)}</p>" if self.chance(0.3) else ""))

    def side(self) -> str:
        parts = [f"<h3>{self.words(1, 4)}</h3>"]
        for _ in range(self.rng.randint(1, 3)):
            parts.append(self.rng.choice((lambda: self.links(2, 7), lambda: f"<p>{self.sentences(4, 40)}</p>", self.advert, self.related, self.form))())
        return self.inside(SIDE, 0, "".join(parts))

    def comments(self) -> str:
        made = [f"<h3>{self.rng.choice(SAYS['comment'])}</h3>" if self.chance(0.6) else ""]
        for _ in range(self.rng.randint(1, 6)):
            by = f"<span>{self.words(1, 2)}</span>" if self.chance(0.4) else f"<p><b>{self.words(1, 2)}</b> {self.rng.choice(SAYS['comment'])}</p>" if self.chance(0.4) else ""
            text = self.sentences(3, 60) if self.chance(0.4) else f"<p>{self.sentences(3, 60)}</p>"
            made.append(self.inside(COMMENT, None, by + text))
        return self.inside(COMMENTS, 0, "".join(made) + (self.form() if self.chance(0.3) else ""))

    # --- the article ---

    def block(self) -> str:
        kind = self.rng.random()
        if kind < 0.68:
            text = self.sentences(1, 12) if self.chance(0.25) else self.sentences(10, 120)
            if self.chance(0.25):
                text = f"{self.rng.choice(('<b>', '<em>', '<strong>'))}{self.words(1, 20)}{self.rng.choice(('</b>', '<br>', ''))} {text}"
            if self.chance(0.15):
                text += f' <a href="/x">{self.words(1, 5)}</a> {self.sentences(2, 20)}'
            return f"<div>{text}</div>" if self.chance(0.08) else f"<p>{text}" + ("</p>" if self.chance(0.9) else "")
        if kind < 0.8:
            return self.rng.choice(("<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>")).format(self.words(1, 9))
        if kind < 0.88:
            items = "".join(f"<li>{self.sentences(2, 25) if self.chance(0.6) else self.words(1, 6)}</li>" for _ in range(self.rng.randint(2, 6)))
            return self.rng.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format(items)
        if kind < 0.93:
            return f"<blockquote>{self.rng.choice(('{}', '<p>{}</p>')).format(self.sentences(5, 50))}</blockquote>"
        if kind < 0.96:
            return f"<figure><img src='a.png'><figcaption>{self.sentences(3, 15)}</figcaption></figure>"
        if kind < 0.98:
            return f"<pre>{self.words(3, 30)}</pre>"
        rows = "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.rng.randint(2, 4)))
        return f"<table>{rows}</table>"

    def article(self) -> str:
        title = f"<h1>{self.words(2, 14)}</h1>"
        if self.chance(0.2):
            title = f'<header data-label="1">{title}</header>'
        blocks = [self.block() for _ in range(self.rng.choice((1, 1, 2, 3, 4, 6, 9, 14)))]
        if self.chance(0.15):
            blocks = [self.sentences(20, 200), *blocks] if self.chance(0.5) else ["<br>".join(self.sentences(10, 60) for _ in range(3))]
        for part, share in ((self.advert, 0.2), (self.share, 0.15), (self.related, 0.12), (self.notice, 0.05), (self.form, 0.05)):
            if self.chance(share):
                blocks.insert(self.rng.randint(0, len(blocks)), part())
        if self.chance(0.1):
            blocks.append(self.comments())
        if self.chance(0.08):
            blocks.append(f'<footer data-label="0">{self.links(1, 4)}</footer>')
        inner = "".join(([title] if self.chance(0.85) else []) + blocks)
        if self.chance(0.2):
            inner = self.inside((("div", ""), ("div", 'class="inner"'), ("section", "")), None, inner)
        return self.inside(ARTICLE, 1, inner)

    def page(self) -> str:
        top = [part() for part, share in ((self.header, 0.6), (self.notice, 0.35), (self.nav, 0.6), (self.advert, 0.4), (self.form, 0.15)) if self.chance(share)]
        self.rng.shuffle(top)
        middle = [self.article()] if self.chance(0.95) else [self.related(), self.nav()]
        if self.chance(0.35):
            middle.insert(self.rng.randint(0, 1), self.side())
        end = [part() for part, share in ((self.comments, 0.35), (self.related, 0.2), (self.share, 0.1), (self.advert, 0.15), (self.form, 0.15)) if self.chance(share)]
        self.rng.shuffle(end)
        if self.chance(0.3):
            middle = [self.inside((("div", 'id="wrapper"'), ("div", 'class="container"'), ("main", ""), ("div", 'id="page"'), ("div", "")), 0, "".join(middle + end))]
            end = []
        bottom = [self.footer()] if self.chance(0.8) else []
        if self.chance(0.15):
            bottom.append(self.notice())
        return f'<html><head><title>{self.words(1, 6)}</title></head><body data-label="0">{"".join(top + middle + end + bottom)}</body></html>'


def pages(rng: random.Random, stock: list[str], count: int) -> Iterator[str]:
    """So many labelled pages of texts of the stock; where it has none, of numbered words."""
    stock = [text for text in stock if text.split()] or [" ".join(f"word{k}" for k in range(200))]
    for _ in range(count):
        yield _Writer(rng, stock).page()
