"""The small labelled table of pages that the decision tree of main text is fitted on, made by rule from page templates.

Texts that begin with "+" are main text. Every template comes in several lengths and with or without some of its parts, so
that no single number of a block gives its label away: titles, short paragraphs and last lines look like slogans, captions and notices
by themselves, and only their neighbours, or where they lie, tell them apart.
"""

from __future__ import annotations

import random

#: Words that the texts of the table are made of.
WORDS = (
    "the river town hall people walk over hills water old bridge wall rain report says about which from with many years while house street night light wind "
    "council plan north field answer question paper letter week month road stone tree market school train number group part place"
).split()
PAGES = 390


class Writer:
    """Random texts, the same in every run."""

    def __init__(self, seed: int):
        self.chance = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.chance.choice(WORDS) for _ in range(self.chance.randint(low, high))).capitalize()

    def long(self) -> str:
        text = self.words(18, 90) + "."
        if self.chance.random() < 0.3:
            text += f' <a href="/r">{self.words(1, 4)}</a> {self.words(3, 20)}<br>{self.words(2, 9)}.'
        return text

    def short(self) -> str:
        return self.words(1, 7) + self.chance.choice([".", "", "!"])

    def maybe(self, text: str, share: float = 0.5) -> str:
        return text if self.chance.random() < share else ""

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.chance.randint(1, 999)}">{self.words(low, high)}</a>'

    def links(self, tag: str, low: int = 2, high: int = 6) -> str:
        return "".join(f"<{tag}>{self.link()}</{tag}>" for _ in range(self.chance.randint(low, high)))

    def body(self, tag: str = "p", low: int = 2, high: int = 6) -> str:
        """Main text: long and short paragraphs, among them a heading, a quotation, a list or one linked line."""
        parts = []
        for _ in range(self.chance.randint(low, high)):
            kind = self.chance.random()
            if kind < 0.55:
                parts.append(f"<{tag}>+{self.long()}</{tag}>")
            elif kind < 0.72:
                parts.append(f"<{tag}>+{self.short()}</{tag}>")
            elif kind < 0.8:
                parts.append(f"<{tag}>+{self.words(1, 3)} {self.link(1, 2)}{self.maybe(' ' + self.short())}</{tag}>")
            elif kind < 0.9:
                parts.append(f"<h2>+{self.words(1, 5)}</h2><{tag}>+{self.long()}</{tag}>")
            elif kind < 0.96:
                parts.append("<ul>" + "".join(f"<li>+{self.short()}</li>" for _ in range(3)) + "</ul>")
            else:
                parts.append(f'<{tag}>+{self.long()}</{tag}><{tag}><a href="/s">+{self.words(3, 8)}</a></{tag}><{tag}>+{self.long()}</{tag}>')
        return "".join(parts)

    def teaser(self) -> str:
        return f'<a href="/t"><h3>{self.words(2, 6)}</h3><p>{self.words(8, 25)}</p></a>'


def plain_article(w: Writer) -> str:
    return (
        f'<nav><ul>{w.links("li")}</ul></nav>' + w.maybe(f'<div class="ad">{w.words(2, 25)}</div>') + w.maybe(f"<div>{w.words(2, 60)}</div>" * w.chance.randint(1, 3), 0.4) + f"<article><h1>+{w.words(2, 9)}</h1>{w.body()}</article>"
        + w.maybe(f'<p>{w.words(3, 40)}</p>') + w.maybe(f"<footer>{w.words(1, 15)} {w.link()}</footer>", 0.8)
    )


def article_with_comments(w: Writer) -> str:
    comments = "".join(f'<article class="comment"><p>{w.words(4, 60)}</p></article>' for _ in range(w.chance.randint(1, 6)))
    return (
        f'<header><h1>{w.words(1, 3)}</h1><p>{w.words(2, 12)}</p></header><aside><h2>{w.words(1, 3)}</h2><p>{w.words(5, 40)}</p></aside><main><h1>+{w.words(2, 8)}</h1>{w.body()}'
        f'<section id="comments"><h3>Comments</h3>{comments}</section></main><div class="footer"><p>{w.words(2, 12)}</p></div>'
    )


def marked_divisions(w: Writer) -> str:
    return (
        f'<div class="{w.chance.choice(["menu", "main-nav", "navbar"])}">{w.links("span")}</div><div id="{w.chance.choice(["site-header", "header"])}"><p>{w.words(2, 9)}</p></div>'
        f'<div class="{w.chance.choice(["content", "text", "page"])}"><h1>+{w.words(2, 7)}</h1>{w.body()}</div><div id="sidebar"><h3>{w.words(1, 3)}</h3><p>{w.words(3, 45)}</p></div>'
        + w.maybe(f'<div class="cookie-notice">{w.words(4, 30)} {w.link()}</div>') + f'<div class="site-footer">{w.words(1, 12)}</div>'
    )


def no_marks(w: Writer) -> str:
    """Nothing but paragraphs or divisions: menus are linked; slogans and small print stand next to links."""
    tag = w.chance.choice(["p", "div"])
    return (
        w.links(tag, 1, 4) + w.maybe(f"<{tag}>{w.short()}</{tag}>{w.links(tag, 1, 3)}") + f"<h1>+{w.words(2, 7)}</h1><{tag}>+{w.long()}</{tag}>{w.body(tag)}<{tag}>+{w.long()}</{tag}>" + w.maybe(f"<{tag}>+{w.short()}</{tag}>")
        + w.maybe(f"<h3>{w.words(1, 3)}</h3>") + w.links(tag, 2, 5) + w.maybe(f"<{tag}>{w.short()}</{tag}>", 0.7)
    )


def table_layout(w: Writer) -> str:
    return (
        f'<table><tr><td><p>{w.link()}</p><p>{w.link()}</p><p>{w.short()}</p><p>{w.link()}</p></td><td><h1>+{w.words(2, 7)}</h1><p>+{w.long()}</p>{w.body()}<p>+{w.long()}</p></td></tr>'
        f'<tr><td><p>{w.link()} | {w.link()}</p><p>{w.short()}</p></td></tr></table>'
    )


def form_around_page(w: Writer) -> str:
    inner = f"<h1>+{w.words(2, 7)}</h1>{w.body()}<p>+{w.long()}</p><p>+{w.long()}</p>"
    return f'<form id="{w.chance.choice(["aspnetForm", "form1"])}"><div>{w.links("p", 1, 4)}</div>' + (f"<article>{inner}</article>" if w.chance.random() < 0.4 else f"<div>{inner}</div>") + "</form>"


def named_wrapper(w: Writer) -> str:
    inner = f"<h1>+{w.words(2, 7)}</h1>{w.body()}<p>+{w.long()}</p><p>+{w.long()}</p>"
    name = w.chance.choice(["layout sidebar-right", "main-wrapper with-nav", "page has-sidebar", "with-footer", "no-comments"])
    side = f'<div class="sidebar"><p>{w.words(2, 20)}</p></div>'
    return f'<nav>{w.links("p", 1, 3)}</nav><div class="{name}">' + (f"<article>{inner}</article>{side}" if w.chance.random() < 0.6 else f"<div>{inner}</div>") + "</div>"


def subjects_like_places(w: Writer) -> str:
    name = w.chance.choice(["share-price", "search-and-rescue", "response", "related-work", "discussion", "register-entry", "notice", "search"])
    kind = w.chance.choice(["p", "div"])
    return (
        f'<article><div class="post-header"><h1>+{w.words(2, 6)}</h1></div>{w.body()}<{kind} class="{name}">+{w.long() if w.chance.random() < 0.5 else w.short()}</{kind}>'
        f'<section id="{w.chance.choice(["related-work", "discussion", "responses", "search-results"])}"><h2>+{w.words(1, 4)}</h2><p>+{w.long()}</p><ul><li>+{w.short()}</li></ul></section>'
        + w.maybe(f'<section id="related"><h2>Related articles</h2><p>{w.words(5, 20)}</p></section>') + w.maybe(f'<div class="share">{w.links("span")}</div>')
        + w.chance.choice([f"<p>+{w.short()}</p>", f'<p class="{w.chance.choice(["response", "notice", "search-term", "share-price"])}">+{w.short()}</p>']) + "</article>"
    )


def asides_in_article(w: Writer) -> str:
    return (
        f'<article><nav>{w.link()}</nav><header><h1>+{w.words(2, 7)}</h1></header>{w.body()}<div class="advertisement">{w.words(2, 25)}</div><p>+{w.long()}</p><p>+{w.short()}</p><form><p>{w.words(2, 14)}</p></form>'
        f'<div class="{w.chance.choice(["sidebar", "newsletter", "related-posts", "comments"])}"><p>{w.words(3, 25)}</p></div>' + w.maybe(f"<div>{w.teaser()}{w.teaser()}{w.teaser()}</div>")
        + f"<p>+{w.short()}</p><footer>{w.words(1, 8)}</footer></article>" + w.maybe(f"<p>{w.words(2, 9)}</p>")
    )


def links_in_article(w: Writer) -> str:
    """Short main text next to links of all kinds, inside the article and around it."""
    teasers = f'<div class="{w.chance.choice(["more", "list", "cards"])}">{w.teaser()}{w.teaser()}</div>'
    return (
        f'<article>{w.maybe(f"<nav>{w.links('p', 1, 3)}</nav>")}<h1>+{w.words(1, 6)}</h1><p>+{w.short()}</p>' + w.maybe(f'<div class="share">{w.links("p")}</div>') + f"<p>+{w.short()}</p>{w.body(low=0, high=3)}<p>+{w.short()}</p>"
        + w.chance.choice([teasers, f"<ul>{w.links('li', 3, 6)}</ul>", f"<footer>{w.link()}</footer>"]) + w.maybe(f"<p>+{w.short()}</p>") + f"</article><div>{w.links('p', 1, 4)}</div>" + w.maybe(f"<p>{w.words(2, 40)}</p>")
    )


def plain_blocks(w: Writer) -> str:
    """One or a few blocks without anything around them, long or short."""
    return "".join(f"<div>+{w.long() if w.chance.random() < 0.5 else w.short()}</div>" for _ in range(w.chance.randint(1, 4)))


def verses(w: Writer) -> str:
    return f"<h1>+{w.words(1, 4)}</h1>" + "".join(f"<p>+{w.words(2, 8)}</p>" for _ in range(w.chance.randint(4, 12)))


def teasers_around(w: Writer) -> str:
    """Linked blocks are teasers wherever they stand; a page without article."""
    return w.teaser() + w.teaser() + f"<h1>+{w.words(3, 8)}</h1><p>+{w.long()}</p>{w.body()}<p>+{w.long()}</p><h2>{w.words(1, 3)}</h2>" + w.teaser() + w.teaser() + w.maybe(f"<p>{w.short()}</p>")


TEMPLATES = (
    plain_article, article_with_comments, marked_divisions, no_marks, table_layout, form_around_page, named_wrapper, subjects_like_places, asides_in_article, links_in_article, plain_blocks, verses, teasers_around,
)


def labelled_pages() -> list[str]:
    """``PAGES`` pages, each template as often as any other."""
    return [TEMPLATES[k % len(TEMPLATES)](Writer(k)) for k in range(PAGES)]
