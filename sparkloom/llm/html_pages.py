"""Labelled pages for training: generated in many layouts, each leaf block with its label."""

from __future__ import annotations

import html
import random

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()
#: Names that sites give to parts of a page; each list is one kind of part.
CONTENT = "article content post entry story main-content article-body post-body entry-content text body page-content post-content articleBody main story-body".split()
BOILER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu site-nav topnav pagination tabs toc".split(),
    "header": "header masthead site-header banner top topbar logo branding page-header".split(),
    "footer": "footer site-footer copyright bottom colophon legal credits imprint".split(),
    "aside": "sidebar aside widget related recommended trending side rail more-stories popular recent tags".split(),
    "notice": "cookie cookies consent notice gdpr alert privacy popup modal overlay notification cookie-banner message warning disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot adbox banner-ad teaser offer".split(),
    "form": "form newsletter subscribe signup search login contact search-box subscription register".split(),
    "comments": "comments comment comment-list reply replies discussion disqus responses user-comments reader-comments comment-body".split(),
    "social": "share social sharing follow like-buttons".split(),
}
#: Names that say nothing of what a part is.
PLAIN = "col row box inner outer left right wide block module item x1 c2 grid panel cell layer".split()
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class PageWriter:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []  # text of a block, 1 for content
        self.plain = self.r.random() < 0.3  # elements without meaning, names that say nothing

    def sentence(self, least: int, most: int) -> str:
        words = [self.r.choice(WORDS) for _ in range(self.r.randint(least, most))]
        end = self.r.choice([".", ".", ".", "", "!", "?"])
        return " ".join(words).capitalize() + end

    def leaf(self, tag: str, text: str, label: int, link: float = 0.0) -> None:
        shown = html.escape(text)
        if self.r.random() < link:
            shown = f'<a href="/{self.r.choice(WORDS)}">{shown}</a>'
        elif self.r.random() < 0.15:
            shown = f"<{self.r.choice(['b', 'em', 'span'])}>{shown}"
            shown += self.r.choice(["</b>", "</em>", "</span>", ""])
        self.out.append(f"<{tag}>{shown}" + ("" if tag in ("p", "li") and self.r.random() < 0.1 else f"</{tag}>"))
        self.labels.append((text, label))

    def opened(self, tag: str, names: list[str], named: float) -> str:
        attributes = ""
        if self.plain:
            names, named, tag = PLAIN, self.plain_names, tag if tag in ("ul", "table") else "div"
        if self.r.random() < named:
            attributes = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
            if self.r.random() < 0.2:
                attributes += f' data-x="{self.r.choice(WORDS)}"'
        self.out.append(f"<{tag}{attributes}>")
        return tag

    def content(self, tag: str, names: list[str], named: float, nested: list[str]) -> None:
        tag = self.opened(tag, names, named)
        brief = self.r.random() < 0.15  # an article of a few words
        if self.r.random() < 0.8:
            self.leaf("h1", self.sentence(1, 12), 1)
        for _ in range(self.r.choice([self.r.randint(0, 2), self.r.randint(1, 14), self.r.randint(1, 14)])):
            kind = self.r.random()
            if brief:
                self.leaf(self.r.choice(["p", "p", "p", "li"]), self.sentence(1, 9), 1, 0.02)
            elif kind < 0.78:
                self.leaf("p", " ".join(self.sentence(1, 24) for _ in range(self.r.randint(1, 6))), 1, 0.02)
            elif kind < 0.86:
                self.leaf(self.r.choice(["h2", "h3"]), self.sentence(1, 7), 1)
            elif kind < 0.94:
                self.out.append("<ul>")
                for _ in range(self.r.randint(2, 4)):
                    self.leaf("li", self.sentence(2, 12), 1, 0.1)
                self.out.append("</ul>")
            else:
                self.leaf(self.r.choice(["blockquote", "pre", "td", "figcaption"]), self.sentence(3, 20), 1)
            if nested and self.r.random() < 0.12:
                self.boiler(self.r.choice(nested), 1.0)
        self.out.append(f"</{tag}>")

    def boiler(self, kind: str, named: float) -> None:
        semantic = SEMANTIC.get(kind)
        tag = semantic if semantic and self.r.random() < 0.6 else self.r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        tag = self.opened(tag, BOILER[kind], 0.5 if tag == semantic else named)
        linked = kind in ("nav", "aside", "social") or (kind in ("header", "footer") and self.r.random() < 0.5)
        long = self.r.random() < (0.6 if kind in ("comments", "ad", "notice", "aside") else 0.4 if kind in ("footer", "form", "header") else 0.0)
        for _ in range(self.r.randint(1, 6 if kind in ("nav", "comments", "aside") else 3)):
            text = " ".join(self.sentence(1, 20) for _ in range(self.r.randint(1, 4))) if long else self.sentence(1, 8 if not linked else 3)
            if kind == "footer" and self.r.random() < 0.6:
                text = "© " + text
            child = "li" if linked and self.r.random() < 0.7 else self.r.choice(["p", "div", "p", "span"])
            if kind == "form":
                child = self.r.choice(["label", "button", "p", "div", "option"])
            self.leaf(child, text, 0, 0.9 if linked else 0.1)
            if child in ("span", "label", "button", "option"):
                self.out.append("<hr>")
        self.out.append(f"</{tag}>")

    def page(self) -> str:
        named = self.r.choice([1.0, 1.0, 0.9, 0.6])
        self.plain_names = self.r.choice([0.0, 0.0, 0.5, 1.0])
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        for kind in ("notice", "header", "nav", "ad"):
            if self.r.random() < 0.55:
                self.boiler(kind, named)
        tag = self.r.choice(["article", "article", "main", "div", "div", "section"])
        wrapped = self.r.random() < 0.4
        if wrapped:
            self.opened("div", ["wrapper", "container", "page", "layout", "row", "site"], 0.8)
        if self.r.random() < 0.25:
            self.boiler("aside", named)
        nested = ["ad", "social", "aside", "form", "comments", "notice", "nav", "footer", "header"] if self.r.random() < 0.6 else []
        self.content(tag, CONTENT, 0.3 if tag in ("article", "main") else 0.9, nested)
        for kind in ("comments", "aside", "form", "social"):
            if self.r.random() < 0.4:
                self.boiler(kind, named)
        if wrapped:
            self.out.append("</div>")
        for kind in ("ad", "notice", "footer"):
            if self.r.random() < 0.5:
                self.boiler(kind, named)
        self.out.append("</body></html>")
        return "".join(self.out)


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """A page and its leaf blocks (text, label) in page order."""
    writer = PageWriter(seed)
    return writer.page(), writer.labels
