"""Labelled training pages for the extractor: varied layouts whose main text is known by construction."""

from __future__ import annotations

import random

# Usual names of page parts in class and id attributes.
MAIN = "content main post article story entry body text post-content entry-content article-body story-body main-content page-content".split()
PARTS = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs tabs toc mainmenu nav-links".split(),
    "header": "header site-header masthead banner topbar logo branding tagline page-header".split(),
    "sidebar": "sidebar aside widget related recommended popular trending more-stories rail widgets sidebar-right secondary".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsored promo promotion ad-slot banner-ad google-ads sponsor".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal newsletter subscribe paywall overlay message warning".split(),
    "share": "share social sharing follow social-links tags meta byline author-bio".split(),
    "comments": "comments comment comment-list discussion replies reply respond disqus user-comments reader-comments responses".split(),
    "footer": "footer site-footer copyright legal colophon bottom page-footer".split(),
}
SYLLABLES = "an the er re on ti es ed in or ea le ou de la en ment ung sch keit os ar ción ue ra do éa è ö ü ñ st nd".split()
FOLLOWED = ("", "", "", ",", ".")


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.texts = rng, [], []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + r.choice(FOLLOWED))
        text = " ".join(out).strip(",.") or "a"
        text = text[0].upper() + text[1:]
        return text + ("." if r.random() < 0.75 else "")

    def add(self, *html: str) -> None:
        self.html += html

    def main(self, tag: str, low: int, high: int, inner: str = "") -> None:
        text = self.words(low, high)
        self.texts.append(text)
        r = self.rng.random()
        if r < 0.15:
            first, _, rest = text.partition(" ")
            self.add(f"<{tag}{inner}><b>{first}</b> {rest}</{tag}>")
        elif r < 0.25 and tag == "p":
            self.add(f"<p><b>{text}<br>")
        elif r < 0.35 and " " in text:
            first, _, rest = text.partition(" ")
            self.add(f'<{tag}{inner}><a href="/x">{first}</a> {rest}</{tag}>')
        else:
            self.add(f"<{tag}{inner}>{text}</{tag}>" if tag != "p" or r < 0.95 else f"<p>{text}")

    def paragraphs(self, n: int) -> None:
        for i in range(n):
            r = self.rng.random()
            if r < 0.08:
                self.main("h2", 1, 7)
            elif r < 0.12:
                self.add("<ul>")
                for _ in range(self.rng.randint(1, 4)):
                    self.main("li", 1, 14)
                self.add("</ul>")
            elif r < 0.15:
                self.add("<blockquote>")
                self.main("p", 2, 30)
                self.add("</blockquote>")
            elif r < 0.17:
                self.add("<table><tr>")
                self.main("td", 1, 6)
                self.main("td", 1, 6)
                self.add("</tr></table>")
            else:
                self.main("p", 1, self.rng.choice((3, 12, 40, 90)))
            if i and self.rng.random() < 0.05:
                self.part(self.rng.choice(("ad", "share", "notice")))

    def links(self, n: int) -> None:
        self.add("<ul>" if self.rng.random() < 0.7 else "<div>")
        closer = "</ul>" if self.html[-1] == "<ul>" else "</div>"
        for _ in range(n):
            link = f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>'
            self.add(f"<li>{link}</li>" if closer == "</ul>" else link + " ")
        self.add(closer)

    def part(self, kind: str) -> None:
        r = self.rng
        name = r.choice(PARTS[kind])
        plain = {"menu": "nav", "header": "header", "sidebar": "aside", "footer": "footer", "comments": "section"}.get(kind, "div")
        tag = plain if r.random() < 0.6 else "div"
        mark = f' {r.choice(("class", "class", "id"))}="{name}"' if tag == "div" or tag == "section" or r.random() < 0.4 else ""
        self.add(f"<{tag}{mark}>")
        if kind == "menu":
            self.links(r.randint(3, 8))
        elif kind == "header":
            self.add(r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", f"<p>{self.words(1, 9)}</p>")))
            if r.random() < 0.5:
                self.links(r.randint(2, 5))
        elif kind in ("ad", "notice"):
            text = self.words(1, r.choice((6, 25, 60)))
            self.add(r.choice((text, f"<p>{text}</p>", f"<span>{text}</span>")))
            if r.random() < 0.3:
                self.add(f'<form><label>{self.words(1, 3)}</label><input name="e"><button>{self.words(1, 2)}</button></form>')
        elif kind == "comments":
            self.add(f"<h3>{self.words(1, 3)}</h3>")
            for _ in range(r.randint(1, 4)):
                inner = r.choice(("div", "li", "article", "p"))
                self.add(f'<{inner} class="{r.choice(PARTS["comments"])}">', self.words(1, 2), f"<p>{self.words(1, 40)}</p>", f"</{inner}>")
            if r.random() < 0.4:
                self.add(f"<form><p>{self.words(1, 5)}</p><textarea></textarea><button>{self.words(1, 2)}</button></form>")
        elif kind == "footer":
            self.add(r.choice((f"&copy; {self.words(1, 8)}", f"<p>{self.words(1, 30)}</p>", f"&copy; x &middot; {self.words(2, 12)}")))
            if r.random() < 0.4:
                self.links(r.randint(2, 6))
        elif kind == "sidebar":
            self.add(f"<h3>{self.words(1, 4)}</h3>")
            self.links(r.randint(2, 6)) if r.random() < 0.6 else self.add(f"<p>{self.words(2, 40)}</p>")
        else:
            self.add(f"<p>{self.words(1, 8)}</p>") if r.random() < 0.5 else self.links(r.randint(2, 4))
        self.add(f"</{tag}>")


def _bare_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page whose article no element names: text in plain ``div`` or other elements, at any depth, with forms and comments that stand alone."""
    w = _Writer(rng)
    if rng.random() < 0.5:
        w.add(f"<html><head><title>{w.words(2, 9)}</title></head><body>")
    for kind, chance in (("header", 0.2), ("menu", 0.4), ("notice", 0.2), ("ad", 0.15)):
        if rng.random() < chance:
            w.part(kind)
    depth = rng.choice((0, 0, 1, 2, 5, 12, 30))
    w.add("<div>" * depth)
    if rng.random() < 0.4:
        w.main(rng.choice(("h1", "h2", "div")), 2, 9)
    for _ in range(rng.choice((1, 1, 2, 3, 6))):
        w.main(rng.choice(("div", "div", "p", "p", "section", "td")), *rng.choice(((3, 14), (8, 40), (20, 90))))
        r = rng.random()
        if r < 0.12:
            w.add(f"<form><p>{w.words(1, 5)}</p><input><button>{w.words(1, 2)}</button></form>")
        elif r < 0.2:
            w.part(rng.choice(("ad", "share", "notice")))
    for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
        inner = rng.choice(("div", "p", "li", "section"))
        w.add(f'<{inner} {rng.choice(("class", "id"))}="{rng.choice(PARTS["comments"])}">{w.words(1, rng.choice((4, 20, 50)))}</{inner}>')
    w.add("</div>" * (depth if rng.random() < 0.8 else 0))
    if rng.random() < 0.4:
        w.part("footer")
    return "".join(w.html), w.texts


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks in page order."""
    if rng.random() < 0.3:
        return _bare_page(rng)
    w = _Writer(rng)
    title = w.words(2, 9)
    w.add("<!DOCTYPE html><html><head><title>", title, "</title><style>p{}</style></head><body>")
    if rng.random() < 0.15:
        w.add(f"<noscript>{w.words(1, 12)}</noscript>")
    for kind, chance in (("notice", 0.25), ("header", 0.5), ("menu", 0.7), ("ad", 0.4), ("sidebar", 0.2)):
        if rng.random() < chance:
            w.part(kind)
    if rng.random() < 0.15:
        w.add(f'<form action="/s"><input><button>{w.words(1, 2)}</button></form>')
    shape = rng.random()
    outer = inner = ""
    if shape < 0.40:
        outer = "article"
    elif shape < 0.55:
        outer, inner = "main", "article"
    elif shape < 0.68:
        outer = "main"
    elif shape < 0.93:
        outer = "div"
    for tag in (outer, inner):
        if tag:
            mark = f' {rng.choice(("class", "id"))}="{rng.choice(MAIN)}"' if tag == "div" or rng.random() < 0.3 else ""
            w.add(f"<{tag}{mark}>")
    if rng.random() < 0.85:
        w.texts.append(title)
        w.add(f"<h1>{title}</h1>")
    w.paragraphs(rng.randint(1, 14))
    if rng.random() < 0.2:
        w.part("share")
    if rng.random() < 0.1:
        w.part("comments")
    for tag in (inner, outer):
        if tag:
            w.add(f"</{tag}>")
    for kind, chance in (("ad", 0.15), ("sidebar", 0.35), ("comments", 0.35), ("notice", 0.15), ("footer", 0.75)):
        if rng.random() < chance:
            w.part(kind)
    if rng.random() < 0.9:
        w.add("</body></html>")
    return "".join(w.html), w.texts
