"""Leaf text blocks of raw HTML pages, and what describes them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

# Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template svg iframe textarea".split())
#: A drawing left open ends where one of these starts, as in browsers.
ENDS_SVG = BLOCK_TAGS - {"title"} | {"br"}
#: A start tag of the first kind ends an open element of the second kind that is not closed.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"},
}
_KEEPS_P = frozenset("button option select legend".split())
_HOLDERS = frozenset("article main aside nav header footer form section".split())
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Place:
    """An open element: what holds for all text inside it, shared with the element around it where it adds nothing.

    ``names`` are the features of the ancestors together; only those in ``known`` are kept where that is given, so a page's places hold no more
    than its elements and the known names, however deep it is.
    """

    __slots__ = ("tag", "names", "near", "marked", "held")

    def __init__(self, around: "Place | None", tag: str, marks: list[str], known) -> None:
        self.tag = tag
        own = {f"tag:{tag}", *(f"word:{m}" for m in marks)} if around else set()
        if known is not None:
            own &= known
        had = around.names if around else frozenset()
        self.names = had if own <= had else had | own
        self.near = [f"near:{m}" for m in marks] if marks else around.near if around else []
        self.marked = tag if marks else around.marked if around else ""
        self.held = tag if tag in _HOLDERS else around.held if around else ""


@dataclass(slots=True)
class Block:
    text: str
    place: Place
    linked: int


class _Blocks(HTMLParser):
    """Cuts a page into runs of text that no block-level tag interrupts.

    Errors are taken as browsers take them, roughly: a block start ends an open paragraph, an end
    tag without a start is ignored, one that skips open elements closes them, inline elements left
    open do not matter, and the end of a page that breaks off closes everything. Only scripts, styles, templates,
    drawings, frames and form fields are silent; formulas and what stands in for media are text like any other.
    """

    def __init__(self, known=None):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.known = known
        self.places: list[Place] = [Place(None, "", [], known)]
        self.n_open: dict[str, int] = {}
        self.parts: list[str] = []
        self.silent: list[str] = []
        self.links = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.places[-1], min(self.linked, len(text))))
            self.parts = []
        self.linked = 0

    def close(self) -> str:
        """Closes the innermost element and gives its tag."""
        tag = self.places.pop().tag
        self.n_open[tag] -= 1
        return tag

    def finish(self) -> list[Block]:
        super().close()
        self.flush()
        return self.blocks

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and self.silent[0] == "svg" and tag in ENDS_SVG:
            self.silent.clear()
        if self.silent:
            if tag == self.silent[0]:
                self.silent.append(tag)
            return
        if tag in SILENT_TAGS:
            self.silent.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        self.links = 0
        ends = CLOSES.get(tag, () if tag in _KEEPS_P else {"p"})
        while self.places[-1].tag in ends:
            self.close()
        if tag in VOID_TAGS:
            return
        marks: list[str] = []
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "aria-label"):
                marks += _TOKEN.findall(_CAMEL.sub(" ", value).lower())
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", ""):
                marks.append("hidden")
        self.places.append(Place(self.places[-1], tag, marks, self.known))
        self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in SILENT_TAGS:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent and self.silent[0] == "svg" and self.n_open.get(tag):
            self.silent.clear()
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "a":
            self.links = 0
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        self.links = 0
        if self.n_open.get(tag):
            while self.close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str, known=None) -> list[Block]:
    """The blocks of a page in page order; white space inside a block is one blank. ``known`` names bound what places hold."""
    parser = _Blocks(known)
    parser.feed(html)
    return parser.finish()


def _step(value: float, *limits: float) -> int:
    return sum(value >= limit for limit in limits)


def describe(blocks: list[Block]) -> list[set[str]]:
    """Names of what holds for each block of a page: its ancestors' tags, their class and id words, its text, and its share of the page's text."""
    whole = sum(len(b.text) for b in blocks) or 1
    out = []
    for block in blocks:
        place = block.place
        names = {*place.names, *place.near, f"parent:{place.tag}", f"held:{place.held}"}
        if place.marked:
            names.add(f"marked:{place.marked}")
        words, share = block.text.count(" ") + 1, block.linked / len(block.text)
        length, full = _step(words, 2, 4, 10, 30), block.text[-1] in ".!?…。"
        names |= {f"words:{length}", f"links:{_step(share, 1e-9, 0.3, 0.8)}", f"stop:{full}", f"prose:{length}:{full}:{bool(place.near)}",
                  f"share:{_step(len(block.text) / whole, 0.02, 0.1, 0.4)}"}
        if "©" in block.text:
            names.add("copyright")
        out.append(names)
    return out
