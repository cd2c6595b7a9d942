"""A tolerant page tree: elements, text in page order, and features of every element."""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np

# Fixed values of the page format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var".split()
)
# Elements whose text no reader sees, or that are controls of a form; forms themselves are scored.
UNSEEN = frozenset(
    "head title script style template noscript iframe object svg annotation annotation-xml canvas audio video select "
    "option button textarea datalist dialog".split()
)
# Those of them that may be left open inside an article; the text behind such a one is the article's.
CONTROLS = frozenset("iframe object svg canvas audio video select option button textarea datalist dialog".split())
# What may stand in a head; any other element, and text, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
# A start tag of the first set closes an open element of the second, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
MAIN_TAGS, BODY_TAGS = frozenset({"article", "main"}), frozenset({"p", "blockquote", "pre", "figcaption"})
SIDE_TAGS = frozenset({"nav", "header", "footer", "aside", "menu", "form"})
HEADING = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
MAIN_TOKENS = frozenset("article main content post entry story body text prose page single blog".split())
SIDE_TOKENS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer foot copyright legal sidebar side aside rail widget related recommended more share social "
    "comment comments reply replies discussion disqus respond notice cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login search form tags meta byline pagination pager toolbar skip".split()
)
FEATURES = (
    "main tag", "side tag", "heading", "paragraph", "list", "container", "depth", "main tokens", "side tokens", "has tokens",
    "chars", "words", "link share", "children", "text density", "place", "siblings", "share of page", "words a block",
    "stops", "parent main", "parent side", "above main", "above side", "next chars", "previous chars", "page place",
)


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "marks", "chars", "words", "linked", "stops", "blocks", "tags", "order", "first", "place")

    def __init__(self, tag: str, parent: "Node | None", marks: tuple, order: int):
        self.tag, self.parent, self.marks, self.order = tag, parent, marks, order
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.chars = self.words = self.linked = self.stops = self.blocks = self.tags = self.first = 0
        self.place = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>=]+|=[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}
_LONG_NUMBER = re.compile(r"&#[0-9]{9,};?")


def decoded(text: str) -> str:
    """Text with character references replaced; a number beyond all characters gives U+FFFD."""
    return unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


class Markup:
    """Calls the handlers for tags and text of a page in one pass over it; no text is an error.

    Comments, declarations, marked sections and processing instructions are skipped; one that never
    ends takes the rest of the page, as does a tag that never ends or an open script. A quote that
    never ends is part of a bare value.
    """

    def read(self, html: str) -> None:
        n, at = len(html), 0
        self.unquoted: set[str] = set()  # quotes that the rest of the page lacks
        while at < n:
            left = html.find("<", at)
            left = n if left < 0 else left
            if left > at:
                self.handle_data(decoded(html[at:left]))
            at = self._tag(html, left) if left < n else n

    def _past(self, html: str, mark: str, at: int) -> int:
        end = html.find(mark, at)
        return len(html) if end < 0 else end + len(mark)

    def _tag(self, html: str, at: int) -> int:
        """Read what begins with the ``<`` at ``at``; where the text goes on."""
        after = html[at + 1 : at + 2]
        if after == "!" and html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at) + 1
            end = _COMMENT_END.search(html, at + 4)
            return end.end() if end else len(html)
        if after == "!" or after == "?":
            return self._past(html, ">", at)
        if after == "/":
            name = _NAME.match(html, at + 2)
            end = self._past(html, ">", at + 2)
            if name and html[end - 1] == ">":
                self.handle_endtag(name[0].lower())
            return end
        name = _NAME.match(html, at + 1)
        if not name:
            self.handle_data("<")
            return at + 1
        tag, attributes, at = name[0].lower(), [], name.end()
        while True:
            at = _GAP.match(html, at).end()
            if at >= len(html):
                return at
            if html[at] == ">":
                break
            found = _ATTRIBUTE.match(html, at)
            at, value = found.end(), None
            if found[2]:
                quote = html[at : at + 1]
                end = -1
                if quote and quote in "\"'" and quote not in self.unquoted:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        self.unquoted.add(quote)
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    value = _BARE.match(html, at)[0]
                    at += len(value)
            attributes.append((found[1].lower(), None if value is None else decoded(value)))
        if html[at - 1] == "/":
            self.handle_startendtag(tag, attributes)
        else:
            self.handle_starttag(tag, attributes)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                self.handle_data(html[at + 1 : end.start() if end else len(html)])
                return end.start() if end else len(html)
        return at + 1


class Page(Markup):
    """Block elements as nodes; ``pieces`` are (node, text, is linked) in page order.

    The places of open elements are kept by tag, so a tag costs the same at any depth.
    """

    def __init__(self, html: str):
        self.root = Node("html", None, (), 0)
        self.nodes, self.pieces = [self.root], []
        self.open: list[tuple[str, Node | None, int]] = []  # inline elements have no node; first piece of each
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of the open elements with a node
        self.at, self.unseen, self.links = self.root, 0, 0
        self.hidden: list[tuple[int, int]] = []  # runs of pieces in closed controls
        self.begun = False  # whether the body has
        self.read(html)
        if self.hidden:
            gone = set()
            for first, end in self.hidden:
                gone.update(range(first, end))
            self.pieces = [(node, " " if i in gone else text, linked) for i, (node, text, linked) in enumerate(self.pieces)]

    def _pop(self, ended: bool = False) -> None:
        tag, node, first = self.open.pop()
        self.places[tag].pop()
        if tag in CONTROLS:
            # text in a control that its own end tag closes is no text; one left open was no control of what follows
            if ended and first < len(self.pieces):
                while self.hidden and self.hidden[-1][0] >= first:
                    self.hidden.pop()
                self.hidden.append((first, len(self.pieces)))
        elif tag in UNSEEN:
            self.unseen -= 1
        if tag == "a":
            self.links -= 1
        if node is not None:
            self.blocks.pop()
            self.at = node.parent

    def _last(self, names) -> int:
        """Place of the innermost open element of these names, -1 without one."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def _close_to(self, names, stop) -> None:
        at = self._last(names)
        if at > self._last(stop):
            while len(self.open) > at:
                self._pop()

    def _leave_head(self) -> None:
        """Close an open head that nothing else is open in."""
        if self.open and self.open[-1][0] == "head":
            self._pop()
            self.begun = True

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._leave_head()
        if tag == "body" and not self.begun:
            self._close_to({"head"}, ())
            self.begun = True
        if tag == "head" and (self.begun or self.open):
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((self.at, " ", False))
            return
        if tag not in INLINE:
            self._close_to({"p"}, {"table", "button", "object", "article", "section", "div", "body"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        node = None
        if tag in ("html", "body"):
            return
        if tag in UNSEEN and tag not in CONTROLS:
            self.unseen += 1
        if tag == "a":
            self._close_to({"a"}, {"table", "td"})
            self.links += 1
        first = len(self.pieces)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            words = [v for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v]
            marks = tuple(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(words)).lower())) if words else ()
            if any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs):
                marks += ("hidden",)
            node = self.at = Node(tag, self.at, marks, len(self.nodes))
            self.nodes.append(node)
            self.blocks.append(len(self.open))
            self.pieces.append((node, " ", False))
        self.open.append((tag, node, first))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag == "svg" or tag in MATH):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        at = self._last((tag,))
        # an inline end tag does not close blocks around it
        if at < 0 or (tag in INLINE and tag != "math" and self.blocks and self.blocks[-1] > at):
            return
        while len(self.open) > at:
            self._pop(len(self.open) == at + 1)
        if tag not in INLINE:
            self.pieces.append((self.at, " ", False))

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        if not self.unseen:
            self.pieces.append((self.at, data, self.links > 0))

    def side(self, node: Node) -> bool:
        """Whether the tag names a side part; a form that holds most text of a measured page frames it."""
        return node.tag in SIDE_TAGS and not (node.tag == "form" and 2 * node.chars > self.root.chars)

    def measure(self) -> np.ndarray:
        """Feature rows, one per node in page order."""
        for node, text, linked in self.pieces:
            n = len(text.split())
            if not n:
                continue
            node.chars += len(text)
            node.words += n
            node.stops += sum(map(text.count, ".,;!?"))
            node.linked += len(text) if linked else 0
            node.blocks = 1
        ahead = 0
        for node in self.nodes:
            node.first, ahead = ahead, ahead + node.chars
        for node in reversed(self.nodes):
            node.tags += 1
            up = node.parent
            if up:
                up.chars += node.chars
                up.words += node.words
                up.stops += node.stops
                up.linked += node.linked
                up.blocks += node.blocks
                up.tags += node.tags
        total = max(1, self.root.chars)
        rows = np.zeros((len(self.nodes), len(FEATURES)))
        # whether an element above names a main or a side part
        above: list[tuple[int, int]] = []
        sides = [self.side(node) for node in self.nodes]
        for i, node in enumerate(self.nodes):
            up = node.parent
            main, side, marks = node.tag in MAIN_TAGS, sides[i], node.marks
            named = sum(m in MAIN_TOKENS for m in marks) if marks else 0
            bad = side + (sum(m in SIDE_TOKENS or m == "hidden" for m in marks) if marks else 0)
            over = above[up.order] if up else (0, 0)
            above.append((over[0] or main + named > bad, over[1] or bad > 0))
            peers, at = (up.children, node.place) if up else ([node], 0)
            rows[i] = (
                main, side, node.tag in HEADING, node.tag in BODY_TAGS, node.tag in ("ul", "ol", "li", "dl"),
                len(node.children) > 0, node.depth, named, bad, len(marks),
                math.log1p(node.chars), math.log1p(node.words), node.linked / max(1, node.chars), len(node.children),
                node.chars / node.tags, at / max(1, len(peers) - 1), len(peers), node.chars / total, node.words / max(1, node.blocks),
                node.stops / max(1, node.words), (up.tag in MAIN_TAGS) if up else 0, sides[up.order] if up else 0, over[0], over[1],
                math.log1p(peers[at + 1].chars) if at + 1 < len(peers) else 0, math.log1p(peers[at - 1].chars) if at else 0, node.first / total,
            )
        return rows

