"""HTML pages as trees of block elements with their texts, read in one pass without backtracking.

Tags are read as browsers read them: a quote opens a value only behind an equals sign, a tag that never ends takes the rest of the page, the content of
scripts and the like is no markup. Every step costs the same however deep elements are nested and however many are never closed, so time grows with the
length of a page. Inline elements are no part of the tree; they only tell which characters are links and which are hidden.

What a page shows besides its article is left out: by tag, role or attribute at once, by words of class and id at the end, when an element's content is
known. Such a word counts as the head of its name only (`cookie-notice` is a notice, `share-price` is none). An element marked like a menu stays in an article
if less than half of it is links (a recipe's menu), and one that holds an article or main and most of the page is its layout, whatever it is called.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Fixed by the HTML standard: elements without content, with content that is no markup, and those that flow inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Inline elements whose content is no text of the page, and block elements that are left out.
UNREAD = frozenset("button select datalist canvas svg object audio video meter progress".split())
LEFT_OUT = frozenset("nav header footer aside form template dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that may stand in a head, and open elements that a start tag ends.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("tr", "td", "th"))
_PARTS = _ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": _ROWS | {"caption", "colgroup"}, "td": _CELLS, "th": _CELLS, "option": {"option"}, "optgroup": {"option", "optgroup"}}
ENDS |= {n: _PARTS for n in ("thead", "tbody", "tfoot")} | {n: _HEADINGS for n in _HEADINGS}
#: Elements that an end tag does not reach across.
LIMITS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",)} | {n: ("table",) for n in _PARTS}
OTHER_LIMITS = ("td", "th", "caption")
MAIN = ("article", "main")
#: Heads of names that mark what is no part of an article; of articles themselves; and those that need links to do so within an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond "
    "replies reply cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search skip copyright".split()
)
LINK_MARKS = frozenset("menu nav navbar navigation social share sharing related recommended recommendations responses rail widget toolbar pagination pager".split())
ARTICLE_MARKS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related recommended".split())
#: Those that also mark a part of a line.
INLINE_MARKS = frozenset("ad ads advert advertisement sponsored".split())
#: Words that may follow the head of a name, and first words by which a name speaks of something else.
TAILS = frozenset(
    "list lists box boxes wrapper wrap container section area block left right top bottom link links slot unit item items inner outer bar panel form widget content contents body text holder "
    "group region zone module row col column header title icon button buttons message policy info sticky fixed placeholder thread feed count meta author date card wide narrow large small".split()
)
ABOUT = frozenset("has with without no is not js can".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def heads(names: str) -> set[str]:
    """The head of each of the names: its last word before words of mere arrangement."""
    out = set()
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        while len(parts) > 1 and parts[-1] in TAILS:
            parts.pop()
        if parts and parts[0] not in ABOUT:
            out.add(parts[-1])
    return out


def label(name: str, attrs: dict[str, str]) -> str:
    """An element's name with its classes and id, as far as these have no digits (numbered ones name a page, not a place)."""
    if attrs.get("role", "").lower() == "main":
        name = "main"
    if "-" in name:
        name = "x-"
    own = [x for x in sorted(set(attrs.get("class", "").split())) if not re.search(r"[0-9\[\]\"]", x)]
    mark = attrs.get("id", "")
    return name + "".join("." + x for x in own) + ("#" + mark if mark and not re.search(r"[0-9\s\[\]\"]", mark) else "")


class Page:
    """Elements in page order, parents first: label, parent, kids (elements, or -1-k for block k), gone; blocks: text and element."""

    def __init__(self, source: str):
        self.label, self.parent, self.kids, self.mark = [""], [-1], [[]], [0]
        self.blocks: list[tuple[str, int]] = []
        self.linked: list[int] = []
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        names: list[str] = []  # open elements, and for each its place in the tree and whether it is left out
        places: list[tuple[int, bool]] = []
        where: dict[str, list[int]] = defaultdict(list)
        text: list[str] = []
        node, out, linked = 0, False, 0
        link = unread = None  # height of the stack at an open link; name, depth and height of an unread inline element

        def flush():
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                text.clear()
                if joined:
                    self.blocks.append((joined, node))
                    self.linked.append(min(linked, len(joined)))
                    self.kids[node].append(-len(self.blocks))
                linked = 0

        def close(height: int):
            nonlocal node, out, link, unread
            while len(names) > height:
                where[names.pop()].pop()
                places.pop()
            node, out = places[-1] if places else (0, False)
            if link is not None and height < link:
                link = None
            if unread and height < unread[2]:
                unread = None

        at, size = 0, len(source)
        while at < size:
            stop = source.find("<", at)
            piece = source[at : stop if stop >= 0 else size]
            mark = source[stop + 1 : stop + 3] if stop >= 0 else ""
            tag = stop >= 0 and (mark[:1].isascii() and mark[:1].isalpha() or mark[:1] == "/" and mark[1:].isascii() and mark[1:].isalpha())
            if not tag and stop >= 0 and mark[:1] not in ("!", "?", "/"):
                piece += "<"
            if piece:
                if names and names[-1] == "head" and piece.strip():
                    close(len(names) - 1)
                if not out and unread is None:
                    piece = html.unescape(piece)
                    text.append(piece)
                    linked += len(piece) if link is not None else 0
            if stop < 0:
                break
            at = stop + 1
            if not tag:
                if mark[:1] in ("!", "?", "/"):  # comment or declaration
                    end = source.find("-->", stop + 4) if source.startswith("<!--", stop) else source.find(">", stop)
                    if source.startswith(("<!-->", "<!--->"), stop):
                        end = source.find(">", stop) - 2
                    at = size if end < 0 else end + (3 if source.startswith("<!--", stop) else 1)
                continue
            found = _TAG.match(source, stop)
            if not found:
                break  # a tag without an end
            at, name = found.end(), found[1].lower()
            if mark[0] == "/":
                if name == "a":
                    link = None
                if unread and name == unread[0]:
                    unread = (name, unread[1] - 1, unread[2])
                    if not unread[1]:
                        height, unread = unread[2], None
                        close(height)
                if name in VOID or name in RAW or name in INLINE or name in UNREAD or name in ("html", "body"):
                    continue
                if name == "p":
                    flush()
                    if names and names[-1] == "p":
                        close(len(names) - 1)
                elif where[name] and where[name][-1] >= max((where[x][-1] for x in LIMITS.get(name, OTHER_LIMITS) if where[x]), default=-1):
                    flush()
                    close(where[name][-1])
                continue
            if names and names[-1] == "head" and name not in IN_HEAD:
                close(len(names) - 1)
            if name in RAW:
                end = _RAW_ENDS[name].search(source, at)
                at = end.start() if end else size
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            if unread and name == unread[0]:
                unread = (name, unread[1] + 1, unread[2])
                continue
            if name == "a" and link is None:
                link = len(names)
            attrs = {}
            if len(found[2]) > 2:
                for k, a, b, c in _ATTR.findall(found[2]):
                    attrs.setdefault(k.lower(), a or b or c)
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
            if name in INLINE or name in UNREAD:
                inline = name in INLINE and "class" in attrs and not INLINE_MARKS.isdisjoint(heads(attrs["class"]))
                if unread is None and (hidden or name in UNREAD or inline):
                    unread = (name, 1, len(names))
                continue
            flush()
            if names and names[-1] == "p":
                close(len(names) - 1)
            ends = ENDS.get(name, ())
            while names and (names[-1] in ends or (ends and names[-1] == "p")):
                close(len(names) - 1)
            if name in ("html", "body"):
                continue
            out = out or unread is not None or hidden or name in LEFT_OUT or attrs.get("role", "").lower() in ROLES
            if not out:
                self.label.append(label(name, attrs))
                self.parent.append(node)
                self.kids.append([])
                self.kids[node].append(len(self.label) - 1)
                self.mark.append(self._marked(name, attrs))
                node = len(self.label) - 1
            where[name].append(len(names))
            names.append(name)
            places.append((node, out))
        flush()

    @staticmethod
    def _marked(name: str, attrs: dict[str, str]) -> int:
        """1 for a mark of what is left out, 2 for one that depends on links."""
        if name == "main" or not (attrs.get("class") or attrs.get("id")):
            return 0
        own = heads(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        if name == "article":
            return int(not ARTICLE_MARKS.isdisjoint(own))
        return 1 if not MARKS.isdisjoint(own) else 2 if not LINK_MARKS.isdisjoint(own) else 0

    def _judge(self) -> None:
        n = len(self.label)
        chars, linked, holds = [0] * n, [0] * n, [False] * n
        for (text, at), k in zip(self.blocks, self.linked):
            chars[at] += len(text)
            linked[at] += k
        main = [x.split(".")[0].split("#")[0] in MAIN and not m for x, m in zip(self.label, self.mark)]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            holds[up] = holds[up] or holds[i] or main[i]
        self.gone, inside = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[up] or main[i]
            layout = holds[i] and 2 * chars[i] > chars[0]
            prose = self.mark[i] == 2 and inside[up] and 2 * linked[i] < chars[i]
            self.gone[i] = self.gone[up] or (self.mark[i] > 0 and not layout and not prose)

    def text(self, regions: set[int]) -> str:
        """Blocks of the regions, without what is left out, in page order."""
        inside = [False] * len(self.label)
        for i, up in enumerate(self.parent):
            inside[i] = i in regions or (up >= 0 and inside[up])
        return "\n".join(t for t, at in self.blocks if inside[at] and not self.gone[at])
