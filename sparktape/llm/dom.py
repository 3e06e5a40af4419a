"""Leaf blocks of an HTML page: runs of text between the borders of block elements, with their ancestors.

Reading is forgiving, as in browsers: tags may be left open, paragraphs, list items and table cells end where the next one
begins, end tags without a start are passed over, and text after a broken tag stays text. Every page is read whole and in
one pass; ancestors are kept as shared nodes, so that deep pages cost no more than flat ones.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Elements of HTML by how they are laid out.
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNREAD = frozenset("script style template noscript iframe object svg math canvas textarea select title audio video datalist".split())
#: A start tag ends open elements of the first set, unless one of the second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"form"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SECTIONS = frozenset("article main section aside nav header footer form body menu dialog table".split())
#: Ancestors beyond so many are not told apart; their text is read all the same.
DEEP = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKENS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in UNREAD}


@dataclass(frozen=True, eq=False)
class Path:
    """Ancestors of a block: their tags and name tokens as a set, and the mark of the nearest marked one."""

    keys: frozenset = frozenset()
    own: tuple = ()
    section: str = ""
    mark: str = ""
    depth: int = 0
    memo: dict = field(default_factory=dict)

    def below(self, tag: str, names: tuple[str, ...], mark: str) -> Path:
        """The path of an element in this one."""
        key = tag, names, mark
        if key not in self.memo:
            more = [f"a:{tag}", *(f"c:{n}" for n in names)] if self.depth < DEEP else []
            keys = self.keys if self.keys.issuperset(more) else self.keys.union(more)
            self.memo[key] = Path(keys, (f"l:{tag}", *(f"m:{n}" for n in names)), tag if tag in SECTIONS else self.section, mark or self.mark, self.depth + 1)
        return self.memo[key]


@lru_cache(maxsize=1 << 14)
def _named(attributes: str) -> tuple[tuple[str, ...], str]:
    """(tokens of class, id, role and itemprop; the value of data-main) of a tag's attributes."""
    tokens, mark = [], ""
    for name, *values in _NAMES.findall(attributes):
        value = html.unescape("".join(values))
        if name.lower() == "data-main":
            mark = value
        else:
            tokens += [t.lower() for t in _TOKENS.findall(value)]
    return tuple(dict.fromkeys(tokens[:16])), mark


@dataclass
class Block:
    text: str
    #: Code points of the text, before white space is reduced, that lie in links.
    linked: int
    size: int
    path: Path


def blocks(page: str | None, root: Path) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space reduced to single spaces, none empty."""
    page = page or ""
    cut = _OPEN.search(page, page.rfind(">") + 1)  # a tag or comment that the page's end breaks off is no text
    page = page[: cut.start()] if cut else page
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    path, at, links, linked, size = root.below("body", (), ""), 0, 0, 0, 0
    open_: dict[str, int] = {}
    pieces: list[str] = []

    def flush():
        nonlocal linked, size
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, linked, size, path))
        pieces.clear()
        linked = size = 0

    def pop():
        nonlocal path
        name, path = stack.pop()
        open_[name] -= 1

    while at < len(page):
        found = _TAG.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            size += len(piece)
            linked += len(piece) if links else 0
        if not found:
            break
        at = found.end()
        end, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in UNREAD:
            if not end and not attributes.endswith("/"):
                close = _CLOSE[tag].search(page, at)
                at = close.start() if close else len(page)
            continue
        if tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in ("html", "body"):  # a page has one body, whether it says so or not
            flush()
            if tag == "body" and not end and not stack:
                path = root.below("body", *_named(attributes))
        elif tag in BLOCKS:
            flush()
            links = 0
            if end:
                if open_.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in VOID:
                if stack and stack[-1][0] == "p":
                    pop()
                closes, stops = ENDS.get(tag, ((), ()))
                if any(open_.get(name) for name in closes):
                    depth = len(stack) - 1
                    while stack[depth][0] not in closes and stack[depth][0] not in stops:
                        depth -= 1
                    if stack[depth][0] in closes:
                        while len(stack) > depth:
                            pop()
                stack.append((tag, path))
                open_[tag] = open_.get(tag, 0) + 1
                path = path.below(tag, *_named(attributes))
    flush()
    return out
