"""Verses of an HTML page, by three strategies in turn, in one Arrow UDF over the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from verbatlas.sources.batches import give_back

# Strings of the page chrome that mark a block as no content.
NOISE = (
    "Currently Selected", "YouVersion", "Bible App", "Copyright", "All rights reserved", "Learn More About", "Popular Bible Verses",
    "READER SETTINGS", "Next Chapter", "Previous Chapter", "Highlight", "Compare", "Share", "Sign up or sign in", "Get the app",
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """All elements below, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Text nodes below, each stripped, without empty ones, joined by a space; scripts and styles say nothing."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if cut := node.strip():
                    out.append(cut)
            elif node is self or node.tag not in _HIDDEN:
                todo.extend(reversed(node.children))
        return " ".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(reversed(attrs)))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(reversed(attrs))))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_comment(self, data):
        self.open[-1].children.append(Node("", {}))  # parts the text before and behind it

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        here = self.open[-1].children
        if here and isinstance(here[-1], str):
            here[-1] += data
        else:
            here.append(data)


#: A text, an end tag, or a start tag whose attributes are all in plain double quotes: what every parser reads alike.
_NAME, _ATTR = r"[a-zA-Z][a-zA-Z0-9]*", re.compile(r'[ \t\n\r\f]+([a-zA-Z_][-a-zA-Z0-9_]*)="([^"<>&]*)"')
_TOKEN = re.compile(rf"(([^<]+)|<(?:/({_NAME})|({_NAME})((?:{_ATTR.pattern.replace('(', '(?:')})*)[ \t\n\r\f]*(/?))>)")
#: Elements whose content a parser may take as it is.
_RAW = set("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


def _parse_plain(html: str) -> Node | None:
    """The tree of a page of nothing but such tokens, by one pattern; None for any other page."""
    found = _TOKEN.findall(html)
    if sum(len(whole) for whole, *_ in found) < len(html):
        return None
    tree, known = _Tree(), {}
    for _, text, end, tag, attrs, empty in found:
        if text:
            tree.handle_data(unescape(text) if "&" in text else text)
        elif end:
            tree.handle_endtag(end.lower())
        else:
            tag = tag.lower()
            if tag in _RAW:
                return None
            if attrs not in known:
                known[attrs] = [(k.lower(), v) for k, v in _ATTR.findall(attrs)]
            (tree.handle_startendtag if empty else tree.handle_starttag)(tag, known[attrs])
    return tree.root


def _parse_any(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def parse(html: str) -> Node:
    return _parse_plain(html) or _parse_any(html)


def _has_class(node: Node, part: str) -> bool:
    return part in (node.attrs.get("class") or "")  # a part without blanks lies within one class


def verses(html: str | None) -> list[str]:
    """The verses of a page: marked verse elements, else elements with data-usfm, else long blocks without chrome."""
    root = parse(html or "")
    found = []
    for node in root.walk():
        if _has_class(node, "ChapterContent_verse"):
            parts = [n.text() for n in node.walk() if _has_class(n, "ChapterContent_content")]
            if text := (" ".join(parts) if parts else node.text()).strip():
                found.append(text)
    if not found:
        found = [t for n in root.walk() if "data-usfm" in n.attrs and (t := n.text())]
    if not found:
        blocks = (n.text() for n in root.walk() if n.tag in ("p", "div", "span"))
        found = list(dict.fromkeys(t for t in blocks if len(t) >= 25 and not any(m in t for m in NOISE)))
    return found


@F.arrow_udf(ArrayType(StringType()))
def _verses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([verses(page.as_py()) for page in pages], pa.list_(pa.string()))
    give_back()


def html_verses(html: Column) -> Column:
    """The verses of each page; the frame it is selected from goes through ``bounded_batches``."""
    return _verses(html)
