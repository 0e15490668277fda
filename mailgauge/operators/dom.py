"""A small lenient HTML tree on the standard library's parser.

No tag closes another one by itself; an end tag closes up to the nearest open tag of its
name and is ignored if there is none. Neighbouring text joins; a string of blanks becomes one
line end (if it holds one) or one space outside pre and textarea.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and elements whose text is never shown.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
UNSEEN = frozenset("script style meta link noscript svg img title".split())
NO_BOX = UNSEEN | {"br", "hr"}
_BLANKS = "\n\t\f\r "
_KEEP_BLANKS = ("pre", "textarea")


class Text(str):
    """A text node: ``kind`` is text, code (script, style), comment, declaration or markup (doctype, processing instruction)."""

    kind = "text"

    def __new__(cls, value: str, kind: str = "text"):
        out = super().__new__(cls, value)
        out.kind = kind
        return out


class Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator:
        """All nodes below, in document order; no recursion, so depth does not matter."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Element):
                todo.extend(reversed(node.children))

    def find(self, name: str) -> Element | None:
        return next((n for n in self.walk() if isinstance(n, Element) and n.name == name), None)

    def strings(self) -> Iterator[str]:
        return (n for n in self.walk() if isinstance(n, Text) and n.kind == "text")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]", {})
        self.open = [self.root]
        self.names: dict[str, int] = {}
        self.held: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.held)
        self.held = []
        if not text:
            return
        if not text.strip(_BLANKS) and not any(self.names.get(n) for n in _KEEP_BLANKS):
            text = "\n" if "\n" in text else " "
        top = self.open[-1]
        top.children.append(Text(text, "code" if top.name in ("script", "style", "template") else "text"))

    def _add(self, text: str, kind: str) -> None:
        self._flush()
        self.open[-1].children.append(Text(text, kind))

    def handle_starttag(self, tag, attrs):
        self._flush()
        node = Element(tag, {k: v if v is not None else "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] = self.names.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self.names.get(tag):
            return
        while True:
            closed = self.open.pop().name
            self.names[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self._add(data, "comment")

    def handle_decl(self, decl):
        low = decl.lower()
        self._add(decl[8:] if low.startswith("doctype ") else "" if low == "doctype" else decl, "markup")

    def handle_pi(self, data):
        self._add(data, "markup")

    def unknown_decl(self, data):
        cdata = data.upper().startswith("CDATA[")
        self._add(data[6:] if cdata else data, "text" if cdata else "declaration")


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._flush()
    return builder.root


def _shown(node) -> bool:
    return isinstance(node, Text) and node.kind not in ("comment", "declaration")


def prune(top: Element) -> None:
    """Drop elements below ``top`` without text and without child elements that have a box, innermost first."""
    order = [top, *(n for n in top.walk() if isinstance(n, Element))]
    text: dict[int, bool] = {}
    for node in reversed(order):  # children come after their parents, so they are settled first
        kept = []
        has_text = False
        for child in node.children:
            if isinstance(child, Element):
                if not text[id(child)] and not any(isinstance(c, Element) and c.name not in NO_BOX for c in child.children):
                    continue
                has_text |= text[id(child)]
            elif _shown(child) and child != "":
                has_text = True
            kept.append(child)
        node.children = kept
        text[id(node)] = has_text


def comments(top: Element) -> list[str]:
    return [str(n).strip() for n in top.walk() if isinstance(n, Text) and n.kind == "comment"]


def link_text(node: Element) -> str:
    return " ".join(s for s in (str(t).strip() for t in node.strings()) if s)


def visible_text(html: str) -> str:
    """Text without code, images and titles; blanks squeezed, empty lines at most one."""
    parts, todo = [], [parse(html)]
    while todo:
        node = todo.pop()
        if isinstance(node, Text):
            if node.kind == "text":
                parts.append(str(node))
        elif node.name not in UNSEEN:
            todo.extend(reversed(node.children))
    text = "\n".join(parts).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
