"""A small document tree on the standard library's HTML parser, for pages whose items a pattern can't cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []

    def __iter__(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        open_ = [iter([p for p in self.parts if isinstance(p, Node)])]
        while open_:
            node = next(open_[-1], None)
            if node is None:
                open_.pop()
                continue
            yield node
            open_.append(iter([p for p in node.parts if isinstance(p, Node)]))

    def text(self) -> str:
        found, open_ = [], [self]
        while open_:
            part = open_.pop()
            if isinstance(part, str):
                found.append(part.strip())
            else:
                open_ += reversed(part.parts)
        return " ".join(x for x in found if x)

    def raw(self) -> str:
        return "".join(p for p in self.parts if isinstance(p, str))

    def all(self, selector: str) -> list[Node]:
        """Nodes below that match a selector of descendants, each like tag#id.class[name^=value]; * and = work too."""
        steps = [_step(s) for s in selector.split()]
        return [n for n in self if _matches(n, steps, self)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.all(selector)), None)


def _step(text: str):
    tag = re.match(r"[a-z][a-z0-9]*", text)
    attrs = re.findall(r"\[([a-z-]+)(?:([\^*]?)=\"?([^\]\"]*)\"?)?\]", text)
    plain = re.sub(r"\[[^\]]*\]", "", text)
    return tag and tag[0], re.findall(r"#([\w-]+)", plain), re.findall(r"\.([\w-]+)", plain), attrs


def _fits(node: Node, step) -> bool:
    tag, ids, classes, attrs = step
    has = (node.attrs.get("class") or "").split()
    if tag and node.tag != tag or any(node.attrs.get("id") != i for i in ids) or any(c not in has for c in classes):
        return False
    for name, how, value in attrs:
        got = node.attrs.get(name)
        if got is None or how == "^" and not got.startswith(value) or how == "*" and value not in got or not how and value and got != value:
            return False
    return True


def _matches(node: Node, steps: list, root: Node) -> bool:
    if not _fits(node, steps[-1]):
        return False
    at, left = node.parent, len(steps) - 2
    while left >= 0 and at is not None and at is not root:
        if _fits(at, steps[left]):
            left -= 1
        at = at.parent
    return left < 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def parsed(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
