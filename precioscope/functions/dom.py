"""A small tolerant document tree and selectors over the standard library's HTML tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends open elements of the value.
CLOSES = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}}
FENCES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


_NONE: dict[str, str] = {}  # the attributes of all elements without any


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "_text", "_below")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self._text: str | None = None
        self._below: list[Node] | None = None

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> list[Node]:
        """Elements below, in document order; kept, so a finished tree is walked once."""
        if self._below is None:
            self._below = list(self._walk())
        return self._below

    def _walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def forget(self) -> None:
        """Drops what the element and those below keep for the next time, so that a large page stays small."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node._text is not None or node._below is not None or node is self:
                node._text = node._below = None
                if len(node.children) < 1000:
                    stack.extend(node.elements())

    def own_text(self) -> str:
        return squeeze(" ".join(c for c in self.children if isinstance(c, str)))

    def text(self) -> str:
        if self._text is None:
            self._text = self._read()
        return self._text

    def _read(self) -> str:
        parts: list[str] = []
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return squeeze(" ".join(parts) if self.tag not in ("script", "style") else "")

    def signature(self) -> str:
        """Tag and up to three stable classes: what repeated blocks of a list have in common."""
        stable = sorted(c for c in self.get("class").split() if len(c) > 2 and not re.search(r"\d{3}", c))[:3]
        return ".".join([self.tag, *stable])


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        shut, node = CLOSES.get(tag), self.at
        while shut and node.parent is not None and node.tag not in FENCES.get(tag, ()):
            if node.tag in shut:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: (k if v is None else v) for k, v in attrs} if attrs else _NONE, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


def _compile(selector: str) -> list[list[tuple[str, str, list[tuple]]]]:
    """Alternatives of (combinator, tag, tests) steps, the last step first."""
    out = []
    for one in selector.split(","):
        steps, link = [], " "
        for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", one):
            if token == ">":
                link = ">"
                continue
            m = _STEP.fullmatch(token)
            if not m:
                steps = []
                break
            steps.append((link, (m[1] or "*").lower(), [p.groups() for p in _PART.finditer(m[2])]))
            link = " "
        if steps:
            out.append(steps[::-1])
    return out


def _fits(node: Node, tag: str, tests: list[tuple]) -> bool:
    if tag not in ("*", node.tag):
        return False
    for sign, name, attr, op, value in tests:
        if sign == "." and name not in node.get("class").split():
            return False
        if sign == "#" and node.get("id") != name:
            return False
        if attr:
            have, value = node.attrs.get(attr.lower()), value or ""
            if have is None or (op and not {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]):
                return False
    return True


def _chain(node: Node | None, steps: list) -> bool:
    link, rest = steps[0][0], steps[1:]
    if not rest:
        return True
    up = node.parent
    while up is not None and up.tag != "#root":
        if _fits(up, *rest[0][1:]) and _chain(up, rest):
            return True
        if link == ">":
            return False
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below that match: tag .class #id [a] [a=v] [a*=v] [a^=v] [a$=v], space, >, commas."""
    rules = _compile(selector)
    return [n for n in root.walk() if any(_fits(n, *s[0][1:]) and _chain(n, s) for s in rules)]


def absolute(url: str | None, base: str | None) -> str | None:
    """The resolved http address; None for empty, script and fragment links."""
    if not url or not isinstance(url, str):
        return None
    url = unescape(url).strip()
    if not url or url.startswith("#") or url.lower().startswith("javascript:"):
        return None
    try:
        full = urljoin(base or "", url)
        return full if urlsplit(full).netloc else None
    except ValueError:
        return None
