"""A small DOM for audit parsing: tolerant tree building and the selectors that extraction rules use."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

#: Fixed values of HTML: elements without content, elements of raw text, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
DECODED = frozenset(("title", "textarea"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
IN_HEAD = frozenset("base link meta noscript script style template title".split())

#: Every part takes what it can and gives nothing back, and ends at the end of the page if not before: no character is
#: read again for each tag that is left open.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element: its tag, attributes (first of each name, lower-case), children (elements and strings), parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if type(c) is Node)

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if type(n) is str:
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


REFERENCE = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);")


def unescape_closed(text: str) -> str:
    """The text with the references that a semicolon ends read; what HTML would also read without one stays as it is."""
    return REFERENCE.sub(lambda m: unescape(m[0]), text)


def attributes(text: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), decode(value) if "&" in value else value)
    return out


def parse(page: str, closed: bool = False) -> Node:
    """The document: html with head and body, which are there whether or not the page says so. A tag that the page
    leaves open is text. The time is linear in the page: where each tag is open is known, not searched. ``closed``:
    references count only with their semicolon."""
    decode = unescape_closed if closed else unescape
    root = Node("html", {}, None)
    head, body = Node("head", {}, root), Node("body", {}, root)
    root.children = [head, body]
    at, here, in_body = 0, head, False
    end = len(page)
    #: The open elements below head or body, and the depths at which each tag is open, the nearest last.
    path: list[Node] = []
    depths: dict[str, list[int]] = {}

    def leave(depth: int) -> None:
        nonlocal here
        here = path[depth].parent
        for n in path[depth:]:
            depths[n.tag].pop()
        del path[depth:]

    def begin_body() -> None:
        nonlocal here, in_body
        if path:
            leave(0)
        here, in_body = body, True

    def text(t: str) -> None:
        if here is head and not t.isspace():
            begin_body()
        if here is not head:
            here.children.append(decode(t) if "&" in t else t)

    def nearest(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def up_to(tags: set[str], stops: set[str]) -> None:
        depth = nearest(tags)
        if depth > nearest(stops):
            leave(depth)

    while at < end:
        m = TOKEN.search(page, at)
        if not m or m[4] == "":
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "head":
                begin_body()
            elif tag not in ("body", "html") and depths.get(tag):
                leave(depths[tag][-1])
            continue
        attrs = attributes(m[3], decode) if m[3] else {}
        if tag in ("html", "body", "head"):
            target = {"html": root, "head": head, "body": body}[tag]
            target.attrs = attrs | target.attrs
            if tag == "body" and not in_body:
                begin_body()
            continue
        if here is head and tag not in IN_HEAD:
            begin_body()
        if tag in CLOSES_P:
            up_to({"p"}, {"button", "td", "th", "table"})
        if tag in HEADINGS and here.tag in HEADINGS:
            leave(len(path) - 1)
        if tag in CLOSES:
            up_to(*CLOSES[tag])
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            raw = page[at : close.start() if close else end]
            if raw:
                node.children.append(decode(raw) if tag in DECODED and "&" in raw else raw)
            at = close.end() if close else end
            continue
        depths.setdefault(tag, []).append(len(path))
        path.append(node)
        here = node
    return root


#: Attributes whose values compare without regard to case.
ANY_CASE = frozenset(("rel", "type", "media", "lang", "dir", "method"))
SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child)""")


class SelectorError(ValueError):
    pass


def compile_selector(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives of steps (combinator, tests); an error for what is outside the subset."""
    out = []
    for one in selector.split(","):
        steps, at, one = [], 0, one.strip()
        join = " "
        while at < len(one):
            tests = []
            while at < len(one) and (m := SIMPLE.match(one, at)):
                tests.append(m.groups())
                at = m.end()
            if not tests:
                raise SelectorError(f"Invalid CSS selector: {selector}")
            steps.append((join, tests))
            m = re.compile(r"\s*([>+~])\s*|\s+").match(one, at)
            if m:
                join, at = m[1] or " ", m.end()
            elif at < len(one):
                raise SelectorError(f"Invalid CSS selector: {selector}")
        if not steps or join != " " and len(steps) == 1 and one[-1:] in ">+~":
            raise SelectorError(f"Invalid CSS selector: {selector}")
        out.append(steps)
    return out


def _fits(n: Node, tests: list) -> bool:
    for tag, ident, cls, name, op, a, b, c, pseudo in tests:
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        if ident and n.attrs.get("id") != ident:
            return False
        if cls and cls not in n.attrs.get("class", "").split():
            return False
        if name:
            has = n.attrs.get(name.lower())
            if has is None:
                return False
            if op:
                want = a if a is not None else b if b is not None else c
                if name.lower() in ANY_CASE:
                    has, want = has.lower(), want.lower()
                if not {"=": has == want, "~=": want in has.split(), "^=": bool(want) and has.startswith(want), "$=": bool(want) and has.endswith(want), "*=": bool(want) and want in has, "|=": has == want or has.startswith(want + "-")}[op]:
                    return False
        if pseudo:
            kin = [x for x in n.parent.children if type(x) is Node] if n.parent else [n]
            if kin[0 if pseudo == "first-child" else -1] is not n:
                return False
    return True


def _matches(n: Node, steps: list) -> bool:
    join, tests = steps[-1]
    if not _fits(n, tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if join == ">":
        return n.parent is not None and _matches(n.parent, rest)
    if join in "+~" and n.parent is not None:
        kin = [x for x in n.parent.children if type(x) is Node]
        before = kin[: next(i for i, x in enumerate(kin) if x is n)]
        return any(_matches(x, rest) for x in (before[-1:] if join == "+" else before))
    up = n.parent
    while up is not None:
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    compiled = compile_selector(selector)
    return [n for n in root.walk() if any(_matches(n, steps) for steps in compiled)]
