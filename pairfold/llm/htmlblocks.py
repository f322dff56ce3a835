"""Web pages as sequences of leaf blocks: the text between block-level tags, with its tag path."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub mfrac msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end or the page's.
RAW = frozenset("script style title textarea".split())
#: Elements whose content is no text of the page; if they are not closed, only their tag is skipped.
SKIPPED = frozenset("noscript template iframe noembed noframes xmp svg select head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
FORMS = frozenset("form button fieldset label".split())


class Node:
    """An open element: its own tag with parts of its class, id and role, below its parent."""

    __slots__ = ("parent", "tag", "own", "size", "place")

    def __init__(self, parent: Node | None, tag: str, own: tuple[str, ...]):
        self.parent, self.tag, self.own = parent, tag, own
        self.size = len(own) + (parent.size if parent else 0)  # parts from the root
        self.place = -1  # where a batch of pages has it


@dataclass
class Block:
    text: str
    node: Node | None  # shared with all blocks in the element, so deep pages cost no more than their tags
    link: float  # share of its characters within links
    form: bool

    @property
    def path(self) -> tuple[str, ...]:
        """Tags from the root, with parts of their class, id and role."""
        steps, at = [], self.node
        while at:
            steps.append(at.own)
            at = at.parent
        return tuple(x for own in reversed(steps) for x in own)


def names_of(attributes: str) -> list[str]:
    out = []
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            out += [f".{p.lower()}" for p in PART.findall(value)]
    return out


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in order; character references decoded, white space runs made one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1] if stack else None, min(1.0, linked / len(whole)), any(open_tags[t] for t in FORMS)))
            text.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        return tag

    at = 0
    while True:
        m = TOKEN.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            text.append(chunk)
            if open_tags["a"]:
                linked += len(chunk)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if closing:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in RAW or tag in SKIPPED:
            if attributes.endswith("/") and tag == "svg":
                continue
            end = None
            if tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if tag == "head" and not end:  # an unclosed head ends where the body begins
                    end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                if not end:
                    unclosed.add(tag)
            at = end.end() if end else len(page) if tag in RAW else at
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        shut = CLOSES.get(tag)
        if shut:
            while stack and stack[-1].tag in shut | INLINE and any(open_tags[t] for t in shut):
                if pop() in shut and tag not in ("tr",):
                    break
        elif tag not in INLINE and any(x.tag == "p" for x in stack[-3:]):
            while pop() != "p":
                pass
        stack.append(Node(stack[-1] if stack else None, tag, (tag, *names_of(attributes))))
        open_tags[tag] += 1
    flush()
    return out
