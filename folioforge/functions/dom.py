"""Element trees of pages, for what needs ancestors: style rules, hidden texts, prose, state literals.

A tree is built in one pass over the tags.  Void elements hold nothing, a new
paragraph or list item ends the open one, and what is left open ends with the
page.  Null html gives an empty tree.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template", "textarea", "title"))
#: Elements that end an open one of the same kind.
ENDS_ITSELF = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
_TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+)|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; ``children`` are nodes and texts in order."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def path(self) -> str:
        """Tags from the root with the place among the parent's elements."""
        out, node = [], self
        while node.parent is not None:
            at = [c for c in node.parent.children if isinstance(c, Node)].index(node)
            out.append(f"{node.tag}[{at}]")
            node = node.parent
        return "/".join(reversed(out))

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: frozenset[str] = frozenset(("script", "style", "template", "noscript"))) -> str:
        """All text below, white space collapsed."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack += reversed(node.children)
        return " ".join(" ".join(out).split())


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag; the first of a name counts, a bare one is empty."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str | None) -> tuple[Node, list[str]]:
    """(root, comments)."""
    root, comments = Node("", {}, None), []
    node, at, html = root, 0, html or ""
    while m := _TOKEN.match(html, at):
        at = m.end()
        if m[1] is not None:
            comments.append(m[1].strip())
        elif m[5] is not None or m.group() == "<":
            text = _html.unescape(m.group())
            if text.strip():
                node.children.append(text)
        elif m[3]:
            tag = m[3].lower()
            if m[2]:
                up: Node | None = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    node = up.parent
                continue
            if tag in ENDS_ITSELF and node.tag == tag and node.parent is not None:
                node = node.parent
            new = Node(tag, attributes(m[4]), node)
            node.children.append(new)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                new.children.append(html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
            elif tag not in VOID and not m[4].rstrip().endswith("/"):
                node = new
    return root, comments


# ---- styles


def declarations(text: str) -> dict[str, str]:
    out = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip().lower()] = value.replace("!important", "").strip().lower()
    return out


def style_rules(css: str) -> list[tuple[str, dict[str, str]]]:
    """(selector, declarations) of the rules outside at-rules, one for each selector of a list."""
    rules, at, depth, begin = [], 0, 0, 0
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    head = ""
    for at, c in enumerate(css):
        if c == "{":
            if depth == 0:
                head, begin = css[begin:at].strip(), at + 1
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                if not head.startswith("@"):
                    body = declarations(css[begin:at])
                    rules += [(s.strip(), body) for s in head.split(",") if s.strip()]
                begin = at + 1
        elif c == ";" and depth == 0:
            begin = at + 1  # a statement such as an import
    return rules


_SIMPLE = re.compile(r"^([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:[.#][\w-]+)*)$")


def matches(selector: str, node: Node) -> bool:
    """Whether a selector of tag, classes and id is met; others meet nothing."""
    m = _SIMPLE.match(selector)
    if not m or not selector:
        return False
    if m[1] and m[1] != "*" and m[1].lower() != node.tag:
        return False
    classes = set(node.attrs.get("class", "").split())
    marks = re.findall(r"[.#][\w-]+", m[2])
    return all(k[1:] in classes if k[0] == "." else node.attrs.get("id") == k[1:] for k in marks)


def _below(limit: float):
    def test(value: str) -> bool:
        m = re.match(r"-?\d+(?:\.\d+)?", value)
        return bool(m) and float(m.group()) <= limit

    return test


def _among(*values: str):
    return lambda value: value.replace(" ", "") in values


#: Fixed values: (technique, tests of properties that must all hold).
CONCEALING = (
    ("display:none", {"display": _among("none")}),
    ("visibility:hidden", {"visibility": _among("hidden")}),
    ("opacity:0", {"opacity": _among("0", "0.0", "0%")}),
    ("font-size:0", {"font-size": _among("0", "0px", "0em", "0rem", "0%")}),
    ("text-indent", {"text-indent": _below(-9999)}),
    ("clip", {"clip": _among("rect(0,0,0,0)", "rect(0px,0px,0px,0px)")}),
    ("no width", {"width": _among("0", "0px")}),
    ("no height", {"height": _among("0", "0px")}),
    ("off to the left", {"position": _among("absolute"), "left": _below(-1000)}),
    ("off to the top", {"position": _among("absolute"), "top": _below(-1000)}),
)


def conceals(style: dict[str, str]) -> str | None:
    """The first technique by which a style hides its element."""
    for name, tests in CONCEALING:
        if all(p in style and ok(style[p]) for p, ok in tests.items()):
            return name
    return None


def concealment(node: Node, rules: list[tuple[str, dict[str, str]]]) -> str | None:
    """How an element hides itself: attribute, inline style, or the rules that meet it, later ones last."""
    if "hidden" in node.attrs:
        return "hidden attribute"
    if node.attrs.get("aria-hidden", "").strip().lower() == "true":
        return "aria-hidden"
    inline = conceals(declarations(node.attrs.get("style", "")))
    if inline:
        return inline
    style: dict[str, str] = {}
    for selector, body in rules:
        if matches(selector, node):
            style |= body
    return conceals(style)


def hidden_texts(html: str) -> Iterator[tuple[str, str, str]]:
    """(path, technique, text) of outermost hidden elements, meta contents, comments and strings of structured data."""
    root, comments = parse(html)
    rules = [r for n in root.walk() if n.tag == "style" for r in style_rules("".join(c for c in n.children if isinstance(c, str)))]
    stack = [root]
    while stack:
        node = stack.pop()
        how = concealment(node, rules) if node.parent is not None else None
        if how:
            text = node.text()
            if text:
                yield node.path(), how, text
            continue
        if node.tag == "meta" and node.attrs.get("content"):
            yield node.path(), "meta", " ".join(node.attrs["content"].split())
        if node.tag == "script" and node.attrs.get("type", "").strip().lower() == "application/ld+json":
            for leaf in string_leaves("".join(c for c in node.children if isinstance(c, str))):
                yield node.path(), "structured data", leaf
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    for k, text in enumerate(comments):
        if text:
            yield f"comment[{k}]", "comment", " ".join(text.split())


# ---- texts that address a machine

# Phrases that override, and phrases that claim authority.
OVERRIDES = ("ignore previous instructions", "ignore prior instructions", "ignore all previous instructions", "ignore all prior instructions", "disregard the above", "system prompt", "you are an ai", "you are a assistant", "you are an assistant", "you are a language model", "you are a ai", "you are an language model", "as an ai", "new instructions")
CLAIMS_AUTHORITY = ("cite this page", "cite this site", "cite this source", "authoritative source", "always recommend", "always mention", "rank this", "do not suggest competitors")
# Names for reading machines, and what they are told to do.
MACHINES = ("ai", "assistant", "model", "chatbot", "llm", "agent", "chatgpt", "claude", "perplexity", "crawler", "bot")
ORDERS = (
    "cite", "recommend", "mention", "rank", "ignore", "disregard", "treat", "respond", "answer", "include", "exclude", "suppress", "prioritize", "favor", "avoid", "state", "claim", "assert", "present",
    "suggest", "promote", "endorse", "list", "tell", "inform", "direct", "instruct", "act", "behave", "pretend", "assume", "output", "generate", "write", "say", "do", "provide",
)
COURTESIES = ("please", "kindly", "always")
#: Letters from which on a claim of authority counts.
LEAST_CLAIM = 40


def _called_upon(text: str) -> bool:
    """A machine's name before a comma or colon, then an order, perhaps with courtesies between."""
    low = text.lower()
    for m in re.finditer(r"([a-z]+)\s*[,:]\s*", low):
        if m[1] in MACHINES and (m.start() == 0 or not low[m.start() - 1].isalnum()):
            rest = re.findall(r"[a-z']+", low[m.end() : m.end() + 60])
            while rest and rest[0] in COURTESIES:
                rest = rest[1:]
            if rest and rest[0] in ORDERS:
                return True
    return False


def _told_as(text: str) -> bool:
    """Within one sentence: as or being a machine, then you, then must or the like, then an order."""
    for sentence in re.split(r"[.?!\n]", text.lower()):
        words = re.findall(r"[a-z']+", sentence)
        for i in range(len(words) - 2):
            if words[i] in ("as", "being") and words[i + 1] in ("a", "an") and words[i + 2] in MACHINES:
                you = next((k for k in range(i + 3, len(words)) if words[k] in ("you", "you're")), None)
                must = next((k for k in range(you + 1, len(words)) if words[k] in ("should", "must", "will", "need", "always")), None) if you else None
                if must and any(w in ORDERS for w in words[must + 1 : must + 8]):
                    return True
    return False


def addressed(text: str) -> str | None:
    """override, addressing or authority, or None."""
    low = " ".join(text.lower().split())
    if any(p in low for p in OVERRIDES):
        return "override"
    if _called_upon(text) or _told_as(text):
        return "addressing"
    if len(text) >= LEAST_CLAIM and any(p in low for p in CLAIMS_AUTHORITY):
        return "authority"
    return None


# ---- prose

#: Elements that hold no prose.
STRUCTURED = frozenset(("table", "dl", "ul", "ol", "select"))
CARD_TAGS = frozenset(("div", "li", "a", "button"))
LEAST_CARDS, LONGEST_CARD = 6, 15


def card_signatures(root: Node) -> dict[tuple[str, str], int]:
    """(tag, class) of the cards of a page that come ``LEAST_CARDS`` times and more and are all short, with their number."""
    words: dict[tuple[str, str], list[int]] = {}
    for node in root.walk():
        if node.tag in CARD_TAGS and node.attrs.get("class"):
            words.setdefault((node.tag, " ".join(node.attrs["class"].split())), []).append(len(node.text().split()))
    return {k: len(v) for k, v in words.items() if len(v) >= LEAST_CARDS and max(v) <= LONGEST_CARD}


def prose(html: str | None) -> str:
    """Visible text without tables, lists, choices and repeated short cards."""
    root, _ = parse(html)
    cards = card_signatures(root)
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in STRUCTURED and node.tag not in ("script", "style", "template", "noscript", "head") and (node.tag, " ".join(node.attrs.get("class", "").split())) not in cards:
            stack += reversed(node.children)
    return " ".join(" ".join(out).split())


# ---- scripts


def balanced(text: str, at: int) -> str | None:
    """The bracketed literal that begins at ``at``; brackets within strings do not count; None if it never closes."""
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[at : i + 1]
        i += 1
    return None


# Names that frameworks assign their state to.
STATE_NAMES = ("window.__NUXT__", "window.__remixContext")


def assigned_literals(script: str) -> Iterator[tuple[str, str]]:
    for name in STATE_NAMES:
        m = re.search(re.escape(name) + r"\s*=\s*(?=[{\[])", script)
        body = balanced(script, m.end()) if m else None
        if body:
            yield name, body


def string_leaves(body: str | None) -> Iterator[str]:
    """Strings among the values of a JSON text, in order."""
    try:
        stack = [json.loads(body or "")]
    except ValueError:
        return
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
