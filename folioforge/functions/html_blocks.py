"""Visible-text blocks of an HTML page, in page order, with their container.

A block is a ``p``, ``li``, ``dd`` or ``blockquote``, or a run of bare text
outside them that ends at the next heading or such tag.  Heading texts are no
blocks; the title text is one.  White space is collapsed.  The function is a
single pass of one compiled pattern over the whole text, without a tree, so a
page costs a few hundred microseconds.

Null or empty html gives no blocks; unclosed comments and script elements end
with the text; unknown tags are transparent.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

BLOCK_TAGS = frozenset({"p", "li", "dd", "blockquote"})
HEADING_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements that take part in the container path.
CONTAINER_TAGS = frozenset(
    "div main article section aside nav header footer table td form".split()
)
INLINE_TAGS = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time u var"
    " html head meta link base title".split()
)

#: Elements whose content is no markup and not visible.
RAW_TAGS = frozenset("script style noscript template svg".split())
_TOKEN = re.compile(
    r"([^<]+)"
    r"|<(/?[a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|(<)",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class HtmlBlock(NamedTuple):
    """One block; ``container`` is the outermost container's number on the
    page (0: none), ``signature`` its tag with class, id or role, ``heading``
    the nearest heading above and ``in_main`` whether the container holds
    the page's first ``h1``."""

    ord: int
    text: str
    tag: str | None
    heading: str | None
    container: int
    signature: str
    in_main: bool


def extract_blocks(html: str | None) -> list[HtmlBlock]:
    """Blocks of ``html`` in page order."""
    if not html:
        return []
    rows: list[list] = []
    buf: list[str] = []
    open_boxes: list[tuple[str, int]] = []
    box_count = 0
    box, sig = 0, ""
    heading: str | None = None
    head_buf: list[str] | None = None
    run_tag: str | None = None
    run_box, run_sig, run_heading = 0, "", None
    current: str = "body"
    h1_box: int | None = None

    def flush() -> None:
        if buf:
            text = "".join(buf)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                rows.append([text, run_tag, run_heading, run_box, run_sig])
            buf.clear()

    skip = 0  # where the content of a raw element ends
    for m in _TOKEN.finditer(html):
        kind = m.lastindex
        if kind is None or m.start() < skip:
            continue
        if kind == 1 or kind == 4:
            text = m.group()
            if head_buf is not None:
                head_buf.append(text)
            elif buf:
                buf.append(text)
            elif not text.isspace():
                buf.append(text)
                run_tag, run_box, run_sig, run_heading = current, box, sig, heading
            continue
        tag = m.group(2).lower()
        closing = tag[0] == "/"
        if closing:
            tag = tag[1:]
        if tag in INLINE_TAGS:
            if tag == "title":
                current = "body" if closing else tag
            continue
        if tag in RAW_TAGS:
            if not closing:
                end = _RAW_END[tag].search(html, m.end())
                skip = end.end() if end else len(html)
            continue
        if tag in BLOCK_TAGS:
            flush()
            current = sig.partition(" ")[0] or "body" if closing else tag
        elif tag in HEADING_TAGS:
            flush()
            if closing:
                if head_buf is not None:
                    heading = " ".join(_html.unescape("".join(head_buf)).split())
                head_buf = None
            else:
                head_buf = []
                if tag == "h1" and h1_box is None:
                    h1_box = box
        else:
            if buf:
                buf.append(" ")
            elif head_buf is not None:
                head_buf.append(" ")
            current = tag
        if tag in CONTAINER_TAGS:
            if not closing:
                if not open_boxes:
                    box_count += 1
                    c = _CLASS.search(m.group(3) or "")
                    box = box_count
                    sig = f"{tag} {next((g for g in c.groups() if g is not None), '')}" if c else f"{tag} "
                open_boxes.append((tag, box))
            else:
                for i in range(len(open_boxes) - 1, -1, -1):
                    if open_boxes[i][0] == tag:
                        del open_boxes[i:]
                        break
                if not open_boxes:
                    box, sig = 0, ""
    flush()
    return [
        HtmlBlock(i, t, tg, hd, bx, sg, h1_box is not None and h1_box != 0 and bx == h1_box)
        for i, (t, tg, hd, bx, sg) in enumerate(rows)
    ]
