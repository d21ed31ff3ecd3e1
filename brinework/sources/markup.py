"""A tolerant reader of XML and HTML: what is broken is closed, skipped or kept as text, and told."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML without an end tag, and those whose content is no markup (fixed by the language).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
ERRORS = "array<struct<kind:string,at:int,what:string>>"
_NAME = r"[A-Za-z_:가-힣][^\s<>/=\"']*"
# possessive throughout, so a tag that doesn't end is given up without trying its parts anew
_OPEN = re.compile(rf"<({_NAME}+)((?:\s++|/(?!>)|[^\s<>\"'/=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=\s*+[^\s<>\"']++|=|\"[^\"<>]*+\"|'[^'<>]*+')*+)(/?)>")
_END = re.compile(rf"</({_NAME})\s*>")
_DECLARATION = re.compile(r"<![A-Za-z][^<>\[]*(?:\[[^\]]*\]\s*)?>")
#: How comments, instructions and verbatim text begin and end.
_MARKS = (("<!--", "-->"), ("<?", ">"), ("<![CDATA[", "]]>"))
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENTITY = re.compile(r"&(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;)?")


@dataclass
class Event:
    """``start`` (name, attributes), ``end`` (name), ``text``, or ``error`` (its kind), each with its place in the text."""

    kind: str
    what: str
    at: int
    attributes: dict[str, str] = field(default_factory=dict)


def decoded(text: str, at: int) -> tuple[str, list[Event]]:
    """Text with its entities read; a bare or unknown ``&`` stays as it is and is an error."""
    if "&" not in text:
        return text, []
    errors: list[Event] = []

    def read(m: re.Match) -> str:
        if m[1] and m[1][0] == "#":
            code = int(m[1][2:-1], 16) if m[1][1] in "xX" else int(m[1][1:-1])
            if 0 < code < 0xD800 or 0xDFFF < code < 0x110000:
                return chr(code)
        elif m[1] in html5:
            return html5[m[1]]
        errors.append(Event("error", "unknown entity" if m[1] else "bare &", at + m.start()))
        return m[0]

    return _ENTITY.sub(read, text), errors


def tokens(text: str, html: bool = False) -> Iterator[Event]:
    """The events of a text, from left to right; a ``<`` that begins no tag is text and an error."""

    def said(a: int, b: int) -> Iterator[Event]:
        if a < b:
            out, errors = decoded(text[a:b], a)
            yield from errors
            yield Event("text", out, a)

    ends: dict[str, int] = {}

    def closing(mark: str, at: int) -> int:
        """Where the next ``mark`` stands, -1 for nowhere; looked for once."""
        if ends.get(mark, at - 1) >= at or ends.get(mark) == -1:
            return ends[mark]
        ends[mark] = text.find(mark, at)
        return ends[mark]

    at = begun = 0
    while (at := text.find("<", at)) >= 0:
        if m := _OPEN.match(text, at):
            yield from said(begun, at)
            name = m[1].lower() if html else m[1]
            attributes = {}
            for key, *values in _ATTRIBUTE.findall(m[2]):
                value, errors = decoded(next((v for v in values if v), ""), at)
                yield from errors
                attributes.setdefault(key.lower() if html else key, value)
            yield Event("start", name, at, attributes)
            if m[3] or (html and name in VOID):
                yield Event("end", name, at)
            begun = at = m.end()
            if html and name in RAW and not m[3]:
                close = _RAW_END[name].search(text, at)
                begun = at = close.start() if close else len(text)
        elif m := _END.match(text, at):
            yield from said(begun, at)
            yield Event("end", m[1].lower() if html else m[1], at)
            begun = at = m.end()
        elif m := _DECLARATION.match(text, at):
            yield from said(begun, at)
            begun = at = m.end()
        elif (found := next(((a, b, closing(b, at + len(a))) for a, b in _MARKS if text.startswith(a, at)), None)) and found[2] >= 0:
            yield from said(begun, at)
            if found[0] == "<![CDATA[":
                yield Event("text", text[at + len(found[0]) : found[2]], at)
            begun = at = found[2] + len(found[1])
        else:
            yield Event("error", "bare <", at)
            at += 1
    yield from said(begun, len(text))


def balanced(events: Iterable[Event], length: int, html: bool = False) -> Iterator[Event]:
    """Events in which every start has its end.

    An end tag closes the elements that stand open inside its own (an error
    each); one without a start is skipped (an error); what is open at the end
    is closed (an error each).  In HTML a ``p`` ends where the next one begins,
    and void elements need no end: neither is an error.
    """
    stack: list[str] = []
    depth: dict[str, int] = {}

    def close() -> Event:
        name = stack.pop()
        depth[name] -= 1
        return Event("end", name, at)

    at = 0
    for e in events:
        at = e.at
        if e.kind == "start":
            if html and e.what == "p" and stack and stack[-1] == "p":
                yield close()
            stack.append(e.what)
            depth[e.what] = depth.get(e.what, 0) + 1
            yield e
        elif e.kind == "end":
            if not depth.get(e.what):
                if not (html and e.what in VOID):
                    yield Event("error", f"no start of {e.what}", at)
                continue
            while stack[-1] != e.what:
                yield Event("error", f"no end of {stack[-1]}", at)
                yield close()
            yield close()
        else:
            yield e
    at = length
    while stack:
        yield Event("error", f"no end of {stack[-1]}", at)
        yield close()


def recovered(text: str, html: bool = False) -> tuple[ET.Element, list[Event]]:
    """An element tree of any text, under a root ``document``, and what was wrong with it."""
    build, errors = ET.TreeBuilder(), []
    build.start("document", {})
    for e in balanced(tokens(text, html), len(text), html):
        if e.kind == "start":
            build.start(e.what, e.attributes)
        elif e.kind == "end":
            build.end(e.what)
        elif e.kind == "text":
            build.data(e.what)
        else:
            errors.append(e)
    build.end("document")
    return build.close(), errors


def parsed(text: str) -> tuple[ET.Element, list[Event]]:
    """The tree of an XML text: by the strict parser where it can be read, else recovered, with what was wrong."""
    try:
        return ET.fromstring(text), []
    except (ET.ParseError, ValueError):
        return recovered(text.lstrip("﻿"))


def text_blocks(text: str, html: bool = True) -> Iterator[tuple[int, str | None, int, str | None, str | None, int | None]]:
    """(seq, path, depth, text, error, at): runs of text between tags with the elements around them, and errors (without a path) where they occur.

    Blanks are made one space, runs of blanks alone are left out.  Streamed: only the open elements are held.
    """
    path: list[str] = []
    seq = 0
    for e in balanced(tokens(text, html), len(text), html):
        if e.kind == "start":
            path.append(e.what)
        elif e.kind == "end":
            path.pop()
        elif e.kind == "error":
            yield seq, None, len(path), None, e.what, e.at
            seq += 1
        elif body := " ".join(e.what.split()):
            yield seq, "/".join(path), len(path), body, None, e.at
            seq += 1


def page_blocks(pages: DataFrame, *, key: str = "page_id", markup: str = "html", html: bool = True) -> DataFrame:
    """(key, seq, path, depth, text, error, at) of pages, by a table function: see :func:`text_blocks`.

    A null page has no rows.  Whatever is wrong with a page, its text is there.
    """

    class Blocks:
        def eval(self, text: str):
            if text is not None:
                yield from text_blocks(text, html)

    blocks = F.udtf(Blocks, returnType="seq int, path string, depth int, text string, error string, at int")
    return pages.select(key, markup).lateralJoin(blocks(F.col(markup).outer())).select(key, "seq", "path", "depth", "text", "error", "at")
