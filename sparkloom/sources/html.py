"""Segments of HTML pages: blocks of text with numbered inline tags.

Scanning markup is sequential inside a page, so pages go through the standard parser in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Content that is not text, elements inside a line, elements without an end.
SKIPPED = frozenset("head script style template pre noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.parts: list[tuple] = []
        self.open: list[str] = []
        self.skip: list[str] = []
        self.block = "body"

    def flush(self) -> None:
        text, number, stack = "", 0, []
        for kind, value in self.parts:
            if kind == "text":
                text += value
            elif kind == "open":
                number += 1
                stack.append((value, number))
                text += f"<{number}>"
            elif kind == "atom":
                number += 1
                text += f"<{number}/>"
            else:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
                if i is not None:
                    for _, n in reversed(stack[i:]):
                        text += f"</{n}>"
                    del stack[i:]
        for _, n in reversed(stack):
            text += f"</{n}>"
        text = re.sub(r"[ \t\r\f]*\n[ \t\r\f]*", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
        # A single pair around everything is no inline markup.
        whole = re.fullmatch(r"<1>((?:(?!</?1>).)*)</1>", text, re.S)
        if whole:
            text = re.sub(r"<(/?)(\d+)(/?)>", lambda m: f"<{m[1]}{int(m[2]) - 1}{m[3]}>", whole[1]).strip()
        if re.search(r"[^\W_]", re.sub(r"</?\d+/?>", "", text)):
            self.out.append((self.block, text))
        self.parts = [("open", t) for t in self.open]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip or tag in SKIPPED:
            if tag in SKIPPED:
                self.skip.append(tag)
            return
        if tag == "br":
            self.parts.append(("text", "\n"))
        elif tag in INLINE:
            self.parts.append(("atom" if tag in EMPTY else "open", tag))
            if tag not in EMPTY:
                self.open.append(tag)
        else:
            self.open = []
            self.flush()
            self.block = tag

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag in INLINE:
            self.parts.append(("close", tag))
            if tag in self.open:
                self.open.remove(tag)
        elif tag not in EMPTY:
            self.open = []
            self.flush()
            self.block = "body"

    def handle_data(self, data: str) -> None:
        if not self.skip:
            # White space between tags is one blank whatever it is; only <br> breaks a line.
            self.parts.append(("text", re.sub(r"[ \t\r\n\f]+", " ", data)))


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of a page's segments, in order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.open = []
    p.flush()
    return p.out


def segments(pages: DataFrame) -> DataFrame:
    """(page_id, no, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, tag, text) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (tag, text) in enumerate(blocks(h))]
            types = [pa.int64(), pa.int32(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "no", "tag", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, no int, tag string, text string")
