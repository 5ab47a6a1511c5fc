"""E0 — page facts: the one Python (Arrow) stage.

Each page's HTML is read once, inside ``mapInArrow``, with the
standard-library ``HTMLParser``, and comes back as a flat table of nodes: one
struct an element, in document order.  An element's place in that order
(``at``) and the place of its last descendant (``last``) say what is inside
what; ``parent``, ``next`` (the next sibling element) and ``turn`` (the next
sibling with another tag) are places as well.  ``t0`` and ``t1`` bound the
element's visible text in the page's array of text nodes.  Python chooses
nothing: every rule (which heading, which price, what is a review card) is
Column code over these numbers (``operators.nodes``, ``operators.extract``).

Only ``(key columns, html)`` cross into Python.  Pages are independent, so the
stage scales with the number of tasks; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import config as C

_S, _I = T.StringType(), T.IntegerType()

NODE = T.StructType(
    [T.StructField(c, _I) for c in ("at", "last", "parent", "next", "turn", "t0", "t1", "r0", "r1", "b0", "b1")]
    + [T.StructField("tag", _S), T.StructField("cls", _S), T.StructField("own", _S),
       T.StructField("attrs", T.MapType(_S, _S))])

FACTS = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("texts", T.ArrayType(_S)),   # visible text nodes, stripped, without empty ones
    T.StructField("raw", T.ArrayType(_S)),     # the same unstripped, and
    T.StructField("html", T.BinaryType()),     # the page itself: only where cards are asked for
    T.StructField("error", _S),                # what ended the parsing early, if anything did
])

#: A frame of results ends after so many pages or bytes of HTML.
FACTS_SLICE, FACTS_BYTES = 256, 8 << 20

_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                   "param", "source", "track", "wbr"})
_HIDDEN = frozenset({"script", "style", "template", "noscript"})

# Markup that every parser reads alike: tags with well-formed attributes,
# comments without "--" inside, a doctype.
_PLAIN = re.compile(
    r"""<(?:([a-zA-Z][a-zA-Z0-9:-]*)((?:\s++[^\s"'<>/=&]++(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+(?=[\s>])))?)*)\s*(/?)>"""
    r"""|/([a-zA-Z][a-zA-Z0-9:-]*)\s*>|!--(?:(?!--)[^>])*-->|![dD][oO][cC][tT][yY][pP][eE][^<>]*>)""")
_ATTR = re.compile(r"""([^\s"'<>/=&]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`/]+))?""")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}


@lru_cache(maxsize=4096)
def _attributes(written: str) -> dict:
    """Attributes by name; pages repeat them, so nobody may change the dict."""
    out = {}
    for name, value in _ATTR.findall(written):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        elif not value:
            value = None
        out[name.lower()] = unescape(value) if value and "&" in value else value
    return out


class Nodes:
    """A page's elements as columns: one entry an element in each list.
    Markup may nest to any depth.  ``spans``: note where in the page each
    element stands."""

    def __init__(self, html: str, spans: bool):
        self.html, self.spans, self.error = html, spans, None
        self._reset()
        if not self._plain():
            self._reset()
            self._lenient()
        self._text()
        while self._open:
            self._shut(len(html))

    def _reset(self):
        self.tag, self.attrs, self.parent, self.last, self.own = [], [], [], [], {}
        self.r0, self.r1, self.b0, self.b1, self.raw = [], [], [], [], []
        self._open, self._count, self._data, self._hidden = [], {}, [], 0

    # -- the tree
    def start(self, tag: str, attrs: dict | None, place: int, end: int, closed: bool):
        if self._data:
            self._text()
        at, n = len(self.tag), len(self.raw)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._open[-1] if self._open else -1)
        self.last.append(at)
        self.r0.append(n)
        self.r1.append(n)
        if self.spans:
            self.b0.append(place)
            self.b1.append(end)
        if not closed and tag not in _VOID:
            self._open.append(at)
            self._count[tag] = self._count.get(tag, 0) + 1
            if tag in _HIDDEN:
                self._hidden += 1

    def end(self, tag: str, place: int, end: int):
        if self._data:
            self._text()
        if self._count.get(tag):
            while self.tag[self._open[-1]] != tag:
                self._shut(place)
            self._shut(end)

    def _shut(self, place: int):
        at = self._open.pop()
        tag = self.tag[at]
        self._count[tag] -= 1
        if tag in _HIDDEN:
            self._hidden -= 1
        self.last[at], self.r1[at] = len(self.tag) - 1, len(self.raw)
        if self.spans:
            self.b1[at] = place

    def data(self, said: str):
        self._data.append(said)

    def _text(self):
        """What was read since the last tag is one text node."""
        said = "".join(self._data)
        self._data.clear()
        if not self._hidden:
            if said:
                self.raw.append(said)
        elif self.tag[self._open[-1]] in _HIDDEN:
            self.own[self._open[-1]] = self.own.get(self._open[-1], "") + said

    # -- reading
    def _plain(self) -> bool:
        """The page, if all its markup is of the plain kind; False at the first
        that is not."""
        html, at, n = self.html, 0, len(self.html)
        find, match = html.find, _PLAIN.match
        while at < n:
            lt = find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                said = html[at:lt]
                self._data.append(unescape(said) if "&" in said else said)
            if lt == n:
                return True
            m = match(html, lt)
            if m is None:
                return False
            at = m.end()
            tag, attrs, closed, ended = m.groups()
            if tag:
                tag = tag.lower()
                self.start(tag, _attributes(attrs) if attrs else None, lt, at, bool(closed))
                if tag in _ENDS and not closed:
                    close = _ENDS[tag].search(html, at)
                    if close is None:
                        return False
                    if close.start() > at:
                        self._data.append(html[at:close.start()])
                    self.end(tag, close.start(), close.end())
                    at = close.end()
            elif ended:
                self.end(ended.lower(), lt, at)
            else:  # a comment or doctype
                self._text()
        return True

    def _lenient(self):
        """The page as the standard library's parser reads it."""
        parser = _Lenient(self)
        try:
            parser.feed(self.html)
            parser.close()
        except Exception as e:  # what was read so far is kept, with the reason
            self.error = f"{type(e).__name__}: {e}"[:200]

    def samples(self) -> tuple[list[int], list[int]]:
        """Bytes of the page at which each element's sample (its first
        ``TEXT_CAP_CHARS`` characters) begins and ends."""
        ends = [min(b, a + C.TEXT_CAP_CHARS) for a, b in zip(self.b0, self.b1)]
        if self.html.isascii():
            return self.b0, ends
        point = np.frombuffer(self.html.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = np.concatenate([[0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))])
        return width[self.b0].tolist(), width[ends].tolist()


class _Lenient(HTMLParser):
    def __init__(self, nodes: Nodes):
        super().__init__(convert_charrefs=True)
        self.nodes = nodes
        self.handle_data = nodes.data
        self._lines = [0, *accumulate(len(x) + 1 for x in nodes.html.split("\n"))] if nodes.spans else None

    def _place(self) -> int:
        """Where in the page the parser stands."""
        if self._lines is None:
            return 0
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _start(self, tag, attrs, closed):
        place = self._place()
        self.nodes.start(tag, dict(attrs) or None, place, place + len(self.get_starttag_text() or ""), closed)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, True)

    def handle_endtag(self, tag):
        place = self._place()
        end = self.nodes.html.find(">", place) + 1 if self._lines else 0
        self.nodes.end(tag, place, end or len(self.nodes.html))

    def handle_comment(self, data):
        self.nodes._text()

    handle_decl = handle_comment


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]) if len(lengths) else [0], pa.int32())


def siblings(parent: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place of its next sibling, and of the next one
    with another tag; -1: none.  ``parent`` tells all parents apart."""
    order = np.argsort(parent, kind="stable")
    p, t, n = parent[order], tag[order], len(parent)
    following, turn = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    if n:
        same = np.flatnonzero(p[1:] == p[:-1])
        following[order[same]] = at[order[same + 1]]
        bounds = np.append(np.flatnonzero((p[1:] != p[:-1]) | (t[1:] != t[:-1])) + 1, n)
        after = bounds[np.searchsorted(bounds, np.arange(n), "right")]
        inside = np.flatnonzero(after < n)
        inside = inside[p[after[inside]] == p[inside]]
        turn[order[inside]] = at[order[after[inside]]]
    return following, turn


def _arrow(pages: list[Nodes], cards: bool) -> pa.StructArray:
    """The pages' nodes as one Arrow column, without a Python object a node."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    base = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(pages)), sizes)
    join = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    tags = [x for p in pages for x in p.tag]
    at, parent, r0, r1 = np.arange(len(tags)) - base[of], join("parent"), join("r0"), join("r1")
    codes: dict[str, int] = {}
    code = np.array([codes.setdefault(t, len(codes)) for t in tags], np.int64)
    following, turn = siblings(np.where(parent < 0, -1 - of, parent + base[of]), code, at)
    # of the text nodes, those that are not empty once stripped
    stripped = [s.strip() for p in pages for s in p.raw]
    raws = np.array([len(p.raw) for p in pages], np.int64)
    first = np.cumsum(raws) - raws
    before = np.concatenate([[0], np.cumsum([bool(s) for s in stripped])]).astype(np.int64)
    t0, t1 = (before[r + first[of]] - before[first[of]] for r in (r0, r1))
    if cards:
        spans = [p.samples() for p in pages]
        b0, b1 = (np.array([x for s in spans for x in s[i]], np.int64) for i in (0, 1))
    else:
        b0 = b1 = np.zeros(len(tags), np.int64)
    whole = {"at": at, "last": join("last"), "parent": parent, "next": following, "turn": turn, "t0": t0, "t1": t1, "r0": r0, "r1": r1, "b0": b0, "b1": b1}
    columns = [pa.array(whole[f.name].astype(np.int32), mask=(whole[f.name] < 0) if f.name in ("next", "turn") else None)
               for f in NODE.fields if f.dataType == _I]
    attrs = [a or {} for p in pages for a in p.attrs]
    own = [p.own.get(i) for p in pages for i in range(len(p.tag))] if any(p.own for p in pages) else pa.nulls(len(tags), pa.string())
    pairs = pa.MapArray.from_arrays(_offsets([len(a) for a in attrs]), pa.array([k for a in attrs for k in a], pa.string()),
                                    pa.array([v for a in attrs for v in a.values()], pa.string()))
    columns += [pa.array(tags, pa.string()), pa.array([a.get("class") or "" for a in attrs], pa.string()),
                own if isinstance(own, pa.Array) else pa.array(own, pa.string()), pairs]
    nodes = pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays(columns, [f.name for f in NODE.fields]))
    said = before[np.append(first, len(stripped))]
    texts = pa.ListArray.from_arrays(pa.array(said, pa.int32()), pa.array([s for s in stripped if s], pa.string()))
    raw = pa.array([p.raw if cards else None for p in pages], pa.list_(pa.string()))
    html = pa.array([p.html.encode("utf-8", "replace") if cards else None for p in pages], pa.binary())
    return pa.StructArray.from_arrays([nodes, texts, raw, html, pa.array([p.error for p in pages], pa.string())], [f.name for f in FACTS.fields])


def page_facts(pages: DataFrame, *, html: str = "html", keys: list | None = None,
               passthrough: list | None = None, cards: bool = False) -> DataFrame:
    """(keys..., html) -> (keys..., passthrough..., facts).  Only the key
    columns and the HTML are shipped to Python; ``passthrough`` columns
    (e.g. url, or features computed from the raw HTML in the JVM before this
    stage) ride along unchanged, so no join back to the pages is needed.
    ``cards``: bring what only the rules for review cards read."""
    keys = list(keys or ["page_id"])
    carry = keys + [c for c in (passthrough or []) if c not in keys]
    src = pages.select(*carry, html)
    out_schema = T.StructType([src.schema[k] for k in carry] + [T.StructField("facts", FACTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # results leave in slices, so the nodes of one Arrow batch of large
        # pages never sit in memory at once
        for batch in batches:
            column, done, size = batch.column(len(carry)), [], 0
            for i in range(batch.num_rows):
                text = column[i].as_py()
                done.append(Nodes(text or "", cards))
                size += len(text or "")
                if len(done) == FACTS_SLICE or size >= FACTS_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(i + 1 - len(done), len(done))
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(carry)], _arrow(done, cards)], [*carry, "facts"])
                    done, size = [], 0

    return src.mapInArrow(run, out_schema)
