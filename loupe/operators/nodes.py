"""SQL expressions over a page's flat node table (``sources.facts``).

An element is a struct of numbers, so "inside", "next sibling" and "text of"
are slices and look-ups by place, never walks: what is inside ``e`` is the
slice from ``e.at + 1`` to ``e.last``, its text the slice ``t0`` to ``t1`` of
the page's text nodes.  A part of a page (one review card) is a ``Page`` of its
own whose arrays begin at other places.

Rules nest array functions several deep, so they are written as SQL text and
become a Column by ``F.expr`` once each: the names of the lambda variables say
which element is meant, and a rule costs the driver one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

Rule = Callable[[str], str]
_names = count()


def name() -> str:
    """A lambda variable that no other has."""
    return f"v{next(_names)}"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Rule) -> str:
    """``body`` of a value that is computed once."""
    v = name()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


class Page:
    """``nodes`` and ``texts`` of a page or a part of one (SQL); the first of
    the arrays' entries have the places ``n0``, ``x0`` and ``w0`` (raw text)."""

    def __init__(self, facts: str = "facts", *, nodes: str | None = None, texts: str | None = None, raw: str | None = None,
                 n0: str = "0", x0: str = "0", w0: str = "0"):
        self.nodes, self.texts, self.strings = nodes or f"{facts}.nodes", texts or f"{facts}.texts", raw or f"{facts}.raw"
        self.n0, self.x0, self.w0 = n0, x0, w0

    # -- choosing elements
    def all(self, rule: Rule) -> str:
        v = name()
        return f"filter({self.nodes}, {v} -> {rule(v)})"

    def first(self, rule: Rule) -> str:
        return f"get({self.all(rule)}, 0)"

    def each(self, rule: Rule, of: Rule) -> str:
        """An array: ``of`` each element of the rule."""
        v = name()
        return f"transform({self.all(rule)}, {v} -> {of(v)})"

    def of_first(self, rule: Rule, of: Rule) -> str:
        """``of`` the rule's first element (NULL: there is none)."""
        v = name()
        return f"get(transform(slice({self.all(rule)}, 1, 1), {v} -> {of(v)}), 0)"

    def first_text(self, rule: Rule, sep: str = "") -> str:
        return self.of_first(rule, lambda e: self.text(e, sep))

    def at(self, place: str) -> str:
        """The element at a place (NULL: none, or not in this part)."""
        return f"get({self.nodes}, {place} - {self.n0})"

    def inside(self, e: str) -> Page:
        """What stands inside ``e``; nothing for a NULL element."""
        return Page(nodes=f"slice({self.nodes}, {e}.at - {self.n0} + 2, {e}.last - {e}.at)", texts=self.texts, raw=self.strings,
                    n0=f"({e}.at + 1)", x0=self.x0, w0=self.w0)

    # -- siblings
    def next(self, e: str) -> str:
        return self.at(f"{e}.next")

    def next_with_tag(self, e: str, tag: str) -> str:
        """The first later sibling with the tag.  Mostly that is the next one
        or, after a run of one's own tag, the one after the run; only else all
        elements are looked through."""
        near, turn = self.at(f"{e}.next"), self.at(f"{e}.turn")
        later = self.first(lambda n: f"{n}.parent = {e}.parent AND {n}.at > {e}.at AND {n}.tag = '{tag}'")
        return f"CASE WHEN {near}.tag = '{tag}' THEN {near} WHEN {turn}.tag = '{tag}' THEN {turn} WHEN {turn} IS NOT NULL THEN {later} END"

    # -- text
    def text(self, e: str, sep: str = "") -> str:
        """The visible text nodes inside ``e``, stripped and joined."""
        return f"array_join(slice({self.texts}, {e}.t0 - {self.x0} + 1, {e}.t1 - {e}.t0), {quoted(sep)})"

    def raw(self, e: str) -> str:
        """The same as it stands."""
        return f"array_join(slice({self.strings}, {e}.r0 - {self.w0} + 1, {e}.r1 - {e}.r0), '')"

    def whole(self, sep: str = "\n") -> str:
        return f"array_join({self.texts}, {quoted(sep)})"


def first_of(values: str, keep: Rule) -> str:
    v = name()
    return f"get(filter({values}, {v} -> {keep(v)}), 0)"


# -- rules
def tagged(*tags: str) -> Rule:
    if len(tags) == 1:
        return lambda n: f"{n}.tag = '{tags[0]}'"
    return lambda n: f"{n}.tag IN ({', '.join(map(quoted, tags))})"


def classed(pattern: str) -> Rule:
    """A class that matches, letter case aside."""
    return lambda n: f"({n}.cls <> '' AND {n}.cls RLIKE {quoted('(?i)' + pattern)})"


def class_word(word: str) -> Rule:
    """One of the element's classes is the word."""
    return lambda n: f"array_contains(split({n}.cls, '\\\\s+'), {quoted(word)})"


def class_holds(text: str) -> Rule:
    return lambda n: f"contains({n}.cls, {quoted(text)})"


def both(*rules: Rule) -> Rule:
    return lambda n: "(" + " AND ".join(r(n) for r in rules) + ")"


def attr(e: str, key: str) -> str:
    """An attribute's value (NULL: none)."""
    return f"try_element_at({e}.attrs, {quoted(key)})"


def has_attr(key: str) -> Rule:
    return lambda n: f"map_contains_key({n}.attrs, {quoted(key)})"


def any_contains(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"
