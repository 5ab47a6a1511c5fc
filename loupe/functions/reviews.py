"""Review-card scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: trims exactly Python's whitespace set (no
    regex)."""
    return F.trim(c, F.lit(C.PY_WHITESPACE))


def text_lines(text: Column) -> Column:
    """Lines, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip_ws),
                    lambda x: x != "")


RATING_TEXT_PATTERN = C.RATING_TEXT_PATTERN


def rating_from_text(text: Column) -> Column:
    """F19 text stage: the first match of the three alternatives; the
    number is the (only) digit run of the matched text.  One regex pass over
    the text, a second over the short match."""
    m = F.regexp_substr(text, F.lit("(?U)" + RATING_TEXT_PATTERN))
    return F.nullif(F.regexp_extract(F.coalesce(m, F.lit("")), r"(\d+)", 1), F.lit("")) \
        .try_cast("int")


def rating_cascade(star_class: Column, star_icons: Column, text: Column,
                   rating_elem_text: Column) -> Column:
    """class 'star(\\d+)' -> number of star icons -> text patterns ->
    first integer in a rating/score/point element; 0 -> NULL; no clamp."""
    def pos(c):
        return F.when(c > 0, c)
    cls = F.nullif(F.regexp_extract(F.coalesce(star_class, F.lit("")), r"star(\d+)", 1),
                   F.lit("")).try_cast("int")
    elem = F.nullif(F.regexp_extract(F.coalesce(rating_elem_text, F.lit("")), r"(\d+)", 1),
                    F.lit("")).try_cast("int")
    return F.coalesce(pos(cls), pos(star_icons), pos(rating_from_text(text)), pos(elem))


OPTION_PATTERNS = C.OPTION_PATTERNS


def first_match(text: Column, patterns: list, group: int) -> Column:
    """Group of the first pattern that matches (NULL when none does); the
    groups used here are never empty on a match, so '' means no match and
    each pattern is evaluated once.  ``(?U)``: white space is Unicode's, so a
    no-break space counts."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?U)" + p, group), F.lit(""))
                        for p in patterns])


def option_parse(text: Column) -> Column:
    """first option pattern that matches, group 1, stripped."""
    return F.coalesce(strip_ws(first_match(text, OPTION_PATTERNS, 1)), F.lit(""))


SCRUB_PATTERNS = C.SCRUB_PATTERNS


def scrub(text: Column) -> Column:
    """delete report/block boilerplate, then strip."""
    out = text
    for p in SCRUB_PATTERNS:
        out = F.regexp_replace(out, p, "")
    return strip_ws(out)


REVIEW_TYPE_PATTERNS = C.REVIEW_TYPE_PATTERNS


def review_type(text: Column) -> Column:
    """whole match of the first pattern that matches, stripped."""
    return F.coalesce(strip_ws(first_match(text, REVIEW_TYPE_PATTERNS, 0)), F.lit(""))


def _any_kw(line: Column, keywords: list) -> Column:
    cond = F.lit(False)
    for k in keywords:
        cond = cond | line.contains(k)
    return cond


def longest_line(lines: Column, keywords: list | None = None) -> Column:
    """F21 fallback: the longest line among those longer than 30 chars that
    carry a keyword or are longer than 100 (scrubbed); else the longest
    line of all.  Ties go to the first line.  One pass over the lines:
    candidates rank above all other lines, so a single ``array_max`` over
    (is_candidate, length, -index) picks either."""
    kws = keywords if keywords is not None else C.BODY_KEYWORDS
    best = F.array_max(F.transform(lines, lambda l, i: F.struct(
        ((F.length(l) > C.LINE_MIN_CHARS)
         & (_any_kw(l, kws) | (F.length(l) > C.LINE_LONG_CHARS))).alias("c"),
        F.length(l).alias("n"), (-i).alias("p"), l.alias("l"))))
    return F.when(best["c"], strip_ws(F.regexp_replace(best["l"], SCRUB_PATTERNS[0], ""))) \
        .otherwise(best["l"])


def review_body(elem_text: Column, lines: Column, keywords: list | None = None) -> Column:
    """the text element (scrubbed) unless empty or shorter than 20
    chars; then the longest-line fallback."""
    e = scrub(F.coalesce(elem_text, F.lit("")))
    return F.when(F.length(e) >= C.BODY_FALLBACK_BELOW, e).otherwise(
        F.coalesce(longest_line(lines, keywords), F.lit("")))


def notes_from_pairs(dts: Column, dds: Column, k: int = 3) -> Column:
    """i-th dt with i-th dd as 'label: value', first three; both
    arrays are cut to the shorter length first."""
    n = F.least(F.size(dts), F.size(dds))
    return F.slice(F.zip_with(F.slice(dts, 1, n), F.slice(dds, 1, n),
                              lambda a, b: F.concat(a, F.lit(": "), b)), 1, k)


def feature_map(dts, dds) -> Column:
    """All notes as label -> value; the first of a label that
    comes twice."""
    empty = F.array().cast("array<string>")
    dts, dds = F.coalesce(F.col(dts), empty), F.coalesce(F.col(dds), empty)
    n = F.least(F.size(dts), F.size(dds))
    pairs = F.zip_with(F.slice(dts, 1, n), F.slice(dds, 1, n), lambda a, b: F.struct(a.alias("key"), b.alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.slice(dts, 1, n), p["key"]) == i + 1)
    return F.map_from_entries(first)


def notes_from_dictionary(body: str, all_text: str, dictionary=None,
                          k: int = 3, max_chars: int = C.NOTE_MAX_CHARS) -> Column:
    """F25 of two columns, given by name: per label, the first pattern present (case-sensitive) in the
    body or the card text whose case-insensitive search in the body (or the
    card text when the body is empty) succeeds; note = match to end of line,
    stripped, 50 chars.  A note that an earlier label has already does not
    count (the label's next pattern does); first three labels with a note."""
    d = dictionary if dictionary is not None else C.NOTE_DICTIONARY
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    labels = []
    for label, pats in d:
        # a pattern counts when present (case-sensitive) and found by the
        # case-insensitive search; the regex runs only for present patterns
        found = [f"IF(contains(s.body, {quoted(p)}) OR contains(s.all, {quoted(p)}), "
                 + quoted("(?i)\\Q" + p + "\\E[^\\n]*") + ", NULL)" for p in pats]
        labels.append(f"struct({quoted(label)} AS label, array_compact(array({', '.join(found)})) AS patterns)")
    # label by label, the first note that none before has
    note = (f"substring(trim(BOTH {quoted(C.PY_WHITESPACE)} FROM regexp_extract(s.in, p, 0)), 1, {max_chars})")
    fresh = f"get(filter(transform(x.patterns, p -> {note}), n -> n <> '' AND NOT array_contains(acc.notes, n)), 0)"
    step = ("get(transform(array(" + fresh + "), n -> IF(n IS NULL, acc, struct(concat(acc.notes, array(n)) AS notes, "
            "concat(acc.lines, array(concat(x.label, ': ', n))) AS lines))), 0)")
    none = "cast(array() AS array<string>)"
    lines = (f"aggregate(filter(array({', '.join(labels)}), l -> size(l.patterns) > 0), struct({none} AS notes, {none} AS lines), "
             f"(acc, x) -> {step}, acc -> slice(acc.lines, 1, {k}))")
    body, all_text = f"coalesce({body}, '')", f"coalesce({all_text}, '')"
    source = f"struct({body} AS body, {all_text} AS all, IF({body} <> '', {body}, {all_text}) AS in)"
    return F.expr(f"get(transform(array({source}), s -> {lines}), 0)")


def text_cap(text: Column, cap: int = C.TEXT_CAP_CHARS, min_len: int = C.TEXT_MIN_CHARS) -> Column:
    """F14 usage / precautions: strip, cut at 1,000, '' when shorter than 10."""
    t = F.substring(strip_ws(F.coalesce(text, F.lit(""))), 1, cap)
    return F.when(F.length(t) < min_len, F.lit("")).otherwise(t)


def ingredients_cap(text: Column, cap: int = C.INGREDIENT_CAP_CHARS,
                    min_len: int = C.INGREDIENT_MIN_CHARS) -> Column:
    """F14 ingredients: drop a leading '1. word' label, '' when shorter than
    20, else cut at 2,000 and strip."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\d+\.\s*\w+", "")
    return F.when(F.length(t) < min_len, F.lit("")).otherwise(strip_ws(F.substring(t, 1, cap)))


def card_ok(card_text: Column, min_chars: int = C.CARD_MIN_CHARS) -> Column:
    """At least 20 chars of card text."""
    return F.length(F.coalesce(card_text, F.lit(""))) >= min_chars


def body_ok(body: Column, min_chars: int = C.BODY_MIN_CHARS) -> Column:
    """Body longer than 10 chars."""
    return F.length(F.coalesce(body, F.lit(""))) > min_chars
