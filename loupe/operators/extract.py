"""Column rules over page facts (``sources.facts.FACTS``, a flat node
table a page) or raw HTML.  Everything here is JVM-side: a rule chooses
elements with array functions over their tags, classes and places
(``operators.nodes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.prices import NUM, parse_number
from ..functions.reviews import strip_ws
from .nodes import (Page, any_contains, attr, both, class_holds, class_word, classed, first_of, has_attr, let, name,
                    quoted, tagged)


def unparsed(df: DataFrame, facts="facts", keys=("page_id",)) -> DataFrame:
    """The pages whose markup ended the parsing early, with the reason; their
    facts hold what came before it."""
    return df.filter(F.col(f"{facts}.error").isNotNull()).select(*keys, F.col(f"{facts}.error").alias("error"))


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _sql_nz(value: str) -> str:
    return f"nullif({value}, '')"


# ---------------------------------------------------------------- E1, E2, E3, D4

def title(facts="facts") -> Column:
    return F.expr(Page(facts).first_text(tagged("title")))


def h1(facts="facts") -> Column:
    """Text of the first h1."""
    return F.expr(Page(facts).first_text(tagged("h1")))


def page_text(facts="facts") -> Column:
    """The page's visible text, a line a text node."""
    return F.expr(Page(facts).whole("\n"))


def links(facts="facts") -> Column:
    """Array of struct(href, text), one an anchor, in page order."""
    p = Page(facts)
    return F.expr(p.each(tagged("a"), lambda e: f"struct(coalesce({attr(e, 'href')}, '') AS href, {p.text(e)} AS text)"))


def scripts(facts="facts") -> Column:
    return F.expr(f"array_join({Page(facts).each(tagged('script'), lambda e: f'coalesce({e}.own, {quoted(str())})')}, {quoted(chr(10))})")


def explode_links(df: DataFrame, facts="facts", keys=("page_id",)) -> DataFrame:
    """One row per anchor, in page order."""
    return df.select(*keys, F.posexplode(links(facts)).alias("pos", "link")) \
        .select(*keys, "pos", F.col("link.href").alias("href"), F.col("link.text").alias("text"))


def absolute_product_link(href: Column, base: str = C.DEFAULT_SITE_BASE,
                          must_contain: str = C.PRODUCT_PATH) -> Column:
    """E3: '' dropped; '/x' -> base + '/x'; other non-http dropped; must
    contain the product-detail path (NULL = dropped)."""
    h = F.coalesce(href, F.lit(""))
    absu = (F.when(h == "", F.lit(None).cast("string"))
             .when(h.startswith("/"), F.concat(F.lit(base), h))
             .when(h.startswith("http"), h))
    return F.when(absu.contains(must_contain), absu)


# ---------------------------------------------------------------- E4-E7

def breadcrumb_categories(facts="facts") -> Column:
    """struct(category, sub_category): with >= 2 crumbs (the links in the
    first element of a breadcrumb class) the last but one and the last; else
    the meta 'category' content."""
    p = Page(facts)

    def crumbs(e: str) -> str:
        trail = p.inside(e)
        return f"array_remove({trail.each(tagged('a'), trail.text)}, '')"

    meta = _meta_sql(facts, C.META_CATEGORY_PROPERTY)
    return F.expr(let(p.of_first(classed(C.CLASS_BREADCRUMB), crumbs), lambda c: (
        f"struct(coalesce(get({c}, size({c}) - 2), {meta}, '') AS category, "
        f"coalesce(IF(size({c}) >= 2, get({c}, size({c}) - 1), NULL), '') AS sub_category)")))


def _meta_sql(facts: str, pattern: str) -> str:
    return _sql_nz(Page(facts).of_first(
        lambda n: f"{n}.tag = 'meta' AND coalesce({attr(n, 'property')}, '') RLIKE {quoted('(?i)' + pattern)}", lambda e: attr(e, "content")))


def meta_content(facts, pattern: str) -> Column:
    """E5: content of the first meta whose property matches (i)."""
    return F.expr(_meta_sql(facts, pattern))


def data_attr(facts, names=tuple(C.DATA_CODE_ATTRS)) -> Column:
    """First present data attribute, in order (of the first element that
    has it)."""
    p = Page(facts)
    return F.expr(f"coalesce({', '.join(_sql_nz(p.of_first(has_attr(a), lambda e, a=a: attr(e, a))) for a in names)}, NULL)")


SCRIPT_CODE = C.SCRIPT_CODE_PATTERN


def script_var(facts, pattern: str = SCRIPT_CODE) -> Column:
    """First regex hit in the page's script text."""
    return _nz(F.regexp_extract(F.coalesce(scripts(facts), F.lit("")), pattern, 1))


# ---------------------------------------------------------------- E8-E12

def _dl_sql(facts: str, keywords: list, min_len: int, sep: str) -> str:
    p = Page(facts)
    values = p.each(lambda n: f"{n}.tag = 'dt' AND {any_contains(p.text(n), keywords)}",
                    lambda e: let(p.next_with_tag(e, "dd"), lambda d: p.text(d, sep)))
    return first_of(values, lambda v: f"length({v}) > {min_len}")


def dl_value(facts, keywords: list, min_len: int = C.TEXT_MIN_CHARS, sep: str = "\n") -> Column:
    """Dd of the first dt containing a keyword whose value is longer
    than ``min_len`` (the length guard sits inside the candidate)."""
    return F.expr(_dl_sql(facts, keywords, min_len, sep))


def th_td_value(facts, keywords: list, min_len: int = C.TEXT_MIN_CHARS) -> Column:
    """Same over table rows (first th / first td)."""
    p = Page(facts)

    def row(e: str) -> str:
        cells = p.inside(e)
        head = f"coalesce({any_contains(cells.first_text(tagged('th')), keywords)}, false)"
        return f"IF({head}, {cells.first_text(tagged('td'), chr(10))}, NULL)"

    return F.expr(first_of(p.each(tagged("tr"), row), lambda v: f"length({v}) > {min_len}"))


def keyword_after(text: Column, keywords: list, cap: int = C.TEXT_CAP_CHARS,
                  min_len: int = C.TEXT_MIN_CHARS) -> Column:
    """Text after the first keyword (in keyword order), leading ':' and
    whitespace dropped, first line, 1,000 chars; longer than ``min_len``."""
    cands = []
    for k in keywords:
        v = F.substring(strip_ws(F.regexp_extract(text, "(?i)\\Q" + k + "\\E[:\\s]*([^\\n]*)", 1)),
                        1, cap)
        cands.append(F.when(text.contains(k) & (F.length(v) > min_len), v))
    return F.coalesce(*cands)


def heading_block(facts, keywords: list, min_len: int = C.TEXT_MIN_CHARS) -> Column:
    """Block after the first h2-h4 containing a keyword: its next
    sibling, else (there being none) its parent's next sibling."""
    p = Page(facts)
    blocks = p.each(lambda n: f"{n}.tag IN ('h2', 'h3', 'h4') AND {any_contains(p.text(n), keywords)}",
                    lambda h: let(f"coalesce({p.next(h)}, {p.next(p.at(h + '.parent'))})", lambda b: p.text(b, "\n")))
    return F.expr(first_of(blocks, lambda b: f"length({b}) > {min_len}"))


INGREDIENT_TEXT = C.INGREDIENT_TEXT_PATTERN


def _names_ingredients(text: str) -> str:
    return "(" + " AND ".join(f"contains({text}, {quoted(w)})" for w in C.INGREDIENT_HEADING_WORDS) + ")"


def _longer(value: str, n: int) -> str:
    v = name()
    return f"get(filter(array({value}), {v} -> length({v}) > {n}), 0)"


def _after(whole: str, head: str) -> str:
    """What follows ``head`` in ``whole``, if it is long enough."""
    def rest(t: str) -> str:
        return f"IF(position({t}.h IN {t}.w) > 0, trim(BOTH {quoted(C.PY_WHITESPACE)} FROM substring({t}.w, position({t}.h IN {t}.w) + length({t}.h))), NULL)"
    return _longer(let(f"struct({whole} AS w, {head} AS h)", rest), 20)


def ingredients(facts) -> Column:
    """The h4 naming both the cosmetics act and ingredients -> next
    sibling (> 20) -> first of the parent's later siblings (> 50) -> parent
    text after the h4 (> 20); then a 'dt' with an ingredient keyword; then
    the first section ``div`` that names both, its text after its first h4
    (> 20); then a text pattern."""
    p = Page(facts)

    def around(h: str) -> str:
        beside = let(p.next(h), lambda e: p.text(e, " "))
        later = let(p.at(f"{h}.parent"), lambda q: first_of(
            p.each(lambda n: f"{n}.parent = {q}.parent AND {n}.at > {q}.at", lambda e: p.text(e, " ")), lambda t: f"length({t}) > 50"))
        above = let(p.at(f"{h}.parent"), lambda q: p.text(q, " "))
        return f"coalesce({_longer(beside, 20)}, {later}, {_after(above, p.text(h))})"

    def section(e: str) -> str:
        return _after(p.text(e, " "), p.inside(e).first_text(tagged("h4")))

    sections = p.each(lambda n: f"{both(tagged('div'), classed(C.CLASS_SECTION))(n)} AND {_names_ingredients(p.text(n))}", section)
    return F.expr("coalesce(" + ", ".join([
        p.of_first(lambda n: f"{n}.tag = 'h4' AND {_names_ingredients(p.text(n))}", around),
        _dl_sql(facts, C.INGREDIENT_DT_KEYWORDS, 20, " "),
        first_of(sections, lambda t: f"{t} IS NOT NULL"),
        _sql_nz(f"regexp_extract(coalesce({p.whole()}, ''), {quoted(INGREDIENT_TEXT)}, 1)")]) + ")")


# ---------------------------------------------------------------- E13-E16, E19

def _first_number(p: Page, rule, pattern: str) -> str:
    """The pattern's group in the first element of the rule that has it; the
    ones without do not end the search."""
    return first_of(p.each(rule, lambda e: f"regexp_extract({p.text(e)}, {quoted(pattern)}, 1)"), lambda v: f"{v} <> ''")


def strike_price(facts) -> Column:
    """Price in the first struck-through element that has one: elements
    of the tags, then of the style, then of a class original/old/strike, then
    of any class with strike/del/original/old in it."""
    p = Page(facts)
    rules = [tagged("s", "strike", "del"), lambda n: f"contains({attr(n, 'style')}, 'line-through')",
             lambda n: any_contains(f"{n}.cls", C.STRUCK_CLASSES), classed(C.CLASS_STRIKE)]
    return parse_number(F.expr(f"coalesce({', '.join(_first_number(p, r, '(' + NUM + ')원') for r in rules)})"))


def class_price(facts, html: Column | None = None) -> Column:
    """struct(discount, price) from priceBox-like classes; else the
    text pattern 'N% price원' in the page."""
    told = lambda pattern: F.expr(f"coalesce({Page(facts).first_text(classed(pattern))}, '')")
    text = F.coalesce(html if html is not None else page_text(facts), F.lit(""))
    pat = C.DISCOUNT_PRICE_TEXT_PATTERN
    return F.struct(
        F.coalesce(_nz(F.regexp_extract(told(C.CLASS_DISCOUNT), r"(\d+)%", 1)),
                   _nz(F.regexp_extract(text, pat, 1))).try_cast("int").alias("discount"),
        F.coalesce(parse_number(_nz(F.regexp_extract(told(C.CLASS_PRICE), "(" + NUM + ")", 1))),
                   parse_number(_nz(F.regexp_extract(text, pat, 2)))).alias("price"))


RATING_PATTERNS = C.PAGE_RATING_PATTERNS


def rating_from_html(html: Column) -> Column:
    """E15 raw-page part: first of the rating patterns over the raw HTML
    (computed in the JVM before the HTML stage, carried through it)."""
    return F.coalesce(*[_nz(F.regexp_extract(html, p, 1)) for p in RATING_PATTERNS])


def page_rating(facts, raw_rating: Column) -> Column:
    """First 'd.d' in an element of a rating/star/score class; else the
    raw-page patterns (``rating_from_html``)."""
    return F.coalesce(F.expr(_first_number(Page(facts), classed(C.CLASS_PAGE_RATING), r"(\d+\.\d+)")), raw_rating)


REVIEW_COUNT_PATTERNS = C.REVIEW_COUNT_PATTERNS


def page_review_count(html: Column) -> Column:
    """First of 'review N', 'later-review N', else the first '(N)'
    anywhere in the raw page (which also hits script calls)."""
    return F.coalesce(*[parse_number(_nz(F.regexp_extract(html, p, 1)))
                        for p in REVIEW_COUNT_PATTERNS])


DECLARED_PATTERNS = C.DECLARED_COUNT_PATTERNS


def declared_count(text: Column) -> Column:
    """First of four 'N items' patterns."""
    return F.coalesce(*[_nz(F.regexp_extract(text, p, 1)) for p in DECLARED_PATTERNS]) \
        .try_cast("long")


# ---------------------------------------------------------------- E17, E18

def listing_name(facts, url: Column) -> Column:
    """h1 -> brand-name class -> logo alt -> title cut at '-' then '|'
    -> id from the URL -> 'unknown'; trailing logo / brand-hall words cut."""
    p = Page(facts)

    def clean(c):
        for cut in C.LISTING_NAME_CUTS:
            c = F.regexp_replace(c, "(?U)" + cut, "")
        return strip_ws(c)
    logo = F.expr(p.of_first(lambda n: f"{n}.tag = 'img' AND {attr(n, 'alt')} RLIKE {quoted('(?i)' + C.LOGO_ALT_PATTERN)}", lambda e: attr(e, "alt")))
    brand_name = F.expr(p.first_text(classed(C.CLASS_BRAND_NAME)))
    head = clean(strip_ws(F.split(F.split(F.coalesce(title(facts), F.lit("")), "-")[0], r"\|")[0]))
    brand = F.regexp_extract(url, C.BRAND_PAGE_PARAM + "=([^&]*)", 1)
    cat = F.regexp_extract(url, C.CATEGORY_PAGE_PARAM + "=([^&]*)", 1)
    return F.coalesce(
        _nz(clean(F.coalesce(h1(facts), F.lit("")))),
        _nz(clean(F.coalesce(brand_name, F.lit("")))),
        _nz(clean(F.coalesce(logo, F.lit("")))),
        _nz(head),
        F.when(url.contains(C.BRAND_PAGE_PARAM + "="), F.concat(F.lit("brand_"), brand)),
        F.when(url.contains(C.CATEGORY_PAGE_PARAM + "="), F.concat(F.lit("category_"), cat)),
        F.lit("unknown"))


def page_kind(url: Column, category_token: str = C.CATEGORY_PAGE_PARAM,
              brand_token: str = C.BRAND_PAGE_PARAM) -> Column:
    """Category / brand / product list from the URL."""
    return (F.when(url.contains(category_token), F.lit("category"))
             .when(url.contains(brand_token), F.lit("brand")).otherwise(F.lit("product list")))


# ---------------------------------------------------------------- E20, E21

def _card_text_sql(text: str) -> str:
    return (f"({text} RLIKE {quoted('(?U)' + C.CARD_FALLBACK_PATTERN)} AND length({text}) > 50 "
            f"AND ({text} RLIKE {quoted(C.CARD_FALLBACK_HINT)} OR length({text}) > 100))")


def card_text(text: str) -> Column:
    """Text (a column's name) that reads like a review card."""
    return F.expr(_card_text_sql(text))


def card_rules() -> list:
    """(name, rule) in the order in which they are tried; the first rule
    that any element meets gives the page's cards."""
    word = C.CARD_CLASS
    return [
        (f"class={word}", class_word(word)), (f"class~{word}", class_holds(word)),
        *((f"class~/{p}/i", classed(p)) for p in C.CARD_CLASS_PATTERNS),
        ("class~review-kw", lambda n: any_contains(f"lower({n}.cls)", C.CARD_KEYWORDS)),
        ("data-review", has_attr("data-review")),
        ("id~/review/i", lambda n: f"{attr(n, 'id')} RLIKE {quoted('(?i)' + C.CARD_ID_PATTERN)}"),
    ]


def found_cards(facts="facts") -> Column:
    """struct(rule, cards) of a page, each card with its own part of the
    page's arrays; NULL without cards."""
    p, rules = Page(facts), card_rules()

    def met(n: str) -> str:
        """The number of the first rule that the element meets, and the element."""
        which = " ".join(f"WHEN {rule(n)} THEN {i}" for i, (_, rule) in enumerate(rules))
        return f"struct(CASE {which} END AS rule, {n} AS el)"

    def part(e: str) -> str:
        return (f"struct({e} AS el, slice({p.nodes}, {e}.at + 1, {e}.last - {e}.at + 1) AS nodes, "
                f"slice({p.texts}, {e}.t0 + 1, {e}.t1 - {e}.t0) AS texts, "
                f"cast(substring({facts}.html, {e}.b0 + 1, {e}.b1 - {e}.b0) AS string) AS sample)")

    def cards(ranked: str) -> str:
        # what meets the least rule met on the page meets none before it
        r, s, e = name(), name(), name()
        return let(f"array_min(transform({ranked}, {r} -> {r}.rule))", lambda least: (
            f"IF({least} IS NOT NULL, struct(get(array({', '.join(quoted(n) for n, _ in rules)}), {least}) AS rule, "
            f"transform(filter({ranked}, {s} -> {s}.rule = {least}), {e} -> {part(e + '.el')}) AS cards), {by_text})"))

    found = p.each(lambda n: f"{n}.tag IN ({', '.join(map(quoted, C.CARD_TEXT_TAGS))}) AND {let(p.raw(n), _card_text_sql)}", part)
    by_text = let(found, lambda c: f"IF(size({c}) > 0, struct('text-pattern' AS rule, {c} AS cards), NULL)")
    tags = ", ".join(map(quoted, C.CARD_TAGS))
    return F.expr(let(p.each(lambda n: f"{n}.tag IN ({tags}) AND NOT {class_holds(C.CARD_EXCLUDE_CLASS)(n)}", met), cards))


def card_fields(card: str) -> list[Column]:
    """The fields of one card (a column, an entry of ``found_cards``) before
    any parsing."""
    el = f"{card}.el"
    own = Page(nodes=f"{card}.nodes", texts=f"{card}.texts", n0=f"{el}.at", x0=f"{el}.t0")
    p = own.inside(el)
    icon = both(tagged("i"), classed(C.CLASS_STAR_ICON))
    wrap, style = both(tagged("div"), classed(C.CLASS_STAR_WRAP)), both(tagged("div"), classed(C.CLASS_REVIEW_NOTES))
    is_txt = class_word("txt")
    bodies = [both(tagged("p"), is_txt), both(tagged("p"), class_holds("txt")), both(tagged("div"), is_txt),
              both(tagged("p", "div"), classed(C.CLASS_REVIEW_BODY))]

    def named(pattern: str, fallback: str) -> str:
        """Text of the first span of the class, else of any element of it; an
        empty one gives way to the fallback class."""
        first = f"coalesce({p.first_text(both(tagged('span'), classed(pattern)))}, {p.first_text(classed(pattern))})"
        return f"coalesce({_sql_nz(first)}, {p.first_text(classed(fallback))})"

    def notes(tag: str) -> str:
        return f"coalesce({p.of_first(style, lambda e: p.inside(e).each(tagged(tag), p.text))}, cast(array() AS array<string>))"

    k, v = name(), name()
    data = f"transform_values(map_filter({el}.attrs, ({k}, {v}) -> startswith({k}, 'data-')), ({k}, {v}) -> coalesce({v}, ''))"
    fields = {
        "cls": f"{el}.cls", "text": own.text(el, "\n"),
        "user": named(C.CLASS_USER_TITLE, C.CLASS_USER_FALLBACK), "user_desc": named(C.CLASS_USER_DESC, C.CLASS_USER_DESC_FALLBACK),
        "star_class": p.of_first(wrap, lambda e: f"{e}.cls"), "star_icons_wrap": p.of_first(wrap, lambda e: f"size({p.inside(e).all(icon)})"),
        "star_icons": f"IF({el} IS NULL, NULL, size({p.all(icon)}))", "rating_text": p.first_text(classed(C.CLASS_RATING_ELEMENT)),
        "body": f"coalesce({', '.join(p.first_text(b) for b in bodies)})", "note_dt": notes("dt"), "note_dd": notes("dd"),
        "sample": f"{card}.sample", "data": data,
    }
    return [F.expr(sql).alias(field) for field, sql in fields.items()]


def explode_cards(df: DataFrame, facts="facts", keys=("page_id",), empty_pages: bool = False) -> DataFrame:
    """One row per review card, keeping page order; ``empty_pages``
    keeps a page without cards as one row of NULLs, as a page walk needs.
    Takes facts with ``cards=True``."""
    each = F.posexplode_outer if empty_pages else F.posexplode
    found = df.select(*keys, found_cards(facts).alias("__found"))
    rows = found.select(*keys, F.col("__found.rule").alias("card_rule"), each("__found.cards").alias("pos", "__card"))
    return rows.select(*keys, "card_rule", "pos", *card_fields("__card"))
