"""Composite extractors: page facts -> typed records.

Each is a projection (plus explode for cards and links) over the facts of
E0, so one pass of the HTML stage feeds products, notices, reviews and
listings alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import prices as P
from ..functions import reviews as R
from ..functions import urls as U
from ..functions import users as US
from . import extract as E
from . import merge as M
from .dedup import first_by_digest, keep_first
from .walk import page_walk


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: More than any text: the record keeps it whole.
WHOLE = (1 << 31) - 1


def text_field(facts: str, keywords: list, whole: bool = False) -> Column:
    """Usage / precautions: dt/dd -> th/td -> keyword-anchored text ->
    heading block (first candidate passing its length guard), cut as the
    exports want it (F14) unless ``whole``."""
    cap = WHOLE if whole else C.TEXT_CAP_CHARS
    return R.text_cap(F.coalesce(E.dl_value(facts, keywords), E.th_td_value(facts, keywords),
                                 E.keyword_after(_or_empty(E.page_text(facts)), keywords, cap),
                                 E.heading_block(facts, keywords)), cap)


def ingredients_field(facts: str, whole: bool = False) -> Column:
    return R.ingredients_cap(E.ingredients(facts), WHOLE if whole else C.INGREDIENT_CAP_CHARS)


def exported(df: DataFrame) -> DataFrame:
    """F14 at the export: the text columns cut to their lengths."""
    cut = {"usage_method": C.TEXT_CAP_CHARS, "precautions": C.TEXT_CAP_CHARS, "ingredients": C.INGREDIENT_CAP_CHARS}
    return df.withColumns({c: R.strip_ws(F.substring(c, 1, n)) for c, n in cut.items() if c in df.columns})


def raw_html_features(pages: DataFrame, html: str = "html", where: Column | None = None) -> DataFrame:
    """Rules that read the raw page (E15 patterns, E16): computed in the JVM
    before the HTML stage and carried through it as small columns.  ``where``:
    the pages whose record has them; the others are not searched (NULL)."""
    h = F.col(html) if where is None else F.when(where, F.col(html))
    return pages.withColumn("raw_rating", E.rating_from_html(h)) \
        .withColumn("raw_review_count", E.page_review_count(h))


RAW_FEATURES = ["raw_rating", "raw_review_count"]


def product_fields(facts: str = "facts", url: str = "url", whole: bool = False) -> list[Column]:
    """The fields of C1 from a product page's facts, its url and the
    ``raw_html_features`` columns."""
    u = F.col(url)
    cp = E.class_price(facts)
    strike = E.strike_price(facts)
    # a heading may hold the whole listing line: discount, price, name, rating, count (F1-F7);
    # what the page itself states comes first
    h1 = R.strip_ws(_or_empty(E.h1(facts)))
    line = P.parse_listing(h1)
    said = line["sale_price"].isNotNull()
    name = F.when(said, P.name_clean(line["name"])).otherwise(h1)
    from_name = F.when(line["sale_price"] > C.NAME_PRICE_FLOOR, line["sale_price"])
    discount = F.coalesce(cp["discount"], F.when(said, line["discount"]))
    current = F.coalesce(cp["price"], P.sale_price(from_name, line["discount"]))
    listp = F.coalesce(strike, P.list_price(cp["price"], cp["discount"]), from_name)
    cats = E.breadcrumb_categories(facts)
    code = U.code_cascade(u, E.meta_content(facts, C.META_CODE_PROPERTY), E.data_attr(facts),
                          E.script_var(facts))
    return [
        _or_empty(code).alias("product_code"),
        _or_empty(U.url_serial(u)).alias("online_sn"),
        u.alias("product_url"),
        _or_empty(name).alias("product_name"),
        cats["category"].alias("category"), cats["sub_category"].alias("sub_category"),
        listp.alias("price"), current.alias("current_price"),
        discount.alias("discount_pct"),
        F.when(listp.isNotNull(), P.price_band(listp)).otherwise(F.lit("")).alias("price_range"),
        F.coalesce(E.page_rating(facts, F.col("raw_rating")), F.when(said, line["rating"])).alias("rating"),
        F.coalesce(F.col("raw_review_count"), F.when(said, line["review_count"])).alias("review_count"),
        *notice_fields(facts, whole),
    ]


def extract_products(pages: DataFrame, *, facts: str = "facts", url: str = "url",
                     keys=("page_id",), whole: bool = False) -> DataFrame:
    """Product record per product page (all strings '' when missing in
    the export, typed here).  ``pages`` carries the facts plus ``url`` and
    the ``raw_html_features`` columns."""
    return pages.select(*keys, *product_fields(facts, url, whole))


def notice_fields(facts: str = "facts", whole: bool = False) -> list[Column]:
    return [text_field(facts, C.USAGE_KEYWORDS, whole).alias("usage_method"),
            ingredients_field(facts, whole).alias("ingredients"),
            text_field(facts, C.PRECAUTION_KEYWORDS, whole).alias("precautions")]


def extract_notices(pages: DataFrame, *, facts: str = "facts", keys=("page_id",), whole: bool = False) -> DataFrame:
    """Usage / ingredients / precautions from a notice page."""
    return pages.select(*keys, *notice_fields(facts, whole))


def product_bundle(pages: DataFrame, *, facts: str = "facts", key: str = "page_id", kind: str = "kind",
                   url: str = "url", whole: bool = False) -> DataFrame:
    """One row a product from all its pages, read once: the product record
    (C1) with the notice pages' texts where they have one (J3), and its parsed
    reviews (C3) as counts and rating sum.  ``kind``: product, notice or
    reviews.  The reviews themselves are a table of their own."""
    is_kind = lambda k: F.col(kind) == k
    record = F.struct(*product_fields(facts, url, whole))
    fields = pages.select(record.alias("r")).select("r.*").columns
    notice = F.struct(*notice_fields(facts, whole))
    rows = pages.select(
        F.col(key).alias("_key"), F.when(is_kind("product"), record).alias("_product"), F.when(is_kind("notice"), notice).alias("_notice"),
        F.when(is_kind("reviews"), E.found_cards(facts)).alias("_found"))
    cards = rows.select("_key", "_product", "_notice", F.explode_outer("_found.cards").alias("_card")).select(
        "_key", "_product", "_notice", *E.card_fields("_card"))
    parsed = parse_reviews(cards)
    said = parsed.groupBy("_key").agg(
        F.max("_product").alias("_product"), F.max("_notice").alias("_notice"),
        F.count(F.when(F.col("valid"), 1)).alias("total_reviews"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("rating"))), F.lit(0)).cast("long").alias("sum_rating"))
    texts = ("usage_method", "ingredients", "precautions")
    return said.filter(F.col("_product").isNotNull()).select(
        F.col("_key").alias(key), *[F.col(f"_product.{c}") for c in fields if c not in texts],
        *[M.first_nonempty(F.col(f"_notice.{c}"), F.col(f"_product.{c}")).alias(c) for c in texts], "total_reviews", "sum_rating")


def parse_reviews(cards: DataFrame, *, body_keywords: list | None = None,
                  note_dictionary=None) -> DataFrame:
    """Review fields per card (E22, P1, F15-F25, P2).  Adds ``valid``
    (card >= 20 chars and body > 10 chars); invalid rows are the quarantine.
    ``features`` is the map of all notes of the card (M13), whole; the flat
    columns hold the first three as the exports want them."""
    t = _or_empty(F.col("text"))
    # the scrubbed text element is materialised once; the line array is only
    # built for cards whose element text is too short (lazy CASE branch)
    cards = cards.withColumn("_body", R.scrub(_or_empty(F.col("body"))))
    lines = R.text_lines(t)
    info = F.coalesce(F.nullif(F.col("user_desc"), F.lit("")), US.user_info_raw(t), F.lit(""))
    icons = F.coalesce(F.nullif(F.col("star_icons_wrap"), F.lit(0)), F.col("star_icons"))
    x = cards.select(
        "*",
        F.coalesce(F.nullif(F.col("user"), F.lit("")), US.username_from_text(t),
                   F.lit("")).alias("username"),
        info.alias("user_info"),
        R.rating_cascade(F.col("star_class"), icons, t, F.col("rating_text")).alias("rating"),
        R.option_parse(t).alias("option"),
        R.review_type(t).alias("review_type"),
        F.when(F.length("_body") >= C.BODY_FALLBACK_BELOW, F.col("_body")).otherwise(
            F.coalesce(R.longest_line(lines, body_keywords), F.lit(""))).alias("review_text"),
        R.notes_from_pairs(F.coalesce("note_dt", F.array().cast("array<string>")),
                           F.coalesce("note_dd", F.array().cast("array<string>"))).alias("_pairs"),
        R.feature_map("note_dt", "note_dd").alias("features"),
    )
    # notes and the parsed profile feed several columns each: materialise
    # them once (a separate projection is not collapsed for such expressions)
    notes = F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(
        R.notes_from_dictionary("review_text", "text", note_dictionary))
    y = x.select("*", notes.alias("_notes"),
                 US.parse_user_info(F.col("user_info")).alias("_prof"))
    return y.select(
        *[c for c in x.columns if c not in ("_pairs", "_body")],
        *[F.col("_prof")[f].alias(f) for f in ("age", "gender", "skin_type_1", "skin_type_2")],
        *[F.coalesce(F.try_element_at("_notes", F.lit(i)), F.lit("")).alias(f"special_note_{i}")
          for i in (1, 2, 3)],
        (R.card_ok(t) & R.body_ok(F.col("review_text"))).alias("valid"))


def walk_reviews(reviews: DataFrame, *, key: str = "product_code", page: str = "page_no",
                 pos: str = "pos", **kw) -> DataFrame:
    """C4: valid reviews of the pages the walk reads, deduped across pages,
    keeping first-seen order.  ``reviews`` holds all parsed cards, invalid
    ones too, and a row with a NULL ``text`` for a page without cards.
    ``prefix``: compare only so many characters of a review (D1); by default
    its whole text."""
    prefix = kw.pop("prefix", None)
    kept = page_walk(reviews, key=key, page=page, card="text", valid="valid",
                     prefix=prefix or (1 << 30), **kw).select(key, page)
    on_kept = reviews.filter("valid").join(kept, [key, page], "left_semi")
    body = F.col("review_text")
    return first_by_digest(on_kept, [key, F.coalesce(F.col("username"), F.lit("")),
                                     F.substring(body, 1, prefix) if prefix else body], [page, pos])


def listing_rows(pages: DataFrame, *, facts: str = "facts", url: str = "url", keys=("page_id",),
                 base: str = C.DEFAULT_SITE_BASE, must_contain: str = C.PRODUCT_PATH) -> DataFrame:
    """One row a product of each page (its first link there), and one without
    a link for a page that has none: keys, the page's ``listing_name`` (E17),
    ``listing_kind`` (E18), ``declared`` (E19) and ``n_links``, then ``pos``,
    ``product_url`` and ``raw_name`` of the link (E2, E3); ``head``: the page's
    first row.  All within the page's arrays, nothing is dealt out."""
    told = pages.select(
        *keys, E.listing_name(facts, F.col(url)).alias("listing_name"), E.page_kind(F.col(url)).alias("listing_kind"),
        E.declared_count(_or_empty(E.page_text(facts))).alias("declared"), E.links(facts).alias("_links"))
    links = F.transform("_links", lambda e, i: F.struct(
        E.absolute_product_link(e["href"], base, must_contain).alias("product_url"), i.alias("pos"), e["text"].alias("raw_name")))
    told = told.withColumn("n_links", F.size("_links")).withColumn(
        "_links", F.array_sort(F.filter(links, lambda e: e["product_url"].isNotNull())))
    # sorted by URL and place, a product's first link follows another product's last
    first = F.filter("_links", lambda e, i: (i == 0) | (F.get("_links", i - 1)["product_url"] != e["product_url"]))
    told = told.withColumn("_links", F.array_sort(F.transform(first, lambda e: F.struct(
        e["pos"].alias("pos"), e["product_url"].alias("product_url"), e["raw_name"].alias("raw_name")))))
    headed = F.transform("_links", lambda e, i: F.struct(e["pos"].alias("pos"), e["product_url"].alias("product_url"),
                                                         e["raw_name"].alias("raw_name"), (i == 0).alias("head")))
    rows = told.select(*keys, "listing_name", "listing_kind", "declared", "n_links", F.inline_outer(headed))
    return rows.withColumn("head", F.coalesce("head", F.lit(True)))


def extract_listing(pages: DataFrame, *, facts: str = "facts", url: str = "url",
                    keys=("page_id",), listing=None, base: str = C.DEFAULT_SITE_BASE,
                    must_contain: str = C.PRODUCT_PATH,
                    code_param: str = C.PRODUCT_CODE_PARAM,
                    serial_param: str = C.PRODUCT_SERIAL_PARAM,
                    max_products: int | None = None) -> DataFrame:
    """The products of listing pages with what the listing says of
    itself: links absolutised, filtered, deduped by URL within their listing
    (first seen), with code, serial and cleaned name, cut at ``max_products`` a
    listing.  ``listing`` names those of the keys that say which pages are one
    listing (by default all: each page is one); the rest order its pages."""
    listing = list(listing or keys)
    rows = listing_rows(pages, facts=facts, url=url, keys=keys, base=base, must_contain=must_contain) \
        .filter(F.col("product_url").isNotNull())
    seen = [k for k in keys if k not in listing] + ["pos"]
    if len(seen) > 1:  # a listing of several pages
        rows = keep_first(rows, [*listing, "product_url"], F.struct(*seen))
    out = rows.select(
        *keys, "listing_name", "listing_kind", "declared", "pos", "product_url",
        P.name_clean(F.col("raw_name"), min_len=3).alias("product_name"),
        _or_empty(U.url_code(F.col("product_url"), code_param, serial_param)).alias("product_code"),
        _or_empty(U.url_serial(F.col("product_url"), serial_param)).alias("serial"))
    if max_products:
        rank = F.row_number().over(Window.partitionBy(*listing).orderBy(*seen))
        out = out.withColumn("_rank", rank).filter(F.col("_rank") <= max_products).drop("_rank")
    return out


def listing_totals(pages: DataFrame, catalog: DataFrame, *, facts: str = "facts", url: str = "url",
                   keys=("page_id",), listing=None, base: str = C.DEFAULT_SITE_BASE, must_contain: str = C.PRODUCT_PATH,
                   code=None, serial=None) -> DataFrame:
    """C7 (A15, A16): one row a listing, those without a link too: name, kind,
    declared count, links, products, those that earlier runs have
    (``catalog``: product_code, serial; J1: either says so; an empty one says
    nothing) and new ones, and whether the listing is complete (NULL where it
    declares nothing).  ``code`` and ``serial``: what of a product URL is
    looked up.  Pages are parsed once: all comes from one row a link."""
    listing = list(listing or keys)
    link = F.col("product_url")
    rows = listing_rows(pages, facts=facts, url=url, keys=keys, base=base, must_contain=must_contain).select(
        *keys, "listing_name", "listing_kind", "declared", "n_links", "head", "product_url",
        _or_empty(U.url_code(link) if code is None else code(link)).alias("_code"),
        _or_empty(U.url_serial(link) if serial is None else serial(link)).alias("_serial"))
    said = F.struct(*keys, "listing_name", "listing_kind").alias("said")
    n_links = F.when(F.col("head"), F.col("n_links"))
    if listing == list(keys):
        once = rows.select(*listing, "product_url", "_code", "_serial", said, "declared", n_links.alias("n_links"))
    else:  # a product once a listing; what a page says of itself with its first row
        once = rows.groupBy(*listing, "product_url", "_code", "_serial").agg(
            F.min(said).alias("said"), F.max("declared").alias("declared"), F.sum(n_links).alias("n_links"))
    once = M.mark_known(once, catalog, catalog, code="_code", serial="_serial")
    out = once.groupBy(*listing).agg(
        F.min("said").alias("said"), F.max("declared").alias("declared"), F.sum("n_links").alias("n_links"),
        F.count("product_url").alias("n_products"),
        F.count(F.when(F.col("known") & F.col("product_url").isNotNull(), 1)).alias("n_skipped"))
    return out.select(
        *listing, F.col("said.listing_name").alias("name"), F.col("said.listing_kind").alias("kind"), "declared",
        "n_links", "n_products", "n_skipped", (F.col("n_products") - F.col("n_skipped")).alias("n_new"),
        (F.col("n_products") >= F.col("declared")).alias("complete"))
