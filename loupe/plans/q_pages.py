"""Page queries: E0-E22, F8-F10, D4, A16, C1-C7 over the driver ``pages``
table and over pages synthesised from ``part`` / ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import urls as U
from ..operators import extract as E
from ..operators import records as R
from ..operators.dedup import keep_first
from ..sources.facts import page_facts
from . import fixtures as X
from . import html_fixtures as H
from .registry import query

BASE = C.DEFAULT_SITE_BASE


def _pages(spark, sf):
    return X.table(spark, sf, "pages")


def _facts(spark, sf):
    """Facts of the driver pages, with the url carried through."""
    return page_facts(_pages(spark, sf), keys=["page_id"], passthrough=["url"])


def _unescape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), "
            f"'&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_H1_SQL = _strip_sql(_unescape_sql("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')"))
_TITLE_SQL = _strip_sql(_unescape_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))

_LINKS_SQL = f"""links AS (
  SELECT page_id, i - 1 AS pos, hrefs[i] AS href, {_strip_sql(_unescape_sql('texts[i]'))} AS text
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
               regexp_extract_all(html, '<a [^>]*>(.*?)</a>', 1) AS texts FROM pages) t,
       unnest(range(1, len(hrefs) + 1)) r(i))"""


# ---------------------------------------------------------------- S1, E0, E1, E2

@query("page_scan", oracle="SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def q_page_scan(spark, sf):
    """Page-snapshot scan (Parquet here; ``sources.pages`` also reads a
    directory of saved pages)."""
    return _pages(spark, sf).select("page_id", "url", F.length("html").alias("n_chars"))


@query("page_facts", oracle=f"""SELECT page_id, {_TITLE_SQL} AS title, {_H1_SQL} AS h1,
       CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n_links,
       regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS scripts
FROM pages""")
def q_page_facts(spark, sf):
    f = page_facts(_pages(spark, sf))
    return f.select("page_id", E.title().alias("title"), E.h1().alias("h1"),
                    F.size(E.links()).alias("n_links"), E.scripts().alias("scripts"))


@query("page_h1", oracle=f"SELECT page_id, {_H1_SQL} AS h1 FROM pages")
def q_page_h1(spark, sf):
    return page_facts(_pages(spark, sf)).select("page_id", E.h1().alias("h1"))


@query("page_links", oracle=f"WITH {_LINKS_SQL} SELECT page_id, pos, href, text FROM links")
def q_page_links(spark, sf):
    return E.explode_links(page_facts(_pages(spark, sf))).withColumn(
        "pos", F.col("pos").cast("long"))


@query("link_filter", oracle=f"""WITH {_LINKS_SQL}
SELECT page_id, pos, CASE WHEN starts_with(href, '/') AND contains('{BASE}' || href, '/t')
       THEN '{BASE}' || href END AS product_url FROM links""")
def q_link_filter(spark, sf):
    """Every link with its product URL, NULL for those that are none (the
    required path fragment is '/t', as driver pages have no product links)."""
    links = E.explode_links(page_facts(_pages(spark, sf)))
    u = E.absolute_product_link(F.col("href"), BASE, must_contain="/t")
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), u.alias("product_url"))


@query("link_dedup", oracle=f"""WITH {_LINKS_SQL}
SELECT '{BASE}' || href AS product_url, min((page_id, pos))[1] AS page_id,
       arg_min(pos, (page_id, pos)) AS pos
FROM links WHERE href <> '' GROUP BY 1""")
def q_link_dedup(spark, sf):
    """By absolute URL, first seen (page, position) wins."""
    links = E.explode_links(page_facts(_pages(spark, sf)))
    x = links.select("page_id", F.col("pos").cast("long").alias("pos"),
                     E.absolute_product_link(F.col("href"), BASE, must_contain="/")
                     .alias("product_url")).filter(F.col("product_url").isNotNull())
    return keep_first(x, ["product_url"], F.struct("page_id", "pos")) \
        .select("product_url", "page_id", "pos")


# ---------------------------------------------------------------- E7, E16, E17, E18, F8-F10, A16

@query("script_var", oracle="""SELECT page_id,
       regexp_extract(regexp_extract(html, '<script>(.*?)</script>', 1, 's'), 'track\\((\\d+)\\)', 1)
         AS v FROM pages""")
def q_script_var(spark, sf):
    f = page_facts(_pages(spark, sf))
    return f.select("page_id", F.coalesce(E.script_var("facts", r"track\((\d+)\)"), F.lit(""))
                    .alias("v"))


def _num_sql(x: str) -> str:
    return f"CAST(NULLIF(replace({x}, ',', ''), '') AS BIGINT)"


@query("page_review_count", oracle=f"""SELECT page_id, COALESCE(
  {_num_sql("regexp_extract(html, '리뷰\\s*(\\d{1,3}(?:,\\d{3})*)', 1)")},
  {_num_sql("regexp_extract(html, '후기\\s*(\\d{1,3}(?:,\\d{3})*)', 1)")},
  {_num_sql("regexp_extract(html, '\\((\\d{1,3}(?:,\\d{3})*)\\)', 1)")}) AS review_count
FROM pages""")
def q_page_review_count(spark, sf):
    return _pages(spark, sf).select("page_id", E.page_review_count(F.col("html"))
                                    .alias("review_count"))


@query("page_kind", oracle="""SELECT page_id,
  CASE WHEN contains(url, 'utm_source') THEN 'category' WHEN contains(url, 'ref=') THEN 'brand'
       ELSE 'product list' END AS kind FROM pages""")
def q_page_kind(spark, sf):
    """E18 with the driver URLs' tokens standing in for the shop's."""
    return _pages(spark, sf).select("page_id", E.page_kind(F.col("url"), "utm_source", "ref=")
                                    .alias("kind"))


@query("listing_name", oracle=f"""SELECT page_id,
  COALESCE(NULLIF({_H1_SQL}, ''), 'unknown') AS name FROM pages""")
def q_listing_name(spark, sf):
    f = _facts(spark, sf)
    return f.select("page_id", E.listing_name("facts", F.col("url")).alias("name"))


_CODE_SQL = """CASE WHEN contains(url, 'ref=') THEN regexp_extract(url, 'ref=([^&]*)', 1)
            WHEN contains(url, 'page=') THEN regexp_extract(url, 'page=([^&]*)', 1) END"""


@query("url_code", oracle=f"SELECT page_id, {_CODE_SQL} AS code FROM pages")
def q_url_code(spark, sf):
    return _pages(spark, sf).select("page_id", U.url_code(F.col("url"), "ref", "page").alias("code"))


@query("url_serial", oracle="""SELECT page_id, NULLIF(regexp_extract(url, 'page=(\\d+)', 1), '')
  AS serial FROM pages""")
def q_url_serial(spark, sf):
    return _pages(spark, sf).select("page_id", U.url_serial(F.col("url"), "page").alias("serial"))


@query("code_cascade", oracle="""SELECT page_id, COALESCE(
  NULLIF(CASE WHEN contains(url, 'ref=') THEN regexp_extract(url, 'ref=([^&]*)', 1) END, ''),
  NULLIF(regexp_extract(html, 'track\\((\\d+)\\)', 1), ''),
  NULLIF(regexp_extract(url, 'page=(\\d+)', 1), '')) AS code FROM pages""")
def q_code_cascade(spark, sf):
    """URL code -> meta -> data attribute -> script variable -> serial."""
    f = _facts(spark, sf)
    code = U.code_cascade(F.col("url"), E.meta_content("facts", "product.*code|code"),
                          E.data_attr("facts"), E.script_var("facts", r"track\((\d+)\)"),
                          "ref", "page")
    return f.select("page_id", code.alias("code"))


@query("listing_completeness", oracle=f"""WITH {_LINKS_SQL}
SELECT p.page_id, COUNT(l.href) AS n_links, COUNT(DISTINCT l.href) AS n_distinct,
       NULL::BIGINT AS declared, NULL::BOOLEAN AS complete
FROM pages p LEFT JOIN links l ON l.page_id = p.page_id GROUP BY p.page_id""")
def q_listing_completeness(spark, sf):
    """Distinct links against the count that the page declares (E19;
    driver pages declare none, ``listing_totals`` has pages that do).  Pages
    without links are kept; all within the page's arrays."""
    f = page_facts(_pages(spark, sf)).select("page_id", E.links().alias("links"), E.declared_count(
        F.coalesce(E.page_text(), F.lit(""))).alias("declared"))
    n = F.size(F.array_distinct(F.transform("links", lambda e: e["href"]))).cast("long")
    return f.select("page_id", F.size("links").cast("long").alias("n_links"), n.alias("n_distinct"), "declared",
                    (n >= F.col("declared")).alias("complete"))


# ---------------------------------------------------------------- synthesised product pages

def _prod_facts(spark, sf):
    p = R.raw_html_features(H.product_pages(spark, sf))
    return page_facts(p, keys=["page_id"], passthrough=["url"] + R.RAW_FEATURES)


_SRC = f"WITH src AS ({H.SRC_PRODUCT})\n"


@query("dl_pairs", oracle=_SRC + "SELECT k AS page_id, usage, prec AS precautions FROM src")
def q_dl_pairs(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.dl_value("facts", C.USAGE_KEYWORDS).alias("usage"),
                    E.dl_value("facts", C.PRECAUTION_KEYWORDS).alias("precautions"))


@query("th_td_pairs", oracle=_SRC + "SELECT k AS page_id, 'Made in KR by ' || brand AS origin FROM src")
def q_th_td_pairs(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.th_td_value("facts", ["제조국"]).alias("origin"))


@query("keyword_after", oracle=_SRC + "SELECT k AS page_id, usage FROM src")
def q_keyword_after(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.keyword_after(E.page_text(), ["How to Use"]).alias("usage"))


@query("heading_block", oracle=_SRC + "SELECT k AS page_id, usage FROM src")
def q_heading_block(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.heading_block("facts", ["How to Use"]).alias("usage"))


@query("ingredients", oracle=_SRC + "SELECT k AS page_id, ingr AS ingredients FROM src")
def q_ingredients(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.ingredients("facts").alias("ingredients"))


@query("breadcrumb", oracle=_SRC + """SELECT k AS page_id, brand AS category, ptype AS sub_category
FROM src""")
def q_breadcrumb(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    b = E.breadcrumb_categories("facts")
    return f.select("page_id", b["category"].alias("category"),
                    b["sub_category"].alias("sub_category"))


@query("meta_content", oracle=_SRC + """SELECT k AS page_id, 'M' || CAST(k AS VARCHAR) AS code,
  ptype AS category FROM src""")
def q_meta_content(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.meta_content("facts", "product.*code|code").alias("code"),
                    E.meta_content("facts", "category").alias("category"))


@query("data_attr", oracle=_SRC + "SELECT k AS page_id, 'D' || CAST(k AS VARCHAR) AS code FROM src")
def q_data_attr(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.data_attr("facts").alias("code"))


@query("strike_price", oracle=_SRC + "SELECT k AS page_id, list AS price FROM src")
def q_strike_price(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.strike_price("facts").alias("price"))


@query("class_price", oracle=_SRC + """SELECT k AS page_id, CAST(d AS INTEGER) AS discount,
  CAST(sale AS BIGINT) AS price FROM src""")
def q_class_price(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    cp = E.class_price("facts")
    return f.select("page_id", cp["discount"].alias("discount"), cp["price"].alias("price"))


@query("page_rating", oracle=_SRC + "SELECT k AS page_id, rating FROM src")
def q_page_rating(spark, sf):
    f = _prod_facts(spark, sf)
    return f.select("page_id", E.page_rating("facts", F.col("raw_rating")).alias("rating"))


@query("declared_count", oracle=_SRC + "SELECT k AS page_id, CAST(s AS BIGINT) AS declared FROM src")
def q_declared_count(spark, sf):
    f = page_facts(H.product_pages(spark, sf))
    return f.select("page_id", E.declared_count(E.page_text()).alias("declared"))


def _band_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN '{lab}'" for b, lab in
                     zip(C.PRICE_BAND_BOUNDS, C.PRICE_BAND_LABELS))
    return f"CASE {parts} ELSE '{C.PRICE_BAND_LABELS[-1]}' END"


@query("product_facts", oracle=_SRC + f"""SELECT k AS page_id, code AS product_code,
  CAST(k * 7 AS VARCHAR) AS online_sn, name AS product_name, brand AS category,
  ptype AS sub_category, list AS price, CAST(sale AS BIGINT) AS current_price, CAST(d AS INTEGER) AS discount_pct,
  {_band_sql('list')} AS price_range, rating, CAST(cnt AS BIGINT) AS review_count,
  usage AS usage_method, ingr AS ingredients, prec AS precautions
FROM src""")
def q_product_facts(spark, sf):
    """The product record of each product page."""
    r = R.extract_products(_prod_facts(spark, sf))
    return r.drop("product_url")


@query("notice_facts", oracle=_SRC + """SELECT k AS page_id, usage AS usage_method,
  ingr AS ingredients, prec AS precautions FROM src""")
def q_notice_facts(spark, sf):
    """Notice-page text fields over four page layouts."""
    return R.extract_notices(page_facts(H.notice_pages(spark, sf)))


# ---------------------------------------------------------------- synthesised review pages

def _review_src_sql() -> str:
    return f"WITH src AS ({H.src_review_sql()})\n"


@query("card_explode", oracle=_review_src_sql() + """SELECT doc_id,
  source || '#' || CAST(page_no AS VARCHAR) AS page_key,
  CAST(ROW_NUMBER() OVER (PARTITION BY source, page_no ORDER BY doc_id) - 1 AS INTEGER) AS pos,
  'class=reviewCard' AS card_rule
FROM src""")
def q_card_explode(spark, sf):
    """Review cards of each page, in page order."""
    c = H.review_cards(spark, sf)
    return c.select("doc_id", "page_key", "pos", "card_rule")


@query("review_facts", oracle=_review_src_sql() + f"""SELECT doc_id, username,
  concat_ws('/', age, gender, s1, s2) AS user_info, age, gender, s1 AS skin_type_1,
  s2 AS skin_type_2, rating, lang AS option, '' AS review_type,
  CASE WHEN doc_id % 3 = 0 THEN '지속력: ' || lang ELSE '' END AS special_note_1,
  CASE WHEN doc_id % 3 = 0 THEN '발색: ' || source ELSE '' END AS special_note_2,
  '' AS special_note_3,
  {_strip_sql("'Customer review text: ' || text")} AS review_text, true AS valid
FROM src""")
def q_review_facts(spark, sf):
    """Review record of each card."""
    r = R.parse_reviews(H.review_cards(spark, sf))
    return r.select("doc_id", "username", "user_info", "age", "gender", "skin_type_1",
                    "skin_type_2", "rating", "option", "review_type", "special_note_1",
                    "special_note_2", "special_note_3",
                    "review_text", "valid")


@query("product_bundle", oracle=_SRC + f""", rv AS (
  SELECT doc_id // {H.CARDS_PER_PAGE} AS k, COUNT(*) AS total_reviews, SUM(rating) AS sum_rating
  FROM ({H.src_review_sql()}) GROUP BY 1)
SELECT s.code AS product_code, s.name AS product_name, s.usage AS usage_method,
       s.ingr AS ingredients, s.prec AS precautions, CAST(s.sale AS BIGINT) AS current_price,
       COALESCE(rv.total_reviews, 0) AS total_reviews, CAST(COALESCE(rv.sum_rating, 0) AS BIGINT) AS sum_rating
FROM src s LEFT JOIN rv ON rv.k = s.k""")
def q_product_bundle(spark, sf):
    """Product record (C1) with the notice page's text fields winning
    when non-empty (J3), plus the product's parsed reviews; all pages of all
    kinds are parsed once."""
    pages = R.raw_html_features(H.bundle_pages(spark, sf), where=F.col("kind") == "product")
    f = page_facts(pages, keys=["page_id"], passthrough=["kind", "url"] + R.RAW_FEATURES, cards=True)
    return R.product_bundle(f).select("product_code", "product_name", "usage_method", "ingredients", "precautions",
                                      "current_price", "total_reviews", "sum_rating")


def _name_clean_sql(x: str) -> str:
    num = r"\d{1,3}(?:,\d{3})*"
    for p in (r"^\d+%", "^" + num + "원", r"\d+\.?\d*\(" + num + r"\)", r"\d+\.\d+\(" + num + r"\)",
              r"\d+\.\d+", r"\(" + num + r"\)", "좋아요$"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"trim({x})"
    return f"CASE WHEN length({x}) < 3 THEN '' ELSE {x} END"


@query("listing_extract", oracle=f"""WITH {_LINKS_SQL},
firsts AS (SELECT page_id, '{BASE}' || href AS product_url, min(pos) AS pos, arg_min(text, pos) AS raw_name
           FROM links WHERE href <> '' GROUP BY ALL)
SELECT page_id, pos, product_url, {_name_clean_sql('raw_name')} AS product_name,
       COALESCE(NULLIF({_H1_SQL}, ''), 'unknown') AS listing_name,
       '' AS product_code FROM firsts JOIN pages USING (page_id)""")
def q_listing_extract(spark, sf):
    """C6 on the driver pages: each is a listing, all its links products."""
    out = R.extract_listing(_facts(spark, sf), must_contain="/")
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "product_url", "product_name", "listing_name",
                      "product_code")


_LISTING_SRC = f"""WITH src AS ({H.SRC_LISTING}),
said AS (
  SELECT DISTINCT g, CASE g % 4 WHEN 0 THEN 'Hall ' || g WHEN 1 THEN 'House ' || g WHEN 2 THEN 'Mark ' || g ELSE 'Shop ' || g END AS name,
         CASE WHEN g % 2 = 0 THEN 'brand' ELSE 'category' END AS kind,
         CASE WHEN g % 3 > 0 THEN count(*) OVER (PARTITION BY g) + CASE WHEN g % 5 = 0 THEN 3 ELSE 0 END END AS declared
  FROM src)
"""


@query("listing_products", oracle=_LISTING_SRC + """
SELECT g AS page_id, s.name AS listing_name, kind AS listing_kind, declared, url AS product_url, code AS product_code, serial,
       CASE WHEN length(src.name) < 3 THEN '' ELSE src.name END AS product_name
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS rk FROM src) src JOIN said s USING (g) WHERE rk <= 40""")
def q_listing_products(spark, sf):
    """Listing pages of the shop's own form: each product once though it
    is linked twice (its first link counts), at most 40 a listing (L2)."""
    f = page_facts(H.listing_pages(spark, sf), passthrough=["url"])
    out = R.extract_listing(f, max_products=40)
    return out.select("page_id", "listing_name", "listing_kind", "declared", "product_url", "product_code", "serial", "product_name")


def _crawled(spark, sf):
    """What earlier runs have: all parts, those above size 9 under other codes,
    those that are not SMALL under other serials."""
    p = X.table(spark, sf, "part")
    code, serial = F.col("p_partkey").cast("string"), (F.col("p_partkey") * 7).cast("string")
    other = lambda c, same: F.when(same, c).otherwise(F.concat(c, F.lit("-x")))
    return p.select(other(code, F.col("p_size") < 10).alias("product_code"), other(serial, F.col("p_type") == "SMALL").alias("serial"))


@query("brand_run", oracle=_LISTING_SRC + """, done AS (
  SELECT p_partkey AS k, p_size < 10 AS by_code, p_type = 'SMALL' AS by_serial FROM part),
marked AS (
  SELECT src.*, EXISTS (SELECT 1 FROM done WHERE by_code AND CAST(done.k AS VARCHAR) = src.code)
             OR EXISTS (SELECT 1 FROM done WHERE by_serial AND CAST(done.k * 7 AS VARCHAR) = src.serial) AS known FROM src),
t AS (SELECT g, count(*) AS n, count(CASE WHEN known THEN 1 END) AS skipped FROM marked GROUP BY g)
SELECT g AS page_id, name, kind, declared, CAST(2 * n + 2 AS BIGINT) AS n_links, n AS n_products, skipped AS n_skipped, n - skipped AS n_new,
       n >= declared AS complete
FROM t JOIN said USING (g)""")
def q_brand_run(spark, sf):
    """The totals of a run over all listings: name, kind, declared count,
    links, products, those that earlier runs have (J1) and new ones (A15),
    completeness (A16); the listings are parsed once."""
    f = page_facts(H.listing_pages(spark, sf), passthrough=["url"])
    return R.listing_totals(f, _crawled(spark, sf))


@query("page_totals", oracle=f"""WITH {_LINKS_SQL},
cat AS (SELECT DISTINCT '{BASE}/' || regexp_extract(text, '[^\x20\x09-\x0D]+') AS u FROM documents),
per AS (SELECT page_id, '{BASE}' || href AS u FROM links WHERE href <> '' GROUP BY ALL)
SELECT p.page_id, COALESCE(NULLIF({_H1_SQL}, ''), 'unknown') AS name,
       CAST((SELECT count(*) FROM links l WHERE l.page_id = p.page_id) AS BIGINT) AS n_links,
       count(per.u) AS n_products, count(cat.u) AS n_skipped, count(per.u) - count(cat.u) AS n_new
FROM pages p LEFT JOIN per ON per.page_id = p.page_id LEFT JOIN cat ON cat.u = per.u GROUP BY p.page_id, p.html""")
def q_page_totals(spark, sf):
    """C7 on the driver pages: each is a listing of all its links, looked up
    by URL in a catalogue of the documents' first words."""
    word = F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    cat = X.table(spark, sf, "documents").select(F.concat(F.lit(BASE + "/"), word).alias("product_code"), F.lit("").alias("serial"))
    out = R.listing_totals(_facts(spark, sf), cat, must_contain="/", code=lambda u: u, serial=lambda u: F.lit(""))
    return out.select("page_id", "name", "n_links", "n_products", "n_skipped", "n_new")
