"""Product, notice and review pages synthesised from driver tables inside
the plan (``part`` and ``documents``), escaped, then parsed by E0.  The
oracle checks parsing against the source columns the HTML was built from
(``SRC_*`` SQL below), so the regex rules are checked independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.prices import money_format
from . import fixtures as X

BASE = C.DEFAULT_SITE_BASE


def esc(c: Column) -> Column:
    """HTML-escape text (& first)."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# ---------------------------------------------------------------- product and notice pages (part)

SRC_PRODUCT = """SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS ptype,
       p_size AS s,
       CASE WHEN p_size > 5 THEN CAST(p_partkey AS VARCHAR) ELSE 'M' || CAST(p_partkey AS VARCHAR) END
         AS code,
       5 + p_partkey % 4 * 5 AS d, 1000 * (1 + p_partkey % 300) AS sale,
       CAST(trunc(1000 * (1 + p_partkey % 300) * 100.0 / (100 - (5 + p_partkey % 4 * 5))) AS BIGINT)
         AS list,
       CAST(1 + p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS rating,
       p_size * 1037 AS cnt,
       'Apply ' || p_name || ' gently on clean skin every morning' AS usage,
       'Keep ' || p_type || ' away from heat and children' AS prec,
       'Water, Glycerin, ' || p_brand || ' extract, ' || p_type || ' oil, Fragrance' AS ingr
FROM part"""


def product_src(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    d = 5 + k % 4 * 5
    sale = 1000 * (1 + k % 300)
    return p.select(
        k.alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("ptype"), s.alias("s"),
        d.alias("d"), sale.alias("sale"),
        (sale * 100 / (100 - d)).cast("long").alias("list"),
        _cat((1 + s % 4).cast("string"), ".", (k % 10).cast("string")).alias("rating"),
        (s * 1037).alias("cnt"),
        _cat("Apply ", F.col("p_name"), " gently on clean skin every morning").alias("usage"),
        _cat("Keep ", F.col("p_type"), " away from heat and children").alias("prec"),
        _cat("Water, Glycerin, ", F.col("p_brand"), " extract, ", F.col("p_type"),
             " oil, Fragrance").alias("ingr"))


def _spread(rows: DataFrame) -> DataFrame:
    """The rows in equal shares over more tasks than there are cores.  A
    table of short rows is one or two splits (a row group of a million rows is
    a few MB), but each becomes a page to be parsed."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One product page per part: (page_id, url, html)."""
    x = _spread(product_src(spark, sf))
    k = F.col("k").cast("string")
    sn = (F.col("k") * 7).cast("string")
    url = F.when(F.col("s") > 5, _cat(BASE, "/product/detail?onlineProdSn=", sn,
                                      "&onlineProdCode=", k)) \
        .otherwise(_cat(BASE, "/product/detail?onlineProdSn=", sn))
    name, brand, ptype = esc(F.col("name")), esc(F.col("brand")), esc(F.col("ptype"))
    html = _cat(
        "<html><head><title>", name, " - 쇼핑몰 | 상세</title>",
        '<meta property="product:code" content="M', k, '">',
        '<meta property="category" content="', ptype, '"></head><body>',
        '<div class="breadcrumb"><a href="/">홈</a><a href="/c/b">', brand,
        '</a><a href="/c/t">', ptype, "</a></div>",
        "<h1>", name, "</h1>",
        '<div class="prdInfo" data-product-code="D', k, '">',
        '<div class="priceBox"><span class="priceBox__rate">', F.col("d").cast("string"),
        '%</span><span class="priceBox__price">', money_format(F.col("sale")), "원</span>",
        "<del>", money_format(F.col("list")), "원</del></div>",
        '<div class="rating">★ ', F.col("rating"), "</div>",
        '<span class="reviewCount">리뷰 ', money_format(F.col("cnt")), "</span></div>",
        '<script>var onlineProdCode = "', k, '";</script>',
        "<dl><dt>사용방법</dt><dd>", esc(F.col("usage")), "</dd><dt>주의사항</dt><dd>",
        esc(F.col("prec")), "</dd></dl>",
        '<table><tr><th>제조국</th><td>Made in KR by ', brand, "</td></tr></table>",
        "<div><h4>화장품법에 따라 기재해야 하는 모든 성분</h4><p>", esc(F.col("ingr")), "</p></div>",
        '<div class="guide"><h3>How to Use</h3><p>', esc(F.col("usage")), "</p></div>",
        "<p>총 ", F.col("s").cast("string"), "개의 상품</p></body></html>")
    return x.select(F.col("k").alias("page_id"), url.alias("url"), html.alias("html"))


def notice_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One notice page per part; the usage / precaution layout rotates over
    dt/dd, th/td, headings and inline 'keyword: text' paragraphs."""
    x = _spread(product_src(spark, sf))
    u, pr = esc(F.col("usage")), esc(F.col("prec"))
    v = F.col("s") % 4
    body = (F.when(v == 0, _cat("<dl><dt>사용방법</dt><dd>", u, "</dd><dt>주의사항</dt><dd>", pr,
                                "</dd></dl>"))
             .when(v == 1, _cat("<table><tr><th>사용법</th><td>", u,
                                "</td></tr><tr><th>주의 사항</th><td>", pr, "</td></tr></table>"))
             .when(v == 2, _cat("<div><h3>How to Use</h3><p>", u, "</p></div><div><h3>경고</h3><p>",
                                pr, "</p></div>"))
             .otherwise(_cat("<p>용법: ", u, "</p><p>주의: ", pr, "</p>")))
    html = _cat("<html><body><h2>상품정보제공 고시</h2>", body,
                "<div><h4>화장품법에 따라 기재해야 하는 모든 성분</h4><p>", esc(F.col("ingr")),
                "</p></div></body></html>")
    return x.select(F.col("k").alias("page_id"), html.alias("html"))


# ---------------------------------------------------------------- listing pages (part)

PER_LISTING = 50

# one row a part: its listing and place there
SRC_LISTING = f"""SELECT p_partkey AS k, p_partkey // {PER_LISTING} AS g, p_name AS name, p_size AS s,
       '{BASE}/product/detail?onlineProdSn=' || CAST(p_partkey * 7 AS VARCHAR)
         || CASE WHEN p_size > 5 THEN '&onlineProdCode=' || CAST(p_partkey AS VARCHAR) ELSE '' END AS url,
       CASE WHEN p_size > 5 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey * 7 AS VARCHAR) END AS code,
       CAST(p_partkey * 7 AS VARCHAR) AS serial
FROM part"""


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that list the parts, 50 each (so what is collected is bounded):
    every product is linked twice, by its name and by its picture, next to
    links that are no products; name, kind and declared count vary."""
    x = product_src(spark, sf)
    sn = (F.col("k") * 7).cast("string")
    href = _cat("/product/detail?onlineProdSn=", sn, F.when(F.col("s") > 5, _cat(
        "&onlineProdCode=", F.col("k").cast("string"))).otherwise(F.lit("")))
    link = _cat('<li><a href="', href, '">', esc(F.col("name")), '</a><a href="', href, '"><img src="x.png"></a></li>')
    pages = x.select(F.floor(F.col("k") / PER_LISTING).alias("g"), "k", link.alias("c")).groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("k", "c"))).alias("rows"))
    g = F.col("g").cast("string")
    name = (F.when(F.col("g") % 4 == 0, _cat("<h1>Hall ", g, " 브랜드관 소개</h1>"))
             .when(F.col("g") % 4 == 1, _cat('<div class="brandName">House ', g, "</div>"))
             .when(F.col("g") % 4 == 2, _cat('<img src="l.png" alt="Mark ', g, ' 로고">')).otherwise(F.lit("")))
    n = F.size("rows") + F.when(F.col("g") % 5 == 0, 3).otherwise(0)
    html = _cat("<html><head><title>Shop ", g, " - 쇼핑몰 | 목록</title></head><body>", name,
                F.when(F.col("g") % 3 == 0, F.lit("")).otherwise(_cat("<p>총 ", n.cast("string"), "개의 상품</p>")),
                '<ul><li><a href="/event/1">event</a></li>', F.array_join(F.transform("rows", lambda r: r["c"]), ""),
                '</ul><a href="">top</a></body></html>')
    url = F.when(F.col("g") % 2 == 0, _cat(BASE, "/display/brand?brandSn=", g)).otherwise(_cat(BASE, "/display/list?displayCategorySn=", g))
    return pages.select(F.col("g").alias("page_id"), url.alias("url"), html.alias("html"))


# ---------------------------------------------------------------- review pages (documents)

CARDS_PER_PAGE = 5

SRC_REVIEW = f"""SELECT d.doc_id, d.source, d.lang, d.text,
       (d.doc_id // 20) // {CARDS_PER_PAGE} + 1 AS page_no,
       'u' || CAST(d.doc_id % 7 AS VARCHAR) || '***' AS username,
       CAST(10 * (1 + d.doc_id % 5) AS VARCHAR) || '대' AS age,
       CASE WHEN d.doc_id % 2 = 0 THEN '여성' ELSE '남성' END AS gender,
       {{main}}[d.doc_id % 8 + 1] AS s1, {{sec}}[(d.doc_id // 8) % 8 + 1] AS s2,
       CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 1 THEN 5 WHEN l.quality = 0 THEN 3 END
            AS INTEGER) AS rating
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def src_review_sql() -> str:
    main = "[" + ", ".join(f"'{x}'" for x in C.MAIN_SKIN_TYPES) + "]"
    sec = "[" + ", ".join(f"'{x}'" for x in C.SECONDARY_SKIN_TYPES) + "]"
    return SRC_REVIEW.replace("{main}", main).replace("{sec}", sec)


def review_src(spark: SparkSession, sf: str) -> DataFrame:
    d = X.table(spark, sf, "documents")
    lab = X.table(spark, sf, "labels")
    k = F.col("doc_id")
    main = F.array(*[F.lit(x) for x in C.MAIN_SKIN_TYPES])
    sec = F.array(*[F.lit(x) for x in C.SECONDARY_SKIN_TYPES])
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "source", "lang", "text",
        (((k / 20).cast("long") / CARDS_PER_PAGE).cast("long") + 1).alias("page_no"),
        _cat("u", (k % 7).cast("string"), "***").alias("username"),
        _cat((10 * (1 + k % 5)).cast("string"), "대").alias("age"),
        F.when(k % 2 == 0, F.lit("여성")).otherwise(F.lit("남성")).alias("gender"),
        F.element_at(main, (k % 8 + 1).cast("int")).alias("s1"),
        F.element_at(sec, ((k / 8).cast("long") % 8 + 1).cast("int")).alias("s2"),
        F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5)
         .when(F.col("quality") == 0, 3).cast("int").alias("rating"))


def review_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Review pages: one page per (source, page_no) holding five cards in
    doc_id order.  The group is bounded (five cards), so collecting it is
    safe at any scale."""
    x = review_src(spark, sf)
    k = F.col("doc_id")
    card = _cat(
        '<div class="reviewCard" data-review="', k.cast("string"), '">',
        '<span class="profileCard__userTitle">', F.col("username"), "</span>",
        '<span class="profileCard__userDesc">', F.concat_ws("/", "age", "gender", "s1", "s2"),
        "</span>",
        F.when(F.col("rating").isNotNull(),
               _cat('<div class="icoStarWrap star', F.col("rating").cast("string"), '"></div>'))
         .otherwise(F.lit("")),
        '<span class="opt">옵션: ', F.col("lang"), "</span>",
        '<p class="txt">Customer review text: ', esc(F.col("text")), "</p>",
        F.when(k % 3 == 0, _cat('<div class="prdStyle"><dl><dt>지속력</dt><dd>', F.col("lang"),
                                "</dd><dt>발색</dt><dd>", F.col("source"), "</dd></dl></div>"))
         .otherwise(F.lit("")),
        "</div>")
    pages = (x.groupBy("source", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct(k.alias("doc_id"), card.alias("c"))))
                  .alias("cards")))
    html = _cat('<html><body><div class="reviewArea">',
                F.array_join(F.transform("cards", lambda s: s["c"]), ""), "</div></body></html>")
    return pages.select(F.concat_ws("#", "source", F.col("page_no").cast("string")).alias("page_key"),
                        F.col("source").alias("product_code"), "page_no", html.alias("html"))


def _card_of(k: Column) -> Column:
    return _cat(
        '<div class="reviewCard" data-review="', k.cast("string"), '">',
        '<span class="profileCard__userTitle">', F.col("username"), "</span>",
        F.when(F.col("rating").isNotNull(),
               _cat('<div class="icoStarWrap star', F.col("rating").cast("string"), '"></div>'))
         .otherwise(F.lit("")),
        '<p class="txt">Customer review text: ', esc(F.col("text")), "</p></div>")


def bundle_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Product, notice and review pages of every part in one table: (page_id,
    kind, url, html).  A part's reviews are five documents."""
    x = review_src(spark, sf)
    cards = x.select(F.floor(F.col("doc_id") / CARDS_PER_PAGE).alias("page_id"), "doc_id", _card_of(F.col("doc_id")).alias("c"))
    reviews = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "c"))).alias("rows")).select(
        "page_id", F.lit("reviews").alias("kind"), F.lit("").alias("url"),
        _cat("<html><body>", F.array_join(F.transform("rows", lambda r: r["c"]), ""), "</body></html>").alias("html"))
    products = product_pages(spark, sf).select("page_id", F.lit("product").alias("kind"), "url", "html")
    notices = notice_pages(spark, sf).select("page_id", F.lit("notice").alias("kind"), F.lit("").alias("url"), "html")
    return products.unionByName(notices).unionByName(reviews)


def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.extract import explode_cards
    from ..sources.facts import page_facts
    f = page_facts(review_pages(spark, sf), keys=["page_key", "product_code", "page_no"], cards=True)
    return explode_cards(f, keys=("page_key", "product_code", "page_no")).withColumn(
        "doc_id", F.col("data")["data-review"].cast("long"))

