"""Serving-view and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summarize as S
from ..operators import views as V
from . import fixtures as X
from .oracle_views import DV, PR, PRX, RV, RV_POS, RVX, with_views
from .registry import query

_RVPR = with_views(rv=RV, pr=PR)

# Products that have no review, and reviews of no product, come from codes that
# the other side lacks; whole tables are read.
_RVPRX = with_views(rv=RV, pr=PR, prx=PRX, rvx=RVX)


@query("review_enrich", oracle=_RVPR + """
SELECT rv.product_code, pr.product_name, rv.username, rv.rating
FROM rv LEFT JOIN pr ON rv.product_code = pr.product_code""")
def q_review_enrich(spark, sf):
    r = V.review_enrich(X.reviews_rv(spark, sf), X.products_pr(spark, sf))
    return r.select("product_code", "product_name", "username", "rating")


@query("product_reviews", oracle=_RVPRX + """
SELECT product_code, username, rating, option FROM rvx
WHERE product_code IN (SELECT product_code FROM pr)""")
def q_product_reviews(spark, sf):
    """J5 for the codes of all parts; as many reviews again are of others."""
    codes = X.products_pr(spark, sf).select("product_code")
    r = V.product_reviews(X.with_unknown(X.reviews_rv(spark, sf)), codes)
    return r.select("product_code", "username", "rating", "option")


@query("products_with_reviews", oracle=_RVPRX + """
SELECT product_code FROM prx WHERE product_code IN (SELECT product_code FROM rv)""")
def q_products_with_reviews(spark, sf):
    return V.products_with_reviews(X.with_unknown(X.products_pr(spark, sf)), X.reviews_rv(spark, sf)) \
        .select("product_code")


@query("product_lookup", oracle=_RVPR + """, top AS (
  SELECT product_code FROM rv GROUP BY 1 ORDER BY COUNT(*) DESC, product_code LIMIT 1)
SELECT product_code, product_name, category FROM pr WHERE product_code = (SELECT * FROM top)""")
def q_product_lookup(spark, sf):
    """Point lookup of the most-reviewed product (the code comes
    from the data as a scalar subquery, which the scan gets as a filter on
    the stored key column)."""
    rv = X.reviews_rv(spark, sf)
    top = (rv.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "product_code").limit(1).select(F.col("product_code").cast("long")))
    return V.product_lookup(X.products_pr(spark, sf), top.scalar(), key="pos") \
        .select("product_code", "product_name", "category")


_STATS = """SELECT product_code, COUNT(*) AS total_reviews,
         COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count
  FROM rv GROUP BY 1"""


@query("product_view", oracle=_RVPRX + f""", s AS ({_STATS})
SELECT prx.product_code, prx.product_name, s.total_reviews, s.positive_count
FROM prx LEFT JOIN s ON prx.product_code = s.product_code""")
def q_product_view(spark, sf):
    stats = S.rating_stats(X.reviews_rv(spark, sf)).select("product_code", "total_reviews", "positive_count")
    return V.product_view(X.with_unknown(X.products_pr(spark, sf)).select("product_code", "product_name"), stats)


@query("product_list", oracle=_RVPRX + """, c AS (
  SELECT product_code, COUNT(*) AS n, SUM(CASE WHEN rating > 0 THEN rating END) AS sr,
         COUNT(CASE WHEN rating > 0 THEN 1 END) AS nr FROM rv GROUP BY 1),
p AS (SELECT *, pos * 2 + CASE WHEN contains(product_code, '-x') THEN 1 ELSE 0 END AS place FROM prx)
SELECT ROW_NUMBER() OVER (ORDER BY p.place) AS ordinal, p.product_code, p.product_name,
       COALESCE(c.n, 0) AS n_reviews, CAST(c.sr AS BIGINT) AS sum_rating, c.nr AS n_rated
FROM p LEFT JOIN c ON c.product_code = p.product_code""")
def q_product_list(spark, sf):
    """J7 + W5: numbered product list with review counts (0 kept) and the
    rating sums of products that have a summary."""
    rv = X.reviews_rv(spark, sf)
    stats = S.rating_stats(rv).select("product_code", "sum_rating", "n_rated", S.average_rating().alias("average_rating"))
    prods = X.with_unknown(X.products_pr(spark, sf)).select(
        "product_code", "product_name", (F.col("pos") * 2 + F.col("product_code").contains("-x").cast("int")).alias("pos"))
    pl = V.product_list(prods, rv, stats.select("product_code", "average_rating"))
    return (pl.join(stats.drop("average_rating"), "product_code", "left")
            .select("ordinal", "product_code", "product_name", "n_reviews", "sum_rating", "n_rated"))


@query("fk_resolve", oracle=_RVPRX + """
SELECT product_code, COUNT(*) AS n_reviews,
       product_code IN (SELECT product_code FROM pr) AS matched
FROM rvx GROUP BY product_code""")
def q_fk_resolve(spark, sf):
    r = V.fk_resolve(X.with_unknown(X.reviews_rv(spark, sf)), X.products_pr(spark, sf))
    return r.groupBy("product_code", "matched").agg(F.count(F.lit(1)).alias("n_reviews"))


@query("review_preview", oracle=_RVPR + f"""
SELECT product_code, rk AS rank, username, rating FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY {RV_POS}) AS rk FROM rv)
WHERE rk <= 10""")
def q_review_preview(spark, sf):
    r = V.review_preview(X.reviews_rv(spark, sf), 10)
    return r.select("product_code", F.col("rank").cast("long").alias("rank"), "username", "rating")


@query("max_products", oracle=_RVPR + """
SELECT product_code, product_name FROM pr ORDER BY pos LIMIT 50""")
def q_max_products(spark, sf):
    return V.max_products(X.products_pr(spark, sf), 50).select("product_code", "product_name")


@query("export_product_info", oracle=_RVPR + """, s AS (
  SELECT product_code, COUNT(*) AS total_reviews,
         COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count,
         COUNT(CASE WHEN COALESCE(rating, 0) <= 2 THEN 1 END) AS negative_count
  FROM rv GROUP BY 1)
SELECT pr.product_code, pr.product_name, pr.category, '' AS product_url,
       COALESCE(s.total_reviews, 0) AS total_reviews, COALESCE(s.positive_count, 0) AS positive_count,
       COALESCE(s.negative_count, 0) AS negative_count, 0 AS n_key_points
FROM pr LEFT JOIN s ON s.product_code = pr.product_code""")
def q_export_product_info(spark, sf):
    """One JSON document per product; compared by parsed fields."""
    stats = S.rating_stats(X.reviews_rv(spark, sf))
    prods = X.products_pr(spark, sf).select("product_code", "product_name", "category")
    j = V.product_info_json(prods, stats, crawled_at=F.lit("2024-01-01 00:00:00"))
    g = lambda p: F.get_json_object("json", p)
    return j.select("product_code", g("$.product_info.product_name").alias("product_name"),
                    g("$.product_info.category").alias("category"),
                    g("$.product_info.product_url").alias("product_url"),
                    g("$.statistics.total_reviews").cast("long").alias("total_reviews"),
                    g("$.statistics.positive_count").cast("long").alias("positive_count"),
                    g("$.statistics.negative_count").cast("long").alias("negative_count"),
                    F.json_array_length(g("$.summary.key_points")).alias("n_key_points"))


@query("export_reviews", oracle=_RVPR + """
SELECT rv.product_code, COALESCE(pr.product_name, '') AS product_name, rv.username, rv.rating,
       rv.option, '' AS special_note_1
FROM rv LEFT JOIN pr ON rv.product_code = pr.product_code""")
def q_export_reviews(spark, sf):
    """One JSON line per review; compared by parsed fields."""
    j = V.review_lines_json(X.reviews_rv(spark, sf),
                            X.products_pr(spark, sf).select("product_code", "product_name"))
    back = F.from_json("json", "product_code string, product_name string, username string, "
                               "rating int, option string, special_note_1 string")
    return j.select(back.alias("r")).select("r.*")


@query("export_product_view", oracle=_RVPRX + f""", s AS ({_STATS})
SELECT prx.product_code, prx.product_name, s.total_reviews AS summary_total,
       s.product_code IS NULL AS summary_is_null
FROM prx LEFT JOIN s ON prx.product_code = s.product_code""")
def q_export_product_view(spark, sf):
    """Product view document; the summary object is null for products
    without a summary."""
    stats = S.rating_stats(X.reviews_rv(spark, sf))
    summ = stats.select("product_code", F.lit("").alias("summary"),
                        F.array().cast("array<string>").alias("key_points"),
                        S.average_rating().alias("average_rating"), "total_reviews",
                        "positive_count", "negative_count")
    j = V.product_view_json(X.with_unknown(X.products_pr(spark, sf)).select("product_code", "product_name"), summ)
    g = lambda p: F.get_json_object("json", p)
    return j.select("product_code", g("$.product_info.product_name").alias("product_name"),
                    g("$.summary.total_reviews").cast("long").alias("summary_total"),
                    g("$.summary").isNull().alias("summary_is_null"))


@query("export_view_reviews", oracle=with_views(dv=DV) + """
SELECT product_code, pos AS id, username, rating, option, '' AS review_type, review_text,
       '2024-01-02T03:04:05.000000' AS created_at, NULL::VARCHAR AS user_info FROM dv""")
def q_export_view_reviews(spark, sf):
    """The reviews of the product view, one JSON line each, with id and
    time of storing; parsed back."""
    rows = X.reviews_dv(spark, sf).select(
        "product_code", F.col("pos").alias("review_id"), "username", "rating", "option", F.lit("").alias("review_type"),
        "review_text", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("created_at"))
    back = F.from_json("json", "id long, username string, user_info string, rating int, option string, review_type string, "
                               "review_text string, created_at string")
    return V.view_review_lines(rows).select("product_code", back.alias("r")).select("product_code", "r.*")
