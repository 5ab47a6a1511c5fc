"""Serving views and exports.

Exports are JSON Lines: one product document per line (product info,
statistics, summary — all bounded), and one line per review keyed by
product.  The original's single nested document per brand (all reviews in
one array) would be one row of one task, and is not built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import surrogate_key, with_ordinal
from .summarize import average_rating, rating_stats

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _s(c) -> Column:
    """Export default: missing -> ''."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def review_enrich(reviews: DataFrame, products: DataFrame, *, key: str = "product_code",
                  cols=("product_name",)) -> DataFrame:
    """Copy product columns onto every review.  A plain equi-join: the
    session's broadcast threshold and AQE choose the strategy from sizes."""
    return reviews.join(products.select(key, *cols), key, "left")


def product_reviews(reviews: DataFrame, codes: DataFrame, *, key: str = "product_code") -> DataFrame:
    """Reviews of the given product codes (unknown codes -> nothing)."""
    return reviews.join(codes.select(key), key, "left_semi")


def products_with_reviews(products: DataFrame, reviews: DataFrame, *,
                          key: str = "product_code") -> DataFrame:
    """P5: only products that have reviews.  A key leaves each task once, so
    what a task of the join holds grows with the products, not the reviews."""
    return products.join(reviews.select(key).distinct(), key, "left_semi")


def product_lookup(products: DataFrame, code, *, key: str = "product_code") -> DataFrame:
    """First row with the given code (the filter reaches the
    Parquet scan when ``code`` is a literal)."""
    c = code if isinstance(code, Column) else F.lit(code)
    return products.filter(F.col(key) == c).limit(1)


def product_view(products: DataFrame, summaries: DataFrame, *, key: str = "product_code") -> DataFrame:
    """Product with its summary (1:1) or none."""
    return products.join(summaries, key, "left")


def product_list(products: DataFrame, reviews: DataFrame, summaries: DataFrame | None = None, *,
                 key: str = "product_code", order: str = "pos") -> DataFrame:
    """J7 + W5: every product with its review count (0 kept) and the
    average when a summary exists, numbered 1.. in ``order``.  Reviews are
    aggregated to one row per product before the join (no N+1)."""
    counts = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))
    # numbered first: the narrow table is what is read for the bounds
    j = with_ordinal(products, [order]).join(counts, key, "left").withColumn(
        "n_reviews", F.coalesce("n_reviews", F.lit(0)))
    if summaries is not None:
        j = j.join(summaries.select(key, "average_rating"), key, "left")
    return j


def fk_resolve(reviews: DataFrame, products: DataFrame, *, key: str = "product_code") -> DataFrame:
    """Surrogate product id per review (xxhash64 of the code, no join)
    and whether the product exists."""
    known = products.select(key).distinct().withColumn("_known", F.lit(True))
    return (reviews.withColumn("product_id", surrogate_key(F.col(key))).join(known, key, "left")
            .withColumn("matched", F.coalesce("_known", F.lit(False))).drop("_known"))


def review_preview(reviews: DataFrame, n: int = 10, *, key: str = "product_code",
                   order: str = "pos") -> DataFrame:
    """L1: first n reviews of every product (rank filter -> WindowGroupLimit);
    n = 0 means no limit."""
    w = Window.partitionBy(key).orderBy(order)
    r = reviews.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("rank") <= n) if n else r


def max_products(listing: DataFrame, n: int, *, order: str = "pos") -> DataFrame:
    """L2: cut the listing at n entries (a top-n: each task keeps n rows)."""
    return listing.orderBy(order).limit(n) if n else listing


def summary_struct(stats: DataFrame, *, key: str = "product_code") -> DataFrame:
    """Statistics block per product from review ratings."""
    return stats.select(key, "total_reviews", "positive_count", "negative_count",
                        average_rating().alias("average_rating"))


def product_info_json(products: DataFrame, stats: DataFrame, summaries: DataFrame | None = None,
                      *, key: str = "product_code", crawled_at: Column | None = None) -> DataFrame:
    """One nested document per product: product_info (missing -> ''),
    statistics (missing -> 0), summary (text, key points)."""
    fields = ["product_name", "product_code", "product_url", "category", "sub_category", "price",
              "current_price", "discount_rate", "rating", "review_count", "price_range",
              "usage_method", "ingredients", "precautions"]
    have = set(products.columns)
    j = products.join(stats, key, "left")
    if summaries is not None:
        j = j.join(summaries.select(key, "summary", "key_points"), key, "left")
    info = F.struct(*[_s(f if f in have else F.lit(None).cast("string")).alias(f) for f in fields],
                    (crawled_at if crawled_at is not None else
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("crawled_at"))
    statistics = F.struct(
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce(average_rating(), F.lit(0.0)).alias("average_rating"),
        F.coalesce("positive_count", F.lit(0)).alias("positive_count"),
        F.coalesce("negative_count", F.lit(0)).alias("negative_count"))
    has_sum = "summary" in j.columns
    summary = F.struct(
        _s("summary" if has_sum else F.lit(None).cast("string")).alias("summary_text"),
        F.coalesce(F.col("key_points") if has_sum else F.lit(None).cast("array<string>"),
                   F.array().cast("array<string>")).alias("key_points"))
    doc = F.struct(info.alias("product_info"), statistics.alias("statistics"),
                   summary.alias("summary"))
    return j.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


REVIEW_EXPORT_FIELDS = ["username", "user_info", "age", "gender", "skin_type_1", "skin_type_2",
                        "rating", "option", "review_type", "special_note_1", "special_note_2",
                        "special_note_3", "review_text"]


def review_lines_json(reviews: DataFrame, products: DataFrame, *,
                      key: str = "product_code") -> DataFrame:
    """One JSON line per review with product code and name (J4);
    missing strings -> '', rating stays null (F26)."""
    j = review_enrich(reviews, products, key=key)
    have = set(j.columns)

    def field(f):
        if f == "rating":
            return (F.col("rating") if "rating" in have else F.lit(None).cast("int")).alias(f)
        return _s(f if f in have else F.lit(None).cast("string")).alias(f)
    doc = F.struct(_s(key).alias("product_code"), _s("product_name").alias("product_name"),
                   *[field(f) for f in REVIEW_EXPORT_FIELDS])
    return j.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def product_view_json(products: DataFrame, summaries: DataFrame, *,
                      key: str = "product_code") -> DataFrame:
    """Product info with ISO timestamps and a summary object, or null
    when the product has no summary; its reviews go out one a line
    (``view_review_lines``)."""
    ts = lambda c: F.date_format(F.col(c), ISO_TS) if c in products.columns \
        else F.lit(None).cast("string")
    extra = [c for c in summaries.columns if c != key and c not in products.columns]
    j = products.join(summaries.select(key, *extra).withColumn("_has", F.lit(True)), key, "left")
    info = F.struct(F.col("product_name"), F.col(key),
                    (F.col("product_url") if "product_url" in products.columns
                     else F.lit(None).cast("string")).alias("product_url"),
                    ts("created_at").alias("created_at"), ts("updated_at").alias("updated_at"))
    summ = F.when(F.col("_has"), F.struct(
        F.col("summary"), F.coalesce("key_points", F.array().cast("array<string>")).alias("key_points"),
        F.col("average_rating"), F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("positive_count", F.lit(0)).alias("positive_count"),
        F.coalesce("negative_count", F.lit(0)).alias("negative_count")))
    doc = F.struct(info.alias("product_info"), summ.alias("summary"))
    return j.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


VIEW_REVIEW_FIELDS = ["username", "user_info", "rating", "option", "review_type", "review_text"]


def view_review_lines(reviews: DataFrame, *, key: str = "product_code", id: str = "review_id",
                      created: str = "created_at") -> DataFrame:
    """One JSON line per review of the product view: its id and when it
    was stored (ISO) besides its fields; missing ones stay null."""
    have = set(reviews.columns)
    field = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    at = F.date_format(F.col(created), ISO_TS) if created in have else F.lit(None).cast("string")
    doc = F.struct(field(id, "long").alias("id"), *[field(c, "int" if c == "rating" else "string").alias(c) for c in VIEW_REVIEW_FIELDS],
                   at.alias("created_at"))
    return reviews.select(key, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


__all__ = ["review_enrich", "product_reviews", "products_with_reviews", "product_lookup",
           "product_view", "product_list", "fk_resolve", "review_preview", "max_products",
           "product_info_json", "review_lines_json", "product_view_json", "view_review_lines",
           "rating_stats"]
