"""Page-walk yield and cut.

The original reads review pages in order, counts new (not yet seen) reviews
per page, and stops at three consecutive zero-yield pages, when the running
total reaches ``max_reviews`` (the whole page is kept), at ``max_pages``, or
at a page without cards.  Here the same cut is computed after the fact with
windows over per-page counts: dedup first (D1 across pages), then count per
page, then running sums per product.  Windows partition by product and hold
one row per page, never one per review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .dedup import digest


def page_walk(reviews: DataFrame, *, key: str = "product_code", page: str = "page_no",
              user: str = "username", text: str = "review_text",
              max_reviews: int | None = None, max_pages: int | None = None,
              zero_stop: int = C.ZERO_YIELD_STOP,
              prefix: int = C.DEDUP_PREFIX_CHARS, card: str | None = None,
              valid: str | None = None) -> DataFrame:
    """Returns one row per kept page: (key, page, new_reviews, running_total).
    ``page`` must number pages densely from 1 within each product; pages
    with zero cards must be present as rows with a NULL ``card`` (by default
    the review text).  Cards that are not ``valid`` yield nothing, but their
    page is not an empty one: it counts towards the zero-yield stop."""
    is_card = F.col(card or text).isNotNull()
    has = is_card & F.col(text).isNotNull() & (F.col(valid) if valid else F.lit(True))
    # a review counts for the first page that has it; its digest is enough for that
    cards = reviews.filter(has)
    hashed = digest([F.coalesce(F.col(user), F.lit("")), F.substring(F.col(text), 1, prefix)])
    first = cards.select(key, page, *hashed).groupBy(key, "_h1", "_h2", "_h3").agg(F.min(page).alias(page))
    yields = first.groupBy(key, page).agg(F.count(F.lit(1)).alias("new_reviews"))
    pages = reviews.groupBy(key, page).agg(F.count(F.when(is_card, 1)).alias("cards"))
    w = Window.partitionBy(key).orderBy(page)
    z = (pages.join(yields, [key, page], "left")
         .withColumn("new_reviews", F.coalesce("new_reviews", F.lit(0)))
         .withColumn("running_total", F.sum("new_reviews").over(
             w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("zero_run", F.sum(F.when(F.col("new_reviews") == 0, 1).otherwise(0))
                     .over(w.rowsBetween(-(zero_stop - 1), 0))))
    stop = (F.col("zero_run") >= zero_stop) | (F.col("cards") == 0)
    if max_reviews:
        stop = stop | (F.col("running_total") >= max_reviews)
    if max_pages:
        stop = stop | (F.col(page) >= max_pages)
    z = z.withColumn("_stop_at", F.min(F.when(stop, F.col(page))).over(Window.partitionBy(key)))
    return (z.filter(F.col("_stop_at").isNull() | (F.col(page) <= F.col("_stop_at")))
            .select(key, page, F.col("new_reviews").cast("long").alias("new_reviews"),
                    F.col("running_total").cast("long").alias("running_total")))
