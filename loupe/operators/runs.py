"""Run-level composites (C8, C9): what one crawl run does to the stored
tables, as DataFrame plans.

``merge_run`` folds a new run into the stored catalogue, reviews and
summaries: catalogue merge (D5), review append then documented dedup
(D3 + D2), product upsert (D6), summaries recomputed for the products that
have reviews in the run (A14) and upserted (D8).  ``run_product`` is the
single-product form with the preview (L1) and the two exports (S6, S7).
Nothing is collected; callers write the returned frames (``sources.catalog``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import dedup as D
from . import merge as M
from . import summarize as S
from . import views as V


def merge_run(catalog: DataFrame, products: DataFrame | None, reviews: DataFrame,
              summaries: DataFrame | None, new_products: DataFrame, new_reviews: DataFrame, *,
              run_ts: Column, key: str = "product_code", dedup: str = "full",
              dicts: C.Dictionaries = C.DEFAULT_DICTS, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> dict:
    """C8.  ``catalog`` / ``new_products`` carry ``run_ts`` and ``pos``;
    reviews carry ``pos`` (first-seen order); ``products`` and ``summaries``
    are the stored tables (with ``created_at`` / ``updated_at``) or None on
    the first run.  Returns the new catalogue, reviews, products and
    summaries.  ``keep(name, table)`` may store each table and return it read
    back, so that what is built on it does not build it again."""
    keep = keep or (lambda _, df: df)
    fields = [c for c in new_products.columns if c not in (key, "run_ts", "pos")]
    merged_catalog = keep("catalog", D.catalog_merge(catalog, new_products, key=key))
    merged_reviews = keep("reviews", D.merge_append(reviews, new_reviews, dedup=dedup, key=key))
    # only products with reviews in this run are stored and summarised (P5)
    with_reviews = V.products_with_reviews(new_products, new_reviews, key=key).select(key, *fields)
    if products is None:
        new_table = (with_reviews.withColumn("created_at", run_ts)
                     .withColumn("updated_at", run_ts))
    else:
        new_table = M.upsert(products, with_reviews, key=key, fields=fields, run_ts=run_ts)
    touched = with_reviews.select(key)
    fresh = S.summarize(merged_reviews.join(touched, key, "left_semi"),
                        with_reviews.select(key, "product_name"), key=key, dicts=dicts)
    if summaries is None:
        new_summaries = fresh.withColumn("created_at", run_ts).withColumn("updated_at", run_ts)
    else:
        metrics = [c for c in fresh.columns if c != key]
        new_summaries = M.upsert(summaries, fresh, key=key, fields=metrics, run_ts=run_ts,
                                 absent_is_null=False)
    return {"catalog": merged_catalog, "reviews": merged_reviews, "products": keep("products", new_table),
            "summaries": keep("summaries", new_summaries)}


def run_totals(existing: DataFrame, new: DataFrame, *, key: str = "product_code", user: str = "username",
               text: str = "review_text") -> DataFrame:
    """One row: reviews stored, new, appended, left after the dedup (D2),
    and products.  Each table is read once; exact distinct counts come from
    two levels of aggregation, of the review's digest and then of the product,
    both combined before they are dealt."""
    tagged = None
    for old, df in ((1, existing), (0, new)):
        said = D.review_key(F.col(text), "full")
        rows = df.select(F.col(key).alias("_p"), *D.digest([F.coalesce(F.col(user), F.lit("")), said]), F.lit(old).alias("_old"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    reviews = tagged.groupBy("_p", "_h1", "_h2", "_h3").agg(F.sum("_old").alias("_old"), F.count(F.lit(1)).alias("_n"))
    products = reviews.groupBy("_p").agg(F.sum("_old").alias("_old"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_merged"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return products.agg(n("_old").alias("n_existing"), (n("_n") - n("_old")).alias("n_new"), n("_n").alias("n_appended"),
                        n("_merged").alias("n_merged"), F.count("_p").alias("n_products"))


def run_product(product: DataFrame, reviews: DataFrame, *, key: str = "product_code",
                preview: int = 10, dicts: C.Dictionaries = C.DEFAULT_DICTS,
                crawled_at: Column | None = None) -> dict:
    """One product's summary, review preview and the two exports."""
    summ = S.summarize(reviews, product.select(key, "product_name"), key=key, dicts=dicts)
    stats = S.rating_stats(reviews, key=key)
    return {
        "summary": summ,
        "preview": V.review_preview(reviews, preview, key=key),
        "info_json": V.product_info_json(product, stats, summ, key=key, crawled_at=crawled_at),
        "reviews_json": V.review_lines_json(reviews, product.select(key, "product_name"), key=key),
    }
