"""Command-line runner over the operators (the original tool's brand run and
stored-data views).

    python -m loupe run  --pages PATH --store DIR [--run-id ID] [--dedup full|prefix|none]
                         [--output NAME] [--max-products N] [--no-resume]
    python -m loupe list --store DIR
    python -m loupe show --store DIR --code CODE [--preview N] [--export DIR]

``--pages`` is a Parquet table ``(page_id, url, html[, kind, product_code,
page_no])`` or a directory of saved ``*.html`` files.  ``kind`` is one of
``listing``, ``product``, ``notice``, ``reviews`` (default: listing when the
URL names a category/brand page, else product; pages with review cards are
read for reviews as well).  Notice and review pages carry the
``product_code`` they belong to.  Everything runs as Spark jobs; a run's
tables become current together (``sources.catalog.commit``), and exports are
JSON Lines, never files built on the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import urls as U
from .operators import extract as E
from .operators import merge as M
from .operators import records as R
from .operators import views as V
from .operators.dedup import first_by_digest, keep_first, review_key
from .operators.runs import merge_run
from .sources import catalog as CAT
from .sources.facts import page_facts
from .sources.pages import read_pages_dir

TABLES = ("catalog", "products", "reviews", "summaries")


def _load_pages(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet") or CAT.exists(spark, path + "/_SUCCESS"):
        pages = spark.read.parquet(path)
    else:
        pages = read_pages_dir(spark, path)
    cols = set(pages.columns)
    kind = F.col("kind") if "kind" in cols else F.lit(None).cast("string")
    auto = F.when(E.page_kind(F.col("url")) != "product list", F.lit("listing")) \
        .otherwise(F.lit("product"))
    return pages.select(
        "page_id", "url", "html",
        F.coalesce(kind, auto).alias("kind"),
        (F.col("product_code") if "product_code" in cols else F.lit(None).cast("string"))
        .alias("page_product"),
        (F.col("page_no") if "page_no" in cols else F.lit(1)).cast("int").alias("page_no"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extract_run(pages: DataFrame, run_no: int, run_ts: Column, bronze: str, catalog: DataFrame | None = None,
                max_products: int | None = None) -> dict:
    """Pages of one run -> its listings (C6, C7), the products that earlier
    runs do not have (J1: ``catalog``) with what their listing knows (J2) and
    their notices (J3), and their walked reviews (C3, C4); rejected cards and
    pages whose markup broke off go to quarantine tables (S11)."""
    # pages are parsed once: all tables of the run, and each replay of their
    # lineage, read the stored facts
    facts = _stored(page_facts(R.raw_html_features(pages), keys=["page_id"], passthrough=["url", "kind", "page_product", "page_no"]
                               + R.RAW_FEATURES, cards=True), f"{bronze}/facts")
    # a page's product: as given, or from its URL, meta, data attributes or script
    own = U.code_cascade(F.col("url"), E.meta_content("facts", C.META_CODE_PROPERTY),
                         E.data_attr("facts"), E.script_var("facts"))
    facts = facts.withColumn("page_product", F.coalesce(F.nullif("page_product", F.lit("")),
                                                        F.nullif(own, F.lit(""))))
    listing_pages = facts.filter(F.col("kind") == "listing")
    entries = R.extract_listing(listing_pages, max_products=max_products)
    entries = _stored(entries, f"{bronze}/listing")
    known = (catalog.select("product_code", F.coalesce(U.url_serial(F.col("product_url")), F.lit("")).alias("serial"))
             if catalog is not None else entries.limit(0).select("product_code", "serial"))
    listings = R.listing_totals(listing_pages, known, keys=("page_id",))
    prods = R.extract_products(facts.filter(F.col("kind") == "product"), whole=True)
    prods = M.fill_from_listing(prods, first_by_digest(entries, ["product_url"], ["page_id", "pos"]))
    prods = M.resume_anti(prods.withColumn("serial", F.col("online_sn")), known, known).drop("serial")
    notices = (R.extract_notices(facts.filter(F.col("kind") == "notice"), keys=("page_id", "page_product"), whole=True)
               .withColumnRenamed("page_product", "product_code"))
    # one notice per product (first page), its non-empty texts win
    prods = M.notice_override(prods, keep_first(notices, ["product_code"], "page_id"))
    text = lambda c: F.col(c).cast("string").alias(c)
    new_products = M.with_key(prods, key="product_code").select(
        "product_code", "product_name", "product_url", "category", "sub_category", text("price"), text("current_price"),
        "price_range", F.concat(F.col("discount_pct").cast("string"), F.lit("%")).alias("discount_rate"), "rating",
        text("review_count"), "usage_method", "ingredients", "precautions", F.col("page_id").alias("pos"),
        F.lit(run_no).alias("run_ts"))
    # a review page without cards is kept, as it ends its product's walk
    cards = E.explode_cards(
        facts.filter((F.col("kind") == "reviews") | E.found_cards().isNotNull()),
        keys=("page_id", "page_product", "page_no"), empty_pages=True)
    reviews = R.parse_reviews(cards).withColumnRenamed("page_product", "product_code") \
        .filter(F.col("product_code").isNotNull())
    reviews = _stored(M.resume_anti(reviews.withColumn("serial", F.lit("")), known, known).drop("serial"), f"{bronze}/cards")
    walked = R.walk_reviews(reviews)
    id_of = F.xxhash64("product_code", F.coalesce("username", F.lit("")), review_key(F.col("review_text"), "full"))
    new_reviews = walked.select(
        "product_code", "username", "user_info", "age", "gender", "skin_type_1", "skin_type_2",
        "rating", "option", "review_type", "special_note_1", "special_note_2", "special_note_3", "features",
        "review_text", id_of.alias("review_id"), run_ts.alias("created_at"),
        F.struct(F.lit(run_no).alias("run"), "page_no", "page_id", "pos").alias("pos"))
    rejected = reviews.filter(F.col("text").isNotNull() & ~F.coalesce(F.col("valid"), F.lit(False))) \
        .select("product_code", "page_id", "page_no", "pos", "sample")
    return {"products": new_products, "reviews": new_reviews, "listings": listings, "rejected": rejected,
            "unparsed": E.unparsed(facts)}


def base_name(spark: SparkSession, given: str | None, listings: DataFrame, run_ts: Column) -> str:
    """What the run's exports are called: the given name's end, the first
    listing's name, or the day."""
    brand = listings.filter("name <> 'unknown'").agg(F.min(F.struct("page_id", "name"))["name"].alias("brand"))
    name = brand.select(CAT.output_base_name(F.lit(given), F.col("brand"), run_ts)).first()[0]
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in name)


def run(spark: SparkSession, pages_path: str, store: str, run_id: str, dedup: str = "full", output: str | None = None,
        max_products: int | None = None, resume: bool = True):
    """One crawl run into the store (C8): all tables or none."""
    now = dt.datetime.now().replace(microsecond=0)
    run_ts, run_no = CAT.run_stamp(now.isoformat(sep=" ")), int(now.strftime("%Y%m%d%H%M%S"))  # taken once a run (S12)
    version = CAT.store_version(spark, store)
    old = {t: CAT.read_store(spark, store, t, version) for t in TABLES}
    new = extract_run(_load_pages(spark, pages_path), run_no, run_ts, f"{store}/bronze/{run_id}",
                      old["catalog"] if resume else None, max_products)
    paths, totals = {}, {}

    def keep(table: str, df: DataFrame) -> DataFrame:  # A15: rows counted while they are written
        key = "product_code" if table in TABLES else None
        paths[table], totals[table] = CAT.write_part(df, store, table, run_id, sort_key=key)
        return spark.read.schema(df.schema).parquet(paths[table])

    fresh = {t: keep(f"new_{t}", new[t]) for t in ("products", "reviews")}
    merge_run(old["catalog"] if old["catalog"] is not None else fresh["products"].limit(0),
              old["products"], old["reviews"] if old["reviews"] is not None else fresh["reviews"].limit(0),
              old["summaries"], fresh["products"], fresh["reviews"], run_ts=run_ts, dedup=dedup, keep=keep)
    listings = keep("listings", new["listings"])
    for t in ("rejected", "unparsed"):
        keep(t, new[t])
    name = base_name(spark, output, listings, run_ts)
    CAT.commit(spark, store, version, run_id, paths, totals=totals, name=name)
    cur = {t: CAT.read_store(spark, store, t) for t in (*TABLES, "listings", "rejected", "unparsed")}
    cur["totals"] = totals
    stats = V.rating_stats(cur["reviews"])
    CAT.write_lines(V.product_info_json(R.exported(cur["products"]), stats, cur["summaries"]),
                    f"{store}/exports/{run_id}/info_{name}")
    CAT.write_lines(V.review_lines_json(cur["reviews"], cur["products"]),
                    f"{store}/exports/{run_id}/review_{name}")
    return cur


def list_products(spark: SparkSession, store: str) -> DataFrame:
    """The product list view (J7 + W5)."""
    p, r, s = (CAT.read_store(spark, store, t) for t in ("products", "reviews", "summaries"))
    return V.product_list(p.withColumn("pos", F.col("product_code")), r,
                          s.select("product_code", "average_rating"))


def show_product(spark: SparkSession, store: str, code: str, preview: int = 10,
                 export: str | None = None) -> dict:
    """One product: info, summary, first reviews; optional export (S10 plus
    review lines)."""
    p = V.product_lookup(CAT.read_store(spark, store, "products"), code)
    r = CAT.read_store(spark, store, "reviews").filter(F.col("product_code") == code)
    s = CAT.read_store(spark, store, "summaries").filter(F.col("product_code") == code)
    out = {"product": p, "summary": s, "preview": V.review_preview(r, preview)}
    if export:
        CAT.write_lines(V.product_view_json(p, s), f"{export}/product")
        CAT.write_lines(V.view_review_lines(r), f"{export}/reviews")
    return out


def main(argv=None):
    ap = argparse.ArgumentParser(prog="python -m loupe")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("--pages", required=True)
    r.add_argument("--store", required=True)
    r.add_argument("--run-id", default=dt.datetime.now().strftime("run=%Y%m%d%H%M%S"))
    r.add_argument("--dedup", default="full", choices=["full", "prefix", "none"])
    r.add_argument("--output")
    r.add_argument("--max-products", type=int)
    r.add_argument("--no-resume", action="store_true")
    ls = sub.add_parser("list")
    ls.add_argument("--store", required=True)
    sh = sub.add_parser("show")
    sh.add_argument("--store", required=True)
    sh.add_argument("--code", required=True)
    sh.add_argument("--preview", type=int, default=10)
    sh.add_argument("--export")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("loupe").getOrCreate()
    if a.cmd == "run":
        cur = run(spark, a.pages, a.store, a.run_id, a.dedup, a.output, a.max_products, not a.no_resume)
        print("run totals:", cur["totals"])
        for r in cur["summaries"].select("product_code", "total_reviews",
                                         "average_rating").toLocalIterator():
            print(*r, sep="\t")
    elif a.cmd == "list":
        for r in list_products(spark, a.store).orderBy("ordinal").toLocalIterator():
            print(*r, sep="\t")
    else:
        out = show_product(spark, a.store, a.code, a.preview, a.export)
        out["product"].show(1, False)
        out["summary"].show(1, False)
        out["preview"].show(a.preview, False)

