"""Composite operators and join helpers."""

from pyspark.sql import functions as F

from loupe.operators import joins as J
from loupe.operators import records as R
from loupe.plans import html_fixtures as H

from .conftest import SF001


def test_walk_reviews_keeps_every_distinct_review(spark):
    cards = H.review_cards(spark, SF001)
    reviews = R.parse_reviews(cards)
    walked = R.walk_reviews(reviews)
    n_docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    # no repeated cards and no three empty pages in a row: nothing is cut,
    # only the 50-char-prefix duplicates (same user) collapse
    dedup_keys = reviews.select("product_code", "username",
                                F.substring("review_text", 1, 50)).distinct().count()
    assert walked.count() == dedup_keys <= n_docs


def test_walk_reviews_stops_after_three_empty_pages(spark):
    cards = H.review_cards(spark, SF001)
    reviews = R.parse_reviews(cards)
    # repeat every product's first page as pages 1001-1004: zero new reviews
    first = reviews.filter(F.col("page_no") == 1)
    extra = None
    for p in (1001, 1002, 1003, 1004):
        page = first.withColumn("page_no", F.lit(p).cast("long"))
        extra = page if extra is None else extra.unionByName(page)
    dense = reviews.unionByName(extra)
    from pyspark.sql import Window
    w = Window.partitionBy("product_code").orderBy("page_no")
    pages = dense.select("product_code", "page_no").distinct() \
        .withColumn("dense", F.dense_rank().over(w))
    dense = dense.join(pages, ["product_code", "page_no"]).drop("page_no") \
        .withColumnRenamed("dense", "page_no")
    from loupe.operators.walk import page_walk
    kept = page_walk(dense.filter("valid"))
    last = kept.groupBy("product_code").agg(F.max("page_no").alias("m"))
    n_pages = pages.groupBy("product_code").agg(F.max("dense").alias("n"))
    rows = last.join(n_pages, "product_code").collect()
    assert all(r["m"] == r["n"] - 1 for r in rows)  # stops at the third empty page


def test_with_ordinal_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, numPartitions=7).select((F.col("id") * 3 % 1000).alias("k"))
    out = J.with_ordinal(df, ["k"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in out] == list(range(1, 1001))
    ks = [r["k"] for r in out]
    assert ks == sorted(ks)


def test_dimension_join_leaves_the_strategy_to_spark(spark):
    from loupe.operators import views as V
    fact = spark.read.parquet(f"{SF001}/lineitem.parquet").withColumnRenamed("l_partkey", "product_code")
    dim = spark.read.parquet(f"{SF001}/part.parquet").select(
        F.col("p_partkey").alias("product_code"), F.col("p_name").alias("product_name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (V.review_enrich(fact, dim), V.fk_resolve(fact, dim)):
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_merge_run_twice_is_stable(spark):
    from loupe import config as C
    from loupe.operators.runs import merge_run, run_product
    from loupe.plans import fixtures as X
    docs = X.reviews_dv(spark, SF001)
    prods = X.products_dv(spark, SF001).withColumn("run_ts", F.lit(1))
    empty_cat = prods.limit(0)
    r1 = merge_run(empty_cat, None, docs.limit(0), None, prods, docs,
                   run_ts=F.lit("2024-01-01").cast("timestamp"), dicts=C.TEST_DICTS)
    n_products = r1["products"].count()
    assert n_products == prods.count() == r1["summaries"].count()
    # the same run again: nothing new, summaries unchanged, created kept
    prods2 = prods.withColumn("run_ts", F.lit(2))
    r2 = merge_run(r1["catalog"], r1["products"], r1["reviews"], r1["summaries"], prods2, docs,
                   run_ts=F.lit("2024-02-01").cast("timestamp"), dicts=C.TEST_DICTS)
    assert r2["reviews"].count() == r1["reviews"].count()
    a = sorted((r["product_code"], r["summary"]) for r in r1["summaries"].collect())
    b = sorted((r["product_code"], r["summary"]) for r in r2["summaries"].collect())
    assert a == b
    created = {r["product_code"]: r["created_at"] for r in r2["summaries"].collect()}
    assert all(str(v).startswith("2024-01-01") for v in created.values())
    one = prods.filter(F.col("product_code") == "src1")
    out = run_product(one, docs.filter(F.col("product_code") == "src1"), dicts=C.TEST_DICTS)
    assert out["summary"].count() == 1 and out["preview"].count() == 10
    assert out["info_json"].count() == 1


def test_cli_run_list_show(spark, tmpdir_path):
    import os
    from loupe import cli
    pages_path = os.path.join(tmpdir_path, "pages.parquet")
    prod = H.product_pages(spark, SF001).select(
        "page_id", "url", "html", F.lit("product").alias("kind"),
        F.lit(None).cast("string").alias("product_code"), F.lit(1).alias("page_no"))
    notice = H.notice_pages(spark, SF001).select(
        (F.col("page_id") + 1_000_000).alias("page_id"), F.lit("n").alias("url"), "html",
        F.lit("notice").alias("kind"), F.col("page_id").cast("string").alias("product_code"),
        F.lit(1).alias("page_no"))
    # review pages keyed to the first products' codes (sources src0.. -> parts 1..)
    rp = H.review_pages(spark, SF001).select(
        F.xxhash64("page_key").alias("page_id"), F.col("page_key").alias("url"), "html",
        F.lit("reviews").alias("kind"),
        (F.regexp_extract("product_code", r"(\d+)", 1).cast("int") + 1).cast("string")
        .alias("product_code"), F.col("page_no").cast("int").alias("page_no"))
    prod.unionByName(notice).unionByName(rp).write.parquet(pages_path)
    store = os.path.join(tmpdir_path, "store")
    cur = cli.run(spark, pages_path, store, "run=1")
    n_summ = cur["summaries"].count()
    assert cur["totals"]["summaries"] == n_summ
    # products with reviews in the run (small parts report the meta code 'M<k>'
    # on their product page, so their reviews attach to no product: P5)
    expected = rp.select("product_code").distinct().join(
        cur["products"].select("product_code"), "product_code").count()
    assert n_summ == expected == cur["products"].count() and n_summ > 0
    again = cli.run(spark, pages_path, store, "run=2")
    assert again["reviews"].count() == cur["reviews"].count()
    lst = cli.list_products(spark, store).collect()
    assert len(lst) == n_summ and sorted(r["ordinal"] for r in lst) == list(range(1, n_summ + 1))
    out = cli.show_product(spark, store, "1", export=os.path.join(tmpdir_path, "exp"))
    assert out["product"].count() == 1 and out["preview"].count() >= 1
    assert spark.read.json(os.path.join(tmpdir_path, "exp", "reviews")).count() >= 1
