"""Plan checks: the shapes the design relies on."""

import re

from pyspark.sql import functions as F

from loupe import config as C
from loupe.operators import merge as M
from loupe.operators import summarize as S
from loupe.operators import views as V
from loupe.plans import fixtures as X
from loupe.plans import html_fixtures as H
from loupe.plans.registry import all_queries

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + \
        df._jdf.queryExecution().optimizedPlan().toString()


def test_resume_anti_join_is_not_nested_loop(spark):
    q = all_queries()["resume_anti"](spark, SF001)
    p = _plan(q)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_summaries_stay_in_the_jvm(spark):
    q = S.summarize(X.reviews_dv(spark, SF001), dicts=C.TEST_DICTS)
    p = _plan(q)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"):
        assert node not in p


def test_topk_uses_window_group_limit(spark):
    q = all_queries()["review_preview"](spark, SF001)
    assert "WindowGroupLimit" in q._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in q._jdf.queryExecution().optimizedPlan().toString()


def test_point_lookup_pushes_filter_to_scan(spark):
    p = spark.read.parquet(f"{SF001}/part.parquet").filter(F.col("p_partkey") == 7).limit(1)
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,7)]" in \
        p._jdf.queryExecution().executedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_operator_pushes_filter_to_scan(spark, tmpdir_path):
    from loupe.operators import views as V
    from loupe.sources import catalog as CAT
    path, _ = CAT.write_part(X.products_pr(spark, SF001), tmpdir_path, "products", "r1", sort_key="product_code")
    p = _physical(V.product_lookup(spark.read.parquet(path), "7"))
    assert "PushedFilters: [IsNotNull(product_code), EqualTo(product_code,7)]" in p
    # the code that the data gives is a subquery of the scan's own filter
    q = _physical(all_queries()["product_lookup"](spark, SF001))
    assert re.search(r"DataFilters: \[[^\]]*p_partkey#\d+L? = [^\]]*scalar-subquery|DataFilters: \[[^\]]*Subquery[^\]]*p_partkey|p_partkey#\d+L? = Subquery", q)


def test_reviews_are_deduplicated_by_digest(spark):
    for name in ("dedup_prefix", "dedup_full", "merge_append"):
        p = _physical(all_queries()[name](spark, SF001))
        assert "SortAggregate" not in p and "ObjectHashAggregate" not in p, name
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", p)
        assert dealt and not any("text" in keys for keys in dealt), dealt


def test_pages_are_parsed_once(spark):
    for name in ("brand_run", "listing_completeness", "product_bundle", "page_totals", "listing_products"):
        assert len(re.findall(r"\bMapInArrow\b", _physical(all_queries()[name](spark, SF001)))) == 1, name


def test_totals_and_checks_read_each_table_once(spark):
    p = _physical(all_queries()["constraint_check"](spark, SF001))
    assert p.count("FileScan") == 2 and "Expand" not in p
    q = all_queries()["run_totals"](spark, SF001)
    main = _physical(q).split("+- == Initial Plan ==")[0]
    assert "Expand" not in main and "SortAggregate" not in main
    # old run, new run, and the largest id, which says what the runs are
    assert main.count("FileScan") - main.count("max(doc_id") <= 2 or main.count("FileScan") <= 4


def test_product_list_is_lazy(spark):
    from loupe.operators import views as V
    rv, prods = X.reviews_rv(spark, SF001), X.products_pr(spark, SF001)  # opening a file reads its footer
    spark.sparkContext.setJobGroup("lazy", "building a plan")
    try:
        q = V.product_list(prods, rv, S.rating_stats(rv).withColumn("average_rating", S.average_rating()))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n = prods.count()
    assert sorted(r.ordinal for r in q.select("ordinal").collect()) == list(range(1, n + 1)) and n > 0


def test_stored_tables_are_not_shuffled(spark):
    """In buckets of the join's key: only the other side is dealt out."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        up = _physical(all_queries()["stored_upsert"](spark, SF001))
        resume = _physical(all_queries()["stored_resume"](spark, SF001))
    finally:
        spark.conf.set(conf, before)
    assert up.count("Exchange hashpartitioning") == 1 and up.count("Bucketed: true") == 1
    # the listing once for each of the two look-ups
    assert resume.count("Exchange hashpartitioning") == 2 and resume.count("Bucketed: true") == 2


def test_summary_reads_its_reviews_twice(spark):
    reviews = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("source").alias("product_code"), F.lit("u").alias("username"), F.lit(5).alias("rating"), F.col("lang").alias("option"),
        F.col("text").alias("review_text"), F.col("doc_id").alias("pos"))
    p = _physical(S.summarize(reviews, dicts=C.TEST_DICTS))
    assert p.count("FileScan") == 2


def test_scan_prunes_columns(spark):
    q = all_queries()["product_summary"](spark, SF001)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan


def test_python_only_in_page_facts(spark):
    q = all_queries()["review_facts"](spark, SF001)
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_no_cross_join_in_registered_queries(spark):
    qs = all_queries()
    for name in ("brand_run", "run_totals", "product_lookup", "merge_append", "product_list"):
        p = _plan(qs[name](spark, SF001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_upsert_is_one_full_outer_join(spark):
    cur = X.catalog_old(spark, SF001).withColumn("created_at", F.lit(1)) \
        .withColumn("updated_at", F.lit(1))
    up = M.upsert(cur, X.catalog_new(spark, SF001), key="product_code",
                  fields=["product_name"], run_ts=F.lit(2))
    assert _plan(up).count("FullOuter") >= 1


def test_no_round_robin_exchange(spark):
    qs = all_queries()
    for name in ("keyword_counts", "cohort_phrases", "export_reviews", "page_links"):
        assert "RoundRobinPartitioning" not in _plan(qs[name](spark, SF001)), name


def test_pages_of_a_short_table_are_built_by_many_tasks(spark):
    """A table of short rows is one split, its pages are not."""
    for pages in (H.product_pages, H.notice_pages):
        used = pages(spark, SF001).select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism


def test_reviews_leave_a_task_once_a_product(spark):
    """What is joined to the products grows with them, not with the reviews (F16)."""
    products = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "product_code string")
    reviews = spark.createDataFrame([("a",)] * 5 + [("c",), (None,)], "product_code string")
    q = V.products_with_reviews(products, reviews)
    assert [r.product_code for r in q.collect()] == ["a", "a"]
    assert re.search(r"Join LeftSemi.*\n.*\n(.*\n)*.*Aggregate \[product_code", q._jdf.queryExecution().optimizedPlan().toString())
