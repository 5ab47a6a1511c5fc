"""Properties: idempotence, no-op re-merge, partition-order invariance."""

from pyspark.sql import functions as F

from loupe import config as C
from loupe.operators import dedup as D
from loupe.operators import summarize as S
from loupe.operators.walk import page_walk
from loupe.plans import fixtures as X

from .conftest import SF001


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_idempotent(spark):
    d = X.docs_as_reviews(spark, SF001)
    once = D.dedup_reviews(d, rule="full")
    twice = D.dedup_reviews(once, rule="full")
    assert _rows(once.select("doc_id")) == _rows(twice.select("doc_id"))


def test_merge_same_run_twice_is_noop(spark):
    d = X.docs_as_reviews(spark, SF001)
    once = D.dedup_reviews(d, rule="full")
    again = D.merge_append(once, d)
    assert _rows(once.select("doc_id")) == _rows(again.select("doc_id"))


def test_positive_negative_mid_partition_total(spark):
    s = S.rating_stats(X.reviews_rv(spark, SF001))
    mid = (X.reviews_rv(spark, SF001).filter(F.coalesce("rating", F.lit(0)) == 3)
           .groupBy("product_code").count())
    j = s.join(mid, "product_code", "left").select(
        (F.col("positive_count") + F.col("negative_count") + F.coalesce("count", F.lit(0))
         == F.col("total_reviews")).alias("ok"))
    assert all(r["ok"] for r in j.collect())


def test_page_walk_is_prefix(spark):
    out = page_walk(X.walk_pages(spark, SF001)).groupBy("product_code").agg(
        F.max("page_no").alias("mx"), F.count(F.lit(1)).alias("n"), F.min("page_no").alias("mn"))
    assert all(r["mx"] == r["n"] and r["mn"] == 1 for r in out.collect())


def test_summary_invariant_under_partition_permutation(spark):
    dv = X.reviews_dv(spark, SF001)
    a = S.summarize(dv, dicts=C.TEST_DICTS).select("product_code", "summary", "key_points")
    shuffled = dv.repartition(7, F.rand(seed=3)).sortWithinPartitions(F.rand(seed=5))
    b = S.summarize(shuffled, dicts=C.TEST_DICTS).select("product_code", "summary", "key_points")
    assert _rows(a) == _rows(b)


def test_top_option_ties_go_to_first_seen(spark):
    df = spark.createDataFrame([("p", "b", 1), ("p", "a", 2), ("p", "a", 3), ("p", "b", 4)],
                               "product_code string, option string, pos int")
    r = S.top_option(df).first()
    assert (r["top_option"], r["top_option_n"]) == ("b", 2)
