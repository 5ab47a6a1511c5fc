"""T1-T3 on Structured Streaming with availableNow triggers."""

import os

from pyspark.sql import functions as F

from loupe.plans import html_fixtures as H
from loupe.session import state_on_disk
from loupe.sources.catalog import read_pointer, read_table
from loupe.streaming import ingest as I

from .conftest import SF001


def _pages(spark):
    p = H.review_pages(spark, SF001)
    return p.select(F.xxhash64("page_key").alias("page_id"), "product_code",
                    F.col("page_key").alias("url"), "html",
                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))


def test_ingest_available_now(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "pages")
    out = os.path.join(tmpdir_path, "reviews")
    pages = _pages(spark)
    pages.write.parquet(src)
    schema = pages.schema
    stream = spark.readStream.schema(schema).parquet(src)
    q = I.ingest(spark, stream, out, name="t1")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    n_docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert got.count() == n_docs  # one card per document, all pages once
    assert {"username", "rating", "review_text", "valid"} <= set(got.columns)


def test_seen_set_drops_repeats(spark):
    df = spark.createDataFrame(
        [("p", "u", "same text", "2024-01-01 00:00:00"), ("p", "u", "same text", "2024-01-02 00:00:00"),
         ("p", "v", "other", "2024-01-01 00:00:00")],
        "product_code string, username string, review_text string, fetched_at string"
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert I.seen_set(df).count() == 2


def test_incremental_summaries_match_batch(spark, tmpdir_path):
    from loupe import config as C
    from loupe.operators.summarize import summarize
    from loupe.plans import fixtures as X
    src = os.path.join(tmpdir_path, "in")
    dv = X.reviews_dv(spark, SF001)
    dv.repartition(3, "doc_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    state = os.path.join(tmpdir_path, "state")
    base = os.path.join(tmpdir_path, "summaries")
    q = I.incremental_summaries(spark, stream, state, base, name="t3", dicts=C.TEST_DICTS)
    q.awaitTermination(300)
    got = read_table(spark, base).select("product_code", "summary", "key_points",
                                         "total_reviews", "positive_count")
    want = summarize(dv, dicts=C.TEST_DICTS).select("product_code", "summary", "key_points",
                                                    "total_reviews", "positive_count")
    norm = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert norm(got) == norm(want)


REVIEWS = "product_code string, username string, review_text string, rating int, option string, pos long, fetched_at timestamp"


def _arrive(spark, src, rows):
    spark.createDataFrame(rows, REVIEWS.replace("timestamp", "string")).withColumn("fetched_at", F.to_timestamp("fetched_at")) \
        .coalesce(1).write.mode("append").parquet(src)


def _day(n):
    return f"2024-01-{n:02d} 00:00:00"


def test_seen_set_remembers_for_the_delay(spark, tmpdir_path):
    """A repeat within the delay of the copy that was kept goes, a later one
    stays and counts from then on; the key is D2's (white space around the
    text, a missing reviewer)."""
    src, out, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ckpt"))
    days = [
        [("p", "u", "same", 5, "", 1, _day(1)), ("p", None, "same", 5, "", 2, _day(1)), ("q", "u", "same", 5, "", 3, _day(1))],
        [("p", "u", "  same\n", 5, "", 4, _day(3)), ("p", "u", "same", 5, "", 5, _day(3)), ("p", "", "same", 5, "", 6, _day(7))],
        [("p", "u", "same", 5, "", 7, _day(9)), ("p", "v", "other", 5, "", 8, _day(9))],   # 8 days after the copy of day 1
        [("p", "u", "same", 5, "", 9, _day(12)), ("p", "u", "same", 5, "", 10, _day(12))],  # 3 days after that of day 9
        [("p", "u", "same", 5, "", 11, _day(20)), ("q", "u", "same", 5, "", 12, _day(20))],
    ]
    kept = []
    for rows in days:
        _arrive(spark, src, rows)
        stream = spark.readStream.schema(REVIEWS).parquet(src)
        with state_on_disk(spark):
            I.seen_set(stream, delay="7 days").writeStream.format("parquet").option("path", out) \
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination(300)
        kept.append(sorted(r.pos for r in spark.read.parquet(out).collect()))
    assert kept == [[1, 2, 3], [1, 2, 3], [1, 2, 3, 7, 8], [1, 2, 3, 7, 8], [1, 2, 3, 7, 8, 11, 12]]


def test_rejected_cards_are_not_stored(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "pages"), os.path.join(tmpdir_path, "reviews")
    good = '<div class="reviewCard"><p class="txt">a review that is long enough to be one</p></div>'
    spark.createDataFrame([(1, "p", good + '<div class="reviewCard"><p>no</p></div>')], "page_id long, product_code string, html string") \
        .write.parquet(src)
    pages = spark.readStream.schema("page_id long, product_code string, html string").parquet(src)
    I.ingest(spark, pages, out, name="t1-rejected").awaitTermination(300)
    assert [r.review_text for r in spark.read.parquet(out).collect()] == ["a review that is long enough to be one"]
    bad = I.rejected(spark.read.parquet(src)).collect()
    assert [r.sample for r in bad] == ['<div class="reviewCard"><p>no</p></div>']


def test_a_batch_rewrites_only_its_buckets(spark, tmpdir_path):
    from loupe import config as C
    from loupe.operators.summarize import summarize
    from loupe.plans import fixtures as X
    state, base = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "summaries")
    dv = X.reviews_dv(spark, SF001)
    run = I.summary_upserter(state, base, dicts=C.TEST_DICTS, buckets=16)
    run(dv.where("doc_id % 3 > 0"), 0)
    before = read_pointer(spark, state, I.MANIFEST)["paths"]
    assert 1 < len(before) <= 16 and all(set(p) == {*I.STATE_TABLES, "summary"} for p in before.values())
    first = dv.agg(F.min("product_code")).first()[0]
    run(dv.where((F.col("doc_id") % 3 == 0) & (F.col("product_code") == first)), 1)
    after = read_pointer(spark, state, I.MANIFEST)["paths"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and len(after) == len(before)
    folders = [d for d in os.listdir(f"{state}/pairs/epoch={1:012d}") if d.startswith("bucket=")]
    assert folders == [f"bucket={changed[0]}"]
    run(dv.where((F.col("doc_id") % 3 == 0) & (F.col("product_code") != first)), 2)
    run(dv.where((F.col("doc_id") % 3 == 0) & (F.col("product_code") != first)), 2)  # replayed
    cols = ["product_code", "summary", "key_points", "total_reviews", "positive_count", "average_rating"]
    norm = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert norm(read_table(spark, base)) == norm(summarize(dv, dicts=C.TEST_DICTS))
