"""JSON catalogue files, snapshots, page directories."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loupe.sources import catalog as CAT
from loupe.sources.pages import read_pages_dir


def test_catalog_read_counts_corrupt_and_drops_keyless(spark, tmpdir_path):
    good = {"brand_url": "u", "crawled_at": "2024-01-01 00:00:00", "total_products": 3,
            "products": [{"product_code": "a", "product_name": "A"},
                         {"product_code": "", "product_name": "no key"},
                         {"product_code": "b", "product_name": "B"}]}
    with open(os.path.join(tmpdir_path, "info_x.json"), "w", encoding="utf-8") as f:
        json.dump(good, f, ensure_ascii=False, indent=2)
    with open(os.path.join(tmpdir_path, "info_bad.json"), "w") as f:
        f.write("{not json")
    prods, bad = CAT.read_catalog(spark, tmpdir_path)
    assert sorted(r["product_code"] for r in prods.collect()) == ["a", "b"]
    assert bad.count() == 1


def test_missing_catalog_is_empty(spark, tmpdir_path):
    prods, bad = CAT.read_catalog(spark, os.path.join(tmpdir_path, "nope"))
    assert prods.count() == 0 and bad.count() == 0


def test_envelope_roundtrip(spark, tmpdir_path):
    doc = {"brand_url": "u", "crawled_at": "t", "total_products": 2,
           "products": [{"product_code": "a", "product_name": "A"}, {"product_code": "b", "product_name": None}]}
    path = os.path.join(tmpdir_path, "env")
    os.makedirs(path)
    with open(os.path.join(path, "f.json"), "w") as f:
        json.dump(doc, f)
    prods, _ = CAT.read_catalog(spark, path)
    assert [r["product_code"] for r in prods.orderBy("pos").collect()] == ["a", "b"]


def test_files_of_other_versions_are_kept_and_counted(spark, tmpdir_path):
    """More fields, fewer, other types, items that are no objects, another
    shape, no JSON: nothing is dropped unseen."""
    files = {
        "now.json": {"brand_url": "u", "reviews": [{"username": "a", "rating": 5, "product_code": "p"}]},
        "more.json": {"brand_url": "u", "schema": 2, "reviews": [
            {"username": "b", "rating": 4, "helpful": 12, "photos": ["x", "y"]}, {"username": "c"}]},
        "less.json": {"reviews": [{"rating": "4"}, {"rating": [1]}, "oops", None]},
        "shape.json": {"brand_url": "u", "items": []},
        "empty.json": {"brand_url": "u", "reviews": []},
    }
    for name, doc in files.items():
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=1)
    with open(os.path.join(tmpdir_path, "cut.json"), "w") as f:
        f.write('{"brand_url": "u", "reviews": [{"usern')
    rows, bad = CAT.read_reviews(spark, tmpdir_path)
    got = {(r.file.rsplit("/", 1)[1], r.pos): r for r in rows.withColumn("more", F.to_json("more")).collect()}
    assert sorted(got) == [("less.json", 0), ("less.json", 1), ("more.json", 0), ("more.json", 1), ("now.json", 0)]
    assert got["now.json", 0].rating == 5 and got["now.json", 0].brand_url == "u" and got["now.json", 0].more == "{}"
    assert json.loads(got["more.json", 0].more) == {"helpful": 12, "photos": ["x", "y"]}
    assert got["less.json", 0].rating == 4 and got["less.json", 1].rating is None and got["more.json", 1].rating is None
    seen = {r.file.rsplit("/", 1)[1]: (r.status, r.n_items, r.n_odd) for r in bad.collect()}
    assert seen == {"less.json": ("ok", 4, 2), "shape.json": ("no items", 0, 0), "cut.json": ("broken", 0, 0)}
    assert bad.filter("status = 'broken'").first().sample.startswith('{"brand_url"')


def test_tables_become_current_together(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    assert CAT.store_version(spark, store) == 0 and CAT.read_store(spark, store, "a") is None

    def parts(n, run):
        return {t: CAT.write_part(spark.range(n).withColumnRenamed("id", "k"), store, t, run, sort_key="k")[0] for t in "abcd"}

    assert CAT.commit(spark, store, 0, "r1", parts(3, "r1")) == 1
    for written in range(5):  # a run that dies after any number of its writes, the last one just before its commit
        for t in "abcd"[:written]:
            CAT.write_part(spark.range(9).withColumnRenamed("id", "k"), store, t, "dead")
        assert [CAT.read_store(spark, store, t).count() for t in "abcd"] == [3] * 4
    second, third = parts(4, "r2"), parts(5, "r3")
    assert CAT.commit(spark, store, 1, "r2", second) == 2
    with pytest.raises(CAT.StoreChanged):  # it read version 1 as well
        CAT.commit(spark, store, 1, "r3", third)
    assert [CAT.read_store(spark, store, t).count() for t in "abcd"] == [4] * 4
    assert CAT.commit(spark, store, 2, "r4", {"a": third["a"]}, note="only one") == 3
    assert [CAT.read_store(spark, store, t).count() for t in "abcd"] == [5, 4, 4, 4]
    assert CAT.read_store(spark, store, "a", version=1).count() == 3
    assert CAT.read_manifest(spark, store)["note"] == "only one"
    path, rows = CAT.write_part(spark.range(7), store, "a", "r5")
    assert rows == 7 and spark.read.parquet(path).count() == 7


def test_snapshots_swap_pointer(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "products")
    assert CAT.read_table(spark, base) is None
    CAT.write_snapshot(spark.range(3).withColumnRenamed("id", "k"), base, "run1", bucket_key="k")
    CAT.write_snapshot(spark.range(5).withColumnRenamed("id", "k"), base, "run2", bucket_key="k")
    assert CAT.read_table(spark, base).count() == 5
    assert spark.read.parquet(f"{base}/snapshots/run1").count() == 3


def test_pages_dir(spark, tmpdir_path):
    for i in range(3):
        with open(os.path.join(tmpdir_path, f"p{i}.html"), "w", encoding="utf-8") as f:
            f.write(f"<html><body><h1>page {i}</h1>\n<p>x</p></body></html>")
    df = read_pages_dir(spark, tmpdir_path)
    assert df.count() == 3
    assert df.select(F.count_distinct("page_id")).first()[0] == 3
    assert all("\n" in r["html"] for r in df.collect())


def test_output_base_name(spark):
    df = spark.createDataFrame([("out_lipcare", "B"), ("", "B"), ("", "")], "g string, b string")
    got = [r[0] for r in df.select(CAT.output_base_name(
        F.col("g"), F.col("b"), F.lit("2024-03-05 10:00:00").cast("timestamp"))).collect()]
    assert got == ["lipcare", "B", "brand_20240305"]


def test_write_observed_counts_rows(spark, tmpdir_path):
    path, m = CAT.write_snapshot_observed(spark.range(7).withColumnRenamed("id", "k"),
                                          os.path.join(tmpdir_path, "t"), "r1")
    assert m["rows"] == 7 and spark.read.parquet(path).count() == 7
