"""A brand run with listings, resume and one commit."""

import os

import pytest

from loupe import cli
from loupe.sources import catalog as CAT

BASE = "https://shop.example.com/product/detail?onlineProdSn="
SCHEMA = "page_id long, url string, html string, kind string, product_code string, page_no int"


def listing(page_id, names, declared):
    links = "".join(f'<a href="/product/detail?onlineProdSn={sn}&onlineProdCode={code}">{name}</a>' for sn, code, name in names)
    html = f"<html><h1>설화수 브랜드관</h1><p>총 {declared}개의 상품</p>{links}<a href='/other'>x</a></html>"
    return (page_id, "https://shop.example.com/display/brand?brandSn=18", html, "listing", None, 1)


def product(page_id, sn, code, h1="", price="12,000"):
    html = f'<html>{h1}<span class="priceBox__price">{price}원</span><s>sale</s><s>15,000원</s><b class="rating">4.5</b><i>리뷰 77</i></html>'
    return (page_id, f"{BASE}{sn}&onlineProdCode={code}", html, "product", None, 1)


def reviews(page_id, code, texts, page_no=1):
    cards = "".join(f'<div class="reviewCard"><span class="userTitle">u{i}***</span><p class="txt">{t}</p></div>' for i, t in enumerate(texts))
    return (page_id, "r", f"<html>{cards}</html>", "reviews", code, page_no)


def pages(spark, where, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(where)
    return where


def test_brand_run_with_resume(spark, tmpdir_path):
    store, at = os.path.join(tmpdir_path, "store"), lambda n: os.path.join(tmpdir_path, f"{n}.parquet")
    one = pages(spark, at("one"), [
        listing(1, [(11, 101, "자음 크림 세트"), (12, 102, "윤조 에센스")], 5),
        product(2, 11, 101), product(3, 12, 102, "<h1>윤조 에센스 90ml</h1>"), product(4, 12, "", "<h1>no code of its own</h1>"),
        reviews(5, "101", ["a review that is long enough", "another review, also long enough", "short"]),
        reviews(6, "101", ["a third review on the second page"], 2), reviews(7, "102", ["essence review, long enough too"]),
        (8, "b", "<h1>x</h1><![broken[", "reviews", "102", 9)])
    cur = cli.run(spark, one, store, "run=1")
    said = cur["listings"].first()
    assert (said["name"], said.kind, said.declared, said.n_links, said.n_products, said.n_skipped, said.n_new, said.complete) == \
        ("설화수", "brand", 5, 3, 2, 0, 2, False)
    got = {r.product_code: r for r in cur["products"].collect()}
    assert got["101"].product_name == "자음 크림 세트"  # its page has no heading: the listing's name
    assert got["102"].product_name == "윤조 에센스 90ml"
    assert (got["101"].price, got["101"].current_price, got["101"].rating, got["101"].review_count) == ("15000", "12000", "4.5", "77")
    assert cur["rejected"].count() == 1 and [r.page_id for r in cur["unparsed"].collect()] == [8]
    assert cur["totals"]["reviews"] == 4 and os.path.isdir(f"{store}/exports/run=1/info_설화수")
    first = {r.review_text: r.pos for r in cur["reviews"].filter("product_code = '101'").collect()}
    order = sorted(first, key=lambda t: tuple(first[t]))
    assert order[-1] == "a third review on the second page" and len({tuple(p) for p in first.values()}) == 3

    two = pages(spark, at("two"), [
        listing(1, [(11, 101, "자음 크림 세트"), (13, 103, "새 제품 이름")], 2),
        product(2, 11, 101, "<h1>changed since</h1>"), product(9, 13, 103),
        reviews(5, "101", ["a review that nobody fetches again"]), reviews(10, "103", ["the new product's only review"])])
    again = cli.run(spark, two, store, "run=2", output="out_spring")
    said = again["listings"].first()
    assert (said.n_products, said.n_skipped, said.n_new, said.complete) == (2, 1, 1, True)
    names = {r.product_code: r.product_name for r in again["products"].collect()}
    assert names == {"101": "자음 크림 세트", "102": "윤조 에센스 90ml", "103": "새 제품 이름"}
    assert again["reviews"].count() == 5 and again["summaries"].count() == 3
    assert os.path.isdir(f"{store}/exports/run=2/review_spring")
    manifest = CAT.read_manifest(spark, store)
    assert manifest["version"] == 2 and manifest["run_id"] == "run=2" and manifest["totals"]["summaries"] == 3
    # a run that began before the second and ends after it is refused, and the store stays as it is
    with pytest.raises(CAT.StoreChanged):
        CAT.commit(spark, store, 1, "late", {"products": manifest["tables"]["listings"]})
    assert CAT.read_store(spark, store, "products").count() == 3
