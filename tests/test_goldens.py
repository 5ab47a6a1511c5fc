"""Scalar and summary goldens (FIXTURES.md section 2)."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from loupe import config as C
from loupe.functions import prices as P
from loupe.functions import reviews as R
from loupe.functions import urls as U
from loupe.functions import users as US
from loupe.operators import dedup as D
from loupe.operators import merge as M
from loupe.operators import summarize as S
from loupe.operators.walk import page_walk

REVIEW_SCHEMA = "product_code string, product_name string, rating int, review_text string, " \
                "option string, pos long, username string"


def _one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("r")).first()["r"]


def test_g1_two_review_summary(spark):
    rows = [("p", "립 슬리핑 마스크", 5, "지속력 오래 지속돼요 유분기 유분 적당해요 촉촉함 촉촉해요", "베리", 1, "a"),
            ("p", "립 슬리핑 마스크", 5, "이 립밤은 단순한 립밤을 넘어선 립 케어의 끝판왕이에요! "
             "특히 건조한 계절에 사용할 때 그 진가를 제대로 느낄 수 있어요.", "자몽", 2, "b")]
    df = spark.createDataFrame(rows, REVIEW_SCHEMA)
    prods = df.select("product_code", "product_name").distinct()
    out = S.summarize(df, prods).first()
    assert out["average_rating"] == 5.0
    assert (out["total_reviews"], out["positive_count"], out["negative_count"]) == (2, 2, 0)
    assert out["key_points"] == ["인기 옵션: 베리 (1개 후기)"]
    assert "주요 언급 키워드: 립, 촉촉, 지속, 유분, 건조" in out["summary"]
    assert out["summary"].endswith("전반적으로 긍정적인 평가가 많습니다.")
    assert out["summary"].startswith("립 슬리핑 마스크에 대한 고객 후기를 분석한 결과, 총 2개의")
    counts = S.keyword_counts(df)
    top = S.keyword_top(counts).orderBy("rank").collect()
    assert [(r["keyword"], r["n"]) for r in top] == [("립", 3), ("촉촉", 2), ("지속", 2),
                                                     ("유분", 2), ("건조", 1)]


def test_g2_listing_text(spark):
    df = spark.createDataFrame([("10%135,000원자음2종 세트 (150ml+125ml)4.9(4,374)좋아요",)], "t string")
    r = df.select(P.parse_listing(F.col("t")).alias("p")).first()["p"]
    assert (r["discount"], r["sale_price"], r["name"], r["rating"], r["review_count"]) == \
        (10, 135000, "자음2종 세트 (150ml+125ml)", "4.9", 4374)
    lp = df.select(P.list_price(F.lit(135000), F.lit(10)).alias("x")).first()["x"]
    assert lp == 150000
    assert df.select(P.name_clean(F.col("t")).alias("n")).first()["n"] == "자음2종 세트 (150ml+125ml)"


def test_g3_name_ending_in_number(spark):
    df = spark.createDataFrame([("45,000원수분 크림 50",)], "t string")
    r = df.select(P.parse_listing(F.col("t")).alias("p")).first()["p"]
    assert (r["sale_price"], r["name"]) == (45000, "수분 크림 50")
    assert df.select(P.name_clean(F.col("t")).alias("n")).first()["n"] == "수분 크림 50"


def _user(spark, text):
    df = spark.createDataFrame([(text,)], "u string")
    r = df.select(US.parse_user_info(F.col("u")).alias("p")).first()["p"]
    return (r["age"], r["gender"], r["skin_type_1"], r["skin_type_2"])


def test_g4_to_g7_user_info(spark):
    assert _user(spark, "20대/여성/지성/트러블") == ("20대", "여성", "지성", "트러블")
    assert _user(spark, "40대여성복합성주름") == ("40대", "여성", "복합성", "주름")
    assert _user(spark, "건성건조함") == ("", "", "건성", "건조함")
    assert _user(spark, "50대 이상여성수분부족지성") == ("50대 이상", "여성", "수분부족지성", "수분부족")


def test_g8_g9_rating(spark):
    df = spark.createDataFrame([("icoStarWrap star5", "x"), (None, "평점: 4.9 / 5"),
                                ("icoStarWrap", "0점"), (None, "nothing")], "c string, t string")
    out = df.select(R.rating_cascade(F.col("c"), F.lit(0), F.col("t"), F.lit(None).cast("string"))
                    .alias("r")).collect()
    assert [r["r"] for r in out] == [5, 4, None, None]


def test_g10_rating_stats(spark):
    df = spark.createDataFrame([("p", r) for r in (5, 4, 3, 2, None)], "product_code string, rating int")
    s = S.rating_stats(df).withColumn("avg", S.average_rating()).first()
    assert (s["avg"], s["total_reviews"], s["positive_count"], s["negative_count"],
            s["unrated_count"]) == (3.5, 5, 2, 2, 1)
    assert s["positive_count"] + s["negative_count"] + 1 == s["total_reviews"]


def test_g11_prices(spark):
    df = spark.createDataFrame([(126000, 10, 135000)], "sale long, d int, lst long")
    r = df.select(P.list_price(F.col("sale"), F.col("d")).alias("l"),
                  P.sale_price(F.col("lst"), F.col("d")).alias("s"),
                  P.list_price(F.col("sale"), F.lit(100)).alias("z")).first()
    assert (r["l"], r["s"], r["z"]) == (140000, 121500, None)


def test_g12_url_code(spark):
    url = "https://x.example/p?onlineProdSn=63063&x=1&onlineProdCode=111#top"
    df = spark.createDataFrame([(url,)], "u string")
    r = df.select(U.url_code(F.col("u")).alias("c"), U.url_serial(F.col("u")).alias("s"),
                  F.try_parse_url(F.col("u"), F.lit("QUERY"), F.lit("onlineProdCode")).alias("p")
                  ).first()
    assert (r["c"], r["s"], r["p"]) == ("111#top", "63063", "111")


def test_g13_price_bands(spark):
    vals = [9999, 10000, 29999, 30000, 199999, 200000, None]
    df = spark.createDataFrame([(v,) for v in vals], "p long")
    got = [r["b"] for r in df.select(P.price_band(F.col("p")).alias("b")).collect()]
    L = C.PRICE_BAND_LABELS
    assert got == [L[0], L[1], L[1], L[2], L[4], L[5], ""]


def _walk_input(spark, yields):
    rows, pos = [], 0
    for page, n in enumerate(yields, start=1):
        for j in range(n):
            rows.append(("p", page, pos, f"user{pos}", f"text number {pos} is long enough"))
            pos += 1
        if n == 0:  # a page whose cards are all repeats of page 1's first card
            rows.append(("p", page, pos, "user0", "text number 0 is long enough"))
            pos += 1
    return spark.createDataFrame(rows, "product_code string, page_no int, pos int, "
                                       "username string, review_text string")


def test_g14_page_walk_zero_yield_stop(spark):
    out = page_walk(_walk_input(spark, [5, 0, 0, 4, 0, 0, 0, 9])).orderBy("page_no").collect()
    assert [r["page_no"] for r in out] == [1, 2, 3, 4, 5, 6, 7]
    assert out[-1]["running_total"] == 9


def test_g15_page_walk_cap_after_page(spark):
    out = page_walk(_walk_input(spark, [5, 5, 5]), max_reviews=7).orderBy("page_no").collect()
    assert [r["page_no"] for r in out] == [1, 2]
    assert out[-1]["running_total"] == 10


def test_g16_dedup_rules(spark):
    rows = [("p", "u", "x" * 50 + "a", 1), ("p", "u", "x" * 50 + "b", 2)]
    df = spark.createDataFrame(rows, "product_code string, username string, review_text string, pos int")
    assert D.dedup_reviews(df, rule="prefix").count() == 1
    assert D.dedup_reviews(df, rule="full").count() == 2
    assert D.dedup_reviews(df, rule="none").count() == 2


def test_g17_upsert_null_absent_empty_overwrites(spark):
    cur = spark.createDataFrame([("p", "old name", "cat", 1, 1)],
                                "product_code string, product_name string, category string, "
                                "created_at int, updated_at int")
    upd = spark.createDataFrame([("p", None, "")], "product_code string, product_name string, "
                                                   "category string")
    r = M.upsert(cur, upd, key="product_code", fields=["product_name", "category"],
                 run_ts=F.lit(2)).first()
    assert (r["product_name"], r["category"], r["created_at"], r["updated_at"]) == \
        ("old name", "", 1, 2)


def test_g18_product_without_reviews(spark):
    reviews = spark.createDataFrame([], REVIEW_SCHEMA)
    prods = spark.createDataFrame([("p", "name")], "product_code string, product_name string")
    r = S.summarize(reviews, prods).first()
    assert (r["summary"], r["key_points"], r["average_rating"], r["total_reviews"],
            r["positive_count"], r["negative_count"]) == (C.SUMMARY_NO_REVIEWS, [], 0.0, 0, 0, 0)


def test_scalar_text_rules(spark):
    df = spark.createDataFrame([Row(t="작성자: 익명 글내용: 좋아요 신고내용 a\nb 차단하기 끝\n옵션: 베리\n3개월 사용 리뷰")],
                               "t string")
    r = df.select(R.scrub(F.col("t")).alias("s"), R.option_parse(F.col("t")).alias("o"),
                  R.review_type(F.col("t")).alias("rt")).first()
    assert r["s"].startswith("좋아요") and "차단하기" not in r["s"]
    assert r["o"] == "베리"
    assert r["rt"] == "3개월 사용 리뷰"
    arr = spark.createDataFrame([(["지속력", "향"], ["좋음", "은은", "x"])], "a array<string>, b array<string>")
    assert arr.select(R.notes_from_pairs(F.col("a"), F.col("b")).alias("n")).first()["n"] == \
        ["지속력: 좋음", "향: 은은"]
    notes = spark.createDataFrame([("발림이 부드러움\n향은 은은해요",)], "t string").select(
        R.notes_from_dictionary("t", "t").alias("n")).first()["n"]
    assert notes == ["사용감: 발림이 부드러움", "향: 향은 은은해요"]


def test_u1_pluggable_summarizer(spark):
    rows = [("p", "n", 5, "good text one here", "a", 1, "u"),
            ("q", "m", 1, "bad text two here", "", 2, "v")]
    df = spark.createDataFrame(rows, REVIEW_SCHEMA)

    def fake(batches):  # answers for 'p' only
        return batches.filter(F.col("product_code") == "p").select(
            "product_code", F.concat(F.lit("ext:"), F.col("batch")).alias("summary"))
    out = {r["product_code"]: r["summary"] for r in
           S.summarize(df, summarizer=fake).collect()}
    assert out["p"] == "ext:good text one here"
    assert "후기를 분석한 결과" in out["q"]
