"""Cases that earlier fixtures never had: several text nodes, deep markup,
no-break spaces, pages without cards, stored copies, replayed epochs."""

import pytest
from pyspark.sql import functions as F

from loupe.functions import reviews as RV
from loupe.operators import dedup as D
from loupe.operators import extract as E
from loupe.operators import merge as M
from loupe.operators import records as R
from loupe.sources import catalog as CAT
from loupe.sources.facts import page_facts


def test_text_nodes_stay_apart(spark):
    html = ("<dl><dt>사용방법</dt><dd><p>Apply daily</p><p>Rinse well after</p></dd></dl>"
            "<table><tr><th>성분</th><td>Water,<br>Glycerin</td></tr></table>"
            "<h3>How to Use</h3><div><p>a</p><p>b</p></div>")
    f = page_facts(spark.createDataFrame([(1, html)], "page_id int, html string")).select(
        E.dl_value("facts", ["사용방법"]).alias("dd"), E.th_td_value("facts", ["성분"]).alias("td"),
        E.heading_block("facts", ["How to Use"], 0).alias("block")).first()
    assert f.dd == "Apply daily\nRinse well after"
    assert f.td == "Water,\nGlycerin"
    assert f.block == "a\nb"


def test_ingredients_from_any_later_sibling(spark):
    long = "Water Glycerin Butylene Glycol Niacinamide Panthenol Allantoin Carbomer"
    html = f"<div><h4>화장품법에 따른 성분</h4><p>short</p></div><div>x</div><div><p>{long}</p><p>Tocopherol</p></div>"
    f = page_facts(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert f.select(E.ingredients("facts").alias("i")).first().i == f"{long} Tocopherol"


def test_product_record_from_a_listing_heading(spark):
    line = "10%135,000원자음2종 세트 (150ml+125ml)4.9(4,374)좋아요"
    pages = spark.createDataFrame([(1, "http://s/p?onlineProdCode=7", f"<h1>{line}</h1>"), (2, "http://s/p?onlineProdCode=8", "<h1> 크림 50 </h1>")],
                                  "page_id int, url string, html string")
    f = page_facts(R.raw_html_features(pages), keys=["page_id"], passthrough=["url"] + R.RAW_FEATURES)
    got = {r.page_id: r for r in R.extract_products(f).collect()}
    assert got[1].product_name == "자음2종 세트 (150ml+125ml)"
    assert (got[1].discount_pct, got[1].price, got[1].current_price, got[1].rating) == (10, 150000, 135000, "4.9")  # the page text comes first
    assert got[1].review_count == 4374 and got[2].product_name == "크림 50" and got[2].price is None


def test_no_break_spaces(spark):
    df = spark.createDataFrame([("평점: 5",), ("4 점",), ("3 / 5",)], "t string")
    assert [r.r for r in df.select(RV.rating_from_text(F.col("t")).alias("r")).collect()] == [5, 4, 3]


def test_stored_copy_is_the_first(spark):
    cols = "product_code string, username string, review_text string, rating int, pos long"
    old = spark.createDataFrame([("p", "u", "same text", 5, 10)], cols)
    new = spark.createDataFrame([("p", "u", "same text", 1, 3), ("p", "v", "other", 2, 1)], cols)
    got = {r.username: r.rating for r in D.merge_append(old, new).collect()}
    assert got == {"u": 5, "v": 2}


def test_empty_codes_do_not_match(spark):
    listing = spark.createDataFrame([("", "", 1), ("a", "", 2), ("b", "9", 3)], "product_code string, serial string, pos int")
    done = spark.createDataFrame([("", ""), ("a", "")], "product_code string, serial string")
    assert [r.pos for r in M.resume_anti(listing, done, done).orderBy("pos").collect()] == [1, 3]


def test_walk_stops_at_pages_without_yield(spark):
    def rows(spec):
        return spark.createDataFrame([("p", page, i, card, valid, f"user{page}", f"a review of page {page}") for page, i, card, valid in spec],
                                     "product_code string, page_no int, pos int, text string, valid boolean, username string, review_text string")
    some = [(1, 0, "card", True), (2, 0, "card", False), (3, 0, "card", False), (4, 0, "card", False), (5, 0, "card", True)]
    assert [r.page_no for r in R.walk_reviews(rows(some)).collect()] == [1]
    assert [r.page_no for r in R.walk_reviews(rows(some[:3] + some[4:])).orderBy("page_no").collect()] == [1, 5]
    assert [r.page_no for r in R.walk_reviews(rows([some[0], (2, 0, None, False), some[4]])).collect()] == [1]


def test_pages_without_cards_are_kept_for_the_walk(spark):
    f = page_facts(spark.createDataFrame([(1, "<p>nothing</p>")], "page_id int, html string"), cards=True)
    assert E.explode_cards(f).count() == 0
    assert [r.text for r in E.explode_cards(f, empty_pages=True).collect()] == [None]


def test_pointer_is_replaced_not_deleted(spark, tmpdir_path):
    base = f"{tmpdir_path}/table"
    for n in (1, 2, 3):
        CAT.write_snapshot(spark.range(n), base, f"run={n}")
        assert CAT.read_table(spark, base).count() == n


def test_replayed_epoch_counts_once(spark, tmpdir_path):
    from loupe import config as C
    from loupe.plans import fixtures as X
    from loupe.streaming.ingest import summary_upserter
    reviews = X.reviews_dv(spark, "/root/testdata/sf0.001")
    run = summary_upserter(f"{tmpdir_path}/state", f"{tmpdir_path}/sum", dicts=C.TEST_DICTS)

    def total():
        return CAT.read_table(spark, f"{tmpdir_path}/sum").agg(F.sum("total_reviews")).first()[0]

    n = reviews.count()
    run(reviews.where("doc_id % 2 = 0"), 0)
    first = total()
    run(reviews.where("doc_id % 2 = 1"), 1)
    assert 0 < first < total() == n
    run(reviews.where("doc_id % 2 = 1"), 1)
    assert total() == n


def test_constraints_in_one_pass_and_strict(spark):
    rows = [("a", "x", 1), ("a", None, 2), (None, "y", None), ("b", "z", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "k string, name string, n int")
    got = {(r.constraint, r.key, r.n) for r in M.constraint_violations(df, key="k", not_null=["k", "name", "n"]).collect()}
    assert got == {("unique", "a", 2), ("not_null:name", "a", 1), ("not_null:k", None, 2), ("not_null:name", None, 1), ("not_null:n", None, 1)}
    fine = df.filter("k = 'b' OR n = 1")
    assert M.strict(fine, key="k", not_null=["name"]).count() == 2
    for bad, why in ((df.filter("k = 'a'"), "unique"), (df.filter("n = 2"), "not_null:name")):
        with pytest.raises(Exception, match=f"constraint {why} broken by k a"):
            M.strict(bad, key="k", not_null=["name"]).collect()


def test_rows_without_a_key(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "product_code string, n int")
    assert [r.n for r in M.with_key(df, key="product_code").collect()] == [1]
    assert {(r.n, r.reason) for r in M.without_key(df, key="product_code").collect()} == {(2, "empty key"), (3, "null key")}
    with pytest.raises(Exception, match="empty key|null key"):
        M.with_key(df, key="product_code", strict=True).write.parquet(f"{tmpdir_path}/t")
    M.with_key(df.limit(1), key="product_code", strict=True).write.parquet(f"{tmpdir_path}/u")


def test_first_by_digest(spark):
    cols = "k string, user string, text string, run int, pos long"
    rows = [("p", None, "t", 1, 5), ("p", "", "t", 0, 9), ("p", "u", "t", 0, 2**62), ("p", "u", "t", 0, -(2**62)), (None, "u", "t", 0, 1), ("", "u", "t", 0, 2)]
    df = spark.createDataFrame(rows, cols)
    for check in (False, True):
        got = D.first_by_digest(df, ["k", F.coalesce("user", F.lit("")), "text"], ["run", "pos"], check=check)
        assert sorted(r.pos for r in got.collect()) == [-(2**62), 1, 2, 9]
    # positions that are no whole numbers
    got = D.first_by_digest(df.withColumn("at", F.struct("run", "pos")), ["text"], "at")
    assert [r.pos for r in got.collect()] == [-(2**62)]


def test_shared_digests_end_the_job_or_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "text string, pos long")
    monkeypatch.setattr(D, "digest", lambda keys: [F.lit(1).cast("long").alias("_h1"), F.lit(1).cast("long").alias("_h2"), F.xxhash64(*keys).alias("_h3")])
    with pytest.raises(Exception, match="share a digest"):
        D.first_by_digest(df, ["text"], "pos").collect()
    assert sorted(r.pos for r in D.first_by_digest(df, ["text"], "pos", check=True).collect()) == [1, 2]


def test_ordinals_of_strings_and_nulls(spark):
    from loupe.operators.joins import with_ordinal
    names = [f"code-{i * 7919 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "c string").repartition(5)
    got = sorted((r.ordinal, r.c) for r in with_ordinal(df, ["c"], ranges=8).collect())
    assert got == [(i + 1, n) for i, n in enumerate(sorted(names))]
    mixed = spark.createDataFrame([(None, 1), (3, 2), (None, 0), (-5, 4)], "c int, d int")
    assert [(r.c, r.d) for r in with_ordinal(mixed, ["c", "d"]).orderBy("ordinal").collect()] == [(None, 0), (None, 1), (-5, 4), (3, 2)]
    assert with_ordinal(mixed.limit(0), ["c"]).count() == 0


def test_dictionary_of_many_keywords(spark):
    """Ten thousand keywords, some within others and some that overlap
    themselves: counted as str.count does, each alone."""
    import random
    rng = random.Random(5)
    words = {"aa", "aba", "abab", "a", "b", "xyz", "\u00e9\u00e9", "needle", "need"}
    while len(words) < 10_000:
        words.add("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))))
    texts = [("p", i, "".join(rng.choice("aab \u00e9cdefgh") for _ in range(200)) + " needle abababab aaaa") for i in range(30)]
    texts += [("q", 100, "aaaaa"), ("q", 101, "aaaaa"), ("q", 102, ""), ("q", 103, None)]
    from loupe.operators.summarize import dictionary_counts
    got = dictionary_counts(spark.createDataFrame(texts, "product_code string, pos long, review_text string"),
                            spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = {}
    for p, _, t in texts:
        for w in words:
            n = (t or "").count(w)
            if n:
                want[p, w] = want.get((p, w), 0) + n
    assert {(r.product_code, r.keyword): r.n for r in got.collect()} == want


def test_dictionary_counts_words_once_and_keywords_across_them(spark):
    """Rows at the same place are counted each; a keyword may reach over white
    space; a word that stands often is cut into windows once (F5)."""
    from loupe.operators.summarize import dictionary_counts
    texts = [("q", 1, "aaaa a b\taaaa")] * 3 + [(None, 2, "a b a\u00a0b"), ("r", None, " \n "), ("r", 4, None)]
    words = ["aa", "a b", "b\ta", "b", "a\u00a0b", "none", ""]
    got = dictionary_counts(spark.createDataFrame(texts, "product_code string, pos long, review_text string"),
                            spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = {}
    for p, _, t in texts:
        for w in filter(None, words):
            if n := (t or "").count(w):
                want[p, w] = want.get((p, w), 0) + n
    assert {(r.product_code, r.keyword): r.n for r in got.collect()} == want


def test_notes_are_distinct(spark):
    df = spark.createDataFrame([("the one line and more", "")], "body string, t string")
    got = df.select(RV.notes_from_dictionary("body", "t", [("A", ["the"]), ("B", ["the", "and"]), ("C", ["the"])]).alias("n")).first().n
    assert got == ["A: the one line and more", "B: and more"]


def test_all_notes_are_kept(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "d"], ["1", "2", "3", "4"]), (None, None)], "dt array<string>, dd array<string>")
    assert [r.m for r in df.select(RV.feature_map("dt", "dd").alias("m")).collect()] == [{"a": "1", "b": "2", "c": "4"}, {}]
