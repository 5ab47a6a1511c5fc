"""E0 page facts and the rules over them, on literal HTML."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loupe import config as C
from loupe.functions.prices import parse_number
from loupe.operators import extract as E
from loupe.operators import records as R
from loupe.operators.nodes import Page, let, tagged
from loupe.sources.facts import Nodes, _arrow, page_facts

PAGE = """<html><head><title>Brand X 로고 - shop | mall</title>
<meta property="product:code" content="M1"><script>var onlineProdCode = "777";</script></head>
<body><div class="breadcrumb"><a href="/">홈</a><a href="/c">스킨케어</a><a href="/c/t">토너</a></div>
<h1> Rose Toner &amp; Mist </h1>
<div data-product-code="D1"><span class="priceBox__rate">10%</span>
<span class="priceBox__price">126,000원</span><s>140,000원</s></div>
<dl><dt>사용방법</dt><dd>짧음</dd><dt>사용법</dt><dd>Apply gently every morning</dd></dl>
<div class="reviewArea">
 <div class="reviewCard"><span class="profileCard__userTitle">abcd***</span>
  <span class="profileCard__userDesc">20대/여성/지성/트러블</span>
  <div class="icoStarWrap star4"><i class="icoStar"></i></div>
  <p class="txt">촉촉하고 좋아요 &lt;정말&gt; 지속력도 오래가요</p>
  <div class="prdStyle"><dl><dt>지속력</dt><dd>좋음</dd></dl></div></div>
 <div class="reviewCard"><p>two</p></div>
</div></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def of(spark, html, *columns, cards=False):
    """The rules' values on one page."""
    return page_facts(pages(spark, html), cards=cards).select(*columns).first()


def cards_of(spark, html):
    return E.explode_cards(page_facts(pages(spark, html), cards=True)).orderBy("pos").collect()


def test_facts_basic(spark):
    p = Page("facts")
    crumbs = E.breadcrumb_categories()
    price = E.class_price("facts")
    f = of(spark, PAGE, E.h1().alias("h1"), crumbs.alias("crumbs"), E.data_attr("facts", ["data-product-code"]).alias("code"),
           price.alias("price"), E.strike_price("facts").alias("strike"), E.scripts().alias("scripts"), E.title().alias("title"),
           E.dl_value("facts", ["사용방법"], 0).alias("short"), E.dl_value("facts", C.USAGE_KEYWORDS).alias("usage"),
           E.meta_content("facts", C.META_CODE_PROPERTY).alias("meta"), F.size(F.expr(p.all(tagged("dt")))).alias("dts"))
    assert f.h1 == "Rose Toner & Mist" and f.title == "Brand X 로고 - shop | mall"
    assert tuple(f.crumbs) == ("스킨케어", "토너")
    assert f.code == "D1" and tuple(f.price) == (10, 126000) and f.strike == 140000
    assert f.short == "짧음" and f.usage == "Apply gently every morning" and f.dts == 3
    assert 'onlineProdCode = "777"' in f.scripts and f.meta == "M1"


def test_cards(spark):
    got = cards_of(spark, PAGE)
    c = got[0]
    assert c.card_rule == "class=reviewCard"
    assert c.user == "abcd***" and c.user_desc == "20대/여성/지성/트러블"
    assert c.star_class == "icoStarWrap star4" and c.star_icons_wrap == 1
    assert c.body == "촉촉하고 좋아요 <정말> 지속력도 오래가요"
    assert c.note_dt == ["지속력"] and c.note_dd == ["좋음"]
    assert c.sample.startswith('<div class="reviewCard">') and c.sample.endswith("</dl></div></div>")
    assert len(got) == 2 and got[1].text == "two" and got[1].sample == '<div class="reviewCard"><p>two</p></div>'
    assert got[1].user is None and got[1].star_icons_wrap is None and got[1].star_icons == 0 and got[1].note_dt == []


def test_malformed_html_is_tolerated(spark):
    f = of(spark, '<div><p>unclosed <b>bold<script>var t="</p>";</script><h1>T</h1>', E.h1().alias("h1"), E.page_text().alias("text"))
    assert f.h1 == "T"
    assert f.text.startswith("unclosed")


def test_pages_that_end_the_parser_are_flagged(spark):
    f = page_facts(pages(spark, "<h1>kept</h1><![broken[", "<h1>fine</h1>", None, ""))
    assert [(r.page_id, bool(r.error)) for r in E.unparsed(f).collect()] == [(0, True)]
    assert [r.h1 for r in f.orderBy("page_id").select(E.h1().alias("h1")).collect()] == ["kept", "fine", None, None]


def test_text_pattern_fallback_cards(spark):
    body = "<div>" + "x" * 60 + " abc*** 20대 여성 촉촉 " + "</div>"
    got = cards_of(spark, body)
    assert [c.card_rule for c in got] == ["text-pattern"]
    assert cards_of(spark, "<div>short 20대</div>") == []


def test_card_rules_in_order(spark):
    area = '<div class="reviewArea">%s</div>'
    for html, rule, n in [
            ('<div class="a reviewCard">x</div><div class="bigReviewCard">y</div>', "class=reviewCard", 1),
            ('<div class="myreviewCardX">x</div><li class="review">y</li>', "class~reviewCard", 1),
            ('<div class="REVIEWCARD">x</div>', "class~/reviewCard/i", 1),
            ('<li class="review-item">x</li><li class="review">y</li>', "class~/review.*item|item.*review/i", 1),
            ('<li class="후기">x</li><p class="review">not a card tag</p>', "class~/review|comment|후기|리뷰/i", 1),
            ('<div data-review="1">x</div>', "data-review", 1), ('<tr id="Review9"><td>x</td></tr>', "id~/review/i", 1)]:
        got = cards_of(spark, area % html)
        assert [c.card_rule for c in got] == [rule] * n, html


def test_price_from_any_struck_or_classed_element(spark):
    def price(html):
        return of(spark, html, E.strike_price("facts").alias("p")).p
    assert price("<s>abc</s><del>9,900원</del>") == 9900
    assert price('<s>sold out</s><span style="text-decoration: line-through">12,000원</span>') == 12000
    assert price('<b class="old">none</b><b class="price-old">7,000원</b>') == 7000
    assert price('<b class="model">no</b><b class="DELeted">1,500원</b>') == 1500
    assert price("<p>3,000원</p>") is None


def test_rating_from_the_first_element_with_a_number(spark):
    html = '<i class="star">stars</i><b class="score">4.7 of 5</b><b class="rating">3.1</b>'
    rating = E.page_rating("facts", F.lit("1.0"))
    assert of(spark, html, rating.alias("r")).r == "4.7"
    assert of(spark, "<p>4.9</p>", rating.alias("r")).r == "1.0"


def test_ingredients_from_a_section(spark):
    what = "Water, Glycerin, Butylene Glycol, Niacinamide"
    html = f'<div class="dSection"><p>화장품법 안내</p></div><div class="dSection"><h4>기재 사항</h4><p>화장품법 성분: {what}</p></div>'
    assert of(spark, html, E.ingredients("facts").alias("i")).i == f"화장품법 성분: {what}"


def test_next_sibling_over_runs_and_strangers(spark):
    html = "<dl><dt>a</dt><dt>b</dt><dd>1</dd><dt>c</dt><p>x</p><dd>2</dd><dt>d</dt></dl><dd>no</dd>"
    p = Page("facts")
    pairs = F.expr(p.each(tagged("dt"), lambda e: f"concat({p.text(e)}, coalesce({let(p.next_with_tag(e, 'dd'), p.text)}, '-'))"))
    assert of(spark, html, pairs.alias("x")).x == ["a1", "b1", "c2", "d-"]


_TREE = st.recursive(st.text("ab <&", max_size=4), lambda kids: st.tuples(st.sampled_from(["div", "p", "dt", "br", "script"]), st.lists(kids, max_size=4)), max_leaves=25)


@settings(deadline=None, max_examples=150)
@given(st.lists(_TREE, max_size=5))
def test_numbers_describe_the_tree(trees):
    """Places, ranges, siblings and text bounds against a walk of the tree."""
    rows, texts, spans = [], [], []

    def write(t, parent, hidden):
        if isinstance(t, str):
            clean = re.sub("[<&]", "", t)
            if clean:
                spans.append(clean)
                if not hidden and clean.strip():
                    texts.append(clean.strip())
            return clean
        at = len(rows)
        rows.append({"tag": t[0], "parent": parent, "t0": len(texts)})
        inner = ""
        if t[0] != "br":
            last = None
            for kid in t[1]:
                # adjacent strings are one text node
                if isinstance(kid, str) and isinstance(last, str):
                    kid = "" if hidden else re.sub("[<&]", "", kid)
                    if kid:
                        continue
                if t[0] == "script" and not isinstance(kid, str):
                    continue
                inner += write(kid, at, hidden or t[0] == "script")
                last = kid
        rows[at] |= {"last": len(rows) - 1, "t1": len(texts)}
        return f"<{t[0]}>" + ("" if t[0] == "br" else inner + f"</{t[0]}>")

    html = "".join(write(t, -1, False) for t in trees if not isinstance(t, str))
    got = Nodes(html, True)
    page = _arrow([Nodes("<p>before<p>", True), got, Nodes(html, True)], True).to_pylist()[1]
    assert page["error"] is None and [n["tag"] for n in page["nodes"]] == [r["tag"] for r in rows] and page["texts"] == texts
    for i, (n, r) in enumerate(zip(page["nodes"], rows)):
        assert (n["at"], n["parent"], n["last"], n["t0"], n["t1"]) == (i, r["parent"], r["last"], r["t0"], r["t1"])
        later = [j for j, q in enumerate(rows) if j > i and q["parent"] == r["parent"]]
        assert n["next"] == next(iter(later), None)
        assert n["turn"] == next((j for j in later if rows[j]["tag"] != r["tag"]), None)
        assert html[got.b0[i]:got.b1[i]].startswith(f"<{r['tag']}>") and (r["tag"] == "br" or html[:got.b1[i]].endswith(f"</{r['tag']}>"))


_MARKUP = st.lists(st.one_of(
    st.sampled_from(["<div>", "</div>", "<P class=a>", "</p >", "<br/>", "<img src='x' alt=\"a&amp;b\">", "<a href='/q?a=1&b=2' disabled>", "</a>", "<!-- c -->", "<!doctype html>",
                     "<script>if (a < b) x('</p>')</script>", "<style>p{}</style>", "<template>", "</template>", "<li data-x='1' data-X='2'>", "&amp;", "&#65;", "\n", " ",
                     "<", "<1", "<a href=x/y>", "<p 'odd'>", "</ p>", "<!-- -- -->", "<?pi?>", "<![x[", "</", "<p", "<script>", "</script>", "<a b=c/>", "<a/b>"]),
    st.text("ab é<>&;\"'=", max_size=5)), max_size=14)


@settings(deadline=None, max_examples=400)
@given(_MARKUP)
def test_plain_markup_is_read_as_the_library_reads_it(parts):
    """The quick reading either gives up or gives the same nodes."""
    html = "".join(parts)
    quick, slow = Nodes(html, True), Nodes.__new__(Nodes)
    slow.html, slow.spans, slow.error = html, True, None
    slow._reset()
    slow._lenient()
    slow._text()
    while slow._open:
        slow._shut(len(html))
    assert vars(quick) == vars(slow)


def test_deep_and_wide_pages(spark):
    t0 = time.time()
    assert of(spark, "<p>" * 5000 + "end", E.page_text().alias("t")).t == "end"
    p = Page("facts")
    wide = "<div>" + "<h3>How to Use</h3><p>block</p>" * 10_000 + "<p>a block that is long enough</p></div>"
    assert of(spark, wide, E.heading_block("facts", ["How"], 100).alias("b"), F.size(F.expr(p.all(tagged("h3")))).alias("n")).n == 10_000
    assert of(spark, "<dl>" + "<dt>용법</dt><dd>b</dd>" * 8000 + "</dl>", E.dl_value("facts", ["용법"], 5).alias("v")).v is None
    assert of(spark, "<i>" * 3000 + "</b>" * 3000 + "x", E.page_text().alias("t")).t == "x"
    assert time.time() - t0 < 40


def test_texts_of_many_bytes_keep_their_samples(spark):
    html = '<p>é日😀</p><div class="reviewCard">' + "日😀" * 900 + "</div>"
    assert cards_of(spark, html)[0].sample == html[html.index("<div"):][:C.TEXT_CAP_CHARS]
    assert of(spark, "<p>1,000</p>", parse_number(E.page_text()).alias("n")).n == 1000


def test_raw_page_rules_search_only_the_pages_that_have_them(spark):
    """A long page of reviews is not searched for what only product records hold."""
    html = '<p>리뷰 1,234</p><div class="rating">★ 4.5</div>'
    pages = spark.createDataFrame([(1, "product", html), (2, "reviews", html), (3, None, html)], "page_id long, kind string, html string")
    whole = {r.page_id: r for r in R.raw_html_features(pages).collect()}
    got = {r.page_id: r for r in R.raw_html_features(pages, where=F.col("kind") == "product").collect()}
    assert got[1] == whole[1] and got[1].raw_review_count == 1234
    assert all(got[k][c] is None for k in (2, 3) for c in R.RAW_FEATURES) and all(got[k].html == html for k in got)
