"""Summary queries (A1-A14, A17, F28) on the RV/PR/DV fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import summarize as S
from . import fixtures as X
from .oracle_views import DV, PR, RV, RV_POS, with_views
from .registry import query

_KW = C.TEST_DICTS.keywords


def _kw_values() -> str:
    return "VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(_KW))


def _rv(spark, sf):
    return X.reviews_rv(spark, sf)


# --- A1-A4 (+ unrated) on RV joined to PR --------------------------------------------------------

@query("product_summary", oracle=with_views(rv=RV, pr=PR) + """
SELECT pr.product_code, pr.product_name,
       COALESCE(s.total_reviews, 0) AS total_reviews, COALESCE(s.sum_rating, 0) AS sum_rating,
       COALESCE(s.n_rated, 0) AS n_rated, COALESCE(s.positive_count, 0) AS positive_count,
       COALESCE(s.negative_count, 0) AS negative_count, COALESCE(s.unrated_count, 0) AS unrated_count
FROM pr LEFT JOIN (
  SELECT product_code, COUNT(*) AS total_reviews,
         CAST(SUM(CASE WHEN rating > 0 THEN rating END) AS BIGINT) AS sum_rating,
         COUNT(CASE WHEN rating > 0 THEN 1 END) AS n_rated,
         COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count,
         COUNT(CASE WHEN COALESCE(rating, 0) <= 2 THEN 1 END) AS negative_count,
         COUNT(CASE WHEN rating IS NULL THEN 1 END) AS unrated_count
  FROM rv GROUP BY product_code) s ON pr.product_code = s.product_code
""")
def q_product_summary(spark, sf):
    # Aggregate reviews to one row per product before the join: the join then
    # moves product-count rows, not review-count rows.
    stats = S.rating_stats(_rv(spark, sf))
    prod = X.products_pr(spark, sf).select("product_code", "product_name")
    cols = ["total_reviews", "sum_rating", "n_rated", "positive_count", "negative_count",
            "unrated_count"]
    return prod.join(stats, "product_code", "left").select(
        "product_code", "product_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


@query("rating_band", oracle=with_views(rv=RV) + """
SELECT product_code,
       CASE WHEN COALESCE(rating, 0) >= 4 THEN 'high' WHEN COALESCE(rating, 0) <= 2 THEN 'low'
            ELSE 'mid' END AS band,
       COUNT(*) AS n
FROM rv GROUP BY 1, 2
""")
def q_rating_band(spark, sf):
    return (_rv(spark, sf).groupBy("product_code", S.rating_band("rating").alias("band"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("summary_rollup", oracle=with_views(rv=RV, pr=PR) + """
SELECT pr.category, s.product_code, CAST(GROUPING_ID(pr.category, s.product_code) AS INTEGER) AS level,
       CAST(SUM(total_reviews) AS BIGINT) AS total_reviews,
       CAST(SUM(sum_rating) AS BIGINT) AS sum_rating, CAST(SUM(n_rated) AS BIGINT) AS n_rated,
       CAST(SUM(positive_count) AS BIGINT) AS positive_count,
       CAST(SUM(negative_count) AS BIGINT) AS negative_count
FROM (SELECT product_code, COUNT(*) AS total_reviews,
             SUM(CASE WHEN rating > 0 THEN rating END) AS sum_rating,
             COUNT(CASE WHEN rating > 0 THEN 1 END) AS n_rated,
             COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count,
             COUNT(CASE WHEN COALESCE(rating, 0) <= 2 THEN 1 END) AS negative_count
      FROM rv GROUP BY product_code) s
JOIN pr ON pr.product_code = s.product_code
GROUP BY ROLLUP (pr.category, s.product_code)
""")
def q_summary_rollup(spark, sf):
    """Extension: brand-level rollup of A1-A4 (category = brand here)."""
    stats = S.rating_stats(_rv(spark, sf))
    prod = X.products_pr(spark, sf).select("product_code", "category")
    cols = ["total_reviews", "sum_rating", "n_rated", "positive_count", "negative_count"]
    return (stats.join(prod, "product_code")
            .rollup("category", "product_code")
            .agg(F.grouping_id("category", "product_code").cast("int").alias("level"),
                 *[F.sum(c).cast("long").alias(c) for c in cols]))


@query("top_option", oracle=with_views(rv=RV) + f"""
SELECT product_code, option AS top_option, n AS top_option_n FROM (
  SELECT product_code, option, n,
         ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY n DESC, fp) AS rk
  FROM (SELECT product_code, option, COUNT(*) AS n, MIN(({RV_POS})) AS fp
        FROM rv WHERE option <> '' GROUP BY 1, 2)) WHERE rk = 1
""")
def q_top_option(spark, sf):
    return S.top_option(_rv(spark, sf))


# --- text summaries on DV with the test dictionaries -------------------------------------------

def _dv(spark, sf):
    return X.reviews_dv(spark, sf)


_KW_COUNTS_SQL = with_views(dv=DV) + f""", kw(keyword, kw_pos) AS ({_kw_values()}),
counts AS (
  SELECT dv.product_code, kw.keyword, kw.kw_pos,
         CAST(SUM((length(dv.review_text) - length(replace(dv.review_text, kw.keyword, '')))
                  // length(kw.keyword)) AS BIGINT) AS n
  FROM dv CROSS JOIN kw WHERE dv.review_text <> ''
  GROUP BY 1, 2, 3)
"""


@query("keyword_counts", oracle=_KW_COUNTS_SQL + "SELECT product_code, keyword, n FROM counts")
def q_keyword_counts(spark, sf):
    counts = S.keyword_counts(_dv(spark, sf), keywords=_KW)
    return S.keyword_long(counts, keywords=_KW).select("product_code", "keyword", "n")


@query("keyword_top5", oracle=_KW_COUNTS_SQL + """
SELECT product_code, keyword, rk AS rank, n FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY n DESC, kw_pos) AS rk
  FROM counts) WHERE rk <= 5 AND n > 0
""")
def q_keyword_top5(spark, sf):
    counts = S.keyword_counts(_dv(spark, sf), keywords=_KW)
    return S.keyword_top(counts, keywords=_KW).select(
        "product_code", "keyword", F.col("rank").cast("long").alias("rank"), "n")


def _polarity_sql() -> str:
    pos = ", ".join(f"'{k}'" for k in C.TEST_DICTS.positive)
    neg = ", ".join(f"'{k}'" for k in C.TEST_DICTS.negative)
    return _KW_COUNTS_SQL + f""", pol AS (
  SELECT product_code,
         CAST(SUM(CASE WHEN keyword IN ({pos}) THEN n ELSE 0 END) AS BIGINT) AS pos_mentions,
         CAST(SUM(CASE WHEN keyword IN ({neg}) THEN n ELSE 0 END) AS BIGINT) AS neg_mentions
  FROM counts GROUP BY 1)
"""


@query("keyword_polarity", oracle=_polarity_sql() + """
SELECT product_code, pos_mentions, neg_mentions,
       CASE WHEN pos_mentions > neg_mentions THEN 'positive'
            WHEN neg_mentions > pos_mentions THEN 'negative' ELSE 'split' END AS polarity
FROM pol
""")
def q_keyword_polarity(spark, sf):
    counts = S.keyword_counts(_dv(spark, sf), keywords=_KW)
    return S.keyword_polarity(counts, dicts=C.TEST_DICTS)


_PAIRS_SQL = """pairs AS (
  SELECT product_code, band, pos, i AS tok, w[i] || ' ' || w[i + 1] AS phrase
  FROM (SELECT product_code, band, pos,
               list_filter(regexp_split_to_array(COALESCE(review_text, ''), '\\s+'),
                           lambda x: x <> '') AS w
        FROM src) t,
       unnest(CASE WHEN len(w) >= 2 THEN range(1, len(w)) ELSE [] END) AS r(i)
  WHERE length(w[i] || ' ' || w[i + 1]) <= 10),
grouped AS (
  SELECT product_code, band, phrase, COUNT(*) AS n, MIN((pos, tok)) AS fs
  FROM pairs GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code, band ORDER BY n DESC, fs) AS rk
  FROM grouped WHERE n >= 2)
"""


def _pairs_sql(banded: bool) -> str:
    band = ("CASE WHEN COALESCE(rating, 0) >= 4 THEN 'high' "
            "WHEN COALESCE(rating, 0) <= 2 THEN 'low' ELSE 'mid' END") if banded else "'all'"
    where = "WHERE band <> 'mid'" if banded else ""
    return (with_views(dv=DV)
            + f""", src AS (SELECT * FROM (SELECT *, {band} AS band FROM dv) {where}),\n"""
            + _PAIRS_SQL)


@query("bigrams", oracle=_pairs_sql(False) + "SELECT product_code, phrase, n FROM grouped")
def q_bigrams(spark, sf):
    return S.bigrams(_dv(spark, sf)).select("product_code", "phrase", "n")


@query("common_phrases", oracle=_pairs_sql(False) + """
SELECT product_code, rk AS rank, phrase, n FROM ranked WHERE rk <= 5
""")
def q_common_phrases(spark, sf):
    ph = S.common_phrases(S.bigrams(_dv(spark, sf)), keys=["product_code"])
    return ph.select("product_code", F.col("rank").cast("long").alias("rank"), "phrase", "n")


@query("cohort_phrases", oracle=_pairs_sql(True) + """
SELECT product_code, band, rk AS rank, phrase, n FROM ranked WHERE rk <= 5
""")
def q_cohort_phrases(spark, sf):
    ph = S.cohort_phrases(_dv(spark, sf))
    return ph.select("product_code", "band", F.col("rank").cast("long").alias("rank"),
                     "phrase", "n")


def _keypoints_sql() -> str:
    return _pairs_sql(True) + """, top3 AS (
  SELECT product_code, band, string_agg(phrase, ', ' ORDER BY rk) AS ph
  FROM ranked WHERE rk <= 3 GROUP BY 1, 2),
opt AS (
  SELECT product_code, option, n FROM (
    SELECT product_code, option, n,
           ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY n DESC, fp) AS rk
    FROM (SELECT product_code, option, COUNT(*) AS n, MIN(pos) AS fp
          FROM dv WHERE option <> '' GROUP BY 1, 2)) WHERE rk = 1),
prods AS (SELECT DISTINCT product_code FROM dv),
kp AS (
  SELECT p.product_code,
         concat_ws(' | ',
           CASE WHEN h.ph IS NOT NULL THEN '긍정적 평가: ' || h.ph END,
           CASE WHEN l.ph IS NOT NULL THEN '개선 필요: ' || l.ph END,
           CASE WHEN o.option IS NOT NULL
                THEN '인기 옵션: ' || o.option || ' (' || CAST(o.n AS VARCHAR) || '개 후기)' END)
           AS key_points
  FROM prods p
  LEFT JOIN top3 h ON h.product_code = p.product_code AND h.band = 'high'
  LEFT JOIN top3 l ON l.product_code = p.product_code AND l.band = 'low'
  LEFT JOIN opt o ON o.product_code = p.product_code)
"""


@query("key_points", oracle=_keypoints_sql() + "SELECT product_code, key_points FROM kp")
def q_key_points(spark, sf):
    full = S.summarize(_dv(spark, sf), dicts=C.TEST_DICTS)
    return full.select("product_code", F.array_join("key_points", " | ").alias("key_points"))


def _summary_text_sql() -> str:
    pol = _polarity_sql().replace("WITH ", "", 1)
    return ("WITH " + pol + """, tk AS (
  SELECT product_code, string_agg(keyword, ', ' ORDER BY rk) AS kws FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY n DESC, kw_pos) AS rk
    FROM counts) WHERE rk <= 5 AND n > 0 GROUP BY 1),
nt AS (SELECT product_code, COUNT(*) AS n_texts FROM dv WHERE review_text <> '' GROUP BY 1),
prods AS (SELECT DISTINCT product_code FROM dv),
st AS (
  SELECT p.product_code,
         CASE WHEN COALESCE(nt.n_texts, 0) = 0 THEN '후기 데이터가 없습니다.'
         ELSE p.product_code || '에 대한 고객 후기를 분석한 결과, 총 '
              || CAST(nt.n_texts AS VARCHAR) || '개의 후기가 수집되었습니다. '
              || '주요 언급 키워드: ' || COALESCE(tk.kws, '') || ' '
              || CASE WHEN pol.pos_mentions > pol.neg_mentions THEN '전반적으로 긍정적인 평가가 많습니다.'
                      WHEN pol.neg_mentions > pol.pos_mentions THEN '일부 부정적인 평가가 있습니다.'
                      ELSE '평가가 양분되어 있습니다.' END END AS summary
  FROM prods p LEFT JOIN nt ON nt.product_code = p.product_code
  LEFT JOIN tk ON tk.product_code = p.product_code
  LEFT JOIN pol ON pol.product_code = p.product_code)
""")


@query("summary_text", oracle=_summary_text_sql() + "SELECT product_code, summary FROM st")
def q_summary_text(spark, sf):
    dv = _dv(spark, sf)
    full = S.summarize(dv, X.products_dv(spark, sf), dicts=C.TEST_DICTS)
    return full.select("product_code", "summary")


def _full_sql() -> str:
    st = _summary_text_sql()
    kp = _keypoints_sql().replace("WITH ", ", ", 1)
    kp = kp.replace("dv AS (", "dv_unused AS (", 1).replace("prods AS (", "prods2 AS (", 1)
    kp = kp.replace("FROM prods p", "FROM prods2 p")
    return st + kp + """, rs AS (
  SELECT product_code, COUNT(*) AS total_reviews,
         CAST(COALESCE(SUM(CASE WHEN rating > 0 THEN rating END), 0) AS BIGINT) AS sum_rating,
         COUNT(CASE WHEN rating > 0 THEN 1 END) AS n_rated,
         COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count,
         COUNT(CASE WHEN COALESCE(rating, 0) <= 2 THEN 1 END) AS negative_count
  FROM dv GROUP BY 1)
SELECT rs.product_code, st.summary, kp.key_points, rs.sum_rating, rs.n_rated, rs.total_reviews,
       rs.positive_count, rs.negative_count
FROM rs JOIN st ON st.product_code = rs.product_code JOIN kp ON kp.product_code = rs.product_code
"""


@query("product_summary_full", oracle=_full_sql())
def q_product_summary_full(spark, sf):
    dv = _dv(spark, sf)
    full = S.summarize(dv, X.products_dv(spark, sf), dicts=C.TEST_DICTS)
    return full.select("product_code", "summary",
                       F.array_join("key_points", " | ").alias("key_points"),
                       "sum_rating", "n_rated", "total_reviews", "positive_count",
                       "negative_count")


@query("prompt_batch", oracle=with_views(dv=DV) + """
SELECT product_code, substr(string_agg(review_text, chr(10) || chr(10) ORDER BY pos), 1, 15000)
       AS batch
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY pos) AS rk
      FROM dv WHERE review_text <> '') WHERE rk <= 50 GROUP BY 1
""")
def q_prompt_batch(spark, sf):
    return S.prompt_batch(_dv(spark, sf))
