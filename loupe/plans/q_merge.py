"""Dedup / merge / resume / upsert / walk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import merge as M
from ..operators import runs as R
from ..operators import summarize as S
from ..operators.walk import page_walk
from . import fixtures as X
from .oracle_views import (CAT_NEW, CAT_OLD, DOCS, DOCS_NEW, DOCS_OLD, PR, RV, RVX, WALK,
                           with_views)
from .registry import query

_STRIP = r"regexp_replace(review_text, '^\s+|\s+$', '', 'g')"


@query("dedup_prefix", oracle=with_views(docs=DOCS) + """
SELECT min(doc_id) AS doc_id, product_code FROM docs
GROUP BY product_code, username, substr(review_text, 1, 50)
""")
def q_dedup_prefix(spark, sf):
    r = D.dedup_reviews(X.docs_as_reviews(spark, sf), rule="prefix")
    return r.select("doc_id", "product_code")


@query("dedup_full", oracle=with_views(docs=DOCS) + f"""
SELECT min(doc_id) AS doc_id, product_code FROM docs
GROUP BY product_code, username, {_STRIP}
""")
def q_dedup_full(spark, sf):
    r = D.dedup_reviews(X.docs_as_reviews(spark, sf), rule="full")
    return r.select("doc_id", "product_code")


_RUNS = with_views(docs=DOCS, old=DOCS_OLD, new=DOCS_NEW)


@query("merge_append", oracle=_RUNS + f"""
SELECT min(doc_id) AS doc_id, product_code
FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
GROUP BY product_code, username, {_STRIP}
""")
def q_merge_append(spark, sf):
    old, new = X.docs_runs(spark, sf)
    return D.merge_append(old, new).select("doc_id", "product_code")


@query("run_totals", oracle=_RUNS + f""", u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT (SELECT count(*) FROM old) AS n_existing, (SELECT count(*) FROM new) AS n_new,
       (SELECT count(*) FROM u) AS n_appended,
       (SELECT count(*) FROM (SELECT 1 FROM u GROUP BY product_code, username, {_STRIP}))
         AS n_merged,
       (SELECT count(DISTINCT product_code) FROM u) AS n_products
""")
def q_run_totals(spark, sf):
    """Run totals, each run read once."""
    return R.run_totals(*X.docs_runs(spark, sf))


_CATS = with_views(cat_old=CAT_OLD, cat_new=CAT_NEW)


@query("catalog_merge", oracle=_CATS + """
SELECT product_code, product_name, category, sub_category, run_ts, first_run, first_pos FROM (
  SELECT u.*, ROW_NUMBER() OVER (PARTITION BY product_code ORDER BY run_ts DESC, pos DESC) AS rk,
         MIN(run_ts) OVER (PARTITION BY product_code) AS first_run,
         MIN(pos) OVER (PARTITION BY product_code) AS first_pos
  FROM (SELECT * FROM cat_old UNION ALL SELECT * FROM cat_new) u
  WHERE product_code IS NOT NULL AND product_code <> '') WHERE rk = 1
""")
def q_catalog_merge(spark, sf):
    m = D.catalog_merge(X.catalog_old(spark, sf), X.catalog_new(spark, sf))
    return m.select("product_code", "product_name", "category", "sub_category", "run_ts",
                    F.col("first_pos.run_ts").alias("first_run"),
                    F.col("first_pos.pos").alias("first_pos"))


@query("product_upsert", oracle=_CATS + """
SELECT COALESCE(o.product_code, n.product_code) AS product_code,
       COALESCE(n.product_name, o.product_name) AS product_name,
       COALESCE(n.category, o.category) AS category,
       COALESCE(n.sub_category, o.sub_category) AS sub_category,
       COALESCE(o.run_ts, 2) AS created_run,
       CASE WHEN n.product_code IS NOT NULL THEN 2 ELSE o.run_ts END AS updated_run
FROM cat_old o FULL OUTER JOIN (SELECT * FROM cat_new WHERE product_code IS NOT NULL) n
  ON o.product_code = n.product_code
""")
def q_product_upsert(spark, sf):
    cur = X.catalog_old(spark, sf).select(
        "product_code", "product_name", "category", "sub_category",
        F.col("run_ts").alias("created_run"), F.col("run_ts").alias("updated_run"))
    up = M.upsert(cur, X.catalog_new(spark, sf), key="product_code",
                  fields=["product_name", "category", "sub_category"], run_ts=F.lit(2),
                  created="created_run", updated="updated_run")
    return up


_STATS_SQL = """SELECT product_code, COUNT(*) AS total_reviews,
       CAST(COALESCE(SUM(CASE WHEN rating > 0 THEN rating END), 0) AS BIGINT) AS sum_rating,
       COUNT(CASE WHEN COALESCE(rating, 0) >= 4 THEN 1 END) AS positive_count,
       COUNT(CASE WHEN COALESCE(rating, 0) <= 2 THEN 1 END) AS negative_count
FROM rv {where} GROUP BY product_code"""


_RUN1 = "CASE WHEN l_linenumber >= 6 THEN product_code || '-o' ELSE product_code END"
_RUN2 = "CASE WHEN l_linenumber <= 3 THEN product_code ELSE product_code || '-n' END"


@query("summary_upsert", oracle=with_views(rv=RV) + f""", cur AS ({_STATS_SQL.format(
    where="").replace("FROM rv", f"FROM (SELECT * REPLACE ({_RUN1} AS product_code) FROM rv)")}),
upd AS ({_STATS_SQL.format(where="").replace("FROM rv", f"FROM (SELECT * REPLACE ({_RUN2} AS product_code) FROM rv)")})
SELECT COALESCE(c.product_code, u.product_code) AS product_code,
       CASE WHEN u.product_code IS NOT NULL THEN u.total_reviews ELSE c.total_reviews END
         AS total_reviews,
       CASE WHEN u.product_code IS NOT NULL THEN u.sum_rating ELSE c.sum_rating END AS sum_rating,
       CASE WHEN u.product_code IS NOT NULL THEN u.positive_count ELSE c.positive_count END
         AS positive_count,
       CASE WHEN u.product_code IS NOT NULL THEN u.negative_count ELSE c.negative_count END
         AS negative_count,
       CASE WHEN c.product_code IS NOT NULL THEN 1 ELSE 2 END AS created_run,
       CASE WHEN u.product_code IS NOT NULL THEN 2 ELSE 1 END AS updated_run
FROM cur c FULL OUTER JOIN upd u ON c.product_code = u.product_code
""")
def q_summary_upsert(spark, sf):
    """Summaries of run 1 updated by run 2's; each run has all reviews,
    some of them under codes the other lacks; every metric is replaced,
    created kept."""
    rv = X.reviews_rv(spark, sf)
    fields = ["total_reviews", "sum_rating", "positive_count", "negative_count"]

    def stats(code: str):
        s = S.rating_stats(rv.withColumn("product_code", F.expr(code)))
        return s.select("product_code", "total_reviews",
                        F.coalesce("sum_rating", F.lit(0)).alias("sum_rating"),
                        "positive_count", "negative_count")
    cur = stats(_RUN1).withColumn("created_run", F.lit(1)).withColumn("updated_run", F.lit(1))
    return M.upsert(cur, stats(_RUN2), key="product_code", fields=fields, run_ts=F.lit(2),
                    created="created_run", updated="updated_run", absent_is_null=False)


_LISTING_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS product_code,
       CAST(p_partkey * 7 AS VARCHAR) AS serial, p_name AS product_name FROM part"""


@query("resume_anti", oracle=f"""WITH listing AS ({_LISTING_SQL})
SELECT * FROM listing l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size < 10
                  AND CAST(p.p_partkey AS VARCHAR) = l.product_code)
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_type = 'SMALL'
                  AND CAST(p.p_partkey * 7 AS VARCHAR) = l.serial)
""")
def q_resume_anti(spark, sf):
    """The stored codes and serials are those of all parts; of size 10 or
    more, and of other types, they are marked so that no listing has them."""
    p = X.table(spark, sf, "part")
    code, serial = F.col("p_partkey").cast("string"), (F.col("p_partkey") * 7).cast("string")
    unknown = lambda c, known: F.when(known, c).otherwise(F.concat(c, F.lit("-x")))
    listing = p.select(code.alias("product_code"), serial.alias("serial"), F.col("p_name").alias("product_name"))
    by_code = p.select(unknown(code, F.col("p_size") < 10).alias("product_code"))
    by_serial = p.select(unknown(serial, F.col("p_type") == "SMALL").alias("serial"))
    return M.resume_anti(listing, by_code, by_serial)


@query("listing_fill", oracle=_CATS + """, listing AS (
  SELECT pos, product_code, product_name,
         CASE WHEN product_name LIKE '%red%' THEN '' ELSE '/p/' || product_code END AS product_url
  FROM cat_old),
detail AS (SELECT pos, product_code, product_name, '/d/' || CAST(pos AS VARCHAR) AS product_url
           FROM cat_new)
SELECT l.pos,
       COALESCE(NULLIF(l.product_url, ''), NULLIF(d.product_url, ''), '') AS product_url,
       COALESCE(NULLIF(d.product_code, ''), NULLIF(l.product_code, ''), '') AS product_code,
       COALESCE(NULLIF(d.product_name, ''), NULLIF(l.product_name, ''), '') AS product_name
FROM listing l LEFT JOIN detail d ON l.pos = d.pos
""")
def q_listing_fill(spark, sf):
    old = X.catalog_old(spark, sf)
    listing = old.select("pos", "product_code", "product_name",
                         F.when(F.col("product_name").contains("red"), F.lit(""))
                          .otherwise(F.concat(F.lit("/p/"), "product_code")).alias("product_url"))
    detail = X.catalog_new(spark, sf).select(
        "pos", "product_code", "product_name",
        F.concat(F.lit("/d/"), F.col("pos").cast("string")).alias("product_url"))
    return M.listing_fill(listing, detail, key="pos", url="product_url")


@query("notice_override", oracle="""WITH basic AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_type AS usage_method,
         p_brand AS ingredients, p_name AS precautions FROM part),
notice AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code,
         CASE WHEN p_size <= 5 THEN '' ELSE 'use ' || p_type END AS usage_method,
         CASE WHEN p_size <= 10 THEN NULL ELSE 'ing ' || p_brand END AS ingredients,
         'care ' || p_name AS precautions
  FROM part WHERE p_size <= 20)
SELECT b.product_code,
       COALESCE(NULLIF(n.usage_method, ''), NULLIF(b.usage_method, ''), '') AS usage_method,
       COALESCE(NULLIF(n.ingredients, ''), NULLIF(b.ingredients, ''), '') AS ingredients,
       COALESCE(NULLIF(n.precautions, ''), NULLIF(b.precautions, ''), '') AS precautions
FROM basic b LEFT JOIN notice n ON b.product_code = n.product_code
""")
def q_notice_override(spark, sf):
    p = X.table(spark, sf, "part")
    code = F.col("p_partkey").cast("string").alias("product_code")
    basic = p.select(code, F.col("p_type").alias("usage_method"),
                     F.col("p_brand").alias("ingredients"), F.col("p_name").alias("precautions"))
    s = F.col("p_size")
    # above size 20 the notices are of products that nobody has
    notice = p.select(
        F.when(s <= 20, F.col("p_partkey").cast("string"))
         .otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("-x"))).alias("product_code"),
        F.when(s <= 5, F.lit("")).otherwise(F.concat(F.lit("use "), "p_type")).alias("usage_method"),
        F.when(s <= 10, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ing "), "p_brand")).alias("ingredients"),
        F.concat(F.lit("care "), "p_name").alias("precautions"))
    return M.notice_override(basic, notice)


@query("constraint_check", oracle=_CATS + """, u AS (
  SELECT * FROM cat_old UNION ALL SELECT * FROM cat_new)
SELECT 'unique' AS "constraint", product_code AS key, COUNT(*) AS n FROM u
WHERE product_code IS NOT NULL GROUP BY product_code HAVING COUNT(*) > 1
UNION ALL
SELECT 'not_null:product_code', product_code, COUNT(*) FROM u WHERE product_code IS NULL
GROUP BY product_code
UNION ALL
SELECT 'not_null:product_name', product_code, COUNT(*) FROM u WHERE product_name IS NULL
GROUP BY product_code
""")
def q_constraint_check(spark, sf):
    u = X.catalog_old(spark, sf).unionByName(X.catalog_new(spark, sf))
    return M.constraint_violations(u, key="product_code",
                                   not_null=["product_code", "product_name"])


@query("orphans", oracle=with_views(rv=RV, pr=PR, rvx=RVX) + """
SELECT product_code, COUNT(*) AS n FROM rvx
WHERE product_code NOT IN (SELECT product_code FROM pr)
GROUP BY product_code
""")
def q_orphans(spark, sf):
    children = X.with_unknown(X.reviews_rv(spark, sf))
    return (M.orphans(children, X.products_pr(spark, sf))
            .groupBy("product_code").agg(F.count(F.lit(1)).alias("n")))


@query("missing_key", oracle=with_views(cat_new=CAT_NEW) + """
SELECT pos, CASE WHEN product_code IS NULL THEN 'null key' ELSE 'empty key' END AS reason
FROM cat_new WHERE product_code IS NULL OR product_code = ''
""")
def q_missing_key(spark, sf):
    """Rows without a key go to quarantine with a reason."""
    return M.without_key(X.catalog_new(spark, sf), key="product_code").select("pos", "reason")


@query("page_walk", oracle=with_views(walk=WALK) + """, firsts AS (
  SELECT product_code, page_no FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY product_code, username, substr(review_text, 1, 50)
                                 ORDER BY page_no, pos) AS rk FROM walk) WHERE rk = 1),
y AS (SELECT product_code, page_no, COUNT(*) AS new_reviews FROM firsts GROUP BY 1, 2),
p AS (SELECT DISTINCT product_code, page_no FROM walk),
z AS (
  SELECT p.product_code, p.page_no, COALESCE(y.new_reviews, 0) AS new_reviews,
         SUM(COALESCE(y.new_reviews, 0)) OVER (PARTITION BY p.product_code ORDER BY p.page_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total,
         SUM(CASE WHEN COALESCE(y.new_reviews, 0) = 0 THEN 1 ELSE 0 END)
             OVER (PARTITION BY p.product_code ORDER BY p.page_no
                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS zero_run
  FROM p LEFT JOIN y ON p.product_code = y.product_code AND p.page_no = y.page_no),
s AS (SELECT *, MIN(CASE WHEN zero_run >= 3 THEN page_no END)
               OVER (PARTITION BY product_code) AS stop_at FROM z)
SELECT product_code, CAST(page_no AS INTEGER) AS page_no, CAST(new_reviews AS BIGINT) AS new_reviews,
       CAST(running_total AS BIGINT) AS running_total
FROM s WHERE stop_at IS NULL OR page_no <= stop_at
""")
def q_page_walk(spark, sf):
    return page_walk(X.walk_pages(spark, sf))
