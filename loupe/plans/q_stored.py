"""Queries over tables that are first written in the stored form: envelope
JSON (S2-S5), bucketed tables (D6, J1), review walks (C4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..operators import merge as M
from ..operators import records as R
from ..operators import summarize as S
from ..session import checkpoint_dir
from ..sources import catalog as CAT
from . import fixtures as X
from . import html_fixtures as H
from .oracle_views import CAT_NEW, CAT_OLD, DV, with_views
from .registry import query

PER_FILE = 20
BUCKETS = 16


def _place(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


def _envelopes(spark, sf) -> str:
    """Documents of 20 parts each as JSON lines: of every seven, one breaks
    off, one has another shape, one has fields that nobody knows and lacks
    others, one has items that are no objects."""
    p = X.table(spark, sf, "part")
    code = F.col("p_partkey").cast("string")
    now = F.to_json(F.struct(code.alias("product_code"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"),
                             F.col("p_retailprice").cast("string").alias("price")))
    later = F.to_json(F.struct(F.when(F.col("p_size") > 3, code).otherwise(F.lit("")).alias("product_code"),
                               F.col("p_size").alias("stock"), F.col("p_retailprice").alias("price")))
    g = F.floor(F.col("p_partkey") / PER_FILE)
    docs = p.select(g.alias("g"), "p_partkey", F.when(g % 7 == 2, later).otherwise(now).alias("item")).groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]).alias("items"))
    g = F.col("g")
    items = F.concat(F.array_join("items", ", "), F.when(g % 7 == 3, ', 7, "odd"').otherwise(""))
    doc = F.concat(F.lit('{"brand_url": "b'), g.cast("string"), F.lit('", "crawled_at": "2024-01-01 00:00:00", "'),
                   F.when(g % 7 == 1, "things").otherwise("products"), F.lit('": ['), items, F.when(g % 7 == 0, "").otherwise("]}"))
    path = _place(spark, "envelopes")
    docs.select(doc.alias("value")).write.text(path)
    return path


_PARTS = f"""WITH p AS (SELECT p_partkey // {PER_FILE} AS g, row_number() OVER (PARTITION BY p_partkey // {PER_FILE} ORDER BY p_partkey) - 1 AS pos, * FROM part)
"""


@query("catalog_items", oracle=_PARTS + """SELECT 'b' || g AS brand_url, pos::INTEGER AS pos, p_partkey::VARCHAR AS product_code,
  CASE WHEN g % 7 <> 2 THEN p_name END AS product_name, CASE WHEN g % 7 <> 2 THEN p_brand END AS category,
  p_retailprice::DOUBLE AS price, CASE WHEN g % 7 = 2 THEN '{"stock":' || p_size || '}' ELSE '{}' END AS more
FROM p WHERE g % 7 > 1 AND NOT (g % 7 = 2 AND p_size <= 3)""")
def q_catalog_items(spark, sf):
    """Products of envelope documents, with what the schema does not know
    in ``more``; broken ones and items without a code are left out."""
    items, _ = CAT.read_catalog(spark, _envelopes(spark, sf), lines=True)
    return items.select("brand_url", "pos", "product_code", "product_name", "category", F.col("price").cast("double").alias("price"),
                        F.to_json("more").alias("more"))


@query("catalog_status", oracle=_PARTS + """SELECT CASE g % 7 WHEN 0 THEN 'broken' WHEN 1 THEN 'no items' ELSE 'ok' END AS status,
  count(DISTINCT g) AS n_documents, count(CASE WHEN g % 7 > 1 THEN 1 END) + 2 * count(DISTINCT CASE WHEN g % 7 = 3 THEN g END) AS n_items,
  2 * count(DISTINCT CASE WHEN g % 7 = 3 THEN g END) AS n_odd
FROM p GROUP BY 1""")
def q_catalog_status(spark, sf):
    """What became of each document."""
    _, files = CAT.read_envelope(spark, _envelopes(spark, sf), C.CATALOG_FILE, "products", lines=True)
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_items").alias("n_items"), F.sum("n_odd").alias("n_odd"))


_CATS = with_views(cat_old=CAT_OLD, cat_new=CAT_NEW)


@query("stored_upsert", oracle=_CATS + """
SELECT COALESCE(o.product_code, n.product_code) AS product_code, COALESCE(n.product_name, o.product_name) AS product_name,
       COALESCE(n.category, o.category) AS category, COALESCE(o.run_ts, 2) AS created_run,
       CASE WHEN n.product_code IS NOT NULL THEN 2 ELSE o.run_ts END AS updated_run
FROM cat_old o FULL OUTER JOIN (SELECT * FROM cat_new WHERE product_code IS NOT NULL) n ON o.product_code = n.product_code""")
def q_stored_upsert(spark, sf):
    """D6 onto a stored table in buckets of the key: only the updates move."""
    cur = X.catalog_old(spark, sf).select("product_code", "product_name", "category", F.col("run_ts").alias("created_run"),
                                          F.col("run_ts").alias("updated_run"))
    stored = CAT.read_bucketed(spark, CAT.write_bucketed(cur, _place(spark, "products"), "product_code", BUCKETS))
    return M.upsert(stored, X.catalog_new(spark, sf), key="product_code", fields=["product_name", "category"], run_ts=F.lit(2),
                    created="created_run", updated="updated_run")


@query("stored_resume", oracle="""SELECT CAST(p_partkey AS VARCHAR) AS product_code, CAST(p_partkey * 7 AS VARCHAR) AS serial
FROM part WHERE NOT p_size < 10 AND NOT p_type = 'SMALL'""")
def q_stored_resume(spark, sf):
    """J1 against what is stored, the codes in buckets of the code and the
    serials in buckets of the serial: only the listing moves."""
    p = X.table(spark, sf, "part")
    code, serial = F.col("p_partkey").cast("string"), (F.col("p_partkey") * 7).cast("string")
    other = lambda c, same: F.when(same, c).otherwise(F.concat(c, F.lit("-x")))
    codes = p.select(other(code, F.col("p_size") < 10).alias("product_code"))
    serials = p.select(other(serial, F.col("p_type") == "SMALL").alias("serial"))
    stored = [CAT.read_bucketed(spark, CAT.write_bucketed(df, _place(spark, name), name, BUCKETS))
              for df, name in ((codes, "product_code"), (serials, "serial"))]
    return M.resume_anti(p.select(code.alias("product_code"), serial.alias("serial")), *stored)


@query("walk_reviews", oracle=f"""WITH src AS ({H.src_review_sql()}),
r AS (SELECT doc_id, source AS product_code, page_no, username, text FROM src),
firsts AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY product_code, username, text ORDER BY page_no, doc_id) = 1),
y AS (SELECT product_code, page_no, count(*) AS n FROM firsts GROUP BY 1, 2),
p AS (SELECT DISTINCT product_code, page_no FROM r),
z AS (SELECT p.*, sum(CASE WHEN y.n IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.product_code ORDER BY p.page_no
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM p LEFT JOIN y USING (product_code, page_no)),
s AS (SELECT *, min(CASE WHEN run >= 3 THEN page_no END) OVER (PARTITION BY product_code) AS stop FROM z)
SELECT f.doc_id, f.product_code FROM firsts f JOIN s USING (product_code, page_no) WHERE s.stop IS NULL OR page_no <= s.stop""")
def q_walk_reviews(spark, sf):
    """C4: the reviews that a walk over each product's pages keeps."""
    return R.walk_reviews(R.parse_reviews(H.review_cards(spark, sf))).select("doc_id", "product_code")


def _dictionary_sql() -> str:
    n = ", ".join(f"sum((length(review_text) - length(replace(review_text, '{k}', ''))) // {len(k)})::BIGINT AS \"{k}\""
                  for k in C.TEST_DICTS.keywords)
    return with_views(dv=DV) + f"""SELECT product_code, keyword, n FROM (UNPIVOT (
  SELECT product_code, {n} FROM dv WHERE review_text <> '' GROUP BY product_code) ON COLUMNS(* EXCLUDE product_code) INTO NAME keyword VALUE n)
WHERE n > 0"""


@query("dictionary_counts", oracle=_dictionary_sql())
def q_dictionary_counts(spark, sf):
    """A5 with the keywords as a table."""
    words = spark.createDataFrame([(k,) for k in C.TEST_DICTS.keywords], "keyword string")
    return S.dictionary_counts(X.reviews_dv(spark, sf), words)
