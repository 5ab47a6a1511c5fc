"""Reference-shaped views derived from the driver tables.

The driver tables are a TPC-H-like star schema plus text tables; none has
the review schema.  These views map them onto it (column names only plus a
few derived columns), so every operator runs over whole tables and its work
grows with them.  Each view has an SQL twin in ``plans.oracle`` for DuckDB.

RV  reviews        <- lineitem   (large, no text)
PR  products       <- part
DV  text reviews   <- documents left join labels
CV  review pages   <- conversations
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rv_pos() -> Column:
    """First-seen order for RV: (l_orderkey, l_linenumber) is not unique, so
    the tie-break carries more columns."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_shipdate", "l_quantity")


def reviews_rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("product_code"),
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("username"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int"))
         .otherwise(1 + F.col("l_quantity").cast("int") % 5).alias("rating"),
        F.when(F.col("l_returnflag") == "N", F.lit(""))
         .otherwise(F.concat("l_returnflag", "l_linestatus")).alias("option"),
        F.lit("").alias("review_text"),
        rv_pos().alias("pos"),
        "l_linenumber", "l_quantity",
    )


def products_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("sub_category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size"),
        F.col("p_partkey").alias("pos"),
    )


def reviews_dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id", "left")
             .select(
                 F.col("source").alias("product_code"),
                 F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("username"),
                 F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5)
                  .when(F.col("quality") == 0, 3).cast("int").alias("rating"),
                 F.col("lang").alias("option"),
                 F.col("text").alias("review_text"),
                 F.col("doc_id").alias("pos"),
                 "doc_id", "lang"))


def products_dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per document source (name = the source id)."""
    d = table(spark, sf_dir, "documents")
    return (d.groupBy("source").agg(F.min("doc_id").alias("pos"))
             .select(F.col("source").alias("product_code"),
                     F.col("source").alias("product_name"), "pos"))


def pages_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("product_code"), F.col("turn").alias("page_no"),
                    F.col("role").alias("username"), F.col("text").alias("review_text"))


def docs_as_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one product per language and a constant user (dedup
    and merge fixtures)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("product_code"), F.lit("u").alias("username"),
                    F.col("text").alias("review_text"), F.col("doc_id").alias("pos"))


def docs_runs(spark: SparkSession, sf_dir: str):
    """Two overlapping runs over documents: run 1 holds doc_id <= 0.6 max,
    run 2 holds doc_id >= 0.4 max (scalar subquery, computed once)."""
    d = docs_as_reviews(spark, sf_dir)
    mx = table(spark, sf_dir, "documents").select(F.max("doc_id")).scalar()
    old = d.filter(F.col("doc_id") <= mx * 0.6)
    new = d.filter(F.col("doc_id") >= mx * 0.4)
    return old, new


def catalog_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 1 catalogue: every part."""
    return products_pr(spark, sf_dir).select(
        "product_code", "product_name", "category", "sub_category", "pos",
        F.lit(1).alias("run_ts"))


def catalog_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run 2 catalogue: every part with changed names; those above size 15 are
    new products; size 1 has a NULL name (absent), 2 an empty name, 3 no key,
    4 an empty category, 5 a NULL sub-category, 6 an empty key."""
    p = table(spark, sf_dir, "part")
    s, code = F.col("p_size"), F.col("p_partkey").cast("string")
    return p.select(
        F.when(s == 3, F.lit(None).cast("string")).when(s == 6, F.lit(""))
         .when(s > 15, F.concat(code, F.lit("-n"))).otherwise(code).alias("product_code"),
        F.when(s == 1, F.lit(None).cast("string")).when(s == 2, F.lit(""))
         .otherwise(F.upper("p_name")).alias("product_name"),
        F.when(s == 4, F.lit("")).otherwise(F.concat("p_brand", F.lit("*"))).alias("category"),
        F.when(s == 5, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("sub_category"),
        F.col("p_partkey").alias("pos"),
        F.lit(2).alias("run_ts"))


def with_unknown(df: DataFrame, mark: str = "-x") -> DataFrame:
    """The rows and each again under a code that nothing else has."""
    return df.unionByName(df.withColumn("product_code", F.concat("product_code", F.lit(mark))))


def walk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV with repeats injected: every conversation gets turns 8-12 copying
    turn 0, then pages are renumbered densely from 1 per conversation."""
    from pyspark.sql import Window
    c = table(spark, sf_dir, "conversations")
    inj = (c.filter(F.col("turn") == 0)
            .select("conv_id", F.explode(F.sequence(F.lit(8).cast("long"), F.lit(12).cast("long"))).alias("turn"),
                    "role", "text"))
    u = c.select("conv_id", "turn", "role", "text").unionByName(inj)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return u.select(F.col("conv_id").alias("product_code"),
                    F.dense_rank().over(w).alias("page_no"),
                    F.col("turn").alias("pos"), F.col("role").alias("username"),
                    F.col("text").alias("review_text"))
