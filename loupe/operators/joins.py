"""Distributed ordinals and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _measure(df: DataFrame, column: str) -> Column:
    """A number that grows with the column, as far as it can tell values
    apart: itself, or the first seven bytes of a string."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("timestamp").cast("double")
    head = F.substring(F.rpad(F.hex(F.encode(F.col(column).cast("string"), "UTF-8")), 14, "0"), 1, 14)
    return F.conv(head, 16, 10).cast("double")


def range_bounds(df: DataFrame, column: str, ranges: int) -> Column:
    """The values that cut the column into ``ranges`` parts of about equal
    rows, as a scalar subquery: one aggregate, run with the plan that uses it."""
    at = [i / ranges for i in range(1, ranges)]
    return df.select(F.array_distinct(F.percentile_approx(_measure(df, column), at, 1000 * ranges)).alias("_b")).scalar()


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal", *, ranges: int | None = None) -> DataFrame:
    """1-based dense ordinals in ``order`` (which tells all rows apart) without
    a single-partition window and without a job of its own: rows fall into
    ranges of the first column by bounds that an aggregate finds, are numbered
    within their range, and get the count of the ranges before (a table of one
    row a range).  Nulls of the first column come first."""
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = order[0]
    bounds = F.coalesce(range_bounds(df, first, ranges), F.array().cast("array<double>"))
    part = F.when(F.col(first).isNotNull(), F.size(F.filter(F.col("_bounds"), lambda b: b < _measure(df, first))) + 1).otherwise(0)
    placed = df.withColumn("_bounds", bounds).withColumn("_part", part).drop("_bounds")
    # one row a range: the only window over all of them
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = placed.withColumn("_at", F.row_number().over(inside))
    return numbered.join(counts, F.col("_part") == F.col("_of")) \
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_of", "_before", "_at")


def surrogate_key(code: Column) -> Column:
    """Deterministic surrogate key of a natural key (survives re-runs,
    needs no join)."""
    return F.xxhash64(code)
