"""Page-snapshot sources.

Pages arrive either as a table ``(page_id, url, html[, fetched_at])`` or as
a directory of saved HTML files.  Both end as the same frame; the file form
derives a stable ``page_id`` from the path (xxhash64), never from
``monotonically_increasing_id`` (it must survive re-runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])


def read_pages_dir(spark: SparkSession, path: str, *, pattern: str = "*.html") -> DataFrame:
    """One row per saved page (whole file as one value)."""
    raw = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
           .text(path, wholetext=True))
    return raw.select(
        F.xxhash64(F.input_file_name()).alias("page_id"),
        F.input_file_name().alias("url"),
        F.col("value").alias("html"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"))


def stream_pages_dir(spark: SparkSession, path: str, *, fmt: str = "parquet",
                     max_files: int | None = None) -> DataFrame:
    """T1 source: new snapshot files as they land (schema fixed up front)."""
    r = spark.readStream.schema(PAGES_SCHEMA).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)
