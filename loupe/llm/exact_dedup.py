"""Exact deduplication of a stream of texts by disk-backed keyed state.

``remembered`` runs a stream of documents into RocksDB state, one entry for
each digest of a normalised text: the identifier that stays (the largest), the
locator of its content (file and row), and how many rows had it.  There is no
watermark, so nothing expires: a copy that comes a year later hits its entry.
The state lies under the stream's checkpoint; a later run over the same folder
takes only the new files.

``resolved`` reads the state back as a table and checks every hit: each row's
whole normalised text is compared with that of the row its entry locates.  Rows
that differ from it (a digest collision) are grouped by their text instead.

Texts go to the check dealt by (digest, salt).  A group of more than a
``PARTS``-th of all rows gets several salts, its kept row a copy for each; there
are at most ``PARTS`` such groups, which bounds the table of them that is
broadcast (24 bytes and a digest a row).
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.llm.common import shared_path, written

#: Groups of more than 1 / PARTS of all rows are dealt to several tasks.
PARTS = 10_000
#: No group of fewer rows is split.
LEAST = 64
#: A micro-batch ends, and state is stored, after about so many bytes of files.
BATCH_BYTES = 1 << 40

#: State lies in RocksDB, which is not to reserve megabytes of disk for the
#: logs of each of many small stores.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A-Z lowered and nothing else; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # then lower() does the same, faster
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def sha256(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """said, digest, place (id, file, row): a row for each row of ``docs``, a
    table or stream of files."""
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(normalised(F.col(f"`{text}`")).alias("said"), F.struct(
        F.col(f"`{key}`").alias("id"), meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("place"))
    return rows.withColumn("digest", digest(F.col("said")))


@contextmanager
def _on_disk(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(spark: SparkSession, path: str, **options) -> DataFrame:
    """The Parquet files of ``path`` (a folder or one file) as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # a stream's path must be a folder or a pattern; this pattern stands for itself
    pattern = f"{folder}/{{{name}}}" if folder else f"{{{name}}}"
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(pattern)


def remembered(stream: DataFrame, checkpoint: str, key: str = "doc_id", text: str = "text",
               digest: Callable[[Column], Column] = sha256) -> DataFrame | None:
    """digest, keep (id, file, row), n: the state once the stream has taken all
    files that are there now; None if none ever came.  ``checkpoint`` names the
    state; called again with it, only files that are new are read."""
    spark = stream.sparkSession
    state = located(stream, key, text, digest).groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
    with _on_disk(spark):
        run = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/*")
        if not commits.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(commits):
            return None
        kept = spark.read.format("statestore").load(checkpoint)
        return written(kept.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n")), "remembered")


def resolved(rows: DataFrame, state: DataFrame) -> DataFrame:
    """place, digest, keep, n, same: each row of ``rows`` (as ``located``) with
    its entry of the state; same: its text is the kept row's, byte by byte."""
    total = state.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST, -(-total // PARTS))
    salts = F.ceil(F.col("n") / most)
    hot = state.where(F.col("n") > most).select(
        "digest", salts.alias("salts"), F.xxhash64("keep").alias("kept"))
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn("own", F.when(
        F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("place"), F.col("salts"))).cast("int"))
    every = F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))
    rows = rows.withColumn("salt", F.explode(F.when(F.xxhash64("place") == F.col("kept"), every).otherwise(F.array("own"))))
    entries = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts - 1, F.lit(0)).cast("int"))))
    met = rows.select("digest", "salt", "own", "said", "place").join(entries, ["digest", "salt"])
    first = Window.partitionBy("digest", "salt").orderBy((F.col("place") == F.col("keep")).desc())
    met = met.withColumn("same", F.col("said") == F.first("said").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    return met.where("salt = own").select("place", "digest", "keep", "n", "same")


def decided(rows: DataFrame, state: DataFrame) -> DataFrame:
    """As ``resolved``, where rows under a digest that several texts share are
    grouped by their whole text."""
    seen = written(resolved(rows, state), "resolved")
    clash = written(seen.where(~F.col("same")).select("digest").distinct(), "collisions")
    if clash.isEmpty():
        return seen.drop("same")
    told = rows.join(clash, "digest", "left_semi")
    groups = told.groupBy("digest", "said").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
    apart = told.join(groups, ["digest", "said"]).select("place", "digest", "keep", "n")
    return seen.drop("same").join(clash, "digest", "left_anti").select("place", "digest", "keep", "n").unionByName(apart)


def _decisions(spark: SparkSession, path: str, key: str, text: str, checkpoint: str | None, digest, **options) -> DataFrame | None:
    options = {"maxBytesPerTrigger": str(BATCH_BYTES)} | {k: str(v) for k, v in options.items()}
    if "maxFilesPerTrigger" in options:
        del options["maxBytesPerTrigger"]  # Spark takes one of the two
    state = remembered(arrivals(spark, path, **options), checkpoint or shared_path(spark, "exact-state"), key, text, digest)
    return None if state is None else decided(located(spark.read.parquet(path), key, text, digest), state)


def exact_duplicates(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", checkpoint: str | None = None,
                     digest: Callable[[Column], Column] = sha256, **options) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256: a row for each row of the
    Parquet files of ``path``.  ``options`` go to the stream (maxFilesPerTrigger).

    Null and empty texts are one text.  The largest key of a group stays, a
    null key below all others; of rows that repeat it the one that stands last
    (file, then row), so one row of each group has ``kept``.  Keys may be of any
    type with an order.  A table without rows or files gives no rows; other
    columns are not read, whatever their names.
    """
    found = _decisions(spark, path, key, text, checkpoint, digest, **options)
    kind = spark.read.parquet(path).select(f"`{key}`").schema[0].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"`{key}` {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string")
    if digest is sha256:
        code = F.lower(F.hex("digest"))
    else:
        places = located(spark.read.parquet(path), key, text).select("place", F.col("digest").alias("code"))
        found, code = found.join(places, "place"), F.lower(F.hex("code"))
    return found.select(F.col("place.id").alias(key), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("place") == F.col("keep")).alias("kept"), code.alias("text_sha256"))


def without_copies(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", checkpoint: str | None = None, **options) -> DataFrame:
    """The rows of the Parquet files of ``path`` that stay, all columns."""
    docs = spark.read.parquet(path)
    found = _decisions(spark, path, key, text, checkpoint, sha256, **options)
    if found is None:
        return docs
    meta = docs.metadataColumn("_metadata")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    stay = found.where(F.col("place") == F.col("keep")).select("place.file", "place.row")
    return named.join(stay, ["file", "row"], "left_semi").select(*(F.col(f"whole.`{c}`") for c in docs.columns))
