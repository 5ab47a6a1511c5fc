"""Incremental jobs (T1-T3) on Structured Streaming.

T1  ingest: new page snapshots -> page facts -> review rows, stateless, so
    E0 and every scalar rule are reused unchanged; ``trigger(availableNow)``
    processes what has landed and stops; the checkpoint makes it resumable
    (the streaming form of the original's resume skip list).  Valid reviews
    are stored; the others are another stream's business (``rejected``).
T2  streaming seen-set: keyed state (``transformWithState`` on RocksDB) with
    the key of batch D2, its text as a digest, and the time of the copy that
    was kept.  A repeat less than ``delay`` after it goes, a later one is kept
    and takes its place; an event-time timer frees the key after that.
T3  incremental summaries: per micro-batch, merge the batch's partial
    aggregates into the stored buckets of state that it touches, recompute
    only its products' summaries and upsert them (D8) in their buckets.

Checkpoints live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..operators.dedup import digest, keep_first, review_key
from ..operators.extract import explode_cards
from ..operators.records import parse_reviews
from ..operators.summarize import finish, merge_partials, partials
from ..session import checkpoint_dir, state_on_disk
from ..sources.catalog import read_pointer, write_pointer
from ..sources.facts import page_facts


def reviews_from_pages(pages: DataFrame, *, product_key: str = "product_code",
                       page_key: str = "page_id") -> DataFrame:
    """Stateless page -> review rows (E0, E20, C3); works on batch and
    streaming frames alike."""
    keys = [page_key, product_key] + (["fetched_at"] if "fetched_at" in pages.columns else [])
    facts = page_facts(pages, keys=keys, cards=True)
    cards = explode_cards(facts, keys=tuple(keys))
    return parse_reviews(cards)


class FirstWithin(StatefulProcessor):
    """Keeps a key's row unless one was kept less than ``delay`` before it."""

    def __init__(self, delay: pd.Timedelta):
        self._delay = delay // pd.Timedelta(1, "ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._since = handle.getValueState("since", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        delay = self._delay
        since = self._since.get()[0] if self._since.exists() else None
        before = since
        for frame in rows:  # one at a time: a key may have any number of rows
            frame = frame.sort_values("seen_ms", kind="stable")
            keep = []
            for i, ms in enumerate(frame["seen_ms"].tolist()):
                if since is None or abs(ms - since) >= delay:
                    keep.append(i)
                    since = ms if since is None else max(ms, since)
            if keep:
                yield frame.iloc[keep]
        if since != before:
            if before is not None:
                self._handle.deleteTimer(before + delay)
            self._since.update((since,))
            self._handle.registerTimer(since + delay)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._since.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def seen_set(reviews: DataFrame, *, key: str = "product_code", user: str = "username", text: str = "review_text",
             event_time: str = "fetched_at", delay: str = "7 days") -> DataFrame:
    """Of the reviews with one key (product, reviewer, text without the
    white space around: D2's key) the first, and each that comes ``delay`` or
    more after the last one kept.  On a batch frame, where nothing is ever
    forgotten, the first by event time (D2).  A stream of it needs RocksDB
    state (``session.state_on_disk``)."""
    person, said = F.coalesce(F.col(user), F.lit("")), review_key(F.col(text), "full")
    if not reviews.isStreaming:
        return keep_first(reviews, [key, person, said], F.col(event_time))
    if isinstance(reviews.schema[event_time].dataType, T.TimestampNTZType):
        reviews = reviews.withColumn(event_time, F.col(event_time).cast("timestamp"))
    keyed = reviews.withColumns({"seen_key": F.coalesce(F.col(key), F.lit("")), "seen_user": person} | {
        name: c for name, c in zip(("seen_h1", "seen_h2"), digest([said]))} | {"seen_ms": F.unix_millis(event_time)}).withWatermark(event_time, "0 seconds")
    out = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema.fields])
    kept = keyed.groupBy("seen_key", "seen_user", "seen_h1", "seen_h2").transformWithStateInPandas(
        FirstWithin(pd.Timedelta(delay)), out, outputMode="append", timeMode="eventTime")
    return kept.select(*reviews.columns)


def rejected(pages: DataFrame) -> DataFrame:
    """The cards that are no valid reviews, with what they look like."""
    return reviews_from_pages(pages).filter(~F.coalesce(F.col("valid"), F.lit(False)))


def ingest(spark: SparkSession, pages_stream: DataFrame, reviews_path: str, *,
           name: str = "ingest", dedup_delay: str | None = "7 days"):
    """T1 (+T2): stream page snapshots into the review table (Parquet
    append).  Returns the started query; ``availableNow`` ends it once the
    backlog is processed."""
    rows = reviews_from_pages(pages_stream).filter("valid")
    if dedup_delay and "fetched_at" in rows.columns:
        rows = seen_set(rows, delay=dedup_delay)
    ckpt = f"{checkpoint_dir(spark)}/{name}"
    with state_on_disk(spark):
        return (rows.writeStream.format("parquet").option("path", reviews_path)
                .option("checkpointLocation", ckpt).outputMode("append")
                .trigger(availableNow=True).start())


STATE_TABLES = ("options", "pairs")
MANIFEST = "_EPOCH"
#: Parts of the state; a product's rows are all in one.
BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def summary_upserter(state_base: str, summary_base: str, *, key: str = "product_code",
                     dicts: C.Dictionaries = C.DEFAULT_DICTS, buckets: int = BUCKETS):
    """A ``foreachBatch`` function.  State is the mergeable
    partial aggregates of ``operators.summarize`` (sums per product and
    option, phrase counts) and the summaries, each in hash buckets of the
    product; a manifest says where each bucket of each table is.  Per
    micro-batch: build the batch's partials, merge them with the stored
    buckets that the batch touches, recompute the summaries of its products,
    and write those buckets anew; all other buckets stay the files they are.
    Review rows are never re-read, so a batch costs what its buckets hold.
    The number of buckets is fixed with the first batch."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        done = read_pointer(spark, state_base, MANIFEST) or {"epoch": -1, "buckets": buckets, "paths": {}}
        if done["epoch"] >= epoch_id:  # replayed: its writes are in place
            write_pointer(spark, summary_base, _current(done))
            return
        n, paths = done["buckets"], done["paths"]
        touched = batch.select(key).distinct()
        # at most ``buckets`` small numbers
        hit = [r[0] for r in touched.select(_bucket(key, n).alias("b")).distinct().collect()]
        if not hit:
            return
        run_id = f"epoch={epoch_id:012d}"

        def stored(table: str) -> DataFrame | None:
            there = [paths[str(b)][table] for b in hit if str(b) in paths]
            return spark.read.parquet(*there) if there else None

        def write(table: str, rows: DataFrame) -> DataFrame:
            base = f"{state_base if table != 'summary' else summary_base}/{table}/{run_id}"
            # bound to the buckets' number of files; a large bucket's rows are one file a task that has some
            rows.withColumn("bucket", _bucket(key, n)).repartition(max(len(hit), 1), "bucket", *_spread(table)) \
                .write.mode("overwrite").partitionBy("bucket").parquet(base)
            new[table] = {b: f"{base}/bucket={b}" for b in hit}
            return spark.read.parquet(*new[table].values())

        new, fresh = {}, partials(batch, key=key, dicts=dicts)
        old = {t: stored(t) for t in STATE_TABLES}
        merged = merge_partials(old, fresh, key=key) if paths and all(old.values()) else fresh
        state = {t: write(t, merged[t]) for t in STATE_TABLES}
        # summaries of the touched products, from their merged state; the others of the bucket as they are
        of = {t: state[t].join(touched, key, "left_semi") for t in STATE_TABLES}
        summ = finish(of, key=key, dicts=dicts).withColumn("epoch", F.lit(epoch_id))
        before = stored("summary")
        if before is not None:
            summ = before.join(touched, key, "left_anti").unionByName(summ)
        write("summary", summ)
        done = {"epoch": epoch_id, "buckets": n, "paths": paths | {str(b): {t: new[t][b] for t in new} for b in hit}}
        # one manifest commits all tables; a crash before it changes nothing
        write_pointer(spark, state_base, done, MANIFEST)
        write_pointer(spark, summary_base, _current(done))

    return run


def _spread(table: str) -> list[str]:
    """Columns that spread a bucket's rows (one product may have most)."""
    return {"pairs": ["phrase"], "options": ["option"]}.get(table, [])


def _current(done: dict) -> dict:
    """What ``sources.catalog.read_table`` reads of the summaries."""
    return {"run_id": f"epoch={done['epoch']:012d}", "paths": [p["summary"] for p in done["paths"].values()]}


def incremental_summaries(spark: SparkSession, reviews_stream: DataFrame, state_base: str,
                          summary_base: str, *, name: str = "summaries", **kw):
    """T3 driver: stream reviews, upsert the summaries of touched products
    per micro-batch (D8)."""
    ckpt = f"{checkpoint_dir(spark)}/{name}"
    return (reviews_stream.writeStream
            .foreachBatch(summary_upserter(state_base, summary_base, **kw))
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
