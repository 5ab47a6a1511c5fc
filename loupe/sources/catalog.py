"""Catalogue / review JSON files (S2-S5) and stored tables.

JSON files are read as VARIANT documents, so that files of other versions
(more fields, fewer, other types) and broken ones are kept and counted instead
of being dropped; the explicit schema is applied afterwards.  Writing is JSON
Lines (distributed).

Tables of a run are written to folders of their own and become current
together, by one manifest file a version.  Manifest N + 1 is created by a
rename that fails if it exists, so of two runs that read version N one is
refused, and a crash before the rename leaves version N as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

RUN_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, doc, broken: one row a JSON document under ``path`` (a folder,
    file or pattern): a file each, or with ``lines`` a line each.  ``doc`` is
    the whole document as VARIANT, NULL for what is not JSON; that one's first
    characters are in ``broken``.  A missing path gives an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, doc variant, broken string")
    text = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("file"), "value")
    doc = F.try_parse_json("value")
    return text.select("file", doc.alias("doc"), F.when(doc.isNull(), F.substring("value", 1, C.TEXT_CAP_CHARS)).alias("broken"))


def _known(kind: T.DataType, item: Column, field: str) -> Column:
    return F.try_variant_get(item, f"$.{field}", kind.simpleString()).alias(field)


def read_envelope(spark: SparkSession, path: str, schema: T.StructType, items: str,
                  lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Envelope documents {brand_url, crawled_at, total, items[]}, one a file
    or line.

    Returns the items in their order (``pos``) with the schema's fields (NULL
    where one is lacking or of another type), what else an item holds as
    map ``more`` of VARIANT; and one row a document: ``file``, ``status`` ('ok',
    'broken': not JSON, 'no items': another shape), ``n_items``, ``n_odd`` (items
    that are no objects; they are left out) and ``sample``."""
    docs = read_documents(spark, path, lines)
    listed = F.try_variant_get("doc", f"$.{items}", "array<variant>")
    docs = docs.select("file", "broken", listed.alias("listed"),
                       *[F.try_variant_get("doc", f"$.{c}", "string").alias(c) for c in ("brand_url", "crawled_at")])
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    status = F.when(F.col("broken").isNotNull(), "broken").when(F.col("listed").isNull(), "no items").otherwise("ok")
    odd = F.size(F.filter("listed", lambda v: ~F.coalesce(is_object(v), F.lit(False))))
    files = docs.select("file", status.alias("status"), F.coalesce(F.size("listed"), F.lit(0)).alias("n_items"),
                        F.coalesce(F.when(F.col("listed").isNotNull(), odd), F.lit(0)).alias("n_odd"), F.col("broken").alias("sample"))
    one = docs.select("file", "brand_url", "crawled_at", F.posexplode("listed").alias("pos", "item")).filter(is_object(F.col("item")))
    kind = next(f.dataType.elementType for f in schema.fields if f.name == items)
    known = F.array(*[F.lit(f.name) for f in kind.fields])
    more = F.map_filter(F.try_variant_get("item", "$", "map<string,variant>"), lambda k, v: ~F.array_contains(known, k))
    return one.select("file", "brand_url", "crawled_at", "pos", *[_known(f.dataType, F.col("item"), f.name) for f in kind.fields],
                      more.alias("more")), files


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Products of catalogue files, keeping rows with a non-empty code,
    in file order (``pos``); plus the files that are not as they should be."""
    items, files = read_envelope(spark, path, C.CATALOG_FILE, "products", lines)
    return items.filter(F.coalesce(F.col("product_code"), F.lit("")) != ""), files.filter("status <> 'ok' OR n_odd > 0")


def read_reviews(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: reviews of review files, in file order (``pos``), and the files
    that are not as they should be."""
    items, files = read_envelope(spark, path, C.REVIEW_FILE, "reviews", lines)
    return items, files.filter("status <> 'ok' OR n_odd > 0")


def write_lines(df: DataFrame, path: str, *, partition_by: list | None = None,
                mode: str = "overwrite") -> None:
    """S4 / S5 default: JSON Lines, UTF-8, nulls kept, one file per task."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def run_stamp(ts: str) -> Column:
    """The run time, taken once per run as a literal."""
    return F.lit(ts).cast("timestamp_ntz")


def output_base_name(given: Column, brand_name: Column, run_ts: Column) -> Column:
    """Last '_' token of the given output name, else the brand name,
    else 'brand_YYYYMMDD'."""
    tail = F.nullif(F.element_at(F.split(F.coalesce(given, F.lit("")), "_"), -1), F.lit(""))
    return F.coalesce(tail, F.nullif(brand_name, F.lit("")),
                      F.concat(F.lit("brand_"), F.date_format(run_ts, "yyyyMMdd")))


# ---------------------------------------------------------------- table snapshots

POINTER = "_CURRENT"


def write_snapshot(df: DataFrame, base: str, run_id: str, *, partition_by: list | None = None,
                   bucket_key: str | None = None) -> str:
    """Write the run's table as a new snapshot folder, then swap the
    pointer file (rename is atomic on HDFS-like stores); readers of the
    previous snapshot are never disturbed."""
    spark = df.sparkSession
    path = f"{base}/snapshots/{run_id}"
    if bucket_key:
        # clustered by the key inside each file: point lookups prune row
        # groups by min/max statistics
        df = df.sortWithinPartitions(bucket_key)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    write_pointer(spark, base, {"run_id": run_id, "path": path})
    return path


def write_pointer(spark: SparkSession, base: str, value: dict, name: str = POINTER) -> None:
    """Replace the pointer file in one rename that overwrites, so a reader
    finds the old value or the new one, also after a crash between them."""
    fs, _ = _fs(spark, base)
    jvm = spark._jvm
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(base))
    tmp = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    files.rename(files.makeQualified(tmp),
                 files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")), how)


def read_pointer(spark: SparkSession, base: str, name: str = POINTER) -> dict | None:
    fs, _ = _fs(spark, base)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream))
    text = reader.readLine()
    reader.close()
    return json.loads(text)


def write_snapshot_observed(df: DataFrame, base: str, run_id: str, **kw) -> tuple[str, dict]:
    """A15 on the write: the snapshot's row count is collected by an
    ``Observation`` while it is written (no second job)."""
    from pyspark.sql import Observation
    obs = Observation(f"write-{run_id}")
    path = write_snapshot(df.observe(obs, F.count(F.lit(1)).alias("rows")), base, run_id, **kw)
    return path, obs.get


def current_snapshot(spark: SparkSession, base: str) -> list[str] | None:
    """The folders that are the table now."""
    found = read_pointer(spark, base)
    return found.get("paths") or [found["path"]] if found else None


def read_table(spark: SparkSession, base: str, schema: T.StructType | None = None) -> DataFrame | None:
    """Scan the current snapshot (None when the table does not exist)."""
    paths = current_snapshot(spark, base)
    if paths is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(*paths)


# ---------------------------------------------------------------- several tables, one commit

MANIFESTS = "_manifests"


class StoreChanged(RuntimeError):
    """Another run became current since this one read the store."""


def _versions(spark: SparkSession, store: str) -> list[int]:
    fs, p = _fs(spark, f"{store}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def store_version(spark: SparkSession, store: str) -> int:
    """The current version, 0 before the first run."""
    return max(_versions(spark, store), default=0)


def read_manifest(spark: SparkSession, store: str, version: int | None = None) -> dict:
    """{table: [paths]} and what else the run put down, at a version (the
    current one)."""
    version = store_version(spark, store) if version is None else version
    if not version:
        return {"tables": {}, "run_id": None, "version": 0}
    return read_pointer(spark, f"{store}/{MANIFESTS}", f"{version:012d}.json") | {"version": version}


def read_store(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame | None:
    """A table as of a version (None: it does not exist there)."""
    paths = read_manifest(spark, store, version)["tables"].get(table)
    return spark.read.parquet(*paths) if paths else None


def write_part(df: DataFrame, store: str, table: str, run_id: str, *, sort_key: str | None = None,
               partition_by: list | None = None) -> tuple[str, int]:
    """A table of a run that nobody sees yet: its path, and the rows, counted
    by an ``Observation`` while they are written (A15)."""
    from pyspark.sql import Observation
    path = f"{store}/{table}/{run_id}-{uuid.uuid4().hex[:8]}"
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if sort_key:  # point look-ups prune row groups by their statistics
        df = df.sortWithinPartitions(sort_key)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path, seen.get["rows"]


def commit(spark: SparkSession, store: str, read_version: int, run_id: str, tables: dict, **more) -> int:
    """Make ``tables`` ({name: path or paths}) current, as the version after
    ``read_version``; tables that are not named stay as they are there.
    Raises ``StoreChanged`` if another run did so first."""
    fs, folder = _fs(spark, f"{store}/{MANIFESTS}")
    jvm = spark._jvm
    fs.mkdirs(folder)
    before = read_manifest(spark, store, read_version)["tables"]
    now = before | {t: [p] if isinstance(p, str) else list(p) for t, p in tables.items()}
    version = read_version + 1
    tmp = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps({"run_id": run_id, "tables": now} | more).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(files.makeQualified(tmp), files.makeQualified(target), how)
    except Exception as e:
        fs.delete(tmp, False)
        if fs.exists(target):
            raise StoreChanged(f"{store}: version {version} is there already") from e
        raise
    return version


# ---------------------------------------------------------------- bucketed tables

def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> dict:
    """``df`` as files in hash buckets of the key, one a bucket; returns what
    ``read_bucketed`` needs to know, to be kept in a manifest."""
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name))
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table's files stay
    return {"path": path, "key": key, "buckets": buckets, "schema": df.schema.json()}


def read_bucketed(spark: SparkSession, stored: dict) -> DataFrame:
    """The table as one that is dealt by its key already: joins and groupings
    on the key do not shuffle it.  Registered in the session's catalogue under
    a name made from its path."""
    name = "bucketed_" + uuid.uuid5(uuid.NAMESPACE_URL, stored["path"]).hex
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(json.loads(stored["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        key = stored["key"]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {stored['buckets']} BUCKETS LOCATION '{stored['path']}'")
    return spark.table(name)
