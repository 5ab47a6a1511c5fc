"""Joins that merge runs: resume anti-join (J1), fills and overrides (J2,
J3), upserts (D6, D8), constraint and orphan checks (D9, D10).

Upserts are full-outer joins on the natural key followed by per-column
``coalesce``; the result is written as a new snapshot (plain Parquet has no
MERGE).  Both sides shuffle on the key once; bucketing the catalogue on
``product_code`` removes that shuffle for the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonempty(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def first_nonempty(*cs) -> Column:
    """First non-empty wins; '' when all are empty (the original's missing)."""
    return F.coalesce(*[nonempty(c) for c in cs], F.lit(""))


def resume_anti(listing: DataFrame, catalog_codes: DataFrame, catalog_serials: DataFrame, *,
                code: str = "product_code", serial: str = "serial") -> DataFrame:
    """Drop listing rows whose serial OR code is already catalogued.
    Two chained equi anti-joins; a single OR-condition anti-join would plan
    as a nested loop over the whole catalogue.  An empty code or serial is a
    missing one and matches nothing."""
    codes = catalog_codes.select(F.col(code).alias("_c")).filter(F.col("_c").isNotNull() & (F.col("_c") != ""))
    serials = catalog_serials.select(F.col(serial).alias("_s")).filter(F.col("_s").isNotNull() & (F.col("_s") != ""))
    return (listing.join(codes, listing[code] == codes["_c"], "left_anti")
            .join(serials, listing[serial] == serials["_s"], "left_anti"))


def _known_values(values: DataFrame, column: str, name: str) -> DataFrame:
    return values.select(F.col(column).alias(name)).filter(F.col(name) != "").distinct()


def mark_known(rows: DataFrame, codes: DataFrame, serials: DataFrame, *, code: str = "product_code",
               serial: str = "serial", known_code: str = "product_code", known_serial: str = "serial") -> DataFrame:
    """J1 as a flag: ``rows`` with ``known``: whether an earlier run has the
    code or the serial.  Two equi-joins on distinct values; empty ones match
    nothing."""
    c = _known_values(codes, known_code, "_c").withColumn("_has_c", F.lit(True))
    s = _known_values(serials, known_serial, "_s").withColumn("_has_s", F.lit(True))
    out = rows.join(c, rows[code] == c["_c"], "left").join(s, rows[serial] == s["_s"], "left")
    return out.withColumn("known", F.coalesce("_has_c", "_has_s", F.lit(False))).drop("_c", "_s", "_has_c", "_has_s")


def fill_from_listing(detail: DataFrame, listing: DataFrame, *, url: str = "product_url",
                      fields=("product_code", "product_name")) -> DataFrame:
    """J2 from the detail's side: a product page without code or name takes
    that of the listing entry that links to it; products that no listing has
    stay as they are.  One entry a URL."""
    entry = listing.select(F.col(url).alias("_url"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    j = detail.join(entry, detail[url] == entry["_url"], "left")
    return j.select(*[first_nonempty(detail[c], f"_l_{c}").alias(c) if c in fields else detail[c] for c in detail.columns])


def listing_fill(listing: DataFrame, detail: DataFrame, *, key: str = "pos",
                 url: str = "product_url",
                 fields=("product_code", "product_name")) -> DataFrame:
    """Detail values win when non-empty, else the listing's; the listing
    URL always wins when non-empty.  ``key`` pairs a listing entry with the
    detail crawled from it."""
    d = detail.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_d_{f}") for f in fields],
                      F.col(url).alias("_d_url"))
    j = listing.join(d, listing[key] == d["_k"], "left")
    out = [first_nonempty(f"_d_{f}", listing[f]).alias(f) for f in fields]
    return j.select(*[listing[c] for c in listing.columns if c not in fields and c != url],
                    first_nonempty(listing[url], "_d_url").alias(url), *out)


def notice_override(basic: DataFrame, notice: DataFrame, *, key: str = "product_code",
                    fields=("usage_method", "ingredients", "precautions")) -> DataFrame:
    """The notice page's text fields win when non-empty."""
    n = notice.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = basic.join(n, basic[key] == n["_k"], "left")
    return j.select(*[c for c in basic.columns if c not in fields],
                    *[first_nonempty(f"_n_{f}", f).alias(f) for f in fields])


def upsert(current: DataFrame, updates: DataFrame, *, key: str, fields: list,
           run_ts: Column, created: str = "created_at", updated: str = "updated_at",
           absent_is_null: bool = True) -> DataFrame:
    """Update fields present in the input (NULL = absent; an empty
    string does overwrite), insert new keys; ``updated_at`` = this run,
    ``created_at`` kept for existing keys."""
    u = updates.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_uk"), *[F.col(f).alias(f"_u_{f}") for f in fields],
        F.lit(True).alias("_hit"))
    j = current.join(u, current[key] == u["_uk"], "full_outer")
    sel = [F.coalesce(current[key], F.col("_uk")).alias(key)]
    for f in fields:
        if absent_is_null:
            sel.append(F.coalesce(F.col(f"_u_{f}"), current[f]).alias(f))
        else:
            sel.append(F.when(F.col("_hit"), F.col(f"_u_{f}")).otherwise(current[f]).alias(f))
    sel.append(F.coalesce(current[created], run_ts).alias(created))
    sel.append(F.when(F.col("_hit"), run_ts).otherwise(current[updated]).alias(updated))
    return j.select(*sel)


def _key_counts(df: DataFrame, key: str, not_null: list) -> DataFrame:
    """One row a key: its rows, and how many lack each required column."""
    return df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{i}") for i, c in enumerate(not_null)])


def _broken(key: str, not_null: list) -> Column:
    """Of a row of ``_key_counts``: struct(constraint, n) of each constraint
    that it breaks."""
    one = lambda name, n, bad: F.when(bad, F.struct(F.lit(name).alias("constraint"), n.alias("n")))
    return F.array_compact(F.array(
        one("unique", F.col("_n"), F.col("key").isNotNull() & (F.col("_n") > 1)),
        *[one(f"not_null:{c}", F.col(f"_null_{i}"), F.col(f"_null_{i}") > 0) for i, c in enumerate(not_null)]))


def constraint_violations(df: DataFrame, *, key: str, not_null: list) -> DataFrame:
    """Duplicate keys and NULL required columns, as a violations table
    (constraint, key, n): one conditional aggregate by key, whatever the
    number of constraints."""
    return _key_counts(df, key, not_null).select("key", F.inline(_broken(key, not_null))).select("constraint", "key", "n")


def strict(df: DataFrame, *, key: str, not_null: list) -> DataFrame:
    """D9 in the plan: ``df``, whose reading (so, the write of it) fails at
    the first broken constraint."""
    told = F.get("_bad", F.lit(0))
    message = F.concat(F.lit("constraint "), told["constraint"], F.lit(f" broken by {key} "), F.coalesce(F.col("key").cast("string"), F.lit("NULL")))
    counts = _key_counts(df, key, not_null).withColumn("_bad", _broken(key, not_null)).select(
        F.col("key").alias("_key"), F.when(F.size("_bad") > 0, F.raise_error(message).cast("boolean")).otherwise(True).alias("_fine"))
    return df.join(counts, df[key].eqNullSafe(F.col("_key"))).filter("_fine").drop("_key", "_fine")


def missing_key_reason(key: str) -> Column:
    """Why a row cannot be stored; NULL if it can."""
    c = F.col(key)
    return F.when(c.isNull(), "null key").when(c == "", "empty key")


def with_key(df: DataFrame, *, key: str, strict: bool = False) -> DataFrame:
    """The rows that have a key.  ``strict``: a row without one ends the
    job that reads them, instead of being left to ``without_key``."""
    reason = missing_key_reason(key)
    if strict:
        return df.filter(F.when(reason.isNotNull(), F.raise_error(F.concat(reason, F.lit(f": {key}"))).cast("boolean")).otherwise(True))
    return df.filter(reason.isNull())


def without_key(df: DataFrame, *, key: str) -> DataFrame:
    """The quarantine: the other rows, with the reason."""
    return df.withColumn("reason", missing_key_reason(key)).filter(F.col("reason").isNotNull())


def orphans(children: DataFrame, parents: DataFrame, *, key: str = "product_code") -> DataFrame:
    """Children whose parent is gone (the cascade would delete them)."""
    return children.join(parents.select(key), key, "left_anti")
