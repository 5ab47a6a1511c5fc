"""Keep-first dedup (D1, D2, D4) and latest-wins merge.

Whole texts make poor keys: they would be sorted and shuffled as such, and
carried in the aggregate's buffer.  ``first_by_digest`` works in two phases.
First a hash aggregate of a 128-bit digest of the key with the least position
(a number: positions of several columns are packed into one decimal): narrow
rows that combine map-side, so a key that holds a third of all rows is one row
a task.  Then each row whose position is its digest's least stays, by a
left-semi join on (digest, position), which spreads even one digest's rows.
A third, independent hash goes along: two keys under one digest end the job
rather than one of them, and ``check=True`` compares the texts themselves.

``keep_first`` (a grouped ``min_by``) remains for short keys.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

#: Digits that a whole number of the type takes once it is shifted above 0.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_HALF = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31, T.LongType: 1 << 63}


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_first(df: DataFrame, keys: list, order) -> DataFrame:
    """One row per key: the row with the smallest ``order`` (unique order
    values make the result deterministic)."""
    cols = df.columns
    kcols = [_as_col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return (df.groupBy(*kcols)
            .agg(F.min_by(F.struct(*cols), _as_col(order)).alias("_r"))
            .select("_r.*"))


def keep_last(df: DataFrame, keys: list, order) -> DataFrame:
    cols = df.columns
    kcols = [_as_col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return (df.groupBy(*kcols)
            .agg(F.max_by(F.struct(*cols), _as_col(order)).alias("_r"))
            .select("_r.*"))


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not only
    spaces (Spark ``trim`` removes spaces only)."""
    return F.trim(c, F.lit(C.PY_WHITESPACE))


def position(df: DataFrame, order: list) -> Column:
    """The columns of ``order`` as one value of the same order: whole numbers
    as one number, which a hash aggregate can keep (a lone column as it is;
    several as a decimal, if 38 digits hold them); else a struct."""
    cols = [_as_col(c) for c in order]
    kinds = [f.dataType for f in df.select(*cols).schema.fields]
    if len(cols) == 1:
        return cols[0]
    if not all(type(k) in _DIGITS for k in kinds) or sum(_DIGITS[type(k)] for k in kinds) > 38:
        return F.struct(*cols)
    out, scale = F.lit(Decimal(0)).cast("decimal(38,0)"), 0
    for c, k in reversed(list(zip(cols, kinds))):
        digits, half = _DIGITS[type(k)], _HALF[type(k)]
        part = (c.cast("decimal(20,0)") + F.lit(Decimal(half))).cast("decimal(21,0)") * F.lit(Decimal(10 ** scale))
        out, scale = (out + part.cast("decimal(38,0)")).cast("decimal(38,0)"), scale + digits
    return out


def digest(keys: list) -> list[Column]:
    """128 bits of the key columns in two numbers, and 64 more to tell keys
    under one digest apart."""
    return [F.xxhash64(F.lit(seed), *keys).alias(name) for seed, name in ((11, "_h1"), (23, "_h2"), (37, "_h3"))]


def least_positions(rows: DataFrame, order: str = "_at") -> DataFrame:
    """_h1, _h2, least: the first phase, over rows that carry ``digest`` and a
    position."""
    told = F.when(F.min("_h3") == F.max("_h3"), F.min(order)).otherwise(
        F.raise_error(F.lit("two keys share a digest: use keep_first")).cast(rows.schema[order].dataType))
    return rows.groupBy("_h1", "_h2").agg(told.alias("_least"))


def first_by_digest(df: DataFrame, keys: list, order, *, check: bool = False) -> DataFrame:
    """One row per key: the row with the smallest ``order`` (a column or a
    list), which is not null and tells the rows of a key apart.  A null key is a
    key like any other.  ``check``: compare the keys themselves, and group by them what shares a digest without being
    equal."""
    cols = df.columns
    order = order if isinstance(order, list) else [order]
    # a null must not meet the hash of an empty text
    kcols = [F.struct(k.isNull(), k) for k in map(_as_col, keys)]
    narrow = df.select(*digest(kcols), position(df, order).alias("_at"))
    if check:
        tagged = df.select(F.struct(*cols).alias("_row"), F.struct(*map(_as_col, keys)).alias("_key"), *digest(kcols)[:2])
        shared = tagged.groupBy("_h1", "_h2").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b")).filter("_a <> _b")
        apart = tagged.join(shared.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").select("_row.*")
        alone = tagged.join(shared.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti").select("_row.*")
        return first_by_digest(alone, keys, order).unionByName(keep_first(apart, keys, F.struct(*map(_as_col, order))))
    least = least_positions(narrow)
    rows = df.select(F.struct(*cols).alias("_row"), *digest(kcols)[:2], position(df, order).alias("_at"))
    here = (rows["_h1"] == least["_h1"]) & (rows["_h2"] == least["_h2"]) & rows["_at"].eqNullSafe(least["_least"])
    return rows.join(least, here, "left_semi").select("_row.*")


def review_key(text: Column, rule: str, prefix: int = C.DEDUP_PREFIX_CHARS) -> Column:
    """What of a review's text its key holds: D1 a prefix, D2 all of it but
    the white space around."""
    t = F.coalesce(text, F.lit(""))
    return F.substring(t, 1, prefix) if rule == "prefix" else strip_ws(t)


def dedup_reviews(reviews: DataFrame, *, rule: str = "full", key: str = "product_code",
                  user: str = "username", text: str = "review_text", order="pos",
                  prefix: int = C.DEDUP_PREFIX_CHARS, check: bool = False) -> DataFrame:
    """Review dedup.

    rule='prefix' (D1, crawl rule): product + username + first 50 chars.
    rule='full'   (D2, documented rule): product + username + stripped text.
    rule='none'   (D3 as implemented): no dedup.
    The key is a column tuple, so a '_' inside a name cannot collide.
    """
    if rule == "none":
        return reviews
    keys = [key, F.coalesce(F.col(user), F.lit("")), review_key(F.col(text), rule, prefix)]
    return first_by_digest(reviews, keys, order, check=check)


def merge_append(existing: DataFrame, new: DataFrame, *, dedup: str = "full",
                 **kw) -> DataFrame:
    """D3 then D2 by default: union all, then keep-first on the documented
    key; a stored review was seen before any of this run's, whatever its
    position.  ``dedup='none'`` keeps the original append-only behaviour."""
    order = kw.pop("order", "pos")
    both = (existing.withColumn("_run", F.lit(0))
            .unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True))
    return dedup_reviews(both, rule=dedup, order=["_run", *(order if isinstance(order, list) else [order])], **kw).drop("_run")


def catalog_merge(old: DataFrame, new: DataFrame, *, key: str = "product_code",
                  run: str = "run_ts", pos: str = "pos") -> DataFrame:
    """The newest record of a key replaces the whole old one; rows
    without a key are dropped; order is the first insertion (``first_pos``)."""
    u = old.unionByName(new, allowMissingColumns=True).filter(
        F.col(key).isNotNull() & (F.col(key) != ""))
    seen = F.struct(F.col(run), F.col(pos))
    if "first_pos" in u.columns:  # a stored catalogue keeps its first insertion
        seen = F.coalesce(F.col("first_pos"), seen)
    u = u.withColumn("_seen", seen).drop("first_pos")
    cols = [c for c in u.columns if c not in (key, "_seen")]
    return (u.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(F.col(run), F.col(pos))).alias("_r"),
                 F.min("_seen").alias("first_pos"))
            .select(key, "_r.*", "first_pos"))
