"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the ``K`` least 64-bit hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole, and two of them estimate
how alike two texts are, how much of one the other holds, and how many
distinct shingles a text has.  All of it is built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import text_of

#: Words of a shingle; hashes of a sketch.
SHINGLE, K = 5, 128


def sketch(text: Column, k: int = K) -> Column:
    """The ``k`` least distinct shingle hashes, ascending.  A text of fewer
    than five words is one shingle, one without words has none."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")

    def hashes(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(grams)), 1, k)).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(words), hashes)[0]  # the words are split once, not once a shingle


def packed(s: Column) -> Column:
    """A sketch as text: its hashes' 8 bytes each, in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def unpacked(text: Column) -> Column:
    digits = F.hex(F.unbase64(text))
    parts = F.sequence(F.lit(0), (F.length(digits) / 16).cast("int") - 1)
    each = F.transform(parts, lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return F.when(F.length(digits) > 0, each).otherwise(F.array().cast("array<long>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(rows: DataFrame, by: str, s: str, k: int = K) -> DataFrame:
    """by, sketch: one sketch for all rows of a group.  Hashes are made
    distinct and ranked before they meet, so a group of any size is gathered
    as ``k`` rows at most."""
    each = rows.select(F.col(by).alias("g"), F.explode(s).alias("h")).distinct()
    least = each.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("r") <= k)
    got = least.groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("h"))
    empty = rows.select(F.col(by).alias("g")).distinct()
    return empty.join(got, empty["g"].eqNullSafe(got["g"]), "left").select(empty["g"].alias(by), F.coalesce("h", F.array().cast("array<long>")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets (exact below ``k``
    distinct shingles); two empty sketches are alike, 1."""
    union = merged(a, b, k)
    common = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) > 0, F.size(common) / F.size(union)).otherwise(F.lit(1.0))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    top = F.element_at(s, -1).cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(j / (1 + j) * (n + m) / n, F.lit(1.0)))


def _bucket(key: Column, bounds: list[float]) -> Column:
    """Place of ``key`` among the bounds: a binary search as nested cases."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return F.when(key.isNull(), F.lit(-1)).otherwise(part(0, len(bounds)))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, t, bucket, halo, and the window in which each row is followed by
    the next in descending order of the key (nulls last, equal keys by text),
    the last by the first.

    Ranges of keys (as many as shuffle partitions, from approximate quantiles)
    are ordered apart; each range ends with a copy of the next one's first row,
    marked ``halo``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    bounds = sorted(set(t.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    t = t.withColumn("bucket", _bucket(F.col("k"), bounds))
    firsts = sorted(((r["bucket"], r["k"]) for r in t.groupBy("bucket").agg(F.max("k").alias("k")).collect()), reverse=True)
    if not firsts:
        return t.withColumn("halo", F.lit(False))
    # the first key of each range goes to the range before it
    goes = {firsts[(i + 1) % len(firsts)][1]: b for i, (b, _) in enumerate(firsts)}
    wanted = F.col("k").isin([k for k in goes if k is not None]) | (F.col("k").isNull() if None in goes else F.lit(False))
    to = F.lit(None).cast("int")
    for k, b in goes.items():
        to = F.when(F.col("k").eqNullSafe(F.lit(k).cast("long")), F.lit(b)).otherwise(to)
    halo = t.where(wanted).groupBy("k").agg(F.min("t").alias("t")).select("k", "t", to.alias("bucket"), F.lit(True).alias("halo"))
    return t.withColumn("halo", F.lit(False)).unionByName(halo)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct_shingles, contained: a row for each row.

    The edited text has its last third replaced by as many characters of the
    next document, in descending order of the key.  Null texts are empty;
    empty texts have empty fingerprints, alike with likeness 1; null keys come
    last, equal keys follow each other by text; one document follows itself;
    an empty table gives no rows; other columns are not read.
    """
    rows = with_next(docs, key, text)
    order = Window.partitionBy("bucket").orderBy(F.col("halo"), F.col("k").desc_nulls_last(), F.col("t"))
    third = F.floor(F.length("t") / 3).cast("int")
    rows = rows.withColumn("follows", F.coalesce(F.lead("t").over(order), F.lit("")))
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.length("t") - third), F.substring("follows", F.lit(1), third)))
    rows = rows.select("bucket", "halo", "k", "t", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       sketch(F.col("t"), k).alias("own"), F.when(~F.col("halo"), sketch(F.col("edited"), k)).alias("new"))
    rows = rows.withColumn("after", F.coalesce(F.lead("own").over(order), F.array().cast("array<long>"))).where("not halo")
    return rows.select(F.col("k").alias(key), "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("new")).alias("edited_fingerprint"),
                       resemblance(F.col("own"), F.col("new"), k).alias("near_edited"), resemblance(F.col("own"), F.col("after"), k).alias("near_next"),
                       distinct_shingles(F.col("own"), k).alias("distinct_shingles"), containment(F.col("new"), F.col("own"), k).alias("contained"))
