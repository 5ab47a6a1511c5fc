"""Which filter takes what, in every order of the filters.

Every row of a table fails a set of filters: its mask.  All that an order of
filters does to a row follows from the mask, so rows are counted by (part,
mask) first, with their labels: at most two to the power of the filters cells a
part, whatever the number of rows.  Each cell then folds across the array of
all orders (a literal, which Spark sends with the task): ``aggregate`` walks an
order's filters with the state "still there", ``transform`` does so for every
order, and one cell gives a struct for each order and step, weighted by the
cell's counts.  The arrays of a part's cells are added element by element.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import written

_SPACES = r"[\x20\x09-\x0D]+"
#: What a struct of the folded array holds.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(said: Column, words: Column) -> list[Column]:
    """The four conditions A to D on a text that is not null, and its words."""
    capitals = F.char_length(said) - F.char_length(F.regexp_replace(said, "[A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.char_length(said),
        said.rlike("[#$%&*|]"),
    ]


def mask_of(failures: Sequence[Column]) -> Column:
    """An integer whose bit i says whether failure i holds (null: it does not)."""
    mask = F.lit(0)
    for i, failure in enumerate(failures):
        mask = mask + F.when(failure, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def document_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask of the filters A
    to E.  Rows that repeat a key, or a third of all rows with one text, are
    counted before they are dealt out."""
    rows = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{key}`").alias("id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("said"))
    rows = rows.withColumn("words", F.array_remove(F.split("said", _SPACES), ""))
    rows = rows.select("part", "id", mask_of(text_failures(F.col("said"), F.col("words"))).alias("mask"),
                       F.unhex(F.sha2(F.col("said").cast("binary"), 256)).alias("digest"))
    rows = written(rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    # a text's smallest key; the pair joins, so no group of copies meets in one task
    least = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    known = rows.where("id IS NOT NULL").join(least, ["digest", "id"], "left")
    again = F.when(F.col("least"), 0).otherwise(1 << 4)
    known = known.groupBy("id", "part", (F.col("mask") + again).alias("mask")).agg(F.sum("n").alias("n"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = known.join(said, "id", "left")
    none = rows.where("id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    marked = marked.select("part", "mask", "n", "good", "toxic").unionByName(none)
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")))


def folded(orders: Column) -> Column:
    """The cell's structs, order by order and step by step; ``orders``: arrays
    of bits.  Reads mask, n, good and toxic."""
    mask, n = F.col("mask"), F.col("n")

    def struct(there: Column, fails: Column, bit: Column) -> Column:
        taken = there * fails
        counts = (there * (1 - fails) * n, taken * n, (1 - there) * fails * n,
                  (mask == F.call_function("shiftleft", F.lit(1), bit)).cast("long") * n, taken * F.col("good"), taken * F.col("toxic"))
        return F.struct(*(c.cast("long").alias(name) for c, name in zip(counts, COUNTS)))

    def step(at: Column, bit: Column) -> Column:
        fails = F.call_function("shiftright", mask, bit).bitwiseAND(F.lit(1)).cast("long")
        there = at["there"]
        return F.struct((there * (1 - fails)).alias("there"), F.concat(at["steps"], F.array(struct(there, fails, bit))).alias("steps"))

    kind = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(F.lit(1).cast("long").alias("there"), F.array().cast(f"array<struct<{kind}>>").alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda at: at["steps"])))


def added(arrays: Column) -> Column:
    """One array: the sums of the structs at each place."""
    def both(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS)))
    return F.aggregate(F.slice(arrays, 2, F.size(arrays)), F.get(arrays, F.lit(0)), both)


def audit(cells: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, the counts and shapley, for every order of the
    filters ``names`` (one letter each, the letter of bit i at i).

    ``cells``: part, mask, n, good, toxic, one row a part and mask.  A cell's
    array has orders x steps structs and a part at most 2 ** filters cells, so
    what one task holds does not grow with the table.
    """
    orders = list(permutations(range(len(names))))
    bits = F.lit([list(o) for o in orders])
    arrays = cells.select("part", folded(bits).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("steps"))
    rows = arrays.select("part", F.posexplode(added(F.col("steps"))).alias("place", "at"))
    order = F.element_at(F.lit(["".join(names[i] for i in o) for o in orders]), (F.floor(F.col("place") / len(names)) + 1).cast("int"))
    rows = rows.select("part", order.alias("filter_order"), (F.col("place") % len(names) + 1).cast("int").alias("step"), "at.*")
    letter = F.substr("filter_order", "step", F.lit(1))
    rows = rows.withColumn("letter", letter)
    sums = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(sums, ["part", "letter"]).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: 600 rows for each value of ``part``.

    Null texts are empty; null parts are the empty string.  E compares keys: a
    row without key is nobody's repeat and nobody repeats it; rows that repeat a
    key count each, and fail E only if a smaller key has their text.  A key that
    several labels name is good (toxic) if one says so; labels without a key
    and rows without a label add nothing to good_lost and toxic_lost.  An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    return audit(document_cells(docs, labels, key, text, part), "ABCDE")
