"""Mixing sources to target weights by entropy balancing.

A source's documents get rates that are as close to 1 as can be (least
Kullback-Leibler divergence) while they meet two moments: the source's target
tokens, and as many documents as leave its mean length as it is.  The solution
is an exponential tilt, rate = exp(a + b (size / mean - 1)), whose a and b
maximise the convex dual; Newton steps find them, each one aggregate over all
documents, which enter as a histogram of (source, size).  Without the second
moment the tilt would meet a small target by dropping all long documents.

Rates become whole copies: everyone gets the whole part; the fraction is dealt
by sequential Poisson sampling (least hash of the document / fraction first),
as far as the target goes, so each source ends within half a document of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import WORD, text_of, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more than so many times.
MOST = 3
#: Parts into which the order of dealing is cut; only one part of each source
#: is ordered row by row.
PARTS = 4096
#: Newton steps end at this relative gap.
EXACT = 1e-12

_SIZE, _DRAW, _SID = "__mix_size", "__mix_draw", "__mix_sid"


def words_in(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def draw(key: str, size: Column) -> Column:
    """A number in [0, 1) that depends on the key and the size alone."""
    said = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, sid, total, target: shares of all tokens by weight; what a
    source of ``MOST`` times its tokens cannot take goes to the others by
    weight.  ``sizes``: source and total, one row a source, ordered here by
    code point, null last."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    # sources in the order in which they fill up; level: the words a weight of 1 gets if those before are full;
    # it rises as long as sources do fill up, so the highest is the one that holds
    full = F.col("total") * MOST
    order = Window.orderBy(full / F.col("weight"), "sid")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("total").over(Window.partitionBy())
    s = s.withColumn("level", (everything - before).cast("double") / rest)
    s = s.withColumn("level", F.max("level").over(Window.partitionBy()))
    return s.select("source", "sid", "total", F.least(full.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def tilts(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """sid, mean, a, b of every source with words: the dual's solution.

    ``histogram``: sid, size (above 0), n.  Each step sums gradient and
    Hessian of the dual over all documents and moves every source at once.
    """
    moments = histogram.groupBy("sid").agg(F.sum("n").alias("docs"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = written(goals.where("total > 0").join(moments, "sid").select(
        "sid", "docs", "mean", (F.col("target") / F.col("total")).alias("ratio"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), "tilts")
    x = F.col("size") / F.col("mean") - 1
    share = F.col("n") / F.col("docs") * F.exp(F.col("a") + F.col("b") * x)
    while True:
        sums = histogram.join(state, "sid").groupBy("sid").agg(
            F.sum(share).alias("h0"), F.sum(share * x).alias("h1"), F.sum(share * x * x).alias("h2"))
        gap0, det = F.col("h0") - F.col("ratio"), F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        flat = det < 1e-12  # all of one size: the second moment says nothing
        da = F.when(flat, gap0 / F.col("h0")).otherwise((F.col("h2") * gap0 - F.col("h1") * F.col("h1")) / det)
        db = F.when(flat, 0.0).otherwise((F.col("h0") * F.col("h1") - F.col("h1") * gap0) / det)
        gap = F.greatest(F.abs(gap0), F.abs(F.col("h1"))) / F.col("ratio")
        step = written(state.join(sums, "sid").select(
            "sid", "docs", "mean", "ratio", (F.col("a") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), da))).alias("a"),
            (F.col("b") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), db))).alias("b"), gap.alias("gap")), "tilts")
        widest = step.agg(F.max("gap")).first()[0]
        state = step.drop("gap")
        if widest is None or widest < EXACT:
            return state.select("sid", "mean", "a", "b")


def copies(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``source`` and the working columns size and draw,
    with source_size, target and copies (int)."""
    sizes = written(rows.groupBy("source", F.col(_SIZE).alias("size")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    goals = written(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))), "targets")
    histogram = written(sizes.where("size > 0").join(goals, sizes["source"].eqNullSafe(goals["source"])).select("sid", "size", "n"), "histogram")
    tilted = tilts(histogram, goals)

    def dealt(frame: DataFrame) -> DataFrame:
        """whole copies, and the place in the order of dealing."""
        rate = F.coalesce(F.exp(F.col("a") + F.col("b") * (F.col(_SIZE) / F.col("mean") - 1)), F.lit(0.0))
        frame = frame.withColumn("__mix_rate", rate).withColumn("__mix_whole", F.least(F.floor("__mix_rate"), F.lit(MOST)))
        place = F.col(_DRAW) / F.greatest(F.col("__mix_rate") - F.col("__mix_whole"), F.lit(1e-12))
        frame = frame.withColumn("__mix_place", place / (place + 1))
        return frame.withColumn("__mix_part", F.floor(F.col("__mix_place") * PARTS))

    named = goals.select(F.col("source").alias("__mix_source"), F.col("sid").alias(_SID), F.col("total").alias("source_size"), "target")
    known = named.join(tilted.withColumnRenamed("sid", _SID), _SID, "left")
    placed = dealt(rows.join(known, rows["source"].eqNullSafe(known["__mix_source"])))
    parts = placed.where(F.col(_SIZE) > 0).groupBy(_SID, "target", "__mix_part").agg(
        F.sum(_SIZE).alias("size"), F.sum(F.col("__mix_whole") * F.col(_SIZE)).alias("whole"))
    parts = written(parts, "parts")
    run = Window.partitionBy(_SID).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("target") - F.sum("whole").over(Window.partitionBy(_SID))
    parts = parts.withColumns({"before": F.coalesce(F.sum("size").over(run), F.lit(0)), "need": need})
    # the part in which the target is reached: the first that it may not take whole
    edge = parts.where(F.col("before") + F.col("size") > F.col("need")).groupBy(_SID).agg(
        F.min(F.struct(F.col("__mix_part").alias("part"), F.col("before"), F.col("need"))).alias("__mix_edge"))
    placed = placed.join(written(edge, "edges"), _SID, "left")
    at, part = F.col("__mix_edge.part"), F.col("__mix_part")
    inside = (F.col(_SIZE) > 0) & (part == at)
    within = Window.partitionBy(_SID).orderBy("__mix_place", _SIZE).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("__mix_edge.before") + F.coalesce(F.sum(_SIZE).over(within), F.lit(0)) + F.col(_SIZE) / 2
    split = placed.where(inside).withColumn("__mix_extra", reached <= F.col("__mix_edge.need"))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("__mix_extra", at.isNull() | (part < at))
    whole = F.col("__mix_whole") + F.col("__mix_extra").cast("int")
    out = split.unionByName(rest).withColumn("copies", F.when(F.col(_SIZE) > 0, F.least(whole, F.lit(MOST))).otherwise(0).cast("int"))
    return out.drop(*(c for c in out.columns if c.startswith("__mix_") and c != _SIZE))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken: a row for each row of ``docs``.

    Null and empty texts have size 0 and are not taken; null sources are one
    source, the last; null keys draw alike, so repeated rows and null keys are
    dealt one after the other; a source without words has target 0; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), words_in(text).alias(_SIZE))
    rows = written(rows.withColumn(_DRAW, draw("k", F.col(_SIZE))), "mix")
    return copies(rows).select(F.col("k").alias(key), F.col(_SIZE).alias("size"), "source_size", "target", (F.col("copies") * F.col(_SIZE)).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col(source).alias("source"), words_in(text).alias(_SIZE), F.col(key).alias("k"))
    rows = rows.withColumn(_DRAW, draw("k", F.col(_SIZE))).drop("k")
    taken = copies(rows).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.col("copies"))).alias("__row")).select(*(F.col(f"__row.`{c}`") for c in names))
