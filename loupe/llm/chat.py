"""Chat formatting by grammar round trip.

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }

A conversation is rendered with its texts as they are, reparsed by the
grammar, and compared with its source; what does not come back identical is
escaped: ``<``, any backslashes, ``|`` gets one more backslash, which the
parser takes away again, so an escaped text holds no control string.  First
the turns that conflict on their own are escaped, then, should the whole still
differ, all of them.  Everything is built-in string and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import shared_path

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation; what follows a
    turn's first end mark is not read."""
    bodies = F.filter(F.split(formatted, START.replace("|", r"\|")), lambda b: b != "")

    def turn(body: Column) -> Column:
        inner = F.substring_index(body, END, 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    return F.transform(bodies, turn)


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, formatted, loss: each conversation with the (start, length) spans,
    in code points, of the texts under the loss mask.

    Rows come by turn, equal turns by role and text, null turns first; null
    roles and texts are empty; null keys are one conversation; repeated rows
    are repeated turns; an empty table gives no rows; other columns are not
    read.
    """
    src = turns.select(F.col(key).alias("k"), F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    said = F.array(F.struct("role", "text"))
    alone = parse(render(F.col("role"), F.col("text"))) == said
    src = src.withColumn("plain", alone).withColumns({
        "r0": F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role"))), "t0": F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))),
        "r1": escape_role(F.col("role")), "t1": escape(F.col("text"))})
    before = Window.partitionBy("k").orderBy("n", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.struct("n", "role", "text").alias("key")]
    for level in "01":
        src = src.withColumn(f"f{level}", render(F.col(f"r{level}"), F.col(f"t{level}")))
        head = F.lit(len(START) + 1) + F.length(f"r{level}")
        src = src.withColumn(f"at{level}", F.coalesce(F.sum(F.length(f"f{level}")).over(before), F.lit(0)) + head)
        cols += [F.col(f"f{level}"), F.struct(F.col(f"at{level}").cast("int").alias("start"), F.length(f"t{level}").alias("length")).alias(f"span{level}")]
    whole = src.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    source = F.transform("rows", lambda r: F.struct(r["key"]["role"].alias("role"), r["key"]["text"].alias("text")))

    def joined(level: str) -> Column:
        return F.array_join(F.transform("rows", lambda r: r[f"f{level}"]), "")

    def spans(level: str) -> Column:
        return F.transform(F.filter("rows", lambda r: r["key"]["role"] == LOSS_ROLE), lambda r: r[f"span{level}"])

    whole = whole.withColumns({"source": source, "first": joined("0")})
    whole = whole.withColumn("same", parse(F.col("first")) == F.col("source"))
    formatted = F.when(F.col("same"), F.col("first")).otherwise(joined("1"))
    loss = F.when(F.col("same"), spans("0")).otherwise(spans("1"))
    return whole.select(F.col("k").alias(key), formatted.alias("formatted"), loss.alias("loss"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def formatted_chats(turns: DataFrame, key: str = "conv_id", **names: str) -> DataFrame:
    """``format_chats`` written as Parquet, read back and described: key,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    path = shared_path(turns.sparkSession, "chats")
    out = format_chats(turns, key, **names)
    out.write.parquet(path)
    got = turns.sparkSession.read.schema(out.schema).parquet(path)
    got = got.withColumns({"turns": parse(F.col("formatted")), "under": loss_text(F.col("formatted"), F.col("loss"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                      F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
