"""Listing-text and price scalars (F1-F7, F11-F13).  Column -> Column,
all JVM-side (codegen), no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

NUM = C.NUM_PATTERN

# One anchored pattern for the listing text
# "[discount%][price원]name[rating(count)][좋아요]"; groups: discount, price,
# name, rating, count.  Anchoring the rating to "(count)" keeps digits inside
# the name intact.
LISTING_PATTERN = (r"^(?:(\d+)%)?\s*(?:(" + NUM + r")원)?\s*(.*?)\s*"
                   r"(?:(\d+\.\d+)\((" + NUM + r")\))?(?:좋아요)?$")


def parse_number(c: Column) -> Column:
    """'135,000' / '135,000원' -> 135000 (NULL when not a number)."""
    return F.regexp_replace(c, r"[,원\s]", "").try_cast("long")


def parse_listing(text: Column) -> Column:
    """F1-F7 in one pass: struct(discount INT, sale_price LONG, name STRING,
    rating STRING, review_count LONG).  The price next to '%' is the sale
    price (see ``list_price`` for the list price)."""
    g = lambda i: F.nullif(F.regexp_extract(text, LISTING_PATTERN, i), F.lit(""))
    return F.struct(g(1).try_cast("int").alias("discount"),
                    parse_number(g(2)).alias("sale_price"),
                    F.coalesce(g(3), F.lit("")).alias("name"),
                    g(4).alias("rating"),
                    parse_number(g(5)).alias("review_count"))


def sale_price(list_price: Column, discount: Column) -> Column:
    """floor(p * (100 - d) / 100); no discount -> same price."""
    d = F.coalesce(discount, F.lit(0))
    return F.floor((list_price * (F.lit(100) - d)) / F.lit(100)).cast("long")


def list_price(sale: Column, discount: Column) -> Column:
    """int(c * 100 / (100 - d)) with float division, truncated;
    d = 100 is left empty (NULL)."""
    return F.try_divide(sale * 100, (F.lit(100) - discount).cast("double")).cast("long")


# Name clean-up: ordered deletions (F7).  The trailing-number rule only fires
# after a decimal rating or before '(count)', so names ending in a number
# ('크림 50') keep it.
NAME_DELETIONS = [
    r"^\d+%",
    r"^" + NUM + "원",
    r"\d+\.\d+\(" + NUM + r"\)",
    r"\d+\.\d+(?=\s*$)",
    r"\(" + NUM + r"\)(?=(?:좋아요)?\s*$)",
    r"좋아요$",
]


def name_clean(name: Column, min_len: int = 0) -> Column:
    out = reduce(lambda acc, p: F.regexp_replace(acc, p, ""), NAME_DELETIONS, name)
    out = F.trim(out, F.lit(C.PY_WHITESPACE))
    if min_len:
        out = F.when(F.length(out) < min_len, F.lit("")).otherwise(out)
    return out


def price_band(price: Column) -> Column:
    """price band label; '' when the price is missing."""
    expr = F.when(price.isNull(), F.lit(""))
    for bound, label in zip(C.PRICE_BAND_BOUNDS, C.PRICE_BAND_LABELS):
        expr = expr.when(price < bound, F.lit(label))
    return expr.otherwise(F.lit(C.PRICE_BAND_LABELS[-1]))


def resolve_price(page_value: Column, name_value: Column, floor: int = 1000) -> Column:
    """the page value when non-empty, else the name value if > 1000."""
    return F.coalesce(parse_number(F.nullif(page_value, F.lit(""))),
                      F.when(name_value > floor, name_value))


def money_format(n: Column) -> Column:
    """135000 -> '135,000' (export edge only)."""
    return F.format_number(n, 0)
