"""Reviewer-profile scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Profile text patterns, tried in order (fixed values in config).
USER_INFO_PATTERNS = C.USER_INFO_PATTERNS
USERNAME_PATTERN = C.USERNAME_PATTERN


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(C.PY_WHITESPACE))


def username_from_text(text: Column) -> Column:
    """F15 fallback: first masked user name like 'abcd****'."""
    return F.nullif(F.regexp_extract(text, USERNAME_PATTERN, 1), F.lit(""))


def user_info_raw(text: Column) -> Column:
    """F16 fallback: first pattern that matches, group 1, stripped."""
    return _strip(F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
                               for p in USER_INFO_PATTERNS]))


def _gender(part: Column) -> Column:
    return (F.when(part.contains("여"), F.lit("여성"))
             .when(part.contains("남"), F.lit("남성")).otherwise(F.lit("")))


def match_order(words: list) -> list:
    """Longest first; equal lengths keep list order (stable)."""
    return sorted(words, key=len, reverse=True)


def _first_hit(u: Column, words: list, exclude: Column | None = None) -> Column:
    expr = None
    for w in match_order(words):
        cond = u.contains(w)
        if exclude is not None:
            cond = cond & (exclude != F.lit(w))
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(""))


def parse_user_info(u: Column) -> Column:
    """struct(age, gender, skin_type_1, skin_type_2).

    '/' form: trimmed non-empty parts -> [0] '\\d+대', [1] gender,
    [2] skin 1, [3] skin 2.  Run-together form: age '\\d+대( 이상)?',
    gender by containment, skin 1 = first main type in match order,
    skin 2 = first secondary type in match order that differs from skin 1.
    """
    u = F.coalesce(u, F.lit(""))
    parts = F.filter(F.transform(F.split(u, "/"), lambda p: _strip(p)), lambda p: p != "")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    slash = F.struct(
        F.regexp_extract(part(1), r"(\d+대)", 1).alias("age"),
        _gender(part(2)).alias("gender"),
        part(3).alias("skin_type_1"),
        part(4).alias("skin_type_2"))
    skin1 = _first_hit(u, C.MAIN_SKIN_TYPES)
    plain = F.struct(
        _strip(F.regexp_extract(u, r"(\d+대(?:\s*이상)?)", 1)).alias("age"),
        _gender(u).alias("gender"),
        skin1.alias("skin_type_1"),
        _first_hit(u, C.SECONDARY_SKIN_TYPES, exclude=skin1).alias("skin_type_2"))
    empty = F.struct(*[F.lit("").alias(n) for n in
                       ("age", "gender", "skin_type_1", "skin_type_2")])
    return F.when(u == "", empty).when(u.contains("/"), slash).otherwise(plain)
