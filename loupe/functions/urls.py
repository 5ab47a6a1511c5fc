"""URL scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def query_value(url: Column, name: str) -> Column:
    """Text after the first ``name=`` up to '&' ('' when present but empty,
    NULL when absent).  A '#fragment' is kept, as the original does;
    ``try_parse_url(url, 'QUERY', name)`` would strip it."""
    return F.when(url.contains(f"{name}="),
                  F.regexp_extract(url, f"\\Q{name}=\\E([^&]*)", 1))


def url_code(url: Column, code_param: str = C.PRODUCT_CODE_PARAM,
             serial_param: str = C.PRODUCT_SERIAL_PARAM) -> Column:
    """F8: code parameter, else the serial parameter."""
    return F.coalesce(query_value(url, code_param), query_value(url, serial_param))


def url_serial(url: Column, serial_param: str = C.PRODUCT_SERIAL_PARAM) -> Column:
    """digits of the serial parameter."""
    return F.nullif(F.regexp_extract(url, f"\\Q{serial_param}=\\E(\\d+)", 1), F.lit(""))


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def code_cascade(url: Column, meta_code: Column, data_code: Column, script_code: Column,
                 code_param: str = C.PRODUCT_CODE_PARAM,
                 serial_param: str = C.PRODUCT_SERIAL_PARAM) -> Column:
    """URL code -> meta -> data attribute -> script variable -> URL
    serial; first non-empty wins."""
    return first_nonempty(query_value(url, code_param), meta_code, data_code, script_code,
                          url_serial(url, serial_param))
