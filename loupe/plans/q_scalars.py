"""Scalar-function queries (F1-F28, E21, E22, P1, P2, S11, S13) over strings
synthesised from the driver tables inside the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import prices as PR_
from ..functions import reviews as RF
from ..functions import users as U
from ..functions.users import match_order
from ..operators import extract as E
from ..sources import catalog as CAT
from . import fixtures as X
from .registry import query

# ---------------------------------------------------------------- listing text

_LISTING_SRC_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name, p_size,
       5 + p_partkey % 4 * 5 AS d, 1000 * (1 + p_partkey % 300) AS price,
       CAST(1 + p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS rating,
       p_size * 1037 AS cnt, p_retailprice
FROM part"""

_LISTING_SQL = f"""WITH src AS ({_LISTING_SRC_SQL})"""


def _listing_src(spark, sf):
    p = X.table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.cast("string").alias("product_code"), "p_name", "p_size", "p_retailprice",
        (5 + k % 4 * 5).alias("d"), (1000 * (1 + k % 300)).alias("price"),
        F.concat((1 + F.col("p_size") % 4).cast("string"), F.lit("."),
                 (k % 10).cast("string")).alias("rating"),
        (F.col("p_size") * 1037).alias("cnt"))


def _listing_text(s):
    return s.withColumn("text", F.concat(
        F.col("d").cast("string"), F.lit("%"), PR_.money_format(F.col("price")), F.lit("원"),
        F.col("p_name"), F.lit(" "), F.col("rating"), F.lit("("), PR_.money_format(F.col("cnt")),
        F.lit(")좋아요")))


@query("listing_parse", oracle=_LISTING_SQL + """
SELECT product_code, CAST(d AS INTEGER) AS discount, CAST(price AS BIGINT) AS sale_price,
       CAST(trunc(price * 100.0 / (100 - d)) AS BIGINT) AS list_price, p_name AS name,
       rating, CAST(cnt AS BIGINT) AS review_count
FROM src
""")
def q_listing_parse(spark, sf):
    s = _listing_text(_listing_src(spark, sf))
    p = PR_.parse_listing(F.col("text"))
    return s.select("product_code", p["discount"].alias("discount"),
                    p["sale_price"].alias("sale_price"),
                    PR_.list_price(p["sale_price"], p["discount"]).alias("list_price"),
                    p["name"].alias("name"), p["rating"].alias("rating"),
                    p["review_count"].alias("review_count"))


@query("name_clean", oracle=_LISTING_SQL + "SELECT product_code, p_name AS name FROM src")
def q_name_clean(spark, sf):
    """F7, listing variant: deletions only, over the whole listing text."""
    s = _listing_text(_listing_src(spark, sf))
    return s.select("product_code", PR_.name_clean(F.col("text"), min_len=3).alias("name"))


@query("money_format", oracle=_LISTING_SQL + """
SELECT product_code, format('{:,}', price) AS price_text, format('{:,}', cnt) AS count_text FROM src
""")
def q_money_format(spark, sf):
    s = _listing_src(spark, sf)
    return s.select("product_code", PR_.money_format(F.col("price")).alias("price_text"),
                    PR_.money_format(F.col("cnt")).alias("count_text"))


@query("resolve_priority", oracle=_LISTING_SQL + """
SELECT product_code,
       COALESCE(CASE WHEN p_size > 10 THEN CAST(round(p_retailprice * 100) AS BIGINT) END,
                CASE WHEN price > 1000 THEN CAST(price AS BIGINT) END) AS price
FROM src
""")
def q_resolve_priority(spark, sf):
    """page price (empty for small sizes) wins over the price in the
    listing name, which counts only above 1,000."""
    s = _listing_text(_listing_src(spark, sf))
    page = F.when(F.col("p_size") > 10,
                  PR_.money_format(F.round(F.col("p_retailprice") * 100).cast("long"))) \
        .otherwise(F.lit(""))
    name_price = PR_.parse_listing(F.col("text"))["sale_price"]
    return s.select("product_code", PR_.resolve_price(page, name_price).alias("price"))


# ---------------------------------------------------------------- price arithmetic

_PRICES_SQL = """WITH src AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_size,
         1000 * (1 + p_partkey % 300) AS p,
         CASE WHEN p_size = 50 THEN 100 ELSE 5 + p_partkey % 4 * 5 END AS d
  FROM part)"""


def _prices(spark, sf):
    p = X.table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.cast("string").alias("product_code"), "p_size",
                    (1000 * (1 + k % 300)).alias("p"),
                    F.when(F.col("p_size") == 50, F.lit(100)).otherwise(5 + k % 4 * 5).alias("d"))


@query("sale_price", oracle=_PRICES_SQL + """
SELECT product_code, CAST(p AS BIGINT) AS list_price, d AS discount,
       CAST(p * (100 - d) // 100 AS BIGINT) AS sale_price FROM src
""")
def q_sale_price(spark, sf):
    s = _prices(spark, sf)
    return s.select("product_code", F.col("p").cast("long").alias("list_price"),
                    F.col("d").alias("discount"),
                    PR_.sale_price(F.col("p"), F.col("d")).alias("sale_price"))


@query("list_price", oracle=_PRICES_SQL + """
SELECT product_code, CAST(p AS BIGINT) AS sale, d AS discount,
       CASE WHEN d = 100 THEN NULL ELSE CAST(trunc(p * 100.0 / (100 - d)) AS BIGINT) END AS list_price
FROM src
""")
def q_list_price(spark, sf):
    s = _prices(spark, sf)
    return s.select("product_code", F.col("p").cast("long").alias("sale"),
                    F.col("d").alias("discount"),
                    PR_.list_price(F.col("p"), F.col("d")).alias("list_price"))


def _band_sql() -> str:
    parts = " ".join(f"WHEN p < {b} THEN '{lab}'" for b, lab in
                     zip(C.PRICE_BAND_BOUNDS, C.PRICE_BAND_LABELS))
    return _PRICES_SQL + f"""
SELECT product_code, CASE WHEN p_size = 1 THEN '' {parts.replace('WHEN p', 'WHEN p')}
       ELSE '{C.PRICE_BAND_LABELS[-1]}' END AS price_range
FROM src"""


@query("price_band", oracle=_band_sql())
def q_price_band(spark, sf):
    s = _prices(spark, sf)
    price = F.when(F.col("p_size") != 1, F.col("p"))
    return s.select("product_code", PR_.price_band(price).alias("price_range"))


# ---------------------------------------------------------------- user info

def _user_src(spark, sf, sep):
    c = X.table(spark, sf, "customer")
    k = F.col("c_custkey")
    main = F.array(*[F.lit(x) for x in C.MAIN_SKIN_TYPES])
    sec = F.array(*[F.lit(x) for x in C.SECONDARY_SKIN_TYPES])
    gender = F.when(k % 2 == 0, F.lit("여성")).otherwise(F.lit("남성"))
    s1 = F.element_at(main, (k % 8 + 1).cast("int"))
    s2 = F.element_at(sec, ((k / 8).cast("long") % 8 + 1).cast("int"))
    age = F.concat((10 * (1 + k % 5)).cast("string"), F.lit("대"))
    return c.select(k.alias("c_custkey"),
                    F.concat_ws(sep, age, gender, s1, s2).alias("u"))


def _user_sql(sep: str) -> str:
    main = ", ".join(f"'{x}'" for x in C.MAIN_SKIN_TYPES)
    sec = ", ".join(f"'{x}'" for x in C.SECONDARY_SKIN_TYPES)
    return f"""WITH src AS (
  SELECT c_custkey,
         CAST(10 * (1 + c_custkey % 5) AS VARCHAR) || '대' AS age,
         CASE WHEN c_custkey % 2 = 0 THEN '여성' ELSE '남성' END AS gender,
         [{main}][c_custkey % 8 + 1] AS s1,
         [{sec}][(c_custkey // 8) % 8 + 1] AS s2
  FROM customer),
u AS (SELECT *, concat_ws('{sep}', age, gender, s1, s2) AS u FROM src)"""


@query("user_info_split", oracle=_user_sql("/") + """
SELECT c_custkey, age, gender, s1 AS skin_type_1, s2 AS skin_type_2 FROM u
""")
def q_user_info_split(spark, sf):
    s = _user_src(spark, sf, "/")
    p = U.parse_user_info(F.col("u"))
    return s.select("c_custkey", p["age"].alias("age"), p["gender"].alias("gender"),
                    p["skin_type_1"].alias("skin_type_1"), p["skin_type_2"].alias("skin_type_2"))


def _dict_sql() -> str:
    m = " ".join(f"WHEN contains(u, '{x}') THEN '{x}'" for x in match_order(C.MAIN_SKIN_TYPES))
    s2 = " ".join(f"WHEN contains(u, '{x}') AND skin_type_1 <> '{x}' THEN '{x}'"
                  for x in match_order(C.SECONDARY_SKIN_TYPES))
    return _user_sql("") + f""",
p AS (SELECT c_custkey, u, age, gender, CASE {m} ELSE '' END AS skin_type_1 FROM u)
SELECT c_custkey, age, gender, skin_type_1, CASE {s2} ELSE '' END AS skin_type_2 FROM p
"""


@query("user_info_dict", oracle=_dict_sql())
def q_user_info_dict(spark, sf):
    s = _user_src(spark, sf, "")
    p = U.parse_user_info(F.col("u"))
    return s.select("c_custkey", p["age"].alias("age"), p["gender"].alias("gender"),
                    p["skin_type_1"].alias("skin_type_1"), p["skin_type_2"].alias("skin_type_2"))


def _card_text(s):
    return s.withColumn("t", F.concat(
        F.lit("리뷰어 u"), F.col("c_custkey").cast("string"), F.lit("*** 님\n"), F.col("u"),
        F.lit("\n본문 내용입니다")))


@query("username_parse", oracle=_user_sql("/") + """
SELECT c_custkey, 'u' || CAST(c_custkey AS VARCHAR) || '***' AS username FROM u
""")
def q_username_parse(spark, sf):
    s = _card_text(_user_src(spark, sf, "/"))
    return s.select("c_custkey", U.username_from_text(F.col("t")).alias("username"))


def _raw_sql() -> str:
    pats = U.USER_INFO_PATTERNS
    whens = " ".join(
        f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(regexp_extract(t, '{p}', 1), "
        f"'^\\s+|\\s+$', '', 'g')" for p in pats)
    return _user_sql("/") + f""",
c AS (SELECT c_custkey, '리뷰어 u' || CAST(c_custkey AS VARCHAR) || '*** 님' || chr(10) || u
             || chr(10) || '본문 내용입니다' AS t FROM u)
SELECT c_custkey, CASE {whens} END AS user_info FROM c
"""


@query("user_info_raw", oracle=_raw_sql())
def q_user_info_raw(spark, sf):
    s = _card_text(_user_src(spark, sf, "/"))
    return s.select("c_custkey", U.user_info_raw(F.col("t")).alias("user_info"))


# ---------------------------------------------------------------- review text fields on documents

_NL = "chr(10)"


def _docs(spark, sf):
    return X.table(spark, sf, "documents")


@query("rating_cascade", oracle=f"""WITH src AS (
  SELECT doc_id,
         CASE WHEN doc_id % 5 = 0 THEN 'icoStarWrap star' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END
           AS cls,
         CASE WHEN doc_id % 5 = 1 THEN doc_id % 3 ELSE 0 END AS icons,
         text || {_NL} || CASE doc_id % 4 WHEN 0 THEN '평점: ' || CAST(doc_id % 6 AS VARCHAR)
                              WHEN 1 THEN CAST(doc_id % 6 AS VARCHAR) || '점'
                              WHEN 2 THEN CAST(doc_id % 6 AS VARCHAR) || ' / 5' ELSE '' END AS t
  FROM documents),
x AS (SELECT doc_id, cls, icons, t,
             CAST(NULLIF(regexp_extract(cls, 'star(\\d+)', 1), '') AS INTEGER) AS c1,
             CAST(COALESCE(NULLIF(regexp_extract(t, '{RF.RATING_TEXT_PATTERN}', 1), ''),
                           NULLIF(regexp_extract(t, '{RF.RATING_TEXT_PATTERN}', 2), ''),
                           NULLIF(regexp_extract(t, '{RF.RATING_TEXT_PATTERN}', 3), ''))
                  AS INTEGER) AS c3
      FROM src)
SELECT doc_id, CAST(COALESCE(CASE WHEN c1 > 0 THEN c1 END, CASE WHEN icons > 0 THEN icons END,
                        CASE WHEN c3 > 0 THEN c3 END) AS INTEGER) AS rating
FROM x
""")
def q_rating_cascade(spark, sf):
    d = _docs(spark, sf)
    k = F.col("doc_id")
    six = (k % 6).cast("string")
    t = F.concat("text", F.lit("\n"),
                 F.when(k % 4 == 0, F.concat(F.lit("평점: "), six))
                  .when(k % 4 == 1, F.concat(six, F.lit("점")))
                  .when(k % 4 == 2, F.concat(six, F.lit(" / 5"))).otherwise(F.lit("")))
    cls = F.when(k % 5 == 0, F.concat(F.lit("icoStarWrap star"), (k % 7).cast("string"))) \
        .otherwise(F.lit(""))
    icons = F.when(k % 5 == 1, k % 3).otherwise(F.lit(0)).cast("int")
    return d.select("doc_id", RF.rating_cascade(cls, icons, t, F.lit(None).cast("string"))
                    .alias("rating"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _first_pattern_sql(t: str, pats: list, group: int) -> str:
    whens = []
    for p in pats:
        ext = "regexp_extract(" + t + ", '" + p + "', " + str(group) + ")"
        whens.append(f"WHEN regexp_matches({t}, '{p}') THEN {_strip_sql(ext)}")
    return "CASE " + " ".join(whens) + " ELSE '' END"


@query("option_parse", oracle=f"""WITH src AS (
  SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN {_NL} || '옵션: ' || lang
                             WHEN 1 THEN {_NL} || '선택 ' || source ELSE '' END AS t
  FROM documents)
SELECT doc_id, {_first_pattern_sql('t', RF.OPTION_PATTERNS, 1)} AS option FROM src
""")
def q_option_parse(spark, sf):
    d = _docs(spark, sf)
    k = F.col("doc_id")
    t = F.concat("text", F.when(k % 3 == 0, F.concat(F.lit("\n옵션: "), "lang"))
                 .when(k % 3 == 1, F.concat(F.lit("\n선택 "), "source")).otherwise(F.lit("")))
    return d.select("doc_id", RF.option_parse(t).alias("option"))


@query("review_type_parse", oracle=f"""WITH src AS (
  SELECT doc_id, text || CASE doc_id % 4
      WHEN 0 THEN {_NL} || CAST(doc_id % 12 + 1 AS VARCHAR) || '개월 사용 리뷰'
      WHEN 1 THEN {_NL} || '한 달 사용' WHEN 2 THEN {_NL} || '사용 리뷰' ELSE '' END AS t
  FROM documents)
SELECT doc_id, {_first_pattern_sql('t', RF.REVIEW_TYPE_PATTERNS, 0)} AS review_type FROM src
""")
def q_review_type_parse(spark, sf):
    d = _docs(spark, sf)
    k = F.col("doc_id")
    t = F.concat("text", F.when(k % 4 == 0, F.concat(F.lit("\n"), (k % 12 + 1).cast("string"),
                                                     F.lit("개월 사용 리뷰")))
                 .when(k % 4 == 1, F.lit("\n한 달 사용")).when(k % 4 == 2, F.lit("\n사용 리뷰"))
                 .otherwise(F.lit("")))
    return d.select("doc_id", RF.review_type(t).alias("review_type"))


@query("scrub", oracle=f"""WITH src AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '작성자: 익명 글내용:' ELSE '' END || text
         || CASE WHEN doc_id % 3 = 0 THEN ' 신고내용 스팸' || {_NL} || '광고 차단하기 끝' ELSE '' END AS t
  FROM documents)
SELECT doc_id, {_strip_sql("regexp_replace(regexp_replace(t, '(?s)신고내용.*?차단하기', '', 'g'), "
                           "'작성자:.*?글내용:', '', 'g')")} AS body
FROM src
""")
def q_scrub(spark, sf):
    d = _docs(spark, sf)
    k = F.col("doc_id")
    t = F.concat(F.when(k % 2 == 0, F.lit("작성자: 익명 글내용:")).otherwise(F.lit("")), "text",
                 F.when(k % 3 == 0, F.lit(" 신고내용 스팸\n광고 차단하기 끝")).otherwise(F.lit("")))
    return d.select("doc_id", RF.scrub(t).alias("body"))


_LINES_SQL = f"""list_filter(list_transform(string_split(text, {_NL}),
                               lambda x: {_strip_sql('x')}), lambda x: x <> '')"""


def _kw_any_sql(x: str, kws: list) -> str:
    return "(" + " OR ".join(f"contains({x}, '{k}')" for k in kws) + ")"


@query("longest_line", oracle=f"""WITH src AS (SELECT doc_id, {_LINES_SQL} AS lines FROM documents),
ln AS (SELECT doc_id, lines[i] AS l, i FROM src, unnest(range(1, len(lines) + 1)) r(i)),
cand AS (SELECT doc_id, arg_max(l, (length(l), -i)) AS best FROM ln
         WHERE length(l) > 30 AND ({_kw_any_sql('l', C.TEST_POSITIVE)} OR length(l) > 100)
         GROUP BY 1),
anyl AS (SELECT doc_id, arg_max(l, (length(l), -i)) AS best FROM ln GROUP BY 1)
SELECT a.doc_id, COALESCE({_strip_sql("regexp_replace(c.best, '(?s)신고내용.*?차단하기', '', 'g')")},
                          a.best) AS body
FROM anyl a LEFT JOIN cand c ON a.doc_id = c.doc_id
""")
def q_longest_line(spark, sf):
    d = _docs(spark, sf)
    lines = RF.text_lines(F.col("text"))
    return (d.select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
            .select("doc_id", RF.longest_line(F.col("lines"), C.TEST_POSITIVE).alias("body")))


@query("text_lines", oracle=f"""SELECT doc_id, CAST(len({_LINES_SQL}) AS INTEGER) AS n_lines,
       array_to_string({_LINES_SQL}, {_NL}) AS card_text FROM documents
""")
def q_text_lines(spark, sf):
    d = _docs(spark, sf)
    lines = RF.text_lines(F.col("text"))
    return d.select("doc_id", F.size(lines).alias("n_lines"),
                    F.array_join(lines, "\n").alias("card_text"))


_VALID_SQL = f"""WITH src AS (SELECT doc_id, {_LINES_SQL} AS lines FROM documents),
ln AS (SELECT doc_id, lines[i] AS l, i FROM src, unnest(range(1, len(lines) + 1)) r(i)),
cand AS (SELECT doc_id, arg_max(l, (length(l), -i)) AS best FROM ln
         WHERE length(l) > 30 AND ({_kw_any_sql('l', C.TEST_POSITIVE)} OR length(l) > 100)
         GROUP BY 1),
anyl AS (SELECT doc_id, arg_max(l, (length(l), -i)) AS best FROM ln GROUP BY 1),
v AS (SELECT s.doc_id, length(array_to_string(s.lines, {_NL})) AS card_len,
             length(COALESCE(c.best, a.best, '')) AS body_len
      FROM src s LEFT JOIN anyl a ON a.doc_id = s.doc_id LEFT JOIN cand c ON c.doc_id = s.doc_id)
"""


def _validity(spark, sf):
    d = _docs(spark, sf)
    lines = RF.text_lines(F.col("text"))
    x = d.select("doc_id", lines.alias("lines"))
    card = F.array_join("lines", "\n")
    body = RF.review_body(F.lit(None).cast("string"), F.col("lines"), C.TEST_POSITIVE)
    return x.select("doc_id", F.length(card).alias("card_len"), card.alias("card"),
                    F.length(body).cast("long").alias("body_len"))


@query("review_valid", oracle=_VALID_SQL + """
SELECT doc_id, body_len FROM v WHERE card_len >= 20 AND body_len > 10
""")
def q_review_valid(spark, sf):
    v = _validity(spark, sf)
    return (v.filter(RF.card_ok(F.col("card")) & (F.col("body_len") > C.BODY_MIN_CHARS))
            .select("doc_id", "body_len"))


@query("quarantine", oracle=_VALID_SQL + """
SELECT doc_id, CASE WHEN card_len < 20 THEN 'short card' ELSE 'short body' END AS reason,
       CAST(least(card_len, 1000) AS INTEGER) AS sample_len
FROM v WHERE NOT (card_len >= 20 AND body_len > 10)
""")
def q_quarantine(spark, sf):
    """S11 + P2 complement: rejected cards with a reason and a 1,000-char
    sample of their text."""
    v = _validity(spark, sf)
    ok = RF.card_ok(F.col("card")) & (F.col("body_len") > C.BODY_MIN_CHARS)
    return v.filter(~ok).select(
        "doc_id", F.when(~RF.card_ok(F.col("card")), "short card").otherwise("short body")
        .alias("reason"), F.length(F.substring("card", 1, 1000)).alias("sample_len"))


def _sql_word(p: str) -> str:
    # Python's Unicode \w as RE2 classes
    return p.replace(r"\w", r"[\pL\pN_]")


@query("card_text_filter", oracle=f"""
SELECT doc_id FROM documents
WHERE regexp_matches(text, '{_sql_word(C.CARD_FALLBACK_PATTERN)}') AND length(text) > 50
  AND (regexp_matches(text, '{C.CARD_FALLBACK_HINT}') OR length(text) > 100)
""")
def q_card_text_filter(spark, sf):
    """The text-pattern fallback for review cards."""
    d = _docs(spark, sf)
    t = F.col("text")
    return d.filter(E.card_text("text")).select("doc_id")


@query("text_caps", oracle=f"""WITH src AS (
  SELECT doc_id, text, '1. Ingredients ' || text AS ing FROM documents),
x AS (SELECT doc_id, substr({_strip_sql('text')}, 1, 1000) AS u,
             regexp_replace(ing, '^\\d+\\.\\s*[\\pL\\pN_]+', '') AS i FROM src)
SELECT doc_id, CASE WHEN length(u) < 10 THEN '' ELSE u END AS usage_method,
       CASE WHEN length(i) < 20 THEN '' ELSE {_strip_sql('substr(i, 1, 2000)')} END AS ingredients
FROM x
""")
def q_text_caps(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", RF.text_cap(F.col("text")).alias("usage_method"),
                    RF.ingredients_cap(F.concat(F.lit("1. Ingredients "), "text"))
                    .alias("ingredients"))


@query("notes_pairs", oracle="""WITH src AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code,
         ['brand', 'type', 'size', 'name'][1:(p_size % 5)] AS dt,
         [p_brand, p_type, CAST(p_size AS VARCHAR)][1:(p_size % 4)] AS dd
  FROM part)
SELECT product_code,
       array_to_string(list_transform(range(1, least(len(dt), len(dd), 3) + 1),
                                      lambda i: dt[i] || ': ' || dd[i]), ' | ') AS notes
FROM src
""")
def q_notes_pairs(spark, sf):
    p = X.table(spark, sf, "part")
    s = F.col("p_size")
    dt = F.slice(F.array(*[F.lit(x) for x in ("brand", "type", "size", "name")]), 1, s % 5)
    dd = F.slice(F.array("p_brand", "p_type", s.cast("string")), 1, s % 4)
    return p.select(F.col("p_partkey").cast("string").alias("product_code"),
                    F.array_join(RF.notes_from_pairs(dt, dd), " | ").alias("notes"))


# English test dictionary for notes (label -> patterns, in order)
TEST_NOTE_DICTIONARY = [("A", ["the", "and"]), ("B", ["de", "la"]), ("C", ["der", "und"]),
                        ("D", ["que", "el"])]


def _notes_dict_sql() -> str:
    """Per label the notes of its patterns; each label takes its first that no
    earlier one took."""
    cands, picks = [], []
    for i, (label, pats) in enumerate(TEST_NOTE_DICTIONARY):
        found = []
        for p in pats:
            ext = _strip_sql("regexp_extract(text, '(?i)" + p + "[^\\n]*', 0)")
            found.append(f"CASE WHEN contains(text, '{p}') THEN NULLIF(substr({ext}, 1, 50), '') END")
        cands.append(f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS c{i}")
    prev = "c"
    steps = f"WITH c AS (SELECT doc_id, {', '.join(cands)} FROM documents)"
    for i, (label, _) in enumerate(TEST_NOTE_DICTIONARY):
        taken = "[" + ", ".join(f"n{j}" for j in range(i)) + "]::VARCHAR[]"
        steps += f", s{i} AS (SELECT *, list_filter(c{i}, lambda x: NOT list_contains({taken}, x))[1] AS n{i} FROM {prev})"
        prev = f"s{i}"
        picks.append(f"'{label}: ' || n{i}")
    return steps + f" SELECT doc_id, array_to_string((list_filter([{', '.join(picks)}], lambda x: x IS NOT NULL))[1:3], ' | ') AS notes FROM {prev}"


@query("notes_dict", oracle=_notes_dict_sql())
def q_notes_dict(spark, sf):
    d = _docs(spark, sf)
    n = RF.notes_from_dictionary("text", "text", TEST_NOTE_DICTIONARY)
    return d.select("doc_id", F.array_join(n, " | ").alias("notes"))


@query("json_roundtrip", oracle="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS first_tag,
       2 AS n_tags
FROM events
""")
def q_json_roundtrip(spark, sf):
    """JSON text to and from typed values; invalid text -> NULL."""
    e = X.table(spark, sf, "events")
    tags = F.from_json(F.to_json(F.array("event_type", F.col("user_id").cast("string"))),
                       "array<string>")
    return e.select("event_id",
                    F.from_json("props", "struct<k:bigint>")["k"].alias("k"),
                    F.element_at(tags, 1).alias("first_tag"), F.size(tags).alias("n_tags"))


@query("output_name", oracle="""
SELECT event_id,
       COALESCE(NULLIF(string_split('reviews_' || COALESCE(event_type, ''), '_')[-1], ''),
                'brand_' || strftime(ts, '%Y%m%d')) AS base_name
FROM events
""")
def q_output_name(spark, sf):
    """Base name = last '_' token of the given output name, else
    'brand_YYYYMMDD' from the run time."""
    e = X.table(spark, sf, "events")
    given = F.concat(F.lit("reviews_"), F.coalesce("event_type", F.lit("")))
    return e.select("event_id", CAT.output_base_name(given, F.lit(""), F.col("ts")).alias("base_name"))
