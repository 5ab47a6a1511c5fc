"""Dictionaries, thresholds and schemas.

Everything in the FIXED VALUES block must equal the values the original
review tool uses, so that results match; they are listed plainly, in their
natural order.  Operators take these as parameters, so other dictionaries
(e.g. the English test sets below) plug in without code changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original tool's output)
# ---------------------------------------------------------------------------

# Summary keywords, in order (ties in the top-5 break by this order).
SUMMARY_KEYWORDS = [
    "촉촉", "보습", "수분", "건조", "지속력", "지속", "오래", "유분", "끈적", "부드러움",
    "향", "냄새", "향기", "각질", "입술", "립", "만족", "좋아", "추천", "별로", "아쉽", "불만",
]
POSITIVE_KEYWORDS = ["만족", "좋아", "추천", "촉촉", "보습"]
NEGATIVE_KEYWORDS = ["별로", "아쉽", "불만", "건조", "끈적"]

POLARITY_POSITIVE = "전반적으로 긍정적인 평가가 많습니다."
POLARITY_NEGATIVE = "일부 부정적인 평가가 있습니다."
POLARITY_SPLIT = "평가가 양분되어 있습니다."
SUMMARY_HEAD = "{name}에 대한 고객 후기를 분석한 결과, 총 {n}개의 후기가 수집되었습니다."
SUMMARY_KEYWORD_LABEL = "주요 언급 키워드: "
SUMMARY_NO_TEXTS = "후기 데이터가 없습니다."
SUMMARY_NO_REVIEWS = "후기가 없습니다."
KEYPOINT_POSITIVE = "긍정적 평가: "
KEYPOINT_NEGATIVE = "개선 필요: "
KEYPOINT_OPTION = "인기 옵션: {option} ({n}개 후기)"

# Skin types: main list and secondary list, as listed; matching tries them
# longest first, equal lengths in list order (see functions.users).
MAIN_SKIN_TYPES = ["지성", "건성", "수분부족지성", "수분부족", "복합성", "민감성", "중성", "수분"]
SECONDARY_SKIN_TYPES = ["트러블", "모공", "주름", "칙칙함", "건조함", "탄력없음", "수분부족", "민감성"]

# Note dictionary: label -> patterns, both in order.
NOTE_DICTIONARY = [
    ("지속력", ["지속", "오래", "오랫동안", "지속력"]),
    ("발색감", ["발색", "색상", "컬러", "톤"]),
    ("사용감", ["사용감", "발림", "밀착", "부드러움", "끈적"]),
    ("향", ["향", "냄새", "향기", "아로마"]),
    ("민감성", ["민감", "순함", "자극", "알레르기"]),
    ("보습감", ["보습", "촉촉", "수분", "건조"]),
    ("유분기", ["유분", "기름", "번들", "윤기"]),
    ("광택감", ["광택", "글로시", "윤기", "번들"]),
]

# Review-body keywords (fallback body choice).
BODY_KEYWORDS = ["지속력", "촉촉", "유분", "향", "각질", "입술", "립", "보습", "수분", "건조", "사용", "후기"]
USAGE_KEYWORDS = ["사용방법", "사용 방법", "사용법", "How to Use", "용법"]
PRECAUTION_KEYWORDS = ["주의사항", "주의 사항", "주의", "precaution", "경고", "사용시 주의사항"]
INGREDIENT_DT_KEYWORDS = ["성분", "화장품법", "ingredient", "성분명"]

# Price bands: upper bounds (exclusive) and labels.
PRICE_BAND_BOUNDS = [10000, 30000, 50000, 100000, 200000]
PRICE_BAND_LABELS = ["1만원 미만", "1-3만원", "3-5만원", "5-10만원", "10-20만원", "20만원 이상"]

# Thresholds.
NAME_PRICE_FLOOR = 1000  # a price in a name counts above this
CARD_MIN_CHARS = 20
BODY_MIN_CHARS = 10            # body must be longer than this
BODY_FALLBACK_BELOW = 20       # element body shorter than this -> fall back to lines
LINE_MIN_CHARS = 30            # candidate line longer than this ...
LINE_LONG_CHARS = 100          # ... and keyword-bearing or longer than this
NOTE_MAX_CHARS = 50
DEDUP_PREFIX_CHARS = 50
PHRASE_MAX_CHARS = 10
PHRASE_MIN_COUNT = 2
PHRASE_TOP = 5
PHRASE_SHOW = 3
KEYWORD_TOP = 5
PROMPT_MAX_TEXTS = 50
PROMPT_MAX_CHARS = 15000
ZERO_YIELD_STOP = 3
TEXT_CAP_CHARS = 1000
TEXT_MIN_CHARS = 10
INGREDIENT_CAP_CHARS = 2000
INGREDIENT_MIN_CHARS = 20

# Review-card patterns.
CARD_TAGS = ["div", "li", "article", "section", "tr"]
CARD_TEXT_TAGS = ["div", "li", "article"]
# tried in this order: the class CARD_CLASS itself, a class that holds it, the
# CARD_CLASS_PATTERNS (case-insensitive), a class with one of CARD_KEYWORDS, an
# attribute data-review, an id of CARD_ID_PATTERN, text of the fallback patterns
CARD_CLASS = "reviewCard"
CARD_CLASS_PATTERNS = ["reviewCard", "review.*item|item.*review", "review|comment|후기|리뷰"]
CARD_EXCLUDE_CLASS = "reviewArea"
CARD_FALLBACK_PATTERN = r"\w+\*+|\d+대|여성|남성|지성|건성|수분"
CARD_FALLBACK_HINT = r"지속력|촉촉|유분|향|각질"

# Page conventions of the shop (URL parameters, attributes, meta properties).
PRODUCT_CODE_PARAM = "onlineProdCode"
PRODUCT_SERIAL_PARAM = "onlineProdSn"
CATEGORY_PAGE_PARAM = "displayCategorySn"
BRAND_PAGE_PARAM = "brandSn"
PRODUCT_PATH = "/product/detail"
DATA_CODE_ATTRS = ["data-product-code", "data-code", "data-prod-code"]
META_CODE_PROPERTY = "product.*code|code"
META_CATEGORY_PROPERTY = "category"
SCRIPT_CODE_PATTERN = r"""onlineProdCode["']?\s*[:=]\s*["']?(\d+)"""

# Element class patterns (case-insensitive search in the class attribute).
CLASS_USER_TITLE = "profileCard__userTitle|userTitle"
CLASS_USER_FALLBACK = "user|name|nick|id"
CLASS_USER_DESC = "profileCard__userDesc|userDesc"
CLASS_USER_DESC_FALLBACK = "info|demographic|user-info"
CLASS_STAR_WRAP = "icoStarWrap|starWrap"
CLASS_STAR_ICON = "icoStar|star"
CLASS_RATING_ELEMENT = "rating|score|point"
CLASS_REVIEW_BODY = "txt|text|content"
CLASS_REVIEW_NOTES = "prdStyle"
CLASS_BREADCRUMB = "breadcrumb|category|nav"
LOGO_ALT_PATTERN = "로고|brand"
CLASS_DISCOUNT = "priceBox__rate|discountRate|discount.*rate"
CLASS_PRICE = "priceBox__price|currentPrice|salePrice"
CLASS_STRIKE = "strike|del|original|old"
STRUCK_CLASSES = ["original", "old", "strike"]
CLASS_SECTION = "dSection|section"
CLASS_PAGE_RATING = "star|rating|score"
CLASS_BRAND_NAME = "brand.*name|brand.*title"
CARD_ID_PATTERN = "review|comment|리뷰|후기"
CARD_KEYWORDS = ["review", "comment", "후기", "리뷰"]

# Text patterns.
NUM_PATTERN = r"\d{1,3}(?:,\d{3})*"
USERNAME_PATTERN = r"([a-zA-Z0-9]+\*+)"
USER_INFO_PATTERNS = [
    r"(\d+대[^\n]*여성|남성[^\n]*)",
    r"(\d+대[^\n]*지성|건성|수분[^\n]*)",
    r"(\d+대[^\n]*)",
    r"(여성|남성[^\n]*지성|건성[^\n]*)",
]
RATING_TEXT_PATTERN = r"(\d+)\s*점|평점[:\s]*(\d+)|(\d+)\s*/\s*5"
OPTION_PATTERNS = [r"(?i)옵션[:\s]*([^\n]+)", r"(?i)option[:\s]*([^\n]+)", r"(?i)선택[:\s]*([^\n]+)"]
SCRUB_PATTERNS = [r"(?s)신고내용.*?차단하기", r"작성자:.*?글내용:"]
REVIEW_TYPE_PATTERNS = [r"(?i)(\d+\s*[일개월주년]+?\s*사용\s*리뷰)", r"(?i)(한달|한\s*달|1개월)\s*사용",
                        r"(?i)사용\s*리뷰"]
PAGE_RATING_PATTERNS = [r"[★☆]\s*(\d+\.\d+)", r"평점[:\s]*(\d+\.\d+)", r"(\d+\.\d+)\s*점"]
REVIEW_COUNT_PATTERNS = [r"리뷰\s*(" + NUM_PATTERN + ")", r"후기\s*(" + NUM_PATTERN + ")",
                         r"\((" + NUM_PATTERN + r")\)"]
DECLARED_COUNT_PATTERNS = [r"(\d+)\s*개의?\s*상품", r"(\d+)\s*개의?\s*제품", r"상품.*?(\d+)\s*개",
                           r"제품.*?(\d+)\s*개"]
INGREDIENT_HEADING_WORDS = ["화장품법", "성분"]
INGREDIENT_TEXT_PATTERN = r"화장품법[^성]*성분[^\n]*\n([^\n]{50,})"
DISCOUNT_PRICE_TEXT_PATTERN = r"(\d+)%\s*(" + NUM_PATTERN + ")원"
LISTING_NAME_CUTS = [r"\s*로고.*", r"\s*브랜드관.*"]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Whitespace as Python's str.strip()/str.split() see it (derived from
# str.isspace), used so Spark trims and tokenises exactly like the original.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE) + "]"

# Default site base used to absolutise relative links (a parameter; any site).
DEFAULT_SITE_BASE = "https://shop.example.com"


@dataclass(frozen=True)
class Dictionaries:
    """Keyword sets used by the summary operators."""

    keywords: list = field(default_factory=lambda: list(SUMMARY_KEYWORDS))
    positive: list = field(default_factory=lambda: list(POSITIVE_KEYWORDS))
    negative: list = field(default_factory=lambda: list(NEGATIVE_KEYWORDS))


DEFAULT_DICTS = Dictionaries()

# English test dictionaries for the driver tables (frequent tokens).
TEST_POSITIVE = ["the", "and", "la", "un"]
TEST_NEGATIVE = ["of", "de", "der", "no"]
TEST_OTHERS = ["to", "in", "que", "en"]
TEST_DICTS = Dictionaries(keywords=TEST_POSITIVE + TEST_NEGATIVE + TEST_OTHERS,
                          positive=TEST_POSITIVE, negative=TEST_NEGATIVE)

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

PRODUCT_RAW_FIELDS = [
    "product_name", "product_code", "product_url", "category", "sub_category", "price",
    "current_price", "price_range", "discount_rate", "rating", "review_count",
    "usage_method", "ingredients", "precautions",
]
PRODUCT_RAW = T.StructType([T.StructField(c, T.StringType()) for c in PRODUCT_RAW_FIELDS])

REVIEW_RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ["username", "user_info", "age", "gender", "skin_type_1", "skin_type_2"]]
    + [T.StructField("rating", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in
       ["option", "review_type", "special_note_1", "special_note_2", "special_note_3",
        "review_text", "product_code", "product_name"]]
)

CATALOG_FILE = T.StructType([
    T.StructField("brand_url", T.StringType()),
    T.StructField("crawled_at", T.StringType()),
    T.StructField("total_products", T.IntegerType()),
    T.StructField("products", T.ArrayType(PRODUCT_RAW)),
])

REVIEW_FILE = T.StructType([
    T.StructField("brand_url", T.StringType()),
    T.StructField("crawled_at", T.StringType()),
    T.StructField("total_reviews", T.IntegerType()),
    T.StructField("reviews", T.ArrayType(REVIEW_RAW)),
])
