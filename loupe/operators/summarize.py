"""Per-product review summaries (rating statistics, keywords, phrases,
options, template text, key points, prompt batches).

All operators are grouped aggregates keyed by product; every one partially
aggregates before its shuffle, so a best-seller holding a third of all
reviews is combined map-side instead of landing in one task.  Top-k cuts use
``row_number() <= k`` over already-aggregated rows, which Catalyst plans as
``WindowGroupLimit`` on both sides of the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def _rating0(rating: str) -> Column:
    return F.coalesce(F.col(rating), F.lit(0))


def rating_band(rating: str = "rating") -> Column:
    """>=4 high, <=2 low (null counts as 0, so low), else mid."""
    r = _rating0(rating)
    return F.when(r >= 4, "high").when(r <= 2, "low").otherwise("mid")


def rating_stats(reviews: DataFrame, *, key: str = "product_code",
                 rating: str = "rating") -> DataFrame:
    """A1-A4: totals, rated sum/count, positives, negatives (null rating is
    negative but left out of the average), plus the unrated count."""
    r = F.col(rating)
    return (reviews.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum(F.when(r > 0, r)).cast("long").alias("sum_rating"),
        F.count(F.when(r > 0, r)).alias("n_rated"),
        F.count(F.when(_rating0(rating) >= 4, 1)).alias("positive_count"),
        F.count(F.when(_rating0(rating) <= 2, 1)).alias("negative_count"),
        F.count(F.when(r.isNull(), 1)).alias("unrated_count"),
    ))


def average_rating(sum_col: str = "sum_rating", n_col: str = "n_rated") -> Column:
    """Rounded mean of rated reviews, 0 when none; half-even like the binary
    rounding of the original on exact ties."""
    return F.bround(F.coalesce(F.try_divide(F.col(sum_col), F.col(n_col)), F.lit(0.0)), 2)


def keyword_count(text: Column, kw: str) -> Column:
    """Non-overlapping occurrences of a literal, as str.count does."""
    return F.coalesce(
        ((F.length(text) - F.length(F.replace(text, F.lit(kw), F.lit("")))) / F.lit(len(kw)))
        .cast("long"), F.lit(0))


def keyword_counts(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
                   keywords: list | None = None) -> DataFrame:
    """A5: per-product count of every keyword, one pass (one column each).
    Row-wise sums equal counts over the space-joined text because no keyword
    contains a space; so the sum partially aggregates."""
    kws = keywords or C.SUMMARY_KEYWORDS
    t = F.col(text)
    return (reviews.filter(t.isNotNull() & (t != ""))
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_texts"),
                 *[F.sum(keyword_count(t, k)).alias(f"kw_{i}") for i, k in enumerate(kws)]))


#: White space that ends a word: no keyword without it goes past it.
GAPS = r"[\x20\x09-\x0D]+"


def _overlaps_itself(keyword: Column) -> Column:
    """Whether two occurrences can overlap: some end of it is its beginning."""
    n = F.length(keyword)
    starts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.substr(keyword, F.lit(1), i) == F.substr(keyword, n - i + 1, i))


def dictionary_counts(reviews: DataFrame, dictionary: DataFrame, *, key: str = "product_code", text: str = "review_text",
                      pos: str = "pos", keyword: str = "keyword") -> DataFrame:
    """A5 / U2 with the dictionary as a table of any size: (key, keyword, n)
    of every keyword that occurs, counted like str.count does: each keyword
    alone, and where one can overlap itself, from left to right.  A keyword
    without white space lies within one word, so each word is looked through
    once, however often it stands in the texts; only keywords with white space
    are looked for in whole texts.  ``pos`` tells the rows apart."""
    words = dictionary.select(F.col(keyword).alias("_kw")).filter("_kw <> ''").distinct()
    spaced = F.col("_kw").rlike(GAPS)
    rows = reviews.filter(F.coalesce(F.col(text), F.lit("")) != "").select(
        F.col(key).alias("_key"), F.col(pos).alias("_row"), F.col(text).alias("_text"))
    tokens = rows.select("_key", F.explode(F.split("_text", GAPS)).alias("_token")).filter("_token <> ''") \
        .groupBy("_key", "_token").agg(F.count(F.lit(1)).alias("_often"))
    inside = _occurrences(tokens.select(F.col("_token").alias("_text")).distinct().withColumn("_row", F.col("_text")), ["_row"], words.filter(~spaced))
    near = tokens.join(inside.withColumnRenamed("_row", "_token"), "_token").select("_key", "_kw", (F.col("n") * F.col("_often")).alias("n"))
    across = _occurrences(rows, ["_key", "_row"], words.filter(spaced))
    both = near.unionByName(across.select("_key", "_kw", "n"))
    return both.groupBy("_key", "_kw").agg(F.sum("n").alias("n")).select(F.col("_key").alias(key), F.col("_kw").alias(keyword), "n")


def _occurrences(rows: DataFrame, keys: list[str], words: DataFrame) -> DataFrame:
    """(keys, _kw, n): how often each of ``words`` stands in each ``_text``.
    A text gives its windows of the keywords' lengths once, whatever the number
    of keywords; a join finds those that are keywords."""
    lengths = words.agg(F.collect_set(F.length("_kw")).alias("_l")).scalar()  # as many as lengths differ
    words = words.withColumn("_folds", _overlaps_itself(F.col("_kw")))
    cut = rows.withColumn("_n", F.explode(lengths)).filter(F.length("_text") >= F.col("_n")).select(*keys, "_n", F.split("_text", "").alias("_chars"))
    windows = F.transform(F.sequence(F.lit(1), F.size("_chars") - F.col("_n") + 1),
                          lambda i: F.array_join(F.slice("_chars", i, F.col("_n")), ""))
    found = cut.select(*keys, "_n", F.posexplode(windows).alias("_at", "_w")).join(words, F.col("_w") == F.col("_kw"))
    alone = found.filter(~F.col("_folds")).groupBy(*keys, "_kw").agg(F.count(F.lit(1)).alias("n"))
    # places of one keyword in one text, at most the text's length
    folded = found.filter("_folds").groupBy(*keys, "_kw", "_n").agg(F.array_sort(F.collect_list("_at")).alias("_places"))
    free = lambda acc, at: F.when(at >= acc["end"], F.struct((at + F.col("_n")).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    count = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), free, lambda acc: acc["n"])
    return alone.unionByName(folded.select(*keys, "_kw", count.alias("n")))


def keyword_long(counts: DataFrame, *, key: str = "product_code",
                 keywords: list | None = None) -> DataFrame:
    """Wide keyword counts -> (key, keyword, kw_pos, n)."""
    kws = keywords or C.SUMMARY_KEYWORDS
    entries = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(i).alias("kw_pos"),
                                 F.col(f"kw_{i}").alias("n")) for i, k in enumerate(kws)])
    return counts.select(key, F.inline(entries))


def keyword_top(counts: DataFrame, *, key: str = "product_code", keywords: list | None = None,
                k: int = C.KEYWORD_TOP) -> DataFrame:
    """Top-k keywords by count, ties by dictionary order; zero counts are
    removed after the cut."""
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("kw_pos"))
    return (keyword_long(counts, key=key, keywords=keywords)
            .withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= k) & (F.col("n") > 0)))


def keyword_polarity(counts: DataFrame, *, key: str = "product_code",
                     dicts: C.Dictionaries = C.DEFAULT_DICTS) -> DataFrame:
    """Positive vs negative keyword mass -> positive / negative / split."""
    idx = {k: i for i, k in enumerate(dicts.keywords)}
    pos = sum((F.col(f"kw_{idx[k]}") for k in dicts.positive), F.lit(0))
    neg = sum((F.col(f"kw_{idx[k]}") for k in dicts.negative), F.lit(0))
    return counts.select(
        key, pos.cast("long").alias("pos_mentions"), neg.cast("long").alias("neg_mentions"),
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("split")
         .alias("polarity"))


def _tokens(text: Column) -> Column:
    """Whitespace tokens, like str.split() (no empty tokens)."""
    # every whitespace character -> ' ' (per-character translate, no regex),
    # then a single-character split and empty tokens dropped
    spaced = F.translate(F.coalesce(text, F.lit("")), C.PY_WHITESPACE,
                         " " * len(C.PY_WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def bigrams(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
            pos: str = "pos", group_extra: list | None = None,
            max_chars: int = C.PHRASE_MAX_CHARS) -> DataFrame:
    """Adjacent token pairs within a review whose joined length (with the
    space) is at most ``max_chars``; counted per product, with the first
    appearance (review position, token index) for stable tie-breaks."""
    keys = [key] + list(group_extra or [])
    # Tokens are materialised as a column first; the pair lambda then indexes
    # into it (re-deriving the split inside the lambda would be quadratic).
    base = reviews.select(*keys, F.col(pos).alias("_pos"),
                                  _tokens(F.col(text)).alias("_w"))
    w = F.col("_w")
    pairs = F.filter(
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                    lambda x, i: F.struct(
                        F.concat(x, F.lit(" "), F.element_at(w, i + 2)).alias("phrase"),
                        (i + 1).alias("tok"))),
        lambda p: F.length(p["phrase"]) <= max_chars)
    # First appearance as one long (review position << 24 | token index) so
    # the aggregate stays a hash aggregate; integral positions only (a
    # struct position would fall back to a sort-based aggregate).
    integral = isinstance(base.schema["_pos"].dataType,
                          (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    seen = (F.shiftleft(F.col("_pos").cast("long"), 24)
            + F.least(F.col("p.tok"), F.lit((1 << 24) - 1)).cast("long")) if integral else \
        F.struct(F.col("_pos").alias("pos"), F.col("p.tok").alias("tok"))
    return (base.select(*keys, "_pos", F.explode(pairs).alias("p"))
            .groupBy(*keys, F.col("p.phrase").alias("phrase"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen")))


def common_phrases(pairs: DataFrame, *, keys: list, top: int = C.PHRASE_TOP,
                   min_count: int = C.PHRASE_MIN_COUNT) -> DataFrame:
    """Top phrases by count, ties by first appearance, then count >= 2.
    Filtering count >= 2 first gives the same rows (all of them rank above
    the rest) and shrinks the window input."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("first_seen"))
    return (pairs.filter(F.col("n") >= min_count)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top))


def cohort_phrases(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
                   rating: str = "rating", pos: str = "pos") -> DataFrame:
    """A10: A8/A9 on high (>=4) and low (<=2 or null) reviews in one pass."""
    banded = (reviews.withColumn("band", rating_band(rating))
              .filter(F.col("band") != "mid"))
    pairs = bigrams(banded, key=key, text=text, pos=pos, group_extra=["band"])
    return common_phrases(pairs, keys=[key, "band"])


def option_counts(reviews: DataFrame, *, key: str = "product_code", option: str = "option",
                  pos: str = "pos") -> DataFrame:
    """Partial aggregate for A11: (key, option, n, first_pos) over non-empty
    options; mergeable by sum / min."""
    o = F.col(option)
    return (reviews.filter(o.isNotNull() & (o != ""))
            .groupBy(key, F.col(option).alias("option"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos")))


def best_option(counts: DataFrame, *, key: str = "product_code") -> DataFrame:
    """A11 from option counts: most frequent, a tie goes to the first seen."""
    best = F.min_by(F.struct(F.col("option"), F.col("n")),
                    F.struct((-F.col("n")).alias("neg_n"), F.col("first_pos")))
    return (counts.groupBy(key).agg(best.alias("b"))
            .select(key, F.col("b.option").alias("top_option"), F.col("b.n").alias("top_option_n")))


def top_option(reviews: DataFrame, *, key: str = "product_code", option: str = "option",
               pos: str = "pos") -> DataFrame:
    """Most frequent non-empty option; a tie goes to the first seen."""
    return best_option(option_counts(reviews, key=key, option=option, pos=pos), key=key)


def cohort_pairs(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
                 rating: str = "rating", pos: str = "pos") -> DataFrame:
    """Partial aggregate for A10: bigram counts per (key, band, phrase) with
    first appearance; mergeable by sum / min."""
    banded = (reviews.withColumn("band", rating_band(rating))
              .filter(F.col("band") != "mid"))
    return bigrams(banded, key=key, text=text, pos=pos, group_extra=["band"])


def _phrase_lists(pairs: DataFrame, *, key: str) -> DataFrame:
    ph = common_phrases(pairs, keys=[key, "band"])
    return (ph.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("band") == "high",
                                           F.struct("rank", "phrase")))).alias("hi"),
        F.array_sort(F.collect_list(F.when(F.col("band") == "low",
                                           F.struct("rank", "phrase")))).alias("lo"))
        .select(key, F.transform("hi", lambda s: s["phrase"]).alias("high_phrases"),
                F.transform("lo", lambda s: s["phrase"]).alias("low_phrases")))


def key_points_col(high: Column, low: Column, opt: Column, opt_n: Column,
                   show: int = C.PHRASE_SHOW) -> Column:
    """Positive phrases, needs-work phrases, popular option; absent
    ones skipped."""
    def part(label, arr):
        a = F.coalesce(arr, F.array().cast("array<string>"))
        return F.when(F.size(a) > 0,
                      F.concat(F.lit(label), F.array_join(F.slice(a, 1, show), ", ")))
    head, tail = C.KEYPOINT_OPTION.split("{option}")
    mid, end = tail.split("{n}")
    optp = F.when(opt.isNotNull(), F.concat(F.lit(head), opt, F.lit(mid),
                                            opt_n.cast("string"), F.lit(end)))
    return F.array_compact(F.array(part(C.KEYPOINT_POSITIVE, high),
                                   part(C.KEYPOINT_NEGATIVE, low), optp))


def summary_text_col(name: Column, n_texts: Column, top_keywords: Column,
                     polarity: Column) -> Column:
    """Template summary; the keyword label is printed even when the
    list is empty; no texts -> fixed sentence."""
    head, tail = C.SUMMARY_HEAD.split("{name}")
    mid, end = tail.split("{n}")
    pol = (F.when(polarity == "positive", C.POLARITY_POSITIVE)
            .when(polarity == "negative", C.POLARITY_NEGATIVE).otherwise(C.POLARITY_SPLIT))
    body = F.concat_ws(" ",
                       F.concat(F.lit(head), F.coalesce(name, F.lit("")), F.lit(mid),
                                n_texts.cast("string"), F.lit(end)),
                       F.concat(F.lit(C.SUMMARY_KEYWORD_LABEL),
                                F.array_join(F.coalesce(top_keywords,
                                                        F.array().cast("array<string>")), ", ")),
                       pol)
    return F.when(F.coalesce(n_texts, F.lit(0)) > 0, body).otherwise(F.lit(C.SUMMARY_NO_TEXTS))


def _aggregates(reviews: DataFrame, keys: list, text: str, rating: str, keywords: list, more: list) -> DataFrame:
    r, t = F.col(rating), F.col(text)
    has_text = t.isNotNull() & (t != "")
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum(F.when(r > 0, r)).cast("long").alias("sum_rating"),
        F.count(F.when(r > 0, r)).alias("n_rated"),
        F.count(F.when(_rating0(rating) >= 4, 1)).alias("positive_count"),
        F.count(F.when(_rating0(rating) <= 2, 1)).alias("negative_count"),
        F.count(F.when(r.isNull(), 1)).alias("unrated_count"),
        F.count(F.when(has_text, 1)).alias("n_texts"),
        *[F.sum(F.when(has_text, keyword_count(t, k))).cast("long").alias(f"kw_{i}")
          for i, k in enumerate(keywords)], *more)


def product_aggregates(reviews: DataFrame, *, key: str = "product_code",
                       text: str = "review_text", rating: str = "rating",
                       keywords: list | None = None) -> DataFrame:
    """A1-A5 in one grouped aggregate (one scan, map-side combine): rating
    statistics, number of non-empty texts and every keyword count."""
    return _aggregates(reviews, [key], text, rating, keywords or C.SUMMARY_KEYWORDS, [])


def _sums(keywords: list) -> list[str]:
    return ["total_reviews", "sum_rating", "n_rated", "positive_count", "negative_count", "unrated_count", "n_texts",
            *[f"kw_{i}" for i in range(len(keywords))]]


def partials(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
             rating: str = "rating", option: str = "option", pos: str = "pos",
             dicts: C.Dictionaries = C.DEFAULT_DICTS) -> dict:
    """The two mergeable partial aggregates behind A14 (one scan each): the
    sums of A1-A5 per product and option with the option's first appearance
    (what A11 needs; the product's own sums follow from them), and the phrase
    counts."""
    of = reviews.withColumn("_option", F.coalesce(F.col(option), F.lit("")))
    sums = _aggregates(of, [F.col(key), F.col("_option").alias("option")], text, rating, dicts.keywords, [F.min(pos).alias("first_pos")])
    return {"options": sums, "pairs": cohort_pairs(reviews, key=key, text=text, rating=rating, pos=pos)}


def merge_partials(a: dict, b: dict, *, key: str = "product_code") -> dict:
    """Combine two sets of partials (sums add, first positions take the
    minimum): the incremental form of A1-A11."""
    pairs = a["pairs"].unionByName(b["pairs"])
    opts = a["options"].unionByName(b["options"])
    sums = [c for c in opts.columns if c not in (key, "option", "first_pos")]
    return {
        "options": opts.groupBy(key, "option").agg(
            *[F.sum(c).cast("long").alias(c) for c in sums], F.min("first_pos").alias("first_pos")),
        "pairs": pairs.groupBy(key, "band", "phrase").agg(
            F.sum("n").cast("long").alias("n"), F.min("first_seen").alias("first_seen")),
    }


def roll_up(options: DataFrame, keywords: list, *, key: str = "product_code") -> DataFrame:
    """The product's sums and its most frequent option (A11: a tie goes to the
    first seen) from the sums per option."""
    real = F.col("option") != ""
    best = F.min_by(F.when(real, F.struct(F.col("option"), F.col("total_reviews").alias("n"))),
                    F.when(real, F.struct((-F.col("total_reviews")).alias("neg_n"), F.col("first_pos"))))
    rolled = options.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in _sums(keywords)], best.alias("_b"))
    return rolled.select(key, *_sums(keywords), F.col("_b.option").alias("top_option"), F.col("_b.n").alias("top_option_n"))


def finish(parts: dict, products: DataFrame | None = None, *, key: str = "product_code",
           name: str = "product_name", dicts: C.Dictionaries = C.DEFAULT_DICTS,
           external: DataFrame | None = None) -> DataFrame:
    """A12-A14 from partials: top keywords, polarity, phrases, option, key
    points, template (or external) summary, rounded average."""
    agg = roll_up(parts["options"], dicts.keywords, key=key)
    kw_cols = [f"kw_{i}" for i in range(len(dicts.keywords))]
    # Top keywords and polarity are row-level on the one per-product row
    # (a 22-entry array sort), so the aggregate is computed once.
    n = {k: F.coalesce(F.col(f"kw_{i}"), F.lit(0)) for i, k in enumerate(dicts.keywords)}
    entries = F.array(*[F.struct((-n[k]).alias("neg_n"), F.lit(i).alias("kw_pos"),
                                 F.lit(k).alias("keyword"))
                        for i, k in enumerate(dicts.keywords)])
    top = F.transform(F.filter(F.slice(F.array_sort(entries), 1, C.KEYWORD_TOP),
                               lambda e: e["neg_n"] < 0), lambda e: e["keyword"])
    pos = sum((n[k] for k in dicts.positive), F.lit(0))
    neg = sum((n[k] for k in dicts.negative), F.lit(0))
    polarity = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("split")
    stats = agg.select(*[c for c in agg.columns if c not in kw_cols],
                       top.alias("top_keywords"), polarity.alias("polarity"))
    phrases = _phrase_lists(parts["pairs"], key=key)
    if products is not None:
        base = products.select(key, name).join(stats, key, "left")
    else:
        base = stats.withColumn(name, F.lit(None).cast("string"))
    j = base.join(phrases, key, "left")
    template = summary_text_col(F.col(name), F.col("n_texts"), F.col("top_keywords"),
                                F.col("polarity"))
    if external is not None:
        j = j.join(external.select(key, F.col("summary").alias("_ext_summary")), key, "left")
        template = F.coalesce(F.col("_ext_summary"), template)
    has = F.coalesce(F.col("total_reviews"), F.lit(0)) > 0
    return j.select(
        key, name,
        F.when(has, template).otherwise(F.lit(C.SUMMARY_NO_REVIEWS)).alias("summary"),
        F.when(has, key_points_col(F.col("high_phrases"), F.col("low_phrases"),
                                   F.col("top_option"), F.col("top_option_n")))
         .otherwise(F.array().cast("array<string>")).alias("key_points"),
        F.when(has, average_rating()).otherwise(F.lit(0.0)).alias("average_rating"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
          ("sum_rating", "n_rated", "total_reviews", "positive_count", "negative_count",
           "unrated_count")],
    )


def summarize(reviews: DataFrame, products: DataFrame | None = None, *,
              key: str = "product_code", name: str = "product_name", text: str = "review_text",
              rating: str = "rating", option: str = "option", pos: str = "pos",
              dicts: C.Dictionaries = C.DEFAULT_DICTS, summarizer=None) -> DataFrame:
    """The composite summary record per product: two scans of the
    reviews (``partials``), each combined map-side, then ``finish``.  With
    ``products`` given, every product appears; those without reviews get
    the fixed empty summary.

    ``summarizer`` (U1) is an optional DataFrame -> DataFrame callable that
    receives the prompt batches of A17 ``(key, batch)`` and returns
    ``(key, summary)``; products it leaves out or answers with NULL keep the
    template summary (the original falls back the same way on failure)."""
    parts = partials(reviews, key=key, text=text, rating=rating, option=option, pos=pos,
                     dicts=dicts)
    ext = summarizer(prompt_batch(reviews, key=key, text=text, pos=pos)) if summarizer else None
    return finish(parts, products, key=key, name=name, dicts=dicts, external=ext)


def prompt_batch(reviews: DataFrame, *, key: str = "product_code", text: str = "review_text",
                 pos: str = "pos", max_texts: int = C.PROMPT_MAX_TEXTS,
                 max_chars: int = C.PROMPT_MAX_CHARS) -> DataFrame:
    """First 50 non-empty texts per product joined by a blank line, cut
    at 15,000 chars.  The rank filter runs before the collect, so a group
    never holds more than 50 texts."""
    t = F.col(text)
    w = Window.partitionBy(key).orderBy(pos)
    firsts = (reviews.filter(t.isNotNull() & (t != ""))
              .withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= max_texts))
    return (firsts.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", text))).alias("t"))
            .select(key, F.substring(F.array_join(F.transform("t", lambda s: s[text]), "\n\n"),
                                     1, max_chars).alias("batch")))
