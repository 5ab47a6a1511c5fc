"""Queries op1 to op13 and the pipeline, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loupe.llm.chat import formatted_chats
from loupe.llm.common import table
from loupe.llm.decontaminate import contaminated
from loupe.llm.exact_dedup import exact_duplicates
from loupe.llm.fill_middle import filled_digests
from loupe.llm.filter_audit import audit_filters
from loupe.llm.fingerprint import fingerprints
from loupe.llm.mixing import mix
from loupe.llm.near_dedup import near_duplicates
from loupe.llm.substring_dedup import repeated
from loupe.llm.token_counts import count_tokens
from loupe.llm.token_store import token_output
from loupe.llm.toxicity import score_toxicity
from loupe.llm.warc import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


# The balanced rate is the same for all documents of a source, so SQL can state
# the result that the Newton steps arrive at.
ORACLE["op2_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), u AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, ((SELECT sum(total) FROM w) - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 3 * total / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, sid, total, least((3 * total)::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM w
), r AS (
  SELECT u.doc_id, u.size, t.total AS source_size, t.target,
    CASE WHEN u.size > 0 THEN floor(t.target / t.total + 1e-9) ELSE 0 END AS whole,
    t.target - floor(t.target / t.total + 1e-9) * t.total AS need,
    coalesce(sum(u.size) OVER (PARTITION BY t.sid ORDER BY u.draw, u.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + u.size / 2 AS reached
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN size > 0 AND reached <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{hard}' text")
    return formatted_chats(turns.unionByName(own))


ORACLE["op8_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
    THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS shown FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(shown))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


@query
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "pages"))


@query
def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


ORACLE["op11_exact_duplicates"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY said) AS keep_id, count(*) OVER (PARTITION BY said) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY said) AS kept, sha256(said) AS text_sha256
FROM d
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS said, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(said, '[A-Z]')) > 3 * length(said) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(said, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY said) THEN 16 ELSE 0 END AS mask FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a JOIN x b ON b.bit <> a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit)
    JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_digests(table(spark, sf_dir, "documents"))


ORACLE["op13_fill_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS said, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d
), f AS (
  SELECT doc_id, said, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN said = '' OR contains(said, '<P>') OR contains(said, '<S>') OR contains(said, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(said, 1, a) AS prefix, substring(said, a + 1, b - a) AS middle, substring(said, b + 1, n - b) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN said WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(said) AS restored_sha256
FROM p
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
