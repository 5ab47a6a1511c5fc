"""SQL twins of the fixture views (``plans.fixtures``) for the DuckDB oracle.

Each is a CTE body; queries splice them with ``WITH rv AS (...)``.
"""

RV = """SELECT CAST(l_partkey AS VARCHAR) AS product_code,
       'u' || CAST(l_suppkey AS VARCHAR) AS username,
       CASE WHEN l_linenumber = 7 THEN NULL
            ELSE 1 + CAST(l_quantity AS INTEGER) % 5 END AS rating,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || l_linestatus END AS option,
       '' AS review_text,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity
FROM lineitem"""

# order of first appearance in RV
RV_POS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity"

PR = """SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name,
       p_brand AS category, p_type AS sub_category, p_retailprice AS price, p_size,
       p_partkey AS pos
FROM part"""

DV = """SELECT d.source AS product_code,
       'u' || CAST(d.doc_id % 7 AS VARCHAR) AS username,
       CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 1 THEN 5
                 WHEN l.quality = 0 THEN 3 END AS INTEGER) AS rating,
       d.lang AS option, d.text AS review_text, d.doc_id AS pos, d.doc_id, d.lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

CV = """SELECT conv_id AS product_code, turn AS page_no, role AS username, text AS review_text
FROM conversations"""


def with_views(**views: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"

DOCS = """SELECT doc_id, lang AS product_code, 'u' AS username, text AS review_text, doc_id AS pos
FROM documents"""

DOCS_OLD = "SELECT * FROM docs WHERE doc_id <= (SELECT max(doc_id) FROM documents) * 0.6"
DOCS_NEW = "SELECT * FROM docs WHERE doc_id >= (SELECT max(doc_id) FROM documents) * 0.4"

CAT_OLD = """SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name,
       p_brand AS category, p_type AS sub_category, p_partkey AS pos, 1 AS run_ts
FROM part"""

CAT_NEW = """SELECT CASE WHEN p_size = 3 THEN NULL WHEN p_size = 6 THEN ''
            WHEN p_size > 15 THEN CAST(p_partkey AS VARCHAR) || '-n' ELSE CAST(p_partkey AS VARCHAR) END AS product_code,
       CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '' ELSE upper(p_name) END AS product_name,
       CASE WHEN p_size = 4 THEN '' ELSE p_brand || '*' END AS category,
       CASE WHEN p_size = 5 THEN NULL ELSE p_type END AS sub_category,
       p_partkey AS pos, 2 AS run_ts
FROM part"""

# each product and each again under a code that nothing else has
PRX = """SELECT * FROM pr UNION ALL SELECT * REPLACE (product_code || '-x' AS product_code) FROM pr"""
RVX = """SELECT * FROM rv UNION ALL SELECT * REPLACE (product_code || '-x' AS product_code) FROM rv"""

WALK = """SELECT conv_id AS product_code,
       DENSE_RANK() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no,
       turn AS pos, role AS username, text AS review_text
FROM (SELECT conv_id, turn, role, text FROM conversations
      UNION ALL
      SELECT conv_id, t AS turn, role, text FROM conversations, range(8, 13) r(t)
      WHERE turn = 0)"""
