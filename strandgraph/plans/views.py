"""SQL definitions of the graph projections, as common table expressions for the oracle."""

STAR_NODES = """
nodes AS (
  SELECT 'region:'||r_regionkey AS id, 'namespace' AS kind, r_name AS name, r_name AS qualified_name,
         'geo/r'||r_regionkey||'/region.tbl' AS file_path, 'unknown' AS language,
         1 AS start_line, 1 AS end_line, TRUE AS is_exported
  FROM region
  UNION ALL
  SELECT 'nation:'||n_nationkey, 'module', n_name, r_name||'::'||n_name,
         'geo/r'||n_regionkey||'/n'||n_nationkey||'.py', 'python', 1, 100000, TRUE
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'customer:'||c_custkey, 'class', c_name, n_name||'::'||c_name,
         'geo/r'||n_regionkey||'/n'||n_nationkey||'.py', 'python',
         c_custkey % 100000 + 1, c_custkey % 100000 + 1, c_acctbal > 0
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'supplier:'||s_suppkey, 'interface', s_name, n_name||'::'||s_name,
         'geo/r'||n_regionkey||'/n'||n_nationkey||'.py', 'python',
         s_suppkey % 100000 + 1, s_suppkey % 100000 + 1, s_acctbal > 0
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'order:'||o_orderkey, 'method', 'order_'||o_orderkey, c_name||'::order_'||o_orderkey,
         'geo/r'||n_regionkey||'/n'||n_nationkey||'.py', 'python',
         o_orderkey % 100000 + 1, o_orderkey % 100000 + 1, o_orderstatus = 'O'
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT id, kind, name, qualified_name, file_path, language, start_line, end_line, is_exported
  FROM part_nodes
)"""

PART_NODES = """
part_nodes AS (
  SELECT 'part:'||p_partkey AS id, 'function' AS kind, p_name AS name,
         p_brand||'::'||p_name AS qualified_name,
         'catalog/'||p_brand||'/'||CASE p_type WHEN 'STANDARD' THEN 'standard.ts'
            WHEN 'ECONOMY' THEN 'economy.js' WHEN 'MEDIUM' THEN 'Medium.java'
            WHEN 'PROMO' THEN 'test/promo.ts' WHEN 'LARGE' THEN 'Large.kt'
            WHEN 'SMALL' THEN 'small.go' END AS file_path,
         CASE p_type WHEN 'STANDARD' THEN 'typescript' WHEN 'ECONOMY' THEN 'javascript'
            WHEN 'MEDIUM' THEN 'java' WHEN 'PROMO' THEN 'typescript' WHEN 'LARGE' THEN 'kotlin'
            WHEN 'SMALL' THEN 'go' END AS language,
         p_partkey % 100000 + 1 AS start_line, p_partkey % 100000 + 1 + p_size AS end_line,
         p_size > 25 AS is_exported
  FROM part
)"""

STAR_EDGES = """
edges AS (
  SELECT 'region:'||n_regionkey AS source, 'nation:'||n_nationkey AS target, 'contains' AS kind, 1 AS line FROM nation
  UNION ALL
  SELECT 'nation:'||c_nationkey, 'customer:'||c_custkey, 'contains', c_custkey % 100000 + 1 FROM customer
  UNION ALL
  SELECT 'nation:'||s_nationkey, 'supplier:'||s_suppkey, 'contains', s_suppkey % 100000 + 1 FROM supplier
  UNION ALL
  SELECT 'customer:'||o_custkey, 'order:'||o_orderkey, 'contains', o_orderkey % 100000 + 1 FROM orders
  UNION ALL
  SELECT 'order:'||l_orderkey, 'part:'||l_partkey, 'calls', l_linenumber FROM lineitem
  UNION ALL
  SELECT 'order:'||l_orderkey, 'supplier:'||l_suppkey, 'references', l_linenumber FROM lineitem
  UNION ALL
  SELECT DISTINCT 'supplier:'||l_suppkey, 'part:'||l_partkey, 'implements', 1 FROM lineitem
)"""


FLOW_EDGES = """
slot AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem
  GROUP BY l_orderkey, l_linenumber
),
edges AS (
  SELECT 'part:'||a.l_partkey AS source, 'part:'||b.l_partkey AS target, 'calls' AS kind,
         a.l_linenumber AS line
  FROM slot a JOIN slot b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
)"""


# Documents: strip_accents and lower mirror the accent-folding tokenizer of the search operators.
DOC_NODES = """
docs AS (
  SELECT 'doc:'||doc_id AS id, 'function' AS kind,
         regexp_extract(text, '([\\p{L}\\p{N}]+)', 1) AS name,
         source||'::'||regexp_extract(text, '([\\p{L}\\p{N}]+)', 1) AS qualified_name,
         source||'/'||lang||'/doc_'||doc_id||'.txt' AS file_path, lang AS language,
         text AS docstring, TRUE AS is_exported
  FROM documents
)"""


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return head + " " + ",".join(ctes) + "\n" + body


def star(body: str, *more: str) -> str:
    return with_ctes(PART_NODES, STAR_NODES, STAR_EDGES, *more, body=body, recursive=True)


HEIR_EDGES = """
edges AS (
  SELECT 'part:'||l_partkey AS source, 'part:'||heir AS target, 'calls' AS kind, 1 AS line
  FROM (SELECT l_partkey, max(struct_pack(e := l_extendedprice, o := l_orderkey)).o AS l_orderkey FROM lineitem GROUP BY l_partkey)
  JOIN (SELECT l_orderkey, min(struct_pack(s := (l_partkey * 31 + l_orderkey * 17) % 101, p := l_partkey)).p AS heir FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)
)"""
_PARTS = "\nnodes AS (SELECT * FROM part_nodes)"


def flow(body: str, *more: str) -> str:
    return with_ctes(PART_NODES, _PARTS, FLOW_EDGES, *more, body=body, recursive=True)


def heirs(body: str, *more: str) -> str:
    return with_ctes(PART_NODES, _PARTS, HEIR_EDGES, *more, body=body, recursive=True)
