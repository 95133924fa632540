"""Graph projections of relational tables (one definition per projection).

Each projection reads its tables whole. Nation and region are dimension tables of fixed
size, so their joins broadcast; all other joins are key joins left to Catalyst.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import union_all
from ..schema import as_edges, as_nodes

# Languages and file endings given to the part types, so that several families meet.
PART_LANGUAGE = {
    "STANDARD": "typescript", "ECONOMY": "javascript", "MEDIUM": "java",
    "PROMO": "typescript", "LARGE": "kotlin", "SMALL": "go",
}
PART_FILE = {
    "STANDARD": "standard.ts", "ECONOMY": "economy.js", "MEDIUM": "Medium.java",
    "PROMO": "test/promo.ts", "LARGE": "Large.kt", "SMALL": "small.go",
}
LINES = 100_000
_NODE = "id, kind, name, qualified_name, file_path, language, start_line, end_line, is_exported"
_schemas: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; its schema is read from the file footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def lookup(column: str, mapping: dict[str, str]) -> str:
    """SQL expression that maps the values of a column."""
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"case {column} {whens} end"


def _id(prefix: str, column: str) -> str:
    return f"concat('{prefix}:', cast({column} as string))"


def _line(column: str) -> str:
    return f"cast({column} % {LINES} + 1 as int)"


def _nodes(df: DataFrame, **columns: str) -> DataFrame:
    return df.selectExpr(*[f"{columns[c]} as {c}" for c in _NODE.split(", ")])


def nation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with their region and the file path that stands for them."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    return nation.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey", "n_name", "n_regionkey", "r_name",
        "concat('geo/r', n_regionkey, '/n', n_nationkey, '.py') as nation_file")


def _part_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(
        table(spark, sf, "part"), id=_id("part", "p_partkey"), kind="'function'", name="p_name",
        qualified_name="concat(p_brand, '::', p_name)",
        file_path=f"concat('catalog/', p_brand, '/', {lookup('p_type', PART_FILE)})",
        language=lookup("p_type", PART_LANGUAGE), start_line=_line("p_partkey"),
        end_line=f"{_line('p_partkey')} + p_size", is_exported="p_size > 25")


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return as_nodes(_part_rows(spark, sf))


def star_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers, suppliers, orders and parts as graph nodes."""
    nation = nation_files(spark, sf)
    customer = table(spark, sf, "customer").join(nation, F.expr("c_nationkey = n_nationkey"))
    supplier = table(spark, sf, "supplier").join(nation, F.expr("s_nationkey = n_nationkey"))
    orders = table(spark, sf, "orders").join(customer, F.expr("o_custkey = c_custkey"))
    py = {"file_path": "nation_file", "language": "'python'"}

    def at(column: str) -> dict:
        return {"start_line": _line(column), "end_line": _line(column)}

    order_name = "concat('order_', cast(o_orderkey as string))"
    return as_nodes(union_all([
        _nodes(table(spark, sf, "region"), id=_id("region", "r_regionkey"), kind="'namespace'", name="r_name",
               qualified_name="r_name", file_path="concat('geo/r', r_regionkey, '/region.tbl')",
               language="'unknown'", start_line="1", end_line="1", is_exported="true"),
        _nodes(nation, id=_id("nation", "n_nationkey"), kind="'module'", name="n_name",
               qualified_name="concat(r_name, '::', n_name)", start_line="1", end_line=str(LINES),
               is_exported="true", **py),
        _nodes(customer, id=_id("customer", "c_custkey"), kind="'class'", name="c_name",
               qualified_name="concat(n_name, '::', c_name)", is_exported="c_acctbal > 0",
               **at("c_custkey"), **py),
        _nodes(supplier, id=_id("supplier", "s_suppkey"), kind="'interface'", name="s_name",
               qualified_name="concat(n_name, '::', s_name)", is_exported="s_acctbal > 0",
               **at("s_suppkey"), **py),
        _nodes(orders, id=_id("order", "o_orderkey"), kind="'method'", name=order_name,
               qualified_name=f"concat(c_name, '::', {order_name})", is_exported="o_orderstatus = 'O'",
               **at("o_orderkey"), **py),
        _part_rows(spark, sf),
    ]))


def star_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Containment tree plus order-to-part calls, order-to-supplier references, supply links."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    supplier, orders = table(spark, sf, "supplier"), table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")

    def edge(df: DataFrame, source: str, target: str, kind: str, line: str) -> DataFrame:
        return df.selectExpr(f"{source} as source", f"{target} as target", f"'{kind}' as kind",
                             f"cast({line} as int) as line")

    order, supply = _id("order", "l_orderkey"), _id("supplier", "l_suppkey")
    return as_edges(union_all([
        edge(nation, _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", "1"),
        edge(customer, _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains", _line("c_custkey")),
        edge(supplier, _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains", _line("s_suppkey")),
        edge(orders, _id("customer", "o_custkey"), _id("order", "o_orderkey"), "contains", _line("o_orderkey")),
        edge(lines, order, _id("part", "l_partkey"), "calls", "l_linenumber"),
        edge(lines, order, supply, "references", "l_linenumber"),
        edge(lines.select("l_suppkey", "l_partkey").distinct(), supply, _id("part", "l_partkey"), "implements", "1"),
    ]))


def star(spark: SparkSession, sf: str) -> Graph:
    return Graph(star_nodes(spark, sf), star_edges(spark, sf))


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part calls part: the parts on consecutive line numbers of one order.

    One part stands for each (order, line number) slot. Every line item counts for its own slot and as successor
    of the slot before, so slots meet in one aggregate, which spreads even a very large order over all tasks.
    """
    lines = table(spark, sf, "lineitem").filter("l_orderkey is not null and l_linenumber is not null")
    both = lines.selectExpr("l_orderkey", "l_partkey", "posexplode(array(l_linenumber, l_linenumber - 1)) as (turn, slot)")
    own = F.col("turn") == 0
    # Dealt out before they are counted, since hardly two rows of a task meet in a slot.
    slot = both.repartition("l_orderkey", "slot").groupBy("l_orderkey", "slot").agg(
        F.min(F.when(own, F.col("l_partkey"))).alias("l_partkey"), F.min(F.when(~own, F.col("l_partkey"))).alias("next_part"),
        F.max(own).alias("here"), F.max(~own).alias("after")).filter("here and after")
    return as_edges(slot.selectExpr(
        f"{_id('part', 'l_partkey')} as source", f"{_id('part', 'next_part')} as target",
        "'calls' as kind", "slot as line"))


def flow(spark: SparkSession, sf: str) -> Graph:
    return Graph(part_nodes(spark, sf), flow_edges(spark, sf))


def heirs(spark: SparkSession, sf: str) -> Graph:
    """Part calls part: a part of its dearest order, picked by a remainder. Sparse by nature: one edge a part."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    last = lines.groupBy("l_partkey").agg(F.max(F.struct("l_extendedprice", "l_orderkey"))["l_orderkey"].alias("l_orderkey"))
    head = lines.groupBy("l_orderkey").agg(F.min(F.struct(F.expr("(l_partkey * 31 + l_orderkey * 17) % 101"), "l_partkey"))["l_partkey"].alias("heir"))
    return Graph(part_nodes(spark, sf), as_edges(last.join(head, "l_orderkey").selectExpr(
        f"{_id('part', 'l_partkey')} as source", f"{_id('part', 'heir')} as target", "'calls' as kind", "1 as line")))


WORD = r"([\\p{L}\\p{N}]+)"


def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes: first word is the name, the whole text is the docstring."""
    first = f"regexp_extract(text, '{WORD}', 1)"
    return as_nodes(table(spark, sf, "documents").selectExpr(
        f"{_id('doc', 'doc_id')} as id", "'function' as kind", f"{first} as name",
        f"concat(source, '::', {first}) as qualified_name",
        "concat(source, '/', lang, '/doc_', cast(doc_id as string), '.txt') as file_path",
        "lang as language", "1 as start_line", "size(split(text, '\\n')) as end_line",
        "text as docstring", "true as is_exported"))
