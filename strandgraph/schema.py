"""Table schemas and enumerations of the graph model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Node kinds, edge kinds and language tags of the data model.
NODE_KINDS = [
    "file", "module", "class", "struct", "interface", "trait", "protocol", "function",
    "method", "property", "field", "variable", "constant", "enum", "enum_member",
    "type_alias", "namespace", "parameter", "import", "export", "route", "component",
]
EDGE_KINDS = [
    "contains", "calls", "imports", "exports", "extends", "implements", "references",
    "type_of", "returns", "instantiates", "overrides", "decorates",
]
LANGUAGES = [
    "typescript", "javascript", "tsx", "jsx", "python", "go", "rust", "java", "c", "cpp",
    "csharp", "razor", "php", "ruby", "swift", "kotlin", "dart", "svelte", "vue", "astro",
    "liquid", "pascal", "scala", "lua", "luau", "objc", "yaml", "twig", "xml",
    "properties", "unknown",
]
# Edge kinds that make a node a caller of another one.
CALLER_KINDS = ["calls", "references", "imports", "instantiates"]
# Kinds whose children are affected together with them.
CONTAINER_KINDS = ["class", "interface", "struct", "trait", "protocol", "module", "enum"]

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_SA = T.ArrayType(T.StringType())

NODES = T.StructType([
    T.StructField("id", _S), T.StructField("kind", _S), T.StructField("name", _S),
    T.StructField("qualified_name", _S), T.StructField("file_path", _S),
    T.StructField("language", _S), T.StructField("start_line", _I),
    T.StructField("end_line", _I), T.StructField("start_column", _I),
    T.StructField("end_column", _I), T.StructField("docstring", _S),
    T.StructField("signature", _S), T.StructField("visibility", _S),
    T.StructField("is_exported", _B), T.StructField("is_async", _B),
    T.StructField("is_static", _B), T.StructField("is_abstract", _B),
    T.StructField("decorators", _SA), T.StructField("type_parameters", _SA),
    T.StructField("return_type", _S), T.StructField("updated_at", _L),
])
EDGES = T.StructType([
    T.StructField("source", _S), T.StructField("target", _S), T.StructField("kind", _S),
    T.StructField("line", _I), T.StructField("col", _I),
    T.StructField("metadata", T.MapType(_S, _S)), T.StructField("provenance", _S),
])
FILES = T.StructType([
    T.StructField("path", _S), T.StructField("content_hash", _S),
    T.StructField("language", _S), T.StructField("size", _L),
    T.StructField("modified_at", _L), T.StructField("indexed_at", _L),
    T.StructField("node_count", _I),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("message", _S), T.StructField("file_path", _S),
        T.StructField("line", _I), T.StructField("column", _I),
        T.StructField("severity", _S), T.StructField("code", _S)]))),
])
REFS = T.StructType([
    T.StructField("from_node_id", _S), T.StructField("reference_name", _S),
    T.StructField("reference_kind", _S), T.StructField("line", _I),
    T.StructField("col", _I), T.StructField("candidates", _SA),
    T.StructField("file_path", _S), T.StructField("language", _S),
])
METADATA = T.StructType([
    T.StructField("key", _S), T.StructField("value", _S), T.StructField("updated_at", _L),
])

# What a node lacks unless told otherwise, as SQL literals.
_NODE_DEFAULTS = {
    "start_line": "0", "end_line": "0", "start_column": "0", "end_column": "0",
    "is_exported": "false", "is_async": "false", "is_static": "false", "is_abstract": "false",
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select exactly the columns of `schema`, filling absent ones with defaults or null."""
    defaults, have = defaults or {}, set(df.columns)
    exprs = []
    for field in schema.fields:
        value = f"`{field.name}`" if field.name in have else "null"
        if field.name in defaults:
            value = f"coalesce({value}, {defaults[field.name]})"
        exprs.append(f"cast({value} as {field.dataType.simpleString()}) as `{field.name}`")
    return df.selectExpr(*exprs)


def as_nodes(df: DataFrame) -> DataFrame:
    """Nodes table: rows lacking a key column are dropped, defaults are filled."""
    df = df.filter("id is not null and kind is not null and name is not null "
                   "and file_path is not null and language is not null")
    if "qualified_name" in df.columns:
        df = df.withColumn("qualified_name", F.coalesce("qualified_name", "name"))
    else:
        df = df.withColumn("qualified_name", F.col("name"))
    return conform(df, NODES, _NODE_DEFAULTS)


def as_edges(df: DataFrame) -> DataFrame:
    return conform(df, EDGES)


def as_refs(df: DataFrame) -> DataFrame:
    return conform(df, REFS)


def any_kind(column: str | Column, values: list[str] | None) -> Column:
    """Membership predicate; no restriction when `values` is empty or None."""
    col = F.col(column) if isinstance(column, str) else column
    return col.isin(list(values)) if values else F.lit(True)


#: Ids of nodes that stand for an event, a collection or a handler chain. Members are linked through them, so
#: that they are never paired; walks and one-hop lookups look through them.
CHANNEL = "channel:"

#: Written with every stored graph; another value means that it should be extracted anew.
EXTRACTION_VERSION = "1"
