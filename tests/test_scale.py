"""Steps whose cost must not grow faster than the input: their results, and what their plans shuffle."""

import re
from unittest.mock import patch

import pyarrow as pa
from pyspark.sql import functions as F

from strandgraph.functions import text as T
from strandgraph.graph import Graph
from strandgraph.llm.log_templates import line_tokens
from strandgraph.lineage import cut
from strandgraph.operators import context, ordered, resolve, scans, scopes, search, structure, synth, traversal
from strandgraph.operators.search import SearchIndex
from strandgraph.plans import resolve_queries, stored_queries
from strandgraph.schema import as_edges, as_nodes, as_refs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_opened_behind_all_shuffles(spark):
    have = spark.range(200).select(F.concat(F.lit("s"), "id").alias("owner"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 5).cast("array<string>")).alias("item"))
    want = spark.createDataFrame([("a", "0"), ("b", "4"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3"), ("d", "9")], "id string, item string")
    owners = have.select("owner").distinct().withColumn("line", F.length("owner"))
    owners = owners.unionByName(owners.filter("owner = 's4'"))  # ids may repeat
    ids = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("c", "C2"), ("d", "D")], "id string, name string")
    pairs = synth.superset_pairs(have, want, owners.filter("owner != 's9'"), ids)
    need = {"A": 0, "B": 4, "C": 3, "C2": 3}
    expected = sorted((f"s{i}", n, len(f"s{i}")) for i in [*range(200), 4] if i != 9 for n, least in need.items() if i % 5 >= least)
    assert sorted(tuple(r) for r in pairs.select("owner", "name", "line").collect()) == expected
    plan = plan_of(pairs)
    assert plan.index("Generate explode(filter") < re.search(r"\bExchange", plan).start()


def test_postings_are_dealt_once(spark):
    nodes = as_nodes(spark.createDataFrame([("a", "x", "one two one"), ("b", "y", "two"), ("b", "y", "two one")], "id string, name string, docstring string").selectExpr(
        "*", "'function' as kind", "'f' as file_path", "'go' as language"))
    postings = SearchIndex.sorted_postings(SearchIndex.words(nodes))
    got = {(r.term, r.id, r.len, tuple(r.pos)) for r in postings.filter("col = 3").collect()}
    assert got == {("one", "a", 6, (0, 2)), ("two", "a", 6, (1,)), ("two", "b", 4, (0,)), ("two", "b", 5, (0,)), ("one", "b", 5, (1,))}
    plan = plan_of(postings)
    assert len(re.findall(r"\bExchange", plan)) == 1 and "Aggregate" not in plan
    for size in (1, 3):  # words are grouped a slice at a time
        words = pa.RecordBatch.from_pydict({"id": ["a", "b", None], "len": [3, 2, 1], "col": [0, 1, 2], "own": [["x", "y", "x"], ["y", "x"], ["z"]]})
        with patch.object(search, "_SLICE", size):
            rows = [tuple(r.values()) for b in search._grouped(iter([words])) for r in b.to_pylist()]
        assert sorted(rows, key=str) == sorted([("x", "a", 0, 3, [0, 2]), ("y", "a", 0, 3, [1]), ("y", "b", 1, 2, [0]), ("x", "b", 1, 2, [1]), ("z", None, 2, 1, [0])], key=str)


def test_depth_of_nodes_in_and_below_cycles(spark):
    pairs = [("r", "n"), ("n", "c"), ("a", "b"), ("b", "a"), ("a", "low"), ("self", "self"), ("self", "kid"), ("gone", "orphan"), ("r", "out")]
    edges = as_edges(spark.createDataFrame(pairs, "source string, target string").withColumn("kind", F.lit("contains")))
    ids = spark.createDataFrame([(x,) for x in "r n c a b low self kid orphan lone".split()], "id string")
    nodes = as_nodes(ids.selectExpr("id", "'class' as kind", "id as name", "'f' as file_path", "'go' as language"))
    g = Graph(nodes, edges)
    depth = {r["id"]: r["depth"] for r in structure.node_metrics(g).collect()}
    assert depth == {"r": 0, "n": 1, "c": 2, "a": 1, "b": 1, "low": 2, "self": 0, "kid": 1, "orphan": 1, "lone": 0, "gone": 0, "out": 0}
    chains = {r["id"]: r["d"] for r in traversal.ancestors(g).groupBy("id").agg(F.max("level").alias("d")).collect()}
    assert {k: v for k, v in depth.items() if v} == chains
    assert "Join" not in plan_of(structure.node_metrics(Graph(nodes, edges.filter("source != 'a' and source != 'b'"))))


def test_lines_and_their_first_tokens():
    texts = ["a b\n\n c1 \n", None, "", "\n\nx", " \t\n ", "y\nz z", "a b"]
    text, number, first, hashes = line_tokens(pa.array(texts))
    want, tokens = [], 0
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line.split():
                want.append((i, n, tokens))
                tokens += len(line.split())
    assert list(zip(text.tolist(), number.tolist(), first.tolist())) == want and len(hashes) == tokens
    assert hashes[2] == 0 and hashes[0] == hashes[-2] and (hashes[[0, 1, 3]] != 0).all()


def test_terms_of_a_context_search_are_values(spark):
    texts = ["user loop users", "super user", "a.b a.bc a. b x.a.b", "Ünïcode user_loop über user", "", None, "ab a b a b", "customer's cust", "日本 user"]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(texts, ["src/User/loop.ts", "test/user.ts", "a.b/x", "user.go", "", "src/x_test.py", "spec/a.ts", "geo/n1.py", "user/日本"]))],
                                 "no int, text string, path string")
    terms = ["user", "us", "a.b", "über", "cust", "loop", "testUser", "user_loop"]
    phrases = [T.fts_phrases(t)[0] for t in terms]
    value = F.array(*[F.struct(F.lit(" ".join(p[:-1])).alias("head"), F.lit(p[-1]).alias("last"), F.lit(len(p)).alias("n")) for p in phrases])
    folded = rows.select("*", T.fold("text").alias("f"))
    for i, (t, p) in enumerate(zip(terms, phrases)):
        got = folded.withColumn("i", F.lit(i)).select(
            T.phrase_count(T.tokens(F.col("f")), value[i]).alias("a"), F.coalesce(T.phrase_hits(F.col("f"), p), F.lit(0)).alias("b"),
            T.term_bonus("path", "text", "i", terms).alias("c"), (T.path_relevance("path", t) + T.name_bonus("text", t)).alias("d"),
            F.size(T.tokens(F.col("f"))).alias("e"), T.token_count(F.col("f")).alias("g")).collect()
        assert all((r.a, r.c, r.e) == (r.b, r.d, r.g) for r in got), (t, got)

    def patterns(some):  # the regular expressions that a plan holds
        return plan_of(rows.withColumn("i", F.lit(0)).select(T.term_bonus("path", "text", "i", some))).count("RLIKE")

    assert patterns(terms) == patterns(terms[:1])


def test_nodes_written_for_searches_lie_in_several_files(spark):
    nodes = as_nodes(spark.range(0, 1000, 1, 1).selectExpr("concat('n', id) as id", "'function' as kind", "'x' as name", "'f' as file_path", "'go' as language"))
    edges = as_edges(spark.createDataFrame([("n1", "n2", "calls")], "source string, target string, kind string"))
    g = Graph(nodes, edges).materialised()
    assert len(g.nodes.inputFiles()) > 1 and g.nodes.count() == 1000


def functions(spark, n: int):
    return as_nodes(spark.range(n).selectExpr("concat('n', id) as id", "'function' as kind", "concat('f', id % 5) as name",
                                              "concat('src/', id % 7, '.go') as file_path", "'go' as language", "cast(id * 3 as int) as start_line"))


def test_nodes_do_not_pass_through_the_driver(spark):
    """A written table of nodes looks small; as a broadcast it would be many times larger."""
    nodes = cut(functions(spark, 300), "nodes")
    edges = cut(as_edges(spark.range(600).selectExpr("concat('n', id % 300) as source", "concat('n', id * 7 % 300) as target", "'calls' as kind")), "edges")
    refs = resolve_queries.flow_refs(Graph(nodes, edges))
    known = {(r["from_node_id"], r["reference_name"]) for r in refs.collect()}
    assert known == {(f"n{i % 300}", f"f{i * 7 % 300 % 5}") for i in range(600)}
    seen = []
    with patch.object(resolve_queries, "cut", lambda df, label="": seen.append(df) or cut(df, label)):
        resolve_queries.flow_refs(Graph(nodes, edges))
    with patch.object(stored_queries, "cut", lambda df, label="": seen.append(df) or cut(df, label)):
        state = stored_queries._with_files(nodes, refs)
    answers = resolve.exact_name(nodes, refs, resolve.EDGE_OF)
    assert answers.count() == refs.count() == state.refs.count()
    found = resolve.edges_from(state, refs, cut(answers, "answers"))
    assert found.count() == refs.count()
    assert len(seen) == 2 and not any("Broadcast" in plan_of(df) for df in [*seen, found])
    near = [line for line in plan_of(answers).splitlines() if "Join" in line and "bin" in line]
    assert near and not any("Broadcast" in line for line in near)


def test_edges_within_files_count_nodes_that_share_an_id(spark):
    nodes = as_nodes(spark.createDataFrame([("a", "f"), ("b", "f"), ("b", "f"), ("b", "g"), ("c", "g")], "id string, file_path string").selectExpr(
        "*", "'function' as kind", "id as name", "'go' as language"))
    edges = as_edges(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("b", "c"), ("a", "c"), ("a", "x"), (None, "b")], "source string, target string"))
    rows = scans.in_file_edges(Graph(nodes, edges))
    assert {r["file_path"]: r["edge_count"] for r in rows.collect()} == {"f": 2 * 2 + 2 * 2, "g": 1 + 1}
    assert not re.search(r"hashpartitioning\(source#\d+, target#", plan_of(rows))  # all pairs of ends are not counted


def test_a_context_joins_all_nodes_with_few_rows_only(spark):
    nodes = as_nodes(spark.createDataFrame(
        [("w", "class", "Widget"), ("x", "class", "Gadget"), ("i", "import", "Widget"), ("e", "parameter", "widget_e"), ("m", "method", "open")],
        "id string, kind string, name string").selectExpr("*", "'a/b.go' as file_path", "'go' as language"))
    edges = as_edges(spark.createDataFrame([("i", "x", "imports"), ("i", "gone", "imports"), ("w", "m", "contains"), ("w", "e", "contains"), ("w", "far", "calls")],
                                           "source string, target string, kind string"))
    g = Graph(nodes, edges)
    ranked = spark.createDataFrame([("w", "class", 9.0), ("w", "class", 9.0), ("i", "import", 7.0), (None, "class", 8.0)], "id string, kind string, score double")
    every = context._definitions_of_imports(g, ranked)
    assert sorted(tuple(r) for r in every.collect()) == [("w", 9.0), ("w", 9.0), ("x", 7.0)]
    seen = {}
    with patch.object(context, "cut", lambda df, label="": seen.setdefault(label, df) and cut(df, label)):
        ctx = context.find(g, "widget", search_limit=1)
    assert {r["id"] for r in ctx.nodes.collect()} == {"w", "m"}  # no parameters, nothing that is not there
    assert [r["id"] for r in seen["step"].select("id").orderBy("id").collect()] == ["e", "far", "m"]  # kinds are asked for behind the step
    assert seen["first"].columns == ["id", "score"]


def test_receivers_travel_once(spark):
    points = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("a", None, 3), ("b", 9, 4), ("c", 9, 5), ("a", 9000, 6), (None, 1, 7)], "k string, o long, n int")
    facts = spark.createDataFrame([("a", 3, "x"), ("b", 10, "y")], "k string, o long, v string")
    first = spark.createDataFrame([("a", "first"), ("b", "only"), (None, "none")], "k string, v string")
    got = {r["n"]: r["v"] for r in ordered.as_of(points, facts, ["k"], "o", "v", otherwise=first).collect()}
    assert got == {1: "x", 2: "first", 3: "first", 4: "only", 5: None, 6: "x", 7: None}

    uses = spark.createDataFrame([(1, "m", 5, "v"), (2, "m", None, "w"), (3, None, 5, "v")], "use_id long, scope string, line int, name string")
    chains = spark.createDataFrame([("m", "m", 0), ("m", "c", 1)], "scope string, at string, level int")
    declared = spark.createDataFrame([("m", 4, "v", "T", False), ("c", 90, "w", "U", True), ("c", 1, "v", "V", True)],
                                     "scope string, line int, name string, type_name string, hoisted boolean")
    types = scopes.visible_types(uses, declared, chains)
    assert {tuple(r) for r in types.collect()} == {(1, "T"), (2, "U")}
    assert "ExistingRDD[scope#" in plan_of(types) and not re.search(r"ExistingRDD\[scope#\d+,at#", plan_of(types))  # chains were joined before

    nodes = as_nodes(spark.createDataFrame([("T::go", "method", "go"), ("c", "class", "c"), ("m", "method", "m")], "id string, kind string, name string").selectExpr(
        "*", "id as qualified_name", "'a.java' as file_path", "'java' as language"))
    refs = as_refs(spark.createDataFrame([("m", "v.go", "calls", 5), ("m", "this.v.go", "calls", 6), ("m", "go", "calls", 7)],
                                         "from_node_id string, reference_name string, reference_kind string, line int").selectExpr("*", "'a.java' as file_path", "'java' as language"))
    g = Graph(nodes, as_edges(spark.createDataFrame([("c", "m", "contains")], "source string, target string, kind string")))
    plain, named = (scopes.typed_receiver(g, r, declared, keep=["line"]) for r in (refs, resolve.with_ref_id(refs)))
    rows = [sorted(tuple(r) for r in df.select("ref_id", "target", "confidence", "resolved_by", "line").collect()) for df in (plain, named)]
    assert rows[0] == rows[1] == [("m|calls|this.v.go|6|0", "T::go", 0.9, "instance-method", 6), ("m|calls|v.go|5|0", "T::go", 0.9, "instance-method", 5)]
