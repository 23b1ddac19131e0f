"""Catalogue queries against their SQL, and graph operators on small hand-made graphs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrograph import catalog
from ferrograph.functions import naming
from ferrograph.operators import locate, maintain, match, navigate, query, references, textindex, traverse, typesys
from ferrograph.schema import EDGE, FILE, NODE, TOKEN, Graph, InvalidArgument, NotFound
from ferrograph.session import kept
from ferrograph.sources.star import SQL, Star
from ferrograph.sources.store import Store

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
SAMPLE = ["find_regex", "ls_roots", "deps_rev", "resolve_path_fuzzy", "scout_candidates", "container_at", "longest_prefix_route", "name_priority_resolution", "ancestors", "implementations", "references_minus_declarations", "upsert_merge", "changed_files", "debounce_sessions", "display_projection", "gradle_dependencies"]


def plain(rows):
    shown = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(map(str, ([shown(v) for v in r] for r in rows)))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got[columns].itertuples(index=False)) == plain(want[columns].itertuples(index=False))


def node(fqn, kind, path=None, **more):
    base = {"fqn": fqn, "name": fqn.rsplit("#", 1)[-1].rsplit(".", 1)[-1], "kind": kind, "lang": "java", "source": "project", "status": "resolved", "path": path, **more}
    return tuple(base.get(f.name) for f in NODE.fields)


def make(spark, nodes, edges):
    return Graph(spark.createDataFrame([node(*n) for n in nodes], NODE), spark.createDataFrame([(a, b, t, p) for a, b, t, p in edges], EDGE))


@pytest.fixture(scope="module")
def chain(spark):
    """Twelve classes in a chain, the last of which inherits from the first; and members."""
    nodes = [(f"p.C{k}", "class", f"C{k}.java") for k in range(12)] + [("p.C3#run(int)", "method", "C3.java"), ("p.C0#run(int)", "method", "C0.java"), ("p", "package")]
    edges = [(f"p.C{k}", f"p.C{k + 1}", "InheritsFrom", f"C{k}.java") for k in range(11)] + [("p.C11", "p.C0", "InheritsFrom", "C11.java"), ("p.C3", "p.C3#run(int)", "Contains", "C3.java"), ("p.C0", "p.C0#run(int)", "Contains", "C0.java")]
    edges += [("p", f"p.C{k}", "Contains", f"C{k}.java") for k in range(12)]
    return make(spark, nodes, edges)


def test_cycles_end_and_depth_is_bounded(spark, chain):
    start = spark.createDataFrame([("p.C0",)], "fqn string")
    got = {r.reached: r.depth for r in traverse.ancestors(chain, start).collect()}
    assert got == {f"p.C{k}": k for k in range(1, 11)}
    assert traverse.ancestors(chain, start, max_depth=50).count() == 11
    assert traverse.ancestors(chain, start, compat_max_nodes=4).count() == 4


def test_nearest_member_wins(spark, chain):
    asked = spark.createDataFrame([("p.C1", "run"), ("p.C5", "run"), ("p.C3", "none")], "type string, simple_name string")
    got = {r.type: (r.fqn, r.depth) for r in traverse.member_in_hierarchy(chain, asked).collect()}
    assert got == {"p.C1": ("p.C3#run(int)", 2), "p.C5": ("p.C0#run(int)", 7)}


def test_overrides_are_found(spark, chain):
    got = traverse.implementations(chain, spark.createDataFrame([("p.C3#run(int)",)], "fqn string")).collect()
    assert [r.fqn for r in got] == ["p.C0#run(int)"]


def test_queries_and_paths(spark, chain):
    assert query.ls(chain, "p.C3").first()["fqn"] == "p.C3#run(int)"
    assert query.find(chain, "c1$|RUN").count() == 3 and query.cat(chain, "x").count() == 0
    with pytest.raises(InvalidArgument):
        query.find(chain, "(")
    with pytest.raises(NotFound):
        query.deps(chain, "nobody")
    assert navigate.resolve_path(chain, "C3", "p").fqns == ["p.C3"]
    assert navigate.resolve_path(chain, "run(int)").status == "ambiguous"
    assert navigate.resolve_path(chain, "..", "p.C3").fqns == ["p"] and navigate.resolve_path(chain, "zz").status == "not_found"


def test_longest_prefix_ends_at_a_dot(spark):
    routes = spark.createDataFrame([("java.util", "a"), ("java.util.concurrent", "b"), ("ja", "c")], "prefix string, asset_path string")
    asked = spark.createDataFrame([("java.util.List",), ("java.util.concurrent.Future",), ("javax.swing",), ("java.util",)], "fqn string")
    got = {r.fqn: r.asset_path for r in match.longest_prefix(asked, routes).collect()}
    assert got == {"java.util.List": "a", "java.util.concurrent.Future": "b", "java.util": "a"}


def test_smallest_container_with_both_ends(spark):
    r = lambda a, b, c, d: {"start_line": a, "start_col": b, "end_line": c, "end_col": d}
    nodes = spark.createDataFrame([node("A", "class", "f", range=r(0, 0, 9, 0)), node("A#m()", "method", "f", range=r(2, 4, 5, 1)), node("B", "class", "g", range=r(0, 0, 99, 0))], NODE)
    points = spark.createDataFrame([("f", 2, 4), ("f", 5, 1), ("f", 5, 2), ("f", 10, 0)], "path string, line int, col int")
    got = {(r.line, r.col): r.container for r in locate.container_at(points, nodes).collect()}
    assert got == {(2, 4): "A#m()", (5, 1): "A#m()", (5, 2): "A", (10, 0): None}


def names(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def same(a, b):
    return names(a.nodes, "fqn", "kind", "source", "status") == names(b.nodes, "fqn", "kind", "source", "status") and names(a.edges, "src", "dst", "edge_type") == names(b.edges, "src", "dst", "edge_type")


def test_increments_equal_a_full_build(spark):
    """Additions, edits and removals in any order leave the graph of what is there in the end."""
    parts = {
        "A.java": ([("p.A", "class", "A.java"), ("p.A#x", "field", "A.java")], [("p.A", "p.A#x", "Contains", "A.java"), ("p.A", "p.B", "InheritsFrom", "A.java")]),
        "B.java": ([("p.B", "class", "B.java")], [("p.B", "lib.Base", "InheritsFrom", "B.java")]),
        "B2": ([("p.B", "interface", "B.java"), ("p.B#y", "field", "B.java")], [("p.B", "p.B#y", "Contains", "B.java")]),
    }
    none = maintain.empty(spark)
    none = Graph(none.nodes, none.edges)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    delta = lambda *keys: make(spark, [n for k in keys for n in parts[k][0]], [e for k in keys for e in parts[k][1]])
    nothing = paths("-")
    one = maintain.apply(maintain.apply(none, nothing, delta("A.java")), nothing, delta("B.java"))
    assert same(one, maintain.apply(none, nothing, delta("A.java", "B.java")))
    assert ("lib.Base", "unresolved") in names(one.nodes, "fqn", "status")
    edited = maintain.apply(one, paths("B.java"), delta("B2"))
    assert same(edited, maintain.apply(none, nothing, delta("A.java", "B2")))
    gone = maintain.apply(edited, paths("B.java"), none)
    assert same(gone, maintain.apply(none, nothing, delta("A.java")))


def test_store_versions(spark, tmp_path, chain):
    store = Store(spark, f"file://{tmp_path}/index")
    assert store.load() is None
    assert (store.save(chain), store.save(chain)) == (0, 1)
    assert store.save(chain, 1) == 1 and store.load(0).nodes.count() == chain.nodes.count() and store.load().tokens is None
    store.clear()
    assert store.load() is None


def test_overloads(spark):
    members = [("f(int)", ["int"], False), ("f(long)", ["long"], False), ("f(Object)", ["java.lang.Object"], False), ("f(Integer)", ["Integer"], False), ("f(String,Object[])", ["String", "Object"], True), ("g(p.Base)", ["p.Base"], False), ("g(p.Mid)", ["p.Mid"], False)]
    rows = spark.createDataFrame([("p.A", m[0], f"p.A#{m}", p, v) for m, p, v in members], "owner_fqn string, simple_name string, fqn string, params array<string>, is_varargs boolean")
    cases = {"exact": ("f", ["int"], "f(int)"), "widened": ("f", ["short"], "f(int)"), "boxed": ("f", ["boolean"], "f(Object)"), "spread": ("f", ["String", "p.X", "int"], "f(String,Object[])"), "bare": ("f", ["String"], "f(Object)"), "specific": ("g", ["p.Leaf"], "g(p.Mid)"), "none": ("g", ["String"], None)}
    calls = spark.createDataFrame([(k, "p.A", m, a) for k, (m, a, _) in cases.items()], "call_id string, owner string, method string, args array<string>")
    above = spark.createDataFrame([("p.Leaf", "p.Mid"), ("p.Leaf", "p.Base"), ("p.Mid", "p.Base")], "start string, reached string")
    got = {r.call_id: r.fqn for r in typesys.resolve_overloads(calls, rows, above).collect()}
    assert got == {k: f"p.A#{want}" for k, (_, _, want) in cases.items() if want}


def test_subtype_rules(spark):
    above = spark.createDataFrame([("p.B", "p.A")], "start string, reached string")
    cases = {("int", "long"): True, ("long", "int"): False, ("int", "Integer"): True, ("Integer", "double"): True, ("p.B[]", "p.A[][]"): True, ("p.B", "p.A"): True, ("p.A", "p.B"): False, ("p.B<X>", "p.B<Y>"): False, ("p.B<X>", "p.B"): True, ("p.B", "java.lang.Object"): True}
    got = typesys.subtype_pairs(spark.createDataFrame(list(cases), "sub string, sup string"), above).collect()
    assert {(r["sub"], r["sup"]): r.is_subtype for r in got} == cases


def test_generics():
    p = typesys.parse_type
    bound = typesys.unify(p("Map<K, List<V>>"), p("Map<String, List<int[]>>"))
    assert {k: typesys.display(v) for k, v in bound.items()} == {"K": "String", "V": "int[]"}
    assert typesys.unify(p("Map<K, K>"), p("Map<A1, B1>")) is None
    assert typesys.display(typesys.substitute(p("List<? extends V>"), bound)) == "List<?>" and typesys.display(typesys.substitute(p("V[]"), bound)) == "int[][]"
    assert typesys.erase(p("Map<String, X>[]")) == "Map[]" and typesys.references_in(p("Map<String, ? super Y1>")) == ["Map", "String", "Y1"]


def test_naming(spark):
    f = F.col("f")
    row = lambda x, c: spark.createDataFrame([(x,)], "f string").select(c).first()[0]
    assert row("a.B#m(int,T)", naming.signature_parameters(f)) == ["int", "T"] and row("a.B#m()", naming.signature_parameters(f)) == []
    assert row("a.B#x", naming.signature_parameters(f)) is None and row("a.B", naming.member_owner(f)) is None
    assert row("com.ex.app.Main", naming.shorten(f)) == "c.e.app.Main" and row("a/b/X.JAVA", naming.is_java(f))
    assert FILE and TOKEN


def uses(spark, lines=40):
    """Three files of which each line names two symbols; the second file is there twice."""
    at = [(f"f{k}", name, i, j, i, j + 1, f"tok.{name}", True) for k in (0, 1, 1, 2) for i in range(lines) for j, name in enumerate("ab")]
    occ = spark.createDataFrame(at, "path string, token string, start_line int, start_col int, end_line int, end_col int, resolved_fqn string, is_call boolean")
    r = lambda a, b, c, d: {"start_line": a, "start_col": b, "end_line": c, "end_col": d}
    fields = [node(f"tok.{name}", "field", "f0", name=name, range=r(0, j, 0, j + 1), selection_range=r(0, j, 0, j + 1)) for j, name in enumerate("ab")]
    blocks = [node(f"f{k}#b{i}()", "method", f"f{k}", range=r(i * 4, 0, i * 4 + 5, 1000)) for k in range(3) for i in range(lines // 4)]
    return Graph(spark.createDataFrame(fields + blocks, NODE), spark.createDataFrame([], EDGE), None, None, occ), kept(spark.createDataFrame([("tok.a",), ("tok.b",)], "fqn string"), "asked")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_are_joined_where_they_are_and_shuffled_once(spark):
    """Rows of occurrences aren't brought together by token, nor all in one task for want of an owner."""
    g, asked = uses(spark)
    for whole, want in ((True, 240), (False, 238)):
        refs = references.find_references(g, asked, include_declaration=whole)
        plan = physical(refs)
        assert refs.count() == want and refs.distinct().count() == want
        assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_COL") == 1


def test_callers_are_found_within_a_file(spark):
    g, asked = uses(spark)
    got = {(r.target, r.caller): len(r.ranges) for r in references.incoming_calls(g, asked).collect()}
    assert sum(got.values()) == 238 and got[("tok.a", "f0#b0()")] == 5 and got[("tok.b", "f1#b0()")] == 6 and len(got) == 60


def test_members_of_related_owners_are_references(spark, chain):
    """Occurrences that resolve to a relative's member of the name count; those of strangers, and of other signatures, don't."""
    rows = [("f", "run", k, 0, k, 3, to) for k, to in enumerate(("p.C3#run(int)", "p.C0#run(int)", "q.X#run(int)", "p.C0#run(long)", "p.C0#run", "p.C3#run", None))]
    occ = spark.createDataFrame(rows, "path string, token string, start_line int, start_col int, end_line int, end_col int, resolved_fqn string")
    nodes = chain.nodes.withColumn("name", naming.strip_signature(F.col("name")))
    got = references.find_references(Graph(nodes, chain.edges, None, None, occ), spark.createDataFrame([("p.C3#run(int)",)], "fqn string")).collect()
    assert sorted(r.start_line for r in got) == [0, 1, 4, 5]


def test_tokens_are_counted_within_a_file(spark):
    """Lines and least places, also of a file that is there twice, of empty texts and of none; nothing is shuffled by token."""
    rows = [("a", "x y x\n\ny x"), ("b", "p q\nq"), ("b", "p\nr\nq p"), (None, "n"), (None, "m n"), ("c", ""), ("d", None), ("e", "é_1-2")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = textindex.tokens_of_files(files)
    want = textindex.line_occurrences(files).groupBy("path", "token").agg(F.count_distinct("line").alias("lines"), F.min("place").cast("long").alias("first_place"))
    assert got.columns == want.columns and plain(got.collect()) == plain(want.collect()) and got.count() == 9
    assert "Exchange" not in physical(textindex.tokens_of_files(files.filter("path IN ('a', 'c', 'd', 'e')")))


def test_edges_of_rows_that_are_there_twice(spark, small, tmp_path):
    """Edges are those of the SQL where orders, customers and suppliers are there twice or lie in two nations; names aren't made distinct."""
    con = duckdb.connect()
    twice = {"customer": "c_nationkey", "supplier": "s_nationkey", "orders": "o_custkey", "lineitem": "l_partkey"}
    for t in TABLES:
        more = f"UNION ALL SELECT * FROM t UNION ALL SELECT * REPLACE (({twice[t]} + 1) % 20 AS {twice[t]}) FROM t" if t in twice else ""
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{small}/{t}.parquet') SELECT * FROM t {more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    edges = Star(spark, str(tmp_path)).edges()
    got = {tuple(r) for r in edges.groupBy("edge_type").agg(F.count("*"), F.sum(F.length("src") + F.length("dst")), F.count_distinct("src", "dst")).collect()}
    want = con.execute(SQL + "SELECT edge_type, count(*), sum(length(src) + length(dst)), count(DISTINCT (src, dst)) FROM edges GROUP BY ALL").fetchall()
    assert got == {(t, n, int(chars), pairs) for t, n, chars, pairs in want}
    assert "keys=[src#" not in physical(edges) and "keys=[l_orderkey#" in physical(edges)


def test_placeholders_are_found_without_distinct_edges(spark, chain):
    """Known nodes and, for placeholders, edges aren't made distinct; nodes that are there twice do no harm."""
    edges = chain.edges.unionByName(chain.edges).unionByName(spark.createDataFrame([("p.C1", "lib.X", "InheritsFrom", None), ("q", "lib.Y", "InheritsFrom", None)], EDGE))
    bound, lost = maintain.bind_edges(edges, chain.nodes.unionByName(chain.nodes))
    assert bound.count() == chain.edges.count() + 1 and [r.fqn for r in lost.collect()] == ["lib.X"]
    assert physical(lost.select("fqn")).count("keys=[") == 2


def test_files_are_removed_where_their_nodes_are(spark, chain):
    """Nodes of one file don't meet in one task."""
    left = maintain.remove_paths(chain, spark.createDataFrame([("C3.java",)], "path string"))
    assert left.nodes.count() == 13 and left.edges.count() == chain.edges.count() - 3
    assert "SortMergeJoin" not in physical(left.nodes) and "SortMergeJoin" not in physical(left.edges)
