"""The engine's queries over the driver's tables, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators import assets, locate, maintain, match, navigate, present, query, references, textindex, traverse
from ferrograph.schema import EDGE, Graph
from ferrograph.session import kept
from ferrograph.sources import gradle
from ferrograph.sources.star import SQL, Star, table
from ferrograph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sql(text: str):
    """Register a query under its function's name, with its SQL after the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = SQL + text
        return f

    return add


def c(name: str):
    return F.col(name)


def graph(spark: SparkSession, d: str, text: bool = False) -> Graph:
    return Star(spark, d).graph(text)


# Filters and projections


@sql("SELECT fqn, kind FROM nodes WHERE regexp_matches(fqn, 'c1[0-9]*5$|^types', 'i') OR regexp_matches(name, 'c1[0-9]*5$|^types', 'i') ORDER BY fqn LIMIT 20")
def find_regex(spark, d):
    return query.find(graph(spark, d), "c1[0-9]*5$|^types").select("fqn", "kind")


@sql("SELECT fqn, kind, source FROM nodes WHERE kind IN ('interface', 'annotation') AND source = 'project' AND (regexp_matches(fqn, '[0-9]$', 'i') OR regexp_matches(name, '[0-9]$', 'i')) ORDER BY fqn LIMIT 10")
def find_filtered_limit(spark, d):
    return query.find(graph(spark, d), "[0-9]$", ["interface", "annotation"], ["project"], 10).select("fqn", "kind", "source")


@sql("SELECT fqn, name FROM nodes WHERE regexp_matches(fqn, 'nation_1\\.', 'i') OR regexp_matches(name, 'nation_1\\.', 'i')".replace("\\\\", "\\"))
def find_all_matches(spark, d):
    return query.find(graph(spark, d), r"nation_1\.", limit=None).select("fqn", "name")


@sql("SELECT fqn, path FROM (SELECT * FROM nodes WHERE regexp_matches(fqn, 's[0-9]+$', 'i') OR regexp_matches(name, 's[0-9]+$', 'i') ORDER BY fqn LIMIT 100) WHERE path IS NOT NULL")
def workspace_symbols(spark, d):
    return query.workspace_symbols(graph(spark, d), "s[0-9]+$").select("fqn", "path")


@sql("SELECT fqn, name, kind, source, parent_fqn FROM nodes WHERE fqn = 'parts.P7'")
def cat(spark, d):
    return query.cat(graph(spark, d), "parts.P7").select("fqn", "name", "kind", "source", "parent_fqn")


@sql("SELECT fqn FROM nodes WHERE fqn = 'no.such.Thing'")
def cat_unknown(spark, d):
    return query.cat(graph(spark, d), "no.such.Thing").select("fqn")


@sql("SELECT n.fqn, n.kind FROM edges e JOIN nodes n ON e.dst = n.fqn WHERE e.src = 'ASIA.NATION_2' AND edge_type = 'Contains' AND kind IN ('class', 'interface')")
def ls_children(spark, d):
    return query.ls(graph(spark, d), "ASIA.NATION_2", ["class", "interface"]).select("fqn", "kind")


@sql("SELECT fqn, kind FROM nodes WHERE fqn NOT IN (SELECT dst FROM edges WHERE edge_type = 'Contains') ORDER BY fqn LIMIT 50")
def ls_roots(spark, d):
    return query.ls(graph(spark, d)).select("fqn", "kind")


@sql("SELECT fqn, kind, source FROM nodes WHERE fqn NOT IN (SELECT dst FROM edges WHERE edge_type = 'Contains')")
def parentless_nodes(spark, d):
    return query.parentless(graph(spark, d)).select("fqn", "kind", "source")


@sql("SELECT n.fqn FROM edges e JOIN nodes n ON e.dst = n.fqn WHERE e.src = 'ASIA.NATION_2' AND edge_type = 'Contains' AND list_contains(modifiers, 'household')")
def ls_modifiers(spark, d):
    return query.ls(graph(spark, d), "ASIA.NATION_2", modifiers=["household"]).select("fqn")


@sql("SELECT n.fqn, n.kind, edge_type FROM edges JOIN nodes n ON dst = n.fqn WHERE src = 'parts.P1'")
def deps_out(spark, d):
    return query.deps(graph(spark, d), "parts.P1").select("fqn", "kind", "edge_type")


@sql("SELECT n.fqn, n.kind, edge_type FROM edges JOIN nodes n ON src = n.fqn WHERE dst = 'parts.P1'")
def deps_rev(spark, d):
    return query.deps(graph(spark, d), "parts.P1", rev=True).select("fqn", "kind", "edge_type")


@sql("SELECT n.fqn, edge_type FROM edges JOIN nodes n ON src = n.fqn WHERE dst = 'types.ECONOMY' AND edge_type IN ('InheritsFrom', 'Implements')")
def deps_edge_filter(spark, d):
    return query.deps(graph(spark, d), "types.ECONOMY", True, ["InheritsFrom", "Implements"]).select("fqn", "edge_type")


@sql("SELECT other AS fqn, array_to_string(list_sort(list(DISTINCT edge_type)), ', ') AS relation FROM (SELECT dst AS other, edge_type FROM edges WHERE src = 'parts.P1' UNION ALL SELECT src, edge_type FROM edges WHERE dst = 'parts.P1') GROUP BY other")
def relation_column(spark, d):
    return query.relation_column(graph(spark, d), "parts.P1")


# Navigation


@sql("SELECT dst AS fqn, min(src) AS parent FROM edges WHERE edge_type = 'Contains' GROUP BY dst")
def parent(spark, d):
    return navigate.parents(graph(spark, d))


@sql("""
, targets AS (SELECT 'C' || s_suppkey AS target, CAST(NULL AS VARCHAR) AS context FROM supplier UNION SELECT 't1', NULL UNION SELECT 'S' || s_suppkey, f FROM supplier, nation_f WHERE n_nationkey = s_suppkey % 25
), names AS (SELECT DISTINCT fqn, unnest([name, list_last(regexp_split_to_array(regexp_replace(fqn, '\\(.*\\)$', ''), '[.:#]'))]) AS target FROM nodes
), found AS (
  SELECT t.target, t.context, n.fqn FROM targets t JOIN names n USING (target) WHERE t.context IS NULL
  UNION SELECT t.target, t.context, n.fqn FROM targets t JOIN names n USING (target) JOIN edges e ON e.src = t.context AND e.dst = n.fqn AND edge_type = 'Contains'
)
SELECT t.target, t.context, CASE count(DISTINCT fqn) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(DISTINCT fqn) AS candidates, min(fqn) AS first
FROM targets t LEFT JOIN found f ON t.target = f.target AND t.context IS NOT DISTINCT FROM f.context GROUP BY t.target, t.context
""".replace("\\\\", "\\"))
def resolve_path_fuzzy(spark, d):
    star = Star(spark, d)
    none = F.lit(None).cast("string").alias("context")
    bound = star.supplier.select("s_suppkey").join(star.nation.select("n_nationkey", c("f").alias("context")), c("n_nationkey") == c("s_suppkey") % 25).select(F.concat(F.lit("S"), "s_suppkey").alias("target"), "context")
    targets = star.supplier.select(F.concat(F.lit("C"), "s_suppkey").alias("target"), none).union(spark.range(1).select(F.lit("t1"), none)).union(bound)
    return navigate.fuzzy(star.graph(), targets)


@sql("SELECT fqn FROM nodes WHERE starts_with(fqn, 'parts.P1') ORDER BY fqn LIMIT 50")
def completion(spark, d):
    return navigate.complete(graph(spark, d), "parts.P1")


@sql("SELECT fqn FROM nodes WHERE contains(fqn, 'A') ORDER BY contains(fqn, '.'), length(fqn), fqn LIMIT 50")
def suggestions(spark, d):
    return navigate.suggest(graph(spark, d).nodes.filter(c("fqn").contains("A"))).select("fqn")


# Aggregates


@sql("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_stats(spark, d):
    return query.stats(graph(spark, d))


@sql("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def kind_histogram(spark, d):
    return query.histogram(graph(spark, d))


@sql("SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY edge_type")
def edge_histogram(spark, d):
    return graph(spark, d).edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@sql("SELECT token, count(*) AS files, min(path) AS first_path FROM tokens GROUP BY token")
def token_postings(spark, d):
    return textindex.posting_heads(textindex.tokenize(Star(spark, d).files()))


@sql("SELECT token, count(DISTINCT path) AS files FROM tokens GROUP BY token")
def posting_sizes(spark, d):
    return textindex.posting_sizes(textindex.tokenize(Star(spark, d).files()))


# The text index

TARGETS = r""", words AS (SELECT item_id, regexp_extract_all(text, '[\pL\pN_]+') AS w FROM benchmark
), targets AS (SELECT DISTINCT w[1] || '.' || w[2] AS fqn, w[2] AS name, w[1] AS context FROM words WHERE len(w) > 1)
"""


def benchmark_targets(spark, d):
    w = F.regexp_extract_all("text", F.lit(textindex.TOKEN_PATTERN), F.lit(0))
    rows = table(spark, d, "benchmark").select(w.alias("w")).filter(F.size("w") > 1)
    return rows.select(F.concat_ws(".", c("w")[0], c("w")[1]).alias("fqn"), c("w")[1].alias("name")).distinct()


@sql(TARGETS + """, sizes AS (SELECT token, count(DISTINCT path) AS n FROM tokens GROUP BY token)
SELECT DISTINCT t.fqn, p.path FROM targets t JOIN tokens p ON p.token = t.name LEFT JOIN sizes s ON s.token = t.context
WHERE coalesce(s.n, 300) >= 300 OR EXISTS (SELECT 1 FROM tokens k WHERE k.token = t.context AND k.path = p.path)
""")
def scout_candidates(spark, d):
    return textindex.scout(benchmark_targets(spark, d), graph(spark, d, True).tokens, cutoff=300, use_context=True)


@sql(TARGETS + "SELECT DISTINCT t.fqn, p.path FROM targets t JOIN tokens p ON p.token = t.name")
def scout_by_name(spark, d):
    return textindex.scout(benchmark_targets(spark, d), graph(spark, d, True).tokens)


LINES = r""", lines AS (SELECT path, doc_id, unnest(string_split(content, chr(10))) AS line_text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM files
), occ AS (SELECT path, line, unnest(regexp_extract_all(line_text, '[\pL\pN_]+')) AS token, generate_subscripts(regexp_extract_all(line_text, '[\pL\pN_]+'), 1) - 1 AS place FROM lines
), blocks AS (SELECT path, path || '#b' || k || '()' AS fqn, k * 4 AS a, k * 4 + 5 AS z FROM (SELECT path, unnest(range(0, CAST(ceil(len(string_split(content, chr(10))) / 4.0) AS BIGINT))) AS k FROM files)
), whole AS (SELECT path, path AS fqn, 0 AS a, len(string_split(content, chr(10))) AS z FROM files)
"""


def block_nodes(files: DataFrame, whole: bool = False) -> DataFrame:
    """Blocks of lines that overlap, as methods, and files as classes."""
    at = lambda a, z, last: F.struct(a.cast("int").alias("start_line"), F.lit(0).alias("start_col"), z.cast("int").alias("end_line"), F.lit(last).alias("end_col"))
    n = F.size(F.split("content", "\n", -1))
    rows = files.select("path", F.explode(F.sequence(F.lit(0), F.ceil(n / 4).cast("int") - 1)).alias("k"))
    blocks = rows.select("path", F.concat("path", F.lit("#b"), "k", F.lit("()")).alias("fqn"), at(c("k") * 4, c("k") * 4 + 5, 1000000).alias("range"), F.lit("method").alias("kind"))
    return blocks.unionByName(files.select("path", c("path").alias("fqn"), at(F.lit(0), n, 1000000).alias("range"), F.lit("class").alias("kind"))) if whole else blocks


@sql(LINES + """, held AS (
  SELECT l.path, l.line, l.line % 7 AS col, b.fqn, (b.z - b.a) * 1000 + 1000000 AS size FROM lines l JOIN (SELECT * FROM blocks UNION ALL SELECT * FROM whole) b ON l.path = b.path AND b.a <= l.line AND l.line <= b.z
)
SELECT path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, arg_min(fqn, {'size': size, 'fqn': fqn}) AS container FROM held GROUP BY ALL
""")
def container_at(spark, d):
    files = Star(spark, d).files()
    points = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "x")).select("path", "line", (c("line") % 7).alias("col"))
    return locate.container_at(points, block_nodes(files, whole=True))


def text_graph(spark, d, symbols: DataFrame) -> Graph:
    """Documents as files of which each token is a use of the symbol tok.<token>; the symbols are declared where they come first."""
    files = Star(spark, d).files()
    symbols = kept(symbols.select("token").distinct(), "symbols")
    occ = kept(textindex.line_occurrences(files).join(symbols, "token", "left_semi").select("path", "token", "line", "place"), "occurrences")
    at = [c("line").alias("start_line"), c("place").alias("start_col"), c("line").alias("end_line"), (c("place") + 1).alias("end_col")]
    occ = occ.select("path", "token", *at, F.concat(F.lit("tok."), "token").alias("resolved_fqn"), F.lit(True).alias("is_call"))
    soon = occ.filter("start_line = 0 AND start_col < 4").groupBy("token").agg(F.min("path").alias("bound"))  # no symbol is declared behind the path of some occurrence
    early = occ.join(kept(symbols.join(soon, "token", "left"), "bounds"), "token").filter("bound IS NULL OR path <= bound")
    first = early.groupBy("token").agg(F.min(F.struct("path", *locate.RANGE_COLUMNS)).alias("p"))
    declared = first.select(F.concat(F.lit("tok."), "token").alias("fqn"), c("token").alias("name"), F.lit("field").alias("kind"), c("p.path").alias("path"), F.struct(*(c(f"p.{x}").alias(x) for x in locate.RANGE_COLUMNS)).alias("range"))
    declared = kept(declared.withColumn("selection_range", c("range")), "declared")
    blocks = block_nodes(files).select("fqn", c("fqn").alias("name"), "kind", "path", "range").withColumn("selection_range", F.lit(None).cast(declared.schema["range"].dataType))
    return Graph(declared.unionByName(blocks), spark.createDataFrame([], EDGE), files, textindex.tokenize(files), occ)


REFERENCES = LINES + TARGETS + """, own AS (SELECT 'tok.' || o.token AS target, o.path, o.line, o.place FROM occ o JOIN (SELECT DISTINCT name FROM targets) t ON o.token = t.name
), declared AS (SELECT target, min({'path': path, 'line': line, 'place': place}) AS p FROM own GROUP BY target
), refs AS (SELECT DISTINCT o.* FROM own o JOIN declared d ON o.target = d.target WHERE {'path': o.path, 'line': o.line, 'place': o.place} <> d.p)
"""


def token_targets(spark, d):
    g = text_graph(spark, d, benchmark_targets(spark, d).select(c("name").alias("token")))
    return g, g.nodes.filter(c("kind") == "field").select("fqn")


@sql(REFERENCES + "SELECT target, path, CAST(line AS INTEGER) AS start_line, CAST(place AS INTEGER) AS start_col FROM refs")
def references_minus_declarations(spark, d):
    return references.find_references(*token_targets(spark, d)).select("target", "path", "start_line", "start_col")


@sql(REFERENCES + "SELECT target, path, CAST(line AS INTEGER) AS start_line, CAST(place AS INTEGER) AS start_col FROM own")
def references_with_declarations(spark, d):
    return references.find_references(*token_targets(spark, d), include_declaration=True).select("target", "path", "start_line", "start_col")


@sql(REFERENCES + """, held AS (SELECT r.target, r.path, r.line, r.place, arg_min(b.fqn, {'size': b.z - b.a, 'fqn': b.fqn}) AS caller FROM refs r JOIN blocks b ON r.path = b.path AND b.a <= r.line AND r.line <= b.z GROUP BY ALL)
SELECT target, caller, count(*) AS ranges FROM held GROUP BY target, caller
""")
def incoming_calls_grouped(spark, d):
    return references.incoming_calls(*token_targets(spark, d)).select("target", "caller", F.size("ranges").cast("long").alias("ranges"))


@sql(REFERENCES + "SELECT b.fqn AS caller, o.target AS callee, count(*) AS ranges FROM own o JOIN blocks b ON o.path = b.path AND b.a <= o.line AND o.line <= b.z GROUP BY ALL")
def outgoing_calls_grouped(spark, d):
    g, _ = token_targets(spark, d)
    return references.outgoing_calls(g, g.nodes.filter(c("kind") == "method")).select("caller", "callee", F.size("ranges").cast("long").alias("ranges"))


@sql(REFERENCES + "SELECT CAST(line AS INTEGER) AS start_line, CAST(place AS INTEGER) AS start_col FROM own WHERE path = 'doc/1' AND target = (SELECT min(target) FROM own WHERE path = 'doc/1')")
def highlights(spark, d):
    g, _ = token_targets(spark, d)
    first = g.occurrences.filter(c("path") == "doc/1").agg(F.min("resolved_fqn").alias("f")).first()["f"]
    return references.highlights(g, "doc/1", first or "").select("start_line", "start_col")


# Longest prefixes and priorities

PAGES = r""", hosts AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), keys AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS fqn, host || rtrim(path, '/') AS file FROM hosts
), routes AS (
  SELECT DISTINCT array_to_string(string_split(fqn, '.')[1:2], '.') AS prefix, 'maven' AS source_type FROM keys
  UNION SELECT array_to_string(string_split(fqn, '.')[1:3], '.'), 'gradle' FROM keys WHERE page_id % 3 = 0
  UNION SELECT fqn, 'jdk' FROM keys WHERE page_id % 5 = 0
), best AS (SELECT DISTINCT fqn, (SELECT max_by(prefix, length(prefix)) FROM routes r WHERE k.fqn = prefix OR starts_with(k.fqn, prefix || '.')) AS prefix FROM keys k
), modules AS (
  SELECT DISTINCT split_part(file, '/', 1) AS path_prefix, 'module:' || split_part(file, '/', 1) AS module_fqn FROM keys
  UNION SELECT array_to_string(string_split(file, '/')[1:2], '/'), 'module:' || array_to_string(string_split(file, '/')[1:2], '/') FROM keys WHERE page_id % 2 = 0 AND contains(file, '/')
)
"""


def page_keys(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    path = F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("fqn"), F.concat(host, F.rtrim(path, F.lit("/"))).alias("file"))


def page_routes(spark, d):
    k = page_keys(spark, d)
    parts = F.split("fqn", r"\.")
    cut = lambda df, p, s: df.select(p.alias("prefix"), F.lit(s).alias("source_type"))
    rows = cut(k, F.array_join(F.slice(parts, 1, 2), "."), "maven").union(cut(k.filter("page_id % 3 = 0"), F.array_join(F.slice(parts, 1, 3), "."), "gradle")).union(cut(k.filter("page_id % 5 = 0"), c("fqn"), "jdk"))
    return assets.register(rows.withColumn("asset_path", F.concat(F.lit("/cache/"), "prefix", F.lit(".jar"))))


def page_modules(spark, d):
    k = page_keys(spark, d)
    cut = lambda df, n: df.select(F.array_join(F.slice(F.split("file", "/"), 1, n), "/").alias("path_prefix"))
    rows = cut(k, 1).union(cut(k.filter("page_id % 2 = 0").filter(c("file").contains("/")), 2)).distinct()
    return rows.withColumn("module_fqn", F.concat(F.lit("module:"), "path_prefix"))


@sql(PAGES + "SELECT DISTINCT b.fqn, r.prefix, r.source_type FROM best b JOIN routes r USING (prefix)")
def longest_prefix_route(spark, d):
    return match.longest_prefix(page_keys(spark, d).select("fqn").distinct(), page_routes(spark, d)).select("fqn", "prefix", "source_type")


@sql(PAGES + "SELECT DISTINCT b.fqn, r.prefix FROM best b JOIN routes r USING (prefix) WHERE source_type = 'jdk'")
def route_by_source(spark, d):
    return assets.lookup(page_keys(spark, d).select("fqn").distinct(), page_routes(spark, d), "jdk").select("fqn", "prefix")


@sql(PAGES + "SELECT source_type, count(*) AS entries, (SELECT count(DISTINCT prefix) FROM routes) AS prefixes FROM routes GROUP BY source_type")
def registry_stats(spark, d):
    return assets.registry_stats(page_routes(spark, d))


@sql(PAGES + """, files_at AS (SELECT DISTINCT file || '/index.html' AS path, file AS directory FROM keys)
SELECT path, (SELECT max_by(module_fqn, length(path_prefix)) FROM modules m WHERE f.directory = path_prefix OR starts_with(f.directory, path_prefix || '/')) AS module_fqn FROM files_at f
""")
def file_to_module(spark, d):
    files = page_keys(spark, d).select(F.concat("file", F.lit("/index.html")).alias("path")).distinct()
    return match.module_of(files, page_modules(spark, d))


@sql(PAGES + """, root AS (SELECT arg_min(module_fqn, {'d': len(string_split(path_prefix, '/')), 'p': path_prefix}) AS root FROM modules
), near AS (SELECT m.module_fqn, (SELECT max_by(o.module_fqn, length(o.path_prefix)) FROM modules o WHERE m.path_prefix <> o.path_prefix AND starts_with(m.path_prefix, o.path_prefix || '/')) AS up FROM modules m)
SELECT module_fqn, coalesce(up, CASE WHEN root <> module_fqn THEN root END) AS parent FROM near, root
""")
def module_hierarchy(spark, d):
    return match.module_parents(page_modules(spark, d))


NAMES = """, contexts AS (SELECT n_nationkey AS context_id, f AS package, ['parts.P' || n_nationkey, 'types.*', 'brands.*'] AS imports FROM nation_f
), names AS (SELECT n_nationkey AS context_id, unnest(['P' || n_nationkey, 'ECONOMY', 'S' || n_nationkey, 'C' || n_nationkey, 'AFRICA', 'Zed', 'int', 'String', 'Brand_2']) AS name FROM nation)
"""


def name_contexts(spark, d):
    star = Star(spark, d)
    contexts = star.nation.select(c("n_nationkey").alias("context_id"), c("f").alias("package"), F.array(F.concat(F.lit("parts.P"), "n_nationkey"), F.lit("types.*"), F.lit("brands.*")).alias("imports"))
    listed = F.array(*(F.concat(F.lit(p), "n_nationkey") for p in "PSC"), *map(F.lit, ("ECONOMY", "AFRICA", "Zed", "int", "String", "Brand_2")))
    return star.nation.select(c("n_nationkey").alias("context_id"), F.explode(listed).alias("name")), contexts, star


@sql(NAMES + """, candidates AS (
  SELECT n.context_id, n.name, i AS fqn, 1 AS rule FROM names n JOIN (SELECT context_id, unnest(imports) AS i FROM contexts) x USING (context_id) WHERE list_last(string_split(i, '.')) = n.name
  UNION ALL SELECT n.context_id, n.name, package || '.' || n.name, 2 FROM names n JOIN contexts USING (context_id)
  UNION ALL SELECT n.context_id, n.name, replace(i, '*', '') || n.name, 3 FROM names n JOIN (SELECT context_id, unnest(imports) AS i FROM contexts) x USING (context_id) WHERE ends_with(i, '.*')
  UNION ALL SELECT context_id, name, 'java.lang.' || name, 4 FROM names UNION ALL SELECT context_id, name, name, 5 FROM names
)
SELECT context_id, name, arg_min(fqn, {'rule': rule, 'fqn': fqn}) AS fqn, CAST(min(rule) AS INTEGER) AS rule FROM candidates WHERE fqn IN (SELECT fqn FROM nodes) GROUP BY context_id, name
""")
def name_priority_resolution(spark, d):
    names, contexts, star = name_contexts(spark, d)
    return match.resolve_names(names, contexts, star.nodes())


@sql(NAMES + "SELECT context_id, name, CASE WHEN name = 'int' THEN name WHEN name = 'P' || context_id THEN 'parts.' || name WHEN name = 'String' THEN 'java.lang.String' ELSE package || '.' || name END AS fqn FROM names JOIN contexts USING (context_id)")
def name_heuristic_resolution(spark, d):
    names, contexts, _ = name_contexts(spark, d)
    return match.guess_names(names, contexts)


# Hierarchies


@sql("SELECT start, reached, CAST(depth AS INTEGER) AS depth FROM ancestors")
def ancestors(spark, d):
    return traverse.ancestors(graph(spark, d))


@sql("SELECT reached AS start, start AS reached, CAST(depth AS INTEGER) AS depth FROM ancestors")
def descendants(spark, d):
    return traverse.descendants(graph(spark, d))


@sql("SELECT start, reached, CAST(depth AS INTEGER) AS depth FROM ancestors QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, reached) <= 3")
def ancestors_capped(spark, d):
    return traverse.ancestors(graph(spark, d), compat_max_nodes=3)


@sql("SELECT dst AS fqn, src AS other FROM edges WHERE edge_type = 'Implements'")
def direct_subtypes(spark, d):
    return traverse.direct(graph(spark, d), "Implements", rev=True)


@sql(""", pairs AS (SELECT f AS sub, up || '.t0' AS sup FROM turns_f UNION SELECT up || '.t0', f FROM turns_f
), reach AS (SELECT a AS start, b AS reached FROM super UNION SELECT r.start, s.b FROM reach r JOIN super s ON s.a = r.reached)
SELECT p.sub, p.sup, p.sub = p.sup OR r.start IS NOT NULL AS is_subtype FROM pairs p LEFT JOIN reach r ON r.start = p.sub AND r.reached = p.sup""")
def is_subtype_pairs(spark, d):
    star = Star(spark, d)
    top = F.concat("up", F.lit(".t0"))
    pairs = star.turns.select(c("f").alias("sub"), top.alias("sup")).union(star.turns.select(top, "f")).distinct()
    return traverse.is_subtype(pairs, traverse.closure(star.edges(), starts=pairs.select(c("sub").alias("fqn")), max_depth=None))


@sql(""", targets AS (SELECT f AS target FROM supplier_f UNION SELECT f || '#' || role || '()' FROM turns_f WHERE turn = 0)
SELECT DISTINCT target, start AS fqn FROM targets JOIN ancestors ON reached = target
UNION SELECT target, min(m.fqn) FROM targets t JOIN ancestors a ON a.reached = regexp_extract(t.target, '^(.*)#', 1) JOIN members m ON m.owner_fqn = a.start AND m.simple_name = regexp_extract(t.target, '#([^(]*)', 1) WHERE contains(target, '#') GROUP BY target, m.owner_fqn
""")
def implementations(spark, d):
    star = Star(spark, d)
    targets = star.supplier.select(c("f").alias("fqn")).union(star.turns.filter("turn = 0").select(F.concat("f", F.lit("#"), "role", F.lit("()"))))
    return traverse.implementations(star.graph(), targets)


@sql(""", requests AS (SELECT f AS type, unnest(['system', 'user', 'assistant']) AS simple_name FROM turns_f
), lines AS (SELECT type, simple_name, type AS owner_fqn, 0 AS depth FROM requests UNION ALL SELECT r.type, r.simple_name, a.reached, a.depth FROM requests r JOIN ancestors a ON a.start = r.type)
SELECT type, l.simple_name, arg_min(m.fqn, {'depth': depth, 'fqn': m.fqn}) AS fqn, CAST(min(depth) AS INTEGER) AS depth FROM lines l JOIN members m ON m.owner_fqn = l.owner_fqn AND m.simple_name = l.simple_name GROUP BY type, l.simple_name
""")
def member_in_hierarchy(spark, d):
    star = Star(spark, d)
    requests = star.turns.select(c("f").alias("type"), F.explode(F.array(*map(F.lit, ("system", "user", "assistant")))).alias("simple_name"))
    return traverse.member_in_hierarchy(star.graph(), requests)


@sql("SELECT owner_fqn, simple_name, fqn, kind FROM members")
def members_of_types(spark, d):
    return traverse.members(graph(spark, d))


# Symbols by intent, name, file and position


@sql("SELECT fqn, kind, kind IN ('class', 'interface', 'enum', 'annotation') AS as_type, kind IN ('method', 'constructor') AS as_method, kind = 'field' AS as_field, false AS as_variable, true AS as_unknown FROM nodes")
def intent_kinds(spark, d):
    return graph(spark, d).nodes.select("fqn", "kind", *(query.fits_intent(c("kind"), i).alias(f"as_{i}") for i in ("type", "method", "field", "variable", "unknown")))


@sql("SELECT name, count(*) AS n, min(fqn) AS first, max(fqn) AS last FROM nodes WHERE name IS NOT NULL GROUP BY name")
def nodes_by_name(spark, d):
    return query.grouped(graph(spark, d).nodes, "name")


@sql("SELECT path, count(*) AS n, min(fqn) AS first, max(fqn) AS last FROM nodes WHERE path IS NOT NULL GROUP BY path")
def nodes_by_file(spark, d):
    return query.grouped(graph(spark, d).nodes, "path")


@sql("""SELECT path, token, count(DISTINCT line) AS lines, min(place) AS first_place FROM (
  SELECT path, line, unnest(regexp_extract_all(line_text, '[\\pL\\pN_]+')) AS token, generate_subscripts(regexp_extract_all(line_text, '[\\pL\\pN_]+'), 1) - 1 AS place
  FROM (SELECT path, unnest(string_split(content, chr(10))) AS line_text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)) GROUP BY path, token""".replace("\\\\", "\\"))
def occurrences_by_file(spark, d):
    return textindex.tokens_of_files(Star(spark, d).files())


@sql("""SELECT doc_id, CAST(CASE WHEN doc_id % 40 <= length(l) THEN strlen(left(l, CAST(doc_id % 40 AS INTEGER))) END AS INTEGER) AS byte_col,
  CAST(CASE WHEN len(ls) > 1 AND doc_id % 40 <= length(ls[2]) THEN strlen(l) + 1 + strlen(left(ls[2], CAST(doc_id % 40 AS INTEGER))) END AS BIGINT) AS byte_offset
FROM (SELECT doc_id, string_split(content, chr(10)) AS ls, string_split(content, chr(10))[1] AS l FROM files WHERE content IS NOT NULL)""")
def editor_positions(spark, d):
    lines, col = F.split("content", "\n", -1), (c("doc_id") % 40).cast("int")
    files = Star(spark, d).files().filter(c("content").isNotNull())
    return files.select("doc_id", locate.byte_column(F.get(lines, F.lit(0)), col).alias("byte_col"), locate.byte_offset(c("content"), F.lit(1), col).alias("byte_offset"))


@sql("""SELECT doc_id, CASE WHEN doc_id % 40 <= length(l) THEN nullif(regexp_extract(left(l, CAST(doc_id % 40 AS INTEGER)), '[\\pL\\pN_]*$') || regexp_extract(substr(l, CAST(doc_id % 40 AS INTEGER) + 1), '^[\\pL\\pN_]*'), '') END AS word
FROM (SELECT doc_id, string_split(content, chr(10))[1] AS l FROM files WHERE content IS NOT NULL)""".replace("\\\\", "\\"))
def word_at_position(spark, d):
    files = Star(spark, d).files().filter(c("content").isNotNull())
    return files.select("doc_id", locate.word_at(F.get(F.split("content", "\n", -1), F.lit(0)), c("doc_id") % 40).alias("word"))


# Maintenance


@sql(", known AS (SELECT fqn FROM nodes WHERE source = 'project') SELECT DISTINCT dst AS fqn, dst AS name, 'class' AS kind, 'external' AS source, 'unresolved' AS status FROM edges WHERE src IN (SELECT fqn FROM known) AND dst NOT IN (SELECT fqn FROM known)")
def placeholder_creation(spark, d):
    g = graph(spark, d)
    return maintain.bind_edges(g.edges, g.nodes.filter(c("source") == "project"))[1].select("fqn", "name", "kind", "source", "status")


@sql(", known AS (SELECT fqn FROM nodes WHERE source = 'project') SELECT edge_type, count(*) AS n FROM (SELECT DISTINCT * FROM edges WHERE src IN (SELECT fqn FROM known)) GROUP BY edge_type")
def bound_edges(spark, d):
    g = graph(spark, d)
    return maintain.bind_edges(g.edges, g.nodes.filter(c("source") == "project"))[0].groupBy("edge_type").agg(F.count("*").alias("n"))


@sql(""", old AS (SELECT * FROM nodes WHERE kind = 'class' AND source = 'project'), new AS (SELECT fqn, 'renamed' AS name, 'enum' AS kind, 'moved.java' AS path FROM old WHERE fqn LIKE '%7' UNION ALL SELECT fqn, name, kind, path FROM nodes WHERE kind = 'interface')
SELECT coalesce(o.fqn, n.fqn) AS fqn, coalesce(o.name, n.name) AS name, coalesce(n.kind, o.kind) AS kind, coalesce(o.path, n.path) AS path FROM old o FULL JOIN new n ON o.fqn = n.fqn
""")
def upsert_merge(spark, d):
    nodes = graph(spark, d).nodes.withColumn("range", F.lit(None)).withColumn("selection_range", F.lit(None))
    old = nodes.filter((c("kind") == "class") & (c("source") == "project"))
    new = old.filter(c("fqn").endswith("7")).withColumn("name", F.lit("renamed")).withColumn("kind", F.lit("enum")).withColumn("path", F.lit("moved.java"))
    return maintain.upsert(old, new.unionByName(nodes.filter(c("kind") == "interface"))).select("fqn", "name", "kind", "path")


@sql("""SELECT kind AS what, count(*) AS n FROM nodes WHERE coalesce(path, '') <> 'src/ASIA/NATION_2.java' GROUP BY kind
UNION ALL SELECT edge_type, count(*) FROM edges e LEFT JOIN (SELECT DISTINCT fqn, path FROM nodes) s ON e.src = s.fqn WHERE coalesce(s.path, '') <> 'src/ASIA/NATION_2.java' GROUP BY edge_type""")
def remove_path(spark, d):
    g = graph(spark, d)
    owned = g.edges.join(g.nodes.select(c("fqn").alias("src"), c("path").alias("src_path")).distinct(), "src", "left")
    left = maintain.remove_paths(Graph(g.nodes, owned), spark.createDataFrame([("src/ASIA/NATION_2.java",)], "path string"))
    return left.nodes.groupBy(c("kind").alias("what")).agg(F.count("*").alias("n")).union(left.edges.groupBy("edge_type").agg(F.count("*").alias("n")))


def versions(spark, d):
    """Documents now and as they were: a third had another text, half another time, and those with ids divisible by seven weren't there."""
    now = Star(spark, d).files(".txt").withColumn("last_modified", F.lit(200).cast("long"))
    was = now.filter("doc_id % 7 != 0").withColumn("content", F.when(c("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(c("content"))).withColumn("last_modified", F.when(c("doc_id") % 2 == 0, 100).otherwise(200).cast("long"))
    return maintain.with_hash(was), maintain.with_hash(now)


@sql("SELECT 'doc/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def changed_files(spark, d):
    return maintain.changed(*versions(spark, d)).select("path")


@sql("SELECT 'doc/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 7 = 0")
def deleted_files(spark, d):
    was, now = versions(spark, d)
    return maintain.deleted(now, was)


@sql("SELECT DISTINCT src, dst, edge_type FROM edges WHERE edge_type IN ('InheritsFrom', 'Implements', 'DecoratedBy')")
def distinct_edges(spark, d):
    e = graph(spark, d).edges.filter(c("edge_type").isin("InheritsFrom", "Implements", "DecoratedBy"))
    return e.unionByName(e).dropDuplicates(["src", "dst", "edge_type"])


# Streams


@sql(""", marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT CAST(user_id AS VARCHAR) AS root, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS flush_ts, count(*) AS events FROM numbered GROUP BY user_id, k
""")
def debounce_sessions(spark, d):
    events = table(spark, d, "events").select(c("user_id").cast("string").alias("root"), c("event_type").alias("path"), "ts")
    return watch.sessions(events, "6 hours").select("root", "first_ts", "flush_ts", "events")


# What is shown


@sql("""SELECT fqn AS id, coalesce(array_to_string(modifiers, ' '), '') AS modifiers,
  '*Defined in `' || CASE WHEN contains(fqn, '#') THEN regexp_extract(fqn, '^(.*)#', 1) ELSE regexp_extract(fqn, '^(.*)\\.', 1) END || '`*' AS detail,
  CASE kind WHEN 'method' THEN name || '(' || CASE WHEN varargs IS NULL THEN '' WHEN varargs THEN 'status: String...' ELSE 'status: String' END || ') -> ' || coalesce(replace(type_display, 'java.util.', ''), 'void') WHEN 'class' THEN 'class ' || name WHEN 'interface' THEN 'interface ' || name ELSE '@interface ' || name END AS signature
FROM nodes WHERE kind IN ('method', 'class', 'interface', 'annotation')""".replace("\\\\", "\\"))
def display_projection(spark, d):
    shown = present.display(graph(spark, d).nodes.filter(c("kind").isin("method", "class", "interface", "annotation")).withColumn("range", F.lit(None).cast("struct<start_line:int>")))
    return shown.select("id", F.coalesce("modifiers", F.lit("")).alias("modifiers"), "detail", "signature")


@sql("SELECT fqn, kind, CAST(CASE kind WHEN 'package' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 3 WHEN 'annotation' THEN 5 WHEN 'method' THEN 7 ELSE 99 END AS INTEGER) AS weight, name || CASE WHEN kind = 'method' THEN '' ELSE '/' END AS listed FROM nodes")
def kind_weight_listing(spark, d):
    return present.listing(graph(spark, d).nodes).select("fqn", "kind", "weight", naming.listed_name(c("name"), c("kind")).alias("listed"))


@sql(", p AS (SELECT fqn, string_split(fqn, '.') AS s FROM nodes) SELECT fqn, CASE WHEN len(s) <= 2 THEN fqn ELSE array_to_string(list_transform(s[1:len(s) - 2], lambda x: x[1]), '.') || '.' || s[len(s) - 1] || '.' || s[len(s)] END AS short FROM p")
def fqn_shortening(spark, d):
    return graph(spark, d).nodes.select("fqn", naming.shorten(c("fqn")).alias("short"))


@sql(r"""SELECT fqn, CASE WHEN contains(fqn, '#') THEN regexp_extract(fqn, '^(.*)#', 1) END AS owner, CASE WHEN contains(fqn, '#') THEN regexp_extract(fqn, '#([^#]*)$', 1) END AS member,
  regexp_replace(fqn, '\(.*\)$', '') AS stripped, list_last(regexp_split_to_array(regexp_replace(fqn, '\(.*\)$', ''), '[.:#]')) AS simple, contains(fqn, '#') AS has_signature FROM nodes""")
def naming_functions(spark, d):
    f = c("fqn")
    return graph(spark, d).nodes.select(f, naming.member_owner(f).alias("owner"), naming.member_name(f).alias("member"), naming.strip_signature(f).alias("stripped"), naming.simple_name(f).alias("simple"), naming.has_signature(f).alias("has_signature"))


@sql(r"""SELECT fqn, array_to_string(list_filter(regexp_split_to_array(fqn, '[^\pL\pN_]+'), lambda x: x <> ''), ' ') AS tokens,
  CASE WHEN len(t) > 1 AND t[len(t)] = name THEN t[len(t) - 1] END AS context FROM (SELECT *, list_filter(regexp_split_to_array(fqn, '[^\pL\pN_]+'), lambda x: x <> '') AS t FROM nodes)""")
def fqn_token_split(spark, d):
    f = c("fqn")
    return graph(spark, d).nodes.select(f, F.array_join(naming.fqn_tokens(f), " ").alias("tokens"), naming.scouting_context(f, c("name")).alias("context"))


@sql(", q AS (SELECT path, CAST(doc_id AS INTEGER) AS line FROM files) SELECT path, list_last(string_split(path, '/')) || ':' || (line + 1) AS location FROM q")
def location_text(spark, d):
    return Star(spark, d).files().select("path", naming.location_text(c("path"), c("doc_id").cast("int")).alias("location"))


@sql("""SELECT doc_id, CASE WHEN n_chars * 900 < 1024 THEN n_chars * 900 || ' B' WHEN n_chars * 900 < 1048576 THEN floor(n_chars * 9000 / 1024.0 + 0.5) / 10 || ' KB' ELSE floor(n_chars * 9000 / 1048576.0 + 0.5) / 10 || ' MB' END AS size,
  CASE WHEN doc_id * 61 < 60 THEN 'just now' WHEN doc_id * 61 < 3600 THEN doc_id * 61 // 60 || 'm ago' WHEN doc_id * 61 < 86400 THEN doc_id * 61 // 3600 || 'h ago' ELSE doc_id * 61 // 86400 || 'd ago' END AS age FROM documents""")
def human_size_and_age(spark, d):
    return table(spark, d, "documents").select("doc_id", naming.human_size(c("n_chars") * 900).alias("size"), naming.age(c("doc_id") * 61).alias("age"))


@sql(r"""SELECT page_id, CASE lower(regexp_extract(f, '\.([^.]+)$', 1)) WHEN '' THEN NULL WHEN 'kt' THEN 'kotlin' WHEN 'py' THEN 'python' ELSE lower(regexp_extract(f, '\.([^.]+)$', 1)) END AS lang, NOT (starts_with(f, '.') OR f IN ('target', 'build', 'node_modules')) AS relevant
FROM (SELECT page_id, list_last(string_split(url, '/')) AS f FROM pages)""")
def language_detection(spark, d):
    return table(spark, d, "pages").select("page_id", naming.language_of(c("url")).alias("lang"), naming.relevant(c("url")).alias("relevant"))


@sql("SELECT fqn, kind, CAST(CASE kind WHEN 'package' THEN 4 WHEN 'class' THEN 5 WHEN 'interface' THEN 11 WHEN 'annotation' THEN 11 WHEN 'method' THEN 6 END AS INTEGER) AS symbol_kind FROM nodes WHERE path = 'src/ASIA/NATION_2.java'")
def document_symbols(spark, d):
    g = graph(spark, d)
    nodes = g.nodes.withColumn("range", F.lit(None)).withColumn("selection_range", F.lit(None))
    return references.document_symbols(Graph(nodes, g.edges), "src/ASIA/NATION_2.java").select("fqn", "kind", "symbol_kind")


# Builds and assets

BUILDS = """, builds AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'implementation' WHEN 1 THEN 'api' WHEN 2 THEN 'testImplementation' ELSE 'compileOnly' END AS how FROM nation)
"""


def build_files(spark, d):
    n = c("n_nationkey")
    how = F.element_at(F.array(*map(F.lit, ("implementation", "api", "testImplementation", "compileOnly"))), (n % 4 + 1).cast("int"))
    text = F.format_string("plugins { id 'java' }\n// implementation 'no:comment:1'\ndependencies {\n    %s 'org.%s:lib%d:1.%d'\n    implementation(\"a.b:c:2\")\n    runtimeOnly 'two:parts'\n    api project(':mod%d')\n}\n", how, F.lower("n_name"), n, n, n % 5)
    return Star(spark, d).nation.select(F.concat(F.lit("mods/m"), n, F.lit("/build.gradle")).alias("path"), text.alias("content"))


@sql(BUILDS + """SELECT 'mods/m' || n_nationkey || '/build.gradle' AS path, how AS configuration, 'org.' || lower(n_name) AS "group", 'lib' || n_nationkey AS name, '1.' || n_nationkey AS version, false AS is_project FROM builds JOIN nation USING (n_nationkey)
UNION ALL SELECT 'mods/m' || n_nationkey || '/build.gradle', 'implementation', 'a.b', 'c', '2', false FROM builds
UNION ALL SELECT 'mods/m' || n_nationkey || '/build.gradle', 'api', NULL, ':mod' || n_nationkey % 5, NULL, true FROM builds""")
def gradle_dependencies(spark, d):
    return gradle.dependencies(build_files(spark, d))


@sql(BUILDS + """SELECT 'mods/m' || n_nationkey AS src, 'dep:org.' || lower(n_name) || ':lib' || n_nationkey || ':1.' || n_nationkey AS dst FROM builds JOIN nation USING (n_nationkey)
UNION ALL SELECT 'mods/m' || n_nationkey, 'dep:a.b:c:2' FROM builds UNION ALL SELECT 'mods/m' || n_nationkey, 'mod' || n_nationkey % 5 FROM builds""")
def dependency_edges(spark, d):
    _, edges = gradle.dependency_graph(gradle.dependencies(build_files(spark, d)))
    return edges.select("src", "dst")


STUBS = """, stubs AS (SELECT p_partkey % 97 AS asset_hash, '/cache/a' || p_partkey % 97 || '.jar' AS asset_path, f AS fqn, lower(p_type) AS type_tag, p_partkey AS created_at FROM part_f)
"""


def stub_rows(spark, d):
    part = Star(spark, d).part
    return part.select((c("p_partkey") % 97).alias("asset_hash"), F.concat(F.lit("/cache/a"), c("p_partkey") % 97, F.lit(".jar")).alias("asset_path"), c("f").alias("fqn"), F.lower("p_type").alias("type_tag"), c("p_partkey").alias("created_at"))


@sql(STUBS + "SELECT asset_hash, min(asset_path) AS asset_path, count(*) AS entries, min(created_at) AS created_at FROM stubs GROUP BY asset_hash")
def asset_summary(spark, d):
    return assets.summaries(stub_rows(spark, d))


@sql(STUBS + "SELECT count(DISTINCT asset_hash) AS assets, count(*) AS entries FROM stubs")
def cache_stats(spark, d):
    return assets.cache_stats(stub_rows(spark, d))


@sql(STUBS + "SELECT type_tag, count(*) AS n FROM stubs WHERE CAST(asset_hash AS VARCHAR) LIKE '1%' GROUP BY type_tag")
def stub_inspect(spark, d):
    return assets.inspect(stub_rows(spark, d), "1")[0]


@sql(PAGES + """, wanted AS (SELECT DISTINCT fqn FROM keys WHERE page_id % 2 = 0), cached AS (SELECT DISTINCT fqn FROM keys WHERE page_id % 6 = 0)
SELECT w.fqn, b.prefix FROM wanted w JOIN best b USING (fqn) WHERE b.prefix IS NOT NULL AND w.fqn NOT IN (SELECT fqn FROM cached)""")
def stub_planning(spark, d):
    k = page_keys(spark, d)
    plan = assets.plan_stubs(k.filter("page_id % 2 = 0").select("fqn"), page_routes(spark, d), k.filter("page_id % 6 = 0").select("fqn"))
    return plan.select("fqn", "prefix").distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate files, verified occurrences, declarations out, in order of place."""
    return locate.sorted_references(references_minus_declarations(spark, sf_dir))
