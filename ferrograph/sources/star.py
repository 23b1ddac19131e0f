"""The driver's tables seen as a project: regions and nations are packages, customers classes, suppliers interfaces, orders methods;
parts are external classes with types and brands; turns of conversations are classes that each inherit from the turn before;
documents are files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrograph.operators import textindex
from ferrograph.schema import NODE, Graph

KINDS = {f.name: f.dataType for f in NODE.fields}
COLUMNS = ("fqn", "parent_fqn", "name", "kind", "lang", "source", "status", "path", "modifiers", "type_display", "parameters")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_rows(df: DataFrame, fqn: Column, name: Column, kind: str, parent: Column | None = None, source: str = "project", **more: Column) -> DataFrame:
    given = {"fqn": fqn, "parent_fqn": parent, "name": name, "kind": F.lit(kind), "lang": F.lit("java"), "source": F.lit(source), "status": F.lit("resolved"), **more}
    return df.select(*((given[c] if given.get(c) is not None else F.lit(None)).cast(KINDS[c]).alias(c) for c in COLUMNS))


class Star:
    """Frames with each table's FQN as ``f``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        t = lambda n: table(spark, sf_dir, n)
        c = F.col
        self.region = t("region").select("*", c("r_name").alias("f"))
        self.nation = t("nation").join(self.region.select("r_regionkey", c("f").alias("up")), c("n_regionkey") == c("r_regionkey")).withColumn("f", F.concat_ws(".", "up", "n_name"))
        places = self.nation.select("n_nationkey", c("f").alias("up"))
        self.customer = t("customer").join(places, c("c_nationkey") == c("n_nationkey")).withColumn("f", F.concat("up", F.lit(".C"), "c_custkey"))
        self.supplier = t("supplier").join(places, c("s_nationkey") == c("n_nationkey")).withColumn("f", F.concat("up", F.lit(".S"), "s_suppkey"))
        self.orders = t("orders").join(self.customer.select("c_custkey", c("f").alias("up"), c("up").alias("place")), c("o_custkey") == c("c_custkey")).withColumn("f", F.concat("up", F.lit("#o"), "o_orderkey", F.lit("()")))
        self.part = t("part").withColumn("f", F.concat(F.lit("parts.P"), "p_partkey")).withColumn("type_f", F.concat(F.lit("types."), "p_type")).withColumn("brand_f", F.concat(F.lit("brands."), F.replace("p_brand", F.lit("#"), F.lit("_"))))
        self.lineitem = t("lineitem")
        by = Window.partitionBy("conv_id").orderBy("turn")
        turn = F.concat(F.lit("conv"), "conv_id", F.lit(".t"), "turn")
        self.turns = t("conversations").withColumn("f", turn).withColumn("up", F.concat(F.lit("conv"), "conv_id")).withColumn("before", F.lag(turn).over(by))

    def nodes(self) -> DataFrame:
        c, named = F.col, lambda p, k: F.concat(F.lit(p), F.col(k))
        path = F.concat(F.lit("src/"), F.replace("up", F.lit("."), F.lit("/")), F.lit(".java"))
        order_path = F.concat(F.lit("src/"), F.replace("place", F.lit("."), F.lit("/")), F.lit(".java"))
        parameter = F.array(F.struct(F.lit("status").alias("name"), F.lit("java.lang.String").alias("type_display"), F.lit("java.lang.String").alias("type_erased"), (c("o_orderstatus") == "F").alias("is_varargs")))
        parts = [
            node_rows(self.region, c("f"), c("f"), "package"),
            node_rows(self.nation, c("f"), c("n_name"), "package", c("up")),
            node_rows(self.customer, c("f"), named("C", "c_custkey"), "class", c("up"), path=path, modifiers=F.array(F.lit("public"), F.lower("c_mktsegment"))),
            node_rows(self.supplier, c("f"), named("S", "s_suppkey"), "interface", c("up"), path=path, modifiers=F.array(F.lit("public"))),
            node_rows(self.orders, c("f"), named("o", "o_orderkey"), "method", c("up"), path=order_path, modifiers=F.array(F.when(c("o_orderstatus") == "O", "public").otherwise("private")), type_display=F.concat(F.lit("java.util."), F.substring_index("o_orderpriority", "-", -1)), parameters=parameter),
            node_rows(self.part, c("f"), named("P", "p_partkey"), "class", source="external"),
            node_rows(self.part.select("type_f", "p_type").distinct(), c("type_f"), c("p_type"), "interface"),
            node_rows(self.part.select("brand_f").distinct(), c("brand_f"), F.substring_index("brand_f", ".", -1), "annotation"),
            node_rows(self.turns, c("f"), named("t", "turn"), "class", c("up")),
            node_rows(self.turns, F.concat("f", F.lit("#"), "role", F.lit("()")), c("role"), "method", c("f")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def lines(self, key: str) -> DataFrame:
        """Distinct ``(f, key)`` of orders' lines. Each FQN holds its key, so that keys are made distinct, where they are to be joined, and not names."""
        c = F.col
        owners = self.customer.select("c_custkey", c("f").alias("up")).repartition("c_custkey").distinct()
        orders = table(self.spark, self.dir, "orders").select("o_orderkey", "o_custkey").repartition("o_custkey").distinct()
        methods = orders.join(owners, c("o_custkey") == c("c_custkey")).select("o_orderkey", F.concat("up", F.lit("#o"), "o_orderkey", F.lit("()")).alias("f"))
        return self.lineitem.select("l_orderkey", key).repartition("l_orderkey").distinct().join(methods, c("l_orderkey") == c("o_orderkey")).select("f", key)

    def edges(self) -> DataFrame:
        c = F.col
        make = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
        suppliers = self.supplier.select("s_suppkey", c("f").alias("s"))
        typed, used = self.lines("l_partkey"), self.lines("l_suppkey").join(suppliers.distinct(), c("l_suppkey") == c("s_suppkey"))
        parts = [
            make(self.nation, c("up"), c("f"), "Contains"),
            make(self.customer, c("up"), c("f"), "Contains"),
            make(self.supplier, c("up"), c("f"), "Contains"),
            make(self.orders, c("up"), c("f"), "Contains"),
            make(typed, c("f"), F.concat(F.lit("parts.P"), "l_partkey"), "TypedAs"),
            make(used, c("f"), c("s"), "UsesDependency"),
            make(self.customer.join(suppliers, c("s_suppkey") == c("c_custkey") % 10), c("f"), c("s"), "Implements"),
            make(self.part, c("f"), c("type_f"), "InheritsFrom"),
            make(self.part, c("f"), c("brand_f"), "DecoratedBy"),
            make(self.turns, c("f"), F.concat("f", F.lit("#"), "role", F.lit("()")), "Contains"),
            make(self.turns.filter("before IS NOT NULL"), c("f"), c("before"), "InheritsFrom"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def files(self, extension: str = "") -> DataFrame:
        return table(self.spark, self.dir, "documents").select(F.concat(F.lit("doc/"), "doc_id", F.lit(extension)).alias("path"), F.col("text").alias("content"), "doc_id")

    def graph(self, text: bool = False) -> Graph:
        files = self.files() if text else None
        return Graph(self.nodes(), self.edges(), files, textindex.tokenize(files) if text else None)


#: The same tables as SQL; every query of the catalogue begins with them.
SQL = r"""WITH RECURSIVE nation_f AS (SELECT n_nationkey, n_name, r_name AS up, r_name || '.' || n_name AS f FROM nation JOIN region ON n_regionkey = r_regionkey
), customer_f AS (SELECT c.*, n.f AS up, n.f || '.C' || c_custkey AS f FROM customer c JOIN nation_f n ON c_nationkey = n_nationkey
), supplier_f AS (SELECT s.*, n.f AS up, n.f || '.S' || s_suppkey AS f FROM supplier s JOIN nation_f n ON s_nationkey = n_nationkey
), orders_f AS (SELECT o.*, c.f AS up, c.up AS place, c.f || '#o' || o_orderkey || '()' AS f FROM orders o JOIN customer_f c ON o_custkey = c_custkey
), part_f AS (SELECT *, 'parts.P' || p_partkey AS f, 'types.' || p_type AS type_f, 'brands.' || replace(p_brand, '#', '_') AS brand_f FROM part
), turns_f AS (SELECT *, 'conv' || conv_id || '.t' || turn AS f, 'conv' || conv_id AS up, 'conv' || conv_id || '.t' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations
), nodes AS (
  SELECT r_name AS fqn, CAST(NULL AS VARCHAR) AS parent_fqn, r_name AS name, 'package' AS kind, 'project' AS source, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR[]) AS modifiers, CAST(NULL AS VARCHAR) AS type_display, CAST(NULL AS BOOLEAN) AS varargs FROM region
  UNION ALL SELECT f, up, n_name, 'package', 'project', NULL, NULL, NULL, NULL FROM nation_f
  UNION ALL SELECT f, up, 'C' || c_custkey, 'class', 'project', 'src/' || replace(up, '.', '/') || '.java', ['public', lower(c_mktsegment)], NULL, NULL FROM customer_f
  UNION ALL SELECT f, up, 'S' || s_suppkey, 'interface', 'project', 'src/' || replace(up, '.', '/') || '.java', ['public'], NULL, NULL FROM supplier_f
  UNION ALL SELECT f, up, 'o' || o_orderkey, 'method', 'project', 'src/' || replace(place, '.', '/') || '.java', [CASE WHEN o_orderstatus = 'O' THEN 'public' ELSE 'private' END], 'java.util.' || split_part(o_orderpriority, '-', 2), o_orderstatus = 'F' FROM orders_f
  UNION ALL SELECT f, NULL, 'P' || p_partkey, 'class', 'external', NULL, NULL, NULL, NULL FROM part_f
  UNION ALL SELECT DISTINCT type_f, NULL, p_type, 'interface', 'project', NULL, CAST(NULL AS VARCHAR[]), NULL, CAST(NULL AS BOOLEAN) FROM part_f
  UNION ALL SELECT DISTINCT brand_f, NULL, replace(p_brand, '#', '_'), 'annotation', 'project', NULL, CAST(NULL AS VARCHAR[]), NULL, CAST(NULL AS BOOLEAN) FROM part_f
  UNION ALL SELECT f, up, 't' || turn, 'class', 'project', NULL, NULL, NULL, NULL FROM turns_f
  UNION ALL SELECT f || '#' || role || '()', f, role, 'method', 'project', NULL, NULL, NULL, NULL FROM turns_f
), edges AS (
  SELECT up AS src, f AS dst, 'Contains' AS edge_type FROM nation_f
  UNION ALL SELECT up, f, 'Contains' FROM customer_f UNION ALL SELECT up, f, 'Contains' FROM supplier_f UNION ALL SELECT up, f, 'Contains' FROM orders_f
  UNION ALL SELECT DISTINCT f, 'parts.P' || l_partkey, 'TypedAs' FROM lineitem JOIN orders_f ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT o.f, s.f, 'UsesDependency' FROM lineitem JOIN orders_f o ON l_orderkey = o_orderkey JOIN supplier_f s ON l_suppkey = s_suppkey
  UNION ALL SELECT c.f, s.f, 'Implements' FROM customer_f c JOIN supplier_f s ON s_suppkey = c_custkey % 10
  UNION ALL SELECT f, type_f, 'InheritsFrom' FROM part_f UNION ALL SELECT f, brand_f, 'DecoratedBy' FROM part_f
  UNION ALL SELECT f, f || '#' || role || '()', 'Contains' FROM turns_f UNION ALL SELECT f, before, 'InheritsFrom' FROM turns_f WHERE before IS NOT NULL
), files AS (SELECT 'doc/' || doc_id AS path, text AS content, doc_id FROM documents
), tokens AS (SELECT path, unnest(list_distinct(regexp_extract_all(content, '[\pL\pN_]+'))) AS token FROM files
), super AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE edge_type IN ('InheritsFrom', 'Implements')
), walk AS (
  SELECT a AS start, b AS reached, 1 AS depth FROM super WHERE a <> b
  UNION SELECT w.start, s.b, w.depth + 1 FROM walk w JOIN super s ON s.a = w.reached WHERE w.depth < 10 AND s.b <> w.start
), ancestors AS (SELECT start, reached, min(depth) AS depth FROM walk GROUP BY ALL
), members AS (
  SELECT DISTINCT e.src AS owner_fqn, n.fqn, n.kind, regexp_replace(regexp_extract(n.fqn, '#([^#]*)$', 1), '\(.*\)$', '') AS simple_name
  FROM edges e JOIN nodes n ON e.dst = n.fqn WHERE e.edge_type = 'Contains' AND n.kind IN ('method', 'field', 'constructor')
)
"""
