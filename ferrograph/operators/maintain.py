"""Keeping a graph current: change detection, ordered operations, upserts and placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.schema import NODE, Graph
from ferrograph.session import kept


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.xxhash64("content"))


def changed(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Current files that are new, or of which both time and hash differ; files without an extension don't count."""
    was = prev.select("path", F.col("last_modified").alias("was_modified"), F.col("content_hash").alias("was_hash"))
    new = F.col("was_hash").isNull()
    moved = (F.col("last_modified") != F.col("was_modified")) & (F.col("content_hash") != F.col("was_hash"))
    return cur.filter(naming.file_name(F.col("path")).contains(".")).join(was, "path", "left").filter(new | moved).drop("was_modified", "was_hash")


def deleted(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return prev.select("path").distinct().join(cur.select("path").distinct(), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both. Of a known one kind, status, source and metadata become the new ones, the name stays, and the location is taken over only where it was missing."""
    names = old.columns
    a, b = old.alias("a"), new.dropDuplicates(["fqn"]).alias("b")
    joined = a.join(b, F.col("a.fqn") == F.col("b.fqn"), "full_outer")
    has_new, keep = F.col("b.fqn").isNotNull(), {"fqn", "name", "path", "range", "selection_range"}
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else F.when(has_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*(pick(c).alias(c) for c in names))


def bind_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose source is known, placeholders for their unknown targets)."""
    known = nodes.select("fqn")
    held = edges.join(known, edges["src"] == known["fqn"], "left_semi")
    lost = held.select(F.col("dst").alias("fqn")).distinct().join(known, "fqn", "left_anti")
    return held.dropDuplicates(["src", "dst", "edge_type"]), placeholders(lost, nodes)


def placeholders(fqns: DataFrame, like: DataFrame) -> DataFrame:
    """External, unresolved nodes that are named by their whole id; a class if the name looks like one or isn't a member."""
    set_to = {"fqn": F.col("fqn"), "name": F.col("fqn"), "kind": F.when(naming.is_member(F.col("fqn")), F.lit("method")).otherwise(F.lit("class")), "source": F.lit("external"), "status": F.lit("unresolved")}
    types = {f.name: f.dataType for f in like.schema.fields}
    return fqns.select(*(set_to.get(c, F.lit(None).cast(types[c])).alias(c) for c in like.columns))


def remove_paths(graph: Graph, paths: DataFrame) -> Graph:
    """Without the nodes of some files, and without the edges that begin in them; edges from other files stay."""
    gone = kept(paths.select("path").distinct(), "gone")  # of known size: nodes of a file that holds many aren't brought together where a few files go
    nodes = graph.nodes.join(gone, "path", "left_anti").select(*graph.nodes.columns)
    edges = graph.edges.join(gone.withColumnRenamed("path", "src_path"), "src_path", "left_anti").select(*graph.edges.columns)
    part = lambda df: None if df is None else df.join(gone, "path", "left_anti").select(*df.columns)
    return Graph(nodes, edges, part(graph.files), part(graph.tokens), part(graph.occurrences))


def apply(graph: Graph, removed: DataFrame, delta: Graph) -> Graph:
    """Removals, then nodes, files and tokens, then edges with placeholders for what they point to; unused placeholders go."""
    left = remove_paths(graph, removed)
    real = left.nodes.filter(~((F.col("source") == "external") & (F.col("status") == "unresolved")))
    nodes = upsert(real, delta.nodes.select(*real.columns))
    edges = left.edges.unionByName(delta.edges.select(*left.edges.columns))
    bound, lost = bind_edges(edges, nodes)
    both = lambda a, b: b if a is None else a if b is None else a.unionByName(b.select(*a.columns)).distinct()
    return Graph(nodes.unionByName(lost), bound, both(left.files, delta.files), both(left.tokens, delta.tokens), both(left.occurrences, delta.occurrences))


def empty(spark) -> Graph:
    from ferrograph.schema import EDGE, FILE, TOKEN

    return Graph(*(spark.createDataFrame([], s) for s in (NODE, EDGE, FILE, TOKEN)))
