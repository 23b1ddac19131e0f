"""Paths typed by a user: absolute, relative, parents, simple names; and completion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators.query import cat, children
from ferrograph.schema import CONTAINS, Graph

SHOWN = 10


@dataclass
class Resolution:
    """``status`` is found, ambiguous or not_found."""

    status: str
    fqns: list[str] = field(default_factory=list)


def of(rows: DataFrame) -> Resolution:
    found = [r["fqn"] for r in rows.select("fqn").distinct().orderBy("fqn").limit(SHOWN + 1).collect()]
    return Resolution("not_found" if not found else "found" if len(found) == 1 else "ambiguous", found[:SHOWN])


def parents(graph: Graph) -> DataFrame:
    """``(fqn, parent)``: the first node that contains each, by its FQN."""
    held = graph.edges.filter(F.col("edge_type") == CONTAINS)
    return held.groupBy(F.col("dst").alias("fqn")).agg(F.min("src").alias("parent"))


def fuzzy(graph: Graph, targets: DataFrame) -> DataFrame:
    """For each (target, context): status, number of candidates and the first one.

    Candidates are the children of the context, or all nodes without one, of which the name or last segment is the target.
    """
    names = graph.nodes.select("fqn", F.explode(F.array_distinct(F.array("name", naming.simple_name(F.col("fqn"))))).alias("target"))
    held = graph.edges.filter(F.col("edge_type") == CONTAINS).select(F.col("src").alias("context"), F.col("dst").alias("fqn")).distinct()
    free = targets.filter(F.col("context").isNull()).select("target").distinct().join(names, "target").withColumn("context", F.lit(None).cast("string"))
    bound = targets.filter(F.col("context").isNotNull()).distinct().join(names.join(held, "fqn"), ["target", "context"])
    found = free.select("target", "context", "fqn").unionByName(bound.select("target", "context", "fqn"))
    counts = found.groupBy("target", "context").agg(F.count_distinct("fqn").alias("candidates"), F.min("fqn").alias("first"))
    asked = targets.distinct().alias("a")
    same = F.col("a.target").eqNullSafe(F.col("c.target")) & F.col("a.context").eqNullSafe(F.col("c.context"))
    n = F.coalesce(F.col("c.candidates"), F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return asked.join(counts.alias("c"), same, "left").select("a.target", "a.context", status.alias("status"), n.cast("long").alias("candidates"), F.col("c.first").alias("first"))


def resolve_path(graph: Graph, target: str, context: str | None = None) -> Resolution:
    if target in ("/", "root"):
        return of(graph.nodes.filter(F.col("kind") == "project"))
    if target == "..":
        return of(parents(graph).filter(F.col("fqn") == context).select(F.col("parent").alias("fqn"))) if context else Resolution("not_found")
    if target == ".":
        return Resolution("found", [context]) if context else Resolution("not_found")
    for full in (target, *(f"{context}{s}{target}" for s in ("::", ".", "#") if context)):
        if not cat(graph, full).isEmpty():
            return Resolution("found", [full])
    spark = graph.nodes.sparkSession
    near = children(graph, spark.createDataFrame([(context,)], "fqn string")) if context else graph.nodes
    return of(near.filter((F.col("name") == target) | (naming.simple_name(F.col("fqn")) == target)))


def complete(graph: Graph, prefix: str, limit: int = 50) -> DataFrame:
    return graph.nodes.filter(F.col("fqn").startswith(prefix)).select("fqn").orderBy("fqn").limit(limit)


def suggest(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Simple names before qualified ones, short before long."""
    return candidates.orderBy(F.col("fqn").contains("."), F.length("fqn"), "fqn").limit(limit)
