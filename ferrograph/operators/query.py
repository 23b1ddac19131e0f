"""The structured queries: find, ls, cat, deps and statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrograph.schema import CONTAINS, INTENT_KINDS, Graph, InvalidArgument, NotFound

ROOT_LIMIT = 50
FIND_LIMIT = 20


def among(column: Column, values: Sequence[str]) -> Column:
    """IN-list; an empty one lets all through."""
    return column.isin(*values) if values else F.lit(True)


def fits_intent(kind: Column, intent: str) -> Column:
    """Whether a symbol of that kind may be meant, where one of some intent is looked for; an intent that nothing is known of allows all."""
    kinds = INTENT_KINDS.get(intent)
    return F.lit(True) if kinds is None else kind.isin(*kinds) if kinds else F.lit(False)


def grouped(nodes: DataFrame, by: str) -> DataFrame:
    """Nodes of one name, or of one file: how many, and the first and last of them; lists are got by a filter."""
    return nodes.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min("fqn").alias("first"), F.max("fqn").alias("last"))


def with_modifiers(nodes: DataFrame, modifiers: Sequence[str]) -> DataFrame:
    for m in modifiers:
        nodes = nodes.filter(F.array_contains("modifiers", m))
    return nodes


def matching(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes of which the FQN or name has a match, without regard to case."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise InvalidArgument(f"Invalid pattern {pattern!r}: {error}") from error
    anywhere = f"(?i){pattern}"
    return nodes.filter(F.col("fqn").rlike(anywhere) | F.col("name").rlike(anywhere))


def find(graph: Graph, pattern: str, kinds: Sequence[str] = (), sources: Sequence[str] = (), limit: int | None = FIND_LIMIT) -> DataFrame:
    found = matching(graph.nodes.filter(among(F.col("kind"), kinds) & among(F.col("source"), sources)), pattern)
    return found if limit is None else found.orderBy("fqn").limit(limit)


def workspace_symbols(graph: Graph, pattern: str, limit: int = 100) -> DataFrame:
    return find(graph, pattern, limit=limit).filter(F.col("path").isNotNull())


def cat(graph: Graph, fqn: str) -> DataFrame:
    return graph.nodes.filter(F.col("fqn") == fqn).limit(1)


def neighbours(graph: Graph, fqn: str, rev: bool = False, edge_types: Sequence[str] = ()) -> DataFrame:
    """Edges one step out of a node (or into it), with the FQN at the other end as ``other``."""
    here, there = ("dst", "src") if rev else ("src", "dst")
    return graph.edges.filter((F.col(here) == fqn) & among(F.col("edge_type"), edge_types)).withColumn("other", F.col(there))


def deps(graph: Graph, fqn: str, rev: bool = False, edge_types: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Neighbouring nodes, each with the ``edge_type`` that leads there."""
    if check and cat(graph, fqn).isEmpty():
        raise NotFound(f"Node not found: {fqn}")
    edges = neighbours(graph, fqn, rev, edge_types).select("other", "edge_type").distinct()
    return edges.join(graph.nodes, F.col("other") == F.col("fqn")).drop("other")


def children(graph: Graph, parents: DataFrame, on: str = "fqn") -> DataFrame:
    """Nodes that are contained in the parents, with the parent as ``owner_fqn``."""
    held = graph.edges.filter(F.col("edge_type") == CONTAINS).select(F.col("src").alias("owner_fqn"), F.col("dst").alias("child"))
    inside = held.join(parents.select(F.col(on).alias("owner_fqn")).distinct(), "owner_fqn", "left_semi")
    return inside.join(graph.nodes, F.col("child") == F.col("fqn")).drop("child")


def parentless(graph: Graph) -> DataFrame:
    held = graph.edges.filter(F.col("edge_type") == CONTAINS).select(F.col("dst").alias("fqn")).distinct()
    return graph.nodes.join(held, "fqn", "left_anti")


def ls(graph: Graph, fqn: str | None = None, kinds: Sequence[str] = (), sources: Sequence[str] = (), modifiers: Sequence[str] = ()) -> DataFrame:
    """Children of a node; without one, modules that nothing holds, or else up to ``ROOT_LIMIT`` nodes that nothing holds."""
    if fqn is not None:
        held = graph.edges.filter((F.col("src") == fqn) & (F.col("edge_type") == CONTAINS)).select("dst").distinct()
        found = held.join(graph.nodes, F.col("dst") == F.col("fqn")).drop("dst")
        return with_modifiers(found.filter(among(F.col("kind"), kinds) & among(F.col("source"), sources)), modifiers)
    roots = parentless(graph).filter(among(F.col("source"), sources))
    modules = roots.filter(F.col("kind") == "module")
    if not modules.isEmpty():
        return with_modifiers(modules, modifiers)
    return with_modifiers(roots.filter(among(F.col("kind"), kinds)), modifiers).orderBy("fqn").limit(ROOT_LIMIT)


def stats(graph: Graph) -> DataFrame:
    nodes = graph.nodes.agg(F.count("*").alias("node_count"))
    return nodes.crossJoin(graph.edges.agg(F.count("*").alias("edge_count")))


def histogram(graph: Graph, by: str = "kind") -> DataFrame:
    return graph.nodes.groupBy(by).agg(F.count("*").alias("n"))


def relation_column(graph: Graph, fqn: str) -> DataFrame:
    """Each neighbour of a node, with the types of all edges between the two, joined by commas."""
    both = neighbours(graph, fqn).unionByName(neighbours(graph, fqn, rev=True))
    return both.groupBy(F.col("other").alias("fqn")).agg(F.array_join(F.array_sort(F.collect_set("edge_type")), ", ").alias("relation"))
