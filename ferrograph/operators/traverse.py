"""Transitive questions: ancestors, descendants, subtypes, implementations and inherited members."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrograph.functions import naming
from ferrograph.schema import CONTAINS, IMPLEMENTS, INHERITS, MEMBER_KINDS, Graph

MAX_DEPTH = 10
SUPER = (INHERITS, IMPLEMENTS)


def links(edges: DataFrame, edge_types: Sequence[str] = SUPER, rev: bool = False) -> DataFrame:
    """Distinct ``(a, b)`` of the edges, from b's side if rev."""
    a, b = ("dst", "src") if rev else ("src", "dst")
    return edges.filter(F.col("edge_type").isin(*edge_types)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def closure(edges: DataFrame, edge_types: Sequence[str] = SUPER, rev: bool = False, max_depth: int | None = MAX_DEPTH, starts: DataFrame | None = None, keep: int = 4, whole: DataFrame | None = None) -> DataFrame:
    """``(start, reached, depth)``: all nodes that are reached in 1 to max_depth steps (None: in any number), at their least depth; cycles end.

    A frontier loop: each step joins only what the step before reached first. The lineage is cut by a checkpoint every ``keep``
    steps, where the session has a checkpoint folder, and the loop ends with the frontier.
    """
    spark = edges.sparkSession
    steps = links(edges, edge_types, rev) if whole is None else whole
    safe = spark.sparkContext.getCheckpointDir() is not None or spark.conf.get("spark.checkpoint.dir", None)
    if safe:
        steps = steps.checkpoint()  # every step joins them; what they come from isn't computed again
    front = steps.select(F.col("a").alias("start"), F.col("b").alias("reached")).filter("start != reached")
    if starts is not None:
        front = front.join(starts.select(F.col("fqn").alias("start")).distinct(), "start", "left_semi")
    if safe:
        front = front.checkpoint()
    seen = front.withColumn("depth", F.lit(1))
    if front.isEmpty():
        return seen.filter(F.lit(False))  # seen to be empty when a query is planned: what is joined with it isn't computed
    for depth in itertools.count(2) if max_depth is None else range(2, max_depth + 1):
        front = front.join(steps, F.col("reached") == F.col("a")).select("start", F.col("b").alias("reached")).filter("start != reached").distinct().join(seen, ["start", "reached"], "left_anti")
        if safe:
            front = front.checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
        if safe and depth % keep == 0:
            seen = seen.checkpoint()
    return seen


def capped(reached: DataFrame, most: int) -> DataFrame:
    """The first ``most`` by depth and name from each start."""
    by = Window.partitionBy("start").orderBy("depth", "reached")
    return reached.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).drop("place")


def ancestors(graph: Graph, starts: DataFrame | None = None, max_depth: int = MAX_DEPTH, compat_max_nodes: int | None = None) -> DataFrame:
    found = closure(graph.edges, SUPER, False, max_depth, starts)
    return capped(found, compat_max_nodes) if compat_max_nodes else found


def descendants(graph: Graph, starts: DataFrame | None = None, max_depth: int = MAX_DEPTH, compat_max_nodes: int | None = None) -> DataFrame:
    found = closure(graph.edges, SUPER, True, max_depth, starts)
    return capped(found, compat_max_nodes) if compat_max_nodes else found


def direct(graph: Graph, edge_type: str, rev: bool = False) -> DataFrame:
    """``(fqn, other)`` one step away: superclasses, interfaces or (rev) subtypes."""
    return links(graph.edges, (edge_type,), rev).select(F.col("a").alias("fqn"), F.col("b").alias("other"))


def is_subtype(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """pairs (sub, sup) with ``is_subtype``: equal, or sup is among sub's ancestors."""
    known = reached.select(F.col("start").alias("sub"), F.col("reached").alias("sup"), F.lit(True).alias("known")).distinct()
    return pairs.join(known, ["sub", "sup"], "left").select("sub", "sup", ((F.col("sub") == F.col("sup")) | F.col("known").isNotNull()).alias("is_subtype"))


def members(graph: Graph) -> DataFrame:
    """``(owner_fqn, simple_name, fqn, kind)`` of methods, fields and constructors."""
    held = graph.edges.filter(F.col("edge_type") == CONTAINS).select(F.col("src").alias("owner_fqn"), F.col("dst").alias("fqn")).distinct()
    own = graph.nodes.filter(F.col("kind").isin(*MEMBER_KINDS)).select("fqn", "kind", naming.strip_signature(F.coalesce(naming.simple_member(F.col("fqn")), F.col("name"))).alias("simple_name"))
    return held.join(own, "fqn").select("owner_fqn", "simple_name", "fqn", "kind")


def implementations(graph: Graph, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(target, fqn)``: descendants of types; for methods, in each descendant of the owner the first member of that name."""
    types = targets.filter(~naming.is_member(F.col("fqn"))).select(F.col("fqn").alias("target")).distinct()
    methods = targets.filter(naming.is_member(F.col("fqn"))).select(F.col("fqn").alias("target"), naming.member_owner(F.col("fqn")).alias("owner"), naming.simple_member(F.col("fqn")).alias("simple_name")).distinct()
    starts = types.select(F.col("target").alias("fqn")).union(methods.select("owner"))
    below = descendants(graph, starts, max_depth)
    of_types = types.join(below, F.col("target") == F.col("start")).select("target", F.col("reached").alias("fqn"))
    inside = methods.join(below, F.col("owner") == F.col("start")).select("target", "simple_name", F.col("reached").alias("owner_fqn"))
    of_methods = inside.join(members(graph), ["owner_fqn", "simple_name"]).groupBy("target", "owner_fqn").agg(F.min("fqn").alias("fqn")).select("target", "fqn")
    return of_types.unionByName(of_methods).distinct()


def member_in_hierarchy(graph: Graph, requests: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """For each (type, simple_name): the type's own member, or else that of the nearest ancestor (ties by FQN)."""
    above = ancestors(graph, requests.select(F.col("type").alias("fqn")), max_depth)
    lines = requests.select("type", "simple_name", F.col("type").alias("owner_fqn"), F.lit(0).alias("depth")).unionByName(requests.join(above, F.col("type") == F.col("start")).select("type", "simple_name", F.col("reached").alias("owner_fqn"), "depth"))
    found = lines.join(members(graph), ["owner_fqn", "simple_name"])
    return found.groupBy("type", "simple_name").agg(F.min_by("fqn", F.struct("depth", "fqn")).alias("fqn"), F.min("depth").alias("depth"))
