"""Positions: what contains a point, where definitions are, which references are declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrograph.schema import Graph

RANGE_COLUMNS = ("start_line", "start_col", "end_line", "end_col")


def contains(r: str | Column, line: Column, col: Column) -> Column:
    """Whether a range holds a point, both ends included."""
    r = F.col(r) if isinstance(r, str) else r
    point = F.struct(line.cast("int").alias("l"), col.cast("int").alias("c"))
    at = lambda a, b: F.struct(r[a].cast("int").alias("l"), r[b].cast("int").alias("c"))
    return (at("start_line", "start_col") <= point) & (point <= at("end_line", "end_col"))


def prefix_of(line: Column, utf16: Column) -> Column:
    """The part of a line before an editor's column, which counts UTF-16 units; null beyond the line's end."""
    raw = F.encode(line, "UTF-16BE")
    return F.when((utf16 >= 0) & (utf16 * 2 <= F.octet_length(raw)), F.decode(F.substring(raw, F.lit(1), (utf16 * 2).cast("int")), "UTF-16BE"))


def byte_column(line: Column, utf16: Column) -> Column:
    return F.octet_length(prefix_of(line, utf16))


def byte_offset(content: Column, line: Column, utf16: Column) -> Column:
    """Bytes before a position in a text; null where the line or the column isn't there."""
    lines = F.split(content, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line.cast("int")), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    return F.when((line >= 0) & (line < F.size(lines)), before + byte_column(F.get(lines, line.cast("int")), utf16))


def word_at(line: Column, col: Column) -> Column:
    """The word that holds a column, or ends there; null where there is none."""
    left = F.regexp_extract(F.substring(line, F.lit(1), col.cast("int")), r"[\p{L}\p{N}_]*$", 0)
    right = F.regexp_extract(F.substring(line, col.cast("int") + 1, F.length(line)), r"^[\p{L}\p{N}_]*", 0)
    return F.when(col <= F.length(line), F.nullif(F.concat(left, right), F.lit("")))


def range_size(r: str | Column) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    return F.greatest(r["end_line"] - r["start_line"], F.lit(0)) * 1000 + F.greatest(r["end_col"] - r["start_col"], F.lit(0))


def container_at(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points (path, line, col) with the ``container``: the smallest node of the file whose range holds the point (ties by FQN).

    Equal paths are joined first, so that the interval test stays within a file.
    """
    best = held_by(points.select("path", "line", "col").distinct(), nodes)
    return points.join(best, ["path", "line", "col"], "left")


def held_by(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of points that are distinct rows (path, line, col and others), those that a node holds, with the ``container``.

    Points that come partitioned by path are not shuffled again.
    """
    inside = nodes.filter(F.col("range").isNotNull()).select("path", "fqn", "range")
    around = F.coalesce((F.col("range.start_line") <= F.col("line")) & (F.col("line") <= F.col("range.end_line")), F.lit(True))  # cheaper than contains
    held = points.join(inside, "path").filter(around & contains("range", F.col("line"), F.col("col")))
    place = ["path", "line", "col"]
    return held.groupBy(*place, *(c for c in points.columns if c not in place)).agg(F.min(F.struct(range_size("range").alias("size"), "fqn"))["fqn"].alias("container"))


def node_at(graph: Graph, path: str, line: int, col: int) -> DataFrame:
    """The node whose name stands at a position."""
    return graph.nodes.filter((F.col("path") == path) & contains("selection_range", F.lit(line), F.lit(col))).orderBy("fqn").limit(1)


def definitions(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matched nodes that have a location."""
    return nodes.join(matches.select("fqn").distinct(), "fqn", "left_semi").filter(F.col("path").isNotNull())


def declarations(nodes: DataFrame) -> DataFrame:
    """``(path, start_line, start_col, end_line, end_col)`` of each node's name, or else of the whole node."""
    r = F.coalesce("selection_range", "range")
    return nodes.filter(F.col("path").isNotNull() & r.isNotNull()).select("path", *(r[c].alias(c) for c in RANGE_COLUMNS))


def exclude_declarations(refs: DataFrame, decls: DataFrame) -> DataFrame:
    return refs.join(decls, ["path", *RANGE_COLUMNS], "left_anti")


def sorted_references(refs: DataFrame) -> DataFrame:
    """By place; of those that begin at the same place one stays."""
    return refs.dropDuplicates(["path", "start_line", "start_col"]).orderBy("path", "start_line", "start_col")
