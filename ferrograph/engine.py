"""The service surface: one object that builds, stores, refreshes and answers questions over a project's graph."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators import assets, locate, maintain, navigate, present, query, references, traverse
from ferrograph.schema import Graph, InvalidArgument, NotFound
from ferrograph.sources import gradle, java
from ferrograph.sources.store import Store
from ferrograph.streaming import watch


def scan_project(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content, last_modified)`` of the relevant source and build files under a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").alias("last_modified"))
    return rows.filter(naming.relevant(F.col("path")) & (naming.is_java(F.col("path")) | naming.is_build(F.col("path")))).withColumn("lang", naming.language_of(F.col("path")))


class Engine:
    """Answers are DataFrames; only paths and counts are brought to the driver."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root, Store(spark, store)
        self.graph: Graph | None = None

    # Lifecycle

    def rebuild(self) -> int:
        files = maintain.with_hash(scan_project(self.spark, self.root))
        return self._publish(self._build(files))

    def _build(self, files: DataFrame) -> Graph:
        g = java.index(java.parse_files(files))
        nodes, edges = gradle.project_graph(files.filter(naming.is_build(F.col("path"))))
        shown = nodes.select(*(F.col(c) if c in nodes.columns else F.lit({"lang": "gradle", "status": "resolved"}.get(c)).cast(t).alias(c) for c, t in g.nodes.dtypes))
        g.nodes = g.nodes.unionByName(shown)
        edges = g.edges.unionByName(edges.withColumn("src_path", F.lit(None).cast("string")))
        g.edges, lost = maintain.bind_edges(edges, g.nodes)
        g.nodes, g.files = g.nodes.unionByName(lost), files
        return g

    def _publish(self, graph: Graph, version: int | None = None) -> int:
        saved = self.store.save(graph, version)
        self.graph = self.store.load()
        return saved

    def load(self) -> bool:
        self.graph = self.store.load()
        return self.graph is not None

    def refresh(self) -> int:
        """Index what has changed, and remove what is gone; edges are bound over all files, so the result is that of a full build."""
        if self.graph is None and not self.load():
            return self.rebuild()
        now, was = maintain.with_hash(scan_project(self.spark, self.root)), self.graph.files
        if maintain.changed(was, now).isEmpty() and maintain.deleted(was, now).isEmpty():
            return self.store.pointer()["version"]
        return self._publish(self._build(now))

    def start_watch(self, events: DataFrame, checkpoint: str):
        """Refresh after each burst of events; ``stop()`` of the result ends it."""
        return watch.watch(events, lambda _paths, _batch: self.refresh(), checkpoint)

    def clear_index(self) -> None:
        self.store.clear()
        self.graph = None

    # Graph

    def query(self, command: str | dict) -> DataFrame:
        """A command such as {"command": "deps", "fqn": "a.B", "rev": true}."""
        q = json.loads(command) if isinstance(command, str) else dict(command)
        verb = q.pop("command", None)
        run = {"find": query.find, "ls": query.ls, "cat": query.cat, "deps": query.deps}.get(verb)
        if run is None:
            raise InvalidArgument(f"Unknown command: {verb}")
        names = {"kind": "kinds"} if verb in ("find", "ls") else {}
        return run(self.graph, **{names.get(k, k): v for k, v in q.items()})

    def get_stats(self) -> dict[str, int]:
        return query.stats(self.graph).first().asDict()

    def get_node_display(self, fqn: str) -> DataFrame:
        return present.display(query.cat(self.graph, fqn))

    # Navigation and symbols

    def resolve_path(self, target: str, context: str | None = None) -> navigate.Resolution:
        return navigate.resolve_path(self.graph, target, context)

    def get_completion_candidates(self, prefix: str, limit: int = 50) -> list[str]:
        return [r["fqn"] for r in navigate.complete(self.graph, prefix, limit).collect()]

    def resolve_symbol_at(self, path: str, line: int, col: int) -> str:
        """The FQN declared or used at a position."""
        declared = locate.node_at(self.graph, path, line, col).select("fqn")
        here = F.struct(*locate.RANGE_COLUMNS)
        used = self.graph.occurrences.filter((F.col("path") == path) & locate.contains(here, F.lit(line), F.lit(col)) & F.col("resolved_fqn").isNotNull()).select(F.col("resolved_fqn").alias("fqn"))
        found = declared.limit(1).collect() or used.orderBy("fqn").limit(1).collect()
        if not found:
            raise NotFound(f"No symbol at {path}:{line + 1}:{col + 1}")
        return found[0]["fqn"]

    def _one(self, fqn: str) -> DataFrame:
        return self.spark.createDataFrame([(fqn,)], "fqn string")

    def find_definitions(self, fqn: str) -> DataFrame:
        return locate.definitions(self._one(fqn), self.graph.nodes)

    def find_type_definitions(self, fqn: str) -> DataFrame:
        """For a type itself, for a member its type."""
        typed = self.graph.edges.filter((F.col("src") == fqn) & (F.col("edge_type") == "TypedAs")).select(F.col("dst").alias("fqn"))
        return locate.definitions(typed if "#" in fqn else self._one(fqn), self.graph.nodes)

    def find_implementations(self, fqn: str) -> DataFrame:
        return locate.definitions(traverse.implementations(self.graph, self._one(fqn)), self.graph.nodes)

    def find_highlights(self, path: str, fqn: str) -> DataFrame:
        return references.highlights(self.graph, path, fqn)

    def find_references(self, fqn: str, include_declaration: bool = False) -> DataFrame:
        return locate.sorted_references(references.find_references(self.graph, self._one(fqn), include_declaration))

    def find_incoming_calls(self, fqn: str) -> DataFrame:
        return references.incoming_calls(self.graph, self._one(fqn))

    def find_outgoing_calls(self, fqn: str) -> DataFrame:
        return references.outgoing_calls(self.graph, self._one(fqn))

    def get_symbol_info(self, fqn: str) -> DataFrame:
        return present.hover(self.get_node_display(fqn))

    def get_document_symbols(self, path: str) -> list[dict]:
        return references.nest([r.asDict(True) for r in references.document_symbols(self.graph, path).orderBy("fqn").collect()])

    def scan_assets(self, folder: str) -> tuple[DataFrame, DataFrame]:
        return assets.scan(assets.discovered(self.spark, folder))


def table(rows: DataFrame, columns: Sequence[str] = ("fqn", "kind", "source")) -> str:
    """A listing as text, for a shell."""
    found = [tuple(str(r[c] or "") for c in columns) for r in present.listing(rows).collect()]
    widths = [max(map(len, x)) for x in zip(columns, *found, strict=True)]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in (tuple(columns), *found))
