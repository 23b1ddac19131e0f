"""Versioned storage of graphs: a directory for each version, and a pointer that is moved last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ferrograph.schema import Graph

FORMAT = 1
PARTS = ("nodes", "edges", "files", "tokens", "occurrences")


class Store:
    """Readers pin a version; a writer never changes one that is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def pointer(self) -> dict | None:
        """What the newest pointer says that can be read; each version has its own, so that none is ever replaced."""
        found = self.fs.globStatus(self.path(f"{self.root}/current-*.json")) or []
        for place in sorted((s.getPath().toString() for s in found), reverse=True):
            try:
                return json.loads(self.spark.read.text(place, wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue
        return None

    def save(self, graph: Graph, version: int | None = None) -> int:
        """Write a version and make it current. A version that is current already isn't written again, so that repeated batches do no harm."""
        now = self.pointer()
        if version is not None and now and now["version"] >= version:
            return now["version"]
        version = (now["version"] + 1 if now else 0) if version is None else version
        parts = []
        for name in PARTS:
            df: DataFrame | None = getattr(graph, name)
            if df is not None:
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/v={version}/{name}")
                parts.append(name)
        new = self.path(f"{self.root}/.current-{version}.json")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version, "format": FORMAT, "parts": parts}).encode()))
        out.close()
        self.fs.rename(new, self.path(f"{self.root}/current-{version:012}.json"))
        return version

    def load(self, version: int | None = None) -> Graph | None:
        """The current version or a given one; None where nothing usable is stored. Nothing is deleted; ``clear`` does that."""
        now = self.pointer()
        if now is None or now.get("format") != FORMAT:
            return None
        version = now["version"] if version is None else version
        read = {n: self.spark.read.parquet(f"{self.root}/v={version}/{n}") if n in now["parts"] else None for n in PARTS}
        return Graph(**read)

    def clear(self) -> None:
        self.fs.delete(self.path(self.root), True)


def dump_json(graph: Graph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").json(f"{folder}/edges")
