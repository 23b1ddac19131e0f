"""Binary assets: discovery, package routes, stubs and their cache."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators import match

ASSET = "path string, source_type string, `group` string, artifact string, version string, size long, modified long"


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """Jars of a build cache laid out as group/artifact/version/hash/file.jar, without sources and javadoc; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jar").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", r"^file:/*", "/")
    parts = F.split(path, "/")
    from_end = lambda k: F.element_at(parts, -k)
    rows = listed.filter(~F.col("path").rlike(r"-(sources|javadoc)\.jar$"))
    return rows.select(path.alias("path"), F.lit("gradle").alias("source_type"), from_end(5).alias("group"), from_end(4).alias("artifact"), from_end(3).alias("version"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"))


def jdk(environment: dict[str, str] | None = None) -> list[tuple[str, str | None]]:
    """(asset path, version) of the JDK's classes, where JAVA_HOME or a usual place has one. On the driver."""
    environment = dict(os.environ) if environment is None else environment
    homes = [environment.get("JAVA_HOME"), *map(str, sorted(Path("/usr/lib/jvm").glob("*"))), "/Library/Java/JavaVirtualMachines"]
    for home in filter(None, homes):
        for inside in ("lib/modules", "jre/lib/rt.jar", "lib/rt.jar", "jmods/java.base.jmod"):
            if (asset := Path(home, inside)).exists():
                release = Path(home, "release")
                found = re.search(r'JAVA_VERSION="([^"]+)"', release.read_text()) if release.exists() else re.search(r"(\d+(?:\.\d+)*)", Path(home).name)
                return [(str(asset), found[1] if found else None)]
    return []


def packages(assets: DataFrame) -> DataFrame:
    """``(path, prefix, status)``: packages of jars, by their directories with classes; status is indexed, skipped or failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch["path"]:
                if not path.endswith((".jar", ".jmod", ".zip")):
                    rows.append((path, None, "skipped"))
                    continue
                try:
                    with zipfile.ZipFile(path) as z:
                        names = {re.sub(r"^classes/", "", n).rpartition("/")[0].replace("/", ".") for n in z.namelist() if n.endswith(".class")}
                    rows += [(path, n, "indexed") for n in sorted(names - {""}) if not n.startswith("META-INF")] or [(path, None, "indexed")]
                except (OSError, zipfile.BadZipFile):
                    rows.append((path, None, "failed"))
            yield pd.DataFrame(rows, columns=["path", "prefix", "status"])

    return assets.select("path").mapInPandas(run, "path string, prefix string, status string")


def scan(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, counters): a route for each package of each asset, and how many assets were indexed, skipped or failed."""
    found = packages(assets)
    routes = found.filter("prefix IS NOT NULL").join(assets, "path").select("prefix", F.col("path").alias("asset_path"), "source_type", "group", "artifact", "version")
    one = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("path"))).alias(s)
    counters = found.agg(F.count_distinct("path").alias("total"), one("indexed"), one("skipped"), one("failed"), F.count("prefix").alias("registrations"), F.count_distinct("prefix").alias("prefixes"))
    return register(routes), counters


def register(routes: DataFrame) -> DataFrame:
    """Routes, each once, however often it was registered."""
    return routes.dropDuplicates(["prefix", "asset_path", "source_type"])


def lookup(requests: DataFrame, routes: DataFrame, source_type: str | None = None) -> DataFrame:
    """Requests (fqn) with the routes of their longest prefix; of one source only, if given, after the prefix is chosen."""
    found = match.longest_prefix(requests, routes)
    return found if source_type is None else found.filter(F.col("source_type") == source_type)


def registry_stats(routes: DataFrame) -> DataFrame:
    """Entries by source type, and distinct prefixes of the whole registry."""
    return routes.groupBy("source_type").agg(F.count("*").alias("entries")).crossJoin(routes.agg(F.count_distinct("prefix").alias("prefixes")))


def asset_hash(path, size, modified):
    """Key of a cached asset; it changes with the file."""
    return F.xxhash64(F.concat_ws(":", path, size.cast("string"), modified.cast("string")))


def store(stubs: DataFrame, folder: str) -> None:
    """Add stubs to the cache, under their assets."""
    stubs.write.mode("append").partitionBy("asset_hash").parquet(folder)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The cache, with the newest stub of each asset and FQN."""
    rows = spark.read.parquet(folder)
    rest = [n for n in rows.columns if n not in ("asset_hash", "fqn")]
    best = rows.groupBy("asset_hash", "fqn").agg(F.max_by(F.struct(*rest), F.struct("created_at", *[n for n in rest if n != "created_at"])).alias("s"))
    return best.select("asset_hash", "fqn", "s.*")


def cache_stats(stubs: DataFrame) -> DataFrame:
    return stubs.agg(F.count_distinct("asset_hash").alias("assets"), F.count("*").alias("entries"))


def summaries(stubs: DataFrame) -> DataFrame:
    return stubs.groupBy("asset_hash").agg(F.min("asset_path").alias("asset_path"), F.count("*").alias("entries"), F.min("created_at").alias("created_at"))


def inspect(stubs: DataFrame, hash_prefix: str, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """(histogram of tags, samples) of the assets whose hash begins so."""
    own = stubs.filter(F.col("asset_hash").cast("string").startswith(hash_prefix))
    return own.groupBy("type_tag").agg(F.count("*").alias("n")), own.orderBy("fqn").limit(samples)


def clear(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def listed(files: DataFrame, contains: str = "", by: str = "size") -> DataFrame:
    """Cached files, filtered by a part of their path, largest or newest first."""
    rows = files.filter(F.col("path").contains(contains)) if contains else files
    return rows.orderBy(F.desc(by), "path").withColumn("shown_size", naming.human_size(F.col("size")))


def source_archives(assets: DataFrame, archives: DataFrame) -> DataFrame:
    """Each asset with its -sources archive in the same directory, where there is one."""
    base = lambda c: F.regexp_replace(c, r"(-sources)?\.jar$", "")
    near = archives.filter(F.col("path").endswith("-sources.jar")).select(base(F.col("path")).alias("base"), F.col("path").alias("sources_path"))
    return assets.withColumn("base", base(F.col("path"))).join(near, "base", "left").drop("base")


def plan_stubs(wanted: DataFrame, routes: DataFrame, known: DataFrame) -> DataFrame:
    """Routes of the FQNs that are wanted, aren't cached yet, and have a route."""
    new = wanted.select("fqn").distinct().join(known.select("fqn").distinct(), "fqn", "left_anti")
    return match.longest_prefix(new, routes)


def hydrate(missing: DataFrame, stubs: DataFrame) -> DataFrame:
    """Stubbed nodes for missing FQNs: the first asset that has each."""
    found = missing.select("fqn").distinct().join(stubs, "fqn")
    return found.groupBy("fqn").agg(F.min("asset_path").alias("asset_path")).withColumn("source", F.lit("external")).withColumn("status", F.lit("stubbed"))
