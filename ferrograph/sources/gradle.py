"""Gradle builds: dependencies, settings, the module hierarchy and their graph. All of it is expressions over the file's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators import match
from ferrograph.schema import CONTAINS, USES

CONFIGURATIONS = "implementation|api|testImplementation|compileOnly|runtimeOnly|annotationProcessor"
EXTERNAL = rf"""\b({CONFIGURATIONS})\s*\(?\s*(?:"([^"\n]*)"|'([^'\n]*)')"""
PROJECT = rf"""\b({CONFIGURATIONS})\s*\(?\s*project\s*\(\s*(?:"([^"\n]*)"|'([^'\n]*)')"""
COMMENTS = r"(?s)/\*.*?\*/|(?<![:\"'])//[^\n]*"
INCLUDE = r"""\binclude\b\s*\(?((?:\s*(?:"[^"\n]*"|'[^'\n]*')\s*,?)+)"""
ROOT_NAME = r"""\brootProject\.name\s*(?:=|\()\s*["']([^"'\n]*)["']"""


def cleaned(content):
    return F.regexp_replace(content, COMMENTS, "")


def is_settings(path):
    return naming.file_name(path).startswith("settings.gradle")


def captures(text, pattern: str, groups: int):
    """One struct for each match, of the groups g1, g2, ..."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, groups + 1)]
    return F.arrays_zip(*parts)


def dependencies(files: DataFrame) -> DataFrame:
    """``(path, configuration, group, name, version, is_project)`` of build files; coordinates need exactly three parts."""
    rows = files.filter(~is_settings(F.col("path"))).select("path", cleaned(F.col("content")).alias("t"))
    some = lambda pattern: rows.select("path", F.explode(captures(F.col("t"), pattern, 3)).alias("m")).select("path", F.col("m.g1").alias("configuration"), F.concat(F.coalesce("m.g2", F.lit("")), F.coalesce("m.g3", F.lit(""))).alias("text"))
    parts = F.split("text", ":")
    outer = some(EXTERNAL).filter(F.size(parts) == 3).select("path", "configuration", parts[0].alias("group"), parts[1].alias("name"), parts[2].alias("version"), F.lit(False).alias("is_project"))
    inner = some(PROJECT).select("path", "configuration", F.lit(None).cast("string").alias("group"), F.col("text").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(True).alias("is_project"))
    return outer.unionByName(inner)


def settings(files: DataFrame) -> DataFrame:
    """``(path, root_project_name, included_projects)`` of settings files."""
    text = cleaned(F.col("content"))
    name = F.regexp_extract(text, ROOT_NAME, 1)
    lists = F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1))
    included = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"""["']([^"']*)["']"""), F.lit(1))))
    return files.filter(is_settings(F.col("path"))).select("path", F.when(name != "", name).alias("root_project_name"), included.alias("included_projects"))


def module_id(directory):
    """A project path :a:b, or a directory a/b, as an id."""
    return F.regexp_replace(F.regexp_replace(directory, "^:", ""), ":", "/")


def modules(files: DataFrame) -> DataFrame:
    """``(path_prefix, module_fqn)``: every directory with a build or settings file."""
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    return files.filter(naming.is_build(F.col("path"))).select(directory.alias("path_prefix")).distinct().withColumn("module_fqn", F.when(F.col("path_prefix") == "", F.lit("root")).otherwise(F.col("path_prefix")))


def root_directory(files: DataFrame) -> DataFrame:
    """``root``: the shallowest directory with settings, or else the shallowest."""
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = files.filter(naming.is_build(F.col("path"))).select(directory.alias("d"), is_settings(F.col("path")).alias("s"))
    depth = F.when(F.col("d") == "", 0).otherwise(F.size(F.split("d", "/")))
    return rows.agg(F.min_by("d", F.struct((~F.col("s")).alias("no_settings"), depth.alias("depth"), "d")).alias("root"))


def dependency_graph(deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): dep:g:a:v for external ones, module ids for project ones; source is the build file's directory."""
    owner = F.regexp_replace("path", r"/?[^/]*$", "")
    target = F.when(F.col("is_project"), module_id(F.col("name"))).otherwise(F.concat(F.lit("dep:"), F.concat_ws(":", "group", "name", "version")))
    edges = deps.select(F.when(owner == "", F.lit("root")).otherwise(owner).alias("src"), target.alias("dst"), F.lit(USES).alias("edge_type"), F.col("path").alias("src_path")).dropDuplicates(["src", "dst"])
    nodes = deps.filter(~F.col("is_project")).select(target.alias("fqn"), "name", F.lit("dependency").alias("kind"), F.lit("external").alias("source"), "group", "version").dropDuplicates(["fqn"])
    return nodes, edges


def project_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole build: the project holds its root module, modules hold modules, modules use dependencies.

    nodes (fqn, name, kind, source); the project has the settings' name, or else that of the root's directory.
    """
    mods = modules(files)
    up = match.module_parents(mods)
    root = up.filter("parent IS NULL").select("module_fqn")
    deps, uses = dependency_graph(dependencies(files))
    named = settings(files).orderBy(F.length("path"), "path").select("root_project_name").limit(1)
    name = F.coalesce("root_project_name", F.element_at(F.split("module_fqn", "/"), -1))
    project = root.join(named, how="left").select(F.concat(F.lit("project:"), name).alias("fqn"), name.alias("name"), F.lit("project").alias("kind"), F.lit("project").alias("source"), "module_fqn")
    nodes = project.drop("module_fqn").unionByName(mods.select(F.col("module_fqn").alias("fqn"), F.element_at(F.split("module_fqn", "/"), -1).alias("name"), F.lit("module").alias("kind"), F.lit("project").alias("source"))).unionByName(deps.select("fqn", "name", "kind", "source"))
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(CONTAINS).alias("edge_type"))
    edges = edge(project, "fqn", "module_fqn").unionByName(edge(up.filter("parent IS NOT NULL"), "parent", "module_fqn")).unionByName(uses.drop("src_path"))
    return nodes, edges
