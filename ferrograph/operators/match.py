"""Joins by longest prefix and by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming

JAVA_LANG = (
    "Object", "String", "Integer", "Long", "Short", "Byte", "Character", "Boolean", "Double", "Float", "Number", "Math", "System", "Thread",
    "Runnable", "Exception", "RuntimeException", "Error", "Throwable", "Iterable", "Comparable", "Override", "Class",
)
PRIMITIVES = ("byte", "short", "int", "long", "float", "double", "boolean", "char", "void")


def longest_prefix(requests: DataFrame, routes: DataFrame, request: str = "fqn", prefix: str = "prefix", separator: str = ".") -> DataFrame:
    """Each request with the rows of ``routes`` whose prefix is the longest that it has, at a separator.

    The request's prefixes are listed and joined by equality, never tried one by one against all routes.
    """
    asked = requests.select(request).distinct()
    listed = asked.select(request, F.explode(naming.dotted_prefixes(F.col(request), separator)).alias(prefix))
    known = routes.select(prefix).distinct()
    best = listed.join(known, prefix).groupBy(request).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return requests.join(best, request).join(routes, prefix)


def module_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``(path, module_fqn)``: the module in the nearest directory above each file."""
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    asked = files.select("path", parent.alias("directory"))
    found = longest_prefix(asked, modules, "directory", "path_prefix", "/")
    return found.select("path", "module_fqn")


def module_parents(modules: DataFrame) -> DataFrame:
    """``(module_fqn, parent)``: the module in the nearest directory above, or else the root module: the shallowest directory, first by name."""
    above = modules.filter("path_prefix != ''").select(F.col("module_fqn"), F.regexp_replace("path_prefix", r"/?[^/]*$", "").alias("directory"))
    outer = modules.select("path_prefix", F.col("module_fqn").alias("parent"))
    found = longest_prefix(above, outer, "directory", "path_prefix", "/").select("module_fqn", "parent")
    depth = F.size(F.split("path_prefix", "/"))
    root = modules.agg(F.min_by("module_fqn", F.struct(depth.alias("d"), "path_prefix")).alias("root"))
    rest = modules.select("module_fqn").join(found, "module_fqn", "left").crossJoin(root)
    return rest.select("module_fqn", F.coalesce("parent", F.when(F.col("root") != F.col("module_fqn"), F.col("root"))).alias("parent"))


def resolve_names(names: DataFrame, contexts: DataFrame, types: DataFrame) -> DataFrame:
    """``(context_id, name, fqn, rule)``: the type that a simple name means in a file.

    names (context_id, name); contexts (context_id, package, imports); types (fqn). The first rule that gives a known type holds:
    an explicit import, the same package, a .* import, java.lang, the default package. Ties go to the first FQN.
    """
    asked = names.join(contexts, "context_id", "left")
    imports = asked.select("context_id", "name", F.explode("imports").alias("i"))
    explicit = imports.filter(naming.last_dotted(F.col("i")) == F.col("name")).select("context_id", "name", F.col("i").alias("fqn"), F.lit(1).alias("rule"))
    wild = imports.filter(F.col("i").endswith(".*")).select("context_id", "name", F.concat(F.regexp_replace("i", r"\*$", ""), "name").alias("fqn"), F.lit(3).alias("rule"))
    own = asked.filter(F.col("package").isNotNull()).select("context_id", "name", F.concat("package", F.lit("."), "name").alias("fqn"), F.lit(2).alias("rule"))
    lang = asked.select("context_id", "name", F.concat(F.lit("java.lang."), "name").alias("fqn"), F.lit(4).alias("rule"))
    bare = asked.select("context_id", "name", F.col("name").alias("fqn"), F.lit(5).alias("rule"))
    candidates = explicit.unionByName(own).unionByName(wild).unionByName(lang).unionByName(bare)
    known = candidates.join(types.select("fqn").distinct(), "fqn", "left_semi")
    best = known.groupBy("context_id", "name").agg(F.min(F.struct("rule", "fqn")).alias("best"))
    return best.select("context_id", "name", F.col("best.fqn").alias("fqn"), F.col("best.rule").alias("rule"))


def guess_names(names: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(context_id, name, fqn)`` without a look at the graph: primitive, dotted, imported, java.lang, the current package."""
    asked = names.join(contexts, "context_id", "left")
    name = F.col("name")
    imported = F.get(F.filter("imports", lambda i: naming.last_dotted(i) == name), F.lit(0))
    guess = F.when(name.isin(*PRIMITIVES), name).when(name.contains("."), name).when(imported.isNotNull(), imported)
    guess = guess.when(name.isin(*JAVA_LANG), F.concat(F.lit("java.lang."), name)).when(F.col("package").isNotNull(), F.concat("package", F.lit("."), name)).otherwise(name)
    return asked.select("context_id", "name", guess.alias("fqn"))
