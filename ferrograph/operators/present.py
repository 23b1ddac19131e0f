"""What is shown of nodes: signatures, details, hover texts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming


def short_type(t: Column) -> Column:
    return F.regexp_replace(t, r"(?:[\p{L}_$][\p{L}\p{N}_$]*\.)+", "")


def parameter_list(parameters: Column) -> Column:
    def one(p: Column) -> Column:
        dots = F.when(p["is_varargs"], F.concat(F.regexp_replace(short_type(p["type_display"]), r"(\[\]|\.\.\.)$", ""), F.lit("..."))).otherwise(short_type(p["type_display"]))
        return F.concat(p["name"], F.lit(": "), dots)

    return F.array_join(F.transform(parameters, one), ", ")


def signature(kind: Column, name: Column, parameters: Column, type_display: Column) -> Column:
    short, plain = naming.strip_signature(name), short_type(type_display)
    args = F.concat(F.lit("("), F.coalesce(parameter_list(parameters), F.lit("")), F.lit(")"))
    out = F.when(kind == "method", F.concat(short, args, F.lit(" -> "), F.coalesce(plain, F.lit("void"))))
    out = out.when(kind == "constructor", F.concat(short, args)).when(kind == "field", F.concat(short, F.lit(": "), F.coalesce(plain, F.lit("?"))))
    for k, word in (("class", "class "), ("interface", "interface "), ("annotation", "@interface "), ("enum", "enum ")):
        out = out.when(kind == k, F.concat(F.lit(word), name))
    return out.otherwise(name)


def detail(fqn: Column) -> Column:
    owner = F.coalesce(naming.member_owner(fqn), F.when(fqn.contains("."), F.regexp_replace(fqn, r"\.[^.]*$", "")))
    return F.when(owner.isNotNull(), F.concat(F.lit("*Defined in `"), owner, F.lit("`*")))


def display(nodes: DataFrame) -> DataFrame:
    """The display projection, with a generic form for languages that have none of their own."""
    c = F.col
    return nodes.select(
        c("fqn").alias("id"), "name", "kind", "lang", "source", "status", F.array_join("modifiers", " ").alias("modifiers"), detail(c("fqn")).alias("detail"),
        signature(c("kind"), c("name"), c("parameters"), c("type_display")).alias("signature"), naming.location_text(c("path"), c("range.start_line")).alias("location"),
    )


def dependency_detail(group: Column, version: Column, is_project: Column) -> Column:
    return F.concat(F.concat_ws(":", group, version), F.when(is_project, F.lit(" (Project)")).otherwise(F.lit("")))


def hover(shown: DataFrame) -> DataFrame:
    """Markdown for a symbol, from its display projection."""
    code = F.concat(F.lit("```java\n"), F.concat_ws(" ", F.when(F.col("modifiers") != "", F.col("modifiers")), "signature"), F.lit("\n```"))
    return shown.select("id", F.concat_ws("\n\n", code, "detail").alias("markdown"))


def listing(nodes: DataFrame) -> DataFrame:
    """As a shell lists them: by kind, then name."""
    return nodes.withColumn("weight", naming.kind_weight(F.col("kind"))).orderBy("weight", "name", "fqn")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
