"""The type system as joins and expressions: subtyping, overload resolution, generics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDENING = {"byte": ("short", "int", "long", "float", "double"), "short": ("int", "long", "float", "double"), "char": ("int", "long", "float", "double"), "int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",)}
BOXES = {"byte": "Byte", "short": "Short", "char": "Character", "int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean"}
BOX_SUPERS = {"Byte": "Number", "Short": "Number", "Integer": "Number", "Long": "Number", "Float": "Number", "Double": "Number"}
OBJECT = "java.lang.Object"


def qualified(t: Column) -> Column:
    """java.lang types may be written short."""
    known = [*BOXES.values(), "Object", "String", "Number", "Comparable", "CharSequence"]
    return F.when(t.isin(*known), F.concat(F.lit("java.lang."), t)).otherwise(t)


def conversions(spark: SparkSession) -> DataFrame:
    """``(sub, sup, cost)`` of the primitive types: widening, boxing, unboxing then widening. A fixed, small table."""
    rows = [(a, b, 1 + k) for a, wide in WIDENING.items() for k, b in enumerate(wide)]
    for p, box in BOXES.items():
        full = f"java.lang.{box}"
        rows += [(p, full, 10), (full, p, 10)] + [(full, w, 11 + k) for k, w in enumerate(WIDENING.get(p, ()))]
        if box in BOX_SUPERS:
            rows += [(p, f"java.lang.{BOX_SUPERS[box]}", 11), (full, f"java.lang.{BOX_SUPERS[box]}", 1)]
    return spark.createDataFrame(rows, "sub string, sup string, cost int")


def erased(t: Column) -> Column:
    return F.regexp_replace(t, r"<.*>", "")


def array_base(t: Column) -> Column:
    return F.regexp_replace(t, r"(\[\])+$", "")


def subtype_pairs(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """pairs (sub, sup) with ``is_subtype``, by the language's rules over types as text.

    Equal; Object over every reference; widening, boxing and unboxing; the class closure; arrays by their elements, whatever
    the number of dimensions; generics only if they are equal, or if one side is raw.
    """
    spark = pairs.sparkSession
    asked = pairs.select("sub", "sup").distinct()
    a, b = qualified(F.col("sub")), qualified(F.col("sup"))
    is_array = lambda t: t.endswith("[]")
    generic = lambda t: t.contains("<")
    rows = asked.withColumn("a", F.when(is_array(a) & is_array(b), array_base(a)).otherwise(a)).withColumn("b", F.when(is_array(a) & is_array(b), array_base(b)).otherwise(b))
    a, b = F.col("a"), F.col("b")
    fixed = conversions(spark).select(F.col("sub").alias("a"), F.col("sup").alias("b"), F.lit(True).alias("converts"))
    known = closure.select(F.col("start").alias("ea"), F.col("reached").alias("eb"), F.lit(True).alias("below")).distinct()
    rows = rows.join(fixed, ["a", "b"], "left").withColumn("ea", erased(a)).withColumn("eb", erased(b)).join(known, ["ea", "eb"], "left")
    primitive = a.isin(*BOXES)
    plain = ~(generic(a) & generic(b))
    yes = (a == b) | ((b == OBJECT) & ~primitive) | ((b == OBJECT) & primitive) | F.coalesce("converts", F.lit(False)) | (F.coalesce("below", F.lit(False)) & plain) | ((F.col("ea") == F.col("eb")) & plain)
    verdict = rows.select("sub", "sup", yes.alias("is_subtype"))
    return pairs.join(verdict, ["sub", "sup"])


def resolve_overloads(calls: DataFrame, members: DataFrame, closure: DataFrame) -> DataFrame:
    """``(call_id, fqn, phase)``: the chosen member of each call.

    calls (call_id, owner, method, args); members (owner_fqn, simple_name, fqn, params, is_varargs), where a varargs member's last
    parameter is its element type. Phases: 1 all types equal, 2 all convertible, 3 varargs equal, 4 varargs convertible. Among those
    of the best phase, the most specific: the one with most parameters that are subtypes of the others'; ties by FQN.
    """
    pairs = calls.join(members, (F.col("owner") == F.col("owner_fqn")) & (F.col("method") == F.col("simple_name")))
    n, m = F.size("args"), F.size("params")
    fixed = pairs.filter(n == m).withColumn("formal", F.col("params")).withColumn("is_expanded", F.lit(False))
    spread = pairs.filter(F.col("is_varargs") & (n >= m - 1)).withColumn("is_expanded", F.lit(True))
    spread = spread.withColumn("formal", F.concat(F.slice("params", F.lit(1), m - 1), F.array_repeat(F.element_at("params", -1), n - m + 1)))
    candidates = fixed.filter(~F.col("is_varargs")).unionByName(spread).select("call_id", "fqn", "args", "formal", "is_expanded")
    each = candidates.select("call_id", "fqn", "is_expanded", F.explode_outer(F.arrays_zip("args", "formal")).alias("p"))
    each = each.select("call_id", "fqn", "is_expanded", F.col("p.args").alias("sub"), F.col("p.formal").alias("sup"))
    judged = subtype_pairs(each.select("sub", "sup").dropna().distinct(), closure)
    each = each.join(judged, ["sub", "sup"], "left")
    empty = F.col("sub").isNull() & F.col("sup").isNull()
    equal = F.bool_and(empty | (qualified(F.col("sub")) == qualified(F.col("sup")))).alias("equal")
    fits = F.bool_and(empty | F.coalesce("is_subtype", F.lit(False))).alias("fits")
    by = each.groupBy("call_id", "fqn", "is_expanded").agg(equal, fits)
    phase = F.when(F.col("equal"), 1).when(F.col("fits"), 2) + F.when(F.col("is_expanded"), 2).otherwise(0)
    ranked = by.withColumn("phase", phase).filter(F.col("phase").isNotNull())
    best = ranked.join(ranked.groupBy("call_id").agg(F.min("phase").alias("phase")), ["call_id", "phase"]).join(candidates.select("call_id", "fqn", "is_expanded", "formal"), ["call_id", "fqn", "is_expanded"])
    x, y = best.alias("x"), best.alias("y")
    duels = x.join(y, F.col("x.call_id") == F.col("y.call_id")).filter(F.col("x.fqn") != F.col("y.fqn"))
    zipped = duels.select(F.col("x.call_id").alias("call_id"), F.col("x.fqn").alias("fqn"), F.explode(F.arrays_zip(F.col("x.formal").alias("s"), F.col("y.formal").alias("t"))).alias("p")).select("call_id", "fqn", F.col("p.s").alias("sub"), F.col("p.t").alias("sup"))
    won = subtype_pairs(zipped.select("sub", "sup").dropna().distinct(), closure)
    score = zipped.join(won, ["sub", "sup"]).groupBy("call_id", "fqn").agg(F.sum(F.when(F.col("sub") == F.col("sup"), 0).when(F.col("is_subtype"), 1).otherwise(-1)).alias("score"))
    final = best.select("call_id", "fqn", "phase").distinct().join(score, ["call_id", "fqn"], "left")
    pick = final.groupBy("call_id").agg(F.min_by(F.struct("fqn", "phase"), F.struct((-F.coalesce("score", F.lit(0))).alias("s"), "fqn")).alias("best"))
    return pick.select("call_id", "best.fqn", "best.phase")


# Types as trees: {"raw": "T"}, {"id": "a.B"}, {"generic": base, "args": [...]}, {"array": element, "dims": n},
# {"wildcard": bound or null, "upper": true}, {"unknown": true}.


def is_variable(t: dict) -> bool:
    name = t.get("raw") or t.get("id") or ""
    return len(name) == 1 and name.isupper()


def unify(pattern: dict, actual: dict, found: dict | None = None) -> dict | None:
    """Bindings of the pattern's variables under which it is the actual type; None where there are none."""
    found = {} if found is None else found
    if is_variable(pattern):
        name = pattern.get("raw") or pattern["id"]
        if name in found and found[name] != actual:
            return None
        return {**found, name: actual}
    if "generic" in pattern and "generic" in actual:
        if len(pattern["args"]) != len(actual["args"]):
            return None
        out = unify(pattern["generic"], actual["generic"], found)
        for p, a in zip(pattern["args"], actual["args"], strict=True):
            out = None if out is None else unify(p, a, out)
        return out
    if "array" in pattern and "array" in actual:
        return unify(pattern["array"], actual["array"], found) if pattern["dims"] == actual["dims"] else None
    if "wildcard" in pattern:
        return found if pattern["wildcard"] is None else unify(pattern["wildcard"], actual.get("wildcard", actual) or {}, found)
    return found if pattern == actual else None


def substitute(t: dict | None, bindings: dict) -> dict | None:
    if t is None:
        return None
    if is_variable(t):
        return bindings.get(t.get("raw") or t.get("id"), t)
    if "generic" in t:
        return {"generic": substitute(t["generic"], bindings), "args": [substitute(a, bindings) for a in t["args"]]}
    if "array" in t:
        return {**t, "array": substitute(t["array"], bindings)}
    if "wildcard" in t:
        return {**t, "wildcard": substitute(t["wildcard"], bindings)}
    return t


def display(t: dict | None) -> str:
    """As shown to a user: last segments, arguments, dimensions, ? for what isn't known."""
    if not t or "unknown" in t or "wildcard" in t:
        return "?"
    if "generic" in t:
        return f"{display(t['generic'])}<{', '.join(map(display, t['args']))}>"
    if "array" in t:
        return display(t["array"]) + "[]" * t["dims"]
    return (t.get("id") or t["raw"]).rsplit(".", 1)[-1]


def parse_type(text: str) -> dict:
    """A type as written in source."""
    text = text.strip()
    if text.endswith("..."):
        return {"array": parse_type(text[:-3]), "dims": 1}
    dims = 0
    while text.endswith("[]"):
        text, dims = text[:-2].rstrip(), dims + 1
    if dims:
        return {"array": parse_type(text), "dims": dims}
    if text.startswith("?"):
        bound = text[1:].strip()
        upper = not bound.startswith("super")
        return {"wildcard": parse_type(bound.split(None, 1)[1]) if bound else None, "upper": upper}
    if text.endswith(">") and "<" in text:
        base, _, rest = text.partition("<")
        args, depth, last = [], 0, 0
        rest = rest[:-1]
        for k, c in enumerate(rest):
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                args.append(rest[last:k])
                last = k + 1
        return {"generic": {"raw": base.strip()}, "args": [parse_type(a) for a in [*args, rest[last:]] if a.strip()]}
    return {"raw": text} if text else {"unknown": True}


def erase(t: dict) -> str:
    """Signature text: no arguments, [] for each dimension, ? for wildcards."""
    if "generic" in t:
        return erase(t["generic"])
    if "array" in t:
        return erase(t["array"]) + "[]" * t["dims"]
    return "?" if "wildcard" in t or "unknown" in t else t.get("id") or t["raw"]


def references_in(t: dict) -> list[str]:
    """Names of the types in a type, without primitives."""
    if "generic" in t:
        return references_in(t["generic"]) + [n for a in t["args"] for n in references_in(a)]
    if "array" in t:
        return references_in(t["array"])
    if "wildcard" in t:
        return references_in(t["wildcard"]) if t["wildcard"] else []
    name = t.get("id") or t.get("raw")
    return [] if not name or name in BOXES or name == "void" or is_variable(t) else [name]


def as_json(t: dict) -> str:
    return json.dumps(t, sort_keys=True, separators=(",", ":"))
