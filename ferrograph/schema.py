"""Row types of the graph, and its closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("package", "module", "class", "interface", "enum", "annotation", "method", "constructor", "field", "variable", "project", "dependency", "task", "plugin")
TYPE_KINDS = ("class", "interface", "enum", "annotation")
MEMBER_KINDS = ("method", "field", "constructor")
CALLER_KINDS = ("method", "constructor")
CONTAINS, INHERITS, IMPLEMENTS, TYPED_AS, DECORATED_BY, USES = EDGE_TYPES = ("Contains", "InheritsFrom", "Implements", "TypedAs", "DecoratedBy", "UsesDependency")
SOURCES = ("project", "external", "builtin")
STATUSES = ("unresolved", "stubbed", "resolved")
#: Kinds that a symbol with some intent may have; None allows all.
INTENT_KINDS = {"type": TYPE_KINDS, "method": ("method", "constructor"), "field": ("field",), "variable": (), "unknown": None}
LANGUAGES = {"java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "gradle": "gradle", "go": "go", "c": "c", "cpp": "cpp", "scala": "scala"}
KIND_WEIGHTS = {"package": 1, "class": 2, "interface": 3, "enum": 4, "annotation": 5, "constructor": 6, "method": 7, "field": 8}
SYMBOL_KINDS = {"package": 4, "module": 2, "class": 5, "interface": 11, "enum": 10, "annotation": 11, "method": 6, "constructor": 9, "field": 8, "variable": 13, "project": 2, "dependency": 4, "task": 12, "plugin": 2}

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RANGE = struct(start_line=I, start_col=I, end_line=I, end_col=I)
PARAMETER = struct(name=S, type_display=S, type_erased=S, is_varargs=B)
NODE = struct(
    fqn=S, parent_fqn=S, name=S, kind=S, lang=S, source=S, status=S, path=S, range=RANGE, selection_range=RANGE,
    modifiers=T.ArrayType(S), type_parameters=T.ArrayType(S), type_erased=S, type_display=S, parameters=T.ArrayType(PARAMETER), is_constructor=B,
)
EDGE = struct(src=S, dst=S, edge_type=S, src_path=S)
FILE = struct(path=S, content_hash=L, last_modified=L, lang=S, content=S)
TOKEN = struct(token=S, path=S)
OCCURRENCE = struct(path=S, token=S, start_line=I, start_col=I, end_line=I, end_col=I)
ROUTE = struct(prefix=S, asset_path=S, source_type=S, group=S, artifact=S, version=S)
MODULE = struct(path_prefix=S, module_fqn=S)


@dataclass
class Graph:
    """The tables of a project; those that a caller doesn't need may be None."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    tokens: DataFrame | None = None
    occurrences: DataFrame | None = None


class EngineError(Exception):
    """Of any query; the subclasses say what went wrong."""


class NotFound(EngineError):
    pass


class InvalidArgument(EngineError):
    pass


class UnsupportedCapability(EngineError):
    pass
