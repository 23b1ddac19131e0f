"""Names as columns: members, signatures, tokens, paths and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrograph.schema import KIND_WEIGHTS, LANGUAGES, MEMBER_KINDS, SYMBOL_KINDS, TYPE_KINDS

SIGNATURE = r"^(.*)#([^(#]*)\((.*)\)$"
PLAIN_MEMBER = r"^(.*)#([^#]*)$"


def is_member(fqn: Column) -> Column:
    return fqn.contains("#")


def member_owner(fqn: Column) -> Column:
    """What stands before the last #, or null."""
    return F.when(is_member(fqn), F.regexp_extract(fqn, PLAIN_MEMBER, 1))


def member_name(fqn: Column) -> Column:
    return F.when(is_member(fqn), F.regexp_extract(fqn, PLAIN_MEMBER, 2))


def type_part(fqn: Column) -> Column:
    return F.coalesce(member_owner(fqn), fqn)


def has_signature(fqn: Column) -> Column:
    return fqn.rlike(SIGNATURE)


def strip_signature(fqn: Column) -> Column:
    return F.regexp_replace(fqn, r"\(.*\)$", "")


def signature_parameters(fqn: Column) -> Column:
    """Parameter types of a signed member; none for (), null for anything else."""
    inside = F.regexp_extract(fqn, SIGNATURE, 3)
    return F.when(has_signature(fqn), F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, ",")))


def format_method(owner: Column, name: Column, types: Column) -> Column:
    return F.concat(owner, F.lit("#"), name, F.lit("("), F.array_join(types, ","), F.lit(")"))


def simple_member(fqn: Column) -> Column:
    """Name of a member without its signature."""
    return strip_signature(member_name(fqn))


def simple_name(fqn: Column) -> Column:
    """The last segment by . : or #, signatures aside."""
    return F.element_at(F.split(strip_signature(fqn), "[.:#]"), -1)


def last_dotted(fqn: Column) -> Column:
    return F.element_at(F.split(fqn, r"\."), -1)


def render(parent: Column, parent_kind: Column, name: Column, kind: Column) -> Column:
    """A child's FQN: # before a type's member, else a dot."""
    member = parent_kind.isin(*TYPE_KINDS) & kind.isin(*MEMBER_KINDS)
    return F.when(parent.isNull(), name).otherwise(F.concat(parent, F.when(member, F.lit("#")).otherwise(F.lit(".")), name))


def fqn_tokens(fqn: Column) -> Column:
    return F.filter(F.split(fqn, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def scouting_context(fqn: Column, name: Column) -> Column:
    """The token before the name, where the last token is the name; else null."""
    tokens = fqn_tokens(fqn)
    return F.when((F.size(tokens) > 1) & (F.element_at(tokens, -1) == name), F.get(tokens, F.size(tokens) - 2))


def dotted_prefixes(fqn: Column, separator: str = ".") -> Column:
    """All prefixes that end at a separator, the whole among them, shortest first."""
    parts = F.split(fqn, rf"\{separator}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def shorten(fqn: Column) -> Column:
    """Initials for all but the last two dotted segments."""
    parts = F.split(fqn, r"\.")
    n = F.size(parts)
    head = F.transform(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda p: F.substring(p, 1, 1))
    return F.when(n <= 2, fqn).otherwise(F.concat_ws(".", head, F.slice(parts, n - 1, F.lit(2))))


def kind_weight(kind: Column) -> Column:
    w = F.lit(99)
    for name, value in KIND_WEIGHTS.items():
        w = F.when(kind == name, value).otherwise(w)
    return w


def symbol_kind(kind: Column) -> Column:
    w = F.lit(13)
    for name, value in SYMBOL_KINDS.items():
        w = F.when(kind == name, value).otherwise(w)
    return w


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "^file://", ""), "/"), -1)


def language_of(path: Column) -> Column:
    """By extension; an unknown one is its own language, and a name without one has none."""
    name = file_name(path)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    lang = F.when(ext != "", ext)
    for key, value in LANGUAGES.items():
        lang = F.when(ext == key, value).otherwise(lang)
    return lang


def relevant(path: Column) -> Column:
    name = file_name(path)
    return ~(name.startswith(".") | name.isin("target", "build", "node_modules"))


def is_java(path: Column) -> Column:
    return F.lower(path).endswith(".java")


GRADLE_NAMES = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")


def is_build(path: Column) -> Column:
    return file_name(path).isin(*GRADLE_NAMES)


def location_text(path: Column, start_line: Column) -> Column:
    return F.when(path.isNotNull(), F.concat(file_name(path), F.lit(":"), (start_line + 1).cast("string")))


def listed_name(name: Column, kind: Column) -> Column:
    """Containers end in a slash."""
    return F.when(kind.isin("package", "module", "project", *TYPE_KINDS), F.concat(name, F.lit("/"))).otherwise(name)


def human_size(size: Column) -> Column:
    k, m, g = 1024.0, 1024.0**2, 1024.0**3
    tenths = lambda unit, name: F.concat((F.floor(size * 10 / unit + 0.5) / 10).cast("string"), F.lit(name))
    return F.when(size < k, F.format_string("%d B", size)).when(size < m, tenths(k, " KB")).when(size < g, tenths(m, " MB")).otherwise(tenths(g, " GB"))


def age(seconds: Column) -> Column:
    whole = lambda unit, text: F.concat(F.floor(seconds / unit).cast("string"), F.lit(text))
    return F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m ago")).when(seconds < 86400, whole(3600, "h ago")).otherwise(whole(86400, "d ago"))
