"""The Java front end: a tolerant scanner and declaration parser, run over files in Arrow batches, and the joins that bind names.

``parse`` is plain Python over one text; ``parse_files`` maps it over a table of files; ``index`` turns what it finds into a graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions import naming
from ferrograph.operators import match, traverse, typesys
from ferrograph.schema import CONTAINS, DECORATED_BY, IMPLEMENTS, INHERITS, NODE, TYPED_AS, Graph

SCAN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>\.\.\.|->|::|[{}()\[\];,.@=<>?&]|.)""",
    re.DOTALL,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = frozenset("if else for while do switch case return new this super try catch finally throw throws instanceof break continue import package class interface enum void int long short byte char float double boolean true false null assert var yield extends implements".split()) | MODIFIERS
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int

    @property
    def end(self) -> tuple[int, int]:
        rows = self.text.split("\n")
        return (self.line, self.col + len(self.text)) if len(rows) == 1 else (self.line + len(rows) - 1, len(rows[-1]))


def scan(text: str) -> list[Token]:
    """Tokens with zero-based lines and columns in code points; comments and white space are left out."""
    out, line, start = [], 0, 0
    for m in SCAN.finditer(text):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, m.start() - start))
        if (n := m[0].count("\n")) > 0:
            line += n
            start = m.start() + m[0].rindex("\n") + 1
    return out


@dataclass
class Unit:
    package: str | None = None
    imports: list[str] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    relations: list[tuple[str, str, str]] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)


class Parser:
    """Declarations first; what isn't understood is stepped over up to the next semicolon or block."""

    def __init__(self, text: str):
        self.t, self.i, self.unit = scan(text), 0, Unit()
        self.last = self.t[-1].end if self.t else (0, 0)

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def word(self, k: int = 0) -> bool:
        return self.i + k < len(self.t) and self.t[self.i + k].kind == "word" and self.peek(k) not in KEYWORDS

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1].text if self.i <= len(self.t) else ""

    def accept(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def end(self) -> tuple[int, int]:
        return self.t[min(self.i, len(self.t)) - 1].end if self.t else (0, 0)

    def skip_balanced(self, a: str, b: str) -> None:
        depth = 0
        while self.i < len(self.t):
            x = self.take()
            depth += (x == a) - (x == b)
            if not depth:
                return

    def name(self) -> str:
        parts = [self.take()]
        while self.peek() == "." and self.word(1):
            self.i += 1
            parts.append(self.take())
        return ".".join(parts)

    def run(self) -> Unit:
        while self.i < len(self.t):
            x = self.peek()
            if x == "package":
                self.i += 1
                self.unit.package = self.name()
            elif x == "import":
                self.i += 1
                self.accept("static")
                full = self.name()
                self.unit.imports.append(full + ".*" if self.peek() == "." and self.peek(1) == "*" else full)
                while self.i < len(self.t) and self.take() != ";":
                    pass
            elif not self.declaration(self.unit.package, None, {}):
                self.i += 1
        return self.unit

    def head(self) -> tuple[list[str], list[str]]:
        """Modifiers and annotations."""
        modifiers, marks = [], []
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.i += 1
                marks.append(self.name())
                if self.peek() == "(":
                    self.skip_balanced("(", ")")
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in ("->", ":")):
                if (x := self.take()) not in modifiers:
                    modifiers.append(x)
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
            else:
                return modifiers, marks

    def type(self) -> str | None:
        """The text of a type, or None where none stands."""
        if self.peek() == "@":
            self.head()
        if self.peek() == "?":
            text = self.take()
            if self.peek() in ("extends", "super"):
                text += f" {self.take()} {self.type() or ''}"
            return text
        if self.i >= len(self.t) or self.t[self.i].kind != "word" or (self.peek() in KEYWORDS and self.peek() not in typesys.BOXES and self.peek() not in ("void", "var")):
            return None
        text = self.name()
        if self.peek() == "<":
            back, args = self.i, []
            self.i += 1
            while self.peek() != ">":
                arg = self.type()
                if arg is None and self.peek() != ">":
                    self.i = back
                    return text
                args.append(arg or "")
                while self.accept("&"):
                    self.type()
                if not self.accept(","):
                    break
            if not self.accept(">"):
                self.i = back
                return text
            text += f"<{', '.join(a for a in args if a)}>"
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            text += "[]"
        return text

    def parameters_of_type(self) -> list[str]:
        names = []
        if self.peek() == "<":
            at = self.i
            self.skip_balanced("<", ">")
            depth = 0
            for k in range(at, self.i):
                x = self.t[k].text
                depth += (x == "<") - (x == ">")
                if depth == 1 and self.t[k].kind == "word" and self.t[k - 1].text in ("<", ","):
                    names.append(x)
        return names

    def relate(self, src: str, dst: str, kind: str) -> None:
        self.unit.relations.append((src, dst, kind))

    def typed(self, src: str, text: str | None) -> None:
        for n in dict.fromkeys(typesys.references_in(typesys.parse_type(text or ""))):
            self.relate(src, n, TYPED_AS)

    def node(self, fqn: str, parent: str | None, name: str, kind: str, start: tuple[int, int], at: Token, **more) -> dict:
        node = {"fqn": fqn, "parent_fqn": parent, "name": name, "kind": kind, "range": (*start, *start), "selection_range": (at.line, at.col, *at.end), "modifiers": [], "type_parameters": [], "type_display": None, "parameters": [], "marks": [], **more}
        self.unit.nodes.append(node)
        return node

    def declaration(self, owner: str | None, kind: str | None, fields: dict[str, str]) -> bool:
        """A type, or within one a member; False where neither begins here."""
        back = self.i
        if self.i >= len(self.t):
            return False
        start = (self.t[self.i].line, self.t[self.i].col)
        modifiers, marks = self.head()
        annotation = self.peek() == "@" and self.peek(1) == "interface"
        if annotation:
            self.i += 1
        if (self.peek() in ("class", "interface", "enum") or (self.peek() == "record" and self.word(1) and self.peek(2) in ("(", "<"))) and self.word(1):
            what = "annotation" if annotation else TYPE_WORDS[self.peek()]
            record = self.take() == "record"
            self.type_body(owner, what, start, modifiers, marks, record)
            return True
        if kind is not None and self.member(owner, kind, start, modifiers, marks, fields):
            return True
        self.i = back
        return False

    def type_body(self, owner: str | None, what: str, start: tuple[int, int], modifiers: list[str], marks: list[str], record: bool) -> None:
        at = self.t[self.i]
        name = self.take()
        fqn = f"{owner}.{name}" if owner else name
        node = self.node(fqn, owner, name, what, start, at, modifiers=modifiers, type_parameters=self.parameters_of_type(), marks=marks)
        for m in marks:
            self.relate(fqn, m, DECORATED_BY)
        fields: dict[str, str] = {}
        if record and self.peek() == "(":
            for p in self.parameters():
                self.node(f"{fqn}#{p['name']}", fqn, p["name"], "field", start, at, type_display=p["type_display"])
                self.typed(f"{fqn}#{p['name']}", p["type_display"])
                fields[p["name"]] = p["type_display"]
        while self.i < len(self.t) and self.peek() != "{":
            x = self.take()
            if x in ("extends", "implements"):
                edge = IMPLEMENTS if x == "implements" else INHERITS
                while (t := self.type()) is not None:
                    self.relate(fqn, typesys.erase(typesys.parse_type(t)), edge)
                    if not self.accept(","):
                        break
        if self.accept("{"):
            if what == "enum":
                self.constants(fqn)
            first = len(self.unit.uses)
            while self.i < len(self.t) and self.peek() != "}":
                if not self.declaration(fqn, name, fields):
                    if self.peek() == "{":
                        self.body(fqn, fqn, fields, {})
                    else:
                        self.i += 1
            self.accept("}")
            for use in self.unit.uses[first:]:  # fields may stand after what uses them
                if use["pending"] and use["owner"] == fqn:
                    use["receiver"], use["pending"] = fields.get(use["pending"], use["receiver"]), None
        node["range"] = (*start, *self.end())

    def constants(self, owner: str) -> None:
        while self.word() or self.peek() == "@":
            self.head()
            at = self.t[self.i]
            name = self.take()
            self.node(f"{owner}#{name}", owner, name, "field", (at.line, at.col), at, type_display=owner.rsplit(".", 1)[-1])["range"] = (at.line, at.col, *at.end)
            if self.peek() == "(":
                self.skip_balanced("(", ")")
            if self.peek() == "{":
                self.skip_balanced("{", "}")
            if not self.accept(","):
                break
        self.accept(";")

    def parameters(self) -> list[dict]:
        out = []
        self.accept("(")
        while self.i < len(self.t) and self.peek() != ")":
            self.head()
            t = self.type()
            if t is None:
                self.i += 1
                continue
            dots = self.accept("...")
            name = self.take() if self.word() else "this" if self.accept("this") else ""
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
                t += "[]"
            t += "[]" if dots else ""
            if name and name != "this":
                out.append({"name": name, "type_display": t, "type_erased": typesys.erase(typesys.parse_type(t)), "is_varargs": dots})
            self.accept(",")
        self.accept(")")
        return out

    def member(self, owner: str, type_name: str, start: tuple[int, int], modifiers: list[str], marks: list[str], fields: dict[str, str]) -> bool:
        generics = self.parameters_of_type()
        modifiers += [m for m in self.head()[0] if m not in modifiers]
        constructor = self.peek() == type_name and self.peek(1) == "("
        result = None if constructor else self.type()
        if not constructor and (result is None or not self.word()):
            return False
        at = self.t[self.i]
        name = self.take()
        if self.peek() == "(":
            ps = self.parameters()
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
            fqn = f"{owner}#{name}({','.join(p['type_erased'] for p in ps)})"
            node = self.node(fqn, owner, name, "constructor" if constructor else "method", start, at, modifiers=modifiers, type_parameters=generics, type_display=result, parameters=ps, marks=marks)
            for m in marks:
                self.relate(fqn, m, DECORATED_BY)
            for t in [result, *(p["type_display"] for p in ps)]:
                self.typed(fqn, t)
            while self.i < len(self.t) and self.peek() not in ("{", ";", "}"):
                self.i += 1
            if self.peek() == "{":
                self.body(fqn, owner, fields, {p["name"]: p["type_display"] for p in ps})
            else:
                self.accept(";")
            node["range"] = (*start, *self.end())
            return True
        while True:
            t = result
            while self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
                t += "[]"
            fqn = f"{owner}#{name}"
            node = self.node(fqn, owner, name, "field", start, at, modifiers=modifiers, type_display=t, marks=marks)
            for m in marks:
                self.relate(fqn, m, DECORATED_BY)
            self.typed(fqn, t)
            fields[name] = t
            if self.accept("="):
                self.expression(owner, fields)
            node["range"] = (*start, *self.end())
            if not self.accept(",") or not self.word():
                break
            at = self.t[self.i]
            name = self.take()
        self.accept(";")
        return True

    def expression(self, owner: str, fields: dict[str, str]) -> None:
        """An initialiser up to its comma or semicolon."""
        depth = 0
        scopes = [dict.fromkeys(())]
        while self.i < len(self.t):
            x = self.peek()
            if not depth and x in (",", ";", "}"):
                return
            depth += (x in "([{") - (x in ")]}")
            self.use(owner, fields, scopes)

    def body(self, fqn: str, owner: str, fields: dict[str, str], parameters: dict[str, str]) -> None:
        """A block: uses of names, with what is known of their receivers from the scopes around them."""
        scopes: list[dict[str, str]] = [parameters]
        while self.i < len(self.t):
            x = self.peek()
            if x == "{":
                scopes.append({})
            elif x == "}":
                scopes.pop()
                if len(scopes) == 1:
                    self.i += 1
                    return
            elif x in ("(", ";", "{", "}") or self.t[self.i - 1].text in ("{", "}", ";", "(", "final", ","):
                self.local(owner, scopes)
            self.use(owner, fields, scopes)

    def local(self, owner: str, scopes: list[dict[str, str]]) -> None:
        """A local variable's declaration, if one begins here: noted, and stepped over up to its name."""
        back = self.i
        if self.peek() in ("(", ";"):
            return
        self.head()
        t = self.type()
        if t is not None and self.word() and self.peek(1) in ("=", ";", ":", ",", ")"):
            for n in typesys.references_in(typesys.parse_type(t)):
                k = next((j for j in range(back, self.i) if self.t[j].text == n.rsplit(".", 1)[-1]), back)
                self.add(owner, self.t[k], None, False, "type")
            name = self.peek()
            if t == "var":
                t = self.type_after_new() or ""
            scopes[-1][name] = t
            self.i += 1
            if self.i < len(self.t) and self.peek() not in ("=", ":", ",", ")", ";"):
                self.i = back
        else:
            self.i = back

    def type_after_new(self) -> str | None:
        if self.peek(1) == "=" and self.peek(2) == "new":
            back = self.i
            self.i += 3
            t = self.type()
            self.i = back
            return t
        return None

    def add(self, owner: str, at: Token, receiver: str | None, call: bool, kind: str, pending: str | None = None, args: int = -1) -> None:
        self.unit.uses.append({"owner": owner, "token": at.text, "range": (at.line, at.col, *at.end), "receiver": receiver, "is_call": call, "use": kind, "pending": pending, "args": args})

    def arguments(self, k: int) -> int:
        """Number of arguments of the list that opens at token k."""
        depth, n, some = 0, 0, False
        while k < len(self.t):
            x = self.t[k].text
            depth += (x in "([{") - (x in ")]}")
            if not depth:
                return n + some
            if depth == 1 and x == ",":
                n += 1
            elif x != "(" or depth > 1:
                some = True
            k += 1
        return n + some

    def use(self, owner: str, fields: dict[str, str], scopes: list[dict[str, str]]) -> None:
        at = self.t[self.i]
        self.i += 1
        if at.kind != "word" or at.text in KEYWORDS:
            return
        find = lambda n: next((s[n] for s in reversed(scopes) if s and n in s), None)
        before = self.t[self.i - 2].text if self.i > 1 else ""
        call = self.peek() == "("
        args = self.arguments(self.i) if call else -1
        if before == "new":
            self.i -= 1
            t = self.type() or at.text
            call = self.peek() == "("
            self.add(owner, at, typesys.erase(typesys.parse_type(t)), call, "new", args=self.arguments(self.i) if call else -1)
        elif before in (".", "::"):
            left = self.t[self.i - 3] if self.i > 2 else at
            receiver, pending = None, None
            if left.text == "this":
                receiver = owner
            elif left.text == "super":
                receiver = f"super:{owner}"
            elif left.kind == "word" and left.text not in KEYWORDS:
                chained = self.i > 3 and self.t[self.i - 4].text == "."
                if not chained or (self.i > 4 and self.t[self.i - 5].text == "this"):
                    own = None if chained else find(left.text)
                    receiver = own if own is not None else fields.get(left.text) or left.text
                    pending = left.text if own is None and left.text not in fields else None
            elif left.text == ")" and self.chained(left):
                receiver = self.chained(left)
            self.add(owner, at, typesys.erase(typesys.parse_type(receiver)) if receiver and not receiver.startswith("super:") else receiver, call or before == "::", "member", pending, args)
        elif call:
            self.add(owner, at, owner, True, "member", args=args)
        elif find(at.text) is None:
            self.add(owner, at, owner, False, "name")
        else:
            self.add(owner, at, None, False, "local")

    def chained(self, left: Token) -> str | None:
        """Type of ``new T(...)`` before a dot."""
        k, depth = self.i - 3, 0
        while k >= 0:
            x = self.t[k].text
            depth += (x == ")") - (x == "(")
            if not depth:
                return self.t[k - 1].text if k > 1 and self.t[k - 2].text == "new" else None
            k -= 1
        return None


def parse(text: str) -> Unit:
    return Parser(text).run()


RANGE = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
PARSED = (
    "path string, package string, imports array<string>, identifiers array<string>, "
    f"nodes array<struct<fqn:string,parent_fqn:string,name:string,kind:string,range:{RANGE},selection_range:{RANGE},modifiers:array<string>,type_parameters:array<string>,type_display:string,"
    "parameters:array<struct<name:string,type_display:string,type_erased:string,is_varargs:boolean>>>>, "
    f"relations array<struct<src:string,dst:string,edge_type:string>>, uses array<struct<owner:string,token:string,range:{RANGE},receiver:string,is_call:boolean,use:string,args:int>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each Java file (path, content), with all that its text tells."""
    span = ("start_line", "start_col", "end_line", "end_col")

    def row(path: str, content: str | None) -> tuple:
        unit = parse(content or "")
        nodes = [{k: (dict(zip(span, v, strict=True)) if k.endswith("range") else v) for k, v in n.items() if k != "marks"} for n in unit.nodes]
        uses = [{**{k: v for k, v in u.items() if k != "pending"}, "range": dict(zip(span, u["range"], strict=True))} for u in unit.uses]
        words = sorted({t.text for t in scan(content or "") if t.kind == "word" and t.text not in KEYWORDS})
        relations = [dict(zip(("src", "dst", "edge_type"), r, strict=True)) for r in dict.fromkeys(unit.relations)]
        return path, unit.package, unit.imports, words, nodes, relations, uses

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split(" ")[0] for p in ("path", "package", "imports", "identifiers", "nodes", "relations", "uses")]
        for batch in batches:
            yield pd.DataFrame([row(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=names)

    return files.filter(naming.is_java(F.col("path"))).select("path", "content").mapInPandas(run, PARSED)


def bind(rows: DataFrame, contexts: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """rows (path, ...) with ``bound``, what the type name in column ``name`` means in the file; names that nothing explains keep the heuristic's guess."""
    names = rows.select(F.col("path").alias("context_id"), F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    known = match.resolve_names(names, contexts, nodes).select("context_id", "name", "fqn")
    whole = names.join(nodes.select(F.col("fqn").alias("name")).distinct(), "name", "left_semi").select("context_id", "name", F.col("name").alias("whole"))
    guess = match.guess_names(names, contexts).select("context_id", "name", F.col("fqn").alias("guess"))
    table = names.join(known, ["context_id", "name"], "left").join(whole, ["context_id", "name"], "left").join(guess, ["context_id", "name"], "left")
    table = table.select(F.col("context_id").alias("path"), F.col("name").alias(name), F.coalesce("whole", "fqn", "guess").alias("bound"))
    return rows.join(table, ["path", name], "left")


def index(parsed: DataFrame) -> Graph:
    """The graph of parsed files: nodes with their packages, bound edges, tokens, and occurrences with what they resolve to."""
    inner = parsed.select("path", "package", F.explode("nodes").alias("n")).select("path", "package", "n.*").dropDuplicates(["fqn"])
    types = {f.name: f.dataType for f in NODE.fields}
    extra = {"lang": F.lit("java"), "source": F.lit("project"), "status": F.lit("resolved"), "type_erased": naming.strip_signature(F.regexp_replace("type_display", "<.*>", "")), "is_constructor": F.col("kind") == "constructor"}
    nodes = inner.select(*(extra.get(c, F.col(c) if c in inner.columns else F.lit(None)).cast(types[c]).alias(c) for c in types))
    packages = parsed.select("package").dropna().distinct().select(*({"fqn": F.col("package"), "name": naming.last_dotted(F.col("package")), "kind": F.lit("package"), **{k: v for k, v in extra.items() if k in ("lang", "source", "status")}}.get(c, F.lit(None)).cast(types[c]).alias(c) for c in types))
    nodes = nodes.unionByName(packages)
    contexts = parsed.select(F.col("path").alias("context_id"), "package", "imports")
    held = inner.filter("parent_fqn IS NOT NULL").select(F.col("parent_fqn").alias("src"), F.col("fqn").alias("dst"), F.lit(CONTAINS).alias("edge_type"), F.col("path").alias("src_path"))
    tops = inner.filter(F.col("kind").isin("class", "interface", "enum", "annotation") & F.col("package").isNotNull()).select(F.col("package").alias("src"), F.col("fqn").alias("dst"), F.lit(CONTAINS).alias("edge_type"), F.col("path").alias("src_path"))
    raw = parsed.select("path", F.explode("relations").alias("r")).select("path", "r.src", "r.edge_type", F.col("r.dst").alias("target"))
    owner_of = F.regexp_replace("src", "#.*$", "")
    near = raw.withColumn("inner_type", F.concat(owner_of, F.lit("."), "target")).join(nodes.select(F.col("fqn").alias("inner_type"), F.lit(True).alias("nested")).distinct(), "inner_type", "left")
    bound = bind(near, contexts, nodes, "target").select("src", F.when(F.col("nested"), F.col("inner_type")).otherwise(F.col("bound")).alias("dst"), "edge_type", F.col("path").alias("src_path"))
    edges = held.unionByName(tops).unionByName(bound).dropDuplicates(["src", "dst", "edge_type"])
    tokens = parsed.select(F.explode("identifiers").alias("token"), "path").distinct()
    graph = Graph(nodes, edges, None, tokens)
    graph.occurrences = resolve_uses(graph, parsed, contexts)
    return graph


def resolve_uses(graph: Graph, parsed: DataFrame, contexts: DataFrame) -> DataFrame:
    """Occurrences (path, token, range columns, is_call, resolved_fqn) of all uses.

    Members are looked up in the receiver's type, then in its ancestors, by name and number of arguments (else by name alone).
    """
    uses = parsed.select("path", F.explode("uses").alias("u")).select("path", "u.*")
    uses = uses.withColumn("parent_of", F.when(F.col("receiver").startswith("super:"), F.substring("receiver", 7, 10_000))).withColumn("plain", F.when(F.col("parent_of").isNull(), F.col("receiver")))
    supers = traverse.links(graph.edges).groupBy(F.col("a").alias("parent_of")).agg(F.min("b").alias("above"))
    typed = bind(uses, contexts, graph.nodes, "plain").withColumnRenamed("bound", "receiver_type").join(supers, "parent_of", "left")
    typed = typed.withColumn("type", F.coalesce("above", "receiver_type"))
    own = traverse.members(graph).join(graph.nodes.select("fqn", F.size(F.coalesce("parameters", F.array())).alias("n"), F.exists("parameters", lambda p: p["is_varargs"]).alias("open")), "fqn")
    asked = typed.filter(F.col("use").isin("member", "name", "new")).select("type", F.col("token").alias("simple_name"), "args", "is_call").dropna(subset=["type"]).distinct()
    above = traverse.closure(graph.edges, starts=asked.select(F.col("type").alias("fqn")))
    lines = asked.withColumn("owner_fqn", F.col("type")).withColumn("depth", F.lit(0)).unionByName(asked.join(above.select(F.col("start").alias("type"), F.col("reached").alias("owner_fqn"), "depth"), "type"))
    fits = F.when(F.col("args") < 0, 0).when(F.col("n") == F.col("args"), 0).when(F.col("open"), 1).otherwise(2)
    kind_ok = F.when(F.col("is_call"), F.col("kind") != "field").otherwise(F.col("kind") == "field")
    found = lines.join(own, ["owner_fqn", "simple_name"]).filter(kind_ok).groupBy("type", "simple_name", "args", "is_call").agg(F.min_by("fqn", F.struct(fits.alias("fits"), "depth", "fqn")).alias("member"))
    joined = typed.join(found.withColumnRenamed("simple_name", "token"), ["type", "token", "args", "is_call"], "left")
    named = joined.withColumn("as_type", F.when(F.col("use").isin("type", "name"), F.col("token")))
    typed_names = bind(named, contexts, graph.nodes, "as_type")
    real = graph.nodes.select(F.col("fqn").alias("bound"), F.lit(True).alias("is_node")).distinct()
    out = typed_names.join(real, "bound", "left")
    target = F.coalesce("member", F.when(F.col("use") == "new", F.col("type")), F.when(F.col("is_node"), F.col("bound")))
    return out.filter(F.col("use") != "local").select("path", "token", *(F.col(f"range.{c}").alias(c) for c in ("start_line", "start_col", "end_line", "end_col")), "is_call", target.alias("resolved_fqn"))
