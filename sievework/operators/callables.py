"""Facts of source files: lines by class, entities, and one row a callable with its structural and cognitive measures.

Python comes from its own syntax tree, Java, JavaScript, TypeScript and Go from ``braced``.  Comments are masked the way
the language defines them, so a sign in a string is no comment, and a callable's code lines are counted on the same
masked text as the file's.  Callables are module functions and methods of named owners; constructors, signatures,
nested and anonymous functions are entities but no rows, and count for nothing around them.

Defined results
---------------
* A null text gives no row.  A file that can't be read as its language has status ``failed`` and NULLs, never zero;
  an empty file is ``complete`` with zeros.  Of a file with unmatched brackets the whole declarations before them are
  read (``partial``, ``recovery`` is ``sound_prefix``); its lines are all counted.  A language without a reader gives ``not_applicable``.
* Rows repeated as a whole come out once; of callables of one identity each gets its place in the file as an ordinal.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize as python_tokens
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import digest
from sievework.operators import braced

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BOUNDARY = (*_FUNCTIONS, ast.Lambda, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
LINES = ("total_physical_lines", "blank_lines", "nonblank_lines", "code_lines", "comment_lines")
MEASURES = ("nloc", "parameters", "decisions", "booleans", "max_condition", "cyclomatic", "max_nesting", "cognitive")
_CALLABLE = pa.struct([("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("place", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), *((m, pa.int32()) for m in MEASURES), ("statements", pa.int32()), ("tokens", pa.int32()), ("lexical", pa.string()), ("structural", pa.string())])
_CALLABLE_SQL = "name: string, qualified_name: string, kind: string, owner: string, place: int, start_line: int, end_line: int, " + ", ".join(f"{m}: int" for m in MEASURES) + ", statements: int, tokens: int, lexical: string, structural: string"


def _operators(node: ast.AST) -> list[tuple[int, int, str]]:
    """Short-circuit operators of an expression with the place of what follows them; nested callables left out."""
    if isinstance(node, _BOUNDARY):
        return []
    own = [(v.lineno, v.col_offset, type(node.op).__name__) for v in node.values[1:]] if isinstance(node, ast.BoolOp) else []
    return own + [o for child in ast.iter_child_nodes(node) for o in _operators(child)]


class _Measured:
    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef, owner: str):
        self.name, self.receivers = function.name, {"self", "cls", owner} - {""}
        self.decisions = self.booleans = self.max_condition = self.max_nesting = self.cognitive = 0
        self.recursive = False
        self.block(function.body, 0, 0)
        self.cognitive += self.recursive

    def block(self, body: list, depth: int, weight: int) -> None:
        if body:
            self.max_nesting = max(self.max_nesting, depth)
        for statement in body:
            self.statement(statement, depth, weight)

    def branch(self, body: list, depth: int, weight: int, flat: bool = True) -> None:
        if body:
            self.cognitive += flat
            self.block(body, depth, weight)

    def condition(self, node: ast.AST, weight: int) -> None:
        self.max_condition = max(self.max_condition, len(_operators(node)))
        self.expression(node, weight)

    def chain(self, node: ast.If, depth: int, weight: int) -> None:
        self.decisions += 1
        self.condition(node.test, weight)
        self.block(node.body, depth + 1, weight + 1)
        other = node.orelse[0] if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) else None
        if other and other.col_offset == node.col_offset:  # elif: an if inside else stands further right
            self.cognitive += 1
            self.chain(other, depth, weight)
        else:
            self.branch(node.orelse, depth + 1, weight + 1)

    def statement(self, node: ast.AST, depth: int, weight: int) -> None:
        if isinstance(node, _BOUNDARY):
            return
        if isinstance(node, ast.If):
            self.cognitive += 1 + weight
            self.chain(node, depth, weight)
        elif isinstance(node, _LOOPS):
            self.decisions += 1
            self.cognitive += 1 + weight
            if isinstance(node, ast.While):
                self.condition(node.test, weight)
            else:
                self.expression(node.iter, weight)
            self.block(node.body, depth + 1, weight + 1)
            self.branch(node.orelse, depth + 1, weight + 1)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            self.block(node.body, depth + 1, weight)
            for handler in node.handlers:
                self.decisions += 1
                self.cognitive += 1 + weight
                self.block(handler.body, depth + 1, weight + 1)
            self.branch(node.orelse, depth + 1, weight + 1)
            self.branch(node.finalbody, depth + 1, weight, flat=False)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self.expression(item.context_expr, weight)
            self.block(node.body, depth + 1, weight)
        elif isinstance(node, ast.Match):
            self.cognitive += 1 + weight
            self.expression(node.subject, weight)
            for case in node.cases:
                p = case.pattern
                self.decisions += not (isinstance(p, ast.MatchAs) and p.pattern is None and p.name is None)
                if case.guard is not None:
                    self.decisions += 1
                    self.cognitive += 1
                    self.condition(case.guard, weight + 1)
                self.max_nesting = max(self.max_nesting, depth + 1)
                self.block(case.body, depth + 2, weight + 1)
        else:
            for child in ast.iter_child_nodes(node):
                (self.statement(child, depth, weight) if isinstance(child, ast.stmt) else self.expression(child, weight))

    def expression(self, node: ast.AST, weight: int, counted: bool = False) -> None:
        """``counted`` where the operators around have already been taken for a run."""
        if isinstance(node, _BOUNDARY):
            return
        if isinstance(node, ast.Call):
            f = node.func
            own = isinstance(f, ast.Attribute) and f.attr == self.name and isinstance(f.value, ast.Name) and f.value.id in self.receivers
            self.recursive |= own or isinstance(f, ast.Name) and f.id == self.name
        if isinstance(node, ast.BoolOp):
            self.booleans += len(node.values) - 1
            if not counted:
                signs = [o[2] for o in sorted(_operators(node))]
                self.cognitive += sum(a != b for a, b in zip(signs, [None, *signs]))
            counted = True
        if isinstance(node, ast.IfExp):
            self.decisions += 1
            self.cognitive += 1 + weight
            self.max_condition = max(self.max_condition, len(_operators(node.test)))
            self.expression(node.test, weight, counted)
            self.expression(node.body, weight + 1, counted)
            self.expression(node.orelse, weight + 1, counted)
            return
        if isinstance(node, _COMPREHENSIONS):
            self.cognitive += 1 + weight
            for g in node.generators:
                self.decisions += 1 + len(g.ifs)
                self.cognitive += len(g.ifs)
                self.expression(g.iter, weight, counted)
                for test in g.ifs:
                    self.max_condition = max(self.max_condition, len(_operators(test)))
                    self.expression(test, weight + 1, counted)
            for child in ast.iter_child_nodes(node):
                if not isinstance(child, ast.comprehension):
                    self.expression(child, weight + 1, counted)
            return
        for child in ast.iter_child_nodes(node):
            self.expression(child, weight, counted)


def _python_masked(text: str, tokens: list) -> str:
    lines = text.split("\n")
    for t in tokens:
        if t.type == python_tokens.COMMENT:
            row, begin = t.start[0] - 1, t.start[1]
            lines[row] = lines[row][:begin] + " " * len(t.string) + lines[row][begin + len(t.string) :]
    return "\n".join(lines)


_LAYOUT = {python_tokens.INDENT: "indent", python_tokens.DEDENT: "dedent", python_tokens.NEWLINE: "line"}


def _python_canonical(tokens: list) -> tuple[str, str]:
    """As ``braced.canonical``; indents, dedents and ends of lines are tokens, comments and blank lines are not."""
    tokens = [t for t in tokens if t.type not in (python_tokens.COMMENT, python_tokens.NL, python_tokens.ENDMARKER)]
    seen: dict[tuple[str, str], int] = {}
    plain, shape = [], []
    for i, t in enumerate(tokens):
        plain.append(_LAYOUT.get(t.type, t.string))
        if t.type == python_tokens.NAME and not keyword.iskeyword(t.string):
            role = "m" if i and tokens[i - 1].string == "." else "f" if i + 1 < len(tokens) and tokens[i + 1].string == "(" else "v"
            shape.append(f"{role}{seen.setdefault((role, t.string), sum(r == role for r, _ in seen))}")
        else:
            shape.append({python_tokens.STRING: "text", python_tokens.NUMBER: "number"}.get(t.type, _LAYOUT.get(t.type, t.string)))
    return "\x1f".join(plain), "\x1f".join(shape)


def _forms(plain: str, shape: str) -> dict:
    code = lambda x: sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return {"tokens": plain.count("\x1f") + bool(plain), "lexical": code(plain), "structural": code(shape)}


def _overload(node: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    targets = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
    return any(getattr(t, "id", None) == "overload" or getattr(t, "attr", None) == "overload" for t in targets)


def _python(text: str) -> tuple[str, dict[str, int], list[dict]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    tokens = list(python_tokens.generate_tokens(io.StringIO(text, newline="\n").readline))
    masked, entities, found = _python_masked(text, tokens), {}, []
    places = [t.start for t in tokens]

    def count(name: str) -> None:
        entities[name] = entities.get(name, 0) + 1

    def walk(node: ast.AST, chain: tuple[str, ...], owner: str, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                count("classes")
                walk(child, (*chain, child.name), child.name, inside)
            elif isinstance(child, _FUNCTIONS):
                method = isinstance(node, ast.ClassDef)
                kind = "signature_only_methods" if _overload(child) else ("constructors" if child.name in ("__init__", "__new__") else "class_methods") if method else "nested_functions" if inside or owner else "module_functions"
                count(kind)
                if isinstance(child, ast.AsyncFunctionDef):
                    count("async_functions")
                if kind in ("class_methods", "module_functions"):
                    a, m = child.args, _Measured(child, owner)
                    found.append({
                        "name": child.name, "qualified_name": ".".join((*chain, child.name)), "kind": kind[:-1], "owner": owner if method else "", "start_line": child.lineno, "end_line": child.end_lineno,
                        "parameters": len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None), **_values(m),
                        "statements": sum(isinstance(x, ast.stmt) for s in child.body for x in ast.walk(s)),
                        **_forms(*_python_canonical(tokens[bisect_left(places, (child.body[0].lineno, child.body[0].col_offset)) : bisect_left(places, (child.end_lineno, 1 << 30))])),
                    })
                walk(child, (*chain, child.name), "", True)
            else:
                if isinstance(child, ast.Lambda):
                    count("lambdas")
                walk(child, chain, owner, inside)

    walk(tree, (), "", False)
    return masked, entities, found


def _values(m) -> dict[str, int]:
    return {"decisions": m.decisions, "booleans": m.booleans, "max_condition": m.max_condition, "cyclomatic": 1 + m.decisions + m.booleans, "max_nesting": m.max_nesting, "cognitive": m.cognitive}


def _braced(text: str, language: str) -> tuple[str, dict[str, int], list[dict], str | None]:
    source, recovery = braced.tokenize(text, language), None
    if not source.sound:
        source, recovery = braced.sound_prefix(source), "sound_prefix"
        if source is None:
            raise ValueError("brackets don't match")
    declared, entities = braced.declarations(source)
    found = []
    for c in declared:
        m = braced.measure(source, c.begin, c.end, c.name, c.receivers)
        found.append({"name": c.name, "qualified_name": f"{c.owner}.{c.name}" if c.owner else c.name, "kind": c.kind, "owner": c.owner, "start_line": source.lines[c.first], "end_line": source.lines[c.last], "parameters": c.parameters, **_values(m), "statements": m.statements, **_forms(*braced.canonical(source, c.begin, c.end))})
    return source.masked, entities, found, recovery


def facts(text: str, language: str) -> dict | None:
    """Lines, entities and callables of a file; None if it can't be read as its language."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        masked, entities, found, recovery = (*_python(text), None) if language == "Python" else _braced(text, language)
    except (SyntaxError, ValueError, RecursionError, MemoryError, KeyError, IndexError, python_tokens.TokenError):
        return None
    raw, bare = text.split("\n"), masked.split("\n")
    is_code = [bool(a.strip()) and bool(b.strip()) for a, b in zip(raw, bare)]
    for place, c in enumerate(found):
        c["place"] = place
        c["nloc"] = sum(is_code[c["start_line"] - 1 : c["end_line"]])
    total = len(raw) - (raw[-1] == "")
    blank = sum(not line.strip() for line in raw[:total])
    code = sum(is_code)
    return {"total_physical_lines": total, "blank_lines": blank, "nonblank_lines": total - blank, "code_lines": code, "comment_lines": total - blank - code, "entities": sorted(entities.items()), "callables": found, "recovery": recovery}


def file_metrics(df: DataFrame, keep: list[str], language: str, text: str) -> DataFrame:
    """``(*keep, status, recovery, *LINES, entities, classes_structs, methods_functions, callables)``, one row a file."""
    kinds, n = dict(df.dtypes), len(keep)
    columns = ", ".join(f"{k} {kinds[k]}" for k in keep)
    lines = ", ".join(f"{c} int" for c in LINES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, states = [], []
            for lang, source in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                known = lang == "Python" or lang in braced.LANGUAGES
                found = facts(source, lang) if known else None
                states.append(("partial" if found["recovery"] else "complete") if found else "failed" if known else "not_applicable")
                out.append(found or {})
            columns = [pa.array([f.get("recovery") for f in out], pa.string()), *(pa.array([f.get(c) for f in out], pa.int32()) for c in LINES)]
            columns += [pa.array([f.get("entities") for f in out], pa.map_(pa.string(), pa.int32())), pa.array([f.get("callables") for f in out], pa.list_(_CALLABLE))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(states, pa.string()), *columns], names=[*keep, "status", "recovery", *LINES, "entities", "callables"])

    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(language).alias("_language"), F.col(text).alias("_text")).distinct()
    out = rows.mapInArrow(scan, f"{columns}, status string, recovery string, {lines}, entities map<string,int>, callables array<struct<{_CALLABLE_SQL}>>")
    total = lambda *names: F.when(F.col("status").isin("complete", "partial"), sum((F.coalesce(F.try_element_at("entities", F.lit(x)), F.lit(0)) for x in names), F.lit(0)))
    return out.withColumns({"classes_structs": total("classes", "records", "structs"), "methods_functions": total("module_functions", "class_methods", "receiver_methods")})


def row_id(path: Column, language: Column, kind: Column, qualified: Column, ordinal: Column) -> Column:
    return digest(F.lit("sievework-callable"), path, language, kind, qualified, F.coalesce(ordinal.cast("string"), F.lit("")))


def callables(metrics: DataFrame, keep: list[str]) -> DataFrame:
    """One row a callable of ``file_metrics``: ``(*keep, name, qualified_name, kind, owner, start_line, end_line, *MEASURES, ordinal)``.

    Only callables that share their identity with another one of the file have an ordinal.
    """
    rows = metrics.select(*keep, F.explode("callables").alias("c")).select(*keep, "c.*")
    same = Window.partitionBy(*keep, "kind", "qualified_name")
    ordinal = F.when(F.count("*").over(same) > 1, F.row_number().over(same.orderBy("place")) - 1)
    return rows.withColumn("ordinal", ordinal)


def body_groups(found: DataFrame, keep: list[str], form: str) -> DataFrame:
    """Groups of bodies of one form: ``(language, form, tokens, statements, occurrences, files, missed)``; ``found`` is from ``callables``.

    ``form`` is ``lexical`` or ``structural``; ``keep`` begins with the language.  Copies collapse map-side, and
    ``missed`` names the floors that the bodies of a group don't reach.
    """
    from sievework.operators.clones import body_floors

    each = found.groupBy(F.col(keep[0]).alias("language"), F.col(form).alias("form"), "tokens", "statements", *keep[1:]).agg(F.count("*").alias("n"), F.max("nloc").alias("nloc"))
    groups = each.groupBy("language", "form", "tokens", "statements").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"), F.max("nloc").alias("nloc")).where("occurrences >= 2")
    return body_floors(groups, F.col("statements"), F.col("tokens"), F.col("nloc")).drop("nloc", "admitted")
