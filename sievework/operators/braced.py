"""Source of Java, JavaScript, TypeScript and Go: tokens, masked comments, declarations and measures of callables.

One tokenizer per language feeds a small statement reader that these four share.  It knows control statements, brackets
and what a brace belongs to; expressions are ranges of tokens.  Broken brackets leave a file without a verdict.

Measures of a callable: decisions, short-circuit operators, the most of them in one condition, the deepest block,
cyclomatic (one more than decisions and operators) and cognitive (structures weigh their depth, an ``else`` or a run of
equal operators one, recursion one).  What stands in a nested callable or class counts for that one only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

LANGUAGES = ("Java", "JavaScript", "TypeScript", "Go")
_SCRIPT = ("JavaScript", "TypeScript")
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"?|\'(?:[^\'\\\n]|\\[\s\S])*\'?'
_SIGNS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|<-|::|:=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|&\^|<<|."
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? == != === !== += -= return typeof case in of do else throw new delete void".split())
_ENDS_LINE = frozenset(") ] } ++ -- return break continue fallthrough".split())
_STARTS = frozenset("if for while do switch try return throw break continue const let var function class import export".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}


@cache
def _pattern(language: str) -> re.Pattern[str]:
    text = r'"""[\s\S]*?(?<!\\)"""|' if language == "Java" else r"`[^`]*`?|" if language == "Go" else ""
    return re.compile(rf"(?P<w>[ \t\r\f\v﻿]+)|(?P<l>\n)|(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>{text}{_QUOTED})|(?P<n>[@#]?[^\W\d][\w$]*|\$[\w$]*)|(?P<d>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<p>{_SIGNS})", re.S)


def _template(text: str, at: int) -> int:
    """End of a template literal, its substitutions included."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template(text, at)
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return at


@dataclass
class Source:
    """Tokens of a file: kinds (``n`` name, ``s`` text, ``d`` number, ``p`` sign), values, lines; and the text without comments."""

    language: str
    kinds: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    masked: str = ""
    pairs: dict[int, int] = field(default_factory=dict)
    opens: dict[int, int] = field(default_factory=dict)
    sound: bool = True
    whole: int = 0  # tokens up to the last declaration or statement that ends outside all brackets

    def at(self, i: int) -> str:
        return self.values[i] if 0 <= i < len(self.values) else ""


def tokenize(text: str, language: str) -> Source:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, match = Source(language), _pattern(language).match
    kinds, values, lines = out.kinds, out.values, out.lines
    at, line, kept, parts = 0, 1, 0, []
    while at < len(text):
        if language in _SCRIPT and (text[at] == "`" or text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (not values or values[-1] in _BEFORE_REGEX)):
            m = _REGEX.match(text, at) if text[at] == "/" else None
            end = m.end() if m else _template(text, at) if text[at] == "`" else at
            if end > at:
                kinds.append("s")
                values.append(text[at:end])
                lines.append(line)
                line += text.count("\n", at, end)
                at = end
                continue
        m = match(text, at)
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "c":
            parts += [text[kept:at], re.sub(r"[^\n]", " ", value)]
            kept = end
        new_line = "\n" in value
        if kind in ("l", "c") and language == "Go" and new_line and values and (kinds[-1] in "nsd" and values[-1] not in _KEEPS_LINE or values[-1] in _ENDS_LINE):
            kinds.append("p")
            values.append(";")
            lines.append(line)
        elif kind in "nsdp":
            kinds.append(kind)
            values.append(value)
            lines.append(line)
        if new_line:
            line += value.count("\n")
        at = end
    out.masked = "".join([*parts, text[kept:]])
    stack: list[int] = []
    for i, v in enumerate(values):
        if kinds[i] != "p":
            continue
        if v == ";" and not stack:
            out.whole = i + 1
        if v in _OPEN:
            stack.append(i)
        elif v in ")]}":
            if not stack or _OPEN[values[stack[-1]]] != v:
                out.sound = False
                break
            out.pairs[stack.pop()] = i
            if v == "}" and not stack:
                out.whole = i + 1
    out.sound = out.sound and not stack
    out.opens = {close: begin for begin, close in out.pairs.items()}
    return out


def sound_prefix(source: Source) -> Source | None:
    """What stands before the first bracket that has no partner, up to the last whole declaration; None if nothing does."""
    n = source.whole
    if not n:
        return None
    pairs = {a: b for a, b in source.pairs.items() if b < n}
    return Source(source.language, source.kinds[:n], source.values[:n], source.lines[:n], source.masked, pairs, {b: a for a, b in pairs.items()}, True, n)


#: Words of Go that never end a statement.
_KEEPS_LINE = frozenset("if for switch select case default func type struct interface map chan go defer else package import var const range goto".split())


@dataclass
class Measures:
    decisions: int = 0
    booleans: int = 0
    max_condition: int = 0
    max_nesting: int = 0
    cognitive: int = 0
    recursive: bool = False
    statements: int = 0


class _Body:
    """Measures the statements of one callable."""

    def __init__(self, source: Source, name: str, receivers: frozenset[str]):
        self.s, self.name, self.receivers = source, name, receivers
        self.m = Measures()
        self.go, self.script = source.language == "Go", source.language in _SCRIPT
        self.short = frozenset(("&&", "||", "??")) if self.script else frozenset(("&&", "||"))

    def is_sign(self, i: int, v: str) -> bool:
        return self.s.at(i) == v and i < len(self.s.kinds) and self.s.kinds[i] != "s"

    # -- statements

    def block(self, i: int, end: int, depth: int, weight: int) -> None:
        while i < end:
            i = max(self.statement(i, end, depth, weight), i + 1)

    def body(self, i: int, end: int, depth: int, weight: int) -> int:
        """A block in braces or one statement."""
        if self.is_sign(i, "{"):
            close = self.s.pairs[i]
            self.block(i + 1, close, depth, weight)
            return close + 1
        return self.statement(i, end, depth, weight)

    def brace(self, i: int, end: int) -> int:
        """The brace that opens the body of a header that has no parentheses."""
        while i < end and not self.is_sign(i, "{"):
            if self.s.at(i) == "func" and self.s.kinds[i] == "n":
                i = self.function(i, end)
                continue
            i = self.s.pairs[i] + 1 if self.s.kinds[i] == "p" and self.s.values[i] in "([" and i in self.s.pairs else i + 1
        return i

    def head(self, i: int, end: int) -> tuple[int, int, int]:
        """(begin, end, what follows) of a header at ``i``."""
        if not self.go and self.is_sign(i, "("):
            return i + 1, self.s.pairs[i], self.s.pairs[i] + 1
        stop = self.brace(i, end)
        return i, stop, stop

    def statement(self, i: int, end: int, depth: int, weight: int, chained: bool = False) -> int:
        s, m = self.s, self.m
        v = s.at(i)
        if s.kinds[i] == "p" and v == ";":
            return i + 1
        m.max_nesting = max(m.max_nesting, depth)
        m.statements += v != "{"
        if s.kinds[i] == "p" and v == "{":
            self.block(i + 1, s.pairs[i], depth, weight)
            return s.pairs[i] + 1
        if s.kinds[i] == "n":
            if v == "if":
                m.decisions += 1
                m.cognitive += 1 if chained else 1 + weight
                a, b, i = self.head(i + 1, end)
                self.condition(a, b, weight)
                i = self.body(i, end, depth + 1, weight + 1)
                if s.at(i) == ";" and s.at(i + 1) == "else":
                    i += 1
                if s.at(i) == "else" and i < end:
                    if s.at(i + 1) == "if":
                        return self.statement(i + 1, end, depth, weight, True)
                    m.cognitive += 1
                    return self.body(i + 1, end, depth + 1, weight + 1)
                return i
            if v in ("for", "while"):
                m.decisions += 1
                m.cognitive += 1 + weight
                i += s.at(i + 1) == "await"
                a, b, i = self.head(i + 1, end)
                parts = self.split(a, b, ";")
                if v == "while" or self.go and len(parts) == 1 and "range" not in s.values[a:b]:
                    self.condition(a, b, weight)
                else:
                    for k, (x, y) in enumerate(parts):
                        (self.condition if k == 1 and len(parts) == 3 else self.expression)(x, y, weight)
                return self.body(i, end, depth + 1, weight + 1)
            if v == "do" and not self.go:
                m.decisions += 1
                m.cognitive += 1 + weight
                i = self.body(i + 1, end, depth + 1, weight + 1)
                if s.at(i) == "while":
                    a, b, i = self.head(i + 1, end)
                    self.condition(a, b, weight)
                return i
            if v in ("switch", "select") and (v == "switch" or self.go):
                return self.switch(i, end, depth, weight)
            if v == "try" and not self.go:
                i += 1
                if self.is_sign(i, "("):
                    self.expression(i + 1, s.pairs[i], weight)
                    i = s.pairs[i] + 1
                i = self.body(i, end, depth + 1, weight)
                while s.at(i) == "catch" and i < end:
                    m.decisions += 1
                    m.cognitive += 1 + weight
                    i = s.pairs[i + 1] + 1 if self.is_sign(i + 1, "(") else i + 1
                    i = self.body(i, end, depth + 1, weight + 1)
                if s.at(i) == "finally" and i < end:
                    i = self.body(i + 1, end, depth + 1, weight)
                return i
            if v == "synchronized" and self.is_sign(i + 1, "("):
                a, b, i = self.head(i + 1, end)
                self.expression(a, b, weight)
                return self.body(i, end, depth + 1, weight)
            if v in ("break", "continue", "goto"):
                if i + 1 < end and s.kinds[i + 1] == "n" and s.lines[i + 1] == s.lines[i]:
                    m.cognitive += 1
                    return i + 2
                return i + 1
            if s.at(i + 1) == ":" and i + 1 < end and v not in ("default", "case"):
                return i + 2
        stop = self.ending(i, end)
        self.expression(i, stop, weight)
        return stop + (s.at(stop) == ";" and stop < end)

    def ending(self, i: int, end: int) -> int:
        """End of an expression statement; in scripts a line may end it."""
        s, begin = self.s, i
        while i < end:
            v, k = s.values[i], s.kinds[i]
            if k == "p" and v == ";":
                return i
            if i > begin and self.script and k == "n" and v in _STARTS and s.lines[i] > s.lines[i - 1] and s.values[i - 1] not in ("=", "=>", "(", ",", "await", "async", "export", "default"):
                return i
            if k == "n" and v in ("class", "interface", "enum", "record") and i + 1 < end and s.kinds[i + 1] == "n" and s.at(i - 1) != ".":
                return self.s.pairs.get(self.brace(i, end), i) + 1
            i = s.pairs[i] + 1 if k == "p" and i in s.pairs else i + 1
            if self.script and s.at(i - 1) == "}" and i < end and s.lines[i] > s.lines[i - 1] and s.kinds[i] == "n":
                return i
        return end

    def switch(self, i: int, end: int, depth: int, weight: int) -> int:
        s, m = self.s, self.m
        m.cognitive += 1 + weight
        a, b, at = self.head(i + 1, end)
        self.expression(a, b, weight)
        if not self.is_sign(at, "{"):
            return at
        close, at = s.pairs[at], at + 1
        m.max_nesting = max(m.max_nesting, depth + 1 if close > at else depth)
        while at < close:
            if s.at(at) in ("case", "default") and s.kinds[at] == "n":
                m.decisions += s.at(at) == "case"
                mark = at + 1
                while mark < close and s.at(mark) not in (":", "->"):
                    if s.at(mark) == "when" and not self.go:
                        m.decisions += 1
                        m.cognitive += 1
                    mark = s.pairs[mark] + 1 if mark in s.pairs else mark + 1
                self.expression(at + 1, mark, weight + 1)
                at = mark + 1
                continue
            at = max(self.statement(at, close, depth + 2, weight + 1), at + 1)
        return close + 1

    # -- expressions

    def split(self, i: int, end: int, sign: str) -> list[tuple[int, int]]:
        parts, begin = [], i
        while i < end:
            if self.s.kinds[i] == "p" and self.s.values[i] == sign:
                parts.append((begin, i))
                begin = i + 1
            i = self.s.pairs[i] + 1 if i in self.s.pairs else i + 1
        return [*parts, (begin, end)]

    def condition(self, i: int, end: int, weight: int) -> None:
        if self.go:
            *before, (i, end) = self.split(i, end, ";")
            for a, b in before:
                self.expression(a, b, weight)
        self.m.max_condition = max(self.m.max_condition, len(self.operators(i, end)))
        self.expression(i, end, weight)

    def function(self, i: int, end: int) -> int:
        """What follows a nested callable that begins at ``i``; it counts for itself."""
        s = self.s
        if s.values[i] in ("=>", "->"):
            if self.is_sign(i + 1, "{"):
                return s.pairs[i + 1] + 1
            i += 1
            begin = i
            while i < end and not (s.kinds[i] == "p" and s.values[i] in (",", ";", ")")):
                if i > begin and self.script and s.lines[i] > s.lines[i - 1] and s.kinds[i] in "nd" and (s.kinds[i - 1] in "nsd" or s.values[i - 1] in (")", "]", "}")):
                    return i
                i = s.pairs[i] + 1 if i in s.pairs else i + 1
            return i
        i += 1
        while i < end and not self.is_sign(i, "{"):
            if s.values[i] in ("struct", "interface") and self.is_sign(i + 1, "{"):
                i += 1
                i = s.pairs[i] + 1
                continue
            if s.kinds[i] == "p" and s.values[i] in (";", ","):
                return i
            i = s.pairs[i] + 1 if i in s.pairs else i + 1
        return s.pairs[i] + 1 if i < end else end

    def skips(self, i: int, end: int) -> int | None:
        """Where to go on if a nested callable or class begins at ``i``."""
        s, v, k = self.s, self.s.values[i], self.s.kinds[i]
        if k == "n" and (v == "func" and self.go or v == "function" and self.script) or k == "p" and (v == "=>" or v == "->" and s.language == "Java"):
            return self.function(i, end)
        if k == "n" and v == "class" and self.script and s.at(i - 1) != ".":
            j = self.brace(i, end)
            return s.pairs[j] + 1 if j in s.pairs else None
        if k == "p" and v == "{" and s.at(i - 1) == ")" and not self.go:
            return s.pairs[i] + 1  # body of an anonymous class or of a method in an object
        return None

    def operators(self, i: int, end: int) -> list[str]:
        found = []
        while i < end:
            nxt = self.skips(i, end)
            if nxt is not None:
                i = nxt
                continue
            if self.s.kinds[i] == "p" and self.s.values[i] in self.short:
                found.append(self.s.values[i])
            i += 1
        return found

    def runs(self, i: int, end: int) -> None:
        """Runs of equal operators, expression by expression; brackets inside one don't end it."""
        s = self.s
        begin, own, inner = i, False, []
        while i <= end:
            v = s.values[i] if i < end else ","
            k = s.kinds[i] if i < end else "p"
            nxt = self.skips(i, end) if i < end else None
            if nxt is not None:
                i = nxt
                continue
            if k == "p" and (v in (",", ";", "?", ":", ":=", "<-") or v.endswith("=") and v not in ("==", "!=", "<=", ">=", "===", "!==")):
                if own:
                    last = None
                    for sign in self.operators(begin, i):
                        self.m.cognitive += sign != last
                        last = sign
                else:
                    for a, b in inner:
                        self.runs(a, b)
                begin, own, inner = i + 1, False, []
            elif k == "p" and v in self.short:
                own = True
            if i < end and i in s.pairs:
                inner.append((i + 1, s.pairs[i]))
                i = s.pairs[i]
            i += 1

    def ternary(self, i: int) -> bool:
        s = self.s
        if self.go or s.values[i] != "?" or s.kinds[i] != "p":
            return False
        if self.script:
            return s.at(i + 1) not in (":", ",", ")", ".", "=", ";")
        return not (s.at(i - 1) in ("<", ",") and s.at(i + 1) in (">", "extends", "super", ",", ">>"))

    def expression(self, i: int, end: int, weight: int) -> None:
        self.m.booleans += len(self.operators(i, end))
        self.runs(i, end)
        self.walk(i, end, weight)

    def walk(self, i: int, end: int, weight: int) -> None:
        s, m = self.s, self.m
        inside, begin = 0, i
        while i < end:
            nxt = self.skips(i, end)
            if nxt is not None:
                i = nxt
                continue
            v, k = s.values[i], s.kinds[i]
            if k == "n" and v == "switch" and s.language == "Java" and self.is_sign(i + 1, "("):
                i = self.switch(i, end, 0, weight + inside)
                continue
            if k == "n" and v == self.name and self.is_sign(i + 1, "("):
                m.recursive |= s.at(i - 1) != "." or s.at(i - 2) in self.receivers and s.at(i - 3) != "."
            if k == "p" and v in (",", ";"):
                inside, begin = 0, i + 1
            elif self.ternary(i):
                m.decisions += 1
                m.cognitive += 1 + weight + inside
                m.max_condition = max(m.max_condition, len(self.operators(begin, i)))
                inside, begin = inside + 1, i + 1
            elif i in s.pairs:
                self.walk(i + 1, s.pairs[i], weight + inside)
                i = s.pairs[i]
            i += 1


def measure(source: Source, begin: int, end: int, name: str, receivers: frozenset[str]) -> Measures:
    body = _Body(source, name, receivers)
    if source.at(begin - 1) == "=>":
        body.expression(begin, end, 0)
    else:
        body.block(begin, end, 0, 0)
    body.m.cognitive += body.m.recursive
    return body.m


#: Words that keep their spelling in a structure (fixed values of the languages).
WORDS = _STARTS | _KEEPS_LINE | frozenset("else catch finally new instanceof extends implements super this null nil true false undefined void int long double float boolean char byte short String static final async await yield typeof in of range default delete goto fallthrough synchronized assert".split())


def canonical(source: Source, begin: int, end: int) -> tuple[str, str]:
    """(tokens as they are, structure): in the structure names are numbered by role and first appearance, literals are classes."""
    seen: dict[tuple[str, str], int] = {}
    plain, shape = [], []
    for i in range(begin, end):
        k, v = source.kinds[i], source.values[i]
        plain.append(v)
        if k == "n" and v not in WORDS:
            role = "m" if source.at(i - 1) in (".", "?.") else "f" if source.at(i + 1) == "(" else "v"
            n = seen.setdefault((role, v), sum(r == role for r, _ in seen))
            shape.append(f"{role}{n}")
        else:
            shape.append("text" if k == "s" else "number" if k == "d" else v)
    return "\x1f".join(plain), "\x1f".join(shape)


@dataclass
class Callable:
    name: str
    kind: str
    owner: str
    first: int  # token of the declaration, of its last token, and the body
    last: int
    begin: int
    end: int
    parameters: int
    receivers: frozenset[str] = frozenset()


class _Finder:
    """Declarations of a file: callables that count, and how many of each entity."""

    def __init__(self, source: Source):
        self.s = source
        self.found: list[Callable] = []
        self.entities: dict[str, int] = {}

    def count(self, name: str) -> None:
        self.entities[name] = self.entities.get(name, 0) + 1

    def parameters(self, i: int) -> int:
        """Parameters in the parentheses at ``i``; commas in angle brackets separate nothing."""
        s, end = self.s, self.s.pairs[i]
        n, angle, filled, at = 0, 0, False, i + 1
        while at < end:
            v = s.values[at]
            filled = True
            if s.language != "Go" and s.kinds[at] == "p":
                angle += (v == "<") - (v.count(">") if v in (">", ">>", ">>>") else 0)
            if v == "," and angle <= 0:
                n, filled = n + 1, False
            at = s.pairs[at] + 1 if at in s.pairs else at + 1
        return n + filled

    def next(self, i: int, end: int, *signs: str) -> int:
        """The first of the signs at this level."""
        s = self.s
        while i < end and not (s.kinds[i] != "s" and s.values[i] in signs):
            i = s.pairs[i] + 1 if i in s.pairs else i + 1
        return i

    # -- Java

    _TYPES = {"class": "classes", "interface": "interfaces", "enum": "enums", "record": "records", "@interface": "annotation_types"}

    def java(self, i: int, end: int, chain: tuple[str, ...]) -> None:
        """Types between statements or members."""
        s = self.s
        while i < end:
            v = s.values[i]
            if s.kinds[i] == "n" and v in self._TYPES and s.at(i - 1) != "." and i + 1 < end and s.kinds[i + 1] == "n" and (v != "record" or self.s.at(i + 2) in ("(", "<")):
                brace = self.next(i + 2, end, "{", ";")
                if s.at(brace) == "{":
                    self.count(self._TYPES[v])
                    self.java_members(brace + 1, s.pairs[brace], (*chain, s.values[i + 1]), v)
                    i = s.pairs[brace] + 1
                    continue
            if v == "new" and s.kinds[i] == "n":
                paren = self.next(i + 1, end, "(", "[", "{", ";", ",", ")")
                if s.at(paren) == "(" and s.at(s.pairs[paren] + 1) == "{" and s.pairs[paren] + 1 < end:
                    brace = s.pairs[paren] + 1
                    self.count("anonymous_classes")
                    self.java(paren + 1, s.pairs[paren], chain)
                    self.java_members(brace + 1, s.pairs[brace], (), "anonymous")
                    i = s.pairs[brace] + 1
                    continue
            i += 1

    def java_members(self, i: int, end: int, chain: tuple[str, ...], kind: str) -> None:
        s = self.s
        if kind == "enum":
            stop = self.next(i, end, ";")
            self.java(i, stop, chain)
            i = stop + 1
        while i < end:
            first = i
            while s.at(i).startswith("@") and s.at(i) != "@interface" and i < end:  # annotations
                i += 1
                while s.at(i) == ".":
                    i += 2
                if s.at(i) == "(" and i in s.pairs:
                    i = s.pairs[i] + 1
            stop = self.next(i, end, "{", ";", "=", "(")
            words = s.values[i:stop]
            if any(w in self._TYPES and s.kinds[i + k] == "n" and (w != "record" or k + 1 < len(words)) for k, w in enumerate(words)) and s.at(stop) in ("{", "(") and self._declares(i, stop):
                brace = self.next(stop, end, "{")
                self.java(i, min(s.pairs.get(brace, end) + 1, end), chain)
                i = s.pairs.get(brace, end) + 1
            elif s.at(stop) == "(":
                name, paren = s.at(stop - 1), stop
                body = self.next(s.pairs[paren] + 1, end, "{", ";", "default")
                if s.at(body) == "default":
                    body = self.next(body, end, ";")
                if s.at(body) == "{":
                    close = s.pairs[body]
                    constructor = bool(chain) and name == chain[-1] and (stop - 1 == i or s.at(stop - 2) in ("public", "private", "protected", ">"))
                    if constructor:
                        self.count("constructors")
                    elif not chain:
                        self.count("anonymous_class_methods")
                    else:
                        self.count("class_methods")
                        self.found.append(Callable(name, "class_method", ".".join(chain), first, close, body + 1, close, self.parameters(paren), frozenset(("this", chain[-1]))))
                    self.java(body + 1, close, chain)
                    i = close + 1
                else:
                    self.count("signature_only_methods")
                    i = body + 1
            elif s.at(stop) == "{":
                if kind == "record" and chain and s.at(stop - 1) == chain[-1]:
                    self.count("constructors")
                self.java(stop + 1, s.pairs[stop], chain)
                i = s.pairs[stop] + 1
            else:
                stop = self.next(stop, end, ";")
                self.java(i, stop, chain)
                i = stop + 1

    def _declares(self, i: int, stop: int) -> bool:
        """Whether what stands before a body declares a type, not a method that returns one."""
        s = self.s
        for k in range(i, stop):
            if s.values[k] in self._TYPES and s.kinds[k] == "n":
                return s.at(k - 1) != "." and k + 1 < len(s.kinds) and s.kinds[k + 1] == "n"
        return False

    # -- Go

    def golang(self) -> None:
        s, i, end = self.s, 0, len(self.s.values)
        while i < end:
            v, k = s.values[i], s.kinds[i]
            if k == "n" and v == "func":
                at, receiver = i + 1, None
                if s.at(at) == "(":
                    receiver = (at + 1, s.pairs[at])
                    at = s.pairs[at] + 1
                name = s.at(at)
                paren = self.next(at + 1, end, "(")
                body = _Body(s, "", frozenset())
                stop = body.function(paren - 1, end) if paren < end else end
                if s.at(stop - 1) == "}" and paren < end:
                    close = stop - 1
                    begin = s.opens[close]
                    owner, names = "", frozenset()
                    if receiver:
                        words = [w for w, kk in zip(s.values[slice(*receiver)], s.kinds[slice(*receiver)]) if kk == "n"]
                        owner = words[1] if len(words) > 1 else words[0] if words else ""
                        names = frozenset(words[:2])
                    self.count("receiver_methods" if receiver else "module_functions")
                    self.found.append(Callable(name, "receiver_method" if receiver else "module_function", owner, i, close, begin + 1, close, self.parameters(paren), names))
                    for x in range(begin + 1, close):
                        if s.values[x] == "func" and s.kinds[x] == "n":
                            self.count("anonymous_functions")
                i = max(stop, i + 1)
                continue
            if k == "n" and v == "type":
                at = i + 1
                specs, stop = [], self.next(at, end, ";")
                if s.at(at) == "(":
                    stop = s.pairs[at]
                    x = at + 1
                    while x < stop:
                        y = self.next(x, stop, ";")
                        specs.append((x, y))
                        x = y + 1
                else:
                    specs.append((at, stop))
                for x, y in specs:
                    rest = x + 1
                    if s.at(rest) == "[" and s.at(s.pairs[rest] + 1) in ("struct", "interface"):
                        rest = s.pairs[rest] + 1
                    what = {"struct": "structs", "interface": "interfaces", "=": "type_aliases"}.get(s.at(rest))
                    if what and x < y:
                        self.count(what)
                i = stop + 1
                continue
            i = s.pairs[i] + 1 if i in s.pairs else i + 1

    # -- scripts

    def script(self, i: int, end: int, module: bool) -> None:
        """Declarations among statements; ``module`` where nothing callable is around."""
        s = self.s
        while i < end:
            v, k = s.values[i], s.kinds[i]
            before = s.at(i - 1)
            if k == "n" and v == "function" and before != ".":
                at = i + 1 + (s.at(i + 1) == "*")
                named = at < end and s.kinds[at] == "n"
                paren = self.next(at, end, "(")
                body = self.next(s.pairs.get(paren, end) + 1, end, "{", ";")
                if s.at(body) != "{":
                    self.count("signature_only_methods")
                    i = body + 1
                    continue
                first = i - (before == "async")
                declared = named and s.at(first - 1) in ("", ";", "}", "{", "export", "default", ")") or named and s.lines[first] > s.lines[first - 1]
                self.callable(first, paren, body, s.values[at] if named else "", module, declared)
                i = s.pairs[body] + 1
                continue
            if k == "p" and v == "=>":
                paren = i - 1
                while s.at(paren) != ")" and i - paren < 30 and s.lines[paren] == s.lines[i] and s.at(paren) not in (";", "{", "=>", "="):  # a result type may stand between
                    paren = s.opens.get(paren, paren) - 1
                paren = s.opens[paren] if s.at(paren) == ")" and (paren == i - 1 or s.at(paren + 1) == ":") else i - 1
                stop = s.pairs[i + 1] if s.at(i + 1) == "{" else _Body(s, "", frozenset()).function(i, end)
                self.arrow(paren - (s.at(paren - 1) == "async"), paren, i, stop, module)
                i = stop + 1 if s.at(i + 1) == "{" else stop
                continue
            if k == "n" and v == "class" and before != ".":
                brace = self.next(i + 1, end, "{")
                name = s.at(i + 1) if s.kinds[i + 1] == "n" and s.at(i + 1) not in ("extends", "implements") else self.assigned(i) or ""
                self.count("classes" if name else "anonymous_classes")
                if brace < end:
                    self.members(brace + 1, s.pairs[brace], name, True)
                    i = s.pairs[brace] + 1
                    continue
            if k == "n" and s.language == "TypeScript" and v in ("interface", "enum", "type", "namespace") and i + 1 < end and s.kinds[i + 1] == "n" and before not in (".", ",") and s.at(i + 2) in ("{", "<", "extends", "="):
                what = {"interface": "interfaces", "enum": "enums", "type": "type_aliases"}.get(v)
                if what:
                    self.count(what)
                    i = self.next(i + 2, end, "{") if v != "type" else self.next(i + 2, end, ";", "const", "function", "export", "class", "interface")
                    i = s.pairs.get(i, i) + 1 if v != "type" else i
                    continue
            if k == "p" and v == "{" and before in ("=", "(", ",", ":", "return", "=>", "?", "[") and module and self.assigned(i):
                self.members(i + 1, s.pairs[i], self.assigned(i) or "", False)
                i = s.pairs[i] + 1
                continue
            i += 1

    def assigned(self, i: int) -> str | None:
        """Name of the variable or export that what begins at ``i`` is assigned to."""
        s = self.s
        if s.at(i - 1) != "=":
            return None
        j = i - 2
        if s.kinds[j] == "n" and s.at(j - 1) in ("const", "let", "var"):
            return s.values[j]
        if s.kinds[j] == "n" and s.at(j - 1) == "." and s.at(j - 2) in ("exports", "module"):
            return s.values[j]
        k = j  # const name: Type =
        while k > 0 and j - k < 40 and s.lines[k] == s.lines[j]:
            if s.values[k] in ("const", "let", "var") and s.at(k + 2) == ":":
                return s.values[k + 1]
            if s.values[k] == ";":
                break
            k -= 1
        return None

    def arrow(self, first: int, paren: int, sign: int, stop: int, module: bool) -> None:
        s = self.s
        name = self.assigned(first)
        n = self.parameters(paren) if s.at(paren) == "(" else 1
        block = s.at(sign + 1) == "{"
        if name and module:
            self.count("module_functions")
            self.found.append(Callable(name, "module_function", "", first, stop if block else stop - 1, sign + (2 if block else 1), stop, n, frozenset(("this",))))
        else:
            self.count("nested_functions" if not module else "anonymous_functions")
        self.script(sign + 1, stop, False)

    def callable(self, first: int, paren: int, body: int, name: str, module: bool, declared: bool) -> None:
        s, close = self.s, self.s.pairs[body]
        name = name if declared else self.assigned(first) or ""
        if module and name:
            self.count("module_functions")
            self.found.append(Callable(name, "module_function", "", first, close, body + 1, close, self.parameters(paren), frozenset(("this",))))
        elif not module:
            self.count("nested_functions")
        else:
            self.count("anonymous_functions")
        self.script(body + 1, close, False)

    def members(self, i: int, end: int, owner: str, is_class: bool) -> None:
        s = self.s
        while i < end:
            first = i
            while s.at(i) in ("public", "private", "protected", "static", "async", "get", "set", "abstract", "override", "readonly", "*", "export") and s.at(i + 1) not in ("(", "=", ":", ";", ",", "?"):
                i += 1
            if s.at(i).startswith("@"):
                i += 1
                i = s.pairs[i] + 1 if s.at(i) == "(" and i in s.pairs else i
                continue
            at = s.pairs[i] + 1 if s.at(i) == "[" and i in s.pairs else i + 1
            name = s.at(i)
            if s.at(at) in ("?", "!"):
                at += 1
            if s.at(at) == "<":
                at = self.next(at, end, "(")
            if s.at(at) == "(" and at in s.pairs:
                body = self.next(s.pairs[at] + 1, end, "{", ";", ",", "=")
                # A result type in braces is followed by the body.
                if s.at(body) == "{" and s.at(body - 1) in (":", "|", "&") and s.at(s.pairs[body] + 1) == "{":
                    body = s.pairs[body] + 1
                if s.at(body) == "{" and body < end:
                    close = s.pairs[body]
                    if name == "constructor" and is_class:
                        self.count("constructors" if owner else "anonymous_class_methods")
                    elif owner:
                        self.count("class_methods")
                        self.found.append(Callable(name, "class_method", owner, first, close, body + 1, close, self.parameters(at), frozenset(("this", owner))))
                    else:
                        self.count("anonymous_class_methods")
                    self.script(body + 1, close, False)
                    i = close + 1
                    continue
                self.count("signature_only_methods")
                i = body + 1
                continue
            stop = self.next(at, end, ";" if is_class else ",")
            if is_class and s.at(stop) != ";":  # a line may end a field
                stop = at
                while stop < end and not (stop > at and s.lines[stop] > s.lines[stop - 1] and s.values[stop - 1] not in ("=", ",", "(", "=>", "|", "&", ":", "?")):
                    stop = s.pairs[stop] + 1 if stop in s.pairs else stop + 1
            self.script(at, min(stop, end), False)
            i = max(stop if is_class and s.at(stop) != ";" else stop + 1, first + 1)


def declarations(source: Source) -> tuple[list[Callable], dict[str, int]]:
    finder = _Finder(source)
    if source.language == "Java":
        finder.java(0, len(source.values), ())
    elif source.language == "Go":
        finder.golang()
    else:
        finder.script(0, len(source.values), True)
    return sorted(finder.found, key=lambda c: c.first), finder.entities
