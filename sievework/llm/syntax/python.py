"""Python 3.13."""

from __future__ import annotations

import re

from sievework.llm.syntax.base import Fault, ListParser

_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[0-9](?:_?[0-9])*[jJ]?"
)
_NAME = re.compile(r"[^\W\d][\w·]*")
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|->|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|!=|<=|>=|:=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_STRING = re.compile(r"(?i:([rbuft]|br|rb|fr|rf|))('''|\"\"\"|'|\")")
_BODY = {
    "'": re.compile(r"(?:[^'\\\n]|\\[\s\S])*'"), '"': re.compile(r'(?:[^"\\\n]|\\[\s\S])*"'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"), '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
_INDENT = re.compile(r"[ \t\f]*")
_SKIP = re.compile(r"(?:[ \t\f]|\\\n)*(?:#[^\n]*)?")
#: Most tokens: a plain name that begins no string, or a sign that begins no longer one, after blanks.
_PLAIN = re.compile(r"[ \t\f]*(?:([A-Za-z_][A-Za-z0-9_]*)(?![\w·'\"])|([,()\[\]{}]|\.(?![.0-9])|:(?!=)|=(?!=)))")
_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N\{[^{}]+\}|[\s\S])")
_BROKEN = frozenset(("\\x", "\\u", "\\U", "\\N"))
# Words (fixed values of the language).
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_AUGMENT = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_COMPARE = frozenset(("<", ">", "==", ">=", "<=", "!="))
_CLOSE = {")": "(", "]": "[", "}": "{"}
_TARGETS = frozenset(("name", "attribute", "item"))


class PythonParser(ListParser):
    """Adds three kinds of tokens: ``l`` ends a line, ``i`` opens and ``o`` closes a block."""

    def __init__(self, text: str):
        super().__init__(text.replace("\r\n", "\n").replace("\r", "\n"))

    def parse(self) -> None:
        if "\x00" in self.text:
            self.note(Fault(self.text.index("\x00"), "null byte"))
            return
        self.load(self.lex())
        while self.kind != "$":
            self.guarded(self.statement)

    def guarded(self, f) -> None:
        start = self.i
        try:
            f()
        except Fault as fault:
            self.note(fault)
            if self.i == start and self.kind != "$":
                self.advance()
            # Panic mode: on to the line after, past a block that hangs on the broken line.
            while self.kind not in "l$":
                self.advance()
            if self.kind == "l":
                self.advance()
            depth = 0
            while self.kind in "io" or depth:
                if self.kind == "$":
                    return
                if self.kind == "o" and not depth:
                    return
                depth += (self.kind == "i") - (self.kind == "o")
                self.advance()

    # -- tokens

    def lex(self) -> list[tuple[str, str, int]]:
        text, size = self.text, len(self.text)
        toks: list[tuple[str, str, int]] = []
        indents, alternative = [0], [0]
        open_: list[tuple[str, int]] = []
        pos = 1 if text.startswith("\ufeff") else 0
        fresh = True
        plain = _PLAIN.match
        while pos < size:
            if fresh and not open_:
                m = _INDENT.match(text, pos)
                column = other = 0
                for c in m.group():
                    if c == " ":
                        column, other = column + 1, other + 1
                    elif c == "\t":
                        column, other = (column // 8 + 1) * 8, other + 1
                    else:
                        column = other = 0
                at = m.end()
                if at >= size:
                    break
                if text[at] == "\n":
                    pos = at + 1
                    continue
                if text[at] == "#":
                    end = text.find("\n", at)
                    pos = size if end < 0 else end + 1
                    continue
                fresh = False
                if column > indents[-1]:
                    if other <= alternative[-1]:
                        self.note(Fault(at, "tabs and spaces are mixed"))
                    indents.append(column)
                    alternative.append(other)
                    toks.append(("i", "", at))
                else:
                    while column < indents[-1]:
                        indents.pop()
                        alternative.pop()
                        toks.append(("o", "", at))
                    if column != indents[-1]:
                        self.note(Fault(at, "unindent matches no outer level"))
                    elif other != alternative[-1]:
                        self.note(Fault(at, "tabs and spaces are mixed"))
                pos = at
            m = plain(text, pos)
            if m:
                v = m.group(1)
                pos = m.end()
                if v:
                    toks.append(("k" if v in _KEYWORDS else "n", v, m.start(1)))
                    continue
                v = m.group(2)
                if v in "([{":
                    open_.append((v, pos - 1))
                elif v in _CLOSE:
                    if not open_ or open_[-1][0] != _CLOSE[v]:
                        self.note(Fault(pos - 1, f"{v!r} closes nothing that is open"))
                    if open_:
                        open_.pop()
                toks.append(("p", v, pos - 1))
                continue
            pos = _SKIP.match(text, pos).end()
            if pos >= size:
                break
            c = text[pos]
            if c == "\n":
                if not open_:
                    toks.append(("l", "", pos))
                    fresh = True
                pos += 1
                continue
            m = _STRING.match(text, pos)
            if m:
                pos = self.string(m, toks)
                continue
            m = _NAME.match(text, pos)
            if m:
                v, end = m.group(), m.end()
                while end < size and text[end] > "\x7f" and (v + text[end]).isidentifier():
                    more = _NAME.match(text, end + 1)
                    end = more.end() if more else end + 1
                    v = text[pos:end]
                if not v.isascii() and not v.isidentifier():
                    self.note(Fault(pos, "wrong character"))
                toks.append(("k" if v in _KEYWORDS else "n", v, pos))
                pos = end
                continue
            if c.isdigit() and c.isascii() or c == "." and text[pos + 1 : pos + 2].isdigit():
                m = _NUMBER.match(text, pos)
                v = m.group()
                rest = _NAME.match(text, m.end())
                if rest and not re.match(r"and|else|for|if|in|is|not|or", rest.group()) or text[m.end() : m.end() + 1].isdigit() or text[m.end() : m.end() + 1] == "_":
                    self.note(Fault(pos, "wrong number"))
                elif len(v) > 1 and v[0] == "0" and re.fullmatch(r"[0-9_]+", v) and v.strip("0_"):
                    self.note(Fault(pos, "leading zeros"))
                toks.append(("0", v, pos))
                pos = m.end()
                continue
            m = _OPERATOR.match(text, pos)
            if not m:
                self.note(Fault(pos, "character after a line continuation" if c == "\\" else "wrong character"))
                toks.append(("?", c, pos))
                pos += 1
                continue
            v = m.group()
            if v in "([{":
                open_.append((v, pos))
            elif v in _CLOSE:
                if not open_ or open_[-1][0] != _CLOSE[v]:
                    self.note(Fault(pos, f"{v!r} closes nothing that is open"))
                if open_:
                    open_.pop()
            toks.append(("p", v, pos))
            pos = m.end()
        if open_:
            self.note(Fault(open_[-1][1], f"{open_[-1][0]!r} is never closed"))
        if toks and toks[-1][0] != "l":
            toks.append(("l", "", size))
        toks += [("o", "", size)] * (len(indents) - 1)
        toks.append(("$", "", size))
        return toks

    def string(self, m: re.Match, toks: list) -> int:
        prefix, quote = m.group(1).lower(), m.group(2)
        if prefix == "t":  # no prefix of this version: a name and a string
            toks.append(("n", m.group(1), m.start()))
            m = _STRING.match(self.text, m.end(1))
            prefix = ""
        if "f" in prefix:
            end = self.fstring(m.end(), quote, "r" in prefix)
            toks.append(("s", "f", m.start()))
            return end
        body = _BODY[quote].match(self.text, m.end())
        if not body:
            self.note(Fault(m.start(), "string without end"))
            toks.append(("s", "b" if "b" in prefix else "", m.start()))
            end = self.text.find("\n", m.end())
            return len(self.text) if len(quote) == 3 or end < 0 else end
        value = body.group()
        if "b" in prefix:
            if not value.isascii():
                self.note(Fault(m.start(), "bytes hold ASCII only"))
            if "r" not in prefix and "\\x" in value and any(e.group() == "\\x" for e in _ESCAPE.finditer(value)):
                self.note(Fault(m.start(), "wrong escape"))
        elif "r" not in prefix and "\\" in value:
            self.escapes(value, m.start())
        toks.append(("s", "b" if "b" in prefix else "", m.start()))
        return body.end()

    def escapes(self, value: str, at: int) -> None:
        if any(e.group() in _BROKEN for e in _ESCAPE.finditer(value)):
            self.note(Fault(at, "wrong escape"))

    def fstring(self, pos: int, quote: str, raw: bool) -> int:
        """Scan a formatted string from after its opening quote; its expressions are parsed on their own."""
        text, size = self.text, len(self.text)
        begin = pos
        long = len(quote) == 3
        while pos < size:
            c = text[pos]
            if text.startswith(quote, pos):
                return pos + len(quote)
            if c == "\\":
                if not raw:
                    e = _ESCAPE.match(text, pos)
                    if e and e.group() in _BROKEN:
                        self.note(Fault(pos, "wrong escape"))
                    elif text.startswith("\\N{", pos):
                        pos = text.index("}", pos) + 1
                        continue
                    pos += 2 if text[pos + 1 : pos + 2] not in "{}" else 1
                else:
                    pos += 2 if text[pos + 1 : pos + 2] not in ("{", "}") else 1
            elif c == "\n" and not long:
                break
            elif c == "{":
                if text.startswith("{{", pos):
                    pos += 2
                else:
                    pos = self.field(pos + 1, quote, raw)
            elif c == "}":
                if not text.startswith("}}", pos):
                    self.note(Fault(pos, "single '}' in a formatted string"))
                pos += 2 if text.startswith("}}", pos) else 1
            else:
                pos += 1
        self.note(Fault(begin, "string without end"))
        return size if long else pos

    def field(self, pos: int, quote: str, raw: bool) -> int:
        """A replacement field from after its brace to after its end."""
        text, size = self.text, len(self.text)
        begin, depth = pos, []
        while pos < size:
            c = text[pos]
            m = _STRING.match(text, pos)
            if m and (pos == begin or not (text[pos - 1].isalnum() or text[pos - 1] == "_") or not m.group(1)):
                sink: list = []
                pos = self.string(m, sink)
                continue
            if c == "#":
                end = text.find("\n", pos)
                pos = size if end < 0 else end
                continue
            if c in "([{":
                depth.append(c)
            elif c in ")]}" and depth:
                if depth.pop() != _CLOSE[c]:
                    self.note(Fault(pos, f"{c!r} closes nothing that is open"))
            elif not depth and (c == "}" or c == ":" or c == "!" and text[pos + 1 : pos + 2] != "=" or c == "=" and text[pos + 1 : pos + 2] != "=" and text[pos - 1] not in "=!<>" and self._debug_ahead(pos + 1)):
                break
            elif c == ")" or c == "]":
                self.note(Fault(pos, f"{c!r} closes nothing that is open"))
            pos += 1
        inner = text[begin:pos]
        if not re.sub(r"#[^\n]*", "", inner).strip():
            self.note(Fault(begin, "empty field in a formatted string"))
        else:
            sub = PythonParser("(" + inner + "\n)" if "#" in inner else "(" + inner + ")")
            try:
                sub.load(sub.lex())
                sub.need("(")
                sub.star_or_yield()
                sub.need(")")
                if sub.kind not in "l$":
                    raise sub.wrong()
            except Fault as fault:
                sub.note(fault)
            for f in sub.faults[:1]:
                self.note(Fault(begin + max(f.at - 1, 0), f.message))
        if text.startswith("=", pos):
            pos += 1
            while pos < size and text[pos] in " \t\n":
                pos += 1
        if text.startswith("!", pos):
            m = re.compile(r"!\s*([^\W\d]\w*)?\s*").match(text, pos)
            if m.group(1) not in ("r", "s", "a"):
                self.note(Fault(pos, "wrong conversion"))
            pos = m.end()
        if text.startswith(":", pos):
            pos += 1
            while pos < size and text[pos] != "}":
                if text.startswith(quote, pos) or text[pos] == "\n" and len(quote) == 1:
                    break
                if text[pos] == "{":
                    pos = self.field(pos + 1, quote, raw)
                else:
                    pos += 1
        if not text.startswith("}", pos):
            self.note(Fault(begin, "field without end"))
            return pos
        return pos + 1

    def _debug_ahead(self, pos: int) -> bool:
        return bool(re.compile(r"[ \t\n]*(?:[}:]|![^=])").match(self.text, pos))

    # -- statements

    def statement(self) -> None:
        k, v = self.kind, self.value
        if k == "i":
            raise self.fail("unexpected indent")
        if k == "o":
            raise self.fail("unexpected unindent")
        if k == "l":
            raise self.wrong("a statement")
        if k == "k":
            handler = getattr(self, f"do_{v}", None)
            if handler:
                return handler()
        elif k == "p" and v == "@":
            while self.eat("@"):
                self.named()
                self.line()
            if self.isp("async"):
                self.advance()
                if not self.isp("def"):
                    raise self.wrong("'def'")
            if self.isp("def"):
                return self.do_def()
            if self.isp("class"):
                return self.do_class()
            raise self.wrong("'def' or 'class'")
        elif k == "n" and v == "match" and self.looks(self._match_ahead):
            return self.match()
        return self.simple_line()

    def looks(self, f) -> bool:
        i, faults = self.i, len(self.faults)
        try:
            return f() is not False
        except Fault:
            return False
        finally:
            del self.faults[faults:]
            self.seek(i)

    def line(self) -> None:
        if self.kind == "l":
            self.advance()
        elif self.kind != "$":
            raise self.wrong("the end of the line")

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.eat(";"):
                break
            if self.kind in "l$":
                break
        self.line()

    def block(self) -> None:
        self.need(":")
        if self.kind == "l":
            self.advance()
            if self.kind != "i":
                raise self.fail("expected an indented block")
            self.advance()
            while self.kind != "o":
                if self.kind == "$":
                    return
                self.guarded(self.statement)
            self.advance()
        else:
            if self.kind == "k" and self.value in ("if", "while", "for", "try", "with", "def", "class", "async"):
                raise self.wrong("a simple statement")
            self.simple_line()

    def simple(self) -> None:
        k, v = self.kind, self.value
        if k == "k":
            if v in ("pass", "break", "continue"):
                return self.advance()
            if v == "return":
                self.advance()
                if not self.over():
                    self.star_expressions()
                return None
            if v == "raise":
                self.advance()
                if not self.over():
                    self.expression()
                    if self.eat("from"):
                        self.expression()
                return None
            if v in ("global", "nonlocal"):
                self.advance()
                self.name()
                while self.eat(","):
                    self.name()
                return None
            if v == "del":
                self.advance()
                at = self.at
                if self.targets_of(self.star_expressions(), star=False):
                    return None
                raise Fault(at, "can't be deleted")
            if v == "assert":
                self.advance()
                self.expression()
                if self.eat(","):
                    self.expression()
                return None
            if v == "import":
                self.advance()
                while True:
                    self.dotted()
                    if self.eat("as"):
                        self.name()
                    if not self.eat(","):
                        return None
            if v == "from":
                return self.from_import()
        elif k == "n" and v == "type" and self.ahead()[0] == "n" and self.looks(self._type_ahead):
            self.advance()
            self.name()
            self.type_parameters()
            self.need("=")
            return self.expression() and None
        return self.assignment()

    def _type_ahead(self) -> bool:
        self.advance()
        self.name()
        self.type_parameters()
        return self.isp("=")

    def over(self) -> bool:
        return self.kind in "l$" or self.isp(";")

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def from_import(self) -> None:
        self.need("from")
        dots = False
        while self.isp(".") or self.isp("..."):
            self.advance()
            dots = True
        if self.kind == "n" or not dots:
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                break
            if paren and self.isp(")"):
                break
        if paren:
            self.need(")")

    def targets_of(self, kind: str, star: bool = True) -> bool:
        """Whether an expression of this kind can be assigned; tuples and lists say so of their parts."""
        return kind in _TARGETS or kind in ("tuple", "list") and star or kind in ("tuple.", "list.")

    def assignment(self) -> None:
        at = self.at
        begin = self.i
        kind = self.star_or_yield()
        if self.isp(":"):
            if kind not in _TARGETS:
                raise Fault(at, "can't be annotated" if kind in ("tuple", "tuple.", "list", "list.") else f"unexpected ':' after {self.toks[begin][1]!r}")
            self.advance()
            self.expression()
            if self.eat("="):
                self.star_or_yield()
            return
        if self.kind == "p" and self.value in _AUGMENT:
            if kind not in _TARGETS:
                raise Fault(at, "can't be assigned")
            self.advance()
            self.star_or_yield()
            return
        while self.isp("="):
            if not self.targets_of(kind):
                raise Fault(at, "can't be assigned")
            self.advance()
            at = self.at
            kind = self.star_or_yield()
        if kind == "star":
            raise Fault(at, "can't use a starred expression here")

    def do_if(self) -> None:
        self.advance()
        self.named()
        self.block()
        while self.isp("elif"):
            self.advance()
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def do_while(self) -> None:
        self.advance()
        self.named()
        self.block()
        if self.eat("else"):
            self.block()

    def do_for(self) -> None:
        self.advance()
        at = self.at
        if not self.targets_of(self.target_list()):
            raise Fault(at, "can't be assigned")
        self.need("in")
        self.star_expressions()
        self.block()
        if self.eat("else"):
            self.block()

    def target_list(self) -> str:
        """Targets before ``in``: no comparison is read."""
        kinds = []
        while True:
            star = self.eat("*")
            kind = self.arithmetic(0)
            kinds.append("star" if star and kind in _TARGETS | {"tuple", "list", "tuple.", "list."} else kind)
            if not self.eat(","):
                if len(kinds) == 1:
                    return "value" if star else kinds[0]
                break
            if self.isp("in"):
                break
        return self.sequence("tuple", kinds)

    def sequence(self, what: str, kinds: list[str]) -> str:
        """``what`` with a dot if it holds no star and can be assigned, without if it can, else ``value``."""
        if not all(k == "star" or self.targets_of(k) for k in kinds) or kinds.count("star") > 1:
            return f"{what}!"
        return what if any(k == "star" or k in ("tuple", "list") for k in kinds) else f"{what}."

    def do_try(self) -> None:
        self.advance()
        self.block()
        handlers = 0
        group = None
        bare = False
        while self.isp("except"):
            if bare:
                raise self.fail("a bare except must come last")
            self.advance()
            star = self.eat("*")
            if group is not None and group != star:
                raise self.fail("except and except* are mixed")
            group = star
            if self.isp(":"):
                if star:
                    raise self.wrong("an exception")
                bare = True
            else:
                self.expression()
                if self.isp(","):
                    raise self.fail("several exceptions need parentheses")
                if self.eat("as"):
                    self.name()
            self.block()
            handlers += 1
        if handlers and self.eat("else"):
            self.block()
        if self.eat("finally"):
            self.block()
        elif not handlers:
            raise self.wrong("'except' or 'finally'")

    def do_with(self) -> None:
        self.advance()

        def several() -> bool:
            self.need("(")
            while True:
                self.expression()
                if self.eat("as"):
                    self.with_target()
                if not self.eat(","):
                    break
                if self.isp(")"):
                    break
            self.need(")")
            return self.isp(":")

        if self.isp("(") and self.looks(several):
            several()
        else:
            while True:
                self.expression()
                if self.eat("as"):
                    self.with_target()
                if not self.eat(","):
                    break
        self.block()

    def with_target(self) -> None:
        at = self.at
        if self.isp("*") or not self.targets_of(self.primary()):
            raise Fault(at, "can't be assigned")

    def do_async(self) -> None:
        self.advance()
        if self.isp("def"):
            return self.do_def()
        if self.isp("for"):
            return self.do_for()
        if self.isp("with"):
            return self.do_with()
        raise self.wrong("'def', 'for' or 'with'")

    def do_def(self) -> None:
        self.advance()
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", annotated=True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        self.block()

    def do_class(self) -> None:
        self.advance()
        self.name()
        self.type_parameters()
        if self.isp("("):
            self.arguments()
        self.block()

    def do_elif(self) -> None:
        raise self.wrong("a statement")

    do_else = do_except = do_finally = do_elif

    def type_parameters(self) -> None:
        if not self.eat("["):
            return
        default = False
        while True:
            star = self.eat("*") or self.eat("**")
            self.name()
            if not star and self.eat(":"):
                self.expression()
            if self.eat("="):
                default = True
                if star and self.isp("*"):
                    self.advance()
                self.expression()
            elif default:
                raise self.fail("a type parameter without default after one with")
            if not self.eat(",") or self.isp("]"):
                break
        self.need("]")

    def parameters(self, end: str, annotated: bool) -> None:
        default = slash = star = False
        count = 0
        while not self.isp(end):
            if self.eat("/"):
                if slash or star or not count:
                    raise self.fail("'/' is misplaced")
                slash = True
            elif self.eat("**"):
                self.name()
                if annotated and self.eat(":"):
                    self.expression()
                if self.isp("="):
                    raise self.fail("no default is allowed here")
                self.eat(",")
                if not self.isp(end):
                    raise self.fail("parameters follow **")
                return
            elif self.eat("*"):
                if star:
                    raise self.fail("'*' is repeated")
                star = True
                if self.isp(","):
                    nxt = self.ahead()
                    if nxt[1] == end or nxt[1] == "**":
                        raise self.fail("named parameters must follow a bare *")
                elif self.kind != "n":
                    raise self.wrong("a name")
                else:
                    self.name()
                    if annotated and self.eat(":"):
                        self.eat("*")
                        self.expression()
                    if self.isp("="):
                        raise self.fail("no default is allowed here")
            else:
                self.name()
                count += 1
                if annotated and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise self.fail("a parameter without default after one with")
            if not self.isp(end):
                self.need(",")

    def _match_ahead(self) -> bool:
        self.advance()
        self.subject()
        if not self.isp(":"):
            return False
        self.advance()
        if self.kind != "l" or self.ahead()[0] != "i":
            return False
        return self.ahead(2)[:2] == ("n", "case")

    def subject(self) -> None:
        if self.isp(":"):
            raise self.wrong()
        while True:
            if self.eat("*"):
                self.arithmetic(0)
            else:
                self.named()
            if not self.eat(",") or self.isp(":"):
                return

    def match(self) -> None:
        self.advance()
        self.subject()
        self.need(":")
        self.advance()
        self.advance()
        while self.kind != "o":
            if self.kind == "$":
                return
            if not (self.kind == "n" and self.value == "case"):
                raise self.wrong("'case'")
            self.advance()
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()
        self.advance()

    def patterns(self) -> None:
        while True:
            if self.eat("*"):
                self.name()
            else:
                self.as_pattern()
            if not self.eat(",") or self.isp(":") or self.isp("if"):
                return

    def as_pattern(self) -> None:
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            if self.value == "_":
                raise self.wrong("a name")
            self.name()

    def closed_pattern(self) -> None:
        k, v = self.kind, self.value
        if k == "0" or k == "p" and v == "-":
            self.eat("-")
            if self.kind != "0":
                raise self.wrong("a number")
            self.advance()
            if self.isp("+") or self.isp("-"):
                self.advance()
                if self.kind != "0" or self.value[-1] not in "jJ":
                    raise self.wrong("an imaginary number")
                self.advance()
        elif k == "s":
            self.strings()
        elif k == "k" and v in ("None", "True", "False"):
            self.advance()
        elif k == "n":
            self.advance()
            while self.eat("."):
                self.name()
            if self.eat("("):
                keyword = False
                while not self.eat(")"):
                    if self.kind == "n" and self.ahead()[1] == "=" and self.ahead()[0] == "p":
                        self.advance()
                        self.advance()
                        keyword = True
                    elif keyword:
                        raise self.fail("a positional pattern follows keywords")
                    self.as_pattern()
                    if not self.isp(")"):
                        self.need(",")
        elif k == "p" and v in "([":
            self.advance()
            end = ")" if v == "(" else "]"
            while not self.eat(end):
                if self.eat("*"):
                    self.name()
                else:
                    self.as_pattern()
                if not self.isp(end):
                    self.need(",")
        elif k == "p" and v == "{":
            self.advance()
            while not self.eat("}"):
                if self.eat("**"):
                    self.name()
                else:
                    if self.kind == "n" and self.ahead()[1] != ".":
                        raise self.wrong("a key")
                    self.closed_pattern()
                    self.need(":")
                    self.as_pattern()
                if not self.isp("}"):
                    self.need(",")
        else:
            raise self.wrong("a pattern")

    # -- expressions

    def star_or_yield(self) -> str:
        if self.isp("yield"):
            self.advance()
            if self.eat("from"):
                self.expression()
            elif not (self.over() or self.kind == "p" and self.value in (")", "]", "}", "=")):
                self.star_expressions()
            return "value"
        return self.star_expressions()

    def star_expressions(self, named: bool = False) -> str:
        kinds = []
        while True:
            if self.eat("*"):
                kind = self.arithmetic(0)
                kinds.append("star" if self.targets_of(kind) else "star!")
            else:
                kinds.append(self.named() if named else self.expression())
            if not self.eat(","):
                if len(kinds) == 1:
                    return "star" if kinds[0] in ("star", "star!") else kinds[0]
                break
            if self.ends_list():
                break
        return self.sequence("tuple", kinds)

    def ends_list(self) -> bool:
        return self.kind in "l$" or self.kind == "p" and self.value in (")", "]", "}", "=", ":", ";") or self.kind == "p" and self.value in _AUGMENT

    def named(self) -> str:
        if self.kind == "n" and self.ahead()[1] == ":=" and self.ahead()[0] == "p":
            self.advance()
            self.advance()
            self.expression()
            return "value"
        return self.expression()

    def expression(self) -> str:
        if self.isp("lambda"):
            self.advance()
            self.parameters(":", annotated=False)
            self.need(":")
            self.expression()
            return "value"
        kind = self.logic(0)
        if self.isp("if"):
            self.advance()
            self.logic(0)
            self.need("else")
            self.expression()
            return "value"
        return kind

    def logic(self, level: int) -> str:
        """or, and, not, comparison."""
        if level < 2:
            word = ("or", "and")[level]
            kind = self.logic(level + 1)
            while self.isp(word):
                self.advance()
                self.logic(level + 1)
                kind = "value"
            return kind
        if self.isp("not"):
            self.advance()
            self.logic(2)
            return "value"
        kind = self.arithmetic(0)
        while True:
            if self.kind == "p" and self.value in _COMPARE or self.isp("in"):
                self.advance()
            elif self.isp("is"):
                self.advance()
                self.eat("not")
            elif self.isp("not") and self.ahead()[1] == "in" and self.ahead()[0] == "k":
                self.advance()
                self.advance()
            else:
                return kind
            self.arithmetic(0)
            kind = "value"

    def arithmetic(self, least: int) -> str:
        """Precedence climbing."""
        kind = self.unary()
        while self.kind == "p":
            power = _BINARY.get(self.value, 0)
            if power <= least:
                break
            self.advance()
            self.arithmetic(power)
            kind = "value"
        return kind

    def unary(self) -> str:
        if self.kind == "p" and self.value in ("+", "-", "~"):
            self.advance()
            self.unary()
            return "value"
        awaited = self.eat("await")
        kind = self.primary()
        if self.eat("**"):
            self.unary()
            return "value"
        return "value" if awaited else kind

    def primary(self) -> str:
        kind = self.atom()
        while self.kind == "p":
            v = self.value
            if v == ".":
                self.advance()
                self.name()
                kind = "attribute"
            elif v == "(":
                self.arguments()
                kind = "call"
            elif v == "[":
                self.advance()
                self.slices()
                self.need("]")
                kind = "item"
            else:
                break
        return kind

    def slices(self) -> None:
        if self.isp("]"):
            raise self.wrong("an index")
        while True:
            if self.eat("*"):
                self.arithmetic(0)
            else:
                if not self.isp(":"):
                    self.named()
                if self.eat(":"):
                    if not (self.isp(":") or self.isp("]") or self.isp(",")):
                        self.expression()
                    if self.eat(":") and not (self.isp("]") or self.isp(",")):
                        self.expression()
            if not self.eat(",") or self.isp("]"):
                return

    def strings(self) -> None:
        raw = self.value == "b"
        while self.kind == "s":
            if (self.value == "b") != raw:
                raise self.fail("bytes and text are mixed")
            self.advance()

    def atom(self) -> str:
        k, v = self.kind, self.value
        if k == "n":
            self.advance()
            return "name"
        if k == "s":
            self.strings()
            return "value"
        if k == "0":
            self.advance()
            return "value"
        if k == "k" and v in ("None", "True", "False"):
            self.advance()
            return "value"
        if k == "p":
            if v == "...":
                self.advance()
                return "value"
            if v == "(":
                return self.group()
            if v == "[":
                return self.list_()
            if v == "{":
                return self.braces()
        raise self.wrong("an expression")

    def comprehension(self) -> bool:
        found = False
        while self.isp("for") or self.isp("async") and self.ahead()[1] == "for":
            found = True
            self.eat("async")
            self.advance()
            at = self.at
            if not self.targets_of(self.target_list()):
                raise Fault(at, "can't be assigned")
            self.need("in")
            self.logic(0)
            while self.eat("if"):
                self.logic(0)
        return found

    def group(self) -> str:
        self.need("(")
        if self.eat(")"):
            return "tuple."
        if self.isp("yield"):
            self.star_or_yield()
            self.need(")")
            return "value"
        kinds = []
        comma = False
        while not self.isp(")"):
            at = self.at
            if self.eat("*"):
                kind = self.arithmetic(0)
                kinds.append("star" if self.targets_of(kind) else "star!")
            else:
                kinds.append(self.named())
                if len(kinds) == 1 and not comma and (self.isp("for") or self.isp("async")):
                    if not self.comprehension():
                        raise self.wrong()
                    self.need(")")
                    return "value"
            if not self.eat(","):
                break
            comma = True
        self.need(")")
        if not comma:
            if kinds[0] in ("star", "star!"):
                raise Fault(at, "can't use a starred expression here")
            return kinds[0]
        return self.sequence("tuple", kinds)

    def list_(self) -> str:
        self.need("[")
        kinds = []
        while not self.isp("]"):
            if self.eat("*"):
                kind = self.arithmetic(0)
                kinds.append("star" if self.targets_of(kind) else "star!")
            else:
                kinds.append(self.named())
                if len(kinds) == 1 and (self.isp("for") or self.isp("async")):
                    if not self.comprehension():
                        raise self.wrong()
                    self.need("]")
                    return "value"
            if not self.eat(","):
                break
        self.need("]")
        return self.sequence("list", kinds)

    def braces(self) -> str:
        self.need("{")
        first = True
        mapping = None
        while not self.isp("}"):
            if self.isp("**"):
                self.advance()
                self.arithmetic(0)
                this = True
            elif self.isp("*"):
                self.advance()
                self.arithmetic(0)
                this = False
            else:
                self.named()
                this = self.eat(":")
                if this:
                    self.expression()
                if first and (self.isp("for") or self.isp("async")):
                    if not self.comprehension():
                        raise self.wrong()
                    self.need("}")
                    return "value"
            if mapping is not None and mapping != this:
                raise self.wrong("':'" if mapping else "'}'")
            mapping, first = this, False
            if not self.eat(","):
                break
        self.need("}")
        return "value"

    def arguments(self) -> None:
        self.need("(")
        keyword = unpacked = False
        count = 0
        while not self.eat(")"):
            if self.eat("**"):
                self.expression()
                unpacked = True
            elif self.eat("*"):
                if unpacked:
                    raise self.fail("iterable unpacking follows keyword unpacking")
                self.expression()
            elif self.kind == "n" and self.ahead()[1] == "=" and self.ahead()[0] == "p":
                self.advance()
                self.advance()
                self.expression()
                keyword = True
            else:
                at = self.at
                self.named()
                if self.isp("="):
                    raise Fault(at, "a keyword must be a name")
                if self.isp("for") or self.isp("async"):
                    if not self.comprehension():
                        raise self.wrong()
                    if count or not self.isp(")"):
                        raise Fault(at, "a generator needs parentheses")
                elif keyword or unpacked:
                    raise Fault(at, "a positional argument follows keywords")
            count += 1
            if not self.isp(")"):
                self.need(",")
