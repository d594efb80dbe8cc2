"""Go 1.22."""

from __future__ import annotations

import re

from sievework.llm.syntax.base import Fault, ListParser

_ESC = r"\\(?:[abfnrtv\\{q}]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}})"
_TOKEN = re.compile(
    rf"""(?P<w>[ \t\r\ufeff]+)
    |(?P<l>\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<n>[^\W\d]\w*)
    |(?P<d>0[xX](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?
        |[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?|\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?)
    |(?P<s>"(?:[^"\\\n]|{_ESC.format(q='"')})*"|`[^`]*`|'(?:[^'\\\n]|{_ESC.format(q="'")})')
    |(?P<p><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~])""",
    re.X,
)
# Words (fixed values of the language).
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
#: Most tokens: a plain name, or a sign that begins no longer one, after blanks.
_PLAIN = re.compile(r"[ \t]*(?:([A-Za-z_][A-Za-z0-9_]*)(?!\w)|([,;()\[\]{}]|\.(?![.0-9])|=(?!=)|:(?!=)))")
_STOP = frozenset(("func", "type", "var", "const", "import", "case", "default"))
_INSERT = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


class GoParser(ListParser):
    def parse(self) -> None:
        self.load(self.lex())
        self.level = 0  # below zero in the head of a statement, where a brace opens its block
        start = self.i
        try:
            self.need("package")
            if self.value == "_":
                raise self.wrong("a package name")
            self.name()
            self.end()
        except Fault as fault:
            self.recover(fault, _STOP, start)
        others = False
        while self.kind != "$":
            start = self.i
            self.level = 0
            try:
                if self.eat(";"):
                    continue
                if self.isp("import"):
                    if others:
                        self.note(self.fail("imports must come before other declarations"))
                    self.advance()
                    self.group(self.import_spec)
                elif self.isp("func"):
                    others = True
                    self.func_decl()
                else:
                    others = True
                    self.declaration()
                self.end()
            except Fault as fault:
                self.recover(fault, _STOP, start)
                if self.isp("}"):
                    self.advance()

    def lex(self) -> list[tuple[str, str, int]]:
        text = self.text
        plain = _PLAIN.match
        toks: list[tuple[str, str, int]] = []
        pos, size = 0, len(text)
        match = _TOKEN.match
        semi = False
        while pos < size:
            m = plain(text, pos)
            if m:
                value = m.group(1)
                kind = "p" if not value else "k" if value in _KEYWORDS else "n"
                value = value or m.group(2)
                toks.append((kind, value, m.end() - len(value)))
                semi = kind == "n" or value in _INSERT
                pos = m.end()
                continue
            m = match(text, pos)
            if not m:
                end = text.find("\n", pos)
                what = {"'": "character", '"': "string", "`": "string", "/": "comment"}.get(text[pos], "token")
                self.note(Fault(pos, f"{what} without end or with a wrong part"))
                toks.append(("s" if text[pos] in "'\"`" else "?", text[pos], pos))
                semi = True
                pos = size if text[pos] == "`" or text.startswith("/*", pos) or end < 0 else end
                continue
            kind, value = m.lastgroup, m.group()
            if kind == "l":
                if semi and (value == "\n" or value[1] == "*" and "\n" in value):
                    toks.append(("p", ";", pos))
                    semi = False
            elif kind != "w":
                if kind == "n":
                    kind = "k" if value in _KEYWORDS else "n"
                elif kind == "d" and m.end() < size and (text[m.end()].isalnum() or text[m.end()] == "_"):
                    self.note(Fault(pos, "wrong number"))
                elif kind == "d" and len(value) > 1 and value.isdigit() and value[0] == "0" and ("8" in value or "9" in value):
                    self.note(Fault(pos, "wrong octal number"))
                toks.append((kind, value, pos))
                semi = kind in "nds" or value in _INSERT
            pos = m.end()
        if semi:
            toks.append(("p", ";", size))
        toks.append(("$", "", size))
        return toks

    def end(self) -> None:
        """End of a statement or declaration."""
        if self.kind == "$" or self.isp(")") or self.isp("}"):
            if self.isp(")"):
                raise self.wrong("';'")
            return
        self.need(";")

    # -- declarations

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                if not self.isp(")"):
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.kind == "n" or self.isp("."):
            self.advance()
        if self.kind != "s" or self.value[0] == "'":
            raise self.wrong("an import path")
        self.advance()

    def declaration(self) -> None:
        v = self.value if self.kind == "k" else ""
        if v == "const":
            self.advance()
            self.group(self.const_spec)
        elif v == "var":
            self.advance()
            self.group(self.var_spec)
        elif v == "type":
            self.advance()
            self.group(self.type_spec)
        else:
            raise self.wrong("a declaration")

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not (self.isp("=") or self.isp(";") or self.isp(")")):
            self.type_()
            if not self.isp("="):
                raise self.wrong("'='")
        if self.eat("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.isp("="):
            self.type_()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.isp("[") and self.ahead()[0] == "n" and self.type_parameters_ahead():
            self.type_parameters()
        self.eat("=")
        self.type_()

    def type_parameters_ahead(self) -> bool:
        i = self.i
        try:
            self.type_parameters()
            return not self.isp(";")
        except Fault:
            return False
        finally:
            self.seek(i)

    def type_parameters(self) -> None:
        self.need("[")
        if self.isp("]"):
            raise self.wrong("a type parameter")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if not self.isp("]"):
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type_()
            if not self.eat("|"):
                return

    def func_decl(self) -> None:
        self.need("func")
        if self.isp("("):
            self.parameters()
        self.name()
        if self.isp("["):
            self.type_parameters()
        self.signature()
        if self.isp("{"):
            self.body()

    def signature(self) -> None:
        self.parameters()
        if self.isp("("):
            self.parameters()
        elif self.type_starts():
            self.type_()

    def parameters(self) -> None:
        self.need("(")
        at = self.at
        named = plain = 0
        while not self.eat(")"):
            if self.isp("..."):
                self.advance()
                self.type_()
                plain += 1
            elif self.kind == "n" and self.ahead()[1] in (",", ")") and self.ahead()[0] == "p":
                self.advance()  # a name whose type follows later, or a type
                if self.isp(")"):
                    if named:
                        raise Fault(at, "named and unnamed parameters are mixed")
                else:
                    self.need(",")
                continue
            else:
                i = self.i
                is_named = False
                if self.kind == "n":
                    self.advance()
                    is_named = not (self.isp(".") or self.isp("[") and not self.array_ahead())
                    if not is_named:
                        self.seek(i)
                if is_named:
                    self.eat("...")
                    self.type_()
                    named += 1
                else:
                    self.type_()
                    plain += 1
            if named and plain:
                raise Fault(at, "named and unnamed parameters are mixed")
            if not self.isp(")"):
                self.need(",")

    def array_ahead(self) -> bool:
        """After a name: whether brackets begin the type of a parameter and not type arguments."""
        i = self.i
        try:
            self.type_()
            return self.isp(",") or self.isp(")")
        except Fault:
            return False
        finally:
            self.seek(i)

    # -- types

    def type_starts(self) -> bool:
        return self.kind == "n" or self.kind in "pk" and self.value in ("*", "[", "(", "map", "chan", "func", "struct", "interface", "<-")

    def type_(self) -> None:
        k, v = self.kind, self.value
        if k == "n":
            self.type_name()
        elif v == "*" and k == "p":
            self.advance()
            self.type_()
        elif v == "(" and k == "p":
            self.advance()
            self.type_()
            self.need(")")
        elif v == "[" and k == "p":
            self.advance()
            if not self.eat("]"):
                if not self.eat("..."):
                    self.nested(self.expression)
                self.need("]")
            self.type_()
        elif v == "<-" and k == "p":
            self.advance()
            self.need("chan")
            self.type_()
        elif k == "k" and v == "map":
            self.advance()
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif k == "k" and v == "chan":
            self.advance()
            self.eat("<-")
            self.type_()
        elif k == "k" and v == "func":
            self.advance()
            self.signature()
        elif k == "k" and v == "struct":
            self.struct()
        elif k == "k" and v == "interface":
            self.interface()
        else:
            raise self.wrong("a type")

    def type_name(self) -> None:
        self.name()
        if self.eat("."):
            self.name()
        if self.isp("[") and self.ahead()[1] != "]":
            i = self.i
            try:
                self.need("[")
                while not self.eat("]"):
                    self.type_()
                    if not self.isp("]"):
                        self.need(",")
            except Fault:
                self.seek(i)

    def struct(self) -> None:
        self.need("struct")
        self.need("{")
        while not self.eat("}"):
            if self.eat("*"):
                self.type_name()
            elif self.eat("("):
                raise self.wrong("a field")
            else:
                nxt = self.ahead()
                if self.kind == "n" and (nxt[0] == "s" or nxt[1] in (";", "}", ".") and nxt[0] == "p"):
                    self.type_name()
                else:
                    i = self.i
                    self.names()
                    if self.isp("[") and self.i == i + 1 and not self.field_array():
                        self.seek(i)
                        self.type_name()
                    else:
                        self.type_()
            if self.kind == "s":
                if self.value[0] == "'":
                    raise self.wrong("';'")
                self.advance()
            if not self.isp("}"):
                self.need(";")

    def field_array(self) -> bool:
        i = self.i
        try:
            self.type_()
            return self.kind == "s" or self.isp(";") or self.isp("}")
        except Fault:
            return False
        finally:
            self.seek(i)

    def interface(self) -> None:
        self.need("interface")
        self.need("{")
        while not self.eat("}"):
            if self.kind == "n" and self.ahead()[1] == "(":
                self.name()
                self.signature()
            else:
                self.constraint()
            if not self.isp("}"):
                self.need(";")

    # -- statements

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not (self.isp("}") or self.isp("case") or self.isp("default")):
            if self.kind == "$":
                raise self.wrong("'}'")
            start, level = self.i, self.level
            try:
                self.statement()
                if not (self.isp("}") or self.isp("case") or self.isp("default")):
                    self.need(";")
            except Fault as fault:
                self.level = level
                if self.kind == "$" or self.isp("func") and self.ahead()[0] == "n":
                    raise
                self.recover(fault, _STOP, start)
                if self.isp("func"):
                    raise Fault(fault.at, fault.message) from None

    def statement(self) -> None:
        k, v = self.kind, self.value
        if k == "k":
            if v in ("const", "var", "type"):
                self.declaration()
            elif v in ("go", "defer"):
                self.advance()
                at = self.at
                if self.expression() != "call":
                    raise Fault(at, f"{v} needs a call")
            elif v == "return":
                self.advance()
                if not (self.isp(";") or self.isp("}")):
                    self.expressions()
            elif v in ("break", "continue"):
                self.advance()
                if self.kind == "n":
                    self.advance()
            elif v == "goto":
                self.advance()
                self.name()
            elif v == "fallthrough":
                self.advance()
            elif v == "if":
                self.if_()
            elif v == "for":
                self.for_()
            elif v == "switch":
                self.switch()
            elif v == "select":
                self.select()
            elif v in ("func", "struct", "map", "chan", "interface"):
                self.simple()
            else:
                raise self.wrong("a statement")
        elif k == "p" and v == "{":
            self.block()
        elif k == "p" and v in (";", "}"):
            return
        elif k == "n" and self.ahead()[1] == ":" and self.ahead()[0] == "p":
            self.advance()
            self.advance()
            if not self.isp("}"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranging: bool = False) -> str:
        """A simple statement; says what it was."""
        if ranging and self.isp("range"):
            self.advance()
            self.expression()
            return "range"
        at = self.at
        kinds = self.expressions()
        if self.kind != "p":
            return kinds[0] if len(kinds) == 1 else self._single(at, kinds)
        v = self.value
        if v == ":=":
            if any(k != "name" for k in kinds):
                raise Fault(at, "what is declared must be a name")
            self.advance()
            if ranging and self.isp("range"):
                self.advance()
                self.expression()
                return "range"
            if self.expressions() == ["typeswitch"]:
                return "typeswitch"
            return "define"
        if v in _ASSIGN:
            if v != "=" and len(kinds) > 1:
                raise self.wrong("one operand")
            self.advance()
            if ranging and v == "=" and self.isp("range"):
                self.advance()
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        self._single(at, kinds)
        if v in ("++", "--"):
            self.advance()
            return "assign"
        if v == "<-":
            self.advance()
            self.expression()
            return "send"
        return kinds[0]

    def _single(self, at: int, kinds: list[str]) -> str:
        if len(kinds) > 1:
            raise self.wrong("':=' or '='")
        return kinds[0]

    def if_(self) -> None:
        self.need("if")
        level, self.level = self.level, -1
        if self.isp("{"):
            raise self.fail("missing condition")
        what = ""
        if not self.isp(";"):
            what = self.simple()
        if self.isp(";"):
            self.advance()
            if self.isp("{"):
                raise self.fail("missing condition")
            what = self.simple()
        if what in ("define", "assign", "send", "typeswitch"):
            raise self.fail("a condition must be an expression")
        self.level = level
        self.block()
        if self.eat("else"):
            if self.isp("if"):
                self.if_()
            elif self.isp("{"):
                self.block()
            else:
                raise self.wrong("'if' or a block")

    def for_(self) -> None:
        self.need("for")
        level, self.level = self.level, -1
        if not self.isp("{"):
            what = ""
            if not self.isp(";"):
                what = self.simple(ranging=True)
            if what != "range":
                if self.isp(";"):
                    self.advance()
                    if not self.isp(";"):
                        if self.isp("{"):
                            raise self.wrong("a condition")
                        what = self.simple()
                        if what in ("define", "assign", "send"):
                            raise self.fail("a condition must be an expression")
                    self.need(";")
                    if not self.isp("{") and self.simple() == "define":
                        raise self.fail("can't declare in the post statement")
                elif what in ("define", "assign", "send"):
                    raise self.wrong("a loop's condition")
        self.level = level
        self.block()

    def switch(self) -> None:
        self.need("switch")
        level, self.level = self.level, -1
        if not self.isp("{"):
            what = "" if self.isp(";") else self.simple()
            if self.eat(";"):
                what = "" if self.isp("{") else self.simple()
            if what in ("define", "assign", "send"):
                raise self.fail("a switch needs an expression")
        self.level = level
        self.cases(self.case_list)

    def case_list(self) -> None:
        while True:
            self.expression()
            if not self.eat(","):
                return

    def select(self) -> None:
        self.need("select")

        self.cases(self.simple)

    def cases(self, head) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                level, self.level = self.level, 0
                head()
                self.level = level
            elif not self.eat("default"):
                raise self.wrong("'case'")
            self.need(":")
            level, self.level = self.level, 0
            self.statements()
            self.level = level

    # -- expressions

    def nested(self, f) -> object:
        level, self.level = self.level, max(self.level, 0) + 1
        result = f()
        self.level = level
        return result

    def expressions(self) -> list[str]:
        kinds = [self.expression()]
        while self.eat(","):
            kinds.append(self.expression())
        return kinds

    def expression(self, least: int = 0) -> str:
        """Precedence climbing."""
        kind = self.unary()
        while self.kind == "p":
            power = _BINARY.get(self.value, 0)
            if power <= least:
                break
            self.advance()
            self.expression(power)
            kind = "binary"
        return kind

    def unary(self) -> str:
        if self.kind == "p":
            v = self.value
            if v in ("+", "-", "!", "^", "&", "*", "~"):
                self.advance()
                self.unary()
                return "unary"
            if v == "<-":
                if self.ahead()[1] == "chan":
                    self.type_()
                    return self.suffixes("type")
                self.advance()
                self.unary()
                return "receive"
        return self.suffixes(*self.operand())

    def operand(self) -> tuple[str, bool]:
        """Kind, and whether a composite literal may follow."""
        k, v = self.kind, self.value
        if k == "n":
            self.advance()
            return "name", True
        if k in "ds":
            self.advance()
            return "value", False
        if k == "p" and v == "(":
            self.advance()
            self.nested(self.inner)
            self.need(")")
            return "paren", False
        if k == "p" and v == "[" or k == "k" and v in ("map", "struct"):
            self.type_()
            return "type", True
        if k == "k" and v == "func":
            self.advance()
            self.signature()
            if self.isp("{"):
                self.body()
                return "func", False
            return "type", False
        if k == "k" and v in ("chan", "interface"):
            self.type_()
            return "type", False
        raise self.wrong("an expression")

    def inner(self) -> str:
        return self.expression()

    def suffixes(self, kind: str, literal: bool = False) -> str:
        forced = kind == "type"  # a written-out type takes its literal even in a head
        while self.kind == "p":
            v = self.value
            if v == ".":
                self.advance()
                if self.eat("("):
                    if self.eat("type"):
                        kind = "typeswitch"
                    else:
                        self.type_()
                        kind = "assert"
                    self.need(")")
                    literal = False
                else:
                    self.name()
                    kind = "selector"
            elif v == "[":
                self.advance()
                self.nested(self.index)
                self.need("]")
                kind = "index"
            elif v == "(":
                self.advance()
                self.nested(self.arguments)
                kind, literal = "call", False
            elif v == "{" and literal and (self.level >= 0 or forced):
                self.literal()
                kind, literal = "composite", False
            else:
                return kind
            forced = False
        return kind

    def index(self) -> None:
        if self.isp("]"):
            raise self.wrong("an index")
        colons = 0
        seen = False
        commas = False
        while not self.isp("]"):
            if self.eat(":"):
                colons += 1
                if colons == 2 and (not seen or self.isp("]")):
                    raise self.wrong("an index")
                seen = False
                if colons > 2:
                    raise self.wrong("']'")
            elif self.isp(",") and seen and not colons:
                self.advance()
                commas, seen = True, False
            elif not seen:
                self.expression()
                seen = True
            else:
                raise self.wrong("']'")
        if commas and colons:
            raise self.wrong("']'")

    def arguments(self) -> None:
        while not self.eat(")"):
            self.expression()
            self.eat("...")
            if not self.isp(")"):
                self.need(",")

    def literal(self) -> None:
        self.need("{")

        def elements() -> None:
            while not self.eat("}"):
                self.element()
                if self.eat(":"):
                    self.element()
                if not self.isp("}"):
                    self.need(",")

        self.nested(elements)

    def element(self) -> None:
        if self.isp("{"):
            self.literal()
        else:
            self.expression()
