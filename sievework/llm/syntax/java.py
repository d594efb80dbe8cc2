"""Java 21, without preview features."""

from __future__ import annotations

import re

from sievework.llm.syntax.base import Fault, ListParser

_ESC = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_TOKEN = re.compile(
    rf"""(?P<w>[\s\ufeff]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<n>(?:[^\W\d]|\$)[\w$]*)
    |(?P<d>0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?(?:\.(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?)?(?:[pP][+-]?[0-9](?:_*[0-9])*)?[lLfFdD]?|0[bB][01](?:_*[01])*[lL]?
        |[0-9](?:_*[0-9])*(?:\.(?:[0-9](?:_*[0-9])*)?)?(?:[eE][+-]?[0-9](?:_*[0-9])*)?[lLfFdD]?|\.[0-9](?:_*[0-9])*(?:[eE][+-]?[0-9](?:_*[0-9])*)?[fFdD]?)
    |(?P<s>\"\"\"[ \t\f]*\r?\n(?:[^"\\]|\\(?:[btnfrs"'\\\n]|\r\n|[0-3]?[0-7]{{1,2}}|u+[0-9a-fA-F]{{4}})|"(?!""))*\"\"\"|"(?:[^"\\\n\r]|{_ESC})*"|'(?:[^'\\\n\r]|{_ESC})')
    |(?P<p>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/%&|^<>=!()\[\]{{}},;.:~?@])""",
    re.X,
)
# Words (fixed values of the language).
_KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
_PRIMITIVE = frozenset("boolean byte char double float int long short".split())
_MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())
#: Most tokens: a plain name, or a sign that begins no longer one, after blanks.
_PLAIN = re.compile(r"[ \t\n]*(?:([A-Za-z_$][A-Za-z0-9_$]*)(?![\w$])|([,;()\[\]{}@]|\.(?![.0-9])|=(?!=)))")
_STOP = frozenset(("class", "interface", "enum", "import", "public", "private", "protected", "case", "default", "static"))
_OPEN = {"(": ")", "[": "]", "{": "}"}


class JavaParser(ListParser):
    def parse(self) -> None:
        self.load(self.lex())
        self.pair()
        first = True
        imports_over = False
        while self.kind != "$":
            start = self.i
            try:
                if self.eat(";"):
                    continue
                if self.isp("import"):
                    if imports_over:
                        raise self.wrong("a type declaration")
                    self.import_()
                elif first and self.package_ahead():
                    self.annotations()
                    self.need("package")
                    self.qualified()
                    self.need(";")
                elif first and self.module_ahead():
                    self.module()
                else:
                    imports_over = True
                    self.type_declaration(self.modifiers())
                first = False
            except Fault as fault:
                self.recover(fault, _STOP, start)
                first = False
                if self.isp("}"):
                    self.advance()

    def lex(self) -> list[tuple[str, str, int]]:
        text, size = self.text, len(self.text)
        toks: list[tuple[str, str, int]] = []
        pos = 0
        match, plain = _TOKEN.match, _PLAIN.match
        while pos < size:
            m = plain(text, pos)
            if m:
                value = m.group(1)
                toks.append(("k" if value in _KEYWORDS else "n", value, m.start(1)) if value else ("p", m.group(2), m.end() - 1))
                pos = m.end()
                continue
            m = match(text, pos)
            if not m:
                if text[pos] == "\x1a" and pos == size - 1:
                    break
                end = text.find("\n", pos)
                what = {"'": "character", '"': "string", "/": "comment"}.get(text[pos], "token")
                self.note(Fault(pos, f"{what} without end or with a wrong part"))
                toks.append(("s" if text[pos] in "'\"" else "?", text[pos], pos))
                pos = size if text.startswith(("/*", '"""'), pos) or end < 0 else end
                continue
            kind, value = m.lastgroup, m.group()
            if kind == "n":
                toks.append(("k" if value in _KEYWORDS else "n", value, pos))
            elif kind != "w":
                if kind == "d":
                    nxt = text[m.end() : m.end() + 1]
                    if nxt.isalnum() or nxt == "_" or value.lower() in ("0x", "0xl") or value[-1:] not in "fFdD" and len(value) > 1 and value[0] == "0" and re.fullmatch(r"0[0-9_]*[89][0-9_]*[lL]?", value):
                        self.note(Fault(pos, "wrong number"))
                toks.append((kind, value, pos))
            pos = m.end()
        toks.append(("$", "", size))
        return toks

    def pair(self) -> None:
        """For each opening parenthesis the index of its closing one."""
        self.closes: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, v, _) in enumerate(self.toks):
            if k == "p":
                if v == "(":
                    stack.append(i)
                elif v == ")" and stack:
                    self.closes[stack.pop()] = i

    def isc(self, word: str) -> bool:
        return self.kind == "n" and self.value == word

    def attempt(self, f) -> bool:
        i, faults = self.i, len(self.faults)
        try:
            if f() is not False:
                return True
        except Fault:
            pass
        del self.faults[faults:]
        self.seek(i)
        return False

    def looks(self, f) -> bool:
        i, faults = self.i, len(self.faults)
        try:
            return f() is not False
        except Fault:
            return False
        finally:
            del self.faults[faults:]
            self.seek(i)

    def qualified(self) -> None:
        self.name()
        while self.isp(".") and self.ahead()[0] == "n":
            self.advance()
            self.advance()

    # -- declarations

    def package_ahead(self) -> bool:
        def see() -> bool:
            self.annotations()
            return self.isp("package")

        return self.looks(see)

    def module_ahead(self) -> bool:
        def see() -> bool:
            self.annotations()
            if self.isc("open"):
                self.advance()
            return self.isc("module") and self.ahead()[0] == "n"

        return self.looks(see)

    def module(self) -> None:
        self.annotations()
        if self.isc("open"):
            self.advance()
        self.advance()
        self.qualified()
        self.need("{")
        while not self.eat("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            while self.kind != "$" and not self.isp(";"):
                if self.isp("{") or self.isp("}"):
                    raise self.wrong("';'")
                self.advance()
            self.need(";")

    def import_(self) -> None:
        self.need("import")
        self.eat("static")
        self.name()
        while self.eat("."):
            if self.eat("*"):
                break
            self.name()
        self.need(";")

    def annotations(self) -> None:
        while self.isp("@") and self.ahead()[1] != "interface":
            self.annotation()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.eat("("):
            while not self.eat(")"):
                if self.kind == "n" and self.ahead()[1] == "=" and self.ahead()[0] == "p":
                    self.advance()
                    self.advance()
                self.element_value()
                if not self.isp(")"):
                    self.need(",")
                    if self.isp(")"):
                        raise self.wrong("a value")

    def element_value(self) -> None:
        if self.isp("@"):
            self.annotation()
        elif self.eat("{"):
            while not self.eat("}"):
                self.element_value()
                if not self.isp("}"):
                    self.need(",")
        else:
            self.ternary()

    def modifiers(self) -> set[str]:
        found: set[str] = set()
        while True:
            if self.isp("@") and self.ahead()[1] != "interface":
                self.annotation()
                continue
            v = self.value
            if self.kind == "k" and v in _MODIFIERS:
                if v == "default" and self.ahead()[1] in (":", "->"):
                    return found
                if v == "synchronized" and self.ahead()[1] == "(":
                    return found
            elif self.kind == "n" and v == "sealed" and (self.ahead()[0] == "k" or self.ahead()[0] == "n"):
                pass
            elif self.kind == "n" and v == "non" and self.ahead()[1] == "-" and self.ahead(2)[1] == "sealed":
                self.advance()
                self.advance()
            else:
                return found
            if v in found:
                raise self.fail(f"{v} is repeated")
            found.add(v)
            self.advance()

    def type_ahead(self) -> bool:
        """Whether a type declaration begins here, after modifiers."""
        if self.kind == "k":
            return self.value in ("class", "interface", "enum")
        if self.isp("@"):
            return self.ahead()[1] == "interface"
        return self.isc("record") and self.ahead()[0] == "n" and self.ahead(2)[1] in ("(", "<")

    def type_declaration(self, mods: set[str]) -> None:
        if self.eat("class"):
            owner = self.type_identifier()
            self.type_parameters()
            if self.eat("extends"):
                self.class_type()
            if self.eat("implements"):
                self.types()
            self.permits()
            self.class_body(owner)
        elif self.eat("interface"):
            owner = self.type_identifier()
            self.type_parameters()
            if self.eat("extends"):
                self.types()
            self.permits()
            self.class_body("", interface=True)
        elif self.eat("enum"):
            owner = self.type_identifier()
            if self.eat("implements"):
                self.types()
            self.enum_body(owner)
        elif self.isp("@") and self.ahead()[1] == "interface":
            self.advance()
            self.advance()
            self.type_identifier()
            self.class_body("", interface=True)
        elif self.isc("record") and self.ahead()[0] == "n":
            self.advance()
            owner = self.type_identifier()
            self.type_parameters()
            self.parameters(record=True)
            if self.eat("implements"):
                self.types()
            self.class_body(owner, record=True)
        else:
            raise self.wrong("a type declaration")

    def type_identifier(self) -> str:
        if self.kind == "n" and self.value in ("record", "sealed", "permits", "var", "yield"):
            raise self.wrong("a type's name")
        return self.name()

    def permits(self) -> None:
        if self.isc("permits"):
            self.advance()
            self.types()

    def types(self) -> None:
        while True:
            self.annotations()
            self.class_type()
            if not self.eat(","):
                return

    def class_body(self, owner: str, interface: bool = False, record: bool = False) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.guarded(lambda: self.member(owner, interface, record))

    def guarded(self, f) -> None:
        start = self.i
        try:
            f()
        except Fault as fault:
            if self.kind == "$":
                raise
            self.recover(fault, frozenset(), start)

    def enum_body(self, owner: str) -> None:
        self.need("{")
        while not (self.isp(";") or self.isp("}")):
            self.annotations()
            self.name()
            if self.isp("("):
                self.arguments()
            if self.isp("{"):
                self.class_body("")
            if not self.eat(","):
                break
        if self.eat(";"):
            while not self.isp("}"):
                if self.kind == "$":
                    raise self.wrong("'}'")
                self.guarded(lambda: self.member(owner, False, False))
        self.need("}")

    def member(self, owner: str, interface: bool, record: bool) -> None:
        if self.eat(";"):
            return
        if self.isp("{") or self.isp("static") and self.ahead()[1] == "{":
            if interface:
                raise self.wrong("a member")
            self.eat("static")
            return self.block()
        mods = self.modifiers()
        if self.type_ahead():
            return self.type_declaration(mods)
        self.type_parameters()
        self.annotations()
        if self.kind == "n" and self.ahead()[1] == "(" and self.ahead()[0] == "p":
            if self.value != owner:
                raise self.fail("a method needs a return type")
            self.advance()
            self.parameters()
            self.throws()
            return self.block()
        if record and self.kind == "n" and self.value == owner and self.ahead()[1] == "{":
            self.advance()
            return self.block()
        if self.isp("void"):
            self.advance()
            method = True
        else:
            self.type_()
            method = self.ahead()[1] == "(" and self.ahead()[0] == "p"
        self.name()
        if method or self.isp("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.element_value()
            if self.isp("{"):
                return self.block()
            return self.need(";")
        self.declarators(named=True)
        return self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.types()

    def dims(self) -> None:
        while True:
            i = self.i
            self.annotations()
            if self.isp("[") and self.ahead()[1] == "]":
                self.advance()
                self.advance()
            else:
                self.seek(i)
                return

    def declarators(self, named: bool = False) -> None:
        while True:
            if not named:
                self.name()
            named = False
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return

    def initializer(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.initializer()
                if not self.isp("}"):
                    self.need(",")
        else:
            self.expression()

    def parameters(self, record: bool = False) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type_()
            self.annotations()
            varied = self.eat("...")
            if self.eat("this"):
                pass
            else:
                self.name()
                if self.isp(".") and not record:  # receiver of an inner class
                    self.advance()
                    self.need("this")
                self.dims()
            if not self.isp(")"):
                if varied:
                    raise self.wrong("')'")
                self.need(",")
                if self.isp(")"):
                    raise self.wrong("a parameter")

    # -- types

    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        while True:
            self.annotations()
            self.type_identifier()
            if self.eat("extends"):
                self.class_type()
                while self.eat("&"):
                    self.class_type()
            if not self.eat(","):
                break
        self.need(">")

    def type_(self) -> None:
        self.annotations()
        if self.kind == "k" and self.value in _PRIMITIVE:
            self.advance()
        else:
            self.class_type()
        self.dims()

    def class_type(self, diamond: bool = False) -> None:
        self.annotations()
        self.name()
        if self.isp("<"):
            self.type_arguments(diamond)
        while self.isp(".") and self.ahead()[0] in "n" or self.isp(".") and self.ahead()[1] == "@":
            self.advance()
            self.annotations()
            self.name()
            if self.isp("<"):
                self.type_arguments(diamond)

    def type_arguments(self, diamond: bool = False) -> None:
        self.need("<")
        if diamond and self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type_()
            else:
                self.type_()
            if not self.eat(","):
                break
        self.need(">")

    # -- statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.guarded(self.block_statement)

    def local_ahead(self) -> bool:
        """Whether a local variable is declared here."""

        def see() -> bool:
            self.type_()
            if self.kind != "n":
                return False
            return self.ahead()[1] in ("=", ";", ",", ":", "[") or self.ahead()[0] in "nk$" or self.ahead()[1] in ("}", ")")

        return self.looks(see)

    def block_statement(self) -> None:
        i = self.i
        if self.isp("@") or self.kind == "k" and self.value in ("final", "abstract", "static", "strictfp", "class", "interface", "enum") or self.type_ahead() or self.isc("sealed") and self.ahead()[0] in "kn" or self.isc("non") and self.ahead()[1] == "-" and self.ahead(2)[1] == "sealed":
            mods = self.modifiers()
            if self.type_ahead():
                return self.type_declaration(mods)
            if self.i != i:
                self.type_()
                self.declarators()
                return self.need(";")
        if (self.kind == "k" and self.value in _PRIMITIVE and self.ahead()[1] not in (".", "::") or self.kind == "n" and not self.yield_ahead()) and self.local_ahead():
            self.type_()
            self.declarators()
            return self.need(";")
        return self.statement()

    def yield_ahead(self) -> bool:
        if not self.isc("yield"):
            return False
        k, v, _ = self.ahead()
        return k in "nds" or k == "k" or v in ("(", "!", "~", "+", "-") or v in ("++", "--") and self.ahead(2)[1] != ";"

    def statement(self) -> None:
        k, v = self.kind, self.value
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
        elif k == "k":
            handler = getattr(self, f"do_{v}", None)
            if handler:
                return handler()
        elif k == "n":
            if self.ahead()[1] == ":" and self.ahead()[0] == "p":
                self.advance()
                self.advance()
                return self.statement()
            if self.yield_ahead():
                self.advance()
                self.expression()
                return self.need(";")
        at = self.at
        if self.expression() not in ("assign", "update", "call", "new"):
            raise Fault(at, "not a statement")
        return self.need(";")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def do_if(self) -> None:
        self.advance()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def do_while(self) -> None:
        self.advance()
        self.paren()
        self.statement()

    def do_do(self) -> None:
        self.advance()
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def do_for(self) -> None:
        self.advance()
        self.need("(")
        i = self.i
        self.modifiers()
        if self.i != i or self.kind in "kn" and self.local_ahead():
            self.type_()
            j = self.i
            self.name()
            self.dims()
            if self.eat(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.seek(j)
            self.declarators()
        elif not self.isp(";"):
            self.statement_expressions()
        self.need(";")
        if not self.isp(";"):
            self.expression()
        self.need(";")
        if not self.isp(")"):
            self.statement_expressions()
        self.need(")")
        return self.statement()

    def statement_expressions(self) -> None:
        while True:
            at = self.at
            if self.expression() not in ("assign", "update", "call", "new"):
                raise Fault(at, "not a statement")
            if not self.eat(","):
                return

    def do_switch(self) -> None:
        kind = self.suffixes(self.switch())
        if kind not in ("switch", "call"):
            raise self.fail("not a statement")
        if kind == "call":
            self.need(";")

    def do_try(self) -> None:
        self.advance()
        handled = False
        if self.eat("("):
            handled = True
            if self.isp(")"):
                raise self.wrong("a resource")
            while not self.eat(")"):
                i = self.i
                self.modifiers()
                if self.i != i or self.local_ahead():
                    self.type_()
                    self.name()
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.isp(")"):
                    self.need(";")
        self.block()
        while self.eat("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.class_type()
            while self.eat("|"):
                self.class_type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            raise self.wrong("'catch' or 'finally'")

    def do_return(self) -> None:
        self.advance()
        if not self.isp(";"):
            self.expression()
        self.need(";")

    def do_throw(self) -> None:
        self.advance()
        self.expression()
        self.need(";")

    def do_break(self) -> None:
        self.advance()
        if self.kind == "n":
            self.advance()
        self.need(";")

    do_continue = do_break

    def do_assert(self) -> None:
        self.advance()
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def do_synchronized(self) -> None:
        self.advance()
        self.paren()
        self.block()

    def switch(self) -> str:
        self.need("switch")
        self.paren()
        self.need("{")
        style = ""
        while not self.eat("}"):
            if self.eat("default"):
                pass
            elif self.eat("case"):
                while True:
                    if not self.eat("default"):
                        self.case_label()
                    if not self.eat(","):
                        break
                if self.isc("when"):
                    self.advance()
                    self.ternary()
            else:
                raise self.wrong("'case'")
            arrow = self.value
            if self.kind != "p" or arrow not in (":", "->") or style and style != arrow:
                raise self.wrong("':' or '->'" if not style else repr(style))
            style = arrow
            self.advance()
            if arrow == "->":
                if self.isp("{"):
                    self.block()
                elif self.isp("throw"):
                    self.do_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                while not (self.isp("case") or self.isp("default") or self.isp("}")):
                    if self.kind == "$":
                        raise self.wrong("'}'")
                    self.guarded(self.block_statement)
        return "switch"

    def case_label(self) -> None:
        if self.pattern_ahead():
            self.pattern()
        else:
            self.ternary()

    def pattern_ahead(self) -> bool:
        def see() -> bool:
            self.modifiers()
            self.type_()
            return self.kind == "n" and not self.isc("when") or self.isp("(") or self.isc("when") and self.ahead()[1] in (",", ":", "->", ")", "&&")

        return self.isp("final") or self.isp("@") or self.kind in "nk" and self.looks(see)

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.eat("("):
            while not self.eat(")"):
                self.pattern()
                if not self.isp(")"):
                    self.need(",")
            return
        self.name()

    # -- expressions

    def operator(self) -> tuple[str, int]:
        """The operator here and how many tokens it has; signs beginning with > come one by one."""
        if self.kind == "k":
            return (self.value, 1) if self.value == "instanceof" else ("", 0)
        if self.kind != "p":
            return "", 0
        v = self.value
        if v != ">":
            return v, 1
        n = 1
        while n < 4 and self.ahead(n)[0] == "p" and self.ahead(n)[2] == self.at + n and self.ahead(n)[1] in (">", "=", "==") and not v.endswith("="):
            if self.ahead(n)[1] == "==":
                break
            v += self.ahead(n)[1]
            n += 1
        return v, n

    def expression(self) -> str:
        if self.lambda_ahead():
            self.lambda_()
            return "lambda"
        at = self.at
        kind = self.ternary()
        op, n = self.operator()
        if op in _ASSIGN:
            if kind not in ("name", "field", "index"):
                raise Fault(at, "can't be assigned")
            for _ in range(n):
                self.advance()
            self.expression()
            return "assign"
        return kind

    def lambda_ahead(self) -> bool:
        if self.kind == "n":
            return self.ahead()[1] == "->" and self.ahead()[0] == "p"
        if self.isp("("):
            end = self.closes.get(self.i)
            return end is not None and end + 1 < len(self.toks) and self.toks[end + 1][1] == "->" and self.toks[end + 1][0] == "p"
        return False

    def lambda_(self) -> None:
        if self.eat("("):
            if not self.eat(")"):
                if self.kind == "n" and self.ahead()[1] in (",", ")"):
                    self.name()
                    while self.eat(","):
                        self.name()
                    self.need(")")
                else:
                    self.seek(self.i - 1)
                    self.parameters()
        else:
            self.name()
        self.need("->")
        if self.isp("{"):
            self.block()
        else:
            self.expression()

    def ternary(self) -> str:
        kind = self.binary(0)
        if self.eat("?"):
            self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.ternary()
            return "ternary"
        return kind

    def binary(self, least: int) -> str:
        """Precedence climbing."""
        kind = self.unary()
        while True:
            op, n = self.operator()
            power = _BINARY.get(op, 0)
            if power <= least:
                return kind
            for _ in range(n):
                self.advance()
            if op == "instanceof":
                if self.pattern_ahead():
                    self.pattern()
                else:
                    self.type_()
            else:
                self.binary(power)
            kind = "binary"

    def unary(self) -> str:
        if self.kind == "p":
            v = self.value
            if v in ("++", "--"):
                self.advance()
                at = self.at
                if self.unary() not in ("name", "field", "index"):
                    raise Fault(at, "can't be changed")
                return "update"
            if v in ("+", "-", "!", "~"):
                self.advance()
                self.unary()
                return "unary"
            if v == "(" and self.cast():
                return "cast"
        at = self.at
        kind = self.suffixes(self.primary())
        while self.kind == "p" and self.value in ("++", "--"):
            if kind not in ("name", "field", "index"):
                raise Fault(at, "can't be changed")
            self.advance()
            kind = "update"
        return kind

    def cast(self) -> bool:
        end = self.closes.get(self.i)
        if end is None:
            return False
        k, v, _ = self.toks[end + 1]
        start = self.i
        primitive = self.ahead()[1] in _PRIMITIVE
        follows = k in "nds" or k == "p" and v in ("(", "!", "~") or k == "k" and v not in ("instanceof", "else") or primitive and v in ("+", "-", "++", "--")
        if not follows:
            return False

        def see() -> bool:
            self.advance()
            self.type_()
            while self.eat("&"):
                self.type_()
            return self.i == end

        if not self.attempt(see):
            self.seek(start)
            return False
        self.advance()
        if self.lambda_ahead():
            self.lambda_()
        else:
            self.unary()
        return True

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.expression()
            if not self.isp(")"):
                self.need(",")
                if self.isp(")"):
                    raise self.wrong("an argument")

    def primary(self) -> str:
        k, v = self.kind, self.value
        if k == "n":
            if self.ahead()[1] == "<" and self.attempt(self.generic_reference):
                return "reference"
            if self.ahead()[1] == "[" and self.ahead(2)[1] == "]":
                self.type_()
                if self.eat("."):
                    self.need("class")
                    return "value"
                return self.reference()
            self.advance()
            if self.isp("("):
                self.arguments()
                return "call"
            return "name"
        if k in "ds" and k:
            self.advance()
            return "value"
        if k == "k":
            if v in ("true", "false", "null"):
                self.advance()
                return "value"
            if v == "this":
                self.advance()
                if self.isp("("):
                    self.arguments()
                    return "call"
                return "value"
            if v == "super":
                self.advance()
                if self.isp("("):
                    self.arguments()
                    return "call"
                if not (self.isp(".") or self.isp("::")):
                    raise self.wrong("'.'")
                return "super"
            if v == "new":
                return self.new()
            if v == "switch":
                return self.switch()
            if v in _PRIMITIVE:
                self.type_()
                if self.eat("."):
                    self.need("class")
                    return "value"
                return self.reference()
            if v == "void":
                self.advance()
                self.need(".")
                self.need("class")
                return "value"
        if k == "p":
            if v == "(":
                self.advance()
                kind = self.expression()
                self.need(")")
                return kind if kind in ("name", "field", "index") else "paren"
            if v == "@":
                self.type_()
                return self.reference()
        raise self.wrong("an expression")

    def reference(self) -> str:
        self.need("::")
        if self.isp("<"):
            self.type_arguments()
        if not self.eat("new"):
            self.name()
        return "reference"

    def generic_reference(self) -> bool:
        self.type_()
        if not self.isp("::"):
            return False
        self.reference()
        return True

    def suffixes(self, kind: str) -> str:
        while self.kind == "p":
            v = self.value
            if v == ".":
                self.advance()
                if self.isp("<"):
                    self.type_arguments()
                    if self.eat("super"):
                        self.arguments()
                    else:
                        self.name()
                        self.arguments()
                    kind = "call"
                elif self.isp("new"):
                    kind = self.new()
                elif self.eat("class") or self.eat("this"):
                    kind = "value"
                elif self.eat("super"):
                    if self.isp("("):
                        self.arguments()
                        kind = "call"
                    else:
                        kind = "super"
                else:
                    if self.kind == "n" and self.ahead()[1] == "<" and kind in ("name", "field") and self.attempt(self.generic_reference):
                        kind = "reference"
                        continue
                    self.name()
                    if self.isp("("):
                        self.arguments()
                        kind = "call"
                    elif self.isp("[") and self.ahead()[1] == "]":
                        self.dims()
                        if self.eat("."):
                            self.need("class")
                            kind = "value"
                        else:
                            kind = self.reference()
                    else:
                        kind = "field"
            elif v == "[":
                if kind == "array":
                    return kind
                self.advance()
                self.expression()
                self.need("]")
                kind = "index"
            elif v == "::":
                kind = self.reference()
            else:
                return kind
        return kind

    def new(self) -> str:
        self.need("new")
        self.annotations()
        if self.isp("<"):
            self.type_arguments()
        if self.kind == "k" and self.value in _PRIMITIVE:
            self.advance()
            primitive = True
        else:
            self.class_type(diamond=True)
            primitive = False
        self.annotations()
        if self.isp("["):
            sized = empty = False
            while self.isp("["):
                self.advance()
                if self.eat("]"):
                    empty = True
                else:
                    if empty:
                        raise self.wrong("']'")
                    self.expression()
                    self.need("]")
                    sized = True
                self.annotations()
            if self.isp("{"):
                if sized:
                    raise self.wrong("';'")
                self.initializer()
            elif not sized:
                raise self.wrong("an array's size")
            return "array"
        if primitive or not self.isp("("):
            raise self.wrong("'(' or '['")
        self.arguments()
        if self.isp("{"):
            self.class_body("")
        return "new"
