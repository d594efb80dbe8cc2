"""JavaScript (ES2022 modules, JSX on demand) and TypeScript 5 (TSX on demand).

The lexer is driven by the parser, one token at a time, because what a slash, a brace or an angle bracket means
depends on where the parser stands.  The whole state is an offset, so trying a reading and going back is cheap.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from sievework.llm.syntax.base import Fault, Parser

_SKIP = re.compile(r"(?:[\s\ufeff\u200b]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_ESC = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_NAME = rf"(?:[^\W\d]|\$|{_ESC})(?:[\w$\u200c\u200d]|{_ESC})*"
_TOKEN = re.compile(
    rf"""(?P<n>{_NAME})
    |(?P<h>\#(?:{_NAME}))
    |(?P<d>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?
        |(?:0|[1-9](?:_?[0-9])*)(?:n|(?:\.(?:[0-9](?:_?[0-9])*)?)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?)
        |\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?)
    |(?P<s>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*
        |[{{}}()\[\];,<>+\-*/%&|^!~?:=.@`])""",
    re.X,
)
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?!(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]{1,6}\}))|[1-9]|0(?=[0-9]))")
_PAIRED = re.compile(r"\\[\s\S]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/([\w$]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_NAME = re.compile(r"[^\W\d][\w$\-]*|\$[\w$\-]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")

# Words (fixed values of the language).
_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_STRICT = frozenset("implements interface let package private protected public static yield".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected static abstract override readonly declare async accessor in out const".split())
_STARTS = frozenset("var let const function class if for while do switch try throw return break continue import export interface type enum async namespace".split())


class ScriptParser(Parser):
    def __init__(self, text: str, *, ts: bool = False, jsx: bool = False, ambient: bool = False):
        super().__init__(text)
        self.ts, self.jsx, self.ambient = ts, jsx, ambient
        self.pos = self.last = 0
        # What is open around the current place.
        self.in_function = self.in_async = self.in_generator = False
        self.loops = self.switches = 0
        self.labels: list[str] = []
        self.cover = -1  # offset of a shorthand initialiser that only a pattern may have
        self.no_conditional = False

    # -- tokens

    def scan(self) -> None:
        """Read the token at ``pos``."""
        text, begin = self.text, self.pos
        # Mostly there is nothing to skip, or one blank.
        c = text[begin : begin + 1]
        at = begin + 1 if c == " " else begin
        if c == " ":
            c = text[at : at + 1]
        if "!" <= c <= "~" and c != "/":
            self.at, self.nl = at, False
        else:
            self.at = _SKIP.match(text, begin).end()
            self.nl = self.at > begin and ("\n" in text[begin : self.at] or "\r" in text[begin : self.at] or "\u2028" in text[begin : self.at])
        if self.at >= len(text):
            self.kind, self.value, self.pos = "$", "", len(text)
            return
        m = _TOKEN.match(text, self.at)
        if not m:
            self.kind, self.value, self.pos = "?", text[self.at], self.at + 1
            return
        self.kind, self.value, self.pos = m.lastgroup, m.group(), m.end()
        if self.kind == "d" and self.pos < len(text) and (text[self.pos].isalnum() or text[self.pos] in "_$\\"):
            self.kind = "?"
        elif self.kind == "s" and "\\" in self.value and self._bad_escape(self.value):
            self.kind = "?"

    @staticmethod
    def _bad_escape(value: str) -> bool:
        return any(_BAD_ESCAPE.match(value, m.start()) for m in _PAIRED.finditer(value))

    def advance(self) -> None:
        self.last = self.pos
        self.scan()

    def mark(self) -> tuple:
        return self.pos, self.last, self.kind, self.value, self.at, self.nl, self.cover

    def back(self, m: tuple) -> None:
        self.pos, self.last, self.kind, self.value, self.at, self.nl, self.cover = m

    def attempt(self, f: Callable[[], object]) -> bool:
        """Try a reading; on failure stand where it began."""
        m, faults = self.mark(), len(self.faults)
        try:
            f()
            return len(self.faults) == faults or self._undo(m, faults)
        except Fault:
            return self._undo(m, faults)

    def _undo(self, m: tuple, faults: int) -> bool:
        del self.faults[faults:]
        self.back(m)
        return False

    def looks(self, f: Callable[[], object]) -> bool:
        m, faults = self.mark(), len(self.faults)
        try:
            return bool(f())
        except Fault:
            return False
        finally:
            self._undo(m, faults)

    def wrong(self, wanted: str = "") -> Fault:
        seen = "end of file" if self.kind == "$" else repr(self.value[:40])
        return Fault(self.at, f"unexpected {seen}" + (f", expected {wanted}" if wanted else ""))

    def isp(self, v: str) -> bool:
        return self.kind == "p" and self.value == v

    def isn(self, v: str) -> bool:
        return self.kind == "n" and self.value == v

    def eat(self, v: str) -> bool:
        if self.kind == "p" and self.value == v:
            self.advance()
            return True
        return False

    def eatn(self, v: str) -> bool:
        if self.kind == "n" and self.value == v:
            self.advance()
            return True
        return False

    def need(self, v: str) -> None:
        if self.kind in "pn" and self.value == v:
            self.advance()
        else:
            raise self.wrong(repr(v))

    def closing(self) -> None:
        """Consume one ``>`` of whatever token begins with it."""
        if self.kind == "p" and self.value[0] == ">":
            self.pos = self.last = self.at + 1
            self.scan()
        else:
            raise self.wrong("'>'")

    def semicolon(self) -> None:
        if self.eat(";"):
            return
        if self.kind == "$" or self.nl or self.isp("}"):
            return
        raise self.wrong("';'")

    def ident(self, what: str = "a name") -> str:
        """A binding or reference name."""
        if self.kind != "n" or not self.is_name():
            raise self.wrong(what)
        v = self.value
        self.advance()
        return v

    def is_name(self) -> bool:
        v = self.value
        if self.kind != "n" or v in _RESERVED:
            return False
        if v == "await":
            return self.ts and not self.in_async and self.in_function
        return self.ts or v not in _STRICT

    def any_name(self) -> str:
        if self.kind != "n":
            raise self.wrong("a name")
        v = self.value
        self.advance()
        return v

    # -- statements

    def parse(self) -> None:
        if self.text.startswith("#!"):
            self.pos = self.text.find("\n") if "\n" in self.text else len(self.text)
        self.scan()
        while self.kind != "$":
            self.guarded(lambda: self.statement(top=True))
            if self.isp("}"):
                self.note(self.wrong())
                self.advance()

    def guarded(self, f: Callable[[], object]) -> None:
        """One statement in panic mode: a fault is noted and the rest of the statement skipped."""
        start = self.at
        state = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, len(self.labels))
        try:
            f()
        except Fault as fault:
            self.note(fault)
            self.in_function, self.in_async, self.in_generator, self.loops, self.switches, n = state
            del self.labels[n:]
            self.no_conditional = False
            if self.at == start and self.kind != "$":
                self.advance()
            while self.kind != "$" and not self.isp("}") and not self.isp(";"):
                if self.nl and (self.kind == "n" and self.value in _STARTS):
                    return
                self.advance()
            self.eat(";")

    def block(self) -> None:
        self.need("{")
        while not self.isp("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.guarded(self.statement)
        self.advance()

    def statement(self, top: bool = False, single: bool = False) -> None:
        k, v = self.kind, self.value
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
            if v == "@":
                self.decorators()
                if self.isn("export"):
                    return self.export()
                if self.eatn("abstract"):
                    pass
                if not self.isn("class"):
                    raise self.wrong("a class")
                return self.class_(True)
            return self.expression_statement()
        if k != "n":
            return self.expression_statement()
        handler = getattr(self, f"do_{v}", None)
        if handler and v in _RESERVED:
            if single and v in ("class", "const", "import", "export"):
                raise self.wrong("a statement")
            if v in ("import", "export"):
                if v == "import" and self.looks(lambda: (self.advance(), self.isp("(") or self.isp("."))[-1]):
                    return self.expression_statement()
                if not top:
                    raise Fault(self.at, f"{v} in a nested place")
            return handler()
        if v == "let" and self.looks(self._let_ahead):
            if single:
                raise self.wrong("a statement")
            self.advance()
            return self.declarations()
        if v == "async" and self.looks(lambda: (self.advance(), not self.nl and self.isn("function"))[-1]):
            self.advance()
            return self.function(True, is_async=True)
        if self.ts and v in ("using", "await") and self.looks(self._using_ahead):
            self.eatn("await")
            self.advance()
            return self.declarations(const=True)
        if self.ts and self.ts_statement(top):
            return None
        m = self.mark()
        if self.is_name():
            self.advance()
            if self.eat(":"):
                self.labels.append(v)
                try:
                    if self.isn("function"):
                        return self.function(True)
                    return self.statement(single=True)
                finally:
                    self.labels.pop()
            self.back(m)
        return self.expression_statement()

    def _let_ahead(self) -> bool:
        self.advance()
        return self.isp("[") or self.isp("{") or (self.kind == "n" and self.value not in ("in", "instanceof", "of"))

    def _using_ahead(self) -> bool:
        self.eatn("await")
        if not self.eatn("using") or self.nl or not self.is_name() or self.value in ("in", "of", "instanceof"):
            return False
        self.advance()
        return self.isp("=") or self.isp(":")

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def do_var(self) -> None:
        self.advance()
        self.declarations()

    def do_const(self) -> None:
        self.advance()
        if self.ts and self.isn("enum"):
            return self.enum()
        self.declarations(const=True)
        return None

    def declarations(self, const: bool = False, semi: bool = True, in_for: bool = False) -> int:
        """Declarators; returns how many, for heads of loops."""
        count = 0
        init = False
        while True:
            pattern = self.isp("[") or self.isp("{")
            self.binding()
            if self.ts:
                if self.isp("!"):
                    self.advance()
                self.annotation()
            count += 1
            if self.eat("="):
                self.assignment(no_in=in_for)
                init = True
            elif in_for and (self.isn("of") or self.isn("in")):
                return count
            elif (const or pattern) and not self.ambient:
                raise self.wrong("an initialiser")
            if not self.eat(","):
                break
        if in_for:
            return -1 if init or count != 1 else 0
        if semi:
            self.semicolon()
        return count

    def binding(self) -> None:
        """A name or pattern that is bound."""
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.assignment()
                if not self.isp("]"):
                    if rest:
                        raise self.wrong("']'")
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.ident()
                    if not self.isp("}"):
                        raise self.wrong("'}'")
                    continue
                simple = self.kind == "n"
                ok = self.is_name()
                at = self.mark()
                self.property_key()
                if self.eat(":"):
                    self.binding()
                elif not (simple and ok):
                    self.back(at)
                    raise self.wrong("a name")
                if self.eat("="):
                    self.assignment()
                if not self.isp("}"):
                    self.need(",")
        else:
            self.ident()

    def do_function(self) -> None:
        self.function(True)

    def function(self, named: bool, *, is_async: bool = False, optional_name: bool = False) -> None:
        self.need("function")
        generator = self.eat("*")
        if self.isp("("):
            if named and not optional_name:
                raise self.wrong("a name")
        else:
            self.ident()
        self.function_rest(is_async=is_async, generator=generator, bodiless=self.ts and named)

    def function_rest(self, *, is_async: bool = False, generator: bool = False, bodiless: bool = False, method: bool = False) -> None:
        state = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_conditional)
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_conditional = True, is_async, generator, 0, 0, [], False
        try:
            if self.ts:
                self.type_parameters()
            self.parameters()
            if self.ts and self.eat(":"):
                self.return_type()
            if bodiless and not self.isp("{"):
                return self.semicolon()
            return self.block()
        finally:
            self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_conditional = state

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.isp("@"):
                self.decorators()
            if self.ts:
                while self.kind == "n" and self.value in ("public", "private", "protected", "readonly", "override") and self.looks(lambda: (self.advance(), self.kind == "n" or self.isp("{") or self.isp("["))[-1]):
                    self.advance()
            rest = self.eat("...")
            if self.ts and self.isn("this"):
                self.advance()
            else:
                self.binding()
            if self.ts:
                self.eat("?")
                self.annotation()
            if self.isp("="):
                if rest:
                    raise self.wrong("')'")
                self.advance()
                self.assignment()
            if not self.isp(")"):
                if rest:
                    raise self.wrong("')'")
                self.need(",")

    def do_class(self) -> None:
        self.class_(True)

    def class_(self, named: bool, optional_name: bool = False) -> None:
        self.need("class")
        if self.kind == "n" and self.value not in ("extends", "implements") or self.isn("implements") and self.ts and self.looks(lambda: (self.advance(), self.isp("{"))[-1]):
            self.ident()
        elif named and not optional_name:
            raise self.wrong("a name")
        if self.ts:
            self.type_parameters()
        if self.eatn("extends"):
            self.left_hand()
            if self.ts and (self.isp("<") or self.isp("<<")):
                self.type_arguments()
        if self.ts and self.eatn("implements"):
            self.type_reference_list()
        self.need("{")
        while not self.eat("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.isp("@"):
            self.decorators()
        is_async = generator = abstract = ambient = False
        while self.kind == "n" and self.value in _MODIFIERS and (self.ts or self.value in ("static", "async", "accessor")):
            v = self.value
            nxt = self.looks(lambda: (self.advance(), (self.kind in "nhds" or self.kind == "p" and self.value in "[*{") and not (v in ("async", "accessor", "abstract", "declare") and self.nl))[-1])
            if not nxt:
                break
            self.advance()
            if v == "static" and self.isp("{"):
                state = (self.in_function, self.in_async, self.loops, self.switches)
                self.in_function, self.in_async, self.loops, self.switches = False, False, 0, 0
                self.block()
                self.in_function, self.in_async, self.loops, self.switches = state
                return
            is_async |= v == "async"
            abstract |= v == "abstract"
            ambient |= v == "declare"
        generator = self.eat("*")
        accessor = False
        if not generator and self.kind == "n" and self.value in ("get", "set") and self.looks(lambda: (self.advance(), self.kind in "nhds" or self.isp("["))[-1]):
            self.advance()
            accessor = True
        if self.ts and self.isp("[") and self.index_signature():
            self.semicolon()
            return
        self.property_key(private=True)
        if self.ts:
            if not self.eat("?"):
                self.eat("!") if not self.nl else None
        if self.isp("(") or self.ts and self.isp("<"):
            self.function_rest(is_async=is_async, generator=generator, bodiless=self.ts, method=True)
            return
        if accessor or is_async or generator:
            raise self.wrong("'('")
        if self.ts:
            self.annotation()
        if self.eat("="):
            state = (self.in_function, self.in_async)
            self.in_function, self.in_async = True, False
            self.assignment()
            self.in_function, self.in_async = state
        self.semicolon()

    def property_key(self, private: bool = False) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]")
        elif self.kind in "nsd" or (private and self.kind == "h"):
            self.advance()
        else:
            raise self.wrong("a property name")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.isp("("):
                self.advance()
                self.expression()
                self.need(")")
            else:
                self.any_name()
                while self.eat("."):
                    if self.kind == "h":
                        self.advance()
                    else:
                        self.any_name()
                if self.ts and self.isp("<"):
                    self.attempt(self.type_arguments)
                if self.isp("("):
                    self.arguments()

    def do_if(self) -> None:
        self.advance()
        self.paren()
        self.sub()
        if self.eatn("else"):
            self.sub()

    def sub(self) -> None:
        """The statement a head governs."""
        if self.isn("function"):
            raise self.wrong("a statement")
        self.statement(single=True)

    def body(self) -> None:
        self.loops += 1
        try:
            self.sub()
        finally:
            self.loops -= 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def do_while(self) -> None:
        self.advance()
        self.paren()
        self.body()

    def do_do(self) -> None:
        self.advance()
        self.body()
        self.need("while")
        self.paren()
        self.eat(";")

    def do_for(self) -> None:
        self.advance()
        waits = False
        if self.isn("await"):
            if self.in_function and not self.in_async:
                raise self.wrong("'('")
            self.advance()
            waits = True
        self.need("(")
        if self.isp(";"):
            pass
        elif self.kind == "n" and (self.value in ("var", "const") or self.value == "let" and self.looks(self._let_ahead)):
            const = self.value == "const"
            self.advance()
            m = self.mark()
            found = self.declarations(const=const, in_for=True)
            if self.isn("of") or self.isn("in"):
                if found < 0:
                    self.back(m)
                    raise self.wrong("one name without initialiser")
                return self.for_each()
        else:
            at = self.at
            self.cover = -1
            if self.isn("async") and self.looks(lambda: (self.advance(), self.isn("of"))[-1]):
                raise self.wrong()
            kind = self.expression(no_in=True, pattern=True)
            if self.isn("of") or self.isn("in"):
                if kind not in ("name", "member", "object", "array"):
                    raise Fault(at, "can't be assigned in a loop")
                self.cover = -1
                return self.for_each()
            self.no_cover()
        if waits:
            raise self.wrong("'of'")
        self.need(";")
        if not self.isp(";"):
            self.expression()
        self.need(";")
        if not self.isp(")"):
            self.expression()
        self.need(")")
        return self.body()

    def for_each(self) -> None:
        of = self.value == "of"
        self.advance()
        if of:
            self.assignment()
        else:
            self.expression()
        self.need(")")
        self.body()

    def do_switch(self) -> None:
        self.advance()
        self.paren()
        self.need("{")
        self.switches += 1
        default = False
        while not self.eat("}"):
            if self.eatn("case"):
                self.expression()
            elif self.isn("default"):
                if default:
                    raise Fault(self.at, "more than one default")
                self.advance()
                default = True
            else:
                raise self.wrong("'case'")
            self.need(":")
            while not (self.isp("}") or self.isn("case") or self.isn("default")):
                if self.kind == "$":
                    raise self.wrong("'}'")
                self.guarded(self.statement)
        self.switches -= 1

    def do_try(self) -> None:
        self.advance()
        self.block()
        handled = False
        if self.eatn("catch"):
            handled = True
            if self.eat("("):
                self.binding()
                if self.ts:
                    self.annotation()
                self.need(")")
            self.block()
        if self.eatn("finally"):
            handled = True
            self.block()
        if not handled:
            raise self.wrong("'catch' or 'finally'")

    def do_throw(self) -> None:
        self.advance()
        if self.nl:
            raise self.wrong("an expression")
        self.expression()
        self.semicolon()

    def do_return(self) -> None:
        if not self.in_function:
            raise Fault(self.at, "return outside a function")
        self.advance()
        if not (self.nl or self.isp(";") or self.isp("}") or self.kind == "$"):
            self.expression()
        self.semicolon()

    def do_break(self) -> None:
        at = self.at
        self.advance()
        if self.kind == "n" and not self.nl and self.is_name():
            if self.value not in self.labels:
                raise Fault(self.at, "no such label")
            self.advance()
        elif not self.loops and not self.switches:
            raise Fault(at, "break outside a loop")
        self.semicolon()

    def do_continue(self) -> None:
        at = self.at
        self.advance()
        if not self.loops:
            raise Fault(at, "continue outside a loop")
        if self.kind == "n" and not self.nl and self.is_name():
            if self.value not in self.labels:
                raise Fault(self.at, "no such label")
            self.advance()
        self.semicolon()

    def do_debugger(self) -> None:
        self.advance()
        self.semicolon()

    def do_with(self) -> None:
        raise Fault(self.at, "with isn't allowed in modules")

    def do_enum(self) -> None:
        if not self.ts:
            raise self.wrong()
        self.enum()

    def do_import(self) -> None:
        self.advance()
        if self.kind == "s":
            self.advance()
        else:
            if self.ts and self.isn("type") and self.looks(lambda: (self.advance(), self.isp("{") or self.isp("*") or self.kind == "n" and (self.value != "from" or self.looks(lambda: (self.advance(), self.isn("from"))[-1])))[-1]):
                self.advance()
            more = True
            if self.kind == "n":
                self.ident()
                if self.ts and self.eat("="):
                    if self.isn("require") and self.looks(lambda: (self.advance(), self.isp("("))[-1]):
                        self.advance()
                        self.need("(")
                        if self.kind != "s":
                            raise self.wrong("a string")
                        self.advance()
                        self.need(")")
                    else:
                        self.entity()
                    return self.semicolon()
                more = self.eat(",")
            if more:
                if self.eat("*"):
                    self.need("as")
                    self.ident()
                else:
                    self.specifiers(importing=True)
            self.need("from")
            if self.kind != "s":
                raise self.wrong("a module name")
            self.advance()
        self.attributes()
        return self.semicolon()

    def attributes(self) -> None:
        if self.ts and (self.isn("with") or self.isn("assert")) and not self.nl:
            self.advance()
            self.object_literal()

    def specifiers(self, importing: bool) -> bool:
        """Returns whether a name is used that can only be exported from elsewhere."""
        self.need("{")
        foreign = False
        while not self.eat("}"):
            if self.ts and self.isn("type") and self.looks(lambda: (self.advance(), self.kind in "ns" and not self.isn("as"))[-1]):
                self.advance()
            plain = self.is_name() or self.isn("default") and not importing
            if self.kind == "s" or not plain:
                foreign = True
            if self.kind not in "ns":
                raise self.wrong("a name")
            was = self.mark()
            self.advance()
            if self.eatn("as"):
                if importing:
                    self.ident()
                elif self.kind in "ns":
                    self.advance()
                else:
                    raise self.wrong("a name")
            elif importing and not plain:
                self.back(was)
                raise self.wrong("a name")
            if not self.isp("}"):
                self.need(",")
        return foreign

    def do_export(self) -> None:
        self.export()

    def export(self) -> None:
        self.need("export")
        if self.ts:
            if self.eat("="):
                self.expression()
                return self.semicolon()
            if self.isn("as") and self.looks(lambda: (self.advance(), self.isn("namespace"))[-1]):
                self.advance()
                self.advance()
                self.ident()
                return self.semicolon()
            if self.isn("import"):
                return self.do_import()
            if self.isn("type") and self.looks(lambda: (self.advance(), self.isp("{") or self.isp("*"))[-1]):
                self.advance()
        if self.eatn("default"):
            if self.isp("@"):
                self.decorators()
            if self.isn("function"):
                return self.function(True, optional_name=True)
            if self.isn("async") and self.looks(lambda: (self.advance(), not self.nl and self.isn("function"))[-1]):
                self.advance()
                return self.function(True, is_async=True, optional_name=True)
            if self.isn("class"):
                return self.class_(True, optional_name=True)
            if self.ts and self.isn("abstract") and self.looks(lambda: (self.advance(), self.isn("class"))[-1]):
                self.advance()
                return self.class_(True, optional_name=True)
            if self.ts and self.isn("interface") and self.looks(lambda: (self.advance(), self.kind == "n")[-1]):
                return self.interface()
            self.assignment()
            return self.semicolon()
        if self.eat("*"):
            if self.eatn("as"):
                if self.kind not in "ns":
                    raise self.wrong("a name")
                self.advance()
            self.need("from")
            if self.kind != "s":
                raise self.wrong("a module name")
            self.advance()
            self.attributes()
            return self.semicolon()
        if self.isp("{"):
            at = self.at
            foreign = self.specifiers(importing=False)
            if self.eatn("from"):
                if self.kind != "s":
                    raise self.wrong("a module name")
                self.advance()
                self.attributes()
            elif foreign:
                raise Fault(at, "exports a name that can't be bound")
            return self.semicolon()
        if self.isp("@"):
            self.decorators()
            if not self.isn("class"):
                raise self.wrong("a class")
            return self.class_(True)
        if self.kind == "n" and (self.value in ("var", "const", "function", "class", "let") or self.isn("async") and self.looks(lambda: (self.advance(), not self.nl and self.isn("function"))[-1])):
            return self.statement()
        if self.ts and self.kind == "n" and (self.isn("enum") or self.ts_statement(True)):
            if self.isn("enum"):
                self.enum()
            return None
        raise self.wrong("a declaration")

    # -- expressions

    def no_cover(self) -> None:
        if self.cover >= 0:
            at, self.cover = self.cover, -1
            raise Fault(at, "initialiser outside a pattern")

    def expression(self, no_in: bool = False, pattern: bool = False) -> str:
        kind = self.assignment(no_in, pattern)
        while self.eat(","):
            self.assignment(no_in)
            kind = "list"
        return kind

    def assignment(self, no_in: bool = False, pattern: bool = False) -> str:
        """Assignment expression; ``pattern`` leaves a shorthand initialiser to the caller."""
        v = self.value
        if self.kind == "n":
            if v == "yield" and self.in_generator:
                self.advance()
                if not self.nl:
                    if self.eat("*"):
                        self.assignment(no_in)
                    elif not (self.kind == "$" or self.kind == "p" and self.value in (")", "]", "}", ",", ";", ":") or self.isn("in") or self.isn("of")):
                        self.assignment(no_in)
                return "yield"
            if v == "async" and self.attempt(self.async_arrow_head):
                self.arrow_body(no_in, True)
                return "arrow"
            if self.is_name() and self.arrow_after_name():
                self.ident()
                self.arrow_body(no_in, False)
                return "arrow"
        elif self.kind == "p":
            if v == "(" and self.arrow_ahead() and self.attempt_arrow(no_in):
                return "arrow"
            if v == "<" and self.ts and self.attempt(self.generic_arrow_head):
                self.arrow_body(no_in, False)
                return "arrow"
        before = self.cover
        self.cover = -1
        at = self.at
        kind = self.conditional(no_in)
        if self.kind == "p" and self.value in _ASSIGN:
            op = self.value
            if op == "=" and kind in ("object", "array"):
                self.cover = -1
            elif kind not in ("name", "member") or self.cover >= 0:
                raise Fault(at, "can't be assigned")
            self.cover = before
            self.advance()
            self.assignment(no_in)
            return "assign"
        if self.cover >= 0:
            if not pattern:
                self.no_cover()
            return kind
        self.cover = before
        return kind

    def arrow_after_name(self) -> bool:
        m = _SKIP.match(self.text, self.pos)
        return self.text.startswith("=>", m.end()) and "\n" not in m.group()

    def arrow_ahead(self) -> bool:
        """Cheap look at whether a parenthesis can open parameters."""
        m = _SKIP.match(self.text, self.pos)
        c = self.text[m.end() : m.end() + 1]
        return c in ")[{.@" or c.isalpha() or c in "_$\\"

    def attempt_arrow(self, no_in: bool) -> bool:
        def head() -> None:
            self.arrow_head()
            if not self.isp("=>") or self.nl:
                raise self.wrong("'=>'")

        m = self.mark()
        if not self.attempt(head):
            return False
        if self.ts and self.no_conditional:
            # In the middle of a ternary, a colon after the parameters may belong to it.
            self.back(m)
            if not self.attempt(lambda: (head(), self.arrow_body(no_in, False))):
                return False
            return True
        self.arrow_body(no_in, False)
        return True

    def arrow_head(self) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()

    def generic_arrow_head(self) -> None:
        if self.jsx and not self.looks(lambda: (self.advance(), self.eatn("const"), self.kind == "n" and (self.advance() or self.isp(",") or self.isn("extends")))[-1]):
            raise self.wrong()
        self.arrow_head()
        if not self.isp("=>"):
            raise self.wrong("'=>'")

    def async_arrow_head(self) -> None:
        self.advance()
        if self.nl:
            raise self.wrong()
        state, self.in_async = self.in_async, True
        try:
            if self.kind == "n" and self.value != "function":
                self.ident()
            elif self.isp("(") or self.ts and self.isp("<"):
                self.arrow_head()
            else:
                raise self.wrong()
        finally:
            self.in_async = state
        if not self.isp("=>") or self.nl:
            raise self.wrong("'=>'")

    def arrow_body(self, no_in: bool, is_async: bool) -> None:
        if self.nl:
            raise self.wrong()
        self.need("=>")
        state = (self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_conditional)
        self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels = True, is_async, False, 0, 0, []
        try:
            if self.isp("{"):
                self.no_conditional = False
                self.block()
            else:
                self.assignment(no_in)
        finally:
            self.in_function, self.in_async, self.in_generator, self.loops, self.switches, self.labels, self.no_conditional = state

    def conditional(self, no_in: bool) -> str:
        kind = self.binary(0, no_in)
        if self.isp("?"):
            self.advance()
            state, self.no_conditional = self.no_conditional, True
            self.assignment()
            self.no_conditional = state
            self.need(":")
            self.assignment(no_in)
            return "conditional"
        return kind

    def binary(self, least: int, no_in: bool) -> str:
        """Precedence climbing."""
        if self.kind == "h":  # #x in object
            self.advance()
            if not self.isn("in") or no_in:
                raise self.wrong("'in'")
            kind = "private"
        else:
            kind = self.unary()
        mixed = ""
        while True:
            op = self.value
            if self.kind == "n":
                if op == "in" and not no_in or op == "instanceof":
                    power = 8
                elif self.ts and op in ("as", "satisfies") and not self.nl:
                    if 8 <= least:
                        return kind
                    self.advance()
                    if not self.eatn("const"):
                        self.type_()
                    kind = "member" if kind in ("name", "member") else "cast"
                    continue
                else:
                    return kind
            elif self.kind == "p":
                power = _BINARY.get(op, 0)
                if not power:
                    return kind
            else:
                return kind
            if power <= least:
                return kind
            at = self.at
            if op == "**" and kind == "unary":
                raise Fault(at, "a unary operator before **")
            if op == "??" and mixed in ("||", "&&") or op in ("||", "&&") and mixed == "??":
                raise Fault(at, "?? mixed with || or &&")
            if op in ("??", "||", "&&"):
                mixed = op
            self.advance()
            right = self.binary(power - (op == "**"), no_in)
            if op == "??" and right == "logical" or op in ("||", "&&") and right == "nullish":
                raise Fault(at, "?? mixed with || or &&")
            kind = "nullish" if op == "??" else "logical" if op in ("||", "&&") else "binary"

    def unary(self) -> str:
        k, v = self.kind, self.value
        if k == "p":
            if v in ("!", "~", "+", "-"):
                self.advance()
                self.unary()
                return "unary"
            if v in ("++", "--"):
                self.advance()
                at = self.at
                if self.unary() not in ("name", "member"):
                    raise Fault(at, "can't be assigned")
                return "update"
            if v == "<" and self.ts and not self.jsx:
                self.advance()
                if not self.eatn("const"):
                    self.type_()
                self.closing()
                self.unary()
                return "cast"
        elif k == "n":
            if v in ("typeof", "void", "delete"):
                self.advance()
                at = self.at
                kind = self.unary()
                if v == "delete" and kind == "name" and not self.ts:
                    raise Fault(at, "delete of a name")
                return "unary"
            if v == "await" and (self.in_async or not self.in_function):
                self.advance()
                self.unary()
                return "unary"
        at = self.at
        kind = self.left_hand()
        if self.kind == "p" and self.value in ("++", "--") and not self.nl:
            if kind not in ("name", "member"):
                raise Fault(at, "can't be assigned")
            self.advance()
            return "update"
        return kind

    def left_hand(self) -> str:
        if self.isn("new"):
            kind = self.new()
        elif self.isn("super"):
            self.advance()
            if not (self.isp("(") or self.isp(".") or self.isp("[")):
                raise self.wrong("a call or property")
            kind = "super"
        elif self.isn("import"):
            self.advance()
            if self.eat("."):
                self.need("meta")
            else:
                self.need("(")
                self.assignment()
                if self.eat(",") and not self.isp(")"):
                    self.assignment()
                    self.eat(",")
                self.need(")")
            kind = "call"
        else:
            kind = self.primary()
        if kind == "arrow":
            return kind
        return self.suffixes(kind)

    def suffixes(self, kind: str, calls: bool = True) -> str:
        chained = False
        while self.kind == "p":
            v = self.value
            if v == ".":
                self.advance()
                if self.kind not in "nh":
                    raise self.wrong("a property name")
                self.advance()
                kind = "optional" if chained else "member"
            elif v == "?.":
                if not calls:
                    raise self.wrong()
                self.advance()
                chained = True
                if self.isp("("):
                    self.arguments()
                elif self.isp("["):
                    self.advance()
                    self.expression()
                    self.need("]")
                elif self.isp("`"):
                    raise self.wrong()
                elif self.ts and self.isp("<"):
                    self.type_arguments()
                    self.arguments()
                elif self.kind in "nh":
                    self.advance()
                else:
                    raise self.wrong("a property name")
                kind = "optional"
            elif v == "[":
                self.advance()
                self.expression()
                self.need("]")
                kind = "optional" if chained else "member"
            elif v == "(":
                if not calls:
                    return kind
                self.arguments()
                kind = "optional" if chained else "call"
            elif v == "`":
                if chained:
                    raise self.wrong()
                self.template(tagged=True)
                kind = "call"
            elif self.ts and v == "!" and not self.nl:
                self.advance()
                kind = kind if kind in ("name", "member") else "member"
            elif self.ts and v in ("<", "<<") and self.attempt(self.instantiation):
                kind = "instance"
            else:
                return kind
        return kind

    def instantiation(self) -> None:
        """Type arguments of a call, a template or an instantiation expression."""
        self.type_arguments()
        if self.isp("(") or self.isp("`"):
            return
        if self.kind == "p" and self.value in ("<", ">", "+", "-", "["):
            raise self.wrong()
        if not self.nl and (self.kind in "dsh" or self.kind == "n" and self.value not in _BINARY and self.value not in ("as", "satisfies", "of")):
            raise self.wrong()

    def new(self) -> str:
        self.need("new")
        if self.eat("."):
            if not self.isn("target"):
                raise self.wrong("'target'")
            self.advance()
            return "call"
        if self.isn("import"):
            raise self.wrong()
        kind = self.new() if self.isn("new") else "super" if self.isn("super") else self.primary()
        if kind == "super":
            self.advance()
        self.suffixes(kind, calls=False)
        if self.isp("("):
            self.arguments()
        return "call"

    def arguments(self) -> None:
        self.need("(")
        state, self.no_conditional = self.no_conditional, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.isp(")"):
                self.need(",")
        self.no_conditional = state

    def primary(self) -> str:
        k, v = self.kind, self.value
        if k == "n":
            if v in ("this", "null", "true", "false"):
                self.advance()
                return "value"
            if v == "function":
                self.function(False)
                return "function"
            if v == "class":
                self.class_(False)
                return "function"
            if v == "async" and self.looks(lambda: (self.advance(), not self.nl and self.isn("function"))[-1]):
                self.advance()
                self.function(False, is_async=True)
                return "function"
            if not self.is_name():
                raise self.wrong("an expression")
            self.advance()
            return "name"
        if k in "ds" and k:
            self.advance()
            return "value"
        if k == "p":
            if v == "(":
                self.advance()
                state, self.no_conditional = self.no_conditional, False
                kind = self.expression()
                self.no_conditional = state
                self.need(")")
                return kind if kind in ("name", "member") else "paren"
            if v == "[":
                return self.array()
            if v == "{":
                return self.object_literal()
            if v == "`":
                self.template()
                return "value"
            if v in ("/", "/="):
                self.regex()
                return "value"
            if v == "<" and self.jsx:
                self.jsx_element()
                return "value"
            if v == "@":
                self.decorators()
                self.class_(False)
                return "function"
        raise self.wrong("an expression")

    def array(self) -> str:
        self.need("[")
        state, self.no_conditional = self.no_conditional, False
        cover = -1
        while not self.eat("]"):
            if self.eat(","):
                continue
            self.eat("...")
            self.assignment(pattern=True)
            cover = max(cover, self.cover)
            if not self.isp("]"):
                self.need(",")
        self.cover = cover
        self.no_conditional = state
        return "array"

    def object_literal(self) -> str:
        self.need("{")
        state, self.no_conditional = self.no_conditional, False
        cover = -1
        while not self.eat("}"):
            self.cover = -1
            self.property()
            cover = max(cover, self.cover)
            if not self.isp("}"):
                self.need(",")
        self.cover = cover
        self.no_conditional = state
        return "object"

    def property(self) -> None:
        if self.eat("..."):
            self.assignment(pattern=True)
            return
        is_async = generator = False
        if self.isn("async") and self.looks(lambda: (self.advance(), not self.nl and (self.kind in "nsd" or self.isp("[") or self.isp("*")))[-1]):
            self.advance()
            is_async = True
        generator = self.eat("*")
        if not (is_async or generator) and self.kind == "n" and self.value in ("get", "set") and self.looks(lambda: (self.advance(), self.kind in "nsd" or self.isp("["))[-1]):
            self.advance()
            self.property_key()
            return self.function_rest(method=True)
        simple = self.kind == "n" and self.is_name()
        m = self.mark()
        self.property_key()
        if self.isp("(") or self.ts and self.isp("<"):
            return self.function_rest(is_async=is_async, generator=generator, method=True)
        if is_async or generator:
            raise self.wrong("'('")
        if self.eat(":"):
            self.assignment(pattern=True)
            return None
        if not simple:
            if self.kind == "p" and self.value in (",", "}", "="):
                self.back(m)
            raise self.wrong("':'")
        if self.isp("="):
            at = self.at
            self.advance()
            self.assignment()
            self.cover = at
        return None

    def template(self, tagged: bool = False) -> None:
        """Stands on the opening backquote; ends after the closing one."""
        at = self.at
        state, self.no_conditional = self.no_conditional, False
        while True:
            m = _TEMPLATE.match(self.text, self.pos)
            if not m:
                self.pos = len(self.text)
                self.scan()
                raise Fault(at, "template without end")
            if not tagged and "\\" in m.group() and self._bad_escape(m.group()):
                self.pos = m.end()
                raise Fault(m.start(), "wrong escape in a template")
            self.pos = m.end()
            if m.group(1) == "`":
                self.no_conditional = state
                self.last = self.pos
                self.scan()
                return
            self.scan()
            self.expression()
            if not self.isp("}"):
                raise self.wrong("'}'")

    def regex(self) -> None:
        m = _REGEX.match(self.text, self.at)
        if not m:
            raise Fault(self.at, "regular expression without end")
        flags = m.group(1)
        if len(set(flags)) != len(flags) or set(flags) - set("dgimsuyv"):
            raise Fault(m.start(1), "wrong flags")
        body = m.group()[1 : len(m.group()) - len(flags) - 1]
        if not self._groups(body):
            raise Fault(self.at, "wrong regular expression")
        self.pos = self.last = m.end()
        self.scan()

    @staticmethod
    def _groups(body: str) -> bool:
        """Whether parentheses pair and quantifiers have something before them."""
        body = re.sub(r"\\[\s\S]", "a", body)
        body = re.sub(r"\[[^\]]*\]", "a", body)
        depth = 0
        for c in body:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return False
        return depth == 0 and not re.search(r"(?:^|[(|])[*+?](?<!\(\?)", body)

    # -- JSX

    def jsx_element(self) -> None:
        """Stands on ``<``; ends on the token after the element."""
        self.pos = self.at
        self.jsx_at(self.at)
        self.last = self.pos
        self.scan()

    def jsx_skip(self) -> None:
        self.pos = _SKIP.match(self.text, self.pos).end()

    def jsx_char(self, c: str) -> None:
        self.jsx_skip()
        if not self.text.startswith(c, self.pos):
            self.at = self.pos
            raise Fault(self.pos, f"expected {c!r} in an element")
        self.pos += len(c)

    def jsx_name(self) -> str:
        self.jsx_skip()
        begin = self.pos
        while True:
            m = _JSX_NAME.match(self.text, self.pos)
            if not m:
                raise Fault(self.pos, "expected a name in an element")
            self.pos = m.end()
            if self.text[self.pos : self.pos + 1] in (".", ":"):
                self.pos += 1
                continue
            return self.text[begin : self.pos]

    def jsx_expression(self, spread: bool = True) -> None:
        """Stands after ``{``; ends after ``}``."""
        self.scan()
        if self.isp("}"):
            return
        if self.eat("...") and not spread:
            raise self.wrong()
        self.expression()
        if not self.isp("}"):
            raise self.wrong("'}'")

    def jsx_at(self, start: int) -> None:
        self.pos = start
        self.jsx_char("<")
        self.jsx_skip()
        name = ""
        if not self.text.startswith(">", self.pos):
            name = self.jsx_name()
            self.jsx_skip()
            if self.ts and self.text.startswith("<", self.pos):
                self.scan()
                self.type_arguments()
                self.pos = self.at
            while True:
                self.jsx_skip()
                c = self.text[self.pos : self.pos + 1]
                if c == "{":
                    self.pos += 1
                    self.scan()
                    if not self.eat("..."):
                        raise self.wrong("'...'")
                    self.assignment()
                    if not self.isp("}"):
                        raise self.wrong("'}'")
                elif c == "/":
                    self.pos += 1
                    self.jsx_char(">")
                    return
                elif c == ">":
                    break
                else:
                    self.jsx_name()
                    self.jsx_skip()
                    if self.text.startswith("=", self.pos):
                        self.pos += 1
                        self.jsx_skip()
                        m = _JSX_STRING.match(self.text, self.pos)
                        if m:
                            self.pos = m.end()
                        elif self.text.startswith("{", self.pos):
                            begin = self.pos
                            self.pos += 1
                            self.jsx_expression(spread=False)
                            if not self.text[begin + 1 : self.at].strip():
                                raise Fault(begin, "empty attribute")
                        elif self.text.startswith("<", self.pos):
                            self.jsx_at(self.pos)
                        else:
                            raise Fault(self.pos, "expected an attribute value")
        self.pos += 1
        while True:
            self.pos = _JSX_TEXT.match(self.text, self.pos).end()
            c = self.text[self.pos : self.pos + 1]
            if c == "{":
                self.pos += 1
                self.jsx_expression()
            elif c == "<":
                m = re.compile(r"<\s*/").match(self.text, self.pos)
                if not m:
                    self.jsx_at(self.pos)
                    continue
                at, self.pos = self.pos, m.end()
                self.jsx_skip()
                end = "" if self.text.startswith(">", self.pos) else self.jsx_name()
                if end != name:
                    raise Fault(at, f"{end!r} closes {name!r}")
                self.jsx_char(">")
                return
            else:
                raise Fault(self.pos, "element without end" if not c else f"{c!r} in an element's text")

    # -- TypeScript declarations

    def ts_statement(self, top: bool) -> bool:
        v = self.value
        after = lambda test: self.looks(lambda: (self.advance(), test())[-1])
        if v == "interface" and after(lambda: self.kind == "n" and not self.nl):
            self.interface()
        elif v == "type" and after(lambda: self.kind == "n" and not self.nl and self.is_name() and self.looks(lambda: (self.advance(), self.isp("=") or self.isp("<"))[-1])):
            self.advance()
            self.ident()
            self.type_parameters()
            self.need("=")
            self.type_()
            self.semicolon()
        elif v in ("namespace", "module") and after(lambda: self.kind in "ns" and not self.nl):
            self.advance()
            if self.kind == "s":
                self.advance()
                if not self.isp("{"):
                    self.semicolon()
                    return True
            else:
                self.ident()
                while self.eat("."):
                    self.ident()
            self.module_block()
        elif v == "global" and after(lambda: self.isp("{")):
            self.advance()
            self.module_block()
        elif v == "declare" and after(lambda: self.kind == "n" and not self.nl):
            self.advance()
            state, self.ambient = self.ambient, True
            try:
                self.statement(top)
            finally:
                self.ambient = state
        elif v == "abstract" and after(lambda: self.isn("class") and not self.nl):
            self.advance()
            self.class_(True)
        else:
            return False
        return True

    def module_block(self) -> None:
        self.need("{")
        while not self.isp("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.guarded(lambda: self.statement(top=True))
        self.advance()

    def interface(self) -> None:
        self.need("interface")
        self.ident()
        self.type_parameters()
        if self.eatn("extends"):
            self.type_reference_list()
        self.object_type()

    def type_reference_list(self) -> None:
        while True:
            self.entity()
            if self.isp("<"):
                self.type_arguments()
            if not self.eat(","):
                return

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.eat("}"):
            if self.kind in "ns":
                self.advance()
            elif self.eat("["):
                if self.kind != "s":
                    raise self.wrong("a string")
                self.advance()
                self.need("]")
            else:
                raise self.wrong("a member")
            if self.eat("="):
                self.assignment()
            if not self.isp("}"):
                self.need(",")

    def entity(self) -> None:
        self.any_name() if self.isn("this") else self.ident("a type")
        while self.eat("."):
            self.any_name()

    # -- types

    def annotation(self) -> None:
        if self.eat(":"):
            self.type_()

    def return_type(self) -> None:
        """A type, a predicate or an assertion."""
        if self.isn("asserts") and self.looks(lambda: (self.advance(), self.kind == "n" and not self.nl)[-1]):
            self.advance()
            self.any_name()
            if self.eatn("is"):
                self.type_()
            return
        if self.kind == "n" and self.looks(lambda: (self.advance(), self.isn("is") and not self.nl)[-1]):
            self.advance()
            self.advance()
        self.type_()

    def type_parameters(self) -> None:
        if not self.isp("<"):
            return
        self.advance()
        if self.isp(">"):
            raise self.wrong("a type parameter")
        while True:
            while self.kind == "n" and self.value in ("const", "in", "out") and self.looks(lambda: (self.advance(), self.kind == "n" and self.value != "extends")[-1]):
                self.advance()
            self.ident()
            if self.eatn("extends"):
                self.type_()
            if self.eat("="):
                self.type_()
            if not self.eat(",") or self.isp(">"):
                break
        self.closing()

    def type_arguments(self) -> None:
        if self.isp("<<"):
            self.pos = self.last = self.at + 1
            self.scan()
        else:
            self.need("<")
        while True:
            self.type_()
            if not self.eat(","):
                break
        self.closing()

    def type_(self) -> None:
        if self.isp("<") or self.isn("new") or self.isn("abstract") and self.looks(lambda: (self.advance(), self.isn("new"))[-1]) or self.isp("(") and self.attempt(self.function_type):
            if self.kind == "p" and self.value == "<" or self.isn("new") or self.isn("abstract"):
                self.eatn("abstract")
                self.eatn("new")
                self.function_type()
            return
        self.union()
        if not self.nl and self.isn("extends") and not self.in_extends:
            self.advance()
            state, self.in_extends = self.in_extends, True
            self.type_()
            self.in_extends = state
            self.need("?")
            state, self.in_extends = self.in_extends, False
            self.type_()
            self.need(":")
            self.type_()
            self.in_extends = state

    in_extends = False

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        state, self.in_extends = self.in_extends, False
        self.return_type()
        self.in_extends = state

    def union(self) -> None:
        if self.isp("|") or self.isp("&"):
            self.advance()
        while True:
            self.type_operator()
            if not (self.eat("|") or self.eat("&")):
                return
            if self.isp("(") and self.attempt(self.function_type):
                return

    def type_operator(self) -> None:
        if self.kind == "n" and self.value in ("keyof", "unique", "readonly") and self.looks(lambda: (self.advance(), self.kind in "nsd" or self.kind == "p" and self.value in ("(", "[", "{", "`", "-"))[-1]):
            self.advance()
            return self.type_operator()
        if self.isn("infer") and self.looks(lambda: (self.advance(), self.kind == "n")[-1]):
            self.advance()
            self.ident()
            if self.isn("extends"):
                def constraint() -> None:
                    self.advance()
                    state, self.in_extends = self.in_extends, True
                    try:
                        self.type_()
                    finally:
                        self.in_extends = state
                    if self.isp("?") and not state:
                        raise self.wrong()

                self.attempt(constraint)
            return None
        self.type_primary()
        while not self.nl and self.isp("["):
            self.advance()
            if not self.eat("]"):
                self.free_type()
                self.need("]")
        return None

    def free_type(self) -> None:
        state, self.in_extends = self.in_extends, False
        self.type_()
        self.in_extends = state

    def type_primary(self) -> None:
        k, v = self.kind, self.value
        if k == "n":
            if v == "typeof":
                self.advance()
                if self.isn("import"):
                    return self.type_primary()
                self.entity()
                if not self.nl and self.isp("<"):
                    self.type_arguments()
                return None
            if v == "import":
                self.advance()
                self.need("(")
                self.type_()
                if self.eat(","):
                    self.object_literal()
                self.need(")")
                while self.eat("."):
                    self.any_name()
                if self.isp("<"):
                    self.type_arguments()
                return None
            if v in ("void", "null", "this", "true", "false"):
                return self.advance()
            self.entity()
            if not self.nl and (self.isp("<") or self.isp("<<")):
                self.type_arguments()
            return None
        if k in "sd":
            return self.advance()
        if k == "p":
            if v == "-":
                self.advance()
                if self.kind != "d":
                    raise self.wrong("a number")
                return self.advance()
            if v == "(":
                self.advance()
                self.free_type()
                return self.need(")")
            if v == "[":
                return self.tuple_type()
            if v == "{":
                return self.object_type()
            if v == "`":
                return self.template_type()
        raise self.wrong("a type")

    def template_type(self) -> None:
        at = self.at
        while True:
            m = _TEMPLATE.match(self.text, self.pos)
            if not m:
                raise Fault(at, "template without end")
            self.pos = m.end()
            self.last = self.pos
            self.scan()
            if m.group(1) == "`":
                return
            self.free_type()
            if not self.isp("}"):
                raise self.wrong("'}'")

    def tuple_type(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.eat("...")
            if self.kind == "n" and self.looks(lambda: (self.advance(), self.eat("?"), self.isp(":"))[-1]):
                self.advance()
                self.eat("?")
                self.need(":")
            self.free_type()
            self.eat("?")
            if not self.isp("]"):
                self.need(",")

    def index_signature(self) -> bool:
        def sign() -> None:
            self.need("[")
            self.ident()
            self.need(":")
            self.type_()
            self.need("]")

        if not self.attempt(sign):
            return False
        self.eat("?")
        self.annotation()
        return True

    def object_type(self) -> None:
        if self.looks(self._mapped_ahead):
            return self.mapped_type()
        self.need("{")
        while not self.eat("}"):
            if self.kind == "$":
                raise self.wrong("'}'")
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.isp("}") or self.nl):
                raise self.wrong("';'")
        return None

    def _mapped_ahead(self) -> bool:
        self.need("{")
        if self.eat("+") or self.eat("-"):
            return self.isn("readonly")
        if self.isn("readonly") and self.looks(lambda: (self.advance(), self.isp("["))[-1]):
            self.advance()
        self.need("[")
        self.ident()
        return self.isn("in")

    def mapped_type(self) -> None:
        self.need("{")
        if self.eat("+") or self.eat("-"):
            self.need("readonly")
        else:
            self.eatn("readonly")
        self.need("[")
        self.ident()
        self.need("in")
        self.free_type()
        if self.eatn("as"):
            self.free_type()
        self.need("]")
        if self.eat("+") or self.eat("-"):
            self.need("?")
        else:
            self.eat("?")
        self.annotation()
        self.eat(";") or self.eat(",")
        self.need("}")

    def type_member(self) -> None:
        if self.isp("(") or self.isp("<"):
            return self.signature()
        if self.isn("new") and self.looks(lambda: (self.advance(), self.isp("(") or self.isp("<"))[-1]):
            self.advance()
            return self.signature()
        if self.isn("readonly") and self.looks(lambda: (self.advance(), self.kind in "nsd" or self.isp("["))[-1]):
            self.advance()
        if self.kind == "n" and self.value in ("get", "set") and self.looks(lambda: (self.advance(), self.kind in "nsd" or self.isp("["))[-1]):
            self.advance()
        if self.isp("[") and self.index_signature():
            return None
        self.property_key()
        self.eat("?")
        if self.isp("(") or self.isp("<"):
            return self.signature()
        if self.eat(":"):
            self.free_type()
        return None

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        if self.eat(":"):
            state, self.in_extends = self.in_extends, False
            self.return_type()
            self.in_extends = state
