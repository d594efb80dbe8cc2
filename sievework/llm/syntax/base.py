"""What the parsers share: errors, token access for token lists, and recovery."""

from __future__ import annotations

import sys
from bisect import bisect_right
from typing import NamedTuple


class Problem(NamedTuple):
    """One syntax error: 1-based line and column, and what was wrong."""

    line: int
    column: int
    message: str


class Fault(Exception):
    """Raised at the offset where parsing can't go on."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at = at
        self.message = message


class Parser:
    """Collects faults and turns offsets into places."""

    #: Frames that a nested file may need; beyond it the file counts as not parsed.
    DEPTH = 40_000

    def __init__(self, text: str):
        self.text = text
        self.faults: list[Fault] = []

    def note(self, fault: Fault) -> None:
        if not self.faults or self.faults[-1].at != fault.at:
            self.faults.append(fault)

    def parse(self) -> None:
        raise NotImplementedError

    def run(self) -> list[Problem]:
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(old, self.DEPTH))
        try:
            self.parse()
        except Fault as fault:
            self.note(fault)
        except RecursionError:
            self.note(Fault(0, "nested too deeply"))
        finally:
            sys.setrecursionlimit(old)
        if not self.faults:
            return []
        starts = [0]
        find = self.text.find
        at = find("\n")
        while at >= 0:
            starts.append(at + 1)
            at = find("\n", at + 1)
        places = []
        first = {f.at: f for f in reversed(self.faults)}  # of faults at one place the earliest noted
        for f in sorted(first.values(), key=lambda f: f.at):
            line = bisect_right(starts, f.at)
            places.append(Problem(line, f.at - starts[line - 1] + 1, f.message))
        return places


class ListParser(Parser):
    """A parser over a token list of (kind, value, offset); kinds are one-letter strings.

    ``n`` names, ``k`` keywords, ``0`` numbers, ``s`` strings and characters, ``p`` punctuation, ``$`` the end.
    """

    toks: list[tuple[str, str, int]]

    def load(self, toks: list[tuple[str, str, int]]) -> None:
        self.toks = toks
        self.i = 0
        self.kind, self.value, self.at = toks[0]

    def seek(self, i: int) -> None:
        self.i = i
        self.kind, self.value, self.at = self.toks[i]

    def advance(self) -> None:
        i = self.i
        if self.kind != "$":
            self.i = i = i + 1
        self.kind, self.value, self.at = self.toks[i]

    def ahead(self, n: int = 1) -> tuple[str, str, int]:
        i = self.i + n
        return self.toks[i] if i < len(self.toks) else self.toks[-1]

    def fail(self, message: str) -> Fault:
        return Fault(self.at, message)

    def wrong(self, wanted: str = "") -> Fault:
        seen = "end of file" if self.kind == "$" else repr(self.value[:40])
        return Fault(self.at, f"unexpected {seen}" + (f", expected {wanted}" if wanted else ""))

    def isp(self, value: str) -> bool:
        return self.value == value and self.kind in "pk"

    def eat(self, value: str) -> bool:
        if self.value == value and self.kind in "pk":
            self.advance()
            return True
        return False

    def need(self, value: str) -> None:
        if self.value == value and self.kind in "pk":
            self.advance()
        else:
            raise self.wrong(repr(value))

    def name(self) -> str:
        if self.kind != "n":
            raise self.wrong("a name")
        v = self.value
        self.advance()
        return v

    def recover(self, fault: Fault, stop: frozenset[str], start: int) -> None:
        """Panic mode: note the fault and skip to where a statement may begin, minding nested braces."""
        self.note(fault)
        if self.i == start:
            self.advance()
        depth = 0
        while self.kind != "$":
            v = self.value if self.kind in "pk" else ""
            if depth == 0:
                if v == ";":
                    self.advance()
                    return
                if v == "}" or v in stop:
                    return
            if v == "{":
                depth += 1
            elif v == "}":
                depth -= 1
                if depth == 0:
                    self.advance()
                    return
            self.advance()
