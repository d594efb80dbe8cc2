"""Syntax checkers: recursive-descent statements, precedence-climbing expressions, panic-mode recovery.

``check(text, language, path)`` gives all errors of a file in source order; the first is the cause.
"""

from __future__ import annotations

from sievework.llm.syntax.base import Fault, Problem

__all__ = ["Fault", "Problem", "LANGUAGES", "check"]

LANGUAGES = ("Python", "Java", "JavaScript", "TypeScript", "Go")


def check(text: str, language: str, path: str = "") -> list[Problem]:
    """All syntax errors of a whole file; an empty list means that it parses."""
    if language == "Python":
        from sievework.llm.syntax.python import PythonParser

        return PythonParser(text).run()
    if language == "Java":
        from sievework.llm.syntax.java import JavaParser

        return JavaParser(text).run()
    if language == "Go":
        from sievework.llm.syntax.go import GoParser

        return GoParser(text).run()
    if language in ("JavaScript", "TypeScript"):
        from sievework.llm.syntax.script import ScriptParser

        name = path.lower()
        ts = language == "TypeScript"
        return ScriptParser(text, ts=ts, jsx=name.endswith(".tsx" if ts else ".jsx"), ambient=ts and name.endswith((".d.ts", ".d.mts", ".d.cts"))).run()
    raise ValueError(f"no parser for {language!r}")
