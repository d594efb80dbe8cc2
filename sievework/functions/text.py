"""Text, hashes and keys as Catalyst expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_lines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(normal_lines(text), "\n")


def line_is_code(original: Column, masked: Column) -> Column:
    """A line is code if it isn't blank and something is left of it without comments."""
    return (F.trim(original) != "") & (F.trim(masked) != "")


def frame(value: Column) -> Column:
    """Length as eight bytes, then the value: concatenated frames are unambiguous."""
    data = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("bigint")), 16, "0")), data)


def digest(*parts: Column, prefix: str = "sha256:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat(*[frame(p) for p in parts]), 256))


def visible_text(text: Column) -> Column:
    """Controls and direction marks are shown as a mark instead of acting."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]", "�")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1"), r"[\r\n]+", " ")


def subject_of_url(url: Column) -> Column:
    """``repo:owner/name`` of a remote location, scheme, host, case of host and a ``.git`` ending left out."""
    path = F.regexp_extract(F.trim(url), r"^(?:[a-z+]+://)?(?:[^/@]+@)?[^/:]+[/:]([^?#]+?)(?:\.git)?/?$", 1)
    return F.when(path != "", F.concat(F.lit("repo:"), path))


def join_routes(prefix: Column, route: Column) -> Column:
    part = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    return F.concat(F.lit("/"), F.concat_ws("/", F.nullif(part(prefix), F.lit("")), F.nullif(part(route), F.lit(""))))


def glob(path: Column, *patterns: str) -> Column:
    """Whether any shell pattern matches; a star crosses slashes."""
    return path.rlike("|".join(f"^{fnmatch.translate(p)}" for p in patterns)) if patterns else F.lit(False)
