"""Path and key normalisation as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_path(path: Column) -> Column:
    """Forward slashes, no empty and no ``.`` segments, case kept.  Only paths that need it are taken apart."""
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.when(path.rlike(r"\\|//|^/|/$|(^|/)\.(/|$)"), F.array_join(segments, "/")).otherwise(path)


def hex_number(digest: Column) -> Column:
    """The number a hexadecimal string stands for, as minimal bytes; NULL where the text is no such number."""
    plain = F.regexp_extract(F.trim(digest), r"^(?:[sS][hH][aA]256:)?(?:0[xX])?([0-9a-fA-F]+)$", 1)
    return F.when(plain != "", F.unhex(F.regexp_replace(plain, "^0+", "")))


def loose_key(key: Column, *, none: tuple[str, ...] = ("", "none", "n/a", "-")) -> Column:
    """A reference without outer blanks and in lower case; NULL where it is one of the spellings for no reference."""
    plain = F.lower(F.regexp_replace(key, r"^\s+|\s+$", ""))
    return F.when(~plain.isin(*none), plain)


def path_fault(path: Column) -> Column:
    """Why a path isn't a canonical relative one; NULL if it is."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty").when(path.contains("\x00"), "nul").when(path.contains("\\"), "backslash").when(path.startswith("/"), "absolute").when(path.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(parts, lambda s: s == ".."), "parent_segment").when(F.exists(parts, lambda s: s == "."), "dot_segment").when(F.exists(parts, lambda s: s == ""), "empty_segment")
    )
