"""Output of version control as tables: tree listings, raw change sets, working-tree states.

Texts come as rows (one listing a row, whatever its length); lines are taken apart by built-in expressions.

Defined results
---------------
* Lines that aren't of the listing's form are left out; null and empty listings give no row.
* Paths are those of the listing with quotes taken off and made portable; a path repeated in a listing comes out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.paths import portable_path


def _lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return df.select(*key, F.explode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line"))


def _path(c: Column) -> Column:
    return portable_path(F.regexp_replace(c, '^"|"$', ""))


def tree_modes(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``mode type object\\tpath`` lines: ``(*key, mode, kind, object, path)``; kind is regular, symlink or submodule."""
    form = r"^(\d{6}) (blob|commit|tree) ([0-9a-f]{7,64})\t(.+)$"
    g = lambda i: F.regexp_extract("line", form, i)
    kind = F.when(g(1) == "120000", "symlink").when(g(1) == "160000", "submodule").otherwise("regular")
    return _lines(df, key, text).where(F.col("line").rlike(form)).select(*key, g(1).alias("mode"), kind.alias("kind"), g(3).alias("object"), _path(g(4)).alias("path")).distinct()


def raw_changes(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``:old new old_object new_object status\\tpath[\\tnew path]`` lines: ``(*key, change, old_path, new_path, old_object, new_object)``."""
    form = r"^:(\d{6}) (\d{6}) ([0-9a-f]+) ([0-9a-f]+) ([AMDTRC])\d*\t([^\t]+)(?:\t(.+))?$"
    g = lambda i: F.regexp_extract("line", form, i)
    status = g(5)
    change = F.when(status == "A", "added").when(status == "D", "removed").when(status == "R", "renamed").when(status == "C", "copied").when(status == "T", "type_changed").otherwise("changed")
    old, new = F.when(status != "A", _path(g(6))), F.when(status == "D", None).when(g(7) != "", _path(g(7))).otherwise(_path(g(6)))
    known = lambda c: F.when(~c.rlike("^0+$"), c)
    return _lines(df, key, text).where(F.col("line").rlike(form)).select(*key, change.alias("change"), old.alias("old_path"), new.alias("new_path"), known(g(3)).alias("old_object"), known(g(4)).alias("new_object")).distinct()


def worktree(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Short status lines: ``(*key, state, path)``; state is untracked, ignored, conflicted or modified."""
    form = r"^([ MADRCU?!]{2}) (?:.+ -> )?(.+)$"
    code = F.regexp_extract("line", form, 1)
    state = F.when(code == "??", "untracked").when(code == "!!", "ignored").when(code.contains("U") | code.isin("AA", "DD"), "conflicted").otherwise("modified")
    return _lines(df, key, text).where(F.col("line").rlike(form)).select(*key, state.alias("state"), _path(F.regexp_extract("line", form, 2)).alias("path")).distinct()


def unique_renames(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Added and removed files of one object, one to one, as ``(*scope, object, old_path, new_path)``; others stay what they are."""
    side = lambda kind, obj, path: changes.where(F.col("change") == kind).groupBy(*scope, F.col(obj).alias("object")).agg(F.count("*").alias("n"), F.min(path).alias(path)).where("n = 1 and object is not null").drop("n")
    return side("removed", "old_object", "old_path").join(side("added", "new_object", "new_path"), [*scope, "object"])


def contained(path: Column) -> Column:
    """Whether a path stays below its root: relative, without a drive, and never climbing out."""
    steps = F.split(portable_path(path), "/")
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda acc, s: F.struct((acc["now"] + F.when(s == "..", -1).otherwise(1)).alias("now"), F.least(acc["least"], acc["now"] + F.when(s == "..", -1).otherwise(1)).alias("least")))
    return ~path.rlike(r"^([A-Za-z]:|[/\\~])") & (depth["least"] >= 0)


def subject_kind(path: Column, revision: Column, head: Column) -> Column:
    """What a subject's location is: a remote, exact revisions of a repository, its working tree, or a plain directory."""
    return F.when(path.rlike(r"^(?:[a-z+]+://|[\w.-]+@[\w.-]+:)"), "remote").when(revision.rlike("^[0-9a-f]{7,64}(\\.\\.\\.?[0-9a-f]{7,64})?$"), "revisions").when(head.isNotNull(), "working_tree").otherwise("directory")
