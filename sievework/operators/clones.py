"""Clone groups: equal content found by fingerprint and settled by content.

A fingerprint is an index only: groups are keyed by fingerprint and canonical content together, so a collision
can't merge different texts.  Copies collapse in the map-side aggregation; a text that makes up a third of all
rows reaches its group as one row a task, and no list of occurrences is ever collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import digest, normal_lines
from sievework.operators.spans import blocked_range_join

NAMESPACE = "sievework-clone-fingerprint"


def canonical_text(text: Column) -> Column:
    """White space made equal and outer white space dropped; case and order kept."""
    return F.trim(F.regexp_replace(normal_lines(text), r"[ \t\n\x0b\f\r]+", " "))


def fingerprint(language: Column, content: Column) -> Column:
    return digest(F.lit(NAMESPACE), F.coalesce(language, F.lit("")), content)


def group_clones(df: DataFrame, language: str, path: str, content: Column) -> DataFrame:
    """Groups of at least two occurrences: ``(language, fingerprint, occurrences, paths, distribution)``; null content is no occurrence."""
    rows = df.select(F.col(language).alias("language"), F.col(path).alias("path"), content.alias("content")).where("content is not null and content <> ''")
    rows = rows.withColumn("fingerprint", fingerprint(F.col("language"), F.col("content")))
    each = rows.groupBy("language", "fingerprint", "content", "path").agg(F.count("*").alias("n"))
    groups = each.groupBy("language", "fingerprint", "content").agg(F.sum("n").alias("occurrences"), F.count("*").alias("paths")).where("occurrences >= 2")
    spread = F.when(F.col("paths") == 1, "same_file").when(F.col("paths") == F.col("occurrences"), "cross_file").otherwise("mixed")
    return groups.select("language", "fingerprint", "occurrences", "paths", spread.alias("distribution"))


def occurrence_ids(df: DataFrame, groups: DataFrame, language: str, coordinate: list[str], content: Column) -> DataFrame:
    """Members of groups with their occurrence id ``do1:``, joined by fingerprint."""
    rows = df.select(F.col(language).alias("language"), *coordinate, content.alias("content")).where("content is not null and content <> ''")
    rows = rows.select(*coordinate, fingerprint(F.col("language"), F.col("content")).alias("fingerprint"))
    ident = digest(*[F.col(c).cast("string") for c in coordinate], prefix="do1:")
    return rows.join(groups.select("fingerprint").distinct(), "fingerprint", "left_semi").select(*coordinate, "fingerprint", ident.alias("occurrence_id"))


def suppress_dominated(occurrences: DataFrame) -> DataFrame:
    """Groups that another initial group dominates: ``(child, parent)``.

    ``occurrences``: (grp, kind, path, start, end), spans inclusive.  A parent of the same kind and size dominates if
    each child occurrence can be given a parent occurrence of its own that strictly holds it.  Containment never
    crosses files, so the pairing splits into files: counts must agree in each, and only files where some span has a
    choice need a matching, done file by file.

    All joins are merges by hint: sizes are guessed from compressed files and not from the rows made of them, and a
    broadcast by such a guess would bring all groups to the driver.
    """
    sizes = occurrences.groupBy("grp", "kind").agg(F.count("*").alias("n")).hint("merge")
    sized = occurrences.join(sizes, ["grp", "kind"])
    c = sized.select("kind", "n", "path", F.col("grp").alias("child"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    p = sized.select("kind", "n", "path", F.col("grp").alias("parent"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    holds = (F.col("child") != F.col("parent")) & (F.col("p_start") <= F.col("c_start")) & (F.col("p_end") >= F.col("c_end")) & ((F.col("p_start") < F.col("c_start")) | (F.col("p_end") > F.col("c_end")))
    pairs = blocked_range_join(c.hint("merge"), p, ["kind", "n", "path"], 64, holds, ("c_start", "c_end"), ("p_start", "p_end"))
    per_file = pairs.groupBy("child", "parent", "n", "path").agg(F.count("*").alias("pairs"), F.countDistinct("c_start", "c_end").alias("children"), F.countDistinct("p_start", "p_end").alias("parents"))
    forced = per_file.where("pairs = children and children = parents").select("child", "parent", "n", "path", "children")
    open_ = per_file.where("pairs > children and parents >= children").select("child", "parent", "n", "path")
    chosen = pairs.join(open_.hint("merge"), ["child", "parent", "n", "path"], "left_semi").groupBy("child", "parent", "n", "path").applyInPandas(_matching, "child string, parent string, n long, path string, children long")
    whole = forced.unionByName(chosen).groupBy("child", "parent", "n").agg(F.sum("children").alias("matched")).where("matched = n")
    return whole.select("child", "parent").distinct()


def _matching(pdf: pd.DataFrame) -> pd.DataFrame:
    """Largest matching of child spans to parent spans of one file; a row only if every child is matched."""
    options: dict[tuple, list[tuple]] = {}
    for cs, ce, ps, pe in zip(pdf.c_start, pdf.c_end, pdf.p_start, pdf.p_end):
        options.setdefault((cs, ce), []).append((ps, pe))
    owner: dict[tuple, tuple] = {}

    def place(child: tuple, tried: set) -> bool:
        for parent in sorted(options[child], key=lambda s: (s[1] - s[0], s)):
            if parent in tried:
                continue
            tried.add(parent)
            if parent not in owner or place(owner[parent], tried):
                owner[parent] = child
                return True
        return False

    done = all(place(child, set()) for child in sorted(options))
    head = pdf[["child", "parent", "n", "path"]].head(1 if done else 0)
    return head.assign(children=len(options))


def body_floors(df: DataFrame, statements: Column, tokens: Column, nloc: Column) -> DataFrame:
    """Bodies with ``admitted`` and ``missed``, the floors they don't reach: four statements, forty tokens, eight code lines."""
    missed = F.array_compact(F.array(F.when(statements < 4, "statements"), F.when(tokens < 40, "tokens"), F.when(nloc < 8, "nloc")))
    return df.withColumns({"missed": F.array_join(missed, ","), "admitted": F.size(missed) == 0})


def group_ids(members: DataFrame, group: list[str], coordinate: list[str]) -> DataFrame:
    """Identity of each group, ``dg1:``, over its sorted occurrences.

    Occurrence hashes are combined in 256 buckets first, so a group with a third of all rows isn't joined in one task.
    """
    h = digest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in coordinate], prefix="")
    inner = members.select(*group, h.alias("h")).distinct().groupBy(*group, F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    outer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")
    return inner.groupBy(*group).agg(F.concat(F.lit("dg1:"), F.sha2(outer, 256)).alias("group_id"), F.sum("n").alias("occurrences"))


def group_order(df: DataFrame, by: list[str]) -> DataFrame:
    """Canonical order of groups: most occurrences first, then identity."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("occurrences").desc(), "group_id")).cast("bigint"))


def kind_status(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """Status of a kind of analysis over files: what wasn't requested doesn't count, all failed is failed, any failed is partial."""
    asked = F.col(status) != "not_requested"
    n, failed, bad = F.count_if(asked), F.count_if(F.col(status) == "failed"), F.count_if(F.col(status).isin("failed", "partial"))
    state = F.when(n == 0, "not_requested").when(failed == n, "failed").when(bad > 0, "partial").otherwise("complete")
    return df.groupBy(*by).agg(state.alias("status"), n.alias("requested"), failed.alias("failed"))
