"""What changed between full snapshots.

Snapshots of one subject are numbered by a small aggregate.  All rows are then range-partitioned by
(group, path) and sorted by (group, path, snapshot number), so that in every range the snapshots stand
interleaved by key and each consecutive pair is merged with two pointers in one pass: the pointer into
the earlier snapshot is the previous row, the one into the later snapshot is the current row.  The
merge keeps one row between batches, whatever the size of a group, and because the path is part of the
range key a subject that holds a third of the table spreads over many ranges.

Defined results
---------------
* The first snapshot of a group reports nothing.
* Rows with a null snapshot belong to no snapshot; rows with a null or empty path name no file but
  still show that the snapshot exists.  Null group columns are values like any other.
* Of several rows of one file in one snapshot the latest arrival counts (nulls last); rows that tie
  in arrival are taken by the greatest digest, so the result doesn't depend on row order.
* A digest that is null, blank or no hexadecimal number is unknown and never ``changed``.
* An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.paths import hex_number, portable_path
from sievework.session import cut

#: Snapshot lists of up to so many rows (under 100 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_SNAPSHOTS = 200_000


def _same(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row but the first equals the row before it in the columns, null equal to null."""
    n = len(table)
    result = np.ones(max(n - 1, 0), dtype=bool)
    for name in columns:
        a, b = table[name].slice(0, n - 1), table[name].slice(1)
        equal = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        result &= np.asarray(pc.or_(equal, both))
    return result


def merge_sorted(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge over rows sorted by group, path, ordinal: emits (run, subject columns, path, kind)."""
    key = [*group, "path"]
    carry: pa.Table | None = None

    def emit(table: pa.Table, kind: str, run: str) -> pa.RecordBatch:
        columns = [table[run], *(table[g] for g in group), table["path"], pa.array([kind] * len(table), pa.string())]
        out = pa.table(columns, names=["run", *group, "path", "change_kind"]).combine_chunks()
        return out.to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        fresh = carry is None
        if not fresh:
            table = pa.concat_tables([carry, table])
        ordinal = np.asarray(table["ordinal"])
        kept = np.r_[True, ~(_same(table, key) & (ordinal[1:] == ordinal[:-1]))]
        table = table.filter(pa.array(kept))
        ordinal = np.asarray(table["ordinal"])
        same = _same(table, key)
        step = same & (ordinal[1:] == ordinal[:-1] + 1)
        digests = table["digest"]
        differ = np.asarray(pc.fill_null(pc.not_equal(digests.slice(0, len(table) - 1), digests.slice(1)), False)) if len(table) > 1 else np.zeros(0, bool)
        added = np.r_[fresh and ordinal[0] > 0, ~step & (ordinal[1:] > 0)]
        removed = np.r_[~step & np.asarray(table["next_run"].is_valid())[:-1], False]
        changed = np.r_[False, step & differ]
        for mask, kind, run in ((added, "added", "run"), (removed, "removed", "next_run"), (changed, "changed", "run")):
            if mask.any():
                yield emit(table.filter(pa.array(mask)), kind, run)
        carry = table.slice(len(table) - 1).combine_chunks()
    if carry is not None and carry["next_run"][0].is_valid:
        yield emit(carry, "removed", "next_run")


def snapshot_changes(
    df: DataFrame,
    *,
    group: list[str],
    run: str,
    sequence: str,
    path: str,
    digest: str,
    arrived: str,
    normalise: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Changes of each snapshot against the group's previous one: ``(run, *group, path, change_kind)``.

    ``normalise`` gives the expressions for the file key and the content digest; by default the portable path
    and the digest as a hexadecimal number.
    """
    key, content = normalise or (portable_path(F.col(path)), hex_number(F.col(digest)))
    rows = df.where(F.col(run).isNotNull()).select(
        *[F.col(g) for g in group], F.col(run).alias("run"), F.col(sequence).alias("sequence"), key.alias("path"), content.alias("digest"), F.col(arrived).alias("arrived")
    )
    order = Window.partitionBy(*group).orderBy(F.col("sequence").asc_nulls_first(), "run")
    runs = (
        df.where(F.col(run).isNotNull())
        .groupBy(*group, F.col(run).alias("run"))
        .agg(F.min(sequence).alias("sequence"))
        .withColumn("ordinal", F.row_number().over(order) - 1)
        .withColumn("next_run", F.lead("run").over(order))
        .select(*[F.col(g).alias(f"r_{g}") for g in group], F.col("run").alias("r_run"), "ordinal", "next_run")
    )
    runs = cut(runs)
    if runs.count() <= BROADCAST_SNAPSHOTS:
        runs = F.broadcast(runs)
    on = F.col("run") == F.col("r_run")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"r_{g}"))
    columns = [*group, "path", "ordinal", "run", "next_run", "digest"]
    numbered = rows.where(F.col("path") != "").join(runs, on).select(*columns, "arrived")
    ranged = numbered.repartitionByRange(*group, "path").sortWithinPartitions(
        *group, "path", "ordinal", F.col("arrived").desc_nulls_last(), F.col("digest").desc_nulls_last()
    )
    kinds = dict(df.dtypes)
    schema = ", ".join([f"run {kinds[run]}", *(f"{g} {kinds[g]}" for g in group), "path string", "change_kind string"])
    return ranged.select(*columns).mapInArrow(lambda batches: merge_sorted(batches, group), schema)
