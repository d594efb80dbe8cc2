"""References to records that do not exist.

A reference holds if a row of its key was recorded by the reference's time and not yet deleted then.
Keys are dictionary-encoded as integers inside key ranges, and for every range and period a compressed
bitmap tells which keys are alive through the whole period.  A bitmap of the keys referred to in the
period AND-NOT that bitmap leaves the (key, period) pairs that may hold an orphan; the surviving bits
are decoded and only their references are held against the exact times.

Skew: both sides are aggregated before the shuffle.  References collapse to distinct (key, period)
pairs, target rows to the earliest record per (key, deletion time), which is all a later comparison
can depend on.  A key that a third of all rows refer to thus reaches its range as one pair a period.

Defined results
---------------
* Null, blank, ``none``, ``n/a`` and ``-`` are no references; keys are compared trimmed and in lower case.
* Target rows without a key or record time prove nothing about existence at any time; a target row
  whose record time is null still makes its key known, so the reason is ``late`` and not ``missing``.
* A reference without a time of its own can't be placed in time and is compared with the end of time:
  it holds if any row of the key is not deleted.
* Repeated rows come out once; an empty target table makes every reference ``missing``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.paths import loose_key

#: Microseconds: the end of time, for targets never deleted and references without time, and before any time.
FOREVER = np.iinfo(np.int64).max
#: Keys that share one bitmap container.
CONTAINER = 1 << 16


@dataclass(frozen=True)
class Target:
    """A table that references lead to."""

    field: str
    rows: DataFrame
    key: str
    recorded: str
    deleted: str


class KeySet:
    """Compressed bitmap over the 2**16 keys of one container: sorted shorts while sparse, a bitset when dense."""

    __slots__ = ("bits", "few")

    def __init__(self, members: np.ndarray):
        members = np.unique(members)
        self.few, self.bits = (members.astype(np.uint16), None) if len(members) <= CONTAINER // 16 else (None, self._dense(members))

    @staticmethod
    def _dense(members: np.ndarray) -> np.ndarray:
        flags = np.zeros(CONTAINER, dtype=np.uint8)
        flags[members] = 1
        return np.packbits(flags, bitorder="little")

    def members(self) -> np.ndarray:
        return self.few.astype(np.int64) if self.bits is None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))

    def and_not(self, other: KeySet) -> np.ndarray:
        """The members that are not in the other set, decoded."""
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits, bitorder="little"))
        mine = self.members()
        if other.bits is None:
            return mine[~np.isin(mine, other.few)]
        return mine[(other.bits[mine >> 3] >> (mine & 7).astype(np.uint8)) & 1 == 0]


def _container(codes: np.ndarray, is_ref: np.ndarray, a: np.ndarray, b: np.ndarray, period_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, period) pairs that survive AND-NOT in one container of keys.

    A reference row has its period in ``a``; a target row is alive from ``a`` until ``b``.
    """
    t_code, t_from, t_until = codes[~is_ref], a[~is_ref], b[~is_ref]
    r_code, r_period = codes[is_ref], a[is_ref]
    out_code, out_period = [], []
    # A target is alive through period p if from <= start of p and until >= end of p.
    first = -(-t_from // period_us)
    last = np.where(t_until == FOREVER, FOREVER, t_until // period_us)
    order = np.argsort(r_period, kind="stable")
    r_code, r_period = r_code[order], r_period[order]
    cuts = np.flatnonzero(np.r_[True, r_period[1:] != r_period[:-1]]) if len(r_period) else np.zeros(0, np.int64)
    for start, stop in zip(cuts, [*cuts[1:], len(r_period)]):
        p = r_period[start]
        alive = KeySet(t_code[(first <= p) & (last > p)])
        left = KeySet(r_code[start:stop]).and_not(alive)
        out_code.append(left)
        out_period.append(np.full(len(left), p, dtype=np.int64))
    if not out_code:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_code).astype(np.int64), np.concatenate(out_period)


def _survivors(batches: Iterator[pa.RecordBatch], period_us: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (field, key) -> surviving (field, key, period, first record, [alive intervals that touch it])."""

    def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        field, key = table["field"].chunk(0), table["key"].chunk(0)
        n = len(table)
        change = np.r_[True, ~np.asarray(pc.and_(pc.equal(field[1:], field[:-1]), pc.equal(key[1:], key[:-1])))] if n > 1 else np.ones(n, bool)
        codes = np.cumsum(change) - 1  # the dictionary: keys arrive sorted
        heads = np.flatnonzero(change)
        is_ref = np.asarray(table["is_ref"])
        a, b = np.asarray(table["a"]), np.asarray(table["b"])
        for low in range(0, int(codes[-1]) + 1, CONTAINER):
            part = (codes >= low) & (codes < low + CONTAINER)
            code, period = _container(codes[part] - low, is_ref[part], a[part], b[part], period_us)
            if not len(code):
                continue
            code = code + low
            targets = np.flatnonzero(~is_ref)
            t_code = codes[targets]
            firsts, spans = [], []
            for c, p in zip(code, period):
                own = targets[np.searchsorted(t_code, c) : np.searchsorted(t_code, c, side="right")]
                firsts.append(int(a[own].min()) if len(own) else None)
                start = p * period_us if p != FOREVER else FOREVER
                stop = start + period_us if p != FOREVER else FOREVER
                spans.append([{"a": int(x), "b": int(y)} for x, y in zip(a[own], b[own]) if x <= stop and y >= start])
            at = pa.array(heads[code])
            yield pa.RecordBatch.from_arrays(
                [field.take(at), key.take(at), pa.array(period), pa.array(firsts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                names=["field", "key", "period", "first", "spans"],
            )

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rows + len(table) > 4 * CONTAINER and held:
            # Flush up to the last change of key, so that a key never straddles two dictionaries.
            table = pa.concat_tables([*held, table]).combine_chunks()
            key, field = table["key"].chunk(0), table["field"].chunk(0)
            same = np.asarray(pc.and_(pc.equal(field[1:], field[:-1]), pc.equal(key[1:], key[:-1])))
            cuts = np.flatnonzero(~same)
            if len(cuts):
                yield from flush([table.slice(0, cuts[-1] + 1)])
                table = table.slice(cuts[-1] + 1)
            held, rows = [], 0
        held.append(table)
        rows += len(table)
    if held:
        yield from flush(held)


def references(df: DataFrame, id_col: str, time_col: str, fields: list[str]) -> DataFrame:
    """One row per distinct reference: ``(id, field, key, t)``, t in microseconds."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), loose_key(F.col(f)).alias("key")) for f in fields])
    t = F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(int(FOREVER)))
    return (
        df.where(F.coalesce(*fields).isNotNull())
        .select(F.col(id_col).alias("id"), t.alias("t"), F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("ref"))
        .select("id", "ref.field", "ref.key", "t")
        .distinct()
    )


def orphan_references(df: DataFrame, id_col: str, time_col: str, targets: list[Target], *, period_days: int = 7) -> DataFrame:
    """One row per orphan reference: ``(id, field, reason, t)``; ``reason`` is missing, late or deleted."""
    period_us = period_days * 86_400_000_000
    refs = references(df, id_col, time_col, [t.field for t in targets])
    period = F.when(F.col("t") == FOREVER, F.lit(int(FOREVER))).otherwise(F.floor(F.col("t") / F.lit(period_us)).cast("long"))
    pairs = refs.select("field", "key", period.alias("a")).distinct().select("field", "key", F.lit(True).alias("is_ref"), "a", F.lit(0).cast("long").alias("b"))
    sides = pairs
    for t in targets:
        # An unknown record time is later than any reference: the key is known, the row never valid.
        life = t.rows.select(
            F.lit(t.field).alias("field"),
            loose_key(F.col(t.key)).alias("key"),
            F.coalesce(F.unix_micros(F.col(t.recorded).cast("timestamp")), F.lit(int(FOREVER))).alias("from"),
            F.coalesce(F.unix_micros(F.col(t.deleted).cast("timestamp")), F.lit(int(FOREVER))).alias("b"),
        ).where(F.col("key").isNotNull())
        life = life.groupBy("field", "key", "b").agg(F.min("from").alias("a"))
        sides = sides.unionByName(life.select("field", "key", F.lit(False).alias("is_ref"), "a", "b"))
    ranged = sides.repartitionByRange("field", "key").sortWithinPartitions("field", "key")
    left = ranged.mapInArrow(
        lambda batches: _survivors(batches, period_us),
        "field string, key string, period long, first long, spans array<struct<a: bigint, b: bigint>>",
    ).select(F.col("field").alias("s_field"), F.col("key").alias("s_key"), F.col("period").alias("s_period"), "first", "spans")
    t = F.col("t")
    # A reference without time compares with the end of time: only rows never deleted hold then.
    valid = F.exists("spans", lambda s: (s["a"] <= t) & (s["a"] != FOREVER) & ((s["b"] == FOREVER) | (s["b"] > t)))
    reason = F.when(F.col("first").isNull(), "missing").when(F.col("first") > t, "late").when((F.col("first") == FOREVER), "late").otherwise("deleted")
    on = (F.col("field") == F.col("s_field")) & (F.col("key") == F.col("s_key")) & (period == F.col("s_period"))
    return refs.join(left, on).where(~valid).select("id", "field", reason.alias("reason"), "t")


def orphan_report(orphans: DataFrame, *, tables: dict[str, str], period: str = "week") -> DataFrame:
    """Counts per table, period of the reference's time and reason: ``(table_name, period, reason, n)``."""
    name = F.coalesce(*[F.when(F.col("field") == f, F.lit(t)) for f, t in tables.items()])
    at = F.when(F.col("t") != FOREVER, F.date_trunc(period, F.timestamp_micros("t")).cast("timestamp"))
    return orphans.groupBy(name.alias("table_name"), at.alias("period"), "reason").agg(F.count("*").alias("n"))
