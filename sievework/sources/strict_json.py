"""Strict JSON: bounds on bytes, depth and items, no repeated keys, no numbers that aren't finite.

One Arrow batch at a time; what isn't accepted comes out with its first fault and place instead of a value.

Defined results
---------------
* A null text is ``missing``; an empty one is ``malformed``.  An accepted text has no fault.
* ``flatten`` gives one row a leaf, an empty object or array being a leaf; texts that aren't accepted give none.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAF = pa.struct([("pointer", pa.string()), ("kind", pa.string()), ("value", pa.string())])


class _Refused(ValueError):
    pass


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        seen: set = set()
        raise _Refused("repeated_key:" + next(k for k, _ in pairs if k in seen or seen.add(k)))
    return found


def _constant(name: str):
    raise _Refused("not_finite:" + name)


def parse(text: str | None, *, most_bytes: int, most_depth: int, most_items: int) -> tuple[object, str | None]:
    """(value, None) or (None, fault)."""
    if text is None:
        return None, "missing"
    if len(text.encode("utf-8", "surrogatepass")) > most_bytes:
        return None, "too_many_bytes"
    try:
        value = json.loads(text, object_pairs_hook=_object, parse_constant=_constant)
    except _Refused as refused:
        return None, str(refused)
    except (ValueError, RecursionError):
        return None, "malformed"
    items, stack = 0, [(value, 1)]
    while stack:
        item, depth = stack.pop()
        items += 1
        if items > most_items:
            return None, "too_many_items"
        if depth > most_depth:
            return None, "too_deep"
        if isinstance(item, float) and not math.isfinite(item):
            return None, "not_finite:number"
        if isinstance(item, (dict, list)):
            stack += [(x, depth + 1) for x in (item.values() if isinstance(item, dict) else item)]
    return value, None


def _leaves(value: object, pointer: str = "") -> Iterator[tuple[str, str, str]]:
    if isinstance(value, (dict, list)) and value:
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        for k, v in pairs:
            yield from _leaves(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")
    else:
        kind = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(value)]
        yield pointer, kind, value if isinstance(value, str) else json.dumps(value)


def checked(df: DataFrame, keep: list[str], text: str, *, most_bytes: int = 16 << 20, most_depth: int = 64, most_items: int = 100_000) -> DataFrame:
    """``(*keep, fault, leaves)``: NULL and the value's leaves, or the first fault and NULL."""
    kinds, n = dict(df.dtypes), len(keep)
    head = ", ".join(f"{k} {kinds[k]}" for k in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t, most_bytes=most_bytes, most_depth=most_depth, most_items=most_items) for t in batch.column(n).to_pylist()]
            leaves = [None if fault else [dict(zip(("pointer", "kind", "value"), leaf)) for leaf in _leaves(value)] for value, fault in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([f for _, f in found], pa.string()), pa.array(leaves, pa.list_(_LEAF))], names=[*keep, "fault", "leaves"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(scan, f"{head}, fault string, leaves array<struct<pointer: string, kind: string, value: string>>")


def flatten(found: DataFrame, keep: list[str]) -> DataFrame:
    """One row a leaf of ``checked``: ``(*keep, pointer, kind, value)``."""
    return found.select(*keep, F.explode("leaves").alias("x")).select(*keep, "x.*")


def structural_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves that differ between two payloads of one key: ``(*keys, pointer, difference)``; both sides from ``flatten``."""
    a = left.select(*keys, "pointer", F.col("kind").alias("l_kind"), F.col("value").alias("l_value"))
    b = right.select(*keys, "pointer", F.col("kind").alias("r_kind"), F.col("value").alias("r_value"))
    kind = F.when(F.col("l_kind").isNull(), "added").when(F.col("r_kind").isNull(), "removed").when(F.col("l_kind") != F.col("r_kind"), "type_changed").when(F.col("l_value") != F.col("r_value"), "changed")
    return a.join(b, [*keys, "pointer"], "full").select(*keys, "pointer", kind.alias("difference")).where("difference is not null")
