"""Schemas that drift between files: rescue-column ingestion, promotion and a list of every change.

``ingest`` enforces a target schema on records that arrive as JSON objects.  A field the target knows, in
the JSON type the target expects, goes to its typed column.  Everything else (unknown fields, values of
another type, records that are no object) is preserved as JSON in ``_rescued``.  ``_seen`` keeps which
fields the record had and in which type, so no information of the record is lost.  ``promote`` fills typed columns from
rescued values: by cast, from a ``value`` member, or from a field approved as another name of the column.

``schema_changes`` runs the same ingestion narrowly: of each record it keeps which fields it has and in which
JSON type, and of the fields that a file lost or won a 128-bit mark of the value.  Files are reduced to one row
before anything is compared; marks are combined to a signature over the records of both files, and fields are a
renaming if their signatures meet, so no pair of fields is ever formed that doesn't agree.

Defined results
---------------
* Null, malformed and non-object records have no fields; they are kept under ``_corrupt`` in ``_rescued``.
* A field that is null in all records of a file has no type there and causes no ``type_changed``.
* Integers and other numbers mixed in one file make ``number``; other mixtures are one joint type.
* Redelivered or corrected records of one key in one file: the latest arrival counts for values, and
  every row counts for which fields the file has.
* A renaming needs at least one record that stands in both files.  If several fields agree, each is used
  once, by name order; the rest are ``removed`` and ``added``.
* The first file of a stream reports nothing; an empty table reports nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAP = "map<string,variant>"
#: JSON type names; a file's set of types is a bit set over them.
TYPES = ("string", "integer", "number", "boolean", "array", "object")
_NATURAL = {"string": "string", "bigint": "integer", "double": "number", "boolean": "boolean", "array<string>": "array"}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_BIG = 1 << 63


def _kind(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def _fits(value: object, kind: str) -> bool:
    if kind == "bigint":
        return -_BIG <= value < _BIG
    return all(isinstance(x, str) for x in value) if kind == "array<string>" else True


def _rows(texts: list[str | None], target: dict[str, str]) -> tuple[list[dict], list, list]:
    typed, seen, rescued = [], [], []
    for text in texts:
        row, kinds, left = {}, [], {}
        try:
            record = json.loads(text) if text is not None else {}
        except (ValueError, RecursionError):
            record = None
        if isinstance(record, dict):
            for field, value in record.items():
                kind = _kind(value)
                kinds.append((field, kind))
                want = target.get(field)
                if want and (kind is None or (kind == _NATURAL[want] and _fits(value, want))):
                    row[field] = value
                else:
                    left[field] = value
        else:
            left["_corrupt"] = text
        typed.append(row)
        seen.append(kinds)
        rescued.append(json.dumps(left, sort_keys=True, ensure_ascii=False) if left else None)
    return typed, seen, rescued


def ingest(df: DataFrame, record: str, target: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns, one column a target field, ``_seen`` (field to type) and ``_rescued`` (JSON text).

    One Arrow batch at a time; ``keep`` columns pass through untouched.
    """
    kinds = dict(df.select(*keep).dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{f}` {t}" for f, t in target.items()), "_seen map<string,string>", "_rescued string"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed, seen, rescued = _rows(batch.column(len(keep)).to_pylist(), target)
            columns = [*batch.columns[: len(keep)], *(pa.array([r.get(f) for r in typed], _ARROW[t]) for f, t in target.items())]
            columns += [pa.array(seen, pa.map_(pa.string(), pa.string())), pa.array(rescued, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *target, "_seen", "_rescued"])

    return df.select(*keep, record).mapInArrow(scan, schema)


def promote(df: DataFrame, target: dict[str, str], approved: dict[str, list[str]]) -> DataFrame:
    """Replay rescued values into typed columns: castable ones, those of a ``value`` member and approved other names.

    What was replayed without loss leaves ``_rescued``, an object only its ``value``; the rest stays there: names that were
    not used, values that another name or the typed column outran, and values that the column doesn't hold exactly.
    """
    rescued = F.try_variant_get(F.try_parse_json("_rescued"), "$", _MAP)
    df = df.withColumn("_r", rescued)
    for field, kind in target.items():
        tries = [F.when(F.col(field).isNotNull(), _replayed(F.col(field), None, False, F.lit(True)))]
        for name in [field, *approved.get(field, [])]:
            item = F.try_element_at("_r", F.lit(name))
            for path in ("$", "$.value"):
                text, value = F.trim(F.try_variant_get(item, path, "string")), F.try_variant_get(item, path, kind)
                if kind == "bigint":  # whole numbers, also those spelled with a sign or blanks; never a part of a number
                    value = F.when(text.try_cast("decimal(38,9)") == F.coalesce(value, text.try_cast("bigint")), F.coalesce(value, text.try_cast("bigint")))
                exact = {"double": text.try_cast("decimal(38,18)") == value.try_cast("decimal(38,18)"), "boolean": F.lower(text) == value.cast("string")}.get(kind, F.lit(True))
                tries.append(F.when(value.isNotNull(), _replayed(value, name, path != "$", F.coalesce(exact, F.lit(False)))))
        df = df.withColumn(f"_p_{field}", F.coalesce(*tries))
    chosen = [F.col(f"_p_{field}") for field in target]
    whole = F.array_compact(F.array(*[F.when(c["exact"] & ~c["inner"], c["name"]) for c in chosen]))
    inner = F.array_compact(F.array(*[F.when(c["exact"] & c["inner"], c["name"]) for c in chosen]))
    df = df.withColumns({"_whole": whole, "_inner": inner})
    beside = lambda v: F.map_filter(F.try_variant_get(v, "$", _MAP), lambda k, _: k != "value")
    left = F.map_filter("_r", lambda k, v: ~F.array_contains("_whole", k) & ~(F.array_contains("_inner", k) & (F.size(beside(v)) == 0)))
    left = F.transform_values(left, lambda k, v: F.when(F.array_contains("_inner", k), F.parse_json(F.to_json(beside(v), {"ignoreNullFields": "false"}))).otherwise(v))
    corrupt = F.when(F.col("_r").isNull(), F.col("_rescued"))
    df = df.withColumn("_rescued", F.coalesce(corrupt, F.nullif(F.to_json(left), F.lit("{}"))))
    return df.withColumns({field: F.col(f"_p_{field}.value") for field in target}).drop("_r", "_whole", "_inner", *[f"_p_{field}" for field in target])


def _replayed(value: Column, name: str | None, inner: bool, exact: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(name).cast("string").alias("name"), F.lit(inner).alias("inner"), exact.alias("exact"))


_BITS = {str: 1, int: 2, float: 4, bool: 8, list: 16, dict: 32, type(None): 0}
_TRUTH = {"true", "false"}
_WHOLE = re.compile(r"[+-]?[0-9]+", re.ASCII)


def _cell_bits(text: str | None) -> int:
    """Type of a text cell by its form; an empty one has none."""
    if not text:
        return 0
    plain = text.strip(" ")
    return 8 if plain.lower() in _TRUTH else 2 if _WHOLE.fullmatch(plain) else 1


def _record(body: str | None) -> dict:
    try:
        record = json.loads(body) if body is not None else None
    except (ValueError, RecursionError):
        record = None
    return record if isinstance(record, dict) else {}


def type_of(bits: Column) -> Column:
    """Name of a file's set of types, NULL for none."""
    names = [F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(TYPES)]
    return F.when(bits == 0b110, "number").when(bits != 0, F.concat_ws("|", *names))


def _shapes(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Fields of each file in the batch, by the shapes of its records: ``(*key, seq, fields)``, fields in order with the bits of their types."""
    for batch in batches:
        bodies, texts, heads = (batch.column(keys + i).to_pylist() for i in (1, 2, 3))
        files = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        first: dict[tuple, int] = {}
        shapes: set[tuple] = set()
        for i, key in enumerate(files):
            at = first.setdefault(key, i)
            if heads[i] is not None:
                shapes.add((at, tuple(heads[i]), (0,) * len(heads[i])))
            record = _record(bodies[i])
            if record:
                kinds = tuple(map(_cell_bits, record.values())) if texts[i] else tuple([_BITS[type(v)] for v in record.values()])
                shapes.add((at, tuple(record), kinds))
        found: dict[int, dict[str, int]] = {at: {} for at in first.values()}
        for at, fields, kinds in shapes:
            file = found[at]
            for field, bits in zip(fields, kinds):
                if not texts[at] or not field.startswith("_cell_"):
                    file[field] = file.get(field, 0) | bits
        flat = [it for file in found.values() for it in sorted(file.items())]
        offsets = pa.array([0, *accumulate(map(len, found.values()))], pa.int32())
        fields = pa.StructArray.from_arrays([pa.array([f for f, _ in flat], pa.string()), pa.array([b for _, b in flat], pa.int32())], names=["field", "bits"])
        at = pa.array(list(found), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(keys + 1)), pa.ListArray.from_arrays(offsets, fields)], names=[*batch.schema.names[: keys + 1], "fields"])


def _mark(record: str, value: object) -> tuple[int, int]:
    """128 bits of a value in a record; an absent key equals null."""
    if value is None:
        return 0, 0
    text = value if isinstance(value, str) else repr(value) if isinstance(value, (int, float)) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    mark = blake2b(f"{len(record)}:{record}{type(value).__name__}:{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True)


_CELL = pa.struct([("field", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def _marks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Marks of the fields a file lost (beside its next file) or won: ``(*stream, into, record, is_new, arrived, cells)``."""
    for batch in batches:
        at, new, fields, a, b, offsets = [], [], [], [], [], [0]
        records, bodies, texts, won, lost = (batch.column(keys + i).to_pylist() for i in (1, 3, 4, 5, 6))
        for i, body in enumerate(bodies):
            values = _record(body)
            for is_new, wanted in ((True, won[i]), (False, lost[i])):
                if wanted:
                    at.append(i)
                    new.append(is_new)
                    for f in wanted:
                        value = values.get(f)
                        x, y = _mark(records[i], None if value == "" and texts[i] else value)
                        fields.append(f)
                        a.append(x)
                        b.append(y)
                    offsets.append(len(fields))
        take = pa.array(at, pa.int64())
        into = pc.if_else(pa.array(new, pa.bool_()), batch.column(keys - 1).take(take), batch.column(keys + 7).take(take))
        cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(_CELL)))
        columns = [*(batch.column(i).take(take) for i in range(keys - 1)), into, batch.column(keys + 1).take(take), pa.array(new, pa.bool_()), batch.column(keys + 2).take(take), cells]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: keys - 1], "into", "record", "is_new", "arrived", "cells"])


def schema_changes(df: DataFrame, *, stream: list[str], run: str, sequence: str, record: str, arrived: str, body: str, text: str | None = None, header: str | None = None, file_type=type_of) -> DataFrame:
    """Changes between consecutive files of a stream: ``(*stream, run, old_field, new_field, change_kind)``.

    ``df`` has the records as delivered: ``record`` is NULL where a record has no identity, ``body`` is its JSON object.
    Where ``text`` is true the values are text cells, typed by their form; ``header`` names fields that a file has apart
    from its records.  ``file_type`` turns the bits of ``TYPES`` found in a file into the type that is compared.

    Two narrow Arrow passes over the records.  The first reduces each file to its fields and their types where it is
    read; the second reads, of files that both lost and won fields, the values of those fields only.  What is between
    them is one row a file.  Equal values of a lost and a won field are equal signatures, so they meet by a key.
    """
    kinds = dict(df.dtypes)
    keys = [*stream, run]
    plain = lambda c, other: (F.col(c) if c else F.lit(other))
    rows = df.select(
        *keys, F.col(sequence).alias("seq"), F.col(record).cast("string").alias("record"), F.col(arrived).alias("arrived"), F.col(body).alias("body"),
        plain(text, False).alias("text"), plain(header, None).cast("array<string>").alias("header"),
    )
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    n = len(keys)
    shapes = rows.select(*keys, "seq", "body", "text", "header").mapInArrow(lambda batches: _shapes(batches, n), f"{head}, seq {kinds[sequence]}, fields array<struct<field: string, bits: int>>")
    # Batches of one file mostly agree on its fields: what is collected is distinct, and merged only where they differ.
    parts = shapes.groupBy(*keys).agg(F.min("seq").alias("seq"), F.collect_set("fields").alias("sets"))
    merged = F.transform(
        F.array_distinct(F.transform(F.flatten("sets"), lambda x: x["field"])),
        lambda f: F.struct(f.alias("field"), F.aggregate(F.filter(F.flatten("sets"), lambda x: x["field"] == f), F.lit(0), lambda acc, x: acc.bitwiseOR(x["bits"])).alias("bits")),
    )
    parts = parts.select(*keys, "seq", F.when(F.size("sets") == 1, F.element_at("sets", 1)).otherwise(merged).alias("fields"))
    files = parts.withColumn("fields", F.transform("fields", lambda f: F.struct(f["field"].alias("field"), F.coalesce(file_type(f["bits"]), F.lit("")).alias("type"))))
    order = Window.partitionBy(*stream).orderBy("seq", run)
    names = F.transform("fields", lambda f: f["field"])
    typed = F.transform("fields", lambda f: F.concat(f["field"], F.lit("\x00"), f["type"]))
    files = files.select(*keys, "seq", names.alias("names"), typed.alias("typed"))
    for out, c, move in (("was", "names", F.lag), ("was_typed", "typed", F.lag), ("next", "names", F.lead), ("next_run", run, F.lead)):
        files = files.withColumn(out, move(c).over(order))
    won, lost = F.array_except("names", "was"), F.array_except("was", "names")
    other = F.transform(F.array_except("typed", "was_typed"), lambda t: F.struct(F.split(t, "\x00")[0].alias("field"), F.split(t, "\x00")[1].alias("type")))
    old_type = lambda f: F.filter("was_typed", lambda w: w.startswith(F.concat(f, F.lit("\x00"))) & ~w.endswith("\x00"))
    retyped = F.filter(other, lambda f: (f["type"] != "") & (F.size(old_type(f["field"])) > 0))
    steps = files.select(
        *keys, "next_run", won.alias("won"), lost.alias("lost"), F.transform(retyped, lambda f: f["field"]).alias("retyped"),
        F.when((F.size(won) > 0) & (F.size(lost) > 0), won).alias("ask_won"),
        F.when((F.size(F.array_except("next", "names")) > 0) & (F.size(F.array_except("names", "next")) > 0), F.array_except("names", "next")).alias("ask_lost"),
    )
    asked = steps.where("ask_won is not null or ask_lost is not null").select(*[F.col(k).alias(f"q_{k}") for k in keys], "ask_won", "ask_lost", "next_run")
    on = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"q_{k}")), stream, F.col(run) == F.col(f"q_{run}"))
    held = rows.where("record is not null").join(asked, on).select(*keys, "seq", "record", "arrived", "body", "text", "ask_won", "ask_lost", "next_run")
    streams = ", ".join(f"{k} {kinds[k]}" for k in stream)
    cells = "array<struct<field: string, a: long, b: long>>"
    marked = held.mapInArrow(lambda batches: _marks(batches, n), f"{streams + ', ' if stream else ''}into {kinds[run]}, record string, is_new boolean, arrived {kinds[arrived]}, cells {cells}")
    last = lambda side: F.max(F.when(side, F.struct("arrived", "cells")))["cells"]
    both = marked.groupBy(*stream, "into", "record").agg(last(F.col("is_new")).alias("new"), last(~F.col("is_new")).alias("old")).where("new is not null and old is not null")
    side = lambda c, is_new: F.transform(c, lambda x: F.struct(F.lit(is_new).alias("is_new"), x["field"].alias("field"), x["a"].alias("a"), x["b"].alias("b")))
    told = both.select(*stream, "into", F.inline(F.concat(side("new", True), side("old", False))))
    moved = lambda c, is_new: F.transform(c, lambda f: F.struct(F.lit(is_new).alias("is_new"), f.alias("field"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")))
    base = steps.select(*stream, F.col(run).alias("into"), F.inline(F.concat(moved("won", True), moved("lost", False))))
    signed = base.unionByName(told).groupBy(*stream, "into", "is_new", "field").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("field"))))
    met = signed.groupBy(*stream, "into", "a", "b").agg(listed(~F.col("is_new")).alias("old"), listed(F.col("is_new")).alias("new"))
    pairs = F.when(F.col("a").isNull(), 0).otherwise(F.least(F.size("old"), F.size("new")))
    change = lambda x, y, kind: F.struct(x.alias("old_field"), y.alias("new_field"), F.lit(kind).alias("change_kind"))
    head_of = lambda c: F.slice(c, 1, F.col("p"))
    rest = lambda c: F.slice(F.col(c), F.col("p") + 1, F.size(c))
    empty = F.lit("")
    found = F.concat(
        F.transform(F.arrays_zip(head_of("old").alias("o"), head_of("new").alias("n")), lambda z: change(z["o"], z["n"], "renamed")),
        F.transform(rest("old"), lambda f: change(f, empty, "removed")), F.transform(rest("new"), lambda f: change(empty, f, "added")),
    )
    moves = met.withColumn("p", pairs).select(*stream, F.col("into").alias("run"), F.inline(found))
    return moves.unionByName(steps.select(*stream, F.col(run).alias("run"), F.inline(F.transform("retyped", lambda f: change(f, f, "type_changed")))))


def with_header(df: DataFrame, cells: list[str], *, stream: list[str], run: str, line: str, arrived: str, record: str, rest: list[str]) -> DataFrame:
    """Lines of files read without a header -> ``(*stream, run, record, arrived, *rest, record_json, header)``.

    Cells are named by their file's own line 0, trimmed, without byte-order mark and in lower case; cells
    under no name are kept as ``_cell_<n>``; of repeated names the first keeps its name.  The header comes out
    as a row too, with a null ``record_json`` and its names in ``header``.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, "^[\\s\\uFEFF]+|[\\s\\uFEFF]+$", ""))
    head = df.where(F.col(line) == 0).groupBy(*stream, run).agg(F.max_by(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cells]), F.struct(arrived, F.concat_ws("\x1f", *cells))).alias("_h"))
    # What a header says is worked out once a file, not once a line.
    named = F.transform("_h", lambda c, i: F.when((c == "") | (F.array_position("_h", c) != i + 1), F.concat(F.lit("_cell_"), i)).otherwise(c))
    head = head.select(*[F.col(s).alias(f"h_{s}") for s in stream], F.col(run).alias("h_run"), F.transform("_h", clean).alias("_h"))
    head = head.select(*[f"h_{s}" for s in stream], "h_run", named.alias("_n")).withColumn("_own", F.filter("_n", lambda c: ~c.startswith("_cell_")))
    on = reduce(lambda a, s: a & F.col(s).eqNullSafe(F.col(f"h_{s}")), stream, F.col(run) == F.col("h_run"))
    texts = F.array(*[F.nullif(F.col(c), F.lit("")) for c in cells])
    body = F.map_filter(F.map_from_arrays("_n", texts), lambda k, v: v.isNotNull() | ~k.startswith("_cell_"))
    is_head = F.col(line) == 0
    # Null cells must survive: an object made of a map drops none of its keys.
    return df.join(head, on).select(*stream, run, arrived, record, *rest, F.when(~is_head, F.to_json(body, {"ignoreNullFields": "false"})).alias("record_json"), F.when(is_head, F.col("_own")).alias("header"))
