"""Several values packed in one field: split cells into one value per row, position kept.

The scan works on the Arrow string buffer of a whole batch at once.  Quote characters are the only
events that carry state; their three-state automaton (outside, in double quotes, in single quotes)
is resolved for all cells together by a prefix composition of transition tables.  Everything else is
byte masks: runs of value bytes outside quotes and the spans between an opening and a closing quote.
Child offsets make a list array per cell, which is flattened with its parent ordinals.

Defined results
---------------
* A null, empty or blank cell gives no row; an empty quoted element gives no row and takes no place.
* A quote that never closes takes the rest of its cell.
* Inside quotes a backslash escapes the next character and a doubled quote stands for one quote.
* An escape nobody defines (``\\q``) keeps both characters.
* Repeated rows of one cell come out once; other columns of the input are ignored.  Ids are expected to name one cell each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_OUT, _DQ, _SQ = 0, 1, 2
# Next state of (outside, in "", in '') at an unescaped ", an escaped ", an unescaped ', an escaped '.
_STEP = np.array([[_DQ, _OUT, _SQ], [_DQ, _DQ, _SQ], [_SQ, _DQ, _OUT], [_SQ, _DQ, _SQ]], dtype=np.int8)
_VALUE = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-/":
    _VALUE[_c] = True
_LETTER = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LETTER[_c] = True
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "a": "\a", "/": "/", "\\": "\\", '"': '"', "'": "'"}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|.)", re.S)


def _unescape(text: str, quote: str) -> str:
    def one(m: re.Match) -> str:
        body = m.group(1)
        if len(body) > 1:
            code = int(body[1:], 16)
            return chr(code) if code < 0x110000 else m.group(0)
        return _ESCAPES.get(body, m.group(0))

    parts = text.split(quote * 2)
    text = quote.join(_ESCAPE.sub(one, p) for p in parts) if len(parts) > 1 else _ESCAPE.sub(one, text)
    # Two halves of a surrogate pair written as two escapes are one character; a lone half can't be stored.
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", text) else text


def _states(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State after each quote event.  ``first`` marks the first event of a cell, whose table ignores what came before."""
    tables = _STEP[kind]
    tables[first] = tables[first][:, [_OUT]]
    known = first.copy()  # tables that no longer depend on earlier events
    shift = 1
    while shift < len(tables) and not known.all():
        earlier = tables[:-shift]
        todo = ~known[shift:]
        later = tables[shift:].copy()
        later[todo] = np.take_along_axis(later[todo], earlier[todo].astype(np.intp), axis=1)
        known = np.concatenate([known[:shift], known[shift:] | known[:-shift]])
        tables = np.concatenate([tables[:shift], later])
        shift *= 2
    return tables[:, 0]


def _escaped(data: np.ndarray, at: np.ndarray, cell_start: np.ndarray) -> np.ndarray:
    """Whether an odd number of backslashes stands directly before each position, within its cell."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    back = np.flatnonzero(data == 0x5C)
    if not len(back):
        return np.zeros(len(at), dtype=bool)
    run = np.cumsum(np.diff(back, prepend=back[0] - 2) != 1)  # id of the run of backslashes
    start = back[np.r_[True, np.diff(run) != 0]][run - 1]
    k = np.searchsorted(back, at - 1)
    hit = (k < len(back)) & (back[np.minimum(k, len(back) - 1)] == at - 1) & (at - 1 >= cell_start)
    begin = np.maximum(start[np.minimum(k, len(back) - 1)], cell_start)
    return hit & (((at - begin) & 1) == 1)


def split_cells(cells: pa.Array) -> pa.ListArray:
    """The values of each cell, in order, as a list array of the same length (null cells give empty lists)."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    if not (pa.types.is_large_string(cells.type)):
        cells = cells.cast(pa.large_string())
    n = len(cells)
    if n == 0:
        return pa.array([], pa.list_(pa.string()))
    _, off, buf = cells.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[cells.offset : cells.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    start, end = offsets[:-1].copy(), offsets[1:].copy()
    valid = np.asarray(cells.is_valid())
    end[~valid] = start[~valid]
    size = len(data)

    # Quote events and their states.
    at = np.flatnonzero((data == 0x22) | (data == 0x27))
    cell = np.searchsorted(offsets, at, side="right") - 1
    keep = valid[cell] if len(at) else np.zeros(0, bool)
    at, cell = at[keep], cell[keep]
    single = data[at] == 0x27
    esc = _escaped(data, at, start[cell])
    first = np.r_[True, cell[1:] != cell[:-1]] if len(at) else np.zeros(0, bool)
    after = _states((single * 2 + esc).astype(np.intp), first) if len(at) else np.zeros(0, np.int8)
    before = np.where(first, _OUT, np.r_[np.int8(_OUT), after[:-1]]) if len(at) else after
    opens = (before == _OUT) & (after != _OUT)
    closes = (before != _OUT) & (after == _OUT)

    # Spans of quoted elements: an opening with the next closing of its cell, else with the cell's end.
    o_at, o_cell, o_single = at[opens], cell[opens], single[opens]
    c_at, c_cell = at[closes], cell[closes]
    k = np.searchsorted(c_at, o_at)
    has = (k < len(c_at)) & (c_cell[np.minimum(k, max(len(c_at) - 1, 0))] == o_cell) if len(c_at) else np.zeros(len(o_at), bool)
    q_end = np.where(has, c_at[np.minimum(k, max(len(c_at) - 1, 0))] if len(c_at) else 0, end[o_cell])
    q_start = o_at + 1
    # A quote that closes and opens again at once is a doubled one: its spans are one element.
    joined = np.r_[False, (o_at[1:] == q_end[:-1] + 1) & has[:-1] & (o_cell[1:] == o_cell[:-1]) & (o_single[1:] == o_single[:-1])] if len(o_at) else np.zeros(0, bool)
    head = np.flatnonzero(~joined)
    tail = np.r_[head[1:] - 1, len(o_at) - 1] if len(head) else head
    q_doubled = (tail > head) if len(head) else np.zeros(0, bool)
    q_start, q_cell, q_single, q_end = q_start[head], o_cell[head], o_single[head], q_end[tail]

    # Bytes inside quotes, the quotes themselves and bytes under null cells aren't plain values.
    plain = _VALUE[data]
    leave = np.where(has, c_at[np.minimum(k, max(len(c_at) - 1, 0))] + 1, end[o_cell]) if len(c_at) else end[o_cell]
    depth = np.bincount(o_at, minlength=size + 1) - np.bincount(leave, minlength=size + 1)
    plain &= np.cumsum(depth[:-1]) == 0
    lead = q_start - 2  # the byte before an opening quote
    lead_ok = (lead >= start[q_cell]) if len(lead) else np.zeros(0, bool)
    lead = lead[lead_ok]
    plain[lead[_LETTER[data[lead]]]] = False
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    begins = plain & np.r_[True, ~plain[:-1]] | plain & edge[:-1] if size else plain
    p_start = np.flatnonzero(begins)
    ends = plain & np.r_[~plain[1:], True] | plain & edge[1:] if size else plain
    p_end = np.flatnonzero(ends) + 1
    p_cell = np.searchsorted(offsets, p_start, side="right") - 1
    live = valid[p_cell] if len(p_cell) else np.zeros(0, bool)
    p_start, p_end, p_cell = p_start[live], p_end[live], p_cell[live]

    s = np.r_[p_start, q_start]
    e = np.r_[p_end, q_end]
    c = np.r_[p_cell, q_cell]
    quoted = np.r_[np.zeros(len(p_start), np.int8), np.where(q_single, 2, 1).astype(np.int8)]
    doubled = np.r_[np.zeros(len(p_start), bool), q_doubled]
    filled = e > s
    order = np.flatnonzero(filled)[np.argsort(s[filled], kind="stable")]
    s, e, c, quoted, doubled = s[order], e[order], c[order], quoted[order], doubled[order]

    length = e - s
    out = np.zeros(len(s) + 1, dtype=np.int64)
    np.cumsum(length, out=out[1:])
    take = np.repeat(s - out[:-1], length) + np.arange(out[-1])
    values = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(out.tobytes()), pa.py_buffer(np.ascontiguousarray(data[take]).tobytes())).cast(pa.string())
    # Only quoted elements that hold a backslash or a doubled quote are touched one by one.
    back = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(data == 0x5C, out=back[1:])
    odd = np.flatnonzero((quoted > 0) & (doubled | (back[e] > back[s])))
    if len(odd):
        mended = pa.array([_unescape(v, "'" if quoted[i] == 2 else '"') for i, v in zip(odd, values.take(pa.array(odd)).to_pylist())], pa.string())
        values = pc.replace_with_mask(values, pa.array(np.isin(np.arange(len(s)), odd)), mended)
    child = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(c, minlength=n), out=child[1:])
    return pa.ListArray.from_arrays(pa.array(child), values)


def split_packed(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row per value: ``(<id_col>, field, pos, val)``; ``fields`` maps a column to the name it gets in ``field``.

    The only shuffle removes redelivered cells and carries them packed, which is the smaller form; splitting is narrow.
    """
    columns = list(fields)
    kind = dict(df.select(id_col).dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, column in enumerate(columns, 1):
                lists = split_cells(batch.column(i))
                parent = np.asarray(pc.list_parent_indices(lists))
                if not len(parent):
                    continue
                begin = np.asarray(lists.offsets)[:-1]
                pos = (np.arange(len(parent)) - begin[parent]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(parent)), pa.array([fields[column]] * len(parent), pa.string()), pa.array(pos, pa.int32()), lists.flatten()],
                    names=[id_col, "field", "pos", "val"],
                )

    return df.select(id_col, *columns).distinct().mapInArrow(scan, f"{id_col} {kind}, field string, pos int, val string")
