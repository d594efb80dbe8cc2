"""Evaluation texts inside a training corpus: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the corpus are hashed where the texts are read; a filter of fixed size keeps all but those that some
item may have from leaving the scan, and the few texts that pass travel with their n-grams, so the corpus is read once.
Their document frequencies over the whole corpus choose the seeds: of the n-grams inside each ``window`` of item
words the rarest one.  A passage of ``window`` or more words in a row holds all n-grams of its windows, hence each
window's seed, and a window one of whose n-grams no document has can't have leaked; so no passage is lost.
Documents that share a seed with an item are aligned with it, whole words as letters, over the stretch around the
seeds.  The alignment scores copies that were edited or cut; the longest run without a gap is exact.

Defined results
---------------
* Words are the longest runs of letters and digits in any script, case ignored; the rest only separates.
* Null, empty and short texts hold no passage.  Items with equal texts are all reported.
* Rows repeated as a whole count once; an empty table on either side gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut

_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that item n-grams are shipped to the scan in (4 MB); what it lets pass is joined exactly.
FILTER_BITS = 1 << 25


def words_of(text: str | None) -> list[str]:
    return "\n".join(_WORD.findall(text)).lower().split("\n") if text else []


def _codes(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts in one array, and the offset of each text."""
    flat: list[int] = []
    offsets = [0]
    for text in texts:
        for w in words_of(text):
            if w:
                code = known.get(w)
                if code is None:
                    if len(known) > 200_000:
                        known.clear()
                    code = known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                flat.append(code)
        offsets.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(offsets, dtype=np.int64)


def gram_hashes(texts: list[str | None], n: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text ordinal, word position, hash) of every n-gram of words."""
    codes, offsets = _codes(texts, known)
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        h = h * _PRIME + codes[j : j + size]
    h ^= h >> np.uint64(29)
    text = np.searchsorted(offsets, np.arange(size), side="right") - 1
    whole = np.arange(size) + n <= offsets[text + 1]
    at = np.flatnonzero(whole)
    return text[at], at - offsets[text[at]], h[at].view(np.int64)


def grams(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``(id, pos, h)`` of the texts' n-grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 500):
                text, pos, h = gram_hashes(texts[low : low + 500], n, known)
                if len(h):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + low)), pa.array(pos.astype(np.int32)), pa.array(h)], names=["id", "pos", "h"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(scan, f"id {kind}, pos int, h long")


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & (FILTER_BITS - 1), (h >> 32) & (FILTER_BITS - 1)


def gram_filter(wanted: DataFrame) -> np.ndarray:
    """Bloom filter of ``h`` with two probes, as 64-bit words; of fixed size however many grams there are."""
    probe = F.explode(F.array(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftright("h", 32).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("at")
    bits = wanted.select(probe).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("bits"))
    rows = bits.toArrow()  # at most FILTER_BITS / 64 rows
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[np.asarray(rows["word"])] = np.asarray(rows["bits"])
    return words


def _maybe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _probes(h)
    return ((words[a >> 6] >> (a & 63)) & (words[b >> 6] >> (b & 63)) & 1).astype(bool)


def candidates(df: DataFrame, id_col: str, text_col: str, n: int, words: np.ndarray) -> DataFrame:
    """``(id, text, pos, h)``: texts with an n-gram that the filter lets pass, and those n-grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), 500):
                text, pos, h = gram_hashes(texts[low : low + 500], n, known)
                keep = _maybe(words, h)
                text, pos, h = text[keep], pos[keep], h[keep]
                if len(h):
                    rows, counts = np.unique(text, return_counts=True)
                    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                    at = pa.array(rows + low)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(h))], names=["id", "text", "pos", "h"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(scan, f"id {kind}, text string, pos array<int>, h array<long>")


def align(document: list[str], item: list[str], *, match: int = 2, mismatch: int = -3, gap: int = -2) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (best score, longest run without a gap, begin and end of that run in the document)."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    d = np.array([number.get(w, -1) for w in document], dtype=np.int32)
    n = len(d)
    slope = np.arange(n, dtype=np.int64) * -gap
    row = np.zeros(n + 1, dtype=np.int64)
    run = np.zeros(n + 1, dtype=np.int32)
    best = longest = at = 0
    for w in item:
        equal = d == number[w]
        score = np.maximum(row[:-1] + np.where(equal, match, mismatch), row[1:] + gap)
        np.maximum(score, 0, out=score)
        score = np.maximum.accumulate(score + slope) - slope  # gaps along the document
        run[1:] = np.where(equal, run[:-1] + 1, 0)
        row[1:] = score
        best = max(best, int(score.max(initial=0)))
        k = int(run.argmax())
        if run[k] > longest:
            longest, at = int(run[k]), k
    return best, longest, at - longest, at


def leaked(docs: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, doc_text: str, item_text: str, n: int = 8, window: int = 13, shared: int = 1) -> DataFrame:
    """Aligned candidates: ``(doc_id, item_id, score, coverage, longest_run, run_start)``.

    ``coverage`` is the score as a share of a whole copy's score; ``run_start`` counts words of the document.
    With ``window`` = ``n`` every shared n-gram is a seed; ``shared`` is how many of them a pair must have to be aligned.
    """
    if window < n:
        raise ValueError("a window holds at least one n-gram")
    own = cut(grams(items, item_id, item_text, n).distinct())
    wanted = own.select("h").distinct()
    found = cut(candidates(docs, doc_id, doc_text, n, gram_filter(wanted)))
    hits = found.select("id", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("id", "x.pos", "x.h").join(wanted, "h", "left_semi").distinct()
    frequency = hits.groupBy("h").agg(F.count("*").alias("df"))
    ahead = Window.partitionBy("id").orderBy("pos").rangeBetween(0, window - n)
    rated = own.join(frequency, "h")
    rated = rated.withColumn("inside", F.count("*").over(ahead)).withColumn("seed", F.min(F.struct("df", "h")).over(ahead))
    seeds = rated.where(F.col("inside") == window - n + 1).select(F.col("id").alias("item"), F.col("seed.h").alias("h")).distinct()
    pairs = hits.join(seeds, "h").groupBy("id", "item").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n")).where(F.col("n") >= shared)
    pairs = pairs.select(F.col("id").alias("p_doc"), F.col("item").alias("p_item"), "low", "high")
    texts = found.select(F.col("id").alias(doc_id), F.col("text").alias("d_text")).join(pairs, F.col(doc_id) == F.col("p_doc"))
    texts = texts.join(items.select(F.col(item_id), F.col(item_text).alias("i_text")), F.col(item_id) == F.col("p_item"))
    kinds = {**dict(docs.dtypes), **dict(items.dtypes)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, item, low, high in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                have, want = [w for w in words_of(text) if w], [w for w in words_of(item) if w]
                start = max(0, low - 2 * len(want))
                score, longest, begin, _ = align(have[start : high + n + 2 * len(want)], want)
                out.append((score, score / (2 * len(want)), longest, start + begin))
            score, coverage, longest, begin = map(list, zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.int32()), pa.array(coverage, pa.float64()), pa.array(longest, pa.int32()), pa.array(begin, pa.int32())],
                names=[doc_id, item_id, "score", "coverage", "longest_run", "run_start"],
            )

    schema = f"{doc_id} {kinds[doc_id]}, {item_id} {kinds[item_id]}, score int, coverage double, longest_run int, run_start int"
    return texts.select(doc_id, item_id, "d_text", "i_text", "low", "high").mapInArrow(scan, schema)
