"""Encoding of a corpus with a public byte-level BPE vocabulary, by a table of distinct words.

Texts are split into words by the vocabulary's pattern inside the JVM.  Merges never cross a word, so every
distinct word is encoded once and the ids are joined back by position.

Words are Zipf-distributed.  The words that make up at least one in ``HOT_WORDS`` of all occurrences are, by
counting, at most ``HOT_WORDS`` many; of these the ones of up to ``HOT_CHARS`` characters are shipped to the tasks, a
size bounded for any corpus (each has at most 4 * HOT_CHARS bytes and as many ids).  They are replaced where the text
is read, so a document travels as its ids, with a gap for each cold word.  Cold words are joined with the table by
shuffle, and none of them can be a skewed key unless it is longer than ``HOT_CHARS``; AQE splits those.  Documents
and the ids of their cold words meet once, sorted by id and position, and are merged as a stream.

Defined results
---------------
* Null and empty texts give the empty list.  Strings that look like special tokens are ordinary text.
* Row ids are expected to be unique; rows repeated as a whole come out once.
* Invalid UTF-8 can't occur in a Spark string that was written as text; what a string column holds is encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import cut

#: Where the vocabulary files lie unless a caller names another folder.
VOCABULARIES = "/opt/tokenizers"
HOT_WORDS = 50_000
HOT_CHARS = 32

# White space as Unicode defines it, spelled out because Java's \s knows ASCII only.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split pattern of the byte-level vocabularies (fixed value), in Java's syntax; frequent alternatives come first, which changes nothing as they exclude each other.
WORD_PATTERN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for Python's ``regex``, as the vocabularies publish it (fixed value).
PYTHON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def read_ranks(path: str) -> bytes:
    """The vocabulary file, a few hundred KB; read on the driver and shipped with the task."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(blob: bytes):
    key = hash(blob)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        # Words are already split: the pattern takes each as a whole.
        _encoders[key] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encode_words(words: DataFrame, ranks: bytes) -> DataFrame:
    """``(word, n)`` -> ``(word, n, ids)``, each row encoded once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks).encode_ordinary
        for batch in batches:
            ids = pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(scan, "word string, n long, ids array<int>")


#: Ends each word on its way to Python: a code point that is no character, so a text that holds it is split in Python.
_END = "\ufdd0"


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, words)``: the words, each with its end marked, or the text where the JVM's Unicode tables are too old for a character of it."""
    newer = (F.octet_length("text") != F.length("text")) & F.col("text").rlike(r"\p{Cn}")
    split = F.when(~newer, F.regexp_replace("text", WORD_PATTERN, "$0" + _END))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("words", split)
    return rows.select("id", F.when(F.col("words").isNull(), F.col("text")).alias("text"), "words")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids and word lists of the texts of ``_texts``; Python's tables split what the JVM left."""
    import regex

    find = regex.compile(PYTHON_PATTERN).findall
    for batch in batches:
        if batch.column(2).null_count:
            left = batch.column(2).is_null()
            newer = batch.select([0, 1]).filter(left)
            yield newer.column(0), pa.array([find(t) for t in newer.column(1).to_pylist()], pa.list_(pa.string()))
            batch = batch.filter(pc.invert(left))
        if batch.num_rows:
            parts, offsets = _spans(pc.split_pattern(batch.column(2), _END))
            words = parts.filter(pc.not_equal(parts, ""))  # what follows the last end of each text
            yield batch.column(0), pa.ListArray.from_arrays(pa.array((offsets - np.arange(len(offsets))).astype(np.int32)), words)


def _spans(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words in one array, and the offset of each list in it."""
    offsets = np.asarray(words.offsets)
    return words.flatten(), (offsets - offsets[0]).astype(np.int64)


def word_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(word, n)``: distinct words of all texts; each batch is counted where it is read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _words(batches):
            counts = pc.value_counts(words.flatten())
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    return _texts(df, id_col, text_col).mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (pos -1) and their cold words in order, whole rows repeated or not -> ``(id, ids)``."""
    held: pa.Table | None = None

    def merged(table: pa.Table) -> pa.RecordBatch:
        ids, pos = table["id"].combine_chunks(), np.asarray(table["pos"])
        equal = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True)
        known = np.asarray(ids.is_valid())
        same = np.asarray(equal) & (known[1:] == known[:-1])
        kept = np.r_[True, ~(same & (pos[1:] == pos[:-1]))]
        table = table.filter(pa.array(kept))
        document = np.asarray(table["pos"]) < 0
        flat, offsets = _spans(table.filter(pa.array(document))["ids"].combine_chunks())
        flat = np.asarray(flat)
        cold, ends = _spans(table.filter(pa.array(~document))["ids"].combine_chunks())
        gap = flat < 0
        sizes = np.ones(len(flat), np.int64)
        sizes[gap] = np.diff(ends)
        starts = np.r_[0, np.cumsum(sizes)]
        out = np.empty(starts[-1], np.int32)
        out[starts[:-1][~gap]] = flat[~gap]
        out[np.repeat(starts[:-1][gap] - ends[:-1], np.diff(ends)) + np.arange(len(cold))] = np.asarray(cold)
        lists = pa.ListArray.from_arrays(pa.array(starts[offsets], pa.int32()), pa.array(out))
        return pa.RecordBatch.from_arrays([table.filter(pa.array(document))["id"].combine_chunks(), lists], names=["id", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = held["id"][-1].as_py()
        other = pc.fill_null(pc.not_equal(held["id"], last), True) if last is not None else held["id"].is_valid()
        n = len(held) - int(np.argmax(np.asarray(other)[::-1])) if pc.any(other).as_py() else 0
        if n:
            yield merged(held.slice(0, n))
            held = held.slice(n).combine_chunks()
    if held is not None:
        yield merged(held)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks: bytes) -> DataFrame:
    """``(id_col, ids)``: the token ids of each text, in order."""
    kind = dict(df.dtypes)[id_col]
    table = cut(encode_words(word_counts(df, id_col, text_col), ranks))
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = (F.col("n") * HOT_WORDS >= total) & (F.length("word") <= HOT_CHARS)
    near = table.where(hot).select("word", "ids").toArrow()  # at most HOT_WORDS rows, see above
    hot_words, hot_ids = near["word"].combine_chunks().cast(pa.string()), near["ids"].combine_chunks().cast(pa.list_(pa.int32()))
    gap = pa.array([[-1]], pa.list_(pa.int32()))
    texts = _texts(df, id_col, text_col)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.concat_arrays([hot_ids, gap])
        for ids, words in _words(batches):
            flat, offsets = _spans(words)
            at = pc.fill_null(pc.index_in(flat, value_set=hot_words), len(hot_words))
            tokens, ends = _spans(known.take(at))
            lists = pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), tokens)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), -1, np.int32)), lists], names=["id", "pos", "ids"])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _words(batches):
            flat, offsets = _spans(words)
            at = np.flatnonzero(np.asarray(pc.invert(pc.is_in(flat, value_set=hot_words))))
            row = np.searchsorted(offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), flat.take(pa.array(at))], names=["id", "pos", "word"])

    far = table.where(~hot).select(F.col("word").alias("w"), "ids")
    rest = texts.mapInArrow(cold, f"id {kind}, pos int, word string").join(far, F.col("word") == F.col("w")).select("id", "pos", "ids")
    parts = texts.mapInArrow(documents, f"id {kind}, pos int, ids array<int>").unionByName(rest)
    return parts.repartition("id").sortWithinPartitions("id", "pos").mapInArrow(_merge, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def pieces(spark: SparkSession, ranks: bytes) -> DataFrame:
    """The vocabulary as a table ``(id, piece)``, piece in hexadecimal."""
    rows = [(int(b), base64.b64decode(a).hex()) for a, b in (line.split() for line in ranks.splitlines() if line)]
    return spark.createDataFrame(rows, "id int, piece string")


def decode_corpus(encoded: DataFrame, id_col: str, vocabulary: DataFrame) -> DataFrame:
    """``(id_col, text)`` by joining each id with its piece; the vocabulary is of fixed size and broadcast."""
    ids = encoded.select(id_col, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id")
    texts = ids.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    text = F.decode(F.unhex(F.concat_ws("", F.col("parts.piece"))), "UTF-8")
    return encoded.where(F.size("ids") == 0).select(id_col, F.lit("").alias("text")).unionByName(texts.select(id_col, text.alias("text")))
