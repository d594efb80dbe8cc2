"""Garbled text from a wrong character encoding: find it, and restore what can be had back.

The unit is the token: what stands between ASCII blanks and holds a character beyond ASCII, digits made equal.
Texts repeat their words far more than themselves, so clean near-twins are found for tokens.

1. Tokens are counted over all documents.  Tokens equal after their non-ASCII characters are stripped are
   near-twins; each is held against the most frequent one of its group only, so a group of any size gives one
   pair a member.  The twins' ASCII letters anchor an alignment of the characters between them.
2. An aligned pair of runs is explained by a transformation (written in one encoding, read in another) of the
   table of encodings.  Transformations with enough distinct pairs are learned; runs that no transformation explains
   are learned as run mappings and applied to other tokens by a join on the run.
3. Transformations are undone on all other tokens.  One well-formed UTF-8 sequence is enough under a reading that
   twins taught.  Else an undone token counts if it is attested: it stands in the corpus, several times as often as
   the garbled form.  Pairs written in a Latin single-byte encoding are tried only if taught.  Text in scripts
   without ASCII letters has no twin of this kind, since nothing is left when it is stripped; there the other
   transformations of the table are tried too, and ``source`` tells documents found so apart.
4. Two things need no attestation and no twin: bytes that read as well-formed UTF-8 at two places or more, or twice
   over (chance doesn't produce them), and traces no writing produces (replacement characters, C1 controls, NULs).

Distinct tokens are few against the corpus and each is judged once; documents get the verdicts by a join.

Defined results
---------------
* Null, empty and plain ASCII texts are never garbled, unless they hold NULs (text read byte by byte from UTF-16).
* A document repeated under another id is judged alike.  Rows repeated as a whole come out once.
* ``restored`` undoes what was judged, and whatever else in the document reads as UTF-8 under its sure transformation; what was
  replaced for good stays, and ``complete`` is then false, as it is where a token is left that such a transformation would change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut

#: Encodings that a text is written or read in (fixed values, Python codec names).
LATIN = ("latin-1", "cp1252", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850", "cp852", "cp1257", "cp1254", "iso8859_15")
OTHER = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7")
WIDE = ("gb18030", "cp932", "euc_jp", "euc_kr", "big5")
UTF16 = ("utf-16-le", "utf-16-be")
#: Distinct pairs a learned transformation or run mapping rests on.
LEAST_PAIRS = 3
#: How many times as often as the garbled form an undone form must stand in the corpus.
TIMES = 4

TRACES = "[�\x00\x80-\x84\x86-\x9f]"
_STRIP = ".,;:!?()[]\"'"
_BLANK = re.compile(r"[ \t\r\n]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"[0-9]+")
_SPLIT = re.compile(r"([\x00-\x7f]+)")
_LETTERS = re.compile(r"[A-Za-z]")
_NEVER = re.compile("[\x80-\x9f\ufffd\ue000-\uf8ff]")  # no clean token has these


def normal(token: str) -> str:
    """Digits made equal, outer ASCII punctuation dropped."""
    return _DIGITS.sub("0", token).strip(_STRIP)


@cache
def _single(encoding: str) -> tuple[dict[int, int], dict[int, int]]:
    """Character to byte and byte to character; bytes the encoding leaves open stand for themselves."""
    to_char = {}
    for b in range(128, 256):
        try:
            to_char[b] = ord(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            to_char[b] = b
    to_byte: dict[int, int] = {}
    for b, c in to_char.items():
        to_byte.setdefault(c, b)
    return to_byte, to_char


@cache
def _between(read: str, written: str) -> dict[int, int]:
    """Character read to character written, for two single-byte encodings."""
    to_byte, _ = _single(read)
    _, to_char = _single(written)
    return {c: to_char[b] for c, b in to_byte.items()}


def _bytes(text: str, read: str) -> bytes | None:
    if read in LATIN or read in OTHER:
        to_byte, _ = _single(read)
        if any(ord(c) > 127 and ord(c) not in to_byte for c in text):
            return None
        return text.translate(to_byte).encode("latin-1")
    try:
        return text.encode(read)
    except UnicodeEncodeError:
        return None


def undo(text: str, written: str, read: str) -> str | None:
    """What was written, if ``text`` came of reading ``written`` as ``read``; None if that can't be."""
    if written != "utf-8" and written not in WIDE:
        table = _between(read, written)
        if any(ord(c) > 127 and ord(c) not in table for c in text):
            return None
        return text.translate(table)
    data = _bytes(text, read)
    if data is None:
        return None
    try:
        return data.decode(written)
    except UnicodeDecodeError:
        if read not in UTF16:
            return None
    # A stretch read in pairs of bytes may lack a part of a character at either end.
    for head in range(4):
        for tail in range(4):
            try:
                return data[head : len(data) - tail].decode(written)
            except UnicodeDecodeError:
                continue
    return None


@cache
def hypotheses() -> tuple[tuple[str, str], ...]:
    """(written, read) pairs that are tried."""
    single = (*LATIN, *OTHER)
    pairs = [("utf-8", r) for r in (*single, *WIDE, *UTF16)]
    pairs += [(w, r) for w in single for r in single if w != r]
    pairs += [(w, r) for w in WIDE for r in ("latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r")]
    return tuple(pairs)


def _plausible(text: str) -> bool:
    """Whether regrouped bytes read as prose: nearly all ASCII letters and blanks, or letters beyond ASCII and blanks."""
    if len(text) < 8 or any(c < " " and c not in "\r\n\t" or "\x7f" <= c < "\xa0" or "\ue000" <= c <= "\uf8ff" for c in text):
        return False
    words = sum(c.isalpha() or c == " " for c in text)
    if text.isascii() and len(text) >= 16 and re.search("[A-Za-z]{5}", text):
        return words >= 0.55 * len(text)
    wide = sum(c > "\u2fff" for c in text)
    return words >= 0.75 * len(text) and wide <= 0.8 * len(text)


#: Blocks of which undone text may consist (fixed values).
_BLOCKS = ((0xA0, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE0F, 0xFE0F), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF))


def _natural(text: str) -> bool:
    """Whether the characters beyond ASCII are ones people write, and their letters of one alphabet."""
    alphabets = set()
    for c in text:
        o = ord(c)
        if o < 0x80:
            continue
        if not any(a <= o <= b for a, b in _BLOCKS):
            return False
        if c.isalpha() and o < 0x2000 and c not in "µªº":
            alphabets.add("latin" if o < 0x370 or o >= 0x1E00 else "greek" if o < 0x400 else "cyrillic")
    return len(alphabets) < 2


def _badness(text: str) -> int:
    """Places where prose seldom looks like this; tells apart the two orders of bytes."""
    return len(re.findall(r"[a-z][A-Z]|[.,;:][A-Za-z]| [.,;:]", text))


@cache
def _readable(read: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters beyond ASCII that a text read in this single-byte encoding can hold, and those that a UTF-8 sequence begins with."""
    to_byte, _ = _single(read)
    return frozenset(map(chr, to_byte)), frozenset(chr(c) for c, b in to_byte.items() if 0xC2 <= b <= 0xF4)


def _from_utf8(token: str, signs: list[str], read: str) -> str | None:
    """``undo(token, "utf-8", read)``; ``signs`` are its characters beyond ASCII, which rule out most readings at once."""
    if read not in WIDE:
        known, leads = _readable(read)
        if signs[0] not in leads or not known.issuperset(signs):
            return None
    return undo(token, "utf-8", read)


def self_evident(token: str, signs: list[str] | None = None) -> tuple[str, str, int] | None:
    """(written, read, times) if undoing needs no attestation."""
    signs = [c for c in token if c > "\x7f"] if signs is None else signs
    if signs:
        for read in (*LATIN, *OTHER, *WIDE):
            once = _from_utf8(token, signs, read)
            if once is None or once == token:
                continue
            again = undo(once, "utf-8", read) if not once.isascii() else None
            if again is not None and again != once and not any("\x80" <= c < "\xa0" for c in again):
                return "utf-8", read, 2
            if sum(c > "\x7f" for c in once) >= 2 and _natural(once):
                return "utf-8", read, 1
    if len(token) >= 3:
        ways = [(_badness(once), read) for read in UTF16 if (once := undo(token, "utf-8", read)) is not None and _plausible(once)]
        if ways:
            return "utf-8", min(ways)[1], 1
    return None


def _units(text: str) -> list[str]:
    """Forms by which a token is attested: itself, and its runs of three characters beyond ASCII or more."""
    return list(dict.fromkeys(u for u in [normal(text), *(r for r in _RUN.findall(text) if len(r) > 2)] if not u.isascii()))


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(id, token)`` of tokens beyond ASCII."""
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text.isascii():
                    found = {normal(t) for t in _BLANK.split(text) if not t.isascii()}
                    at += [i] * len(found)
                    out += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["id", "token"])

    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(scan, f"id {kind}, token string").distinct()


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, its clean twin) -> runs (garbled, clean, written, read); without encodings where the table explains nothing and nobody writes so."""
    for batch in batches:
        rows: list[tuple] = []
        for token, twin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # The ASCII parts are equal and in order: they align the runs between them.
            mine, theirs = _SPLIT.split(token), _SPLIT.split(twin)
            if mine[1::2] != theirs[1::2]:
                continue
            for a, b in zip(mine[::2], theirs[::2]):
                if a and b and a != b:
                    ways = [(a, b, w, r) for w, r in hypotheses() if undo(a, w, r) == b]
                    rows += ways or ([] if _natural(a) else [(a, b, None, None)])
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["run", "clean", "written", "read"])


def learn(vocabulary: DataFrame) -> DataFrame:
    """What twins teach: ``(written, read, run, clean, pairs)``; run mappings outside the table have no encodings."""
    skeleton = F.regexp_replace("token", r"[^\x00-\x7f]+", "")
    known = vocabulary.select("token", "df", skeleton.alias("skeleton")).where(F.regexp_replace("skeleton", "[^A-Za-z]", "") != "").where(F.length("skeleton") >= 3)
    best = known.groupBy("skeleton").agg(F.max(F.struct("df", "token")).alias("best"))
    twins = known.join(best, "skeleton").where((F.col("token") != F.col("best.token")) & (F.col("best.df") >= TIMES * F.col("df"))).select("token", F.col("best.token").alias("twin"))
    voted = twins.mapInArrow(_votes, "run string, clean string, written string, read string")
    return voted.groupBy("written", "read", "run", "clean").agg(F.count("*").alias("pairs"))


def _one_sequence(token: str, signs: list[str], reads: tuple[str, ...]) -> str | None:
    """The reading under which a token with ASCII letters holds well-formed UTF-8, were it a single sequence; reads are taught by twins."""
    if not _LETTERS.search(token):
        return None
    for read in reads:
        was = _from_utf8(token, signs, read)
        if was is not None and was != token and not was.isascii() and _natural(was):
            return read
    return None


def _tries(vocabulary: DataFrame, trusted: frozenset[tuple[str, str]]) -> DataFrame:
    """Ways to undo each token: ``(token, df, written, read, times, unit, was)``; no ``unit`` where nothing else has to attest it."""
    taught = tuple(r for w, r in hypotheses() if w == "utf-8" and r in LATIN and (w, r) in trusted)
    by_read: dict[str, list[str]] = {}
    for written, read in hypotheses():
        if written not in LATIN or (written, read) in trusted:
            by_read.setdefault(read, []).append(written)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {read: _readable(read)[0] for read in by_read if read in LATIN or read in OTHER}
        for batch in batches:
            rows: list[tuple] = []
            for token, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                signs = [c for c in token if c > "\x7f"]
                evident = self_evident(token, signs)
                if evident is None and (read := _one_sequence(token, signs, taught)):
                    evident = "utf-8", read, 1
                if evident:
                    rows.append((token, df, *evident, None, None))
                    continue
                for read, written_in in by_read.items():
                    if read in known and not known[read].issuperset(signs):
                        continue  # no text read in this encoding has these characters
                    for written in written_in:
                        was = _from_utf8(token, signs, read) if written == "utf-8" and read not in UTF16 else undo(token, written, read)
                        if was is not None and was != token and not was.isascii() and not _NEVER.search(was):
                            rows += [(token, df, written, read, 1, unit, was) for unit in _units(was)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["token", "df", "written", "read", "times", "unit", "was"])

    return vocabulary.select("token", "df").mapInArrow(scan, "token string, df long, written string, read string, times int, unit string, was string")


def _by_runs(vocabulary: DataFrame, learned: DataFrame, units: DataFrame) -> DataFrame:
    """Tokens undone by run mappings outside the table, joined on the run: ``(token, runs)``, where the result is attested."""
    outside = learned.where(F.col("written").isNull()).groupBy("run").agg(F.max_by("clean", F.struct("pairs", "clean")).alias("clean"), F.max("pairs").alias("most"), F.sum("pairs").alias("all"))
    outside = outside.where((F.col("most") >= LEAST_PAIRS) & (F.col("most") * 5 >= F.col("all") * 4)).select("run", "clean")
    held = vocabulary.select("token", "df", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(r"[^\x00-\x7f]+"), F.lit(0)))).alias("run"))
    found = held.join(outside, "run").groupBy("token", "df").agg(F.map_from_entries(F.collect_set(F.struct("run", "clean"))).alias("runs"))
    was = F.aggregate(F.map_entries("runs"), F.col("token"), lambda text, e: F.replace(text, e["key"], e["value"]))
    both = found.withColumn("unit", was).join(units, "unit")
    return both.where((F.col("times_seen") >= LEAST_PAIRS) & (F.col("times_seen") >= TIMES * F.col("df"))).select("token", "runs")


def judge(vocabulary: DataFrame) -> DataFrame:
    """Garbled tokens: ``(token, written, read, times, runs, sure, taught)``.

    ``sure`` is false where a token proves nothing by itself; ``taught`` tells whether twins taught the transformation.
    """
    learned = cut(learn(vocabulary))
    # The table of encodings is fixed, so what is learned about it is of fixed size: at most its square.
    named = learned.where(F.col("written").isNotNull()).groupBy("written", "read").agg(F.count("*").alias("n"))
    trusted = frozenset(tuple(r) for r in named.where(F.col("n") >= LEAST_PAIRS).select("written", "read").collect())
    tries = cut(_tries(vocabulary, trusted))
    runs = vocabulary.select(F.explode(F.filter(F.regexp_extract_all("token", F.lit(r"[^\x00-\x7f]+"), F.lit(0)), lambda r: F.length(r) > 2)).alias("unit"), "df")
    units = vocabulary.select(F.col("token").alias("unit"), "df").unionByName(runs).groupBy("unit").agg(F.max("df").alias("times_seen"))
    none = F.lit(None).cast("map<string,string>")
    evident = tries.where(F.col("unit").isNull()).select("token", "written", "read", "times", none.alias("runs"), F.lit(True).alias("sure"))
    attested = tries.where(F.col("unit").isNotNull()).join(units, "unit").where((F.col("times_seen") >= LEAST_PAIRS) & (F.col("times_seen") >= TIMES * F.col("df")))
    # A lone sign read in another single-byte encoding is often another lone sign: such a token is weak evidence.
    letters = F.length(F.regexp_replace("was", r"[^\p{L}]", ""))
    common = F.col("token").rlike("[A-Za-z]") & (F.col("times_seen") >= 50 * F.col("df"))
    weak = (F.col("written") != "utf-8") & ~common & ((letters < 2) | (F.length(F.regexp_replace("was", r"[^\p{L}\p{M}]", "")) < 3))
    top = attested.groupBy("token").agg(F.max_by(F.struct("written", "read", "times", weak.alias("weak")), F.struct((~weak), "times_seen", "written", "read")).alias("best"))
    best = top.select("token", "best.written", "best.read", "best.times", none.alias("runs"), (~F.col("best.weak")).alias("sure"))
    outside = _by_runs(vocabulary, learned, units).select("token", F.lit("").alias("written"), F.lit("").alias("read"), F.lit(1).alias("times"), "runs", F.lit(True).alias("sure"))
    taught = F.concat_ws("/", "written", "read").isin("/", *["/".join(t) for t in sorted(trusted)])
    return evident.unionByName(best).unionByName(outside.join(evident.select("token"), "token", "left_anti").join(best.select("token"), "token", "left_anti")).withColumn("taught", taught)


def garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a garbled document: ``(id, fixes, traces, source)``; ``fixes`` maps tokens to how they are undone.

    ``source`` is ``twins`` if a transformation or run mapping taught by near-twins undoes a token of the document, ``table``
    if only transformations of the table do that no twin taught, ``traces`` if nothing but traces shows the damage.
    """
    held = cut(tokens(df, id_col, text_col))
    # Judging a token costs far more than moving it: the distinct tokens are spread evenly, whatever their bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = cut(held.groupBy("token").agg(F.count("*").alias("df")).repartition(parts, "token"))
    verdicts = judge(vocabulary)
    fixes = F.collect_list(F.struct("token", "written", "read", "times", "runs"))
    kinds = held.join(verdicts, "token").groupBy("id", "written", "read").agg(fixes.alias("fixes"), F.bool_or("sure").alias("sure"), F.bool_or("taught").alias("taught"))
    # Weak tokens count only beside a sure one of the same transformation.
    found = kinds.where("sure").groupBy("id").agg(F.flatten(F.collect_list("fixes")).alias("fixes"), F.bool_or("taught").alias("taught"))
    marked = df.where(F.col(text_col).rlike(TRACES)).select(F.col(id_col).alias("id"), F.lit(True).alias("traces")).distinct()
    both = found.join(marked, "id", "full")
    source = F.when(F.col("taught"), "twins").when(F.col("taught").isNotNull(), "table").otherwise("traces")
    return both.select("id", "fixes", F.coalesce("traces", F.lit(False)).alias("traces"), source.alias("source"))


_HELD = re.compile(r"([ \t\r\n]+)")


def _undone(token: str, how: tuple[str, str, int]) -> str | None:
    """A token that nobody judged, undone under a transformation that is sure for its document; None if it doesn't fit."""
    for times in range(how[2], 0, -1):
        was: str | None = token
        for _ in range(times):
            was = undo(was, how[0], how[1]) if was is not None else None
        if was is not None and was != token and _natural(was) and not any("\x80" <= c < "\xa0" for c in was):
            return was
    return None


def _mend(text: str, fixes: dict[str, tuple]) -> tuple[str, bool]:
    """The text undone, and whether a token is left that a sure transformation would change.

    Well-formed UTF-8 doesn't come by chance, so the document's other tokens are undone too.  Nearly any sign fits another
    single-byte encoding, and a text may be garbled in places only: there a token that wasn't judged stays and is told.
    """
    parts, left = _HELD.split(text), False
    sure = sorted({how[:3] for how in fixes.values() if how[0] and how[1] not in UTF16}, key=lambda how: (how[0] != "utf-8", how))
    for i in range(0, len(parts), 2):
        if parts[i].isascii():
            continue
        how = fixes.get(normal(parts[i]))
        if how and how[0] == "":
            parts[i] = _RUN.sub(lambda m, runs=how[3]: runs.get(m.group(), m.group()), parts[i])
            continue
        if how:
            was: str | None = parts[i]
            for _ in range(how[2]):
                was = undo(was, how[0], how[1]) if was is not None else None
            left |= was is None
            parts[i] = was if was is not None else parts[i]
            continue
        ways = [(h, was) for h in sure if (was := _undone(parts[i], h)) is not None]
        if ways and ways[0][0][0] == "utf-8":
            parts[i] = ways[0][1]
        else:
            left |= bool(ways)
    return "".join(parts), left


def restore(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, restored, complete, source)`` of the garbled documents."""
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace = re.compile(TRACES)
        for batch in batches:
            out, whole = [], []
            for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, left = _mend(text, {f["token"]: (f["written"], f["read"], f["times"], dict(f["runs"] or [])) for f in fixes or []})
                if "\x00" in text:  # every other byte of UTF-16 read as a character
                    text = re.sub(r"(?:[^\x00]\x00){4,}", lambda m: m.group(0).replace("\x00", ""), text)
                out.append(text)
                whole.append(not left and not trace.search(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(whole, pa.bool_()), batch.column(3)], names=[id_col, "restored", "complete", "source"])

    how = found.select(F.col("id").alias("_f_id"), F.col("fixes").alias("_f_fixes"), F.col("source").alias("_f_source"))
    joined = df.select(id_col, text_col).join(how, F.col(id_col) == F.col("_f_id")).select(id_col, text_col, "_f_fixes", "_f_source").where(F.col(text_col).isNotNull())
    return joined.mapInArrow(scan, f"{id_col} {kind}, restored string, complete boolean, source string")
