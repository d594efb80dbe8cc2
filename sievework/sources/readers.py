"""Sources: strict typed CSV, JSON lines, source trees and whole runs as lazy tables.

Everything is a lazy DataFrame with an explicit schema; nothing infers one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.numbers import lenient_boolean, numeric_value, strict_integer
from sievework.operators.scope import exclusion_reason, language_of, nul_class

#: How each column type reads a text cell; what a cell can't be stays NULL and is reported by ``violations``.
_READ = {"string": lambda c: c, "integer": strict_integer, "number": numeric_value, "boolean": lenient_boolean, "json": lambda c: F.try_parse_json(c)}


def typed_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with exactly these columns; an empty cell is NULL, unknown or missing header columns are an error."""
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), nullValue="", mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"')
    return raw.select(*[_READ[t](F.col(c)).alias(c) for c, t in columns.items()], *[F.col(c).alias(f"_raw_{c}") for c, t in columns.items() if t != "string"])


def violations(df: DataFrame, columns: dict[str, str], key: list[str]) -> DataFrame:
    """Cells that hold something their column's type can't: ``(*key, column, cell)``."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_raw_{c}").alias("cell"), F.col(c).isNull().alias("bad")) for c, t in columns.items() if t != "string"])
    return df.select(*key, F.explode(F.filter(items, lambda x: x["bad"] & x["cell"].isNotNull())).alias("x")).select(*key, "x.column", "x.cell")


def outside_vocabulary(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Rows whose value isn't of the closed vocabulary; NULL is no value."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*vocabulary))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, strictly: a line that doesn't fit the schema fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def source_tree(spark: SparkSession, root: str, *, largest: int = 5_000_000, prefix: int = 65_536) -> DataFrame:
    """Inventory of a tree: path, size, digest, encoding, language, the reason that excludes a file, and text of included ones.

    A file beyond ``largest`` bytes is told as ``oversized`` and judged by its first ``prefix`` bytes only; every smaller file
    is read whole.  Names decide before contents: what they exclude keeps its digest, but its text is never decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "")
    rows = files.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), "content")
    path, big = F.col("relative_path"), F.col("size_bytes") > largest
    rows = rows.withColumns({"language": language_of(path), "byte_order_mark": byte_order_mark(F.col("content")), "by_name": exclusion_reason(path)})
    readable = F.col("language").isNotNull() & F.col("by_name").isNull()
    decoded = F.when(readable, decode_source(F.when(big, F.substring("content", 1, prefix)).otherwise(F.col("content")), F.col("byte_order_mark")))
    rows = rows.withColumn("text", decoded)
    by_text = F.when(F.col("text").isNull(), "undecodable").otherwise(F.coalesce(exclusion_reason(path, text=F.col("text")), nul_class(F.col("text"))))
    rows = rows.withColumn("exclusion_reason", F.coalesce("by_name", F.when(readable, F.coalesce(F.when(big, "oversized"), by_text))))
    included = F.col("language").isNotNull() & F.col("exclusion_reason").isNull()
    return rows.select(
        "relative_path", "size_bytes", "language", "exclusion_reason", included.alias("included"), "byte_order_mark", F.when(~big, F.sha2("content", 256)).alias("content_sha256"), F.when(included, F.col("text")).alias("source_text")
    )


def decode_source(content: Column, mark: Column) -> Column:
    """Text of a file by its byte-order mark, else strict UTF-8; NULL where it isn't."""
    wide = F.decode(content, "UTF-16")
    return F.when(mark.isin("utf-16-le", "utf-16-be"), wide).otherwise(F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\\x{feff}", ""))


def byte_order_mark(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("EFBBBF"), "utf-8").when(head.startswith("FFFE0000"), "utf-32-le").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")


def numstat(df: DataFrame, commit: str, text: str) -> DataFrame:
    """``git log --numstat`` bodies as rows: ``(commit, added, deleted, path, old_path)``; a dash is a binary change (NULL)."""
    line = df.select(F.col(commit).alias("commit"), F.explode(F.split(text, "\n")).alias("line"))
    form = r"^(\d+|-)\t(\d+|-)\t(?:(.*?)\{(.*?) => (.*?)\}(.*)|(.*?) => (.*)|(.*))$"
    g = lambda i: F.regexp_extract("line", form, i)
    braced, arrow = g(5) != "", g(8) != ""
    squeeze = lambda c: F.regexp_replace(c, "//", "/")
    path = F.when(F.col("line").contains("{") & (braced | (g(4) != "")), squeeze(F.concat(g(3), g(5), g(6)))).when(arrow, g(8)).otherwise(g(9))
    old = F.when(F.col("line").contains("{") & (braced | (g(4) != "")), squeeze(F.concat(g(3), g(4), g(6)))).when(arrow, g(7))
    rows = line.where(F.col("line").rlike(form))
    return rows.select("commit", g(1).try_cast("bigint").alias("added"), g(2).try_cast("bigint").alias("deleted"), path.alias("path"), old.alias("old_path"))


def hunks(df: DataFrame, key: list[str], patch: str) -> DataFrame:
    """Zero-context hunk headers of patches: ``(*key, ordinal, base_start, base_count, head_start, head_count)``."""
    form = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    heads = df.select(*key, F.posexplode(F.regexp_extract_all(patch, F.lit(form), F.lit(0))).alias("ordinal", "head"))
    n = lambda i: F.coalesce(F.regexp_extract("head", form, i).try_cast("int"), F.lit(1))
    return heads.select(*key, "ordinal", n(1).alias("base_start"), n(2).alias("base_count"), n(3).alias("head_start"), n(4).alias("head_count"))


def open_run(spark: SparkSession, directory: str, tables: list[str], prefix: str = "run_") -> dict[str, DataFrame]:
    """The tables of a finished run as lazy frames and temporary views; a run without its status row is refused."""
    status = spark.read.parquet(f"{directory}/status")
    if status.where("state = 'complete'").limit(1).count() == 0:
        raise ValueError("the run wasn't finished")
    found = {t: spark.read.parquet(f"{directory}/{t}") for t in tables}
    for t, df in found.items():
        df.createOrReplaceTempView(prefix + t)
    return found
