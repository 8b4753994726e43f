"""Quoted multi-line CSV that splits (T1): records put together from the lines of file splits.

Spark reads a CSV file with line breaks in quoted fields as one task, because only the start
of a file tells whether a line break lies in quotes. Here the file is read as plain lines, in
as many splits as its size gives:

1. a line's parity is whether it holds an odd number of quotes (doubled quotes are even). A
   line is inside a quoted field if the lines before it in its file hold an odd number in all,
2. parities are added up per split; one row per split, in file order, tells each split the
   parity of everything before it,
3. a line that neither starts nor ends in quotes is a record by itself and goes on as it is.
   Only lines of multi-line records are brought together, by the number of their record,
4. ``from_csv`` parses every record.

The text must follow the usual rules (RFC 4180): quotes in a quoted field are doubled, and
unquoted fields hold none. A file that ends inside quotes keeps its last lines as one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.session import stored_table

SPLIT = ["file", "block"]


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, line, odd``: the lines of every split in their order, stored."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),        # ascends with the lines of a split
        F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return stored_table(lines.withColumn("odd", (quotes % 2).cast("int")), "csv-lines")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, first``: every record of the CSV files below ``path``, headers included,
    with its line breaks; ``first`` marks the first of each file."""
    lines = _numbered_lines(spark, path)
    splits = lines.groupBy(*SPLIT).agg(F.sum("odd").alias("odd"))          # a row per split
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*SPLIT, F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("base") + F.sum("odd").over(inside)
    # quotes so far, before and after the line; one more record starts wherever none is open
    known = lines.join(splits, SPLIT).withColumn("after", after).withColumn("before", F.col("after") - F.col("odd"))
    starts = F.col("before") % 2 == 0
    text = F.regexp_replace("line", "\r$", "")
    whole = known.where(starts & (F.col("after") % 2 == 0))
    # an odd line opens a record or closes one; the number of those before names the record
    parts = known.where(~(starts & (F.col("after") % 2 == 0))).withColumn(
        "number", F.floor((F.col("before") + 1) / 2 - F.when(starts, 0).otherwise(1)))
    glued = (parts.groupBy("file", "number")
             .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
             .select("file", F.col("lines")[0]["block"].alias("block"), F.col("lines")[0]["at"].alias("at"),
                     F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("line")))
    records = whole.select("file", "block", "at", "line").unionByName(glued)
    written = lines.where(~F.col("line").isin("", "\r"))           # blank lines before the header are none
    first = written.groupBy("file").agg(F.min(F.struct("block", "at")).alias("top"))     # a row per file
    return records.join(first, "file").select(
        "file", text.alias("record"), (F.struct("block", "at") == F.col("top")).alias("first"))


def load_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files with a header, every column as text, read in as many tasks as splits.

    The same rows as the ``multiLine`` reader gives with ``escape`` set to a quote, but that
    line breaks in quotes stay as they are (that reader turns ``\\r\\n`` into ``\\n``). With
    ``columns`` the header is skipped unread. The lines are stored when this is called.
    """
    records = csv_records(spark, path)
    options = {"quote": '"', "escape": '"'}
    if columns is None:
        header = records.where("first").select(F.min("record")).first()[0]
        wide = ", ".join(f"c{i} string" for i in range((header or "").count(",") + 1))
        named = spark.range(1).select(F.from_csv(F.lit(header or ""), wide, options).alias("h")).first()["h"]
        columns = [c for c in named if c is not None]
    schema = ", ".join(f"`{c}` string" for c in columns)
    body = records.where(~F.col("first") & (F.col("record") != ""))
    return body.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
