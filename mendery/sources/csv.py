"""CSV in and out.

Files are read as lines, which Spark splits, and every line is parsed under the header of its own file. One
pass over the lines finds the headers, how many rows each block holds, and which files have quoted line
breaks; those are cut into records block by block, all of them together (``records``).
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendery.functions.text import strip
from mendery.session import settle_table
from mendery.sources.records import read_records
from mendery.sources.rows import resolve_names

# RFC quoting doubles the quote. Blank fields are empty text whether quoted or not, and over-long rows
# lose their extra fields.
_READ = {
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "maxColumns": "100000",
    "maxCharsPerColumn": "-1",
}
# A table whose rows have more different names than this is refused: each name becomes a column.
MAX_COLUMNS = 10_000
# Facts about blocks are broadcast up to this many numbers in them (16 MB); a larger table is joined as Spark
# sees fit.
BROADCAST_CELLS = 2_000_000
_MIN_SPLITS = "spark.sql.files.minPartitionNum"


class TooManyColumns(ValueError):
    """Free-form keys cannot be spread into columns."""


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    ]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with text, with their file and block. Inside a block ``__at`` rises by one from line to line: it is
    given out after empty lines are gone, so no list of them is needed.

    The survey and the rows are two scans that must split the files alike. What splitting depends on, beside
    the files, is fixed here; a scan that splits otherwise all the same is refused by ``_rows``.
    """
    if spark.conf.get(_MIN_SPLITS, None) is None:
        spark.conf.set(_MIN_SPLITS, str(spark.sparkContext.defaultParallelism))
    return spark.read.text(paths).filter(F.col("value") != "").select("value", *_place())


def _survey(lines: DataFrame) -> DataFrame:
    """One row per block: number of lines, first place, first line, and whether a quoted field goes on over a
    line break."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("__file", "__block").agg(
        F.count("*").alias("n_lines"),
        F.min("__at").alias("first_at"),
        F.min_by("value", "__at").alias("first_line"),
        F.max(quotes % 2 == 1).alias("torn"),
    )


def _names(header: str) -> list[str]:
    return next(csv.reader(io.StringIO(header, newline="")))


def _rows(lines: DataFrame, blocks: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """Rows of the lines, parsed and put under the names of their own file's header."""
    known = blocks.select(F.col("__file").alias("of"), F.col("__block").alias("at_block"), "first_at", "n_lines", "has_header", "start", "places")
    cells = blocks.agg(F.sum(F.size("places") + F.lit(8))).first()[0] or 0
    if cells <= BROADCAST_CELLS:  # then the lines stay where they are
        known = F.broadcast(known)
    joined = lines.join(known, (F.col("__file") == F.col("of")) & (F.col("__block") == F.col("at_block")), "left")
    offset = F.col("__at") - F.col("first_at")
    alike = F.coalesce((offset >= 0) & (offset < F.col("n_lines")), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("The file was split differently by two scans: "), F.col("__file")))
    placed = joined.withColumn("offset", F.when(alike, offset).otherwise(refused.cast("bigint")))
    rows = placed.filter(F.col("places").isNotNull() & ~(F.col("has_header") & (F.col("offset") == 0)))
    index = F.col("start") + F.col("offset") - F.col("has_header").cast("bigint")
    return _spread(rows.withColumn("__index", index), "value", width, columns)


def _spread(rows: DataFrame, text: str, width: int, columns: list[str]) -> DataFrame:
    """Columns from texts of one row each; ``places`` says where each column stands in the row, -1: nowhere."""
    fields = ", ".join(f"c{i} string" for i in range(width))
    parsed = rows.withColumn("p", F.from_csv(text, fields, {**_READ, "multiLine": "true"}))
    cells = parsed.withColumn("cells", F.array(*[F.col(f"p.c{i}") for i in range(width)]))

    def value(place: Column) -> Column:
        return F.when(place >= 0, F.coalesce(strip(F.get("cells", place)), F.lit("")))

    return cells.select(*[value(F.col("places")[i]).alias(n) for i, n in enumerate(columns)], "__index")


def _record_rows(records: DataFrame, blocks: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """Rows of the records of files with quoted line breaks, but for the headers."""
    known = blocks.select(F.col("__file").alias("of"), F.col("__block").alias("at_block"), "start", "places", "has_header")
    joined = records.join(known, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at_block")))
    rows = joined.filter(~(F.col("has_header") & (F.col("ordinal") == 0)))
    return _spread(rows.withColumn("__index", F.col("start") + F.col("ordinal") - F.col("has_header").cast("bigint")), "text", width, columns)


def read_csv(spark: SparkSession, path: str | list[str], row_index: str | None = None) -> DataFrame:
    """All-string table from CSV files; names and values are normalised.

    ``path`` may be a file, a landing folder for uploads, or a list. Every file has its own header: columns
    are brought together by name, in the order in which the files, by path, first name them. A field that a
    short row lacks is empty text, one that its file does not have is NULL. A file without rows adds no
    column. A line of blanks is a row, an empty line is none. ``row_index`` adds the position of a row, 0 to
    n-1, in the order of files by path and of lines in a file, without writing or sorting rows: the lines of
    a block are in order, and blocks, a few bytes each, are counted and summed up.

    The driver sees one row per file: its header, whether it has rows and quoted line breaks. Files with quoted
    line breaks take two more passes, together and split like others; no file has a job or a plan of its own.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = _lines(spark, paths)
    survey = settle_table(_survey(lines), "csv-survey")
    of_file = survey.groupBy("__file").agg(
        F.min_by("first_line", "__block").alias("header"), F.max("torn").alias("torn"), F.sum("n_lines").alias("n")
    )
    found = {r["__file"]: r for r in of_file.collect()}
    named = [T.StructField(row_index, T.LongType())] if row_index else []
    if not found:
        return spark.createDataFrame([], T.StructType(named))
    torn = sorted(file for file, r in found.items() if r["torn"])
    records = read_records(spark, torn) if torn else None
    counts = settle_table(records.groupBy("file", "block").agg(F.count("*").alias("n")), "csv-record-counts") if torn else None
    if torn:
        first = records.filter("ordinal = 0").groupBy("file").agg(F.min_by("text", "block").alias("header"))
        sums = counts.groupBy(F.col("file").alias("of")).agg(F.sum("n").alias("n"))
        found |= {r["file"]: r for r in first.join(sums, F.col("file") == F.col("of")).collect()}
    headers = {file: _names(r["header"]) for file, r in found.items()}
    naming = {file for file, r in found.items() if r["n"] > 1}
    names = {file: resolve_names(headers[file]) for file in sorted(headers)}
    columns = list(dict.fromkeys(n for file, own in names.items() if file in naming or not naming for n in own))
    if not naming:
        fields = [T.StructField(c, T.StringType()) for c in columns]
        return spark.createDataFrame([], T.StructType([*fields, *named]))

    facts = [(file, [names[file].get(c, -1) for c in columns]) for file in sorted(naming)]
    files = spark.createDataFrame(facts, "of_file string, places array<int>")
    width = max(len(headers[file]) for file in naming)
    # where lines are no rows, records are
    sizes = survey.filter(~F.col("torn")) if not torn else survey.join(counts.select(F.col("file").alias("of")).distinct(), F.col("__file") == F.col("of"), "left_anti")
    sizes = sizes.select("__file", "__block", F.col("n_lines").alias("n"), "first_at", "n_lines")
    if torn:
        sizes = sizes.unionByName(counts.toDF("__file", "__block", "n"), allowMissingColumns=True)
    blocks = settle_table(_starts(sizes.join(files, F.col("__file") == F.col("of_file"))), "csv-blocks")
    out = _rows(lines, blocks.filter("n_lines is not null"), width, columns)
    if torn:
        out = out.unionByName(_record_rows(records, blocks.filter("n_lines is null"), width, columns))
    return out.select(*columns, *([F.col("__index").alias(row_index)] if row_index else []))


def _starts(blocks: DataFrame) -> DataFrame:
    """The blocks with the header's place and the number of rows before them. The windows run over one small row
    per block of the input."""
    first = F.min("__block").over(Window.partitionBy("__file"))
    blocks = blocks.withColumn("has_header", F.col("__block") == first)
    own = F.col("n") - F.col("has_header").cast("bigint")
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(own).over(before), F.lit(0).cast("bigint")))


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of (file) over a folder in which CSV files arrive, one row per file; no file is opened for it."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(F.col("path").alias("file"))


def spread_ragged(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """Ragged ``map<string,string>`` rows as a table whose columns are the union of all keys.

    Only the distinct key names come to the driver; they become column names. More than ``MAX_COLUMNS`` of
    them are an error, since no table has that many columns.
    """
    distinct = frame.select(F.explode(F.map_keys(raw)).alias("key")).distinct()
    keys = sorted(r["key"] for r in distinct.limit(MAX_COLUMNS + 1).collect())
    if len(keys) > MAX_COLUMNS:
        raise TooManyColumns(f"The rows have more than {MAX_COLUMNS} different keys")
    rest = [c for c in frame.columns if c != raw]
    return frame.select(*rest, *[F.col(raw)[k].alias(k) for k in keys])


def csv_layout(*frames: DataFrame) -> DataFrame:
    """Union of tables that may differ in columns: sorted header, missing values empty."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(joined.columns)]
    )


def write_csv(path: str, *frames: DataFrame, mode: str = "error") -> None:
    csv_layout(*frames).write.mode(mode).options(header="true", quote='"', escape='"', emptyValue="").csv(path)
