"""Records of CSV files whose quoted fields go on over line breaks, with files split like any others.

Whether a line belongs to a quoted field depends on all lines before it. Each block of a file is therefore read
for both cases: it reports in which state it ends if it begins outside a quoted field, and if it begins inside
one. Composing these reports, two truth values per block, gives every block its true state at the start. With it
each block is cut into records by itself; a record that crosses blocks comes in pieces, which are joined under
the block in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.session import settle_table

QUOTE, DELIMITER = '"', ","
# Blocks that begin inside a field are broadcast up to this many rows; beyond it lines are joined and sorted.
BROADCAST_BLOCKS = 100_000


def goes_on(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one was open at its beginning.

    A field is quoted if its first character is a quote; two quotes inside it stand for one. What follows a
    closing quote, and any quote in an unquoted field, is plain text up to the next delimiter.
    """
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            at += not inside
            end = line.find(QUOTE, at)
            while end >= 0 and line.startswith(QUOTE, end + 1):
                end = line.find(QUOTE, end + 2)
            if end < 0:
                return True
            at, inside = end + 1, False
        at = line.find(DELIMITER, at) + 1
        if at == 0:
            return False


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(file, block) and the range of rows of each block in a batch; lines of one block lie together."""
    n = batch.num_rows
    if n == 0:
        return
    changed = pa.array([False] * (n - 1), pa.bool_())
    for column in batch.columns[:2]:
        changed = pc.or_(changed, pc.not_equal(column.slice(1), column.slice(0, n - 1)))
    cuts = [0, *[i + 1 for i in pc.indices_nonzero(changed).to_pylist()], n]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield (batch.column(0)[start].as_py(), batch.column(1)[start].as_py()), start, end


def _reports(lines: DataFrame) -> DataFrame:
    """(file, block, outside, inside): the state at the end of each block for either state at its beginning."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list[bool]] = {}
        for batch in batches:
            quoted = pc.fill_null(pc.match_substring(batch.column(2), QUOTE), False)
            for key, start, end in _stretches(batch):
                state = ends.setdefault(key, [False, True])
                for line in batch.column(2).slice(start, end - start).filter(quoted.slice(start, end - start)).to_pylist():
                    outside = goes_on(line, state[0])
                    state[1] = outside if state[0] == state[1] else goes_on(line, state[1])
                    state[0] = outside
            if len(ends) > 1_000:  # all but the last block are complete
                last = list(ends)[-1]
                yield _rows([(*k, *v) for k, v in ends.items() if k != last], schema)
                ends = {last: ends[last]}
        if ends:
            yield _rows([(*k, *v) for k, v in ends.items()], schema)

    return lines.select("file", "block", "value").mapInArrow(run, "file string, block bigint, outside boolean, inside boolean")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _begun_inside(reports: DataFrame) -> DataFrame:
    """(file, block) of the blocks that begin inside a quoted field.

    A block either forces its end state, or keeps the state, or turns it around. The state before a block is
    that of the last block that forced one (outside, at the start of a file), turned as often as blocks since
    then did. The window holds one small row per block of a file.
    """
    in_file = Window.partitionBy("file").orderBy("block")
    forces = F.col("outside") == F.col("inside")
    turns = F.when(~forces & F.col("outside"), 1).otherwise(0)
    counted = reports.withColumn("turns", turns).withColumn("turned", F.sum("turns").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    forced = F.last(F.when(forces, F.struct("outside", "turned")), ignorenulls=True)
    found = counted.withColumn("forced", forced.over(in_file.rowsBetween(Window.unboundedPreceding, -1)))
    since = F.col("turned") - F.col("turns") - F.coalesce(F.col("forced.turned"), F.lit(0))
    begun = F.coalesce(F.col("forced.outside"), F.lit(False)) != (since % 2 == 1)
    return found.filter(begun).select(F.col("file").alias("of"), F.col("block").alias("at_block"))


def _pieces(lines: DataFrame) -> DataFrame:
    """(file, block, ordinal, ends, text): records of each block in order; ordinal -1 goes on with a record of
    an earlier block, and ``ends`` is false for the last one if it goes on in the next block."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ordinal", pa.int64()), ("ends", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, ordinal, held = None, False, 0, []
        for batch in batches:
            out = []
            for new, start, end in _stretches(batch):
                if new != key:
                    if open_:
                        out.append((*key, ordinal, False, "\n".join(held)))
                    open_ = batch.column(3)[start].as_py()
                    key, ordinal, held = new, -1 if open_ else 0, []
                for line in batch.column(2).slice(start, end - start).to_pylist():
                    if not open_ and line in ("", "\r"):
                        continue
                    open_ = goes_on(line, open_) if QUOTE in line else open_
                    held.append(line)
                    if not open_:
                        out.append((*key, ordinal, True, "\n".join(held).removesuffix("\r")))
                        ordinal, held = ordinal + 1, []
            if out:
                yield _rows(out, schema)
        if open_:
            yield _rows([(*key, ordinal, False, "\n".join(held))], schema)

    return lines.select("file", "block", "value", "inside").mapInArrow(run, "file string, block bigint, ordinal bigint, ends boolean, text string")


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, ordinal, text) of every record of the files, written once to the shared folder.

    (block, ordinal) orders the records of a file; a record stands under the block in which it begins. Lines
    end at a line feed, and a carriage return before the end of a record is not part of it; inside a quoted
    field line breaks stay as they are. Empty lines between records are none. A field that is still open at
    the end of a file ends there. Two passes over the files, whatever their number: none of them is read by
    one task, unless it is a single block.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    begun = settle_table(_begun_inside(settle_table(_reports(lines), "csv-quote-states")), "csv-open-blocks")
    same = (F.col("file") == F.col("of")) & (F.col("block") == F.col("at_block"))
    if begun.count() <= BROADCAST_BLOCKS:  # then the lines stay where they are
        marked = lines.join(F.broadcast(begun), same, "left")
    else:
        marked = lines.join(begun, same, "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    pieces = settle_table(_pieces(marked.withColumn("inside", F.col("of").isNotNull())), "csv-records")

    torn = pieces.filter("ordinal = -1 or not ends")
    up_to_here = Window.partitionBy("file").orderBy("block", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col("ordinal") >= 0, F.col("block")), ignorenulls=True).over(up_to_here)
    parts = F.array_sort(F.collect_list(F.struct("block", "ordinal", "text")))
    joined = (
        torn.withColumn("begin", begin)
        .groupBy("file", "begin")
        .agg(F.max("ordinal").alias("ordinal"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    )
    whole = pieces.filter("ordinal >= 0 and ends").select("file", "block", "ordinal", "text")
    return whole.unionByName(joined.select("file", F.col("begin").alias("block"), "ordinal", "text"))
