"""Helpers shared by the operators: tables, Arrow batches of bounded size, hashes of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows and bytes that one Arrow batch brings to a Python worker. A single text may be larger.
BATCH_ROWS = 2_000
BATCH_BYTES = "8m"

# Words a worker remembers between documents; the memory is emptied when it is full, nothing is lost.
# Longer words than REMEMBERED bytes are not kept, so the memory is bounded in bytes, too.
KNOWN_WORDS = 400_000
REMEMBERED = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(frame: DataFrame) -> None:
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_rows(frame: DataFrame, schema: str, make: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Run Python over Arrow batches: ``make()`` is called once per task and returns a function that takes
    the columns of a batch (lists; text as UTF-8 bytes) and returns rows.

    Batches are bounded in rows and bytes, so memory does not depend on the size of a partition. A function
    that gathers rows over batches has a method ``finish`` that returns the last rows of its task.
    """
    bound_batches(frame)
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = function(*[as_list(batch.column(i)) for i in range(batch.num_columns)])
            if rows:
                yield record_batch(rows, out)
        rows = function.finish() if hasattr(function, "finish") else None
        if rows:
            yield record_batch(rows, out)

    return frame.mapInArrow(run, schema)


class ByKey:
    """Hands the rows of one key, sorted by it in column 0, to a function; a key may span batches."""

    def __init__(self, function: Callable[[list[tuple]], list[tuple]]):
        self.function, self.rows = function, []

    def __call__(self, *columns: list) -> list[tuple]:
        out: list[tuple] = []
        for row in zip(*columns, strict=True):
            if self.rows and row[0] != self.rows[0][0]:
                out += self.finish()
            self.rows.append(row)
        return out

    def finish(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return self.function(rows) if rows else []


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filter_rows(frame: DataFrame, names: list[str], make: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Keep the rows whose values pass; the rows themselves are handed through untouched."""
    bound_batches(frame)
    at = [frame.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            values = zip(*[as_list(batch.column(i)) for i in at], strict=True)
            yield batch.filter(pa.array([bool(passes(*v)) for v in values], pa.bool_()))

    return frame.mapInArrow(run, frame.schema)


def as_list(column: pa.Array) -> list:
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


class Words(dict):
    """Word (bytes) to a 64-bit hash, remembered between documents."""

    def __missing__(self, word: bytes) -> int:
        return self.remember(word, xxhash.xxh3_64_intdigest(word))

    def remember(self, word: bytes, value: int) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(word) <= REMEMBERED:
            self[word] = value
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter text is one run; no words, no runs."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    return one_run([hashes[k : n - size + 1 + k] for k in range(size)])


def one_run(columns) -> np.ndarray:
    """Hash of the run of words that each place of the columns holds, one word a column."""
    out = np.full(len(columns[0]), np.uint64(len(columns)))
    for words in columns:
        out = mix(out * _MIX + words)
    return out


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def signed(x: np.ndarray) -> list[int]:
    """64-bit hashes as the signed numbers of a Spark bigint."""
    return x.astype(np.uint64).view(np.int64).tolist()
