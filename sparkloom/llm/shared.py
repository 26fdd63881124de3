"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.folders import Files, scratch

#: The ASCII white space that the word contracts name.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Upper bound of text bytes that one numpy step of an operator handles at once; a longer document is a step of its own.
STEP_BYTES = 400_000


#: Spark removes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a partition and its file; of rows with whole texts; of keys and numbers.
TEXT_ROWS, FILE_ROWS = 8_000, 50_000


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows, in one partition for every ``each`` of them at most, so that small tables are not many tiny files."""
    return df.coalesce(max(1, -(-rows // each)))


def staged(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage ends there.

    The folder's name is unique, and its shuffle files go with the write. Where it is known about how many ``rows`` there are,
    :func:`few` files are written. The table stays until :func:`remove` deletes it; :func:`staging` tells the paths.
    """
    spark = df.sparkSession
    if rows is not None:
        df = few(df, rows, each)
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _paths.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


_paths: ContextVar[list[str]] = ContextVar("paths", default=[])  # noqa: B039  (what is staged outside of staging() is nobody's to delete)


@contextmanager
def staging() -> Iterator[list[str]]:
    """Collects the paths of what is staged inside. Delete them once the results that read them are written."""
    own: list[str] = []
    token = _paths.set(own)
    try:
        yield own
    finally:
        _paths.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    Files(spark, path).delete()


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch to a Python worker holds, whatever the length of the texts: the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the offset of each string (one more at the end)."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive strings of about ``most`` bytes together; a longer string stands alone."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        up = np.full(size, base, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """H with H[i] = sum of values[j] * base**j for j < i; (H[e] - H[s]) * base**-s is the hash of values[s:e]."""
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of the spans [starts, ends) from :func:`prefix_sums`."""
    _, down = powers(base, len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX_A)


def zipped(df: DataFrame, text: str = "_t", zipped_as: str = "_z") -> DataFrame:
    """Replaces a column of texts without nulls by compressed bytes, so that a shuffle moves less than half of them."""
    others = [c for c in df.columns if c != text]
    rows = df.select(*others, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs = pa.array([pack(t.as_buffer()) for t in batch.column(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), blobs], [*others, zipped_as])

    schema = T.StructType([f for f in rows.schema if f.name != text] + [T.StructField(zipped_as, T.BinaryType())])
    return rows.mapInArrow(run, schema)


def boxed(columns: list[str], name: str = "_row") -> Column:
    """The columns as one struct, so that their names clash with none that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)


def unzipped(blobs: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of texts from :func:`zipped`."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(b.as_buffer()) for b in blobs]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``sizes`` from ``starts``: which range each element belongs to, and the elements, all in a row."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
