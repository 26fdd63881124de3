"""An offset-addressed log as a table: append in batches, range reads, consumer groups, retention, recovery checks.

Records are rows (offset, payload, crc, segment_base) of Parquet files partitioned by segment, one folder and commit for a batch, so
that readers prune batches and segments by offset. The raw segment format (offset, length, CRC32, payload) is read and
written for exchange.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import record_crc
from sparkloom.sources.folders import Files, Versions

HEADER = struct.Struct(">qiI")
SCHEMA = "offset long, payload binary, crc long"


@dataclass(frozen=True)
class LogConfig:
    """A segment is closed before an append once it holds ``segment_bytes`` or more."""

    segment_bytes: int = 64 << 20
    max_record_bytes: int = 1 << 20

    def __post_init__(self) -> None:
        if self.segment_bytes <= 0 or self.max_record_bytes <= 0:
            raise ValueError("sizes must be positive")


class Log:
    """A log in a directory that Spark can write.

    An append writes a folder of records under a new name and then a small commit file that names it, with the range of
    offsets and the open segment. What no commit names does not exist, so a torn append is invisible, and is removed by
    the next writer. Of two writers that append at the same place one fails. After a failed append the log refuses further ones
    until it is opened again.
    """

    def __init__(self, spark: SparkSession, path: str, config: LogConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path, config or LogConfig()
        self.failed = False
        self._commits, self._data = Files(spark, f"{path}/commits"), Files(spark, f"{path}/records")
        self._repaired = False

    def _repair(self) -> None:
        """Removes what torn appends have left. Only the one writer of a log calls it, before its first append."""
        named = {c["data"] for c in self.commits()}
        for name in self._data.names():
            if name not in named:
                self._data.delete(name)
        self._repaired = True

    def commits(self) -> list[dict]:
        """Commits in order of offsets: first, next, data (a folder), segment (base of the open one) and bytes in it."""
        return [json.loads(self._commits.read(n)) for n in self._commits.names() if not n.startswith(".")]

    def rows(self, low: int = 0, high: int | None = None) -> DataFrame:
        """Records of the batches that reach into the offsets from ``low`` to before ``high``."""
        paths = list(dict.fromkeys(f"{self.path}/records/{c['data']}" for c in self.commits() if c["next"] > low and (high is None or c["first"] < high)))
        if not paths:
            return self.spark.createDataFrame([], f"{SCHEMA}, segment_base long")
        return self.spark.read.schema(f"{SCHEMA}, segment_base long, batch string").option("basePath", f"{self.path}/records").parquet(*paths).drop("batch")

    def segments(self) -> DataFrame:
        """(segment_base): every segment that has records."""
        return self.rows().select("segment_base").distinct()

    def next_offset(self) -> int:
        return max((c["next"] for c in self.commits()), default=0)

    def first_offset(self) -> int:
        return min((c["first"] for c in self.commits()), default=0)

    def append(self, payloads: DataFrame, order: str) -> int:
        """Appends a batch (column ``payload``) in order of a unique column as one commit; returns its first offset."""
        from sparkloom.operators.relational import with_rank

        if self.failed:
            raise RuntimeError("an append failed; open the log again")
        if not self._repaired:
            self._repair()
        checked = payloads.agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("most"), F.count_if(F.col("payload").isNull()).alias("none")).first()
        if not checked["n"]:
            raise ValueError("an empty batch")
        if checked["none"] or checked["most"] > self.config.max_record_bytes:
            raise ValueError("a record is null or too large")
        last = max(self.commits(), key=lambda c: c["next"], default={"next": 0, "segment": 0, "bytes": 0})
        base, name = last["next"], f"batch={last['next']:020d}-{uuid.uuid4().hex}"
        rows = with_rank(payloads, order, "_rank").select((F.lit(base) + F.col("_rank")).cast("long").alias("offset"), F.col("payload").cast("binary").alias("payload"))
        try:
            rolled, segment, held = rolled_segments(rows, F.octet_length("payload") + HEADER.size, self.config.segment_bytes, last["segment"], last["bytes"])
            rows = rolled.withColumn("crc", record_crc(F.col("offset"), F.col("payload"))).select("offset", "payload", "crc", "segment_base")
            rows.repartitionByRange("offset").sortWithinPartitions("offset").write.partitionBy("segment_base").parquet(f"{self.path}/records/{name}")
            commit = {"first": base, "next": base + checked["n"], "data": name, "segment": segment, "bytes": held}
            self._commits.write(f"{base:020d}", json.dumps(commit).encode())
        except Exception:
            self.failed = True
            raise
        return base

    def read_from(self, offset: int, limit: int) -> DataFrame:
        """At most ``limit`` records from an offset on; offsets below the first are an error."""
        if offset < 0 or offset < self.first_offset():
            raise ValueError(f"offset {offset} is below the first")
        return self.rows(offset, offset + limit).where((F.col("offset") >= offset) & (F.col("offset") < offset + limit)).orderBy("offset").select("offset", "payload")

    def read(self, offset: int) -> bytes | None:
        found = self.rows(offset, offset + 1).where(F.col("offset") == offset).first()
        return bytes(found["payload"]) if found else None

    def delete_up_to(self, offset: int) -> int:
        """Removes segments that lie wholly below ``offset``, never the last; returns how many.

        A batch goes with its last such segment; a batch that has later ones is cut, and its commit replaced first.
        """
        gone = {r[0] for r in sealed_below(self.segments(), offset).collect()}
        if not gone:
            return 0
        end = self.segments().where(~F.col("segment_base").isin(list(gone))).agg(F.min("segment_base")).first()[0]
        for c in self.commits():
            if c["first"] >= end:
                continue
            if c["next"] > end:
                self._commits.write(f"{end:020d}", json.dumps(c | {"first": end}).encode())
            self._commits.delete(f"{c['first']:020d}")
            if c["next"] <= end:
                self._data.delete(c["data"])
            else:
                for name in Files(self.spark, f"{self.path}/records/{c['data']}").names():
                    if name.startswith("segment_base=") and int(name.partition("=")[2]) in gone:
                        self._data.delete(f"{c['data']}/{name}")
        return len(gone)


def sealed_below(segments: DataFrame, offset: int) -> DataFrame:
    """Of a log's segment bases: those whose successor starts at or below ``offset``.

    That is every base below the greatest one that is at or below ``offset``.
    """
    last = segments.where(F.col("segment_base") <= offset).agg(F.max("segment_base")).first()[0]
    return segments.where(F.col("segment_base") < F.lit(last).cast("long"))


def rolled_segments(rows: DataFrame, size: Column, segment_bytes: int, base: int = 0, held: int = 0) -> tuple[DataFrame, int, int]:
    """Adds ``segment_base`` to records (offset): a segment that holds ``segment_bytes`` or more is closed before the next record.

    ``base`` and ``held`` are the open segment and its bytes; those after the last record are returned too. Where a segment ends
    depends on where it began, so the sizes alone are folded in order, as a stream through one task of constant memory; payloads are
    not. What comes back is one number for each new segment.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, before, found = held, -1, []
        for batch in batches:
            for offset, n in zip(batch.column("offset").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if offset <= before:
                    raise ValueError("records out of order")
                if full >= segment_bytes:
                    found.append(offset)
                    full = 0
                full, before = full + n, offset
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.nulls(len(found), pa.int64())], ["start", "held"])
            found = []
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([full], pa.int64())], ["start", "held"])

    sizes = rows.select("offset", size.cast("long").alias("size")).orderBy("offset").coalesce(1)
    told = sizes.mapInArrow(fold, "start long, held long").collect()
    starts = [base, *sorted(r["start"] for r in told if r["start"] is not None)]

    @F.pandas_udf("long")
    def base_of(offset: pd.Series) -> pd.Series:
        return pd.Series(np.array(starts)[np.searchsorted(np.array(starts[1:], np.int64), offset, side="right")])

    return rows.withColumn("segment_base", base_of("offset")), starts[-1], max((r["held"] for r in told if r["held"] is not None), default=held)


class Consumer:
    """A consumer group's position in a log; it moves with polls and is kept by commits."""

    def __init__(self, log: Log, group: str) -> None:
        self.log, self.group = log, group
        self._kept = Versions(log.spark, f"{log.path}/groups/{group}")
        self.position = max(self._committed(), log.first_offset())

    def _committed(self) -> int:
        text = (self._kept.load() or b"").strip()
        return int(text) if text.isdigit() else 0  # no commit, or a damaged one: start over

    def poll(self, limit: int) -> list[tuple[int, bytes]]:
        found = [(r["offset"], bytes(r["payload"])) for r in self.log.read_from(self.position, limit).collect()]
        if found:
            self.position = found[-1][0] + 1
        return found

    def lag(self) -> int:
        """Records that are not polled yet."""
        return max(self.log.next_offset() - self.position, 0)

    def commit(self) -> None:
        self._kept.save(str(self.position).encode())


def encoded_segment(records: Sequence[tuple[int, bytes]]) -> bytes:
    """Records in the raw format."""
    out = []
    for offset, payload in records:
        head = struct.pack(">qi", offset, len(payload))
        out += (head, struct.pack(">I", zlib.crc32(head + payload)), payload)
    return b"".join(out)


def decoded_segment(data: bytes, limit: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Records of a raw segment up to the first torn or damaged one."""
    at = 0
    while at + HEADER.size <= len(data):
        offset, size, crc = HEADER.unpack_from(data, at)
        end = at + HEADER.size + size
        if not 0 <= size <= limit or end > len(data) or zlib.crc32(data[at : at + 12] + data[at + HEADER.size : end]) != crc:
            return
        yield offset, data[at + HEADER.size : end]
        at = end


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment_base, offset, payload) of raw segment files; each file is read by one task."""
    from sparkloom.functions.text import segment_base

    @F.pandas_udf("array<struct<offset:long,payload:binary>>")
    def records(contents):  # noqa: ANN001, ANN202
        return contents.map(lambda b: [{"offset": o, "payload": p} for o, p in decoded_segment(bytes(b))])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    return files.select(segment_base(F.col("path")).alias("segment_base"), F.inline(records("content")))


def segments_by_size(df: DataFrame, size: Column, segment_bytes: int) -> DataFrame:
    """Adds ``segment_base`` to records (offset), by the rule of :func:`rolled_segments` from an empty log on."""
    return rolled_segments(df, size, segment_bytes)[0]


def recovered_segment(data: bytes, limit: int = 1 << 20) -> tuple[bytes, int]:
    """A raw segment without its torn or damaged tail, and the bytes cut."""
    whole = sum(HEADER.size + len(payload) for _, payload in decoded_segment(data, limit))
    return data[:whole], len(data) - whole


def verified(log: DataFrame, expected: Column) -> DataFrame:
    """(offset, status): OK where the payload is as expected, else BAD."""
    return log.select("offset", F.when(F.col("payload").cast("string") == expected, "OK").otherwise("BAD").alias("status"))
