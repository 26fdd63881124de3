from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.sources import readers
from sparkloom.sources.log import LogConfig, encoded_segment, read_segments, recovered_segment, segments_by_size
from sparkloom.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    (tmp_path / "b.json").write_text('{"a": 1}')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2 and readers.read_json(spark, str(tmp_path / "b.json")).count() == 1
    for other in ("7", '"x"', "[1, 2]", "{broken"):
        (tmp_path / "c.json").write_text(other)
        assert readers.read_json(spark, str(tmp_path / "c.json")).count() == 0


def test_generators(spark):
    rows = readers.random_rows(spark, 500, seed=1)
    assert rows.count() == 500 and {r[0] for r in rows.select("category").distinct().collect()} == {"A", "B", "C"}
    assert rows.where("value < 10 or value > 99").count() == 0
    assert readers.random_telemetry(spark, 100).where("temperature not between 20 and 80").count() == 0
    assert readers.random_transactions(spark, 100, seed=2).where("senderAccount = receiverAccount").count() == 0
    assert readers.keyed_log(spark, 20).select("payload").distinct().count() == 10


def test_raw_segments(spark, tmp_path):
    (tmp_path / f"{0:020d}.log").write_bytes(encoded_segment([(0, b"a"), (1, b"b")]))
    (tmp_path / f"{2:020d}.log").write_bytes(encoded_segment([(2, b"c"), (3, b"d")])[:-1])
    got = read_segments(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["segment_base"], r["offset"], bytes(r["payload"])) for r in got] == [(0, 0, b"a"), (0, 1, b"b"), (2, 2, b"c")]
    with pytest.raises(ValueError):
        LogConfig(segment_bytes=0)


def test_segments_by_size(spark):
    """A segment that holds as many bytes or more is closed before the next record."""
    sizes = [30] * 8 + [250, 1, 99, 100, 5] + [40] * 9
    df = spark.createDataFrame(list(enumerate(sizes)), "offset long, n int").repartition(5)
    want, base, held = [], 0, 0
    for k, n in enumerate(sizes):
        if held >= 100:
            base, held = k, 0
        held += n
        want.append(base)
    assert [r["segment_base"] for r in segments_by_size(df, F.col("n"), 100).orderBy("offset").collect()] == want


def test_torn_tail_is_cut():
    data = encoded_segment([(0, b"a"), (1, b"bc")])
    assert recovered_segment(data) == (data, 0) and recovered_segment(data[:-1]) == (encoded_segment([(0, b"a")]), 17)
    assert recovered_segment(data + b"\0" * 5) == (data, 5) and recovered_segment(b"") == (b"", 0)


def test_windows_drop_nothing_in_batch_and_counts_in_streams(spark, tmp_path):
    tel = readers.random_telemetry(spark, 3000, seed=4)
    tel.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = jobs.window_averages(spark.read.parquet(str(tmp_path / "in")))
    assert batch.agg(F.sum("n")).first()[0] == 3000
    stream = spark.readStream.schema(tel.schema).parquet(str(tmp_path / "in"))
    q = jobs.to_batches(jobs.window_averages(stream), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.join(batch, ["window_start", "sensor_id", "n"]).count() == done.count() > 0


def test_small_functions(spark):
    row = spark.range(1).select(fn.split_and_trim(F.lit("a, b ,c")).alias("s"), fn.segment_name(F.lit(7)).alias("n"), fn.rotate_to_least(F.array(*map(F.lit, "cab"))).alias("r"), fn.epoch_millis_now().alias("t")).first()
    assert row["s"] == ["a", "b", "c"] and row["n"] == f"{7:020d}.log" and row["r"] == ["a", "b", "c"] and row["t"] > 0
