"""Registered queries of sources, sinks, streams, contracts and task graphs: each runs its operator over tables and files and compares by SQL.

What they write goes to the shared folder and is removed. Results that read such files are small, and taken before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.functions.registry import default_registry
from sparkloom.operators import relational as rel
from sparkloom.plans import contracts
from sparkloom.plans.dag import Dag, Node
from sparkloom.plans.refine import FieldMapping, Mapping, Step, refine
from sparkloom.queries import _NAMED, _RINGS, LOG, RAW, SIM, TEL, TX, log, query, raw, sim, table, tel, told, tx, tx_alerts
from sparkloom.sources import readers
from sparkloom.sources.folders import Files, scratch
from sparkloom.sources.log import encoded_segment, read_segments
from sparkloom.streaming import jobs


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder that goes afterwards."""
    path = scratch(spark, name)
    try:
        yield path
    finally:
        Files(spark, path).delete()


# Sources.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    with folder(spark, "csv") as path:
        n.write.option("header", True).csv(path)
        return told(readers.read_csv(spark, path, n.schema))


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 99, 'single'")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"id": r["r_regionkey"], "name": r["r_name"]} for r in table(spark, d, "region").collect()]
    with folder(spark, "json") as path:
        files = Files(spark, path)
        files.write("array.json", json.dumps(rows).encode())
        files.write("single.json", b'{"id": 99, "name": "single"}')
        return told(readers.read_json(spark, path).select("id", "name"))


_SENT = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{no' WHEN 2 THEN '[]' WHEN 3 THEN '{\"senderAccount\":\"' || user_id || '\"}' ELSE '{\"transactionId\":\"' || event_id || '\",\"senderAccount\":\"' || user_id || '\",\"amount\":2.5,\"timestamp\":7}' END"


@query("SELECT CASE WHEN event_id % 6 > 3 THEN event_id::VARCHAR END AS transactionId, user_id::VARCHAR AS senderAccount, NULL::VARCHAR AS receiverAccount, CASE WHEN event_id % 6 > 3 THEN 2.5::DOUBLE END AS amount, CASE WHEN event_id % 6 > 3 THEN 7::BIGINT END AS timestamp FROM events WHERE event_id % 6 > 2")
def decoded_messages(spark: SparkSession, d: str) -> DataFrame:
    return readers.decoded(table(spark, d, "events").select(F.expr(_SENT).alias("value")), readers.TRANSACTION)


@query(f"SELECT \"offset\", payload, \"offset\" // 100 * 100 AS segment_base FROM {LOG} WHERE \"offset\" < 299")
def raw_segments(spark: SparkSession, d: str) -> DataFrame:
    """Three raw segments, the last with a torn record."""
    rows = [(r["offset"], r["payload"].encode()) for r in log(spark, d).where("offset < 300").orderBy("offset").collect()]
    with folder(spark, "segments") as path:
        for base in (0, 100, 200):
            data = encoded_segment([r for r in rows if base <= r[0] < base + 100])
            Files(spark, path).write(f"{base:020d}.log", data[: len(data) - (base == 200)])
        return told(read_segments(spark, path).select("offset", F.col("payload").cast("string").alias("payload"), "segment_base"))


@query("SELECT * FROM (VALUES ('rows', true), ('telemetry', true), ('transactions', true), ('log', true), ('sample', true)) v(source, holds)")
def generators(spark: SparkSession, d: str) -> DataFrame:
    """Each generator's rows against its description."""
    rows, telemetry, paid, keyed = readers.random_rows(spark, 5000, seed=3), readers.random_telemetry(spark, 5000, seed=3), readers.random_transactions(spark, 5000, seed=3), readers.keyed_log(spark, 5000)
    found = {
        "rows": rows.agg((F.count("*") == 5000) & (F.min("id") == 1) & (F.max("id") == 5000) & (F.count_distinct("category") == 3) & (F.min("value") == 10) & (F.max("value") == 99)),
        "telemetry": telemetry.agg((F.count_distinct("sensor_id") == 10) & (F.min("temperature") >= 20) & (F.max("temperature") <= 80) & (F.max("timestamp") == 49990)),
        "transactions": paid.agg(F.bool_and(F.expr("senderAccount <> receiverAccount")) & F.bool_and(F.expr("amount between 10 and 100 or amount between 5000 and 15000")) & (F.count_distinct("timestamp") == 5000)),
        "log": keyed.agg((F.count_distinct("payload") == 10) & (F.max("offset") == 4999)),
        "sample": readers.sample_records(spark).agg((F.count("*") == 1) & (F.max("salary") == 50000.556)),
    }
    return spark.createDataFrame([(name, df.first()[0]) for name, df in found.items()], "source string, holds boolean")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: trim(x)), '|') AS parts FROM part")
def split_fields(spark: SparkSession, d: str) -> DataFrame:
    listed = F.replace("p_type", F.lit(" "), F.lit(" , "))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("|", fn.split_and_trim(listed)).alias("parts"))


# Placement.


@query("SELECT * FROM (VALUES ('hash', true), ('range', true), ('skewed', true), ('coalesced', true), ('random', true)) v(operator, holds)")
def placement(spark: SparkSession, d: str) -> DataFrame:
    """Where the repartitionings put rows: keys together, ranges apart, most rows in one, few partitions, even ones."""
    rows = sim(spark, d).where("value is not null")

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.spark_partition_id())

    sizes = lambda df: [r["count"] for r in parts(df).groupBy("part").count().collect()]
    ranges = sorted((r["a"], r["b"]) for r in parts(rel.range_partitioned(rows, "value", 3)).groupBy("part").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect())
    n, skewed, even = rows.count(), sizes(rel.repartition_skewed(rows, 0.9, 3)), sizes(rel.repartition_random(rows, 3))
    found = {
        "hash": parts(rel.repartition_hash(rows, "category", 3)).groupBy("category").agg(F.count_distinct("part").alias("k")).where("k > 1").isEmpty(),
        "range": len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False)),
        "skewed": 0.85 * n <= max(skewed) <= 0.95 * n, "coalesced": len(sizes(rel.coalesce(rows.repartition(6), 2))) <= 2, "random": len(even) == 3 and max(even) <= 1.1 * n / 3 + 3,
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "operator string, holds boolean")


# Refinement.


@query(f"SELECT c_custkey::VARCHAR AS c_custkey, upper(trim(customer_name)) AS name, (region_id::BIGINT + 1)::BIGINT AS region, (region_id::BIGINT + 1) || '' AS region_text, 0::BIGINT AS n_errors FROM {RAW}")
def refine_typed(spark: SparkSession, d: str) -> DataFrame:
    """A mapping that went through its JSON, with cast types."""
    m = Mapping.of_columns(["c_custkey", "customer_name", "region_id"])
    m.fields["c_custkey"].rich_key_type = "string"
    m.fields["customer_name"] = FieldMapping("name", transformation=[Step("lowercase"), Step("trim_whitespace")])
    m.fields["customer_name"].add("transformation", Step("uppercase"))
    m.fields["customer_name"].add("validation", Step("min_length", {"min_chars": 999}))
    m.fields["customer_name"].delete("validation", 0)
    m.fields["region_id"] = FieldMapping("region", rich_key_type="int", transformation=[Step("math_add", {"amount_to_add": 1})])
    out = refine(raw(spark, d), Mapping.from_json(m.to_json()), cast_types=True)
    return out.select("c_custkey", "name", "region", F.col("region").cast("string").alias("region_text"), F.size("errors").cast("long").alias("n_errors"))


@query("SELECT * FROM (VALUES ('transformation', 7, 'lowercase,math_add,replace_text,round_number,substring,trim_whitespace,uppercase'), ('validation', 5, 'is_valid_email,min_length,not_null,number_range,validate_name_length'), ('derivation', 3, 'calculate_tax,combine_fields,extract_email_domain')) v(category, n, names)")
def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    known = default_registry().parameters()
    return spark.createDataFrame([(c, len(own), ",".join(sorted(own))) for c, own in known.items()], "category string, n int, names string")


# Streams.


def _stream(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a stream of files."""
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _last_batch(stream: DataFrame, path: str) -> DataFrame:
    """What the last batch of a complete stream holds."""
    run = jobs.to_batches(stream, lambda df, k: df.write.parquet(f"{path}/out/{k}"), f"{path}/checkpoint", "complete", once=True)
    run.awaitTermination()
    files = Files(stream.sparkSession, f"{path}/out")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/{max(files.names(), key=int)}")


@query(f"SELECT payload AS key, count(*) AS count FROM {LOG} GROUP BY payload")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per key of a stream, over several micro-batches."""
    with folder(spark, "stream") as path:
        return told(_last_batch(jobs.keyed_counts(_stream(spark, log(spark, d).repartition(3), f"{path}/in")), path))


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 10 SECOND, make_timestamp(timestamp * 1000))) AS start_ms, sensor_id, count(*) AS n FROM {TEL} WHERE timestamp < (SELECT min(timestamp) + 86400000 FROM {TEL}) GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The first day's windows of a stream that keeps all of them: late rows within the watermark are counted."""
    rows = tel(spark, d)
    first = rows.agg(F.min("timestamp")).first()[0]
    with folder(spark, "stream") as path:
        stream = jobs.window_averages(_stream(spark, rows.where(F.col("timestamp") < first + 86_400_000), f"{path}/in"), delay="2 days")
        return told(_last_batch(stream, path).select(F.unix_millis("window_start").alias("start_ms"), "sensor_id", "n"))


@query(f"""{_RINGS.replace(TX, _NAMED)} SELECT epoch_ms(w) AS start_ms, array_to_string(ring, '>') AS ring FROM r WHERE w < (SELECT min(w) + INTERVAL 10 DAY FROM e)""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Rings of the first ten days as a stream alerts of them, read back from the alerts' JSON."""
    t = tx(spark, d)
    end = t.where("sender <> receiver").agg(F.min("w") + F.expr("interval 10 days")).first()[0]
    sent = t.where(F.col("w") < F.lit(end)).select(F.col("sender").cast("string").alias("senderAccount"), F.col("receiver").cast("string").alias("receiverAccount"), F.unix_millis(F.col("w").cast("timestamp")).alias("timestamp"))
    with folder(spark, "stream") as path:
        alerts = _last_batch(jobs.ring_alerts(_stream(spark, sent.coalesce(1), f"{path}/in"), "1 hour", delay=None), path)
        return told(jobs.ring_messages(alerts).select(F.col("windowStart").alias("start_ms"), F.concat_ws(">", "ring").alias("ring")))


@query(f"""{_RINGS.replace(TX, _NAMED)} SELECT epoch_ms(w) AS start_ms, epoch_ms(w) + 3600000 AS end_ms, array_to_string(ring, '>') AS ring FROM r""")
def ring_messages(spark: SparkSession, d: str) -> DataFrame:
    """The rings in the alerts' JSON, next to messages that are none."""
    alerts = tx_alerts(spark, d).select("alert")
    noise = spark.createDataFrame([("{no",), ("{}",), (None,), ('{"rings":null}',)], "alert string")
    return jobs.ring_messages(alerts.unionAll(noise)).select(F.col("windowStart").alias("start_ms"), F.col("windowEnd").alias("end_ms"), F.concat_ws(">", "ring").alias("ring"))


@query(f"SELECT category, count(*) AS n, sum(id)::BIGINT AS ids, min(value) AS least, max(value) AS most FROM {SIM} WHERE category <> 'C' GROUP BY category")
def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """A stream into files, started twice: the second run finds nothing new."""
    with folder(spark, "stream") as path:
        rows = sim(spark, d)
        rows.repartition(2).write.parquet(f"{path}/in")
        for _ in range(2):
            stream = rel.filter_rows(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "category", "<", "C")
            jobs.to_files(stream, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
        out = spark.read.schema(rows.schema).parquet(f"{path}/out")
        return told(out.groupBy("category").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("value").alias("least"), F.max("value").alias("most")))


# Contracts and graphs.

_SPEC = {"dataset": "orders", "owner": "team", "stream": {"topic": "orders", "partitions": 3, "retention_hours": 24}, "schema": {"version": 1, "fields": [{"name": "id", "type": "long", "required": True}, {"name": "at", "type": "timestamp"}]}}
_SPECS = {
    "good": {}, "table": {"stream": None, "table": {"name": "shop.orders", "partition_by": ["day(at)", "bucket(8, id)", "id"]}}, "neither": {"stream": None}, "name": {"dataset": "Orders"}, "owner": {"owner": ""}, "key": {"extra": 1},
    "two": {"description": 5, "state": "gone"}, "stream": {"stream": {"topic": "a b", "partitions": 0}}, "parts": {"table": {"name": "a.b.c", "partition_by": ["week(at)", "day(no)"]}},
    "fields": {"schema": {"version": True, "fields": [{"name": "A", "type": "int"}, {"name": "b", "type": "decimal(40,2)"}, {"name": "c", "type": "int"}, {"name": "c", "type": "int", "required": "yes"}]}},
}


@query("SELECT * FROM (VALUES ('neither', 1), ('name', 1), ('owner', 1), ('key', 1), ('two', 2), ('stream', 3), ('parts', 3), ('fields', 5)) v(source, n)")
def spec_problems(spark: SparkSession, d: str) -> DataFrame:
    loaded = [(name, *contracts.parse_spec(_SPEC | over, name)) for name, over in _SPECS.items()]
    return contracts.problems_table(spark, loaded).groupBy("source").agg(F.count("*").cast("int").alias("n"))


_TYPES = ("string", "long", "decimal(8,2)", "decimal(8,  2)", "decimal(39,2)", "decimal(4,5)", " long", "decimal(8,2) ", "integer", "bigint")


@query("SELECT * FROM (VALUES ('string', 'string', 0, 0), ('long', 'long', 0, 0), ('decimal(8,2)', 'decimal', 8, 2), ('decimal(8,  2)', 'decimal', 8, 2), ('decimal(39,2)', NULL, NULL, NULL), ('decimal(4,5)', NULL, NULL, NULL), (' long', NULL, NULL, NULL), ('decimal(8,2) ', NULL, NULL, NULL), ('integer', NULL, NULL, NULL), ('bigint', NULL, NULL, NULL)) v(text, kind, digits, scale)")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, *(contracts.parse_type(t) or (None, None, None))) for t in _TYPES], "text string, kind string, digits int, scale int")


@query("SELECT event_id, year(ts)::INT AS ts_year, strftime(ts, '%Y-%m') AS ts_month, ts::DATE AS ts_day, epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_type AS event_type_identity FROM events")
def partition_values(spark: SparkSession, d: str) -> DataFrame:
    e = contracts.partition_columns(table(spark, d, "events"), ["year(ts)", "month(ts)", "day(ts)", "hour(ts)", "event_type"])
    return e.select("event_id", "ts_year", "ts_month", "ts_day", F.unix_millis(F.col("ts_hour").cast("timestamp")).alias("hour_ms"), "event_type_identity")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def swapped_copies(spark: SparkSession, d: str) -> DataFrame:
    """What the table points at after two shadow copies took its place."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    with folder(spark, "swap") as path:
        for rows in (n.where("n_nationkey < 5"), n):
            contracts.shadow_swap(spark, rows, path, "n_regionkey", ["n_nationkey", "n_name"])
        return told(spark.read.schema(n.schema).parquet(contracts.current_copy(spark, path)))


@query("SELECT * FROM (VALUES ('nightly', 'get', 'bash', ''), ('nightly', 'post', 'http', 'get'), ('nightly', 'end', 'dummy', 'get,post')) v(dag, task, kind, after)")
def dag_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A graph that was edited, read back from its YAML."""
    import yaml

    g = Dag()
    for node in (Node("h", "head", {"label": "nightly"}), Node("1", "bash", {"label": "fetch"}), Node("2", "http", {"label": "post", "headers": '{"a": 1}'}), Node("3", "python", {"label": "gone"}), Node("4", "dummy", {"label": "end"})):
        g.add(node)
    for source, target in (("h", "1"), ("1", "2"), ("3", "2"), ("1", "4"), ("2", "4"), ("h", "4")):
        g.connect(source, target)
    g.edit("1", label="get")
    g.delete("3")
    g.disconnect("h", "4")
    ((name, made),) = yaml.safe_load(g.to_yaml()).items()
    kinds = {r["label"]: r["kind"] for r in g.tables(spark)[0].collect()}
    return spark.createDataFrame([(name, task, kinds[task], ",".join(own.get("dependencies", []))) for task, own in made["tasks"].items()], "dag string, task string, kind string, after string")
