"""Registered queries for the engine's own operators, each with SQL for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.operators import relational as rel
from sparkloom.operators import rings
from sparkloom.plans import contracts
from sparkloom.plans.refine import FieldMapping, Mapping, Step, as_json_rows, error_rows, refine
from sparkloom.sources.folders import Files, scratch
from sparkloom.sources.log import HEADER, Consumer, Log, LogConfig, verified
from sparkloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(made: Query) -> Query:
        _QUERIES[made.__name__] = made
        if sql:
            _SQL[made.__name__] = sql
        return made

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views that both sides define alike.


def sim(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("user_id") % 3 + 1).cast("int")).alias("category"), "value")


SIM = "(SELECT event_id AS id, substr('ABC', (user_id % 3 + 1)::INT, 1) AS category, value FROM events)"


def raw(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    email = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("invalid"), F.col("c_custkey"))).otherwise(F.concat(F.lower("c_mktsegment"), F.col("c_custkey"), F.lit("@mail.example")))
    return c.select("c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("customer_name"), email.alias("email"), F.col("c_acctbal").alias("salary"), F.col("c_nationkey").cast("string").alias("region_id"))


RAW = "(SELECT c_custkey, '  ' || c_name || ' ' AS customer_name, CASE WHEN c_custkey % 7 = 0 THEN 'invalid' || c_custkey ELSE lower(c_mktsegment) || c_custkey || '@mail.example' END AS email, c_acctbal AS salary, c_nationkey::VARCHAR AS region_id FROM customer)"


def tx(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("w", F.date_trunc("hour", "ts"))
    nxt = F.lead("user_id").over(Window.partitionBy("w").orderBy("ts", "event_id"))
    return e.select("event_id", "w", F.col("user_id").alias("sender"), nxt.alias("receiver"), F.col("value").alias("amount"), "ts").where("receiver is not null")


TX = "(SELECT * FROM (SELECT event_id, date_trunc('hour', ts) AS w, user_id AS sender, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS receiver, value AS amount, ts FROM events) WHERE receiver IS NOT NULL)"


def tel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("sensor_"), (F.col("user_id") % 10 + 1).cast("string")).alias("sensor_id"), F.col("value").alias("temperature"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))


TEL = "(SELECT 'sensor_' || (user_id % 10 + 1) AS sensor_id, value AS temperature, epoch_us(ts) // 1000 AS timestamp FROM events)"
SEGMENT = 100


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("offset"), fn.key_of_offset(F.col("event_id")).alias("payload"), (F.col("event_id") - F.col("event_id") % SEGMENT).alias("segment_base"))


LOG = f"(SELECT event_id AS \"offset\", 'k' || (event_id % 10) AS payload, event_id - event_id % {SEGMENT} AS segment_base FROM events)"


# Refinement.


def _mapping() -> Mapping:
    m = Mapping.of_columns(["c_custkey", "customer_name", "email", "salary", "region_id"])
    m.fields["customer_name"] = FieldMapping("name", transformation=[Step("trim_whitespace"), Step("lowercase"), Step("replace_text", {"old_value": "customer", "new_value": "client"})], validation=[Step("validate_name_length", {"min_length": 5, "max_length": 15})])
    m.fields["email"] = FieldMapping("email", validation=[Step("is_valid_email"), Step("not_null")], derivation=[Step("extract_email_domain", {"target_field_name": "domain"})])
    m.fields["salary"] = FieldMapping("pay", transformation=[Step("math_add", {"amount_to_add": 100})], validation=[Step("number_range", {"min_value": 0, "max_value": 9000})], derivation=[Step("calculate_tax", {"tax_percentage": 20})])
    m.fields["region_id"] = FieldMapping("region_id", is_key_ignored=True)
    return m


_NAME = "replace(lower(trim(customer_name)), 'customer', 'client')"


@query(f"SELECT c_custkey, {_NAME} AS name, email, CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) END AS domain, salary + 100 AS pay, (salary + 100) * 0.2 AS pay_derived, (NOT length({_NAME}) BETWEEN 5 AND 15)::INT + (NOT contains(email, '@'))::INT + (NOT (salary + 100) BETWEEN 0 AND 9000)::INT AS n_errors FROM {RAW}")
def refine_records(spark: SparkSession, d: str) -> DataFrame:
    return refine(raw(spark, d), _mapping()).withColumn("n_errors", F.size("errors")).drop("errors")


@query(f"SELECT c_custkey AS record, 'email' AS field, 'validation' AS category, 'is_valid_email' AS step, 'validation failed' AS error FROM {RAW} WHERE NOT contains(email, '@') UNION ALL SELECT c_custkey, 'salary', 'validation', 'number_range', 'validation failed' FROM {RAW} WHERE NOT (salary + 100) BETWEEN 0 AND 9000 UNION ALL SELECT c_custkey, 'customer_name', 'validation', 'validate_name_length', 'validation failed' FROM {RAW} WHERE NOT length({_NAME}) BETWEEN 5 AND 15")
def refine_errors(spark: SparkSession, d: str) -> DataFrame:
    return error_rows(refine(raw(spark, d), _mapping()), "c_custkey")


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (NOT contains(email, '@')) AS n_bad FROM {RAW}")
def refine_error_count(spark: SparkSession, d: str) -> DataFrame:
    out = refine(raw(spark, d), _mapping())
    return out.agg(F.count("*").alias("n_rows"), F.count_if(F.exists("errors", lambda e: e["step"] == "is_valid_email")).alias("n_bad"))


@query("SELECT to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS json FROM region")
def refined_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").select("r_regionkey", "r_name")
    return as_json_rows(refine(rows, Mapping.of_columns(rows.columns)))


@query("SELECT c_custkey, upper(c_name) AS upper_name, lower(c_name) AS lower_name, c_name[2:5] AS middle, right(c_name, 4) AS last_four, replace(c_name, '0', 'o') AS replaced, c_acctbal + 1.5 AS added, length(c_name) >= 10 AS long_enough, c_name || ' tail' AS combined, c_acctbal * 0.19 AS tax FROM customer")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    c, name, pay = table(spark, d, "customer"), F.col("c_name"), F.col("c_acctbal")
    return c.select(
        "c_custkey", fn.uppercase(name).alias("upper_name"), fn.lowercase(name).alias("lower_name"), fn.substring(name, 1, 5).alias("middle"), fn.substring(name, -4, 1000).alias("last_four"),
        fn.replace_text(name, "0", "o").alias("replaced"), fn.math_add(pay, 1.5).alias("added"), fn.min_length(name, 10).alias("long_enough"), fn.combine_fields(name, "tail").alias("combined"), fn.calculate_tax(pay, 19).alias("tax"),
    )


@query("SELECT c_custkey, (c // 10 + (c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1))::INT) / 10.0 AS tenths, n IS NOT NULL AND trim(n) <> '' AS present FROM (SELECT c_custkey, abs(round(c_acctbal * 100)::BIGINT) AS c, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE c_name END AS n FROM customer)")
def rounding_and_presence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 4 == 1, "   ").when(F.col("c_custkey") % 4 > 1, F.col("c_name"))
    return c.select("c_custkey", fn.round_number(F.abs("c_acctbal"), 1).alias("tenths"), fn.not_null(name).alias("present"))


_ADDRESSES = ("a+b{}@x.com", "x@y{}.c-d", "x@y_z{}.com", "no-at{}.com", "a{}@b", "a.b-c_{}@d.e.f", "@{}.com", "ä{}@x.com")


@query(f"SELECT c_custkey, address, regexp_full_match(address, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+[.][a-zA-Z0-9.-]+') AS valid FROM (SELECT c_custkey, replace({list(_ADDRESSES)}[c_custkey % {len(_ADDRESSES)} + 1], '{{}}', c_custkey::VARCHAR) AS address FROM customer)")
def address_validity(spark: SparkSession, d: str) -> DataFrame:
    shapes = F.array(*map(F.lit, _ADDRESSES))
    address = F.replace(F.get(shapes, (F.col("c_custkey") % len(_ADDRESSES)).cast("int")), F.lit("{}"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", address.alias("address")).withColumn("valid", fn.is_valid_email(F.col("address")))


@query("SELECT c_custkey, list_sum(list_transform(string_split(c_mktsegment, ''), lambda x: ascii(x)))::INT % 3 + 1 AS bucket FROM customer")
def ascii_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", rel.bucket_of("c_mktsegment").alias("bucket"))


# Filters, groups, order.


@query(f"SELECT * FROM {SIM} WHERE category = 'A'")
def filter_equal(spark: SparkSession, d: str) -> DataFrame:
    return rel.filter_rows(sim(spark, d), "category", "==", "A")


@query(f"SELECT * FROM {SIM} WHERE value > 50")
def filter_greater(spark: SparkSession, d: str) -> DataFrame:
    return rel.filter_rows(sim(spark, d), "value", ">", "50")


@query(f"SELECT * FROM {SIM} WHERE value < 50")
def filter_less(spark: SparkSession, d: str) -> DataFrame:
    return rel.filter_rows(sim(spark, d), "value", "<", "50")


def _group(agg: str) -> None:
    name = "count" if agg == "count" else "value"
    what = "count(*)" if agg == "count" else f"{agg}(value)"

    def made(spark: SparkSession, d: str) -> DataFrame:
        out = rel.group_by(sim(spark, d), "category", agg)
        return out if agg == "count" else out.withColumn("value", F.round("value", 6))

    made.__name__ = f"group_{agg}"
    query(f"SELECT category, {what if agg == 'count' else f'round({what}, 6)'} AS {name} FROM {SIM} GROUP BY category")(made)


for _agg in rel.AGGREGATES:
    _group(_agg)


@query(f"SELECT id, value FROM {SIM} ORDER BY value DESC NULLS LAST, id LIMIT 100")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return rel.top(sim(spark, d), "value", 100, tie=["id"]).select("id", "value")


@query(f"SELECT id, value, row_number() OVER (ORDER BY value NULLS LAST, id) - 1 AS place FROM {SIM}")
def sorted_values(spark: SparkSession, d: str) -> DataFrame:
    """The sorted rows with the places at which they stand: partitions in order, and rows in order within each."""
    return rel.with_places(rel.order_by(sim(spark, d), "value", tie=["id"]).select("id", "value"))


@query(f"SELECT block, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT id, ntile(3) OVER (ORDER BY id)::INT AS block FROM {SIM}) GROUP BY block")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    return rel.blocks(sim(spark, d), "id", 3).groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


def _dealt(name: str, deal: Callable[[DataFrame], DataFrame]) -> None:
    def made(spark: SparkSession, d: str) -> DataFrame:
        return deal(sim(spark, d))

    made.__name__ = name
    query(f"SELECT * FROM {SIM}")(made)


_dealt("repartition_random", lambda df: rel.repartition_random(df, 3))
_dealt("repartition_hash", lambda df: rel.repartition_hash(df, "category", 3))
_dealt("repartition_skewed", lambda df: rel.repartition_skewed(df, 0.9, 3))
_dealt("coalesce_partitions", lambda df: rel.coalesce(df, 2))
_dealt("range_partitions", lambda df: rel.range_partitioned(df, "value", 3))


@query(f"SELECT ascii(category)::INT % 3 + 1 AS \"to\", count(*) AS n FROM {SIM} GROUP BY 1")
def shuffle_trace(spark: SparkSession, d: str) -> DataFrame:
    return rel.movement(sim(spark, d), rel.bucket_of("category")).groupBy("to").agg(F.sum("count").alias("n"))


@query(f"SELECT category AS partition, count(*) AS rows, least(count(*) / 3000.0, 1.0)::DOUBLE AS load, count(*) > 3000 AS over FROM {SIM} GROUP BY category")
def memory_report(spark: SparkSession, d: str) -> DataFrame:
    return rel.over_limit(sim(spark, d), F.col("category"), 3000)


# Sets.


@query(f"SELECT id, category, value, NULL::VARCHAR AS note FROM {SIM} UNION ALL SELECT id, category, NULL, 'twice' FROM {SIM} WHERE category = 'B'")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = sim(spark, d)
    return rel.union_all(s.withColumn("note", F.lit(None).cast("string")), s.where("category = 'B'").select("id", "category", F.lit("twice").alias("note")))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) OR value > 100")
def union_of_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("event_type"))
    return rel.union_distinct(e.join(F.broadcast(least), "event_type").select("user_id"), e.where("value > 100").select("user_id"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def lost_records(spark: SparkSession, d: str) -> DataFrame:
    return rel.difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT min(event_id) = 0 AND count(DISTINCT event_id) = max(event_id) + 1 AS gapless FROM events")
def gapless(spark: SparkSession, d: str) -> DataFrame:
    return rel.is_gapless(table(spark, d, "events"), "event_id")


# Rings.

_RINGS = f"""
WITH RECURSIVE e AS (SELECT DISTINCT w, sender AS src, receiver AS dst FROM {TX} WHERE sender <> receiver),
p AS (SELECT w, src AS start, dst AS node, [src, dst] AS path FROM e WHERE dst > src UNION ALL
  SELECT p.w, p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.w = p.w AND e.src = p.node WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst)),
r AS (SELECT p.w, p.path AS ring FROM p JOIN e ON e.w = p.w AND e.src = p.node AND e.dst = p.start)
"""


def _payments(spark: SparkSession, d: str) -> DataFrame:
    return rings.edges(tx(spark, d), "w", "sender", "receiver")


@query(f"{_RINGS} SELECT w, array_to_string(ring, ',') AS ring FROM r")
def ring_search(spark: SparkSession, d: str) -> DataFrame:
    return rings.find_ring_texts(_payments(spark, d))


@query(f"{_RINGS} SELECT w, count(*) AS n_rings, max(len(ring))::INT AS longest FROM r GROUP BY w")
def ring_counts(spark: SparkSession, d: str) -> DataFrame:
    return rings.count_rings(_payments(spark, d))


@query(f"{_RINGS} SELECT w, i AS step, ring[i] AS src, ring[i + 1] AS dst FROM (SELECT w, ring, unnest(range(1, len(ring)))::INT AS i FROM r)")
def ring_display_edges(spark: SparkSession, d: str) -> DataFrame:
    return rings.find_ring_edges(_payments(spark, d))


_NAMED = f"(SELECT w, sender::VARCHAR AS sender, receiver::VARCHAR AS receiver FROM {TX})"


@query(f"""{_RINGS.replace(TX, _NAMED)}, k AS (SELECT w, ring, row_number() OVER (PARTITION BY w ORDER BY ring) AS i FROM r)
SELECT epoch_ms(w) AS start_ms, count(*) AS n_rings, '{{"windowStart":' || epoch_ms(w) || ',"windowEnd":' || (epoch_ms(w) + 3600000) || ',"rings":' || to_json(list(ring ORDER BY ring))::VARCHAR || '}}' AS alert FROM k WHERE i <= {rings.MAX_RINGS} GROUP BY w""")
def tx_alerts(spark: SparkSession, d: str) -> DataFrame:
    """One alert for each hour that has rings, as its JSON."""
    t = tx(spark, d).select(F.col("sender").cast("string").alias("senderAccount"), F.col("receiver").cast("string").alias("receiverAccount"), F.unix_millis(F.col("w").cast("timestamp")).alias("timestamp"))
    return jobs.ring_alerts(t, "1 hour").select(F.unix_millis("start").alias("start_ms"), F.size("rings").cast("long").alias("n_rings"), "alert")


@query(f"SELECT w, sender, array_to_string(list_sort(list(DISTINCT receiver)), ',') AS receivers FROM {TX} WHERE sender <> receiver GROUP BY w, sender")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = rings.edges(tx(spark, d), "w", "sender", "receiver")
    return e.groupBy("w", F.col("src").alias("sender")).agg(F.concat_ws(",", F.array_sort(F.collect_set("dst")).cast("array<string>")).alias("receivers"))


@query("SELECT s_suppkey, array_to_string(list_concat(a[i:], a[:i - 1]), ',') AS turned FROM (SELECT s_suppkey, a, list_position(a, list_min(a)) AS i FROM (SELECT s_suppkey, [s_suppkey % 7, s_suppkey % 5, s_suppkey % 3 + 10, s_suppkey % 11] AS a FROM supplier))")
def ring_rotation(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(*[F.expr(x) for x in ("s_suppkey % 7", "s_suppkey % 5", "s_suppkey % 3 + 10", "s_suppkey % 11")])
    return table(spark, d, "supplier").select("s_suppkey", a.alias("a")).select("s_suppkey", F.concat_ws(",", fn.rotate_to_least(F.col("a")).cast("array<string>")).alias("turned"))


@query(f"SELECT event_id, sender || '->' || receiver || ' ($' || floor(amount)::BIGINT || ')' AS label FROM {TX}")
def transaction_labels(spark: SparkSession, d: str) -> DataFrame:
    t = tx(spark, d)
    return t.select("event_id", fn.transaction_label(F.col("sender").cast("string"), F.col("receiver").cast("string"), F.floor("amount")).alias("label"))


# Windows and logs.


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 10 SECOND, make_timestamp(timestamp * 1000))) AS start_ms, sensor_id, round(avg(temperature), 6) AS avg_temperature, count(*) AS n FROM {TEL} GROUP BY ALL")
def telemetry_windows(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.window_averages(tel(spark, d))
    return out.select(F.unix_millis("window_start").alias("start_ms"), "sensor_id", F.round("avg_temperature", 6).alias("avg_temperature"), "n")


@query(f"SELECT sensor_id, count(*) AS n, min(timestamp) AS first_ms, max(timestamp) AS last_ms, 0::BIGINT AS turns FROM {TEL} GROUP BY sensor_id")
def tel_partition_order(spark: SparkSession, d: str) -> DataFrame:
    """As a keyed producer sends them: what comes first and last for each sensor, and how often time goes back or its rows lie in two places."""
    sent = jobs.by_key(tel(spark, d), "sensor_id").withColumn("place", F.monotonically_increasing_id())
    before = F.lag(F.struct("timestamp", "place")).over(Window.partitionBy("sensor_id").orderBy("place"))
    turned = (before["timestamp"] > F.col("timestamp")) | (F.shiftright(before["place"], 33) != F.shiftright("place", 33))
    rows = sent.withColumn("turned", F.coalesce(turned, F.lit(False)))
    return rows.groupBy("sensor_id").agg(F.count("*").alias("n"), F.min_by("timestamp", "place").alias("first_ms"), F.max_by("timestamp", "place").alias("last_ms"), F.count_if("turned").alias("turns"))


@query(f"SELECT payload AS key, count(*) AS count FROM {LOG} GROUP BY payload")
def log_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.keyed_counts(log(spark, d))


@query(f"SELECT payload AS key, (count(*) + count(*) FILTER (\"offset\" >= 0 AND \"offset\" < 500))::BIGINT AS count FROM {LOG} GROUP BY payload")
def log_counts_split(spark: SparkSession, d: str) -> DataFrame:
    return jobs.naive_counts(log(spark, d), crash_at=730)


@query(f"SELECT payload AS key, count(*) AS left_count, 2 * count(*) AS right_count, -count(*) AS delta FROM {LOG} GROUP BY payload")
def count_verification(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return rel.compare_counts(jobs.keyed_counts(rows), jobs.keyed_counts(rows.unionAll(rows)), "key")


@contextmanager
def written_log(spark: SparkSession, d: str) -> Iterator[Log]:
    """A log in the shared folder that holds all events, appended in two batches; it goes afterwards.

    Payloads have two bytes, so segments of SEGMENT records are full with these bytes.
    """
    path = scratch(spark, "log")
    made = Log(spark, path, LogConfig(segment_bytes=SEGMENT * (HEADER.size + 2)))
    rows = log(spark, d)
    cut = rows.agg(F.floor(F.max("offset") * 0.37)).first()[0]
    try:
        made.append(rows.where(F.col("offset") <= cut), "offset")
        made.append(rows.where(F.col("offset") > cut), "offset")
        yield made
    finally:
        Files(spark, path).delete()


def told(df: DataFrame) -> DataFrame:
    """A small result that no longer needs its log: limited reads, and one row for each segment at most."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@query(f"SELECT \"offset\", payload FROM {LOG} WHERE \"offset\" >= 250 ORDER BY \"offset\" LIMIT 40")
def log_read_from(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        return told(made.read_from(250, 40).withColumn("payload", F.col("payload").cast("string")))


@query(f"SELECT \"offset\", payload FROM {LOG} WHERE \"offset\" = 77")
def log_point_read(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        found = made.read(77)
    return spark.createDataFrame([(77, found.decode())] if found is not None else [], "offset long, payload string")


@query(f"SELECT min(segment_base) AS first_offset, max(\"offset\") + 1 AS next_offset FROM {LOG}")
def log_bounds(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        return spark.createDataFrame([(made.first_offset(), made.next_offset())], "first_offset long, next_offset long")


@query(f"SELECT segment_base, count(*) AS n, max(\"offset\") AS last, sum(length(payload))::BIGINT AS bytes FROM {LOG} GROUP BY segment_base")
def log_segments(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        return told(made.rows().groupBy("segment_base").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.sum(F.octet_length("payload")).alias("bytes")))


@query(f"SELECT segment_base FROM (SELECT segment_base, lead(segment_base) OVER (ORDER BY segment_base) AS n FROM (SELECT DISTINCT segment_base FROM {LOG})) WHERE n <= 450")
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        before = {r[0] for r in made.segments().collect()}
        made.delete_up_to(450)
        gone = before - {r[0] for r in made.segments().collect()}
    return spark.createDataFrame([(x,) for x in gone], "segment_base long")


@query(f"SELECT name, greatest(least(polled, n), f) AS position, greatest(n - greatest(least(polled, n), f), 0) AS lag FROM (VALUES ('none', 0), ('some', 30), ('all', 1000000000)) g(name, polled), (SELECT max(\"offset\") + 1 AS n, 200 AS f FROM {LOG})")
def log_consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    """Three groups, after retention has taken the first two segments: one without a commit, one whose commit is below what is left, one at the end."""
    with written_log(spark, d) as made:
        some, every = Consumer(made, "some"), Consumer(made, "all")
        some.poll(30)
        some.commit()
        every.position = made.next_offset()
        every.commit()
        made.delete_up_to(250)
        groups = [(name, Consumer(made, name)) for name in ("none", "some", "all")]
        return spark.createDataFrame([(name, c.position, c.lag()) for name, c in groups], "name string, position long, lag long")


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN payload = 'k' || (\"offset\" % 10) THEN 'OK' ELSE 'BAD' END AS status FROM {LOG}) GROUP BY status")
def log_verification(spark: SparkSession, d: str) -> DataFrame:
    with written_log(spark, d) as made:
        return told(verified(made.rows(), fn.key_of_offset(F.col("offset"))).groupBy("status").agg(F.count("*").alias("n")))


@query(f"SELECT payload AS key, count(*) AS count FROM {LOG} GROUP BY payload")
def log_counts_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept with their position, in three runs."""
    path = scratch(spark, "counts")
    with written_log(spark, d) as made:
        for limit in (333, 1, made.next_offset()):
            jobs.count_next(made, path, limit)
        out = told(jobs.counted(spark, path)[0])
    Files(spark, path).delete()
    return out


@query("SELECT event_id, 'r' || event_id || '-' || repeat('x', (event_id % 64)::INT) AS payload, lpad(event_id::VARCHAR, 20, '0') || '.log' AS segment, event_id AS base FROM events")
def log_codecs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", fn.payload_of_offset(F.col("event_id")).alias("payload"), fn.segment_name(F.col("event_id")).alias("segment"))
    return e.withColumn("base", fn.segment_base(F.col("segment")))


@query("SELECT n_nationkey, 3 AS n_keys, n_name AS name, n_regionkey::VARCHAR AS region, '' AS none FROM nation")
def state_codec(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("name="), "n_name", F.lit("\nregion="), "n_regionkey", F.lit("\nnone=\n"))
    m = table(spark, d, "nation").select("n_nationkey", fn.key_value_map(text).alias("m"))
    return m.select("n_nationkey", F.size("m").alias("n_keys"), F.col("m")["name"].alias("name"), F.col("m")["region"].alias("region"), F.col("m")["none"].alias("none"))


# Contracts and graphs.

OLD = contracts.Schema(1, (contracts.Field("id", "long", True), contracts.Field("amount", "int", True), contracts.Field("note", "string"), contracts.Field("gone", "date"), contracts.Field("rate", "decimal(8,2)")))
NEW = contracts.Schema(2, (contracts.Field("id", "long", True), contracts.Field("amount", "long", False), contracts.Field("note", "int"), contracts.Field("fresh", "string", True), contracts.Field("rate", "decimal(10,2)"), contracts.Field("extra", "string")))


@query("SELECT * FROM (VALUES ('fresh', 'added as required', true), ('extra', 'added as optional', false), ('gone', 'dropped', true), ('amount', 'widened int -> long', false), ('amount', 'required -> optional', false), ('note', 'type changed string -> int', true), ('rate', 'widened decimal(8,2) -> decimal(10,2)', false)) v(field, what, breaking)")
def contract_diff(spark: SparkSession, d: str) -> DataFrame:
    return contracts.schema_changes(contracts.fields_table(spark, OLD), contracts.fields_table(spark, NEW))


_PAIRS = {
    "same": (OLD, OLD), "breaking": (OLD, NEW), "older": (NEW, OLD), "unversioned": (OLD, contracts.Schema(1, NEW.fields)),
    "wider": (OLD, contracts.Schema(2, tuple(contracts.Field(f.name, {"int": "long", "decimal(8,2)": "decimal(12, 2)"}.get(f.type, f.type), f.required) for f in OLD.fields))),
    "respelled": (OLD, contracts.Schema(1, tuple(contracts.Field(f.name, f.type.replace(",", ", "), f.required) for f in OLD.fields))),
}


@query("SELECT * FROM (VALUES ('same', 0, 0), ('breaking', 2, 7), ('older', 1, 7), ('unversioned', 1, 7), ('wider', 0, 2), ('respelled', 0, 0)) v(pair, verdict, n_changes)")
def con_verdict(spark: SparkSession, d: str) -> DataFrame:
    found = [(name, contracts.compatibility(spark, old, new)) for name, (old, new) in _PAIRS.items()]
    return spark.createDataFrame([(name, int(verdict), changes.count()) for name, (changes, _, verdict) in found], "pair string, verdict int, n_changes int")


@query("SELECT n_name AS value, 'nation' AS kind, 'a,b' AS names FROM nation WHERE n_nationkey % 2 = 0")
def claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("value"), "n_nationkey")
    claims = n.select("kind", "value", F.lit("a").alias("name")).unionAll(n.where("n_nationkey % 2 = 0").select("kind", "value", F.lit("b").alias("name")))
    return rel.duplicate_claims(claims).select("kind", "value", F.concat_ws(",", "names").alias("names"))


@query("SELECT n_regionkey, count(*) AS rows FROM nation GROUP BY n_regionkey")
def backfill_checksums(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = (rel.partition_checksums(x, "n_regionkey", ["n_nationkey", "n_name"]) for x in (n, n.repartition(3)))
    return a.join(b, ["n_regionkey", "rows", "checksum"]).select("n_regionkey", "rows")


@query("SELECT CASE WHEN n_nationkey % 4 = 1 THEN 'missing' WHEN n_nationkey % 4 = 2 THEN 'divergent' WHEN n_nationkey % 4 = 3 THEN 'unmanaged' ELSE 'in sync' END AS action, count(*) AS n FROM nation GROUP BY 1")
def contract_plan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    desired = n.where("k % 4 <> 3").select("name", F.lit("active").alias("state"), F.lit("v1").alias("fingerprint"))
    actual = n.where("k % 4 <> 1").select("name", F.when(F.col("k") % 4 == 2, "v0").otherwise("v1").alias("fingerprint"))
    return contracts.plan(desired, actual).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS dst, array_to_string(list_sort(list(n_name)), ',') AS upstream FROM nation GROUP BY n_regionkey")
def task_dependencies(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "nation").select(F.col("n_name").alias("src"), F.col("n_regionkey").alias("dst"))
    return rings.dependencies(links).select("dst", F.concat_ws(",", "upstream").alias("upstream"))


from sparkloom import queries_io  # noqa: E402, F401  (registers its queries; it uses the views above)
