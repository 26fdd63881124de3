"""File sources and seeded generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION = T.StructType([
    T.StructField("transactionId", T.StringType()), T.StructField("senderAccount", T.StringType()), T.StructField("receiverAccount", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("timestamp", T.LongType()),
])
TELEMETRY = T.StructType([T.StructField("sensor_id", T.StringType()), T.StructField("temperature", T.DoubleType()), T.StructField("timestamp", T.LongType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or a single record; a file that holds other JSON, or none, gives no rows."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if "_bad" not in rows.columns:
        return rows
    return spark.read.schema(T.StructType([f for f in rows.schema if f.name != "_bad"])).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def sample_records(spark: SparkSession) -> DataFrame:
    """The built-in sample for trying mappings (fixed values)."""
    return spark.createDataFrame([("  JAMES BOND_007 ", "James.Bond@mi6.uk", 50000.556, "eu-west")], "customer_name string, email string, salary double, region_id string")


def random_rows(spark: SparkSession, count: int = 20, seed: int = 0) -> DataFrame:
    """id from 1, category A, B or C, value from 10 to 99; the same rows for a seed and partitioning."""
    rows = spark.range(1, count + 1)
    category = F.element_at(F.array(*map(F.lit, "ABC")), (F.floor(F.rand(seed) * 3) + 1).cast("int"))
    return rows.select(F.col("id").cast("int").alias("id"), category.alias("category"), (F.floor(F.rand(seed + 1) * 90) + 10).cast("int").alias("value"))


def random_transactions(spark: SparkSession, rounds: int, seed: int = 0, users: int = 100) -> DataFrame:
    """Each round is noise of one transfer (amount 10 to 100) or, one time in ten, a ring of 3 to 5 users (5000 to 15000)."""
    base = spark.range(rounds).select(F.col("id").alias("round"), (F.rand(seed) < 0.1).alias("ring"), F.floor(F.rand(seed + 1) * users).alias("first"), (F.floor(F.rand(seed + 2) * 3) + 3).cast("int").alias("n"), F.rand(seed + 3).alias("u"))
    member = lambda k: (F.col("first") + k * 7) % users
    hops = F.when(F.col("ring"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))
    rows = base.select("*", F.explode(hops).alias("k"))
    receiver = F.when(F.col("ring"), member((F.col("k") + 1) % F.col("n"))).otherwise(member(F.lit(1)))
    amount = F.when(F.col("ring"), 5000 + F.col("u") * 10000).otherwise(10 + F.col("u") * 90)
    name = lambda c: F.concat(F.lit("user_"), c.cast("string"))
    return rows.select(
        F.concat_ws("-", F.col("round"), F.col("k")).alias("transactionId"), name(member(F.col("k"))).alias("senderAccount"), name(receiver).alias("receiverAccount"),
        F.round(amount, 2).alias("amount"), (F.col("round") * 300).alias("timestamp"),
    )


def random_telemetry(spark: SparkSession, count: int, seed: int = 0, start_ms: int = 0) -> DataFrame:
    """Ten sensors, temperatures from 20 to 80 with two decimals, an event every 10 ms."""
    return spark.range(count).select(
        F.concat(F.lit("sensor_"), (F.floor(F.rand(seed) * 10) + 1).cast("string")).alias("sensor_id"), F.round(20 + F.rand(seed + 1) * 60, 2).alias("temperature"), (F.lit(start_ms) + F.col("id") * 10).alias("timestamp"),
    )


def keyed_log(spark: SparkSession, records: int, start: int = 0) -> DataFrame:
    """Records of ten keys: offset and payload."""
    from sparkloom.functions.text import key_of_offset

    return spark.range(start, start + records).select(F.col("id").alias("offset"), key_of_offset(F.col("id")).cast("binary").alias("payload"))


def decoded(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON text to columns; what does not parse as an object is dropped, missing and null fields are null."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    text = F.col(value).cast("string")
    parsed = raw.select(F.from_json(text, whole, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.ltrim(text).startswith("{").alias("_object"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("_object")).select(*[F.col("r").getField(f).alias(f) for f in schema.fieldNames()])


def open_stream(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A streaming source by name (kafka where its package is there, rate, socket, or files with a schema)."""
    return spark.readStream.format(kind).options(**options).load()


def alert_json(window_start: Column, window_end: Column, rings: Column) -> Column:
    return F.to_json(F.struct(F.unix_millis(window_start).alias("windowStart"), F.unix_millis(window_end).alias("windowEnd"), rings.alias("rings")))
