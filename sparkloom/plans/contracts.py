"""Versioned dataset contracts: parsing with all problems reported, schema differences and compatibility verdicts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import IntEnum
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import partition_checksums
from sparkloom.sources.folders import Files, Versions

PRIMITIVES = ("string", "boolean", "int", "long", "float", "double", "date", "timestamp")
SPARK_TYPES = dict(zip(PRIMITIVES, ("string", "boolean", "int", "bigint", "float", "double", "date", "timestamp"), strict=True))
#: Shapes of names.
DATASET = re.compile(r"[a-z][a-z0-9_-]{0,62}")
FIELD = re.compile(r"[a-z][a-z0-9_]{0,62}")
TOPIC = re.compile(r"[a-zA-Z0-9._-]{1,249}")
TABLE = re.compile(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*")
TRANSFORM = re.compile(r"(?:(year|month|day|hour)\((\w+)\)|bucket\((\d+),\s*(\w+)\)|(\w+))")
DECIMAL = re.compile(r"decimal\((\d+),\s*(\d+)\)")


class Verdict(IntEnum):
    """Process exit codes."""

    OK = 0
    INVALID = 1
    BREAKING = 2


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    doc: str = ""


@dataclass(frozen=True)
class Schema:
    version: int
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Spec:
    dataset: str
    owner: str
    schema: Schema
    description: str = ""
    state: str = "active"
    stream: dict | None = None
    table: dict | None = None


@dataclass
class Problems:
    """Collects everything that is wrong with a document."""

    source: str
    found: list[str] = field(default_factory=list)

    def need(self, ok: bool, message: str) -> bool:
        if not ok:
            self.found.append(message)
        return ok

    def keys(self, where: str, value: dict, known: Sequence[str]) -> None:
        for key in sorted(set(map(str, value)) - set(known)):
            self.found.append(f"{where}: unknown key {key!r}")


def parse_type(text: object) -> tuple[str, int, int] | None:
    """(kind, precision, scale) of a type's name; None for what is no type."""
    if text in PRIMITIVES:
        return str(text), 0, 0
    found = DECIMAL.fullmatch(text) if isinstance(text, str) else None
    if found and 1 <= int(found[1]) <= 38 and int(found[2]) <= int(found[1]):
        return "decimal", int(found[1]), int(found[2])
    return None


def type_name(text: str) -> str:
    """A type's one name, however its digits are spaced; what is no type stays as it is."""
    found = parse_type(text)
    return f"decimal({found[1]},{found[2]})" if found and found[0] == "decimal" else text


def _positive(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 1


def _schema(raw: object, p: Problems) -> Schema:
    if not p.need(isinstance(raw, dict), "schema: a mapping is needed"):
        return Schema(0, ())
    p.keys("schema", raw, ("version", "fields"))
    p.need(_positive(raw.get("version")), "schema.version: an integer of 1 or more is needed")
    listed = raw.get("fields")
    if not p.need(isinstance(listed, list) and bool(listed), "schema.fields: a list that is not empty is needed"):
        listed = []
    fields: list[Field] = []
    for k, f in enumerate(listed):
        at = f"schema.fields[{k}]"
        if not p.need(isinstance(f, dict), f"{at}: a mapping is needed"):
            continue
        p.keys(at, f, ("name", "type", "required", "doc"))
        name = f.get("name")
        p.need(isinstance(name, str) and bool(FIELD.fullmatch(name)), f"{at}.name: {name!r} is no field name")
        p.need(name not in {x.name for x in fields}, f"{at}.name: {name!r} stands twice")
        p.need(parse_type(f.get("type")) is not None, f"{at}.type: {f.get('type')!r} is no type")
        p.need(isinstance(f.get("required", False), bool), f"{at}.required: true or false is needed")
        fields.append(Field(str(name), str(f.get("type")), f.get("required") is True, str(f.get("doc") or "")))
    return Schema(raw["version"] if _positive(raw.get("version")) else 0, tuple(fields))


def _stream(raw: dict, p: Problems) -> None:
    p.keys("stream", raw, ("topic", "partitions", "retention_hours", "config"))
    topic = raw.get("topic")
    p.need(isinstance(topic, str) and bool(TOPIC.fullmatch(topic)), f"stream.topic: {topic!r} is no topic name")
    for key in ("partitions", "retention_hours"):
        p.need(_positive(raw.get(key)), f"stream.{key}: an integer of 1 or more is needed")
    p.need(isinstance(raw.get("config", {}), dict), "stream.config: a mapping is needed")


def transform(text: object) -> tuple[str, str, int] | None:
    """(kind, column, buckets) of a partition transform."""
    found = TRANSFORM.fullmatch(text) if isinstance(text, str) else None
    if not found:
        return None
    if found[1]:
        return found[1], found[2], 0
    return ("bucket", found[4], int(found[3])) if found[3] else ("identity", found[5], 0)


def _table(raw: dict, schema: Schema, p: Problems) -> None:
    p.keys("table", raw, ("name", "partition_by", "properties"))
    name = raw.get("name")
    p.need(isinstance(name, str) and bool(TABLE.fullmatch(name)), f"table.name: {name!r} is no table name")
    p.need(isinstance(raw.get("properties", {}), dict), "table.properties: a mapping is needed")
    parts = raw.get("partition_by", [])
    if p.need(isinstance(parts, list), "table.partition_by: a list is needed"):
        for x in parts:
            t = transform(x)
            if p.need(t is not None, f"table.partition_by: {x!r} is no transform"):
                p.need(t[1] in {f.name for f in schema.fields}, f"table.partition_by: no field {t[1]!r}")
                p.need(t[0] != "bucket" or t[2] >= 1, f"table.partition_by: {x!r} needs a bucket or more")


def parse_spec(raw: object, source: str = "<spec>") -> tuple[Spec | None, list[str]]:
    """The spec, or None, and every problem. A stream or a table is needed; an empty section is none."""
    p = Problems(source)
    if not p.need(isinstance(raw, dict), "a mapping is needed"):
        return None, p.found
    p.keys("spec", raw, ("dataset", "owner", "description", "state", "stream", "table", "schema"))
    name = raw.get("dataset")
    p.need(isinstance(name, str) and bool(DATASET.fullmatch(name)), f"dataset: {name!r} is no dataset name")
    p.need(isinstance(raw.get("owner"), str) and bool(str(raw.get("owner")).strip()), "owner: a text is needed")
    p.need(isinstance(raw.get("description", ""), str), "description: a text is needed")
    p.need(raw.get("state", "active") in ("active", "retired"), f"state: {raw.get('state')!r} is no state")
    schema = _schema(raw.get("schema"), p)
    sections = {k: raw.get(k) for k in ("stream", "table") if raw.get(k) is not None}
    p.need(bool(sections), "a stream or a table is needed")
    for key, section in sections.items():
        if p.need(isinstance(section, dict), f"{key}: a mapping is needed"):
            _stream(section, p) if key == "stream" else _table(section, schema, p)
    if p.found:
        return None, p.found
    return Spec(name, raw["owner"].strip(), schema, raw.get("description", ""), raw.get("state", "active"), sections.get("stream"), sections.get("table")), []


def load_specs(directory: str) -> list[tuple[str, Spec | None, list[str]]]:
    """(file, spec, problems) of the YAML files of a directory, by name, without subfolders."""
    import yaml

    out = []
    for path in sorted(p for p in Path(directory).iterdir() if p.suffix in (".yaml", ".yml")):
        try:
            out.append((path.name, *parse_spec(yaml.safe_load(path.read_text()), path.name)))
        except yaml.YAMLError as error:
            out.append((path.name, None, [f"no YAML: {error}"]))
    return out


def problems_table(spark: SparkSession, loaded: Sequence[tuple[str, Spec | None, list[str]]]) -> DataFrame:
    return spark.createDataFrame([(f, x) for f, _, found in loaded for x in found], "source string, problem string")


def claims_table(spark: SparkSession, specs: Sequence[Spec]) -> DataFrame:
    """(kind, value, name): what each spec claims; for ``operators.relational.duplicate_claims``."""
    rows = [("dataset", s.dataset, f"{k}:{s.dataset}") for k, s in enumerate(specs)]
    rows += [("topic", s.stream["topic"], s.dataset) for s in specs if s.stream]
    rows += [("table", s.table["name"], s.dataset) for s in specs if s.table]
    return spark.createDataFrame(rows, "kind string, value string, name string")


def fields_table(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(k, f.name, type_name(f.type), f.required) for k, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, field string, type string, required boolean")


def is_widening(old: Column, new: Column) -> Column:
    """int to long, float to double, or a decimal of more digits and the same scale."""
    digits = lambda c, k: F.regexp_extract(c, r"^decimal\((\d+),\s*(\d+)\)$", k)
    numbers = lambda c, k: digits(c, k).try_cast("int")
    decimals = (numbers(old, 2) == numbers(new, 2)) & (numbers(new, 1) > numbers(old, 1))
    return ((old == "int") & (new == "long")) | ((old == "float") & (new == "double")) | F.coalesce(decimals, F.lit(False))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, what, breaking) from two field tables: added, dropped, retyped, and requiredness, in that order."""
    both = old.alias("o").join(new.alias("n"), "field", "full").select("field", F.col("o.type").alias("ot"), F.col("n.type").alias("nt"), F.col("o.required").alias("oreq"), F.col("n.required").alias("nreq"), F.col("o.position").alias("op"), F.col("n.position").alias("np"))
    change = lambda rank, place, when, what, breaking: F.when(when, F.struct(F.lit(rank).alias("rank"), place.alias("place"), what.alias("what"), breaking.alias("breaking")))
    o, n = F.col("ot"), F.col("nt")
    wider = is_widening(o, n)
    retyped = o.isNotNull() & n.isNotNull() & (o != n)
    found = F.array(
        change(0, F.col("np"), o.isNull(), F.when(F.col("nreq"), F.lit("added as required")).otherwise(F.lit("added as optional")), F.coalesce(F.col("nreq"), F.lit(False))),
        change(1, F.col("op"), n.isNull(), F.lit("dropped"), F.lit(True)),
        change(2, F.col("op"), retyped, F.concat(F.when(wider, F.lit("widened ")).otherwise(F.lit("type changed ")), o, F.lit(" -> "), n), ~wider),
        change(3, F.col("op"), o.isNotNull() & n.isNotNull() & (F.col("oreq") != F.col("nreq")), F.when(F.col("nreq"), F.lit("optional -> required")).otherwise(F.lit("required -> optional")), F.coalesce(F.col("nreq"), F.lit(False))),
    )
    rows = both.select("field", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c"))
    return rows.orderBy(F.least("c.rank", F.lit(2)), "c.place", "c.rank", "field").select("field", "c.what", "c.breaking")


def version_problems(old: Schema, new: Schema, changed: bool) -> list[str]:
    if new.version < old.version:
        return [f"version goes back from {old.version} to {new.version}"]
    if changed and new.version == old.version:
        return [f"fields changed but version is still {old.version}"]
    return []


def compatibility(spark: SparkSession, old: Schema, new: Schema, allow_breaking: bool = False) -> tuple[DataFrame, list[str], Verdict]:
    """The changes, the version problems and the verdict; version problems come before breaking changes."""
    changes = schema_changes(fields_table(spark, old), fields_table(spark, new))
    found = changes.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking")).first()
    problems = version_problems(old, new, found["n"] > 0)
    if problems:
        return changes, problems, Verdict.INVALID
    return changes, problems, Verdict.BREAKING if found["breaking"] and not allow_breaking else Verdict.OK


def plan(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, action) from desired (name, state, fingerprint) and actual (name, fingerprint) datasets."""
    both = desired.alias("d").join(actual.alias("a"), "name", "full")
    action = (
        F.when(F.col("d.state").isNull(), "unmanaged").when(F.col("d.state") == "retired", F.when(F.col("a.fingerprint").isNull(), "gone").otherwise("retired"))
        .when(F.col("a.fingerprint").isNull(), "missing").when(F.col("a.fingerprint") != F.col("d.fingerprint"), "divergent").otherwise("in sync")
    )
    return both.select("name", action.alias("action"))


def partition_columns(df: DataFrame, transforms: Sequence[str]) -> DataFrame:
    """``df`` with a column for each partition transform, named after it."""
    made = {}
    for text in transforms:
        kind, column, n = transform(text)
        c = F.col(column)
        made[f"{column}_{kind}"] = {"year": F.year(c), "month": F.date_format(c, "yyyy-MM"), "day": F.to_date(c), "hour": F.date_trunc("hour", c)}.get(kind, F.pmod(F.xxhash64(c), F.lit(n)) if kind == "bucket" else c)
    return df.withColumns(made)


def current_copy(spark: SparkSession, table_path: str) -> str | None:
    """The path of the copy that the table points at."""
    found = Versions(spark, f"{table_path}/current").load()
    return found.decode() if found else None


def shadow_swap(spark: SparkSession, df: DataFrame, table_path: str, partition: str, keys: Sequence[str]) -> str:
    """Writes a shadow copy, verifies it against ``df`` by checksums, and points the table at it; the old copy goes last.

    The pointer in ``table_path``/current is replaced as a whole: a crash at any moment leaves the old or the new copy in place.
    """
    shadow = f"{table_path}/data-{uuid.uuid4().hex}"
    df.write.partitionBy(partition).parquet(shadow)
    want, got = (partition_checksums(x, partition, keys).select(F.col(partition).cast("string").alias("p"), "rows", "checksum") for x in (df, spark.read.parquet(shadow)))
    if not want.exceptAll(got).isEmpty() or not got.exceptAll(want).isEmpty():
        raise ValueError("the shadow copy differs")
    old = current_copy(spark, table_path)
    Versions(spark, f"{table_path}/current").save(shadow.encode())
    if old:
        Files(spark, old).delete()
    return shadow
