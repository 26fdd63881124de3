"""Record refinement: a mapping of fields compiled to one projection with an array of errors per row."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.registry import FunctionRegistry, default_registry

ERROR = "struct<field:string,category:string,step:string,error:string>"
#: Transformations that yield null for a value that is no number; the value is then kept and an error reported.
NUMERIC = {"round_number", "math_add"}


@dataclass
class Step:
    name: str
    parameter_to_function: dict = field(default_factory=dict)


@dataclass
class FieldMapping:
    rich_key: str
    is_key_ignored: bool = False
    rich_key_type: str | None = None
    transformation: list[Step] = field(default_factory=list)
    validation: list[Step] = field(default_factory=list)
    derivation: list[Step] = field(default_factory=list)

    def add(self, category: str, step: Step) -> None:
        getattr(self, category).append(step)

    def delete(self, category: str, at: int) -> None:
        del getattr(self, category)[at]


@dataclass
class Mapping:
    """Field mappings by input column. Columns without one are dropped."""

    fields: dict[str, FieldMapping]

    @classmethod
    def of_columns(cls, columns: Sequence[str]) -> Mapping:
        return cls({c: FieldMapping(c) for c in columns})

    def to_json(self) -> str:
        return json.dumps({"mapping": {k: asdict(v) for k, v in self.fields.items()}})

    @classmethod
    def from_json(cls, text: str) -> Mapping:
        steps = ("transformation", "validation", "derivation")
        return cls({k: FieldMapping(**{n: [Step(**s) for s in x] if n in steps else x for n, x in v.items()}) for k, v in json.loads(text)["mapping"].items()})


def _error(name: str, category: str, step: str, message: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(category).alias("category"), F.lit(step).alias("step"), message.cast("string").alias("error"))


def refine(df: DataFrame, mapping: Mapping, registry: FunctionRegistry | None = None, cast_types: bool = False) -> DataFrame:
    """Renamed, transformed and derived columns, and ``errors``.

    Transformations chain. A numeric one that meets a value that is no number reports an error; a number-typed
    value is kept then, a text that is no number becomes null, since the column is a number from there on; the chain goes on.
    Validations look at the transformed value and never drop a row. Derivations start from the transformed value, whatever
    validation says; their column is target_field_name or ``<rich_key>_derived``. Of two outputs with one name the later wins.

    Every numeric step's value is a column of its own, so that a chain of steps is as long as its steps.
    """
    registry = registry or default_registry()
    kinds = dict(df.dtypes)
    out: dict[str, Column] = {}
    errors: list[Column] = []
    rows = df.select(*[F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(df.columns)])
    for k, name in enumerate(df.columns):
        own = mapping.fields.get(name)
        if own is None or own.is_key_ignored:
            continue
        value, kind = F.col(f"_in{k}"), kinds[name]
        for j, step in enumerate(own.transformation):
            made = registry.build("transformation", step.name, value, step.parameter_to_function)
            if step.name in NUMERIC:
                rows = rows.withColumn(f"_made{k}_{j}", made)
                made = F.col(f"_made{k}_{j}")
                errors.append(F.when(made.isNull() & value.isNotNull(), _error(name, "transformation", step.name, F.lit("not a number"))))
                if kind not in ("string", "double"):
                    rows = rows.withColumn(f"_kept{k}_{j}", F.coalesce(made, value.cast("double")))
                    made = F.col(f"_kept{k}_{j}")
                kind = "double"
            else:
                kind = "string"
            value = made
        for step in own.validation:
            passed = registry.build("validation", step.name, value, step.parameter_to_function)
            errors.append(F.when(~passed, _error(name, "validation", step.name, F.lit("validation failed"))))
        casts = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean"}
        out[own.rich_key] = value.try_cast(casts[own.rich_key_type]) if cast_types and own.rich_key_type else value
        for step in own.derivation:
            parameters = dict(step.parameter_to_function)
            target = parameters.pop("target_field_name", None) or f"{own.rich_key}_derived"
            out[target] = registry.build("derivation", step.name, value, parameters)
    found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast(f"array<{ERROR}>")
    return rows.select(*[c.alias(n) for n, c in out.items()], found.cast(f"array<{ERROR}>").alias("errors"))


def error_rows(refined: DataFrame, record: str) -> DataFrame:
    """One row per error, with the column ``record`` that names the row."""
    return refined.select(F.col(record).alias("record"), F.inline("errors"))


def as_json_rows(refined: DataFrame) -> DataFrame:
    """Each refined record as a JSON object, nulls included."""
    columns = [c for c in refined.columns if c != "errors"]
    return refined.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
