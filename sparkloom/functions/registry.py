"""A registry of named functions in three categories, looked up by the refinement plan."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from sparkloom.functions import text

CATEGORIES = ("transformation", "validation", "derivation")


@dataclass
class FunctionRegistry:
    """Builders by category and name. A builder takes the value's Column first, then parameters by name."""

    builders: dict[str, dict[str, Callable[..., Column]]] = field(default_factory=lambda: {c: {} for c in CATEGORIES})

    def register(self, category: str, name: str, builder: Callable[..., Column]) -> None:
        if category not in self.builders:
            raise KeyError(f"no category {category!r}")
        self.builders[category][name] = builder

    def build(self, category: str, name: str, value: Column, parameters: dict) -> Column:
        if name not in self.builders[category]:
            raise KeyError(f"no {category} {name!r}")
        return self.builders[category][name](value, **parameters)

    def parameters(self) -> dict[str, dict[str, list[str]]]:
        """{category: {name: parameter names}}, without the value itself."""
        return {c: {n: list(inspect.signature(b).parameters)[1:] for n, b in own.items()} for c, own in self.builders.items()}

    def describe(self) -> dict[str, dict[str, str]]:
        return {c: {n: (inspect.getdoc(b) or "").partition("\n")[0] for n, b in own.items()} for c, own in self.builders.items()}


def default_registry() -> FunctionRegistry:
    made = FunctionRegistry()
    own = {
        "transformation": (text.uppercase, text.lowercase, text.trim_whitespace, text.replace_text, text.substring, text.round_number, text.math_add),
        "validation": (text.not_null, text.is_valid_email, text.min_length, text.number_range, text.validate_name_length),
        "derivation": (text.extract_email_domain, text.combine_fields, text.calculate_tax),
    }
    for category, builders in own.items():
        for builder in builders:
            made.register(category, builder.__name__, builder)
    return made
