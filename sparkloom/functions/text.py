"""Column functions for refining values: transformations, validations and derivations.

Each builder takes a Column and parameters and returns a Column, so a whole mapping is one projection. Text functions
keep nulls. ``compat`` builders reproduce text coercion of missing values ("None").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, in all scripts.
_EDGES = r"(?U)^\s+|\s+$"
#: What a number may look like besides what a plain cast takes: single underscores between digits.
_UNDERSCORED = r"^\s*[+-]?\d+(_\d+)*(\.\d+(_\d+)*)?([eE][+-]?\d+)?\s*$"
_SUFFIXED = r"[dDfF]\s*$"
#: Fixed value: the shape of an address.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


def as_text(c: Column) -> Column:
    return c.cast("string")


def with_missing_as_text(c: Column) -> Column:
    """Missing values as the text ``None``."""
    return F.coalesce(as_text(c), F.lit("None"))


def to_number(c: Column) -> Column:
    """A double, or null where the text is no number: digits may be grouped by underscores, type suffixes are no number."""
    text = as_text(c)
    plain = F.when(text.rlike(_UNDERSCORED), F.regexp_replace(text, "_", "")).otherwise(text)
    return F.when(~(text.rlike(_SUFFIXED) & ~F.lower(F.trim(text)).isin("inf", "-inf", "+inf")), plain.try_cast("double"))


def uppercase(c: Column) -> Column:
    return F.upper(as_text(c))


def lowercase(c: Column) -> Column:
    return F.lower(as_text(c))


def trim_whitespace(c: Column) -> Column:
    return F.regexp_replace(as_text(c), _EDGES, "")


def replace_text(c: Column, old_value: str, new_value: str) -> Column:
    """All occurrences; an empty ``old_value`` puts ``new_value`` around every character."""
    if old_value == "":
        text = as_text(c)
        return F.when(F.length(text) == 0, F.lit(new_value)).otherwise(F.concat(F.lit(new_value), F.regexp_replace(text, r"(?s)(.)", "$1" + new_value.replace("\\", "\\\\").replace("$", "\\$"))))
    return F.replace(as_text(c), F.lit(old_value), F.lit(new_value))


def substring(c: Column, start_index: int, end_index: int) -> Column:
    """Characters from start (0 is the first) to before end; negative places count from the end."""
    text, n = as_text(c), F.length(as_text(c))

    def place(i: int) -> Column:
        return F.greatest(n + int(i), F.lit(0)) if int(i) < 0 else F.least(F.lit(int(i)), n)

    return F.substring(text, place(start_index) + 1, F.greatest(place(end_index) - place(start_index), F.lit(0)))


def round_number(c: Column, decimals: int) -> Column:
    """Rounded half to even; null where the value is no number (the mapping then keeps the value and reports it)."""
    return F.bround(to_number(c), int(decimals))


def math_add(c: Column, amount_to_add: float) -> Column:
    return to_number(c) + F.lit(float(amount_to_add))


def not_null(c: Column) -> Column:
    return c.isNotNull() & (F.regexp_replace(as_text(c), _EDGES, "") != "")


def is_valid_email(c: Column) -> Column:
    return F.coalesce(as_text(c).rlike(EMAIL), F.lit(False))


def min_length(c: Column, min_chars: int) -> Column:
    return F.coalesce(F.length(as_text(c)) >= int(min_chars), F.lit(False))


def number_range(c: Column, min_value: float, max_value: float) -> Column:
    """Between both bounds, inclusive; false for what is no number, and for NaN."""
    v = to_number(c)
    return F.coalesce(~F.isnan(v) & v.between(float(min_value), float(max_value)), F.lit(False))


def validate_name_length(c: Column, min_length: int = 1, max_length: int = 50) -> Column:
    return F.coalesce(F.length(as_text(c)).between(int(min_length), int(max_length)), F.lit(False))


def extract_email_domain(c: Column) -> Column:
    """What stands between the first and the second @; null without one."""
    return F.try_element_at(F.split(as_text(c), "@"), F.lit(2))


def combine_fields(c: Column, append_text: str) -> Column:
    return F.concat_ws(" ", with_missing_as_text(c), F.lit(append_text))


def calculate_tax(c: Column, tax_percentage: float) -> Column:
    """The share of the value; 0 for what is no number."""
    return F.coalesce(to_number(c) * F.lit(float(tax_percentage) / 100), F.lit(0.0))


def split_and_trim(c: Column) -> Column:
    """Parts between commas without surrounding spaces."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def ascii_bucket(c: Column, n: int = 3) -> Column:
    """1 to n by the sum of the character codes."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return (F.aggregate(codes, F.lit(0), lambda a, x: a + x) % n + 1).cast("int")


def rotate_to_least(a: Column) -> Column:
    """An array turned so that its least element comes first; empty arrays stay."""
    i = F.array_position(a, F.array_min(a)).cast("int")
    turned = F.concat(F.slice(a, i, F.size(a)), F.slice(a, F.lit(1), i - 1))
    return F.when(F.size(a) > 0, turned).otherwise(a)


def key_of_offset(offset: Column, keys: int = 10) -> Column:
    return F.concat(F.lit("k"), (offset % keys).cast("string"))


def payload_of_offset(offset: Column) -> Column:
    return F.concat(F.lit("r"), offset.cast("string"), F.lit("-"), F.repeat(F.lit("x"), (offset % 64).cast("int")))


def segment_name(base: Column) -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(".log"))


def segment_base(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{20})\.log$", 1).try_cast("long")


def record_crc(offset: Column, payload: Column) -> Column:
    """CRC32 over offset (8 bytes), length (4 bytes) and payload, big-endian."""
    size = F.octet_length(payload)
    head = F.unhex(F.concat(F.lpad(F.hex(offset), 16, "0"), F.lpad(F.hex(size.cast("long")), 8, "0")))
    return F.crc32(F.concat(head, payload.cast("binary")))


def key_value_map(text: Column) -> Column:
    """Lines of key=value as a map."""
    return F.str_to_map(F.regexp_replace(text, r"\n+$", ""), F.lit("\n"), F.lit("="))


def transaction_label(sender: Column, receiver: Column, amount: Column) -> Column:
    return F.concat(sender, F.lit("->"), receiver, F.lit(" ($"), amount.cast("string"), F.lit(")"))


def epoch_millis_now() -> Column:
    return F.unix_millis(F.current_timestamp())
