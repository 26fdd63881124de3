from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.functions.registry import default_registry
from sparkloom.plans.refine import FieldMapping, Mapping, Step, error_rows, refine

VALUES = ["  Ab c ", "", None, "ß", "12.5", "1_000", "5d", "nan", "a@b@c", "x@y.zz", "long enough text", " wide "]


def rows(spark, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(("start", "end"), [(0, 3), (-3, 100), (2, -1), (5, 2), (-100, 2), (100, 200), (-2, -1)])
def test_substring_slices_like_python(spark, start, end):
    assert rows(spark, fn.substring(F.col("v"), start, end)) == [None if v is None else v[start:end] for v in VALUES]


def test_text_functions_agree_with_python(spark):
    v = F.col("v")
    assert rows(spark, fn.uppercase(v)) == [None if x is None else x.upper() for x in VALUES]
    assert rows(spark, fn.trim_whitespace(v)) == [None if x is None else x.strip() for x in VALUES]
    assert rows(spark, fn.replace_text(v, "", "-")) == [None if x is None else x.replace("", "-") for x in VALUES]
    assert rows(spark, fn.replace_text(v, "b", "$1")) == [None if x is None else x.replace("b", "$1") for x in VALUES]
    assert rows(spark, fn.combine_fields(v, "t")) == [f"{x} t" for x in VALUES]


def test_numbers(spark):
    v = F.col("v")
    got = rows(spark, fn.to_number(v))
    assert got[4] == 12.5 and got[5] == 1000.0 and got[6] is None and got[7] != got[7] and got[0] is None
    assert rows(spark, fn.number_range(v, 0, 100))[4:8] == [True, False, False, False]
    assert rows(spark, fn.calculate_tax(v, 20))[3:6] == [0.0, 2.5, 200.0]
    assert rows(spark, fn.round_number(F.lit(2.5), 0))[0] == 2.0


def test_validation_of_missing_values(spark):
    v = F.col("v")
    assert rows(spark, fn.not_null(v))[:3] == [True, False, None] or rows(spark, F.coalesce(fn.not_null(v), F.lit(False)))[:3] == [True, False, False]
    assert rows(spark, fn.is_valid_email(v))[8:10] == [False, True]
    assert rows(spark, fn.extract_email_domain(v))[8:11] == ["b", "y.zz", None]


def test_refinement_keeps_failed_values_and_rows(spark):
    df = spark.createDataFrame([(1, "x", "5"), (2, None, "no"), (3, " y ", None)], "id int, a string, b string")
    m = Mapping({
        "id": FieldMapping("id"),
        "a": FieldMapping("name", transformation=[Step("trim_whitespace"), Step("uppercase")], validation=[Step("not_null")]),
        "b": FieldMapping("n", transformation=[Step("math_add", {"amount_to_add": 1})], derivation=[Step("calculate_tax", {"tax_percentage": 50})]),
    })
    assert Mapping.from_json(m.to_json()) == m
    out = refine(df, m)
    assert [tuple(r)[:3] for r in out.orderBy("id").collect()] == [(1, "X", 6.0), (2, None, None), (3, "Y", None)]
    found = {(r["record"], r["step"]) for r in error_rows(out, "id").collect()}
    assert (2, "math_add") in found and (1, "math_add") not in found


def test_registry():
    r = default_registry()
    assert r.parameters()["transformation"]["substring"] == ["start_index", "end_index"]
    r.register("derivation", "twice", lambda c: F.concat(c, c))
    with pytest.raises(KeyError):
        r.build("validation", "nothing", None, {})


def test_log_codecs(spark):
    import zlib

    from sparkloom.sources.log import decoded_segment, encoded_segment

    records = [(0, b"a"), (1, b""), (2, b"xyz")]
    data = encoded_segment(records)
    assert list(decoded_segment(data)) == records
    assert list(decoded_segment(data[:-1])) == records[:2]
    assert list(decoded_segment(data[:13] + b"\xff" + data[14:])) == []
    got = spark.createDataFrame([(2, bytearray(b"xyz"))], "o long, p binary").select(fn.record_crc(F.col("o"), F.col("p"))).first()[0]
    assert got == zlib.crc32((2).to_bytes(8, "big") + (3).to_bytes(4, "big") + b"xyz")


def test_addresses(spark):
    good = ["a+b@x.com", "x@y.c-d", "a.b-c_d@e.f.g", "A@b.c."]
    bad = ["x@y_z.com", "x@y", "@x.com", "ä@x.com", "x y@z.com", "", None, "x@.com"]
    df = spark.createDataFrame([(x,) for x in good + bad], "v string")
    assert {r["v"] for r in df.where(fn.is_valid_email(F.col("v"))).collect()} == set(good)
