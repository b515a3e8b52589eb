import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.operators import catalogue, fields, filters

PARAMS = "rid string, name string, value string, unit string, seq int, dtype string, qualifier string, descr string"


def params(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], PARAMS)


def test_typed_values(spark):
    p = params(spark, [("a", "Range", "1 to 2", "m", 0), ("a", "Range", "1,234.5", "m", 1), ("b", "Range", "2 to 1", "m", 0), ("b", "Status", "1974", None, 0), ("b", "Note", "one, two", None, 1), ("c", "Empty", "", None, 0), ("c", "Count", "7", None, 1, "Number")])
    got = {(r.rid, r.field, r.seq): (r.num, r.lo, r.hi, r.str, r.kind) for r in fields.from_params(p).collect()}
    assert got[("a", "Range", 0)] == (None, 1.0, 2.0, None, "interval") and got[("b", "Range", 0)][1:3] == (1.0, 2.0)
    assert got[("a", "Range", 1)][0] == 1234.5 and got[("b", "Note", 1)][3] == "one, two" and ("c", "Empty", 0) not in got


def test_any_variant_needs_both_bounds_on_one_value(spark):
    p = params(spark, [("a", "Range", "1", "m", 0), ("a", "Range", "2", "m", 1), ("b", "Range", "1.5", "m", 0), ("c", "Range", "1 to 2", "m", 0), ("d", "Other", "1.5", "m", 0)])
    rows = fields.from_params(p)
    assert sorted(r.rid for r in filters.eligible(rows, {"Range": {"type": "numeric", "min": 1.4, "max": 1.6}}).collect()) == ["b", "c"]
    assert filters.eligible(rows, {}) is None


@pytest.mark.parametrize("seed", range(3))
def test_filter_equals_plain_predicate(spark, seed):
    rng = random.Random(seed)
    data = [(str(r), f, k, v) for r in range(30) for f in "xy" for k, v in enumerate(rng.choices([1.0, 2.0, 3.0, 4.0], k=rng.randint(0, 3)))]
    rows = spark.createDataFrame([(r, f, k, v, v, v, None, "number", None) for r, f, k, v in data], fields.SCHEMA)
    clauses = {"x": {"type": "numeric", "min": 2}, "y": {"type": "numeric", "max": 3, "min": 2}}
    ok = lambda c, v: c.get("min", -9) <= v <= c.get("max", 9)
    expected = sorted(r for r in {d[0] for d in data} if all(any(d[0] == r and d[1] == f and ok(c, d[3]) for d in data) for f, c in clauses.items()))
    assert sorted(x.rid for x in filters.eligible(rows, clauses).collect()) == expected


def test_validation():
    cat = {"Maximum range": {"type": "numeric", "unit": "km", "values": []}, "Country": {"type": "categorical", "values": ["United States", "Norway"]}, "Tags": {"type": "multi_value", "values": ["a", "b"]}, "Built": {"type": "date", "values": []}}
    got = filters.validate({"max range": {"min": "1,000", "unit": "m"}, "country": {"eq": "usa"}, "Tags": {"contains": ["b", "zz"]}, "Built": {"date_from": "1999"}, "Nothing": {"min": 1}, "Maximum rangee": {"max": "x"}},
                           cat, {"max range": "Maximum range"}, {"usa": "united states"})
    assert got.clauses["Maximum range"] == {"type": "numeric", "min": 1.0} and got.clauses["Country"]["in"] == ["United States"]
    assert got.clauses["Tags"] == {"type": "multi_value", "contains": ["b"]} and got.clauses["Built"]["date_from"] == "1999" and len(got.errors) == 3
    bad = filters.validate({"Maximum range": {"min": 1, "unit": "kg"}}, cat)
    assert not bad.clauses and bad.errors


def test_degenerate_and_merge(spark):
    rows = spark.createDataFrame([("1", "c", 0, None, None, None, "a", "string", None), ("2", "c", 0, None, None, None, "b", "string", None)], fields.SCHEMA)
    cat = {"c": {"type": "categorical", "values": ["a", "b"]}}
    assert filters.is_degenerate(rows, {"c": {"in": ["a", "b"]}}, cat) and not filters.is_degenerate(rows, {"c": {"in": ["a"]}}, cat)
    assert filters.merge({"c": {"in": ["a"]}}, {"c": {"in": ["b", "a"]}, "d": {"min": 1}}) == {"c": {"in": ["a", "b"]}, "d": {"min": 1}}


def test_catalogue_classes(spark):
    rows = []
    for i in range(10):
        rows.append((str(i), "n", 0, float(i), float(i), float(i), None, "number", "m"))
        rows.append((str(i), "label", 0, None, None, None, "ab"[i % 2], "string", None))
        rows.append((str(i), "day", 0, None, None, None, f"2001-01-{i + 10}", "string", None))
        rows.append((str(i), "prose", 0, None, None, None, f"text {i} " * 10, "string", None))
        rows.append((str(i), "flag", 0, None, None, None, None, "bool", None))
        rows += [(str(i), "tags", k, None, None, None, f"t{k}", "string", None) for k in range(2)]
    rows += [("0", "n", 1, None, 1.0, 5.0, None, "interval", "m")]
    got = {r.field: r for r in catalogue.classify(spark.createDataFrame(rows, fields.SCHEMA)).collect()}
    assert {f: got[f].type for f in got} == {"n": "numeric", "label": "categorical", "day": "date", "prose": "free_text", "flag": "unknown", "tags": "multi_value"}
    assert got["n"].intervals and got["n"].multi and (got["n"].min, got["n"].max) == (0.0, 9.0)
    assert catalogue.classify(spark.createDataFrame([], fields.SCHEMA)).count() == 0


def test_unit_reconciliation(spark):
    rows = [("1", "L", 0, 2.0, 2.0, 2.0, None, "number", "m"), ("2", "L", 0, 3.0, 3.0, 3.0, None, "number", "m"), ("3", "L", 0, 150.0, 150.0, 150.0, None, "number", "mm"), ("4", "L", 0, 5.0, 5.0, 5.0, None, "number", "kg")]
    units = spark.createDataFrame([("m", "length", 1.0, 0.0), ("mm", "length", 0.001, 0.0), ("kg", "mass", 1.0, 0.0)], "unit string, dimension string, factor double, shift double")
    got = {r.rid: (r.num, r.to_unit, r.converted) for r in catalogue.reconcile_units(spark.createDataFrame(rows, fields.SCHEMA), units).collect()}
    assert got == {"1": (2.0, "m", True), "2": (3.0, "m", True), "3": (0.15, "m", True), "4": (5.0, "m", False)}


def test_value_functions(spark):
    df = spark.createDataFrame([("1980-present", "Norway; United States", "FY2021", None)], "r string, c string, y string, n string")
    row = df.select(V.date_range(F.col("r")).alias("r"), V.split_country(F.lit("Country of use"), F.col("c")).alias("c"), V.service_year(F.col("y")).alias("y"),
                    V.coerce_number(F.col("n")).alias("n"), V.family_stem(F.lit("AIM-120")).alias("s"), V.fingerprint(F.col("n"), F.lit("x")).alias("f"), V.snippet(F.lit("Title: a\n" + "b " * 300)).alias("sn")).first()
    assert str(row.r["from"]) == "1980-01-01" and row.r["to"] is None and row.c == ["Norway", "United States"] and row.y == 2021 and row.n is None and row.s == "aim" and len(row.f) == 16 and len(row.sn) == 200


def test_variants_and_lines(spark):
    text = "Title: T\nParameter Range = 5 km (reach)\nParameter Range [export] = 7 km (reach)\nNo parameter"
    p = fields.param_lines(spark.createDataFrame([(1, "r", text), (2, None, text), (3, "q", None)], "row_id long, parent_rid string, text string"))
    assert [(r.name, r.value, r.unit, r.descr) for r in fields.rich_params(p).collect()] == [("Range", "5; 7 (export)", "km", "reach")]
    assert fields.last_param(p).first().value == "7"
