import pytest
from hypothesis import given
from hypothesis import strategies as st

from orrery.functions.unitgrammar import parse_number, parse_unit
from orrery.operators import quantities


@pytest.mark.parametrize("a,b", [("kph", "km/h"), ("m s-1", "m/s"), ("thousand ft", "kft"), ("bn USD", "USD billion"), ("M$", "USD million"), ("lbf/in2", "psi"),
                                 ("cu m", "m3"), ("m³", "m3"), ("KM", "km"), ("KPa", "kPa"), ("nm", "nmi"), ("NM", "nmi"), ("naut. miles", "nmi"), ("км/ч", "km/h"),
                                 ("公里", "km"), ("kilos", "kg"), ("deg F", "degF"), ("megabits/s", "Mbit/s"), ("metric tons", "t"), ("kms", "km")])
def test_spellings_denote_the_same_unit(a, b):
    assert parse_unit(a).same_unit(parse_unit(b))


@pytest.mark.parametrize("text", [None, "", " ", "units", "n/a", "-", "lengths", "x" * 5000])
def test_no_unit(text):
    assert parse_unit(text) is None


@pytest.mark.parametrize("text,value", [("7,324", 7324.0), ("39 960", 39960.0), ("43,7", 43.7), ("0,961", 0.961), ("1.234.567", 1234567.0), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("-6.36", -6.36), ("x", None)])
def test_numbers(text, value):
    assert parse_number(text) == value


@given(st.floats(0.001, 1e6), st.sampled_from(["ft", "degF", "kn", "psi", "US gal", "mrad", "USD thousand"]))
def test_conversion_round_trip(value, unit):
    q, base = parse_unit(unit), parse_unit({"ft": "m", "degF": "degC", "kn": "km/h", "psi": "kPa", "US gal": "L", "mrad": "deg", "USD thousand": "USD"}[unit])
    there = (value * q.factor + q.offset - base.offset) / base.factor
    back = (there * base.factor + base.offset - q.offset) / q.factor
    assert back == pytest.approx(value, rel=1e-9, abs=1e-6)


FIELDS = [("Length", "m"), ("Maximum range", "km"), ("Unit cost", "USD"), ("Operating temperature", "degC"), ("Crew", None)]
UNITS = [("m", "length", 1.0, 0.0), ("km", "length", 1000.0, 0.0), ("ft", "length", 0.3048, 0.0), ("nmi", "length", 1852.0, 0.0), ("USD", "money", 1.0, 0.0), ("USD million", "money", 1e6, 0.0),
         ("degC", "temperature", 1.0, 273.15), ("degF", "temperature", 5 / 9, 255.3722222222222), ("kg", "mass", 1.0, 0.0)]
CLAIMS = [
    (1, "Length", "12,5", "ft", "length", "X has a length of 12,5 ft."), (2, "Length", "3 m", None, "length", None), (3, "Maximum range", "36", None, "reach [NM]", None),
    (4, "Unit cost", "$5.5M", None, "price", "price: $5.5M"), (5, "Operating temperature", "50", "F", None, None), (6, "Length", "10", "kg", None, None), (7, "Length", "9", "", "length", "X - length 9 The mast stood 38 m above ground."),
    (8, "Maximum range", "18 / 9.72", "km/nmi", None, None), (9, "Crew", "4", None, None, None), (10, None, "4", "m", None, None), (11, "Length", None, None, None, None),
    (1, "Length", "12,5", "ft", "length", "X has a length of 12,5 ft."), (12, "Length", "38", None, "length", "length: 38 <b>ft</b> The mast stood 38 m above ground."), (13, "Maximum range", "1,000 to 2,000 m", None, None, None),
    (14, "Length", "7" * 300, "ft", "l" * 100_000, "q" * 100_000)]


def test_claims(spark):
    claims = spark.createDataFrame(CLAIMS, "claim_id long, canon_field string, value_raw string, unit_raw string, attribute string, quote string").selectExpr("*", "1 as unit", "2 as canonical_unit_x")
    got = {r.claim_id: r for r in quantities.normalise_units(claims, spark.createDataFrame(FIELDS, "canon_field string, canonical_unit string"), spark.createDataFrame(UNITS, "unit string, dimension string, factor double, shift double")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, 12, 13, 14}
    assert {k: got[k].unit_from for k in (1, 2, 3, 4, 5, 8, 12, 13)} == {1: "ft", 2: "m", 3: "nmi", 4: "USD million", 5: "degF", 8: "km", 12: "ft", 13: "m"}
    assert got[1].value_low == pytest.approx(3.81) and got[3].value_low == pytest.approx(66.672) and got[4].value_low == pytest.approx(5.5e6)
    assert got[5].value_low == pytest.approx(10.0) and got[8].value_low == 18 and (got[13].value_low, got[13].value_high) == (1.0, 2.0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "claim_id long, canon_field string, value_raw string, unit_raw string, attribute string, quote string")
    assert quantities.normalise_units(empty, spark.createDataFrame(FIELDS, "canon_field string, canonical_unit string"), spark.createDataFrame(UNITS, "unit string, dimension string, factor double, shift double")).count() == 0


def test_stated(spark):
    rows = [(1, "Maximum range", "18 / 9.72", "km/nmi", None, None), (2, "Maximum range", "18 / 12", "km/nmi", None, None), (3, "Length", "10", "kg", None, None), (4, "Crew", "4", None, None, None), (5, "Length", "4", None, None, None), (6, "Length", "10", "ft", None, None)]
    claims = spark.createDataFrame(rows, "claim_id long, canon_field string, value_raw string, unit_raw string, attribute string, quote string")
    got = {r.claim_id: (r.value, r.unit_ok, r.dual_ok) for r in quantities.stated(claims, spark.createDataFrame(FIELDS, "canon_field string, canonical_unit string")).collect()}
    assert got == {1: (18.0, True, True), 2: (18.0, True, False), 3: (None, False, None), 4: (4.0, None, None), 5: (None, None, None), 6: (pytest.approx(3.048), True, None)}
