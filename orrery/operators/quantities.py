"""Quantities recorded in different units, brought to the canonical unit of their field.

The grammar of :mod:`orrery.functions.unitgrammar` reads numbers and unit expressions from the
value, the unit column, the attribute's name and the quoted sentence. Each unit is an exponent
vector with scale and offset; a value converts exactly if the vectors agree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.unitgrammar import _DIGITS, NUMBER, Quantity, parse_number, parse_unit
from orrery.plans.runtime import broadcast_if_small

# What may stand before a number without belonging to its unit.
_HEAD = r"(?:approx\.?|about|ca\.?|circa|up to|at least|at most|over|under|[~≈<>≤≥±])?\s*"
_MONEY = r"(?P<money>US\$|USD|U\.S\. dollars|\$)?\s*"
_NUM = rf"[-+−]?(?:{_DIGITS})(?:[eE][-+]?\d+)?"
_VALUE = re.compile(rf"^\s*{_HEAD}{_MONEY}(?P<a>{_NUM})(?:\s*(?P<sep>/|–|—|-|\bto\b)\s*(?P<b>{_NUM}))?\s*(?P<tail>[^\d].*)?$", re.I)
_ATTRIBUTE_UNIT = re.compile(r"[\(\[]\s*(?P<a>[^\)\]]+?)\s*[\)\]]\s*:?\s*$|,\s*in\s+(?P<b>\S.*?)\s*:?\s*$")
_OTHER_QUANTITY = re.compile(r"(?:\b(?:stood|weighed|ran|was|were|since|in|version|v)|[~≈<>]|\bset of)\s*$", re.I)
_TAGS = re.compile(r"<[^<>]*>|\*\*|'''|`|\\textbf\{|[{}]")


@dataclass
class Reading:
    """What a claim states: the numbers, and each unit with the place it was found in."""

    low: float | None = None
    high: float | None = None
    dual: bool = False
    units: list[tuple[str, Quantity]] = field(default_factory=list)


def _money_unit(tail: str) -> Quantity | None:
    tail = tail.strip(" .,;")
    return parse_unit("USD") if not tail else parse_unit(f"{tail} USD") or parse_unit("USD")


def _unit_pair(text: str) -> list[Quantity]:
    """One unit, or the two of a dual notation such as 'km/h | kn' or 'nmi/km'."""
    if "|" in text:
        return [q for q in map(parse_unit, text.split("|")) if q]
    whole = parse_unit(text)
    if "/" in text and text.count("/") == 1:
        left, right = (parse_unit(x) for x in text.split("/"))
        if left and right and left.same_dimension(right):
            return [left, right]
    return [whole] if whole else []


def _unit_after(text: str) -> Quantity | None:
    """The unit at the beginning of a text: the longest of up to four words that is one."""
    text = text[:60]
    words = re.match(r"\s*(?:\S+\s*){0,4}", text).group(0).split()
    for k in range(min(4, len(words)), 0, -1):
        candidate = " ".join(words[:k])
        for form in (candidate, candidate.rstrip(".,;:!?)|")):
            if any(w[-1] in ".,;:!?" for w in words[:k - 1] if parse_unit(w) is None) and k > 1:
                continue
            if (q := parse_unit(form)) is not None:
                return q
    return None


def read_claim(value: str | None, unit: str | None, attribute: str | None, quote: str | None) -> Reading:
    """All statements of the claim's own quantity. Nulls and blanks state nothing."""
    out = Reading()
    m = _VALUE.match(value) if value else None
    numbers: list[str] = []
    if m:
        numbers = [m["a"], *([m["b"]] if m["b"] else [])]
        values = [parse_number(n) for n in numbers]
        out.low, out.high, out.dual = values[0], values[-1], m["sep"] == "/"
        tail = (m["tail"] or "").strip()
        if m["money"]:
            out.units.append(("value", _money_unit(tail)))
        elif tail:
            found = _unit_pair(tail) or [q for q in [_unit_after(tail)] if q]
            out.units += [("value", q) for q in found]
    if unit and unit.strip():
        out.units += [("unit", q) for q in _unit_pair(unit)]
    if attribute and (a := _ATTRIBUTE_UNIT.search(attribute)):
        out.units += [("attribute", q) for q in _unit_pair(a["a"] or a["b"])]
    if quote:
        text = _TAGS.sub(" ", html.unescape(quote))
        for hit in NUMBER.finditer(text):
            own = hit.group(0)
            if numbers and not any(own.lstrip("-+−") == n.lstrip("-+−") or parse_number(own) == parse_number(n) for n in numbers):
                continue
            before, after = text[:hit.start()], text[hit.end():]
            if _OTHER_QUANTITY.search(before):
                continue
            currency = re.search(r"(US\$|USD|\$)\s*$", before)
            if currency:
                scale = re.match(r"\s?(k|M|m|mn|bn|thousand|million|billion)\b", after)
                q = _money_unit(scale.group(1) if scale else "")
            else:
                q = _unit_after(after)
            if q is not None:
                out.units.append(("quote", q))
                if not numbers:
                    out.low = out.high = parse_number(own)
                    break
    return out


def convert(reading: Reading, canonical: Quantity, names: list[tuple[str, Quantity]]) -> tuple | None:
    """(low, high, unit_from, from_place) in the canonical unit, or None if nothing converts.

    A statement in the canonical unit wins; then unit_from is the canonical unit itself. A unit of
    another dimension makes the quantity unusable unless the canonical unit is stated as well.
    """
    if reading.low is None or not reading.units:
        return None
    name = lambda q: next((n for n, r in names if r.same_unit(q)), None)
    for k, (place, q) in enumerate(reading.units):
        if q.same_unit(canonical):
            pair = reading.dual and [p for p, _ in reading.units].count(place) == 2
            second = pair and [q2 for p, q2 in reading.units if p == place][1].same_unit(canonical)
            low = reading.high if second else reading.low
            return low, low if reading.dual else reading.high, name(q), place
    if any(not q.same_dimension(canonical) for _, q in reading.units):
        return None
    place, q = reading.units[0]
    found = name(q)
    if found is None:
        return None
    to = lambda v: (v * q.factor + q.offset - canonical.offset) / canonical.factor
    return to(reading.low), to(reading.low if reading.dual else reading.high), found, place


_SCHEMA = "claim_id long, canon_field string, value_low double, value_high double, unit_norm string, unit_from string, stated_in string"


def normalise_units(claims: DataFrame, fields: DataFrame, units: DataFrame) -> DataFrame:
    """One row per distinct claim of a field with a canonical unit whose quantity converts.

    Columns: claim_id, canon_field, value_low, value_high, unit_norm (the canonical unit),
    unit_from, stated_in. Claims with a null or unknown field, without a number, without a unit or
    with one of another dimension give no row; exact duplicates give one. ``fields`` and ``units``
    are the small reference tables; the join to fields is broadcast only below a proven size.
    """
    known = [(r["unit"], q) for r in units.select("unit", "dimension", "factor", "shift").toLocalIterator()
             if r["unit"] and (q := parse_unit(r["unit"]))]
    canonical = fields.where("canonical_unit is not null").select("canon_field", "canonical_unit").distinct()
    rows = claims.select("claim_id", "canon_field", "value_raw", "unit_raw", "attribute", "quote").join(
        broadcast_if_small(canonical), "canon_field")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("claim_id", "canon_field", "value_low", "value_high", "unit_norm", "unit_from", "stated_in")}
            cols = batch.to_pydict()
            for cid, fld, value, unit, attribute, quote, target in zip(*(cols[c] for c in (
                    "claim_id", "canon_field", "value_raw", "unit_raw", "attribute", "quote", "canonical_unit"))):
                q = parse_unit(target)
                got = q and convert(read_claim(value, unit, attribute, quote), q, known)
                if got:
                    for key, x in zip(out, (cid, fld, got[0], got[1], target, got[2], got[3])):
                        out[key].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("claim_id", pa.int64()), ("canon_field", pa.string()), ("value_low", pa.float64()), ("value_high", pa.float64()),
                ("unit_norm", pa.string()), ("unit_from", pa.string()), ("stated_in", pa.string())]))

    return rows.mapInArrow(run, _SCHEMA).dropDuplicates(["claim_id"])


def _dual_agrees(reading: Reading, tolerance: float) -> bool | None:
    """Whether the two numbers of a dual notation state the same quantity; None without two units of one place."""
    if not reading.dual or reading.low is None or reading.high is None:
        return None
    for place in ("value", "unit", "attribute", "quote"):
        pair = [q for p, q in reading.units if p == place]
        if len(pair) == 2 and pair[0].same_dimension(pair[1]):
            a, b = (v * q.factor + q.offset for v, q in zip((reading.low, reading.high), pair))
            return abs(a - b) <= tolerance * max(abs(a), abs(b))
    return None


def stated(claims: DataFrame, fields: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(claim_id, value, unit_ok, dual_ok) for every distinct claim of a known field.

    ``value`` is in the canonical unit (null if nothing converts, and for fields without a unit the bare
    number); ``unit_ok`` is false if a unit of another dimension is stated, null if none is; ``dual_ok`` is
    null unless two numbers with two units are given.
    """
    rows = claims.select("claim_id", "canon_field", "value_raw", "unit_raw", "attribute", "quote").join(
        broadcast_if_small(fields.select("canon_field", "canonical_unit").distinct()), "canon_field")
    schema = pa.schema([("claim_id", pa.int64()), ("value", pa.float64()), ("unit_ok", pa.bool_()), ("dual_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            cols = batch.to_pydict()
            for cid, value, unit, attribute, quote, target in zip(*(cols[c] for c in ("claim_id", "value_raw", "unit_raw", "attribute", "quote", "canonical_unit"))):
                reading, q = read_claim(value, unit, attribute, quote), parse_unit(target)
                if q is None:
                    out.append({"claim_id": cid, "value": reading.low, "unit_ok": None, "dual_ok": _dual_agrees(reading, tolerance)})
                    continue
                got = convert(reading, q, [(target, q), *((str(i), u) for i, (_, u) in enumerate(reading.units))])
                ok = all(u.same_dimension(q) for _, u in reading.units) if reading.units else None
                out.append({"claim_id": cid, "value": got[0] if got else None, "unit_ok": ok, "dual_ok": _dual_agrees(reading, tolerance)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "claim_id long, value double, unit_ok boolean, dual_ok boolean").dropDuplicates(["claim_id"])
