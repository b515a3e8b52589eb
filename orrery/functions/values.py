"""Column functions for typed values, names, tokens and fingerprints.

All of them are built-in expressions, so they stay in code generation; a null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of numbers, intervals and dates in free values.
THOUSANDS = r"(?<=\d),(?=\d{3}(?:\D|$))"
NUMERIC = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_N = r"[+-]?\d+(?:,\d{3})*(?:\.\d*)?|\.\d+"
INTERVAL = rf"(?i)^\s*({_N})\s+to\s+({_N})\s*$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM", "yyyy")
SERVICE_YEAR = r"(?i)\b(?:FY\s*)?(19[3-9]\d|20[0-2]\d|203[0-5])\b"


def strip_thousands(c: Column) -> Column:
    return F.regexp_replace(c, THOUSANDS, "")


def coerce_number(value: Column, unit: Column | None = None, force: bool = False) -> Column:
    """The value as a double if it looks numeric, or if a unit or ``force`` says that it is a quantity; else null."""
    plain = strip_thousands(F.trim(value))
    number = plain.try_cast("double")
    if force:
        return number
    looks = plain.rlike(NUMERIC)
    return F.when(looks if unit is None else (looks | (F.coalesce(unit, F.lit("")) != "")), number)


def parse_interval(value: Column) -> Column:
    """struct(lo, hi) of 'N to N' in ascending order, else null."""
    a = strip_thousands(F.regexp_extract(value, INTERVAL, 1)).try_cast("double")
    b = strip_thousands(F.regexp_extract(value, INTERVAL, 2)).try_cast("double")
    return F.when(value.rlike(INTERVAL), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def parse_date(value: Column) -> Column:
    """Strict dates of the forms Y-m-d, Y/m/d, Y-m and Y; anything else is null."""
    s = F.trim(value)
    shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{4}-\d{1,2}$", r"^\d{4}$")
    padded = (s, F.regexp_replace(s, "/", "-"), F.concat(s, F.lit("-01")), F.concat(s, F.lit("-01-01")))
    return F.coalesce(*[F.when(s.rlike(shape), p.try_cast("date")) for shape, p in zip(shapes, padded)])


def date_range(value: Column) -> Column:
    """struct(from, to) of a two-part year or month range; 'present' leaves ``to`` null; else null."""
    shape = r"(?i)^\s*([12]\d{3}(?:-\d{2})?)\s*[-–—]\s*([12]\d{3}(?:-\d{2})?|present)\s*$"
    start = parse_date(F.regexp_extract(value, shape, 1))
    end = parse_date(F.regexp_extract(value, shape, 2))
    return F.when(value.rlike(shape) & start.isNotNull(), F.struct(start.alias("from"), end.alias("to")))


def service_year(value: Column) -> Column:
    """A year from 1930 to 2035 in a value such as '2020' or 'FY2021', else null."""
    return F.regexp_extract(value, SERVICE_YEAR, 1).try_cast("int")


def split_country(name: Column, value: Column) -> Column:
    """Ordered distinct parts of a compound value of a country field; null if there is only one part."""
    inside = F.array_join(F.regexp_extract_all(value, F.lit(r"\(([^)]*)\)"), F.lit(1)), ";")
    flat = F.concat_ws(";", F.regexp_replace(value, r"\([^)]*\)", ""), inside)
    parts = F.array_distinct(F.filter(F.transform(F.split(flat, r"\s*(?:;|/|,|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.lower(name).contains("country") & (F.size(parts) > 1), parts)


def normal_name(c: Column) -> Column:
    """Lower-case alphanumeric tokens of a field name joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")


def normal_label(c: Column) -> Column:
    """Folded case, single blanks, no trailing punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"[\s.,;:!?]+$", "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def passage_body(c: Column) -> Column:
    """A passage without its title line."""
    return F.regexp_replace(c, r"^Title:[^\n]*\n", "")


def snippet(c: Column, size: int = 200) -> Column:
    body = F.trim(F.regexp_replace(passage_body(c), r"\s+", " "))
    return F.when(F.length(body) > size, F.concat(F.rtrim(F.substring(body, 1, size)), F.lit("…"))).otherwise(body)


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by '|'; null parts count as the text 'None'."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)


def content_hash(text: Column, render: str = "text") -> Column:
    """First 16 hex digits of the SHA-256 of the rendering's name and the text."""
    return F.substring(F.sha2(F.concat(F.lit(render + "|"), text), 256), 1, 16)


def family_stem(alias: Column) -> Column:
    """Letters before the first run of digits of a designation, in lower case."""
    return F.lower(F.regexp_extract(alias, r"([A-Za-z]+)[- ]?\d", 1))


def numeric_prefix(c: Column) -> Column:
    return strip_thousands(F.regexp_extract(c, r"^\s*([-+]?\d[\d,]*(?:\.\d+)?)", 1)).try_cast("double")


def numbers_in(c: Column) -> Column:
    """All numbers in a cell, in order."""
    found = F.regexp_extract_all(strip_thousands(c), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def strip_markdown(c: Column) -> Column:
    """Without table rules, pipes, backticks, asterisks and heading marks."""
    no_rules = F.regexp_replace(c, r"(?m)^\s*\|?[\s:|-]+\|\s*$", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_rules, r"[|`*]|(?m)^#+\s*", " "), r"\s+", " "))


def ground_form(c: Column) -> Column:
    """The form in which values are looked for in quotes: no markup, lower case, plain dashes, no commas."""
    return F.regexp_replace(F.translate(F.lower(strip_markdown(c)), "–—−,", "---"), r"\s+", " ")


def round4(c: Column) -> Column:
    """Four decimals; the tiny shift lifts values that are exactly half-way except for binary noise."""
    return F.round(c + 1e-8, 4)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_date_like(c: Column) -> Column:
    """A text with a year or a month's name that is a date as a whole."""
    named = c.rlike(r"(?i)\b(?:\d{4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
    parsed = F.coalesce(parse_date(c), *[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in ("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM yyyy", "MMM yyyy", "yyyy")])
    return F.coalesce(named & parsed.isNotNull(), F.lit(False))


def shown_number(c: Column, places: int = 4) -> Column:
    """A number with at most so many decimals and no zeros behind; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.round(c, places).cast(f"decimal(38,{places})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def sentence_with(text: Column, token: Column) -> Column:
    """The first sentence of a text in which the token stands with no letter, digit or hyphen beside it; null if none."""
    edge = lambda s: F.concat(F.lit(" "), F.regexp_replace(F.lower(s), r"[^\w.-]+", " "), F.lit(" "))
    bare = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(token), r"[^\w.-]+", " ")))
    holds = lambda s: edge(s).contains(F.concat(bare, F.lit(" "))) | edge(s).contains(F.concat(bare, F.lit(". ")))
    return F.try_element_at(F.filter(F.split(text, r"(?<=[.!?])\s+"), holds), F.lit(1))


def one_line(c: Column, size: int = 240) -> Column:
    """A quotation on one line, cut to ``size``."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, size)


def document_name(path: Column) -> Column:
    """The name of a file without folders and ending."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def unit_parts(c: Column) -> Column:
    """Units written together, as 'km / mi' or 'm, ft', one by one."""
    return F.filter(F.transform(F.split(c, r"[/,]"), lambda x: F.trim(x)), lambda x: x != "")


def spelled_out(c: Column, words: dict[str, str]) -> Column:
    """Each word of a text that is an abbreviation by its expansion; dots behind a word are dropped for the look-up."""
    if not words:
        return c
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.coalesce(table[F.rtrim(F.regexp_replace(w, r"\.$", ""))], w)), " ")


def numbers_of(values: Column) -> Column:
    """The values of an array of texts that are numbers, thousands commas allowed."""
    return F.filter(F.transform(values, lambda v: coerce_number(v)), lambda v: v.isNotNull())
