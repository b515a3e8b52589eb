"""The long table of typed field values: one row per value of a field of a record.

Columns: rid, field, seq (order of the value within record and field), num, lo, hi, str, kind and unit.
A number is stored as lo = hi = num, an interval with its bounds, so one overlap test serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V

SCHEMA = "rid string, field string, seq long, num double, lo double, hi double, str string, kind string, unit string"


def from_columns(df: DataFrame, rid: str, columns: list[str]) -> DataFrame:
    """Field rows from the columns of a wide table; nulls and empty strings give no row.

    Numeric columns become numbers, booleans 'bool', timestamps and dates ISO text, all else text.
    The unpivot is one generator over an array, so the table is read once and not shuffled.
    """
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        kind = kinds[c]
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        text = F.date_format(F.col(c), "yyyy-MM-dd") if kind.startswith(("timestamp", "date")) else F.col(c).cast("string")
        cells.append(F.struct(
            F.lit(c).alias("field"), (F.col(c).cast("double") if number else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if number else text).alias("str"),
            F.lit("number" if number else "bool" if kind == "boolean" else "string").alias("kind")))
    long = df.select(F.col(rid).cast("string").alias("rid"), F.explode(F.array(*cells)).alias("c")).select("rid", "c.*")
    kept = long.where("num is not null or (str is not null and str <> '')")
    return kept.select("rid", "field", F.lit(0).cast("long").alias("seq"), "num", F.col("num").alias("lo"), F.col("num").alias("hi"), "str", "kind",
                       F.lit(None).cast("string").alias("unit"))


def from_params(params: DataFrame) -> DataFrame:
    """Typed values of parameter rows (rid, name, value, unit, seq, dtype): intervals, numbers, dates or text.

    Rows of one name are variants: each keeps its row. A Number type forces a number, an 'N to N'
    value with a unit or Number type is an interval, and a text that is a whole date is stored as ISO.
    """
    numeric = F.lower(F.coalesce("dtype", F.lit(""))).isin("number", "numeric", "integer", "int", "float", "decimal")
    quantity = (F.coalesce("unit", F.lit("")) != "") | numeric
    interval = F.when(quantity, V.parse_interval(F.col("value")))
    number = F.when(quantity, V.coerce_number(F.col("value"), force=True)).otherwise(V.coerce_number(F.col("value")))
    typed = params.where("value is not null and value <> ''").select(
        "rid", F.col("name").alias("field"), F.col("seq").cast("long").alias("seq"), "value", "unit",
        interval.alias("i"), number.alias("n"), V.parse_date(F.col("value")).alias("d"))
    return typed.select(
        "rid", "field", "seq", F.when(F.col("i").isNull(), F.col("n")).alias("num"),
        F.coalesce("i.lo", "n").alias("lo"), F.coalesce("i.hi", "n").alias("hi"),
        F.when(F.col("i").isNull() & F.col("n").isNull(), F.coalesce(F.col("d").cast("string"), F.col("value"))).alias("str"),
        F.when(F.col("i").isNotNull(), "interval").when(F.col("n").isNotNull(), "number").otherwise("string").alias("kind"),
        F.nullif("unit", F.lit("")).alias("unit"))


def override(extras: DataFrame, params: DataFrame) -> DataFrame:
    """Extras whose name is also a parameter of the record give way to the parameter."""
    return extras.join(params.select("rid", "field").distinct(), ["rid", "field"], "left_anti").unionByName(params)


def range_fields(extras: DataFrame) -> DataFrame:
    """'<field> (from)' and '<field> (to)' of unitless values that are date ranges; 'present' has no end."""
    found = extras.where("kind = 'string' and unit is null").withColumn("r", V.date_range(F.col("str"))).where("r is not null")
    none = F.lit(None).cast("double")
    ends = F.explode(F.array(F.struct(F.lit(" (from)").alias("tail"), F.col("r.from").alias("d")), F.struct(F.lit(" (to)").alias("tail"), F.col("r.to").alias("d"))))
    return found.select("rid", "field", "seq", ends.alias("e")).where("e.d is not null").select(
        "rid", F.concat("field", "e.tail").alias("field"), "seq", none.alias("num"), none.alias("lo"), none.alias("hi"),
        F.col("e.d").cast("string").alias("str"), F.lit("string").alias("kind"), F.lit(None).cast("string").alias("unit"))


def country_parts(fields: DataFrame) -> DataFrame:
    """Compound values of country fields as one row per country."""
    parts = V.split_country(F.col("field"), F.col("str"))
    whole = fields.withColumn("p", F.coalesce(parts, F.array("str")))
    keep = [c for c in fields.columns if c != "str"]
    return whole.select(*keep, F.posexplode_outer("p").alias("seq2", "str")).withColumn(
        "seq", F.col("seq") + F.coalesce("seq2", F.lit(0))).select(*fields.columns)


def param_lines(passages: DataFrame, rid: str = "parent_rid", text: str = "text", order: str = "row_id") -> DataFrame:
    """(rid, name, value, unit, descr, qualifier, seq, dtype) from lines 'Parameter name [qualifier] = value unit (descr)'.

    ``order`` is a whole number; with the line's place it gives ``seq``, an order without a window, so a
    record with very many passages is no task of its own.
    """
    shape = r"^Parameter ([^\[=]+?)(?: \[([^\]]*)\])? = (\S+(?: to \S+)?)(?: ([^(]*?))?(?: \((.*)\))?$"
    lines = passages.where(F.col(rid).isNotNull() & F.col(text).isNotNull()).select(
        F.col(rid).alias("rid"), F.col(order).alias("o"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).where("line like 'Parameter %'")
    got = lambda k: F.nullif(F.trim(F.regexp_extract("line", shape, k)), F.lit(""))
    return lines.where(F.col("line").rlike(shape)).select(
        "rid", got(1).alias("name"), got(3).alias("value"), got(4).alias("unit"), got(5).alias("descr"), got(2).alias("qualifier"),
        (F.col("o").cast("long") * (1 << 20) + F.col("pos")).alias("seq"), F.lit(None).cast("string").alias("dtype"))


def rich_params(params: DataFrame) -> DataFrame:
    """(rid, name, value, unit, descr): variants of one name stacked in order as 'v (qualifier); v2'."""
    cell = F.concat(F.coalesce("value", F.lit("")), F.when(F.col("qualifier").isNotNull(), F.concat(F.lit(" ("), F.col("qualifier"), F.lit(")"))).otherwise(""))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    stacked = F.array_sort(F.collect_list(F.struct("seq", cell.alias("cell"))))
    return params.groupBy("rid", "name").agg(
        F.array_join(F.transform(stacked, lambda s: s["cell"]), "; ").alias("value"), first("unit").alias("unit"), first("descr").alias("descr"))


def last_param(params: DataFrame) -> DataFrame:
    """One row per (rid, name): the last variant."""
    w = Window.partitionBy("rid", "name").orderBy(F.desc("seq"))
    return params.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def text_view(records: DataFrame, title: Column, extras: list[str], params: DataFrame, rid: str = "rid") -> DataFrame:
    """(rid, text): title line, 'key: value' lines of the extras, then a line for each parameter in order."""
    line = F.concat(
        F.lit("Parameter "), F.col("name"), F.when(F.col("qualifier").isNotNull(), F.concat(F.lit(" ["), F.col("qualifier"), F.lit("]"))).otherwise(""),
        F.lit(" = "), F.coalesce("value", F.lit("")), F.when(F.col("unit").isNotNull(), F.concat(F.lit(" "), F.col("unit"))).otherwise(""),
        F.when(F.col("descr").isNotNull(), F.concat(F.lit(" ("), F.col("descr"), F.lit(")"))).otherwise(""))
    lines = params.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in extras])
    return records.select(F.col(rid).cast("string").alias("rid"), head.alias("head")).join(lines, "rid", "left").select(
        "rid", F.concat_ws("\n", F.nullif("head", F.lit("")), "lines").alias("text"))
