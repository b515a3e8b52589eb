"""The field catalogue: types and statistics inferred from the long table of field values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans.runtime import broadcast_if_small

# Fields that hold administrative data.
ADMIN_FIELDS = ("releaseID", "reviewDate", "createdDate", "updatedDate", "versionDate", "productLink", "aliasList", "name",
                "release_id", "created_date", "updated_date", "product_link", "alias_list")
# Thresholds of the classification.
MAJORITY, FULL, MAX_DISTINCT, FEW_DISTINCT, MAX_RATIO, SHORT = 0.5, 0.8, 50, 20, 0.5, 40


def reconcile_units(fields: DataFrame, units: DataFrame) -> DataFrame:
    """Field values in the field's majority unit: adds ``to_unit`` and ``converted`` to the columns.

    The majority is by count, then by the least unit name. Values that can't be converted (unknown
    unit or another dimension) keep their number with ``converted`` false; values without a unit are
    taken as they are. ``units`` has (unit, dimension, factor, shift).
    """
    counts = fields.where("unit is not null").groupBy("field", "unit").count()
    best = Window.partitionBy("field").orderBy(F.desc("count"), "unit")
    major = counts.withColumn("r", F.row_number().over(best)).where("r = 1").select("field", F.col("unit").alias("to_unit"))
    u = units.select("unit", "dimension", "factor", "shift")
    a, b = u.toDF("unit", "d1", "f1", "s1"), u.toDF("to_unit", "d2", "f2", "s2")
    joined = fields.join(broadcast_if_small(major), "field", "left").join(broadcast_if_small(a), "unit", "left").join(broadcast_if_small(b), "to_unit", "left")
    same = F.col("unit").isNull() | F.col("to_unit").isNull() | (F.col("unit") == F.col("to_unit"))
    can = (F.col("d1") == F.col("d2")) & F.col("f2").isNotNull()
    out = joined
    for c in ("num", "lo", "hi"):
        out = out.withColumn(c, F.when(same | ~F.coalesce(can, F.lit(False)), F.col(c)).otherwise((F.col(c) * F.col("f1") + F.col("s1") - F.col("s2")) / F.col("f2")))
    return out.withColumn("converted", same | F.coalesce(can, F.lit(False))).select(*fields.columns, "to_unit", "converted")


def record_level(fields: DataFrame) -> DataFrame:
    """(rid, field) with flags: all values numeric, several values, an interval, a date."""
    return fields.groupBy("rid", "field").agg(
        F.min((F.col("lo").isNotNull() & (F.col("kind") != "bool")).cast("int")).alias("numeric"),
        (F.count("*") > 1).cast("int").alias("listed"), F.max((F.col("kind") == "interval").cast("int")).alias("interval"),
        F.max(V.parse_date(F.col("str")).isNotNull().cast("int")).alias("dated"))


def _quantile(column: str, p: float, exact: bool):
    return V.round4(F.percentile(column, F.lit(p)) if exact else F.percentile_approx(column, F.lit(p), F.lit(10_000)).cast("double"))


def classify(fields: DataFrame, lov: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """One row per field: field, type, count, unit-free statistics, distinct, admin, partial, multi, intervals.

    A field is numeric if all values of at least half of its records are numbers; else multi_value if
    a record has several; else a date under the same majority; else categorical if its texts are short
    and few, otherwise free_text, or unknown without texts. ``lov`` (field) forces categorical.
    Intervals enter the statistics with both ends. Exact percentiles interpolate linearly; they count the
    distinct values of a field in one reducer, so for fields of very many distinct values ``exact=False``
    takes the mergeable sketch instead.
    """
    by_record = record_level(fields).groupBy("field").agg(
        F.count("*").alias("count"), F.sum("numeric").alias("n_numeric"), F.max("listed").alias("any_list"),
        F.max("interval").alias("any_interval"), F.sum("dated").alias("n_dated"))
    points = fields.where("lo is not null and kind <> 'bool'").select(
        "field", F.explode(F.when(F.col("kind") == "interval", F.array("lo", "hi")).otherwise(F.array("lo"))).alias("v"))
    stats = points.groupBy("field").agg(
        F.min("v").alias("min"), _quantile("v", 0.05, exact).alias("p5"), _quantile("v", 0.5, exact).alias("median"),
        _quantile("v", 0.95, exact).alias("p95"), F.max("v").alias("max"))
    texts = fields.where("kind = 'string' and str is not null").groupBy("field").agg(
        F.count_distinct("str").alias("n_distinct"), F.avg(F.length("str")).alias("avg_length"), F.count("*").alias("n_text"))
    joined = by_record.join(stats, "field", "left").join(texts, "field", "left")
    forced = F.lit(False)
    if lov is not None:
        joined = joined.join(broadcast_if_small(lov.select("field").distinct().withColumn("is_lov", F.lit(True))), "field", "left")
        forced = F.coalesce("is_lov", F.lit(False))
    half = F.greatest(F.lit(1), F.ceil(F.col("count") * MAJORITY))
    few = (F.col("n_distinct") <= FEW_DISTINCT) | ((F.col("n_distinct") <= MAX_DISTINCT) & (F.col("n_distinct") / F.col("n_text") <= MAX_RATIO))
    kind = (F.when(forced, "categorical").when(F.col("n_numeric") >= half, "numeric").when(F.col("any_list") == 1, "multi_value")
            .when(F.col("n_dated") >= half, "date").when(F.col("n_distinct").isNull(), "unknown")
            .when((F.col("avg_length") < SHORT) & few, "categorical").otherwise("free_text"))
    typed = joined.withColumn("type", kind)
    enough = F.when(F.col("type") == "numeric", F.col("n_numeric")).when(F.col("type") == "date", F.col("n_dated"))
    only = lambda c: F.when(F.col("type") == "numeric", F.col(c)).alias(c)
    return typed.select(
        "field", "type", "count", *[only(c) for c in ("min", "p5", "median", "p95", "max")], F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.col("field").isin(*ADMIN_FIELDS).alias("admin"), F.coalesce(enough < F.ceil(F.col("count") * FULL), F.lit(False)).alias("partial"),
        (F.col("any_list") == 1).alias("multi"), (F.col("any_interval") == 1).alias("intervals"))


def label_values(fields: DataFrame, most: int = 1000) -> DataFrame:
    """(field, values): sorted distinct labels of text values, intervals left out.

    A field with more than ``most`` distinct texts holds no labels but prose or names; it gets no row. So no
    task ever gathers the texts of such a field.
    """
    distinct = fields.where("kind = 'string' and str is not null").select("field", F.trim("str").alias("v")).distinct()
    few = distinct.groupBy("field").count().where(F.col("count") <= most).select("field")
    return distinct.join(broadcast_if_small(few), "field", "left_semi").groupBy("field").agg(F.sort_array(F.collect_list("v")).alias("values"))


def examples(fields: DataFrame, n: int = 2, size: int = 80) -> DataFrame:
    """(field, examples): the first ``n`` texts in order, cut to ``size``; the window limits each group before the shuffle."""
    w = Window.partitionBy("field").orderBy("str")
    top = fields.where("kind = 'string'").select("field", "str").distinct().withColumn("r", F.row_number().over(w)).where(f"r <= {n}")
    return top.groupBy("field").agg(F.array_sort(F.collect_list(F.substring("str", 1, size))).alias("examples"))


def partition_fields(catalogue: DataFrame, min_count: int = 1, max_cardinality: int = 40, limit: int = 8) -> DataFrame:
    """The fields that split the records best: labels of few values, by coverage, then by fewer labels, then by name."""
    return catalogue.where(
        F.col("type").isin("categorical", "multi_value") & ~F.col("admin") & (F.col("n_distinct") <= max_cardinality) & (F.col("count") >= min_count)
    ).orderBy(F.desc("count"), "n_distinct", "field").limit(limit).select("field", "type", "count", "n_distinct")


def category_stats(fields: DataFrame, catalogue: DataFrame, category: str, min_count: int = 2, exact: bool = True) -> DataFrame:
    """(category, field, count, min, p5, median, p95, max) of numeric fields within each value of a category field.

    Records with several categories are left out; groups of fewer than ``min_count`` points too.
    """
    labels = fields.where((F.col("field") == category) & (F.col("kind") == "string")).groupBy("rid").agg(
        F.min("str").alias("category"), F.count("*").alias("n")).where("n = 1").select("rid", "category")
    numeric = catalogue.where("type = 'numeric'").select("field")
    points = fields.where("lo is not null and kind <> 'bool'").join(broadcast_if_small(numeric), "field", "left_semi").select(
        "rid", "field", F.explode(F.when(F.col("kind") == "interval", F.array("lo", "hi")).otherwise(F.array("lo"))).alias("v"))
    return points.join(labels, "rid").groupBy("category", "field").agg(
        F.count("*").alias("count"), F.min("v").alias("min"), _quantile("v", 0.05, exact).alias("p5"),
        _quantile("v", 0.5, exact).alias("median"), _quantile("v", 0.95, exact).alias("p95"), F.max("v").alias("max")
    ).where(F.col("count") >= min_count)


def coverage(fields: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """(field, records): distinct records with a value, within the eligible ones if given."""
    kept = fields if eligible is None else fields.join(eligible.select("rid"), "rid", "left_semi")
    return kept.groupBy("field").agg(F.count_distinct("rid").alias("records"))


def type_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(F.when(F.col("admin"), "admin").otherwise(F.col("type")).alias("type")).agg(F.count("*").alias("fields"))


def descriptor(catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, text): the sentence that stands for a field when fields are embedded."""
    number = F.format_string("%s: numeric, from %s to %s, typically %s", "field", F.col("min").cast("string"), F.col("max").cast("string"), F.col("median").cast("string"))
    shown = F.array_join(F.slice("values", 1, 12), ", ")
    return catalogue.join(labels, "field", "left").select("field", F.when(F.col("type") == "numeric", number).when(
        F.col("type").isin("categorical", "multi_value"), F.concat(F.col("field"), F.lit(": "), F.col("type"), F.lit(", one of "), F.coalesce(shown, F.lit("")))
    ).otherwise(F.concat(F.col("field"), F.lit(": "), F.col("type"))).alias("text"))


def spec_lines(catalogue: DataFrame, labels: DataFrame, stats: DataFrame | None = None, category: str | None = None,
               only: list[str] | None = None, min_count: int = 1, max_fields: int | None = None) -> DataFrame:
    """(rank, line): the catalogue as lines of a prompt, by coverage, with ranges of one category where it has them."""
    kept = catalogue.where(~F.col("admin") & (F.col("count") >= min_count))
    if only is not None:
        kept = kept.where(F.col("field").isin(*only))
    if stats is not None and category is not None:
        own = stats.where(F.col("category") == category).select("field", F.col("p5").alias("c5"), F.col("p95").alias("c95"))
        kept = kept.join(own, "field", "left").withColumn("p5", F.coalesce("c5", "p5")).withColumn("p95", F.coalesce("c95", "p95"))
    joined = kept.join(labels, "field", "left")
    note = F.concat(F.when(F.col("multi"), F.lit(", several values")).otherwise(""), F.when(F.col("partial"), F.lit(", partly typed")).otherwise(""))
    body = F.when(F.col("type") == "numeric", F.format_string("numeric %s to %s", F.col("p5").cast("string"), F.col("p95").cast("string"))).when(
        F.col("type").isin("categorical", "multi_value"), F.concat(F.col("type"), F.lit(" in ["), F.coalesce(F.array_join("values", ", "), F.lit("")), F.lit("]"))
    ).otherwise(F.col("type"))
    line = F.concat(F.col("field"), F.lit(" ("), F.col("count").cast("string"), F.lit("): "), body, note)
    # the catalogue has one row per field name, so this window orders a small table
    ranked = joined.select(F.row_number().over(Window.orderBy(F.desc("count"), "field")).alias("rank"), line.alias("line"))
    return ranked if max_fields is None else ranked.where(F.col("rank") <= max_fields)


def audit(profiles: DataFrame, units: DataFrame) -> DataFrame:
    """(field, issue) of fields without a definition or type, of mixed types, or with units of several dimensions.

    ``profiles`` has (field, definition, dtype, unit) rows.
    """
    grouped = profiles.groupBy("field").agg(F.count("definition").alias("defs"), F.count_distinct("dtype").alias("types"))
    simple = grouped.select("field", F.explode(F.array_compact(F.array(
        F.when(F.col("defs") == 0, F.lit("missing definition")), F.when(F.col("types") == 0, F.lit("missing type")),
        F.when(F.col("types") > 1, F.lit("mixed types"))))).alias("issue"))
    dims = profiles.where("unit is not null").join(broadcast_if_small(units.select("unit", "dimension")), "unit").groupBy("field").agg(
        F.count_distinct("dimension").alias("d")).where("d > 1").select("field", F.lit("inconvertible units").alias("issue"))
    return simple.unionByName(dims)


def peers(records: DataFrame, rid: str, kind: str, group: str) -> DataFrame:
    """(rid, n_peers): how many other records share the type or the group, by counts only, without pairing records."""
    by_type = records.groupBy(kind).agg(F.count("*").alias("n_type"))
    by_group = records.groupBy(group).agg(F.count("*").alias("n_group"))
    by_both = records.groupBy(kind, group).agg(F.count("*").alias("n_both"))
    return records.join(broadcast_if_small(by_type), kind, "left").join(broadcast_if_small(by_group), group, "left").join(
        broadcast_if_small(by_both), [kind, group], "left").select(
        F.col(rid).cast("string").alias("rid"),
        (F.coalesce("n_type", F.lit(1)) + F.coalesce("n_group", F.lit(1)) - F.coalesce("n_both", F.lit(1)) - 1).alias("n_peers"))
