"""Structured evidence: exact values, pivot tables, one-hop relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans.runtime import broadcast_if_small


def direct_value(params: DataFrame, fields: DataFrame, rid: str, field: str) -> DataFrame:
    """The value of one field of one record with its unit: from the parameters, else from the typed fields.

    Both keys are literals, so they reach the scans as pushed filters.
    """
    own = params.where((F.col("rid") == rid) & (F.col("name") == field)).select(F.lit(0).alias("o"), "seq", "value", "unit")
    typed = fields.where((F.col("rid") == rid) & (F.col("field") == field)).select(
        F.lit(1).alias("o"), "seq", F.coalesce("str", F.col("num").cast("string"), F.concat_ws(" to ", F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("value"), "unit")
    both = own.unionByName(typed)
    first = both.agg(F.min("o").alias("least"))
    return both.join(F.broadcast(first), both.o == first.least).groupBy().agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), ", ").alias("value"), F.max("unit").alias("unit")).where("value <> ''")


def record_table(records: DataFrame, cells: DataFrame, columns: list[str], numeric: list[str], limit: int = 40, ascending: bool = False,
                 eligible: DataFrame | None = None) -> DataFrame:
    """One row per record with a column per field; sorted by the first numeric column, nulls last, else by title.

    ``records`` has (rid, title), ``cells`` (rid, field, value). Each row carries ``total``, the number
    of records before the cut. The pivot's columns are given, so no job looks for them.
    """
    kept = records if eligible is None else records.join(eligible.select("rid"), "rid", "left_semi")
    total = kept.agg(F.count("*").alias("total"))
    pivot = cells.where(F.col("field").isin(columns)).groupBy("rid").pivot("field", columns).agg(F.min("value"))
    table = kept.join(pivot, "rid", "left")
    lead = next((c for c in columns if c in numeric), None)
    if lead:
        found = V.numbers_in(F.col(f"`{lead}`"))
        key = F.array_min(found) if ascending else F.array_max(found)
        order = [F.asc_nulls_last(key) if ascending else F.desc_nulls_last(key), F.col("rid")]
    else:
        order = [F.lower("title"), F.col("rid")]
    return table.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def edges(relations: DataFrame, plain) -> DataFrame:
    """Distinct (parent, child, relation_type) with ids in plain form."""
    return relations.select(
        F.coalesce(plain(F.col("rel_parent_model_id")), plain(F.col("parent_rid"))).alias("parent"),
        plain(F.col("child_model_id")).alias("child"), "relation_type").where("parent is not null and child is not null").distinct()


def related(links: DataFrame, seeds: DataFrame, records: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(rid, labels): neighbours of the seeds in either direction that are records, not seeds and not shown.

    ``seeds`` is a handful of records of a question; labels are the distinct 'type: seed' texts in order.
    """
    s = broadcast_if_small(seeds.select(F.col("rid").alias("seed"), F.col("title").alias("seed_title")))
    down = links.join(s, links.parent == s.seed).select(F.col("child").alias("rid"), F.concat_ws(": ", "relation_type", "seed_title").alias("label"))
    up = links.join(s, links.child == s.seed).select(F.col("parent").alias("rid"), F.concat_ws(": ", "relation_type", "seed_title").alias("label"))
    found = down.unionByName(up).join(records.select("rid"), "rid", "left_semi").join(seeds.select("rid"), "rid", "left_anti")
    if exclude is not None:
        found = found.join(exclude.select("rid"), "rid", "left_anti")
    return found.groupBy("rid").agg(F.array_join(F.sort_array(F.collect_set("label")), "; ").alias("labels"))


def relation_rows(links: DataFrame, seeds: DataFrame, titles: DataFrame, limit: int = 12) -> DataFrame:
    """Edges that touch a seed, marked ``reversed`` where the seed is the child, with titles or the ids in their place."""
    s = seeds.select("rid")
    out = links.join(broadcast_if_small(s.withColumnRenamed("rid", "parent")), "parent", "left_semi").withColumn("reversed", F.lit(False))
    back = links.join(broadcast_if_small(s.withColumnRenamed("rid", "child")), "child", "left_semi").join(
        broadcast_if_small(s.withColumnRenamed("rid", "parent")), "parent", "left_anti").withColumn("reversed", F.lit(True))
    both = out.unionByName(back).dropDuplicates(["parent", "child", "relation_type"])
    name = lambda c: titles.select(F.col("rid").alias(c), F.col("title").alias(f"{c}_title"))
    top = both.orderBy("parent", "child", "relation_type").limit(limit)
    return top.join(name("parent"), "parent", "left").join(name("child"), "child", "left").select(
        "parent", "child", "relation_type", "reversed", F.coalesce("parent_title", "parent").alias("parent_title"), F.coalesce("child_title", "child").alias("child_title"))


def related_each(links: DataFrame, seeds: DataFrame, records: DataFrame) -> DataFrame:
    """(seed, rid, labels): as ``related``, but every seed is a question of its own, so seeds may be each other's neighbours."""
    s = seeds.select(F.col("rid").alias("seed"), F.col("title").alias("seed_title"))
    label = F.concat_ws(": ", "relation_type", "seed_title").alias("label")
    down = links.join(s, links.parent == s.seed).select("seed", F.col("child").alias("rid"), label)
    up = links.join(s, links.child == s.seed).select("seed", F.col("parent").alias("rid"), label)
    found = down.unionByName(up).where("rid <> seed").join(records.select("rid"), "rid", "left_semi")
    return found.groupBy("seed", "rid").agg(F.array_join(F.sort_array(F.collect_set("label")), "; ").alias("labels"))


def relation_rows_each(links: DataFrame, seeds: DataFrame, titles: DataFrame, limit: int = 12) -> DataFrame:
    """The rows of ``relation_rows`` with their ``seed``: every seed is a question of its own and has up to ``limit`` edges."""
    s = seeds.select(F.col("rid").alias("seed"))
    out = links.join(s, links.parent == s.seed).withColumn("reversed", F.lit(False))
    back = links.where("parent <> child").join(s, F.col("child") == s.seed).withColumn("reversed", F.lit(True))
    order = Window.partitionBy("seed").orderBy("parent", "child", "relation_type")
    top = out.unionByName(back).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")
    name = lambda c: titles.select(F.col("rid").alias(c), F.col("title").alias(f"{c}_title"))
    return top.join(name("parent"), "parent", "left").join(name("child"), "child", "left").select(
        "seed", "parent", "child", "relation_type", "reversed", F.coalesce("parent_title", "parent").alias("parent_title"), F.coalesce("child_title", "child").alias("child_title"))


def fitted_to(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(rid, fitted_to): for every record that is a child, the sorted titles of its parents."""
    named = links.join(titles.select(F.col("rid").alias("parent"), "title"), "parent")
    return named.join(titles.select(F.col("rid").alias("child")), "child", "left_semi").groupBy(F.col("child").alias("rid")).agg(
        F.array_join(F.sort_array(F.collect_set("title")), "; ").alias("fitted_to"))


def outside_names(relations: DataFrame, links_child: str, titles: DataFrame, plain) -> DataFrame:
    """(rid, alias): names of related systems that are no records themselves, as further aliases of their parents."""
    named = relations.select(F.coalesce(plain(F.col("rel_parent_model_id")), plain(F.col("parent_rid"))).alias("rid"),
                             plain(F.col(links_child)).alias("child"), F.lower(F.trim("child_name")).alias("alias")).where("rid is not null and alias is not null")
    return named.join(titles.select(F.col("rid").alias("child")), "child", "left_anti").select("rid", "alias").distinct()


def best_passages(passages: DataFrame, field: str, rids: list[str], shown: DataFrame | None = None) -> DataFrame:
    """(parent_rid, row_id): per pinned record the first passage with a line of the field, else any parameter passage."""
    own = passages.where(F.col("parent_rid").isin(rids))
    if shown is not None:
        own = own.join(shown.select("row_id"), "row_id", "left_anti")
    score = F.when(F.col("text").contains(f"Parameter {field} ="), 0).when(F.col("text").rlike(r"(?m)^Parameter "), 1)
    ranked = own.withColumn("s", score).where("s is not null").withColumn("r", F.row_number().over(Window.partitionBy("parent_rid").orderBy("s", "row_id")))
    return ranked.where("r = 1").select("parent_rid", "row_id")
