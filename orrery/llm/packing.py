"""Filling containers of fixed capacity by harmonic packing.

Class k holds the items of size in (C / (k + 1), C / k]; k of them always fit one container, so the
containers of a class are filled by count alone, without looking at any other class or worker. What
the first two classes leave free (up to half a container) is again a reciprocal share of the
capacity: a gap of at least C / m hosts one item of class m. Hosting repeats on what remains. Items of
at most C / SMALL form the last class and are filled by prefix sums. The incomplete last container of
each class, a number of items bounded by the classes, is packed by first fit decreasing.

Items are spread over buckets of bounded size by hash; each bucket is packed on its own, so a class
that holds a third of all items is no task of its own. Only sizes are shuffled, never texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch

CAPACITY = 2048
#: Containers' worth of items in a bucket: bounds a bucket, and with it the containers left partly filled.
BUCKET_CONTAINERS = 4096
#: First of the classes that are filled together by prefix sums.
SMALL = 16


def parts(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part_no, first_token, n_tokens): items divided only if they alone exceed the capacity."""
    count = f"cast(greatest(({size} - 1) div {capacity}, 0) as int)"
    cut = sizes.where(f"{size} > 0").select(key, size, F.explode(F.expr(f"sequence(0, {count})")).alias("part_no"))
    first = F.col("part_no").cast("long") * capacity
    return cut.select(key, "part_no", first.alias("first_token"), F.least(F.lit(capacity), F.col(size) - first).cast("long").alias("n_tokens"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, rounds: int = 4) -> DataFrame:
    """key, part_no, first_token, n_tokens, container (a text id, null for items of size 0 or null).

    Every item appears in whole; no container exceeds the capacity; an item larger than the capacity
    is divided into full containers and a remainder. Equal sizes and repeated keys are packed each.
    """
    scratch = Scratch(sizes.sparkSession, "packing")
    sizes = scratch.put(sizes.select(key, size))  # counted once, read for the items and for the empty ones
    items = scratch.put(parts(sizes, key, size, capacity))
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, round(total / (capacity * BUCKET_CONTAINERS)))
    order = [F.desc("n_tokens"), F.col(key), F.col("part_no")]
    rest = items.withColumn("bucket", F.pmod(F.xxhash64(key, "part_no"), F.lit(buckets)).cast("int")).withColumn(
        "k", F.expr(f"cast({capacity} div n_tokens as int)"))
    by_class = Window.partitionBy("bucket", "k").orderBy(*order)
    large = rest.where("k <= 2").withColumn("i", F.row_number().over(by_class) - 1).withColumn(
        "container", F.concat_ws("-", "bucket", "k", F.expr("i div k")))
    placed = [large.select(key, "part_no", "first_token", "n_tokens", "container")]
    bins = large.groupBy("bucket", "container").agg((F.lit(capacity) - F.sum("n_tokens")).alias("gap"))
    rest = rest.where("k > 2")
    for _ in range(rounds):
        # a gap of at least capacity / m hosts an item of class m: m is the least such number
        open_bins = bins.where("gap > 0").withColumn("k", F.expr(f"cast(ceil({capacity} / gap) as int)")).withColumn(
            "i", F.row_number().over(Window.partitionBy("bucket", "k").orderBy("gap", "container")))
        numbered = rest.withColumn("i", F.row_number().over(Window.partitionBy("bucket", "k").orderBy(
            "n_tokens", key, "part_no")))
        hosted = scratch.put(numbered.join(open_bins.select("bucket", "k", "i", "container", "gap"), ["bucket", "k", "i"], "left"))
        inside = hosted.where("container is not null")
        placed.append(inside.select(key, "part_no", "first_token", "n_tokens", "container"))
        bins = inside.select("bucket", "container", (F.col("gap") - F.col("n_tokens")).alias("gap"))
        rest = hosted.where("container is null").select(key, "part_no", "first_token", "n_tokens", "bucket", "k")
    medium = rest.where(f"k < {SMALL}").withColumn("i", F.row_number().over(by_class) - 1).withColumn(
        "full", F.expr("div(count(*) over (partition by bucket, k), k) * k"))
    named = F.concat_ws("-", "bucket", "k", F.expr("i div k"))
    placed.append(medium.where("i < full").withColumn("container", named).select(key, "part_no", "first_token", "n_tokens", "container"))
    # sums of at most this width start in a container, so the last item still fits
    width = capacity - capacity // SMALL
    before = F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    small = rest.where(f"k >= {SMALL}").withColumn("before", F.coalesce(before, F.lit(0))).withColumn("no", F.expr(f"before div {width}"))
    sums = small.withColumn("last", F.max("no").over(Window.partitionBy("bucket")))
    placed.append(sums.where("no < last").withColumn("container", F.concat_ws("-", "bucket", F.lit("s"), "no")).select(
        key, "part_no", "first_token", "n_tokens", "container"))

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """At most SMALL incomplete containers' worth of items of one bucket, largest first."""
        pdf = pdf.sort_values(["n_tokens", key, "part_no"], ascending=[False, True, True])
        room: list[int] = []
        where = []
        for n in pdf["n_tokens"]:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= n
            where.append(at)
        return pdf.assign(container=[f"{b}-r-{i}" for b, i in zip(pdf["bucket"], where)])[[key, "part_no", "first_token", "n_tokens", "container"]]

    columns = [key, "part_no", "first_token", "n_tokens", "bucket"]
    remainder = medium.where("i >= full").select(*columns).unionByName(sums.where("no = last").select(*columns))
    kind = dict(items.dtypes)[key]
    placed.append(remainder.groupBy("bucket").applyInPandas(
        first_fit, f"{key} {kind}, part_no int, first_token long, n_tokens long, container string"))
    empty = sizes.where(f"{size} is null or {size} <= 0").select(
        key, F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("first_token"), F.col(size).cast("long").alias("n_tokens"),
        F.lit(None).cast("string").alias("container"))
    out = placed[0]
    for more in [*placed[1:], empty]:
        out = out.unionByName(more)
    return out


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the capacity that is filled, and the least possible number of containers."""
    used = packed.where("container is not null")
    bins = used.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum("items").alias("items"),
        F.round(F.sum("n") / (F.count("*") * capacity), 4).alias("filled"),
        F.ceil(F.sum("n") / capacity).alias("least_containers"))
