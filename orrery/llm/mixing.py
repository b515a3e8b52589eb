"""Mixing sources to target weights by Pfair scheduling.

Each source's share of the mixture is cut into blocks of equal token size. Block j of a source with n
of N blocks has the weight n / N, the release floor(j N / n) and the deadline ceil((j + 1) N / n) in
slots of one block. Among the released blocks the one with the earliest deadline gets each slot, which
keeps every source within less than one block of its share at every point of the mixture.

The mixture is cut into epochs of EPOCH_SLOTS slots, whose blocks of each source follow from the target
shares at the epoch's borders; each worker schedules epochs by itself. So a block
keeps its size however large the mixture, and every source stays within less than two blocks of its share
at every point (less than one in a mixture of one epoch). Documents are placed in blocks by a distributed
prefix sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch, broadcast_if_small, parallelism, running_total

#: Least size of a block, which is also no smaller than the longest document, and slots that are scheduled together.
BLOCK_TOKENS = 4096
EPOCH_SLOTS = 50_000


def schedule_blocks(blocks: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks: earliest deadline first among the released ones."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s in sorted(blocks)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // blocks[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[s], s, j + 1))
    return slots


def epoch_borders(blocks: dict[str, int], slots: int = EPOCH_SLOTS) -> list[dict[str, int]]:
    """How many blocks of each source stand before each epoch and after the last.

    A border holds all blocks whose deadline has passed and what earlier borders held; the slots left go to the
    released blocks of the earliest deadlines. One small step for every epoch, on the driver.
    """
    total = sum(blocks.values())
    held = dict.fromkeys(blocks, 0)
    out = [held]
    while sum(held.values()) < total:
        slot = min(sum(held.values()) + slots, total)
        due = {s: max(n * slot // total, held[s]) for s, n in blocks.items()}
        released = sorted((-(-(due[s] + 1) * total // n), s) for s, n in blocks.items() if due[s] < n and due[s] * total // n < slot)
        for _, s in released[:max(0, slot - sum(due.values()))]:
            due[s] += 1
        held = due
        out.append(held)
    return out


def schedule_epoch(begin: dict[str, int], end: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of the epoch between two borders."""
    own = {s: end[s] - begin[s] for s in end if end[s] > begin[s]}
    first = sum(begin.values())
    return [(s, begin[s] + j, first + t) for s, at in schedule_blocks(own).items() for j, t in enumerate(at)]


def quotas(tokens: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, float]]:
    """source -> (effective share, tokens) of the largest mixture that all available sources can fill.

    Sources without documents can't contribute; their share is divided among the others in proportion.
    """
    available = [(s, w, r) for s, w, r in targets if s is not None and w and w > 0 and (r or 0) > 0 and tokens.get(s, 0) > 0]
    whole = sum(w for _, w, _ in available)
    if not available:
        return {}
    size = min(r * tokens[s] / (w / whole) for s, w, r in available)
    return {s: (w / whole, size * w / whole) for s, w, _ in available}


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", epoch_slots: int = EPOCH_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(schedule, report).

    schedule: key, copy_no, source, n_tokens, block_no, slot; slot is the place of the block in the mixture.
    report: source, target_share, effective_share, actual_share, tokens, uses, documents, most_uses, max_repeats.

    No document is used more than its source's max_repeats times; a source ends within half a
    document of its quota. Documents of sources that aren't targets, of a null source and without
    tokens aren't used; the report has them with a null target. ``targets`` is a fixed small table.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mixing")
    held = scratch.put(sizes.select(key, "source", F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens")))
    # one row per source that is a target: bounded by the targets' table
    wanted = {(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.collect()}
    named = [s for s, _, _ in wanted if s is not None]
    supply = {r["source"]: r["n"] for r in held.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    quota = quotas(supply, sorted(wanted, key=str))
    longest = held.agg(F.max("n_tokens")).first()[0] or 0
    block = max(BLOCK_TOKENS, longest)
    blocks = {s: max(1, -(-round(t) // block)) for s, (_, t) in quota.items()}
    borders = epoch_borders(blocks, epoch_slots)
    epochs = len(borders) - 1

    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for epoch in batch.column(0).to_pylist():
                rows = schedule_epoch(borders[epoch], borders[epoch + 1])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]], names=["source", "block_no", "slot"])

    slot_of = scratch.put(spark.range(0, epochs, numPartitions=max(1, min(epochs, parallelism(spark)))).mapInArrow(scheduled, "source string, block_no long, slot long"))
    repeats = {s: r for s, _, r in wanted}
    plan_rows = [(s, float(t), supply[s], repeats[s], blocks[s]) for s, (_, t) in sorted(quota.items())]
    plan = spark.createDataFrame(plan_rows, "source string, quota double, supply long, repeats int, blocks long")
    used = held.where("n_tokens > 0").join(F.broadcast(plan), "source")
    placed = running_total(used, "source", [key], "n_tokens", "before", buckets=max(256, 4 * parallelism(spark)))
    # only the copies that the quota has room for are made
    last = placed.withColumn("last", F.expr("least(repeats - 1, cast(floor((quota - before - n_tokens / 2) / supply) as int))")).where("last >= 0")
    copies = last.withColumn("copy_no", F.explode(F.expr("sequence(0, last)"))).withColumn("start", F.col("copy_no") * F.col("supply") + F.col("before"))
    chosen = copies.where("start + n_tokens / 2 <= quota").withColumn(
        "block_no", F.least(F.expr(f"start div {block}"), F.col("blocks") - 1))
    schedule = scratch.put(chosen.join(broadcast_if_small(slot_of), ["source", "block_no"]).select(
        key, "copy_no", "source", "n_tokens", "block_no", "slot"))
    actual = schedule.groupBy("source", key).agg(F.count("*").alias("u"), F.sum("n_tokens").alias("t")).groupBy("source").agg(
        F.sum("t").alias("tokens"), F.sum("u").alias("uses"), F.count("*").alias("documents"), F.max("u").alias("most_uses"))
    total = actual.agg(F.sum("tokens").alias("all"))
    effective = spark.createDataFrame([(s, e) for s, (e, _) in sorted(quota.items())], "source string, effective_share double")
    sources = held.select("source").distinct().unionByName(targets.select("source")).distinct()
    report = sources.join(targets.select(F.col("source").alias("ts"), "target_share", "max_repeats"), F.col("source").eqNullSafe(F.col("ts")), "left").join(
        F.broadcast(effective), "source", "left").join(actual, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce("effective_share", F.lit(0.0)).alias("effective_share"),
        F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
    return schedule, report
