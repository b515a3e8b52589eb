"""Parent-child links to full hierarchies by Euler tours with parallel list ranking.

1. Ids are normalised and each child keeps one parent.
2. Every edge becomes two arcs, down into the child and up out of it, linked to tours. In a tree the
   tour is a list that ends at the root. In a component with a cycle every node has a parent, so
   each arc has a successor and no list ends.
3. List ranking: in every round each arc jumps along its successors' pointers, four times as far as
   before, and sums what it passes. An arc whose list ends learns the root, its depth and its
   position; a round in which no further arc reaches an end leaves only arcs of cycles and of what
   hangs on them. So ranking itself exposes the cycles; peeling leaf by leaf would need as
   many rounds as the hierarchy is deep.
4. Entry and exit positions form nested intervals. A scan over them in order, with the intervals open
   at each partition's border carried over, yields paths, ancestors and descendants.

No step collects edges or components to the driver. Each arc is the successor of at most one other, so
a hot parent is no hot key of any round; the order of siblings comes from a global range sort whose
partition borders are patched afterwards.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch, parallelism

CYCLE = "CYCLE"
#: Successors that an arc passes in a round; with its own pointer that makes four times the distance.
HOPS = 3


def plain_id(col: Column) -> Column:
    """An id as a plain integer: blanks, a leading '#', zero padding and a '.0' tail are dropped.

    Text that is no number is kept trimmed; blank becomes null.
    """
    text = F.trim(F.regexp_replace(F.trim(col), r"^#\s*", ""))
    number = F.regexp_extract(text, r"^0*(\d+?)(?:\.0*)?$", 1)
    return F.when(number != "", number).otherwise(F.when(text == "", None).otherwise(text))


def parent_links(relations: DataFrame, child: str = "child_model_id", parent: str = "rel_parent_model_id",
                 fallback: str = "parent_rid") -> DataFrame:
    """Distinct (node_id, parent_id). Rows without a child or without any parent are no edges.

    A child that names several parents keeps the least (shorter id first, then text), so that the
    result doesn't depend on row order.
    """
    edges = relations.select(
        plain_id(F.col(child)).alias("node_id"),
        F.coalesce(plain_id(F.col(parent)), plain_id(F.col(fallback))).alias("parent_id"),
    ).where("node_id is not null and parent_id is not null")
    return edges.groupBy("node_id").agg(
        F.min(F.struct(F.length("parent_id").alias("n"), F.col("parent_id").alias("p"))).alias("m")
    ).select("node_id", F.col("m.p").alias("parent_id"))


def _next_in_order(sorted_rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds (next_parent, next_node), the row that follows in the global order (parent, node).

    The order is a range partitioning; within a partition the successor is the following line, and
    the last line of a partition takes the first line of the next one. Those first lines, one per
    partition, are the only thing that reaches the driver.
    """
    spark = scratch.spark
    n = parallelism(spark)
    ranged = sorted_rows.repartitionByRange(n, "parent_id", "node_id").withColumn("pid", F.spark_partition_id())
    stored = scratch.put(ranged)
    heads = {r["pid"]: (r["h"]["parent_id"], r["h"]["node_id"]) for r in stored.groupBy("pid").agg(
        F.min(F.struct("parent_id", "node_id")).alias("h")).collect()}
    order = sorted(heads)
    following = {pid: heads[nxt] for pid, nxt in zip(order, order[1:])}

    by = Window.partitionBy("pid").orderBy("parent_id", "node_id")
    linked = stored.withColumn("next_parent", F.lead("parent_id").over(by)).withColumn(
        "next_node", F.lead("node_id").over(by))
    if following:
        rows = [(pid, p, c) for pid, (p, c) in following.items()]
        border = spark.createDataFrame(rows, "b_pid int, b_parent string, b_node string")
        linked = linked.join(F.broadcast(border), linked.pid == border.b_pid, "left").select(
            "node_id", "parent_id", F.coalesce("next_parent", "b_parent").alias("next_parent"),
            F.coalesce("next_node", "b_node").alias("next_node"))
    return linked.select("node_id", "parent_id", "next_parent", "next_node")


def euler_tour(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Arcs (arc, nxt, s, n, root) of the tours of all components; ``edges`` has (node_id, parent_id).

    'd' + node is the arc from the parent into the node (weight +1), 'u' + node the way back (-1).
    The last arc of a tree's tour has no successor and knows the root.
    """
    linked = scratch.put(_next_in_order(edges, scratch))
    same = F.col("next_parent") == F.col("parent_id")
    firsts = linked.groupBy("parent_id").agg(F.min("node_id").alias("first_child")).withColumnRenamed("parent_id", "p")
    down = linked.join(firsts, linked.node_id == firsts.p, "left").select(
        F.concat(F.lit("d"), "node_id").alias("arc"),
        F.coalesce(F.concat(F.lit("d"), "first_child"), F.concat(F.lit("u"), "node_id")).alias("nxt"),
        F.lit(1).cast("long").alias("s"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("root"))
    has_arc = edges.select(F.col("node_id").alias("a"))
    follows = F.when(same, F.concat(F.lit("d"), "next_node"))
    # only a parent's last child asks whether the parent has an arc of its own: one row for each parent
    inner, last = linked.where(F.coalesce(same, F.lit(False))), linked.where(~F.coalesce(same, F.lit(False)))
    closing = last.join(has_arc, last.parent_id == has_arc.a, "left")
    up = inner.select(F.concat(F.lit("u"), "node_id").alias("arc"), follows.alias("nxt"), F.lit(None).cast("string").alias("root")).unionByName(
        closing.select(F.concat(F.lit("u"), "node_id").alias("arc"), F.when(F.col("a").isNotNull(), F.concat(F.lit("u"), "parent_id")).alias("nxt"),
                       F.when(F.col("a").isNull(), F.col("parent_id")).alias("root")))
    return down.unionByName(up.select("arc", "nxt", F.lit(-1).cast("long").alias("s"), F.lit(1).cast("long").alias("n"), "root"))


def rank_list(arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """List ranking: per arc the sum of weights and number of arcs to the end of its list, and the root
    there. Arcs of endless lists keep a successor and have no root.
    """

    def write(df: DataFrame) -> tuple[str, int]:
        seen = Observation()
        path = scratch.write(df.observe(seen, F.count("nxt").alias("open")))
        return path, seen.get["open"]

    # an arc that has arrived looks itself up, which spreads such rows and changes nothing
    hops = "".join(f""", h{k} AS (
        SELECT a.arc, if(a.nxt IS NULL, NULL, f.nxt) AS nxt, if(a.nxt IS NULL, a.s, a.s + f.s) AS s,
               if(a.nxt IS NULL, a.n, a.n + f.n) AS n, if(a.nxt IS NULL, a.root, f.root) AS root
        FROM h{k - 1} a LEFT JOIN {{state}} f ON coalesce(a.nxt, a.arc) = f.arc)""" for k in range(1, HOPS + 1))
    round_ = f"WITH h0 AS (SELECT * FROM {{state}} WHERE nxt IS NOT NULL){hops} SELECT * FROM {{state}} WHERE nxt IS NULL UNION ALL SELECT * FROM h{HOPS}"
    here, open_ = write(arcs)
    while open_:
        following, left = write(scratch.spark.sql(round_, state=scratch.read(here)))
        scratch.drop(here)
        here = following
        if left == open_:
            break
        open_ = left
    return scratch.read(here)


def ranks(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, root_id, depth, entry, exit, n_descendants) of every node of (node_id, parent_id) edges.

    Positions count the arcs back from the end of the tree's tour, so they are negative but for the exit of a root.
    """
    arcs = scratch.put(rank_list(euler_tour(links, scratch), scratch))
    down = F.col("arc").startswith("d")
    nodes = arcs.groupBy(F.expr("substring(arc, 2)").alias("node_id")).agg(
        F.max("root").alias("root_id"), F.max(F.when(down, F.col("s"))).alias("s"),
        F.max(F.when(down, F.col("n"))).alias("n_down"), F.max(F.when(~down, F.col("n"))).alias("n_up"))
    tree = F.col("root_id").isNotNull()
    below = nodes.select(
        "node_id", F.coalesce("root_id", F.lit(CYCLE)).alias("root_id"),
        F.when(tree, F.lit(1) - F.col("s")).otherwise(-1).cast("int").alias("depth"),
        F.when(tree, -F.col("n_down")).alias("entry"), F.when(tree, -F.col("n_up")).alias("exit"),
        F.when(tree, F.expr("div(n_down - n_up - 1, 2)")).cast("long").alias("n_descendants"))
    tours = arcs.where("root is not null").groupBy("root").agg(F.max("n").alias("tour"))
    roots = tours.select(
        F.col("root").alias("node_id"), F.col("root").alias("root_id"), F.lit(0).cast("int").alias("depth"),
        (-F.col("tour") - 1).alias("entry"), F.lit(0).cast("long").alias("exit"), F.expr("div(tour, 2)").cast("long").alias("n_descendants"))
    return below.unionByName(roots)


def hierarchy(relations: DataFrame, child: str = "child_model_id", parent: str = "rel_parent_model_id",
              fallback: str = "parent_rid") -> DataFrame:
    """One row per node: node_id, parent_id, root_id, depth, entry, exit, n_descendants.

    A root has depth 0 and itself as root. Nodes on a cycle or below one have root_id 'CYCLE',
    depth -1 and null positions. ``entry`` < ``exit`` are positions in the tour of the node's tree:
    a node is a descendant of another exactly if it has the same root and its interval lies inside.
    Repeated edges, null ids, clashing extra columns and an empty table need no special care: they
    add no row.
    """
    scratch = Scratch(relations.sparkSession, "hierarchy")
    links = scratch.put(parent_links(relations, child, parent, fallback))
    return ranks(links, scratch).join(links, "node_id", "left").select(
        "node_id", "parent_id", "root_id", "depth", "entry", "exit", "n_descendants")


def depths(relations: DataFrame, child: str = "child_model_id", parent: str = "rel_parent_model_id",
           fallback: str = "parent_rid") -> DataFrame:
    """(node_id, root_id, depth) of every node, as in :func:`hierarchy`."""
    scratch = Scratch(relations.sparkSession, "hierarchy")
    return ranks(scratch.put(parent_links(relations, child, parent, fallback)), scratch).select("node_id", "root_id", "depth")


def _in_order(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Tree nodes in order of (root, entry) with the number of their partition, and in front of each
    partition the nodes whose intervals are open at its border.

    One border per partition goes to the driver and to all tasks; each node finds the borders within
    its interval by bisection.
    """
    n = parallelism(scratch.spark)
    ranged = nodes.where("depth >= 0").select("node_id", "root_id", "depth", "entry", "exit")
    stored = scratch.put(ranged.repartitionByRange(n, "root_id", "entry").withColumn("pid", F.spark_partition_id()).withColumn("carried", F.lit(False)))
    borders = sorted((r["h"]["root_id"], r["h"]["entry"], r["pid"]) for r in stored.groupBy("pid").agg(F.min(F.struct("root_id", "entry")).alias("h")).collect())
    places = [(root, entry) for root, entry, _ in borders]

    def open_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            pids: list[int] = []
            for i, (root, a, z) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                for k in range(bisect.bisect_right(places, (root, a)), bisect.bisect_left(places, (root, z))):
                    index.append(i)
                    pids.append(borders[k][2])
            taken = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:5], pa.array(pids, pa.int32()), pa.array([True] * len(pids), pa.bool_())], names=batch.schema.names)

    kinds = "node_id string, root_id string, depth int, entry long, exit long, pid int, carried boolean"
    both = stored.unionByName(stored.mapInArrow(open_at, kinds))
    return both.repartition(n, "pid").sortWithinPartitions("pid", "root_id", "entry")


def _scan(ordered: DataFrame, schema: str, pairs: bool) -> DataFrame:
    """One pass with a stack of open intervals: the path of each node, or a row for each of its ancestors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, int]] = []
        place: tuple[int, str] | None = None
        for batch in batches:
            out: list[tuple] = []
            for node, root, depth, _, end, pid, carried in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (pid, root):
                    stack, place = [], (pid, root)
                while stack and stack[-1][1] < end:
                    stack.pop()
                if not carried:
                    if pairs:
                        out += [(a, node, len(stack) - k) for k, (a, _) in enumerate(stack)]
                    else:
                        out.append((node, root, depth, "/".join([*(a for a, _ in stack), node])))
                stack.append((node, end))
                if len(out) > 100_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int32()] + ([] if pairs else [pa.string()])
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [part.split(" ")[0] for part in schema.split(", ")]
    return ordered.mapInArrow(run, schema)


def paths(relations: DataFrame, **columns: str) -> DataFrame:
    """(node_id, root_id, depth, path): ids from the root down, joined by '/'; nodes on or below a cycle have null."""
    scratch = Scratch(relations.sparkSession, "paths")
    nodes = scratch.put(ranks(scratch.put(parent_links(relations, **columns)), scratch))
    ordered = _in_order(nodes, scratch)
    found = _scan(ordered.select("node_id", "root_id", "depth", "entry", "exit", "pid", "carried"), "node_id string, root_id string, depth int, path string", False)
    cyclic = nodes.where("depth < 0").select("node_id", "root_id", "depth", F.lit(None).cast("string").alias("path"))
    return found.unionByName(cyclic)


def descendants(relations: DataFrame, **columns: str) -> DataFrame:
    """(node_id, descendant_id, distance) of every ancestor and descendant outside cycles."""
    scratch = Scratch(relations.sparkSession, "descendants")
    nodes = scratch.put(ranks(scratch.put(parent_links(relations, **columns)), scratch))
    ordered = _in_order(nodes, scratch)
    return _scan(ordered.select("node_id", "root_id", "depth", "entry", "exit", "pid", "carried"), "node_id string, descendant_id string, distance int", True)
