"""Registered queries of the general data-preparation operators (hierarchies, quantities)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import hierarchy, quantities
from orrery.plans.runtime import table


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every convertible claim in its field's canonical unit."""
    return quantities.normalise_units(
        table(spark, sf_dir, "claims"), table(spark, sf_dir, "field_ref"), table(spark, sf_dir, "unit_ref"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose quantity had to be converted, with the unit it is stated in."""
    return p3_units(spark, sf_dir).where("unit_from <> unit_norm").select("claim_id", "unit_from")


def p7_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, tour interval and number of descendants of each node."""
    return hierarchy.hierarchy(table(spark, sf_dir, "record_relations"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depths(table(spark, sf_dir, "record_relations"))


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of each node from its root."""
    return hierarchy.paths(table(spark, sf_dir, "record_relations"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ancestor and descendant with their distance."""
    return hierarchy.descendants(table(spark, sf_dir, "record_relations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_units": p3_units,
    "p7_found": p7_found,
    "p7_hierarchy": p7_hierarchy,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
}

_EDGES = """
raw AS (
  SELECT trim(regexp_replace(trim(child_model_id), '^#\\s*', '')) AS c,
         trim(regexp_replace(trim(rel_parent_model_id), '^#\\s*', '')) AS p1,
         trim(regexp_replace(trim(parent_rid), '^#\\s*', '')) AS p2
  FROM record_relations
), ids AS (
  SELECT CASE WHEN regexp_extract(c, '^0*(\\d+?)(?:\\.0*)?$', 1) <> '' THEN regexp_extract(c, '^0*(\\d+?)(?:\\.0*)?$', 1) ELSE nullif(c, '') END AS c,
         CASE WHEN regexp_extract(p1, '^0*(\\d+?)(?:\\.0*)?$', 1) <> '' THEN regexp_extract(p1, '^0*(\\d+?)(?:\\.0*)?$', 1) ELSE nullif(p1, '') END AS p1,
         CASE WHEN regexp_extract(p2, '^0*(\\d+?)(?:\\.0*)?$', 1) <> '' THEN regexp_extract(p2, '^0*(\\d+?)(?:\\.0*)?$', 1) ELSE nullif(p2, '') END AS p2
  FROM raw
), pairs AS (
  SELECT DISTINCT c AS node_id, coalesce(p1, p2) AS parent_id FROM ids WHERE c IS NOT NULL AND coalesce(p1, p2) IS NOT NULL
), edges AS (
  SELECT node_id, parent_id FROM (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY length(parent_id), parent_id) AS rn FROM pairs) WHERE rn = 1
), nodes AS (
  SELECT node_id FROM edges UNION SELECT parent_id FROM edges
), tree AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM nodes WHERE node_id NOT IN (SELECT node_id FROM edges)
  UNION ALL
  SELECT e.node_id, t.root_id, t.depth + 1, t.path || '/' || e.node_id FROM edges e JOIN tree t ON e.parent_id = t.node_id
)
"""

ORACLES: dict[str, str] = {
    "p7_hierarchy": f"""WITH RECURSIVE {_EDGES}, lists AS (
  SELECT *, string_split(path, '/') AS steps FROM tree
), placed AS (
  SELECT node_id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY steps) - 1 AS i, count(*) OVER (PARTITION BY root_id) AS n FROM lists
), below AS (
  SELECT u.node_id, count(*) AS m FROM (SELECT unnest(steps[:-2]) AS node_id FROM lists) u GROUP BY 1
), spans AS (
  SELECT p.*, coalesce(b.m, 0) AS m, 2 * (n - 1) AS arcs FROM placed p LEFT JOIN below b USING (node_id)
)
SELECT n.node_id, e.parent_id, coalesce(s.root_id, 'CYCLE') AS root_id, CAST(coalesce(s.depth, -1) AS INTEGER) AS depth,
       CAST(CASE WHEN s.depth = 0 THEN -arcs - 1 ELSE -(arcs - (2 * i - s.depth) + 1) END AS BIGINT) AS entry,
       CAST(CASE WHEN s.depth = 0 THEN 0 ELSE -(arcs - (2 * i - s.depth + 2 * m + 1) + 1) END AS BIGINT) AS exit,
       CAST(s.m AS BIGINT) AS n_descendants
FROM nodes n LEFT JOIN edges e USING (node_id) LEFT JOIN spans s USING (node_id)""",
    "p7_found": f"""WITH RECURSIVE {_EDGES}
SELECT n.node_id, coalesce(t.root_id, 'CYCLE') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
FROM nodes n LEFT JOIN tree t USING (node_id)""",
    "p7_paths": f"""WITH RECURSIVE {_EDGES}
SELECT n.node_id, coalesce(t.root_id, 'CYCLE') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, t.path
FROM nodes n LEFT JOIN tree t USING (node_id)""",
    "p7_descendants": f"""WITH RECURSIVE {_EDGES}, up AS (
  SELECT e.node_id AS descendant_id, e.parent_id AS node_id, 1 AS distance FROM edges e JOIN tree t ON e.node_id = t.node_id
  UNION ALL
  SELECT u.descendant_id, e.parent_id, u.distance + 1 FROM up u JOIN edges e ON e.node_id = u.node_id)
SELECT node_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM up""",
}
