"""Registered queries of the catalogue, filter, retrieval, evidence and enrichment operators, with SQL counterparts.

The catalogue's records are ``models`` (first release of each), its parameters the 'Parameter' lines
of ``records`` and the linked ``claims``, its passages ``records``, its edges ``record_relations``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.operators import catalogue, enrich, evidence, fields, filters, linking, names, quantities, retrieval
from orrery.operators.hierarchy import plain_id
from orrery.plans.runtime import Scratch, broadcast_if_small, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with its SQL counterpart if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- the catalogue's tables -----------------------------------------------------------------------

ATTRIBUTES = ["system_group", "system_type", "manufacturer", "country_of_origin", "ioc_year", "created_date"]


def records_of(spark: SparkSession, sf: str) -> DataFrame:
    """(rid, title, ...) one row per model: its first release."""
    m = table(spark, sf, "models")
    first = m.groupBy("model_id").agg(F.min("release_id").alias("release_id"))
    return m.join(first, ["model_id", "release_id"]).dropDuplicates(["model_id"]).withColumn("rid", F.col("model_id").cast("string")).withColumn(
        "title", F.trim(F.regexp_replace("nomenclature", r"\s+", " ")))


def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Long field table: attributes of the records and the normalised values of their claims."""
    own = fields.from_columns(records_of(spark, sf), "rid", ATTRIBUTES)
    claims = table(spark, sf, "claims").where("model_id is not null and canon_field is not null and value_norm is not null").dropDuplicates(["claim_id"])
    given = claims.select(
        F.col("model_id").alias("rid"), F.col("canon_field").alias("field"), F.col("claim_id").cast("long").alias("seq"),
        F.col("value_norm").alias("num"), F.col("value_norm").alias("lo"), F.col("value_norm").alias("hi"), F.lit(None).cast("string").alias("str"),
        F.lit("number").alias("kind"), F.col("unit_norm").alias("unit"))
    return own.unionByName(given)


_RECORDS = """
rec AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY release_id) AS rn FROM models) WHERE rn = 1
), own AS (
  SELECT CAST(model_id AS VARCHAR) AS rid, f.field, f.num, f.str FROM rec,
    LATERAL (VALUES ('system_group', NULL::DOUBLE, system_group), ('system_type', NULL, system_type), ('manufacturer', NULL, manufacturer),
                    ('country_of_origin', NULL, country_of_origin), ('ioc_year', ioc_year::DOUBLE, NULL), ('created_date', NULL, created_date)) AS f(field, num, str)
  WHERE f.num IS NOT NULL OR (f.str IS NOT NULL AND f.str <> '')
), given AS (
  SELECT DISTINCT ON (claim_id) claim_id, model_id AS rid, canon_field AS field, value_norm AS num, NULL::VARCHAR AS str, unit_norm AS unit
  FROM claims WHERE model_id IS NOT NULL AND canon_field IS NOT NULL AND value_norm IS NOT NULL
), fld AS (
  SELECT rid, field, num, str FROM own UNION ALL SELECT rid, field, num, str FROM given
)"""

_CATALOGUE = _RECORDS + """, byrec AS (
  SELECT rid, field, min(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) AS numeric_rec, max(CASE WHEN regexp_full_match(coalesce(str, ''), '\\d{4}-\\d{1,2}-\\d{1,2}') THEN 1 ELSE 0 END) AS dated, count(*) AS n
  FROM fld GROUP BY rid, field
), agg AS (
  SELECT field, count(*) AS cnt, sum(numeric_rec) AS nn, sum(dated) AS nd, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS ml FROM byrec GROUP BY field
), st AS (
  SELECT field, min(num) AS mn, round(quantile_cont(num, 0.05) + 1e-8, 4) AS p5, round(quantile_cont(num, 0.5) + 1e-8, 4) AS md, round(quantile_cont(num, 0.95) + 1e-8, 4) AS p95, max(num) AS mx FROM fld WHERE num IS NOT NULL GROUP BY field
), tx AS (
  SELECT field, count(DISTINCT str) AS nds, avg(length(str)) AS al, count(*) AS nt FROM fld WHERE str IS NOT NULL GROUP BY field
), cat AS (
  SELECT a.field, CASE WHEN nn >= greatest(1, ceil(cnt * 0.5)) THEN 'numeric' WHEN ml = 1 THEN 'multi_value' WHEN nd >= greatest(1, ceil(cnt * 0.5)) THEN 'date'
      WHEN nds IS NULL THEN 'unknown' WHEN al < 40 AND (nds <= 20 OR (nds <= 50 AND nds * 1.0 / nt <= 0.5)) THEN 'categorical' ELSE 'free_text' END AS type,
    cnt, nn, nd, ml, mn, p5, md, p95, mx, coalesce(nds, 0) AS nds
  FROM agg a LEFT JOIN st USING (field) LEFT JOIN tx USING (field)
)"""


@query(f"WITH {_CATALOGUE} SELECT field, type, cnt AS count, CASE WHEN type = 'numeric' THEN mn END AS min, CASE WHEN type = 'numeric' THEN p5 END AS p5, "
       "CASE WHEN type = 'numeric' THEN md END AS median, CASE WHEN type = 'numeric' THEN p95 END AS p95, CASE WHEN type = 'numeric' THEN mx END AS max, nds AS n_distinct, "
       "field IN ('created_date') AS admin, coalesce(CASE WHEN type = 'numeric' THEN nn WHEN type = 'date' THEN nd END < ceil(cnt * 0.8), false) AS partial, ml = 1 AS multi, false AS intervals FROM cat")
def catalogue_fields(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.classify(field_rows(spark, sf))


@query(f"WITH {_CATALOGUE} SELECT CASE WHEN field = 'created_date' THEN 'admin' ELSE type END AS type, count(*) AS fields FROM cat GROUP BY 1")
def catalogue_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.type_counts(catalogue_fields(spark, sf))


@query(f"WITH {_CATALOGUE} SELECT field, type, cnt AS count, nds AS n_distinct FROM cat WHERE type IN ('categorical', 'multi_value') AND field <> 'created_date' AND nds <= 40 ORDER BY cnt DESC, nds, field LIMIT 8")
def partition_fields(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.partition_fields(catalogue_fields(spark, sf))


@query(f"WITH {_CATALOGUE}, lab AS (SELECT rid, str AS category FROM fld WHERE field = 'system_type') "
       "SELECT category, f.field, count(*) AS count, min(num) AS min, round(quantile_cont(num, 0.05) + 1e-8, 4) AS p5, round(quantile_cont(num, 0.5) + 1e-8, 4) AS median, round(quantile_cont(num, 0.95) + 1e-8, 4) AS p95, max(num) AS max "
       "FROM fld f JOIN lab USING (rid) WHERE num IS NOT NULL AND f.field IN (SELECT field FROM cat WHERE type = 'numeric') GROUP BY category, f.field HAVING count(*) >= 2")
def category_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = field_rows(spark, sf)
    return catalogue.category_stats(rows, catalogue.classify(rows), "system_type")


@query("SELECT field, string_agg(DISTINCT v, '|' ORDER BY v) AS labels FROM (SELECT 'system_type' AS field, trim(system_type) AS v FROM models WHERE system_type <> '' UNION ALL "
       "SELECT 'country_of_origin', trim(country_of_origin) FROM models WHERE country_of_origin <> '') GROUP BY field")
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = fields.from_columns(table(spark, sf, "models"), "model_id", ["system_type", "country_of_origin"])
    return catalogue.label_values(rows).select("field", F.array_join("values", "|").alias("labels"))


@query(f"WITH {_RECORDS} SELECT field, count(DISTINCT rid) AS records FROM fld WHERE rid IN (SELECT rid FROM fld WHERE field = 'system_group' AND str = 'Sensors') GROUP BY field")
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = field_rows(spark, sf)
    return catalogue.coverage(rows, filters.eligible(rows, {"system_group": {"in": ["Sensors"]}}))


_UNITS = """counts AS (SELECT field, unit, count(*) AS n FROM given WHERE unit IS NOT NULL GROUP BY field, unit),
major AS (SELECT field, unit AS to_unit FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, unit) AS rn FROM counts) WHERE rn = 1),
conv AS (SELECT g.field, m.to_unit, CASE WHEN g.unit IS NULL OR m.to_unit IS NULL OR g.unit = m.to_unit OR coalesce(a.dimension <> b.dimension, true) THEN g.num ELSE (g.num * a.factor + a.shift - b.shift) / b.factor END AS v,
  (g.unit IS NULL OR m.to_unit IS NULL OR g.unit = m.to_unit OR coalesce(a.dimension = b.dimension, false)) AS ok
  FROM given g LEFT JOIN major m USING (field) LEFT JOIN unit_ref a ON a.unit = g.unit LEFT JOIN unit_ref b ON b.unit = m.to_unit)"""


@query(f"WITH {_RECORDS}, {_UNITS} SELECT field, to_unit, count(*) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS kept_unconverted, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM conv GROUP BY field, to_unit")
def unit_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    given = field_rows(spark, sf).where("seq > 0")
    done = catalogue.reconcile_units(given, table(spark, sf, "unit_ref"))
    return done.groupBy("field", "to_unit").agg(F.count("*").alias("n"), F.sum((~F.col("converted")).cast("long")).alias("kept_unconverted"),
                                                F.round(F.min("num"), 4).alias("lo"), F.round(F.max("num"), 4).alias("hi"))


@query(f"WITH {_CATALOGUE} SELECT CAST(row_number() OVER (ORDER BY cnt DESC, field) AS INTEGER) AS rank, field FROM cat WHERE field <> 'created_date' AND cnt >= 2")
def catalogue_prompt_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = field_rows(spark, sf)
    lines = catalogue.spec_lines(catalogue.classify(rows), catalogue.label_values(rows), min_count=2)
    return lines.select("rank", F.regexp_extract("line", r"^(.*?) \(\d+\): ", 1).alias("field"))


@query("SELECT canon_field AS field, CASE WHEN count(definition) = 0 THEN 'missing definition' END AS issue FROM field_ref GROUP BY canon_field HAVING count(definition) = 0 "
       "UNION ALL SELECT c.canon_field, 'inconvertible units' FROM claims c JOIN unit_ref u ON u.unit = c.unit_norm WHERE c.canon_field IN (SELECT canon_field FROM field_ref) GROUP BY c.canon_field HAVING count(DISTINCT u.dimension) > 1")
def field_audit(spark: SparkSession, sf: str) -> DataFrame:
    ref = table(spark, sf, "field_ref").select(F.col("canon_field").alias("field"), "definition", F.col("data_type").alias("dtype"))
    used = table(spark, sf, "claims").select(F.col("canon_field").alias("field"), F.col("unit_norm").alias("unit")).where("unit is not null").distinct()
    profiles = ref.join(used, "field", "left")
    return catalogue.audit(profiles, table(spark, sf, "unit_ref"))


@query("WITH rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY release_id) AS rn FROM models) WHERE rn = 1) "
       "SELECT CAST(a.model_id AS VARCHAR) AS rid, count(*) - 1 AS n_peers FROM rec a JOIN rec b ON a.system_type = b.system_type OR a.system_group = b.system_group GROUP BY a.model_id")
def record_peers(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.peers(records_of(spark, sf), "model_id", "system_type", "system_group")


def _ungrouped(column: str) -> str:
    """SQL that removes thousands commas of whole numbers; RE2 has no look-around."""
    return f"CASE WHEN regexp_full_match({column}, '[+-]?\\d+(,\\d{{3}})+(\\.\\d*)?') THEN replace({column}, ',', '') ELSE {column} END"


# --- values ---------------------------------------------------------------------------------------

@query("SELECT claim_id, max(CASE WHEN regexp_full_match(s, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(s AS DOUBLE) END) AS num FROM "
       f"(SELECT claim_id, {_ungrouped('trim(value_raw)')} AS s FROM claims WHERE value_raw IS NOT NULL) GROUP BY claim_id")
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").where("value_raw is not null")
    return c.groupBy("claim_id").agg(F.max(V.coerce_number(F.col("value_raw"))).alias("num"))


@query("SELECT DISTINCT claim_id, round(least(a, b), 6) AS lo, round(greatest(a, b), 6) AS hi FROM (SELECT claim_id, TRY_CAST(replace(regexp_extract(value_raw, '^\\s*([+-]?\\d+(?:,\\d{3})*(?:\\.\\d*)?)\\s+to\\s+([+-]?\\d+(?:,\\d{3})*(?:\\.\\d*)?)\\s*$', 1), ',', '') AS DOUBLE) AS a, "
       "TRY_CAST(replace(regexp_extract(value_raw, '^\\s*([+-]?\\d+(?:,\\d{3})*(?:\\.\\d*)?)\\s+to\\s+([+-]?\\d+(?:,\\d{3})*(?:\\.\\d*)?)\\s*$', 2), ',', '') AS DOUBLE) AS b FROM claims) WHERE a IS NOT NULL AND b IS NOT NULL")
def parse_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals among the claims' values; these tables hold none, ``parse_interval_ranges`` has cases."""
    plain = table(spark, sf, "claims").select("claim_id", V.parse_interval(F.col("value_raw")).alias("i")).where("i is not null")
    return plain.select("claim_id", F.round("i.lo", 6).alias("lo"), F.round("i.hi", 6).alias("hi")).distinct()


@query("SELECT year(TRY_CAST(created_date AS DATE)) AS year, count(*) AS n FROM models WHERE TRY_CAST(created_date AS DATE) IS NOT NULL GROUP BY 1")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    dated = table(spark, sf, "models").select(V.parse_date(F.col("created_date")).alias("d")).where("d is not null")
    return dated.groupBy(F.year("d").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT claim_id, substr(sha1(concat_ws('|', coalesce(model_id, 'None'), coalesce(canon_field, 'None'))), 1, 16) AS fp FROM (SELECT DISTINCT claim_id, model_id, canon_field FROM claims)")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("claim_id", "model_id", "canon_field").distinct().select("claim_id", V.fingerprint(F.col("model_id"), F.col("canon_field")).alias("fp"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PARAMS = """lines AS (
  SELECT parent_rid AS rid, row_id, u.line, u.pos FROM records, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u WHERE parent_rid IS NOT NULL AND text IS NOT NULL
), params AS (
  SELECT rid, regexp_extract(line, '^Parameter ([^\\[=]+?)(?: \\[([^\\]]*)\\])? = (\\S+(?: to \\S+)?)(?: ([^(]*?))?(?: \\((.*)\\))?$', 1) AS name,
    regexp_extract(line, '^Parameter ([^\\[=]+?)(?: \\[([^\\]]*)\\])? = (\\S+(?: to \\S+)?)(?: ([^(]*?))?(?: \\((.*)\\))?$', 3) AS value,
    nullif(trim(regexp_extract(line, '^Parameter ([^\\[=]+?)(?: \\[([^\\]]*)\\])? = (\\S+(?: to \\S+)?)(?: ([^(]*?))?(?: \\((.*)\\))?$', 4)), '') AS unit,
    row_number() OVER (PARTITION BY rid ORDER BY row_id, pos) AS seq
  FROM lines WHERE regexp_full_match(line, 'Parameter ([^\\[=]+?)(?: \\[([^\\]]*)\\])? = (\\S+(?: to \\S+)?)(?: ([^(]*?))?(?: \\((.*)\\))?')
)"""


@query(f"WITH {_PARAMS} SELECT rid, name, string_agg(value, '; ' ORDER BY seq) AS value, min_by(unit, seq) FILTER (WHERE unit IS NOT NULL) AS unit FROM params GROUP BY rid, name")
def rich_params(spark: SparkSession, sf: str) -> DataFrame:
    return fields.rich_params(fields.param_lines(table(spark, sf, "records"))).select("rid", "name", "value", "unit")


@query(f"WITH {_PARAMS} SELECT name AS field, count(*) AS n, CAST(sum(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS numbers FROM params GROUP BY name")
def typed_params(spark: SparkSession, sf: str) -> DataFrame:
    typed = fields.from_params(fields.param_lines(table(spark, sf, "records")))
    return typed.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.col("num").isNotNull().cast("long")).alias("numbers"))


@query("SELECT user_id, round(min(value), 2) AS lo, round(max(value), 2) AS hi FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING min(value) IS NOT NULL")
def parse_interval_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The range of each user's values, written as text with the bounds in either order, and read back."""
    e = table(spark, sf, "events").where("user_id is not null").groupBy("user_id").agg(F.round(F.min("value"), 2).alias("a"), F.round(F.max("value"), 2).alias("z"))
    text = F.when(F.col("user_id") % 2 == 0, F.concat_ws(" to ", F.col("a").cast("string"), F.col("z").cast("string"))).otherwise(
        F.concat_ws(" to ", F.col("z").cast("string"), F.col("a").cast("string")))
    return e.where("a is not null").select("user_id", V.parse_interval(text).alias("i")).select("user_id", F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"))


# --- filters --------------------------------------------------------------------------------------

@query(f"WITH {_RECORDS} SELECT DISTINCT rid FROM fld WHERE field = 'Maximum range' AND num >= 100 AND num <= 500")
def filter_numeric_any(spark: SparkSession, sf: str) -> DataFrame:
    return filters.eligible(field_rows(spark, sf), {"Maximum range": {"type": "numeric", "min": 100, "max": 500}})


@query("SELECT CAST(user_id AS VARCHAR) AS rid FROM events GROUP BY user_id HAVING max(value) >= 50 AND min(value) <= 60")
def filter_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = spans.select(F.col("user_id").cast("string").alias("rid"), F.lit("value").alias("field"), "lo", "hi", F.lit("interval").alias("kind"), F.lit(None).cast("string").alias("str"))
    return filters.eligible(rows, {"value": {"type": "numeric", "min": 50, "max": 60}})


@query(f"WITH {_RECORDS} SELECT rid FROM fld WHERE field = 'country_of_origin' AND str IN ('Norway', 'Poland') GROUP BY rid")
def filter_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return filters.eligible(field_rows(spark, sf), {"country_of_origin": {"in": ["Norway", "Poland"]}})


@query("SELECT CAST(l_orderkey AS VARCHAR) AS rid FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey")
def filter_contains_any(spark: SparkSession, sf: str) -> DataFrame:
    rows = fields.from_columns(table(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag"])
    return filters.eligible(rows, {"l_returnflag": {"contains": ["A", "R"]}})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'")
def filter_date_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = fields.from_columns(table(spark, sf, "orders"), "o_orderkey", ["o_orderdate"])
    return filters.eligible(rows, {"o_orderdate": {"date_from": "1995-03-01", "date_to": "1996-02-28"}})


@query(f"WITH {_RECORDS} SELECT rid FROM fld WHERE (field = 'system_group' AND str = 'Sensors') OR (field = 'ioc_year' AND num >= 1990) GROUP BY rid HAVING count(DISTINCT field) = 2")
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    return filters.eligible(field_rows(spark, sf), {"system_group": {"in": ["Sensors"]}, "ioc_year": {"type": "numeric", "min": 1990}})


@query("SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY p_brand")
def filter_count(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = fields.from_columns(part, "p_partkey", ["p_size"])
    ok = filters.eligible(rows, {"p_size": {"type": "numeric", "min": 10, "max": 20}})
    return part.withColumn("rid", F.col("p_partkey").cast("string")).join(ok, "rid", "left_semi").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))


# --- retrieval ------------------------------------------------------------------------------------

def query_vector(spark: SparkSession, sf: str, key: int = 0) -> list[float]:
    """The vector of the first row stands for the embedded question."""
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == key).select("embedding").first()[0])


_SCORED = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings, q)"


@query(f"WITH {_SCORED} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_top(table(spark, sf, "embeddings"), "embedding", query_vector(spark, sf), "vec_id")


@query(f"WITH {_SCORED} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.vector_top(table(spark, sf, "embeddings").where(F.col("label").isin(1, 3)), "embedding", query_vector(spark, sf), "vec_id")


def bm25_sql(name: str, key: str, terms: list[str], limit: int = 20) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""w AS (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM {name} WHERE text IS NOT NULL),
t AS (SELECT {key}, len(w) AS dl, unnest(w) AS term FROM w), n AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM w),
h AS (SELECT {key}, dl, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT {key}, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM h JOIN d USING (term), n GROUP BY {key} ORDER BY score DESC, {key} LIMIT {limit})"""


@query(f"WITH {bm25_sql('records', 'row_id', ['redundant', 'gearbox', 'winter', 'patrols'])} SELECT row_id, score, CAST(row_number() OVER (ORDER BY score DESC, row_id) - 1 AS INTEGER) AS rank FROM b")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25_top(table(spark, sf, "records"), "row_id", "text", "redundant gearbox winter patrols")


_FUSED = f"""{_SCORED}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s ORDER BY score DESC, vec_id LIMIT 20),
l AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) - 1 AS rank FROM embeddings ORDER BY label, vec_id LIMIT 20),
u AS (SELECT id, rank, 0 AS list FROM v UNION ALL SELECT id, rank, 1 FROM l),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, min(list * 1000000 + rank) AS seen FROM u GROUP BY id),
r AS (SELECT id AS vec_id, rrf, CAST(row_number() OVER (ORDER BY rrf DESC, seen) - 1 AS INTEGER) AS rank FROM f)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = retrieval.vector_top(e, "embedding", query_vector(spark, sf), "vec_id")
    second = e.orderBy("label", "vec_id").limit(20).select("vec_id", (F.row_number().over(Window.orderBy("label", "vec_id")) - 1).alias("rank"))
    return retrieval.fuse(first, second, "vec_id")


@query(f"WITH {_FUSED} SELECT vec_id, rrf, rank FROM r")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf)


_NORMAL = f"{_FUSED}, m AS (SELECT vec_id, rank, CASE WHEN max(rrf) OVER () <= min(rrf) OVER () THEN 1.0 ELSE round((rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()), 6) END AS rel FROM r)"


@query(f"WITH {_NORMAL} SELECT vec_id, rel, rank FROM m")
def score_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.normalise(_fused(spark, sf)).select("vec_id", "rel", "rank")


@query(f"WITH {_NORMAL}, g AS (SELECT vec_id, rank AS old, round(rel + CASE WHEN vec_id % 3 = 0 THEN 0.15 ELSE 0 END, 6) AS rel FROM m) SELECT vec_id, rel, CAST(row_number() OVER (ORDER BY rel DESC, old) - 1 AS INTEGER) AS rank FROM g")
def soft_boost(spark: SparkSession, sf: str) -> DataFrame:
    ok = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select("vec_id")
    return retrieval.soft_boost(retrieval.normalise(_fused(spark, sf)), ok, "vec_id").select("vec_id", "rel", "rank")


@query(f"WITH {_FUSED}, e AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s WHERE vec_id % 3 = 0 ORDER BY score DESC, vec_id LIMIT 20), "
       "x AS (SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM e) THEN 0 ELSE 2 END AS tier, rank FROM r UNION ALL SELECT vec_id, 1, rank FROM e WHERE vec_id NOT IN (SELECT vec_id FROM r)) "
       "SELECT vec_id, tier, CAST(row_number() OVER (ORDER BY tier, rank, vec_id) - 1 AS INTEGER) AS rank FROM x")
def fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    ok = retrieval.vector_top(table(spark, sf, "embeddings").where("vec_id % 3 = 0"), "embedding", query_vector(spark, sf), "vec_id")
    return retrieval.fill(_fused(spark, sf), ok, "vec_id")


@query(f"WITH {_NORMAL}, h AS (SELECT vec_id, rank, CASE WHEN rank < 10 THEN vec_id % 7 END AS ce FROM m) SELECT vec_id, CAST(row_number() OVER (ORDER BY ce IS NULL, ce DESC, rank) - 1 AS INTEGER) AS rank FROM h")
def rerank_head(spark: SparkSession, sf: str) -> DataFrame:
    scorer = lambda head: head.select("vec_id", (F.col("vec_id") % 7).alias("ce"))
    return retrieval.rerank(retrieval.normalise(_fused(spark, sf)), scorer, "vec_id", pool=10).select("vec_id", "rank")


@query(f"WITH {_NORMAL}, p AS (SELECT m.*, e.label, CASE WHEN m.vec_id = (SELECT max(vec_id) FROM m) THEN 0 ELSE 1 END AS free FROM m JOIN embeddings e USING (vec_id)), "
       "o AS (SELECT vec_id, label, rel, free = 0 AS pinned, row_number() OVER (ORDER BY free, rank, vec_id) - 1 AS rank FROM p), "
       "c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) AS nth FROM o WHERE rel >= 0.1 OR pinned) "
       "SELECT vec_id, label, rel, pinned, CAST(row_number() OVER (ORDER BY rank) - 1 AS INTEGER) AS rank FROM c WHERE nth <= 2 ORDER BY rank LIMIT 6")
def pin_and_cap(spark: SparkSession, sf: str) -> DataFrame:
    ranked = retrieval.normalise(_fused(spark, sf))
    last = ranked.agg(F.max("vec_id").alias("vec_id")).withColumn("pin_no", F.lit(0))
    pinned = retrieval.pin(ranked, last, "vec_id").join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.assemble(pinned, "vec_id", "label", k=6, max_per_parent=2, min_rel=0.1)


@query(f"WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s WHERE label <> 4) SELECT label, vec_id, score FROM b WHERE rn = 1 ORDER BY score DESC, label LIMIT 24")
def digest_best_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    shown = spark.createDataFrame([(4,)], "label int").select(F.col("label").cast(dict(e.dtypes)["label"]).alias("label"))
    return retrieval.digest(e, "label", "embedding", query_vector(spark, sf), "vec_id", exclude=shown)


@query(f"WITH {_SCORED} SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s")
def rank_within_parent(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rank_within_parent(table(spark, sf, "embeddings"), "label", "embedding", query_vector(spark, sf), "vec_id")


@query()
def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The whole composition over the passages with a soft filter and one pinned record; tested against its parts."""
    records = table(spark, sf, "records")
    start = records.where("embedding is not null").orderBy("row_id").select("embedding", "parent_rid").first()
    ok = filters.eligible(field_rows(spark, sf), {"system_group": {"in": ["Sensors"]}})
    pins = spark.createDataFrame([(start[1], 0)], "rid string, pin_no int")
    return retrieval.retrieve(records, "redundant gearbox winter patrols", list(start[0]), k=6, mode="soft", eligible=ok, pins=pins, n_pins=1, max_per_parent=2)


BUDGET = 2000


@query(f"SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, CAST(sum(greatest(1, length(text) // 4)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents WHERE text IS NOT NULL QUALIFY used <= {BUDGET}")
def budget_pack_all(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order of id until the budget is used."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", V.estimated_tokens(F.col("text")).alias("tokens"))
    docs = docs.orderBy("doc_id").limit(BUDGET)  # a text has at least one token, so no more texts than tokens can fit
    used = F.sum("tokens").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("used", used).where(f"used <= {BUDGET}")


# --- evidence -------------------------------------------------------------------------------------

_LINKS = """ids AS (SELECT regexp_replace(trim(regexp_replace(trim(coalesce(nullif(trim(regexp_replace(trim(rel_parent_model_id), '^#\\s*', '')), ''), parent_rid)), '^#\\s*', '')), '^0*(\\d+?)(?:\\.0*)?$', '\\1') AS parent,
  regexp_replace(trim(regexp_replace(trim(child_model_id), '^#\\s*', '')), '^0*(\\d+?)(?:\\.0*)?$', '\\1') AS child, relation_type, lower(trim(child_name)) AS child_name FROM record_relations),
links AS (SELECT DISTINCT parent, child, relation_type FROM ids WHERE nullif(parent, '') IS NOT NULL AND nullif(child, '') IS NOT NULL),
ttl AS (SELECT CAST(model_id AS VARCHAR) AS rid, trim(regexp_replace(min_by(nomenclature, release_id), '\\s+', ' ', 'g')) AS title FROM models GROUP BY model_id)"""


@query(f"WITH {_LINKS} SELECT child AS rid, string_agg(DISTINCT title, '; ' ORDER BY title) AS fitted_to FROM links JOIN ttl ON ttl.rid = parent WHERE child IN (SELECT rid FROM ttl) GROUP BY child")
def reverse_edges(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.fitted_to(evidence.edges(table(spark, sf, "record_relations"), plain_id), records_of(spark, sf).select("rid", "title"))


@query(f"WITH {_LINKS}, n AS (SELECT parent AS seed, child AS rid, relation_type FROM links UNION ALL SELECT child, parent, relation_type FROM links) "
       "SELECT seed, n.rid, string_agg(DISTINCT concat_ws(': ', relation_type, s.title), '; ' ORDER BY concat_ws(': ', relation_type, s.title)) AS labels FROM n JOIN ttl s ON s.rid = seed JOIN ttl o ON o.rid = n.rid WHERE seed <> n.rid GROUP BY seed, n.rid")
def related_one_hop_each(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of every record with the relations that lead to them."""
    titles = records_of(spark, sf).select("rid", "title")
    return evidence.related_each(evidence.edges(table(spark, sf, "record_relations"), plain_id), titles, titles)


@query(f"WITH {_LINKS}, b AS (SELECT parent AS seed, * FROM links UNION ALL SELECT child, * FROM links WHERE child <> parent), "
       "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY parent, child, relation_type) AS rn FROM b WHERE seed IN (SELECT rid FROM ttl)) WHERE rn <= 12) "
       "SELECT seed, parent, child, relation_type, parent <> seed AS reversed, coalesce(p.title, parent) AS parent_title, coalesce(c.title, child) AS child_title FROM t LEFT JOIN ttl p ON p.rid = parent LEFT JOIN ttl c ON c.rid = child")
def relation_evidence_each(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 12 edges of every record, the limit of the operator."""
    titles = records_of(spark, sf).select("rid", "title")
    return evidence.relation_rows_each(evidence.edges(table(spark, sf, "record_relations"), plain_id), titles, titles)


@query(f"WITH {_LINKS} SELECT DISTINCT parent AS rid, child_name AS alias FROM ids WHERE nullif(parent, '') IS NOT NULL AND child_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ttl WHERE ttl.rid = ids.child)")
def outside_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.outside_names(table(spark, sf, "record_relations"), "child_model_id", records_of(spark, sf).select("rid", "title"), plain_id)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS rid, min(CASE WHEN l_returnflag = 'A' THEN q END) AS A, min(CASE WHEN l_returnflag = 'N' THEN q END) AS N, min(CASE WHEN l_returnflag = 'R' THEN q END) AS R FROM "
       "(SELECT l_orderkey, l_returnflag, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey ORDER BY max(CASE WHEN l_returnflag = 'A' THEN CAST(q AS DOUBLE) END) DESC NULLS LAST, rid LIMIT 40")
def record_table_pivot(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").cast("string").alias("value"))
    cells = sums.select(F.col("l_orderkey").cast("string").alias("rid"), F.col("l_returnflag").alias("field"), "value")
    orders = cells.select("rid").distinct().withColumn("title", F.col("rid"))
    return evidence.record_table(orders, cells, ["A", "N", "R"], ["A"]).select("rid", "A", "N", "R")


@query(f"WITH {_PARAMS}, pick AS (SELECT min(rid) AS rid FROM params WHERE name = 'Length') SELECT string_agg(value, ', ' ORDER BY seq) AS value, max(unit) AS unit FROM params JOIN pick USING (rid) WHERE name = 'Length'")
def direct_lookup(spark: SparkSession, sf: str) -> DataFrame:
    params = fields.param_lines(table(spark, sf, "records"))
    rid = params.where("name = 'Length'").agg(F.min("rid")).first()[0]
    return evidence.direct_value(params, field_rows(spark, sf), rid, "Length")


# --- names ----------------------------------------------------------------------------------------

@query("WITH t AS (SELECT CAST(model_id AS VARCHAR) AS rid, trim(regexp_replace(min_by(nomenclature, release_id), '\\s+', ' ', 'g')) AS title FROM models GROUP BY model_id), "
       f"a AS (SELECT title AS alias, rid FROM t UNION ALL SELECT unnest(regexp_extract_all(title, '{names.DESIGNATION}')), rid FROM t UNION ALL SELECT unnest(regexp_extract_all(title, '\\(([^)]+)\\)', 1)), rid FROM t "
       "UNION ALL SELECT trim(unnest(string_split(title, ','))), rid FROM t UNION ALL SELECT w, rid FROM (SELECT unnest(regexp_split_to_array(regexp_replace(title, '[(),]', ' ', 'g'), '\\s+')) AS w, rid FROM t) "
       f"WHERE lower(w) NOT IN ({', '.join(repr(w) for w in names.STOPWORDS)}) AND (length(w) >= 3 OR regexp_matches(w, '{names.DESIGNATION}'))) "
       "SELECT DISTINCT lower(trim(alias)) AS alias, rid FROM a WHERE length(trim(alias)) >= 2")
def alias_table_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All aliases of the catalogue's names, designations included."""
    return names.alias_table(records_of(spark, sf), "rid", "title")


@query("SELECT stem, count(DISTINCT rid) AS members FROM (SELECT lower(regexp_extract(c, '([A-Za-z]+)[- ]?\\d', 1)) AS stem, model_id AS rid FROM (SELECT primary_equip_code AS c, model_id FROM models)) WHERE stem <> '' GROUP BY stem")
def designator_families(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "models").select(F.col("primary_equip_code").alias("alias"), F.col("model_id").alias("rid"))
    return names.families(codes)


@query("WITH t AS (SELECT CAST(model_id AS VARCHAR) AS rid, trim(regexp_replace(lower(min_by(nomenclature, release_id)), '[^a-z0-9]+', ' ', 'g')) AS alias FROM models GROUP BY model_id), "
       "d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body FROM documents WHERE text IS NOT NULL), "
       "g AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '[a-z]+ [a-z]+ (?:mk|block|lot|model) \\d+'))) AS alias FROM d), h AS (SELECT DISTINCT g.doc_id, t.rid, t.alias FROM g JOIN t ON ends_with(' ' || g.alias, ' ' || t.alias)) "
       "SELECT doc_id, count(DISTINCT rid) AS records FROM h GROUP BY doc_id")
def entity_match(spark: SparkSession, sf: str) -> DataFrame:
    titles = records_of(spark, sf).select(F.lower("title").alias("alias"), "rid")
    found = names.mentions(table(spark, sf, "documents"), "doc_id", "text", titles)
    return names.matched_records(found, "doc_id").groupBy("doc_id").agg(F.count_distinct("rid").alias("records"))


@query("WITH f AS (SELECT canon_field AS target, list_distinct(regexp_extract_all(lower(canon_field), '[a-z0-9]+')) AS words FROM field_ref), "
       "a AS (SELECT DISTINCT attribute AS item, list_distinct(regexp_extract_all(lower(attribute), '[a-z0-9]+')) AS w FROM claims WHERE attribute IS NOT NULL), "
       "s AS (SELECT item, target, round(2.0 * len(list_intersect(w, words)) / (len(w) + len(words)), 4) AS score FROM a, f WHERE len(list_intersect(w, words)) > 0), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, target) AS rn, lead(score) OVER (PARTITION BY item ORDER BY score DESC, target) AS nxt FROM s) "
       "SELECT item, target, score, coalesce(nxt, 0.0) AS runner_up, CASE WHEN score >= 0.62 AND score - coalesce(nxt, 0.0) >= 0.12 THEN 'resolved' WHEN score >= 0.35 THEN 'ambiguous' ELSE 'unmapped' END AS status FROM r WHERE rn = 1")
def field_resolve_margin(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "claims").where("attribute is not null").select(F.col("attribute").alias("item")).distinct()
    targets = table(spark, sf, "field_ref").select(F.col("canon_field").alias("target"), F.array_distinct(F.regexp_extract_all(F.lower("canon_field"), F.lit(r"[a-z0-9]+"), F.lit(0))).alias("words"))
    return names.resolve_by_overlap(items.withColumn("attribute_text", F.col("item")), "item", "attribute_text", targets)


@query("WITH f AS (SELECT canon_field AS target, list_distinct(regexp_extract_all(lower(canon_field), '[a-z0-9_]+')) AS words FROM field_ref), "
       "a AS (SELECT DISTINCT attribute AS item, list_distinct(regexp_extract_all(lower(attribute), '[a-z0-9_]+')) AS w FROM claims WHERE attribute IS NOT NULL) "
       "SELECT item, min(target) AS target FROM a, f WHERE len(words) > 0 AND list_has_all(w, words) GROUP BY item HAVING count(*) = 1")
def token_subset_match(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "claims").where("attribute is not null").select(F.col("attribute").alias("item")).distinct()
    targets = table(spark, sf, "field_ref").select(F.col("canon_field").alias("target"), F.array_distinct(V.tokens(F.col("canon_field"))).alias("words"))
    return names.subset_match(items.withColumn("attribute_text", F.col("item")), "item", "attribute_text", targets)


@query("WITH q AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body FROM documents WHERE title IS NOT NULL), "
       "v AS (SELECT DISTINCT system_type AS field, ' ' || trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pattern, len(string_split(p, ' ')) AS words FROM (SELECT system_type, regexp_replace(nomenclature, '\\s+(Mk|Block|Lot|Model|MK|BLOCK|LOT|MODEL).*$', '') AS p FROM models)), "
       "h AS (SELECT doc_id, field, max(words) AS words FROM q JOIN v ON contains(body, pattern) GROUP BY ALL) SELECT doc_id, field, 4 AS score FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY words DESC) AS r FROM h) WHERE r = 1")
def query_field_intents(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.regexp_replace("nomenclature", r"\s+(Mk|Block|Lot|Model|MK|BLOCK|LOT|MODEL).*$", "")
    vocabulary = table(spark, sf, "models").select(F.lower(F.regexp_replace(phrase, r"\s+", " ")).alias("phrase"), F.col("system_type").alias("field"), F.lit(4).alias("weight")).distinct()
    return names.field_intents(table(spark, sf, "documents"), "doc_id", "title", vocabulary)


# --- enrichment -----------------------------------------------------------------------------------

@query("SELECT substr(sha256('text|' || text), 1, 16) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.distinct_documents(table(spark, sf, "documents"))


@query("WITH d AS (SELECT doc_id, content_hash, coalesce(ingested_at < TIMESTAMP '2024-01-01', false) AS early FROM documents) SELECT doc_id, content_hash FROM d WHERE NOT early AND NOT EXISTS (SELECT 1 FROM d e WHERE e.early AND e.content_hash = d.content_hash)")
def anti_seen_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents ingested from 2024 on, or undated, whose hash no earlier document has: each document is seen or incoming."""
    docs = table(spark, sf, "documents").select("doc_id", "content_hash", F.coalesce(F.col("ingested_at") < "2024-01-01", F.lit(False)).alias("early"))
    return enrich.unseen(docs.where("not early"), docs.where("early")).select("doc_id", "content_hash")


@query("SELECT coalesce(s.k, i.k) AS k, coalesce(s.first_run, i.first_run) AS first_run, coalesce(i.n, s.n) AS n FROM (SELECT doc_id AS k, min(run_id) AS first_run, count(*) AS n FROM claims WHERE run_id <= 2 GROUP BY doc_id) s "
       "FULL OUTER JOIN (SELECT doc_id AS k, min(run_id) AS first_run, count(*) AS n FROM claims WHERE run_id > 2 GROUP BY doc_id) i ON s.k = i.k")
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims")
    per = lambda cond: c.where(cond).groupBy(F.col("doc_id").alias("k")).agg(F.min("run_id").alias("first_run"), F.count("*").alias("n"))
    return enrich.upsert(per("run_id <= 2"), per("run_id > 2"), "k")


_CLUSTERS = "c AS (SELECT DISTINCT ON (claim_id) claim_id, doc_id, model_id, canon_field, value_norm, value_raw, status, park_reason, run_id FROM claims WHERE model_id IS NOT NULL AND canon_field IS NOT NULL AND value_norm IS NOT NULL)"


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").where("model_id is not null and canon_field is not null and value_norm is not null").dropDuplicates(["claim_id"])
    return enrich.with_fingerprints(c)


@query(f"WITH {_CLUSTERS} SELECT a.claim_id, count(DISTINCT b.doc_id) AS supporters FROM c a JOIN c b ON a.model_id = b.model_id AND a.canon_field = b.canon_field AND abs(b.value_norm - a.value_norm) <= greatest(1e-6, 0.02 * abs(a.value_norm)) GROUP BY a.claim_id HAVING count(DISTINCT b.doc_id) >= 2")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.corroborated(_clustered(spark, sf))


@query(f"WITH {_CLUSTERS} SELECT doc_id, model_id || '|' || canon_field AS cluster, count(*) AS n, min(value_norm) AS lo, max(value_norm) AS hi FROM c GROUP BY doc_id, model_id, canon_field HAVING max(value_norm) - min(value_norm) > greatest(1e-6, 0.02 * least(abs(min(value_norm)), abs(max(value_norm))))")
def intradoc_conflict(spark: SparkSession, sf: str) -> DataFrame:
    c = _clustered(spark, sf).withColumn("cluster", F.concat_ws("|", "model_id", "canon_field"))
    return enrich.conflicts_within(c, "doc_id", "cluster", "value_norm")


@query(f"WITH {_CLUSTERS}, o AS (SELECT * FROM c WHERE status = 'surfaced' OR (status = 'parked' AND coalesce(park_reason, '') <> 'unmapped')), k AS (SELECT a.claim_id FROM o a JOIN o b ON a.model_id = b.model_id AND a.canon_field = b.canon_field "
       "AND abs(b.value_norm - a.value_norm) <= greatest(1e-6, 0.02 * abs(a.value_norm)) GROUP BY a.claim_id HAVING count(DISTINCT b.doc_id) >= 2) "
       "SELECT CASE WHEN status = 'parked' AND park_reason = 'uncorroborated' AND claim_id IN (SELECT claim_id FROM k) THEN 'surfaced' ELSE status END AS status, count(*) AS n FROM c GROUP BY 1")
def graduation(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.graduate(_clustered(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_CLUSTERS}, f AS (SELECT *, substr(sha1(model_id || '|gap_fill|' || canon_field || '|' || coalesce(value_raw, 'None')), 1, 16) AS full_fp, substr(sha1(model_id || '|' || canon_field), 1, 16) AS partial_fp FROM c WHERE status = 'surfaced'), "
       "k AS (SELECT partial_fp, count(DISTINCT doc_id) AS cluster_sources, count(DISTINCT value_raw) AS cluster_values FROM f GROUP BY partial_fp) "
       "SELECT full_fp, partial_fp, min(model_id) AS model_id, min(canon_field) AS canon_field, min(value_raw) AS value, count(DISTINCT doc_id) AS n_sources, min(run_id) AS first_run, max(run_id) AS last_run, any_value(cluster_sources) AS cluster_sources, any_value(cluster_values) AS cluster_values FROM f JOIN k USING (partial_fp) GROUP BY full_fp, partial_fp")
def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.proposals(_clustered(spark, sf))


@query(f"WITH {_CLUSTERS}, n AS (SELECT substr(sha1(model_id || '|' || canon_field), 1, 16) AS partial_fp, value_raw, count(*) AS k FROM c WHERE status = 'surfaced' GROUP BY ALL) SELECT partial_fp, string_agg(value_raw || ':' || k, '; ' ORDER BY k DESC, value_raw) AS distribution FROM n GROUP BY partial_fp")
def proposal_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.value_distribution(_clustered(spark, sf))


@query("SELECT trim(regexp_replace(lower(attribute), '[^a-z0-9]+', ' ', 'g')) AS term, canon_field AS field, count(*) AS n, round(avg(mapping_score) + 1e-8, 4) AS avg_score, count(DISTINCT doc_id) AS docs FROM claims WHERE mapping_method = 'definition_profile' AND canon_field IS NOT NULL AND attribute IS NOT NULL GROUP BY 1, 2")
def alias_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.alias_suggestions(table(spark, sf, "claims"))


@query(f"WITH {_PARAMS}, st AS (SELECT rid, name AS field, TRY_CAST(value AS DOUBLE) AS v FROM params WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL), {_CLUSTERS}, "
       "j AS (SELECT c.claim_id, max(c.value_norm) AS value, count(st.v) AS n, max(CASE WHEN c.value_norm BETWEEN st.v - greatest(1e-6, 0.02 * abs(st.v)) AND st.v + greatest(1e-6, 0.02 * abs(st.v)) THEN 1 ELSE 0 END) AS hit FROM c LEFT JOIN st ON st.rid = c.model_id AND st.field = c.canon_field GROUP BY c.claim_id) "
       "SELECT claim_id, CASE WHEN n = 0 THEN 'gap' WHEN hit = 1 THEN 'match' ELSE 'conflict' END AS outcome FROM j")
def compare_numeric(spark: SparkSession, sf: str) -> DataFrame:
    stored = fields.from_params(fields.param_lines(table(spark, sf, "records"))).where("num is not null").select("rid", "field", "lo", "hi")
    c = _clustered(spark, sf).select("claim_id", F.col("model_id").alias("rid"), F.col("canon_field").alias("field"), F.col("value_norm").alias("value"))
    return enrich.compare_numeric(c, stored)


@query(f"WITH {_CLUSTERS} SELECT claim_id FROM c WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.status = 'rejected' AND r.model_id = c.model_id AND r.canon_field = c.canon_field AND coalesce(r.value_raw, 'None') = coalesce(c.value_raw, 'None'))")
def suppress_rejected(spark: SparkSession, sf: str) -> DataFrame:
    c = _clustered(spark, sf)
    return enrich.without_rejected(c, c.where("status = 'rejected'")).select("claim_id")


@query("SELECT status, coalesce(park_reason, '-') AS reason, count(*) AS n FROM claims GROUP BY ALL")
def claim_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").groupBy("status", F.coalesce("park_reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def claim_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The decisions over all claims: grounded, compared, decided; (claim_id, decision, reason). Steps not built are in the README."""
    ref = table(spark, sf, "field_ref")
    kinds = ref.select("canon_field", (F.col("data_type") == "Number").alias("field_numeric"), F.col("canonical_unit").alias("field_unit"))
    c = table(spark, sf, "claims").dropDuplicates(["claim_id"]).join(broadcast_if_small(kinds), "canon_field", "left")
    read = quantities.stated(c, ref)
    stored = fields.from_params(fields.param_lines(table(spark, sf, "records"))).where("num is not null").select("rid", "field", "lo", "hi")
    ready = enrich.ground(c.join(read, "claim_id", "left").withColumn("rid", F.col("model_id")).withColumn("field", F.col("canon_field")))
    outcome = enrich.compare_numeric(ready.select("claim_id", "rid", "field", "value"), stored)
    decided = enrich.classify(ready.join(outcome, "claim_id").withColumn("value_num", F.coalesce("value", V.numeric_prefix(F.col("value_raw")))).withColumn(
        "unit_norm", F.when(F.col("value").isNotNull(), F.col("field_unit"))).withColumn("field_numeric", F.coalesce("field_numeric", F.lit(False))))
    return decided.select("claim_id", "decision", "reason")


@query("WITH t AS (SELECT DISTINCT CAST(model_id AS VARCHAR) AS rid, trim(regexp_replace(lower(trim(regexp_replace(min_by(nomenclature, release_id), '\\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS alias FROM models GROUP BY model_id), "
       "c AS (SELECT DISTINCT claim_id, ' ' || trim(regexp_replace(lower(coalesce(entity_mention, '') || ' ' || coalesce(quote, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body FROM claims), "
       "h AS (SELECT claim_id, rid, alias FROM c JOIN t ON contains(body, ' ' || alias || ' ')), r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY length(alias) DESC, alias, rid) AS rn FROM h) SELECT claim_id, rid FROM r WHERE rn = 1")
def claim_links(spark: SparkSession, sf: str) -> DataFrame:
    """The record that each claim names by its longest alias; every claim is its own document here."""
    claims = table(spark, sf, "claims").select("claim_id", F.col("claim_id").alias("doc_id"), "entity_mention", "quote").distinct()
    said = claims.select("doc_id", F.concat_ws(" ", "entity_mention", "quote").alias("text"))
    titles = records_of(spark, sf).select(F.lower("title").alias("alias"), "rid")
    return linking.link_claims(claims, linking.document_mentions(said, titles)).select("claim_id", "rid")


@query("WITH w AS (SELECT canon_field AS field, list_distinct(regexp_extract_all(lower(canon_field), '[a-z0-9]+')) AS nw, list_distinct(regexp_extract_all(lower(concat_ws(' ', canon_field, definition, component)), '[a-z0-9]+')) AS pw, "
       "u.dimension AS fdim, canonical_unit, lower(data_type) = 'number' AS num, ' ' || trim(regexp_replace(lower(component), '[^a-z0-9]+', ' ', 'g')) || ' ' AS comp FROM field_ref f LEFT JOIN unit_ref u ON lower(trim(u.unit)) = lower(trim(f.canonical_unit))), "
       "i AS (SELECT DISTINCT attribute, unit_raw, value_raw FROM claims WHERE attribute IS NOT NULL), "
       "o AS (SELECT attribute, unit_raw, value_raw, list_distinct(regexp_extract_all(lower(attribute), '[a-z0-9]+')) AS q, u.dimension AS dim, regexp_matches(coalesce(value_raw, ''), '^\\s*[-+]?\\d') AS isnum, "
       "' ' || trim(regexp_replace(lower(attribute), '[^a-z0-9]+', ' ', 'g')) || ' ' AS ctx FROM i LEFT JOIN (SELECT DISTINCT ON (lower(trim(unit))) lower(trim(unit)) AS lu, dimension FROM unit_ref ORDER BY lower(trim(unit)), dimension) u ON u.lu = lower(trim(unit_raw))), "
       "s AS (SELECT attribute, unit_raw, value_raw, field, round(least(1.0::DOUBLE, greatest(len(list_intersect(q, nw))::DOUBLE / len(q) * 0.72, len(list_intersect(q, pw))::DOUBLE / len(q) * 0.62) + CASE WHEN dim IS NULL OR fdim IS NULL THEN 0 WHEN dim = fdim THEN 0.10 ELSE -0.30 END "
       "+ CASE WHEN isnum AND (num OR canonical_unit IS NOT NULL) THEN 0.04 ELSE 0 END + CASE WHEN comp IS NOT NULL AND contains(ctx, comp) THEN 0.05 ELSE 0 END), 4) AS score FROM o, w WHERE len(q) > 0 AND len(list_intersect(q, pw)) > 0), "
       "r AS (SELECT *, row_number() OVER win AS rn, lead(score) OVER win AS nxt FROM s WHERE score > 0 WINDOW win AS (PARTITION BY attribute, unit_raw, value_raw ORDER BY score DESC, lower(field), field)) "
       "SELECT attribute, unit_raw, value_raw, field AS candidate, score, CASE WHEN score >= 0.62 AND round(score - coalesce(nxt, 0), 4) >= 0.12 THEN 'resolved' WHEN score >= 0.35 THEN 'ambiguous' ELSE 'unmapped' END AS status FROM r WHERE rn = 1")
def field_profile_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The field whose profile (name, definition, component, unit, type) fits each attribute, unit and value best."""
    ref = table(spark, sf, "field_ref")
    params = ref.select(F.lit("0").alias("rid"), F.col("canon_field").alias("field"), "definition", F.col("data_type").alias("dtype"), F.col("canonical_unit").alias("unit"), "component")
    items = table(spark, sf, "claims").where("attribute is not null").select("attribute", F.col("unit_raw").alias("unit"), F.col("value_raw").alias("value")).distinct()
    keyed = items.withColumn("item", F.struct("attribute", "unit", "value")).withColumn("context", F.col("attribute"))
    found = linking.resolve_profiles(keyed, linking.field_profiles(params), table(spark, sf, "unit_ref"))
    return found.select("item.attribute", F.col("item.unit").alias("unit_raw"), F.col("item.value").alias("value_raw"), "candidate", "score", "status")


@query()
def claim_states(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of every claim after the decisions: repeats, contradictions within a document, corroboration."""
    claims = table(spark, sf, "claims").dropDuplicates(["claim_id"]).select("claim_id", "doc_id", "model_id", "canon_field", "value_raw", "value_norm")
    return linking.process_claims(claims.join(claim_decisions(spark, sf), "claim_id"))


# --- reports --------------------------------------------------------------------------------------

@query("SELECT coalesce(lang, '(all)') AS class, count(*) AS cases, round(avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(quantile_cont(n_chars, 0.5), 2) AS median, round(quantile_cont(n_chars, 0.95), 2) AS p95 FROM documents WHERE lang IS NOT NULL GROUP BY GROUPING SETS ((lang), ())")
def eval_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    from orrery.plans import evaluation

    cases = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("class"), (F.col("n_chars") > 500).alias("hit"), F.col("n_chars").alias("tokens"))
    return evaluation.hit_rates(cases)


@query(f"WITH {_CLUSTERS}, e AS (SELECT * FROM c WHERE coalesce(run_id, 0) <= 2), f AS (SELECT * FROM c WHERE coalesce(run_id, 0) > 2), "
       "p AS (SELECT e.claim_id AS ei, f.claim_id AS fi FROM e JOIN f ON e.status = f.status AND e.model_id = f.model_id AND e.canon_field = f.canon_field AND abs(f.value_norm - e.value_norm) <= 0.03 * abs(e.value_norm)), "
       "a AS (SELECT status AS type, sum(CASE WHEN claim_id IN (SELECT ei FROM p) THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN claim_id IN (SELECT ei FROM p) THEN 0 ELSE 1 END) AS fn FROM e GROUP BY 1), "
       "b AS (SELECT status AS type, sum(CASE WHEN claim_id IN (SELECT fi FROM p) THEN 0 ELSE 1 END) AS fp FROM f GROUP BY 1) "
       "SELECT type, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn, CASE WHEN coalesce(tp,0)+coalesce(fp,0) > 0 THEN round(coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0)), 4) END AS precision, "
       "CASE WHEN coalesce(tp,0)+coalesce(fn,0) > 0 THEN round(coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fn, 0)), 4) END AS recall FROM a FULL OUTER JOIN b USING (type)")
def precision_recall_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of later runs against those of the first two, as in ``upsert_documents``: each valid claim is on one side."""
    c = _clustered(spark, sf).select(F.col("status").alias("type"), F.col("model_id").alias("rid"), F.col("canon_field").alias("field"), F.col("value_norm").alias("value"), F.col("claim_id").alias("id"),
                                     (F.coalesce("run_id", F.lit(0)) <= 2).alias("early"))
    return enrich.evaluate_proposals(c.where("early").drop("early"), c.where("not early").drop("early"))


@query("WITH rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY release_id) AS rn FROM models) WHERE rn = 1), p AS (SELECT r.system_group, r.system_type, c.canon_field AS parameter, min_by(c.unit_norm, c.claim_id) FILTER (WHERE c.unit_norm IS NOT NULL) AS uom, count(*) AS n FROM "
       "(SELECT DISTINCT ON (claim_id) * FROM claims WHERE canon_field IS NOT NULL AND model_id IS NOT NULL) c JOIN rec r ON CAST(r.model_id AS VARCHAR) = c.model_id GROUP BY ALL) SELECT system_group, system_type, string_agg(parameter || ':' || n, '; ' ORDER BY n DESC, parameter) AS manifest FROM p GROUP BY ALL")
def type_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from orrery.sources import pages

    c = table(spark, sf, "claims").where("canon_field is not null and model_id is not null").dropDuplicates(["claim_id"])
    rows = c.join(records_of(spark, sf).select(F.col("rid").alias("model_id"), "system_group", "system_type"), "model_id").select(
        "system_group", "system_type", F.col("canon_field").alias("parameter"), F.col("unit_norm").alias("uom"), F.col("claim_id").alias("seq"))
    made = pages.type_manifests(rows)
    return made.select("system_group", "system_type", F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["parameter"], p["count"].cast("string"))), "; ").alias("manifest"))


@query("WITH p AS (SELECT descr_id, model_id, seq, CASE WHEN seq % 2 = 1 THEN descr_type END AS heading FROM (SELECT DISTINCT descr_id, model_id, seq, descr_type FROM rbe2)) "
       "SELECT descr_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY model_id ORDER BY seq, descr_id ROWS UNBOUNDED PRECEDING) AS section FROM p")
def carry_forward_section(spark: SparkSession, sf: str) -> DataFrame:
    from orrery.sources import pages

    rows = table(spark, sf, "rbe2").select("descr_id", "model_id", "seq", "descr_type").distinct().withColumn("heading", F.when(F.col("seq") % 2 == 1, F.col("descr_type")))
    return pages.carry_forward(rows, "model_id", ["seq", "descr_id"], "heading", "section").select("descr_id", "section")


@query()
def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of all records made from their descriptions; the packing's invariants are unit-tested."""
    from orrery.operators import chunks

    d = table(spark, sf, "rbe2").where("description is not null and description <> ''").select("model_id", "seq", "descr_id", "description").distinct()
    texts = d.groupBy(F.col("model_id").cast("string").alias("rid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "descr_id", "description"))), lambda s: s["description"]), "\n").alias("text"))
    return chunks.chunk(texts.join(records_of(spark, sf).select("rid", "title"), "rid", "left"), "rid", "title", "text")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over the event table (beyond the reference)."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(f"WITH {_CLUSTERS} SELECT model_id, canon_field, count(DISTINCT doc_id) AS docs, count(*) AS claims FROM c GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def stream_corroboration(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters with two sources, counted by a stream over the claims with state per cluster."""
    from orrery.streaming import corroborate

    return corroborate.clusters_once(spark, f"{sf}/claims.parquet", Scratch(spark, "stream").root)
