"""Reverse enrichment: claims grounded in quotes, compared with stored values and corroborated across documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans.runtime import broadcast_if_small

# Relative tolerances of agreement and the number of sources that corroborates.
TOLERANCE, DUAL_TOLERANCE, SOURCES = 0.02, 0.05, 2
# Wording of statements that assert nothing.
NONASSERTED = (r"(?i)\b(?:not|never|no longer|denied|denies|rumou?red|alleged(?:ly)?|reportedly|could|would|might|may|planned|proposed|"
               r"hypothetical|unconfirmed|expected to|is said to)\b")
RELATION_VERB = r"(?i)\b(?:fitted with|equipped with|carries|carried by|armed with|mounted on|integrated (?:on|with)|part of|variant of)\b"


def distinct_documents(documents: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first document of each content hash, with the number of copies. A hot text is combined before the shuffle."""
    hashed = documents.where(F.col(text).isNotNull()).select(order, V.content_hash(F.col(text)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def unseen(documents: DataFrame, seen: DataFrame, key: str = "content_hash") -> DataFrame:
    return documents.join(seen.select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep_first: tuple[str, ...] = ("first_run",)) -> DataFrame:
    """Incoming rows replace stored ones of the same key; ``keep_first`` columns keep the stored value."""
    s, i = stored.alias("s"), incoming.alias("i")
    joined = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    cols = [F.coalesce(*([f"s.{c}", f"i.{c}"] if c in keep_first else [f"i.{c}", f"s.{c}"])).alias(c) for c in stored.columns]
    return joined.select(*cols)


def contains_value(text: Column, value: Column) -> Column:
    """The value stands in the text with no digit or letter next to it (both in ground form)."""
    found = F.concat(F.lit(" "), F.regexp_replace(V.ground_form(text), r"[^a-z0-9.+-]+", " "), F.lit(" "))
    asked = F.concat(F.lit(" "), F.trim(F.regexp_replace(V.ground_form(value), r"[^a-z0-9.+-]+", " ")), F.lit(" "))
    return found.contains(asked) | found.contains(F.concat(F.rtrim(asked), F.lit(". ")))


def ground(claims: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Adds ``grounded``: 'quote' if the value stands in the quote, 'text' if it stands in a document, else 'none'."""
    in_quote = F.coalesce(contains_value(F.col("quote"), F.col("value_raw")), F.lit(False))
    if documents is None:
        return claims.withColumn("grounded", F.when(in_quote, "quote").otherwise("none"))
    joined = claims.join(documents.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    in_text = F.coalesce(contains_value(F.col("__text"), F.col("value_raw")), F.lit(False))
    return joined.withColumn("grounded", F.when(in_quote, "quote").when(in_text, "text").otherwise("none")).drop("__text")


def with_fingerprints(claims: DataFrame) -> DataFrame:
    """Adds partial_fp (record and field) and full_fp (and value; for conflicts the stored value too)."""
    db = F.col("db_value") if "db_value" in claims.columns else F.lit(None).cast("string")
    kind = F.col("type") if "type" in claims.columns else F.lit("gap_fill")
    plain = V.fingerprint(F.col("model_id"), kind, F.col("canon_field"), F.col("value_raw"))
    both = V.fingerprint(F.col("model_id"), kind, F.col("canon_field"), F.col("value_raw"), db)
    return claims.withColumn("partial_fp", V.fingerprint(F.col("model_id"), F.col("canon_field"))).withColumn("full_fp", F.when(kind == "conflict", both).otherwise(plain))


def agreement(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """b agrees with the target a within a share of a; null values decide nothing."""
    return F.abs(b - a) <= F.greatest(F.lit(1e-6), tolerance * F.abs(a))


def corroborated(claims: DataFrame, cluster: str = "partial_fp", value: str = "value_norm", doc: str = "doc_id", key: str = "claim_id",
                 sources: int = SOURCES, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, supporters): claims of a cluster whose value at least ``sources`` documents support, the claim's own included.

    Agreement isn't transitive, so each claim counts its own supporters: those whose value lies in an
    interval around its own. Claims and values are first reduced to the distinct values of a cluster
    with their documents; then values meet in windows of the logarithm of their size, three
    neighbouring windows covering every interval, so that a hot cluster isn't paired with itself whole.
    """
    width = F.lit(float(1 + tolerance)).cast("double")
    rows = claims.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).select(key, cluster, F.col(value).cast("double").alias("v"), doc)
    step = F.log(width) * 2
    bin_of = F.when(F.abs("v") < 1e-4, F.lit(-(10**9))).otherwise(F.signum("v") * (F.floor(F.log(F.abs("v")) / step) + 10**6)).cast("long")
    values = rows.select(cluster, "v", doc).distinct().withColumn("bin", bin_of)
    # values below 1e-4 share one bin; near that border a target also looks at the bins on the other side
    edge = F.floor(F.log(F.lit(1e-4)) / step) + 10**6
    around = F.when(F.abs("v") < 1e-4, F.array(bin_of, edge, edge + 1, -edge, -edge - 1)).when(
        F.abs("v") < 1.1e-4, F.array(bin_of - 1, bin_of, bin_of + 1, F.lit(-(10**9)))).otherwise(F.array(bin_of - 1, bin_of, bin_of + 1))
    targets = rows.select(cluster, "v").distinct().withColumn("bin", F.explode(F.array_distinct(around.cast("array<bigint>"))))
    pair = targets.alias("a").join(values.alias("b"), (F.col(f"a.{cluster}") == F.col(f"b.{cluster}")) & (F.col("a.bin") == F.col("b.bin")))
    support = pair.where(agreement(F.col("a.v"), F.col("b.v"), tolerance)).groupBy(F.col(f"a.{cluster}").alias(cluster), F.col("a.v").alias("v")).agg(
        F.count_distinct(F.col(f"b.{doc}")).alias("supporters"))
    return rows.join(support.where(F.col("supporters") >= sources), [cluster, "v"]).select(key, "supporters").distinct()


def conflicts_within(claims: DataFrame, doc: str, cluster: str, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, cluster): groups of one document that state values too far apart.

    Two values conflict exactly if the smallest and the largest do, so no pairs are built.
    """
    g = claims.where(F.col(value).isNotNull()).groupBy(doc, cluster).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    near = F.least(F.abs("lo"), F.abs("hi"))
    return g.where((F.col("hi") - F.col("lo")) > F.greatest(F.lit(1e-6), tolerance * near)).select(doc, cluster, "n", "lo", "hi")


def compare_numeric(claims: DataFrame, stored: DataFrame, key: str = "claim_id", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, outcome): match, conflict, gap (no stored value) or incomparable (no number) against all stored variants.

    ``claims`` has (key, rid, field, value), ``stored`` (rid, field, lo, hi) in the same unit.
    """
    # stored values of a record and field are few (variants), so the aggregate below stays small
    joined = claims.join(stored, ["rid", "field"], "left")
    hit = F.col("value").between(F.col("lo") - F.greatest(F.lit(1e-6), tolerance * F.abs("lo")), F.col("hi") + F.greatest(F.lit(1e-6), tolerance * F.abs("hi")))
    g = joined.groupBy(key).agg(F.max(F.col("value")).alias("value"), F.count("lo").alias("n"), F.max(hit.cast("int")).alias("hit"))
    return g.select(key, F.when(F.col("value").isNull(), "incomparable").when(F.col("n") == 0, "gap").when(F.col("hit") == 1, "match").otherwise("conflict").alias("outcome"))


def compare_text(claims: DataFrame, stored: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, outcome): match, difference or gap of normalised texts; ``stored`` has (rid, field, str)."""
    joined = claims.select(key, "rid", "field", V.normal_label(F.col("value")).alias("v")).join(stored.select("rid", "field", V.normal_label(F.col("str")).alias("s")), ["rid", "field"], "left")
    g = joined.groupBy(key).agg(F.count("s").alias("n"), F.max((F.col("v") == F.col("s")).cast("int")).alias("hit"))
    return g.select(key, F.when(F.col("n") == 0, "gap").when(F.col("hit") == 1, "match").otherwise("difference").alias("outcome"))


def first_in_run(claims: DataFrame, doc: str = "doc_id", fp: str = "full_fp", order: str = "claim_id") -> DataFrame:
    """Claims without those that repeat an earlier one of the same document. Only fingerprints are shuffled twice."""
    firsts = claims.groupBy(doc, fp).agg(F.min(order).alias(order))
    return claims.join(firsts.select(order), order, "left_semi")


def without_rejected(claims: DataFrame, rejected: DataFrame, fp: str = "full_fp") -> DataFrame:
    return claims.join(rejected.select(fp).distinct(), fp, "left_anti")


def reject(claims: DataFrame, fps: list[str]) -> DataFrame:
    """Surfaced and parked claims of the given fingerprints become rejected."""
    hit = F.col("full_fp").isin(fps) & F.col("status").isin("surfaced", "parked")
    return claims.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))


def graduate(claims: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Parked uncorroborated claims that two documents support become surfaced."""
    open_rows = claims.where("status = 'surfaced' or (status = 'parked' and coalesce(park_reason, '') <> 'unmapped')")
    ok = corroborated(open_rows, sources=sources).select("claim_id", F.lit(True).alias("ok"))
    joined = claims.join(ok, "claim_id", "left")
    up = F.coalesce("ok", F.lit(False)) & (F.col("status") == "parked") & (F.col("park_reason") == "uncorroborated")
    return joined.withColumn("status", F.when(up, "surfaced").otherwise(F.col("status"))).withColumn("park_reason", F.when(~up, F.col("park_reason"))).drop("ok")


def proposals(claims: DataFrame) -> DataFrame:
    """One row per full fingerprint of surfaced claims: record, field, value, sources, first run, sources of the whole cluster."""
    surfaced = claims.where("status = 'surfaced'")
    own = surfaced.groupBy("full_fp", "partial_fp").agg(
        F.min("model_id").alias("model_id"), F.min("canon_field").alias("canon_field"), F.min("value_raw").alias("value"),
        F.count_distinct("doc_id").alias("n_sources"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
    cluster = surfaced.groupBy("partial_fp").agg(F.count_distinct("doc_id").alias("cluster_sources"), F.count_distinct("value_raw").alias("cluster_values"))
    return own.join(cluster, "partial_fp")


def value_distribution(claims: DataFrame) -> DataFrame:
    """(partial_fp, distribution): 'value:count' of the surfaced values of a cluster, most frequent first."""
    counts = claims.where("status = 'surfaced'").groupBy("partial_fp", "value_raw").count()
    cell = F.concat_ws(":", "value_raw", F.col("count").cast("string"))
    return counts.groupBy("partial_fp").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "value_raw", cell.alias("cell")))), lambda s: s["cell"]), "; ").alias("distribution"))


def alias_suggestions(claims: DataFrame, method: str = "definition_profile") -> DataFrame:
    """(term, field, n, avg_score, docs): attributes that the profile mapper resolved, as suggestions for the alias list."""
    return claims.where(F.col("mapping_method") == method).where("canon_field is not null and attribute is not null").groupBy(
        V.normal_name(F.col("attribute")).alias("term"), F.col("canon_field").alias("field")).agg(
        F.count("*").alias("n"), V.round4(F.avg("mapping_score")).alias("avg_score"), F.count_distinct("doc_id").alias("docs"))


def classify(claims: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``reason`` by the ordered cascade of tests; the first that applies decides.

    Needs columns: attribute, canon_field, mapping_status, model_id, grounded, quote, value_num (double or
    null), unit_norm, field_numeric (bool), field_unit, unit_ok (bool or null), outcome (of the comparison);
    dual_ok (bool or null) is optional.
    """
    dual = F.col("dual_ok") if "dual_ok" in claims.columns else F.lit(None).cast("boolean")
    tests: list[tuple[Column, str, str]] = [
        (F.trim(F.coalesce("attribute", F.lit(""))) == "", "dropped", "malformed_claim"),
        (F.col("model_id").isNull(), "parked", "unlinked"),
        (F.col("grounded") == "none", "dropped", "ungrounded"),
        (F.coalesce(F.col("quote").rlike(NONASSERTED), F.lit(False)), "parked", "nonasserted"),
        (F.col("mapping_status") == "ambiguous", "parked", "ambiguous_field"),
        (F.col("canon_field").isNull(), "parked", "unmapped"),
        (~F.col("field_numeric"), "parked", "text_field"),
        (~F.coalesce(dual, F.lit(True)), "parked", "inconsistent_dual"),
        (~F.coalesce("unit_ok", F.lit(True)), "parked", "incompatible_unit"),
        (F.col("value_num").isNull(), "parked", "incomplete"),
        (F.col("field_unit").isNotNull() & F.col("unit_norm").isNull(), "parked", "incomplete"),
        (F.col("outcome") == "incomparable", "parked", "incomplete"),
        (F.col("outcome") == "match", "dropped", "already_present"),
        (F.col("outcome") == "gap", "surfaced", "gap_fill"),
    ]
    decision = reduce(lambda acc, t: acc.when(t[0], F.struct(F.lit(t[1]).alias("d"), F.lit(t[2]).alias("r"))), tests[1:],
                      F.when(tests[0][0], F.struct(F.lit(tests[0][1]).alias("d"), F.lit(tests[0][2]).alias("r"))))
    decided = claims.withColumn("__d", decision.otherwise(F.struct(F.lit("surfaced").alias("d"), F.lit("conflict").alias("r"))))
    return decided.withColumn("decision", F.col("__d.d")).withColumn("reason", F.col("__d.r")).drop("__d")


def header_units(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, field_text, unit) of headers such as 'Length (m)'."""
    hits = documents.where(F.col(text).isNotNull()).select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z ]{2,40}\([A-Za-z/°]{1,10}\))"), F.lit(1))).alias("h"))
    return hits.select("doc_id", F.trim(F.regexp_extract("h", r"^([^(]+)\(", 1)).alias("field_text"), F.regexp_extract("h", r"\(([^)]+)\)$", 1).alias("unit")).distinct()


def document_context(documents: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_records, low_trust): per document the records mentioned and whether it calls itself unreliable."""
    cue = r"(?i)\b(?:blog|forum|rumou?r|fan ?fiction|satire|opinion|unverified)\b"
    counts = found.groupBy("doc_id").agg(F.count_distinct("rid").alias("n_records"))
    return documents.select("doc_id", F.coalesce(F.col(text).rlike(cue), F.lit(False)).alias("low_trust")).join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("n_records", F.lit(0)).alias("n_records"), "low_trust")


def best_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def evaluate_proposals(expected: DataFrame, found: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """One row per type: tp, fp, fn, precision, recall. A proposal meets an expectation of the same record, type and field within 3 %.

    Both have (type, rid, field, value double, id).
    """
    e, f = expected.alias("e"), found.alias("f")
    near = F.col("e.value").isNull() | F.col("f.value").isNull() | (F.abs(F.col("f.value") - F.col("e.value")) <= tolerance * F.abs(F.col("e.value")))
    pairs = e.join(f, (F.col("e.type") == F.col("f.type")) & (F.col("e.rid") == F.col("f.rid")) & (F.col("e.field") == F.col("f.field"))).where(near)
    hits_e = pairs.select(F.col("e.id").alias("id")).distinct().withColumn("hit", F.lit(1))
    hits_f = pairs.select(F.col("f.id").alias("id")).distinct().withColumn("hit", F.lit(1))
    by_e = expected.join(hits_e, "id", "left").groupBy("type").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("tp"), F.sum(1 - F.coalesce("hit", F.lit(0))).alias("fn"))
    by_f = found.join(hits_f, "id", "left").groupBy("type").agg(F.sum(1 - F.coalesce("hit", F.lit(0))).alias("fp"))
    joined = by_e.join(by_f, "type", "full_outer").select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 4))
    return joined.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))


def update_titles(found: DataFrame, titles: DataFrame) -> DataFrame:
    return found.join(broadcast_if_small(titles), "rid", "left")
