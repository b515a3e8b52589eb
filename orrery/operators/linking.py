"""Linking claims to records and fields: mentions with a second signal, relations between records, field profiles.

Texts and names meet on words, never each with each; what a document says is decided once per document and
record, and claims take part by their ids.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.functions.unitgrammar import parse_number, parse_unit
from orrery.operators import enrich, names
from orrery.plans.runtime import broadcast_if_small

# Weights of the parts of a field's score and the bounds of its acceptance.
NAME_WEIGHT, PROFILE_WEIGHT, PEER, UNIT_MISFIT, UNIT_FIT, NUMERIC, COMPONENT = 0.72, 0.62, 0.08, -0.30, 0.10, 0.04, 0.05
ACCEPT, MARGIN, DOUBTFUL = 0.62, 0.12, 0.35
#: Beginnings of verbs that relate two pieces of equipment.
RELATION_STEMS = ("fired", "fires", "firing", "launch", "carr", "employ", "fitted", "armed", "equip", "integrat")
CLAIM_KEYS = ("entity", "attribute", "value", "unit", "qualifier", "quote")


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))


def _spaced(c: Column) -> Column:
    """Words of a text in lower case between single blanks, for whole-word searches by position."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(" "))


# --- claims as extracted ---------------------------------------------------------------------------

def coerce_claims(claims: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``attribute`` and ``value`` from a map of what an extractor returned.

    Where both are missing and exactly one key is unknown, that key is the attribute and its value the
    value; with several unknown keys, or none, both stay null. A null map gives nulls.
    """
    m = F.col(raw)
    extra = F.map_filter(m, lambda k, v: ~k.isin(*CLAIM_KEYS))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    alone = blank(m["attribute"]) & blank(m["value"]) & (F.size(F.map_keys(extra)) == 1)
    return claims.withColumn("attribute", F.when(alone, F.map_keys(extra)[0]).otherwise(m["attribute"])).withColumn(
        "value", F.when(alone, F.map_values(extra)[0]).otherwise(m["value"]))


# --- mentions and links ----------------------------------------------------------------------------

def document_mentions(documents: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, rid, alias, ambiguous, pos): aliases as whole words, and the place of the first among the document's words.

    An alias of several records is ambiguous. Null texts mention nothing.
    """
    shared = aliases.select("alias", "rid").distinct().groupBy("alias").agg((F.count("*") > 1).alias("ambiguous"))
    found = names.mentions(documents, "doc_id", text, aliases).join(shared, "alias")
    placed = found.join(documents.select("doc_id", _spaced(F.col(text)).alias("__body")), "doc_id")
    return placed.select("doc_id", "rid", "alias", "ambiguous", F.expr("instr(__body, concat(' ', trim(regexp_replace(alias, '[^a-z0-9]+', ' ')), ' '))").alias("pos"))


def country_in(text: Column, countries: Column) -> Column:
    """The first of an array of countries that stands in the text as whole words; null if none does."""
    body = _spaced(text)
    return F.try_element_at(F.filter(countries, lambda c: body.contains(_spaced(c))), F.lit(1))


def second_signal(documents: DataFrame, mentioned: DataFrame, operators: DataFrame, domain_terms: Sequence[str], text: str = "text") -> DataFrame:
    """(doc_id, rid, signal): what besides the name speaks for a record that a document mentions.

    'domain-term' if the document has one of the terms, else 'operator-country:X' if a country of ``operators``
    (rid, country) of this record stands in it, else 'co-entity' if the record and another one are both
    mentioned unambiguously; records without such a signal give no row.
    """
    per = mentioned.groupBy("doc_id", "rid").agg(F.min("ambiguous").alias("amb"))
    strong = per.where("not amb").groupBy("doc_id").agg(F.count("*").alias("strong"))
    countries = operators.where("country is not null").groupBy("rid").agg(F.sort_array(F.collect_set("country")).alias("countries"))
    terms = "|".join(re.escape(t.lower()) for t in domain_terms) or "$^"
    body = documents.select("doc_id", F.col(text).alias("__text"), F.lower(F.col(text)).rlike(terms).alias("domain"))
    joined = per.select("doc_id", "rid", "amb").join(strong, "doc_id", "left").join(body, "doc_id").join(broadcast_if_small(countries), "rid", "left")
    country = country_in(F.col("__text"), F.coalesce("countries", F.array().cast("array<string>")))
    signal = F.when(F.col("domain"), "domain-term").when(country.isNotNull(), F.concat(F.lit("operator-country:"), country)).when(
        ~F.col("amb") & (F.coalesce("strong", F.lit(0)) > 1), "co-entity")
    return joined.select("doc_id", "rid", signal.alias("signal")).where("signal is not null")


def link_claims(claims: DataFrame, mentioned: DataFrame, entity: str = "entity_mention", quote: str = "quote") -> DataFrame:
    """(claim_id, rid, alias): the record of the document whose longest alias stands in entity or quote.

    Ties go to the smaller alias and record. Claims find aliases by words, so a document with very many
    claims isn't paired with all its mentions.
    """
    said = claims.select("claim_id", "doc_id", F.concat_ws(" ", F.coalesce(entity, F.lit("")), F.coalesce(quote, F.lit(""))).alias("__said"))
    known = mentioned.select("alias", "rid").distinct()
    hits = names.mentions(said, "claim_id", "__said", known).join(said.select("claim_id", "doc_id"), "claim_id").join(
        mentioned.select("doc_id", "alias", "rid").distinct(), ["doc_id", "alias", "rid"], "left_semi")
    w = Window.partitionBy("claim_id").orderBy(F.desc(F.length("alias")), "alias", "rid")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("claim_id", "rid", "alias")


def link(claims: DataFrame, documents: DataFrame, aliases: DataFrame, operators: DataFrame, domain_terms: Sequence[str]) -> DataFrame:
    """(claim_id, rid, link): each claim once; ``link`` is the second signal, 'unlinked' or 'no-second-signal' (rid null in both)."""
    mentioned = document_mentions(documents, aliases)
    linked = link_claims(claims, mentioned).join(claims.select("claim_id", "doc_id").distinct(), "claim_id")
    signals = second_signal(documents, mentioned, operators, domain_terms)
    judged = linked.join(signals, ["doc_id", "rid"], "left").select("claim_id", "rid", "signal", F.lit(True).alias("__named"))
    return claims.select("claim_id").distinct().join(judged, "claim_id", "left").select(
        "claim_id", F.when(F.col("signal").isNotNull(), F.col("rid")).alias("rid"),
        F.coalesce("signal", F.when(F.col("__named"), "no-second-signal").otherwise("unlinked")).alias("link"))


def relation_endpoints(claims: DataFrame, mentioned: DataFrame, quote: str = "quote") -> DataFrame:
    """(claim_id, subject, object): of claims whose quote has a relating verb and names two records unambiguously.

    The two of the longest aliases are taken; the one that the document mentions first is the subject, so that both
    wordings of a relation give one edge.
    """
    verb = r"(?<![a-z])(?:" + "|".join(RELATION_STEMS) + ")"
    said = claims.where(F.lower(F.col(quote)).rlike(verb)).select("claim_id", "doc_id", F.col(quote).alias("__said"))
    strong = mentioned.where("not ambiguous")
    hits = names.mentions(said, "claim_id", "__said", strong.select("alias", "rid").distinct()).join(said.select("claim_id", "doc_id"), "claim_id")
    ends = hits.groupBy("claim_id", "doc_id", "rid").agg(F.max(F.length("alias")).alias("size")).join(
        strong.groupBy("doc_id", "rid").agg(F.min("pos").alias("pos")), ["doc_id", "rid"])
    w = Window.partitionBy("claim_id").orderBy(F.desc("size"), "rid")
    two = ends.withColumn("__r", F.row_number().over(w)).where("__r <= 2").groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rid"))).alias("e"))
    return two.where("size(e) = 2").select("claim_id", F.col("e")[0]["rid"].alias("subject"), F.col("e")[1]["rid"].alias("object"))


# --- fields ----------------------------------------------------------------------------------------

def field_profiles(params: DataFrame) -> DataFrame:
    """(field, name_words, profile_words, units, dtypes, components, records) from rows of
    (rid, field, definition, dtype, unit, component); nulls add nothing.

    Sets are of a field's definitions, units and components, which are few however many its records.
    """
    filled = params.where(F.trim("field") != "")
    sets = filled.groupBy("field").agg(*[F.sort_array(F.collect_set(F.trim(c))).alias(c + "s") for c in ("definition", "dtype", "unit", "component")], F.count_distinct("rid").alias("records"))
    profile = F.concat_ws(" ", "field", F.concat_ws(" ", "definitions"), F.concat_ws(" ", "components"))
    return sets.select("field", _words(F.col("field")).alias("name_words"), _words(profile).alias("profile_words"), "units", "dtypes", "components", "records")


def peer_fields(params: DataFrame, records: DataFrame, keys: Sequence[str] = ("system_type", "system_group")) -> DataFrame:
    """(rid, field): fields that another record of the same type or group has; ``records`` has (rid, *keys)."""
    has = params.select("rid", "field").distinct()
    placed = has.join(records.select("rid", *keys), "rid")
    out = None
    for k in keys:
        counts = placed.where(F.col(k).isNotNull()).groupBy(k, "field").agg(F.count("*").alias("n"), F.min("rid").alias("only"))
        one = records.select("rid", k).join(broadcast_if_small(counts), k).where("n > 1 or only <> rid").select("rid", "field")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def resolve_profiles(items: DataFrame, profiles: DataFrame, units: DataFrame, peers: DataFrame | None = None, key: str = "item") -> DataFrame:
    """(key, candidate, score, runner_up, runner_up_score, status): the field whose profile fits an item best.

    ``items`` has (key, attribute, unit, value, context[, rid]), ``units`` (unit, dimension). The score is the greater
    of the shares of the attribute's words in the field's name and in its profile, weighted, with additions
    for a peer of the record that has the field, for units of the same or another dimension, for numbers and for a
    component named in the context. Items and fields meet on shared words; a field without one has no row.
    """
    dims = units.select(F.lower(F.trim("unit")).alias("__u"), "dimension").dropDuplicates(["__u"])
    own = items.select(key, _words(F.coalesce("attribute", F.lit(""))).alias("__w"), F.lower(F.trim("unit")).alias("__u"),
                       F.coalesce(F.col("value").rlike(r"^\s*[-+]?\d"), F.lit(False)).alias("__numeric"), _spaced(F.coalesce("context", F.lit(""))).alias("__context"),
                       (F.col("rid") if "rid" in items.columns else F.lit(None).cast("string")).alias("__rid")).withColumn("__n", F.size("__w")).where("__n > 0")
    own = own.join(broadcast_if_small(dims.withColumnRenamed("dimension", "__dim")), "__u", "left")
    theirs = profiles.select("field", F.explode("profile_words").alias("__word"), F.array_contains("name_words", F.col("__word")).alias("__in_name"))
    shared = own.select(key, "__n", F.explode("__w").alias("__word")).join(broadcast_if_small(theirs), "__word").groupBy(key, "__n", "field").agg(
        F.sum(F.col("__in_name").cast("int")).alias("in_name"), F.count("*").alias("in_profile"))
    field_dims = profiles.select("field", F.explode("units").alias("unit")).select("field", F.lower(F.trim("unit")).alias("__u")).join(dims, "__u").groupBy("field").agg(
        F.collect_set("dimension").alias("dims"))
    wide = shared.join(own.drop("__w", "__n"), key).join(broadcast_if_small(profiles.select("field", "units", "dtypes", "components")), "field").join(
        broadcast_if_small(field_dims), "field", "left")
    if peers is not None:
        wide = wide.join(peers.select(F.col("rid").alias("__rid"), "field", F.lit(True).alias("__peer")), ["__rid", "field"], "left")
    else:
        wide = wide.withColumn("__peer", F.lit(None).cast("boolean"))
    fits = F.array_contains("dims", F.col("__dim"))
    numeric = F.col("__numeric") & (F.exists("dtypes", lambda d: F.lower(d) == "number") | (F.size("units") > 0))
    named = F.exists("components", lambda c: F.col("__context").contains(_spaced(c)))
    score = (F.greatest(F.col("in_name") / F.col("__n") * NAME_WEIGHT, F.col("in_profile") / F.col("__n") * PROFILE_WEIGHT)
             + F.when(F.col("__peer"), PEER).otherwise(0.0)
             + F.when(F.col("__dim").isNull() | F.col("dims").isNull(), 0.0).when(fits, UNIT_FIT).otherwise(UNIT_MISFIT)
             + F.when(numeric, NUMERIC).otherwise(0.0) + F.when(named, COMPONENT).otherwise(0.0))
    scored = wide.select(key, "field", F.round(F.least(score, F.lit(1.0)), 4).alias("score")).where("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.lower("field"), "field")
    top = scored.withColumn("__r", F.row_number().over(w)).withColumn("runner_up", F.lead("field").over(w)).withColumn("__second", F.lead("score").over(w)).where("__r = 1")
    second = F.coalesce("__second", F.lit(0.0))
    status = F.when((F.col("score") >= ACCEPT) & (F.round(F.col("score") - second, 4) >= MARGIN), "resolved").when(F.col("score") >= DOUBTFUL, "ambiguous").otherwise("unmapped")
    return top.select(key, F.col("field").alias("candidate"), "score", "runner_up", second.alias("runner_up_score"), status.alias("status"))


def alias_index(aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """(term, field) of aliases, an array for each field, of known fields only; terms in normal form."""
    return aliases.join(fields.select("field").distinct(), "field", "left_semi").select(F.explode("aliases").alias("__a"), "field").select(V.normal_name(F.col("__a")).alias("term"), "field").distinct()


def map_attribute(items: DataFrame, fields: DataFrame, index: DataFrame, contextual: DataFrame | None = None, key: str = "item") -> DataFrame:
    """(key, field, method): exact field names, else aliases of one field, else contextual ones, else all words of one field.

    ``contextual`` has (term, field, requires array): the alias holds only if one of the required terms stands in the
    item's context. Articles before and prepositions behind an attribute are ignored. Items without a field give no row.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower("attribute")), r"^(?:the|a|an|its)\s+", ""), r"\s+(?:of|is|for|to)$", "")
    own = items.where(F.trim("attribute") != "").select(key, V.normal_name(bare).alias("__term"), "attribute", "context")
    by_name = own.join(broadcast_if_small(fields.select("field").distinct().withColumn("__term", V.normal_name(F.col("field")))), "__term").select(key, "field", F.lit("canonical_exact").alias("method"), F.lit(0).alias("__k"))
    unique = index.groupBy("term").agg(F.min("field").alias("field"), F.count_distinct("field").alias("n")).where("n = 1").select(F.col("term").alias("__term"), "field")
    by_alias = own.join(broadcast_if_small(unique), "__term").select(key, "field", F.lit("curated_alias").alias("method"), F.lit(1).alias("__k"))
    every = by_name.unionByName(by_alias)
    if contextual is not None:
        rules = contextual.select(V.normal_name(F.col("term")).alias("__term"), "field", "requires")
        held = own.join(broadcast_if_small(rules), "__term").where(F.exists("requires", lambda r: _spaced(F.coalesce("context", F.lit(""))).contains(_spaced(r))))
        every = every.unionByName(held.select(key, "field", F.lit("contextual_alias").alias("method"), F.lit(2).alias("__k")))
    targets = fields.select(F.col("field").alias("target"), _words(F.col("field")).alias("words")).distinct().where("size(words) > 1")
    subset = names.subset_match(own.select(key, "attribute"), key, "attribute", targets)
    every = every.unionByName(subset.select(key, F.col("target").alias("field"), F.lit("token_subset").alias("method"), F.lit(3).alias("__k")))
    return every.groupBy(key).agg(F.min(F.struct("__k", "field", "method")).alias("m")).select(key, "m.field", "m.method")


def source_values(rows: DataFrame, key: str, tolerance: float = enrich.TOLERANCE) -> DataFrame:
    """(key, value): distinct values that a text states after a label, for labels that recur in it.

    ``rows`` has (key, text, labels array, canonical_unit). Values in units of another dimension don't count; values that
    agree within the tolerance are one. A label that stands once tells nothing, for a flattened table
    header may be followed by any row. Null texts and labels give no row.
    """
    number = re.compile(r"(?<!\d)([-+]?\d[\d,]*(?:\.\d+)?)(?!\d)\s*([^\W\d_]+(?:/[^\W\d_]+)?|%|°[CF]?)?")

    def values_of(text: str, labels: list[str], unit: str | None) -> list[float]:
        flat = re.sub(r"\s+", " ", re.sub(r"[*_`|#]+", " ", text))
        canonical = parse_unit(unit) if unit else None
        found: list[float] = []
        for label in sorted({x for x in labels if x and x.strip()}):
            parts = re.findall(r"\w+", label)
            spots = [m.end() for m in re.finditer(r"\b" + r"\s+".join(map(re.escape, parts)) + r"\b", flat, re.I)] if parts else []
            for at in spots if len(spots) > 1 else []:
                m = number.search(flat, at, at + 90)
                value = parse_number(m.group(1)) if m else None
                if value is None:
                    continue
                given = parse_unit(m.group(2)) if m.group(2) else None
                if given and canonical:
                    if not given.same_dimension(canonical):
                        continue
                    value = (value * given.factor + given.offset - canonical.offset) / canonical.factor
                if not any(math.isclose(value, old, rel_tol=tolerance, abs_tol=1e-6) for old in found):
                    found.append(value)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [values_of(t, ls, u) for t, ls, u in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            index = pa.array([i for i, vs in enumerate(made) for _ in vs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array([v for vs in made for v in vs], pa.float64())], names=[key, "value"])

    kind = dict(rows.dtypes)[key]
    return rows.where("text is not null and labels is not null").select(key, "text", "labels", "canonical_unit").mapInArrow(run, f"{key} {kind}, value double")


# --- a document's claims from end to end -----------------------------------------------------------

def process_claims(claims: DataFrame, rejected: DataFrame | None = None, sources: int = enrich.SOURCES) -> DataFrame:
    """(claim_id, status, reason): all claims that :func:`enrich.classify` has decided, brought to their last state.

    Surfaced claims that repeat an earlier one of their document are 'dup_in_run', rejected ones 'rejected';
    those of a document that contradicts itself about a field are parked as 'intradoc_conflict'; the others need
    ``sources`` documents in agreement, else they are parked as 'uncorroborated'. Each test sees what the tests before left.
    """
    marked = enrich.with_fingerprints(claims)
    open_ = marked.where("decision = 'surfaced'")
    first = enrich.first_in_run(open_)
    allowed = first if rejected is None else enrich.without_rejected(first, rejected)
    torn = enrich.conflicts_within(allowed, "doc_id", "partial_fp", "value_norm").select("doc_id", "partial_fp", F.lit(True).alias("__torn"))
    supported = enrich.corroborated(allowed, sources=sources).select("claim_id", F.lit(True).alias("__supported"))
    state = marked.select("claim_id", "doc_id", "partial_fp", "decision", "reason").join(first.select("claim_id", F.lit(True).alias("__first")), "claim_id", "left").join(
        allowed.select("claim_id", F.lit(True).alias("__allowed")), "claim_id", "left").join(torn, ["doc_id", "partial_fp"], "left").join(supported, "claim_id", "left")
    surfaced = F.col("decision") == "surfaced"
    last = (F.when(~surfaced, F.struct(F.col("decision").alias("s"), F.col("reason").alias("r")))
            .when(F.col("__first").isNull(), F.struct(F.lit("dropped").alias("s"), F.lit("dup_in_run").alias("r")))
            .when(F.col("__allowed").isNull(), F.struct(F.lit("dropped").alias("s"), F.lit("rejected").alias("r")))
            .when(F.col("__torn"), F.struct(F.lit("parked").alias("s"), F.lit("intradoc_conflict").alias("r")))
            .when(F.col("__supported").isNull(), F.struct(F.lit("parked").alias("s"), F.lit("uncorroborated").alias("r")))
            .otherwise(F.struct(F.lit("surfaced").alias("s"), F.col("reason").alias("r"))))
    return state.select("claim_id", last.alias("__s")).select("claim_id", F.col("__s.s").alias("status"), F.col("__s.r").alias("reason"))
