import pytest
from pyspark.sql import functions as F

from orrery.operators import linking


@pytest.fixture(scope="module")
def scene(spark):
    docs = spark.createDataFrame([(1, "The Hull One carries the Keel Two. Hull One was built in Norway."), (2, "Keel Two alone."), (3, "A radar, the Mast."), (4, None), (5, "Mast in Spain")], "doc_id long, text string")
    aliases = spark.createDataFrame([("hull one", "h"), ("keel two", "k"), ("mast", "m"), ("mast", "n")], "alias string, rid string")
    return docs, aliases, linking.document_mentions(docs, aliases)


def test_mentions_and_signals(spark, scene):
    docs, _, found = scene
    assert sorted((r.doc_id, r.rid, r.ambiguous, r.pos > 0) for r in found.collect()) == [(1, "h", False, True), (1, "k", False, True), (2, "k", False, True), (3, "m", True, True), (3, "n", True, True), (5, "m", True, True), (5, "n", True, True)]
    operators = spark.createDataFrame([("h", "Norway"), ("m", "Spain"), ("k", None)], "rid string, country string")
    got = {(r.doc_id, r.rid): r.signal for r in linking.second_signal(docs, found, operators, ["radar"]).collect()}
    assert got == {(1, "h"): "operator-country:Norway", (1, "k"): "co-entity", (3, "m"): "domain-term", (3, "n"): "domain-term", (5, "m"): "operator-country:Spain"}
    assert linking.second_signal(docs.limit(0), found.limit(0), operators, []).count() == 0


def test_links_of_claims(spark, scene):
    docs, aliases, found = scene
    claims = spark.createDataFrame([(10, 1, "the hull", "Hull One and Keel Two"), (11, 1, None, None), (12, 2, "Keel Two", "x"), (13, 3, "Hull One", ""), (14, 2, "Keel  two", None), (14, 2, "Keel  two", None)],
                                   "claim_id long, doc_id long, entity_mention string, quote string")
    assert {r.claim_id: r.rid for r in linking.link_claims(claims, found).collect()} == {10: "h", 12: "k", 14: "k"}
    operators = spark.createDataFrame([("h", "Norway")], "rid string, country string")
    got = {r.claim_id: (r.rid, r.link) for r in linking.link(claims, docs, aliases, operators, ["radar"]).collect()}
    assert got == {10: ("h", "operator-country:Norway"), 11: (None, "unlinked"), 12: (None, "no-second-signal"), 13: (None, "unlinked"), 14: (None, "no-second-signal")}


def test_relations_have_one_direction(spark, scene):
    claims = spark.createDataFrame([(1, 1, "Keel Two is carried by Hull One"), (2, 1, "Hull One carries Keel Two"), (3, 1, "Hull One and Keel Two"), (4, 1, "Hull One is fitted"), (5, 1, None)], "claim_id long, doc_id long, quote string")
    assert {r.claim_id: (r.subject, r.object) for r in linking.relation_endpoints(claims, scene[2]).collect()} == {1: ("h", "k"), 2: ("h", "k")}


def test_coerced_claims(spark):
    rows = [(1, {"entity": "a", "Height (m)": "21"}), (2, {"attribute": "x", "value": "1", "other": "2"}), (3, {"one": "1", "two": "2"}), (4, None), (5, {"entity": "a"})]
    got = {r.id: (r.attribute, r.value) for r in linking.coerce_claims(spark.createDataFrame(rows, "id long, raw map<string,string>"), "raw").collect()}
    assert got == {1: ("Height (m)", "21"), 2: ("x", "1"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_profiles_units_and_peers(spark):
    params = spark.createDataFrame([("1", "Draught", "depth of the hull", "Number", "m", "Hull"), ("1", "Tonnage", "mass of the hull", "Number", "t", None), ("2", "Draught", None, None, None, None), ("2", " ", None, None, None, None)],
                                   "rid string, field string, definition string, dtype string, unit string, component string")
    profiles = linking.field_profiles(params)
    assert {r.field: (r.records, sorted(r.name_words)) for r in profiles.collect()} == {"Draught": (2, ["draught"]), "Tonnage": (1, ["tonnage"])}
    units = spark.createDataFrame([("m", "length"), ("ft", "length"), ("t", "mass")], "unit string, dimension string")
    items = spark.createDataFrame([("a", "draught", "ft", "5", None, "9"), ("b", "hull", "t", "5", "the hull", "9"), ("c", "beam", None, None, None, "9"), ("d", None, None, None, None, None)],
                                  "item string, attribute string, unit string, value string, context string, rid string")
    got = {r.item: (r.candidate, r.score, r.runner_up, r.status) for r in linking.resolve_profiles(items, profiles, units).collect()}
    assert got == {"a": ("Draught", 0.86, None, "resolved"), "b": ("Tonnage", 0.76, "Draught", "resolved")}
    records = spark.createDataFrame([("1", "ship", "naval"), ("9", "ship", None), ("2", None, None)], "rid string, system_type string, system_group string")
    peers = linking.peer_fields(params, records)
    assert sorted(map(tuple, peers.collect())) == [("9", "Draught"), ("9", "Tonnage")]
    assert {r.item: r.score for r in linking.resolve_profiles(items, profiles, units, peers).collect()} == {"a": 0.94, "b": 0.84}


def test_attribute_cascade(spark):
    fields = spark.createDataFrame([("Hull length",), ("Draught",), ("Sail area",)], "field string")
    index = linking.alias_index(spark.createDataFrame([("Draught", ["depth", "immersion"]), ("Sail area", ["depth"]), ("Gone", ["x"])], "field string, aliases array<string>"), fields)
    contextual = spark.createDataFrame([("depth", "Draught", ["hull"])], "term string, field string, requires array<string>")
    items = spark.createDataFrame([(1, "the draught of", None), (2, "Immersion", None), (3, "depth", "of the hull"), (4, "depth", "of the sea"), (5, "total hull length in m", None), (6, None, None), (7, "length", None)], "item long, attribute string, context string")
    got = {r.item: (r.field, r.method) for r in linking.map_attribute(items, fields, index, contextual).collect()}
    assert got == {1: ("Draught", "canonical_exact"), 2: ("Draught", "curated_alias"), 3: ("Draught", "contextual_alias"), 5: ("Hull length", "token_subset")}


def test_source_values(spark):
    rows = [(1, "Mass: 5 t. Later, mass was 5,000 kg. The mass is 7 t.", ["mass"], "kg"), (2, "Mass 5 t", ["mass"], "kg"), (3, None, ["mass"], None), (4, "Length 3 s, length 4 m", ["length"], "m"), (5, "speed 4 speed 9", ["Speed", ""], None)]
    got = sorted((r.id, round(r.value, 3)) for r in linking.source_values(spark.createDataFrame(rows, "id long, text string, labels array<string>, canonical_unit string"), "id").collect())
    assert got == [(1, 5000.0), (1, 7000.0), (4, 4.0), (5, 4.0), (5, 9.0)]


def test_states_of_claims(spark):
    rows = [(1, "a", "m", "f", "5", 5.0, "surfaced", "gap_fill"), (2, "b", "m", "f", "5", 5.05, "surfaced", "gap_fill"), (3, "b", "m", "f", "5", 5.05, "surfaced", "gap_fill"), (4, "c", "m", "g", "5", 5.0, "surfaced", "gap_fill"),
            (5, "d", "m", "h", "5", 5.0, "surfaced", "gap_fill"), (6, "d", "m", "h", "9", 9.0, "surfaced", "gap_fill"), (7, "d", None, None, None, None, "dropped", "ungrounded")]
    claims = spark.createDataFrame(rows, "claim_id long, doc_id string, model_id string, canon_field string, value_raw string, value_norm double, decision string, reason string")
    got = {r.claim_id: (r.status, r.reason) for r in linking.process_claims(claims).collect()}
    assert got == {1: ("surfaced", "gap_fill"), 2: ("surfaced", "gap_fill"), 3: ("dropped", "dup_in_run"), 4: ("parked", "uncorroborated"), 5: ("parked", "intradoc_conflict"), 6: ("parked", "intradoc_conflict"), 7: ("dropped", "ungrounded")}
    assert linking.process_claims(claims.limit(0)).count() == 0
    fps = linking.enrich.with_fingerprints(claims).where(F.col("claim_id") == 4).select("full_fp")
    assert {r.claim_id: r.reason for r in linking.process_claims(claims, fps).collect()}[4] == "rejected"
