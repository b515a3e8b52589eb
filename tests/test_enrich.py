import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import enrich
from orrery.sources import state

C = "claim_id long, partial_fp string, value_norm double, doc_id string"


@pytest.mark.parametrize("seed", range(4))
def test_corroboration_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice([100.0, 101.0, 101.9, 104.0, 0.0, 5e-7, 1e-4, 1.005e-4, -100.0, -101.5, None]), f"d{rng.randrange(4)}") for i in range(60)]
    want = {}
    for i, c, v, _ in rows:
        if v is not None:
            docs = {d for _, c2, w, d in rows if c2 == c and w is not None and abs(w - v) <= max(1e-6, 0.02 * abs(v))}
            if len(docs) >= 2:
                want[i] = len(docs)
    got = {r.claim_id: r.supporters for r in enrich.corroborated(spark.createDataFrame(rows, C)).collect()}
    assert got == want


def test_graduation(spark):
    rows = [(1, "30", 30.0, "a"), (2, "30", 30.0, "b"), (3, "x", 20.0, "a"), (4, "x", 50.0, "b"), (5, "u", 7.0, "a"), (6, "u", 7.1, "b")]
    df = spark.createDataFrame([(*r, "parked", "uncorroborated") for r in rows], C + ", status string, park_reason string")
    got = {r.claim_id: r.status for r in enrich.graduate(df).collect()}
    assert {k for k, s in got.items() if s == "surfaced"} == {1, 2, 5, 6}


def test_comparison_and_conflicts(spark):
    claims = spark.createDataFrame([(1, "r", "f", 10.1), (2, "r", "f", 12.0), (3, "r", "g", 1.0), (4, "r", "f", None)], "claim_id long, rid string, field string, value double")
    stored = spark.createDataFrame([("r", "f", 10.0, 10.0), ("r", "f", 20.0, 22.0)], "rid string, field string, lo double, hi double")
    assert {r.claim_id: r.outcome for r in enrich.compare_numeric(claims, stored).collect()} == {1: "match", 2: "conflict", 3: "gap", 4: "incomparable"}
    inside = spark.createDataFrame([("d", "k", 1.0), ("d", "k", 1.01), ("d", "m", 1.0), ("d", "m", 2.0)], "doc string, cluster string, v double")
    assert [r.cluster for r in enrich.conflicts_within(inside, "doc", "cluster", "v").collect()] == ["m"]


def test_grounding_is_by_whole_values(spark):
    df = spark.createDataFrame([(1, "It has 1,200 km.", "1,200"), (2, "It has 21,200 km.", "1,200"), (3, None, "5"), (4, "**12** m", "12"), (5, "Range is 12.", "12")], "claim_id long, quote string, value_raw string")
    assert {r.claim_id: r.grounded for r in enrich.ground(df).collect()} == {1: "quote", 2: "none", 3: "none", 4: "quote", 5: "quote"}


def test_cascade(spark):
    base = dict(attribute="a", canon_field="f", mapping_status="resolved", model_id="m", grounded="quote", quote="it is 5 m", value_num=5.0, unit_norm="m", field_numeric=True, field_unit="m", unit_ok=True, outcome="gap", dual_ok=None)
    changes = [({}, "gap_fill"), ({"attribute": " "}, "malformed_claim"), ({"model_id": None}, "unlinked"), ({"grounded": "none"}, "ungrounded"), ({"quote": "it may be 5 m"}, "nonasserted"), ({"mapping_status": "ambiguous"}, "ambiguous_field"),
               ({"canon_field": None}, "unmapped"), ({"field_numeric": False}, "text_field"), ({"value_num": None}, "incomplete"), ({"unit_norm": None}, "incomplete"), ({"unit_ok": False}, "incompatible_unit"), ({"outcome": "match"}, "already_present"), ({"outcome": "conflict"}, "conflict"), ({"dual_ok": False}, "inconsistent_dual")]
    schema = "attribute string, canon_field string, mapping_status string, model_id string, grounded string, quote string, value_num double, unit_norm string, field_numeric boolean, field_unit string, unit_ok boolean, outcome string, dual_ok boolean, n int"
    df = spark.createDataFrame([(*(base | c).values(), i) for i, (c, _) in enumerate(changes)], schema)
    assert [r.reason for r in enrich.classify(df).orderBy("n").collect()] == [reason for _, reason in changes]


def test_upsert_and_dedup(spark):
    s = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "k string, first_run int, n int")
    i = spark.createDataFrame([("b", 2, 9), ("c", 2, 1)], "k string, first_run int, n int")
    assert sorted(tuple(r) for r in enrich.upsert(s, i, "k").collect()) == [("a", 1, 5), ("b", 1, 9), ("c", 2, 1)]
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.copies) for r in enrich.distinct_documents(docs).collect()) == [(1, 2), (4, 1)]


def test_batches_keep_failures_retryable(spark, tmp_path):
    ledger = state.Ledger(spark, str(tmp_path / "state"))
    docs = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "alpha")], "doc_id string, text string")
    calls = []

    def extract(fresh):
        calls.append(sorted(r.doc_id for r in fresh.select("doc_id").collect()))
        return fresh.select("doc_id", F.crc32("doc_id").alias("claim_id"), F.lit("m").alias("model_id"), F.lit("f").alias("canon_field"), F.lit("5").alias("value_raw"), F.lit(5.0).alias("value_norm"),
                            F.lit("parked").alias("status"), F.lit("uncorroborated").alias("park_reason"), F.when((F.col("doc_id") == "b") & F.lit(len(calls) == 1), "timeout").alias("error"))

    first = state.run_batch(spark, docs, extract, ledger)
    assert first.count() == 1 and len(calls[0]) == 2
    second = state.run_batch(spark, docs, extract, ledger)
    assert calls[1] == ["b"] and {r.status for r in second.collect()} == {"surfaced"}
    assert ledger.next_run() == 3
