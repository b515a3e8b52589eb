"""Registered queries that cover their whole input, against plain code."""

import os
import re

import pytest

from orrery.operators import evidence, names
from orrery.operators.hierarchy import plain_id
from orrery.plans import registry
from orrery.plans.runtime import table

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def first_releases(spark):
    """{rid: title} of the first release of each model."""
    rows = sorted(table(spark, SMALL, "models").select("model_id", "release_id", "nomenclature").collect(), reverse=True)
    return {str(r.model_id): re.sub(r"\s+", " ", r.nomenclature).strip() for r in rows if r.nomenclature is not None}


@needs_tables
def test_alias_table_keeps_designations(spark):
    want = set()
    for rid, title in first_releases(spark).items():
        own = [title, *re.findall(names.DESIGNATION, title), *re.findall(r"\(([^)]+)\)", title), *title.split(",")]
        own += [w for w in re.sub(r"[(),]", " ", title).split() if w.lower() not in names.STOPWORDS and (len(w) >= 3 or re.search(names.DESIGNATION, w))]
        want |= {(a.strip().lower(), rid) for a in own if len(a.strip()) >= 2}
    got = [(r.alias, r.rid) for r in registry.QUERIES["alias_table_whole"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert any(re.fullmatch(r"(?:mk|lot) ?\d+", a) for a, _ in got)


def test_every_seed_has_its_own_limit(spark):
    links = spark.createDataFrame([(s, f"{s}{i:02}", "Carries") for s in "ab" for i in range(15)] + [("b", "a", "Part of"), ("b", "b", "Part of")], "parent string, child string, relation_type string")
    recs = spark.createDataFrame([("a", "A"), ("b", "B"), ("a00", "A0")], "rid string, title string")
    rows = evidence.relation_rows_each(links, recs.where("rid in ('a', 'b')"), recs).collect()
    for seed in "ab":
        edges = [(r.parent, r.child, r.relation_type) for r in links.collect() if seed in (r.parent, r.child)]
        assert sorted((r.parent, r.child, r.relation_type) for r in rows if r.seed == seed) == sorted(edges)[:12]
    assert all(r.reversed == (r.parent != r.seed) for r in rows)
    got = {(r.seed, r.rid): r.labels for r in evidence.related_each(links, recs.where("rid in ('a', 'b')"), recs).collect()}
    assert got == {("a", "b"): "Part of: A", ("b", "a"): "Part of: B", ("a", "a00"): "Carries: A"}


@needs_tables
def test_relations_cover_all_records(spark):
    titles = first_releases(spark)
    links = {tuple(r) for r in evidence.edges(table(spark, SMALL, "record_relations"), plain_id).select("parent", "child", "relation_type").collect()}
    labels, edges = {}, {}
    for p, c, kind in links:
        for seed, other in {(p, c), (c, p)}:
            if seed in titles:
                edges.setdefault(seed, set()).add((p, c, kind))
                if other in titles and other != seed:
                    labels.setdefault((seed, other), set()).add(": ".join(x for x in (kind, titles[seed]) if x is not None))
    related = registry.QUERIES["related_one_hop_each"](spark, SMALL).collect()
    assert {(r.seed, r.rid): r.labels for r in related} == {k: "; ".join(sorted(v)) for k, v in labels.items()}
    rows = registry.QUERIES["relation_evidence_each"](spark, SMALL).collect()
    key = lambda e: tuple((x is not None, x or "") for x in e)
    want = sorted((s, *e) for s, found in edges.items() for e in sorted(found, key=key)[:12])
    assert sorted((r.seed, r.parent, r.child, r.relation_type) for r in rows) == want


@needs_tables
def test_precision_recall_reads_every_claim(spark):
    rows = {r.claim_id: r for r in table(spark, SMALL, "claims").collect() if None not in (r.model_id, r.canon_field, r.value_norm)}.values()
    early, late = [r for r in rows if (r.run_id or 0) <= 2], [r for r in rows if (r.run_id or 0) > 2]
    meets = lambda e, f: (e.status, e.model_id, e.canon_field) == (f.status, f.model_id, f.canon_field) and abs(f.value_norm - e.value_norm) <= 0.03 * abs(e.value_norm)
    got = {r.type: (r.tp, r.fp, r.fn) for r in registry.QUERIES["precision_recall_runs"](spark, SMALL).collect()}
    want = {}
    for t in {r.status for r in rows}:
        tp = sum(any(meets(e, f) for f in late) for e in early if e.status == t)
        want[t] = (tp, sum(not any(meets(e, f) for e in early) for f in late if f.status == t), sum(e.status == t for e in early) - tp)
    assert got == want and len(early) + len(late) == len(rows)


@needs_tables
def test_anti_seen_reads_every_document(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "content_hash", "ingested_at").collect()
    seen = {d.content_hash for d in docs if d.ingested_at is not None and d.ingested_at.year < 2024}
    want = [(d.doc_id, d.content_hash) for d in docs if (d.ingested_at is None or d.ingested_at.year >= 2024) and d.content_hash not in seen]
    assert sorted(map(tuple, registry.QUERIES["anti_seen_dates"](spark, SMALL).collect())) == sorted(want) and want


def test_intervals_with_thousands_commas(spark, tmp_path):
    rows = [(1, "5,861 to 7,033"), (2, "9 to 4"), (3, "5,861"), (4, None)]
    spark.createDataFrame(rows, "claim_id long, value_raw string").write.parquet(str(tmp_path / "claims.parquet"))
    assert {tuple(r) for r in registry.QUERIES["parse_interval"](spark, str(tmp_path)).collect()} == {(1, 5861.0, 7033.0), (2, 4.0, 9.0)}


def test_budget_takes_documents_of_all_sources(spark, tmp_path):
    rows = [(5, "x" * 4000, None), (1, "x" * 1999, "trade_press"), (2, None, "trade_press"), (3, "x" * 3, "glossary_card"), (4, "y" * 2400, None), (6, "x", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.QUERIES["budget_pack_all"](spark, str(tmp_path)).collect()))
    assert got == [(1, 499, 499), (3, 1, 500), (4, 600, 1100)]
