import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans import ask, evaluation, planner, prompt
from orrery.sources import generate, index, page_text, state


def test_columns(spark):
    cases = [
    (V.is_date_like(F.lit("3 May 1998")), True), (V.is_date_like(F.lit("1998-05-03")), True), (V.is_date_like(F.lit("in 1998 or so")), False), (V.is_date_like(F.lit(None).cast("string")), False), (V.is_date_like(F.lit("12")), False),
    (V.shown_number(F.lit(2.50)), "2.5"), (V.shown_number(F.lit(3.0)), "3"), (V.shown_number(F.lit(0.123456)), "0.1235"), (V.shown_number(F.lit(100.0)), "100"),
    (V.sentence_with(F.lit("A 51 b. It has 5 m. No."), F.lit("5")), "It has 5 m."), (V.sentence_with(F.lit("A 51"), F.lit("5")), None), (V.one_line(F.lit(" a\n b ")), "a b"),
    (V.document_name(F.lit("/a/b.c/d.e.txt")), "d.e"), (V.document_name(F.lit("plain")), "plain"), (V.unit_parts(F.lit("km / mi,")), ["km", "mi"]), (V.spelled_out(F.lit("Max. rng"), {"max": "maximum", "rng": "range"}), "maximum range"),
    (V.numbers_of(F.array(F.lit("1,234"), F.lit("x"), F.lit("2"))), [1234.0, 2.0]),
    (page_text.first_sentence(F.lit("One two. Three.")), "One two."), (page_text.first_sentence(F.lit("x" * 300)), "x" * 200 + "..."), (page_text.first_sentence(F.lit("no end")), "no end"), (page_text.file_name(F.lit("a/b:c")), "a_b_c.html"),
    (page_text.is_key_value_list(F.lit("Aa: 1\nBb: 2\nc")), True), (page_text.is_key_value_list(F.lit("Aa: 1")), False), (page_text.is_editorial_note(F.lit("Note: this article is short")), True), (page_text.is_editorial_note(F.lit("Note: wet")), False)]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [v for _, v in cases]


def test_descriptions_and_specifications(spark):
    text = "Lead text.\n\nAa: 1\nBb: 2\n\nDevelopment: It began.\n\nNote: this article is a stub\n\nMore of it.\n\nvariants followed soon.\n\nSpecifications\n\nLength: 5 m\n\nplain\n\nMass: 7 kg\n\nReferences\n\nEnd: 1"
    rows = spark.createDataFrame([(1, text, "sum", ["Development", "Specifications:"]), (2, None, "Only a summary.", []), (3, "", "", [])], "page_id long, full_text string, summary string, sections array<string>")
    known = page_text.headings(rows, ["References", " "])
    assert sorted(r.heading for r in known.collect()) == ["development", "references", "specifications"]
    got = {(r.page_id, r.bucket): r.text for r in page_text.described(rows, known).collect()}
    assert got == {(1, "Overview"): "Lead text.", (1, "History"): "It began.\n\nMore of it.", (1, "Variants"): "variants followed soon.", (1, "Design"): "Length: 5 m\n\nplain\n\nMass: 7 kg", (2, "Overview"): "Only a summary."}
    assert [(r.page_id, r.label, r.value) for r in page_text.spec_block(rows, known).orderBy("pos").collect()] == [(1, "Length", "5 m"), (1, "Mass", "7 kg")]


def test_hints_and_modes():
    catalogue = {"Maximum range": {"type": "numeric", "values": []}, "kind": {"type": "categorical", "values": ["Deck Crane"]}}
    assert planner.hints("Deck crane with maximum range over 5 km", catalogue) == ["The question names the field Maximum range.", "kind may be Deck Crane.", "A value of at least 5 km is asked for."]
    assert planner.selection_mode("auto", True) == "embed" and planner.selection_mode("auto", False) == "coverage"
    with pytest.raises(ValueError):
        planner.selection_mode("embed", False)
    assert prompt.related([{"rid": "1", "title": "T", "labels": "Carries: X", "text": "body"}, {"rid": "2", "labels": "y"}]) == ["[1] T (Carries: X)\nbody", "[2]  (y)"]


def test_evaluation_runs_and_resumes(spark, tmp_path):
    source, target, log = tmp_path / "src", str(tmp_path / "index"), str(tmp_path / "log.jsonl")
    source.mkdir()
    made = generate.records(20)
    (source / "all.json").write_text(json.dumps(made))
    embed = index.hashed_embedder(16)
    index.ingest(spark, str(source), target, embed=embed, embedder="hashed")
    ix = index.Index(spark, target)
    ix.check_schema()
    question = lambda q: list(embed(spark.createDataFrame([(q,)], "text string")).first()["embedding"])
    assert ix.field_ranking(question("range")) and ix.field_ranking(None) is None and ix.category_stats.columns[:2] == ["category", "field"]
    r = next(r for r in made if r["parametrics"])
    rid = ix.records.where(F.col("title") == r["name"]).first() or ix.records.first()
    cases = spark.createDataFrame([("a", "lookup", f"Tell me about {rid['title']}", [rid["rid"]], [], None, ["model"]), ("b", "none", "anything over 5", [], [], None, None)],
                                  "id string, class string, question string, required_rids array<string>, expected_rids array<string>, filter map<string,string>, answer array<string>")
    calls = []

    def model(system, text):
        calls.append(text)
        return "the model's reply"

    out = evaluation.run_eval(ix, cases, question, model, checkpoint=log)
    rates = {x["class"]: x for x in out["rates"].collect()}
    assert rates["lookup"]["hit_rate"] == 1.0 and rates["(all)"]["cases"] == 2
    before = len(calls)
    again = evaluation.run_eval(ix, cases, question, model, checkpoint=log)
    assert len(calls) == before and again["results"].count() == 2 and {x["class"] for x in again["stages"].collect()} == {"lookup", "none", "(all)"}
    assert sum(index.snapshot(ix, str(tmp_path / "snap")).values()) == ix.catalogue.count()
    index.write_records(ix.records, str(tmp_path / "out"), clean=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    replies = iter(['{"systemGroup": {"in": ["Sensors"]}}', '{"Maximum range": {"min": 1}}'])
    found, status = ask.extract_filter_in_two(ix, "sensors over 1 km", lambda s, t: next(replies))
    assert status == "ok" and any("min" in c for c in found.values())
    newer = index.publish(spark, {"records": ix.records}, target)
    assert index.current(spark, target) == newer and index.remove_old(spark, target, keep=1) and ix.refresh()
    with pytest.raises(Exception):
        ix.check_schema()


def test_field_alias_files_and_runs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Draught": ["Depth", "immersion"], "beam": "Width"}')
    assert index.field_aliases([str(tmp_path / "a.json")], {"Length": ["depth"]}) == {"depth": "Draught", "immersion": "Draught", "beam": "Width"}
    ledger = state.Ledger(spark, str(tmp_path / "ledger"))
    ledger.finish_run(1, "first", documents=3, errors=1)
    ledger.finish_run(1, "first", documents=4, errors=1)
    assert [(r.run_id, r.documents) for r in ledger.read("runs", spark.createDataFrame([], "run_id int")).collect()] == [(1, 4)] and ledger.next_run() == 2


def test_strata_and_unknown_fields(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, g int")
    assert {r.g: r["count"] for r in evaluation.stratified(rows, "g", "id").groupBy("g").count().collect()} == {0: 2, 1: 2, 2: 2}
    cases = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", None)], "id string, filter map<string,string>")
    assert [(r.id, r.field) for r in evaluation.unknown_filter_fields(cases, spark.createDataFrame([("x",)], "field string")).collect()] == [("a", "y")]
