import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators import chunks, records
from orrery.plans import ask, evaluation, planner, prompt
from orrery.sources import generate, index, pages

CAT = {"Maximum range": {"type": "numeric", "unit": "km", "count": 9, "values": []}, "Unit cost": {"type": "numeric", "unit": "USD", "count": 5, "values": []},
       "systemType": {"type": "categorical", "count": 9, "values": ["Surface Radar", "Sonar Set"]}}
ALIASES = {"ax-1": ["1"], "ax-2": ["2"], "falcon": ["1"]} | {f"zq-{i}": [str(i)] for i in range(10, 40)}


@pytest.mark.parametrize("question,route", [
    ("What is the maximum range of AX-1?", "exact_entity_field"), ("Compare AX-1 and AX-2", "comparison"), ("List all Surface Radar with maximum range over 300 km", "analytic_filter"),
    ("What is AX-1 equipped with?", "relation"), ("Tell me about radars", "hybrid")])
def test_routes(question, route):
    assert planner.plan(question, CAT, ALIASES).route == route


def test_bounds_and_unresolved():
    assert planner.plan("unit cost less than $5 million", CAT, {}).filter["Unit cost"] == {"type": "numeric", "max": 5e6}
    assert planner.plan("maximum range between 1,000 and 2000 m", CAT, {}).filter["Maximum range"] == {"type": "numeric", "min": 1.0, "max": 2.0}
    assert planner.plan("anything over 5", CAT, {}).unresolved and planner.plan("the best radar", CAT, {}).unresolved
    assert planner.unknown_designations("What is QX-9?", ALIASES) == ["QX-9"] and planner.unknown_designations("AX-1 or QX-9", ALIASES) == []
    assert planner.ambiguous_family("Which ZQ?", ALIASES)[0] == "zq" and planner.ambiguous_family("zq or ZQ-11", ALIASES) is None


@given(st.dictionaries(st.sampled_from(list(prompt.WEIGHTS)), st.integers(0, 5000), min_size=1), st.integers(1, 4000))
def test_budget_is_never_exceeded(needs, total):
    got = prompt.allocate(needs, total)
    assert set(got) == set(needs) and sum(got.values()) <= total + 1e-6 and all(got[s] <= needs[s] + 1e-9 or got[s] <= total for s in needs)


def test_prompt_parts():
    text = "Parameter A = 1\n" + "word " * 400
    assert "Parameter A = 1" in prompt.shorten(text, 20) and len(prompt.shorten(text, 20)) < 120
    rows = [{"rid": str(i), "title": f"T{i}", "A": i} for i in range(40)]
    assert prompt.tokens(prompt.table(rows, ["A"], 40, {"A": "x" * 500}, budget=60)) <= 60
    whole = prompt.build("q?", [{"rid": "1", "title": "T", "text": "body", "rank": 0}], {"rows": rows, "columns": ["A"], "total": 40}, most=200)
    assert whole.endswith("Question: q?") and "[1] T" in whole


@given(st.lists(st.text(alphabet="abc ,", min_size=1, max_size=300), max_size=12))
def test_chunks_cover_and_overlap(parts):
    sentences = [p.strip() + "." for p in parts if p.strip()]
    made = chunks.pack("T", " ".join(sentences), target=200)
    assert made
    joined = " ".join(c[len("Title: T\n"):] for c in made)
    for s in sentences:
        for piece in re.split(r"(?<=[.!?])\s+", s):
            assert piece.strip() in joined
    bodies = [re.split(r"(?<=[.!?])\s+", c[len("Title: T\n"):]) for c in made]
    for a, b in zip(bodies, bodies[1:]):
        assert a[-1] == b[0]


def test_normaliser():
    c = records.normalise({"modelID": 7, "nomenclature": "A &amp; B", "descriptions": [{"descrType": "O", "description": "It was declared operational in 1999."}],
                           "parametrics": [{"parameter": "Range - 1", "parameterValue": "5", "uom": "km", "comments": "Typical range 4-6"}, {"parameter": "Radar", "parameterValue": "R", "childModel": "R-1", "childModelID": 9}],
                           "proliferations": [{"country": "X", "proliferation": "Using"}, {"country": "X", "type": "IOC Year", "proliferation": "FY2001"}, {"country": "Y", "type": "Projected Fielding", "proliferation": "2030"}],
                           "parametricUrls": [], "odd": [{"a": 1}], "specs": {"thermal": {"max": 4}}, "flag": True})
    extras = {(e["path"], e["seq"]): e["str"] if e["num"] is None else e["num"] for e in c.extras}
    assert c.title == "A & B" and c.params[0]["name"] == "Range" and c.relations[0]["child_id"] == "9" and extras[("specs.thermal.max", 0)] == 4.0 and extras[("flag", 0)] == "true"
    assert extras[("serviceEntryYear", 0)] == 2001.0 and extras[("Fielding status", 0)] == "Projected" and {d["path"] for d in c.dropped} == {"odd", "serviceEntryYear.prose_conflict"}
    n = records.normalise({"id": "x", "parameters": {"a": 1, "b": {"value": "2", "unit": "m"}, "g": {"h": 3}}, "text": "t"})
    assert [(p["name"], p["value"], p["unit"]) for p in n.params] == [("a", "1", None), ("b", "2", "m")] and {e["path"] for e in n.extras} == {"h", "text"}


@pytest.mark.parametrize("value,year", [(2019, 2019), ("2020", 2020), ("FY2021", 2021), ("unknown", None), (True, None), (1900, None)])
def test_service_year(value, year):
    assert records.service_year(value) == year


def test_json_recovery():
    assert ask.parse_json('Sure: ```json\n{"a": {"in": ["x}"]}}\n``` done') == {"a": {"in": ["x}"]}} and ask.parse_json("{broken") is None and ask.parse_json(None) is None


def test_scores():
    assert evaluation.answer_hit(["1,234"], "It is 1234 km") and not evaluation.answer_hit(["12"], "It is 124 km")
    assert evaluation.citations("As [5001, 5002] and [zz9] say", ["5001"]) == {"cited": ["5001", "5002", "zz9"], "hallucinated": ["5002", "zz9"]}
    s = evaluation.score_filter({"country": {"in": ["Norway"]}, "Range": {"min": 1}}, {"country_of_origin": {"in": ["norway"]}, "X": {"max": 2}})
    assert (s.precision, s.recall) == (0.5, 0.5)


def test_index_round_trip_and_safety(spark, tmp_path):
    source, target = tmp_path / "src", str(tmp_path / "index")
    with pytest.raises(index.CatalogueError):
        index.read_records(spark, str(source))
    source.mkdir()
    with pytest.raises(index.CatalogueError):
        index.read_records(spark, str(source))
    made = generate.records(25)
    (source / "all.json").write_text(json.dumps(made))
    embed = index.hashed_embedder(16)
    first = index.ingest(spark, str(source), target, embed=embed, embedder="hashed")
    ix = index.Index(spark, target)
    assert ix.records.count() == 25 and ix.version == first
    with pytest.raises(index.CatalogueError):
        ix.check_embedder("other")
    ix.check_embedder("other", allow=True)
    with pytest.raises(index.CatalogueError):
        ix.check_embedder("hashed", dimension=8)
    with pytest.raises(index.CatalogueError):
        index.publish(spark, {"records": ix.records.limit(0)}, target)
    assert index.current(spark, target) == first and not ix.refresh()
    question = lambda q: list(embed(spark.createDataFrame([(q,)], "text string")).first()["embedding"])
    r = next(r for r in made if r["parametrics"])
    p = r["parametrics"][0]
    reply = ask.ask(ix, f"What is the {p['parameterOnly'].lower()} of the {r['name']}?", question, lambda s, t: "model")
    assert reply.stop == "deterministic_reply" and p["parameterValue"] in reply.reply
    listed = ask.ask(ix, "List all Sensors with maximum range over 100 km", question, lambda s, t: "model")
    assert listed.reply == "model" and listed.table and all(x["rid"] for x in listed.table)


PAGE = """<html><head><title>X-1 - Wikipedia</title><link rel="canonical" href="https://w.example/wiki/X-1_(radar)"></head><body><nav>menu</nav>
<table class="infobox"><tr><th>Type</th><td>Airborne radar</td></tr><tr><th>Mass</th><td>120&nbsp;kg<br>or 265 lb</td></tr></table><script>var p='</p>';</script>
<p>The X-1 is a radar.<sup class="reference">[1]</sup></p><h2>Design</h2><p>It is <b>small</b>.<p>Unclosed<h2>Gallery</h2><p>pic</p><h2>See also</h2><p>no</p></body></html>"""


def test_pages(spark):
    p = pages.extract_page(PAGE)
    assert p.title == "X-1" and p.category == "aircraft_radar" and p.specs == [("Type", "Airborne radar"), ("Mass", "120 kg; or 265 lb")] and p.sections == ["Design"]
    assert p.full_text == "The X-1 is a radar.\n\nDESIGN: It is small.\n\nUnclosed" and pages.slug(p.url) == "X-1_radar"
    assert pages.extract_page("") is None and pages.extract_page(None) is None
    df = pages.pages(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"))
    assert df.count() == 1 and [r.parameter for r in pages.parametrics(df).orderBy("seq").collect()] == ["Type", "Weight"]
    assert {r.bucket: r.text for r in pages.descriptions(df).collect()} == {"Overview": "The X-1 is a radar.", "Design": "It is small.\n\nUnclosed"}


@pytest.mark.parametrize("text,dim,value", [("range 1.200 km", "length", 1.2), ("1,200 km (650 nmi)", "length", 1200.0), ("65 mi (105 km)", "length", 105.0), ("Mach 2", "speed", 2450.0), ("12,5 t", "mass", 12500.0), ("nothing", "mass", None)])
def test_quantity_of_pages(text, dim, value):
    got = pages.quantity(text, dim)
    assert (got and got[0]) == (pytest.approx(value) if value is not None else None)


def test_hit_rates(spark):
    cases = spark.createDataFrame([("1", "a", ["x"], []), ("2", "a", [], ["y", "z"]), ("3", "b", [], []), ("4", "b", ["q"], [])], "id string, class string, expected_rids array<string>, required_rids array<string>")
    results = spark.createDataFrame([("1", ["x", "y"], 10), ("2", ["y"], 20), ("3", ["k"], 30)], "id string, got array<string>, tokens int")
    rows = {r.id: (r.hit, r["rank"]) for r in evaluation.score_retrieval(cases, results).collect()}
    assert rows == {"1": (True, 1), "2": (False, 1), "3": (None, None), "4": (False, None)}
    rates = {r["class"]: r.hit_rate for r in evaluation.hit_rates(evaluation.score_retrieval(cases, results)).collect()}
    assert rates["a"] == 0.5 and rates["(all)"] == pytest.approx(0.3333)
    with pytest.raises(ValueError):
        evaluation.select_cases(cases, ["9"])
    assert evaluation.select_cases(cases, classes=["b"]).count() == 2 and cases.select(F.col("id")).count() == 4
