import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import evidence, names, retrieval


def ranking(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, rank int")


def test_fusion_is_the_formula(spark):
    a, b = ["x", "y", "z"], ["z", "w", "x"]
    got = {r.key: r.rrf for r in retrieval.fuse(ranking(spark, a), ranking(spark, b), "key").collect()}
    for k in "xyzw":
        expected = sum(1 / (60 + lst.index(k)) for lst in (a, b) if k in lst)
        assert got[k] == pytest.approx(expected, abs=1e-8)


def test_bm25_against_plain_code(spark):
    docs = {1: "red pump red mast", 2: "blue pump", 3: "mast mast mast tower", 4: "", 5: None}
    df = spark.createDataFrame(list(docs.items()), "row_id long, text string")
    words = {k: v.split() for k, v in docs.items() if v is not None}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    score = {}
    for t in ("red", "mast"):
        d = sum(t in w for w in words.values())
        for k, w in words.items():
            if t in w:
                tf = w.count(t)
                score[k] = score.get(k, 0) + max(1e-6, math.log((n - d + .5) / (d + .5))) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(w) / avg))
    got = {r.row_id: r.score for r in retrieval.bm25_top(df, "row_id", "text", "red mast").collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in score.items()}
    assert retrieval.bm25_top(df, "row_id", "text", "???").count() == 0
    only = spark.createDataFrame([(3,)], "row_id long")
    assert [r.row_id for r in retrieval.bm25_top(df, "row_id", "text", "red mast", eligible=only).collect()] == [3]


def test_vectors_ties_nulls_and_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<float>")
    assert [(r.id, r.score, r["rank"]) for r in retrieval.vector_top(df, "v", [3.0, 0.0], "id", 2).collect()] == [(1, 1.0, 0), (2, 1.0, 1)]


def test_modes_pins_and_caps(spark):
    assert retrieval.filter_mode("auto", True, 9, 4) == "hard" and retrieval.filter_mode("auto", True, 3, 4) == "fill" and retrieval.filter_mode("soft", False, None, 4) == "off"
    ranked = spark.createDataFrame([(i, 1 - i / 10, i, f"p{i % 3}") for i in range(9)], "id long, rel double, rank int, parent string")
    pinned = retrieval.pin(ranked.drop("parent"), spark.createDataFrame([(7, 0)], "id long, pin_no int"), "id").join(ranked.select("id", "parent"), "id")
    got = retrieval.assemble(pinned, "id", "parent", k=4, max_per_parent=1, min_rel=0.5).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 0, 2]
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, rrf double")
    assert {r.rel for r in retrieval.normalise(same).collect()} == {1.0}


def test_table_sort_and_total(spark):
    recs = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "rid string, title string")
    cells = spark.createDataFrame([("1", "Speed", "1426"), ("2", "Speed", "591; 1635"), ("3", "Kind", "x")], "rid string, field string, value string")
    got = evidence.record_table(recs, cells, ["Speed", "Kind"], ["Speed"], limit=2).collect()
    assert [r.rid for r in got] == ["2", "1"] and got[0].total == 3
    assert [r.rid for r in evidence.record_table(recs, cells, ["Speed"], ["Speed"], ascending=True).collect()] == ["2", "1", "3"]


def test_relations(spark):
    links = spark.createDataFrame([("a", "b", "Carries"), ("c", "a", "Part of"), ("a", "zz", "Carries")], "parent string, child string, relation_type string")
    recs = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "rid string, title string")
    seed = recs.where("rid = 'a'")
    assert {r.rid: r.labels for r in evidence.related(links, seed, recs).collect()} == {"b": "Carries: A", "c": "Part of: A"}
    rows = {(r.parent, r.child): (r.reversed, r.child_title) for r in evidence.relation_rows(links, seed, recs).collect()}
    assert rows == {("a", "b"): (False, "B"), ("a", "zz"): (False, "zz"), ("c", "a"): (True, "A")}
    assert {r.rid: r.fitted_to for r in evidence.fitted_to(links, recs).collect()} == {"b": "A", "a": "C"}


def test_aliases_mentions_and_families(spark):
    recs = spark.createDataFrame([("1", "F-16 Falcon (Viper), Block X"), ("2", None), ("3", "AIM-120 missile")], "rid string, title string")
    made = {(r.alias, r.rid) for r in names.alias_table(recs, "rid", "title").collect()}
    assert {("f-16", "1"), ("viper", "1"), ("falcon", "1"), ("aim-120", "3")} <= made and ("missile", "3") not in made
    texts = spark.createDataFrame([(1, "The F-16 met an f-16x and the viper."), (2, None), (3, "nothing")], "id long, text string")
    found = names.mentions(texts, "id", "text", spark.createDataFrame([("f-16", "1"), ("viper", "1"), ("viper pit", "9")], "alias string, rid string"))
    assert {(r.alias, r.rid) for r in found.collect()} == {("f-16", "1"), ("viper", "1")}
    best = names.matched_records(found, "id").collect()
    assert [(b.rid, b.alias) for b in best] == [("1", "viper")]
    fam = names.families(spark.createDataFrame([(f"aim-{i}", str(i)) for i in range(30)] + [("f-1", "x")], "alias string, rid string"))
    asks = spark.createDataFrame([(1, "Which AIM is it?"), (2, "the AIM-7"), (3, "aim well")], "id long, text string")
    assert [(r.id, r.stem, r.members) for r in names.ambiguous_family(asks, "id", "text", fam).collect()] == [(1, "aim", 30)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "row_id long, text string, v array<float>")
    assert retrieval.bm25_top(none, "row_id", "text", "a b").count() == 0 and retrieval.vector_top(none, "v", [1.0], "row_id").count() == 0
    assert names.mentions(none, "row_id", "text", spark.createDataFrame([], "alias string, rid string")).count() == 0
    assert none.select(retrieval.cosine("v", [0.0]).alias("c")).where(F.col("c") > 0).count() == 0
