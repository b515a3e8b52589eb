import random

import pytest

from orrery.operators import hierarchy

COLUMNS = "child_model_id string, rel_parent_model_id string, parent_rid string, node_id int"


def brute(edges):
    parent = {}
    for c, p in sorted(edges, key=lambda e: (len(e[1]), e[1])):
        parent.setdefault(c, p)
    out = {}
    for n in {x for e in edges for x in e}:
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        cyclic = path[-1] in parent
        out[n] = ("CYCLE", -1, None) if cyclic else (path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


def frame(spark, edges):
    return spark.createDataFrame([(c, p, None, 7) for c, p in edges], COLUMNS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(str(i), str(rng.randrange(max(1, i - 6), i + 1) if i > 1 else 2)) for i in range(1, 120)]
    edges += [(f"c{i}", f"c{i - 1}") for i in range(1, 90)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x4", "x1"), ("s", "s")]
    expected = brute(edges)
    rows = hierarchy.hierarchy(frame(spark, edges)).collect()
    assert {r.node_id: (r.root_id, r.depth) for r in rows} == {n: v[:2] for n, v in expected.items()}
    assert len(rows) == len(expected)
    shown = {r.node_id: r.path for r in hierarchy.paths(frame(spark, edges)).collect()}
    assert shown == {n: v[2] for n, v in expected.items()}
    below = {n: sum(1 for m, v in expected.items() if v[2] and m != n and n in v[2].split("/")) for n, v in expected.items() if v[2]}
    assert {r.node_id: r.n_descendants for r in rows if r.depth >= 0} == below
    spans = {r.node_id: (r.root_id, r.entry, r.exit) for r in rows if r.depth >= 0}
    for a, (ra, ea, xa) in spans.items():
        inside = {b for b, (rb, eb, xb) in spans.items() if rb == ra and ea < eb and xb < xa}
        assert len(inside) == below[a]


def test_dirty_ids_nulls_and_repeats(spark):
    rows = [("0002", "1", "9", 1), (" 2 ", "1.0", None, 1), ("#3", None, "#0001", 1), (None, "1", "1", 1), ("4", None, None, 1), ("5", "", "2", 1), ("part-a", "5", None, 1)]
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy.hierarchy(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 1), "5": ("1", 2), "part-a": ("1", 3)}


def test_hot_parent_and_empty_table(spark):
    edges = [(f"k{i}", "hub") for i in range(500)] + [("hub", "top")]
    got = {r.node_id: (r.depth, r.n_descendants) for r in hierarchy.hierarchy(frame(spark, edges)).collect()}
    assert got["top"] == (0, 501) and got["hub"] == (1, 500) and got["k499"] == (2, 0)
    assert hierarchy.hierarchy(frame(spark, [])).count() == 0
    assert hierarchy.descendants(frame(spark, [("b", "a"), ("c", "b")])).count() == 3
