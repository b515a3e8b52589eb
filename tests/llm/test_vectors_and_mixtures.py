import collections
import os
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import mixing, neighbours, packing, tokens


def close_rows(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    for i in range(0, n, 5):
        for j in range(1, 5):
            base[i + j] = base[i] + rng.standard_normal(64) * rng.choice([0.2, 0.4, 0.5])
    base[100:140] = base[100]
    return (base * rng.uniform(0.1, 5, (n, 1))).astype(np.float32)


def brute(x, ids, k=10, least=0.9):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, -np.round(s[i], 6)))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_pairs_against_brute_force(spark):
    x = close_rows()
    x[200:203] = x[300:303] = x[300:303]
    x[200:203] = x[300:303].copy()
    x[400:430] = np.outer(np.linspace(0.5, 9, 30), x[400])  # scaled copies
    rows = [(i, r.tolist(), i) for i, r in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 64, 0), (5002, [1.0] * 3, 0), (5003, [float("nan")] * 64, 0)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<float>, rep long")
    got = {(r.row_id_a, r.row_id_b): r.cosine for r in neighbours.similar_pairs(df, "row_id", "embedding", list_rows=100, fine_rows=16).collect()}
    want = brute(x, np.arange(len(x)))
    exact = {p for p in want if np.array_equal(x[p[0]], x[p[1]])}
    assert len(want - set(got)) <= 0.01 * len(want) and all(c >= 0.9 for c in got.values())
    # a group of copies is represented by its first rows, so its pairs stay linear in its size
    assert len([p for p in got if p[0] in range(100, 140) and p[1] in range(100, 140)]) <= 40 * 11 and exact


def dense_ball(n, seed=6):
    """Distinct vectors all within the margin of each other."""
    rng = np.random.default_rng(seed)
    return neighbours.unit((np.ones(64) + 0.1 * rng.standard_normal((n, 64))).astype(np.float32))


def test_memory_of_a_list_does_not_grow_with_visitors_or_pairs():
    """9 million close pairs of one list: neither they nor 60,000 visitors are held at once."""
    x = dense_ball(3000)
    index = neighbours.fit(x, 1)
    far = neighbours.unit(np.random.default_rng(7).standard_normal((6000, 64)).astype(np.float32))

    def visitors():
        for k in range(10):
            yield far.copy(), np.arange(6000) + 10_000 * (k + 1)

    tracemalloc.start()
    rows = [np.stack([a, b]) for a, b, _ in neighbours.compare_list(x, np.arange(3000), visitors(), index, 10, 0.9, 0.16, 160)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    got = {(min(p), max(p)) for p in np.concatenate(rows, axis=1).T.tolist()}
    want = brute(x, np.arange(3000))
    assert len(want - got) <= 0.01 * len(want) and all(b < 3000 for _, b in got)


def test_visitors_in_any_portions_give_the_same_pairs():
    x = neighbours.unit(close_rows(1500, 3).astype(np.float32))
    index = neighbours.fit(x, 1)
    ids = np.arange(1500)
    whole, parts = (set() for _ in range(2))
    for into, cuts in ((whole, [1500]), (parts, [401, 402, 900, 1500])):
        stream = [(x[a:b], ids[a:b]) for a, b in zip([400, *cuts], cuts)]
        for a, b, cosine in neighbours.compare_list(x[:400], ids[:400], stream, index, 3, 0.9, 0.16, 50):
            into.update(zip(a.tolist(), b.tolist()))
    assert whole == parts and whole


def test_lists_grow_beyond_their_number():
    """Visits of a vector stay in step with a bounded number of lists until a list fills its bytes."""
    assert [neighbours.rows_of_list(n, 8192, 64) for n in (0, 150_000, 1 << 20)] == [8192] * 3
    assert neighbours.rows_of_list(9_150_000, 8192, 64) * 128 >= 9_150_000 and neighbours.rows_of_list(10**9, 8192, 64) == (32 << 20) // 256


def test_empty_and_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "row_id long, embedding array<float>")
    assert neighbours.similar_pairs(df, "row_id", "embedding").count() == 0 and neighbours.similar_pairs(df.limit(0), "row_id", "embedding").count() == 0
    assert neighbours.search(df, "row_id", "embedding", df).count() == 0


def test_search_recall(spark):
    x = np.random.default_rng(2).standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, embedding array<float>")
    rows = neighbours.search(df, "row_id", "embedding", df.where("row_id % 100 = 0"), chunk_rows=1000, rerank=120).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        s = u @ u[q]
        s[q] = -9
        hits += len({r.row for r in rows if r.query == q} & set(np.argsort(-s)[:10].tolist()))
    assert hits / 300 >= 0.9 and len(rows) == 300


def test_anisotropic_codes_cut_the_parallel_error():
    x = neighbours.unit(np.random.default_rng(1).standard_normal((4000, 64)).astype(np.float32))
    books = neighbours.train_books(x)
    along = {}
    for eta in (1.0, 4.0):
        codes = neighbours.encode(x, books, eta)
        r = x - books[np.arange(16)[None], codes].reshape(len(x), -1)
        along[eta] = np.abs((r * x).sum(axis=1)).mean()
    assert along[4.0] < along[1.0]
    codes = neighbours.encode(x[:50], books)
    assert np.allclose(neighbours.scan(x[:7], codes, books), books[np.arange(16)[None], codes].reshape(50, -1) @ x[:7].T, atol=1e-4)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 5000], [1025] * 30, [700, 600, 400] * 40, list(range(1, 400)), [0, 3, 0], [10] * 999])
def test_packing(spark, sizes):
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] + [(10_000, None, 1)], "id long, n long, container int")
    rows = packing.pack(df.select("id", "n"), "id", "n").collect()
    total, held = collections.Counter(), collections.Counter()
    for r in rows:
        total[r.id] += r.n_tokens or 0
        if r.container is not None:
            held[r.container] += r.n_tokens
    assert all(0 < v <= 2048 for v in held.values()) and {i: total[i] for i in range(len(sizes))} == dict(enumerate(sizes)) and 10_000 in {r.id for r in rows}
    split = {r.id for r in rows if r.part_no > 0}
    assert all(sizes[i] > 2048 for i in split)
    if len(sizes) > 100:
        assert sum(held.values()) / (2048 * len(held)) > 0.75


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 60), min_size=1))
def test_schedule_stays_within_one_block(blocks):
    slots = mixing.schedule_blocks(blocks)
    total = sum(blocks.values())
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for s, at in slots.items():
        for t in range(1, total + 1):
            assert abs(sum(x < t for x in at) - blocks[s] * t / total) < 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 90), min_size=1), st.integers(5, 40))
def test_epochs_stay_within_two_blocks(blocks, slots):
    total = sum(blocks.values())
    borders = mixing.epoch_borders(blocks, slots)
    rows = [r for a, b in zip(borders, borders[1:]) for r in mixing.schedule_epoch(a, b)]
    assert sorted(t for _, _, t in rows) == list(range(total))
    for s, n in blocks.items():
        own = sorted((j, t) for k, j, t in rows if k == s)
        assert [j for j, _ in own] == list(range(n)) and [t for _, t in own] == sorted(t for _, t in own)
        for t in range(1, total + 1):
            assert abs(sum(x < t for _, x in own) - n * t / total) < 2


def test_mixture_in_epochs(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 4000) for i in range(300)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    whole, cut = (sorted((r.doc_id, r.copy_no, r.source, r.block_no) for r in mixing.mix(docs, targets, epoch_slots=n)[0].collect()) for n in (50_000, 20))
    assert whole == cut and len(whole) > 300


def test_mixture(spark):
    docs = [(i, "big" if i % 3 else "small", 50 + i % 40, "x") for i in range(900)] + [(9000, None, 10, "x"), (9001, "other", 10, "x"), (9002, "big", None, "x"), (9003, "big", 0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, slot string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    schedule, report = mixing.mix(df, targets)
    uses = collections.Counter((r.doc_id, r.source) for r in schedule.collect())
    assert max(n for (_, s), n in uses.items() if s == "big") == 1 and max(n for (_, s), n in uses.items() if s == "small") <= 2 and not {9000, 9001, 9002, 9003} & {d for d, _ in uses}
    got = {r.source: r for r in report.collect()}
    assert got["big"].actual_share == pytest.approx(5 / 9, abs=0.01) and got["none"].actual_share == 0 and got["other"].target_share is None and None in got
    empty, rep = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and rep.count() == 3


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "word " * 50_000)], "id long, text string")
    got = sorted((r.id, r.n_tokens) for r in tokens.count_tokens(df.withColumn("n_tokens", F.lit(1)), "id", "text").collect())
    assert got[0] == got[1] and got[2] == (2, 0) and got[3] == (3, None) and got[4][1] >= 50_000
