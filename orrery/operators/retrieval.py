"""Hybrid retrieval: vector and keyword rankings, their fusion, and what is done with the fused list."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans.runtime import Scratch, broadcast_if_small

# Constants of BM25 and of reciprocal rank fusion.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60


def cosine(vector: str, query: list[float]) -> Column:
    """Cosine of an array column with a literal vector, in double precision; zero vectors give null."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(q)) or 1.0
    literal = F.array(*[F.lit(float(x) / norm) for x in q])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, literal, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, dot / size)


def vector_top(passages: DataFrame, vector: str, query: list[float], key: str, pool: int = 20, extra: list[str] | None = None) -> DataFrame:
    """The ``pool`` most similar rows: key, score, rank from 0. Ties go by key.

    The eligibility of passages must be applied before (a filter doesn't pass below a limit). The plan
    is one scan with a local top-k in each task.
    """
    scored = passages.where(F.col(vector).isNotNull()).select(key, *(extra or []), F.round(cosine(vector, query), 6).alias("score"))
    top = scored.where("score is not null").orderBy(F.desc("score"), key).limit(pool)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index (term, key, tf, dl): one row per distinct term of a text, with the text's length in terms."""
    words = texts.where(F.col(text).isNotNull()).select(key, V.tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    return words.select(key, "dl", F.explode("w").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25_top(texts: DataFrame, key: str, text: str, query: str, pool: int = 20, eligible: DataFrame | None = None) -> DataFrame:
    """The ``pool`` best rows for the OR of the query's terms: key, score, rank from 0.

    Texts are read and cut into words once: the pass counts texts, words and the texts of each term, and keeps
    the rows that hit. Statistics cover all texts; eligibility narrows the candidates before the cut. A key of
    several rows has the score of its best one; null texts and a query without terms give no row.
    """
    terms = list(dict.fromkeys(re.findall(r"[a-z0-9_]+", query.lower())))
    if not terms:
        return texts.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    times = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    words = texts.where(F.col(text).isNotNull()).select(key, V.tokens(F.col(text)).alias("w")).select(
        key, F.size("w").alias("dl"), *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    seen = Observation()
    counted = words.observe(seen, F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    hits = Scratch(texts.sparkSession, "bm25").put(counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))))
    n, total, df = seen.get["n"], seen.get["total"] or 0, [seen.get[f"df{i}"] for i in range(len(terms))]
    length = K1 * (1 - B + B * F.col("dl") / (total / n if n and total else 1.0))
    score = F.lit(0.0)
    for i, d in enumerate(df):
        idf = max(math.log((n - d + 0.5) / (d + 0.5)), LEAST_IDF)
        score = score + F.lit(idf) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + length)
    kept = hits if eligible is None else hits.join(eligible.select(key), key, "left_semi")
    top = kept.groupBy(key).agg(F.max(F.round(score, 6)).alias("score")).orderBy(F.desc("score"), key).limit(pool)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, rank): key, rrf, rank. Ties keep the first list's order."""
    both = first.select(key, F.col("rank").alias("r"), F.lit(0).alias("list")).unionByName(second.select(key, F.col("rank").alias("r"), F.lit(1).alias("list")))
    summed = both.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("r"))).alias("rrf"), F.min(F.col("list") * 1_000_000 + F.col("r")).alias("seen"))
    return summed.select(key, F.round("rrf", 8).alias("rrf"), F.row_number().over(Window.orderBy(F.desc(F.round("rrf", 8)), "seen")).alias("rank")).withColumn("rank", F.col("rank") - 1)


def normalise(ranked: DataFrame, score: str = "rrf", out: str = "rel") -> DataFrame:
    """Min-max scaling to [0, 1]; equal scores all become 1. The ranked list is at most two pools long."""
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return ranked.withColumn(out, F.when(hi <= lo, F.lit(1.0)).otherwise(F.round((F.col(score) - lo) / (hi - lo), 6)))


def _order(*cols: Column) -> Column:
    return F.row_number().over(Window.orderBy(*cols)) - 1


def rerank(ranked: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, pool: int = 30) -> DataFrame:
    """A second scorer reorders the first ``pool`` rows; the tail keeps its order behind them.

    ``score`` maps the head to (key, ce); if it has no score for a row, the row stays behind those that have.
    """
    head = ranked.where(F.col("rank") < pool)
    scored = score(head).select(key, "ce")
    joined = ranked.join(scored, key, "left")
    return joined.withColumn("rank", _order(F.col("ce").isNull(), F.desc_nulls_last("ce"), F.col("rank"))).drop("ce")


def soft_boost(ranked: DataFrame, eligible: DataFrame, key: str, boost: float = 0.15) -> DataFrame:
    """Eligible rows gain ``boost`` relevance; equal relevance keeps the old order."""
    flagged = ranked.join(eligible.select(key).distinct().withColumn("ok", F.lit(True)), key, "left")
    rel = F.round(F.col("rel") + F.when(F.col("ok"), F.lit(boost)).otherwise(0.0), 6)
    return flagged.withColumn("rel", rel).withColumn("rank", _order(F.desc("rel"), F.col("rank"))).drop("ok")


def fill(ranked: DataFrame, eligible_ranked: DataFrame, key: str) -> DataFrame:
    """Eligible rows first, those missing from the list added by their own rank, then all others."""
    inside = ranked.join(eligible_ranked.select(key), key, "left_semi").select(key, F.lit(0).alias("tier"), "rank")
    missing = eligible_ranked.join(ranked.select(key), key, "left_anti").select(key, F.lit(1).alias("tier"), "rank")
    others = ranked.join(eligible_ranked.select(key), key, "left_anti").select(key, F.lit(2).alias("tier"), "rank")
    return inside.unionByName(missing).unionByName(others).select(key, "tier", _order(F.col("tier"), F.col("rank"), F.col(key)).alias("new_rank")).withColumnRenamed("new_rank", "rank")


def filter_mode(mode: str, has_filter: bool, matched: int | None, k: int, guard_min: int | None = None) -> str:
    """hard, soft, fill or off; 'auto' is hard if more records match than are asked for, else fill."""
    if not has_filter or mode == "off":
        return "off"
    if mode != "auto":
        return mode
    return "hard" if (matched or 0) > (guard_min if guard_min is not None else k) else "fill"


def rank_within_parent(passages: DataFrame, parent: str, vector: str, query: list[float], key: str) -> DataFrame:
    """All passages with their rank within the parent by similarity; the best of each parent is rank 0."""
    scored = passages.where(F.col(vector).isNotNull()).select(parent, key, F.round(cosine(vector, query), 6).alias("score")).where("score is not null")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("score"), key)) - 1)


def pin(ranked: DataFrame, best_of_pins: DataFrame, key: str) -> DataFrame:
    """The best passage of each pinned record moves to the front, in the order of the pins (pin_no)."""
    pins = best_of_pins.select(key, "pin_no")
    both = ranked.join(pins, key, "full_outer")
    return both.withColumn("rank", _order(F.col("pin_no").isNull(), F.col("pin_no"), F.col("rank"), F.col(key))).withColumn("pinned", F.col("pin_no").isNotNull()).drop("pin_no")


def assemble(ranked: DataFrame, key: str, parent: str, k: int = 4, max_per_parent: int = 1, min_rel: float = 0.0, n_pins: int = 0) -> DataFrame:
    """At most ``k`` rows with at most ``max_per_parent`` of one parent, relevance floor applied before counting.

    With two or more pinned records each of them gets at most its even share of the k rows.
    """
    kept = ranked.where((F.col("rel") >= min_rel) | F.col("pinned"))
    share = -(-k // n_pins) if n_pins >= 2 else k
    cap = F.when(F.col("pinned_parent"), F.lit(max(1, share))).otherwise(F.lit(max_per_parent)) if n_pins >= 2 else F.lit(max_per_parent)
    flagged = kept.withColumn("pinned_parent", F.max("pinned").over(Window.partitionBy(parent)))
    within = flagged.withColumn("nth", F.row_number().over(Window.partitionBy(parent).orderBy("rank"))).where(F.col("nth") <= cap)
    return within.orderBy("rank").limit(k).select(key, parent, "rel", "pinned", _order(F.col("rank")).alias("rank"))


def digest(passages: DataFrame, parent: str, vector: str, query: list[float], key: str, limit: int = 24, exclude: DataFrame | None = None) -> DataFrame:
    """The best passage of each parent that isn't shown yet, the ``limit`` best of them."""
    open_rows = passages if exclude is None else passages.join(exclude.select(parent).distinct(), parent, "left_anti")
    best = rank_within_parent(open_rows, parent, vector, query, key).where("rank = 0")
    return best.orderBy(F.desc("score"), parent).limit(limit).select(parent, key, "score")


def token_cap(context: DataFrame, text: str, most: int) -> DataFrame:
    """Rows in rank order until the token estimate is used up; the first row always stays. The input is a ranked list of at most k rows."""
    used = F.sum(V.estimated_tokens(F.col(text))).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return context.withColumn("used", used).where((F.col("used") <= most) | (F.col("rank") == 0))


def retrieve(passages: DataFrame, query: str, query_vector: list[float], k: int = 4, pool: int = 20, mode: str = "off",
             eligible: DataFrame | None = None, matched: int | None = None, pins: DataFrame | None = None, n_pins: int = 0,
             max_per_parent: int = 1, min_rel: float = 0.0, boost: float = 0.15,
             reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Composition: passages (row_id, parent_rid, text, embedding) to at most k ranked rows.

    ``eligible`` has (rid); ``pins`` has (rid, pin_no). Pins act after filter modes and always lead; a
    hard filter also holds for pins.
    """
    effective = filter_mode(mode, eligible is not None, matched, k)
    ok = None if eligible is None else passages.join(broadcast_if_small(eligible.select(F.col("rid").alias("parent_rid"))), "parent_rid", "left_semi")
    scope = ok if effective == "hard" else passages
    by_vector = vector_top(scope, "embedding", query_vector, "row_id", pool)
    by_words = bm25_top(passages, "row_id", "text", query, pool, ok.select("row_id") if effective == "hard" else None)
    ranked = normalise(fuse(by_vector, by_words, "row_id"))
    if reranker is not None:
        ranked = rerank(ranked, reranker, "row_id")
    if effective == "soft":
        ranked = soft_boost(ranked, ok, "row_id", boost)
    elif effective == "fill":
        filled = fill(ranked, vector_top(ok, "embedding", query_vector, "row_id", pool), "row_id")
        ranked = filled.join(ranked.select("row_id", "rel"), "row_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    ranked = ranked.select("row_id", "rel", "rank")
    if pins is not None and n_pins:
        own = scope.join(broadcast_if_small(pins.select(F.col("rid").alias("parent_rid"), "pin_no")), "parent_rid")
        best = rank_within_parent(own, "parent_rid", "embedding", query_vector, "row_id").where("rank = 0")
        best = best.join(broadcast_if_small(pins.select(F.col("rid").alias("parent_rid"), "pin_no")), "parent_rid").select("row_id", "pin_no")
        ranked = pin(ranked, best, "row_id").withColumn("rel", F.coalesce("rel", F.lit(1.0)))
    else:
        ranked = ranked.withColumn("pinned", F.lit(False))
    with_parent = passages.select("row_id", "parent_rid").join(broadcast_if_small(ranked), "row_id")
    return assemble(with_parent, "row_id", "parent_rid", k, max_per_parent, min_rel, n_pins)
