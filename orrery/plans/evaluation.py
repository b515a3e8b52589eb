"""Evaluation: retrieval hits, filter and answer scores, their aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wording of a refusal, and fields that stand for each other in filters.
REFUSALS = ("not in the context", "no information", "not available", "cannot answer", "can't answer", "unable to answer", "not provided", "unknown",
            "do not have", "don't have", "no record")
EQUIVALENT = (("systemType", "systemGroup", "category"), ("country", "Operated by (country)", "Produced by (country)", "country_of_origin"))


def hit(required: Column, expected: Column, got: Column) -> Column:
    """All required ids present, or any expected id; null if the case names none."""
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return F.when(has(required), F.size(F.array_except(required, got)) == 0).when(has(expected), F.arrays_overlap(expected, got))


def first_rank(targets: Column, got: Column) -> Column:
    """1-based rank of the first target in the ranked ids, null if none is there."""
    places = F.filter(F.transform(targets, lambda t: F.array_position(got, t)), lambda p: p > 0)
    return F.array_min(places)


def score_retrieval(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(id, class, hit, rank, tokens): ``results`` has (id, got array, tokens). A case without a result is a miss."""
    none = F.array().cast("array<string>")
    joined = cases.join(results, "id", "left").withColumn("got", F.coalesce("got", none))
    targets = F.when(F.size(F.coalesce("required_rids", none)) > 0, F.col("required_rids")).otherwise(F.coalesce("expected_rids", none))
    return joined.select("id", "class", hit(F.col("required_rids"), F.col("expected_rids"), F.col("got")).alias("hit"), first_rank(targets, F.col("got")).alias("rank"), "tokens")


def hit_rates(results: DataFrame) -> DataFrame:
    """(class, cases, hit_rate, median, p95) by class and for all, in one pass by grouping sets."""
    shown = results.withColumn("c", F.col("class")).groupingSets([["c"], []], "c").agg(
        F.grouping("c").alias("g"), F.count("*").alias("cases"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"),
        F.round(F.percentile("tokens", F.lit(0.5)), 2).alias("median"), F.round(F.percentile("tokens", F.lit(0.95)), 2).alias("p95"))
    return shown.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("c")).alias("class"), "cases", "hit_rate", "median", "p95")


def over_cap(results: DataFrame, cap: int) -> DataFrame:
    return results.agg(F.count(F.when(F.col("tokens") > cap, 1)).alias("over"), F.count("*").alias("cases"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))


@dataclass
class FilterScore:
    precision: float
    recall: float
    missing: list[str]
    extra: list[str]


def same_field(a: str, b: str) -> bool:
    return a == b or any(a in group and b in group for group in EQUIVALENT)


def clauses_match(expected: dict, got: dict) -> bool:
    """Lenient: labels overlap (equal or one within the other), or bounds of the same side are set."""
    labels = lambda c: [str(x).casefold().strip() for x in (c.get("in") or c.get("contains") or ([c["eq"]] if "eq" in c else []))]
    e, g = labels(expected), labels(got)
    if e or g:
        return any(a == b or a in b or b in a for a in e for b in g)
    sides = ("min", "max", "date_from", "date_to")
    return {s for s in sides if s in expected} == {s for s in sides if s in got}


def score_filter(expected: dict, got: dict) -> FilterScore:
    """Precision and recall over clauses; equivalent fields count as the same."""
    matched_e = [e for e in expected if any(same_field(e, g) and clauses_match(expected[e], got[g]) for g in got)]
    matched_g = [g for g in got if any(same_field(e, g) and clauses_match(expected[e], got[g]) for e in expected)]
    return FilterScore(len(matched_g) / len(got) if got else float(not expected), len(matched_e) / len(expected) if expected else float(not got),
                       sorted(set(expected) - set(matched_e)), sorted(set(got) - set(matched_g)))


def answer_hit(expected: list[str], reply: str) -> bool:
    """Every expected text stands in the reply, by text or by its numbers without thousands commas; a bare number must stand there whole."""
    plain = lambda s: re.sub(r"(?<=\d),(?=\d{3})", "", s.lower())
    low = plain(reply)
    numbers = set(re.findall(r"\d+(?:\.\d+)?", low))
    def found(e: str) -> bool:
        own = re.findall(r"\d+(?:\.\d+)?", e)
        bare = re.fullmatch(r"[-+\s\d.]+", e) is not None
        return (not bare and e in low) or (bool(own) and set(own) <= numbers)

    return all(found(plain(e)) for e in expected)


def is_refusal(reply: str) -> bool:
    return any(k in reply.lower() for k in REFUSALS)


def citations(reply: str, context: list[str]) -> dict[str, list[str]]:
    """Ids cited in brackets, also grouped ones, and those that aren't in the context."""
    cited = [t.strip() for group in re.findall(r"\[([^\[\]]+)\]", reply) for t in group.split(",")]
    rids = list(dict.fromkeys(t for t in cited if t in context or re.search(r"\d", t)))
    return {"cited": rids, "hallucinated": [r for r in rids if r not in context]}


def evidence_present(fields: list[str], contains: list[str], rids: list[str], envelope: str, context: list[str]) -> bool:
    return all(f in envelope for f in fields) and answer_hit(contains, envelope) and set(rids) <= set(context)


def select_cases(cases: DataFrame, ids: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """The asked cases; an unknown id is an error."""
    out = cases
    if ids is not None:
        known = {r["id"] for r in cases.where(F.col("id").isin(ids)).select("id").collect()}
        if missing := sorted(set(ids) - known):
            raise ValueError(f"unknown cases: {', '.join(missing)}")
        out = out.where(F.col("id").isin(ids))
    return out if classes is None else out.where(F.col("class").isin(classes))


def run_case(index, case: dict, embed, model=None, filter_model=None, k: int = 10, most: int | None = 3000) -> dict:
    """One case of an evaluation set through retrieval, filter and answer; stages without a model or expectation are null.

    The ranked ids are those of retrieval without a filter, as for hit rates; the answer goes the way of a user's question.
    """
    from orrery.plans import ask, prompt

    question, answer = case.get("question") or case["query"], case.get("answer") or case.get("expected_answer_contains")
    plain = ask.prepare(index, question, embed, k=k, mode="off", max_context_tokens=most, explicit={})
    got = list(dict.fromkeys(c["rid"] for c in plain.contexts)) or [e[0] for e in plain.plan.get("entities", [])]
    out = {"id": case["id"], "class": case["class"], "got": got, "tokens": prompt.tokens(plain.prompt or ""), "required_rids": case.get("required_rids") or [], "expected_rids": case.get("expected_rids") or [],
           "filter_precision": None, "filter_recall": None, "answer_hit": None, "refused": None, "hallucinated": None}
    if case.get("filter") is not None and filter_model is not None:
        found, _ = ask.extract_filter_in_two(index, question, filter_model)
        score = score_filter(case["filter"], found)
        out |= {"filter_precision": score.precision, "filter_recall": score.recall}
    if model is not None:
        reply = ask.ask(index, question, embed, model, k=k, max_context_tokens=most)
        shown = [c["rid"] for c in reply.contexts] + [r["rid"] for r in reply.table]
        out |= {"answer_hit": answer_hit(answer, reply.reply) if answer else None, "refused": is_refusal(reply.reply),
                "hallucinated": len(citations(reply.reply, shown)["hallucinated"])}
    return out


def aggregate_stages(results: DataFrame) -> DataFrame:
    """(class, cases, filter_precision, filter_recall, answer_rate, refusal_rate, hallucinated) by class and for all."""
    shown = results.withColumn("c", F.col("class")).groupingSets([["c"], []], "c").agg(
        F.grouping("c").alias("g"), F.count("*").alias("cases"), F.round(F.avg("filter_precision"), 4).alias("filter_precision"), F.round(F.avg("filter_recall"), 4).alias("filter_recall"),
        F.round(F.avg(F.col("answer_hit").cast("double")), 4).alias("answer_rate"), F.round(F.avg(F.col("refused").cast("double")), 4).alias("refusal_rate"), F.sum("hallucinated").alias("hallucinated"))
    return shown.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("c")).alias("class"), *[c for c in shown.columns if c not in ("c", "g")])


_RESULT = ("id string, class string, got array<string>, tokens int, required_rids array<string>, expected_rids array<string>, filter_precision double, filter_recall double, "
           "answer_hit boolean, refused boolean, hallucinated int")


def run_eval(index, cases: DataFrame, embed, model=None, filter_model=None, k: int = 10, most: int | None = 3000, ids: list[str] | None = None,
             classes: list[str] | None = None, checkpoint: str | None = None) -> dict[str, DataFrame]:
    """{results, rates, stages} of an evaluation set: (id, class, question or query, required_rids, expected_rids, filter, answer).

    Cases are questions, few by nature, and run one after the other, as questions do. With ``checkpoint`` each result is
    appended to that JSON-lines file, and cases that stand there already aren't run again.
    """
    import json
    import os

    done: dict[str, dict] = {}
    if checkpoint and os.path.exists(checkpoint):
        with open(checkpoint, encoding="utf-8") as f:
            done = {r["id"]: r for r in map(json.loads, f)}
    for row in select_cases(cases, ids, classes).orderBy("id").toLocalIterator():
        case = row.asDict(recursive=True)
        if case["id"] in done:
            continue
        done[case["id"]] = run_case(index, case, embed, model, filter_model, k, most)
        if checkpoint:
            with open(checkpoint, "a", encoding="utf-8") as f:
                f.write(json.dumps(done[case["id"]]) + "\n")
    columns = [part.split(" ")[0] for part in _RESULT.split(", ")]
    results = index.spark.createDataFrame([tuple(r[c] for c in columns) for r in done.values()], _RESULT)
    scored = score_retrieval(results.select("id", "class", "required_rids", "expected_rids"), results.select("id", "got", "tokens"))
    return {"results": results, "rates": hit_rates(scored), "stages": aggregate_stages(results)}


def unknown_filter_fields(cases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(id, field): fields of expected filters (a map) that the catalogue doesn't have."""
    return cases.where(F.col("filter").isNotNull()).select("id", F.explode(F.map_keys("filter")).alias("field")).join(catalogue.select("field"), "field", "left_anti").select("id", "field")


def stratified(rows: DataFrame, group: str, key: str, n: int = 2, seed: int = 0) -> DataFrame:
    """``n`` rows of each group by a seeded hash of the key; the window is limited before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(f"__r <= {n}").drop("__r")
