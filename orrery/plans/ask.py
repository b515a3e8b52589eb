"""A question to an index: plan, filter, retrieve, gather evidence, build the prompt, let a model answer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from orrery.operators import catalogue as cat
from orrery.operators import evidence, fields, filters, names, retrieval
from orrery.plans import planner, prompt
from orrery.sources.index import Index

# Defaults of a question.
DEFAULTS = {"k": 4, "max_context_tokens": 3000, "filter_mode": "auto", "min_rel": 0.0, "disambiguation_threshold": 8}


@dataclass
class Answer:
    stop: str
    reply: str | None = None
    prompt: str | None = None
    system: str | None = None
    plan: dict = field(default_factory=dict)
    contexts: list[dict] = field(default_factory=list)
    table: list[dict] = field(default_factory=list)
    fell_back: bool = False


def parse_json(raw: str) -> dict | None:
    """The first balanced JSON object of a model's reply, fences and words around it ignored."""
    depth, start, quoted, escaped = 0, None, False, False
    for i, ch in enumerate(raw or ""):
        if quoted:
            quoted, escaped = (escaped or ch != '"'), (ch == "\\" and not escaped)
            continue
        if ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    found = json.loads(raw[start:i + 1])
                    return found if isinstance(found, dict) else None
                except ValueError:
                    start = None
    return None


def extract_filter(question: str, spec: str, model: Callable[[str, str], str], retry: bool = True) -> tuple[dict, str]:
    """(filter, status): a model turns the question into a filter over the fields of ``spec``; status is ok, empty or parse_failed."""
    system = "Return one JSON object that filters records by the fields listed. Use only listed fields and labels. Return {} if nothing applies."
    for _ in range(1 + retry):
        found = parse_json(model(system, f"Fields:\n{spec}\n\nQuestion: {question}"))
        if found is not None:
            return found, "ok" if found else "empty"
    return {}, "parse_failed"


def extract_filter_in_two(index: Index, question: str, model: Callable[[str, str], str], min_count: int = 2, most: int = 40,
                          field_aliases: dict[str, str] | None = None) -> tuple[dict, str]:
    """(filter, status) in two passes: first over the fields that partition the records, then over the fields that the
    records left still have, with their ranges there.

    If the first pass finds nothing, the second sees all fields; the clauses of both are merged, the second's first.
    """
    known = index.catalogue_map()
    spec = lambda only, stats=None, kind=None: "\n".join(r["line"] for r in cat.spec_lines(
        index.catalogue, index.labels, stats, kind, only, min_count=min_count, max_fields=most).orderBy("rank").collect())
    partition = [r["field"] for r in cat.partition_fields(index.catalogue, min_count).collect()]
    first, status = extract_filter(question, spec(partition), model) if partition else ({}, "empty")
    clauses = filters.validate(first, known, field_aliases).clauses
    left = filters.eligible(index.fields, clauses)
    fields_left = None if left is None else [r["field"] for r in cat.coverage(index.fields, left).orderBy(F.desc("records"), "field").limit(most).collect()]
    label = next((v for c in clauses.values() for v in c.get("in", []) if len(c["in"]) == 1), None)
    second, status_2 = extract_filter(question, spec(fields_left or None, index.category_stats if label else None, label), model)
    return filters.merge(filters.validate(second, known, field_aliases).clauses, clauses), "ok" if first or second else status_2 if status == "empty" else status


def aliases_of(index: Index, question: str, threshold: int) -> dict[str, list[str]]:
    """Aliases that matter for one question: those that it mentions, and families whose letters stand in it.

    Found by a join with the question's words, so the alias table never reaches the driver; of a family
    one member more than ``threshold`` times eight is enough to know it's ambiguous and to list it.
    """
    asked = index.spark.createDataFrame([("q", question)], "key string, text string")
    named = names.mentions(asked, "key", "text", index.aliases).select("alias", "rid")
    letters = {t.text for t in planner.read(question) if t.text.isalpha() and len(t.text) <= 4 and question[t.start:t.end].isupper()}
    out: dict[str, set[str]] = {}
    for r in named.toLocalIterator():
        out.setdefault(r["alias"], set()).add(r["rid"])
    if letters:
        kin = index.aliases.where(F.regexp_extract("alias", r"^([a-z]+)[- ]?\d", 1).isin(sorted(letters))).select("alias", "rid").orderBy("alias", "rid").limit(8 * (threshold + 1))
        for r in kin.collect():
            out.setdefault(r["alias"], set()).add(r["rid"])
    return {a: sorted(rids) for a, rids in out.items()}


def prepare(index: Index, question: str, embed: Callable[[str], list[float]], explicit: dict | None = None, k: int = 4, mode: str = "auto",
            max_context_tokens: int | None = 3000, min_rel: float = 0.0, threshold: int = 8, field_aliases: dict[str, str] | None = None,
            filter_model: Callable[[str, str], str] | None = None) -> Answer:
    """Everything up to generation. Unknown designations, bare families, exact lookups and subjective criteria stop early."""
    catalogue = index.catalogue_map()
    aliases = aliases_of(index, question, threshold)
    plan = planner.plan(question, catalogue, aliases, field_aliases, explicit)
    shown = asdict(plan) | {"complete": plan.complete}
    titles = index.records.select("rid", "title")
    if unknown := planner.unknown_designations(question, aliases):
        return Answer("unknown_designation", f"No record matches {', '.join(unknown)}.", plan=shown)
    family = planner.ambiguous_family(question, aliases, threshold)
    if family:
        kin = [r["title"] for r in titles.where(F.col("rid").isin(family[1])).collect()]
        return Answer("clarification_required", planner.disambiguation(family[0], kin), plan=shown)
    pins = [rid for rid, _ in plan.entities]
    if plan.route == "exact_entity_field":
        row = evidence.direct_value(index.params, index.fields, pins[0], plan.fields[0]).first()
        if row:
            title = titles.where(F.col("rid") == pins[0]).first()["title"]
            unit = f" {row['unit']}" if row["unit"] and row["unit"] not in row["value"] else ""
            return Answer("deterministic_reply", f"{title}: {plan.fields[0]} = {row['value']}{unit} [{pins[0]}]", plan=shown)
    if any(u.startswith("subjective") for u in plan.unresolved):
        return Answer("clarification_required", "Please name a field or a bound for the criterion.", plan=shown)
    clauses = plan.filter if explicit is not None or plan.complete else {}
    if not clauses and explicit is None and filter_model is not None:
        lines = "\n".join(r["line"] for r in cat.spec_lines(index.catalogue, index.labels, min_count=2, max_fields=60).orderBy("rank").collect())
        raw, _ = extract_filter(question, lines, filter_model)
        clauses = filters.validate(filters.merge(raw, plan.filter), catalogue, field_aliases).clauses
    ok = filters.eligible(index.fields, clauses)
    matched = None if ok is None else ok.count()
    if matched is not None and filters.is_degenerate(index.fields, clauses, catalogue, matched):
        clauses, ok, matched = {}, None, None
    analytic = planner.is_analytic(question, clauses, len(pins))
    effective = "hard" if clauses and plan.complete and analytic else mode
    passages = index.passages.withColumn("row_id", F.col("rid"))
    pin_rows = index.spark.createDataFrame([(r, i) for i, r in enumerate(pins)], "rid string, pin_no int") if pins else None
    vector = embed(question)
    run = lambda e, m: retrieval.retrieve(passages, planner.expand(question), vector, k, mode=m, eligible=e, matched=matched, pins=pin_rows, n_pins=len(pins), min_rel=min_rel).join(
        passages.select("row_id", "title", "text"), "row_id").orderBy("rank").collect()
    got, fell_back = run(ok, effective), False
    if not got and ok is not None:
        got, fell_back = run(None, "off"), True
    contexts = [{"rid": r["parent_rid"], "passage": r["row_id"], "title": r["title"], "text": r["text"], "rank": r["rank"]} for r in got]
    rows, table_rows, digest_rows = [], None, None
    if analytic and (ok is not None or len(pins) >= 2):
        scope = ok if ok is not None else index.spark.createDataFrame([(p,) for p in pins], "rid string")
        cells = fields.rich_params(index.params).select("rid", F.col("name").alias("field"), "value").unionByName(
            index.fields.join(index.params.select("rid", F.col("name").alias("field")).distinct(), ["rid", "field"], "left_anti").groupBy("rid", "field").agg(
                F.array_join(F.sort_array(F.collect_set(F.coalesce("str", F.col("num").cast("string")))), ", ").alias("value")))
        columns = planner.table_columns(question, clauses, catalogue, plan.fields)
        numeric = [c for c in columns if catalogue.get(c, {}).get("type") == "numeric"]
        rows = [r.asDict() for r in evidence.record_table(titles, cells, columns, numeric, ascending=planner.ascending(question), eligible=scope).collect()]
        table_rows = {"rows": rows, "columns": columns, "total": rows[0]["total"] if rows else 0}
    elif ok is not None:
        seen = index.spark.createDataFrame([(c["rid"],) for c in contexts] or [("",)], "parent_rid string")
        best = retrieval.digest(filters.eligible_passages(passages, ok), "parent_rid", "embedding", vector, "row_id", exclude=seen).join(passages.select("row_id", "title", "text"), "row_id").collect()
        digest_rows = {"entries": [{"rid": b["parent_rid"], "title": b["title"], "snippet": b["text"][:200]} for b in best], "remaining": max(0, (matched or 0) - len(contexts) - len(best))}
    relation, kin = [], []
    if pins and planner.asks_relation(question):
        links = index.edges.select(F.coalesce("parent_id", "rid").alias("parent"), F.col("child_id").alias("child"), "relation_type").where("child is not null")
        seeds = titles.where(F.col("rid").isin(pins))
        relation = [r.asDict() for r in evidence.relation_rows(links, seeds.select("rid"), titles).collect()]
        beside = evidence.related(links, seeds, titles)
        best = retrieval.digest(passages.join(beside.select(F.col("rid").alias("parent_rid")), "parent_rid", "left_semi"), "parent_rid", "embedding", vector, "row_id").limit(6)
        near = best.join(passages.select("row_id", "text"), "row_id").select(F.col("parent_rid").alias("rid"), "score", "text").join(beside, "rid").join(titles, "rid")
        kin = [r.asDict() for r in near.orderBy(F.desc("score"), "rid").collect()]
    text = prompt.build(question, contexts, table_rows, digest_rows, related=prompt.related(kin), relation_rows=relation, most=max_context_tokens)
    return Answer("ready" if contexts or rows else "no_records", None, text, prompt.system_for(table_rows is not None), shown, contexts, rows, fell_back)


def ask(index: Index, question: str, embed: Callable[[str], list[float]], model: Callable[[str, str], str], **options) -> Answer:
    """Like :func:`prepare`, then ``model(system, prompt)`` answers; deterministic replies need no model."""
    out = prepare(index, question, embed, **options)
    if out.reply is None:
        out.reply = model(out.system, out.prompt) if out.stop == "ready" else "No records indexed."
    return out
