"""Passages of records: sentences packed to a size with an overlap, parameter lines packed apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Sizes in characters and the overlap in sentences.
TARGET, PARAMETER_FACTOR, OVERLAP = 900, 1.5, 1
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def pack(title: str | None, text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one record, each led by the title line; a record without text gives one chunk.

    Consecutive prose chunks share ``overlap`` sentences; only a sentence longer than the target, or a
    long carried one, makes a chunk exceed it.
    """
    lines = [ln for ln in (text or "").split("\n") if ln.strip() and not ln.startswith("Title:")]
    parameters = [ln for ln in lines if ln.startswith("Parameter ")]
    prose = " ".join(ln.strip() for ln in lines if not ln.startswith("Parameter "))
    bodies: list[str] = []
    held: list[str] = []
    fresh = False
    for sentence in filter(None, _SENTENCE.split(prose.strip())):
        if held and sum(len(s) + 1 for s in held) + len(sentence) > target:
            bodies.append(" ".join(held))
            held, fresh = held[-overlap:] if overlap else [], False
        held.append(sentence)
        fresh = True
    if held and (fresh or not bodies):
        bodies.append(" ".join(held))
    group: list[str] = []
    for ln in parameters:
        if group and sum(map(len, group)) + len(ln) > target * PARAMETER_FACTOR:
            bodies.append("\n".join(group))
            group = []
        group.append(ln)
    if group:
        bodies.append("\n".join(group))
    head = f"Title: {title}\n" if title else ""
    return [(head + b).strip() for b in bodies] or [(head + (text or "")).strip()]


def chunk(records: DataFrame, rid: str, title: str, text: str) -> DataFrame:
    """(rid, parent_rid, title, text, kind): passages 'parent/j' of every record, made where the record is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.string()), ("parent_rid", pa.string()), ("title", pa.string()), ("text", pa.string()), ("kind", pa.string())])
        for batch in batches:
            rows = []
            for r, t, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for j, c in enumerate(pack(t, x)):
                    rows.append({"rid": f"{r}/{j}", "parent_rid": r, "title": t, "text": c, "kind": "parameters" if "\nParameter " in c or c.startswith("Parameter ") else "prose"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.selectExpr(f"cast({rid} as string) as rid", f"{title} as title", f"{text} as text").mapInArrow(
        run, "rid string, parent_rid string, title string, text string, kind string")
