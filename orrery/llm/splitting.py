"""Splitting oversized items at natural boundaries, by ranges with halos.

A text (or a giant file) is processed in ranges. A worker sees its range and a halo on either side,
detects sentence and paragraph boundaries there, and takes as its own the stretch from the first
boundary at or after the start of its range to the first one at or after its end. Whether a place is a
boundary depends on ``CONTEXT`` code points around it only, which both neighbours of a border see; so
their boundary tables agree at the border and no worker needs a whole text. Offsets of later ranges
come from the prefix sums of range lengths.

Within its stretch a worker packs whole sentences into pieces of at most ``limit`` code points. The
next piece begins with the last sentence of the one before wherever both fit. A sentence longer than
the limit is cut at the last line break, blank or clause mark that fits, or at the limit where there is
none; as no whole sentence fits beside it, such pieces share nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.sentences import _END, _GERMAN, _THAI, Weights, _classes, _thai_classes, fit
from orrery.plans.runtime import Scratch

LIMIT = 900
CONTEXT = 64
_BREAK = re.compile(r"\n[^\S\n]*\n\s*|\n(?=[^\S\n]*(?:[-*•]|\d{1,3}[.)]|Parameter )[^\S\n]*)")
_BLANKS = re.compile(r"(?<=\S)\s+(?=\S)")
_SOFT = re.compile(r"[\s，、；：,;:।。]")


def boundaries(text: str, lo: int, hi: int, weights: Weights | None = None) -> list[int]:
    """Starts of sentences, paragraphs and list lines in [lo, hi).

    Each place is judged by the ``CONTEXT`` code points on either side (runs of marks or blanks longer
    than that are no boundary), by the closing and opening weights fitted to decide on their own.
    """
    of = (weights or fit(joint=False)).of
    a = max(0, lo - 2 * CONTEXT)
    found = {m.end() for m in _BREAK.finditer(text, a, hi) if m.end() - m.start() <= CONTEXT}
    end = min(len(text), hi + CONTEXT)

    def ends(closing: str, opening: str) -> bool:
        return of.get("closing " + closing, 0.0) + of.get("opening " + opening, 0.0) > 0

    for m in _END.finditer(text, a, end):
        s, e = m.span()
        if e < len(text) and e - s <= CONTEXT and ends(*_classes(text, m, [_GERMAN.search(text, max(0, s - CONTEXT), s + CONTEXT) is not None] if text[s - 1:s].isdigit() else [])):
            found.add(e)
    if _THAI.search(text, a, end):
        for m in _BLANKS.finditer(text, a, end):
            if m.end() < len(text) and m.start() > 0 and m.end() - m.start() <= CONTEXT and ends(*_thai_classes(text, m.start(), m.end())):
                found.add(m.end())
    return sorted(p for p in found if lo <= p < hi)


def pack(text: str, begin: int, end: int, cuts: list[int], before: int | None, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Pieces (start, stop) that cover [begin, end): stops at boundaries ``cuts`` where possible.

    ``before`` is the start of the sentence that precedes ``begin``, which the first piece repeats if it fits.
    """
    marks = [begin, *(c for c in cuts if begin < c < end), end]
    pieces: list[tuple[int, int]] = []
    k = 0  # marks[k] is the first place not yet covered
    lead = before
    while marks[k] < end:
        fresh = marks[k]
        start = lead if lead is not None and lead < fresh and marks[k + 1] - lead <= limit else fresh
        if marks[k + 1] - start > limit:
            stop = _soft_cut(text, fresh, limit)
            pieces.append((fresh, stop))
            marks[k] = stop
            lead = None
            continue
        while k + 1 < len(marks) and marks[k + 1] - start <= limit:
            k += 1
        pieces.append((start, marks[k]))
        lead = marks[k - 1] if k else None
    return pieces


def _soft_cut(text: str, start: int, limit: int) -> int:
    """The last line break, blank or clause mark in the second half of the window, else the limit itself."""
    stop = start + limit
    for at in range(stop, start + limit // 2, -1):
        if _SOFT.match(text, at - 1):
            return at
    return stop


def split_range(chunk: str, offset: int, lo: int, hi: int, total: int, limit: int = LIMIT, weights: Weights | None = None) -> list[tuple[int, int]]:
    """Pieces of one range in absolute positions. ``chunk`` starts at ``offset`` of the whole text of
    ``total`` code points; the range is [lo, hi)."""
    cuts = boundaries(chunk, 0, len(chunk), weights)

    def border(at: int) -> int:
        if at <= 0 or at >= total:
            return min(max(at, 0), total)
        own = next((c for c in cuts if at - offset <= c < at - offset + limit), None)
        return at if own is None else own + offset

    begin, end = border(lo), border(hi)
    if begin >= end:
        return []
    earlier = [c for c in cuts if c < begin - offset]
    before = earlier[-1] if earlier else None
    made = [(a + offset, b + offset) for a, b in pack(chunk, begin - offset, end - offset, cuts, before, limit)]
    if end < total and len(made) > 1:
        # the next range repeats the sentence before its border; a last piece of just that sentence would lie inside its first piece
        last = max(c for c in (*cuts, begin - offset) if c < end - offset) + offset
        after = next((c for c in cuts if c > end - offset), len(chunk))
        if made[-1][0] == last and after + offset - last <= limit:
            made.pop()
    return made


def split_texts(rows: DataFrame, key: str, text: str, limit: int = LIMIT, range_chars: int = 1 << 16,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: key, ``keep`` columns, range_no, start_pos, end_pos, total, piece.

    A text within the limit is one piece; empty texts are one empty piece; null texts give no row.
    Repeated rows are split each. A text is cut into ranges of ``range_chars`` code points in one pass
    in the JVM, and only ranges with their halos are passed on, so Python never holds more than one
    range of a giant text and the work is linear in its length. No shuffle is needed.
    """
    halo = 2 * limit + 2 * CONTEXT
    whole = F.array(F.col("__text"))
    parts = F.when(F.col("__n") <= range_chars, whole).otherwise(F.expr(f"regexp_extract_all(__text, '(?s).{{1,{range_chars}}}', 0)"))
    named = rows.where(f"{text} is not null").select(
        F.col(key).alias("__key"), *[F.col(c) for c in keep], F.col(text).alias("__text"), F.length(text).alias("__n"))
    cut = named.withColumn("__parts", parts).drop("__text").withColumn(
        "__chunks", F.expr(f"""transform(__parts, (x, i) -> struct(
            i as no,
            concat(if(i > 0, right(get(__parts, i - 1), {halo}), ''), x, coalesce(left(get(__parts, i + 1), {halo}), '')) as chunk))"""))
    chunks = cut.select("__key", F.explode("__chunks").alias("__c"), F.col("__n").alias("total"), *keep).select(
        "__key", F.col("__c.no").alias("range_no"), "total",
        F.greatest(F.col("__c.no") * range_chars - halo, F.lit(0)).cast("int").alias("offset"), F.col("__c.chunk").alias("chunk"), *keep)
    weights = fit(joint=False)
    out_type = chunks.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, total, offs, chunk = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            index: list[int] = []
            begin: list[int] = []
            stop: list[int] = []
            texts: list[str] = []
            for i, (r, t, o, c) in enumerate(zip(no, total, offs, chunk)):
                if t <= limit:
                    found = [(0, t)]
                else:
                    found = split_range(c, o, r * range_chars, min((r + 1) * range_chars, t), t, limit, weights)
                for a, b in found:
                    index.append(i)
                    begin.append(a)
                    stop.append(b)
                    texts.append(c[a - o:b - o])
            at = pa.array(index, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()),
                       batch.column(2).take(at), *[batch.column(5 + k).take(at) for k in range(len(keep))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())],
                                             names=[key, "range_no", "start_pos", "end_pos", "total", *keep, "piece"])

    kinds = {f.name: f.dataType.simpleString() for f in out_type}
    schema = f"{key} {kinds['__key']}, range_no int, start_pos int, end_pos int, total int"
    schema += "".join(f", {c} {kinds[c]}" for c in keep) + ", piece string"
    return chunks.mapInArrow(run, schema)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or a URI of the shared storage."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, range_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of UTF-8 files on storage that all workers reach, read by byte ranges: path, start_pos, end_pos, piece.

    Workers seek to their range plus halos; no task reads a whole file. Positions in code points come
    from the prefix sums of the ranges' lengths. Empty files give no row.
    """
    halo = 4 * (2 * limit + 2 * CONTEXT)
    sizes = [(p, _open(p)[0].get_file_info(_open(p)[1]).size or 0) for p in paths]
    files = spark.createDataFrame([r for r in sizes if r[1]], "path string, size long")
    ranges = files.select("path", F.explode(F.expr(f"transform(sequence(0L, (size - 1) div {range_bytes}), x -> cast(x as int))")).alias("range_no"), "size")
    spread = min(4096, sum(-(-n // range_bytes) for _, n in sizes)) or 1
    ranges = ranges.repartition(spread)
    weights = fit(joint=False)

    def read(path: str, a: int, b: int) -> bytes:
        system, place = _open(path)
        with system.open_input_file(place) as f:
            return f.read_at(b - a, a)

    def text(raw: bytes, first: bool) -> str:
        skip = 0
        while not first and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
            skip += 1
        return raw[skip:].decode("utf-8", errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, no, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lo, hi = no * range_bytes, min((no + 1) * range_bytes, size)
                a, b = max(0, lo - halo), min(size, hi + halo)
                raw = read(path, a, b)
                # a code point cut by the range's end belongs to the range in which it begins
                stop = hi - a
                while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                    stop += 1
                first = lo - a
                while lo and raw[first] & 0xC0 == 0x80:
                    first += 1
                head, body, tail = text(raw[:first], a == 0), text(raw[first:stop], True), text(raw[stop:], True)
                chunk = head + body + tail
                n = len(head) + len(body)
                total = n + len(tail) if b == size else n + len(tail) + limit
                pieces = split_range(chunk, 0, len(head) if no else 0, n, total, limit, weights)
                out.append({"path": path, "range_no": no, "n": len(body),
                            "pieces": [{"a": s - len(head), "b": e - len(head), "t": chunk[s:e]} for s, e in pieces]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("path", pa.string()), ("range_no", pa.int32()), ("n", pa.int64()),
                ("pieces", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("t", pa.string())])))]))

    done = Scratch(spark, "split").put(ranges.mapInArrow(
        run, "path string, range_no int, n long, pieces array<struct<a:long,b:long,t:string>>"))
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.select("path", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return done.select("path", "range_no", F.explode("pieces").alias("p")).join(offsets, ["path", "range_no"]).select(
        "path", (F.col("offset") + F.col("p.a")).alias("start_pos"), (F.col("offset") + F.col("p.b")).alias("end_pos"), F.col("p.t").alias("piece"))
